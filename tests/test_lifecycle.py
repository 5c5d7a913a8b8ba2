"""Changes, loading, waiting, locks, enumerations, stored queries and kept results."""

import asyncio
import time
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.functions.enums import Enum, is_enum, is_enum_value
from quillgrid.functions.text import taggify
from quillgrid.operators import aggregate as A
from quillgrid.operators import diff as D
from quillgrid.operators.query import View
from quillgrid.plans import ir
from quillgrid.plans.ir import Ids, Type, no
from quillgrid.plans.reflection import Registry, complete_with, immutable, noted
from quillgrid.sources.prefix import Workspace


@pytest.fixture
def ws(spark, tmp_path):
    return Workspace(spark, str(tmp_path))


def rows(spark, *values):
    return spark.createDataFrame([(i, v, i + 100) for i, v in values], "oid long, value long, friend long")


def ids(q):
    return sorted(r["oid"] for r in q.ids().collect())


def test_load_and_loaders(spark, ws):
    p = ws.open("a")
    p.put("thing", rows(spark, (1, 10), (2, 20)))
    p.put("friend", spark.createDataFrame([(101, "x", 1), (102, "y", 2)], "oid long, name string, back long"))
    p.commit()
    assert p.load("thing", 1, exclude=["friend", "version"]) == {"oid": 1, "value": 10}
    assert p.load("thing", 1, references={"friend": "friend"})["friend"]["name"] == "x"
    assert p.load("friend", 101, references={"back": "thing", "friend": "friend"})["back"]["friend"] == 101  # a cycle ends at an id
    p.loaders["thing"] = lambda row: row["value"]
    assert sorted(p.load_all(p.find(Type("thing")), "thing")) == [10, 20] and p.load("thing", 2) == 20
    assert p.classes() == ["friend", "thing"] and p.attributes("friend") == [("name", "string"), ("back", "bigint")]
    assert {r["table"] for r in p.storage_stats().filter("bytes > 0").collect()} >= {"objects_thing", "objects_friend"}
    with pytest.raises(KeyError):
        p.fetch("thing", 3)
    assert p.find_singleton("none") is None


def test_renames_migrations_and_removed_attributes(spark, ws):
    p = ws.open("a")
    p.put("thing", rows(spark, (1, 10), (2, 20)))
    p.index("ix", spark.createDataFrame([(5, 1), (6, 2)], "key long, oid long"))
    p.commit()
    p.rename_field("thing", "value", "worth")
    p.commit()
    p.migrate("thing", lambda df: df.selectExpr("oid", "worth * 2 worth", "friend"))
    p.commit()
    p.remove_attributes("thing", spark.createDataFrame([(2,)], "oid long"), "friend")
    p.index_clear("ix")
    p.commit()
    assert [(r.oid, r.worth, r.friend) for r in p.snapshot().types["thing"].orderBy("oid").collect()] == [(1, 20, 101), (2, 40, None)]
    assert "value" in p.snapshot(1).types["thing"].columns and p.index_len("ix") == 0
    with D.SnapshotWindow(p, None, 3) as (before, after):
        assert before.state == 1 and after.state == 3


def test_waiting_and_closing(spark, ws):
    p, reader = ws.open("a"), ws.open("a")
    assert not reader.refresh() and not p.wait(1, 0)
    p.put("thing", rows(spark, (1, 10)))
    assert p.get_state_num(finalized=False) == 1 and p.get_state_num() == 0
    p.autocommit(0.05)
    assert asyncio.run(p.await_commit(60)) and reader.wait(1, 60) and reader.refresh() and not reader.refresh()
    end = time.time() + 30
    while p._staged and time.time() < end:
        time.sleep(0.05)
    ws.close("a")
    reader.close()
    with pytest.raises(PermissionError):
        reader.put("thing", rows(spark, (2, 1)))
    with pytest.raises(FileNotFoundError):
        ws.drop("none", if_exists=False)


def test_atomic_and_locked(spark, ws):
    p = ws.open("a")
    with pytest.raises(ZeroDivisionError), p.atomic():
        p.put("thing", rows(spark, (1, 10)))
        1 / 0
    assert p.commit() == 0
    with p.locked(await_commit=True) as log:
        with p.atomic():
            p.put("thing", rows(spark, (1, 10)))
            with pytest.raises(RuntimeError):
                p.commit()
    assert log == [("a", 1)] and p._mutations == []


def test_kept_results_are_told_apart(spark, ws):
    """By prefix, type and functions; and the nearest one gives the same as a full one."""
    fast, views = A.FastQuery(), []
    for name, n in (("a", 3), ("b", 7)):
        p = ws.open(name)
        p.put("thing", rows(spark, *[(i, i % 2) for i in range(n)]))
        p.put("other", rows(spark, *[(i, 0) for i in range(50, 52)]))
        p.tag(spark.range(n).withColumnRenamed("id", "oid"), "t")
        p.tag(spark.range(2).withColumnRenamed("id", "oid"), "u")
        p.commit()
        views.append(p.snapshot())
    count = lambda v, *terms, groups=("1",), kind="thing": sorted(r["count"] for r in fast.group_by(v, list(groups), v.find(*terms), kind).collect())
    assert [count(v, Type("thing")) for v in views] == [[3], [7]] and count(views[0], Type("other"), kind="other") == [2]
    odd, one = A.Key(lambda r: r.value % 2, "long"), A.Key(lambda r: 1, "long")
    assert count(views[1], Type("thing"), groups=[odd]) == [3, 4] and count(views[1], Type("thing"), groups=[one]) == [7]
    v = views[1]
    q = v.find(Type("thing"), ["t", "u", "w"])
    near = v.find(Type("thing"), ["t", "u", "w", "x"])
    shape = fast.shape(v, "thing", ["value"], (A.count_op,))
    fast.group_by(v, ["value"], q, "thing")
    assert ir.compare(q.ir, near.ir) < fast.NEAR and fast.nearest(shape, near.ir) is not None and fast.nearest(shape, v.find("zzz").ir) is None
    got = sorted(map(tuple, fast.group_by(v, ["value"], near, "thing").collect()))
    assert got == sorted(map(tuple, A.group_by(v, ["value"], near, "thing").collect()))


def test_merged_custom_op_equals_the_grouped_one(spark, ws):
    p = ws.open("a")
    p.put("thing", rows(spark, *[(i, None if i % 5 == 0 else i % 3) for i in range(40)]).repartition(4))
    p.commit()
    v = p.snapshot()
    step, q = (lambda state, row: state + row.oid), v.find(Type("thing"))
    plain, merged = A.CustomOp("total", 0, step, "long"), A.CustomOp("total", 0, step, "long", lambda a, b: a + b, ("oid",))
    want = sorted(map(repr, A.group_by(v, ["value"], q, "thing", [A.make_sum("oid", "total")]).collect()))
    assert [sorted(map(repr, A.group_by(v, ["value"], q, "thing", [op]).collect())) for op in (plain, merged)] == [want, want]


def test_enums():
    colours = Enum("Colours", ["RED", "GREEN"])
    assert [v.name for v in colours.values()] == ["RED", "GREEN"] and len(colours) == 2 and colours.RED == colours["RED"] == colours[0]
    assert colours.deserialize(colours.GREEN.serialize()) == Enum("Colours", ["GREEN"]).GREEN and hash(colours.GREEN) == hash(Enum("Colours", ["GREEN"]).GREEN)
    assert is_enum(colours) and is_enum_value(colours.RED) and not is_enum(colours.RED) and colours.RED != Enum("Other", ["RED"]).RED
    for bad in (lambda: colours.BLUE, lambda: Enum("X", ["a", "a"]), lambda: colours.deserialize("Other.RED")):
        with pytest.raises((AttributeError, ValueError)):
            bad()


def test_registry():
    registry, done = Registry(), lambda: 1

    @registry.query
    @immutable
    @complete_with(done)
    def cheap(most: int, kind="x"):
        return (most, kind)

    q = registry.get("cheap")
    assert q(3) == (3, "x") and [(p.name, p.kind, p.default, p.required) for p in q.parameters()] == [("most", "int", None, True), ("kind", "", "x", False)]
    assert registry.names(immutable=True) == ["cheap"] and registry.names(fulltext=True) == [] and noted(cheap, "complete_with") is done


@pytest.mark.parametrize("text, how, want", [("--Mińsk Mazowiecki", {"max_len": 4}, ["MINS", "MAZO"]), ("A.Kowalski", {"min_len": 3}, ["KOW"]), ("A/B x_y (z)", {}, ["AB", "XY", "Z"]), ("15-593", {"max_len": None}, ["15", "593"]), ("Zażółć Gęślą Jaźń", {"suffix": True}, ["OLC", "SLA", "AZN"]), ("ab cd!\"'?", {}, ["AB", "CD"]), ("", {}, [])])
def test_taggify(spark, text, how, want):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(text,)], "t string").select(taggify(F.col("t"), **how).alias("x")).first()["x"] == want


def test_find_without_criteria_and_pick(spark, ws):
    p = ws.open("a")
    p.put("thing", rows(spark, *[(i, i) for i in range(5)]))
    p.commit()
    v = p.snapshot()
    assert ids(v.find()) == [] and len(v.find()) == 0 and not v.find() and 3 in v.find(Type("thing")) and 9 not in v.find(Type("thing"))
    assert v.find(Type("thing"))[0, 4] == [4, 0] and ids(v.find(Type("thing"), no(v.find()))) == list(range(5))
    with pytest.raises(IndexError):
        v.find(Type("thing"))[5]


def test_join_deals_one_tag_objects_tuples_over_tasks(spark, tmp_path):
    """A tag object with more members than blocks hold: every tuple as often as its tags, and no task makes most of them."""
    n = {"a": 600, "b": 2, "c": 1100}
    types = {t: spark.range(1000 * i, 1000 * i + k, 1, 1).select(F.col("id").alias("oid")) for i, (t, k) in zip((1, 3, 5), n.items(), strict=True)}
    types["key"] = spark.createDataFrame([(7,), (8,)], "oid long")
    extra = spark.createDataFrame([(1000, "8"), (3000, "8"), (3000, "8"), (5000, "8")], "oid long, key string")  # 3000 carries 8 twice
    tags = reduce(DataFrame.union, [types[t].select("oid", F.lit("7").alias("key")) for t in n], extra)
    tags.select("oid", F.lit("obj").alias("kind"), F.lit("").alias("scope"), "key").coalesce(1).write.parquet(f"{tmp_path}/tags")
    v = View(types, spark.read.parquet(f"{tmp_path}/tags"))
    out = v.join(*map(Type, n), on=v.find(Type("key")))
    got = out.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in got) == 600 * 2 * 1100 + 2
    assert max(r["count"] for r in got) <= 256 * 2 * 1024
    often = out.groupBy("oid_1", "oid_2", "oid_3").count().groupBy("count").agg(F.count("*").alias("n"), F.sum("oid_1"), F.sum("oid_2"), F.sum("oid_3")).collect()
    s = [sum(range(b, b + k)) for b, k in zip((1000, 3000, 5000), n.values(), strict=True)]
    assert sorted(map(tuple, often)) == [
        (1, 600 * 2 * 1100 - 1, s[0] * 2200 - 1000, s[1] * 660_000 - 3000, s[2] * 1200 - 5000),
        (3, 1, 1000, 3000, 5000),
    ]


def test_join_of_one_side_and_of_none_found(spark):
    objects = spark.createDataFrame([(1,), (2,), (3,)], "oid long")
    tags = spark.createDataFrame([(1, "obj", "", "9"), (2, "obj", "", "9"), (3, "obj", "", "4")], "oid long, kind string, scope string, key string")
    v = View({"a": objects, "key": spark.createDataFrame([(9,)], "oid long")}, tags)
    on = v.find(Type("key"))
    assert sorted(r.oid_1 for r in v.join(Type("a"), on=on).collect()) == [1, 2]
    assert v.join(Type("a"), Type("a"), on=v.find(Type("key"), Ids((8,)))).isEmpty()
