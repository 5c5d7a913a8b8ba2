"""Versioned prefixes, snapshots, kept aggregates and the algebra's own functions."""

import pytest

from quillgrid.operators import aggregate as A
from quillgrid.operators import diff as D
from quillgrid.operators.query import deserialize
from quillgrid.plans import ir
from quillgrid.plans.ir import Tag, Type, no
from quillgrid.sources.prefix import Workspace


def ids(q):
    return sorted(r["oid"] for r in q.ids().collect())


@pytest.fixture(scope="module")
def prefix(spark, tmp_path_factory):
    ws = Workspace(spark, str(tmp_path_factory.mktemp("ws")))
    p = ws.open("main")
    rows = spark.createDataFrame([(i, ["one", "two", "three"][i % 3], i) for i in range(10)], "oid long, key string, value long")
    p.put("kv", rows)
    p.tag(rows, "tag1")
    p.tag(rows.filter("oid % 2 = 0"), "tag2")
    p.index("ix", rows.selectExpr("if(oid = 3, null, value) key", "oid"))
    assert p.commit() == 1 and p.commit() == 1
    p.put("kv", spark.createDataFrame([(10, "one", 10), (11, "three", 11)], "oid long, key string, value long"))
    p.tag(spark.range(10, 12).withColumnRenamed("id", "oid"), "tag1")
    p.tag(spark.range(1, 2).withColumnRenamed("id", "oid"), "tag1", remove=True)
    p.assign("kv", spark.range(2, 3).withColumnRenamed("id", "oid"), value=200)
    assert p.commit() == 2
    return p


def test_find_over_states(prefix):
    now, old = prefix.snapshot(), prefix.snapshot(1)
    assert ids(old.find(Type("kv"), "tag1")) == list(range(10)) and ids(now.find("tag1")) == [0, *range(2, 12)]
    assert ids(now.find(Type("kv"), "tag2", no("tag1"))) == [] and ids(now.find(Type("kv"), no("tag1"))) == [1]
    assert ids(now.select("ix", None, 5)) == [0, 1, 2, 4, 5] and ids(now.select("ix", None, 5, True)) == [0, 1, 2, 3, 4, 5]
    assert ids(now.select("ix", 2, None, True)) == [2, 4, 5, 6, 7, 8, 9]
    assert now.sort("ix", now.find("tag2"), desc=True)[0:2].ordered().select("oid").collect()[0][0] == 8
    assert now.find("tag2")[0, 1] == [8, 6]


def test_diffs(prefix):
    now, old = prefix.snapshot(), prefix.snapshot(1)
    q = now.find("tag1")
    assert sorted(r[0] for r in D.select_new(q, old, now).collect()) == [10, 11]
    assert [r[0] for r in D.select_deleted(q, old, now).collect()] == [1]
    assert [(r.oid, r.old.value, r.new.value) for r in D.select_modified(q, old, now, "kv").collect()] == [(2, 2, 200)]


def test_kept_aggregate_equals_full(prefix):
    fast, ops = A.FastQuery(), [A.count_op, A.make_sum("value")]
    for state in (1, 2):
        v = prefix.snapshot(state)
        got = sorted(map(tuple, fast.group_by(v, ["key"], v.find("tag1"), "kv", ops).collect()))
        assert got == sorted(map(tuple, A.group_by(v, ["key"], v.find("tag1"), "kv", ops).collect()))
    assert [r[:2] for r in got] == [("one", 5), ("three", 4), ("two", 2)]


def test_workspace(prefix):
    ws = prefix.ws
    ws.copy_prefix("main", "copy")
    assert ws.get_prefixes() == ["copy", "main"] and ws.open("copy", "r").get_state_num() == 2
    with pytest.raises(FileExistsError):
        ws.copy_prefix("main", "copy")
    with pytest.raises(PermissionError):
        ws.open("copy", "r").tag(prefix.spark.range(1).withColumnRenamed("id", "oid"), "x")
    ws.drop("copy")
    assert ws.get_prefixes() == ["main"]
    assert prefix.fetch("kv", 2)["value"] == 200 and prefix.exists("kv", 11) and not prefix.exists("kv", 99)


def test_algebra(prefix):
    v = prefix.snapshot()
    a, b = v.find(Type("kv"), "x", ["y", "z"]), v.find(Type("kv"), ["z", "y"], "x")
    assert a.signature() == b.signature() and a.compare(b) == 0 and a.compare(v.find("w")) > 0
    assert deserialize(v, a.serialize()).ir == a.ir
    with pytest.raises(ValueError):
        v.find(no("x"))
    with pytest.raises(NotImplementedError):
        ir.term((Tag("x"), no("y")))
    with pytest.raises(ValueError):
        v.find(v.sort("ix", v.find("tag1")))
