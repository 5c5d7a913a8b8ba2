"""Lazy queries over a view of tagged objects, lowered to DataFrames of object ids."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import ir
from ..plans.ir import And, At, Filter, Ids, Not, Or, Range, Slice, Sort, Split, Tag, Type, term


#: Up to so many places a top-k numbers them in one task; beyond, places come from a range-partitioned sort.
TOP = 100_000

#: Members of a tag object that a join takes at once: of its last side, and of the others.
LAST, BLOCK = 1024, 256


class View:
    """What queries read: objects by type (oid, attributes), tags (oid, kind, scope, key), indexes (key, oid).

    ``parents`` maps a class to its base.  ``earlier`` gives the view of an earlier state.  ``name`` tells views of
    different prefixes apart.  ``type_of`` names the type of an id where the id itself tells it.
    """

    def __init__(self, objects: dict[str, DataFrame], tags: DataFrame | None = None, indexes: dict[str, DataFrame] | None = None, parents: dict[str, str] | None = None, earlier: Callable[[int], View] | None = None, state: int | None = None, name: str = "", type_of: Callable[[int], str | None] | None = None):
        self.types, self.tag_rows, self.indexes, self.parents, self.earlier, self.state = objects, tags, indexes or {}, parents or {}, earlier, state
        self.name, self.type_of = name, type_of

    def nothing(self) -> DataFrame:
        some = next(iter(self.types.values()), self.tag_rows)
        return some.sparkSession.createDataFrame([], "oid long")

    def reference_counts(self, name: str) -> DataFrame:
        """(oid, n) of a type's objects: how many objects carry each as a tag."""
        held = self.tag_rows.filter("kind = 'obj'").groupBy(F.col("key").cast("long").alias("oid")).agg(F.count(F.lit(1)).alias("n"))
        return self.ids_of(name).join(held, "oid", "left").select("oid", F.coalesce("n", F.lit(0)).cast("long").alias("n"))

    def instance_count(self, name: str) -> int:
        """Objects of a class and its subclasses."""
        return self.ids_of(name).count()

    def expired(self, refs: DataFrame) -> DataFrame:
        """Of ``refs`` (oid) those whose object no longer exists: what weak proxies to them would find."""
        every = reduce(DataFrame.union, [t.select("oid") for t in self.types.values()], self.nothing())
        return refs.join(every, "oid", "left_anti")

    def closure(self, name: str) -> list[str]:
        """A class and its subclasses."""
        out = [name]
        for t in out:
            out += [c for c, p in self.parents.items() if p == t]
        return out

    def ids_of(self, name: str) -> DataFrame:
        found = [self.types[t].select("oid") for t in self.closure(name) if t in self.types]
        if not found:
            raise KeyError(f"unknown type {name}")
        return reduce(DataFrame.union, found)

    def objects(self, name: str) -> DataFrame:
        found = [self.types[t] for t in self.closure(name) if t in self.types]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)

    def tagged(self, tags: Sequence[Tag]) -> DataFrame:
        """Rows of tags that are among ``tags``; equality on kind and key reaches the scan."""
        by: dict[tuple[str, str], list[str]] = {}
        for t in tags:
            by.setdefault((t.kind, t.scope), []).append(t.key)
        match = reduce(Column.__or__, [(F.col("kind") == k) & (F.col("scope") == s) & F.col("key").isin(keys) for (k, s), keys in by.items()])
        return self.tag_rows.filter(match)

    # queries

    def find(self, *criteria: Any) -> Query:
        """Objects that meet all criteria; only the first may be a type, and negation needs a positive part."""
        terms = tuple(term(c) for c in criteria)  # none at all find nothing
        if any(isinstance(t, Sort) or (isinstance(t, Slice) and isinstance(t.query, Sort)) for t in terms):
            raise ValueError("Invalid object iterator: a sorted query is not a criterion")
        if any(isinstance(t, Type) for t in terms[1:]):
            raise ValueError("only the first criterion can be a type")
        if terms and all(isinstance(t, Not) for t in terms):
            raise ValueError("negation without a positive criterion")
        return Query(self, terms[0] if len(terms) == 1 else And(terms))

    def select(self, index: str, low: Any = None, high: Any = None, null_first: bool = False) -> Query:
        return Query(self, Range(index, low, high, null_first))

    def sort(self, index: str, query: Query, desc: bool = False, null_first: bool = False) -> Query:
        q = query.ir
        if isinstance(q, Slice):  # a slice is taken after the sort
            return Query(self, Slice(Sort(index, q.query, desc, null_first), q.start, q.stop, q.step))
        return Query(self, Sort(index, q, desc, null_first))

    def split_by(self, tags: Sequence[Any], query: Query, exclusive: bool = True) -> Query:
        if isinstance(tags, str):
            raise TypeError("split_by takes a sequence of tags")
        return Query(self, Split(tuple(term(t) for t in tags), query.ir, exclusive))

    def join(self, *sides: Any, on: Any) -> DataFrame:
        """Tuples of members of all sides that carry a common tag object of ``on``: oid_1 .. oid_n.

        A tuple stands once for each shared tag object.  Sides meet through the tags table, keyed by tag object, as blocks
        of members: a tag object's tuples are dealt over tasks by combinations of blocks, and each task makes them from
        blocks of bounded size, however many members share the tag object.
        """
        keys = Query(self, term(on)).ids().select(F.col("oid").cast("string").alias("key"))
        links = self.tag_rows.filter("kind = 'obj'").select("oid", "key").join(keys, "key", "left_semi")
        out, names = None, [f"oid_{n}" for n in range(1, len(sides) + 1)]
        for name, side in zip(names, sides, strict=True):
            own = blocks(links.join(Query(self, term(side)).ids(), "oid", "left_semi"), name, LAST if name == names[-1] else BLOCK)
            out = own if out is None else out.join(own, "key")
        sc = out.sparkSession.sparkContext
        out = out.drop("key").repartition(max(int(out.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8 * sc.defaultParallelism))
        for name in names:  # coalesce merges nothing here: it ends a generated loop, which would hold the rows of all the loops in it
            out = out.coalesce(1 << 30).select(*[F.explode(n).alias(n) if n == name else n for n in names])
        return out


def blocks(links: DataFrame, name: str, size: int) -> DataFrame:
    """Rows (key, array ``name`` of at most ``size`` oids): the members of a key in blocks; those of a task are its own."""
    part = links.select("key", "oid").sortWithinPartitions("key", "oid").withColumn("block", F.floor(F.monotonically_increasing_id() / size))
    return part.groupBy("key", "block").agg(F.collect_list("oid").alias(name)).drop("block")


class Query:
    def __init__(self, view: View, node: Any):
        self.view, self.ir = view, node

    # lowering

    def ids(self) -> DataFrame:
        """DataFrame of oid (and the columns of splits), unordered; sorted queries carry their place in ``pos``."""
        return lower(self.view, self.ir)

    def rows(self, type_name: str) -> DataFrame:
        """The result with the attributes of its objects."""
        return self.ids().join(self.view.objects(type_name), "oid")

    def ordered(self) -> DataFrame:
        """The result in its order: of its sort, or else by descending id."""
        order = _order(self.view, self.ir)
        return order[0].orderBy(*order[1])

    def filter(self, type_name: str, predicate: str | Callable, columns: Sequence[str] = ()) -> Query:
        """By a Column expression in SQL (pushed into the scan), or a Python function of a row (Arrow batches).

        A function is given the named ``columns`` only, so that the scan reads no others; by default all.  A slice stays
        a slice of the unfiltered query, whichever was asked for first.
        """
        if isinstance(predicate, str):
            return Query(self.view, Filter(self.ir, type_name, predicate))
        return Query(self.view, Filter(self.ir, type_name, None, predicate, tuple(columns)))

    def project(self, type_name: str, *columns: str | Column) -> DataFrame:
        """oid and the named attributes of the result's objects."""
        return self.rows(type_name).select("oid", *columns)

    def contains(self, refs: DataFrame) -> DataFrame:
        """``refs`` (oid) with a column ``found``: is it in the result?"""
        own = self.ids().select("oid").distinct().withColumn("found", F.lit(True))
        return refs.join(own, "oid", "left").withColumn("found", F.coalesce("found", F.lit(False)))

    def __contains__(self, oid: int) -> bool:
        return not self.ids().filter(F.col("oid") == oid).isEmpty()

    @property
    def snapshot(self) -> View:
        """The view that the query reads."""
        return self.view

    def __len__(self) -> int:
        return self.ids().count()

    def __bool__(self) -> bool:
        return not self.ids().isEmpty()

    def __getitem__(self, key: Any) -> Query | DataFrame:
        if isinstance(key, tuple):
            return self.pick(*key)
        if not isinstance(key, slice):
            return self.pick(key)
        if key == slice(None):
            return self
        if isinstance(self.ir, Filter):
            inner = Query(self.view, self.ir.query)[key]
            return Query(self.view, Filter(inner.ir, self.ir.type, self.ir.expr, self.ir.fn, self.ir.columns))
        if isinstance(self.ir, Slice):
            raise ValueError("a sliced query cannot be sliced again")
        start, stop, step = key.start, key.stop, key.step or 1
        if step <= 0:
            raise ValueError("a slice's step is positive")
        if (start or 0) < 0 or (stop or 0) < 0:
            n = len(self)
            start = max(0, n + start) if start is not None and start < 0 else start
            stop = max(0, n + stop) if stop is not None and stop < 0 else stop
        if stop is not None and (start or 0) > stop:
            start, stop = stop, start
        return Query(self.view, Slice(self.ir, start, stop, step))

    def pick(self, *places: int) -> list[int]:
        """The ids at places, in the order asked for; IndexError beyond the end."""
        most = max(places, default=0) + 1
        got = {r["at"]: r["oid"] for r in numbered(self, most).filter(F.col("at").isin([*places])).collect()}
        if missing := [p for p in places if p not in got]:
            raise IndexError(missing[0])
        return [got[p] for p in places]

    def signature(self) -> str:
        return ir.signature(self.ir)

    def compare(self, other: Query) -> float:
        return ir.compare(self.ir, other.ir)

    def serialize(self) -> bytes:
        return ir.serialize(self.ir)


def deserialize(view: View, data: bytes) -> Query:
    return Query(view, ir.deserialize(data))


def _order(view: View, node: Any) -> tuple[DataFrame, list[Column]]:
    """A query's rows, and by what they are ordered."""
    if isinstance(node, Slice):
        return lower(view, node), [F.col("pos")]
    if not isinstance(node, Sort):
        return lower(view, node), [F.col("oid").desc()]
    keys, inner, by = [], node, []
    while isinstance(inner, Sort):
        keys.append(inner)
        inner = inner.query
    df = lower(view, inner).select("oid")
    for n, s in enumerate(keys):
        df = df.join(view.indexes[s.index].select(F.col("key").alias(f"k{n}"), "oid"), "oid")
        c = F.col(f"k{n}")
        first = s.null_first != s.desc  # descending turns the placement of nulls around
        by.append((c.desc_nulls_first() if first else c.desc_nulls_last()) if s.desc else (c.asc_nulls_first() if first else c.asc_nulls_last()))
    return df, [*by, F.col("oid").desc() if keys[0].desc else F.col("oid").asc()]


def by_row(fn: Callable, kind: str, of: Callable = lambda x: x) -> Callable[[Column], Column]:
    """A function of rows (named tuples) as one of a struct column, in Arrow batches."""
    import pandas as pd

    def values(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([of(fn(r)) for r in rows.itertuples(index=False)], dtype=object)

    values.__annotations__ = {"rows": pd.DataFrame, "return": pd.Series}
    return F.pandas_udf(values, kind)


def numbered(q: Query, most: int | None = None) -> DataFrame:
    """oid and ``at``, the place in the query's order from 0.

    With ``most``, up to TOP, only the first so many places: a top-k, of which the single ordering task gets ``most`` rows
    a task.  Else places come from a range-partitioned sort and the partitions' sizes, not from one task.
    """
    df, by = _order(q.view, q.ir)
    if isinstance(q.ir, Slice):
        return df.select("oid", "pos").withColumnRenamed("pos", "at")
    if most is not None and most <= TOP:
        top = df.orderBy(*by).limit(most)
        return top.select("oid", (F.row_number().over(Window.orderBy(*by)) - 1).cast("long").alias("at"))
    part = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id())
    part = part.withColumn("own", F.monotonically_increasing_id() - F.shiftleft(F.col("part").cast("long"), 33))
    from ..sources.scratch import written

    part = written(part.select("oid", "part", "own"), "places")
    sizes = part.groupBy("part").count()
    before = sizes.select("part", F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))  # a row for each partition
    return part.join(F.broadcast(before), "part").select("oid", (F.col("own") + F.coalesce("before", F.lit(0))).alias("at"))


def lower(view: View, node: Any) -> DataFrame:
    if isinstance(node, Type):
        return view.ids_of(node.name)
    if isinstance(node, Tag):
        return view.tagged([node]).select("oid")
    if isinstance(node, Ids) and view.type_of is not None:
        by: dict[str | None, list[int]] = {}
        for oid in node.oids:
            by.setdefault(view.type_of(oid), []).append(oid)
        return reduce(DataFrame.union, [view.types[t].select("oid").filter(F.col("oid").isin(own)) for t, own in by.items() if t in view.types], view.nothing())
    if isinstance(node, Ids):
        every = reduce(DataFrame.union, [view.ids_of(t) for t in view.types if t not in view.parents]) if view.types else None
        return every.filter(F.col("oid").isin([*node.oids]))
    if isinstance(node, Or):
        tags = [t for t in node.terms if isinstance(t, Tag)]
        parts = [view.tagged(tags).select("oid")] if tags else []
        parts += [lower(view, t).select("oid") for t in node.terms if not isinstance(t, Tag)]
        return reduce(DataFrame.union, parts).distinct()
    if isinstance(node, And) and not node.terms:
        return view.nothing()
    if isinstance(node, And):
        positive = [t for t in node.terms if not isinstance(t, Not)]
        wide = [t for t in positive if isinstance(t, Split | Filter)]
        rest = [t for t in positive if t not in wide]
        df = lower(view, (wide or rest)[0])
        if not wide and isinstance(rest[0], Range):
            df = df.distinct()
        for t in (wide[1:] + rest) if wide else rest[1:]:
            df = df.join(lower(view, t).select("oid"), "oid", "left_semi")
        gone = [t for n in node.terms if isinstance(n, Not) for t in n.terms]
        return df.join(lower(view, Or(tuple(gone))), "oid", "left_anti") if gone else df
    if isinstance(node, Range):
        key = F.col("key")
        bounds = [b for b in (key >= F.lit(node.low) if node.low is not None else None, key <= F.lit(node.high) if node.high is not None else None) if b is not None]
        inside = reduce(Column.__and__, bounds, key.isNotNull())
        nulls = (node.low if node.null_first else node.high) is None
        return view.indexes[node.index].filter(inside | key.isNull() if nulls else inside).select("oid")
    if isinstance(node, At):
        return lower(view.earlier(node.state), node.query)
    if isinstance(node, Split):
        base = lower(view, node.query)
        place = F.create_map(*[x for i, t in enumerate(node.tags) for x in (F.lit(f"{t.kind}|{t.scope}|{t.key}"), F.lit(i))])
        hit = view.tagged(node.tags).select("oid", F.col("key").alias("split_tag"), F.element_at(place, F.concat_ws("|", "kind", "scope", "key")).alias("split_at"))
        if node.exclusive:  # the first of the listed tags
            hit = hit.groupBy("oid").agg(F.min_by("split_tag", "split_at").alias("split_tag"))
        n = sum(c.startswith("tag_") for c in base.columns) + 1
        return base.join(hit.select("oid", F.col("split_tag").alias(f"tag_{n}")), "oid")
    if isinstance(node, Filter):
        base = lower(view, node.query)
        objects = view.objects(node.type)
        if node.fn is None:
            return base.join(objects.filter(node.expr).select("oid"), "oid", "left_semi")
        test = by_row(node.fn, "boolean", bool)
        return base.join(objects.filter(test(F.struct(*(node.columns or objects.columns)))).select("oid"), "oid", "left_semi")
    if isinstance(node, Sort):
        return _order(view, node)[0]
    if isinstance(node, Slice):
        start, stop = node.start or 0, node.stop
        at = numbered(Query(view, node.query), stop)
        keep = (F.col("at") >= start) & ((F.col("at") - start) % node.step == 0)
        if stop is not None:
            keep = keep & (F.col("at") < stop)
        return at.filter(keep).select("oid", F.floor((F.col("at") - start) / node.step).cast("long").alias("pos"))
    raise TypeError(f"cannot lower {node!r}")
