"""Grouped aggregates of queries, kept up by differences between states."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import ir
from ..sources.scratch import written
from .query import Query, View, by_row


@dataclass(frozen=True)
class Op:
    """An aggregate that differences can maintain: sum of ``value`` over added rows less that over removed ones."""

    name: str
    value: str

    def column(self, sign: str = "1") -> Column:
        return F.sum(F.expr(f"({self.value}) * ({sign})")).alias(self.name)


count_op = Op("count", "1")


def make_sum(expr: str, name: str = "sum") -> Op:
    return Op(name, expr)


@dataclass(frozen=True)
class CustomOp:
    """Any aggregate, by a Python function state = step(state, row) from ``start``; recomputed in full.

    With ``merge`` (of two states) each task folds its own rows first, and only states meet by group.  Without, a group's
    rows meet in one task.  ``columns``: the attributes that ``step`` reads, by default all.
    """

    name: str
    start: object
    step: Callable
    kind: str = "double"
    merge: Callable | None = None
    columns: tuple = ()


@dataclass(frozen=True)
class Key:
    """A group key by a Python function of a row (Arrow batches), of a SQL type; ``columns``: those that it reads."""

    fn: Callable
    kind: str = "string"
    columns: tuple = ()


def source_of(fn: Callable) -> tuple:
    """What tells functions apart that aren't the same object: code, constants, names and what they close over."""
    code = fn.__code__
    return code.co_code, tuple(source_of_code(c) for c in code.co_consts), code.co_names, repr(fn.__defaults__), tuple(repr(c.cell_contents) for c in fn.__closure__ or ())


def source_of_code(x: object) -> object:
    return (x.co_code, tuple(map(source_of_code, x.co_consts)), x.co_names) if hasattr(x, "co_code") else repr(x)


def shape_of(groups: Sequence, ops: Sequence) -> str:
    """Group definitions and ops as text: equal for functions of equal source."""
    plain = lambda g: ("key", source_of(g.fn), g.kind) if isinstance(g, Key) else ("key", source_of(g), "string") if callable(g) else g
    return repr(([plain(g) for g in groups], tuple(ops)))


def keyed(view: View, query: Query, groups: Sequence[str | Callable | Key | Sequence], type_name: str) -> tuple[DataFrame, list[str]]:
    """Rows of the query with attributes and a column for each group: an expression, a function's value, or a list's tag."""
    q, names, exprs = query, [], []
    for n, g in enumerate(groups, 1):
        if isinstance(g, str):
            exprs.append(F.expr(g).alias(f"key_{n}"))
        elif isinstance(g, Key) or callable(g):
            own = g if isinstance(g, Key) else Key(g)
            exprs.append(by_row(own.fn, own.kind)(F.struct(*(own.columns or view.objects(type_name).columns))).alias(f"key_{n}"))
        else:
            before = sum(isinstance(x, list | tuple) for x in groups[:n])
            q = view.split_by(g, q)
            exprs.append(F.col(f"tag_{before}").alias(f"key_{n}"))
        names.append(f"key_{n}")
    return q.ids().join(view.objects(type_name), "oid").select("*", *exprs), names


def folder(op: CustomOp, names: list[str]) -> Callable:
    def fold(key: tuple, pdf):
        import pandas as pd

        state = op.start
        for row in pdf.itertuples(index=False):
            state = op.step(state, row)
        return pd.DataFrame([(*key, state)], columns=[*names, op.name])

    return fold


def folded(rows: DataFrame, op: CustomOp, names: list[str], fields: T.StructType) -> DataFrame:
    """The op by group, from the states of each task."""

    def parts(batches):
        import pandas as pd

        states: dict[tuple, object] = {}
        for batch in batches:
            keys = list(zip(*[batch.pop(n) for n in names], strict=True))
            for key, row in zip(keys, batch.itertuples(index=False), strict=True):
                key = tuple(None if k != k else k for k in key)  # a null key may come as NaN
                states[key] = op.step(states.get(key, op.start), row)
        yield pd.DataFrame([(*k, v) for k, v in states.items()], columns=[*names, op.name])

    def meet(key: tuple, pdf):
        import pandas as pd

        return pd.DataFrame([(*key, reduce(op.merge, pdf[op.name]))], columns=[*names, op.name])

    own = [c for c in (op.columns or rows.columns) if c not in names]
    return rows.select(*names, *own).mapInPandas(parts, fields).groupBy(*names).applyInPandas(meet, fields)


def group_by(view: View, groups: Sequence, query: Query, type_name: str, ops: Sequence[Op | CustomOp] = (count_op,)) -> DataFrame:
    """key_1 .. key_n and a column for each op.  Rows with none of a list's tags are left out."""
    if isinstance(groups, str):
        raise TypeError("groups is a sequence of expressions and tag lists")
    rows, names = keyed(view, query, groups, type_name)
    plain = [o for o in ops if isinstance(o, Op)]
    out = rows.groupBy(*names).agg(*[o.column() for o in plain] or [F.count(F.lit(1)).alias("_n")])
    for o in (o for o in ops if isinstance(o, CustomOp)):
        fields = T.StructType([*[rows.schema[n] for n in names], T.StructField(o.name, T._parse_datatype_string(o.kind))])

        fold = folder(o, names)
        own = folded(rows, o, names, fields) if o.merge else rows.groupBy(*names).applyInPandas(fold, fields)
        out = out.join(own, [out[n].eqNullSafe(own[n]) for n in names]).select(out["*"], own[o.name])
    return out.drop("_n")


class FastQuery:
    """Results of group_by, kept and brought up to date from the difference of two states.

    A result is found by prefix, type, groups, ops and the query's signature.  A later call reads only rows that joined,
    left or changed since: each counts with its sign.  Groups that become empty go, so that the maintained result equals
    a full one.  A query not met before starts from the nearest kept one (a difference under NEAR by ``ir.compare``) of the
    same prefix, type, groups and ops: what one has and the other hasn't is the difference.

    With ``path``, a folder, results outlive the session: each is written there with a row that tells what it is of.
    """

    NEAR = 0.33

    def __init__(self, spark: SparkSession | None = None, path: str | None = None) -> None:
        #: by prefix, type, groups and ops; then by the query's signature: state, query, result
        self.kept: dict[str, dict[str, tuple[int, object, DataFrame]]] = {}
        self.path = path
        if path is not None:
            self._load(spark)

    ENTRY = "shape string, state long, query binary, place string"

    def _load(self, spark: SparkSession) -> None:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/entries")
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return
        for r in spark.read.schema(self.ENTRY).parquet(f"{self.path}/entries").orderBy("state").collect():  # a row for each kept result
            query = ir.deserialize(bytes(r["query"]))
            self.kept.setdefault(r["shape"], {})[ir.signature(query)] = (r["state"], query, spark.read.parquet(f"{self.path}/{r['place']}"))

    def _keep(self, shape: str, state: int, query: object, result: DataFrame) -> DataFrame:
        spark = result.sparkSession
        if self.path is None:
            now = written(result, "groups")
        else:
            place = f"groups-{uuid.uuid4().hex}"
            result.write.parquet(f"{self.path}/{place}")
            now = spark.read.schema(result.schema).parquet(f"{self.path}/{place}")
            spark.createDataFrame([(shape, state, bytearray(ir.serialize(query)), place)], self.ENTRY).coalesce(1).write.mode("append").parquet(f"{self.path}/entries")
        self.kept.setdefault(shape, {})[ir.signature(query)] = (state, query, now)
        return now

    @staticmethod
    def shape(view: View, type_name: str, groups: Sequence, ops: Sequence[Op]) -> str:
        return hashlib.sha256(repr((view.name, type_name, shape_of(groups, ops))).encode()).hexdigest()

    def nearest(self, shape: str, query: object) -> tuple[int, object, DataFrame] | None:
        """The result kept for the query, or else for the nearest that is near enough."""
        own = self.kept.get(shape, {})
        if (found := own.get(ir.signature(query))) is not None:
            return found
        ranked = sorted(((ir.compare(query, x[1]), key) for key, x in own.items()), key=lambda x: x[0])
        return own[ranked[0][1]] if ranked and ranked[0][0] < self.NEAR else None

    def group_by(self, view: View, groups: Sequence, query: Query, type_name: str, ops: Sequence[Op] = (count_op,)) -> DataFrame:
        shape, every = self.shape(view, type_name, groups, ops), [*ops, Op("_size", "1")]
        old = self.nearest(shape, query.ir)
        if old is None:
            now = group_by(view, groups, Query(view, query.ir), type_name, every)
        elif old[0] == view.state and ir.signature(old[1]) == ir.signature(query.ir):
            return old[2].drop("_size")
        else:
            before = view if old[0] == view.state else view.earlier(old[0])
            a, names = keyed(before, Query(before, old[1]), groups, type_name)
            b, _ = keyed(view, Query(view, query.ir), groups, type_name)
            same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("version", *names) if c in a.columns]
            on = reduce(Column.__and__, same, F.col("a.oid") == F.col("b.oid"))
            left = a.alias("a").join(b.alias("b"), on, "left_anti").withColumn("_sign", F.lit(-1))
            came = b.alias("b").join(a.alias("a"), on, "left_anti").withColumn("_sign", F.lit(1))
            change = left.unionByName(came, allowMissingColumns=True).groupBy(*names).agg(*[o.column("_sign") for o in every])
            both = old[2].unionByName(change)
            now = both.groupBy(*names).agg(*[F.sum(o.name).alias(o.name) for o in every]).filter("_size > 0")
        return self._keep(shape, view.state, query.ir, now).drop("_size")


def get_schema(objects: DataFrame) -> DataFrame:
    """field, primary_type (the most common that isn't null) and all_types by frequency, of typed or variant columns."""
    parts = [objects.select(F.lit(f.name).alias("field"), F.when(F.col(f"`{f.name}`").isNull(), "null").otherwise(F.schema_of_variant(f"`{f.name}`") if isinstance(f.dataType, T.VariantType) else F.lit(f.dataType.simpleString())).alias("type")) for f in objects.schema]
    n = reduce(DataFrame.union, parts).groupBy("field", "type").count()
    ranked = n.groupBy("field").agg(F.sort_array(F.collect_list(F.struct(-F.col("count"), "type"))).alias("t"))
    types = F.transform("t", lambda x: x["type"])
    return ranked.select("field", F.get(F.filter(types, lambda x: x != "null"), 0).alias("primary_type"), types.alias("all_types"))
