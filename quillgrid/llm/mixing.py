"""Mixing sources to target weights by hash-threshold histograms.

Every document has a hash of 60 bits.  A mix takes, of each source, whole passes over its documents and of
one further pass the documents whose hash is below a threshold, so that mixes of smaller budgets are parts of
larger ones.  A threshold is found from a histogram: words are summed by source and hash bucket (4096
buckets), the bucket in which the running sum crosses the budget is refined into 4096 narrower ones, and so on
until it holds one hash value.  Nothing is sorted; each level reads only rows of boundary buckets.

Defined cases: a null source is a source of its own, last in order.  A null id takes the text's hash.  Rows with
equal hashes (repeats of one row) are taken or left together, whichever is nearer the budget.  Documents without
words belong to the mix but add nothing.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .common import table, word_count, written

BITS, STEP = 60, 12
#: Above so many sources the plan is joined by a shuffle, not broadcast.
BROADCAST_SOURCES = 100_000

PLAN = T.StructType([
    T.StructField("mix_source", T.StringType()), T.StructField("mix_k", T.IntegerType()),
    T.StructField("mix_source_size", T.LongType()), T.StructField("mix_target", T.DoubleType()),
    T.StructField("mix_passes", T.LongType()), T.StructField("mix_below", T.LongType()),
])


def doc_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of the md5 of the id (of the text where the id is null)."""
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), text), F.lit(""))
    return F.conv(F.substring(F.md5(key), 1, BITS // 4), 16, 10).cast("long")


def targets(sizes: dict[str | None, int], weights: Sequence[int], share: float, most: int) -> dict[str | None, float]:
    """Words each source should give: shares by weight of ``share`` of all words, at most ``most`` times its own.

    What a stopped source leaves goes to the others by weight: sources are stopped in the order of
    most * size / weight, as long as the level of the rest is above that ratio.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left_words, left_weight, level = share * sum(sizes.values()), sum(weight.values()), 0.0
    stopped = set()
    for s in sorted(order, key=lambda s: (most * sizes[s] / weight[s], order.index(s))):
        level = left_words / left_weight
        if most * sizes[s] / weight[s] >= level:
            break
        stopped.add(s)
        left_words -= most * sizes[s]
        left_weight -= weight[s]
    return {s: float(most * sizes[s]) if s in stopped else weight[s] * level for s in order}


def fit_mix(rows: DataFrame, weights: Sequence[int] = (1, 2, 3), shares: Sequence[float] = (1.0,), most: int = 3) -> DataFrame:
    """The plan of a mix from ``rows`` (source, size, h): a row for each source and share.

    ``mix_passes`` whole passes and, of one more, the hashes below ``mix_below``.  The driver holds a row for each
    source and share, as the configuration of a mix does.
    """
    spark = rows.sparkSession
    sizes = {r["source"]: int(r["n"] or 0) for r in rows.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    done, state = [], []
    for k, share in enumerate(shares):
        for s, t in targets(sizes, weights, share, most).items():
            passes = int(t // sizes[s]) if sizes[s] else 0
            rest = t - passes * sizes[s]
            if rest <= 0:
                done.append((s, k, sizes[s], t, passes, 0))
            else:
                state.append((s, k, sizes[s], t, passes, rest, 0, 0))
    level = 0
    schema = "b_source string, k int, source_size long, target double, passes long, rest double, path long, cum long"
    live = rows.filter("size > 0")
    while state:
        level += 1
        shift = BITS - STEP * level
        bounds = spark.createDataFrame(state, schema)
        inside = live.join(_small(bounds, len(state)), F.col("source").eqNullSafe(F.col("b_source")) & (F.shiftright("h", shift + STEP) == F.col("path")))
        keys = [c for c in bounds.columns]
        hist = inside.groupBy(*keys, F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy("b_source", "k").orderBy("bucket"))
        at = hist.withColumn("upto", F.col("cum") + upto).filter("upto >= rest and upto - n < rest")
        found = at.collect()
        crossed = {(r["b_source"], r["k"]) for r in found}
        done += [(*x[:5], 1 << BITS) for x in state if (x[0], x[1]) not in crossed]  # rounding: the budget is all there is
        state = []
        for r in found:
            before, after = r["upto"] - r["n"], r["upto"]
            if r["lo"] == r["hi"]:
                below = r["lo"] + 1 if after - r["rest"] <= r["rest"] - before else r["lo"]
                done.append((r["b_source"], r["k"], r["source_size"], r["target"], r["passes"], below))
            else:
                state.append((r["b_source"], r["k"], r["source_size"], r["target"], r["passes"], r["rest"], r["bucket"], before))
    return spark.createDataFrame(done, PLAN)


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_SOURCES else df


def apply_mix(docs: DataFrame, plan: DataFrame, source: str, h: Column, n_sources: int, k: int = 0) -> DataFrame:
    """``docs`` with the plan's columns and ``mix_copies``, how often the mix takes the row."""
    joined = docs.join(_small(plan.filter(F.col("mix_k") == k), n_sources), F.col(source).eqNullSafe(F.col("mix_source")), "left")
    return joined.withColumn("mix_copies", F.col("mix_passes") + (h < F.col("mix_below")).cast("long"))


def sized(docs: DataFrame) -> DataFrame:
    """The narrow table that mixing needs of documents: id, source, size in words, hash."""
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), doc_hash(F.col("doc_id"), F.col("text")).alias("h"))


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(sized(table(spark, sf_dir, "documents")), "mix-sizes")
    plan = fit_mix(rows)
    out = apply_mix(rows, plan, "source", F.col("h"), plan.count())
    return out.select("doc_id", "size", F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("size") * F.col("mix_copies")).alias("taken"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, repeated as often as it takes them; the columns of ``docs``."""
    plan = fit_mix(written(sized(docs), "mix-sizes"))
    mixed = apply_mix(docs.withColumn("mix_h", doc_hash(F.col("doc_id"), F.col("text"))), plan, "source", F.col("mix_h"), plan.count())
    copies = mixed.filter("mix_copies > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int"))))
    return copies.select(*docs.columns)


OP1_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'text:' || text, '')), 1, 15) AS BIGINT) AS h
  FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS s,
         1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM rows GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY 3 * s / w::DOUBLE, source NULLS LAST) AS r FROM src),
steps AS (
  SELECT *, (SELECT sum(s) FROM src) - coalesce(sum(3 * s) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lw,
         (SELECT sum(w) FROM src) - coalesce(sum(w) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ww
  FROM ranked),
cut AS (SELECT coalesce(min(r) FILTER (WHERE 3 * s / w::DOUBLE >= lw::DOUBLE / ww), 1000000000) AS r FROM steps),
lvl AS (SELECT lw::DOUBLE / ww AS level FROM steps WHERE r = (SELECT r FROM cut)),
tgt AS (
  SELECT source, s, CASE WHEN r < (SELECT r FROM cut) THEN (3 * s)::DOUBLE ELSE w * (SELECT level FROM lvl) END AS t FROM ranked),
plan AS (
  SELECT source, s, t, CASE WHEN s > 0 THEN CAST(floor(t / s) AS BIGINT) ELSE 0 END AS passes FROM tgt),
byhash AS (SELECT source, h, sum(size) AS n FROM rows GROUP BY source, h),
cum AS (SELECT source, h, n, sum(n) OVER (PARTITION BY source ORDER BY h) AS upto FROM byhash),
taken AS (
  SELECT c.source, c.h, p.passes, p.t - p.passes * p.s AS rest, c.upto, c.n FROM cum c JOIN plan p ON c.source IS NOT DISTINCT FROM p.source),
sel AS (
  SELECT source, h, passes + CASE WHEN rest > 0 AND (upto < rest OR (upto - n < rest AND upto - rest <= rest - (upto - n))) THEN 1 ELSE 0 END AS copies FROM taken)
SELECT r.doc_id, r.size, p.s AS source_size, p.t AS target, CAST(r.size * s.copies AS BIGINT) AS taken
FROM rows r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source JOIN sel s ON s.source IS NOT DISTINCT FROM r.source AND s.h = r.h
"""
