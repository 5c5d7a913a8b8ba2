"""Document fingerprints: bottom-k sketches of word shingles, in DataFrame functions only.

A sketch is the K smallest different 64-bit hashes of a text's five-word shingles, in order.  The sketch of a union is
the K smallest of both sketches, so parts merge.  Among the K smallest of two texts' union, the share that both have
estimates their resemblance (Jaccard); from it and the distinct counts follows containment.  A full sketch whose
largest hash lies at the fraction f of the hash range estimates (K - 1) / f distinct shingles; a smaller one is exact.

Defined cases: null texts are empty.  Fewer than five words make one shingle of all; no words, none: two such texts
resemble each other by 1, such a text and another by 0.  Order of documents: id from large to small, nulls last, then
hash of the text; repeats of a row (same id and text) have one place in it and share their next document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import WORD, release_shuffles, table, text_or_empty, written

K, WORDS = 64, 5
#: Ids of a range that is ordered by one task, and the most ranges.
RANGE, RANGES = 2048, 2048


def with_sketch(df: DataFrame, text: str, name: str, k: int = K, words: int = WORDS) -> DataFrame:
    """``df`` with the sketch (array of longs) of a text column without nulls."""
    w, n = f"{name}_w", F.size(f"{name}_w")
    df = df.withColumn(w, F.transform(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0)), lambda x: F.xxhash64(x)))
    many = F.transform(F.sequence(F.lit(0), n - words), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(words)]))
    df = df.withColumn(f"{name}_h", F.when(n >= words, many).when(n > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>")))
    return df.withColumn(name, F.slice(F.sort_array(F.array_distinct(f"{name}_h")), 1, k)).drop(w, f"{name}_h")


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    u = merged(a, b, k)
    return F.when(F.size(u) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(u, F.array_intersect(a, b))) / F.size(u).cast("double"))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimate of the number of different shingles."""
    share = (F.element_at(a, k).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of the share of a's shingles that b has."""
    r = resemblance(a, b, k)
    both = r / (1 + r) * (distinct_count(a, k) + distinct_count(b, k))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / F.greatest(distinct_count(a, k), F.lit(1.0))))


def as_text(a: Column) -> Column:
    return F.lower(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def next_documents(ids: DataFrame) -> DataFrame:
    """ids (doc_id, h, n_chars), one for each place -> with next_id and next_h, in a circle.

    Ids are ordered within ranges, by one task each; only each range's first place is collected.
    """
    spark = ids.sparkSession
    n = ids.count()
    ranges = min(RANGES, n // RANGE)
    bounds = ids.agg(F.percentile_approx("doc_id", [i / (ranges + 1) for i in range(1, ranges + 1)], 10_000)).first()[0] if ranges else []
    bounds = sorted(set(bounds or []))
    at = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b <= F.col("doc_id"))) if bounds else F.lit(0)
    order = Window.partitionBy("range").orderBy(F.col("doc_id").desc_nulls_last(), F.col("h").desc())
    placed = ids.withColumn("range", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(at)).select("*", F.row_number().over(order).alias("rn"), F.lead(F.struct("doc_id", "h")).over(order).alias("nxt"))
    placed = written(placed, "places")
    firsts = sorted(placed.filter("rn = 1").select("range", "doc_id", "h").collect(), key=lambda r: -r["range"])
    after = [(a["range"], b["doc_id"], b["h"]) for a, b in zip(firsts, firsts[1:] + firsts[:1], strict=True)]
    ahead = F.broadcast(spark.createDataFrame(after, "range int, first_id long, first_h long"))
    out = placed.join(ahead, "range", "left")
    return out.select("doc_id", "h", "n_chars", F.when(F.col("nxt").isNull(), F.col("first_id")).otherwise(F.col("nxt.doc_id")).alias("next_id"), F.when(F.col("nxt").isNull(), F.col("first_h")).otherwise(F.col("nxt.h")).alias("next_h"), "copies")


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, sketch) -> those, n_chars, edited (text) and next_sketch."""
    keyed = docs.withColumn("h", F.xxhash64("text"))
    ids = docs.select("doc_id", F.xxhash64("text").alias("h"), F.length("text").alias("n_chars")).groupBy("doc_id", "h").agg(F.first("n_chars").alias("n_chars"), F.count(F.lit(1)).alias("copies"))
    ids = written(ids, "ids")
    order = next_documents(ids)
    wanted = order.select(F.col("doc_id").alias("w_id"), F.col("h").alias("w_h"), F.floor(F.col("n_chars") / 3).cast("int").alias("third"), F.col("next_id").alias("n_id"), F.col("next_h").alias("n_h"))
    ahead = keyed.join(wanted, F.col("doc_id").eqNullSafe(F.col("n_id")) & (F.col("h") == F.col("n_h")))
    ahead = ahead.select("w_id", "w_h", "third", F.expr("substring(text, 1, third)").alias("tail"), F.col("sketch").alias("next_sketch"))
    if (ids.agg(F.max("copies")).first()[0] or 0) > 1:  # repeats of a row: its text stands for all of them
        ahead = ahead.dropDuplicates(["w_id", "w_h"])
    both = keyed.join(ahead, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("h") == F.col("w_h")))
    return both.select("doc_id", F.length("text").cast("long").alias("n_chars"), "sketch", "next_sketch", F.concat(F.expr("substring(text, 1, length(text) - third)"), F.col("tail")).alias("edited"))


def op8_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty().alias("text"))
    both = with_sketch(with_next(with_sketch(docs, "text", "sketch")), "edited", "edited_sketch")
    release_shuffles(spark)
    a, b, c = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(a).alias("fingerprint"), as_text(b).alias("edited_fingerprint"),
        resemblance(a, b).alias("near_edited"), resemblance(a, c).alias("near_next"), containment(a, b).alias("held_by_edited"), distinct_count(a).alias("n_shingles"),
    )
