"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, extra columns."""

import random
import zlib

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("size", T.StringType()), T.StructField("taken", T.StringType())])
LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])


def crc(doc_id, n):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % n


def awkward_rows():
    rng = random.Random(5)
    vocab = ["the", "of", "über", "straße", "x#y", "a|b", "Zażółć", "naïve", "it's", "42nd"] + ["w%d" % i for i in range(300)]
    words = lambda n: [rng.choice(vocab) for _ in range(n)]
    base, passage = words(200), " ".join(words(140))
    rows = [(0, None, None, None, None), (1, "", "en", "a", 0), (2, " \t\n\r ", "de", "b", 5), (None, " ".join(words(30)), "en", "a", 1), (None, None, None, None, None)]
    rows += [(3, "one", "en", "a", 3), (4, "one two", "fr", None, 7), (5, "Two One\x0btwo one two one two one", "en", "b", 9), (6, "!" * 5000, "en", "b", 5000), (7, "ab" * 3000, "en", "c", 6000)]
    rows += [(8, " ".join(words(20000)), "en", "c", 1)]
    rows += [(10 + i, " ".join(base), "en", "a", 1) for i in range(6)] + [(10, " ".join(base), "en", "a", 1)]
    for i in range(8):
        near = list(base)
        near[rng.randrange(len(near))] = "changed%d" % i
        rows.append((20 + i, " ".join(near), "en", "a", 1))
    for i in range(8):
        rows.append((30 + i, " ".join(words(60)) + "\n" + passage + "\n" + " ".join(words(60)), "de", "b", 1))
    rows += [(40 + i, "\n".join([" ".join(words(12)) for _ in range(4)] * (1 + i % 3)), ["fr", "es", None][i % 3], ["d", "é", "\U0001f600"][i % 3], 1) for i in range(12)]
    rows += [(60, "tail <|endoftext|> middle 日本語 text ﷺ \U0001f600", "en", "a", 1)]
    return [(*r, "clash", "clash") for r in rows]


@pytest.fixture(scope="session")
def awkward(spark, tmp_path_factory):
    """A folder with documents and labels of the awkward cases; and the rows."""
    d = str(tmp_path_factory.mktemp("awkward"))
    rows = awkward_rows()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(r[0], None if i % 9 == 0 else i % 2, None if i % 7 == 0 else i % 3 == 0) for i, r in enumerate(rows)], "doc_id long, quality int, toxic boolean").selectExpr("doc_id", "quality", "cast(toxic as int) toxic").write.parquet(f"{d}/labels.parquet")
    return d, [r[:5] for r in rows]


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{d}/labels.parquet")
    return d


def collected(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def by_text(rows, result):
    """Pairs of an input row and its result, where ids are unique or rows equal."""
    own = {}
    for r in result:
        own.setdefault(r["doc_id"], []).append(r)
    for r in rows:
        if r[0] is not None:
            yield r, own[r[0]][0]
