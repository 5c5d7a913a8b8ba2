"""Joins of ids with ranges of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_spans(rows: DataFrame, spans: DataFrame, width: int = 1 << 12) -> DataFrame:
    """``rows`` (oid, ...) that stand in any of ``spans`` (first, last; both inclusive), each once.

    Spans are cut into blocks of ``width`` ids, rows carry their block's number, and the two meet in a semi join by it:
    no row meets a span of another block.  A span with a null bound, or that ends before it begins, holds nothing.
    """
    block = lambda c: F.floor(F.col(c) / width)
    cut = spans.filter("first <= last").select(F.explode(F.sequence(block("first"), block("last"))).alias("s_block"), F.col("first").alias("s_first"), F.col("last").alias("s_last")).distinct()
    near = (block("oid") == F.col("s_block")) & F.col("oid").between(F.col("s_first"), F.col("s_last"))
    return rows.join(cut, near, "left_semi")
