"""Best-fit packing of documents into bins (training sequences) under conflicts.

A bin holds at most CAPACITY words, no two documents of one duplicate cluster and at most PER_SOURCE documents of one
source.  Documents are dealt at random (by hash) to shards, each packed by itself in descending size: bins stand in a
list for each residual, with a bitmap of the residuals that have bins; each bin carries a bitmap of its clusters and
one of the sources that are full in it.  The search takes the least residual that fits, and its successors, until a
bin agrees; so the tightest compatible bin is found.  A document longer than the capacity fills bins of its own with
its first pieces, and the rest is packed.

Sharding bounds memory and search by SHARD rows, whatever a source's or cluster's share; it leaves at most a few open
bins a shard.  So the tightest bin is that of the shard, not of the whole table.

Defined cases: a null text, or one without a word, is a piece of size 0, packed like any other.  Cluster: the hash of
the lower-cased words, so that exact copies and repeated rows conflict; texts without a word conflict with none.  A
null source is a source.  The packing depends on the rows alone, not on their order or partitions.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, release_shuffles, table, word_count, written

CAPACITY, PER_SOURCE, SHARD = 2048, 8, 4096


class Packer:
    """Best fit within one shard."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.used: list[int] = []
        self.clusters: list[int] = []
        self.full: list[int] = []
        self.counts: list[dict[int, int]] = []
        self.open: dict[int, list[int]] = defaultdict(list)
        self.residuals = 0  # bit r: some bin has residual r

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Bin and offset of a piece; source: a bit's place; cluster: a bit's place, -1 for none."""
        own, full = (1 << cluster) if cluster >= 0 else 0, 1 << source
        rest = self.residuals >> size
        r = size
        while rest:
            step = (rest & -rest).bit_length() - 1
            r += step
            bins = self.open[r]
            for j in range(len(bins) - 1, -1, -1):
                b = bins[j]
                if not self.clusters[b] & own and not self.full[b] & full:
                    del bins[j]
                    if not bins:
                        self.residuals &= ~(1 << r)
                    return self._put(b, size, source, own)
            rest >>= step + 1
            r += 1
        self.used.append(0)
        self.clusters.append(0)
        self.full.append(0)
        self.counts.append({})
        return self._put(len(self.used) - 1, size, source, own)

    def _put(self, b: int, size: int, source: int, own: int) -> tuple[int, int]:
        at = self.used[b]
        self.used[b] += size
        self.clusters[b] |= own
        n = self.counts[b][source] = self.counts[b].get(source, 0) + 1
        if n >= self.per_source:
            self.full[b] |= 1 << source
        r = self.capacity - self.used[b]
        self.open[r].append(b)
        self.residuals |= 1 << r
        return b, at


def pack_shard(rows: pd.DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE) -> pd.DataFrame:
    """rows (doc_id, source, cluster, size) of a shard -> doc_id, piece, bin, start, size."""
    sources = {s: i for i, s in enumerate(sorted(rows["source"].map(lambda s: (s is None or s != s, s or "")).unique()))}
    sharing = rows["cluster"].value_counts()
    bits = {c: i for i, c in enumerate(sharing.index[sharing > 1])}
    pieces = []
    for doc_id, source, cluster, size in zip(rows["doc_id"], rows["source"], rows["cluster"], rows["size"], strict=True):
        piece = 0
        bit = bits.get(cluster, -1) if cluster == cluster and cluster is not None else -1
        src = sources[source is None or source != source, source or ""]
        while size > capacity:
            pieces.append((capacity, doc_id, piece, src, bit))
            size -= capacity
            piece += 1
        pieces.append((size, doc_id, piece, src, bit))
    pieces.sort(key=lambda p: -p[0])
    packer, out = Packer(capacity, per_source), []
    for size, doc_id, piece, src, bit in pieces:
        out.append((doc_id, piece, *packer.place(int(size), src, bit), int(size)))
    return pd.DataFrame(out, columns=["doc_id", "piece", "bin", "start", "size"])


#: Ids pass through pandas as text, which keeps nulls beside ids above 2**53.
PACKED = "shard long, doc_id string, piece int, bin long, start long, size long"


def pack(rows: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE) -> DataFrame:
    """rows (doc_id, source, cluster, size) -> doc_id, piece, bin_id, start, size of every piece.

    ``bin_id`` is shard * 2**32 + bin.
    """
    names = ["doc_id", "source", "cluster", "size"]
    # equal rows (repeats of a mix, say) are counted and numbered, so that the deal depends on the rows alone; in blocks,
    # so that no array holds all numbers of a row that stands very often
    alike = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n_alike"))
    n = max(1, -(-(alike.agg(F.sum("n_alike")).first()[0] or 0) // SHARD))
    blocks = alike.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_alike") - 1) / SHARD))))
    first = F.col("block") * SHARD
    each = blocks.select(*names, F.explode(F.sequence(first, F.least(first + SHARD, "n_alike") - 1)).alias("number"))
    dealt = each.withColumn("shard", F.pmod(F.xxhash64(*names, "number"), F.lit(n)))

    def packed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = pack_shard(pdf.sort_values(["size", "doc_id", "cluster", "source"], ascending=False, kind="stable"), capacity, per_source)
        out.insert(0, "shard", key[0])
        return out

    out = dealt.select("shard", F.col("doc_id").cast("string").alias("doc_id"), "source", F.col("cluster").cast("string").alias("cluster"), "size").groupBy("shard").applyInPandas(packed, PACKED)
    return out.select(F.col("doc_id").cast(rows.schema["doc_id"].dataType).alias("doc_id"), "piece", (F.shiftleft("shard", 32) + F.col("bin")).alias("bin_id"), "start", "size")


def sized(docs: DataFrame) -> DataFrame:
    words = F.array_join(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)), " ")
    return docs.select("doc_id", "source", F.when(words != "", F.xxhash64(words)).alias("cluster"), word_count(F.col("text")).alias("size"))


def op2_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(written(sized(table(spark, sf_dir, "documents")), "pack-sizes"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row of ``docs`` in pieces with their bins; the repeats of a mix never share a bin."""
    rows = written(sized(docs), "pack-sizes")
    release_shuffles(spark)
    return pack(rows)
