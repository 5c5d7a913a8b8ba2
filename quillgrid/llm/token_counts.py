"""Exact token counts by a map-side lookup in two tiers.

A text is cut into pre-tokens by the tokenizer's own rule.  Tier one is a broadcast table of the lengths of the corpus's
most frequent pre-tokens, at most FREQUENT of them.  They are found over all texts by frequent-item sketches of bounded
size: each task folds its pre-tokens into one, and only sketches move.  What the table misses is encoded by the library
once per Python worker and kept in a bounded cache.  No pre-token is ever shuffled, and the counts are those of the
library on whole texts, whichever pre-tokens a sketch returns.

Texts for which cutting could differ from the library's (characters outside the ranges of SAFE, special strings of
the tokenizer) are encoded whole by the library.

Defined cases: a null text counts as an empty one: 0 bytes, 0 tokens.  Order, repeats and other columns don't matter.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty

#: Fixed value: the pre-token pattern of byte-level BPE.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of other characters go to the library whole.
SAFE = r"[\t\n\r\x20-\x7e -¬®-ȳΑ-ΡΣ-ωА-я‐-‧€]*"
#: Longest pre-token that the table and a worker's cache keep, and the most entries of a cache.
KEPT_CHARS, CACHE_ENTRIES = 48, 1_000_000
#: Entries of the broadcast table; items that a sketch tracks; sketches that are merged before the last one.
FREQUENT, TRACKED, GROUPS = 20_000, 65_536, 64

_worker: dict = {}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _load(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def frequent(docs: DataFrame, text: str = "text", n: int = FREQUENT) -> list[str]:
    """The ``n`` most frequent pre-tokens of all texts, as far as a sketch tells; in two steps of merging."""
    pre = F.explode(F.regexp_extract_all(F.col(text), F.lit(PRE_TOKEN), F.lit(0)))
    rows = docs.filter(F.col(text).isNotNull()).select(pre.alias("pre"), (F.spark_partition_id() % GROUPS).alias("part")).filter(F.length("pre") <= KEPT_CHARS)
    # grouped throughout: without pre-tokens there is no sketch, and no empty one to estimate from
    parts = rows.groupBy("part").agg(F.expr(f"approx_top_k_accumulate(pre, {TRACKED})").alias("sketch"))
    top = parts.groupBy(F.lit("all")).agg(F.expr(f"approx_top_k_combine(sketch, {TRACKED})").alias("sketch")).select(F.explode(F.expr(f"approx_top_k_estimate(sketch, {n})")).alias("x"))
    return sorted(r["item"] for r in top.select("x.item").collect())


def lengths(path: str, pres: list[str]) -> dict[str, int]:
    """Lengths in tokens of those of ``pres`` that are whole pre-tokens and hold no special string."""
    t, cut = _load(path), regex.compile(PRE_TOKEN)
    special = [x.content for x in t.get_added_tokens_decoder().values()]
    whole = [x for x in pres if cut.fullmatch(x) and not any(s in x for s in special)]
    return {x: len(e.ids) for x, e in zip(whole, t.encode_batch(whole, add_special_tokens=False), strict=True)}


class Counter:
    """Counts in one worker: the broadcast table, with the cache in one dictionary, then the library."""

    def __init__(self, path: str, frequent: dict[str, int]):
        self.tokenizer, self.frequent, self.known = _load(path), frequent, dict(frequent)
        self.cut, self.safe = regex.compile(PRE_TOKEN).findall, regex.compile(SAFE).fullmatch
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def miss(self, pre: str) -> int:
        n = self.known.get(pre)
        if n is None:
            n = self.whole(pre)
            if len(pre) <= KEPT_CHARS:
                if len(self.known) >= len(self.frequent) + CACHE_ENTRIES:
                    self.known = dict(self.frequent)
                self.known[pre] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.safe(text) or any(s in text for s in self.special):
            return self.whole(text)
        pres = self.cut(text)
        got = list(map(self.known.get, pres))
        if None not in got:
            return sum(got)
        miss, n = self.miss, 0
        for pre, g in zip(pres, got, strict=True):
            n += miss(pre) if g is None else g
        return n


def count_tokens(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens, the library's count for the whole of each text."""
    table_, key = docs.sparkSession.sparkContext.broadcast(lengths(path, frequent(docs, text))), uuid.uuid4().hex

    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if key not in _worker:
            _worker.clear()
            _worker[key] = Counter(path, table_.value)
        for texts in batches:
            yield texts.map(_worker[key].count, na_action=None).astype("int64")

    return docs.withColumn("n_tokens", n_tokens(F.col(text)))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty().alias("text"))
    return count_tokens(docs, tokenizer_path()).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))
