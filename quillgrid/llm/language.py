"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from its code point.  A trigram of letters (and word gaps) is bound
as the product of the first letter's vector rotated twice, the second's rotated once and the third's.  A document's
profile bundles (sums) the vectors of its trigrams; a language's prototype bundles the trigrams of all its documents.
Prediction takes the prototype of the largest cosine.

As bundling is a sum, a profile is computed from trigram counts: counts times trigram vectors.  Learning reduces each
partition to one vector a language, so what meets in the shuffle and on the driver is languages x DIM numbers.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, as is everything if no language is
learned.  Rows with a null id or a null lang teach nothing.  Ties go to the first language by code point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, table

#: Length of the vectors, seed of the letters, most trigram vectors kept by a worker (4 bytes x DIM each).
DIM, SEED, KEPT = 512, 20240, 40_000
#: Longest stretch of text that is counted at once.
STRETCH = 1 << 20

_worker: dict = {}


class Letters:
    """Codes of characters, from 1 in the order first seen; 0 is the gap between words."""

    def __init__(self) -> None:
        self.code = np.full(0x110000, -1, np.int32)
        self.vectors = [self.draw(0)]
        self.trigrams: dict[int, int] = {}
        self.bound = np.zeros((KEPT, DIM), np.float32)

    @staticmethod
    def draw(point: int) -> np.ndarray:
        return np.random.default_rng([SEED, point]).integers(0, 2, DIM).astype(np.float32) * 2 - 1

    def codes(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        got = self.code[points]
        if (got < 0).any():
            for p in np.unique(points[got < 0]).tolist():
                ch = chr(p)
                if ch.isalpha():
                    self.code[p] = len(self.vectors)
                    self.vectors.append(self.draw(p))
                else:
                    self.code[p] = 0
            got = self.code[points]
        return got

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Keys and counts of the trigrams of a text: letters in lower case, gaps collapsed, one at either end."""
        keys: list[np.ndarray] = []
        low = text.lower()
        held = np.zeros(1, np.int64)  # the gap at the start; then the last two codes so far, so that a cut changes nothing
        for at in range(0, len(low), STRETCH):
            c = np.concatenate([held, self.codes(low[at : at + STRETCH]), [0] if at + STRETCH >= len(low) else []]).astype(np.int64)
            c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]
            if len(c) >= 3:
                keys.append((c[:-2] << 42) | (c[1:-1] << 21) | c[2:])
            held = c[-2:]
        if not keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.unique(np.concatenate(keys), return_counts=True)

    def profile(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        rows = np.fromiter((self.trigrams.get(k, -1) for k in keys.tolist()), np.int64, len(keys))
        for j in np.nonzero(rows < 0)[0].tolist():
            if len(self.trigrams) >= KEPT:  # beyond what is kept: bound anew
                break
            rows[j] = self.trigrams[int(keys[j])] = len(self.trigrams)
            self.bound[rows[j]] = self.bind(int(keys[j]))
        known = rows >= 0
        out = counts[known].astype(np.float32) @ self.bound[rows[known]]
        for j in np.nonzero(~known)[0].tolist():
            out = out + counts[j] * self.bind(int(keys[j]))
        return out

    def bind(self, key: int) -> np.ndarray:
        a, b, c = key >> 42, (key >> 21) & 0x1FFFFF, key & 0x1FFFFF
        return np.roll(self.vectors[a], 2) * np.roll(self.vectors[b], 1) * self.vectors[c]


def _letters() -> Letters:
    if "letters" not in _worker:
        _worker["letters"] = Letters()
    return _worker["letters"]


def prototypes(rows: DataFrame) -> dict[str, np.ndarray]:
    """Unit vectors by language, from ``rows`` (lang, text) without nulls."""

    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters, sums = _letters(), {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                keys, counts = letters.counts(text)
                if len(keys):
                    own = sums.setdefault(lang, np.zeros(DIM))
                    own += letters.profile(keys, counts) / np.sqrt(float((counts.astype(np.float64) ** 2).sum()))
        if sums:
            yield pd.DataFrame({"lang": list(sums), "v": [x.tolist() for x in sums.values()]})

    parts = rows.mapInPandas(bundle, "lang string, v array<double>")
    summed = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    learned: dict[str, np.ndarray] = {}
    for r in summed.collect():  # languages x DIM rows
        learned.setdefault(r["lang"], np.zeros(DIM))[r["i"]] = round(r["x"], 6)  # the same whatever the order of sums
    return {k: v / n for k, v in sorted(learned.items()) if (n := np.linalg.norm(v)) > 0}


def predict(docs: DataFrame, learned: dict[str, np.ndarray]) -> DataFrame:
    """``docs`` with lang_pred and score, half of one plus the cosine to that language's prototype."""
    names, matrix = list(learned), np.array([*learned.values()], np.float32).reshape(len(learned), DIM)

    @F.pandas_udf("lang_pred string, score double")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        letters = _letters()
        for texts in batches:
            found = []
            for text in texts:
                keys, counts = letters.counts(text) if text else ((), ())
                if not len(keys) or not names or not keys.any():
                    found.append(("und", 0.0))
                    continue
                v = letters.profile(keys, counts)
                cos = matrix @ v / max(float(np.linalg.norm(v)), 1e-9)
                best = int(np.argmax(cos))
                found.append((names[best], float(np.clip((1 + cos[best]) / 2, 0, 1))))
            yield pd.DataFrame(found, columns=["lang_pred", "score"])

    return docs.withColumn("lang_found", nearest("text")).select(*[F.col(c) for c in docs.columns], F.col("lang_found.lang_pred").alias("lang_pred"), F.col("lang_found.score").alias("score"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_mod(F.col("doc_id"), 4) == 2
    learned = prototypes(docs.filter(~held & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text"))
    return predict(docs.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "text"), learned).drop("text")
