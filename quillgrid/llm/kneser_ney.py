"""Language-model scoring: an interpolated modified Kneser-Ney bigram model.

Counting: each task reduces its texts to sorted arrays of word-pair hashes with counts and sends them, as a few large
rows, to the shard of the left word; a shard merges what it gets.  A shard's pairs, and the totals of its left words,
become sorted hash arrays in files of the shared folder.  A second, smaller round counts the different left words of
each right word.  Workers map the files into memory (pages are shared and evictable) and look up sorted batches of
hashes.  All texts are counted and every pair is kept; shards grow in number with the corpus.

A first pass over all texts finds the hot left words, those with over 1 / (HOT_PARTS shards) of all tokens in front of
others.  The pairs of each are dealt by their right word over as many shards as its share asks for, so that no shard
holds more of them than of other words; their totals, which then come in parts, are added up and travel with the model.

p(w | h) = max(c(hw) - D(c(hw)), 0) / c(h) + g(h) q(w), where g(h) is what the discounts took, q is built likewise from
the number of different words before w and mixed with 1 / (V + 1); D1, D2, D3+ follow from the counts of counts.

Defined cases: a null text is an empty one, with one token, its end.  Without training texts all probabilities are 1.
Rows with a null id are scored but teach nothing (they have no remainder).  Repeated rows count as often as they stand.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, fresh_path, release_shuffles, table, text_or_empty, written

END, START = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC949C7D23E6D1B2B)
#: Right words are told apart by so many bits within one left word's pairs.
RIGHT_BITS = 40
RIGHT_MASK = np.uint64((1 << RIGHT_BITS) - 1)
#: Tokens that a task counts at once; bytes of text for each shard; tokens scored at once.
TOKENS, SHARD_BYTES, SCORED = 2_000_000, 24 << 20, 1_000_000
#: Parts of a shard's size into which a hot word's pairs are cut; the least share of the tokens that makes a word hot.
HOT_PARTS, HOT_SHARE = 4, 1e-6
U64 = np.uint64


def tokens(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def hashes(words: list[bytes]) -> np.ndarray:
    """Word hashes and the end's, of one text."""
    import xxhash

    out = np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, len(words))
    return np.append(out, END)


def mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One 64-bit hash of a pair."""
    x = left * U64(0x9E3779B97F4A7C15) ^ (right & RIGHT_MASK) * U64(0xC2B2AE3D27D4EB4F)
    x ^= x >> U64(31)
    x *= U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def shard_of(left: np.ndarray, shards: int) -> np.ndarray:
    return ((left >> U64(40)) * U64(shards) >> U64(24)).astype(np.int64)


Hot = Pair = tuple[np.ndarray, np.ndarray]
START_ONLY = np.array([START], U64)
NO_HOT: Hot = (np.zeros(0, U64), np.zeros(0, U64))


def places(left: np.ndarray, right: np.ndarray, shards: int, hot: Hot) -> np.ndarray:
    """Shards of pairs: by the left word; by left word and a range of right words where the left one is hot."""
    words, parts = hot
    at, there = found(words, left)
    if there.any():
        part = (right[there] & RIGHT_MASK) * parts[at[there]] >> U64(RIGHT_BITS)
        left = left.copy()
        left[there] = mixed(left[there], part)
    return shard_of(left, shards)


def found(values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in sorted values, and whether each is there."""
    if not len(values):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
    return at, values[at] == wanted


def joined(held: list[np.ndarray]) -> Pair:
    """Left and right words of the texts of ``held``, which is emptied, so that they are in memory once."""
    left, right = np.concatenate([x for h in held for x in (START_ONLY, h[:-1])]), np.concatenate(held)
    held.clear()
    return left, right


def pairs_of(batches: Iterator[pd.DataFrame]) -> Iterator[Pair]:
    """Left and right words of the texts, TOKENS or somewhat more at a time."""
    held, size = [], 0
    for batch in batches:
        for text in batch["text"]:
            held.append(hashes(tokens(text)))
            size += len(held[-1])
            if size >= TOKENS:
                size = 0
                yield joined(held)
    if held:
        yield joined(held)


def hot_words(texts: DataFrame, shards: int) -> Hot:
    """The left words with over a part of a shard of all tokens, sorted, and into how many parts each is cut.

    A word of such a share has it in some batch, and at least half of its tokens are in batches where it has half of it;
    so batches report only those, a bounded number each, and the result is at most 2 / HOT_SHARE words.
    """
    least = max(1 / (HOT_PARTS * shards), HOT_SHARE)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for left, _ in pairs_of(batches):
            words, n = np.unique(left, return_counts=True)
            total = int(n.sum())
            keep = n >= least * total / 2
            yield pd.DataFrame({"word": np.append(words[keep].view(np.int64), 0), "n": np.append(n[keep], 0), "total": np.append(np.zeros(keep.sum(), np.int64), total)})

    if shards == 1:
        return NO_HOT
    rows = written(texts.mapInPandas(counted, "word long, n long, total long"), "hot-words")
    total = rows.agg(F.sum("total")).first()[0] or 0
    got = rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") > least * total / 2).collect()
    found_ = sorted((r["word"] % (1 << 64), int(2 * r["n"] / (least * total)) + 1) for r in got)
    return np.array([w for w, _ in found_], U64), np.array([min(k, 1 << 20) for _, k in found_], U64)


def _order(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.lexsort((right, left))


def _sum_equal(left: np.ndarray, right: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs in order, equal ones added up."""
    if not len(left):
        return left, right, n
    o = _order(left, right)
    left, right, n = left[o], right[o], n[o]
    first = np.flatnonzero(np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])]))
    return left[first], right[first], np.add.reduceat(n, first)


def packed(left: np.ndarray, right: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted pairs as bytes: each left word once, 5 bytes of each right word, counts of 1 byte, large ones apart."""
    first = np.flatnonzero(np.concatenate([[True], left[1:] != left[:-1]]))
    lens = np.diff(np.append(first, len(left))).astype("<u4")
    big = np.flatnonzero(n >= 255).astype("<u4")
    return b"".join([
        struct.pack("<QQQ", len(first), len(left), len(big)), left[first].astype("<u8").tobytes(), lens.tobytes(),
        right.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes(), np.minimum(n, 255).astype(np.uint8).tobytes(), big.tobytes(), n[big].astype("<u8").tobytes(),
    ])


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k, m, b = struct.unpack_from("<QQQ", data)
    at = 24
    left = np.frombuffer(data, "<u8", k, at)
    lens = np.frombuffer(data, "<u4", k, at := at + 8 * k)
    five = np.frombuffer(data, np.uint8, 5 * m, at := at + 4 * k)
    one = np.frombuffer(data, np.uint8, m, at := at + 5 * m)
    big = np.frombuffer(data, "<u4", b, at := at + m)
    large = np.frombuffer(data, "<u8", b, at + 4 * b)
    eight = np.zeros((m, 8), np.uint8)
    eight[:, :5] = five.reshape(-1, 5)
    n = one.astype(U64)
    n[big] = large
    return np.repeat(left, lens), eight.view("<u8").ravel(), n


def _local(path: str) -> str | None:
    return path[5:] if path.startswith("file:") else path if path.startswith("/") else None


def _save(path: str, arrays: dict[str, np.ndarray]) -> None:
    """Write arrays under ``path``; a task that is run again writes the same bytes, and files appear whole."""
    from pyarrow import fs

    store, base = (fs.LocalFileSystem(), os.path.normpath(_local(path))) if _local(path) else fs.FileSystem.from_uri(path)
    store.create_dir(base, recursive=True)
    for name, x in arrays.items():
        part = f"{base}/{name}.{os.getpid()}.{os.urandom(4).hex()}"
        with store.open_output_stream(part) as out:
            out.write(np.ascontiguousarray(x).tobytes())
        store.move(part, f"{base}/{name}")


def _map(path: str, dtype: type) -> np.ndarray:
    """A file's array, mapped into memory; one in a remote store is mapped from an unlinked local copy."""
    import tempfile

    from pyarrow import fs

    if local := _local(path):
        return np.memmap(os.path.normpath(local), dtype, "r") if os.path.getsize(os.path.normpath(local)) else np.zeros(0, dtype)
    store, base = fs.FileSystem.from_uri(path)
    with store.open_input_stream(base) as src, tempfile.NamedTemporaryFile() as copy:
        while block := src.read(1 << 24):
            copy.write(block)
        copy.flush()
        return np.memmap(copy.name, dtype, "r") if os.path.getsize(copy.name) else np.zeros(0, dtype)


def count_pairs(texts: DataFrame, shards: int, hot: Hot = NO_HOT) -> DataFrame:
    """(shard, data): packed pair counts of each task's texts."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for left, right in pairs_of(batches):
            left, right, n = _sum_equal(left, right & RIGHT_MASK, np.ones(len(left), U64))
            shard = places(left, right, shards, hot)
            by = np.argsort(shard, kind="stable")
            left, right, n = left[by], right[by], n[by]
            cut = np.searchsorted(shard[by], np.arange(shards + 1))
            rows = [(s, packed(left[a:b], right[a:b], n[a:b])) for s, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if b > a]
            yield pd.DataFrame(rows, columns=["shard", "data"])

    return texts.mapInPandas(counted, "shard int, data binary")


STATS = "shard int, right_shard int, data binary, total long, kinds long, ones long, twos long, threes long, fours long"


#: In the place of a right shard: a shard's counts of counts; its parts of hot words' totals.
COUNTS, HOT = -1, -2


def merge_shards(parts: DataFrame, path: str, shards: int, hot: Hot = NO_HOT) -> DataFrame:
    """Write each shard's arrays; rows of its counts of counts, of hot words, and of right words for the second round."""

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        shard, data = int(key[0]), pdf["data"]
        left, right, n = _sum_equal(*map(np.concatenate, zip(*map(unpacked, data), strict=True)))
        first = np.flatnonzero(np.concatenate([[True], left[1:] != left[:-1]]))
        add = lambda x: np.add.reduceat(x.astype(U64), first)
        by_key = np.argsort(keys := mixed(left, right))
        big = n[by_key] >= 255
        words, counts = left[first], np.stack([add(n), add(n == 1), add(n == 2), add(n > 2)], axis=1)
        is_hot = found(hot[0], words)[1]
        _save(f"{path}/left-{shard:06d}", {
            "words": words[~is_hot], "counts": counts[~is_hot],
            "pairs": keys[by_key], "n": np.minimum(n[by_key], 255).astype(np.uint8), "big": keys[by_key][big], "big_n": n[by_key][big],
        })
        rights, befores = np.unique(right, return_counts=True)
        place = (rights * U64(shards) >> U64(RIGHT_BITS)).astype(np.int64)
        cut = np.searchsorted(place, np.arange(shards + 1))
        rows = [(shard, COUNTS, b"", int(n.sum()), int((~is_hot).sum()), *[int((n == k).sum()) for k in (1, 2, 3, 4)])]
        if is_hot.any():
            rows.append((shard, HOT, words[is_hot].tobytes() + counts[is_hot].tobytes(), 0, 0, 0, 0, 0, 0))
        rows += [(shard, s, rights[a:b].tobytes() + befores[a:b].astype(U64).tobytes(), 0, 0, 0, 0, 0, 0) for s, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if b > a]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in STATS.split(", ")])

    return parts.repartition(shards, "shard").groupBy("shard").applyInPandas(merge, STATS)


def merge_rights(rows: DataFrame, path: str, shards: int) -> DataFrame:
    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        both = [np.frombuffer(d, U64).reshape(2, -1) for d in pdf["data"]]
        words, befores = np.concatenate([x[0] for x in both]), np.concatenate([x[1] for x in both])
        o = np.argsort(words, kind="stable")
        words, befores = words[o], befores[o]
        first = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
        n = np.add.reduceat(befores, first)
        _save(f"{path}/right-{int(key[0]):06d}", {"words": words[first], "n": n})
        return pd.DataFrame([(int(n.sum()), len(n), *[int((n == k).sum()) for k in (1, 2, 3)], int((n == 4).sum()))], columns=["total", "kinds", "ones", "twos", "threes", "fours"])

    return rows.repartition(shards, "right_shard").groupBy("right_shard").applyInPandas(merge, "total long, kinds long, ones long, twos long, threes long, fours long")


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """D for counts 0, 1, 2 and more, by the counts of counts; in bounds where those are too few."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [0.0, *[min(max(x, 0.05), k - 0.05) for k, x in enumerate(d, 1)]]


_models: dict[str, Model] = {}


class Model:
    """The mapped arrays of a model, opened shard by shard."""

    def __init__(self, path: str, info: dict):
        self.path, self.info, self.files = path, info, {}

    def array(self, name: str, dtype: type) -> np.ndarray:
        if name not in self.files:
            self.files[name] = _map(f"{self.path}/{name}", dtype)
        return self.files[name]

    def by_shard(self, shard: np.ndarray, present: set[int]) -> Iterator[tuple[int, slice]]:
        """Stretches of equal shard of a sorted array."""
        cut = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])) if len(shard) else []
        for a, b in zip(cut, cut[1:], strict=False):
            if int(shard[a]) in present:
                yield int(shard[a]), slice(a, b)

    def words(self, left: np.ndarray) -> np.ndarray:
        """Totals and counts of ones, twos and more, of sorted words: (n, 4)."""
        out = np.zeros((len(left), 4))
        for s, part in self.by_shard(shard_of(left, self.info["shards"]), self.info["left"]):
            at, there = found(self.array(f"left-{s:06d}/words", U64), left[part])
            rows = self.array(f"left-{s:06d}/counts", U64).reshape(-1, 4)[at].astype(float)
            out[part] = rows * there[:, None]
        at, there = found(self.info["hot"][0], left)
        out[there] = self.info["hot_counts"][at[there]]
        return out

    def lower(self, right: np.ndarray) -> np.ndarray:
        """q of sorted right words."""
        i = self.info
        n = np.zeros(len(right))
        for s, part in self.by_shard((right * U64(i["shards"]) >> U64(RIGHT_BITS)).astype(np.int64), i["right"]):
            at, there = found(self.array(f"right-{s:06d}/words", U64), right[part])
            n[part] = self.array(f"right-{s:06d}/n", U64)[at] * there
        if not i["q_total"]:
            return np.ones(len(right))
        d = np.array(i["q_discounts"])
        return np.maximum(n - d[np.minimum(n, 3).astype(int)], 0) / i["q_total"] + i["q_left"] / (i["vocabulary"] + 1)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Counts of pairs."""
        shard, keys = places(left, right, self.info["shards"], self.info["hot"]), mixed(left, right)
        by = np.lexsort((keys, shard))  # in order, neighbours share pages
        own = np.zeros(len(left))
        for s, part in self.by_shard(shard[by], self.info["left"]):
            wanted, name = keys[by[part]], f"left-{s:06d}"
            at, there = found(self.array(f"{name}/pairs", U64), wanted)
            n = self.array(f"{name}/n", np.uint8)[at].astype(float) * there
            if (big := n == 255).any():
                where, _ = found(self.array(f"{name}/big", U64), wanted[big])
                n[big] = self.array(f"{name}/big_n", U64)[where]
            own[part] = n
        out = np.empty(len(left))
        out[by] = own
        return out

    def score(self, texts: list[str]) -> pd.DataFrame:
        """n_tokens, n_known, base_score and score of each text."""
        i = self.info
        each = [hashes(tokens(t)) for t in texts]
        sizes = np.array([len(h) for h in each])
        first = np.cumsum(sizes) - sizes
        right = np.concatenate(each)
        left = np.concatenate([[START], right[:-1]])
        left[first] = START
        words, at = np.unique(np.append(right, START), return_inverse=True)
        counts = self.words(words)
        c = counts[at[:-1], 0]
        c[first + sizes - 1] = counts[at[-1], 0]  # there are as many ends as starts
        base = np.log10((c + 1) / (i["tokens"] + i["vocabulary"] + 1))
        low, low_at = np.unique(right & RIGHT_MASK, return_inverse=True)
        q = self.lower(low)[low_at]
        where = np.empty(len(left), np.int64)
        where[1:], where[first] = at[:-2], at[-1]
        n = self.pairs(left, right)
        total = counts[where, 0]
        d = np.array(i["discounts"])
        with np.errstate(divide="ignore", invalid="ignore"):
            seen = np.maximum(n - d[np.minimum(n, 3).astype(int)], 0) / total + counts[where, 1:] @ d[1:] / total * q
        p = np.where(total > 0, seen, q)
        return pd.DataFrame({"n_tokens": sizes, "n_known": np.add.reduceat((c > 0).astype(np.int64), first), "base_score": np.add.reduceat(base, first), "score": np.add.reduceat(np.log10(p), first)})


def train(texts: DataFrame) -> tuple[str, dict]:
    """Count a model of ``texts`` (text, no nulls); its folder and constants."""
    spark = texts.sparkSession
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    path = fresh_path(spark, "ngrams")
    hot = hot_words(texts, shards)
    stats = written(merge_shards(count_pairs(texts, shards, hot), path, shards, hot), "ngram-stats")
    hot_counts = np.zeros((len(hot[0]), 4))
    for r in stats.filter(F.col("right_shard") == HOT).select("data").collect():
        x = np.frombuffer(r["data"], U64)
        at, _ = found(hot[0], x[: len(x) // 5])
        hot_counts[at] += x[len(x) // 5 :].reshape(-1, 4)
    left = stats.filter(F.col("right_shard") == COUNTS).select("shard", "total", "kinds", "ones", "twos", "threes", "fours").collect()
    release_shuffles(spark)
    rights = written(merge_rights(stats.filter("right_shard >= 0").select("right_shard", "data"), path, shards), "ngram-rights").collect()
    of = lambda rows, k: sum(r[k] for r in rows)
    q = [of(rights, k) for k in ("ones", "twos", "threes", "fours")]
    q_total, kinds = of(rights, "total"), of(rights, "kinds")
    qd = discounts(*q)
    more = kinds - q[0] - q[1]
    words = of(left, "kinds") + int((hot_counts[:, 0] > 0).sum())  # every word but the end stands on the left, as does the start, once for each text
    info = {
        "shards": shards, "hot": hot, "hot_counts": hot_counts, "left": {r["shard"] for r in left}, "right": {r["right_shard"] for r in stats.filter("right_shard >= 0").select("right_shard").distinct().collect()},
        "tokens": of(left, "total"), "vocabulary": words, "discounts": discounts(*[of(left, k) for k in ("ones", "twos", "threes", "fours")]),
        "q_total": q_total, "q_discounts": qd, "q_left": (qd[1] * q[0] + qd[2] * q[1] + qd[3] * more) / q_total if q_total else 1.0,
    }
    return path, info


def scored(docs: DataFrame, path: str, info: dict) -> DataFrame:
    """``docs`` with n_tokens, n_known, base_score and score of column text (no nulls); text goes."""

    @F.pandas_udf("n_tokens long, n_known long, base_score double, score double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if path not in _models:
            _models.clear()
            _models[path] = Model(path, info)
        for texts in batches:
            out, held, size = [], [], 0
            for text in texts:
                held.append(text)
                size += len(text)
                if size >= 5 * SCORED:
                    out.append(_models[path].score(held))
                    held, size = [], 0
            if held:
                out.append(_models[path].score(held))
            yield pd.concat(out, ignore_index=True) if out else pd.DataFrame({"n_tokens": [], "n_known": [], "base_score": [], "score": []})

    rest = [c for c in docs.columns if c != "text"]
    return docs.withColumn("lm", of("text")).select(*rest, "lm.*")


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty().alias("text"), (crc_mod(F.col("doc_id"), 7) == 2).alias("held"))
    path, info = train(docs.filter(~F.col("held")).select("text"))
    out = scored(docs.select("doc_id", F.coalesce("held", F.lit(False)).alias("held_out"), "text"), path, info)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(info["tokens"])).cast("long").alias("train_tokens"), "base_score", "score")
