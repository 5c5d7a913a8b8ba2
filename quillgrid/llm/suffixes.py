"""Exact substring dedup by a logarithmic family of suffix arrays.

A byte is removed if a LENGTH-byte string that covers it also starts anywhere else.  The strings of LENGTH bytes
("windows") are compared in three steps, none of which holds more than a bounded share of the corpus.

1. Every window has a key: the least hash of its MER-byte strings, a function of the window alone.  Neighbouring
   windows share keys, so a text becomes runs of windows (about 180 each).  A run is named by its key and the hash of
   its bytes; equal runs are counted (map-side first), so copies collapse whatever their number.
2. Windows can only be equal within a key.  A key with one run that occurs once has no match, unless the key's string
   stands in the run more than once ("folded"); one run that occurs often matches itself, throughout.  Only keys with
   different runs, or a folded one, have their (distinct) runs' bytes compared.
3. Those runs are dealt out by key.  A task reads them in batches; each new batch gets a suffix array (its windows,
   sorted by rank doubling to LENGTH bytes).  Arrays of one level are merged into one of the next, in which equal
   windows of the two stand together: so every window is compared with all others of its task in a logarithmic number
   of merges.

A key of a hot group (near copies of one text, say) may have any number of different runs.  One of over HOT kinds is not
compared in one task: the windows of its runs are dealt out by hashes of 128 bits, and those of equal hashes match.

The pipeline's stage removes, besides, what stands in a repeated passage of WORDS words.  There the same three steps
run over texts whose words are coded as CODE bytes each (the word's hash), with windows of WORDS codes; spans shrink to
whole codes.  Windows off the codes' bounds can only add a word if 64 bits agree by chance.

Matches go back to texts as intervals.  The answers depend on bytes only: hashes route and collapse (128 bits or more
must agree), and what they collapse is never split.

Defined cases: a null text is an empty one.  Equal texts, repeated rows and copies under other ids alike, match each
other in whole.  Texts shorter than LENGTH keep all bytes.  Matches may overlap and never cross documents.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, forget_tables, release_shuffles, small_batches, table, tables_so_far, text_or_empty, trimming, written

LENGTH, MER = 400, 32
#: Words of the least repeated passage that the pipeline's stage removes, whatever its bytes; bytes of a word's code.
WORDS, CODE = 51, 8
#: Bytes of text that are hashed at once; bytes of a batch; bytes of runs that a task should get.
STRETCH, BATCH, SHARE = 1 << 22, 1 << 21, 3 << 19
#: A key with more kinds of run is dealt out by the hashes of its windows, so many kinds a shard.
HOT = 512

U64 = np.uint64


def _odd(x: int) -> tuple[int, int]:
    return x, pow(x, -1, 1 << 64)


_BASE, _INVERSE = _odd(0x9E3779B97F4A7C15 | 1)
_BYTE = np.random.default_rng(400).integers(0, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, b in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, U64(b))
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def mer_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the MER bytes from each position."""
    n = len(data)
    up, down = powers(n)
    total = np.empty(n + 1, U64)
    total[0] = 0
    np.cumsum(_BYTE[data] * up, out=total[1:])
    h = (total[MER:] - total[:-MER]) * down[: n - MER + 1]
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(29)
    return h


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours."""
    n = len(x)
    blocks = -(-n // w)
    padded = np.full(blocks * w, np.iinfo(np.uint64).max, U64)
    padded[:n] = x
    grid = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def runs_of(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Runs of windows with one key: first window, one past the last window, key, does its string stand twice."""
    firsts, ends, keys, folds = [], [], [], []
    n = len(data) - length + 1
    whole = np.frombuffer(data, np.uint8)
    for at in range(0, n, STRETCH):  # a run may be cut at a stretch's end: at the same offsets only in equal texts
        to = min(n, at + STRETCH)
        mers = mer_hashes(whole[at : to + length - 1])
        key = sliding_min(mers, length - MER + 1)
        cut = np.flatnonzero(key[1:] != key[:-1]) + 1
        first = np.concatenate([[0], cut])
        end, count = np.append(cut, to - at), np.count_nonzero
        firsts.append(first + at)
        ends.append(end + at)
        keys.append(key[first])
        folds.append([count(mers[a : b + length - MER] == k) > 1 for a, b, k in zip(first.tolist(), end.tolist(), key[first], strict=True)])
    return np.concatenate(firsts), np.concatenate(ends), np.concatenate(keys), np.concatenate(folds)


RUNS = "text_key binary, first int, end int, key long, body long, folded boolean"


def text_key(data: bytes) -> bytes:
    return hashlib.md5(data).digest()


def plain(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def coded(text: str) -> bytes:
    """The text's words (see WORD), each as a hash of CODE bytes."""
    import xxhash

    return b"".join(map(xxhash.xxh3_64_digest, plain(text).split()))


def uncoded(text: bytes, spans: list) -> list[dict]:
    """Spans of ``text``, from spans of its code: from the first whole word to the end of the last one."""
    at = [m.span() for m in re.finditer(WORD.encode(), text)]
    return [{"a": at[-(-s["a"] // CODE)][0], "b": at[s["b"] // CODE - 1][1]} for s in spans]


def text_runs(docs: DataFrame, length: int = LENGTH, encode: Callable[[str], bytes] = plain) -> DataFrame:
    """The runs of all texts: ``docs`` has a column text without nulls."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            out: list[tuple] = []
            for text in batch["text"]:
                data = encode(text)
                if len(data) < length:
                    continue
                first, end, key, folded = runs_of(data, length)
                view = memoryview(data)
                body = [digest(view[a : b + length - 1]) for a, b in zip(first.tolist(), end.tolist(), strict=True)]
                own = np.empty(len(first), object)
                own[:] = [text_key(plain(text))] * len(first)  # np.full would strip a key's trailing zeros
                out.append((own, first, end, key.view(np.int64), np.array(body, U64).view(np.int64), folded))
            if out:
                cols = [np.concatenate(x) for x in zip(*out, strict=True)]
                yield pd.DataFrame(dict(zip(("text_key", "first", "end", "key", "body", "folded"), cols, strict=True)))

    return docs.select("text").mapInPandas(trimming(found), RUNS)


class Level:
    """A suffix array: windows of a text buffer, sorted; and which of them have an equal."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, matched: np.ndarray, length: int = LENGTH):
        """starts: of the windows in ``data``, in ascending order; matched: of those."""
        self.data, self.starts, self.length = data, starts, length
        rank = self._ranks()
        order = np.argsort(rank, kind="stable")
        sorted_rank = rank[order]
        same = sorted_rank[1:] == sorted_rank[:-1]
        equal = np.zeros(len(starts), bool)
        equal[1:] = same
        equal[:-1] |= same
        self.order = order.astype(np.int32)
        matched[order] |= equal
        self.matched = matched

    def _ranks(self) -> np.ndarray:
        """Ranks of the windows by their bytes: equal ranks for equal windows."""
        n = len(self.data)
        word = np.zeros(n, U64)
        for i in range(8):
            word[: n - 7] = (word[: n - 7] << U64(8)) | self.data[i : n - 7 + i]
        rank, depth = _dense(word), 8
        fan = 3 if n <= 1 << 21 else 2  # so many ranks fit into 64 bits
        while depth < self.length:
            reach = min(self.length, fan * depth)
            offsets = sorted({0, *[min(k * depth, reach - depth) for k in range(1, fan)]})
            size = n - reach + 1
            keys = np.zeros(size, U64)
            for o in offsets:
                keys = (keys << U64(64 // fan)) | rank[o : o + size].astype(U64)
            depth = reach
            if depth == self.length:
                return _dense(keys[self.starts])
            rank = _dense(keys)
        raise AssertionError

    @staticmethod
    def merged(a: Level, b: Level) -> Level:
        return Level(np.concatenate([a.data, b.data]), np.concatenate([a.starts, b.starts + len(a.data)]), np.concatenate([a.matched, b.matched]), a.length)


def _dense(x: np.ndarray) -> np.ndarray:
    order = np.argsort(x)
    s = x[order]
    rank = np.empty(len(x), np.uint32)
    rank[order] = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
    return rank


class Family:
    """Levels of doubling size; every window added is compared with all others."""

    def __init__(self, length: int = LENGTH) -> None:
        self.length = length
        self.levels: list[tuple[int, Level]] = []

    def add(self, bodies: list[bytes]) -> None:
        sizes = np.array([len(x) for x in bodies], np.int64)
        at = np.cumsum(sizes) - sizes
        windows = sizes - self.length + 1
        starts = np.repeat(at - np.cumsum(windows) + windows, windows) + np.arange(windows.sum())
        new = Level(np.frombuffer(b"".join(bodies), np.uint8), starts, np.zeros(len(starts), bool), self.length)
        self.levels.append((0, new))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (k, b), (_, a) = self.levels.pop(), self.levels.pop()
            self.levels.append((k + 1, Level.merged(a, b)))

    def matched(self) -> np.ndarray:
        """For all windows in the order in which they were added: does it have an equal?"""
        while len(self.levels) > 1:
            (_, b), (k, a) = self.levels.pop(), self.levels.pop()
            self.levels.append((k, Level.merged(a, b)))
        return self.levels[0][1].matched if self.levels else np.zeros(0, bool)


def intervals(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and one past the last of each stretch of true."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


ROUTED = "route long, key long, body long, data binary, starts binary"
MATCHES = "key long, body long, spans array<struct<a:int,b:int>>"


def routed(key: int, body: int, data: bytes, kinds: int, length: int) -> list[tuple]:
    """A run as rows of ROUTED: itself, or if its key has over HOT kinds of run, the hashes of its windows by shard."""
    import xxhash

    if kinds <= HOT:
        return [(key, key, body, data, None)]
    view = memoryview(data)
    digests = b"".join(xxhash.xxh3_128_digest(view[i : i + length]) for i in range(len(data) - length + 1))
    hashes = np.frombuffer(digests, U64).reshape(-1, 2)
    shard = hashes[:, 0] % U64(-(-kinds // HOT))
    out = []
    for s in np.unique(shard).tolist():
        at = np.flatnonzero(shard == s)
        route = xxhash.xxh3_64_intdigest(b"%d %d" % (key, s))
        out.append((route - (1 << 64) if route >> 63 else route, key, body, hashes[at].tobytes(), at.astype(np.int32).tobytes()))
    return out


def equal_hashes(rows: list[tuple]) -> Iterator[tuple]:
    """Matched windows of rows (key, body, hashes, starts): those whose hash of 128 bits stands in more than one place."""
    hashes = np.concatenate([np.frombuffer(r[2], U64).reshape(-1, 2) for r in rows])
    order = np.lexsort((hashes[:, 0], hashes[:, 1]))
    same = (hashes[order[1:]] == hashes[order[:-1]]).all(axis=1)
    equal = np.zeros(len(hashes), bool)
    equal[order[1:]] |= same
    equal[order[:-1]] |= same
    at = 0
    for key, body, _, starts in rows:
        own = np.frombuffer(starts, np.int32)
        if len(hit := own[equal[at : at + len(own)]]):
            first = np.flatnonzero(np.concatenate([[True], np.diff(hit) > 1]))
            last = np.append(first[1:], len(hit)) - 1
            yield key, body, [{"a": int(hit[a]), "b": int(hit[b]) + 1} for a, b in zip(first, last, strict=True)]
        at += len(own)


def compare_runs(bodies: DataFrame, parts: int, length: int = LENGTH) -> DataFrame:
    """Matched windows of runs (ROUTED): spans of window starts within the run."""

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        family, names, counts, hot = Family(length), [], [], []
        waiting, size = [], 0
        for batch in batches:
            for key, body, data, starts in zip(batch["key"], batch["body"], batch["data"], batch["starts"], strict=True):
                if starts is not None:
                    hot.append((key, body, data, starts))
                    continue
                if waiting and size + len(data) > BATCH:
                    family.add(waiting)
                    waiting, size = [], 0
                names.append((key, body))
                counts.append(len(data) - length + 1)
                waiting.append(data)
                size += len(data)
        if waiting:
            family.add(waiting)
        flags, at, out = family.matched(), 0, []
        for (key, body), n in zip(names, counts, strict=True):
            if spans := intervals(flags[at : at + n]):
                out.append((key, body, [{"a": a, "b": b} for a, b in spans]))
            at += n
        if hot:
            out += equal_hashes(hot)
        for i in range(0, len(out), 10_000):
            yield pd.DataFrame(out[i : i + 10_000], columns=["key", "body", "spans"])

    @F.pandas_udf("array<struct<a:int,b:int>>")
    def joined(spans: pd.Series) -> pd.Series:
        out = []
        for own in spans:
            flags = np.zeros(max(s["b"] for s in own), bool)
            for s in own:
                flags[s["a"] : s["b"]] = True
            out.append([{"a": a, "b": b} for a, b in intervals(flags)])
        return pd.Series(out, dtype=object)

    found = bodies.repartition(parts, "route").mapInPandas(trimming(compared), MATCHES)
    found = found.groupBy("key", "body").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return found.select("key", "body", joined("spans").alias("spans"))


def removed_spans(docs: DataFrame, length: int = LENGTH, encode: Callable[[str], bytes] = plain) -> DataFrame:
    """text_key and spans (sorted array of struct a, b: bytes to remove) of each text that has any.

    Windows of ``length`` bytes of what ``encode`` makes of a text; spans are of that.
    """
    spark = docs.sparkSession
    runs = written(text_runs(docs, length, encode), "runs")
    bodies = runs.groupBy("key", "body").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("text_key", "first", "end")).alias("at"), F.max("folded").alias("folded"))
    by_key = bodies.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.max("n").alias("most"), F.max("at").alias("at"), F.max("body").alias("body"), F.max("folded").alias("folded"))
    shared = written(by_key.filter("kinds > 1 or most > 1 or folded"), "keys")
    # one kind of run, in many places: all its windows match
    alone = shared.filter("kinds = 1 and most > 1").select("key", "body", F.array(F.struct(F.lit(0).alias("a"), (F.col("at.end") - F.col("at.first")).alias("b"))).alias("spans"))
    various = shared.filter("kinds > 1 or most = 1").select("key", "kinds")
    distinct = written(bodies.join(various, "key").select("key", "body", "n", "kinds", "at.*"), "distinct")
    wanted = distinct.groupBy("text_key").agg(F.collect_list(F.struct("key", "body", "first", "end", "kinds")).alias("cuts"))
    texts = docs.select("text", F.unhex(F.md5("text")).alias("text_key")).join(wanted, "text_key")
    windows = F.col("end") - F.col("first")
    size = distinct.agg(F.sum(F.when(F.col("kinds") > HOT, 20 * windows).otherwise(windows + length))).first()[0] or 0

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, cuts in zip(batch["text"], batch["cuts"], strict=True):
                data = encode(text)
                for c in cuts:
                    out += routed(c["key"], c["body"], data[c["first"] : c["end"] + length - 1], c["kinds"], length)
            yield pd.DataFrame(out, columns=["route", "key", "body", "data", "starts"])

    # a text may stand in many rows: of its copies one is cut
    data = texts.dropDuplicates(["text_key"]).select("text", "cuts").mapInPandas(trimming(cut), ROUTED)
    matched = compare_runs(data, max(1, -(-size // SHARE)), length)
    often = distinct.filter("n > 1").select("key", "body", F.array(F.struct(F.lit(0).alias("a"), (F.col("end") - F.col("first")).alias("b"))).alias("spans"))
    matched = matched.join(often.select("key", "body"), ["key", "body"], "left_anti").unionByName(often)
    matched = written(matched.unionByName(alone), "matches")
    release_shuffles(spark)
    hits = runs.join(matched, ["key", "body"]).select("text_key", F.explode(F.transform("spans", lambda s: F.struct((F.col("first") + s["a"]).alias("a"), (F.col("first") + s["b"] + length - 1).alias("b")))).alias("span")).distinct()
    return hits.groupBy("text_key").agg(F.sort_array(F.collect_list("span")).alias("spans"))


def cut_out(data: bytes, spans: list) -> tuple[bytes, int, int]:
    """What is left of ``data`` without the (overlapping, sorted) spans; bytes and runs removed."""
    keep, at, removed, n = [], 0, 0, 0
    end = -1
    for s in spans:
        a, b = s["a"], s["b"]
        if a > end:
            n += 1
        a = max(a, at)
        if b > at:
            keep.append(data[at:a])
            removed += b - a
            at = b
        end = max(end, b)
    keep.append(data[at:])
    return b"".join(keep), removed, n


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty().alias("text"))
    spans = written(removed_spans(docs), "spans")
    release_shuffles(spark)

    @F.pandas_udf("n_removed long, n_spans long, kept_sha256 string")
    def kept(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for text, own in zip(texts, spans, strict=True):
            data = text.encode("utf-8", "surrogatepass")
            left, removed, n = cut_out(data, own)
            out.append((removed, n, hashlib.sha256(left).hexdigest()))
        return pd.DataFrame(out, columns=["n_removed", "n_spans", "kept_sha256"])

    keyed = docs.withColumn("text_key", F.unhex(F.md5("text")))
    joined = keyed.join(spans, "text_key", "left")
    cut = joined.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), kept("text", F.coalesce("spans", F.array().cast("array<struct<a:int,b:int>>"))).alias("k"))
    return cut.select("doc_id", "n_bytes", "k.n_removed", "k.n_spans", "k.kept_sha256")


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without repeated passages, of LENGTH bytes or of WORDS words, whichever is less.

    Each removed run shrinks to whole characters; n_chars follows.
    Only passages go, never rows.  Null texts stay null.
    """
    small_batches(spark)
    texts = docs.select(text_or_empty().alias("text"))
    before = tables_so_far()
    spans = written(removed_spans(texts), "spans")
    forget_tables(spans, before)
    before = tables_so_far()
    worded = written(removed_spans(texts, WORDS * CODE, coded).withColumnRenamed("spans", "worded"), "worded")
    forget_tables(worded, before)

    @F.pandas_udf("string")
    @trimming
    def kept(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, spans, worded in batches:
            out = []
            for text, own, words in zip(texts, spans, worded, strict=True):
                if text is None:
                    out.append(None)
                    continue
                data = plain(text)
                whole = []
                for s in sorted([*own, *uncoded(data, words)], key=lambda s: (s["a"], s["b"])):
                    a, b = s["a"], s["b"]
                    while a < b and data[a] & 0xC0 == 0x80:
                        a += 1
                    while b < len(data) and b > a and data[b] & 0xC0 == 0x80:
                        b -= 1
                    whole.append({"a": a, "b": b})
                out.append(cut_out(data, whole)[0].decode("utf-8", "surrogatepass"))
            yield pd.Series(out, dtype=object)

    row = docs.select(F.struct(*docs.columns).alias("sd_row"), F.unhex(F.md5(text_or_empty())).alias("text_key"))
    joined = row.join(spans, "text_key", "left").join(worded, "text_key", "left")
    or_none = lambda name: F.coalesce(name, F.array().cast("array<struct<a:int,b:int>>"))
    cut, whole = F.coalesce("spans", "worded").isNotNull(), F.col("sd_row.text")
    # only the texts that lose something go to Python: both branches are evaluated for every row
    text = F.when(cut, kept(F.when(cut, whole), or_none("spans"), or_none("worded"))).otherwise(whole)
    out = joined.select("sd_row", text.alias("sd_text"))
    cols = {"text": F.col("sd_text"), "n_chars": F.when(F.col("sd_text").eqNullSafe(F.col("sd_row.text")), F.col("sd_row.n_chars")).otherwise(F.length("sd_text").cast("long"))}
    return out.select(*[cols.get(c, F.col(f"sd_row.`{c}`")).alias(c) for c in docs.columns])
