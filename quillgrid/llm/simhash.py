"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint bit is 1 if set in over half of the XXH64 hashes of a text's word shingles.  Fingerprints within RADIUS
bits are linked.  Candidates come from 2**(RADIUS+1) - 1 tables: each bit position has a vector of RADIUS+1 bits, and
table v keeps the positions whose vector has an odd product with v.  Any RADIUS positions leave some v orthogonal to
all their vectors, so a pair within the radius has equal masked fingerprints in at least one table: no link is missed.

Inside a table's buckets no pairs are made.  A fingerprint that shares a bucket emits itself and itself with one
unmasked bit flipped; two fingerprints are within 2 bits exactly if they emit a common value.  At most 65 different
fingerprints emit a value, so groups are bounded whatever the number of copies.

Defined cases: a null or empty text has fingerprint zero, linked like any other; fewer words than a shingle make one
shingle.  Repeated rows share a fingerprint.  A component's id is its smallest id that isn't null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, small_batches, table, trimming, written
from .graph import components

RADIUS, BITS, SEED = 2, 64, 42
#: Shingles whose bits are counted at once.
BLOCK = 1 << 15


def fingerprint(text: str | None, words: int) -> int:
    """The 64-bit fingerprint as a signed integer."""
    hashes = shingle_hashes(text, words)
    return bits_of(hashes) if len(hashes) else 0


def with_fingerprints(docs: DataFrame, words: int = 3, text: str = "text", name: str = "fp") -> DataFrame:
    @F.pandas_udf("long")
    @trimming
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, words) for t in texts], dtype="int64")

    return docs.withColumn(name, of(F.col(text)))


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The masks of all tables, each as an unsigned integer."""
    n = (1 << (radius + 1)) - 1
    vector = [1 + i % n for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (vector[i] & v).bit_count() % 2) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all fingerprints within 2 bits; ``prints`` (fp) are distinct."""
    masks = [_signed(m) for m in covering_masks()]
    flips = F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)).cast("long") for i in range(BITS) if not (m >> i) & 1]) for m in covering_masks()])
    tables = F.explode(F.array(*[F.struct(F.lit(v).alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for v, m in enumerate(masks)]))
    rows = prints.select("fp", tables.alias("x")).select("fp", "x.t", "x.key")
    full = rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("t", "key")
    near = rows.join(full, ["t", "key"]).select("fp", F.explode(F.transform(F.element_at(flips, F.col("t") + 1), lambda f: F.col("fp").bitwiseXOR(f))).alias("z")).distinct()
    groups = near.groupBy("z").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all")).filter(F.size("all") > 1)
    return groups.select("a", F.explode("all").alias("b")).filter("a <> b").distinct()


def components_of(rows: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``rows`` (with fp) and component_id, the smallest id of those that links reach."""
    roots = components(links(rows.select("fp").distinct()))
    keyed = rows.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    keyed = written(keyed, "rooted")
    # written, so that the join is not bound to the aggregate's partitioning and a large component's rows can be split
    least = written(keyed.groupBy("root").agg(F.min(doc_id).alias("component_id")), "least")
    return keyed.join(least, "root").drop("root")


def hex_print(c: Column) -> Column:
    return F.lpad(F.lower(F.hex(c)), 16, "0")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = written(with_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "fp"), "prints")
    return components_of(prints).select("doc_id", hex_print(F.col("fp")).alias("fingerprint"), "component_id")


#: Min-hashes of a signature, and how many make a band: 40 bands miss one in eight million pairs at a similarity of 0.8.
HASHES, BAND = 200, 5
#: So far below the similarity may the min-hashes' estimate (standard error 0.03) be for a pair to be decided exactly.
SLACK = 0.15
#: Nodes of a band's bucket with which all of the bucket are compared first; nodes of a block in the pass over the rest.
REPS, NODES = 3, 512
_rng = np.random.default_rng(9)
_TIMES = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    import xxhash

    tokens = (text or "").encode("utf-8", "replace").lower().split()
    digest = xxhash.xxh64_intdigest
    n = max(1, len(tokens) - words + 1) if tokens else 0
    return np.fromiter((digest(b" ".join(tokens[i : i + words]), SEED) for i in range(n)), np.uint64, n)


def signature(hashes: np.ndarray) -> bytes:
    """The least of each of HASHES functions over the shingles, 2 bytes of each; equal places estimate Jaccard."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 512):
        np.minimum(least, (hashes[at : at + 512, None] * _TIMES + _PLUS).min(axis=0), out=least)
    return ((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype("<u2").tobytes()


def bits_of(hashes: np.ndarray) -> int:
    """The fingerprint, from shingle hashes."""
    ones, n = np.zeros(BITS, np.int64), len(hashes)
    for at in range(0, n, BLOCK):
        ones += np.unpackbits(hashes[at : at + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def estimated(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose signatures agree in at least ``least`` of their places."""

    @F.pandas_udf("double")
    def agreement(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([float((np.frombuffer(a, np.uint16) == np.frombuffer(b, np.uint16)).mean()) for a, b in zip(x, y, strict=True)], dtype="float64")

    sig = lambda end, name: nodes.select(F.col("node").alias(end), F.col("sig").alias(name))
    both = pairs.join(sig("a", "sig_a"), "a").join(sig("b", "sig_b"), "b")
    return both.filter(agreement("sig_a", "sig_b") >= least).select("a", "b")


def shingle_sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, set) of nodes (node, text_hash: that of the node's text in ``docs``): 64-bit hashes of the shingles, sorted."""

    @F.pandas_udf("binary")
    def shingles(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(t, words)).tobytes() for t in texts], dtype=object)

    texts = docs.select("text", F.xxhash64("text").alias("text_hash")).join(nodes, "text_hash").dropDuplicates(["node"])
    return texts.select("node", shingles("text").alias("set"))


def verified(pairs: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets of shingles have a Jaccard similarity of at least ``similarity``, exactly."""

    @F.pandas_udf("boolean")
    def near(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([jaccard(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) >= similarity for a, b in zip(x, y, strict=True)], dtype=bool)

    pairs = written(pairs, "candidates")
    sets = written(sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), "sets")
    of = lambda end: sets.select(F.col("node").alias(end), F.col("set").alias(f"set_{end}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").filter(near("set_a", "set_b")).select("a", "b")


def of_units(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole units, from batches in which each unit's rows stand together."""
    waiting = None
    for batch in rows:
        if not len(batch):
            continue
        held = batch if waiting is None else pd.concat([waiting, batch], ignore_index=True)
        last = (held["unit"] == held["unit"].iloc[-1]).to_numpy()
        yield from (group for _, group in held[~last].groupby("unit", sort=False))
        waiting = held[last]
    if waiting is not None:
        yield waiting


def close_pairs(unit: pd.DataFrame, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of side 0, the rows of a unit that it is compared with and whose signatures agree in ``least``.

    Those of side 1, or if there are none the later ones of side 0.  Places are of the unit's rows.  Rows of one root are
    not compared, nor rows that agree in a band before the unit's own: a bucket of that band has both.
    """
    side, roots, band = unit["side"].to_numpy(), unit["root"].to_numpy(), int(unit["band"].iloc[0])
    sigs = np.frombuffer(b"".join(unit["sig"]), np.uint16).reshape(len(unit), HASHES)
    first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    for k, i in enumerate(first):
        at = second if len(second) else first[k + 1 :]
        at = at[roots[at] != roots[i]]
        same = sigs[at] == sigs[i]
        near = np.flatnonzero(same.sum(axis=1) >= least * HASHES)
        if len(near):
            bands = same[near].reshape(len(near), HASHES // BAND, BAND).all(axis=2)
            bands[:, band] = True
            yield i, at[near[bands.argmax(axis=1) == band]]


def jaccard(p: np.ndarray, q: np.ndarray) -> float:
    """Similarity of two sets, as sorted arrays."""
    both = len(np.intersect1d(p, q, assume_unique=True))
    return both / (len(p) + len(q) - both)


def forest(unit: pd.DataFrame, least: float, similarity: float | None) -> list[tuple[int, int]]:
    """Links (a, b) of a unit's rows, as many as join what its links join: pairs already joined are not looked at.

    A link is a close pair whose sets have the ``similarity``; None: any close pair.
    """
    nodes, roots = unit["node"].tolist(), unit["root"].tolist()
    sets = [np.frombuffer(x, np.uint64) for x in unit["set"]] if similarity is not None else []
    up: dict[int, int] = {}

    def find(r: int) -> int:
        while (to := up.get(r, r)) != r:
            up[r] = r = up.get(to, to)
        return r

    out = []
    for i, at in close_pairs(unit, least):
        for j in at.tolist():
            p, q = find(roots[i]), find(roots[j])
            if p != q and (similarity is None or jaccard(sets[i], sets[j]) >= similarity):
                up[p] = q
                out.append((min(nodes[i], nodes[j]), max(nodes[i], nodes[j])))
    return out


def rest_links(members: DataFrame, roots: DataFrame, nodes: DataFrame, least: float, similarity: float | None, sets_of: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """Links (a, b) of members (band, key, node) of a bucket, of different roots: so many that they join what all would.

    A bucket's largest component is not compared with itself.  The other members and that are dealt by hash into blocks
    of about NODES; a task compares two blocks, so that neither a bucket nor its pairs stand in one task.  A first pass
    over signatures tells which members have a close pair in their unit; a second one, with the sets of only those,
    decides.  No pass returns more than a row or link for each row it has read, however many pairs are close.
    """
    rooted = written(members.join(roots, "node", "left").select("band", "key", "node", F.coalesce("root", "node").alias("root")), "members")
    per_root = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    blocks = lambda c: F.ceil(c / NODES).cast("int")
    mixed = per_root.groupBy("key").agg(F.max(F.struct("c", "root")).alias("main"), F.sum("c").alias("m"), F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    # written, so that the join is not bound to the aggregate's partitioning and a large bucket's rows can be split
    mixed = written(mixed.select("key", F.col("main.root").alias("main"), blocks(F.col("main.c")).alias("n_main"), blocks(F.col("m") - F.col("main.c")).alias("n_other")), "mixed")
    rows = rooted.join(mixed, "key").withColumn("is_main", F.col("root") == F.col("main"))
    rows = rows.withColumn("i", F.pmod(F.xxhash64("node"), F.when(F.col("is_main"), F.col("n_main")).otherwise(F.col("n_other"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    unit = lambda p, q, main, side: F.struct(F.xxhash64("key", p, q, F.lit(main)).alias("unit"), side.alias("side"))
    zero, one = F.lit(0), F.lit(1)
    with_main = F.when(F.col("is_main"), F.transform(upto("n_other"), lambda j: unit(j, F.col("i"), 1, one))).otherwise(F.transform(upto("n_main"), lambda j: unit(F.col("i"), j, 1, zero)))
    with_others = F.when(F.col("is_main"), F.array().cast("array<struct<unit:bigint,side:int>>")).otherwise(F.transform(upto("n_other"), lambda j: unit(F.least("i", j), F.greatest("i", j), 0, F.when(j < F.col("i"), one).otherwise(zero))))
    dealt = rows.select("band", "node", "root", F.explode(F.concat(with_main, with_others)).alias("u")).select("u.unit", "u.side", "band", "node", "root")
    by_unit = lambda df: df.repartition("unit").sortWithinPartitions("unit", "side")
    dealt = by_unit(dealt.join(nodes.select("node", "sig"), "node"))

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in of_units(batches):
            if found := forest(group, least, similarity):
                yield pd.DataFrame(found, columns=["a", "b"])

    if similarity is None:
        return dealt.mapInPandas(trimming(joined), "a long, b long").distinct()

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in of_units(batches):
            if found := [x for i, at in close_pairs(group, least) if len(at) for x in (i, *at.tolist())]:
                yield group.iloc[np.unique(found)][["unit", "side", "band", "node", "root"]]

    near = written(dealt.mapInPandas(trimming(close), "unit long, side int, band int, node long, root long"), "close")
    sets = written(sets_of(near.select("node").distinct()), "sets")
    return by_unit(near.join(nodes.select("node", "sig"), "node").join(sets, "node")).mapInPandas(trimming(joined), "a long, b long").distinct()


def near_roots(nodes: DataFrame, least: float, linked: Callable[[DataFrame], DataFrame], similarity: float | None = None, sets_of: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node, root) of the nodes (node, fp, sig; distinct) that have links.

    ``linked`` decides pairs (a, b); none that it links agrees in less than ``least``.  With a ``similarity`` it is that
    of the sets that ``sets_of`` gives for nodes; without, any pair that agrees in ``least`` is linked.  Candidates are the pairs of the
    covering tables and all pairs of each band's buckets.  64 bits alone are too few here: at a Jaccard similarity of 0.8
    about ten differ, and covering that radius would take 2047 tables.

    In a bucket all nodes are compared with REPS drawn nodes first.  The draw is by node, so that buckets with much the
    same nodes draw the same.  The others of a bucket that are by then not in one component are compared with each other
    (``rest_links``): so no pair of a bucket is left out that could join two components.
    """
    first = nodes.groupBy("fp").agg(F.min("node").alias("rep"))
    close = links(nodes.select("fp").distinct())
    by_fp = close.join(first.select(F.col("fp").alias("a"), F.col("rep").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("rep").alias("y")), "b").select("x", "y")
    same_fp = nodes.join(first, "fp").select(F.col("node").alias("x"), F.col("rep").alias("y"))
    width = 2 * BAND
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("sig", width * i + 1, width)) for i in range(HASHES // BAND)])
    banded = nodes.select("node", F.posexplode(keys).alias("band", "key"))
    drawn = [F.min(F.struct(F.xxhash64("node", F.lit(t)).alias("by"), F.col("node").alias("is"))).getField("is") for t in range(REPS)]
    buckets = banded.groupBy("key").agg(F.array_distinct(F.array(*drawn)).alias("reps"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    buckets = written(buckets, "buckets")
    shared = written(banded.join(buckets, "key").select("band", "key", "node", "reps", "n"), "shared")
    by_band = shared.select(F.col("node").alias("x"), F.explode("reps").alias("y"))
    pairs = by_fp.union(same_fp).union(by_band).filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    edges = written(linked(pairs), "links")
    members = shared.filter((F.col("n") - F.size("reps") > 1) & ~F.array_contains("reps", F.col("node"))).select("band", "key", "node")
    more = written(rest_links(members, components(edges), nodes, least, similarity, sets_of), "links")
    return components(edges.union(more))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest id.

    Groups are the components of links between texts whose sets of five-word shingles have a Jaccard similarity of 0.8
    or more.  Min-hashes give the candidates; the sets decide.  Rows without a word, or with a null id, all stay; so do
    repeats of the row that stays.  Of different texts under one id each is judged by itself.
    """
    small_batches(spark)

    @F.pandas_udf("fp long, sig binary, node long")
    @trimming
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import xxhash

        for texts in batches:
            found = []
            for t in texts:
                h = shingle_hashes(t, words)
                node = xxhash.xxh3_64_intdigest(np.unique(h).tobytes())  # of the set: equal sets are one node
                found.append((bits_of(h), signature(h), _signed(node)) if len(h) else (0, None, 0))
            yield pd.DataFrame(found, columns=["fp", "sig", "node"])

    rows = docs.filter("doc_id is not null").select("doc_id", F.xxhash64("text").alias("text_hash"), prints("text").alias("p"))
    # filtered as read again: a filter above the function would run it once more, in a worker of its own
    rows = written(rows.select("doc_id", "text_hash", "p.fp", "p.sig", "p.node"), "signatures").filter("sig is not null")
    one = F.min(F.struct("text_hash", "fp", "sig")).alias("one")
    nodes = written(rows.groupBy("node").agg(one).select("node", "one.*"), "nodes")
    least = similarity - SLACK
    sets_of = lambda wanted: shingle_sets(docs, nodes.select("node", "text_hash").join(wanted, "node"), words)
    roots = near_roots(nodes, least, lambda pairs: verified(estimated(pairs, nodes, least), sets_of, similarity), similarity, sets_of)
    rooted = rows.select("doc_id", "text_hash", "node").join(roots, "node", "left")
    stay = rooted.groupBy(F.coalesce("root", "node")).agg(F.min(F.struct("doc_id", "text_hash")).alias("nd")).select("nd.*")
    stay = written(stay.select(F.col("doc_id").alias("nd_id"), F.col("text_hash").alias("nd_hash")), "stay")
    judged = F.col("doc_id").isNotNull() & F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    kept = docs.filter(judged).join(stay, (F.col("doc_id") == F.col("nd_id")) & (F.xxhash64("text") == F.col("nd_hash")), "left_semi")
    return kept.unionByName(docs.filter(~judged))
