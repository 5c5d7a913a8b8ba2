import collections
import re

import duckdb
import regex
import xxhash
from pyspark.sql import functions as F

from quillgrid.llm import language, mixing, packing, quality, simhash, token_counts

from .conftest import by_text, collected, crc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def views(d):
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.sql(f"create view {name} as select * from '{d}/{name}.parquet/*.parquet'")
    return con


def test_mix_matches_sorted_prefixes(spark, awkward):
    d, rows = awkward
    got = collected(mixing.op1_mix(spark, d))
    assert len(got) == len(rows)
    cols = ["doc_id", "size", "source_size", "target", "taken"]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    want = views(d).sql(mixing.OP1_SQL).select(*cols).fetchall()
    assert sorted((tuple(r[c] for c in cols) for r in got), key=key) == sorted(want, key=key)
    assert all(r["taken"] <= 3 * r["size"] for r in got)


def test_mix_targets_stop_at_most():
    t = mixing.targets({"a": 10, "b": 1000, "c": 5, None: 500}, (1, 2, 3), 1.0, 3)
    assert t["c"] == 15 and t["a"] == 30 and abs(sum(t.values()) - 1515) < 1e-6 and t["b"] / t[None] == 2


def test_mixes_nest(spark):
    rows = spark.range(3000).selectExpr("id doc_id", "concat('s', id % 4) source", "1 + id % 50 size").withColumn("h", mixing.doc_hash(F.col("doc_id"), F.col("source")))
    plan = mixing.fit_mix(rows, (1, 2, 3), (0.1, 0.3, 0.9))
    below = collections.defaultdict(list)
    for r in sorted(plan.collect(), key=lambda r: r["mix_k"]):
        below[r["mix_source"]].append((r["mix_passes"], r["mix_below"]))
    assert all(x == sorted(x) for x in below.values()) and len(below) == 4


def test_token_counts_equal_library(spark, awkward):
    d, rows = awkward
    t = token_counts._load(token_counts.tokenizer_path())
    got = collected(token_counts.op3_token_counts(spark, d))
    assert len(got) == len(rows)
    for r, g in by_text(rows, got):
        text = r[1] or ""
        n = len(t.encode(text, add_special_tokens=False).ids)
        assert (g["n_bytes"], g["n_tokens"], g["over_limit"]) == (len(text.encode()), n, n > 1024)


def test_frequent_pre_tokens(spark, awkward):
    """The broadcast table holds what is frequent over all texts, and lengths that are the library's."""
    d, rows = awkward
    docs, path = spark.read.parquet(f"{d}/documents.parquet").repartition(5), token_counts.tokenizer_path()
    n = collections.Counter(x for r in rows for x in regex.findall(token_counts.PRE_TOKEN, r[1] or "") if len(x) <= token_counts.KEPT_CHARS)
    top = token_counts.frequent(docs, n=20)
    assert min(n[x] for x in top) >= sorted(n.values())[-20]
    t, table = token_counts._load(path), token_counts.lengths(path, top)
    assert set(table) == set(top) and all(k == len(t.encode(x, add_special_tokens=False).ids) for x, k in table.items())
    assert token_counts.lengths(path, ["<|endoftext|>", "two words", "one"]).keys() == {"one"}


def test_language(spark, awkward):
    d, rows = awkward
    got = collected(language.op4_language_id(spark, d))
    assert len(got) == len(rows)
    for r, g in by_text(rows, got):
        assert g["held_out"] == (crc(r[0], 4) == 2)
        assert (g["lang_pred"] == "und") == (not any(c.isalpha() for c in r[1] or ""))
        assert 0 <= g["score"] <= 1


def test_language_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = language.op4_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out")
    right, n = got.selectExpr("avg(cast(lang = lang_pred as int))", "count(1)").first()
    assert n > 200 and right > 0.97


def quality_brute(text):
    text = text or ""
    w = WORD.findall(text)
    grams = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    cover = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover)


def test_quality_measures(spark, awkward):
    d, rows = awkward
    got = collected(quality.op6_quality_rules(spark, d))
    assert len(got) == len(rows)
    for r, g in by_text(rows, got):
        n, chars, symbols, dup, rep = quality_brute(r[1])
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"]) == (n, chars, symbols, dup, rep)
        assert g["base_failed"] == (n < 50 or 100 * rep > 50 * n) and not (g["base_failed"] and g["kept"])


def test_binomial_tail_is_exact():
    from fractions import Fraction
    from math import comb

    for n, k, p in ((50, 0, 0.02), (200, 3, 0.01), (30, 30, 0.5)):
        q = Fraction(p)
        assert abs(quality.binomial_tail(n, k, p) - float(sum(comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(k + 1)))) < 1e-9


def test_quality_rejects_few_good(spark):
    d = "/root/testdata/sf0.1"
    got = quality.op6_quality_rules(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("not base_failed")
    r = {x["quality"]: x["kept"] for x in got.groupBy("quality").agg({"kept": "count"}).selectExpr("quality", "`count(kept)` kept").collect()}
    k = {x["quality"]: x["n"] for x in got.filter("kept").groupBy("quality").count().selectExpr("quality", "count n").collect()}
    assert k[1] >= 0.98 * r[1] and k.get(0, 0) <= 0.5 * r[0]


def print_brute(text, words):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    g = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, awkward):
    d, rows = awkward
    got = collected(simhash.op9_simhash(spark, d))
    assert len(got) == len(rows)
    prints = [(r[0], print_brute(r[1], 3)) for r in rows]
    up = {fp: fp for _, fp in prints}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    values = list(up)
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 2:
                up[root(a)] = root(b)
    least = collections.defaultdict(list)
    for i, fp in prints:
        if i is not None:
            least[root(fp)].append(i)
    want = sorted((i is None, i or 0, f"{fp:016x}", min(least[root(fp)], default=None) or 0) for i, fp in prints)
    assert sorted((g["doc_id"] is None, g["doc_id"] or 0, g["fingerprint"], g["component_id"] or 0) for g in got) == want


def test_covering_masks_cover():
    masks = simhash.covering_masks()
    assert len(masks) == 7
    for i in range(64):
        for j in range(i + 1):
            assert any(not (m >> i & 1 or m >> j & 1) for m in masks)


def test_empty_tables(spark, empty):
    for op in (mixing.op1_mix, token_counts.op3_token_counts, language.op4_language_id, quality.op6_quality_rules, simhash.op9_simhash, packing.op2_best_fit):
        assert op(spark, empty).count() == 0


def test_packing_is_valid_and_tight(spark, awkward):
    d, rows = awkward
    got = collected(packing.op2_best_fit(spark, d))
    words = {r[0]: len(WORD.findall(r[1] or "")) for r in rows}
    total = sum(len(WORD.findall(r[1] or "")) for r in rows)
    assert sum(g["size"] for g in got) == total
    text = {r[0]: " ".join(WORD.findall((r[1] or "").lower())) for r in rows}
    source = {r[0]: r[3] for r in rows}
    bins = collections.defaultdict(list)
    pieces = collections.defaultdict(list)
    for g in got:
        bins[g["bin_id"]].append(g)
        pieces[g["doc_id"]].append(g)
    assert {k for k in pieces} == {r[0] for r in rows}
    for k, v in pieces.items():
        if k is not None and k != 10:
            assert sum(g["size"] for g in v) == words[k] and sorted(g["piece"] for g in v) == list(range(len(v)))
    for v in bins.values():
        v.sort(key=lambda g: (g["start"], g["size"]))
        assert sum(g["size"] for g in v) <= packing.CAPACITY
        assert all(a["start"] + a["size"] == b["start"] for a, b in zip(v, v[1:], strict=False))
        clusters = [text[g["doc_id"]] for g in v if text[g["doc_id"]]]
        assert len(clusters) == len(set(clusters))
        assert max(collections.Counter(source[g["doc_id"]] for g in v).values()) <= packing.PER_SOURCE


def test_packing_depends_on_rows_alone(spark, monkeypatch):
    """Other partitions and another order give the same bins; ids above 2**53 beside null ones pass unharmed."""
    import random

    monkeypatch.setattr(packing, "SHARD", 16)
    rng = random.Random(3)
    rows = [(None if i % 11 == 0 else (1 << 60) + i // 2, rng.choice(["a", "b", None]), None if i % 5 == 0 else (1 << 61) + i % 40, rng.randrange(3000)) for i in range(150)]
    rows += [(None, None, None, 0)] * 90 + [(7, "a", 9, 20)] * 50
    packs = []
    for parts in (1, 5):
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "doc_id long, source string, cluster long, size long").repartition(parts)
        packs.append(sorted(map(repr, packing.pack(df).collect())))
        assert packing.pack(df).dtypes[0] == ("doc_id", "bigint")
    assert packs[0] == packs[1]
    got = packing.pack(df).collect()
    assert collections.Counter(g["doc_id"] for g in got if not g["piece"]) == collections.Counter(r[0] for r in rows)
    seven = [g["bin_id"] for g in got if g["doc_id"] == 7]
    assert len(seven) == len(set(seven)) == 50


def test_packer_takes_the_tightest_compatible_bin():
    import random

    rng = random.Random(2)
    p, bins = packing.Packer(100, 3), []
    for _ in range(2000):
        size, source, cluster = rng.randrange(1, 100), rng.randrange(4), rng.randrange(-1, 20)
        ok = [(100 - b["used"], i) for i, b in enumerate(bins) if 100 - b["used"] >= size and (cluster < 0 or cluster not in b["clusters"]) and b["sources"][source] < 3]
        b, at = p.place(size, source, cluster)
        if ok:
            assert b < len(bins) and at == bins[b]["used"] and 100 - at == min(ok)[0] and (100 - at, b) in ok
        else:
            assert b == len(bins) and at == 0
            bins.append({"used": 0, "clusters": set(), "sources": collections.Counter()})
        bins[b]["used"] += size
        bins[b]["sources"][source] += 1
        bins[b]["clusters"] |= {cluster} - {-1}
