"""Whole queries and stages against plain versions of them."""

import collections
import math
import re

import pytest

from quillgrid.llm import mixing, packing, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL, LARGE = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


class PlainPacker:
    """Best fit by a look at every bin; of equally tight ones, that which was filled last."""

    def __init__(self, capacity, per_source):
        self.capacity, self.per_source, self.bins, self.clock = capacity, per_source, [], 0

    def place(self, size, source, cluster):
        fits = [(self.capacity - b["used"], -b["at"], i) for i, b in enumerate(self.bins) if b["used"] + size <= self.capacity and cluster not in b["clusters"] and b["sources"][source] < self.per_source]
        if not fits:
            self.bins.append({"used": 0, "clusters": set(), "sources": collections.Counter()})
        i = min(fits)[2] if fits else len(self.bins) - 1
        b, self.clock = self.bins[i], self.clock + 1
        start = b["used"]
        b.update(used=start + size, at=self.clock)
        b["sources"][source] += 1
        b["clusters"] |= {cluster} - {-1}
        return i, start


def test_best_fit_query_equals_plain_best_fit(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 256)
    got = [tuple(r) for r in packing.op2_best_fit(spark, SMALL).collect()]
    rows = packing.sized(spark.read.parquet(f"{SMALL}/documents.parquet")).toPandas()
    shard = {doc: bin_id >> 32 for doc, _, bin_id, _, _ in got}
    assert len(set(shard.values())) > 2 and set(shard) == set(rows["doc_id"])
    monkeypatch.setattr(packing, "Packer", PlainPacker)
    rows["doc_id"], rows["cluster"] = rows["doc_id"].astype(str), rows["cluster"].astype(str)
    want = set()
    for s, own in rows.groupby(rows["doc_id"].map(lambda d: shard[int(d)])):
        own = own.sort_values(["size", "doc_id", "cluster", "source"], ascending=False, kind="stable")
        want |= {(int(d), piece, (s << 32) + b, start, size) for d, piece, b, start, size in packing.pack_shard(own).itertuples(index=False)}
    assert set(got) == want and len(got) == len(want)


def test_packing_stage_parts_the_repeats_of_a_mix(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").filter("source is not null").limit(200).cache()
    got = packing.packing_stage(spark, docs.union(docs).union(docs), SMALL).collect()
    words = {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in docs.collect()}
    size, bins, load = collections.Counter(), collections.defaultdict(list), collections.Counter()
    for r in got:
        size[r["doc_id"]] += r["size"]
        load[r["bin_id"]] += r["size"]
        bins[r["doc_id"]].append(r["bin_id"])
    assert size == {d: 3 * n for d, n in words.items()} and max(load.values()) <= packing.CAPACITY
    assert all(len(b) == len(set(b)) for d, b in bins.items() if words[d])


def test_mix_stage_takes_what_the_mix_takes(spark):
    """Every document as often as the query says, whose rows SQL checks; all its columns as they were."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = mixing.mix_stage(spark, docs, SMALL)
    assert out.columns == docs.columns and out.subtract(docs).count() == 0
    got = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    plan = [r for r in mixing.op1_mix(spark, SMALL).collect() if r["size"]]
    assert {r["doc_id"]: got.get(r["doc_id"], 0) for r in plan} == {r["doc_id"]: r["taken"] // r["size"] for r in plan}


def values(text):
    """The rules' measures, plainly; None for a text that fails the base rules."""
    words = WORD.findall(text)
    n = len(words)
    grams = [tuple(words[i : i + 3]) for i in range(n - 2)]
    often = collections.Counter(grams)
    repeats = len({i + j for i, g in enumerate(grams) if often[g] > 1 for j in range(3)})
    if n < 50 or 100 * repeats > 50 * n:
        return None
    lines = [x for x in text.split("\n") if WORD.search(x)]
    mean = sum(map(len, words)) / n
    return {"symbols": len(re.findall(r"[#*$%&|<>]", text)) / n, "dup_lines": len(lines) - len(set(lines)), "repeats": repeats / n, "long_words": mean, "short_words": -mean, "shouts": text.count("!!") / n}


def plain_cutoffs(good):
    """The strictest cutoff of each rule up to the first that too many of ``good`` exceed, by the sum of the binomial."""
    out, n, p = {}, len(good), quality.LIMIT
    for rule, cutoffs in quality.RULES.items():
        for c in cutoffs:
            k = sum(v[rule] > c for v in good)
            if not n or math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) > quality.DELTA / len(quality.RULES):
                break
            out[rule] = c
    return out


@pytest.mark.parametrize("d", [SMALL, LARGE])
def test_quality_verdicts_equal_plain_ones(spark, d):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "text").collect()}
    label = collections.defaultdict(list)
    for r in spark.read.parquet(f"{d}/labels.parquet").filter("quality is not null").collect():
        label[r["doc_id"]].append(r["quality"])
    measured = {i: v for i, r in docs.items() if (v := values(r["text"] or "")) is not None}
    good = collections.defaultdict(list)
    for i, v in measured.items():
        if label[i] and min(label[i]) == 1:
            good[docs[i]["lang"]].append(v)
    pooled = plain_cutoffs([v for x in good.values() for v in x])
    cutoffs = collections.defaultdict(lambda: pooled)
    for lang, own in good.items():
        cutoffs[lang] = plain_cutoffs(own)
        if (1 - quality.LIMIT) ** len(own) > quality.DELTA / len(quality.RULES):  # too few to certify anything
            for rule, strictest in pooled.items():
                passed = [c for c in quality.RULES[rule] if c <= quality.RULES[rule][0] and c >= strictest]
                for c in passed:
                    if sum(v[rule] > c for v in own) > quality.LIMIT * len(own):
                        break
                    cutoffs[lang][rule] = c
    want = {i: i in measured and all(measured[i][rule] <= c for rule, c in cutoffs[r["lang"]].items()) for i, r in docs.items()}
    got = {r["doc_id"]: r["kept"] for r in quality.op6_quality_rules(spark, d).collect()}
    assert got == want and 0 < sum(got.values()) < len(got)
