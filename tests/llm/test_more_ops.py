import collections
import hashlib
import math
import re

import pytest

from quillgrid.llm import fingerprints, kneser_ney

from .conftest import by_text, collected, crc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_fingerprints(spark, awkward):
    d, rows = awkward
    got = collected(fingerprints.op8_bottom_k(spark, d))
    assert len(got) == len(rows)
    order = sorted({(r[0], r[1] or "") for r in rows if r[0] is not None}, key=lambda x: -x[0])
    nulls = {r[1] or "" for r in rows if r[0] is None}
    for i, (doc_id, text) in enumerate(order):
        g = next(x for x in got if x["doc_id"] == doc_id)
        after = [order[i + 1][1]] if i + 1 < len(order) else sorted(nulls)
        third = len(text) // 3
        edits = {text[: len(text) - third] + n[:third] for n in after}
        assert g["n_chars"] == len(text) and g["edited_sha256"] in {hashlib.sha256(e.encode()).hexdigest() for e in edits}, doc_id
        if len(after) == 1:
            a, b, c = shingles(text), shingles(next(iter(edits))), shingles(after[0])
            for x, y, key in ((a, b, "near_edited"), (a, c, "near_next")):
                j = len(x & y) / len(x | y) if x | y else 1.0
                assert abs(g[key] - j) < 0.25 and (len(x | y) > fingerprints.K or abs(g[key] - j) < 1e-9), doc_id
            assert abs(g["n_shingles"] - len(a)) <= (0.5 * len(a) if len(a) >= fingerprints.K else 0)
    prints = collections.defaultdict(set)
    for r, g in by_text(rows, got):
        prints[r[1] or ""].add(g["fingerprint"])
    assert all(len(x) == 1 for x in prints.values())


def test_order_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE", 7)
    ids = spark.range(100).selectExpr("id * id doc_id", "id h", "3 n_chars", "1 copies")
    got = {r["doc_id"]: r["next_id"] for r in fingerprints.next_documents(ids).collect()}
    want = [i * i for i in range(99, -1, -1)]
    assert got == dict(zip(want, want[1:] + want[:1], strict=True))


def brute_model(texts):
    toks = [WORD.findall((t or "").encode().lower().decode()) + [None] for t in texts]
    uni = collections.Counter(x for t in toks for x in t)
    pair = collections.Counter(p for t in toks for p in zip(["<s>", *t], t, strict=False))
    return uni, pair


def test_kneser_ney(spark, awkward):
    d, rows = awkward
    got = collected(kneser_ney.op7_kneser_ney(spark, d))
    assert len(got) == len(rows)
    uni, pair = brute_model([r[1] for r in rows if r[0] is not None and crc(r[0], 7) != 2])
    n, v = sum(uni.values()), len(uni)
    coc = collections.Counter(pair.values())
    dd = kneser_ney.discounts(*[coc[k] for k in (1, 2, 3, 4)])
    before = collections.Counter(w for _, w in pair)
    cob = collections.Counter(before.values())
    qd = kneser_ney.discounts(*[cob[k] for k in (1, 2, 3, 4)])
    total = sum(before.values())
    gone = sum(qd[min(c, 3)] for c in before.values())
    ctx, taken = collections.Counter(), collections.Counter()
    for (h, _), c in pair.items():
        ctx[h] += c
        taken[h] += dd[min(c, 3)]

    def q(w):
        return max(before[w] - qd[min(before[w], 3)], 0) / total + gone / total / (v + 1)

    def p(h, w):
        c = pair[h, w]
        return max(c - dd[min(c, 3)], 0) / ctx[h] + taken[h] / ctx[h] * q(w) if ctx[h] else q(w)

    assert abs(sum(q(w) for w in uni) + gone / total / (v + 1) - 1) < 1e-9
    for r, g in by_text(rows, got):
        t = WORD.findall((r[1] or "").encode().lower().decode()) + [None]
        assert (g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"]) == (crc(r[0], 7) == 2, len(t), sum(uni[x] > 0 for x in t), n)
        assert g["base_score"] == pytest.approx(sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in t), rel=1e-9)
        assert g["score"] == pytest.approx(sum(math.log10(p(h, w)) for h, w in zip(["<s>", *t], t, strict=False)), rel=1e-6, abs=1e-9)


def test_many_shards_score_alike(spark, awkward, monkeypatch):
    d, _ = awkward
    one = {(r["doc_id"], r["score"]) for r in collected(kneser_ney.op7_kneser_ney(spark, d))}
    monkeypatch.setattr(kneser_ney, "SHARD_BYTES", 10_000)
    many = {(r["doc_id"], r["score"]) for r in collected(kneser_ney.op7_kneser_ney(spark, d))}
    assert {(i, round(s, 6)) for i, s in one} == {(i, round(s, 6)) for i, s in many}


def test_hot_left_words_are_dealt_over_shards(spark, monkeypatch):
    """A left word with a third of all tokens, before ever new words: shards stay even, and scores are those of one shard."""
    texts = [" ".join(f"hot w{i}x{j} cold" for j in range(40)) for i in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path, info = kneser_ney.train(docs.select("text"))
    one = sorted(kneser_ney.scored(docs, path, info).collect())
    assert not len(info["hot"][0])
    monkeypatch.setattr(kneser_ney, "SHARD_BYTES", sum(map(len, texts)) // 16)
    path, info = kneser_ney.train(docs.select("text"))
    hot, cold, end = kneser_ney.hashes([b"hot", b"cold"])
    assert {hot, cold} <= set(info["hot"][0]) and end == kneser_ney.END
    assert info["hot_counts"][list(info["hot"][0]).index(hot)].tolist() == [6000, 6000, 0, 0]
    sizes = [len(kneser_ney._map(f"{path}/left-{s:06d}/pairs", kneser_ney.U64)) for s in info["left"]]
    assert sum(sizes) >= 12000 and max(sizes) < 0.2 * sum(sizes)
    many = sorted(kneser_ney.scored(docs, path, info).collect())
    assert all(a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], rel=1e-9) for a, b in zip(one, many, strict=True))


def test_held_out_beats_base(spark):
    rows = kneser_ney.op7_kneser_ney(spark, "/root/testdata/sf0.01").filter("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert rows["s"] > rows["b"]


def test_empty(spark, empty):
    for op in (fingerprints.op8_bottom_k, kneser_ney.op7_kneser_ney):
        assert op(spark, empty).count() == 0
