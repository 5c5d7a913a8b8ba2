import collections
import hashlib
import random

from quillgrid.llm import suffixes

from .conftest import by_text, collected


def brute(texts):
    n = suffixes.LENGTH
    seen = collections.Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        left = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])), hashlib.sha256(left).hexdigest()))
    return out


def check(rows, got):
    want = dict(zip([r[1] or "" for r in rows], brute([(r[1] or "").encode() for r in rows]), strict=True))
    assert len(got) == len(rows)
    for r, g in by_text(rows, got):
        assert (g["n_bytes"], g["n_removed"], g["n_spans"], g["kept_sha256"]) == want[r[1] or ""], r[0]


def test_awkward(spark, awkward):
    d, rows = awkward
    check(rows, collected(suffixes.op5_suffix_dedup(spark, d)))


def test_edges_of_passages(spark, tmp_path, monkeypatch):
    """Passages of 399 to 402 bytes, nested and overlapping ones, in texts whose contexts agree by chance."""
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("ab é\n") for _ in range(n))
    long = text(3000)
    rows = []
    for i in range(60):
        parts = [text(rng.randrange(0, 300))]
        for _ in range(rng.randrange(3)):
            n = rng.choice([250, 330, 399, 400, 401, 402, 700, 1200])
            a = rng.randrange(0, len(long) - n)
            parts += [long[a : a + n], text(rng.randrange(0, 40))]
        rows.append((i, "".join(parts), "en", "a", 1))
    rows += [(100, "x" * 900, "en", "a", 1), (101, "xy" * 450, "en", "a", 1), (102, "y" * 400, "en", "a", 1)]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    check(rows, collected(suffixes.op5_suffix_dedup(spark, d)))


def test_keys_that_end_in_zero_bytes(spark, tmp_path):
    """Texts whose key ends in a zero byte lose their passages, and give them to others, like any text."""
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdef ") for _ in range(n))

    def ending(zero, passage):
        while True:
            if (hashlib.md5((t := text(30) + passage + text(30)).encode()).digest()[-1] == 0) == zero:
                return t

    rows = []
    for kinds in ((True, False), (True, True), (False, True, False)):
        passage = text(500)
        rows += [(len(rows) + k, ending(zero, passage), "en", "a", 1) for k, zero in enumerate(kinds)]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    got = collected(suffixes.op5_suffix_dedup(spark, d))
    check(rows, got)
    assert all(g["n_removed"] >= 500 for g in got)


def test_hot_keys(spark, tmp_path, monkeypatch):
    """Near copies by the dozen, dealt out by window hashes: the same answers as any key's."""
    rng = random.Random(12)
    monkeypatch.setattr(suffixes, "HOT", 8)
    base = "".join(rng.choice("abcdefgh \n") for _ in range(2500))
    rows = []
    for i in range(90):
        near = list(base[rng.randrange(300) : 2500 - rng.randrange(300)])
        for _ in range(rng.randrange(1, 9)):
            near[rng.randrange(len(near))] = rng.choice("XYZé")
        rows.append((i, "".join(near), "en", "a", 1))
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    routes = suffixes.routed(5, 6, base.encode(), 40, 400)
    assert len(routes) == 5 and sum(len(r[4]) // 4 for r in routes) == 2101
    check(rows, collected(suffixes.op5_suffix_dedup(spark, d)))


def test_family_equals_one_array():
    rng = random.Random(1)
    base = bytes(rng.randrange(256) for _ in range(2000))
    bodies = [base[a : a + 500 + rng.randrange(100)] for a in (rng.randrange(1400) for _ in range(40))]
    many, one = suffixes.Family(), suffixes.Family()
    for b in bodies:
        many.add([b])
    one.add(bodies)
    count = collections.Counter(b[i : i + 400] for b in bodies for i in range(len(b) - 399))
    want = [count[b[i : i + 400]] > 1 for b in bodies for i in range(len(b) - 399)]
    assert many.matched().tolist() == one.matched().tolist() == want
    level = one.levels[0][1]
    windows = [level.data[s : s + 400].tobytes() for s in level.starts[level.order]]
    assert windows == sorted(windows)


def test_empty(spark, empty):
    assert suffixes.op5_suffix_dedup(spark, empty).count() == 0


def test_stage_removes_passages_of_51_words(spark, tmp_path):
    """A passage of 51 short words goes though it has under 400 bytes; one of 50 stays; 400 bytes in few words go."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randrange(2, 6)))
    words = lambda n: [word() + str(rng.randrange(10**6)) for _ in range(n)]
    short, less, wide = [word() for _ in range(51)], [word() for _ in range(50)], "z".join(words(60))
    assert len(" ".join(short).encode()) < 400 <= len(wide.encode())
    own = [words(80) for _ in range(6)]
    around = lambda i, x: " ".join(own[i][:40]) + " " + x + " " + " ".join(own[i][40:])
    texts = [around(0, " ".join(short)), around(1, "\n".join(short)), around(2, " ".join(less)), around(3, " ".join(less)), around(4, wide), around(5, wide)]
    d = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    got = {r["doc_id"]: r for r in suffixes.suffix_stage(spark, spark.read.parquet(f"{d}/documents.parquet"), d).collect()}
    assert [got[i]["text"].split() for i in (0, 1)] == own[:2]
    assert [got[i]["text"] for i in (2, 3)] == texts[2:4]
    assert all(wide not in got[i]["text"] and got[i]["n_chars"] == len(got[i]["text"]) for i in (4, 5))
