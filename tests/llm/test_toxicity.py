import random

from quillgrid.llm import toxicity

from .conftest import by_text, collected, crc


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row[-1]


def _next(row, i, x, b):
    new = [i]
    for j, y in enumerate(b, 1):
        new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
    return new


def test_automaton_equals_edit_distance():
    rng = random.Random(4)
    terms = ["abab", "abcde", "abcdeabcd", "bcdea", "cab*", "edcba"]
    a = toxicity.Automaton(terms)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randrange(1, 11))) for _ in range(3000)] + [t.rstrip("*") for t in terms]
    for w in words:
        stem = any(t[-1] == "*" and w.startswith(t[:-1]) for t in terms)
        exact = stem or w in terms
        near = any(distance(w, t) <= toxicity.Automaton.edits(t) for t in terms if t[-1] != "*")
        assert a.match(w) == (1 if exact else 2 if near else 0), w


def test_quotation_is_told_from_use():
    a = toxicity.Automaton(["idiot"])
    assert toxicity.features("you idiot", a, {})[1:3] != toxicity.features('he said "idiot" to me', a, {})[1:3]
    assert toxicity.features("you idoit what an idiit", a, {})[3] > 0


def test_held_out(spark):
    """Recall and false alarms on held-out labels, in every language."""
    d = "/root/testdata/sf0.1"
    got = toxicity.op10_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out and toxic is not null")
    rows = got.collect()
    for lang in ("en", "de", "fr", "es"):
        bad, good = [[r["predicted"] for r in rows if r["lang"] == lang and r["toxic"] == t] for t in (1, 0)]
        print(lang, sum(bad), len(bad), sum(good), len(good))
        # one in fourteen of the English toxic texts here has none of the terms, nor a misspelled one
        assert sum(bad) >= 0.9 * len(bad) and sum(good) <= 0.03 * len(good), lang
    hit = sum(r["predicted"] and r["toxic"] for r in rows)
    assert hit >= 0.9 * sum(r["toxic"] for r in rows) and hit >= 0.95 * sum(r["predicted"] for r in rows)


def test_awkward(spark, awkward, empty):
    d, rows = awkward
    got = collected(toxicity.op10_toxicity(spark, d))
    assert len(got) == len(rows)
    for r, g in by_text(rows, got):
        assert g["held_out"] == (crc(r[0], 4) == 2) and 0 <= g["score"] <= 1 and g["predicted"] == (g["score"] >= 0.3)
    assert toxicity.op10_toxicity(spark, empty).count() == 0


def test_weaker_terms_need_several():
    """A term of 40 toxic and 30 clean texts is a weaker one; a common word with many neighbourhoods is none."""
    strong, weak = toxicity.lexicon([("foul", 60, 50, 1), ("bomen*", 90, 40, 30), ("bomente", 60, 30, 25), ("common", 900, 60, 380)], 100, 800)
    assert strong == ["foul"] and weak == ["bomen*"]
    a, b = toxicity.Automaton(strong), toxicity.Automaton(weak)
    one, two = (toxicity.features(t, a, {}, b) for t in ("x bomenti y", "x bomenti bomenta y"))
    assert one[1:8] == [0.0] * 7 and one[9] == 0 < one[8] and two[9] == 1 and two[8] > one[8]
