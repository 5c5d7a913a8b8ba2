"""Toxicity by Levenshtein automata over a lexicon trie, with context windows.

The lexicon is learned from labelled texts: words, and stems (beginnings of words), that stand in toxic texts far more
often than chance over all candidates explains.  A term's support is the number of different neighbourhoods (word
before, word after) in which it stands in toxic texts, so that copies of one text don't make its words look toxic.  It is laid out as a trie; the automaton of all strings within an edit distance of a term
(1 from five letters on, 2 from nine) is intersected with the trie by walking sets of (node, edits) through a word.
The walk's states are determinised as they are met and kept, so a word costs a table look-up a letter, and most words
leave the automaton after a few letters.

A second lexicon holds weaker terms: they stand in clean texts too, but a text with one is toxic far more often than the
base rate, by numbers of texts (a common word has many neighbourhoods, but stands in most texts of its language).  Their
hits have weights of their own, so that it takes several to call a text toxic.

Each hit is judged in a window of words around it: inside quotation marks or near words of reporting it counts as a
quotation, else as use.  A logistic regression over logarithmic counts of hits (exact or misspelled, used or quoted)
and their density gives the score.

Learning reads at most SAMPLE labelled texts, those whose ids have the least hashes (a top-k over the narrow table of
labels).  Scores read whole texts of all documents.

Defined cases: a null or empty text has no hits and gets the score of that.  Labels that are null, or of null ids,
teach nothing; an id with several labels takes the largest.  Without both kinds of label every score is the base rate.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, table, text_or_empty, written

#: Most labelled texts that are learned from (the bound of the sample; all its terms are counted).
SAMPLE = 20_000
#: Candidates that the bound on chance allows for.
CANDIDATES = 50_000
#: Least support of a term; chance that any candidate is taken by accident; lengths of stems.
SUPPORT, CHANCE, STEMS = 5, 1e-3, range(4, 9)
#: Least share of toxic texts among those that have a weaker term.
WEAK = 0.3
WINDOW, CACHE_ENTRIES = 6, 500_000
FEATURES = 11

TOKEN = re.compile(r"\w+|[\"“”„«»‘’]")
QUOTES = frozenset("\"“”„«»‘’")
#: Words by which speech is reported, in the languages at hand.
REPORTING = frozenset("said says wrote called quote quoted quotes word term insult sagte schrieb nannte zitat dit écrit appelé citation dijo escribió llamó cita".split())


def terms_of(text: str) -> set[str]:
    """Words, and stems (with a star), of a text."""
    words = {w for w in TOKEN.findall(text.lower()) if len(w) >= 3}
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


def sampled(labels: DataFrame) -> DataFrame:
    """l_id, label of at most SAMPLE labelled ids that may be learned from."""
    rows = labels.filter("doc_id is not null and toxic is not null").filter(crc_mod(F.col("doc_id"), 4) != 2)
    rows = rows.groupBy(F.col("doc_id").alias("l_id")).agg(F.max("toxic").alias("label"))
    return rows.orderBy(F.xxhash64("l_id"), "l_id").limit(SAMPLE)


def contexts(text: str) -> set[tuple[str, int]]:
    """Terms of a text, each with a hash of the words around it."""
    words = [w for w in TOKEN.findall(text.lower()) if w not in QUOTES]
    out = set()
    for before, w, after in zip(["", *words], words, [*words[1:], ""], strict=False):
        if len(w) >= 3:
            around = zlib.crc32(f"{before} {after}".encode("utf-8", "replace"))
            out.add((w, around))
            out.update((w[:n] + "*", around) for n in STEMS if len(w) > n)
    return out


def learn_terms(texts: DataFrame) -> list[tuple[str, int, int, int]]:
    """Terms, their support in toxic texts, and the numbers of toxic and of other texts that have them.

    ``texts`` (text, label) are a bounded sample, so the terms of SUPPORT that come to the driver are bounded too.
    """

    def supported(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = list(set().union(*map(contexts, batch["text"])))
            yield pd.DataFrame({"term": pd.Series([x[0] for x in found], dtype=object), "around": pd.Series([x[1] for x in found], dtype="int64")})

    bad = texts.filter("label = 1").select("text").mapInPandas(supported, "term string, around long").groupBy("term").agg(F.count_distinct("around").alias("n"))
    support = {r["term"]: r["n"] for r in bad.filter(F.col("n") >= SUPPORT).collect()}
    if not support:
        return []
    only = frozenset(support)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter = Counter()
        for batch in batches:
            for text, label in zip(batch["text"], batch["label"], strict=True):
                n.update((t, label) for t in terms_of(text) & only)
        yield pd.DataFrame({"term": pd.Series([t for t, _ in n], dtype=object), "label": pd.Series([x for _, x in n], dtype="int64"), "n": pd.Series(list(n.values()), dtype="int64")})

    rows = texts.mapInPandas(counted, "term string, label long, n long").groupBy("term", "label").agg(F.sum("n").alias("n")).collect()
    having = {(r["term"], r["label"]): r["n"] for r in rows}
    return [(t, n, having.get((t, 1), 0), having.get((t, 0), 0)) for t, n in sorted(support.items())]


def unlikely(a: int, b: int, rate: float) -> bool:
    """Is a share of a in a + b above ``rate`` beyond chance, were all candidates tried?  (Chernoff's bound.)"""
    n, x = a + b, a / (a + b)
    if x <= rate:
        return False
    divergence = x * math.log(x / rate) + ((1 - x) * math.log((1 - x) / (1 - rate)) if x < 1 else 0.0)
    return n * divergence >= math.log(CANDIDATES / CHANCE)


def general(terms: list[tuple[str, int]], but: list[str]) -> list[str]:
    """Of (term, support) the terms that no other, or one of ``but``, makes needless."""
    terms = sorted(terms, key=lambda x: (-x[1], len(x[0]), x[0]))
    within: dict[str, int] = {}  # the support of the best word that a stem begins
    for t, a in terms:
        if t[-1] != "*":
            for n in STEMS:
                within[t[:n]] = max(within.get(t[:n], 0), a)
    words, stems, kept = {t for t in but if t[-1] != "*"}, {t[:-1] for t in but if t[-1] == "*"}, []
    for t, a in terms:
        bare = t.rstrip("*")
        # a stem that hardly reaches beyond one word (which may be misspelled) gives way to it
        if (t[-1] != "*" or a >= 1.2 * within.get(bare, 0)) and bare not in words and not any(bare[:n] in stems for n in STEMS):
            kept.append(t)
            if t[-1] == "*":
                stems.add(bare)
    return sorted(kept)


def lexicon(terms: list[tuple[str, int, int, int]], n_bad: int, n_good: int) -> tuple[list[str], list[str]]:
    """The terms that stand in toxic texts beyond chance, and in few others; and the weaker ones."""
    rate = n_bad / (n_bad + n_good)
    strong = general([(t, a) for t, a, _, b in terms if a >= 9 * b and unlikely(a, b, rate)], [])
    weak = [(t, a) for t, a, n, b in terms if a < 9 * b and n >= WEAK * (n + b) and unlikely(min(a, n), b, rate)]
    return strong, general(weak, strong)


class Automaton:
    """The trie of a lexicon intersected with its Levenshtein automata, determinised as it is walked."""

    def __init__(self, terms: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.reach: list[int] = [0]  # most edits that a term below allows
        self.ends: list[str] = [""]  # "" no term, "=" a word, "*" a stem
        for t in terms:
            bare, node = t.rstrip("*"), 0
            edits = self.edits(t)
            self.reach[0] = max(self.reach[0], edits)
            for ch in bare:
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.reach.append(0)
                    self.ends.append("")
                node = self.children[node][ch]
                self.reach[node] = max(self.reach[node], edits)
            self.ends[node] = "*" if "*" in (t[-1], self.ends[node]) else "="
            self.own = getattr(self, "own", {}) | {node: edits}
        start = self._closed({(0, 0): 0})
        self.ids = {start: 0}
        self.states = [start]
        self.steps: list[dict[str, int]] = [{}]
        self.stem_hit = [self._stem(start)]

    @staticmethod
    def edits(term: str) -> int:
        """Edits that a term allows: stems must stand exactly."""
        n = len(term)
        return 0 if term[-1] == "*" or n < 5 else 1 if n < 9 else 2

    def _closed(self, active: dict) -> frozenset:
        """With letters of terms left out."""
        best = {}
        todo = [(node, e) for node, e in active]
        while todo:
            node, e = todo.pop()
            if e > self.reach[node] or best.get(node, 9) <= e:
                continue
            best[node] = e
            todo += [(c, e + 1) for c in self.children[node].values()]
        return frozenset(best.items())

    def _stem(self, state: frozenset) -> bool:
        return any(self.ends[n] == "*" and e == 0 for n, e in state)

    def step(self, s: int, ch: str) -> int:
        got = self.steps[s].get(ch)
        if got is None:
            after: dict = {}
            for node, e in self.states[s]:
                after[node, e + 1] = 0  # a letter too many
                for c, child in self.children[node].items():
                    after[child, e + (c != ch)] = 0
            state = self._closed(after)
            got = self.ids.get(state)
            if got is None:
                got = self.ids[state] = len(self.states)
                self.states.append(state)
                self.steps.append({})
                self.stem_hit.append(self._stem(state))
            self.steps[s][ch] = got
        return got

    def match(self, word: str) -> int:
        """0: no term; 1: a term, or a stem that begins the word; 2: a misspelled term."""
        s = 0
        for ch in word:
            s = self.step(s, ch)
            if not self.states[s]:
                return 0
            if self.stem_hit[s]:
                return 1
        best = min((e for n, e in self.states[s] if self.ends[n] and e <= self.own.get(n, 0) and (self.ends[n] == "=" or not e)), default=9)
        return 0 if best == 9 else 1 if best == 0 else 2


def features(text: str, automaton: Automaton, cache: dict, weaker: Automaton | None = None) -> list[float]:
    tokens = TOKEN.findall(text.lower())
    hits, weak = [], 0
    for i, w in enumerate(tokens):
        m = cache.get(w)
        if m is None:
            if len(cache) >= CACHE_ENTRIES:
                cache.clear()
            m = cache[w] = automaton.match(w) or (4 if weaker is not None and weaker.match(w) else 0)
        if m == 4:
            weak += 1
        elif m:
            hits.append((i, m))
    n = [0, 0, 0, 0]  # used exactly, quoted exactly, used misspelled, quoted misspelled
    if hits:
        marks = np.cumsum([t in QUOTES for t in tokens])
        for i, m in hits:
            a, b = max(0, i - WINDOW), i + WINDOW + 1
            quoted = (marks[i] % 2 == 1 and (any(t in QUOTES for t in tokens[i:b]))) or not REPORTING.isdisjoint(tokens[a:i])
            n[2 * (m - 1) + quoted] += 1
    log = [math.log1p(x) for x in n]
    some = [float(n[0] > 0), float(n[2] > 0 and not n[0])]
    return [1.0, *log, *some, 100 * (n[0] + n[2]) / (len(tokens) + 50), math.log1p(weak), float(weak > 1), 100 * weak / (len(tokens) + 50)]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        keep = np.r_[1e-6, np.full(len(w) - 1, ridge)]
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w = w + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame) -> tuple[tuple[list[str], list[str]], np.ndarray]:
    """Lexicons and weights from labelled documents (doc_id, text)."""
    picked = F.broadcast(sampled(labels))  # at most SAMPLE rows
    texts = written(docs.join(picked, F.col("doc_id") == F.col("l_id")).select("text", (F.col("label") > 0).cast("int").alias("label")), "labelled")
    n = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not (n.get(0) and n.get(1)):
        rate = (n.get(1, 0) + 0.5) / (sum(n.values()) + 1)
        return ([], []), np.array([math.log(rate / (1 - rate)), *[0.0] * (FEATURES - 1)])
    terms = lexicon(learn_terms(texts), n[1], n[0])
    rows = texts.select("label", feature_udf(terms)("text").alias("x")).groupBy("label", "x").count().orderBy("label", "x").collect()  # at most SAMPLE rows
    x = np.array([r["x"] for r in rows]).repeat([r["count"] for r in rows], axis=0)
    return terms, fit(x, np.array([r["label"] for r in rows], float).repeat([r["count"] for r in rows]))


def feature_udf(terms: tuple[list[str], list[str]]):
    key = tuple(map(tuple, terms))

    @F.pandas_udf("array<double>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if key not in _worker:
            _worker.clear()
            _worker[key] = (Automaton(terms[0]), {}, Automaton(terms[1]))
        for texts in batches:
            yield pd.Series([features(t, *_worker[key]) for t in texts])

    return of


_worker: dict = {}


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty().alias("text"))
    terms, w = learn(docs, table(spark, sf_dir, "labels"))
    x = docs.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), feature_udf(terms)("text").alias("x"))
    z = sum((F.get("x", i) * F.lit(float(c)) for i, c in enumerate(w)), F.lit(0.0))
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
    return x.select("doc_id", "held_out", score.alias("score"), (score >= 0.3).cast("int").alias("predicted"))
