"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Rules measure a text (mean word length either way, symbols a word, repeated lines, repeated words).  A cutoff is
accepted only if labelled documents show that it rejects few good ones: of the n good documents (quality 1) of a
stratum, k would be rejected; if the true rate were above LIMIT, so few would have probability at most
sum_{i<=k} C(n, i) LIMIT^i (1 - LIMIT)^(n - i), the exact binomial tail.  A cutoff is certified if that is at most
DELTA / rules while the cutoffs of a rule are tested in a fixed order from lenient to strict, stopping at the first
failure; with Bonferroni over rules, all certified cutoffs of a stratum hold at once with confidence 1 - DELTA, and the
stratum's false rejection is at most rules x LIMIT.  The confidence is each stratum's own: what a language's labels
certify does not depend on how many other languages there are.  A rule without a certified cutoff rejects nothing.

The strata are the languages, null among them.  One too small to certify anything, even if none of its good documents
were rejected (under 237 of them), takes the cutoffs certified on all languages together.  Those bound the rejection
over all languages, not within the small one; so there a cutoff is taken only as far as it rejects no more than LIMIT of
the stratum's own good documents.  The counts (strata x rules x cutoffs numbers) are all that comes to the driver.

Defined cases: a null text has no words and fails the base rules, as does an empty one.  Labels that are null, or of
unknown ids, teach nothing; repeated labels of an id count once, as good only if all say so.  Without labels only the
base rules reject.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, table, text_or_empty, written

LIMIT, DELTA = 0.02, 0.05
#: The stratum of all languages, as a key of cutoffs: for languages without a labelled good document.
POOLED = ("all languages",)
Cutoffs = dict[tuple[str | tuple | None, str], float]
#: Rules: the measure, and cutoffs from lenient to strict; larger measures are rejected.
RULES: dict[str, list[float]] = {
    "symbols": [3.0, 2.0, 1.5, 1.0, 0.75, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1],
    "dup_lines": [64.0, 32.0, 16.0, 12.0, 8.0, 6.0, 4.0, 3.0],
    "repeats": [0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1],
    "long_words": [24.0, 20.0, 18.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0, 8.5, 8.0],
    "short_words": [-1.5, -2.0, -2.5, -3.0, -3.5, -4.0],
    "shouts": [0.9, 0.7, 0.5, 0.3, 0.2, 0.1],
}


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (longs) and n_shouts."""
    t = text_or_empty(text)
    words = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    grams = F.when(F.size("q_words") >= 3, F.transform(F.sequence(F.lit(1), F.size("q_words") - 2), lambda i: F.xxhash64(F.get("q_words", i - 1), F.get("q_words", i), F.get("q_words", i + 1)))).otherwise(F.array().cast("array<bigint>"))
    seen = F.array_sort(F.transform("q_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    twice = F.filter("q_seen", lambda x, k: (x["g"] == F.get("q_seen", k - 1)["g"]) | (x["g"] == F.get("q_seen", k + 1)["g"]))
    at = F.array_sort(F.transform(twice, lambda x: x["i"]))
    covered = F.aggregate("q_at", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda a, i: F.struct((a["n"] + i + 3 - F.greatest(i, a["end"])).alias("n"), (i + 3).alias("end")), lambda a: a["n"])
    out = docs.withColumns({"q_words": words, "q_lines": lines, "q_text": t})
    out = out.withColumn("q_grams", grams)
    out = out.withColumn("q_any", F.size("q_grams") > F.size(F.array_distinct("q_grams")))
    out = out.withColumn("q_seen", F.when(F.col("q_any"), seen))
    out = out.withColumn("q_at", F.when(F.col("q_any"), at))
    long = lambda c: c.cast("long")
    return out.select(
        *docs.columns,
        long(F.size("q_words")).alias("n_words"),
        long(F.length(F.regexp_replace("q_text", r"[\x20\x09-\x0D]+", ""))).alias("word_chars"),
        long(F.length(F.regexp_replace("q_text", r"[^#*$%&|<>]+", ""))).alias("n_symbols"),
        long(F.size("q_lines") - F.size(F.array_distinct("q_lines"))).alias("n_dup_lines"),
        long(F.coalesce(F.when(F.col("q_any"), covered), F.lit(0))).alias("n_repeat_words"),
        long(F.regexp_count("q_text", F.lit("!!"))).alias("n_shouts"),
    )


def rule_values() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "symbols": F.col("n_symbols") / words, "dup_lines": F.col("n_dup_lines").cast("double"), "repeats": F.col("n_repeat_words") / words,
        "long_words": F.col("word_chars") / words, "short_words": -F.col("word_chars") / words, "shouts": F.col("n_shouts") / words,
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_tail(n: int, k: int, rate: float) -> float:
    """P(at most k of n) at ``rate``."""
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(rate) + (n - i) * math.log1p(-rate) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def certified(counts: list[dict], limit: float = LIMIT, delta: float = DELTA) -> Cutoffs:
    """The strictest certified cutoff by stratum and rule; ``counts``: lang, n, and k of each rule and cutoff."""
    out = {}
    for row in counts:
        for rule, cutoffs in RULES.items():
            for j, cutoff in enumerate(cutoffs):
                n, k = row["n"], row[f"{rule}_{j}"]
                if n == 0 or binomial_tail(n, k, limit) > delta / len(RULES):
                    break
                out[row["lang"], rule] = cutoff
    return out


def with_pooled(counts: list[dict], limit: float = LIMIT, delta: float = DELTA) -> Cutoffs:
    """``certified`` of the strata, and of all together for those that are too small; keys with POOLED: for all others."""
    if not counts:
        return {}
    total = {k: sum(row[k] for row in counts) for k in counts[0] if k != "lang"} | {"lang": POOLED}
    pooled = certified([total], limit, delta)
    out = certified(counts, limit, delta) | pooled
    for row in counts:
        if binomial_tail(row["n"], 0, limit) > delta / len(RULES):
            for (_, rule), strictest in pooled.items():
                for j, cutoff in enumerate(RULES[rule]):
                    if row[f"{rule}_{j}"] > limit * row["n"]:
                        break
                    out[row["lang"], rule] = cutoff
                    if cutoff == strictest:
                        break
    return out


def fit(measured: DataFrame, labels: DataFrame) -> tuple[Cutoffs, list[str | None]]:
    """Cutoffs from all labelled good documents that pass the base rules; and the languages of those."""
    good = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("q_id")).agg(F.min("quality").alias("q_good")).filter("q_good = 1")
    rows = measured.filter(~base_failed()).join(good, F.col("doc_id") == F.col("q_id"))
    over = [F.sum((value > c).cast("long")).alias(f"{rule}_{j}") for rule, value in rule_values().items() for j, c in enumerate(RULES[rule])]
    counts = [r.asDict() for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *over).collect()]
    return with_pooled(counts), [row["lang"] for row in counts]


def verdict(cutoffs: Cutoffs, langs: list[str | None]) -> Column:
    """True for texts that pass the base rules and no cutoff of their stratum rejects; ``langs`` have their own cutoffs."""
    values, bad, known = rule_values(), F.lit(False), F.lit(False)
    for lang in langs:
        known = known | F.col("lang").eqNullSafe(F.lit(lang))
    for (lang, rule), cutoff in cutoffs.items():
        here = ~known if lang == POOLED else F.col("lang").eqNullSafe(F.lit(lang))
        bad = bad | (here & (values[rule] > cutoff))
    return ~base_failed() & ~bad


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the measures, base_failed and kept of every document."""
    rows = written(measures(docs.select("doc_id", "lang", "text")).drop("text"), "measures")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), verdict(*fit(rows, labels)).alias("kept"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass, with the columns of ``docs``; cutoffs are fitted on all of ``docs``."""
    inner = docs.select(F.struct(*docs.columns).alias("q_row"), "doc_id", "lang", "text")
    # written with its measures: a filter over unwritten measures would repeat their expressions for each rule
    measured = written(measures(inner).drop("text"), "measured")
    return measured.filter(verdict(*fit(measured, table(spark, sf_dir, "labels")))).select("q_row.*")
