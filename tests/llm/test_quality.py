from quillgrid.llm import quality


def test_bad_documents_are_rejected_in_every_language(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = quality.op6_quality_rules(spark, d).join(docs.select("doc_id", "lang"), "doc_id").join(labels, "doc_id").filter("not base_failed and quality is not null")
    by = {(r["lang"], r["quality"]): r for r in got.groupBy("lang", "quality").agg({"*": "count", "kept": "count"}).selectExpr("lang", "quality", "`count(1)` n").collect()}
    kept = {(r["lang"], r["quality"]): r["count"] for r in got.filter("kept").groupBy("lang", "quality").count().collect()}
    langs = {lang for lang, q in by}
    assert {"de", "en", "es", "fr"} <= langs
    print({k: (r["n"], kept.get(k, 0)) for k, r in sorted(by.items(), key=str)})
    for lang in langs:
        assert kept.get((lang, 0), 0) <= 0.1 * by[lang, 0]["n"], lang
        assert kept[lang, 1] >= 0.98 * by[lang, 1]["n"], lang


def counts(lang, n, **k):
    return {"lang": lang, "n": n} | {f"{rule}_{j}": k.get(rule, 0) for rule, cutoffs in quality.RULES.items() for j in range(len(cutoffs))}


def test_small_strata_take_pooled_cutoffs():
    strictest = {rule: cutoffs[-1] for rule, cutoffs in quality.RULES.items()}
    got = quality.with_pooled([counts("en", 3000), counts("de", 300, long_words=60), counts(None, 20, symbols=1), counts("es", 237)])
    of = lambda lang: {rule: c for (x, rule), c in got.items() if x == lang}
    assert of("en") == of("es") == strictest
    # many labels that speak against a rule: the pooled cutoff does not replace them
    assert of("de") == {r: c for r, c in strictest.items() if r != "long_words"}
    # few labels: pooled, but not where they speak against it
    assert of(None) == {r: c for r, c in of(quality.POOLED).items() if r != "symbols"}
    assert "symbols" in of(quality.POOLED)
    assert quality.with_pooled([]) == {}


def test_languages_without_labels_take_pooled_cutoffs(spark):
    cutoffs = quality.with_pooled([counts("en", 3000)])
    rows = spark.createDataFrame([(lang, 100, 500, s, 0, 0, 0) for lang in ("en", "xx", None) for s in (0, 500)], "lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_shouts long")
    got = rows.select("lang", "n_symbols", quality.verdict(cutoffs, ["en"]).alias("kept")).collect()
    assert {(r["lang"], r["n_symbols"], r["kept"]) for r in got} == {(lang, n, n == 0) for lang in ("en", "xx", None) for n in (0, 500)}
