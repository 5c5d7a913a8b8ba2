import corpus_pipeline

from .conftest import collected


def test_stages_keep_columns_and_run(spark, awkward, empty):
    d, rows = awkward
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns, name
        out.write.parquet(f"{d}/stage-{name}")
        docs = spark.read.parquet(f"{d}/stage-{name}")
    assert corpus_pipeline.STAGES[-1][1](spark, docs, d).count() == corpus_pipeline.run(spark, d).count()
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_other_queries_keep_their_tables(spark, awkward):
    """A lazy result of another query, and of an earlier run, can still be read after the pipeline has run."""
    from quillgrid.llm.suffixes import op5_suffix_dedup

    d, rows = awkward
    other, first = op5_suffix_dedup(spark, d), corpus_pipeline.run(spark, d)
    n = corpus_pipeline.run(spark, d).count()
    assert other.count() == len(rows) and first.count() == n


def test_near_duplicate_stage_keeps_one_of_each_group(spark, awkward):
    d, rows = awkward
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = [r["doc_id"] for r in collected(corpus_pipeline.STAGES[1][1](spark, docs, d))]
    assert [i for i in range(10, 16) if i in kept] == [10] and {0, 1, 2, None} <= set(kept)
    assert {r[0] for r in rows if r[0] is not None and (r[0] < 10 or 30 <= r[0] < 40)} <= set(kept)


def test_near_duplicate_stage_against_exact_similarity(spark):
    """Pairs of Jaccard similarity well above 0.8 collapse; texts without any near 0.7 stay."""
    import collections

    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.STAGES[1][1](spark, docs, d).collect()}
    sets = {}
    where = collections.defaultdict(list)
    for r in docs.collect():
        w = r["text"].encode().lower().split()
        sets[r["doc_id"]] = {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
        for x in sets[r["doc_id"]]:
            where[x].append(r["doc_id"])
    near = collections.defaultdict(float)
    for a, s in sets.items():
        common = collections.Counter(b for x in s for b in where[x] if b != a)
        for b, n in common.items():
            j = n / (len(s) + len(sets[b]) - n)
            near[a] = max(near[a], j)
            if j >= 0.88:
                assert not {a, b} <= kept, (a, b, j)
    assert {a for a in sets if near[a] < 0.68} <= kept
    assert 0 < len(kept) < len(sets)
