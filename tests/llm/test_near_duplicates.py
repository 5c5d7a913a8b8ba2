import numpy as np

from quillgrid.llm import simhash
from quillgrid.llm.common import written


def test_all_pairs_of_a_mixed_bucket(spark):
    """1500 pairs of twins in one bucket, which share no other: each pair is found, and nothing else joined."""
    rng = np.random.default_rng(4)
    common = rng.integers(0, 1 << 16, simhash.BAND, dtype=np.uint16)
    rows = []
    for g in range(1500):
        sig = rng.integers(0, 1 << 16, simhash.HASHES, dtype=np.uint16)
        sig[: simhash.BAND] = common
        twin = sig.copy()
        twin[simhash.BAND :: simhash.BAND] ^= 1
        assert (sig == twin).mean() >= 0.8
        rows += [(10 * g + k, int(rng.integers(-(1 << 63), 1 << 63)), s.tobytes()) for k, s in enumerate((sig, twin))]
    nodes = written(spark.createDataFrame(rows, "node long, fp long, sig binary").repartition(4), "nodes")
    roots = {r["node"]: r["root"] for r in simhash.near_roots(nodes, 0.8, lambda pairs: simhash.estimated(pairs, nodes, 0.8)).collect()}
    assert set(roots) == {r[0] for r in rows}
    assert all(roots[10 * g] == roots[10 * g + 1] for g in range(1500)) and len(set(roots.values())) == 1500


def test_groups_are_those_of_the_exact_similarity(spark):
    """The documents kept are exactly the least ids of the components of pairs of Jaccard similarity 0.8 or more."""
    import collections

    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = {r["doc_id"] for r in simhash.near_duplicate_stage(spark, docs, d).select("doc_id").collect()}
    sets, ids = {}, collections.defaultdict(list)
    where = collections.defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        w = (r["text"] or "").encode().lower().split()
        ids[frozenset(b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else r["doc_id"]].append(r["doc_id"])
    for k, s in enumerate(ids):
        if not isinstance(s, int):
            sets[k] = s
            for x in s:
                where[x].append(k)
    parent = list(range(len(ids)))

    def find(k):
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    near, close = 0, 0
    for a, s in sets.items():
        for b, n in collections.Counter(b for x in s for b in where[x] if b > a).items():
            j = n / (len(s) + len(sets[b]) - n)
            near, close = near + (0.8 <= j < 0.82), close + (0.76 <= j < 0.8)
            if j >= 0.8:
                parent[find(a)] = find(b)
    least = collections.defaultdict(list)
    for k, own in enumerate(ids.values()):
        least[find(k)] += own
    want = {min(x) for x in least.values()}
    print(len(want), len(kept), len(want - kept), len(kept - want), near, close)
    assert near and close and kept == want


def test_forest_joins_what_all_links_join():
    """Units of one and of two blocks: as few links as possible, none of one root, joining what all pairs would."""
    import pandas as pd

    rng = np.random.default_rng(7)
    base = np.arange(300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, 285, replace=False), rng.integers(1000, 9000, int(rng.integers(0, 60))).astype(np.uint64)])) for _ in range(60)]
    rows = [(7, int(i >= 40), 0, i, 100 + i // 2, simhash.signature(s), s.tobytes()) for i, s in enumerate(sets)]
    for unit in (pd.DataFrame(rows[:40], columns=["unit", "side", "band", "node", "root", "sig", "set"]), pd.DataFrame(rows, columns=["unit", "side", "band", "node", "root", "sig", "set"])):
        found = simhash.forest(unit, 0.5, 0.8)
        close = [(int(i), int(j)) for i, at in simhash.close_pairs(unit, 0.5) for j in at]
        side, root = unit["side"].tolist(), unit["root"].tolist()
        assert all(root[i] != root[j] and (side[i], side[j]) in {(0, 0), (0, 1)} for i, j in close)

        def groups(pairs, root=root):
            up = {r: r for r in root}
            for i, j in pairs:
                old, new = up[root[i]], up[root[j]]
                up = {r: new if x == old else x for r, x in up.items()}
            return {frozenset(r for r in up if up[r] == x) for x in up.values()}

        all_links = [(i, j) for i, j in close if simhash.jaccard(sets[i], sets[j]) >= 0.8]
        assert groups(found) == groups(all_links) and len(found) == len(set(root)) - len(groups(found)) and len(found) < len(all_links)
