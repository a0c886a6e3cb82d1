import numpy as np

from tesserae.llm import near_dedup as D
from tesserae.llm.common import WordHash


def sets_of(rows, k=5):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    return out


def brute(rows):
    s = sets_of(rows)
    root = {i: i for i in s}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in s:
        for j in s:
            if i < j and s[i] and s[j] and 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s[i]), find(i)) for i in s}


def test_against_brute_force(table, corpus):
    for seed in (1, 2):
        rows = corpus(seed, 60)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in D.near_groups(table(rows)).collect()}
        assert got == brute(rows)


def test_a_large_group_with_many_components_in_one_band(table):
    # One base text, and texts that differ from it by more and more words: links only along the chain.
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for p in rng.choice(120, 1 + i % 9, replace=False):
            w[p] = f"x{i}_{p}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in D.near_groups(table(rows)).collect()}
    assert got == {i: c for i, (_, c) in brute(rows).items()}


def test_pairs_of_groups_and_blocks():
    rng = np.random.default_rng(9)
    for seed in range(6):
        m = 120
        group, side = np.sort(rng.integers(0, 9, m)), rng.integers(0, 2 if seed % 2 else 1, m).astype(bool)
        n, root = rng.integers(20, 60, m), rng.integers(0, 30, m)
        base = rng.integers(0, 2**62, D.SKETCH)
        sketch = np.array([base ^ (rng.integers(0, 2**62, D.SKETCH) & rng.integers(0, 2**62, D.SKETCH) * (rng.random(D.SKETCH) < 0.02)) for _ in range(m)])
        two = {g: len(set(side[group == g])) > 1 for g in group}
        want = set()
        for i in range(m):
            for j in range(i + 1, m):
                apart = sum(int(v).bit_count() for v in (sketch[i] ^ sketch[j]).view(np.uint64))
                if group[i] == group[j] and root[i] != root[j] and (side[i] != side[j] or not two[group[i]]) and 75 * max(n[i], n[j]) <= 100 * min(n[i], n[j]) and 175 * apart <= 25 * (n[i] + n[j]):
                    want.add((i, j))
        got = D.near_pairs(group, n, root, sketch, side, 75)
        assert sorted(map(tuple, map(sorted, zip(*(x.tolist() for x in got), strict=True)))) == sorted(want) and want


def test_blocks_lose_no_pair(spark):
    rng = np.random.default_rng(10)
    base = rng.integers(0, 2**62, D.SKETCH)
    rows = [(int(i), 100, int(b), int(i % 7), base.tobytes()) for b in (1, 2) for i in range(40 * b)]
    at = spark.createDataFrame(rows, "node long, n long, band long, root long, sketch binary")
    want = {(i, j) for i in range(80) for j in range(i + 1, 80) if i % 7 != j % 7}
    for block in (3, 16, 1000):
        assert {(r.a, r.b) for r in D.crossing(at, 75, block).collect()} == want


def test_many_texts_of_one_template(table):
    """No two are links, and all share bands: their pairs are ruled out by sketches, in groups of bounded size."""
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(3000):
        w = list(base)
        for p in rng.choice(200, 9, replace=False):
            w[p] = f"x{i}_{p}"
        rows.append((i, " ".join(w)))
    assert D.near_groups(table(rows)).where("component_id != doc_id").count() == 0


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(4)
    for _ in range(50):
        a = rng.integers(0, 2**63, rng.integers(1, 400)).astype(np.uint64)
        b = np.concatenate([a[: len(a) // 2], rng.integers(0, 2**63, 50).astype(np.uint64)])
        x, y = (D.parity_sketches(s, np.zeros(len(s), np.int64), 1)[0] for s in (a, b))
        differ = sum(int(v).bit_count() for v in (x ^ y).view(np.uint64))
        assert differ <= len(set(a.tolist()) ^ set(b.tolist()))


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    gaps = []
    for _ in range(60):
        pool = rng.integers(0, 2**63, 300).astype(np.uint64)
        a, b = pool[:240], pool[40:]
        s = D.super_minhash(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2)
        gaps.append((s[0] == s[1]).mean() - 200 / 300)
    assert abs(np.mean(gaps)) < 0.02 and np.std(gaps) < 0.06
    one = D.super_minhash(np.array([7], np.uint64), np.zeros(1, np.int64), 1)
    assert (one[0] >> 32).tolist() != [0] * D.SLOTS and sorted((one[0] >> 32).tolist()) == list(range(D.SLOTS))


def test_union_find_rounds(spark):
    rng = np.random.default_rng(6)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2))] + [(i, i + 1) for i in range(300, 340)]
    got = {r.node: r.root for r in D.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {i: i for e in edges for i in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert {i: got.get(i, i) for i in root} == root


def test_edges_of_the_input(table, empty):
    assert D.near_groups(empty).count() == 0
    rows = [(1, None), (2, ""), (3, "one two"), (4, "ONE two"), (None, "one two"), (4, "one two"), (7, " ")]
    got = D.near_groups(table(rows)).collect()
    assert sorted((r.doc_id or 99, r.component_id, r.kept) for r in got) == [(1, 1, True), (2, 2, True), (3, 3, True), (4, 3, False), (4, 3, False), (7, 7, True), (99, 3, False)]
    docs = table(rows)
    out = D.one_of_each(docs)
    assert out.columns == docs.columns and out.count() == 4


def test_short_texts_are_one_shingle():
    h = WordHash()
    assert len(D.shingle_set(b"a b", h)) == 1 and len(D.shingle_set(b"", h)) == 0
    assert D.shingle_set(b"a b", h).tolist() == D.shingle_set(b"A  b\n", h).tolist()
