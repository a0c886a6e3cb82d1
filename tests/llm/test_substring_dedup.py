import hashlib
import random

import numpy as np

from tesserae.llm import substring_dedup as S


def brute(rows, k=20):
    words = {i: (t or "").encode().split() for i, t in rows}
    seen, out = set(), {}
    for i in sorted(words):
        w, gone = words[i], set()
        for s in range(len(w) - k + 1):
            g = tuple(w[s : s + k])
            if g in seen:
                gone.update(range(s, s + k))
            seen.add(g)
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest())
    return out


def test_against_brute_force(table, corpus):
    rng = random.Random(7)
    for seed in (1, 2):
        rows = corpus(seed)
        passage = " ".join(f"p{i}" for i in range(55))
        rows += [(100 + i, f"{' '.join(f'u{i}_{j}' for j in range(rng.randint(0, 30)))} {passage} tail{i} {passage if i % 3 == 0 else ''}") for i in range(8)]
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in S.repeated_passages(table(rows)).collect()}
        assert got == brute(rows)


def test_equal_windows_own_equal_anchors():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 5, 400).astype(np.uint64)  # few symbols: many ties
    own = S.anchors(h)[1]
    at = {}
    for s, a in enumerate(own):
        assert s <= a <= s + S.WINDOW - S.GRAM
        assert at.setdefault(h[s : s + S.WINDOW].tobytes(), a - s) == a - s


def test_edges_of_the_input(table, empty):
    assert S.repeated_passages(empty).count() == 0
    text = " ".join(f"w{i}" for i in range(25))
    got = {r.doc_id: (r.n_words, r.n_removed, r.spans) for r in S.repeated_passages(table([(2, text), (None, text), (1, "a " * 19), (3, None), (4, "a " * 19), (5, text + " x")])).collect()}
    assert got == {1: (19, 0, []), 2: (25, 0, []), 3: (0, 0, []), 4: (19, 0, []), 5: (26, 25, [[0, 25]]), None: (25, 25, [[0, 25]])}


def test_repeated_rows_keep_one(table):
    text = " ".join(f"w{i}" for i in range(30))
    got = sorted(r.n_removed for r in S.repeated_passages(table([(1, text), (1, text), (1, text)])).collect())
    assert got == [0, 30, 30]


def test_hot_anchors_are_extended_before_the_shuffle(table):
    """A phrase of many contexts and a passage of many documents, with no, some and all anchors hot."""
    rng = random.Random(3)
    phrase, passage = " ".join(f"q{i}" for i in range(7)), " ".join(f"p{i}" for i in range(30))
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) + f" {phrase} {rng.choice('xyz')} {passage if i % 3 else phrase} " + " ".join(rng.choice("abc") for _ in range(15))) for i in range(60)]
    for hot in (0, 20, 10**9):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in S.repeated_passages(table(rows), hot=hot).collect()}
        assert got == brute(rows)


def test_groups_over_several_batches(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(5)
    n = 400
    meet = np.sort(rng.integers(0, 6, n))
    count = rng.integers(1, 5, n)
    ext = [rng.integers(0, 4, k).astype(np.int64) for k in count]
    seen, want = set(), []
    for i in range(n):
        mask = 0
        for d, x in enumerate(ext[i].tolist()):
            mask |= ((meet[i], x) not in seen) << d
            seen.add((meet[i], x))
        if mask:
            want.append((i, (10 * i) | int(mask) << 48))
    cols = [pa.array(meet), pa.array(np.arange(n)), pa.array((10 * np.arange(n)) << 4 | count), pa.array([x.tobytes() for x in ext])]
    whole = pa.RecordBatch.from_arrays(cols, names=["meet", "row_no", "place", "extensions"])
    for size in (1, 7, n):
        parts = list(S._earliest(whole.slice(i, size) for i in range(0, n, size)))
        assert [(r, f) for p in parts for r, f in zip(*(c.to_pylist() for c in p.columns), strict=True)] == want


def test_largest_id_is_kept(table):
    last = (1 << 63) - 1
    got = {r.doc_id: r.n_removed for r in S.repeated_passages(table([(last, "w " * 30), (None, "v " * 30)])).collect()}
    assert got == {last: 29, None: 29}


def test_windows_of_other_lengths(table, corpus):
    import pytest

    rows = corpus(4)
    for window in (6, 13, 20):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in S.repeated_passages(table(rows), window=window).collect()}
        assert got == brute(rows, window)
    for window in (5, 21, 30):
        with pytest.raises(ValueError, match="window"):
            S.repeated_passages(table(rows), window=window)
