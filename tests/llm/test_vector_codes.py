import hashlib
import math
import os

import duckdb
import numpy as np
import pytest

from tesserae.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<double>, label int, code string, q string"


def plain(rows, parts=8, entries=16, rounds=6):
    """Lloyd's rounds with a full scan of Python integers."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = -(-max((len(r[1]) for r in kept), default=0) // parts)
    ints = [[math.floor(4096 * x) for x in r[1]] + [0] * (width * parts - len(r[1])) for r in kept]
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in ints]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, np.array(ints[i], np.int32).tobytes()))[:entries]
    books = [[cut[i][p] for i in order] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, book: min(range(len(book)), key=lambda e: (far(v, book[e]), e))
    for _ in range(rounds):
        at = [[near(v[p], books[p]) for p in range(parts)] for v in cut]
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [v[p] for v, a in zip(cut, at, strict=True) if a[p] == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    codes = [[near(v[p], books[p]) for p in range(parts)] for v in cut]
    errors = [sum(far(v[p], books[p][c[p]]) for p in range(parts)) for v, c in zip(cut, codes, strict=True)]
    sums = {}
    for r, e in zip(kept, errors, strict=True):
        sums[r[2]] = sums.get(r[2], 0) + e
    name = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(str((r[0], "".join("%02x" % c for c in cs), e, sums[r[2]], name)) for r, cs, e in zip(kept, codes, errors, strict=True))


@pytest.fixture
def found(spark, table, monkeypatch):
    def run(rows, schema=SCHEMA, **kwargs):
        coded, books, scans = V.compressed(table(rows, schema), **kwargs)
        out = V.with_label_errors(coded).collect()
        return sorted(str((r.vec_id, r.code, r.error, r.label_error, V.digest(books))) for r in out), scans

    return run


def grouped(n, dims, seed, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, dims))
    return [(i, (centres[rng.integers(30)] + spread * rng.normal(size=dims)).tolist(), int(rng.integers(3)) or None) for i in range(n)]


def test_bounds_give_what_full_scans_give(found):
    rows = grouped(400, 24, 1)
    got, scans = found(rows)
    assert got == plain(rows)
    assert scans[0] == 400 * 8 and sum(scans[1:]) < 400 * 8 * 2  # bounds rule out most scans


def test_ties_repeats_and_rows_that_go(found):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.integers(-1, 2, 16) / 4096).tolist(), i % 2) for i in range(300)]  # distances tie everywhere
    rows += [rows[3], rows[3], (None, [0.5] * 16, None), (None, [0.5] * 16, None), (700, None, 1), (701, [None] + [0.0] * 15, 1)]
    rows += [(702, [float("nan")] + [0.0] * 15, 1), (703, [float("inf")] * 16, None), (-5, [-0.0001] * 16, 7)]
    got, _ = found(rows)
    assert got == plain(rows) and len(got) == 305


def test_lengths_few_rows_and_none(found):
    rows = [(3, [0.1, 0.2, 0.3], 1), (1, [], None), (2, [1.0] * 9, 1), (4, [-2.5] * 17, 1)]
    assert found(rows)[0] == plain(rows)
    assert found([(1, [0.5] * 8, 1)])[0] == plain([(1, [0.5] * 8, 1)])
    assert found([]) == ([], []) and found([(1, None, 1)]) == ([], [])
    assert found(grouped(50, 8, 3), parts=2, entries=5, rounds=3)[0] == plain(grouped(50, 8, 3), parts=2, entries=5, rounds=3)


def test_large_components_are_exact_and_the_largest_saturate(found):
    rows = [(i, [x * 1000.0 for x in v], k) for i, v, k in grouped(60, 16, 4)]
    assert found(rows)[0] == plain(rows)
    assert len(found([(1, [1e300, -1e300], 1), (2, [0.0, 1.0], 1)])[0]) == 2


def test_hot_and_rare_labels(found, monkeypatch):
    monkeypatch.setattr(V, "HOT", 3)
    rows = [(i, v, 0 if i % 2 else i) for i, v, _ in grouped(90, 8, 5)]
    assert found(rows)[0] == plain(rows)


def test_query_against_sql(spark):
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    path = f"{data}/embeddings.parquet"
    con.execute(f"create view embeddings as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    want = con.execute(V.SQL)
    df = V.query(spark, data)
    assert df.columns == [d[0] for d in want.description]
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want.fetchall()))
