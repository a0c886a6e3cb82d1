import math

import numpy as np

from tesserae.llm import quality_rules as Q
from tests.llm import test_quality_rules as T


def estimate(x):
    """``T.estimate`` for any number of rows, of which the half is all where they are fewer than five."""
    n, ridge = len(x), np.diag([(t * Q.GRID) ** 2 for t in Q.TOLERANCE.values()])
    if n >= 5:
        return T.estimate(x)
    even = lambda w, factor: (w @ x / w.sum(), factor * np.cov(x.T, aweights=w, ddof=0) + ridge if n > 1 else ridge)
    mean, cov = even(np.ones(n), 1.0)
    far = np.einsum("ni,ij,nj->n", x - mean, np.linalg.inv(Q.consistency(0.5) * cov), x - mean)
    return even((far <= Q.quantile(0.975, 4)).astype(float), Q.consistency(0.975))


def test_query_estimates_each_language_and_source_over_every_row(spark, table, tmp_path):
    rows = T.mixed_corpus()[:-603] + [(9000 + i, T.mixed_corpus()[3][1], "en", "a") for i in range(90)] + [(9500, T.prose(T.random.Random(8), 30), "fr", "z")]
    table(rows, T.SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in Q.query(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    found = {i: T.plain_counts(t) for i, t, *_ in rows}
    grid = lambda v: math.floor(v * Q.GRID + 0.5)
    groups = {}
    for i, _, *own in rows:
        n, c, s, d, r = found[i]
        if not got[i].base_failed:
            groups.setdefault(tuple(own), {})[i] = grid(math.log(c / n)), *(grid(math.sqrt(x / n)) for x in (s, d, r))
    assert sum(len(v) < 5 for v in groups.values()) and sum(len(set(v.values())) < Q.LEAST for v in groups.values()) > 3
    for members in groups.values():
        mean, cov = estimate(np.array(sorted(members.values()), float))
        inverse = np.linalg.inv(cov)
        for i, v in members.items():
            want = float((np.array(v) - mean) @ inverse @ (np.array(v) - mean))
            assert math.isclose(got[i].distance, want, rel_tol=1e-6, abs_tol=1e-9), (i, got[i].distance, want)
            assert got[i].kept == (want <= Q.quantile(1 - Q.TAIL, 4))
