import math
import random
import re
from collections import Counter

import numpy as np

from tesserae.llm import quality_rules as Q
from tesserae.llm import text_statistics as S

SCHEMA = "doc_id long, text string, lang string, source string, n_words int, kept string, own string, row int, mean int"


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    many = {w for w, n in times.items() if n > 1}
    held = {i + k for i, w in enumerate(windows) if w in many for k in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(held)


def plain_verdicts(rows):
    """The estimator over lists: every group's vectors at once, with numpy alone."""
    found = [plain_counts(t) for _, t, *_ in rows]
    failed = [n < 20 or 100 * rep > 30 * n for n, _, _, _, rep in found]
    grid = lambda v: math.floor(v * Q.GRID + 0.5)
    vectors = [None if f else (grid(math.log(c / n)), grid(math.sqrt(s / n)), grid(math.sqrt(d / n)), grid(math.sqrt(r / n))) for (n, c, s, d, r), f in zip(found, failed, strict=True)]
    own = {}
    for (_, _, lang, source), v in zip(rows, vectors, strict=True):
        if v:
            own.setdefault((lang, source), set()).add(v)
    small = {}
    for k, v in own.items():
        if len(v) < Q.LEAST:
            small[k[0]] = small.get(k[0], 0) + len(v)
    group = {k: k if len(v) >= Q.LEAST else (k[0],) if small[k[0]] >= Q.LEAST else () for k, v in own.items()}
    members = {}
    for k, v in own.items():
        members.setdefault(group[k], []).extend(v)
    estimates = {g: estimate(np.array(sorted(v), float)) for g, v in members.items() if len(v) >= Q.LEAST}
    out = []
    for r, v, f, c in zip(rows, vectors, failed, found, strict=True):
        e = estimates.get(group.get((r[2], r[3]))) if v else None
        d = None if e is None else float((np.array(v) - e[0]) @ np.linalg.inv(e[1]) @ (np.array(v) - e[0]))
        out.append((r[0], *c, f, d, not f and (d is None or d <= Q.quantile(1 - 1e-6, 4))))
    return out


def estimate(x):
    n, ridge = len(x), np.diag([(t * Q.GRID) ** 2 for t in (0.05, 0.1, 0.1, 0.15)])
    middle = lambda a: np.sort(a, axis=0)[(n + 1) // 2 - 1]
    centre = middle(x)
    scale = 1.4826 * middle(np.abs(x - centre)) + np.sqrt(np.diag(ridge))
    z = (x - centre) / scale
    unit = z / np.maximum(np.linalg.norm(z, axis=1), 1e-300)[:, None]
    starts = [(centre, np.diag(scale**2) + ridge)]
    for y in (np.tanh(z), unit):
        m = np.floor(y * 10_000 + 0.5)
        m = m.T @ m + np.eye(4) * 1e-9
        starts.append((centre, m / np.sqrt(np.outer(np.diag(m), np.diag(m))) * np.outer(scale, scale) + ridge))
    far = lambda e: np.einsum("ni,ij,nj->n", x - e[0], np.linalg.inv(e[1]), x - e[0])

    def weighted(w, factor):
        mean = w @ x / w.sum()
        return mean, factor * ((x - mean).T @ ((x - mean) * w[:, None]) / w.sum()) + ridge

    def step(e):
        bucket = np.floor(np.log2(far(e) + 2.0**-20) * 16)
        half, left = (n + 5) // 2, (n + 5) // 2
        w = np.zeros(n)
        for b in np.unique(bucket):
            w[bucket == b] = min(1, left / (bucket == b).sum())
            left -= min(left, (bucket == b).sum())
        assert abs(w.sum() - half) < 1e-6
        return weighted(w, 1.0)

    for _ in range(2):
        starts = [step(e) for e in starts]
    best = min(starts, key=lambda e: round(np.linalg.slogdet(e[1])[1], 9))
    for _ in range(6):
        best = step(best)
    near = far((best[0], best[1] * Q.consistency(0.5))) <= Q.quantile(0.975, 4)
    return weighted(near.astype(float), Q.consistency(0.975))


def prose(rng, n):
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9))) for _ in range(n)]
    for i in range(9, n, 10):
        words[i] += "\n"
    return " ".join(words)


def mixed_corpus(seed=1):
    rng, rows = random.Random(seed), []
    for lang, source, n in (("en", "a", 400), ("en", "b", 20), ("de", "a", 70), ("de", "c", 60), (None, None, 150), ("fr", "x", 5)):
        for _ in range(n):
            text = prose(rng, rng.choice([5, 20, 25, 60, 200, 400]))
            kind = rng.random()
            if kind < 0.1:
                text = " ".join(w + rng.choice(["###", "$$$"]) for w in text.split(" "))
            elif kind < 0.2:
                text += "\n" + "\n".join(text.split("\n")[:2])
            elif kind < 0.25:
                text = "".join(w * 3 for w in text.split(" "))
            rows.append((len(rows), text, lang, source))
    rows += [(None, None, "en", "a"), (7, "", None, "a"), (7, rows[7][1], "en", "a")] + [(9000 + i, rows[3][1] + " " + prose(random.Random(3), 30), "en", "a") for i in range(600)]
    return rows


def test_counts():
    rng = random.Random(2)
    texts = ["", " \n\t\n", "a\n a\na\n\na", "## <a> | é漢😀 $", "a b c d e f g h " * 3, "x " * 30, "a\rb\va\fb \x1c \xa0 c", " a\n a\na", "q\n" * 5]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randint(1, 60))) for _ in range(200)]
    for t in texts:
        assert S.counts(t.encode()) == plain_counts(t), t


def test_counts_where_hashes_collide(monkeypatch):
    monkeypatch.setattr(S, "grams", lambda h, n: np.zeros(len(h) - n + 1, np.uint64))
    rng = random.Random(4)
    for _ in range(50):
        t = " ".join(rng.choice("abc") for _ in range(rng.randint(1, 60)))
        assert S.counts(t.encode()) == plain_counts(t)


def test_factors():
    assert abs(Q.quantile(0.5, 4) - 3.3567) < 1e-3 and abs(Q.quantile(0.975, 4) - 11.1433) < 1e-3
    x = np.random.default_rng(0).normal(size=(200_000, 4))
    d = (x * x).sum(1)
    assert abs(x[d <= np.median(d)].var() * Q.consistency(0.5) - 1) < 0.02


def test_verdicts_against_numpy(spark, table):
    rows = mixed_corpus()
    got = {}
    for r in Q.quality_rules(table(rows, SCHEMA)).collect():
        got.setdefault(r.doc_id, []).append((r.doc_id, *(r[c] for c in S.Counts._fields), r.base_failed, r.distance, r.kept))
    assert sum(map(len, got.values())) == len(rows)
    for want in plain_verdicts(rows):
        close = [g for g in got[want[0]] if g[:7] == want[:7] and g[8] == want[8] and (g[7] is None) == (want[7] is None) and (g[7] is None or math.isclose(g[7], want[7], rel_tol=1e-6, abs_tol=1e-9))]
        assert close, (want, got[want[0]])
        got[want[0]].remove(close[0])
    kept = {w[0]: w[8] for w in plain_verdicts(rows) if not w[6]}
    assert 0.03 < 1 - np.mean(list(kept.values())) < 0.3


def test_half_of_a_group_are_copies(table):
    rng = random.Random(5)
    clean = [(i, prose(rng, rng.randint(60, 140)), "en", "a") for i in range(150)]
    copies = [(1000 + i, "short words in it are so few but so it is to me as we go on or up to do no ill at all", "en", "a") for i in range(400)]
    bad = [(5000, "$$$ ### " * 3 + prose(rng, 40).replace(" ", "# "), "en", "a")]
    kept = {r.doc_id: r.kept for r in Q.quality_rules(table(clean + copies + bad, SCHEMA)).collect()}
    assert all(kept[i] for i in range(150)) and not kept[5000]


def test_few_rows_and_none(table, empty):
    rows = [(1, "one " * 5, "en", "a"), (2, " ".join(f"w{i}" for i in range(25)), "en", "a"), (3, None, None, None)]
    out = {r.doc_id: (r.base_failed, r.kept, r.distance) for r in Q.quality_rules(table(rows, SCHEMA)).collect()}
    assert out == {1: (True, False, None), 2: (False, True, None), 3: (True, False, None)}
    assert Q.quality_rules(table([], SCHEMA)).collect() == []


def test_very_long_text_is_judged_by_its_shares(table):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randint(40, 90)), "en", "a") for i in range(200)] + [(777, prose(rng, 400_000), "en", "a")]
    assert all(r.kept for r in Q.quality_rules(table(rows, SCHEMA)).collect())
