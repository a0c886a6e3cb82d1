import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from tesserae.llm import periodic_runs as P


def plain(t):
    """Every period's stretches of equal pairs, and no smaller period."""
    t, n, out = np.asarray(t), len(t), []
    for q in range(1, n // 4 + 1):
        same = np.concatenate([[0], (t[:-q] == t[q:]).astype(int), [0]])
        turns = np.flatnonzero(np.diff(same))
        for s, e in turns.reshape(-1, 2).tolist():
            length = e - s + q
            part = t[s : s + length]
            if length >= max(6, 4 * q) and not any((part[:-p] == part[p:]).all() for p in range(1, q)):
                out.append((s, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def repeated(rng, letters, size):
    out = []
    while len(out) < size:
        if rng.random() < 0.5:
            out += [rng.randrange(letters) for _ in range(rng.randint(1, 12))]
        else:
            root = [rng.randrange(letters) for _ in range(rng.choice([1, 2, 3, 5, 7, 8, 9, 16, 31]))]
            out += (root * 9)[: rng.randint(1, 9 * len(root))]
    return out[:size]


@pytest.mark.parametrize("letters", [1, 2, 3, 50])
@pytest.mark.parametrize("kept", [2, 8, 64])
def test_runs_are_those_of_every_period(letters, kept, monkeypatch):
    monkeypatch.setattr(P, "LETTERS", kept)
    rng = random.Random(letters)
    texts = [repeated(rng, letters, rng.randint(0, 300)) for _ in range(150)]
    texts += [([0] * a + [1]) * 7 for a in (1, 3, 7, 14, 15, 16, 17, 40)]
    texts += [([0] * a + [1] + [0] * b + [1]) * 5 for a, b in ((3, 4), (15, 17), (31, 2))]
    texts += [[0, 0, 1, 0, 0, 1, 0] * 9, [0, 1] * 40 + [0, 1, 1] * 30]
    got = P.runs_together([[b"%d" % w for w in t] for t in texts])
    assert got == [plain(t) for t in texts]


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def test_long_and_odd_words_of_any_length():
    rng = random.Random(7)
    texts = [fibonacci(3000), [bin(i).count("1") % 2 for i in range(3000)], [0] * 3000, repeated(rng, 2, 4000)]
    texts.append([rng.randrange(1000) for _ in range(500)] + [rng.randrange(1000) for _ in range(700)] * 5)
    assert P.runs_together([[b"%d" % w for w in t] for t in texts]) == [plain(t) for t in texts]


@pytest.mark.parametrize("text", [[b"a"] * 400_000, ([b"a"] * 1000 + [b"b"]) * 300, [b"%d" % (i % 90_001) for i in range(400_000)], [b"a", b"b"] * 200_000])
def test_very_long_texts_in_bounded_time(text):
    began = time.time()
    (found,) = P.runs_together([text])
    assert found and max(n for _, n, _ in found) >= 300_000 and time.time() - began < 60


def wanted(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
    runs = plain([numbers[w] for w in words])
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    lines = digest("".join("%d,%d,%d\n" % r for r in runs).encode())
    kept = digest(b" ".join(w for i, w in enumerate(words) if i not in drop))
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], lines, kept)


def test_query_against_every_period(spark, table, corpus):
    rows = [(i * 7, t) for i, t in corpus(5, n=300)] + [(None, "a a a a a a b"), (None, None), (3, "x " * 50), (3, "x " * 50), (50, "b c\v\fb c\x1cb c b c b c")]
    docs = table(rows, "doc_id long, text string, runs string, row string, collapsed string, start int")
    got = [tuple(r) for r in P.digests(P.periodic_runs(docs, P.planted("text", "doc_id"))).collect()]
    assert sum(r[1] for r in got) > 10 and any(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 10 == 0 and r[1] for r in got)
    assert sorted(map(str, got)) == sorted(str(wanted(*r)) for r in rows)


def test_operator_keeps_what_it_is_given(table, empty):
    out = P.periodic_runs(table([(1, "one two one two one two one two end"), (2, None)]), "text", "doc_id", "kept", "size").collect()
    assert out[0].asDict()["runs"][0].asDict() == {"start": 0, "length": 8, "period": 2} if out[0].doc_id == 1 else True
    assert {(r.doc_id, r.collapsed) for r in out} == {(1, "one two end"), (2, "")}
    assert P.digests(P.periodic_runs(empty)).collect() == []
