import random

import numpy as np

from tesserae.llm import decontamination as C

from .conftest import WORDS


def words(t):
    return C.words_of((t or "").encode())


def brute(rows, items, k=10):
    out = {}
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            p = words(text)
            for s in range(max(1, len(p) - k + 1) if p else 0):
                g = p[s : s + k]
                for j in range(len(w) - len(g) + 1):
                    if w[j : j + len(g)] == g:
                        hit.update(range(j, j + len(g)))
                        found.add(str(item))
        out[i] = (len(w), len(hit), sorted(found))
    return out


def data(corpus, seed):
    rng = random.Random(seed)
    rows = corpus(seed, 30)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.choice([0, 2, 4, 10, 14])))) for i in range(25)]
    items += [(100, None), (101, "..."), (7, "alpha, BETA gamma"), (102, rows[3][1])]
    rows += [(200 + i, f"start {t} -- {t} end") for i, (_, t) in enumerate(items[:12])]
    return rows, items


def test_words_by_the_definition():
    import re

    rng = random.Random(2)
    for _ in range(300):
        t = "".join(rng.choice("aZ0 é_漢-\x7f\x1c\xa0'9\n") for _ in range(20))
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        assert [w.decode() for w in words(t)] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_index_against_plain_search():
    rng = np.random.default_rng(3)
    s = rng.integers(1, 5, 500)
    index = C.FMIndex(s, 5, sample=4)
    patterns = np.array([[0, *p] if len(p) == 2 else p for p in [s[a : a + n].tolist() for a, n in ((3, 3), (50, 3), (498, 2), (10, 3))]] + [[4, 4, 4]])
    lengths = np.array([3, 3, 2, 3, 3])
    low, high = index.search(patterns, lengths)
    for row, n, a, b in zip(patterns, lengths, low, high, strict=True):
        p = row[3 - n :].tolist()
        want = [i for i in range(len(s) - n + 1) if s[i : i + n].tolist() == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_against_brute_force(spark, table, corpus):
    for seed, block in ((1, C.BLOCK_BYTES), (2, 300)):
        rows, items = data(corpus, seed)
        bench = spark.createDataFrame(items, "item_id long, text string")
        got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in C.contamination(table(rows), bench, block_bytes=block).collect()}
        assert got == brute(rows, items)


def test_shards_of_a_batch():
    texts = [f"x y{i} one two three four z" .encode() for i in range(20)]
    p = C.Phrases([("1", b"one two three four"), ("2", b"three four z")])
    assert p.hits(texts, shard_words=3)[1:] == p.hits(texts)[1:]


def test_empty_tables_and_columns(spark, table, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = table([(1, "a b c"), (2, None)])
    assert C.contamination(empty, none).count() == 0
    assert [r.contaminated for r in C.contamination(docs, none).collect()] == [False, False]
    out = C.clean_documents(docs, spark.createDataFrame([(1, "B c")], "item_id long, text string"))
    assert out.columns == docs.columns and [r.doc_id for r in out.collect()] == [2]
