import hashlib
import random

from pyspark.sql import functions as F

from tesserae.llm import exact_dedup as X


def brute(rows):
    norm = lambda t: (t or "").translate({ord(c): None for c in " \t\n\x0b\x0c\r"})
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i))
    return {i: (min(groups[norm(t)])[1], len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows}


def test_fingerprints_compose():
    rng = random.Random(1)
    for _ in range(200):
        a, b = (bytes(rng.choices(b"abc\xff\x00", k=rng.randint(0, 40))) for _ in range(2))
        whole = X.fingerprint(a + b)
        assert X.combine(X.fingerprint(a), X.fingerprint(b)) == whole
        assert X.fingerprint(a + b, chunk=7) == whole


def test_against_brute_force(table, corpus):
    for seed, chunk in ((1, X.CHUNK), (2, 16)):
        rows = corpus(seed)
        got = {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in X.exact_groups(table(rows), chunk=chunk, salts=3).collect()}
        assert got == brute(rows)


def test_ties_repeats_and_nulls(table):
    rows = [(5, "a b"), (5, "a b"), (3, "ab "), (None, "ab  x"), (None, "abx"), (2, "ab")]
    got = X.exact_groups(table(rows)).collect()
    assert len(got) == 6
    kept = sorted((r.doc_id is None, r.doc_id or 0, r.keep_id) for r in got if r.kept)
    assert kept == [(False, 3, 3), (True, 0, None)]
    assert {r.group_size for r in got if r.keep_id == 3} == {4}


def test_equal_fingerprints_of_different_texts_are_told_apart(spark, table):
    docs = table([(i, t) for i, t in enumerate(["aa", "ab", "aa", "ba", "ab", "aa"])])
    prints = X.fingerprints(docs).withColumns({"h1": F.lit(1).cast("long"), "h2": F.lit(1).cast("long")})
    parts = X.text_classes(docs, prints, salts=2)
    named = prints.join(parts, "row_no", "left").fillna({"part": 0}).groupBy("part").agg(F.countDistinct("text_sha256").alias("n")).collect()
    assert len(named) == 3 and all(r.n == 1 for r in named)


def test_empty_table_and_columns(table, empty):
    assert X.exact_groups(empty).count() == 0
    docs = table([(1, "x y"), (2, "xy"), (3, None)])
    out = X.without_copies(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 3]
