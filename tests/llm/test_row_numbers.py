"""Row numbers hold although every job scans the table in other partitions, as after a change of the core count."""

import pytest

from tesserae.llm import common, exact_dedup, near_dedup, sentencepiece_codec, substring_dedup

from .test_exact_dedup import brute as copies
from .test_near_dedup import brute as near
from .test_substring_dedup import brute as passages

NARROW, WIDE = {"openCostInBytes": "4194304", "minPartitionNum": "4"}, {"openCostInBytes": "0", "minPartitionNum": "1"}


@pytest.fixture
def replanned(spark, monkeypatch):
    """After every stored table, scans have one partition in place of three, or three in place of one."""
    plain, turn = common.stored, [NARROW, WIDE]

    def scans(plan):
        for k, v in plan.items():
            spark.conf.set(f"spark.sql.files.{k}", v)

    def stored(df, name):
        out = plain(df, name)
        turn.reverse()
        scans(turn[0])
        return out

    scans(NARROW)
    for module in (common, exact_dedup, near_dedup, substring_dedup):
        monkeypatch.setattr(module, "stored", stored)
    yield
    for k in NARROW:
        spark.conf.unset(f"spark.sql.files.{k}")


def test_exact_copies(table, corpus, replanned):
    rows = corpus(1)
    docs = table(rows)
    assert {r.doc_id: r.text for r in exact_dedup.without_copies(docs).collect()} == {i: t for i, t in rows if copies(rows)[i][0] == i}


def test_near_copies(table, corpus, replanned):
    rows = corpus(2, 60)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_groups(table(rows)).collect()}
    assert got == near(rows)
    assert {r.doc_id for r in near_dedup.one_of_each(table(rows)).collect()} == {i for i, (n, root) in near(rows).items() if i == root}


def test_passages(table, corpus, replanned):
    rows = corpus(1)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.repeated_passages(table(rows)).collect()}
    assert got == passages(rows)


def test_rows_without_files(spark):
    docs = spark.range(20).selectExpr("id AS doc_id", "CAST(id % 7 AS string) AS text").repartition(3)
    assert {r.text for r in exact_dedup.without_copies(docs.union(docs)).collect()} == set("0123456")


@pytest.fixture
def made(spark, table):
    """Tables whose rows are made of a file's rows: several to one, joined, and a file met twice."""
    rows = [(i, f"w{i} " * 30 if i % 2 else "alpha beta gamma delta epsilon zeta " * 5) for i in range(10)]
    docs = table(rows, "doc_id long, text string")
    two = docs.selectExpr("explode(array(struct(doc_id, text), struct(doc_id + 100 AS doc_id, 'one two three four five six seven eight ' || 'nine ten ' AS text))) AS r").select("r.*")
    pair = docs.join(spark.range(2).selectExpr("id AS k"), on=docs.doc_id >= 0).selectExpr("doc_id + 100 * k AS doc_id", "concat(text, k) AS text")
    return {"explode": two, "join": pair, "union": docs.union(docs.selectExpr("doc_id + 100", "concat(text, '!')"))}


@pytest.mark.parametrize("how", ["explode", "join", "union"])
def test_tables_made_from_files(made, how):
    docs = made[how]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert not common.bare_scan(docs) and len(rows) == 20
    numbers = [r.row_no for r in common.located(common.in_files(docs), "doc_id").collect()]
    assert len(set(numbers)) == 20
    assert {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in exact_dedup.exact_groups(docs).collect()} == copies(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_groups(docs).collect()} == near(rows)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.repeated_passages(docs).collect()} == passages(rows)
    assert {r.doc_id: r.text for r in exact_dedup.without_copies(docs).collect()} == {i: t for i, t in rows if copies(rows)[i][0] == i}
    sp = sentencepiece_codec.processor(sentencepiece_codec.default_model())
    assert {r.doc_id: r.n_tokens for r in sentencepiece_codec.digests(docs).collect()} == {i: len(sp.encode(t)) for i, t in rows}


def test_scans_stay_where_they_are(table):
    docs = table([(1, "a"), (2, "b")])
    assert common.bare_scan(docs) and common.bare_scan(docs.where("doc_id > 1").selectExpr("doc_id", "text AS t")) and common.in_files(docs) is docs
