import corpus_pipeline as P

from tesserae.llm import toxicity
from tesserae.llm.common import stored

from .test_decontamination import brute as hits
from .test_exact_dedup import brute as copies
from .test_near_dedup import brute as near

DATA = "/root/testdata/sf0.001"


def test_every_stage_does_what_it_says(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    toxic = {r.doc_id for r in toxicity.query(spark, DATA).where("predicted = 1").collect()}
    for k, (name, stage) in enumerate(P.STAGES):
        before = [(r.doc_id, r.text) for r in docs.collect()]
        after = stored(stage(spark, docs, DATA), name)
        left = {r.doc_id for r in after.collect()}
        ids = {i for i, _ in before}
        if name == "toxicity":
            assert left == ids - toxic
        elif name == "exact_dedup":
            assert left == {i for i, (keep, *_) in copies(before).items() if i == keep}
        elif name == "near_dedup":
            assert left == {i for i, (_, root) in near(before).items() if i == root}
        elif name == "decontamination":
            bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
            assert left == {i for i, (_, n, _) in hits(before, bench).items() if not n}
        else:
            assert left == ids
        if k + 1 < len(P.STAGES):
            assert after.columns == columns
        docs = after
    whole = P.run(spark, DATA)
    assert {r.doc_id for r in whole.collect()} == left
    assert P.ORACLE_SQL is None
