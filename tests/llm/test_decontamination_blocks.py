from tesserae.llm import decontamination as C


def test_items_without_id_count_as_hits(spark, table):
    docs = table([(1, "x a b c y"), (2, "d e a b c"), (3, "none")])
    bench = spark.createDataFrame([(None, "a b c"), (7, "d e"), (None, None)], "item_id long, text string")
    for block in (C.BLOCK_BYTES, 2):
        got = {r.doc_id: (r.n_hit, r.n_items, r["items"], r.contaminated) for r in C.contamination(docs, bench, block_bytes=block).collect()}
        assert got == {1: (3, 0, [], True), 2: (5, 1, ["7"], True), 3: (0, 0, [], False)}
    assert [r.doc_id for r in C.clean_documents(docs, bench).collect()] == [3]


def test_a_stage_holds_one_block(spark, table):
    bench = spark.createDataFrame([(i, f"w{i} v{i}") for i in range(9)], "item_id long, text string")
    out = C.contamination(table([(1, "w3 v3 w5 v5")]), bench, block_bytes=15)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert out.first()["items"] == ["3", "5"]


def test_phrases_of_a_block_take_little_memory():
    import random
    import time
    import tracemalloc

    from tesserae.llm import decontamination as D

    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(50_000)]
    items = [(str(i), " ".join(rng.choices(words, k=120)).encode()) for i in range(9_000)]
    items += items[:500]  # repeated items share their windows
    assert sum(len(t) for _, t in items) > 7_900_000
    tracemalloc.start()
    phrases = D.Phrases(items)
    size, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert size < 150_000_000 and len(phrases.rows) == 9_000 * 111
    began = time.time()
    D.Phrases(items)
    assert time.time() - began < 5
    counts, spans, hit = phrases.hits([b"x y " + items[3][1][:140] + b" z", b"nothing of it"])
    assert len(spans[0]) == 1 and spans[0][0][0] == 2 and hit == [{3, 9003}, set()]
