import hashlib
import math
import random

from tesserae.llm import sentencepiece_codec as P
from tesserae.llm import token_counts as T
from tesserae.llm.word_table import marked_words

ODD = ["a", "b", " ", "  ", "▁", "\n", "\t", "é", "漢", "😀", "the", " of", "\x00", "ﬁ", "1", " " * 17, "x" * 30, ".", "<s>", "​", "\r\n", "\xa0", "<0x41>"]


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_codec_is_the_library(table, corpus):
    sp = P.processor(P.default_model())
    rows = corpus(3) + [(1000 + i, t) for i, t in enumerate(odd_texts(400))]
    for block, buckets in ((300, 5), (P.BLOCK, None)):
        check(sp, rows, P.encoded(table(rows), block=block, buckets=buckets).collect())


def check(sp, rows, out):
    got = {r.doc_id: r for r in out}
    assert len(got) == len(out) == len(rows)
    for i, t in rows:
        ids = sp.encode(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids == ",".join(map(str, ids))
        assert got[i].decoded == sp.decode(ids)


def test_blocks_without_answers_segment_their_words():
    """As when the second scan is cut in other places than the first."""
    import pyarrow as pa

    texts = [t for t in odd_texts(60, 4) if t]
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["row_no", "doc_id", "text"])
    model = P.default_model()
    words = [pa.Table.from_batches([b]) for part in (rows.slice(0, 3), rows.slice(3)) for b in P._distinct(200, 3)(iter([part]))]
    answers = list(P._segment(model)(b for t in words for b in t.to_batches()))
    held = list(P._texts(200)(iter([rows])))
    both = pa.concat_tables([pa.Table.from_batches([b]) for b in [*answers, *held]]).sort_by([("block", "ascending"), ("last", "ascending"), ("bucket", "ascending")])
    assert {tuple(x) for b in held for x in zip(b["block"].to_pylist(), b["last"].to_pylist(), strict=True)} - {tuple(x) for b in answers for x in zip(b["block"].to_pylist(), b["last"].to_pylist(), strict=True)}
    out = [r for b in P._join(model, 3, False)(iter(both.to_batches(max_chunksize=7))) for r in b.to_pylist()]
    assert sorted((r["doc_id"], r["ids"]) for r in out) == [(i, ",".join(map(str, P.processor(model).encode(t)))) for i, t in enumerate(texts)]


def test_a_block_cuts_each_text_once(monkeypatch):
    import pyarrow as pa

    texts, cut = [t for t in odd_texts(80, 6) if t] + ["a\x00b ﬁ", "plain words"], []
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["row_no", "doc_id", "text"])
    model = P.default_model()
    answers = [r for t in P._distinct(10**6, 3)(iter([rows])) for r in P._segment(model)(iter([t]))]
    both = pa.Table.from_batches([*P._texts(10**6)(iter([rows])), *answers]).sort_by([("block", "ascending"), ("bucket", "ascending")])
    monkeypatch.setattr(P, "marked_words", lambda t: cut.append(t) or marked_words(t))
    out = [r for b in P._join(model, 3, False)(iter(both.to_batches())) for r in b.to_pylist()]
    sp = P.processor(model)
    assert len(cut) == len(texts)  # twice as many before
    assert [(r["n_tokens"], r["decoded"]) for r in out] == [(len(sp.encode(t)), sp.decode(sp.encode(t))) for t in texts]


def test_odd_decoded_words():
    import numpy as np
    import pyarrow as pa

    texts = ["a b", "c", "b b a", ""]
    block = P._Block(pa.table({"row_no": range(4), "doc_id": range(4), "text": texts}), 1)
    assert block.waiting == {0: ["▁a", "▁b", "▁c"]}
    block.learn(0, np.array([7, 8, 9, 70_000], np.uint32), np.array([1, 2, 1], np.uint32), {1: "B!"})
    out = [tuple(r[c] for c in ("n_tokens", "ids", "decoded")) for b in block.encoded(False) for r in b.to_pylist()]
    assert out == [(3, "7,8,9", "a B!"), (1, "70000", "c"), (5, "8,9,8,9,7", "B! B! a"), (0, "", "")]


def test_repeated_ids_stay_apart(table):
    rows = [(1, "a b"), (1, "a b"), (None, "a"), (None, None)]
    assert sorted((r.doc_id or 0, r.n_tokens, r.decoded) for r in P.encoded(table(rows)).collect()) == [(0, 0, ""), (0, 1, "a"), (1, 2, "a b"), (1, 2, "a b")]


def test_digests(table):
    r = P.digests(table([(1, "hello world")])).first()
    ids = P.processor(P.default_model()).encode("hello world")
    assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert r.decoded_sha256 == hashlib.sha256(b"hello world").hexdigest()


def test_empty_tables(empty):
    assert P.encoded(empty).count() == 0
    assert T.token_counts(empty).count() == 0


def best_count(word, scores, longest, unknown):
    """Plain dynamic programming over one word."""
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        top = (-math.inf, 0)
        for start in range(max(0, end - longest), end):
            s = scores.get(word[start:end])
            if s is not None and best[start][0] + s > top[0]:
                top = (best[start][0] + s, best[start][1] + 1)
        best.append(top if top[0] > -math.inf else (best[-1][0] + unknown, best[-1][1] + len(word[end - 1].encode())))
    return best[-1][1]


def test_token_counts(table, corpus):
    model = T.piece_scores(P.default_model())
    rows = corpus(4) + [(1000 + i, t) for i, t in enumerate(odd_texts(100, 2))]
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in T.token_counts(table(rows), frequent=10).collect()}
    for i, t in rows:
        w = marked_words(t or "")
        assert got[i] == (len(w), sum(best_count(x, *model) for x in w))


def test_trie_works_out_each_prefix_once():
    scores, longest, unknown = T.piece_scores(T.default_model())
    rng = random.Random(8)
    words = ["▁" + "".join(rng.choice("abé") for _ in range(rng.randint(0, 9))) for _ in range(300)]
    trie, small = T.Trie(scores, longest, unknown), T.Trie(scores, longest, unknown, most=40)
    want = [best_count(w, scores, longest, unknown) for w in words]
    assert trie.counts(words) == small.counts(words) == want
    assert len(trie.best) == 1 + len({w[:i] for w in words for i in range(1, len(w) + 1)})
    assert len(small.best) <= 40


def test_only_pieces_that_can_end_a_prefix_are_looked_up():
    looked = []

    class Scores(dict):
        def get(self, key, default=None):
            looked.append(key)
            return super().get(key, default)

    rng = random.Random(4)
    scores = Scores({"".join(rng.choice("abc") for _ in range(rng.randint(2, 9))): -rng.random() * 9 for _ in range(60)} | {"a": -8.0, "b": -9.0})
    words = sorted({"".join(rng.choice("abcé") for _ in range(rng.randint(1, 24))) for _ in range(300)})
    trie = T.Trie(scores, max(map(len, scores)), -20.0)

    def plain(word):
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            top = max(((best[i][0] + scores[word[i:end]], i - end, best[i][1] + 1) for i in range(end) if word[i:end] in scores), key=lambda e: (e[0], -e[1]), default=None)
            best.append((top[0], top[2]) if top else (best[-1][0] - 20.0, best[-1][1] + len(word[end - 1].encode())))
        return best[-1][1]

    assert trie.counts(words) == [plain(w) for w in words]
    assert len(looked) < 3 * len(trie.best)  # up to the longest piece's length for each node before


def test_words_enter_the_trie_level_by_level():
    class Scores(dict):
        def get(self, key, default=None):
            raise AssertionError("a piece was looked up for one node")  # as before, some 2 for each node

    scores, longest, unknown = T.piece_scores(T.default_model())
    rng = random.Random(9)
    words = ["▁" + "".join(rng.choice(["the", "ing", "é", "漢", "😀", "\x00", "a", "ti", "on", "1"]) for _ in range(rng.randint(0, 16))) for _ in range(400)]
    words += ["", "\x00", "a", "a\x00", "a\x00\x00", "b"]
    assert max(map(len, words)) <= T.DEEP
    assert T.Trie(Scores(scores), longest, unknown).counts(words) == [best_count(w, scores, longest, unknown) for w in words]


def test_words_deeper_than_the_levels():
    scores, longest, unknown = T.piece_scores(T.default_model())
    rng = random.Random(10)
    words = ["▁" * rng.randint(0, 3) + "".join(rng.choice(["the", "ing", "é", "😀", "\x00"]) * 3 for _ in range(n)) for n in range(40)]
    words += ["x" * n for n in (T.DEEP - 1, T.DEEP, T.DEEP + 1, 2000)] + ["x" * 100 + y for y in "abc"]
    assert T.Trie(scores, longest, unknown).counts(words) == [best_count(w, scores, longest, unknown) for w in words]
    pieces = {"ab": -1.0, "a": -0.5, "b": -0.5, "\x00": -2.0}  # equal scores: the longest last piece
    for n in (1, 40):
        assert T.Trie(pieces, 2, -9.0).counts(["ab" * n, "\x00" * n, "c" * n]) == [n, n, n]
