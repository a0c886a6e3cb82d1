import itertools

import numpy as np
import pytest

from tesserae.llm import quality as Q
from tesserae.llm import toxicity as T


def test_toxicity_gradient():
    rng = np.random.default_rng(0)
    q = T.fresh(rng, np.float64)
    x, mask, y = rng.normal(size=(7, 5, T.INPUTS)), np.ones((7, 5, 1)), np.array([0, 1, 1, 0, 1.0])
    mask[4:, 2] = 0
    _, g, d_x = T.gradient(q, x, mask, y, 3)
    q["x"], g["x"] = x, d_x
    for k, v in q.items():
        i = tuple(rng.integers(0, s) for s in v.shape)
        old, e = v[i], 1e-5
        v[i] = old + e
        up = T.gradient(q, x, mask, y, 3)[0]
        v[i] = old - e
        down = T.gradient(q, x, mask, y, 3)[0]
        v[i] = old
        assert (up - down) / (2 * e) == pytest.approx(g[k][i], abs=1e-6)


def random_model(seed=3):
    rng = np.random.default_rng(seed)
    odds = {k: rng.normal(size=n).astype(np.float32) for k, n in (("w", T.WORDS), ("g", T.GRAMS))}
    by = {"w": rng.normal(size=(T.WORDS, T.WORD_SIZE)).astype(np.float32), "g": rng.normal(size=(T.GRAMS, T.GRAM_SIZE)).astype(np.float32)}
    return T.Model(odds, by, T.fresh(rng), 0.1)


def test_inputs_of_a_vocabulary_are_those_of_its_words():
    m, words = random_model(), [b"a", b"toxic", "größe".encode(), b"x" * 60]
    v = T.Vocabulary(words, 0.1)
    v.by = m.by
    want = np.array([T.word_input(w, m) for w in words])
    assert np.hstack([v.counted(m.odds), v.learned(np.arange(4))]) == pytest.approx(want, abs=1e-5)
    assert T.inputs_of(words, m) == pytest.approx(want, abs=1e-5)


def plain_score(text, m):
    """The network's score worked out word by word, window by window, as its definition reads."""
    words, q = T.words_of(text), {k: v.astype(float) for k, v in m.q.items()}
    sig = lambda x: 1 / (1 + np.exp(-x))
    h = T.HIDDEN

    def read(xs, way):
        state, out = np.zeros(h), []
        for x in xs:
            p, r = x @ q["W" + way] + q["b" + way], state @ q["U" + way]
            z, reset = sig(p[:h] + r[:h]), sig(p[h : 2 * h] + r[h : 2 * h])
            state = z * state + (1 - z) * np.tanh(p[2 * h :] + reset * r[2 * h :])
            out.append(state)
        return out

    logits = []
    for first in range(0, max(1, len(words) - (T.WINDOW - T.STRIDE)), T.STRIDE):
        xs = [T.word_input(w, m).astype(float) for w in words[first : first + T.WINDOW]]
        states = [np.concatenate(s) for s in zip(read(xs, "f"), read(xs[::-1], "b")[::-1], strict=True)]
        weights = [np.exp(np.tanh(s @ q["A"] + q["ab"]) @ q["v"]) for s in states]
        pooled = sum(w * s for w, s in zip(weights, states, strict=True)) / sum(weights) if states else np.zeros(2 * h)
        logits.append(pooled @ q["w"] + q["c"][0])
    return sig(max(logits))


def test_scores_are_those_of_the_definition():
    m, rng = random_model(), np.random.default_rng(8)
    texts = [" ".join(rng.choice(["idiot", "a", "day", "größe", "漢字"], n)).encode() for n in (0, 1, 31, 33, 57, 200)]
    texts.append(("語" * 90).encode())
    assert T.Scorer(m).scores(texts) == pytest.approx([plain_score(t, m) for t in texts], abs=1e-4)


def test_windows_overlap_and_cover():
    for n in (0, 1, 31, 32, 33, 56, 57, 500):
        windows, owner, first = T.cut([np.arange(1, n + 1)])
        seen = set(windows[windows > 0].tolist())
        assert seen == set(range(1, n + 1)) and (owner == 0).all()
        assert all(b - a == T.STRIDE < T.WINDOW for a, b in itertools.pairwise(first.tolist()))


def test_chain_marginals_by_enumeration():
    rng = np.random.default_rng(1)
    unary, change = rng.normal(size=(4, 1)), rng.normal(size=(2, 2))
    whole, one, pairs = Q.marginals(unary, np.ones((4, 1), bool), change)
    weight = {s: np.exp(sum(unary[t, 0] * s[t] for t in range(4)) + sum(change[a, b] for a, b in itertools.pairwise(s))) for s in itertools.product((0, 1), repeat=4)}
    z = sum(weight.values())
    assert whole[0] == pytest.approx(np.log(z))
    for t in range(4):
        assert one[t, 0] == pytest.approx(sum(w for s, w in weight.items() if s[t]) / z)
    for a, b in itertools.product((0, 1), repeat=2):
        assert pairs[a, b] == pytest.approx(sum(w * sum((x, y) == (a, b) for x, y in itertools.pairwise(s)) for s, w in weight.items()) / z)


def plain_marginals(unary, change):
    """Forward-backward over one chain, line by line."""
    lse = lambda x: np.log(np.exp(x - x.max()).sum()) + x.max()
    n, node = len(unary), np.stack([np.zeros(len(unary)), unary], 1)
    a, b = np.zeros((n, 2)), np.zeros((n, 2))
    for t in range(1, n):
        a[t] = [lse(a[t - 1] + node[t - 1] + change[:, j]) for j in (0, 1)]
        b[n - 1 - t] = [lse(change[i] + node[n - t] + b[n - t]) for i in (0, 1)]
    both = a + node + b
    return np.exp(both[:, 1] - [lse(x) for x in both])


def test_pieces_carry_the_messages(monkeypatch):
    monkeypatch.setattr(Q, "CELLS", 40)
    rng = np.random.default_rng(2)
    unary, change = [rng.normal(size=n) * 3 for n in (1, 5, 8, 9, 16, 3, 61, 8, 1)], rng.normal(size=(2, 2)) * 2
    for piece in (1, 2, 8, 100):
        for u, p in zip(unary, Q.line_marginals(unary, change, piece), strict=True):
            assert p == pytest.approx(plain_marginals(u, change))


def test_quality_is_that_of_the_definition():
    rng = np.random.default_rng(4)
    m = Q.Model(rng.normal(size=Q.SIZE), rng.normal(size=(2, 2)), np.array([2.0, -1.0]), 0.5)
    texts = [b"", b"one line", b"\n\n", "größe | x\nWHAT!?\n$$$ ** 12\nWHAT!?".encode(), b"\n".join(b"%d is." % (i % 40) for i in range(700))]
    want = []
    for t in texts:
        lines = t.split(b"\n")
        rows = np.vstack([Q.line_features(lines, Q.Counter(lines), i, i + 1) for i in range(len(lines))])
        n = np.array([len(x) + 1 for x in lines])
        want.append(1 / (1 + np.exp(1 - 2 * (plain_marginals(rows @ m.w, m.change) * n).sum() / n.sum())))
    assert m.scores(texts) == pytest.approx(want)


def test_a_million_lines_take_bounded_time_and_memory():
    import resource
    import time

    m = Q.Model(np.zeros(Q.SIZE), np.zeros((2, 2)), np.array([1.0, 0.0]), 0.5)
    m.scores([b"a\n" * 1000])
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.process_time()
    m.scores([b"short"] * 255 + [b"\n" * 1_000_000])
    assert time.process_time() - began < 30 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000


def test_training_lines_are_bounded():
    texts = [b"\n" * 5000, b"a\nb", b"x\n" * 900]
    rows, owner = Q.training_pieces(texts, most=1000)
    assert sum(map(len, rows)) <= 1000 + 3 * Q.PIECE and set(owner) == {0, 1, 2}
    rows, owner = Q.training_pieces(texts)
    assert sum(map(len, rows)) == 5001 + 2 + 901


@pytest.mark.parametrize(("module", "label", "least"), [(T, "toxic", 0.9), (Q, "quality", 0.95)])
def test_held_out_accuracy(spark, module, label, least):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    out = module.query(spark, d).join(labels, "doc_id").where("held_out").collect()
    assert len(out) > 50
    assert np.mean([r.predicted == r[label] for r in out]) >= least
    assert all(0 <= r.score <= 1 for r in out)


@pytest.mark.parametrize(("run", "label"), [(T.toxicity, "toxic"), (Q.quality, "quality")])
def test_edges_of_the_input(spark, table, empty, run, label):
    kind = "doc_id long, quality int, toxic int"
    rows = [(i, "you are trash scum idiot\n" if i % 3 == 0 else "a fine day to walk\n") for i in range(30)] + [(None, "x"), (40, None), (40, ""), (41, "word " * 30_000), (42, "\n" * 500)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 3 == 0)) for i in range(30)] + [(None, 1, 1), (40, None, None), (3, 0, 1)], kind)
    out = run(table(rows), labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in out)
    assert run(empty, labels).count() == 0
    none = run(table(rows), labels.limit(0)).collect()
    assert len({r.score for r in none}) == 1


def test_toxic_recall_on_held_out_rows(spark):
    """Of 144 toxic held-out rows six have none of the words that make others toxic."""
    d = "/root/testdata/sf0.1"
    out = T.query(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    toxic = [r.predicted for r in out if r.toxic]
    assert np.mean(toxic) >= 0.85 and np.mean([r.predicted for r in out if not r.toxic]) <= 0.015


def test_filter_takes_columns_of_any_name(spark, table):
    docs = table([(1, "fine"), (2, None)]).selectExpr("doc_id", "text", "1 AS `my col`", "named_struct('a b', 2) AS `x.y`", "'q' AS score", "0 AS row")
    out = T.without_toxic(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert out.columns == docs.columns and sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)


def test_filter_keeps_columns(spark, table):
    docs = table([(1, "fine"), (2, None)])
    out = T.without_toxic(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert out.columns == docs.columns and out.count() == 2
