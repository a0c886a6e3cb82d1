"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's features are its own and those of its two
neighbours; a chain over the lines adds transitions. The field is trained in numpy
on a labelled sample: lines start with their document's label, and after a first
fit the clearly good lines of bad documents change sides. A document's quality is
the mean of its lines' forward-backward marginals, weighted by their lengths, put
through a logistic curve fitted to the documents' labels.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import SAMPLE, held_out, logistic, sample

UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGIT = b"0123456789"
SYMBOL = b"#$%&*@^~|<>=+{}[]_/\\`"
CALLS = b"!?"
HIGH = bytes(range(128, 256))
OWN = 13
#: Own features that a line's neighbours show as well.
SHOWN = (2, 4, 5, 6, 7, 9)
SIZE = OWN + 2 * len(SHOWN) + 2
#: Lines of a piece of a chain, cells (lines of all pieces) of a group of pieces, lines of the texts scored at once.
PIECE = 256
CELLS = 1 << 17
GROUP = 1 << 17
#: Most lines of the sample that the field is trained on.
LINES = 300_000
GOOD = 0.5


def line_features(lines: list[bytes], copies: Counter, first: int = 0, end: int | None = None) -> np.ndarray:
    """Features (lines, SIZE) of the lines [first, end) of a text; ``copies`` counts all its lines."""
    end = len(lines) if end is None else end
    low, high = max(0, first - 1), min(len(lines), end + 1)
    own = np.zeros((high - low, OWN))
    for i, line in enumerate(lines[low:high]):
        n = len(line)
        w = line.split()
        own[i, 0] = 1
        own[i, 1] = log(1 + n) / 6
        if not w:
            own[i, 12] = 1
            continue
        for k, kind in ((2, UPPER), (3, DIGIT), (4, SYMBOL), (5, CALLS), (10, HIGH)):
            own[i, k] = (n - len(line.translate(None, kind))) / n
        own[i, 6] = min(1.0, line.count(b"|") * 4 / n)
        own[i, 7] = 1 - log(1 + len(set(w))) / log(1 + len(w))
        own[i, 8] = n / len(w) / 10
        own[i, 9] = copies[line] > 1
        own[i, 11] = line.rstrip()[-1:] in b".!?\"'"
    edge = np.zeros((1, len(SHOWN)))
    shown = np.vstack([*([edge] if first == 0 else []), own[:, SHOWN], *([edge] if end == len(lines) else [])])
    ends = np.zeros((end - first, 2))
    ends[0, 0], ends[-1, 1] = first == 0, end == len(lines)
    return np.hstack([own[first - low : end - low], shown[:-2], shown[2:], ends])


def lengths_of(lines: list[bytes]) -> np.ndarray:
    return np.fromiter(map(len, lines), float, len(lines)) + 1


def scores_of_lines(text: bytes, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every line its score for "good" and its length; features are held for ``PIECE`` lines at once."""
    lines = text.split(b"\n")
    copies = Counter(lines)
    parts = [line_features(lines, copies, i, min(i + PIECE, len(lines))) @ w for i in range(0, len(lines), PIECE)]
    return np.concatenate(parts), lengths_of(lines)


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    most = max(map(len, rows))
    x = np.zeros((most, len(rows), *rows[0].shape[1:]))
    mask = np.zeros((most, len(rows)), bool)
    for i, r in enumerate(rows):
        x[: len(r), i], mask[: len(r), i] = r, True
    return x, mask


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def marginals(unary: np.ndarray, mask: np.ndarray, change: np.ndarray):
    """Of chains (time, chains) with score ``unary`` for state 1 and transitions ``change``: log-partition,
    marginals of state 1, summed pair marginals."""
    steps, n = unary.shape
    node = np.stack([np.zeros_like(unary), unary], 2)
    alpha = np.empty((steps, n, 2))
    alpha[0] = node[0]
    for t in range(1, steps):
        step = _lse(alpha[t - 1][:, :, None] + change, 1) + node[t]
        alpha[t] = np.where(mask[t][:, None], step, alpha[t - 1])
    beta = np.zeros((steps, n, 2))
    for t in range(steps - 2, -1, -1):
        step = _lse(change[None] + (node[t + 1] + beta[t + 1])[:, None, :], 2)
        beta[t] = np.where(mask[t + 1][:, None], step, 0)
    whole = _lse(alpha[-1], 1)
    one = np.exp(np.clip(alpha[:, :, 1] + beta[:, :, 1] - whole, -60, 0)) * mask
    pairs = np.zeros((2, 2))
    for t in range(1, steps):
        p = alpha[t - 1][:, :, None] + change + (node[t] + beta[t])[:, None, :] - whole[:, None, None]
        pairs += np.exp(np.clip(p[mask[t]], -60, 0)).sum(axis=0)
    return whole, one, pairs


def fit(rows: list[np.ndarray], states: list[np.ndarray], start=None, epochs: int = 30, penalty: float = 1e-3, seed: int = 3):
    """Weights and transitions that maximise the conditional likelihood, by Adam over batches of chains."""
    w, change = (start[0].copy(), start[1].copy()) if start else (np.zeros(SIZE), np.zeros((2, 2)))
    rng = np.random.default_rng(seed)
    order = sorted(range(len(rows)), key=lambda i: len(rows[i]))
    batches = [order[i : i + 64] for i in range(0, len(order), 64)]
    held = [(*_padded([rows[i] for i in b]), _padded([states[i] for i in b])[0]) for b in batches]
    theta = np.concatenate([w, change.ravel()])
    m, v, n = np.zeros_like(theta), np.zeros_like(theta), 0
    for epoch in range(epochs):
        for b in rng.permutation(len(held)):
            x, mask, y = held[b]
            _, one, pairs = marginals(x @ theta[:SIZE], mask, theta[SIZE:].reshape(2, 2))
            seen = np.zeros((2, 2))
            both = mask[1:]
            for i in (0, 1):
                for j in (0, 1):
                    seen[i, j] = ((y[:-1] == i) & (y[1:] == j) & both).sum()
            g = np.concatenate([np.einsum("tn,tnf->f", (one - y) * mask, x), (pairs - seen).ravel()]) / mask.sum() + penalty * theta
            n += 1
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            theta -= (0.1 if epoch < epochs * 2 // 3 else 0.02) * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.99**n)) + 1e-8)
    return theta[:SIZE], theta[SIZE:].reshape(2, 2)


def _pass(node: np.ndarray, last: np.ndarray, change: np.ndarray, start: np.ndarray, back: bool) -> np.ndarray:
    """Messages into each line of the pieces (time, pieces, states), given those into their first line (their last one, if ``back``)."""
    out = np.empty_like(node)
    m = start
    for t in range(len(node) - 1, -1, -1) if back else range(len(node)):
        if back:
            m = np.where((t == last)[:, None], start, m)
        out[t] = m
        m = _lse(change[None] + (node[t] + m)[:, None, :], 2) if back else _lse((m + node[t])[:, :, None] + change, 1)
    return out


def line_marginals(unary: list[np.ndarray], change: np.ndarray, piece: int = PIECE) -> list[np.ndarray]:
    """Marginals of "good" for the lines of chains with the given scores, by forward-backward over pieces of chains.

    A piece maps what enters it to what leaves it, a 2 x 2 matrix; the matrices of a chain's pieces carry
    the messages to all its pieces, which are then worked on side by side. What is held grows with the
    lines, never with the longest chain times the number of chains.
    """
    of = [(c, i) for c, u in enumerate(unary) for i in range(0, len(u), piece)]
    size = np.array([min(piece, len(unary[c]) - i) for c, i in of], np.int64)
    groups: list[list[int]] = []
    for k in np.argsort(size, kind="stable").tolist():
        if not groups or (len(groups[-1]) + 1) * size[k] > CELLS:
            groups.append([])
        groups[-1].append(k)

    def nodes(group: list[int]) -> np.ndarray:
        node = np.zeros((size[group].max(), len(group), 2))
        for j, k in enumerate(group):
            c, i = of[k]
            node[: size[k], j, 1] = unary[c][i : i + piece]
        return node

    enter = np.zeros((len(of), 2))  # into the first line of each piece
    leave = np.zeros((len(of), 2))  # into its last line, from those behind it
    if any(i for _, i in of):
        through, closed = np.zeros((len(of), 2, 2)), np.zeros((len(of), 2))
        for group in groups:
            node, last, each = nodes(group), size[group] - 1, np.arange(len(group))
            for s in (0, 1):
                start = np.full((len(group), 2), -1e30)
                start[:, s] = 0
                at = _pass(node, last, change, start, False)[last, each] + node[last, each]
                through[group, s], closed[group, s] = _lse(at[:, :, None] + change, 1), _lse(at, 1)
        for k in range(1, len(of)):
            if of[k][1]:
                enter[k] = _lse(enter[k - 1][:, None] + through[k - 1], 0)
                enter[k] -= enter[k].max()
        for k in range(len(of) - 2, -1, -1):
            if of[k + 1][1]:  # closed: what lies from a state at the piece's first line to the chain's end
                leave[k] = _lse(change + closed[k + 1], 1)
                leave[k] -= leave[k].max()
                closed[k] = _lse(through[k] + closed[k + 1], 1)
                closed[k] -= closed[k].max()
    out = [np.empty(len(u)) for u in unary]
    for group in groups:
        node, last = nodes(group), size[group] - 1
        good = _pass(node, last, change, enter[group], False) + _pass(node, last, change, leave[group], True) + node
        p = np.exp(good[:, :, 1] - _lse(good, 2))
        for j, k in enumerate(group):
            c, i = of[k]
            out[c][i : i + size[k]] = p[: size[k], j]
    return out


class Model:
    def __init__(self, w, change, curve, prior: float):
        self.w, self.change, self.curve, self.prior = w, change, curve, prior

    def shares(self, texts: list[bytes]) -> np.ndarray:
        """The part of each text's length that is good, ``GROUP`` lines or one text at once."""
        out, held, lines = [], [], 0
        for i, text in enumerate(texts):
            held.append(scores_of_lines(text, self.w))
            lines += len(held[-1][0])
            if lines >= GROUP or i + 1 == len(texts):
                unary, lengths = zip(*held, strict=True)
                out += [float((p * n).sum() / n.sum()) for p, n in zip(line_marginals(list(unary), self.change), lengths, strict=True)]
                held, lines = [], 0
        return np.array(out)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.w is None:
            return np.full(len(texts), self.prior)
        x = self.shares(texts).reshape(-1, 1)
        return 1 / (1 + np.exp(-np.clip(x @ self.curve[:-1] + self.curve[-1], -30, 30)))


def training_pieces(texts: list[bytes], most: int = LINES, piece: int = PIECE) -> tuple[list[np.ndarray], list[int]]:
    """Features of pieces of at most ``piece`` lines, and the text of each; ``most`` lines in all or a little more.

    Texts of few lines are taken whole; of the longest, pieces at even distances.
    """
    counts = np.array([t.count(b"\n") + 1 for t in texts])
    low, high = piece, max(piece, int(counts.max()))
    while low < high:  # the largest quota that keeps the total
        middle = (low + high + 1) // 2
        low, high = (middle, high) if np.minimum(counts, middle).sum() <= most else (low, middle - 1)
    rows, owner = [], []
    for k, text in enumerate(texts):
        lines = text.split(b"\n")
        copies, n = Counter(lines), -(-len(lines) // piece)
        taken = n if len(lines) <= low else max(1, low // piece)
        for i in np.unique(np.linspace(0, n - 1, taken).round().astype(int)).tolist():
            rows.append(line_features(lines, copies, i * piece, min((i + 1) * piece, len(lines))))
            owner.append(k)
    return rows, owner


def train(texts: list[bytes], y: np.ndarray) -> Model:
    prior = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    if len(np.unique(y)) < 2:
        return Model(None, None, None, prior)
    rows, owner = training_pieces(texts)
    states = [np.full(len(r), float(y[k])) for r, k in zip(rows, owner, strict=True)]
    found = fit(rows, states)
    for i, p in enumerate(line_marginals([r @ found[0] for r in rows], found[1])):
        if not y[owner[i]] and p.min() < 0.5:
            states[i] = (p > 0.9).astype(float)
    model = Model(*fit(rows, states, found, epochs=15), None, prior)
    model.curve = logistic(model.shares(texts).reshape(-1, 1), y)
    return model


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 1000):
                part = batch.slice(i, 1000)
                texts = part.column("text").cast(pa.binary()).to_pylist()
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.value.scores(texts), pa.float64())], names=["doc_id", "score"])

    return run


def quality(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """Quality of every whole text of ``docs``: doc_id, held_out, score, predicted (score of 0.5 or more).

    Learns from at most ``most`` labelled rows outside the held-out third of the ids.
    The field is fitted to at most ``LINES`` of the sample's lines, the curve to all of
    them. Null and empty texts score as one empty line; with no labels, or of one class
    only, every text scores the prior. Null ids are not held out. One row per row of
    ``docs``: repeated rows score alike, an empty table gives an empty result, further
    columns are left alone. What a task holds grows with its longest text alone.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(*sample(docs, labels, "quality", most)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    out = rows.mapInArrow(_score(model), "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return quality(docs, labels)
