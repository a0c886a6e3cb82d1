"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters as a learned embedding of its own and the mean of learned embeddings of
its character n-grams; both are rows of hashed tables that are trained with the
network, by back-propagation. Beside them stands the evidence of small samples: the
log-odds of the word and of its n-grams (mean and greatest), which a training document
is read with as the other folds of the sample give them. Two GRUs read a window of words from either end,
attention pools their states, and a logistic unit scores the window. A document's
score is that of its worst window; windows overlap and cover the whole text, of which
runs without ASCII space are cut into words first. All is trained in numpy on the
driver, from a bounded sample. Embeddings start at zero, so what the sample never
showed says nothing; words are dropped at random while training, so that characters
have to speak for the words that the sample lacks.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from unicodedata import category
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import ALNUM_LOWER, whole_rows
from .labelled import SAMPLE, held_out, sample

WINDOW = 32
STRIDE = 24
HIDDEN = 8
ATTENTION = 4
WORDS = 1 << 16
GRAMS = 1 << 17
GRAM_SIZES = (4, 6)
#: Bytes of a word; a longer run is several words.
LONGEST = 40
WORD_SIZE, GRAM_SIZE = 6, 10
#: Inputs of a word that are counted, then those that are learned.
COUNTED = 4
INPUTS = COUNTED + WORD_SIZE + GRAM_SIZE
FOLDS = 4
REJECT = 0.7
#: Step of the embeddings, weight of a toxic document in training, times that an epoch reads each document.
RATE = 0.01
TOXIC = 2
PASSES = 3
#: Texts of the sample that a word or n-gram must be in to be learned.
COMMON = 3
#: Words that a task remembers the inputs of, and windows it scores at once.
KNOWN = 200_000
BATCH = 4096

Params = dict[str, np.ndarray]


@lru_cache(maxsize=1)
def _parts() -> re.Pattern:
    """Runs of letters, marks and digits of any script, and runs of all else."""
    inside = [c < 128 or category(chr(c))[0] in "LMN" for c in range(sys.maxunicode + 1)]
    edges = [c for c in range(1, len(inside)) if inside[c] != inside[c - 1]] + [len(inside)]
    other = "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(edges[::2], edges[1::2], strict=False))
    return re.compile(f"[{other}]+|[^{other}]+")


def _edge(run: bytes, i: int) -> int:
    """The nearest start of a character at or before ``i``."""
    for _ in range(3):
        if i < len(run) and run[i] & 0xC0 == 0x80:
            i -= 1
    return i


def pieces(run: bytes) -> Iterator[bytes]:
    """A run without ASCII space as words of at most ``LONGEST`` bytes: cut at the signs and spaces of other
    scripts, then into pieces that overlap, so that every n-gram of a part is whole in one of them."""
    for part in _parts().findall(run.decode("utf-8", "surrogateescape")):
        if part.isspace():
            continue
        part, i = part.encode("utf-8", "surrogateescape"), 0
        while i + LONGEST < len(part):
            end = _edge(part, i + LONGEST)
            yield part[i:end]
            i = _edge(part, end - max(GRAM_SIZES) + 1)
        yield part[i:]


def words_of(text: bytes) -> list[bytes]:
    words = text.translate(ALNUM_LOWER).split()
    if max(map(len, words), default=0) <= LONGEST:
        return words
    return [p for w in words for p in (pieces(w) if len(w) > LONGEST else (w,))]


def gram_ids(word: bytes) -> list[int]:
    w = b"<" + word + b">"
    return [crc32(w[i : i + n]) & (GRAMS - 1) for n in GRAM_SIZES for i in range(max(1, len(w) - n + 1))]


def window_starts(n: int) -> range:
    return range(0, max(1, n - (WINDOW - STRIDE)), STRIDE)


def word_input(word: bytes, m: Model) -> np.ndarray:
    w, g = crc32(word) & (WORDS - 1), gram_ids(word)
    odds = m.odds["g"][g]
    return np.concatenate([[m.odds["w"][w] / 2, odds.mean(), odds.max() / 2, min(len(word), 20) / 20], m.by["w"][w], m.by["g"][g].mean(axis=0)]).astype(np.float32)


def inputs_of(words: list[bytes], m: Model) -> np.ndarray:
    """``word_input`` of many words."""
    ids = list(map(gram_ids, words))
    n = np.fromiter(map(len, ids), np.int64, len(ids))
    g = np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum()))
    w = np.fromiter(map(crc32, words), np.int64, len(words)) & (WORDS - 1)
    size = np.minimum(np.fromiter(map(len, words), np.float32, len(words)), 20) / 20
    at, odds = np.cumsum(n) - n, m.odds["g"][g]
    counted = np.stack([m.odds["w"][w] / 2, np.add.reduceat(odds, at) / n, np.maximum.reduceat(odds, at) / 2, size], 1)
    return np.hstack([counted, m.by["w"][w], np.add.reduceat(m.by["g"][g], at) / n[:, None]]).astype(np.float32)


def evidence(hits: np.ndarray, positive: np.ndarray, prior: float, strength: float = 2.0) -> np.ndarray:
    """Log-odds of a document with each id, against the prior, drawn to 0 where few documents have it."""
    p = np.clip((positive + strength * prior) / (hits + strength), 1e-4, 1 - 1e-4)
    return np.clip(np.log(p / (1 - p)) - np.log(prior / (1 - prior)), -6, 6).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fresh(rng: np.random.Generator, kind=np.float32) -> Params:
    h, a = HIDDEN, ATTENTION
    shapes = {"Wf": (INPUTS, 3 * h), "Uf": (h, 3 * h), "bf": (3 * h,), "Wb": (INPUTS, 3 * h), "Ub": (h, 3 * h), "bb": (3 * h,), "A": (2 * h, a), "ab": (a,), "v": (a,), "w": (2 * h,), "c": (1,)}
    return {k: (rng.normal(0, 0.3, s) if k[0] not in "bc" and k not in ("ab", "bf", "bb") else np.zeros(s)).astype(kind) for k, s in shapes.items()}


def _read(p: np.ndarray, mask: np.ndarray, u: np.ndarray, backwards: bool, tape: list | None) -> np.ndarray:
    """States of a GRU over projected inputs (time, windows, 3 * hidden); where the mask is 0 it stands still."""
    steps, n, _ = p.shape
    k = u.shape[0]
    h = np.zeros((n, k), p.dtype)
    out = np.empty((steps, n, k), p.dtype)
    for t in range(steps - 1, -1, -1) if backwards else range(steps):
        hu = h @ u
        gates = sigmoid(p[t, :, : 2 * k] + hu[:, : 2 * k])
        z, r = gates[:, :k], gates[:, k:]
        new = np.tanh(p[t, :, 2 * k :] + r * hu[:, 2 * k :])
        if tape is not None:
            tape.append((t, h, z, r, new, hu[:, 2 * k :]))
        h = h + mask[t] * (1 - z) * (new - h)
        out[t] = h
    return out


def _unread(d_out: np.ndarray, mask: np.ndarray, u: np.ndarray, tape: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the projected inputs and of the recurrent weights."""
    k = u.shape[0]
    d_p = np.zeros((*d_out.shape[:2], 3 * k), d_out.dtype)
    d_u, d_h = np.zeros_like(u), np.zeros(d_out.shape[1:], d_out.dtype)
    for t, h, z, r, new, hn in reversed(tape):
        d = d_out[t] + d_h
        dm = d * mask[t]
        d_new = dm * (1 - z) * (1 - new * new)
        d_z = -dm * (new - h) * z * (1 - z)
        d_r = d_new * hn * r * (1 - r)
        d_p[t] = np.concatenate([d_z, d_r, d_new], 1)
        d_hu = np.concatenate([d_z, d_r, d_new * r], 1)
        d_h = d - dm * (1 - z) + d_hu @ u.T
        d_u += h.T @ d_hu
    return d_p, d_u


def forward(q: Params, pf: np.ndarray, pb: np.ndarray, mask: np.ndarray, tapes: tuple[list, list] | None = None):
    """Logits of windows from their projected inputs, and what the gradient needs."""
    states = np.concatenate([_read(pf, mask, q["Uf"], False, tapes and tapes[0]), _read(pb, mask, q["Ub"], True, tapes and tapes[1])], 2)
    u = np.tanh(states @ q["A"] + q["ab"])
    s = u @ q["v"] + np.where(mask[:, :, 0] > 0, 0, -1e4).astype(u.dtype)
    a = np.exp(s - s.max(axis=0))
    a /= a.sum(axis=0)
    pooled = np.einsum("tn,tnk->nk", a, states)
    return pooled @ q["w"] + q["c"][0], (states, u, a, pooled)


def gradient(q: Params, x: np.ndarray, mask: np.ndarray, y: np.ndarray, toxic: float = 1) -> tuple[float, Params, np.ndarray]:
    """Mean log-loss of windows x (time, windows, inputs), and its gradients of the weights and of x, by back-propagation
    through time. Windows with y = 1 weigh ``toxic``."""
    tapes: tuple[list, list] = ([], [])
    logit, (states, u, a, pooled) = forward(q, x @ q["Wf"] + q["bf"], x @ q["Wb"] + q["bb"], mask, tapes)
    p = sigmoid(logit)
    loss = float(-np.mean(np.where(y > 0, toxic * np.log(p + 1e-7), np.log(1 - p + 1e-7))))
    d = (np.where(y > 0, toxic, 1) * (p - y) / len(y)).astype(x.dtype)
    g = {"w": pooled.T @ d, "c": np.array([d.sum()], x.dtype)}
    d_pool = d[:, None] * q["w"]
    d_a = np.einsum("tnk,nk->tn", states, d_pool)
    d_s = a * (d_a - (a * d_a).sum(axis=0))
    d_u = d_s[:, :, None] * q["v"] * (1 - u * u)
    g["v"] = np.einsum("tn,tna->a", d_s, u)
    g["A"], g["ab"] = np.einsum("tnk,tna->ka", states, d_u), d_u.sum(axis=(0, 1))
    d_states = a[:, :, None] * d_pool + d_u @ q["A"].T
    k, d_x = q["Uf"].shape[0], np.zeros_like(x)
    for way, part, tape in (("f", d_states[:, :, :k], tapes[0]), ("b", d_states[:, :, k:], tapes[1])):
        d_p, g["U" + way] = _unread(part, mask, q["U" + way], tape)
        g["W" + way], g["b" + way] = np.einsum("tni,tnj->ij", x, d_p), d_p.sum(axis=(0, 1))
        d_x += d_p @ q["W" + way].T
    return loss, g, d_x


class Adam:
    def __init__(self, q: Params, rate: float):
        self.rate, self.n = rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in q.items()} for _ in range(2))

    def step(self, q: Params, g: Params) -> None:
        self.n += 1
        for k, d in g.items():
            self.m[k] = 0.9 * self.m[k] + 0.1 * d
            self.v[k] = 0.999 * self.v[k] + 0.001 * d * d
            q[k] -= (self.rate * (self.m[k] / (1 - 0.9**self.n)) / (np.sqrt(self.v[k] / (1 - 0.999**self.n)) + 1e-8)).astype(q[k].dtype)


def cut(inputs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of documents' word numbers (0 pads): windows (n, time), their documents, their first words."""
    rows, docs, at = [], [], []
    for d, x in enumerate(inputs):
        starts = np.arange(len(x))[: max(1, len(x) - (WINDOW - STRIDE)) : STRIDE] if len(x) else np.zeros(1, np.int64)
        padded = np.concatenate([x, np.zeros(WINDOW, x.dtype)])
        rows.append(padded[starts[:, None] + np.arange(WINDOW)])
        docs.append(np.full(len(starts), d))
        at.append(starts)
    return np.concatenate(rows), np.concatenate(docs), np.concatenate(at)


def scored(q: Params, x: np.ndarray, table_f: np.ndarray, table_b: np.ndarray) -> np.ndarray:
    """Logits of windows of word numbers, given each word's projected inputs; word 0 pads."""
    out = np.empty(len(x), np.float32)
    for i in range(0, len(x), BATCH):
        part = x[i : i + BATCH].T
        out[i : i + BATCH] = forward(q, table_f[part], table_b[part], (part > 0)[:, :, None].astype(np.float32))[0]
    return out


class Model:
    """Tables ("w": of words, "g": of n-grams) of log-odds and embeddings, and the network; without two classes to learn from it scores the prior."""

    def __init__(self, odds, by, q: Params | None, prior: float):
        self.odds, self.by, self.q, self.prior = odds, by, q, prior


def added(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows, and the sum of the values of each."""
    order = np.argsort(rows, kind="stable")
    at = np.flatnonzero(np.concatenate(([True], rows[order][1:] != rows[order][:-1])))
    return rows[order][at], np.add.reduceat(values[order], at)


class Vocabulary:
    """A sample's distinct words with their rows in the tables, and the embeddings, which are trained row by row.

    Only rows that ``COMMON`` texts share move: what one document has alone would explain its label and
    no other. A row moves by its gradient over the root of its squared gradients so far, and of ``DAMP``,
    without which the least gradient would move a rare row by a whole step.
    """

    DAMP = 1e-6

    def __init__(self, words: list[bytes], rate: float):
        self.rate = rate
        self.word = np.array([crc32(w) & (WORDS - 1) for w in words], np.int64)
        self.length = np.array([min(len(w), 20) / 20 for w in words], np.float32)
        self.count = np.array([sum(max(1, len(w) + 3 - n) for n in GRAM_SIZES) for w in words], np.int64)
        self.start = np.cumsum(self.count) - self.count
        self.grams = np.fromiter(chain.from_iterable(map(gram_ids, words)), np.int32, int(self.count.sum()))
        self.by = {"w": np.zeros((WORDS, WORD_SIZE), np.float32), "g": np.zeros((GRAMS, GRAM_SIZE), np.float32)}
        self.seen = {k: np.zeros_like(x) for k, x in self.by.items()}
        self.moves = {k: np.ones(len(x), bool) for k, x in self.by.items()}

    def grams_of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams of words end to end, and where each word's begin."""
        n = self.count[words]
        at = np.cumsum(n) - n
        return self.grams[np.repeat(self.start[words] - at, n) + np.arange(n.sum())], at

    def counts(self, texts: list[np.ndarray], y: np.ndarray, fold: np.ndarray) -> dict[str, np.ndarray]:
        """Texts with each word and n-gram, by label and fold."""
        hits = {"w": np.zeros((2, FOLDS, WORDS), np.float32), "g": np.zeros((2, FOLDS, GRAMS), np.float32)}
        for text, label, f in zip(texts, y.astype(int), fold, strict=True):
            distinct = np.unique(text)
            hits["w"][label, f, np.unique(self.word[distinct])] += 1
            hits["g"][label, f, np.unique(self.grams_of(distinct)[0])] += 1
        self.moves = {k: n.sum(axis=(0, 1)) >= COMMON for k, n in hits.items()}
        return hits

    def counted(self, odds: dict[str, np.ndarray]) -> np.ndarray:
        """The counted inputs of every word."""
        if not len(self.word):
            return np.empty((0, COUNTED), np.float32)
        g = odds["g"][self.grams]
        mean, most = np.add.reduceat(g, self.start) / self.count, np.maximum.reduceat(g, self.start)
        return np.stack([odds["w"][self.word] / 2, mean, most / 2, self.length], 1).astype(np.float32)

    def learned(self, words: np.ndarray) -> np.ndarray:
        """The learned inputs of words."""
        if not len(words):
            return np.empty((0, WORD_SIZE + GRAM_SIZE), np.float32)
        g, at = self.grams_of(words)
        return np.concatenate([self.by["w"][self.word[words]], np.add.reduceat(self.by["g"][g], at) / self.count[words][:, None]], 1).astype(np.float32)

    def move(self, words: np.ndarray, d: np.ndarray) -> None:
        """One step against the gradients ``d`` of the words' learned inputs."""
        n = self.count[words]
        g, _ = self.grams_of(words)
        for k, rows, values in (("w", self.word[words], d[:, :WORD_SIZE]), ("g", g, np.repeat(d[:, WORD_SIZE:] / n[:, None], n, axis=0))):
            some = self.moves[k][rows]
            if some.any():
                rows, values = added(rows[some], values[some])
                self.seen[k][rows] += values * values
                self.by[k][rows] -= self.rate * values / np.sqrt(self.DAMP + self.seen[k][rows])


def train(texts: list[bytes], y: np.ndarray, epochs: int = 6, dropped: float = 0.5, seed: int = 7) -> Model:
    prior = float(np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3))
    if len(np.unique(y)) < 2:
        return Model(None, None, None, prior)
    rng = np.random.default_rng(seed)
    known: dict[bytes, int] = {}
    numbers = [np.fromiter((known.setdefault(w, len(known)) for w in words_of(t)), np.int64) for t in texts]
    words = Vocabulary(list(known), RATE)
    fold = np.zeros(len(y), np.int64)
    for value in (0, 1):
        mine = np.flatnonzero(y == value)
        fold[rng.permutation(mine)] = np.arange(len(mine)) % FOLDS
    hits = words.counts(numbers, y, fold)

    def odds(without: int | None) -> dict[str, np.ndarray]:
        use = [f for f in range(FOLDS) if f != without]
        return {k: evidence((h := n[:, use].sum(axis=1)).sum(axis=0), h[1], prior) for k, n in hits.items()}

    # Every word once for each fold, with the odds of those who have not seen its documents; 0 pads.
    counted = np.concatenate([words.counted(odds(f)) for f in range(FOLDS)])
    windows, owner, _ = cut([1 + fold[d] * len(known) + n for d, n in enumerate(numbers)])
    size = min(64, max(16, len(y) // 16))
    blank = np.zeros((1, INPUTS), np.float32)
    q = fresh(rng)
    q["c"][0] = np.log(prior / (1 - prior))
    adam = Adam(q, 0.01)
    # Each document stands for itself by its worst window, as it will be scored; at first by that of the most suspicious word.
    worth = np.concatenate([[-np.inf], np.maximum(counted[:, 0], counted[:, 2])])[windows].max(axis=1)
    for epoch in range(epochs):
        if epoch:
            learned = words.learned(np.arange(len(known)))
            for f in range(FOLDS):  # one fold's words at a time
                mine, shift = np.flatnonzero(fold[owner] == f), f * len(known)
                x = np.concatenate([blank, np.hstack([counted[shift : shift + len(known)], learned])])
                worth[mine] = scored(q, np.maximum(windows[mine] - shift, 0), x @ q["Wf"] + q["bf"], x @ q["Wb"] + q["bb"])
        order = np.lexsort((worth, owner))
        worst = order[np.append(owner[order][1:] != owner[order][:-1], True)]
        for _ in range(PASSES):
            for i in np.array_split(rng.permutation(worst), max(1, len(worst) // size)):
                used, at = np.unique(np.append(windows[i].T, 0), return_inverse=True)  # 0 first, whether it pads or not
                at = at[:-1].reshape(windows[i].T.shape)
                used = used[1:] - 1
                here = used % len(known) if len(known) else used
                x = np.concatenate([blank, np.hstack([counted[used], words.learned(here)])])
                gone = rng.random((len(x), 1)) < dropped
                x[:, COUNTED : COUNTED + WORD_SIZE] *= ~gone
                _, g, d_x = gradient(q, x[at], (windows[i].T > 0)[:, :, None].astype(np.float32), y[owner[i]], TOXIC)
                adam.step(q, g)
                d = np.zeros_like(x)
                rows, values = added(at.ravel(), d_x.reshape(-1, INPUTS))
                d[rows] = values
                d[:, COUNTED : COUNTED + WORD_SIZE] *= ~gone
                if len(here):
                    words.move(here, d[1:, COUNTED:])
        if epoch == epochs * 2 // 3:
            adam.rate /= 4
            words.rate /= 4
    return Model(odds(None), words.by, q, prior)


class Scorer:
    """Scores texts in a task; remembers the projected inputs of a bounded number of words."""

    def __init__(self, model: Model):
        self.model, self.q, self.prior = model, model.q, model.prior
        if self.q:
            self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.table = {w: np.zeros((1, 3 * HIDDEN), np.float32) for w in "fb"}

    def _learn(self, texts: list[list[bytes]]) -> None:
        new = set().union(*texts).difference(self.known)
        if len(self.known) + len(new) > KNOWN and self.known:
            self._forget()
            new = set().union(*texts)
        if new:
            new = sorted(new)
            x = np.concatenate([inputs_of(new[i : i + 20_000], self.model) for i in range(0, len(new), 20_000)])
            first = len(self.known) + 1
            self.known.update(zip(new, range(first, first + len(new)), strict=True))
            self.table = {w: np.concatenate([self.table[w], x @ self.q["W" + w] + self.q["b" + w]]) for w in "fb"}

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not self.q:
            return np.full(len(texts), self.prior)
        out = np.zeros(len(texts))
        first, held, size = 0, [], 0
        for i, t in enumerate(texts):
            held.append(words_of(t))
            size += len(held[-1])
            if size >= 100_000 or i + 1 == len(texts):
                self._learn(held)
                get = self.known.__getitem__
                windows, owner, _ = cut([np.fromiter(map(get, w), np.int64, len(w)) for w in held])
                worst = np.full(len(held), -np.inf)
                np.maximum.at(worst, owner, scored(self.q, windows, self.table["f"], self.table["b"]))
                out[first : i + 1] = sigmoid(worst)
                first, held, size = i + 1, [], 0
        return out


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(scorer.scores(texts), pa.float64())], names=[*kept, "score"])

    return run


def with_scores(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` (with a column ``text``, which goes) and the score of every whole text."""
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    schema = StructType([*(f for f in rows.schema if f.name != "text"), StructField("score", DoubleType())])
    return rows.mapInArrow(_score(rows.sparkSession.sparkContext.broadcast(model)), schema)


def toxicity(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """Score of every whole text of ``docs``: doc_id, held_out, score, predicted (score of 0.7 or more).

    Learns from at most ``most`` labelled rows outside the held-out third of the ids.
    Null and empty texts score as the empty window does; with no labels, or of one
    class only, every text scores the prior. Null ids are not held out. One row per row
    of ``docs``: repeated rows each get the same score, an empty table gives an empty
    result, further columns are left alone whatever their names. Very long texts are scored by
    all of their windows.
    """
    model = train(*sample(docs, labels, "toxic", most))
    out = with_scores(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that are predicted toxic, all columns as they were.

    Repeated rows stay or go together; null and empty texts score as the empty window; columns may have any names.
    """
    model = train(*sample(docs, labels, "toxic"))
    rows = with_scores(whole_rows(docs), model)
    return rows.where(F.col("score") < REJECT).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity(docs, labels)
