"""Benchmark decontamination with an FM-index per shard of documents.

A shard is one batch of documents in one task. Its text, as word numbers, becomes
an FM-index: the Burrows-Wheeler transform in a wavelet tree, whose rank queries
drive the backward search, and sampled suffix positions, which locate what it
finds. All benchmark windows are searched at once as vectors. Words that occur in
no benchmark text cannot be part of a hit, so runs of them enter the index as one
separator: the index grows with what could match.

No shuffle is needed. The benchmark goes to the tasks in blocks of bounded size;
each further block is one more pass over the documents, stored in between.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_LOWER, stored, whole_rows

WINDOW = 10
#: Bytes of benchmark text in a block, the most that a task gets at once.
BLOCK_BYTES = 8 << 20
#: Words of an index; a longer batch of documents is indexed in several shards.
SHARD_WORDS = 4_000_000
SAMPLE = 8


def words_of(data: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return data.translate(ALNUM_LOWER).split()


class WaveletTree:
    """Ranks of symbols in a sequence, one bit vector per level (wavelet matrix layout)."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        s = sequence
        for level in range(self.levels - 1, -1, -1):
            bit = (s >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int64))))
            self.zeros.append(int(len(s) - bit.sum()))
            s = np.concatenate((s[bit == 0], s[bit == 1]))

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place."""
        start = np.zeros_like(place)
        for d in range(self.levels):
            bit = (symbol >> (self.levels - 1 - d)) & 1
            a, b = self.ones[d][start], self.ones[d][place]
            one = bit == 1
            start = np.where(one, self.zeros[d] + a, start - a)
            place = np.where(one, self.zeros[d] + b, place - b)
        return place - start

    def access(self, place: np.ndarray) -> np.ndarray:
        value = np.zeros_like(place)
        for d in range(self.levels):
            a = self.ones[d][place]
            bit = self.ones[d][place + 1] - a
            value = (value << 1) | bit
            place = np.where(bit == 1, self.zeros[d] + a, place - a)
        return value


def suffix_array(s: np.ndarray) -> np.ndarray:
    """By prefix doubling; ``s`` ends in its only 0, the smallest symbol."""
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        pair = rank * (n + 1)
        pair[:-step] += rank[step:] + 1
        order = np.argsort(pair, kind="stable")
        fresh = np.empty(n, np.int64)
        fresh[order] = np.concatenate(([0], np.cumsum(pair[order][1:] != pair[order][:-1])))
        rank = fresh
        if rank[order[-1]] == n - 1 or step >= n:
            return order
        step *= 2


class FMIndex:
    """Backward search and location over a sequence of symbols 1, 2, ... ."""

    def __init__(self, s: np.ndarray, symbols: int, sample: int = SAMPLE):
        s = np.append(s, 0)
        order = suffix_array(s)
        self.bwt = s[order - 1]
        self.tree = WaveletTree(self.bwt, symbols)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(s, minlength=symbols))))
        marked = order % sample == 0
        self.marked = marked
        self.place = np.concatenate(([0], np.cumsum(marked)))
        self.samples = order[marked]
        self.n = len(s)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of rows that begin with each pattern (right-aligned rows of symbols)."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for back in range(patterns.shape[1]):
            live = np.flatnonzero((lengths > back) & (low < high))
            if not len(live):
                continue
            c = patterns[live, patterns.shape[1] - 1 - back]
            low[live] = self.before[c] + self.tree.rank(c, low[live])
            high[live] = self.before[c] + self.tree.rank(c, high[live])
        high[lengths == 0] = 0
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of rows: back-steps to the nearest sampled suffix."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        while len(live := np.flatnonzero(~self.marked[rows])):
            c = self.tree.access(rows[live])
            rows[live] = self.before[c] + self.tree.rank(c, rows[live])
            steps[live] += 1
        return self.samples[self.place[rows]] + steps


class Phrases:
    """The windows of a block of benchmark items, as symbols. Symbol 1 is the separator."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        self.ids = [i for i, _ in items]
        self.symbol: dict[bytes, int] = {}
        #: The items of each different word sequence, its windows as rows of one array, and whose each row is.
        self.items: list[list[int]] = []
        known: dict[bytes, list[int]] = {}
        rows, counts, lengths = [np.zeros((0, window), np.int32)], [], []
        for k, (_, text) in enumerate(items):
            w = words_of(text)
            if not w:
                continue
            mine = known.setdefault(b" ".join(w), [])
            mine.append(k)
            if len(mine) > 1:
                continue
            s = np.fromiter((self.symbol.setdefault(x, len(self.symbol) + 2) for x in w), np.int32, len(w))
            if len(s) < window:
                rows.append(np.pad(s, (window - len(s), 0))[None])
            else:
                rows.append(np.lib.stride_tricks.sliding_window_view(s, window))
            self.items.append(mine)
            counts.append(len(rows[-1]))
            lengths.append(min(len(s), window))
        self.rows = np.concatenate(rows)
        self.owner = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        self.lengths = np.repeat(np.array(lengths, np.int32), counts)
        self.shortest = min(lengths, default=0)

    def hits(self, texts: list[bytes], shard_words: int = SHARD_WORDS):
        """Per text: number of words, merged hit spans [start, end) and the numbers of the items hit."""
        counts, spans, items = [0] * len(texts), [[] for _ in texts], [set() for _ in texts]
        seq: list[np.ndarray] = []
        at: list[tuple[int, int, int]] = []  # index position, text, word
        size = 0
        get = self.symbol.get
        for t, text in enumerate(texts):
            w = words_of(text)
            counts[t] = len(w)
            if not self.shortest or len(w) < self.shortest:
                continue
            s = np.fromiter((get(x, 1) for x in w), np.int64, len(w))
            edge = np.flatnonzero(np.diff(np.concatenate(([0], s > 1, [0]))))
            for a, b in zip(edge[::2], edge[1::2], strict=True):
                if b - a >= self.shortest:
                    at.append((size, t, int(a)))
                    seq += [s[a:b], np.ones(1, np.int64)]
                    size += int(b - a) + 1
            if size >= shard_words:
                self._search(seq, at, spans, items)
                seq, at, size = [], [], 0
        if seq:
            self._search(seq, at, spans, items)
        return counts, [_merged(x) for x in spans], items

    def _search(self, seq, at, spans, items) -> None:
        index = FMIndex(np.concatenate(seq), len(self.symbol) + 2)
        low, high = index.search(self.rows, self.lengths)
        found = np.flatnonzero(low < high)
        if not len(found):
            return
        n = (high - low)[found]
        which = np.repeat(found, n)
        rows = np.repeat(low[found], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        place = index.locate(rows)
        starts = np.array([a for a, _, _ in at])
        run = np.searchsorted(starts, place, "right") - 1
        for p, r, k in zip(place.tolist(), run.tolist(), which.tolist(), strict=True):
            first, t, word = at[r]
            begin = word + p - first
            spans[t].append((begin, begin + int(self.lengths[k])))
            items[t].update(self.items[self.owner[k]])


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(bench: DataFrame, block_bytes: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """The benchmark in blocks of bounded size, one at a time on the driver."""
    items = bench.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).where("t is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n = max(1, -(-int(total) // block_bytes))
    for k in range(n):
        block = items if n == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield [(r["i"], r["t"].encode()) for r in block.toLocalIterator()]


def _step(items, window: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(items.value, window)
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "").cast(pa.binary()).to_pylist()
            counts, spans, hit = phrases.hits(texts)
            old = [json.loads(x) for x in batch.column("found").to_pylist()]
            found = [json.dumps([_merged([*map(tuple, o[0]), *s]), sorted({*o[1], *(phrases.ids[i] for i in h if phrases.ids[i] is not None)})]) for o, s, h in zip(old, spans, hit, strict=True)]
            kept = [c for c in names if c not in ("n_words", "found")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(counts, pa.int64()), pa.array(found)], names=[*kept, "n_words", "found"])

    return run


def contamination(docs: DataFrame, bench: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, keep_text: bool = False) -> DataFrame:
    """Words of documents that lie in an occurrence of a benchmark window.

    Returns one row per row of ``docs``, repeated ones too: its other columns as they were
    (text with ``keep_text``; a column named like one of the following gives way to it), n_words, n_hit, n_items, items (sorted as strings), spans (word
    positions [start, end), merged) and contaminated. Null texts have no words; items
    without words match nothing; the windows of an item with a null id count as hits, but the item is not
    in ``items``; repeated items count once. An empty table gives an empty result; with an empty benchmark
    nothing is hit. Very long texts are indexed whole. With several blocks the documents are stored after each but the last.
    """
    spark = docs.sparkSession
    spare = {c: f"__in_{i}" for i, c in enumerate(docs.columns) if c != "text"}
    out = docs.select(*(F.col(f"`{c}`").alias(a) for c, a in spare.items()), "text", F.lit(0).cast("long").alias("n_words"), F.lit("[[], []]").alias("found"))
    for k, items in enumerate(_blocks(bench, block_bytes)):
        if k:  # a task holds the phrases of one block only
            out = stored(out, "decontamination")
        out = out.mapInArrow(_step(spark.sparkContext.broadcast(items), window, out.columns), out.schema)
    out = out.withColumn("found", F.from_json("found", "array<string>"))
    out = out.withColumn("spans", F.from_json(F.col("found")[0], "array<array<int>>")).withColumn("items", F.from_json(F.col("found")[1], "array<string>"))
    names = ["n_words", "n_hit", "n_items", "items", "spans", "contaminated"]
    return (
        out.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0]))
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("contaminated", F.col("n_hit") > 0)
        .select(*(F.col(a).alias(c) for c, a in spare.items() if c not in names), *(["text"] if keep_text else []), *names)
    )


def clean_documents(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """``docs`` without those that hold a window of the benchmark, all columns as they were, whatever their names.

    Null and empty texts stay; repeated rows stay or go together; an empty table stays empty.
    """
    flagged = contamination(whole_rows(docs), bench)
    return flagged.where("not contaminated").select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    out = contamination(docs.select("doc_id", "text"), bench)
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
p AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i + 1 : i + 10], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
s AS (SELECT DISTINCT n FROM p),
c AS (
  SELECT doc_id, i, n, array_to_string(w[i + 1 : i + n], ' ') AS phrase
  FROM (SELECT doc_id, w, s.n, unnest(range(greatest(0, len(w) - s.n + 1))) AS i FROM d, s)),
h AS (SELECT c.doc_id, c.i, c.n, p.item_id FROM c JOIN p ON c.phrase = p.phrase AND c.n = p.n),
m AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN m USING (doc_id) LEFT JOIN i USING (doc_id)
"""
