"""Periodic runs of words: stretches that repeat with one period at least four times.

Scale by scale (lengths m of powers of two), aligned blocks of m words go into an
Aho-Corasick automaton over integer sequences, which is run over the document; an
occurrence of a block at a distance of m to 2m - 1 words from the block seeds an exact
extension both ways. A run of period q, m <= q < 2m, is over 4m long and so holds an
aligned block that occurs again q words on: no run is missed, and none is reported that
the words themselves do not show.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import U64, mixed

#: A run repeats its period so often, and is at least so long.
REPEATS, SHORTEST = 4, 6
#: Blocks enter the automaton as at most so many letters; longer ones by hashes of equal pieces.
LETTERS = 64
#: Grams whose next occurrence tells which blocks can recur in time.
GRAM = 8
#: Words that are looked at together; a longer document is alone.
TOGETHER = 500_000


class Numbers(dict):
    """Word to number, in order of first sight."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def doubled(h: np.ndarray, m: int) -> np.ndarray:
    """Hashes of grams of 2m words from those of m words; grams that would pass the end get a hash of their own place."""
    out = mixed(np.arange(len(h), dtype=U64) * U64(2) + U64(1))
    if len(h) > m:
        out[:-m] = mixed(h[:-m] * U64(0x9E3779B97F4A7C15) + h[m:])
    return out


def to_next(h: np.ndarray) -> np.ndarray:
    """Distance from each place to the next that holds the same; the length where there is none."""
    out = np.full(len(h), len(h), np.int64)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def common(t: np.ndarray, a: int, b: int, end: int) -> int:
    """Words from a on (b > a, up to b = end) that equal those from b on."""
    n, step = 0, 64
    while b + n < end:
        size = min(step, end - b - n)
        differs = np.flatnonzero(t[a + n : a + n + size] != t[b + n : b + n + size])
        if len(differs):
            return n + int(differs[0])
        n, step = n + size, step * 4
    return n


def common_back(t: np.ndarray, a: int, b: int) -> int:
    """Words before a that equal those before b (b > a), down to the first."""
    n, step = 0, 64
    while a - n > 0:
        size = min(step, a - n)
        differs = np.flatnonzero(t[a - n - size : a - n] != t[b - n - size : b - n])
        if len(differs):
            return n + size - 1 - int(differs[-1])
        n, step = n + size, step * 4
    return n


class Stretches:
    """Maximal stretches (start, end, period) of one document."""

    def __init__(self, t: np.ndarray):
        self.t = t
        self.found: set[tuple[int, int, int]] = set()
        self.last: dict[int, tuple[int, int]] = {}
        self.starts: list[int] = []
        self.ends: list[int] = []

    def settle(self) -> None:
        """From now on ``cover`` knows of all stretches found so far."""
        self.last = {}
        order = sorted((s, e) for s, e, _ in self.found)
        self.starts = [s for s, _ in order]
        self.ends = np.maximum.accumulate([e for _, e in order]).tolist() if order else []

    def cover(self, start: int, end: int) -> bool:
        """Whether one stretch of a smaller scale holds all of start..end.

        Its period is under m. What has a period q of this scale (m <= q < 2m) and holds a block
        of m words and its copy q words on, all within such a stretch, repeats a shorter
        period through every q words, so that q is not its smallest.
        """
        at = bisect_right(self.starts, start) - 1
        return at >= 0 and self.ends[at] >= end

    def extend(self, b: int, q: int, m: int) -> None:
        s, e = self.last.get(q, (0, 0))
        if s <= b and b + q + m <= e:
            return
        t = self.t
        if not np.array_equal(t[b : b + m], t[b + q : b + q + m]):
            return
        s = b - common_back(t, b, b + q)
        e = b + q + m + common(t, b + m, b + q + m, len(t))
        self.last[q] = s, e
        self.found.add((s, e, q))

    def bounds(self, at: int, q: int) -> tuple[int, int]:
        """The maximal stretch of period q around ``at``."""
        return at - common_back(self.t, at, at + q), at + q + common(self.t, at, at + q, len(self.t))

    def seed(self, b: int, places: list[int], m: int) -> None:
        """Extend from block b and its later occurrences (within 2m words), but for those that can't be of a run.

        Three or more places are an arithmetic progression whose step is the block's smallest
        period: the block lies in one stretch of that period and the places in another. If
        it is the same, no distance is a smallest period; else a run holds the start or the end
        of the first stretch, and its period takes it to that of the second.
        """
        if len(places) > 2:
            step = places[1] - places[0]
            (s, e), (s2, e2) = self.bounds(b, step), self.bounds(places[0], step)
            if e >= b + m and e2 >= places[-1] + m:
                places = [b + q for q in sorted({s2 - s, e2 - e}) if m <= q < 2 * m] if (s, e) != (s2, e2) else []
        for at in places:
            if not self.cover(b, at + m):
                self.extend(b, at - b, m)

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period), by start, then period; no stretch that a smaller period holds too."""
        long = sorted(((s, e, q) for s, e, q in self.found if e - s >= max(SHORTEST, REPEATS * q)), key=lambda r: r[2])
        out: list[tuple[int, int, int]] = []
        within: dict[tuple[int, int], list[int]] = {}
        for s, e, q in long:  # a smaller period that divides q has the same maximal stretch
            smaller = within.setdefault((s, e), [])
            if not any(q % p == 0 for p in smaller):
                smaller.append(q)
                out.append((s, e - s, q))
        return sorted(out, key=lambda r: (r[0], r[2]))


def occurrences(letters: np.ndarray, blocks: list[int], m: int, width: int) -> dict[int, list[int]]:
    """For each block, its places that are m to 2m - 1 words on.

    The automaton holds the distinct blocks; ``width`` words are one letter, so that it
    reads every ``width``-th place of the text for each remainder. Only the text within
    reach of a block is read.
    """
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    keys, key_of = {}, []
    for b in blocks:
        key = tuple(letters[b : b + m : width].tolist())
        key_of.append(keys.setdefault(key, len(keys)))
        automaton.add_word(key, key_of[-1])
    automaton.make_automaton()
    reach: list[list[int]] = []
    for b in blocks:
        if reach and b + m <= reach[-1][1]:
            reach[-1][1] = b + 3 * m - 1
        else:
            reach.append([b + m, b + 3 * m - 1])
    places: list[list[int]] = [[] for _ in keys]
    for start, end in reach:
        for r in range(width):
            part = tuple(letters[start + r : min(end, len(letters)) : width].tolist())
            for last, key in automaton.iter(part):
                places[key].append(start + r + (last + 1) * width - m)
    for p in places:
        p.sort()
    found = {}
    for b, k in zip(blocks, key_of, strict=True):
        p = places[k]
        found[b] = p[bisect_left(p, b + m) : bisect_left(p, b + 2 * m)]
    return found


def runs_of(t: np.ndarray, candidates: list[tuple[int, np.ndarray, np.ndarray]]) -> list[tuple[int, int, int]]:
    """Runs of one document: its words' numbers, and (m, starts of blocks, letters) of each scale that has blocks."""
    stretches = Stretches(t)
    for m, blocks, letters in candidates:
        stretches.settle()
        blocks = [b for b in blocks.tolist() if not stretches.cover(b, min(b + 3 * m - 1, len(t)))]
        if blocks:
            width = max(1, m // LETTERS)
            for b, places in occurrences(letters, blocks, m, width).items():
                stretches.seed(b, places, m)
    return stretches.runs()


def runs_together(documents: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """Runs of each document (its words), looked at together: what can recur is found for all of them at once."""
    sizes = np.array([len(d) for d in documents], np.int64)
    ends = np.cumsum(sizes + 1)
    starts = ends - sizes - 1
    numbers = Numbers()
    t = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
    for d, s in zip(documents, starts.tolist(), strict=True):
        t[s : s + len(d)] = np.fromiter(map(numbers.__getitem__, d), np.int64, len(d))
    t[ends - 1] = len(numbers) + np.arange(len(ends))  # a word of its own ends each document
    owner = np.repeat(np.arange(len(documents)), sizes + 1)
    candidates: dict[int, list] = {}
    m, h, letters = 1, mixed(t.astype(U64)), t
    while REPEATS * m <= sizes.max(initial=0):
        if m <= GRAM:
            gap = to_next(h)
            grams = m
        far = np.concatenate([[0], np.cumsum(gap >= 2 * m)])
        blocks = np.arange(0, len(t) - m + 1, m)
        blocks = blocks[far[blocks + m - grams + 1] == far[blocks]]
        at = owner[blocks]
        inside = blocks + 2 * m <= ends[at] - 1
        blocks, at = blocks[inside], at[inside]
        for first in np.flatnonzero(np.diff(at, prepend=-1)):
            d = int(at[first])
            mine = blocks[first : np.searchsorted(at, d, "right")] - starts[d]
            pieces = letters[starts[d] : ends[d] - 1]
            candidates.setdefault(d, []).append((m, mine, pieces if m <= LETTERS else np.unique(pieces, return_inverse=True)[1]))
        h = doubled(h, m)
        m *= 2
        if m > LETTERS:  # a letter is the hash of m // LETTERS words
            letters = doubled(mixed(t.astype(U64)) if m == 2 * LETTERS else letters, m // LETTERS // 2)
    return [runs_of(t[starts[d] : ends[d] - 1], candidates[d]) if d in candidates else [] for d in range(len(documents))]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words but those that a run holds after its first period, one space between them."""
    if runs:
        gone = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            gone[start + period] += 1
            gone[start + length] -= 1
        words = [w for w, g in zip(words, np.cumsum(gone[:-1]).tolist(), strict=True) if not g]
    return b" ".join(words)


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for batch in batches:
        texts, i = batch.column("text").cast(pa.binary()), 0
        while i < len(batch):
            words, held, first = [], 0, i
            while i < len(batch) and (not words or held < TOGETHER):
                words.append((texts[i].as_py() or b"").split())
                held += len(words[-1])
                i += 1
            runs = runs_together(words)
            rows = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in found] for found in runs], kind)
            left = pa.array([collapsed(w, r) for w, r in zip(words, runs, strict=True)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("row").slice(first, i - first), rows, left], names=["row", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, text: Column | str = "text", *columns: Column | str) -> DataFrame:
    """``columns`` of ``docs`` (doc_id unless given), every periodic run of its text, and the text without the repeats.

    Words are what ASCII white space parts. ``runs`` has (start, length, period) in words, by
    start, then period: maximal stretches in which words a period apart are equal, with at least
    four periods and six words, and no smaller period. ``collapsed`` drops the words that a run
    holds after its first period. Null and empty texts have no runs and collapse to an empty text;
    one row per row of ``docs``, repeated ones too; an empty table gives an empty result, and
    columns of any name pass. Nothing is shuffled; a task holds half a million words, or one text.
    """
    row = F.struct(*(columns or ("doc_id",))).alias("row")
    rows = docs.select(row, (F.col(text) if isinstance(text, str) else text).alias("text"))
    out = rows.mapInArrow(_find, f"row {rows.schema['row'].dataType.simpleString()}, runs {RUNS}, collapsed string")
    return out.select("row.*", "runs", "collapsed")


def planted(text: Column | str, doc_id: Column | str) -> Column:
    """The text with the repeats that the query asks for: its end, for a tenth of the ids, is a few periods of itself."""
    text, doc_id = F.coalesce(text, F.lit("")), F.col(doc_id) if isinstance(doc_id, str) else doc_id
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    times = (F.floor((n - a) / p) + 1).cast("int")
    tail = F.flatten(F.array_repeat(F.slice(words, a + 1, p), times))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.slice(F.concat(F.slice(words, 1, a), tail), 1, n), " ")).otherwise(text)


def digests(found: DataFrame) -> DataFrame:
    """What the query returns of ``periodic_runs``: counts, the longest run (then smallest start, then period), and digests."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("m"), F.array_join(line, "").alias("lines"), "collapsed")
    period = -F.col("m.col3")
    return rows.select(
        "doc_id",
        "n_runs",
        (-F.col("m.col2")).alias("start"),
        F.col("m.length").alias("length"),
        period.alias("period"),
        F.floor(F.col("m.length") * 1000 / period).alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(periodic_runs(docs, planted("text", "doc_id")))
