"""Substring deduplication: seed and extend over winnowed anchors.

Seeds: of every 15 consecutive 6-word hashes the smallest is an anchor, so each
window of 20 words owns one anchor, and equal windows own equal anchors at the
same offset. Documents meet on equal anchors; those that occur once seed nothing.

Extension: every occurrence of a recurring anchor carries what it becomes when it
is extended d words to the left and 14 - d to the right, for the offsets d that it
owns. Occurrences of an anchor are read in document order; where an extension
equals that of an earlier occurrence, its 20 words repeat. Extensions of
neighbouring anchors chain into maximal repeats of at least 20 words, whose words go.

No pairs are made: each occurrence is held against the different extensions seen so
far. An anchor with more than a millionth of all occurrences (and over ``HOT``) is
extended before the shuffle instead of after it: its extensions are keys of their
own, of which each task sends the earliest only, so that a passage in every document
costs each task one row and a frequent phrase in many contexts is spread over all.
Documents with the same words throughout are settled first, by the smallest id.

Words are compared by 128-bit hashes: equal extensions agree in the 64 bits of the
anchor and in 64 independent bits of the 20 words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, WordPrint, discard, grams, in_files, key, located_texts, mixed, signed, stored

WINDOW = 20
GRAM = 6
#: Occurrences up to which an anchor is never hot; hot ones are at most a million, 8 MB, whatever the corpus.
HOT = 1000
MOST_HOT = 1_000_000
#: Bits of an anchor's hash in the count of occurrences; a collision there only leaves a lone anchor in.
COUNTED = (1 << 48) - 1
#: Extensions of hot anchors that a task remembers having sent.
SENT = 200_000
ROWS = 50_000


def anchors(hashes: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """The 6-word hashes, and for each window the position of the anchor it owns."""
    g = grams(hashes, gram)
    if len(hashes) < window:
        return g, np.empty(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(g, window - gram + 1)
    return g, view.argmin(axis=1) + np.arange(len(view))


def covered(starts: np.ndarray, n_words: int, window: int = WINDOW) -> np.ndarray:
    """Mask of the words in windows that start at ``starts``."""
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return np.cumsum(edge[:-1]) > 0


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of every range, end to end."""
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())


def runs(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The anchors, and for each its distance from the one before and the number of windows that own it, a byte each.

    As the windows move right so do their anchors; the windows of an anchor are consecutive.
    """
    at, count = np.unique(own, return_counts=True)
    return at, np.stack([np.diff(at, prepend=0), count]).astype(np.uint8)


def _scan(window: int, gram: int):
    """Per document: words, fingerprints of the whole word sequence, digest of all words, anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = WordPrint()
        for batch in batches:
            out = []
            for text in batch.column("text").cast(pa.binary()):
                w = text.as_py().split()
                h = prints.of(w)
                g, own = anchors(h[0], window, gram)
                at, steps = runs(own)
                place = np.arange(1, len(w) + 1, dtype=U64)
                f = [int(mixed(mixed(x * U64(c)) + mixed(place * U64(c))).sum(dtype=U64).view(np.int64)) if len(w) else 0 for x, c in zip(h, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), strict=True)]
                six = (g[at] & U64(COUNTED)).view(np.uint8).reshape(-1, 8)[:, :6]
                out.append((len(w), *f, hashlib.sha256(b" ".join(w)).hexdigest(), len(at), steps.tobytes(), six.tobytes()))
            cols = list(zip(*out, strict=True)) if out else [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.binary()]
            names = ["n_words", "f1", "f2", "all_sha256", "n_anchors", "runs", "hash"]
            yield pa.RecordBatch.from_arrays([batch.column("row_no"), batch.column("ord"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["row_no", "ord", *names])

    return run


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.column("n_anchors").to_numpy()
        rows = np.repeat(batch.column("row_no").to_numpy(), n)
        six = np.frombuffer(b"".join(batch.column("hash").to_pylist()), np.uint8).reshape(-1, 6)
        hashes = np.zeros((len(six), 8), np.uint8)
        hashes[:, :6] = six
        which = ranges(np.zeros(len(n), np.int64), n.astype(np.int64)).astype(np.int32)
        for i in range(0, len(rows), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 200_000]) for x in (hashes.view(np.int64).ravel(), rows, which)], names=["hash", "row_no", "which"])


def _recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchors of a document with a bit for each that recurs, and the number of windows that own those.

    The row without a number passes the hashes of the hot anchors on.
    """
    for batch in batches:
        out = []
        for row, steps, answer in zip(*(batch.column(c).to_pylist() for c in ("row_no", "runs", "answer")), strict=True):
            answer = np.array(answer or [], np.int64)
            if row is None:
                out.append((None, answer.tobytes()))
                continue
            recurs = np.ones(len(steps or b"") // 2, bool)
            recurs[answer] = False
            n = int(np.frombuffer(steps, np.uint8)[len(recurs) :][recurs].sum()) if steps else 0
            out.append((n, steps + np.packbits(recurs).tobytes() if n else None))
        n, seeds = zip(*out, strict=True) if out else ((), ())
        kept = [c for c in batch.schema.names if c not in ("runs", "answer")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(n, pa.int64()), pa.array(seeds, pa.binary())], names=[*kept, "n_windows", "seeds"])


def unpacked_seeds(seeds: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the recurring anchors: position, first window that owns it, number of those windows."""
    n = len(seeds) * 8 // 17  # two bytes and a bit each
    data = np.frombuffer(seeds, np.uint8)
    recurs = np.unpackbits(data[2 * n :], count=n).astype(bool)
    at, count = np.cumsum(data[:n], dtype=np.int64), data[n : 2 * n].astype(np.int64)
    return at[recurs], (np.cumsum(count) - count)[recurs], count[recurs]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        data = [z.compress(t.as_py()) for t in batch.column("text").cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column("row_no"), pa.array(data, pa.binary())], names=["row_no", "packed"])


def _unpacked(batch: pa.RecordBatch) -> Iterator[list[bytes]]:
    z = zstandard.ZstdDecompressor()
    for p in batch.column("packed"):
        yield z.decompress(p.as_py()).split()


class Sent(dict):
    """The earliest place at which a task has sent each extension of a hot anchor; forgets all when full."""

    def new(self, extension: int, place: tuple) -> bool:
        if extension in self and self[extension] <= place:
            return False
        if len(self) >= SENT:
            self.clear()
        self[extension] = place
        return True


def _extended(window: int, gram: int, hot):
    """Occurrences of recurring anchors with their extensions: meeting key, document order, first window and how many, extensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, sent, frequent = WordPrint(), Sent(), hot.value
        names = ["meet", "ord", "row_no", "place", "extensions"]

        def rows(parts) -> pa.RecordBatch:
            meet, order, row, place, count, flat = (np.concatenate(c) for c in zip(*parts, strict=True))
            offsets = pa.py_buffer(np.concatenate(([0], np.cumsum(count * 8))).astype(np.int32))
            ext = pa.Array.from_buffers(pa.binary(), len(count), [None, offsets, pa.py_buffer(flat)])
            late = order == None  # noqa: E711
            order = pa.array(np.where(late, 0, order).astype(np.int64), mask=late.astype(bool))
            return pa.RecordBatch.from_arrays([pa.array(signed(meet)), order, pa.array(row), pa.array(place), ext], names=names)

        for batch in batches:
            parts, size = [], 0
            for w, seeds, row, order in zip(_unpacked(batch), batch.column("seeds").to_pylist(), batch.column("row_no").to_pylist(), batch.column("ord").to_pylist(), strict=True):
                at, first, count = unpacked_seeds(seeds)
                h = prints.of(w)
                g, whole = grams(h[0], gram)[at], grams(h[1], window)
                low = (g & U64(COUNTED)).view(np.int64)
                is_hot = frequent[np.minimum(np.searchsorted(frequent, low), len(frequent) - 1)] == low if len(frequent) else np.zeros(len(at), bool)
                starts = ranges(first[~is_hot], count[~is_hot])
                n = len(count) - int(is_hot.sum())
                one = lambda k, order=order, row=row: (np.array([order] * k, object), np.full(k, row))
                if n:
                    parts.append((g[~is_hot], *one(n), first[~is_hot] << 4 | count[~is_hot], count[~is_hot], whole[starts]))
                if n < len(count):
                    starts = ranges(first[is_hot], count[is_hot])
                    meet = mixed(np.repeat(g[is_hot], count[is_hot]) * U64(0x9E3779B97F4A7C15) + whole[starts])
                    go = [sent.new(m, (order is None, order or 0, row, s)) for m, s in zip(meet.tolist(), starts.tolist(), strict=True)]
                    starts, meet = starts[go], meet[go]
                    if len(starts):
                        parts.append((meet, *one(len(starts)), starts << 4 | 1, np.ones(len(starts), np.int64), whole[starts]))
                        n += len(starts)
                size += n
                if size >= ROWS:
                    yield rows(parts)
                    parts, size = [], 0
            if parts:
                yield rows(parts)

    return run


def _earliest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences sorted by meeting key and document order: which of their extensions no earlier one of the key has.

    Answers row_no and ``firsts``: the first such window, and above 48 bits a mask of it and those after it.
    """
    at, seen = None, np.empty(0, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        meet = batch.column("meet").to_numpy()
        ext = batch.column("extensions").to_pylist()
        n = np.array([len(x) // 8 for x in ext])
        keys = np.frombuffer(b"".join(ext), np.int64)
        group = np.concatenate(([0], np.cumsum(meet[1:] != meet[:-1])))
        if meet[0] != at:
            seen = seen[:0]
        keys = np.concatenate([seen, keys])
        of = np.concatenate([np.zeros(len(seen), np.int64), np.repeat(group, n)])
        order = np.lexsort((keys, of))  # stable: of equal ones the earliest stays in front
        fresh = np.zeros(len(keys), bool)
        fresh[order] = np.concatenate(([True], (keys[order][1:] != keys[order][:-1]) | (of[order][1:] != of[order][:-1])))
        at, seen = meet[-1], keys[fresh & (of == group[-1])]
        fresh = fresh[len(fresh) - n.sum() :]
        bit = ranges(np.zeros(len(n), np.int64), n)
        mask = np.bincount(np.repeat(np.arange(len(n)), n), fresh * (1 << bit), len(n)).astype(np.int64)
        place = batch.column("place").to_numpy() >> 4
        some = mask > 0
        yield pa.RecordBatch.from_arrays([batch.column("row_no").filter(pa.array(some)), pa.array((place | mask << 48)[some])], names=["row_no", "firsts"])


def first_windows(firsts: list[int] | None) -> np.ndarray:
    packed = np.array(firsts or [], np.int64)
    starts, mask = packed & (1 << 48) - 1, packed >> 48
    return np.concatenate([starts[(mask >> d) & 1 > 0] + d for d in range(15)])


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for w, seeds, firsts in zip(_unpacked(batch), batch.column("seeds").to_pylist(), batch.column("firsts").to_pylist(), strict=True):
                _, first, count = unpacked_seeds(seeds)
                repeats = np.setdiff1d(ranges(first, count), first_windows(firsts))
                gone = covered(repeats, len(w), window)
                edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
                digest = hashlib.sha256(b" ".join([x for x, g in zip(w, gone.tolist(), strict=True) if not g])).hexdigest()
                out.append((int(gone.sum()), digest, edge.reshape(-1, 2).tolist()))
            n, digests, spans = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_no"), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(spans, pa.list_(pa.list_(pa.int32())))], names=["row_no", "n_removed", "kept_sha256", "spans"]
            )

    return run


def seeded(rows: DataFrame, window: int, gram: int, hot: int) -> tuple[DataFrame, np.ndarray]:
    """Documents with their recurring anchors (stored), and the sorted hashes of the hot anchors."""
    scan = "row_no long, ord long, n_words long, f1 long, f2 long, all_sha256 string, n_anchors int, runs binary, hash binary"
    table = stored(rows.mapInArrow(_scan(window, gram), scan), "scan")
    first = table.where(F.col("n_words") >= window).groupBy("n_words", "f1", "f2").agg(F.min(F.struct(key("ord").alias("k"), "row_no")).alias("f"))
    first = stored(first.select(F.col("f.row_no").alias("row_no"), F.lit(True).alias("is_first")), "first")

    total = table.agg(F.sum("n_anchors")).first()[0] or 0
    least = max(hot, total // MOST_HOT)
    seeds = table.join(first.hint("merge"), "row_no", "left_semi").select("row_no", "n_anchors", "hash").mapInArrow(_anchor_rows, "hash long, row_no long, which int")
    counts = seeds.groupBy("hash").agg(F.count("*").alias("n"), F.min("row_no").alias("row_no"), F.min("which").alias("which"))
    # Lone anchors are told to their documents; the few hot ones to nobody, which makes one row more.
    alone = F.col("n") == 1
    answer = counts.where(alone | (F.col("n") > least)).groupBy(F.when(alone, F.col("row_no")).alias("row_no")).agg(F.collect_list(F.when(alone, F.col("which").cast("long")).otherwise(F.col("hash"))).alias("answer"))
    lite = table.drop("hash", "f1", "f2", "n_anchors").join(first.hint("merge"), "row_no", "left").withColumn("runs", F.when(F.col("is_first"), F.col("runs")))
    found = lite.join(answer.hint("merge"), "row_no", "full").mapInArrow(_recurring, "row_no long, ord long, n_words long, all_sha256 string, is_first boolean, n_windows long, seeds binary")
    found = stored(found, "seeded")
    discard(table, first)
    frequent = found.where("row_no is null").select("seeds").first()
    return found.where("row_no is not null"), np.sort(np.frombuffer(frequent[0] if frequent else b"", np.int64))


def repeated_passages(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Words of documents that a window of ``window`` words repeats from an earlier place.

    ``docs`` is a table with ``doc_id`` and ``text``; further columns, whatever their
    names, are left alone. Earlier means a smaller doc_id (null last), of repeated rows
    one nearer the table's start, or an earlier start in the same document. Returns one
    row per row: row_no, doc_id, n_words, n_removed, kept_sha256 and spans (word
    positions [start, end) of the maximal repeats). Null and empty texts have no words;
    texts under ``window`` words lose none; an empty table gives an empty result.
    ``hot`` only says which anchors are extended before the shuffle. An anchor's windows are
    counted in four bits: a window may be longer than ``gram`` by 14 words at most.
    """
    if not 0 <= window - gram < 15:
        raise ValueError("a window has as many words as an anchor, or up to 14 more")
    docs = in_files(docs)
    rows = located_texts(docs, F.col("doc_id").cast("long").alias("ord"))
    table, frequent = seeded(rows.select("row_no", "ord", "text"), window, gram, hot)

    packed = located_texts(docs).select("row_no", "text").mapInArrow(_packed, "row_no long, packed binary")
    seeds = table.where("n_windows > 0").select("row_no", "ord", "n_windows", "seeds")
    held = packed.join(seeds.hint("merge"), "row_no")
    met = held.mapInArrow(_extended(window, gram, docs.sparkSession.sparkContext.broadcast(frequent)), "meet long, ord long, row_no long, place long, extensions binary")
    met = met.repartition("meet").sortWithinPartitions("meet", F.asc_nulls_last("ord"), "row_no", "place").mapInArrow(_earliest, "row_no long, firsts long")
    firsts = stored(met.groupBy("row_no").agg(F.collect_list("firsts").alias("firsts"), F.sum(F.bit_count(F.shiftright("firsts", 48))).alias("n_firsts")), "firsts")

    repeats = seeds.join(firsts.hint("merge"), "row_no", "left").where("n_windows > coalesce(n_firsts, 0)").select("row_no", "seeds", "firsts")
    cut = packed.join(repeats.hint("merge"), "row_no").mapInArrow(_cut(window), "row_no long, n_removed long, kept_sha256 string, spans array<array<int>>")
    out = table.drop("seeds").join(cut.hint("merge"), "row_no", "left")
    copies = F.col("is_first").isNull() & (F.col("n_words") >= window)
    none = F.array().cast("array<array<int>>")
    whole = F.array(F.array(F.lit(0), F.col("n_words").cast("int")))
    return out.select(
        "row_no",
        F.col("ord").alias("doc_id"),
        "n_words",
        F.when(copies, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copies, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "all_sha256")).alias("kept_sha256"),
        F.when(copies, whole).otherwise(F.coalesce("spans", none)).alias("spans"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row_no", "spans")


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT doc_id, i, array_to_string(w[i + 1 : i + 20], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(greatest(0, len(w) - 19))) AS i FROM d)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM g),
x AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM r WHERE k > 1),
k AS (
  SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.j) AS kept, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS j FROM d) p ANTI JOIN x ON p.doc_id = x.doc_id AND p.j = x.j
  GROUP BY p.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, len(d.w) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
