"""Exact deduplication by composable polynomial fingerprints.

The fingerprint of a byte string s is (|s|, H1(s), H2(s)), where
H(s) = sum s[i] * B^(|s|-1-i) modulo a prime. It composes: H(ab) = H(a) * B^|b| + H(b).
A long text is therefore cut into chunks whose hashes are computed in separate
tasks, each already shifted by the length that follows it, and summed.

Equal fingerprints only nominate texts: all members of such a group are compared
with a leader, chunk by chunk, as sorted streams that hold one chunk at a time.
Large groups are dealt over salts first, and the salts' leaders compared after.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_files, key, located_texts, rows_kept, stored

CHUNK = 1 << 16
SALTS = 64
PRIMES = (2147483647, 2147483629)
BASES = (1000003, 998244353)
PRINT = ["size", "h1", "h2"]
IDS = ["row_no", "doc_id", "n_points"]
#: The white space that two equal texts may differ in.
SPACE = b" \t\n\x0b\x0c\r"


@lru_cache(maxsize=4)
def _powers(chunk: int) -> list[np.ndarray]:
    out = []
    for p, b in zip(PRIMES, BASES, strict=True):
        w = np.empty(chunk, np.uint64)
        x = 1
        for i in range(chunk - 1, -1, -1):
            w[i] = x
            x = x * b % p
        out.append(w)
    return out


def chunk_hash(data: bytes, weights: list[np.ndarray]) -> list[int]:
    """The hash of one chunk under both moduli; a chunk is short enough that sums stay below 2^64."""
    a = np.frombuffer(data, np.uint8).astype(np.uint64)
    return [int((a * w[len(w) - len(a) :]).sum() % np.uint64(p)) if len(a) else 0 for w, p in zip(weights, PRIMES, strict=True)]


def combine(left: tuple[int, int, int], right: tuple[int, int, int]) -> tuple[int, int, int]:
    """Fingerprint (size, h1, h2) of two strings put together."""
    hs = [(a * pow(b, right[0], p) + c) % p for a, c, b, p in zip(left[1:], right[1:], BASES, PRIMES, strict=True)]
    return left[0] + right[0], hs[0], hs[1]


def fingerprint(data: bytes, chunk: int = CHUNK) -> tuple[int, int, int]:
    weights = _powers(chunk)
    data = _normal(data)
    total = (0, 0, 0)
    for i in range(0, len(data), chunk):
        piece = data[i : i + chunk]
        total = combine(total, (len(piece), *chunk_hash(piece, weights)))
    return total


def _normal(data: bytes) -> bytes:
    return data.translate(None, SPACE)


def _hash_texts(chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = _powers(chunk)
        for batch in batches:
            out = []
            for text in batch.column("text").cast(pa.binary()):
                data = _normal(text.as_py())
                out.append((hashlib.sha256(data).hexdigest(), len(data), *chunk_hash(data, weights)))
            cols = list(zip(*out, strict=True)) if out else [()] * 4
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in IDS), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[*IDS, "text_sha256", *PRINT]
            )

    return run


def _hash_chunks(chunk: int):
    """Of each chunk: its length without white space, its hashes, and the powers that shift what precedes it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = _powers(chunk)
        for batch in batches:
            out = []
            for piece in batch.column("piece"):
                data = _normal(piece.as_py())
                out.append((len(data), *chunk_hash(data, weights), *(pow(b, len(data), p) for b, p in zip(BASES, PRIMES, strict=True))))
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            names = ["n", "a1", "a2", "p1", "p2"]
            yield pa.RecordBatch.from_arrays([batch.column("row_no"), batch.column("k"), *(pa.array(c, pa.int64()) for c in cols)], names=["row_no", "k", *names])

    return run


def _composed(h: str, power: str, prime: int):
    """H(ab) = H(a) * B^|b| + H(b) over the chunks in order; products stay below 2^63."""
    p = F.lit(prime).cast("long")
    return F.aggregate("chunks", F.lit(0).cast("long"), lambda x, c: F.pmod(x * c[power] + c[h], p))


def fingerprints(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per document: row_no, doc_id, n_points, text_sha256, size, h1, h2 (a stored table)."""
    base = located_texts(docs).select("row_no", F.col("doc_id").cast("long").alias("doc_id"), F.length("text").alias("n_points"), "text")
    raw = F.octet_length("text")
    schema = "row_no long, doc_id long, n_points int, text_sha256 string, size long, h1 long, h2 long"
    short = base.where(raw <= chunk).mapInArrow(_hash_texts(chunk), schema)
    # Huge documents: every chunk is a row of its own, dealt to any task; their hashes compose.
    huge = base.where(raw > chunk).withColumn("data", F.encode("text", "UTF-8"))
    pieces = F.transform(F.sequence(F.lit(0), F.ceil(F.octet_length("data") / chunk).cast("int") - 1), lambda k: F.struct(k.alias("k"), F.call_function("substring", F.col("data"), k * chunk + 1, F.lit(chunk)).alias("piece")))
    parts = huge.select("row_no", F.inline(pieces)).repartition("row_no", "k").mapInArrow(_hash_chunks(chunk), "row_no long, k int, n long, a1 long, a2 long, p1 long, p2 long")
    parts = parts.groupBy("row_no").agg(F.array_sort(F.collect_list(F.struct("k", "n", "a1", "a2", "p1", "p2"))).alias("chunks"))
    parts = parts.select("row_no", F.aggregate("chunks", F.lit(0).cast("long"), lambda x, c: x + c["n"]).alias("size"), _composed("a1", "p1", PRIMES[0]).alias("h1"), _composed("a2", "p2", PRIMES[1]).alias("h2"))
    whole = huge.select(*IDS, F.sha2(F.encode(F.translate("text", SPACE.decode(), ""), "UTF-8"), 256).alias("text_sha256"))
    return stored(short.unionByName(whole.join(parts, "row_no")), "fingerprints")


def _chunks(chunk: int):
    """A text without white space as rows of at most ``chunk`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ks, pieces, size = [], [], [], 0
            for i, text in enumerate(batch.column("text").cast(pa.binary())):
                data = _normal(text.as_py())
                for k in range(max(1, -(-len(data) // chunk))):
                    rows.append(i)
                    ks.append(k)
                    pieces.append(data[k * chunk : (k + 1) * chunk])
                    size += len(pieces[-1])
                if size >= 8 << 20 or i + 1 == len(batch):
                    ids = batch.select(["row_no", *PRINT]).take(pa.array(rows, pa.int64()))
                    yield pa.RecordBatch.from_arrays([*ids.columns, pa.array(ks, pa.int32()), pa.array(pieces, pa.binary())], names=["row_no", *PRINT, "k", "piece"])
                    rows, ks, pieces, size = [], [], [], 0

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by fingerprint, salt, chunk and row: each chunk against that of the first row."""
    at, leader, piece = None, None, None
    for batch in batches:
        out = []
        places = zip(*(batch.column(c).to_pylist() for c in [*PRINT, "salt", "k"]), strict=True)
        for place, row, data in zip(places, batch.column("row_no").to_pylist(), batch.column("piece"), strict=True):
            data = data.as_py()
            if place != at:
                at, leader, piece = place, row, data
            out.append((row, leader, data != piece))
        rows, leaders, differs = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(leaders, pa.int64()), pa.array(differs, pa.bool_())], names=["row_no", "leader", "differs"])


def _compared(pieces: DataFrame, salts: int) -> DataFrame:
    """row_no, leader and whether the two texts differ anywhere, for the texts of ``pieces``."""
    rows = pieces.withColumn("salt", F.pmod(F.xxhash64("row_no"), F.lit(salts)).cast("int"))
    dealt = rows.repartition(*PRINT, "salt", "k").sortWithinPartitions(*PRINT, "salt", "k", "row_no")
    out = dealt.mapInArrow(_compare, "row_no long, leader long, differs boolean")
    return out.groupBy("row_no").agg(F.min("leader").alias("leader"), F.max("differs").alias("differs"))


def text_classes(docs: DataFrame, prints: DataFrame, chunk: int = CHUNK, salts: int = SALTS) -> DataFrame | None:
    """Rows whose text differs from others of the same fingerprint: row_no, part (1, 2, ...).

    None if, as is all but certain, no two different texts share a fingerprint.
    """
    shared = prints.groupBy(*PRINT).agg(F.count("*").alias("n")).where("n > 1").select(*PRINT)
    rows = prints.join(shared, PRINT, "left_semi").select("row_no", *PRINT)
    texts = located_texts(docs).select("row_no", "text").join(rows.hint("merge"), "row_no")
    pieces = stored(texts.mapInArrow(_chunks(chunk), "row_no long, size long, h1 long, h2 long, k int, piece binary"), "pieces")
    found, part = None, 0
    while True:
        first = stored(_compared(pieces, salts), "compared")
        leaders = first.select(F.col("leader").alias("row_no")).distinct()
        second = stored(_compared(pieces.join(leaders, "row_no", "left_semi"), 1), "leaders")
        bad = first.where("differs").select("row_no").unionByName(
            first.join(second.where("differs").select(F.col("row_no").alias("leader")), "leader", "left_semi").select("row_no")
        ).distinct()
        if bad.isEmpty():
            return found
        part += 1
        bad = stored(bad, "unequal")
        pieces = pieces.join(bad, "row_no", "left_semi")
        now = bad.select("row_no", F.lit(part).alias("part"))
        found = now if found is None else stored(found.join(now.select("row_no"), "row_no", "left_anti").unionByName(now), "parts")


def exact_groups(docs: DataFrame, chunk: int = CHUNK, salts: int = SALTS) -> DataFrame:
    """Groups of documents whose texts are equal apart from white space.

    ``docs`` is a table read from files with ``doc_id`` and ``text``; further columns
    are left alone. Returns one row per input row: row_no, doc_id, keep_id,
    group_size, kept, text_sha256.

    Kept is the row with the most code points in its original text, then the
    smallest doc_id (null last), then the first in the table: of repeated rows just
    one. Null texts count as empty; empty texts are equal to each other; an empty
    table gives an empty result.
    """
    docs = in_files(docs)
    prints = fingerprints(docs, chunk)
    parts = text_classes(docs, prints, chunk, salts)
    rows = prints.withColumn("part", F.lit(0)) if parts is None else prints.join(parts, "row_no", "left").fillna({"part": 0})
    by = [*PRINT, "part"]
    best = F.min(F.struct((-F.col("n_points")).alias("n"), key().alias("id"), F.col("row_no").alias("row"))).alias("best")
    # From a stored table the join reads both sides through exchanges of its own, which lets Spark split the rows of a hot group.
    groups = stored(rows.groupBy(*by).agg(F.count("*").alias("group_size"), best), "groups")
    return rows.join(groups, by).select(
        "row_no",
        "doc_id",
        F.col("best.id.doc_id").alias("keep_id"),
        "group_size",
        (F.col("best.row") == F.col("row_no")).alias("kept"),
        "text_sha256",
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they were."""
    docs = in_files(docs)
    return rows_kept(docs, exact_groups(docs).where("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row_no")


SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
k AS (
  SELECT norm, first(doc_id ORDER BY n DESC, doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, k.keep_id, k.group_size, t.doc_id = k.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN k USING (norm)
"""
