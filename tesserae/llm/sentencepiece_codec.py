"""SentencePiece encoding and decoding by a table of distinct marked words.

If no piece of the vocabulary has a whitespace marker after another character, no
merge crosses into a marker, and a text's ids are those of its marked words put
together. So each distinct word is segmented once and the ids are joined back by
position; decoding joins the words' decoded texts in the same way.

Texts are taken in blocks of bounded size. A block sends each of its distinct words
once to the word's bucket, sorted and packed; the bucket segments every distinct word
once for all blocks and answers in the same order; the answers meet the block's texts,
which give the words their positions. A word of every document costs a bucket one
entry for each block, so frequent words need no care of their own.
"""

from __future__ import annotations

import hashlib
import json
import os
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import count
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_files, located_texts
from .word_table import MARK, WordTable, marked_words

#: UTF-8 bytes of text in a block, more with many buckets, within bounds; a longer text is a block of its own.
BLOCK = 8_000_000
FOR_EACH_BUCKET = 16_000
LARGEST = 32_000_000
#: Buckets of words for each shuffle partition; a task holds the table of one bucket at a time.
BUCKETS = 4
TEXTS = -1


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def processor(model: str):
    """The model's processor; each task loads it from its own copy of the vocabulary file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    if any(MARK in (p := sp.id_to_piece(i)).lstrip(MARK) or sp.is_control(i) and p.startswith(MARK) for i in range(sp.vocab_size())):
        raise ValueError(f"pieces of {os.path.basename(model)} cross whitespace markers")
    if sp.encode("a  b ") == sp.encode("a b") or sp.encode("a")[:1] != sp.encode(MARK + "a")[-1:]:
        raise ValueError(f"{os.path.basename(model)} changes white space or adds no marker in front")
    return sp


def plain(word: str) -> str:
    """What nearly every marked word decodes to."""
    return word[1:].replace(MARK, " ")


def segmented(model: str, words: list[str]) -> list[tuple[bytes, str | None]]:
    """For each marked word: its ids as little-endian 32-bit numbers, and its decoded text where that is not the plain one."""
    sp = processor(model)
    bare = [w[1:] for w in words]
    ids = sp.encode(bare, num_threads=1) if words else []
    # The library gives no ids for an empty text; a lone marker is a word within a text.
    ids = [x or [sp.piece_to_id(MARK)] for x in ids]
    texts = sp.decode(ids) if ids else []
    expected = "\0".join(bare).replace(MARK, " ")
    if expected == "\0".join(texts) and expected.count("\0") < max(1, len(words)):  # as nearly always, no odd text among them
        texts = [None] * len(words)
    return [(array("I", x).tobytes(), None if t is None or t == plain(w) else t) for w, x, t in zip(words, ids, texts, strict=True)]


def blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Consecutive rows with ``size`` bytes of text or a little more; the cuts depend on the rows alone."""
    held, total = [], 0
    for batch in batches:
        first = 0
        for i, n in enumerate(pc.binary_length(batch.column("text")).to_pylist(), 1):
            total += n
            if total >= size:
                yield pa.Table.from_batches([*held, batch.slice(first, i - first)])
                held, total, first = [], 0, i
        if first < batch.num_rows:
            held.append(batch.slice(first))
    if held:
        yield pa.Table.from_batches(held)


def dealt_words(words: Iterable[str], buckets: int) -> dict[int, list[str]]:
    """Distinct words dealt over buckets, in order within each."""
    held = list(words)
    at = np.fromiter(map(crc32, map(str.encode, held)), np.uint32, len(held)) % buckets
    order = np.argsort(at, kind="stable")
    ends = np.flatnonzero(np.diff(at[order], prepend=-1, append=-1))
    return {int(at[order[lo]]): sorted(map(held.__getitem__, order[lo:hi].tolist())) for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)}


def words_by_bucket(rows: pa.Table, buckets: int) -> dict[int, list[str]]:
    """The distinct marked words of a block in order, dealt over buckets."""
    words: set[str] = set()
    for text in rows.column("text"):
        words.update(marked_words(text.as_py()))
    return dealt_words(words, buckets)


def _named(rows: pa.Table) -> tuple[int, int]:
    return rows["row_no"][0].as_py(), rows["row_no"][-1].as_py()


def _packed(block: tuple[int, int], bucket: list[int], **binary: list[bytes]) -> pa.RecordBatch:
    first, last = (pa.array([x] * len(bucket), pa.int64()) for x in block)
    return pa.RecordBatch.from_arrays([first, last, pa.array(bucket, pa.int32()), *(pa.array(x, pa.binary()) for x in binary.values())], names=["block", "last", "bucket", *binary])


def _distinct(size: int, buckets: int):
    """Each block's distinct words, a row for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor().compress
        for rows in blocks(batches, size):
            dealt = words_by_bucket(rows, buckets)
            # No marked word has a space in it.
            yield _packed(_named(rows), list(dealt), words=[pack(" ".join(w).encode()) for w in dealt.values()])

    return run


def _segment(model: str):
    """Answers each row of words, bucket after bucket, by their ids end to end, the numbers of ids, and odd decoded texts by index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, unpack = zstandard.ZstdCompressor().compress, zstandard.ZstdDecompressor().decompress
        at, known = None, WordTable({}, lambda words: segmented(model, words))
        for batch in batches:
            for block, last, bucket, packed in zip(*(batch.column(c).to_pylist() for c in ("block", "last", "bucket", "words")), strict=True):
                if bucket != at:
                    known.clear()
                    at = bucket
                words = unpack(packed).decode().split(" ")
                known.learn(set(words))
                ids, texts = zip(*map(known.__getitem__, words), strict=True)
                counts = np.array([len(x) // 4 for x in ids], "<u4")
                flat = np.frombuffer(b"".join(ids), "<u4")
                flat = flat.astype("<u2") if not len(flat) or flat.max() < 1 << 16 else flat
                odd = {i: t for i, t in enumerate(texts) if t is not None}
                yield _packed((block, last), [bucket], ids=[flat.dtype.str.encode() + pack(flat.tobytes())], counts=[pack(counts.tobytes())], odd=[json.dumps(odd).encode() if odd else None])

    return run


def _texts(size: int):
    """Each block's rows as one packed row, to meet the answers to its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in blocks(batches, size):
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_table(rows.combine_chunks())
            yield _packed(_named(rows), [TEXTS], ids=[out.getvalue().to_pybytes()], counts=[None], odd=[None])

    return run


def joined(strings: pa.Array, counts: np.ndarray) -> pa.Array:
    """So many consecutive strings each, joined by commas."""
    ends = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), strings), pa.scalar(",", pa.large_string()))


class _Block:
    """A block's texts as numbers of its distinct words, and what is known of these: the ids as decimals, their number, odd decoded texts."""

    def __init__(self, rows: pa.Table, buckets: int):
        self.rows = rows
        self.number: dict[str, int] = defaultdict(count().__next__)
        self.texts = [array("I", map(self.number.__getitem__, marked_words(t.as_py()))) for t in rows.column("text")]
        self.waiting = dealt_words(self.number, buckets)
        self.known: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []
        self.odd: dict[int, str] = {}

    def learn(self, bucket: int, flat: np.ndarray, counts: np.ndarray, odd: dict[int, str]) -> None:
        """Ids of a bucket's words end to end, their numbers, and odd decoded texts by index."""
        at = np.fromiter(map(self.number.__getitem__, self.waiting.pop(bucket)), np.int64, len(counts))
        self.known.append((at, joined(pa.array(flat).cast(pa.large_string()), counts), counts))
        self.odd.update((int(at[i]), text) for i, text in odd.items())

    def answered(self, bucket: int, ids: bytes, counts: bytes, odd: bytes | None) -> None:
        unpack = zstandard.ZstdDecompressor().decompress
        flat = np.frombuffer(unpack(ids[3:]), ids[:3].decode())
        self.learn(bucket, flat, np.frombuffer(unpack(counts), "<u4"), {int(i): t for i, t in json.loads(odd).items()} if odd else {})

    def segmented(self, model: str) -> None:
        """The words of the buckets that gave no answer."""
        for bucket, words in list(self.waiting.items()):
            ids, texts = zip(*segmented(model, words), strict=True)
            self.learn(bucket, np.frombuffer(b"".join(ids), "<u4"), np.array([len(x) // 4 for x in ids], "<u4"), {i: t for i, t in enumerate(texts) if t is not None})

    def decoded(self, text: str, numbers: array) -> str:
        """Plain words joined by one space are the text itself, with spaces for markers."""
        if not self.odd or self.odd.keys().isdisjoint(numbers):
            return text.replace(MARK, " ")
        return " ".join(plain(w) if (t := self.odd.get(n)) is None else t for w, n in zip(marked_words(text), numbers, strict=True))

    def encoded(self, digests: bool) -> Iterator[pa.RecordBatch]:
        number = np.concatenate([k[0] for k in self.known] or [np.empty(0, np.int64)])
        place = np.empty(len(number), np.int64)
        place[number] = np.arange(len(number))
        decimals = pa.concat_arrays([k[1] for k in self.known] or [pa.array([], pa.large_string())])
        sizes = np.concatenate([k[2] for k in self.known] or [np.empty(0, "<u4")]).astype(np.int64)
        first = 0
        for batch in self.rows.to_batches(max_chunksize=1000):
            texts = self.texts[first : first + batch.num_rows]
            first += batch.num_rows
            at = place[np.frombuffer(b"".join(texts), np.uint32)]
            lengths = np.array([len(t) for t in texts], np.int64)
            ids = joined(decimals.take(pa.array(at)), lengths)
            counts = np.diff(np.concatenate([[0], np.cumsum(sizes[at])])[np.concatenate([[0], np.cumsum(lengths)])])
            decoded = [self.decoded(t, n) for t, n in zip(batch.column("text").to_pylist(), texts, strict=True)]
            if digests:
                ids, decoded = ([hashlib.sha256(x.encode()).hexdigest() for x in column] for column in (ids.to_pylist(), decoded))
            ids = pa.array(ids, pa.string()) if digests else ids.cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("row_no"), batch.column("doc_id"), pa.array(counts, pa.int64()), ids, pa.array(decoded, pa.string())], names=["row_no", "doc_id", "n_tokens", "ids", "decoded"])


def _join(model: str, buckets: int, digests: bool):
    """Blocks in order, each with its texts first and then the answers of all buckets that have words of it."""

    def finished(held: _Block) -> Iterator[pa.RecordBatch]:
        held.segmented(model)
        yield from held.encoded(digests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                block, last, bucket, ids, counts, odd = (batch.column(c)[i].as_py() for c in ("block", "last", "bucket", "ids", "counts", "odd"))
                if bucket == TEXTS:
                    if held is not None:
                        yield from finished(held)
                    held, at = _Block(pa.ipc.open_stream(ids).read_all(), buckets), (block, last)
                elif held is not None and (block, last) == at and bucket in held.waiting:
                    held.answered(bucket, ids, counts, odd)
                if held is not None and not held.waiting:
                    yield from finished(held)
                    held = None
        if held is not None:
            yield from finished(held)

    return run


def encoded(docs: DataFrame, model: str | None = None, block: int | None = None, buckets: int | None = None, digests: bool = False) -> DataFrame:
    """Ids and decoded text of every document, as the sentencepiece library gives them.

    One row per row of ``docs``, repeated ones too: row_no, doc_id, n_tokens, ids (decimals
    joined by commas) and decoded; with ``digests`` the SHA-256 of the two in hex, so that
    the texts leave no task. Null and empty texts have no ids and decode to the empty text;
    an empty table gives an empty result; further columns are left alone. ``block`` bounds
    the text that a task holds, ``buckets`` divides the distinct words.
    """
    model = model or default_model()
    processor(model)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = buckets or BUCKETS * parts
    block = block or min(LARGEST, max(BLOCK, FOR_EACH_BUCKET * buckets))
    texts = located_texts(in_files(docs)).withColumn("doc_id", F.col("doc_id").cast("long")).select("row_no", "doc_id", "text")
    packed = "block long, last long, bucket int, ids binary, counts binary, odd binary"
    words = texts.mapInArrow(_distinct(block, buckets), "block long, last long, bucket int, words binary")
    answers = words.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_segment(model), packed)
    both = answers.union(texts.mapInArrow(_texts(block), packed))
    return both.repartition(parts, "block", "last").sortWithinPartitions("block", "last", "bucket").mapInArrow(_join(model, buckets, digests), "row_no long, doc_id long, n_tokens long, ids string, decoded string")


def digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of ``encoded``, one row per row; null and empty texts have no ids."""
    out = encoded(docs, model, digests=True)
    return out.select("doc_id", "n_tokens", F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
