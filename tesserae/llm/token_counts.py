"""Unigram token counts by dynamic programming over a trie of distinct pre-tokens.

Distinct pre-tokens are inserted in a trie. A node is a prefix; level by level, the
forward score of its best segmentation into pieces is worked out from its ancestors'
and kept with the number of its pieces, once for all pre-tokens that share it.
The frequent words of the corpus are dealt by ranges of the sorted words, that is by
subtrees. Each task makes tries of the other words that it meets, of many at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from operator import lt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered
from .sentencepiece_codec import default_model
from .word_table import FREQUENT, WordTable, by_parts, frequent_words


#: Nodes of a task's trie.
NODES = 1_000_000
#: Code points of the longest words that enter it level by level.
DEEP = 64
#: A bit that the keys of all states have.
TAKEN = np.uint64(1 << 63)


@lru_cache(maxsize=2)
def piece_scores(model: str) -> tuple[dict[str, float], int, float]:
    """Unigram scores of a vocabulary file's pieces, their greatest length, the score of an unknown character.

    The file ranks its pieces; rank r gets the log-probability -ln(r + 2) of Zipf's law.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    plain = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    ranked = sorted(plain, key=lambda i: (-sp.get_score(i), i))
    scores = {sp.id_to_piece(i): -math.log(r + 2) for r, i in enumerate(ranked)}
    return scores, max(map(len, scores)), -math.log(len(ranked) + 2) - 10


class Pieces:
    """The pieces' own trie as arrays: what state a character leads to from another, and what a state is worth as a whole piece."""

    def __init__(self, scores: dict[str, float]):
        states: dict[int, int] = {}
        worth = [-math.inf]
        for piece, score in scores.items():
            at = 0
            for char in piece:
                at = states.setdefault(at << 21 | ord(char), len(worth))
                if at == len(worth):
                    worth.append(-math.inf)
            if at:
                worth[at] = score
        self.worth = np.array(worth)
        self.bits = max(4, (2 * len(states)).bit_length())
        # Open addressing; no key is 0, as a NUL that begins a piece is set apart by the bit above all states.
        self.keys, self.to = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        keys, to = np.fromiter(states.keys(), np.uint64, len(states)) | TAKEN, np.fromiter(states.values(), np.int64, len(states))
        slots = self._slots(keys)
        while len(keys):
            first = np.zeros(len(keys), bool)
            first[np.unique(slots, return_index=True)[1]] = True
            first &= self.keys[slots] == 0
            self.keys[slots[first]], self.to[slots[first]] = keys[first], to[first]
            keys, to, slots = keys[~first], to[~first], (slots[~first] + 1) & ((1 << self.bits) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def after(self, states: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The states that the characters lead to; 0 where no piece goes on so."""
        keys = (states.astype(np.uint64) << np.uint64(21)) | chars | TAKEN
        slots = self._slots(keys)
        held = self.keys[slots]
        out = np.where(held == keys, self.to[slots], 0)
        left = np.flatnonzero((held != keys) & (held != 0))
        while len(left):
            slots[left] = (slots[left] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slots[left]]
            hit = held == keys[left]
            out[left[hit]] = self.to[slots[left[hit]]]
            left = left[~hit & (held != 0)]
        return out


class Trie:
    """Prefixes of a call's words, each with its forward score and number of pieces, worked out for a whole level of the trie at once.

    A node scores when the levels above it do; it then follows the pieces that begin at it down the trie, as far as
    one goes. Words of over ``DEEP`` code points are gone along one by one, each from where it parts with the one before.
    No more than ``most`` nodes are held at once, unless one word has more. An unknown character counts its UTF-8 bytes. Of
    equal scores the one with the longest last piece is taken.
    """

    def __init__(self, scores: dict[str, float], longest: int, unknown: float, most: int = NODES):
        self.scores, self.longest, self.unknown, self.most = scores, longest, unknown, most
        self.known = Pieces(scores)
        self.best = np.zeros(1)
        self.endings: dict[str, list[int]] = {}
        for piece in sorted(scores, key=len, reverse=True):
            if len(piece) > 2 and len(piece) not in (known := self.endings.setdefault(piece[-3:], []))[-1:]:
                known.append(len(piece))

    def counts(self, words: list[str]) -> list[int]:
        """The number of pieces of each word's best segmentation, as its last node says."""
        if not all(map(lt, words, words[1:])):
            found = sorted(set(words))
            return list(map(dict(zip(found, self.counts(found), strict=True)).__getitem__, words))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        out, deep = np.zeros(len(words), np.int64), sizes > DEEP
        if deep.any():
            out[deep] = self._along([words[i] for i in np.flatnonzero(deep)])
        flat = np.flatnonzero(~deep)
        upto = np.cumsum(sizes[flat])
        first = 0
        while first < len(flat):
            last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + self.most - 1, "right")))
            mine = flat[first:last]
            out[mine] = self._by_levels([words[i] for i in mine], sizes[mine])
            first = last
        return out.tolist()

    def _by_levels(self, words: list[str], sizes: np.ndarray) -> np.ndarray:
        """Counts of sorted, different words."""
        out, deepest = np.zeros(len(words), np.int64), int(sizes.max())
        if not deepest:
            return out
        chars = np.array(words, f"U{deepest}").view(np.uint32).reshape(len(words), deepest)
        shared = np.zeros(len(words), np.int64)
        apart = chars[1:] != chars[:-1]
        shared[1:] = np.minimum(np.where(apart.any(1), apart.argmax(1), deepest), np.minimum(sizes[1:], sizes[:-1]))
        # Of each level: a node's character, its parent on the level above, and where a node's children begin on the level below.
        char, parent, children, last = [np.zeros(1, np.uint32)], [np.zeros(1, np.int64)], [], []
        node = np.zeros(len(words), np.int64)
        for level in range(1, deepest + 1):
            new = (shared < level) & (sizes >= level)
            char.append(chars[new, level - 1])
            parent.append(node[new])
            children.append(np.searchsorted(parent[-1], np.arange(len(char[-2]) + 1)))
            node = np.cumsum(new) - 1
            ends = np.flatnonzero(sizes == level)
            last.append((ends, node[ends]))
        best = [np.zeros(1)] + [np.full(len(c), -np.inf) for c in char[1:]]
        pieces = [np.zeros(len(c), np.int64) for c in char]
        for level in range(deepest + 1):
            if level:
                lost = np.flatnonzero(best[level] == -np.inf)
                c, up = char[level][lost], parent[level][lost]
                best[level][lost] = best[level - 1][up] + self.unknown
                pieces[level][lost] = pieces[level - 1][up] + 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
                ends, at = last[level - 1]
                out[ends] = pieces[level][at]
            here = begun = np.arange(len(best[level]))
            state = np.zeros(len(here), np.int64)
            for below in range(level + 1, min(level + self.longest, deepest) + 1):
                low = children[below - 1][here]
                n = children[below - 1][here + 1] - low
                many = np.repeat(np.arange(len(here)), n)
                here = np.arange(len(many)) + (low - np.cumsum(n) + n)[many]
                state = self.known.after(state[many], char[below][here])
                on = np.flatnonzero(state)
                here, begun, state = here[on], begun[many[on]], state[on]
                if not len(on):
                    break
                # Longer last pieces begin on higher levels and come first, so that an equal one changes nothing.
                score = best[level][begun] + self.known.worth[state]
                better = np.flatnonzero(score > best[below][here])
                best[below][here[better]] = score[better]
                pieces[below][here[better]] = pieces[level][begun[better]] + 1
        self.best = np.concatenate(best)
        return out

    def _along(self, words: list[str]) -> list[int]:
        """Counts of sorted words by the nodes of one path."""
        out, before, best, pieces, get = [], "", [0.0], [0], self.scores.get
        for word in words:
            shared = 0
            for a, b in zip(before, word, strict=False):
                if a != b:
                    break
                shared += 1
            del best[shared + 1 :], pieces[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                top, n = -math.inf, 0
                last = word[max(0, end - 3) : end]
                for size in (*self.endings.get(last, ()), 2, 1):
                    if size > end:
                        continue
                    s = get(word[end - size : end])
                    if s is not None and (t := best[end - size] + s) > top:
                        top, n = t, pieces[end - size] + 1
                if top == -math.inf:
                    top, n = best[-1] + self.unknown, pieces[-1] + len(word[end - 1].encode())
                best.append(top)
                pieces.append(n)
            out.append(pieces[-1])
            before = word
        return out


@lru_cache(maxsize=2)
def default_trie(model: str) -> Trie:
    """The trie of a vocabulary file, made once for the tasks of a worker."""
    return Trie(*piece_scores(model))


def counted(words: list[str], scores: dict[str, float], longest: int, unknown: float) -> list[int]:
    """Pieces in the best segmentation of each word."""
    return Trie(scores, longest, unknown).counts(words)


def _count_words(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = default_trie(model)
        for batch in batches:
            words = batch.column("word").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(trie.counts(words), pa.int64())], names=["word", "tokens"])

    return run


def _count_texts(model: str, table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordTable(table.value, default_trie(model).counts)
        for batch in batches:
            for first, texts in by_parts(batch):
                known.learn(set().union(*texts))
                rows = batch.slice(first, len(texts))
                sums = [sum(map(known.__getitem__, words)) for words in texts]
                yield pa.RecordBatch.from_arrays([rows.column("row_no"), rows.column("doc_id"), pa.array([len(w) for w in texts], pa.int64()), pa.array(sums, pa.int64())], names=["row_no", "doc_id", "n_words", "n_tokens"])

    return run


def token_counts(docs: DataFrame, model: str | None = None, frequent: int = FREQUENT) -> DataFrame:
    """Unigram tokens of every document: row_no, doc_id, n_words (marked words), n_tokens.

    One row per row of ``docs``, repeated ones too; null and empty texts count 0; an empty
    table gives an empty result; further columns are left alone. Tries and tables that
    forget when full only work words out again: counts do not depend on their bounds.
    """
    model = model or default_model()
    texts = numbered(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    # Range partitions of the sorted words are subtrees of the trie.
    common = frequent_words(texts, frequent).repartitionByRange(8, "word").sortWithinPartitions("word")
    table = {r["word"]: r["tokens"] for r in common.mapInArrow(_count_words(model), "word string, tokens long").toLocalIterator()}
    known = docs.sparkSession.sparkContext.broadcast(table)
    return texts.mapInArrow(_count_texts(model, known), "row_no long, doc_id long, n_words long, n_tokens long")


def query(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row_no")
