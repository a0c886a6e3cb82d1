"""Tables of distinct marked words, shared by the tokenising operators.

A marked word is a run of whitespace markers with what follows it up to the next
marker. The frequent ones are counted over all documents, worked out once for the
whole corpus and sent to every task; their number and length are bounded, so is
their size. A task works out each further word once, in a table of its own.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

MARK = "▁"
#: Frequent words that go to every task, and their greatest length: at most 100,000 x 48 code points.
FREQUENT = 100_000
LONGEST = 48
#: Words that a task remembers or counts at once.
KNOWN = 300_000

_words = re.compile(f"{MARK}+[^{MARK}]*").findall


def marked_words(text: str) -> list[str]:
    """The text's marked words in order, with the marker that a tokenizer puts in front."""
    return _words(MARK + text.replace(" ", MARK)) if text else []


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[str] = Counter()

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])

    for batch in batches:
        for text in batch.column("text"):
            seen.update(x for x in marked_words(text.as_py()) if len(x) <= LONGEST)
            if len(seen) >= KNOWN:
                yield rows()
                seen.clear()
    yield rows()


def frequent_words(texts: DataFrame, most: int = FREQUENT) -> DataFrame:
    """The most frequent marked words, at most ``most``: word, n. Counted in the tasks before the shuffle.

    Words go in by whole classes of like frequency, so the choice needs a small histogram and no global sort.
    """
    counts = texts.select("text").mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    level = F.floor(F.log2("n") * 64).cast("int").alias("level")  # at most 64 x 63 levels, whatever the corpus
    counts = stored(counts.where("n > 1").select("word", "n", level), "words")
    least, total = None, 0
    for r in sorted(counts.groupBy("level").count().collect(), reverse=True):
        total += r["count"]
        if total > most:
            break
        least = r["level"]
    return counts.where(F.lit(False) if least is None else F.col("level") >= least).select("word", "n")


class WordTable(dict):
    """Word to value: the frequent ones as given, the others worked out once while they are remembered."""

    def __init__(self, frequent: dict, work_out: Callable[[list[str]], list], most: int = KNOWN):
        super().__init__(frequent)
        self.frequent, self.work_out, self.most = frequent, work_out, most + len(frequent)

    def learn(self, words: set[str]) -> None:
        new = sorted(words.difference(self))
        if len(self) + len(new) > self.most:
            self.clear()
            self.update(self.frequent)
            new = sorted(words.difference(self))
        self.update(zip(new, self.work_out(new), strict=True))


def by_parts(batch: pa.RecordBatch, words: int = 200_000) -> Iterator[tuple[int, list[list[str]]]]:
    """The marked words of a batch's texts, a bounded number at once: first row and its texts' words."""
    first, held, size = 0, [], 0
    for i, text in enumerate(batch.column("text")):
        held.append(marked_words(text.as_py()))
        size += len(held[-1])
        if size >= words:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held
