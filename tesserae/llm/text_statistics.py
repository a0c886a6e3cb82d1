"""Counts of a whole text that quality rules rest on."""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np

from tesserae.llm.common import U64, grams, mixed
from tesserae.llm.periodic_runs import Numbers

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
NO_SYMBOL = bytes(b for b in range(256) if b not in SYMBOLS)
#: Bytes that go on with a code point of UTF-8.
FOLLOWING = bytes(range(0x80, 0xC0))
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD = re.compile(rb"[^\x20\x09-\x0D]")


class Counts(NamedTuple):
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of ``WINDOW`` words that the text has twice or more; hashes propose, words decide."""
    count = len(words) - WINDOW + 1
    if count < 2 or len(set(words)) == len(words):
        return 0
    t = np.fromiter(map(Numbers().__getitem__, words), np.int64, len(words))
    h = grams(mixed(t.astype(U64)), WINDOW)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    a, b = order[:-1][same], order[1:][same]
    places = np.arange(WINDOW)
    if (t[a[:, None] + places] == t[b[:, None] + places]).all():
        starts = np.zeros(count, bool)
        starts[a] = starts[b] = True
    else:  # two windows share a hash: compare the windows themselves
        windows = np.lib.stride_tricks.sliding_window_view(t, WINDOW)
        _, at, n = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
        starts = n[at.ravel()] > 1
    held = np.zeros(len(words) + 1, np.int64)
    first = np.flatnonzero(starts)
    held[first] += 1
    held[first + WINDOW] -= 1
    return int((np.cumsum(held[:-1]) > 0).sum())


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    if b"\n" not in text:
        return 0
    lines = [line for line in text.split(b"\n") if line.strip(SPACE)]
    return len(lines) - len(set(lines))


def counts(text: bytes) -> Counts:
    words = text.split()
    chars = len(text.translate(None, SPACE + FOLLOWING))
    return Counts(len(words), chars, len(text.translate(None, NO_SYMBOL)), repeated_lines(text), repeated_words(words))
