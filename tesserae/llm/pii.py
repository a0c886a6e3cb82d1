"""Personal data with offset-preserving deobfuscation.

Base identifiers are found in the text as it is. Then transducers rewrite it:
look-alike characters become ASCII and invisible ones vanish, spelled digits become
digits, and disguised "at" and "dot" become signs. Each keeps, for every character
it writes, the source characters it stands for, so what is found in the rewritten
text maps back to spans of the source.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[int, int]


def emails(text: str) -> list[Span]:
    """As the leftmost matches of local part, at and domain, in time linear in the text."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            out.append((start, done))
        at = text.find("@", max(at + 1, done))
    return out


def ips(text: str) -> list[Span]:
    return [m.span() for m in IP.finditer(text) if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split(".")))]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def cards(text: str) -> list[Span]:
    return [m.span() for m in CARD.finditer(text) if 13 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d)]


def phones(text: str) -> list[Span]:
    return [m.span() for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15]


def identifiers(text: str) -> dict[str, list[Span]]:
    digits = re.search("[0-9]", text) is not None
    return {
        "email": emails(text) if "@" in text else [],
        "ip": ips(text) if digits else [],
        "card": cards(text) if digits else [],
        "phone": phones(text) if digits and "+" in text else [],
    }


#: Letters that look like Latin ones, and the Latin ones.
LOOK_ALIKES = dict(zip("аеорсхуіјѕһԁԛԝАВЕКМНОРСТХІЈЅαοριυνΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcxyijshdqwABEKMHOPCTXIJSaopiuvABEZHIKMNOPTYX", strict=True))
LOOK_ALIKES |= {"。": ".", "․": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " ", " ": " ", " ": " "}
INVISIBLE = frozenset("­​‌‍‎‏⁠﻿")
#: Blocks whose characters may be forms of ASCII ones: full width, enclosed, mathematical, super- and subscripts.
FORMS = "²³¹⁰-ₜ①-⓿！-～\U0001d400-\U0001d7ff\U0001f100-\U0001f1ff"
DISGUISED = re.compile(f"[{''.join(map(re.escape, LOOK_ALIKES))}{''.join(INVISIBLE)}{FORMS}]")

DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_D = "|".join(DIGITS)
SPELLED = re.compile(rf"\b(?:plus[\s-]+)?(?:{_D})(?:(?:[\s,-]+|\s+dot\s+)(?:{_D}))+\b", re.I)
OPEN, SHUT = r"[\(\[\{{<]", r"[\)\]\}}>]"
# White space is entered at its start only: from anywhere, a long run would be read again and again.
AT = re.compile(
    rf"(?:(?<!\s)\s++)?{OPEN}\s*(?:at|@)\s*{SHUT}\s*|(?<=[A-Za-z0-9])\s+at\s+(?=[A-Za-z0-9-]+(?:\s*{OPEN}\s*(?:dot|\.)\s*{SHUT}\s*|\s+dot\s+)[A-Za-z])".replace("{{", "{").replace("}}", "}"), re.I
)
DOT = re.compile(rf"(?<=[A-Za-z0-9])(?:\s*{OPEN}\s*(?:dot|\.)\s*{SHUT}\s*|\s+dot\s+)(?=[A-Za-z0-9])".replace("{{", "{").replace("}}", "}"), re.I)
HINT = re.compile(r"[\(\[\{<]\s*(?:at|dot|@|\.)\s*[\)\]\}>]|\sdot\s", re.I)
WORD = re.compile(rf"(?:{_D})\b", re.I)


class Rewritten:
    """A text with, for each character, the span of source characters it stands for, and whether it was changed."""

    def __init__(self, text: str):
        self.text, self.start, self.end, self.changed = text, None, None, None

    def _open(self) -> None:
        if self.start is None:
            n = len(self.text)
            self.start, self.end, self.changed = list(range(n)), list(range(1, n + 1)), [False] * n

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Put strings in place of ordered, disjoint spans; each new character stands for a part of its span."""
        if not edits:
            return
        self._open()
        text, start, end, changed, at = [], [], [], [], 0
        for a, b, new in edits:
            text.append(self.text[at:a])
            start += self.start[at:a]
            end += self.end[at:a]
            changed += self.changed[at:a]
            if new:
                text.append(new)
                start += [self.start[a]] * len(new)
                end += [self.end[b - 1]] * len(new)
                changed += [True] * len(new)
            elif start:
                changed[-1] = True
            at = b
        text.append(self.text[at:])
        self.text = "".join(text)
        self.start, self.end, self.changed = start + self.start[at:], end + self.end[at:], changed + self.changed[at:]


def _plain(c: str) -> str:
    if c in INVISIBLE:
        return ""
    if c in LOOK_ALIKES:
        return LOOK_ALIKES[c]
    n = unicodedata.normalize("NFKC", c)
    return n if len(n) == 1 and n.isascii() else c


def characters(t: Rewritten) -> None:
    t.replace([(m.start(), m.end(), new) for m in DISGUISED.finditer(t.text) if (new := _plain(m[0])) != m[0]])


def digits(t: Rewritten) -> None:
    edits = []
    for m in SPELLED.finditer(t.text):
        at = m.start()
        if m[0][:4].lower() == "plus":
            first = WORD.search(t.text, at)
            edits.append((at, first.start(), "+"))
            at = first.start()
        words = list(WORD.finditer(t.text, at, m.end()))
        for i, w in enumerate(words):
            edits.append((w.start(), w.end(), DIGITS[w[0].lower()]))
            if i + 1 < len(words) and "d" not in t.text[w.end() : words[i + 1].start()].lower():
                edits.append((w.end(), words[i + 1].start(), ""))
    t.replace(edits)


def signs(t: Rewritten) -> None:
    t.replace([(*m.span(), "@") for m in AT.finditer(t.text)])
    t.replace([(*m.span(), ".") for m in DOT.finditer(t.text)])


def outside(new: list[Span], base: list[Span]) -> list[Span]:
    """The spans of ``new`` that no span of ``base`` holds; base spans are in order and do not overlap, so the last that starts in time decides."""
    starts = [b for b, _ in base]
    at = (bisect_right(starts, s) - 1 for s, _ in new)
    return [s for s, i in zip(new, at, strict=True) if i < 0 or s[1] > base[i][1]]


def disguised(text: str, base: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Further spans that show once the text is rewritten; none lies within a base span of its kind."""
    t = Rewritten(text)
    if not text.isascii() and DISGUISED.search(text):
        characters(t)
    low = t.text.lower()
    if sum(d in low for d in DIGITS) >= 2 or any(low.count(d) > 1 for d in DIGITS):
        digits(t)
    if HINT.search(t.text):
        signs(t)
    if t.start is None:
        return {k: [] for k in KINDS}
    out = {}
    for kind, spans in identifiers(t.text).items():
        new = [(t.start[a], t.end[b - 1]) for a, b in spans if any(t.changed[a:b])]
        out[kind] = outside(new, base[kind])
    return out


def found(text: str) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Base spans and all spans by kind, in code points, end exclusive, ordered by start."""
    base = identifiers(text)
    more = disguised(text, base)
    return base, {k: sorted(set(base[k]) | set(more[k])) for k in KINDS}


def listed(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        both = [found(t or "") for t in batch.column("text").to_pylist()]
        counts = [pa.array([len(b[k]) for b, _ in both], pa.int64()) for k in KINDS]
        digest = pa.array([hashlib.sha256(listed(b).encode()).hexdigest() for b, _ in both], pa.string())
        every = pa.array([listed(a) for _, a in both], pa.string())
        added = pa.array([sum(map(len, a.values())) - sum(map(len, b.values())) for b, a in both], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, digest, every, added], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])


def personal_data(docs: DataFrame) -> DataFrame:
    """Personal data of every document: doc_id, counts of base spans by kind, their digest, all spans, spans added.

    One row per row of ``docs``, repeated ones too; null and empty texts hold none, an
    empty table gives an empty result, further columns are left alone. Time is linear in
    the text, whatever it holds. Nothing is shuffled.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_find, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def query(spark, sf_dir: str) -> DataFrame:
    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
