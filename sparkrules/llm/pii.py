"""Personal data by offset-preserving deobfuscation.

Base detectors run on the text as it is. Where a text holds disguises, transducers rewrite it and keep, for each rewritten
piece, where it came from: characters that look like ASCII ones become these (one for one), invisible ones vanish, bracketed
or spelled "at" and "dot" become signs, and runs of spelled digits become digits. The same detectors run on the
rewritten text; each span is mapped back to source characters and added unless a base span of its kind covers it.
Offsets are code points, the end exclusive. Each document is handled alone, so nothing is shuffled.

Defined cases: a null or empty text has no spans; texts of any length are scanned in one pass per detector; repeated rows are
scanned each; other columns pass through.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrules.llm.tables import body, packed, pieces, with_fields

KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"

HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*+\Z")
LOCAL_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: Look-alikes of ASCII letters among Cyrillic and Greek ones (fixed values).
LOOK_ALIKE = str.maketrans("АВЕКМНОРСТХаеорсухіјѕԁΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαν", "ABEKMHOPCTXaeopcyxijsdABEZHIKMNOPTYXoav")
INVISIBLE = "­​‌‍⁠﻿"
DIGITS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
_DIGIT = "(?:" + "|".join(DIGITS) + ")"
DISGUISE = re.compile(
    rf"(?P<hidden>[{INVISIBLE}]+)"
    r"|(?P<at>[ ]?[(\[{<][ ]?(?:at|@)[ ]?[)\]}>][ ]?|(?<=[a-z0-9])[ ]at[ ](?=(?:[a-z0-9-]+(?:\.|[ ]dot[ ]))+?[a-z]{2,}\b))"
    r"|(?P<dot>[ ]?[(\[{<][ ]?(?:dot|\.)[ ]?[)\]}>][ ]?|(?<=[a-z0-9])[ ]dot[ ](?=[a-z0-9]))"
    rf"|(?P<digits>\b(?:plus[ ])?{_DIGIT}(?:[ -]{_DIGIT})*+\b)",
    re.IGNORECASE | re.ASCII,
)
#: Every match of DISGUISE holds one of these in lower case, or an invisible character: a bracketed sign is followed by a closing bracket.
HINTS = (*DIGITS, " at ", "dot", *(f"{sign}{gap}{end}" for sign in ("at", "@", ".") for gap in ("", " ") for end in ")]}>"))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Every @ from the left: the run of local signs before it, as far as the last match, and a host after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_SIGNS:
            start -= 1
        host = HOST.match(text, at + 1) if start < at else None
        if host:
            yield start, host.end()
        done = host.end() if host else at + 1
        at = text.find("@", done)


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _detect(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of every identifier, ASCII forms only."""
    found = [(a, 0, b) for a, b in _emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p[-3:]) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and _luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return found


def _plain(char: str) -> str:
    code = ord(char)
    if 0xFF01 <= code <= 0xFF5E:  # full-width forms
        return chr(code - 0xFEE0)
    digit = unicodedata.decimal(char, None)
    return char if digit is None else str(digit)


def _rewritten(text: str) -> tuple[str, list[int], list[int], list[int]] | None:
    """The text without disguises; per piece its place there, its source place and its source length (-1: one for one)."""
    plain = text
    if not text.isascii():
        plain = text.translate(LOOK_ALIKE)
        odd = {c for c in set(plain) if ord(c) > 0x5FF}
        if odd:
            plain = plain.translate({ord(c): _plain(c) for c in odd})
    low = plain.lower()
    hinted = any(h in low for h in HINTS) or any(c in plain for c in INVISIBLE)
    if not hinted:
        return None if plain == text else (plain, [0], [0], [-1])
    out: list[str] = []
    here, source, length = [], [], []
    size = done = 0

    def put(piece: str, at: int, n: int) -> None:
        nonlocal size
        if piece:
            here.append(size)
            source.append(at)
            length.append(n)
            out.append(piece)
            size += len(piece)

    for m in DISGUISE.finditer(plain):
        if m.lastgroup == "digits":
            words = re.split("[ -]", m[0].lower())
            sign = "+" if words[0] == "plus" else ""
            words = words[1:] if sign else words
            if len(words) < 2:
                continue
            put(plain[done : m.start()], done, -1)
            at = m.start()
            if sign:
                put(sign, at, 4)
                at += 5
            for word in words:
                put(str(DIGITS.index(word)), at, len(word))
                at += len(word) + 1
        else:
            put(plain[done : m.start()], done, -1)
            put({"hidden": "", "at": "@", "dot": "."}[m.lastgroup], m.start(), m.end() - m.start())
        done = m.end()
    put(plain[done:], done, -1)
    return "".join(out), here, source, length


def find(text: str | None) -> list[tuple[str, int, int, bool]]:
    """``(kind, start, end, base)`` by start, then kind as listed; an added span follows a base one that is equal so far."""
    text = text or ""
    base = _detect(text)
    spans = [(a, k, 0, b) for a, k, b in base]
    new = _rewritten(text)
    if new:
        plain, here, source, length = new

        def back(at: int, end: bool) -> int:
            piece = bisect_right(here, at) - 1
            if length[piece] < 0:
                return source[piece] + at - here[piece] + end
            return source[piece] + (length[piece] if end else 0)

        covers: dict[int, list[tuple[int, int]]] = {}
        for a, k, b in sorted(base):
            covers.setdefault(k, []).append((a, b))
        for a, k, b in _detect(plain):
            start, end = back(a, False), back(b - 1, True)
            own = covers.get(k, [])
            near = own[max(0, bisect_right(own, (start, len(text) + 1)) - 1) :][:1]
            if not any(x <= start and end <= y for x, y in near):
                spans.append((start, k, 1, end))
    return [(KINDS[k], a, b, not added) for a, k, added, b in sorted(set(spans))]


def _spans(lists: list[list[tuple]]) -> pa.Array:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
    return pa.array([[dict(zip(("kind", "start", "end", "base"), s)) for s in spans] for spans in lists], kind)


def scan(docs: DataFrame, *carry: str) -> DataFrame:
    """The ``carry`` columns and ``spans`` of ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in pieces(batches):
            yield pa.RecordBatch.from_arrays([rows, _spans([find(t) for t in texts.to_pylist()])], ["_row", "spans"])

    df = docs.select(packed(carry), body().alias("_text"))
    return df.mapInArrow(run, with_fields(df, f"spans {SPANS}")).select("_row.*", "spans")


def masked(text: str) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, named after the first."""
    out, done = [], 0
    merged: list[list] = []
    for kind, a, b, _ in find(text):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[done:a], f"[{kind.upper()}]"]
        done = b
    return "".join([*out, text[done:]])


def clean(docs: DataFrame) -> DataFrame:
    """All documents, with their columns, personal data in ``text`` masked. ``n_chars``, where there is one, follows the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in pieces(batches):
            new = [t if t is None else masked(t) for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([rows, texts, pa.array(new, texts.type)], ["_row", "_text", "_new"])

    df = docs.select(packed(docs.columns), F.col("text").alias("_text"))
    out = df.mapInArrow(run, with_fields(df, "_text string, _new string"))
    changed = ~F.col("_text").eqNullSafe(F.col("_new"))

    def column(name: str, kind: str) -> Column:
        old = F.col(f"_row.`{name}`")
        if name == "text":
            old = F.col("_new")
        elif name == "n_chars":
            old = F.when(changed, F.length("_new").cast(kind)).otherwise(old)
        return old.alias(name)

    return out.select(*[column(name, kind) for name, kind in docs.dtypes])


def joined(spans: str, base_only: bool) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    kept = F.filter(spans, lambda s: s["base"]) if base_only else F.col(spans)
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
