"""Personal data with offset-preserving deobfuscation.

Base identifiers are found in the text as it is.  Then transducers rewrite a
text that holds a disguise: homoglyphs become ASCII one for one, invisible
characters vanish, spelled digits become digits, and at/dot disguises become @
and dots.  Every rewritten piece remembers the source characters it came from, so
an identifier found in the normalised text maps back to a span of the source.
Base spans stay; a mapped span is added if something in it was rewritten and it
does not lie inside a base span of its kind.

Every scan is linear in the text: patterns start at a character that ends the
preceding run, and gaps inside disguises are of bounded width.

Defined cases: null and empty texts hold nothing; repeated rows each get their
own row; offsets are code points, end exclusive; columns other than doc_id and
text pass through ``redacted`` unchanged and are not looked at by ``find``.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapescope.llm.common import map_batches

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, index of the kind, end

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])) % 10 == 0


def identifiers(text: str) -> list[Span]:
    """Base identifiers, leftmost and non-overlapping within their kind, by start and kind."""
    found: list[Span] = []
    if "@" in text:
        free = 0  # end of the last match
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                free = m.end()
                found.append((start, 0, free))
    for m in _IP.finditer(text):
        parts = (p.lstrip("0") for p in m.group().split("."))
        if all(len(p) < 4 and int(p or 0) <= 255 for p in parts):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _DIGITS.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.sub("", m.group())) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


# ---- transducers

def _homoglyphs() -> dict[int, str]:
    """One character for one: full-width forms, digits of other scripts, look-alike letters and signs."""
    table = {cp: chr(cp - 0xFEE0) for cp in range(0xFF01, 0xFF5F)}
    for zero in (0x0660, 0x06F0, 0x0966, 0x09E6, 0x0E50, *range(0x1D7CE, 0x1D800, 10)):
        table |= {zero + d: str(d) for d in range(10)}
    alike = ("аa еe оo рp сc уy хx іi јj ѕs ԁd һh ԛq ԝw ɡg ѵv АA ВB ЕE КK МM НH ОO РP СC ТT ХX ІI ЈJ ЅS "
             "οo αa νv ρp ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ıi İI ſs")  # IGNORECASE takes the last three for ASCII
    table |= {ord(pair[0]): pair[1] for pair in alike.split()}
    table |= dict.fromkeys([0x2024, 0x3002, 0xFF61, 0xFE52], ".") | dict.fromkeys([0xFE6B], "@") | dict.fromkeys([0x207A, 0xFE62], "+")
    return table | dict.fromkeys([*range(0x2010, 0x2016), 0x2212, 0xFE63], "-") | dict.fromkeys([0xA0, *range(0x2000, 0x200B), 0x202F, 0x3000], " ")


HOMOGLYPHS = _homoglyphs()
_ALIKE = re.compile("[" + "".join(map(re.escape, map(chr, sorted(HOMOGLYPHS)))) + "]")
_HIDDEN = "".join(map(chr, (0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD)))
_NUMERALS = {w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine".split())} | {"oh": "0"}
_NAMES = "|".join(_NUMERALS)
_OPEN, _SHUT, _GAP = r"[\[({<]", r"[\])}>]", r"[\x20\t]{1,3}"
_RULES = re.compile(
    rf"(?P<hidden>[{_HIDDEN}]+)"
    rf"|(?P<spelled>(?<![A-Za-z0-9])(?:{_NAMES})(?:[\x20-](?:{_NAMES}))*+(?![A-Za-z0-9]))"
    rf"|(?P<plus>(?<![A-Za-z0-9])plus{_GAP}(?=[0-9]|(?:{_NAMES})(?![A-Za-z0-9])))"
    rf"|(?P<at>[\x20\t]{{0,3}}{_OPEN}[\x20\t]{{0,3}}(?:at|@)[\x20\t]{{0,3}}{_SHUT}[\x20\t]{{0,3}}|&#64;|&#x40;|&commat;"
    rf"|(?<=[A-Za-z0-9]){_GAP}(?:at|@){_GAP}(?=[A-Za-z0-9-]{{1,63}}(?:\.|{_GAP}dot{_GAP}|[\x20\t]{{0,3}}{_OPEN})))"
    rf"|(?P<dot>[\x20\t]{{0,3}}{_OPEN}[\x20\t]{{0,3}}(?:dot|\.)[\x20\t]{{0,3}}{_SHUT}[\x20\t]{{0,3}}|(?<=[A-Za-z0-9]){_GAP}dot{_GAP}(?=[A-Za-z0-9]))",
    re.IGNORECASE)
_SPELLED = re.compile(_NAMES, re.IGNORECASE)


class Normalised:
    """A rewritten text and where its pieces came from."""

    def __init__(self, source: str):
        text = source.translate(HOMOGLYPHS) if not source.isascii() and _ALIKE.search(source) else source
        self.source, self.changed = source, text is not source
        first = _RULES.search(text)  # the rules themselves: a second, shorter pattern would have to match wherever they do
        if not first:
            self.text, self.starts, self.pieces = text, [0], [(0, None)]
            return
        self.changed = True
        out: list[str] = []
        #: first normalised position; (first source position, end of the source of a rewritten piece)
        self.starts: list[int] = []
        self.pieces: list[tuple[int, int | None]] = []
        at = length = 0

        def put(piece: str, start: int, end: int | None) -> None:
            nonlocal length
            if piece:
                self.starts.append(length)
                self.pieces.append((start, end))
                out.append(piece)
                length += len(piece)

        for m in chain((first,), _RULES.finditer(text, first.end())):
            put(text[at:m.start()], at, None)
            if m.lastgroup == "spelled":
                for word in _SPELLED.finditer(text, m.start(), m.end()):
                    put(_NUMERALS[word.group().lower()], word.start(), word.end())
            else:
                put({"hidden": "", "plus": "+", "at": "@", "dot": "."}[m.lastgroup], m.start(), m.end())
            at = m.end()
        put(text[at:], at, None)
        self.text = "".join(out)

    def span(self, start: int, end: int) -> tuple[int, int]:
        """Source span of the normalised characters [start, end)."""
        i, j = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        (a, rewritten), (b, to) = self.pieces[i], self.pieces[j]
        return (a if rewritten is not None else a + start - self.starts[i]), (to if to is not None else b + end - self.starts[j])


def disguised(text: str, base: list[Span]) -> list[Span]:
    """Identifiers that only the normalised text shows, as source spans."""
    norm = Normalised(text)
    if not norm.changed:
        return []
    found = []
    for start, kind, end in identifiers(norm.text):
        s, e = norm.span(start, end)
        if text[s:e] != norm.text[start:end]:
            found.append((s, kind, e))
    if not found:
        return []
    by_kind = [[(s, e) for s, k, e in base if k == kind] for kind in range(len(KINDS))]
    out = []
    for s, kind, e in found:
        i = bisect_right(by_kind[kind], (s, len(text) + 1)) - 1  # the last base span that starts no later
        if i < 0 or by_kind[kind][i][1] < e:
            out.append((s, kind, e))
    return out


def all_spans(text: str | None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of a text."""
    if not text:
        return [], []
    base = identifiers(text)
    return base, sorted(base + disguised(text, base))


def redact(text: str | None) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    _, spans = all_spans(text)
    if not spans:
        return text
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


# ---- Spark

_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def find(docs: DataFrame) -> DataFrame:
    """doc_id with ``base`` and ``spans``: arrays of (kind, start, end) by start, then kind."""
    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        pairs = [all_spans(t.as_py()) for t in batch.column(1)]
        as_rows = lambda spans: [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([as_rows(p[i]) for p in pairs], pa.list_(_SPAN)) for i in (0, 1))],
                                          names=["doc_id", "base", "spans"])

    span = "array<struct<kind:string,start:long,end:long>>"
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), scan,
                       f"doc_id long, base {span}, spans {span}")


def redacted(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """``docs`` with identifiers replaced in ``text``; ``length``, if there, is counted anew where the text changed."""
    names = docs.columns

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = list(batch.columns)
        i = names.index(text)
        old = columns[i].to_pylist()
        new = [redact(t) for t in old]
        columns[i] = pa.array(new, columns[i].type)
        if length in names:
            j = names.index(length)
            columns[j] = pa.array([n if a == b else len(b) for a, b, n in zip(old, new, columns[j].to_pylist())], columns[j].type)
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(lambda batches: map(scan, batches), docs.schema)
