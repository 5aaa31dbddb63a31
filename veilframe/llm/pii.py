"""Personal data by offset-preserving deobfuscation.

Plain detection finds e-mail addresses, IPv4 addresses, payment cards and phone numbers in a text as it is. Then
transducers rewrite disguises: homoglyphs and other scripts' digits to ASCII (one code point each),
zero-width marks to nothing, at/dot in brackets or words to their signs, runs of spelled digits to
digits. They give edits (source start, source end, replacement); the normalised text is spliced from them,
detection runs on it again, and found spans are mapped back through the edits to source code points. A span
found this way is added unless it lies within a plain span of its kind; plain spans always stay, so spans may overlap.

Nulls are empty texts. Every scan is linear in the text's length. Rows that repeat an id have a row each; no documents give no
rows; other columns pass through ``redact_documents``. A sign or dot spelled without brackets counts only before a known
last label, so prose such as "look at this dot and" stays.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

# Letters of other scripts that look like ASCII ones
_LOOKALIKES = {
    "а": "a", "в": "B", "е": "e", "к": "k", "м": "M", "н": "H", "о": "o", "р": "p", "с": "c", "т": "T", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "﹫": "@", "․": ".", "。": ".", "﹣": "-", "−": "-", "‐": "-", "‑": "-", "‒": "-", "–": "-", " ": " ", " ": " ", " ": " ", " ": " ",
}
# The digits zero to nine in English, German, French and Spanish
_SPELLED = (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
)
_VALUE = {w: str(i) for words in _SPELLED for i, w in enumerate(words.split())} | {"oh": "0"}

_GLYPHS = {ord(k): v for k, v in _LOOKALIKES.items()}
for _c in range(0x80, 0x1FC00):  # compatibility forms of one ASCII character: full width, mathematical, circled letters, spaces
    _form = unicodedata.normalize("NFKC", chr(_c))
    if len(_form) == 1 and _form.isascii() and unicodedata.category(chr(_c)) != "No":
        _GLYPHS.setdefault(_c, _form)
_GLYPHS |= {c: str(unicodedata.decimal(chr(c))) for c in range(0x80, 0x1FC00) if unicodedata.category(chr(c)) == "Nd"}
_GLYPH = frozenset(map(chr, _GLYPHS))
_HIDDEN = re.compile("[­​-‍⁠﻿]")
_OPEN, _CLOSE = r"[\[({<]\s{0,2}", r"\s{0,2}[\])}>]"
_AT = rf"(?P<at>\s{{0,2}}{_OPEN}(?:at|@|arroba){_CLOSE}\s{{0,2}}|\s{{1,2}}(?:at|arroba)\s{{1,2}}|@)"
_DOT = rf"(?:\s{{0,2}}{_OPEN}(?:dot|\.|punkt|point|punto){_CLOSE}\s{{0,2}}|\s{{1,2}}(?:dot|punkt|punto)\s{{1,2}}|\.)"
# Last labels of hosts that a sign spelled without brackets must have
_LAST = frozenset("com org net edu gov mil int info biz io co ai app dev tv cc eu de fr es nl ch pl pt se fi dk ie uk ca au nz br mx ar cl jp cn ru za".split())
_ADDRESS = re.compile(rf"(?<=[a-z0-9_%+-]){_AT}(?P<host>[a-z0-9-]{{1,63}}(?:{_DOT}[a-z0-9-]{{1,63}})+)")
_DOTS = re.compile(_DOT)
_LOCAL_DOT = re.compile(rf"(?<=[a-z0-9_%+-])(?P<dot>{_DOT})[a-z0-9_%+-]{{1,64}}$")  # before the end of a local part
_WORD = "|".join(sorted(_VALUE, key=len, reverse=True))
_SEP = r"[\s,.-]{1,3}(?:(?:dot|point|punkt|punto)[\s,.-]{1,3})?"
_RUN = re.compile(rf"\b(?:(?:plus|\+)\s{{0,2}})?(?:(?<![0-9])(?:[0-9]{{1,19}}{_SEP}){{1,8}})?(?:{_WORD})(?:{_SEP}(?:{_WORD}|[0-9]+))*\b")
_STEP = re.compile(rf"plus|dot|point|punkt|punto|\+|[0-9]+|{_WORD}|[\s,.-]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """As [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(.[A-Za-z0-9-]+)+ finds them, led by the @ signs: a local part holds none."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(done, at + 1))


def detect(text: str) -> list[Span]:
    """Plain spans, by kind and start."""
    out: list[Span] = [("email", s, e) for s, e in emails(text)]
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


Edit = tuple[int, int, str]


def disguises(text: str) -> tuple[str, list[Edit]]:
    """The text with homoglyphs replaced (same length), and the edits that undo the other disguises."""
    edits: list[Edit] = []
    if not text.isascii():
        if not _GLYPH.isdisjoint(text):
            text = text.translate(_GLYPHS)
        edits += [(*m.span(), "") for m in _HIDDEN.finditer(text)]
    low = text.lower()
    if len(low) != len(text):  # a few capitals grow in lower case
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    if any(c in low for c in "[({<") or "dot" in low or "punkt" in low or "punto" in low or "arroba" in low:
        last = 0
        for m in _ADDRESS.finditer(low):
            sign, host = m["at"], m.start("host")
            dots = [(host + d.start(), host + d.end()) for d in _DOTS.finditer(m["host"])]
            veiled = [(s, e) for s, e in dots if e - s > 1]
            bracketed = any(c in sign for c in "[({<")
            if not (veiled or bracketed or "arroba" in sign):
                continue
            if sign != "@" and not bracketed and m["host"][dots[-1][1] - host :] not in _LAST:
                continue
            if sign != "@":
                edits.append((m.start("at"), m.end("at"), "@"))
            edits += [(s, e, ".") for s, e in veiled]
            end = m.start("at")
            while d := _LOCAL_DOT.search(low[max(last, end - 100) : end]):  # dots of the local part, from its end
                at = max(last, end - 100) + d.start("dot")
                if len(d["dot"]) > 1:
                    edits.append((at, at + len(d["dot"]), "."))
                end = at
            last = m.end()
    for m in _RUN.finditer(low):
        if m[0] in _VALUE:
            continue
        steps = [(s.group(), m.start() + s.start(), m.start() + s.end()) for s in _STEP.finditer(m[0])]
        if sum(w in _VALUE or w.isdigit() for w, _, _ in steps) < 2:
            continue
        for i, (word, s, e) in enumerate(steps):
            if word in _VALUE:
                edits.append((s, e, _VALUE[word]))
            elif word == "plus":
                edits.append((s, e, "+"))
            elif word in ("dot", "point", "punkt", "punto"):
                edits.append((s, e, "."))
            elif not word.isdigit() and word not in ("+", "."):
                beside = [steps[k][0] for k in (i - 1, i + 1) if 0 <= k < len(steps)]
                if any(b in _VALUE or not b.isdigit() for b in beside):
                    edits.append((s, e, ""))
    edits.sort()
    clean: list[Edit] = []
    for x in edits:
        if not clean or x[0] >= clean[-1][1]:
            clean.append(x)
    return text, clean


class Mapped:
    """A text spliced from edits, with the way back from its positions to the source's."""

    def __init__(self, source: str, edits: list[Edit]):
        parts, self.at, self.pieces, here, done = [], [], [], 0, 0
        for s, e, new in [*edits, (len(source), len(source), "")]:
            for start, end, piece, copied in ((done, s, source[done:s], True), (s, e, new, False)):
                if piece:
                    parts.append(piece)
                    self.at.append(here)
                    self.pieces.append((start, end, copied))
                    here += len(piece)
            done = e
        self.text = "".join(parts)

    def source(self, start: int, end: int) -> tuple[int, int]:
        i, j = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        (s, _, s_copied), (t, e, e_copied) = self.pieces[i], self.pieces[j]
        return s + (start - self.at[i]) * s_copied, t + end - self.at[j] if e_copied else e


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """Plain spans and added ones."""
    text = text or ""
    base = detect(text)
    plain, edits = disguises(text)
    if plain is text and not edits:
        return base, []
    mapped = Mapped(plain, edits)
    added: list[Span] = []
    for kind, s, e in detect(mapped.text):
        s, e = mapped.source(s, e)
        if not any(k == kind and x <= s and e <= y for k, x, y in base):
            added.append((kind, s, e))
    return base, added


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


def redact(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span replaced by its kind in brackets; of spans that meet, the first stands for all."""
    if text is None or not spans:
        return text
    out, done = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= done:
            out += [text[done:s], f"[{kind.upper()}]"]
        done = max(done, e)
    return "".join([*out, text[done:]])


def scan_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone (plain spans), n_added, base_sha256, spans (plain and added)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                base, added = find(text)
                count = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                rows.append((*count, len(added), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + added)))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=["id", "n_email", "n_ip", "n_card", "n_phone", "n_added", "base_sha256", "spans"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, n_added long, base_sha256 string, spans string").withColumnRenamed("id", id_col)


def redact_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with their personal data, plain or disguised, replaced in the text."""

    def clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([None if t is None else redact(t, [s for part in find(t) for s in part]) for t in batch], dtype=object)

    return docs.withColumn(text_col, F.pandas_udf(clean, "string")(F.col(text_col)))
