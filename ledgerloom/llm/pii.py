"""Personal data: detection that sees through disguises, with spans in the source text.

Base patterns find plain email addresses, IP addresses, card and phone numbers. Then a transducer rewrites the text and
keeps, for each character that it writes, the source characters that it stands for: homoglyphs and other digits become ASCII,
invisible characters go, spelled digits become digits, and bracketed or spoken at, dot and plus signs become signs. The
base patterns run over the rewritten text too; what they find is mapped back to the source, and added unless a base span
of the same kind holds it already.

A spoken sign counts only in context: `at` with a spoken or written dot and a known ending after it (any ending
where some sign is bracketed), `dot` after such an
`at` or between digits, spelled digits only in runs. So prose is left alone. Texts without any trigger are not rewritten.

Defined results: a null or empty text has no spans; a null id is carried along; extra columns are not read; an empty table gives
no rows; rows with equal ids are searched each. redacted() leaves a null text null and an empty one empty, keeps all rows and columns,
and puts one name for spans that overlap.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ledgerloom.llm.common import in_arrow

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# a match can start only where a run of digits starts, as all patterns take runs whole
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGITS = re.compile(r"[^0-9]+")
#: Digits doubled and reduced, for the Luhn sum.
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return (sum(values[0::2]) + sum(_DOUBLED[v] for v in values[1::2])) % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost matches: the run of local characters before each sign, with the domain after it."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            out.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    return out


def plain_spans(text: str) -> list[Span]:
    """The base spans of all kinds."""
    out = emails(text) if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NOT_DIGITS.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGITS.sub("", m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return ordered(out)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# Letters of other scripts that look like Latin ones, spelled digits and signs, endings of host names.
LOOKALIKES = dict(zip("АВЕЅІЈКМНОРСТУХаеѕіјорсухԁԛԝһӏΑΒΕΖΗΙΚΜΝΟΡΤΥΧαοριν", "ABESIJKMHOPCTYXaesijopcyxdqwhlABEZHIKMNOPTYXaopiv"))
DIGITS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
AT_WORDS = ("at", "arroba", "arobase")
DOT_WORDS = ("dot", "punkt", "punto", "point")
ENDINGS = ("com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "io", "co", "me", "uk", "de", "fr", "es", "it", "nl", "ch", "at", "be", "eu", "us", "ca", "au", "jp", "cn", "ru", "br", "pl", "se", "ai", "fi", "dk", "cz", "sk", "hu", "ro", "bg", "gr", "pt", "ie", "lt", "lv", "ee", "ua", "kr", "tw", "hk", "sg", "nz", "za", "mx", "cl", "ar", "tr", "il", "rs", "hr", "lu", "li", "vn", "ph", "ae", "ng", "ke", "eg", "tv", "fm", "app", "dev", "xyz", "mobi", "coop", "example", "test", "invalid")
INVISIBLE = "­​‌‍⁠﻿"

_AT, _DOT = "|".join(AT_WORDS), "|".join(DOT_WORDS)
_AT_SIGN = rf"(?:\s*(?:\[\s*(?:{_AT}|@)\s*\]|\(\s*(?:{_AT}|@)\s*\)|\{{\s*(?:{_AT}|@)\s*\}}|<\s*(?:{_AT}|@)\s*>)\s*)"
_DOT_SIGN = rf"(?:\s*(?:\[\s*(?:{_DOT}|\.)\s*\]|\(\s*(?:{_DOT}|\.)\s*\)|\{{\s*(?:{_DOT}|\.)\s*\}}|<\s*(?:{_DOT}|\.)\s*>)\s*)"
_NAME = r"[a-z0-9_%+-]+"
_LABEL = r"[a-z0-9-]+"
_ANY_DOT = rf"(?:{_DOT_SIGN}|\s+(?:{_DOT})\s+|\.|\s\.\s)"
#: Names joined by dots, plain or disguised; the lookbehind keeps starts at the beginning of a name.
_LOCAL_PART = re.compile(rf"(?<![a-z0-9._%+-]){_NAME}(?:{_ANY_DOT}{_NAME})*+", re.I)
_SIGN = re.compile(rf"(?P<at>(?P<bracketed>{_AT_SIGN})|\s+(?:{_AT})\s+|\s@\s|@)(?P<label>{_LABEL})", re.I)
_NEXT_LABEL = re.compile(rf"(?P<dot>{_ANY_DOT})(?P<label>{_LABEL})", re.I)
_BRACKETED_DOT = re.compile(_DOT_SIGN, re.I)
_ENDINGS = frozenset(ENDINGS)
_AT_PART = re.compile(rf"{_AT_SIGN}|\s+(?:{_AT})\s+|\s@\s", re.I)
_DOT_PART = re.compile(rf"{_DOT_SIGN}|\s+(?:{_DOT})\s+|\s\.\s", re.I)
_DIGIT_WORD = "|".join(sorted(DIGITS, key=len, reverse=True))
#: A run of spelled digits, digits and spoken signs, at least three of them spelled.
_ITEM = rf"(?:(?:{_DIGIT_WORD})\b|[0-9]+|(?:{_DOT})\b|\.)"
RUN = re.compile(rf"(?<![^\W_])(?:plus[\s-]+|\+\s*)?{_ITEM}(?:[\s,-]{{0,2}}{_ITEM}){{3,}}+", re.I)
_RUN_PART = re.compile(rf"(?P<digit>{_DIGIT_WORD})|(?P<number>[0-9]+)|(?P<dot>{_DOT}|\.)|(?P<plus>plus|\+)|(?P<gap>[\s,-]+)", re.I)
_STRANGE = re.compile(r"[^\x00-ɏ‐-‟…€\s]|\xad")
#: What a text needs to hold before the costlier patterns look at it; for RE2, which reads a text once.
MAY_BE_PLAIN = r"@|\+[0-9]|[0-9](?:[ -]?[0-9]){11}|[0-9]\.[0-9]+\.[0-9]+\.[0-9]"
#: Python's white space, of which RE2's class has only a part; the rest is beyond U+024F.
_GAP = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}]"
_GAP_IN = _GAP[1:-1]
MAY_BE_DISGUISED = (
    r"[^\x00-\x{24F}\x{2010}-\x{201F}\x{2026}\x{20AC}\s]|\x{AD}"
    + rf"|[\[({{<]{_GAP}*(?:{_AT}|@|{_DOT}|\.){_GAP}*[\])}}>]|{_GAP}@{_GAP}|{_GAP}(?:{_DOT}){_GAP}"
    + rf"|(?:@|{_GAP}(?:{_AT}){_GAP}+){_LABEL}(?:\.{_LABEL})*{_GAP}\.{_GAP}|{_GAP}\.{_GAP}{_NAME}(?:\.{_NAME})*@"
    + rf"|(?:^|[^A-Za-z0-9])(?:{_DIGIT_WORD})\b(?:[{_GAP_IN},.-]{{0,2}}(?:{_DIGIT_WORD}|{_DOT}|[0-9]+|\.)){{2}}|[0-9](?:[{_GAP_IN},-]{{1,2}}(?:{_DIGIT_WORD})\b){{3}}"
)


def ascii_of(c: str) -> str:
    """What a character stands for; '' for an invisible one, itself if it stands for nothing else."""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if c in INVISIBLE:
        return ""
    digit = unicodedata.digit(c, None)
    if digit is not None:
        return str(digit)
    plain = unicodedata.normalize("NFKC", c)
    return plain if len(plain) == 1 and plain.isascii() else "." if c in "。․" else c


def card_ends(items: list[re.Match]) -> set[int]:
    """Places of the gaps of a run that end a number, where over 19 digits stand together: lines are joined only if they make a card,
    and a line that is longer is cut only if cards fill it whole."""
    out: set[int] = set()
    stretch: list[tuple[int, str]] = []  # place of the gap before, digits
    for k, p in [*enumerate(items), (len(items), None)]:
        if p is not None and p["gap"]:
            continue
        if p is not None and (p["digit"] or p["number"]):
            before = k - 1 if k and items[k - 1]["gap"] else -1
            stretch.append((before, DIGITS[p["digit"].lower()] if p["digit"] else p["number"]))
            continue
        if sum(len(d) for _, d in stretch) > 19:
            lines: list[list[tuple[int, str]]] = []
            for gap, digits in stretch:
                if not lines or gap >= 0 and re.search(r"[\r\n]", items[gap][0]):
                    lines.append([])
                lines[-1].append((gap, digits))
            for first, n in _tiled(["".join(d for _, d in x) for x in lines]):
                out.add(lines[first][0][0])
                if n == 1 and sum(len(d) for _, d in lines[first]) > 19:
                    cuts = _tiled([d for _, d in lines[first]])
                    if all(_is_card("".join(d for _, d in lines[first][i : i + j])) for i, j in cuts):
                        out.update(lines[first][i][0] for i, _ in cuts)
            out.discard(stretch[0][0])
        stretch = []
    return out - {-1}


def ip_ends(items: list[re.Match]) -> set[int]:
    """Places of the gaps of a run with dots that end an identifier: at commas and new lines where that leaves whole addresses or cards, and
    between addresses that follow each other, whose last and first part stand together."""
    atoms: list[tuple[int, str]] = []  # place of the gap before, text
    for k, p in enumerate(items):
        if not p["gap"]:
            atoms.append((k - 1 if k and items[k - 1]["gap"] else -1, DIGITS[p["digit"].lower()] if p["digit"] else "." if p["dot"] else "+" if p["plus"] else p["number"]))
    if not any(t == "." for _, t in atoms):
        return set()
    lists: list[list[tuple[int, str]]] = []
    for gap, t in atoms:
        if not lists or gap >= 0 and re.search(r"[\r\n,]", items[gap][0]):
            lists.append([])
        lists[-1].append((gap, t))
    texts = ["".join(t for _, t in x) for x in lists]
    pieces = _tiled(texts, lambda t: _is_ip(t) or _is_card(t))
    some = any(_is_ip("".join(texts[i : i + n])) for i, n in pieces)
    out = {lists[i][0][0] for i, _ in pieces} if some else set()
    for part in [[a for x in lists[i : i + n] for a in x] for i, n in pieces] if some else [atoms]:
        groups: list[list[tuple[int, str]]] = [[]]
        for a in part:
            groups.append([]) if a[1] == "." else groups[-1].append(a)
        if len(groups) > 4 and len(groups) % 3 == 1 and all(groups):
            for g in groups[3:-1:3]:
                whole = lambda x: _is_ip("0.0.0." + "".join(t for _, t in x))
                out.update([g[c][0] for c in range(1, len(g)) if whole(g[:c]) and whole(g[c:])][:1])
    return out - {-1, atoms[0][0]}


def _is_ip(text: str) -> bool:
    parts = text.split(".")
    return len(parts) == 4 and all(p.isdigit() and len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in parts)


def _is_card(digits: str) -> bool:
    return 12 <= len(digits) <= 19 and digits.isdigit() and luhn(digits)


def _tiled(units: list[str], fits: Callable[[str], bool] = _is_card) -> list[tuple[int, int]]:
    """Consecutive units as (first, how many), so that the most characters are in pieces that fit; units of none stand alone."""
    best: list[tuple[int, int]] = [(0, 0)]  # characters in such pieces so far, units of the last piece
    for k in range(1, len(units) + 1):
        options, joined = [(best[k - 1][0], 1)], ""
        for n in range(1, k + 1):
            joined = units[k - n] + joined
            if len(joined) > 19:
                break
            if fits(joined):
                options.append((best[k - n][0] + len(joined), n))
        best.append(max(options))
    out, k = [], len(units)
    while k:
        n = best[k][1]
        out.append((k - n, n))
        k -= n
    return out[::-1]


class Rewritten:
    """A text under rewriting, with the source span of each of its characters."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, np.arange(len(text)), np.arange(1, len(text) + 1)

    def characters(self) -> None:
        found = [(m.start(), ascii_of(m[0])) for m in _STRANGE.finditer(self.text)]
        self.replace([(i, i + 1, c) for i, c in found if c != self.text[i]])

    def replace(self, parts: list[tuple[int, int, str]]) -> None:
        """Puts c for [a, b) for ascending parts; every character of c stands for the whole of it."""
        if not parts:
            return
        text, start, end, last = [], [], [], 0
        for a, b, c in parts:
            text += [self.text[last:a], c]
            start += [self.start[last:a], np.full(len(c), self.start[a])]
            end += [self.end[last:a], np.full(len(c), self.end[b - 1])]
            last = b
        self.text = "".join(text) + self.text[last:]
        self.start, self.end = np.concatenate([*start, self.start[last:]]), np.concatenate([*end, self.end[last:]])

    def domain_end(self, sign: re.Match, bracketed: bool) -> int:
        """Where the domain after a sign ends, 0 if there is none: at the last label that is a known ending, or, with a bracketed
        sign before it, any of two letters and more, unless it only follows a spoken or spaced dot of a later sentence."""
        end, at, first = 0, sign.end(), True
        while m := _NEXT_LABEL.match(self.text, at):
            own = bool(_BRACKETED_DOT.fullmatch(m["dot"]))
            bracketed = bracketed or own
            label = m["label"].lower()
            if label in _ENDINGS or bracketed and (own or first or m["dot"] == ".") and len(label) >= 2 and label.isalpha():
                end = m.end()
            at, first = m.end(), False
        return end

    def addresses(self) -> None:
        parts: list[tuple[int, int, str]] = []
        pos = 0
        while name := _LOCAL_PART.search(self.text, pos):
            pos = name.end()
            m = _SIGN.match(self.text, pos)
            end = m and self.domain_end(m, bool(m["bracketed"] or _BRACKETED_DOT.search(self.text, *name.span())))
            if not end:
                continue
            spoken_at = m["at"].strip().lower() in AT_WORDS
            if spoken_at and not _DOT_PART.search(self.text, m.end("at"), end):
                continue  # "meet at example.com" is no address
            pos = end
            if m["at"] != "@":
                a, b = m.span("at")
                parts.append((a, b, "@"))
            parts += [(d.start(), d.end(), ".") for side in ((name.start(), m.start("at")), (m.end("at"), end)) for d in _DOT_PART.finditer(self.text, *side)]
        self.replace(sorted(parts))

    def digits(self) -> None:
        parts: list[tuple[int, int, str]] = []
        for m in RUN.finditer(self.text):
            items = list(_RUN_PART.finditer(self.text, m.start(), m.end()))
            if sum(p["digit"] is not None for p in items) < 3:
                continue
            ends = card_ends(items) | ip_ends(items)
            for k, p in enumerate(items):
                c = "\n" if k in ends else DIGITS[p["digit"].lower()] if p["digit"] else "." if p["dot"] else "+" if p["plus"] else "" if p["gap"] else p["number"]
                if c != p[0]:
                    parts.append((p.start(), p.end(), c))
        self.replace(parts)

    def source(self, a: int, b: int) -> tuple[int, int]:
        return int(self.start[a:b].min()), int(self.end[a:b].max())


def spans(text: str | None, disguised: bool = True) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) in code points of the text; `disguised` says whether rewriting could matter."""
    if not text:
        return [], []
    base = plain_spans(text)
    if not disguised:
        return base, base
    seen = Rewritten(text)
    seen.characters()
    seen.addresses()
    seen.digits()
    if seen.text == text:
        return base, base
    added: list[Span] = []
    for kind, a, b in plain_spans(seen.text):
        start, end = seen.source(a, b)
        if not any(k == kind and x <= start and end <= y for k, x, y in base):
            added.append((kind, start, end))
    return base, ordered(base + added)


def spans_of(texts: pa.Array) -> list[tuple[list[Span], list[Span]]]:
    """spans() of each text of a column; only those with some trigger are looked at one by one."""
    plain, disguised = (pc.match_substring_regex(texts, pattern, ignore_case=True).fill_null(False).to_pylist() for pattern in (MAY_BE_PLAIN, MAY_BE_DISGUISED))
    return [spans(texts[i].as_py(), d) if p or d else ([], []) for i, (p, d) in enumerate(zip(plain, disguised))]


def shown(found: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def masked(text: str | None, found: list[Span]) -> str | None:
    """The text with each span, or each chain of overlapping ones, replaced by the name of its first kind."""
    if not text or not found:
        return text
    out, last = [], 0
    for kind, a, b in found:
        if a >= last:
            out += [text[last:a], f"[{kind.upper()}]"]
        last = max(last, b)
    return "".join(out) + text[last:]


def detected(docs: DataFrame) -> DataFrame:
    """Counts and digest of the base spans and all spans, for every row of `docs` (doc_id, text)."""

    def run(batch: pa.RecordBatch) -> dict:
        found = spans_of(batch.column(1))
        out = {"doc_id": batch.column(0)}
        for kind in KINDS:
            out[f"n_{kind}"] = pa.array([sum(s[0] == kind for s in base) for base, _ in found], pa.int64())
        out["base_sha256"] = pa.array([hashlib.sha256(shown(base).encode()).hexdigest() for base, _ in found], pa.string())
        return out | {"spans": pa.array([shown(every) for _, every in found], pa.string())}

    return in_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(docs: DataFrame) -> DataFrame:
    """`docs` with personal data in `text` masked and `n_chars`, if there, counted again; all other columns as they are."""

    def run(batch: pa.RecordBatch) -> dict:
        texts = [masked(t, every) for t, (_, every) in zip(batch.column("text").to_pylist(), spans_of(batch.column("text")))]
        out = {c: batch.column(c) for c in batch.schema.names} | {"text": pa.array(texts, pa.string())}
        if "n_chars" in out:
            out["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
        return out

    return in_arrow(docs, run, ", ".join(f"`{c}` {kind}" for c, kind in docs.dtypes))
