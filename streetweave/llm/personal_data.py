"""Personal data in texts: e-mail and IP addresses, card and phone numbers, plain or disguised.

The plain patterns run over the text as it stands. Then three transducers rewrite it, each with a map from
every character it writes to the source characters it stands for:

1. ``fold``: letters of other scripts that look like Latin ones, full-width and styled forms, digits of any
   script, odd spaces, dots and dashes become ASCII; invisible characters and character references go;
   O and l inside numbers become 0 and 1.
2. ``numerals``: digits that are spelled out, at least three of them in a row, in four languages, with
   "double", "plus", "dot" and "dash" between them.
3. ``signs``: "[at]", "(dot)", " at ... dot com" and the like around names, and dots between numbers.

The plain patterns run again over what comes out, and what they find is mapped back: a span of the source,
in code points, end exclusive. Spans that the first pass has, or that lie inside one of its spans of that
kind, aren't reported again. So plain spans stay as they are and disguised ones are added.

A rewriting needs its context: "at" between words is a sign only where a domain with a disguised dot follows
and, with nothing but plain words, a known ending. Everything takes time in proportion to the text, also for
long runs of letters, digits or blanks, and a text is processed whole within a task. Null and empty texts have
no spans; repeated rows each get a row; a null doc_id is an id like any other."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

# Kinds in their order, and the patterns of the contract, in forms that need no backtracking.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_NAME = "abcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# Letters that look like Latin ones, after which they are named here, and other characters.
_LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ɡ": "g", "ո": "n",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ω": "w",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ı": "i", "ℓ": "l",
    "·": ".", "•": ".", "‧": ".", "∙": ".", "⋅": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "―": "-", "−": "-", "⁃": "-", "\t": " ",
}
_INVISIBLE = "­͏᠎​‌‍‎‏⁠⁡⁢⁣⁤︎️﻿"
_REFERENCES = {"&#64;": "@", "&#x40;": "@", "&commat;": "@", "&#46;": ".", "&#x2e;": ".", "&period;": ".", "&#43;": "+", "&plus;": "+", "%40": "@", "&nbsp;": " "}
# Digits in English, French, German and Spanish, and words around them.
_NUMERALS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_SIGNS = {"dot": ".", "point": ".", "punkt": ".", "punto": ".", "dash": "-", "hyphen": "-", "minus": "-", "plus": "+", "más": "+"}
_TIMES = {"double": 2, "triple": 3}
#: Endings of domains that make " at ... dot ..." an address without any brackets.
_ENDINGS = frozenset("com org net edu gov mil int info biz name io dev app co uk de fr es eu nl ch ru cn jp example test invalid".split())

_NUMERAL, _WORD = ("|".join(sorted(w, key=len, reverse=True)) for w in (_NUMERALS, [*_NUMERALS, *_SIGNS, *_TIMES]))
#: All on lower-cased texts. A run of spelled digits begins with one, and two more tokens follow.
_RUN = re.compile(rf"\b(?:{_NUMERAL})\b(?:[ \n,;:/()-]{{0,3}}+(?:\b(?:{_WORD})\b|[0-9]+|[+.])){{2}}")
_BEFORE = re.compile(rf"(?:(?<!\w)(?:{'|'.join([*_TIMES, 'plus', 'más'])})|\+)[ -]?\Z")
_TOKEN = re.compile(rf"(?<!\w)(?:{_WORD})(?!\w)|[0-9]+|[+.]")
_GAP = re.compile(r"[ \n,;:/()-]{0,3}")
_HINT = re.compile(r"[0-9][OoIl]|[OoIl][0-9]")
_MIXED = re.compile(r"(?<![A-Za-z0-9])(?=[OoIl]*[0-9])[0-9OoIl]{2,}(?![A-Za-z0-9])")
_DOT_WORD, _AT_WORD = "dot|point|punkt|punto", "at|arroba|arobase"
_LABEL = re.compile(r"[a-z0-9-]++(?:\.[a-z0-9-]++)*+")
_DOT = re.compile(rf"\s*+[\[({{<]\s*+(?:{_DOT_WORD}|\.|d0t)\s*+[\])}}>]\s*+|\s++(?:{_DOT_WORD})\s++|_dot_|\s++\.\s*+")
_BRACKETED_AT = rf"[\[({{<]\s*+(?:{_AT_WORD}|@|a|ät)\s*+[\])}}>]"
_WORD_AT = rf"(?<=[\s_])(?:{_AT_WORD})(?=[\s_]++[a-z0-9-]++(?:\.[a-z0-9]|\s*+[\[({{<]|\s++(?:{_DOT_WORD}|\.)\s|_dot_))"
_AT = re.compile(f"{_BRACKETED_AT}|{_WORD_AT}|@")
_NUMBER_DOT = re.compile(rf"(?<=[0-9])\s{{0,3}}+(?:[\[({{<]\s*+(?:{_DOT_WORD}|\.|d0t)\s*+[\])}}>]|(?<=\s)(?:{_DOT_WORD})(?=\s))\s{{0,3}}+(?=[0-9])")
_NAME_DOT = re.compile(rf"(?:[\[({{<]\s?(?:{_DOT_WORD}|\.|d0t)\s?[\])}}>]|(?<=\s)dot|(?<=[a-z0-9])_dot_)\Z")
_NAME_END = re.compile(r"[a-z0-9%+]")
#: A name that no word of prose looks like.
_NAME_LIKE = re.compile(r"[a-z][a-z0-9-]*(?:[0-9]|[._][a-z0-9])[a-z0-9._%+-]*\Z")
_UNSEEN = re.compile(f"[{_INVISIBLE}]+")
_REFERENCE = re.compile("|".join(map(re.escape, _REFERENCES)), re.I)
_BLANK = " \t\n\r\f\v"


@cache
def _folds() -> tuple[re.Pattern, dict[int, str]]:
    """A pattern of the characters that ``fold`` replaces one by one, and what by."""
    table = {ord(k): v for k, v in _LOOKALIKES.items() if k != "\t"}
    for first, last in ((0x2000, 0x2100), (0x2460, 0x24FF), (0x3000, 0x3001), (0xFE50, 0xFE6F), (0xFF00, 0xFFEF), (0x1D400, 0x1D800), (0xA0, 0xA1)):
        for c in range(first, last):
            plain = unicodedata.normalize("NFKC", chr(c))
            if len(plain) == 1 and " " <= plain <= "~":
                table.setdefault(c, plain)
    for c in range(0x80, sys.maxunicode + 1):
        if unicodedata.category(chr(c)) == "Nd":
            table.setdefault(c, str(unicodedata.digit(chr(c))))
    near = "".join(re.escape(chr(c)) for c in sorted(table) if c < 0x10000)
    return re.compile(f"[{near}\U00010000-\U0010ffff]"), table


def _lower(text: str) -> str:
    """Lower case, character for character."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(x := c.lower()) != 1 else x for c in text)


@dataclass
class Mapped:
    """A text, and for each of its characters where it begins and ends in the source; None: where it is."""

    text: str
    starts: np.ndarray | None = None
    ends: np.ndarray | None = None

    def rewritten(self, edits: list[tuple[int, int, str]]) -> Mapped:
        """With [a, b) replaced by a string for each edit, which come in order and don't overlap."""
        if not edits:
            return self
        starts = np.arange(len(self.text), dtype=np.int32) if self.starts is None else self.starts
        ends = np.arange(1, len(self.text) + 1, dtype=np.int32) if self.ends is None else self.ends
        pieces, first, last, at = [], [], [], 0
        for a, b, new in edits:
            pieces += [self.text[at:a], new]
            first += [starts[at:a], np.full(len(new), starts[a], np.int32)]
            last += [ends[at:a], np.full(len(new), ends[b - 1], np.int32)]
            at = b
        return Mapped("".join([*pieces, self.text[at:]]), np.concatenate([*first, starts[at:]]), np.concatenate([*last, ends[at:]]))

    def source(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.starts is None else (int(self.starts[a]), int(self.ends[b - 1]))


def fold(m: Mapped) -> Mapped:
    if not m.text.isascii():
        pattern, table = _folds()
        if pattern.search(m.text):
            m = Mapped(m.text.translate(table), m.starts, m.ends)
        m = m.rewritten([(x.start(), x.end(), "") for x in _UNSEEN.finditer(m.text)])
    if "&" in m.text or "%40" in m.text:
        m = m.rewritten([(x.start(), x.end(), _REFERENCES[x[0].lower()]) for x in _REFERENCE.finditer(m.text)])
    if not _HINT.search(m.text):
        return m
    return m.rewritten([(x.start(), x.end(), x[0].translate({79: "0", 111: "0", 73: "1", 108: "1"})) for x in _MIXED.finditer(m.text) if not x[0].isdigit()])


def numerals(m: Mapped, least: int = 3) -> Mapped:
    """Runs with ``least`` or more spelled digits, gaps between them left out."""
    text, edits, at = _lower(m.text), [], 0
    while found := _RUN.search(text, at):
        # a run may begin before its first digit: plus, double
        first = found.start()
        before = _BEFORE.search(text, max(at, first - 8), first)
        run, end = [], before.start() if before else first
        while token := _TOKEN.match(text, end if not run else _GAP.match(text, end).end()):
            run.append(token)
            end = token.end()
        words = [t[0] for t in run]
        while words and words[-1] not in _NUMERALS and not words[-1].isdigit():
            words.pop()
            run.pop()
        at = max(found.end(), run[-1].end() if run else 0)
        if sum(w in _NUMERALS for w in words) < least:
            continue
        times = 1
        for k, (t, w) in enumerate(zip(run, words, strict=True)):
            spelled = w in _NUMERALS or w in _SIGNS or w in _TIMES
            if k and (gap := (run[k - 1].end(), t.start()))[0] < gap[1] and (spelled or words[k - 1] in _NUMERALS):
                edits.append((*gap, ""))
            if w in _TIMES:
                times = _TIMES[w]
                edits.append((t.start(), t.end(), ""))
            elif spelled:
                edits.append((t.start(), t.end(), _NUMERALS[w] * times if w in _NUMERALS else _SIGNS[w]))
                times = 1
    return m.rewritten(edits)


def _domain_after(text: str, at: int) -> tuple[list[tuple[int, int, str]], int, str]:
    """Edits of disguised dots in the domain that begins here, how many labels it has, and the last one."""
    edits, label = [], _LABEL.match(text, at)
    if not label:
        return [], 0, ""
    n, last = label[0].count(".") + 1, label
    while (dot := _DOT.match(text, last.end())) and (label := _LABEL.match(text, dot.end())):
        edits.append((dot.start(), dot.end(), "."))
        n, last = n + label[0].count(".") + 1, label
    return edits, n, last[0].rsplit(".", 1)[-1]


def _name_before(text: str, least: int, end: int) -> list[tuple[int, int, str]]:
    """Edits of disguised dots in the name that ends here."""
    edits = []
    while True:
        start = least + len(text[least:end].rstrip(_NAME))
        stem = text[least:start].rstrip(_BLANK)
        # a disguised dot is a few characters long, blanks apart
        if start == end or not (dot := _NAME_DOT.search(stem[-12:])):
            return edits
        a = least + len(stem[: len(stem) - len(dot[0])].rstrip(_BLANK))
        if a == least or not _NAME_END.match(text, a - 1):
            return edits
        edits.insert(0, (a, start, "."))
        end = a


def signs(m: Mapped) -> Mapped:
    text, edits, done = _lower(m.text), [], 0
    for x in _AT.finditer(text):
        if x.start() < done:
            continue
        word = x[0][0] not in "[({<@"
        left = done + len(text[done : x.start()].rstrip(_BLANK + "_" * word))
        right = x.end()
        while right < len(text) and text[right] in (_BLANK + "_" if word else _BLANK):
            right += 1
        if left == done or not _NAME_END.match(text, left - 1):
            done = max(done, left)
            continue
        dots, labels, last = _domain_after(text, right)
        name = _name_before(text, done, left)
        known = last in _ENDINGS
        if word:
            marked = x[0] != "at" or any(text[a:b].strip()[0] in "[({<_" for a, b, _ in dots)
            like = known and _NAME_LIKE.search(text, done + len(text[done:left].rstrip(_NAME)), left)
            fits = (dots and (marked or known)) or like
        else:
            # a spaced "@" of prose, as in prices, is a sign only before a known ending
            fits = dots or name or known or x[0] != "@" or (left, right) == (x.start(), x.end())
        if labels < 2 or not fits:
            continue
        sign = [] if (left, right) == (x.start(), x.end()) and x[0] == "@" else [(left, right, "@")]
        edits += [*name, *sign, *dots]
        done = (dots or sign or [(left, right)])[-1][1]
    taken = iter([*edits, (len(text), len(text), "")])
    edge, between = next(taken), []
    for x in _NUMBER_DOT.finditer(text):
        while edge[1] <= x.start() and edge[0] < len(text):
            edge = next(taken)
        if x.end() <= edge[0]:
            between.append((x.start(), x.end(), "."))
    return m.rewritten(sorted([*edits, *between]))


def _luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def plain_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) by the patterns: leftmost, not overlapping within a kind; failing matches are dropped."""
    at = text.find("@")
    done = 0
    while at >= 0:
        found = _DOMAIN.match(text, at)
        start = done + len(text[done:at].rstrip(_LOCAL)) if found else at
        done = at + 1 if not found or start == at else found.end()
        if found and start < at:
            yield "email", start, found.end()
        at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m[0].split(".")):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and _luhn(digits):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGIT.findall(m[0])) <= 15:
                yield "phone", m.start(), m.end()


def all_spans(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, plain) in order of start and kind; those that aren't plain come from the rewritten text."""
    plain = sorted(plain_spans(text), key=lambda s: (s[1], KINDS.index(s[0])))
    m = signs(numerals(fold(Mapped(text))))
    if m.text == text:
        return [(*s, True) for s in plain]
    inside = {k: [(a, b) for kind, a, b in plain if kind == k] for k in KINDS}
    added = set()
    for kind, a, b in plain_spans(m.text):
        a, b = m.source(a, b)
        k = np.searchsorted(np.array([x for x, _ in inside[kind]]), a, side="right") - 1
        if k < 0 or inside[kind][k][1] < b:
            added.add((kind, a, b))
    both = [*[(*s, True) for s in plain], *[(*s, False) for s in added]]
    return sorted(both, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


_SPANS = "array<struct<kind:string,start:long,end:long,plain:boolean>>"


def spans(text: Column) -> Column:
    """The spans of a text as structs of kind, start, end and plain."""

    @arrow_udf(_SPANS)
    def find(texts: pa.Array) -> pa.Array:
        rows = [[dict(zip(("kind", "start", "end", "plain"), s, strict=True)) for s in all_spans(x.as_py() or "")] for x in texts]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("plain", pa.bool_())]))
        return pa.array(rows, kind)

    return find(text)


def redacted(text: Column) -> Column:
    """The text with each span, joined with those it overlaps, replaced by its first kind in brackets."""

    @arrow_udf("string")
    def mask(texts: pa.Array) -> pa.Array:
        def one(t: str | None) -> str | None:
            if not t:
                return t
            pieces, at = [], 0
            for kind, a, b, _ in all_spans(t):
                if a >= at:
                    pieces += [t[at:a], f"[{kind}]"]
                at = max(at, b)
            return "".join([*pieces, t[at:]])

        return pa.array([one(x.as_py()) for x in texts], pa.string())

    return mask(text)


def _same(a: Column, b: Column) -> Column:
    return a == b


def _joined(each: Column) -> Column:
    return F.array_join(F.transform(each, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def found(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (plain spans), base_sha256 of the plain spans, spans (all of them),
    n_added: a row for each document."""
    rows = docs.select("doc_id", spans(docs["text"]).alias("s"))
    plain = F.filter("s", lambda s: s["plain"])
    kinds = F.transform(plain, lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, partial(_same, F.lit(k)))).cast("long").alias(f"n_{k}") for k in KINDS]
    added = F.size(F.filter("s", lambda s: ~s["plain"])).cast("long").alias("n_added")
    return rows.select("doc_id", *counts, F.sha2(_joined(plain).cast("binary"), 256).alias("base_sha256"), _joined(F.col("s")).alias("spans"), added)
