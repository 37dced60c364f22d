"""Personal data in texts: emails, IPv4 addresses, card and phone numbers, also where they are disguised.

Plain ones are found by fixed patterns in the text itself (the base spans). Disguised ones are found in what two transducers make of
it: the first turns look-alike letters, digits and signs of other scripts into ASCII and drops invisible characters, the second
turns at/dot disguises into their signs, spelled digits into digits, and O and l among digits into 0 and 1. Each transducer
keeps where the pieces it replaced lay, so a span found in its output is mapped back to the source characters that made it.

A span is kind, start, end (code points, the end exclusive). Base spans always stay; a disguised one is added unless a base span of
its kind holds it whole. Texts are judged whole; all patterns take linear time, so long texts and long runs of one character are safe.

Defined cases: a null text counts as empty and has no spans; a bare "at" counts only before a domain whose first dot is spelled
too ("ann at mail dot example dot org"), so prose such as "look at example.org" stays clean; an added email ends in letters; rows
that repeat an id have their own spans; an empty table gives an empty result; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read

KINDS = ("email", "ip", "card", "phone")

# ---------------------------------------------------------------------------------------------- plain patterns

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_GROUP = re.compile(r"[0-9]+")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local part, @, domain; the local part is walked back from each @, so long runs cost nothing."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    """Four numbers of at most 255 between dots; of a longer chain four after four."""
    out = []
    for chain in _DOTTED.finditer(text) if "." in text else ():
        groups = [g.span() for g in _GROUP.finditer(text, *chain.span())]
        for i in range(0, len(groups) - 3, 4):
            if all(int(text[a:b].lstrip("0")[:4] or "0") <= 255 for a, b in groups[i : i + 4]):
                out.append((groups[i][0], groups[i + 3][1]))
    return out


def luhn(digits: str) -> bool:
    twice = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(int(d) for d in digits[-1::-2]) + sum(d - 9 if d > 9 else d for d in twice)) % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15] if "+" in text else []


def spans_of(text: str) -> list[tuple[str, int, int]]:
    """Plain spans by kind, then start."""
    return [(k, a, b) for k, find in zip(KINDS, (emails, addresses, cards, phones), strict=True) for a, b in find(text)]


# ---------------------------------------------------------------------------------------------- transducers


class Rewritten:
    """A text after replacements, and where its characters come from.

    cuts: where each replacement begins and ends in the source, and its new text, in order.
    """

    def __init__(self, source: str, cuts: list[tuple[int, int, str]]):
        parts, self.begin, self.to, at, n = [], [0], [(0, 0, False)], 0, 0
        for a, b, new in cuts:
            parts += (source[at:a], new)
            n += a - at
            # a piece that replaces is one unit; what follows runs in step again
            self.begin += (n, n + len(new))
            self.to += ((a, b, True), (b, b, False))
            n, at = n + len(new), b
        parts.append(source[at:])
        self.text = "".join(parts)

    def _source(self, i: int, end: bool) -> int:
        """Where character i begins (or ends) in the source."""
        k = bisect_right(self.begin, i) - 1
        a, b, whole = self.to[k]
        return (b if end else a) if whole else a + i - self.begin[k] + end

    def back(self, start: int, end: int) -> tuple[int, int]:
        """The source characters that made [start, end)."""
        return self._source(start, False), self._source(end - 1, True)


#: Letters of other scripts that look like Latin ones, each before the one it looks like.
LOOK_ALIKES = (
    "АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ЅS ІI ЈJ Ԛ" "Q ԜW аa еe оo рp сc уy хx ѕs іi јj ԛq ԝw һh ԁd ӏl "
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX οo νv ιi κk ρp αa ɑa ɡg ıi Օ" "O օo ո" "n ս" "u"
)
#: Signs that stand for others (the rest follows from compatibility forms and digit values).
SIGNS = {"\u3002": ".", "\u2044": "/", **dict.fromkeys("\u2010\u2011\u2012\u2013\u2014\u2015\u2212", "-"), **dict.fromkeys("\u2028\u2029", " ")}
#: Characters that aren't seen.
UNSEEN = "\u00ad\u034f\u061c\u180e\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\u2064\ufeff"


@cache
def _ascii_of(c: str) -> str:
    """What a character looks like in ASCII; itself if it looks like nothing there."""
    if c in _LOOKS:
        return _LOOKS[c]
    digit = unicodedata.decimal(c, None)
    if digit is not None:
        return str(digit)
    plain = unicodedata.normalize("NFKC", c)
    return plain if len(plain) == 1 and plain.isascii() else c


_LOOKS = {x[0]: x[1] for x in LOOK_ALIKES.split()} | SIGNS | dict.fromkeys(UNSEEN, "")


def plain_characters(text: str) -> Rewritten:
    """Look-alikes as ASCII, invisible characters gone."""
    odd = [] if text.isascii() else [c for c in set(text) if c > "\x7f" and _ascii_of(c) != c]
    if not odd:
        return Rewritten(text, [])
    return Rewritten(text, [(m.start(), m.end(), _ascii_of(m.group())) for m in re.finditer("[" + "".join(map(re.escape, odd)) + "]", text)])


#: Digits as words (English, German, Spanish, French), by their value.
DIGIT_WORDS = (
    "zero oh null cero zéro", "one eins uno un", "two zwei dos deux", "three drei tres trois", "four vier cuatro quatre",
    "five fünf cinco cinq", "six sechs seis", "seven sieben siete sept", "eight acht ocho huit", "nine neun nueve neuf",
)
_VALUE = {w: str(v) for v, words in enumerate(DIGIT_WORDS) for w in words.split()}
_TIMES = {"double": 2, "triple": 3}
_SPOKEN = frozenset([*_VALUE, *_TIMES, "plus"])
_LETTERS = re.compile(r"[^\W\d_]+")
_BETWEEN = re.compile(r",? |-")
_OPEN, _CLOSE, _LABEL = r"[\[({<]", r"[\])}>]", r"[a-z0-9-]{1,63}"
_DOT_IN = rf"{_OPEN}\s{{0,2}}(?:dot|punkt|punto|point|\.)\s{{0,2}}{_CLOSE}|&#46;|&period;"
_DOT = rf"(?:\s{{0,3}}(?:{_DOT_IN})\s{{0,3}}|\s{{1,3}}dot\s{{1,3}}|[_-]dot[_-])"
#: Each pattern begins with a letter or sign to look for, so texts without it are passed over fast; what stands before is checked after.
_BRACKETED = re.compile(rf"(?P<at>{_OPEN}\s{{0,2}}(?:at|@|\u00e4t)\s{{0,2}}{_CLOSE})|{_OPEN}\s{{0,2}}(?:dot|punkt|punto|point|\.)\s{{0,2}}{_CLOSE}")
_ENTITY = re.compile(r"(?P<at>&#64;|&commat;)|&#46;|&period;")
_BARE_AT = re.compile(rf"(?P<at>at(?:(?<=\sat)(?=\s{{1,3}}{_LABEL}{_DOT}[a-z0-9])|(?<=[_-]at)(?=[_-]{_LABEL}(?:{_DOT}|\.){_LABEL})))")
_BARE_SIGN = re.compile(rf"(?P<at>@(?<=\s@)(?=\s{{1,3}}{_LABEL}(?:{_DOT}|\.)[a-z]))")
_BARE_DOT = re.compile(r"dot(?:(?<=\sdot)(?=\s)|(?<=[_-]dot)(?=[_-]))")
_MIXED = re.compile(r"[0-9][oOlI]|[oOlI][0-9]")
_FIX, _FIXED = str.maketrans("oOlI", "0011"), frozenset("oOlI0123456789")


def _lower(text: str) -> str:
    """Lower case, character by character, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _signs(low: str) -> list[tuple[int, int, str]]:
    """at/dot disguises with what surrounds them (up to three spaces, or a line or dash); both sides must be letters or digits."""
    out = []
    for pattern in (_BRACKETED, _ENTITY, _BARE_AT, _BARE_SIGN, _BARE_DOT):
        for m in pattern.finditer(low):
            a, b = m.span()
            if a > 0 and b < len(low) and low[a - 1] in "_-" and low[b] in "_-":
                a, b = a - 1, b + 1
            while a > 0 and m.start() - a < 3 and low[a - 1].isspace():
                a -= 1
            while b < len(low) and b - m.end() < 3 and low[b].isspace():
                b += 1
            if a > 0 and b < len(low) and low[a - 1].isalnum() and low[b].isalnum():
                out.append((a, b, "@" if m.groupdict().get("at") else "."))
    return sorted(out)


@lru_cache(maxsize=4096)
def _any_of(words: frozenset[str]) -> re.Pattern:
    return re.compile("(?:" + "|".join(sorted(words, key=len, reverse=True)) + r")(?![^\W\d_])")


def _spelled(low: str, signs: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Runs of digits as words, with doubled ones, and "plus" before digits.

    One word alone counts only between digits or beside a dot's disguise: many are also articles.
    """
    held = _SPOKEN.intersection(_LETTERS.findall(low))
    if not held:
        return []
    out: list[tuple[int, int, str]] = []
    sign_at, sign_from = {b for _, b, _ in signs}, {a for a, _, _ in signs}
    plus, times, run = None, None, []  # run: (start, end, digits)

    def flush() -> None:
        nonlocal plus, run
        if run:
            a, b = run[0][0], run[-1][1]
            joined = plus is not None and _BETWEEN.fullmatch(low, plus[1], a)
            left = joined or a in sign_at or (a > 1 and low[a - 1] in " -" and low[a - 2].isdigit())
            right = b in sign_from or (b + 1 < len(low) and low[b] in " -" and low[b + 1].isdigit())
            if len(run) > 1 or (left and right) or a in sign_at or b in sign_from:
                out.append((plus[0] if joined else a, b, ("+" if joined else "") + "".join(x[2] for x in run)))
        elif plus and plus[1] + 1 < len(low) and low[plus[1]] in " -" and low[plus[1] + 1].isdigit():
            out.append((plus[0], plus[1] + 1, "+"))
        plus, run = None, []

    for m in _any_of(held).finditer(low):
        word, (a, b) = m.group(), m.span()
        if a > 0 and low[a - 1].isalpha():
            continue
        if word in _VALUE:
            bound = times is not None and _BETWEEN.fullmatch(low, times[1], a)
            start = times[0] if bound else a
            if run and not _BETWEEN.fullmatch(low, run[-1][1], start):
                flush()
            elif not run and plus and not _BETWEEN.fullmatch(low, plus[1], start):
                flush()
            run.append((start, b, _VALUE[word] * (_TIMES[times[2]] if bound else 1)))
            times = None
        elif word in _TIMES:
            times = (a, b, word)
        else:
            times = None
            flush()
            plus = (a, b)
    flush()
    return out


def _mixed(text: str) -> list[tuple[int, int, str]]:
    """O and l in numbers: whole words of them and digits, of at most 20 characters."""
    out, done = [], 0
    for m in _MIXED.finditer(text):
        a, b = m.span()
        if a < done:
            continue
        while a > 0 and m.start() - a < 20 and text[a - 1] in _FIXED:
            a -= 1
        while b < len(text) and b - a < 21 and text[b] in _FIXED:
            b += 1
        done = b
        if b - a <= 20 and not (a > 0 and text[a - 1].isalnum()) and not (b < len(text) and text[b].isalnum()):
            out.append((a, b, text[a:b].translate(_FIX)))
    return out


def plain_signs(text: str) -> Rewritten:
    """at/dot disguises as signs, spelled digits as digits, O and l among digits as 0 and 1."""
    low = _lower(text)
    signs = _signs(low)
    kept, end = [], 0
    for c in sorted(signs + _spelled(low, signs) + _mixed(text)):
        if c[0] >= end:
            kept.append(c)
            end = c[1]
    return Rewritten(text, kept)


def _credible(kind: str, found: str) -> bool:
    """Disguised emails must end in a top-level name of letters."""
    return kind != "email" or bool(re.fullmatch("[A-Za-z]{2,24}", found.rpartition(".")[2]))


def all_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, added spans), each by kind, then start."""
    base = spans_of(text)
    first = plain_characters(text)
    second = plain_signs(first.text)
    if second.text == text:
        return base, []
    held: dict[str, list[tuple[int, int]]] = {k: [(a, b) for x, a, b in base if x == k] for k in KINDS}
    added = set()
    for kind, a, b in spans_of(second.text):
        if _credible(kind, second.text[a:b]):
            start, end = first.back(*second.back(a, b))
            i = bisect_right(held[kind], (start, float("inf"))) - 1
            if i < 0 or held[kind][i][1] < end:
                added.add((kind, start, end))
    return base, sorted(added, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


# ---------------------------------------------------------------------------------------------- documents

SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])


def found(docs: DataFrame, text: bool = False) -> DataFrame:
    """doc_id, spans (kind, start, end, base) of every row, by kind and start; with text also the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for value in batch.column("text"):  # one text at a time
                base, added = all_spans(value.as_py() or "")
                both = [(*x, True) for x in base] + [(*x, False) for x in added]
                both.sort(key=lambda x: (KINDS.index(x[0]), x[1], x[2]))
                spans.append([dict(zip(("kind", "start", "end", "base"), x, strict=True)) for x in both])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, pa.list_(SPAN)), *([batch.column("text")] if text else [])], ["doc_id", "spans", *(["text"] if text else [])])

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, spans array<struct<kind: string, start: bigint, end: bigint, base: boolean>>" + (", text string" if text else "")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def redacted(docs: DataFrame) -> DataFrame:
    """doc_id, text: each span replaced by its kind in brackets; spans that overlap become one, of the kind that begins first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for value in batch.column("text"):
                text = value.as_py()
                base, added = all_spans(text or "")
                merged: list[list] = []
                for kind, a, b in sorted(base + added, key=lambda x: (x[1], -x[2])):
                    if merged and a < merged[-1][2]:
                        merged[-1][2] = max(merged[-1][2], b)
                    else:
                        merged.append([kind, a, b])
                texts.append(None if text is None else Rewritten(text, [(a, b, f"[{kind}]") for kind, a, b in merged]).text)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, text string")


def op12_pii(spark, sf_dir: str) -> DataFrame:
    """Counts and digest of the base spans, and all spans, of every document."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    added = F.size(F.filter("spans", lambda s: ~s["base"])).cast("long")
    out = found(read(spark, sf_dir, "documents"))
    return out.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), added.alias("n_added"))
