"""Personal data: plain identifiers, and disguised ones found through offset-preserving transducers.

`plain` finds e-mail addresses, IPv4 addresses, payment cards and phone numbers as they are written.
`disguised` rewrites the text by five transducers, each of which records what it replaced:

1. look-alikes and compatibility forms (full-width, mathematical, small capitals) become ASCII, invisible characters go;
2. runs of seven or more spelled digits, in four languages, become digits ("plus" before them becomes "+");
3. letters that stand for digits (O, I, l) inside long digit groups become digits;
4. four digit groups joined by "[.]", "(dot)" or "dot" become IPv4 addresses;
5. "name (at) host (dot) tld", "name at host dot tld" and mixtures become addresses, with names such as "john dot doe".

The same finders then run on the rewritten text, and a span is mapped back through the records to the
source characters. A mapped span counts only if its source reads differently from its rewritten
form and overlaps no plain span of its kind, so plain text gains nothing; but it may contain a plain one that is only a part of it
("john[dot]doe@example.com"), and then stands beside it. `redact` covers the union of all spans.

Defined cases: a null text is empty and has no spans; long texts are searched whole, in linear time;
repeated rows each get their own result; empty tables give no rows. Spans are (kind, start, end) in code
points, ends exclusive, by start and then by kind as in KINDS. `redact` keeps all columns, whatever their
names; `scan` reads only the id and the text.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import bounded_batches

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, kind's number, end

# --- plain identifiers ---

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_DIGIT = re.compile(r"[0-9]")


def _local_start(text: str, at: int, least: int) -> int:
    """Where the run of local-part characters that ends before `at` starts."""
    i = at
    while i > least and text[i - 1] in _LOCAL:
        i -= 1
    return i


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern local@label(.label)+ from left to right, found from each @ so that long runs cost linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        if (start := _local_start(text, at, done)) < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def plain(text: str) -> list[Span]:
    out: list[Span] = []
    if "@" in text:
        out += [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_small, m.groups()))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := _NOT_DIGIT.sub("", m.group())) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return sorted(out)


# --- transducers ---

#: Letters of other scripts and signs that look like the ASCII ones below them.
_LOOKS = "аеорсухіјѕԁһӏѵԛԝүк" + "АВЕКМНОРСТХІЈЅ" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρικυα" + "օոսհցյ" + "ıɑɡɩ" + "。․﹒" + "﹫" + "‐‑‒–−﹣"
_ASCII = "aeopcyxijsdhlvqwyk" + "ABEKMHOPCTXIJS" + "ABEZHIKMNOPTYXovpikua" + "onuhgj" + "iagi" + "..." + "@" + "------"


def _folds() -> dict[int, str]:
    """Characters that stand for one ASCII character: full-width, mathematical and other compatibility forms, small capitals, decimal
    digits of any script, and the look-alikes above."""
    out = {}
    for c in range(0x80, 0x20000):
        x, kind = chr(c), unicodedata.category(chr(c))
        if kind == "Nd":
            out[c] = str(unicodedata.decimal(x))
        elif kind[0] in "LPS" and len(n := unicodedata.normalize("NFKC", x)) == 1 and "!" <= n <= "~":
            out[c] = n
        elif kind[0] == "L" and re.fullmatch("LATIN LETTER SMALL CAPITAL [A-Z]", n := unicodedata.name(x, "")):
            out[c] = n[-1].lower()
    return out | dict(zip(map(ord, _LOOKS), _ASCII, strict=True))


_FOLD = _folds()
#: Characters without a width of their own.
_UNSEEN = "".join(chr(c) for c in range(0x80, 0x20000) if unicodedata.category(chr(c)) == "Cf") + "\u034f\u115f\u1160\u3164"


def _class(chars: set[int]) -> str:
    """A character class of ranges."""
    parts = []
    for c in sorted(chars):
        if parts and parts[-1][1] == c - 1:
            parts[-1][1] = c
        else:
            parts.append([c, c])
    return "[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in parts) + "]"


#: All beyond 16 bits is one range, as the expressions' engine tries ranges there in turn; translating changes nothing else.
_ODD = re.compile(_class({*(c for c in _FOLD if c < 1 << 16), *(c for c in map(ord, _UNSEEN) if c < 1 << 16), *range(1 << 16, 1 << 17)}))
_GONE = re.compile(_class(set(map(ord, _UNSEEN))) + "+")

#: Digits as words, in English, German, French and Spanish.
_DIGIT_WORDS = """zero oh one two three four five six seven eight nine
null - eins zwei drei vier fünf sechs sieben acht neun
zéro - un deux trois quatre cinq six sept huit neuf
cero - uno dos tres cuatro cinco seis siete ocho nueve"""
_WORDS = {w: str(max(i - 1, 0)) for line in _DIGIT_WORDS.split("\n") for i, w in enumerate(line.split()) if w != "-"}
_ANY_WORD = "|".join(sorted(_WORDS, key=len, reverse=True))
_SPELLED = re.compile(rf"(?<!\w)(?:plus[\s,.-]{{1,3}})?(?:{_ANY_WORD})(?:[\s,.-]{{1,3}}(?:{_ANY_WORD}))" + r"{6,}(?!\w)", re.I)


def _tree(words: list[str]) -> str:
    """Alternatives by their first letter."""
    firsts = sorted({w[0] for w in words})
    return "(?:" + "|".join(f + "(?:" + "|".join(w[1:] for w in sorted(words, key=len, reverse=True) if w[0] == f) + ")" for f in firsts) + ")"


#: Whether a text, in lower case, can hold such a run: words by first letters, without folding case, which is many times faster.
_SPELLED_HINT = re.compile(rf"\b{_tree([*_WORDS])}(?:[\s,.-]{{1,3}}{_tree([*_WORDS])}){{6}}")
_WORD_IN = re.compile(rf"plus|{_ANY_WORD}", re.I)

_LETTERED = re.compile(r"(?<![A-Za-z0-9])[0-9OoIl](?:[\x20-]?[0-9OoIl]){9,18}(?![A-Za-z0-9])")
_DIGITS_FOR = str.maketrans("OoIl", "0011")

#: How "at" and "dot" are spoken, in the same languages.
_SAY_AT, _SAY_DOT = "(?:at|arroba|arobase)", "(?:dot|punkt|punto|point)"
_BRACKET_DOT = rf"\s{{0,3}}[\[({{<]\s{{0,3}}(?:{_SAY_DOT}|\.)\s{{0,3}}[\])}}>]\s{{0,3}}|\s{{1,3}}{_SAY_DOT}\s{{1,3}}"
_AT = re.compile(rf"\s{{0,3}}[\[({{<]\s{{0,3}}(?:{_SAY_AT}|@)\s{{0,3}}[\])}}>]\s{{0,3}}|\s{{1,3}}{_SAY_AT}\s{{1,3}}|@", re.I)
_DOTTED = re.compile(rf"(?:{_BRACKET_DOT}|\.)([A-Za-z0-9-]+)", re.I)
_LABEL = re.compile(r"[A-Za-z0-9-]+")
#: A part of a name and a disguised dot, read backwards from where they end.
_DOT_BEFORE = re.compile(rf"(?:{_BRACKET_DOT})\Z", re.I)
_DOT_REACH = 20
_GROUPS = re.compile(rf"(?<![0-9])(?<![0-9]\.)[0-9]{{1,3}}(?:(?:{_BRACKET_DOT}|\.)[0-9]{{1,3}}){{3}}(?![0-9])", re.I)
_GROUP_DOT = re.compile(rf"{_BRACKET_DOT}|\.", re.I)
#: Whether a text, in lower case, can hold a disguised separator.
_AT_HINT = re.compile(rf"[\[({{<]\s{{0,3}}(?:{_SAY_AT}|@|{_SAY_DOT}|\.)\s{{0,3}}[\])}}>]|\s{_SAY_DOT}\s")

#: What a spoken address ends in ("name at host dot com"), as prose has "at the dot matrix"; with brackets or an @ any
#: label may end it.
_ENDINGS = frozenset("com net org edu gov mil int info biz io dev app ai co me tv eu uk us de fr es it nl be ch at pl pt se no dk fi ie ru ua cz ca mx br ar in cn jp kr au nz za gr hu ro sk si hr bg lt lv ee lu mt cy is li ie tr il ae sa eg ng ke ma cl pe uy ve hk sg my th vn ph id pk bd lk ir kz by ge am az xyz online site shop club top store tech live news world blog cloud email space website agency digital company group page link click pro mobi name museum asia travel jobs cat".split())

Edit = tuple[int, int, str]  # source start, source end, replacement
Layer = list[tuple[int, int, int, int]]  # rewritten start and end, source start and end


def _apply(text: str, edits: list[Edit]) -> tuple[str, Layer]:
    parts, layer, at, now = [], [], 0, 0
    for a, b, new in edits:
        parts += [text[at:a], new]
        now += a - at
        layer.append((now, now + len(new), a, b))
        now, at = now + len(new), b
    return "".join([*parts, text[at:]]), layer


def _back(layer: Layer, start: int, end: int) -> tuple[int, int]:
    """The source characters behind rewritten [start, end)."""

    def edge(i: int, last: bool) -> int:
        if not (k := bisect_right(layer, (i, float("inf")))):
            return i + last
        a, b, x, y = layer[k - 1]
        return (y if last else x) if a <= i < b else y + i - b + last

    return edge(start, False), edge(end - 1, True)


def _unseen(text: str) -> list[Edit]:
    return [] if text.isascii() else [(m.start(), m.end(), "") for m in _GONE.finditer(text)]


def _spelled(text: str) -> list[Edit]:
    out: list[Edit] = []
    if not _SPELLED_HINT.search(text.lower()):
        return out
    for run in _SPELLED.finditer(text):
        at = run.start()
        for m in _WORD_IN.finditer(text, run.start(), run.end()):
            if at < m.start():
                out.append((at, m.start(), ""))
            word = m.group().lower()
            out.append((m.start(), m.end(), "+" if word == "plus" else _WORDS[word]))
            at = m.end()
    return out


def _lettered(text: str) -> list[Edit]:
    out: list[Edit] = []
    for m in _LETTERED.finditer(text):
        s = m.group()
        if len(_DIGIT.findall(s)) >= 10 and (new := s.translate(_DIGITS_FOR)) != s:
            out.append((m.start(), m.end(), new))
    return out


def _dots_before(text: str, start: int, least: int) -> list[Edit]:
    """Disguised dots between the parts of a name whose last part starts at `start`."""
    out: list[Edit] = []
    while m := _DOT_BEFORE.search(text, max(least, start - _DOT_REACH), start):
        before = _local_start(text, m.start(), least)
        if before == m.start():
            break
        out.append((m.start(), m.end(), "."))
        start = before
    return out[::-1]


def _dotted_groups(text: str) -> list[Edit]:
    """Disguised dots between four digit groups."""
    if not _AT_HINT.search(text.lower()):
        return []
    return [(d.start(), d.end(), ".") for m in _GROUPS.finditer(text) for d in _GROUP_DOT.finditer(text, m.start(), m.end()) if d.group() != "."]


def _spoken(text: str) -> list[Edit]:
    out: list[Edit] = []
    if not _AT_HINT.search(text.lower()):
        return out
    done = 0
    for m in _AT.finditer(text):
        start = _local_start(text, m.start(), done) if m.start() >= done else m.start()
        if start == m.start() or not (label := _LABEL.match(text, m.end())):
            continue
        token, dots, at = m.group(), [], label.end()
        while d := _DOTTED.match(text, at):
            dots.append((at, d.start(1), "."))
            at = d.end()
        disguised = [x for x in dots if text[x[0] : x[1]] != "."]
        before = _dots_before(text, start, done)
        if token == "@" and not all(text[a:b].strip()[0] in "[({<" for a, b, _ in before):
            before = []  # prose may say "dot" before a plain address
        bare = token.strip()[:1].isalpha()  # prose says "at example.com"; only a spoken first dot makes it an address
        if not dots or (bare and (dots[0] not in disguised or text[dots[-1][1] : at].lower() not in _ENDINGS)) or (token == "@" and not disguised and not before):
            continue
        out += [*before, (m.start(), m.end(), "@"), *disguised] if token != "@" else [*before, *disguised]
        done = at
    return out


TRANSDUCERS: tuple[Callable[[str], list[Edit]], ...] = (_unseen, _spelled, _lettered, _dotted_groups, _spoken)


def disguised(text: str, known: list[Span]) -> list[Span]:
    now = text.translate(_FOLD) if not text.isascii() and _ODD.search(text) else text
    layers: list[Layer] = []
    for f in TRANSDUCERS:
        if edits := f(now):
            now, layer = _apply(now, edits)
            layers.append(layer)
    if now == text:
        return []
    out = []
    for start, kind, end in plain(now):
        a, b = start, end
        for layer in reversed(layers):
            a, b = _back(layer, a, b)
        if text[a:b] != now[start:end] and not any(k == kind and a < y and x < b and not (a <= x and y <= b and (a, b) != (x, y)) for x, k, y in known):
            out.append((a, kind, b))
    # spelled numbers without "plus" that are long enough for a phone number and are no card
    return sorted({*out, *(s for s in _bare_numbers(text) if not any(x < s[2] and s[0] < y for x, _, y in [*known, *out]))})


def _bare_numbers(text: str) -> list[Span]:
    if not _SPELLED_HINT.search(text.lower()):
        return []
    return [(m.start(), 3, m.end()) for m in _SPELLED.finditer(text) if 10 <= len(_WORD_IN.findall(m.group().lower().removeprefix("plus"))) <= 15]


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """Plain spans and the further, disguised ones."""
    if not text:
        return [], []
    known = plain(text)
    return known, disguised(text, known)


# --- over tables ---

_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("plain", pa.bool_())]))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans): spans holds (kind, start, end, plain), sorted."""

    def run(batches):
        for batch in batches:
            rows = []
            for t in batch.column(1).to_pylist():
                known, more = find(t)
                rows.append(sorted([(a, k, b, True) for a, k, b in known] + [(a, k, b, False) for a, k, b in more]))
            spans = pa.array([[{"start": a, "kind": k, "end": b, "plain": p} for a, k, b, p in r] for r in rows], _SPANS)
            yield pa.record_batch([batch.column(0), spans], ["doc_id", "spans"])

    ids = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = bounded_batches(ids).mapInArrow(run, f"doc_id {ids.schema['doc_id'].dataType.simpleString()}, spans array<struct<start:int,kind:int,end:int,plain:boolean>>")
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return found.select(
        "doc_id",
        F.transform("spans", lambda x: F.struct(F.element_at(kinds, x["kind"] + 1).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["plain"].alias("plain"))).alias("spans"),
    )


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def joined(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: str | None) -> str | None:
    """The text with <EMAIL>, <IP>, <CARD> or <PHONE> for each span; where spans overlap, the first covers what it shares."""
    if not text:
        return text
    known, more = find(text)
    parts, at = [], 0
    for a, k, b in sorted(known + more):
        if b > at:
            parts += [text[at:a], f"<{KINDS[k].upper()}>"] if a >= at else []
            at = b
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, text: str = "text", length: str | None = None) -> DataFrame:
    """All rows and columns of `docs`, with placeholders in the text and, if named, its length column renewed."""

    def run(batches):
        for batch in batches:
            i = batch.schema.get_field_index(text)
            yield batch.set_column(i, batch.schema.field(i), pa.array(map(redacted, batch.column(i).to_pylist()), batch.schema.field(i).type))

    out = bounded_batches(docs).mapInArrow(run, docs.schema)
    return out.withColumn(length, F.length(text).cast(docs.schema[length].dataType)) if length else out
