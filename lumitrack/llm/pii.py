"""Personal data in disguise: a deobfuscator that keeps offsets.

Small transducers rewrite a text (look-alike letters, zero-width characters, spelled digits, "at" and "dot" in words or
brackets) and remember for each written character which source characters it stands for. Detectors run on the source
and on the rewritten text; spans found in the latter are mapped back to source positions and added unless they lie
within a span of the same kind that the source shows plainly.

Null texts count as empty and have no spans. Texts are read whole, in time linear in their length: no detector
backtracks over a run twice. Repeated rows are each reported. An empty table gives an empty result; only ``doc_id`` and
``text`` are read, so other columns can't clash.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from unicodedata import normalize

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")
LOCAL = r"[A-Za-z0-9._%+-]"
#: Patterns of the query contract (fixed values), written so that each run is tried once: an email is looked for from
#: its "@", an address only from a run's first digit.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
FIGURES = re.compile(r"[0-9][0-9.]*")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Look-alikes of ASCII characters (fixed values): Cyrillic and Greek letters, and signs.
LOOK_ALIKES = dict(
    zip(
        "аеорсухіјѕԁһԛԝАВЕКМНОРСТУХІЈЅοναιρτυκΑΒΕΖΗΙΚΜΝΟΡΤΥΧ٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹＠﹫．。․﹒–—‐‑−",
        "aeopcyxijsdhqwABEKMHOPCTYXIJSovaiptukABEZHIKMNOPTYX01234567890123456789@@....-----",
        strict=True,
    )
)
#: Fullwidth forms stand 0xFEE0 above ASCII.
LOOK_ALIKES |= {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)}
#: More Latin, Armenian and Roman-numeral look-alikes (fixed values).
LOOK_ALIKES |= dict(zip("ƅɑɡıⅼոսց", "bagilnug", strict=True))
#: Mathematical and circled letters and digits stand for what Unicode's compatibility decomposition makes of them.
LOOK_ALIKES |= {chr(c): x for c in (*range(0x1D400, 0x1D800), *range(0x2460, 0x2469), *range(0x24B6, 0x24EB)) if len(x := normalize("NFKC", chr(c))) == 1 and x.isascii() and x.isalnum()}
INVISIBLE = "​‌‍⁠﻿­"
#: Digits spelled in English, German, French and Spanish (fixed values); "o" and "oh" only among others.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
DIGIT = "(?:" + "|".join(sorted(SPELLED, key=len, reverse=True)) + ")"
#: A spelled number: at least SPELLED_RUN digit words, perhaps with figures between and "plus" before.
SPELLED_RUN = 4
SPELLED_NUMBER = re.compile(rf"(?i)(?<![^\W_])(?:plus[\s-]+(?:[0-9]+[\s,-]+)*+)?{DIGIT}(?![^\W_])(?:[\s,-]+(?:[0-9]+[\s,-]+)*+{DIGIT}(?![^\W_]))*+")
DIGIT_OR_REST = re.compile(rf"(?i){DIGIT}(?![^\W_])|[0-9]+|plus[\s-]+|[\s,-]+")
#: "at" and "dot": in brackets anywhere between word characters; bare words only where both stand in one address.
AT, DOT = r"(?:at|arroba|chez|@)", r"(?:dot|punkt|punto|point|\.)"
OPEN, SHUT = r"[\(\[\{<]\s{0,3}", r"\s{0,3}[\)\]\}>]"
BRACKETED_AT = rf"\s{{0,3}}{OPEN}{AT}{SHUT}\s{{0,3}}"
BRACKETED_DOT = rf"\s{{0,3}}{OPEN}{DOT}{SHUT}\s{{0,3}}"
NAME = r"[A-Za-z0-9-]{1,63}"
ANY_DOT = rf"(?:{BRACKETED_DOT}|\s{{1,3}}dot\s{{1,3}}|\.)"
ANY_AT = rf"(?:{BRACKETED_AT}|\s{{1,3}}at\s{{1,3}}|@)"
#: What follows "at" is no domain if it is itself the local part of an address.
DISGUISED = re.compile(rf"(?i)(?P<at>{ANY_AT})(?P<domain>{NAME}(?:{ANY_DOT}{NAME}(?![A-Za-z0-9-]))++)(?!{ANY_AT}{NAME}{ANY_DOT}{NAME})")
DOTS = re.compile(rf"(?i){BRACKETED_DOT}|\s{{1,3}}dot\s{{1,3}}")
#: A disguised dot at the end of what precedes a part of a local part; no longer than DOT_LENGTH.
DOT_BEFORE = re.compile(rf"(?:{DOTS.pattern[4:]})\Z", re.IGNORECASE)
DOT_LENGTH = 20
#: Four groups of figures with dots of any form between.
DISGUISED_IP = re.compile(rf"(?i)(?<![0-9])[0-9]++(?:{ANY_DOT}[0-9]++){{3}}")
#: What a text must hold for the rewritten one to differ: one of these characters, or words that ``spells`` finds.
#: Characters beyond the first plane are a range here, since a class tries them one after the other.
ODD = re.compile(rf"[{re.escape(''.join(c for c in LOOK_ALIKES if c < chr(0x10000)))}\U0001D400-\U0001D7FF{INVISIBLE}\(\[\{{<]")
#: ASCII punctuation becomes a space.
APART = bytes(32 if chr(c) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else c for c in range(256))
SPELLED_BYTES = frozenset(x for w in SPELLED for x in (w.encode(), w.upper().encode().lower()))


def spells(text: str) -> bool:
    """Whether ``text`` may hold a bare "dot" or a spelled number."""
    words = text.encode("utf-8", "surrogatepass").lower().translate(APART).split()
    return b"dot" in words or b"\1" * SPELLED_RUN in bytes(x in SPELLED_BYTES for x in words if not x.isdigit())


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _figures(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def emails(text: str) -> list[tuple[int, int]]:
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return found


def detect(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the plain identifiers in ``text``, sorted by kind, then start."""
    spans = [(0, a, b) for a, b in emails(text)]
    runs = [r.span() for r in FIGURES.finditer(text) if r[0].count(".") >= 3]
    spans += [(1, *m.span()) for a, b in runs for m in IP.finditer(text, a, b) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split("."))]
    spans += [(2, *m.span()) for m in CARD.finditer(text) if 13 <= len(d := _figures(m[0])) <= 19 and luhn(d)]
    return spans + [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(_figures(m[0])) <= 15]


class Written:
    """Text that transducers have written; ``source[i]`` is the (start, end) in the source of character i."""

    def __init__(self, text: str):
        self.text, self.source = text, [(i, i + 1) for i in range(len(text))]

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces each (start, end, by), in order and apart; what is written stands for all that it replaces."""
        text, source, at = [], [], 0
        for start, end, by in edits:
            text += [self.text[at:start], by]
            source += self.source[at:start] + [(self.source[start][0], self.source[end - 1][1])] * len(by)
            at = end
        self.text, self.source = "".join([*text, self.text[at:]]), source + self.source[at:]


def look_alikes(w: Written) -> None:
    edits = [(i, i + 1, LOOK_ALIKES.get(c, "")) for i, c in enumerate(w.text) if c in LOOK_ALIKES or c in INVISIBLE]
    w.rewrite(edits)


def spelled_digits(w: Written) -> None:
    edits = []
    for m in SPELLED_NUMBER.finditer(w.text):
        parts = DIGIT_OR_REST.findall(m[0])
        if sum(x.lower() in SPELLED for x in parts) >= SPELLED_RUN:
            said = "".join("+" if x.lower().startswith("plus") else x if x[0] in "0123456789" else SPELLED.get(x.lower(), "") for x in parts)
            edits.append((*m.span(), said))
    w.rewrite(edits)


def _dots_before(text: str, at: int, floor: int) -> list[tuple[int, int, str]]:
    """The disguised dots in the local part that ends at ``at`` and begins at ``floor`` or after it."""
    dots = []
    while True:
        while at > floor and text[at - 1] in LOCAL_CHARS:
            at -= 1
        m = DOT_BEFORE.search(text, max(floor, at - DOT_LENGTH), at)
        if not m or m.start() <= floor or text[m.start() - 1] not in LOCAL_CHARS:
            return dots[::-1]
        dots.append((*m.span(), "."))
        at = m.start()


def at_and_dot(w: Written) -> None:
    edits, floor = [], 0
    for m in DISGUISED.finditer(w.text):
        low, floor = floor, m.end()
        dots = [(d.start(), d.end(), ".") for d in DOTS.finditer(w.text, m.start("domain"), m.end("domain"))]
        if m.start() == 0 or w.text[m.start() - 1] not in LOCAL_CHARS:
            continue
        before = _dots_before(w.text, m.start(), low)
        bare = w.text[m.start("at") : m.end("at")].strip().lower() == "at"
        if not dots and not before and (bare or m["at"] == "@"):
            continue
        edits += before
        if m["at"] != "@":
            edits.append((m.start("at"), m.end("at"), "@"))
        edits += dots
    w.rewrite(edits)


def dotted_figures(w: Written) -> None:
    w.rewrite([(d.start(), d.end(), ".") for m in DISGUISED_IP.finditer(w.text) for d in DOTS.finditer(w.text, *m.span())])


def disguised(text: str) -> list[tuple[int, int, int]]:
    """Source spans of what only the rewritten text shows."""
    if not ODD.search(text) and not spells(text):
        return []
    w = Written(text)
    for transducer in (look_alikes, spelled_digits, at_and_dot, dotted_figures):
        transducer(w)
    return [(k, w.source[a][0], w.source[b - 1][1]) for k, a, b in detect(w.text)]


def personal_data(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The plain spans and the added ones, each (kind, start, end): code points, end exclusive."""
    if not text:
        return [], []
    base, added = detect(text), []
    taken: dict[int, list[tuple[int, int]]] = {}
    for k, a, b in base:
        taken.setdefault(k, []).append((a, b))
    for k, a, b in disguised(text):
        if not holds(taken.get(k, []), a, b):
            added.append((k, a, b))
    return base, added


def holds(spans: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether one of the sorted, disjoint ``spans`` holds start to end."""
    i = bisect_right(spans, (start, float("inf")))
    return i > 0 and spans[i - 1][1] >= end


def masked(text: str, mask: str = "<{}>") -> str:
    """``text`` with every span, plain or disguised, replaced by its kind."""
    base, added = personal_data(text)
    out, at = [], 0
    for a, b, k in sorted(((a, b, k) for k, a, b in base + added), key=lambda s: (s[0], -s[1], s[2])):
        if a >= at:
            out += [text[at:a], mask.format(KINDS[k])]
            at = b
    return "".join([*out, text[at:]])


def with_spans(docs: DataFrame) -> DataFrame:
    """doc_id and, per document, the arrays ``base`` and ``added`` of struct(kind, start, end)."""
    span = "array<struct<kind:int,start:int,end:int>>"
    arrow = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in them:
            found = [personal_data(t) for t in batch.column(1).to_pylist()]
            columns = [pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in f[i]] for f in found], arrow) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "base", "added"])

    return docs.select("doc_id", "text").mapInArrow(batches, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, base {span}, added {span}")


def op9(docs: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    names = F.array(*map(F.lit, KINDS))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return with_spans(docs).select("doc_id", *map(count, range(4)), F.sha2(said(F.col("base")), 256).alias("base_sha256"), said(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"))
