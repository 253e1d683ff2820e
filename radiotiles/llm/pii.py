"""Personal data: regular expressions propose spans, validators confirm them, context words adjust their score.

Base spans are the non-overlapping matches of four fixed patterns (email, ip, card, phone) that pass their
validator; they always stay.  What the patterns swallow or cannot see is proposed again and scored:

- a card number next to other digits: windows of the digit groups that pass Luhn's sum and are grouped as cards are;
- a phone number next to other digits: the longest beginning of whole groups with 9 to 15 digits;
- an IBAN, confirmed by its remainder modulo 97;
- an address with its signs written out (name [at] host [dot] com), a phone number without country, a social
  security number: these need a context word.

A proposal starts from the score of its pattern; a passed validator and words of its kind near by add to it, words
of other numbers (order, version, ISBN, ...) take from it.  Those that reach `LEAST` are added where they overlap no
span that is there.

Patterns run in time linear in the text, whatever it holds.  No shuffle.  Empty table: no rows.  Null and
empty texts: no spans.  Very long texts are searched whole, in one task.  Repeated rows and equal or null ids
are rows of their own.  Of proposals that overlap the one with the higher score stays, then the first, then the
longest.  Other columns are kept; those named spans or masked are replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from radiotiles.llm.common import numbered, slices

# The kinds of base spans, in their order; further kinds follow.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
RANK = {k: i for i, k in enumerate(KINDS)}
#: The score that a proposal needs, and the characters before and after it that are searched for context.
LEAST, NEAR = 0.6, 48
#: Words that make a kind likelier.
CONTEXT = {
    "email": ("email", "e-mail", "mail", "contact", "correo", "courriel", "kontakt", "write"),
    "card": ("card", "credit", "debit", "visa", "mastercard", "amex", "tarjeta", "carte", "karte", "payment", "cc"),
    "phone": ("phone", "tel", "telephone", "call", "mobile", "cell", "fax", "whatsapp", "telefono", "teléfono", "téléphone", "telefon", "anruf", "sms"),
    "iban": ("iban", "account", "bank", "cuenta", "compte", "konto", "transfer", "swift", "bic"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
}
#: Words of numbers that are not personal.
OTHER = ("order", "version", "isbn", "issn", "doi", "invoice", "serial", "part", "model", "sku", "build", "ticket", "page", "figure", "table")

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
# The fixed patterns, with possessive repeats and a look behind that keep them from starting again inside a run of
# digits: the matches are the same.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[\x20-]?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
SPELLED = re.compile(r"(?<![\w.%+-])[A-Za-z0-9._%+-]{1,64}+[\x20]?(?:\(at\)|\[at\]|\{at\})[\x20]?[A-Za-z0-9-]{1,63}+(?:[\x20]?(?:\(dot\)|\[dot\]|\{dot\}|\.)[\x20]?[A-Za-z0-9-]{1,63}+){1,5}")
PLAIN_PHONE = re.compile(r"(?<![0-9+(.-])(?:\([0-9]{3}\)[\x20]?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
DIGITS = re.compile(r"[0-9]+")
DIGIT = re.compile(r"[0-9]")
WORDS = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    """True if the sum of the digits, every second one from the right doubled and reduced, ends in 0."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """True if an IBAN without spaces leaves 1: country and check digits go last, letters count from 10."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def iban_end(found: str) -> int:
    """Where the longest beginning of whole groups that is an IBAN ends; 0 without one."""
    ends = [k for k, c in enumerate(found) if c in " -"] + [len(found)]
    for end in reversed(ends):
        own = found[:end].replace(" ", "").replace("-", "")
        if 15 <= len(own) <= 34 and mod97(own):
            return end
    return 0


def only_digits(text: str) -> str:
    return "".join(DIGITS.findall(text))


def emails(text: str) -> Iterator[Span]:
    """Each address has one @: its name is the run of allowed characters before, not before the last address's end."""
    end, at = 0, text.find("@")
    while at >= 0:
        before = text[end:at]
        start = end + len(before.rstrip(LOCAL))
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        else:
            end = at + 1  # no match can hold this @
        at = text.find("@", end)


def ips(text: str) -> Iterator[Span]:
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
            yield m.span()


def cards(text: str) -> Iterator[tuple[Span, bool]]:
    """Runs of digit groups, and whether they are a card number as a whole."""
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = only_digits(m[0])
            if len(digits) >= 13:
                yield m.span(), len(digits) <= 19 and luhn(digits)


def phones(text: str) -> Iterator[tuple[Span, bool]]:
    for m in PHONE.finditer(text):
        yield m.span(), 9 <= len(only_digits(m[0])) <= 15


def card_shaped(sizes: tuple[int, ...]) -> bool:
    """Groups as cards are printed: all in one, in fours (the last may differ), or 4-6-5 and 4-6-4."""
    return len(sizes) == 1 or sizes in ((4, 6, 5), (4, 6, 4)) or (len(sizes) >= 4 and all(s == 4 for s in sizes[:-1]) and sizes[-1] <= 4)


def inner_cards(text: str, a: int, b: int) -> Iterator[tuple[Span, float]]:
    """Windows of whole groups of a run that failed as a whole, which pass Luhn's sum."""
    groups = [(a + m.start(), a + m.end()) for m in DIGITS.finditer(text[a:b])]
    for i in range(len(groups)):
        sizes: tuple[int, ...] = ()
        for j in range(i, len(groups)):
            sizes += (groups[j][1] - groups[j][0],)
            if sum(sizes) > 19 or len(sizes) > 19:
                break
            if sum(sizes) >= 13 and card_shaped(sizes) and (i, j) != (0, len(groups) - 1) and luhn(only_digits(text[groups[i][0] : groups[j][1]])):
                yield (groups[i][0], groups[j][1]), 0.7


def inner_phone(text: str, a: int, b: int) -> Iterator[tuple[Span, float]]:
    """The longest beginning of a run with too many digits that ends before a space and has 9 to 15."""
    best, digits, end = None, 0, a
    for m in re.finditer(r"[^\x20]+", text[a:b]):
        digits += len(only_digits(m[0]))
        if digits > 15:
            break
        end = a + m.end()
        if digits >= 9 and text[end - 1].isdigit():
            best = end
    if best:
        balanced = text.count("(", a, best) == text.count(")", a, best)
        yield (a, best), 0.7 if balanced else 0.5


def context_score(text: str, kind: str, a: int, b: int) -> float:
    """What the words near a span add to its score."""
    near = {w.lower() for w in WORDS.findall(text[max(0, a - NEAR) : a] + " " + text[b : b + NEAR])}
    return 0.3 * any(w in near for w in CONTEXT[kind]) - 0.3 * any(w in near for w in OTHER)


def proposals(text: str, failed_cards: list[Span], failed_phones: list[Span]) -> Iterator[tuple[str, Span, float]]:
    """(kind, span, score before context) of what the base patterns leave."""
    for a, b in failed_cards:
        for span, score in inner_cards(text, a, b):
            yield "card", span, score
    for a, b in failed_phones:
        for span, score in inner_phone(text, a, b):
            yield "phone", span, score
    if DIGIT.search(text):
        for m in IBAN.finditer(text):
            if b := iban_end(m[0]):
                yield "iban", (m.start(), m.start() + b), 0.8
        for m in PLAIN_PHONE.finditer(text):
            yield "phone", m.span(), 0.4
        for m in SSN.finditer(text):
            yield "ssn", m.span(), 0.4
    if "at)" in text or "at]" in text or "at}" in text:
        for m in SPELLED.finditer(text):
            yield "email", m.span(), 0.4


def find_spans(text: str) -> list[tuple[str, int, int, float, bool]]:
    """(kind, start, end, score, base) in code points, by kind and start."""
    digits = bool(DIGIT.search(text))
    base = [("email", s) for s in emails(text)] if "@" in text else []
    failed: dict[str, list[Span]] = {"card": [], "phone": []}
    if digits:
        base += [("ip", s) for s in ips(text)]
        for kind, found in (("card", cards(text)), ("phone", phones(text))):
            for span, good in found:
                if good:
                    base.append((kind, span))
                else:
                    failed[kind].append(span)
    out = [(k, a, b, 1.0, True) for k, (a, b) in base]
    scored = []
    for kind, (a, b), score in proposals(text, failed["card"], failed["phone"]):
        score = round(min(1.0, score + context_score(text, kind, a, b)), 3)
        if score >= LEAST:
            scored.append((-score, a, -b, kind))
    if scored:
        taken: list[list[int]] = []  # disjoint, in order
        for a, b in sorted((a, b) for _, a, b, _, _ in out):
            if taken and a < taken[-1][1]:
                taken[-1][1] = max(taken[-1][1], b)
            else:
                taken.append([a, b])
        for low, a, neg, kind in sorted(scored):
            k = bisect_left(taken, [-neg])
            if not k or taken[k - 1][1] <= a:
                taken.insert(k, [a, -neg])
                out.append((kind, a, -neg, -low, False))
    return sorted(out, key=lambda s: (RANK[s[0]], s[1], s[2]))


def masked_text(text: str, spans: list[tuple[str, int, int, float, bool]]) -> str:
    """The text with <kind> in place of its spans; where spans overlap, the part not covered before is replaced."""
    out, at = [], 0
    for kind, a, b, _, _ in sorted(spans, key=lambda s: (s[1], -s[2], RANK[s[0]])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("base", T.BooleanType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())]))
_FIELDS = ("kind", "start", "end", "score", "base")


def personal_data(docs: DataFrame, text_col: str = "text", mask: bool = False) -> DataFrame:
    """The rows, without their text, with `spans` (array of kind, start, end, score, base; code points, end
    exclusive); with `mask` also `masked`, the text with its spans replaced."""
    others = [c for c in docs.columns if c not in ("spans", "masked", text_col)]
    own = numbered(docs, others, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    new = [T.StructField("spans", SPANS)] + [T.StructField("masked", T.StringType())] * mask
    schema = T.StructType([*own.schema.fields[:-1], *new])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "__text"):
                texts = batch.column(len(others)).to_pylist()
                found = [find_spans(t) for t in texts]
                made = [pa.array([[dict(zip(_FIELDS, s, strict=True)) for s in f] for f in found], _ARROW)]
                if mask:
                    made.append(pa.array([masked_text(t, f) for t, f in zip(texts, found, strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], *made], names=schema.names)

    return own.mapInArrow(work, schema).toDF(*others, *[f.name for f in new])


def listed(spans: Column) -> Column:
    """kind:start:end of the spans in their order, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    """The rows with the number of base spans of each base kind, a hash of the base spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select("*", *[count(k) for k in BASE], F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("listed"))
