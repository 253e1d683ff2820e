"""Fill-in-middle transformation: texts cut into prefix, middle and suffix, which change places between marks.

Cuts are found on UTF-8 bytes, whole batches at a time.  A sparse exception index holds the multibyte characters
only: the byte position of each, and the excess bytes of those before it.  Binary search in it turns a byte cut
into a code-point cut and back; between two exceptions both differ by one constant, so ASCII text
needs no index at all.

Where to cut and in which order the parts go is decided by a hash of seed and id, so a row's form does not depend on
other rows.  No shuffle.

Empty table: no rows.  Null text: empty, so plain.  Null ids hash as the id ''.  Rows with equal ids are cut
by the same numbers, each in its own text.  Very long texts are taken whole (a task holds one text and its index).
Texts that hold one of the marks stay plain, as the parts could not be told apart.  Bytes that are not UTF-8 are
carried unchanged; stray continuation bytes count as characters.  Other columns are kept; those with the
names of new ones are replaced, and the text itself is left out: `restored` has it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from radiotiles.llm.common import SPACES, numbered, slices

# The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
NEW = (("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.StringType()))
_SPACE = np.zeros(256, bool)
_SPACE[[ord(c) for c in SPACES]] = True


@dataclass(frozen=True)
class Exceptions:
    """The multibyte characters of a buffer: `at`, their byte positions, and `before`, the excess bytes of the
    first 0, 1, 2, ... of them."""

    at: np.ndarray
    before: np.ndarray

    @classmethod
    def of(cls, buf: np.ndarray) -> Exceptions:
        at = np.flatnonzero(buf >= 0xC0)
        lead = buf[at]
        return cls(at, np.concatenate([[0], np.cumsum(1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0))]))

    def to_chars(self, cuts: np.ndarray) -> np.ndarray:
        """Code points before each byte position (a position between characters)."""
        return cuts - self.before[np.searchsorted(self.at, cuts)]

    def to_bytes(self, cuts: np.ndarray) -> np.ndarray:
        """The byte position after so many code points."""
        return cuts + self.before[np.searchsorted(self.at - self.before[:-1], cuts)]


def token_ends(buf: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Byte positions after each token of texts end to end: a word with the spaces before it, or the spaces that end
    a text."""
    space = _SPACE[buf]
    last = ~space & np.append(space[1:], True)[: len(buf)]
    full = edges[1:] > edges[:-1]
    last[edges[1:][full] - 1] = True
    return np.flatnonzero(last) + 1


def draws(key: bytes) -> list[int]:
    """The first four numbers of 32 bits of a key's SHA-256."""
    digest = hashlib.sha256(key).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12)]


def cut_points(buf: np.ndarray, edges: np.ndarray, numbers: np.ndarray, unit: str, index: Exceptions) -> tuple[np.ndarray, np.ndarray]:
    """(units of each text; byte positions of its two cuts) for texts end to end; `numbers`: two draws for each."""
    if unit == "token":
        ends = token_ends(buf, edges)
        first = np.searchsorted(ends, edges, "right")
        n = np.diff(first)
        after = lambda u: np.where(u > 0, np.append(ends, 0)[np.maximum(first[:-1] + u - 1, 0)], edges[:-1])
    else:
        chars = index.to_chars(edges)
        n = np.diff(chars)
        after = lambda u: index.to_bytes(chars[:-1] + u)
    a, b = (numbers[:, k] % (n + 1) for k in (0, 1))
    return n, np.stack([after(np.minimum(a, b)), after(np.maximum(a, b))], 1)


def transformed(docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80, unit: str = "token", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows with n (tokens, or with unit "char" code points), form (plain, psm or spm), prefix_chars and
    middle_chars (code points; null if plain) and output.  `rate` of 100 rows are cut, `spm_rate` of 100 of these with the
    suffix first."""
    if unit not in ("token", "char"):
        raise ValueError("unit is token or char")
    new = [n for n, _ in NEW]
    others = [c for c in docs.columns if c not in (*new, text_col)]
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary")
    own = numbered(docs, others, key.alias("__key"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("__text"))
    schema = T.StructType([*own.schema.fields[:-2], *[T.StructField(n, t) for n, t in NEW]])

    def form_of(text: bytes, h: list[int]) -> str:
        if not text or any(m in text for m in MARKS) or h[2] % 100 >= rate:
            return "plain"
        return "spm" if h[3] % 100 < spm_rate else "psm"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, s, m = MARKS
        for whole in batches:
            for batch in slices(whole, "__text"):
                texts = batch.column(len(others) + 1).to_pylist()
                h = [draws(k) for k in batch.column(len(others)).to_pylist()]
                forms = [form_of(t, x) for t, x in zip(texts, h, strict=True)]
                edges = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
                buf = np.frombuffer(b"".join(texts), np.uint8)
                index = Exceptions.of(buf)
                n, cuts = cut_points(buf, edges, np.array(h, np.int64)[:, :2], unit, index)
                chars = np.diff(index.to_chars(np.column_stack([edges[:-1], cuts])), axis=1)
                out, plain = [], np.array([f == "plain" for f in forms])
                for t, f, (a, b) in zip(texts, forms, (cuts - edges[:-1, None]).tolist(), strict=True):
                    if f == "psm":
                        t = b"".join((p, t[:a], s, t[b:], m, t[a:b]))
                    elif f == "spm":
                        t = b"".join((s, t[b:], p, t[:a], m, t[a:b]))
                    out.append(t)
                made = [pa.array(n), pa.array(forms, pa.string()), *(pa.array(chars[:, k], mask=plain) for k in (0, 1)), pa.array(out, pa.binary()).view(pa.string())]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], *made], names=schema.names)

    return own.mapInArrow(work, schema).toDF(*others, *new)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made from: no part holds a mark, so the first of each divides."""

    def parts(first: str) -> tuple[Column, Column, Column]:
        body = F.substr(output, F.lit(len(PREFIX) + 1))
        tail = F.split_part(body, F.lit(first), F.lit(2))
        return F.split_part(body, F.lit(first), F.lit(1)), F.split_part(tail, F.lit(MIDDLE), F.lit(1)), F.split_part(tail, F.lit(MIDDLE), F.lit(2))

    (prefix, suffix, middle), (suffix2, prefix2, middle2) = parts(SUFFIX), parts(PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(output)
