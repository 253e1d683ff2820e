"""What the operators of this package share: tables, scratch space and words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (as pa.compute)
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from radiotiles.sources.scratch import scratch_root, stage

__all__ = ["column_bytes", "gram_hashes", "hashed_words", "learned_from", "mix", "numbered", "scratch_root", "shingle_set", "signed", "slices", "stage", "table"]

#: Characters that end a word: a space and \t \n \v \f \r.  `bytes.split()` splits at just these.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def learned_from(doc_id: Column, modulus: int) -> Column:
    """False for the held-out rows: crc32 of the id as text, modulo `modulus`, is 0.  A null id counts
    as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus != 0


def numbered(df: DataFrame, names: list[str], *more: Column) -> DataFrame:
    """The named columns as c0, c1, ... and `more`: Spark's Arrow functions take no names with dots."""
    return df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], *more)


def column_bytes(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


_MULT = np.uint64(0x9E3779B97F4A7C15)
_MULT2 = np.uint64(0xBF58476D1CE4E5B9)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads their bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * _MULT2
    return h ^ (h >> np.uint64(29))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the windows of n words."""
    out = mix(h[: len(h) - n + 1] + np.uint64(n))
    for k in range(1, n):
        out = mix(out * _MULT + h[k : len(h) - n + 1 + k])
    return out


def shingle_set(h: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct shingles of n words; a shorter text is one shingle, one without words none."""
    if not len(h):
        return h
    s = np.sort(gram_hashes(h, min(n, len(h))))
    return s[np.append(True, s[1:] != s[:-1])]


def signed(values: np.ndarray) -> pa.Array:
    """Unsigned 64-bit values as the longs that Spark knows."""
    return pa.array(values.view(np.int64))


_rng = np.random.default_rng(7)
#: Words from so many bytes on (spaces after them included) are hashed by another function: in long words the sum
#: below, which is modulo 2^64, can be the same for different ones.
LONGEST = 64
_POWERS = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(LONGEST - 1, _MULT)]))
_SPACE = np.zeros(256, bool)
_SPACE[[ord(c) for c in SPACES]] = True
#: A random number for each byte; capital letters A-Z have those of small ones, spaces none.
_BYTES = _rng.integers(1, 2**63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES[ord("A") : ord("Z") + 1] = _BYTES[ord("a") : ord("z") + 1]
_BYTES[_SPACE] = 0


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased (A-Z only) words of all texts, end to end, and where each text's begin
    (one place more than there are texts).  Null texts have no words."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    base = int(edges[0]) if len(edges) else 0
    edges = edges - base
    n = int(edges[-1]) if len(edges) else 0
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    buf = np.frombuffer(texts.buffers()[2], np.uint8, n, base)
    space = _SPACE[buf]
    begins = np.append(True, space[:-1])
    begins[edges[:-1][edges[:-1] < n]] = True
    starts = np.flatnonzero(begins & ~space)
    at = np.searchsorted(starts, edges)
    out = np.empty(len(starts), np.uint64)
    step = 100_000
    ends = np.append(starts[1:], n)  # of the word and the spaces after it, which count as nothing
    for a in range(0, len(starts), step):
        own, to = starts[a : a + step], ends[a : a + step]
        lo, hi = own[0], to[-1]
        place = np.arange(hi - lo) - np.repeat(own - lo, to - own)
        out[a : a + step] = np.add.reduceat(_BYTES[buf[lo:hi]] * _POWERS[place & (LONGEST - 1)], own - lo)
    for i in np.flatnonzero(ends - starts >= LONGEST):
        out[i] = xxhash.xxh3_64_intdigest(buf[starts[i] : ends[i]].tobytes().lower().split()[0])
    return mix(out), at


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20):
    """The batch in slices of about `limit` bytes of text at most."""
    k = batch.schema.get_field_index(column)
    sizes = pa.compute.binary_length(batch.column(k)).fill_null(0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)
