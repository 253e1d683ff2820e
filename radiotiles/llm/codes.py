"""Vector code compression: product codes whose nearest entries are found by slicing and intersecting bitmasks.

A vector is cut into equal parts; each part is replaced by the number of the nearest entry of that part's
codebook.  For each dimension of a codebook its coordinates are sorted, and prefix masks tell which entries are
among the first k of that order.  A radius selects a range of each order by two binary searches; the exclusive or
of two prefix masks is the set of entries in that range, and the masks of all dimensions, ANDed as 64-bit words,
leave the entries of a box.  The initial radius finds a near entry; its exact distance is the radius of a second
box, which holds every entry that is as near, so exact distances of the candidates decide, ties by lower number.

Codebooks are fitted by passes over all rows: each task adds up the parts of each entry, Spark adds up the
tasks, and the driver gets one row for each entry (`parts` * `entries` of them, whatever the input).  All arithmetic
is on integers, so the result does not depend on how rows are dealt.

Empty table: no rows, and codebooks without entries.  Null vectors and vectors with a null, NaN or infinite
component are left out.  The width is that of the longest vector, rounded up to whole parts; shorter vectors are
read with zeros after them, so an empty vector is all zeros.  Integers beyond +-2^26 (components beyond
65536) are read as those bounds, which keeps sums of squares exact.  Null ids come after all others;
equal ids are told apart by their components, and repeated rows each count.  With fewer rows than entries there are
as many entries as rows.  Other columns are kept; those named code or error are replaced.
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

from radiotiles.llm.common import numbered, stage

#: Integers for a component of 1, and the largest integer.
SCALE, LARGEST = 1024, 1 << 26
#: Rows whose candidates are looked at together, and dimensions after which candidates too far already go.
BLOCK, STEP = 1024, 8


def complete(vector: Column) -> Column:
    """True for vectors without a null, NaN or infinite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~bad


def integers(vectors: pa.Array, width: int) -> np.ndarray:
    """floor(1024 x) of each component, rows filled up with zeros to `width`."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    flat = np.clip(np.floor(flat * SCALE), -LARGEST, LARGEST).astype(np.int64)
    sizes = pa.compute.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


class Slices:
    """One part's codebook: for each dimension its sorted coordinates, and the masks of the first 0, 1, ... entries."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        k, d = entries.shape
        words = -(-k // 64)
        order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(entries, order, axis=0).T.copy()
        own = np.zeros((k, words), np.uint64)  # the bit of each entry
        own[np.arange(k), np.arange(k) // 64] = np.uint64(1) << (np.arange(k) % 64).astype(np.uint64)
        self.prefix = np.zeros((d, k + 1, words), np.uint64)
        for j in range(d):
            self.prefix[j, 1:] = np.bitwise_or.accumulate(own[order[:, j]], axis=0)
        # the initial radius: the median over dimensions of the distance of the quartiles, so that a box holds a part of the entries
        spread = np.percentile(entries, 75, axis=0) - np.percentile(entries, 25, axis=0) if k else np.ones(d)
        self.radius = max(1, int(np.median(spread)))

    def box(self, x: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, entry) of the entries whose every coordinate is within the row's radius, in order."""
        mask = None
        for j in range(x.shape[1]):
            lo = np.searchsorted(self.sorted[j], x[:, j] - radius, "left")
            hi = np.searchsorted(self.sorted[j], x[:, j] + radius, "right")
            own = self.prefix[j, hi] ^ self.prefix[j, lo]
            mask = own if mask is None else mask & own
        bits = np.unpackbits(mask.astype("<u8").view(np.uint8), axis=1, bitorder="little")
        return np.nonzero(bits)

    def best(self, x: np.ndarray, row: np.ndarray, entry: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest of the candidates of each row and its squared distance; -1 where all are beyond `bound`."""
        total = np.zeros(len(row), np.int64)
        for at in range(0, x.shape[1], STEP):
            off = x[row, at : at + STEP] - self.entries[entry, at : at + STEP]
            total = total + np.einsum("ij,ij->i", off, off)
            near = total <= bound[row]
            row, entry, total = row[near], entry[near], total[near]
        index, least = np.full(len(x), -1, np.int64), bound.copy()
        if len(row):
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            own = row[first]
            least[own] = np.minimum.reduceat(total, first)
            hit = np.flatnonzero(total == least[row])[::-1]
            index[row[hit]] = entry[hit]  # backwards, so the lowest number stays
        return index, least

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the nearest entry of each row, ties to the lowest, and the squared distance."""
        index, least = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        for at in range(0, len(x), BLOCK):
            own = x[at : at + BLOCK]
            found, bound = self._bounds(own)
            # entries as near as the one found lie in a box with its distance as radius
            radius = np.ceil(np.sqrt(bound.astype(np.float64))).astype(np.int64) + 1
            wide = np.flatnonzero(radius > self.radius)
            if len(wide):
                row, entry = self.box(own[wide], radius[wide])
                found[wide], bound[wide] = self.best(own[wide], row, entry, bound[wide])
            index[at : at + BLOCK], least[at : at + BLOCK] = found, bound
        return index, least

    def _bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry in the initial box; where that is empty, in the first box of doubled radius that is not."""
        most = np.full(len(x), np.iinfo(np.int64).max, np.int64)
        index, bound, radius = np.full(len(x), -1, np.int64), most.copy(), self.radius
        open_ = np.arange(len(x))
        while len(open_):
            row, entry = self.box(x[open_], np.full(len(open_), radius))
            index[open_], bound[open_] = self.best(x[open_], row, entry, most[open_])
            open_ = open_[index[open_] < 0]
            radius *= 2
        return index, bound


@dataclass(frozen=True)
class Codebooks:
    """Entries by part, entry and position within the part."""

    values: np.ndarray

    @property
    def width(self) -> int:
        return self.values.shape[0] * self.values.shape[2]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.values.ravel().tolist())).encode()).hexdigest()

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, parts) numbers of the nearest entries, and their squared distances."""
        parts, _, d = self.values.shape
        found = [Slices(self.values[p]).nearest(x[:, p * d : (p + 1) * d]) for p in range(parts)]
        return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def first_entries(kept: DataFrame, parts: int, entries: int, id_col: str, vector_col: str) -> Codebooks:
    """The parts of the vectors with the least ids: at most `entries` rows reach the driver."""
    longest = kept.agg(F.max(F.size(vector_col))).first()[0] or 0
    d = max(1, -(-longest // parts))
    rows = kept.select(F.col(id_col).alias("i"), F.col(vector_col).cast("array<double>").alias("v")).orderBy(F.col("i").asc_nulls_last(), "v").limit(entries).collect()
    x = integers(pa.array([r["v"] for r in rows], pa.list_(pa.float64())), d * parts)
    return Codebooks(x.reshape(len(rows), parts, d).transpose(1, 0, 2))


def moved(kept: DataFrame, books: Codebooks, vector_col: str) -> Codebooks:
    """One round: each entry becomes the floored mean of the parts nearest to it; unused ones stay."""
    parts, entries, d = books.values.shape

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, d), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            x = integers(batch.column(0), books.width)
            index, _ = books.assign(x)
            for p in range(parts):
                np.add.at(sums[p], index[:, p], x[:, p * d : (p + 1) * d])
                counts[p] += np.bincount(index[:, p], minlength=entries)
        part, entry = np.nonzero(counts)
        columns = [part, entry, counts[part, entry], *(sums[part, entry, j] for j in range(d))]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=names)

    names = ["part", "entry", "n", *(f"s{j}" for j in range(d))]
    each = kept.select(vector_col).mapInArrow(add_up, ", ".join(f"{n} long" for n in names))
    values = books.values.copy()
    for r in each.groupBy("part", "entry").agg(*[F.sum(n).alias(n) for n in names[2:]]).collect():  # a row for each entry
        values[r["part"], r["entry"]] = [s // r["n"] for s in r[3:]]
    return Codebooks(values)


def fit(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> Codebooks:
    """Codebooks of all complete vectors, from those with the least ids by `rounds` rounds of assigning and averaging."""
    kept = vectors.where(complete(F.col(vector_col)))
    books = first_entries(kept, parts, entries, id_col, vector_col)
    for _ in range(rounds if books.values.shape[1] else 0):
        books = moved(kept, books, vector_col)
    return books


def encode(vectors: DataFrame, books: Codebooks, vector_col: str = "embedding") -> DataFrame:
    """The complete rows with `code` (two hex digits for each part; more with over 256 entries) and `error`, the squared
    distance to the decoded vector; the vector itself is left out."""
    digits = max(2, len(f"{max(books.values.shape[1] - 1, 0):x}"))
    others = [c for c in vectors.columns if c not in (vector_col, "code", "error")]
    kept = numbered(vectors.where(complete(F.col(vector_col))), [*others, vector_col])
    schema = T.StructType([*kept.schema.fields[:-1], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    names = schema.names

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and not books.values.shape[1]:
                raise ValueError("codebooks without entries")
            index, off = books.assign(integers(batch.column(len(others)), books.width))
            code = ["".join(f"{i:0{digits}x}" for i in row) for row in index.tolist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], pa.array(code, pa.string()), pa.array(off.sum(1))], names=names)

    return kept.mapInArrow(work, schema).toDF(*others, "code", "error")


def decode(coded: DataFrame, books: Codebooks) -> DataFrame:
    """The rows with `vector`: the entries that their code names, as components."""
    parts, entries, _ = books.values.shape
    digits = max(2, len(f"{max(entries - 1, 0):x}"))
    others = [c for c in coded.columns if c != "vector"]
    own = numbered(coded, [*others, "code"])
    schema = T.StructType([*own.schema.fields[:-1], T.StructField("vector", T.ArrayType(T.DoubleType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(len(others)).to_pylist()
            index = np.array([[int(c[p * digits : (p + 1) * digits], 16) for p in range(parts)] for c in codes], np.int64).reshape(-1, parts)
            values = [books.values[p, index[:, p]] for p in range(parts)]
            rows = pa.array((np.concatenate(values, 1) / SCALE).tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], rows], names=schema.names)

    return own.mapInArrow(work, schema).toDF(*others, "vector")


def with_label_error(coded: DataFrame, label: str = "label") -> DataFrame:
    """`coded` with the sum of the errors of its label, null labels together.  `coded` is read twice, so pass a written
    table.  The sums are written too: Spark sends them to all tasks only where they are small, else it joins by
    shuffle and splits the parts of hot labels."""
    sums = stage(coded.groupBy(F.col(label).alias("__label")).agg(F.sum("error").alias("label_error")), "label_errors")
    return coded.join(sums, F.col(label).eqNullSafe(F.col("__label")), "left").drop("__label")
