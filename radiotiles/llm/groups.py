"""Maximal repeats of whole texts, however long, with all their occurrences.

The suffix arrays of `repeats` see a gram's contexts, which are shorter than two windows, so a longer repeat
shows there as a chain.  Of each context repeat it is asked here what precedes and follows its occurrences in the
texts.  A maximal repeat begins where some context repeat does that different bytes precede, ends where one does
that different bytes follow, and between the two context repeats follow each other without a gap: its first windows,
up to the end of their context, are a repeat of that context, its last ones of theirs, and those between are whole
contexts.  From each such begin the 1st, 2nd, 4th, ... end after it is tried until the string is unique, and then
all ends before that: at most twice as many strings as repeat, and no others.  Strings are counted by hash and length;
those with different bytes on both sides are the groups.

Null text: empty.  Texts shorter than `length` have no repeats.  Copies of a document, repeated rows included, are
occurrences of one repeat.  A null id is an id of its own.  Empty table: no rows.  Very long texts are whole.
Ties do not arise.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radiotiles.llm.common import column_bytes, stage
from radiotiles.llm.repeats import BUCKET, LENGTH, context_groups, in_bulk, in_pieces

SIDES = "gram long, repeat long, doc_id long, text_key long, lo long, stop long, before long, after long"
TRIED = "repeat long, n_bytes long, doc_id long, text_key long, lo long, step long"
FOUND = "repeat long, n_bytes long, doc_id long, text_key long, lo long, before long, after long"


def by_text(found: DataFrame, *columns: str) -> DataFrame:
    """d, k, found: the different rows of each text, of which there are as many as there are repeats in it."""
    return found.groupBy(F.col("doc_id").alias("d"), F.col("text_key").alias("k")).agg(F.collect_set(F.struct(*columns)).alias("found"))


def with_found(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs of which something was found, and that; of repeated rows, each."""
    met = docs.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")))
    return met.select("doc_id", "text_key", "text", *[c for c in found.columns if c not in ("d", "k")])


def fields(column: pa.ListArray) -> Iterator[list[np.ndarray]]:
    """Of each row of a column of lists of structs, the fields."""
    edges, inner = column.offsets.to_pylist(), column.values
    each = [inner.field(i).to_numpy(zero_copy_only=False) for i in range(inner.type.num_fields)]
    for a, b in zip(edges, edges[1:], strict=False):
        yield [x[a:b] for x in each]


def texts_with(batch: pa.RecordBatch) -> Iterator[tuple]:
    """doc_id, text_key, text and the fields of each further column."""
    ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    return zip(ids, keys, column_bytes(batch, "text"), *(fields(c) for c in batch.columns[3:]), strict=True)


def with_sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SIDES: each context repeat's occurrences with the bytes before and after them, -1 at a text's start and end."""
    for batch in batches:
        for doc_id, text_key, text, (gram, repeat, start, n) in texts_with(batch):
            ringed = np.concatenate([[-1], np.frombuffer(text, np.uint8), [-1]]).astype(np.int64)
            own = [pa.array([doc_id] * len(gram), pa.int64()), np.full(len(gram), text_key)]
            columns = [gram, repeat, *own, start, start + n, ringed[start], ringed[start + n + 1]]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=[c.split()[0] for c in SIDES.split(", ")])


def begins(found: list[np.ndarray], length: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each begin with the ends, ascending, that make a string of at least `length` bytes with it and that windows of
    repeats reach without a gap.  found: start, stop, whether it opens, whether it closes."""
    order = np.argsort(found[0], kind="stable")
    start, stop, opens, closes = (x[order] for x in found)
    reach = np.maximum.accumulate(stop)
    cuts = np.flatnonzero(start[1:] > reach[:-1] - length + 1) + 1
    for a, b in zip([0, *cuts], [*cuts, len(start)], strict=True):
        some = slice(a, b)
        lo, hi = np.unique(start[some][opens[some].astype(bool)]), np.unique(stop[some][closes[some].astype(bool)])
        for x, first in zip(lo.tolist(), np.searchsorted(hi, lo + length).tolist(), strict=True):
            if first < len(hi):
                yield x, hi[first:]


def digests(text: bytes, start: int, stops: list[int]) -> Iterator[int]:
    """Signed hashes of the text from the start to each stop; stops ascend, so each byte is read once."""
    state, at = xxhash.xxh3_64(), start
    for stop in stops:
        state.update(text[at:stop])
        at, h = stop, state.intdigest()
        yield h - (1 << 64) if h >> 63 else h


def different(column: str) -> Column:
    """Whether the bytes told in a group differ; a text's start or end differs from all."""
    return (F.min(column) != F.max(column)) | (F.min(column) < 0)


def repeat_groups(docs: DataFrame, length: int = LENGTH, bucket: int = BUCKET) -> DataFrame:
    """repeat, n_bytes, doc_id, text_key, start: every maximal repeat (repeat, n_bytes) of at least `length` bytes of the
    texts (docs: doc_id, text_key, text) with all its occurrences, of repeated rows once for each row.

    A maximal repeat is a byte string with several occurrences that neither all have the same byte before them nor all
    the same byte after them.  Strings are told by a 64-bit hash and their length.  The table grows with the nesting
    of repeats: one byte n times has some n^2 / 2 occurrences of n repeats."""
    pieces = by_text(context_groups(docs, length, bucket), "gram", "repeat", "start", "n_bytes")
    seen = stage(with_found(docs, pieces).mapInArrow(with_sides, SIDES), "sides")
    kinds = seen.groupBy(F.col("gram").alias("g"), F.col("repeat").alias("r")).agg(F.count("*").alias("n"), different("before").alias("opens"), different("after").alias("closes"))
    told = in_pieces(seen, stage(kinds, "kinds"), {"gram": "g", "repeat": "r"}, "n")
    ends = stage(by_text(told, "lo", "stop", "opens", "closes"), "ends")

    def tries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for doc_id, text_key, text, found in texts_with(batch):
                for x, stops in begins(found, length):
                    steps = [1 << j for j in range(len(stops).bit_length())]
                    own = stops[np.array(steps) - 1].tolist()
                    for h, y, step in zip(digests(text, x, own), own, steps, strict=True):
                        yield h, y - x, doc_id, text_key, x, step

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for doc_id, text_key, text, found, (lo, step) in texts_with(batch):
                furthest = dict(zip(lo.tolist(), step.tolist(), strict=True))
                for x, stops in begins(found, length):
                    own = stops[: 2 * furthest.get(x, 0) - 1].tolist() if x in furthest else []
                    for h, y in zip(digests(text, x, own), own, strict=True):
                        yield h, y - x, doc_id, text_key, x, text[x - 1] if x else -1, text[y] if y < len(text) else -1

    key = F.col("repeat").alias("r"), F.col("n_bytes").alias("b")
    names = {"repeat": "r", "n_bytes": "b"}
    tried = stage(with_found(docs, ends).mapInArrow(lambda batches: in_bulk(tries(batches), TRIED), TRIED), "tried")
    twice = stage(tried.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1"), "twice")
    far = in_pieces(tried, twice, names, "n", "left_semi").groupBy("doc_id", "text_key", "lo").agg(F.max("step").alias("step"))
    far = by_text(far, "lo", "step").withColumnsRenamed({"d": "far_d", "k": "far_k", "found": "far"})
    both = ends.join(far, F.col("d").eqNullSafe(F.col("far_d")) & (F.col("k") == F.col("far_k"))).drop("far_d", "far_k")
    every = stage(with_found(docs, both).mapInArrow(lambda batches: in_bulk(strings(batches), FOUND), FOUND), "strings")
    maximal = every.groupBy(*key).agg(F.count("*").alias("n"), different("before").alias("opens"), different("after").alias("closes"))
    maximal = stage(maximal.where("n > 1 and opens and closes").select("r", "b", "n"), "maximal")
    return in_pieces(every, maximal, names, "n", "left_semi").select("repeat", "n_bytes", "doc_id", "text_key", F.col("lo").alias("start"))
