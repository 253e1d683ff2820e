"""Work on all pairs of two tables in blocks, and running totals without one task for each key."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from radiotiles.sources.scratch import stage

Work = Callable[[pa.Table, pa.Table], pa.Table]


def matrix(table: pa.Table, column: str) -> np.ndarray:
    """A column of equally long arrays as a matrix."""
    values = table.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return values.reshape(table.num_rows, -1) if table.num_rows else np.empty((0, 0))


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if not len(a) or not len(b):  # a block may be empty on one side
        return np.zeros((len(a), len(b)))
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0.0)


def block_pairs(left: DataFrame, right: DataFrame, keys: tuple[str, ...], unit: str, work: Work, schema: str, per_block: int = 2000, once: bool = False) -> DataFrame:
    """`work` of every two blocks of rows with equal keys, end to end.  A key's rows are dealt by a hash of `unit` to
    blocks of about `per_block` rows, so a task holds two blocks however many rows a key has; a row is sent
    once for each block of the other side.  With `once`, `left` is `right` and blocks (columns __a and __b) meet in one order."""
    counts = [t.groupBy(*keys).agg(F.ceil(F.count("*") / per_block).alias(n)) for t, n in ((left, "__left"), (right, "__right"))]
    sizes = counts[0].join(counts[1], list(keys))
    # columns of both sides are named anew, as they may be the same table
    deal = lambda t, own, other, a, b: (
        t.join(sizes, list(keys))
        .select(*[F.col(c).alias(c) for c in (*t.columns, "__left", "__right")])
        .withColumn(a, F.pmod(F.xxhash64(unit), F.col(own)))
        .withColumn(b, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
        .drop("__left", "__right")
    )
    a, b = deal(left, "__left", "__right", "__a", "__b"), deal(right, "__right", "__left", "__b", "__a")
    if once:
        a, b = (t.where("__a <= __b") for t in (a, b))
    by = [*keys, "__a", "__b"]
    return a.groupBy(*by).cogroup(b.groupBy(*by)).applyInArrow(work, schema)


def running_total(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], amount: str, name: str) -> DataFrame:
    """`rows` with the total of `amount` over the rows of the same keys up to each in the order, ties included.
    Rows are dealt by ranges of keys and order; ranges before add one number for each key and range."""
    dealt = stage(rows.repartitionByRange(*keys, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy(*keys, "__range").agg(F.sum(amount).alias("__sum"))
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sums = sums.select(*keys, "__range", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*keys, "__range").orderBy(*order)
    out = dealt.withColumn(name, F.sum(amount).over(inside)).join(sums, [*keys, "__range"])
    return out.withColumn(name, F.col(name) + F.col("__before")).drop("__range", "__before")
