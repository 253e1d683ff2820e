"""The rows of least hash of each group, without putting a whole group in order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Leading hex digits of a hash that make a bin: 4096 bins.
DIGITS = 3


def flag_least(rows: DataFrame, keys: tuple[str, ...], order: Column, ties: tuple[str, ...], limit: Callable[[Column], Column], name: str, digits: int = DIGITS) -> DataFrame:
    """`rows` with a boolean: is the row among the `limit(n)` first of its keys' n rows, by the hex digits `order` and
    then by `ties`?  A histogram of the leading digits tells the bin in which the limit falls; rows of bins before it are
    in, those after it out, and only that bin is ranked: a 4096th of a group.  Null keys are a group of their own; rows that
    are equal in order and ties are taken as they come."""
    own = rows.withColumn("__order", order).withColumn("__bin", F.substring("__order", 1, digits))
    by = Window.partitionBy(*keys)  # the bins of a group
    bins = own.groupBy(*keys, "__bin").agg(F.count("*").alias("__n"))
    run = bins.withColumn("__run", F.sum("__n").over(by.orderBy("__bin"))).withColumn("__limit", limit(F.sum("__n").over(by)))
    full = F.col("__run") < F.col("__limit")
    cuts = run.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(
        F.min(F.when(~full, F.col("__bin"))).alias("__cut"),
        (F.first("__limit") - F.coalesce(F.max(F.when(full, F.col("__run"))), F.lit(0))).alias("__need"),
    )
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    at = own.join(cuts, same).drop(*[f"__{k}" for k in keys])
    inside = F.col("__cut").isNotNull() & (F.col("__bin") == F.col("__cut"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("__order", *ties))  # the rows of one bin
    sure = at.where(~inside).withColumn(name, F.coalesce(F.col("__bin") < F.col("__cut"), F.lit(True)))
    ranked = at.where(inside).withColumn(name, rank <= F.col("__need"))
    return sure.unionByName(ranked).drop("__order", "__bin", "__cut", "__need")
