"""Sharding by a two-pass external shuffle.

Pass one scatters whole records into buckets that fit in memory, by a seeded hash of the record.
Pass two shuffles each bucket with Fisher-Yates.  The buckets laid end to end are one random order
of all rows; cutting it at equal row counts gives the shards, so the law is `rows`: counts are at
most one apart.  Buckets stay of one size whatever the input; their row counts are added up by ranges of
RANGE buckets, and sent to all tasks only while there are few of them.

Empty table: no rows.  Null ids and texts: hashed as nulls, size 8 for a null text.  Rows are told apart by
all their columns but maps, so the order does not depend on how the input is dealt.  Repeated rows: each gets
a place of its own; of over MANY rows that are equal, each scatters by its number among them.
Equal texts under different ids scatter independently, so a group of copies never meets in one bucket.  A very
long text stays whole in its bucket.  Input columns named shard or slot are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from radiotiles.llm.common import stage


#: Buckets whose counts are added up together, and equal rows from which on they scatter one by one.
RANGE, MANY = 1000, 1000
#: Keys of such rows, and counts of buckets, that are sent to all tasks; more are joined by shuffle.
SENT_KEYS, SENT_BUCKETS = 100_000, 200_000


def record_bytes(text: Column) -> Column:
    """UTF-8 bytes of the text plus 8."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A permutation of 0..n-1, decided by seed and bucket."""
    order = list(range(n))
    draws = np.random.default_rng([seed, bucket]).random(n)
    for i in range(n - 1, 0, -1):
        j = int(draws[i] * (i + 1))
        order[i], order[j] = order[j], order[i]
    return np.array(order, dtype=np.int64)


def row_key(docs: DataFrame, seed: int, first: tuple[str, ...] = ()) -> Column:
    """A hash of a row: of its id and text, and of all other columns that hash (maps do not)."""
    hashes = [f.name for f in docs.schema.fields if f.name not in first and "map<" not in f.dataType.simpleString()]
    return F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in (*first, *hashes)])


def numbers_of_copies(rows: DataFrame, many: DataFrame) -> DataFrame:
    """`rows` (key, rec, part) with `copy`: the number of a row among those of its key, from 0, for the keys in `many`;
    null for others.  Rows of a key are numbered within each input partition, after those of the partitions before."""
    marked = rows.join(many, F.col("key") == F.col("many"), "left")
    hot = marked.where(F.col("many").isNotNull())
    parts = hot.groupBy("key", "part").agg(F.count("*").alias("n"))
    before = parts.select(F.col("key").alias("k"), F.col("part").alias("p"), (F.sum("n").over(Window.partitionBy("key").orderBy("part")) - F.col("n")).alias("before"))  # a row for each input partition
    inside = F.row_number().over(Window.partitionBy("key", "part").orderBy(F.lit(0))) - 1  # rows of one input partition, all alike
    counted = hot.withColumn("inside", inside).join(before, (F.col("key") == F.col("k")) & (F.col("part") == F.col("p")))
    numbered = counted.select("rec", "key", (F.col("before") + F.col("inside")).alias("copy"))
    return marked.where(F.col("many").isNull()).select("rec", "key", F.lit(None).cast("long").alias("copy")).unionByName(numbered)


def external_shuffle(docs: DataFrame, seed: int = 20, bucket_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text", total: int | None = None) -> DataFrame:
    """All rows of `docs` as (rec, rank): rec is the row as a struct, rank its place in a random order.  `total`: the bytes
    of all records, where they are known."""
    rec, size = F.struct(*[F.col(f"`{c}`") for c in docs.columns]), record_bytes(F.col(text_col))
    if total is None:
        total = docs.agg(F.sum(size)).first()[0] or 0
    n_buckets = max(1, -(-total // bucket_bytes))
    keyed = docs.select(rec.alias("rec"), row_key(docs, seed, (id_col, text_col)).alias("key"), F.spark_partition_id().alias("part"))
    many = stage(keyed.groupBy(F.col("key").alias("many")).count().where(F.col("count") > MANY).select("many"), "many")
    found = many.count()
    if not found:
        rows = keyed.select("rec", "key", F.lit(None).cast("long").alias("copy"))
    else:
        rows = numbers_of_copies(keyed, F.broadcast(many) if found <= SENT_KEYS else many)
    spread = F.when(F.col("copy").isNull(), F.col("key")).otherwise(F.xxhash64("key", "copy"))
    scattered = rows.select("rec", F.pmod(spread, F.lit(n_buckets)).alias("bucket"), F.xxhash64(F.lit(seed + 1), spread).alias("tie"))
    placed = T.StructType([scattered.schema["rec"], T.StructField("bucket", T.LongType()), T.StructField("place", T.LongType())])

    def shuffle(group: pa.Table) -> pa.Table:
        group = group.sort_by("tie")  # the order of arrival is not repeatable; this one is, but for rows that are alike
        bucket = group.column("bucket")[0].as_py()
        place = fisher_yates(group.num_rows, seed, bucket)
        return pa.table({"rec": group.column("rec"), "bucket": group.column("bucket"), "place": pa.array(place)})

    shuffled = stage(scattered.groupBy("bucket").applyInArrow(shuffle, placed), "shuffled")
    bases = bases_of(shuffled.groupBy("bucket").agg(F.count("*").alias("n")))
    if n_buckets <= SENT_BUCKETS:
        bases = F.broadcast(bases)
    return shuffled.join(bases, "bucket").select("rec", (F.col("base") + F.col("place")).alias("rank"))


def bases_of(counts: DataFrame) -> DataFrame:
    """(bucket, base): the rows of the buckets before each, added up in ranges of RANGE buckets and then over the ranges."""
    ranged = counts.withColumn("range", F.expr(f"bucket div {RANGE}"))
    sums = ranged.groupBy("range").agg(F.sum("n").alias("all"))
    lower = sums.select("range", (F.sum("all").over(Window.orderBy("range")) - F.col("all")).alias("lower"))  # a row for each 1000 buckets
    inside = F.sum("n").over(Window.partitionBy("range").orderBy("bucket")) - F.col("n")
    return ranged.withColumn("inside", inside).join(lower, "range").select("bucket", (F.col("lower") + F.col("inside")).alias("base"))


def assign_shards(docs: DataFrame, n_shards: int = 24, **how) -> DataFrame:
    """The columns of `docs` with shard (int) and slot (long, gapless from 0 in each shard)."""
    text_col = how.get("text_col", "text")
    known = docs.agg(F.count("*").alias("n"), F.sum(record_bytes(F.col(text_col))).alias("bytes")).first()
    n, how = known["n"], how | {"total": known["bytes"] or 0}
    shard = F.floor(F.col("rank") * n_shards / F.lit(max(n, 1))) if n == 0 else F.expr(f"(rank * {n_shards}) div {n}")
    first = F.expr(f"(shard * {n}L + {n_shards - 1}) div {n_shards}")
    return (
        external_shuffle(docs, **how)
        .select("rec", "rank", shard.cast("int").alias("shard"))
        .select(*[F.col("rec").getField(c).alias(c) for c in docs.columns if c not in ("shard", "slot")], "shard", (F.col("rank") - first).alias("slot"))
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard, its rows in slot order."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
