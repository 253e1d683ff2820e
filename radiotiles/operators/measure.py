"""From simulator or receiver rows to measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radiotiles.functions.radio import finite, hash_rank_key
from radiotiles.operators.draws import flag_least


def drop_unreached(rows: DataFrame, c: str = "pathloss_db") -> DataFrame:
    return rows.where(finite(F.col(c)))


def cells_to_measurements(cells: DataFrame, max_pathloss_db: float, per_station: int, seed: int, *keys: str) -> DataFrame:
    """Radio-map cells (city, bs_id, path_gain, keys) as path loss, at most `per_station` of each station,
    drawn by a seeded hash of the keys."""
    loss = cells.withColumn("pathloss_db", -10.0 * F.log10(F.greatest("path_gain", F.lit(1e-30)))).where(F.col("pathloss_db") <= max_pathloss_db)
    drawn = flag_least(loss, ("city", "bs_id"), hash_rank_key(seed, *[F.col(k) for k in keys]), keys, lambda n: F.lit(per_station), "__drawn")
    return drawn.where("__drawn").drop("__drawn")


def silent_stations(stations: DataFrame, measurements: DataFrame) -> DataFrame:
    """Stations without a covered cell."""
    return stations.join(measurements.select("city", "bs_id"), ["city", "bs_id"], "left_anti")


def ingest_summary(rows: DataFrame) -> DataFrame:
    """Counts and ranges by station; los_share: the share of the rows whose line of sight is known that have one."""
    return rows.groupBy("city", "bs_id").agg(
        F.count("*").alias("n_total"),
        F.count_if(finite(F.col("pathloss_db"))).alias("n_valid"),
        F.min("pathloss_db").alias("pl_min"),
        F.max("pathloss_db").alias("pl_max"),
        F.avg(F.col("los").cast("double")).alias("los_share"),
    )
