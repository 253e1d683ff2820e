"""Folds and draws; random order is a portable hash of the keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from radiotiles.functions.radio import hash_rank_key
from radiotiles.operators.draws import flag_least


# Numbers of anchors, and draws of each.
KS, DRAWS = (3, 5, 10, 25, 50, 100), 10


def leave_one_city_out(cities: DataFrame, n_val: int = 1, seed: int = 0) -> DataFrame:
    """fold, city, role: each city is the test city of its own fold."""
    pairs = cities.select(F.col("city").alias("fold")).crossJoin(F.broadcast(cities.select("city")))  # a row for each city
    order = Window.partitionBy("fold", F.col("city") == F.col("fold")).orderBy(hash_rank_key(seed, F.col("fold"), F.col("city")))
    role = F.when(F.col("city") == F.col("fold"), "test").when(F.row_number().over(order) <= n_val, "val").otherwise("train")
    return pairs.select("fold", "city", role.alias("role"))


def geographic_blocks(points: DataFrame, lat: str, lon: str, n_blocks: int = 5, seed: int = 0) -> DataFrame:
    """Points with block and is_val: quantile cells by city, a fifth of the cells (at least one) to validation."""
    inner = F.array(*[F.lit(i / n_blocks) for i in range(1, n_blocks)])
    edges = points.groupBy("city").agg(F.array_distinct(F.percentile(lat, inner)).alias("e_lat"), F.array_distinct(F.percentile(lon, inner)).alias("e_lon"))

    def bucket(v: str, e: str) -> Column:
        return F.size(F.filter(e, lambda x: F.col(v) > x))

    placed = points.join(F.broadcast(edges), "city").withColumn("block", bucket(lat, "e_lat") * n_blocks + bucket(lon, "e_lon")).drop("e_lat", "e_lon")  # a row for each city
    by = Window.partitionBy("city")
    blocks = placed.select("city", "block").distinct()
    chosen = blocks.select("city", "block", (F.row_number().over(by.orderBy(hash_rank_key(seed, F.col("city"), F.col("block")))) <= F.greatest(F.lit(1), F.floor(F.count("*").over(by) / 5))).alias("is_val"))
    return placed.join(F.broadcast(chosen), ["city", "block"])  # n_blocks ** 2 rows for each city


def holdout(tiles: DataFrame, share: float = 0.15, seed: int = 0, key: str = "tile", by: str = "city") -> DataFrame:
    """Exactly int(share * n) rows of each group to validation, by hash order."""
    return flag_least(tiles, (by,), hash_rank_key(seed, F.col(key)), (key,), lambda n: F.floor(n * share + 1e-9), "is_val")


def anchors(tiles: DataFrame, ks: tuple[int, ...] = KS, draws: int = DRAWS, seed: int = 0) -> DataFrame:
    """(city, k, draw, tile, is_anchor): k tiles of each city in each draw without replacement."""
    grid = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(d).alias("draw")) for k in ks for d in range(draws)]))
    rows = tiles.select("city", "tile", grid.alias("g")).select("city", "tile", "g.*")
    drawn = flag_least(rows, ("city", "k", "draw"), hash_rank_key(seed, F.col("k"), F.col("draw"), F.col("tile")), ("tile",), lambda n: F.col("k").cast("long"), "is_anchor")
    return drawn.select("city", "tile", "k", "draw", "is_anchor")
