"""Reading and writing measurement and tile tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from radiotiles.functions.radio import finite

_D = T.DoubleType()
#: The one schema of measurements.
MEASUREMENTS = T.StructType(
    [T.StructField("bs_id", T.StringType()), T.StructField("freq_mhz", _D)]
    + [T.StructField(c, _D) for c in ("tx_lat", "tx_lon", "tx_h", "rx_lat", "rx_lon", "rx_h", "dist_m", "pathloss_db")]
    + [T.StructField("los", T.BooleanType()), T.StructField("city", T.StringType())]
)
#: Footprints: vertices in order, one row for each polygon.
GEOJSON = "features array<struct<id: string, properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"


def scan_measurements(spark: SparkSession, path: str, cities: list[str] | None = None) -> DataFrame:
    """Measurements stored by city; with `cities`, only their folders are read."""
    df = spark.read.schema(MEASUREMENTS).parquet(path)
    return df if cities is None else df.where(F.col("city").isin(cities))


def missing_cities(measurements: DataFrame, cities: DataFrame) -> DataFrame:
    """The cities (city) without a measurement."""
    return cities.join(measurements.select("city"), "city", "left_anti")


def scan_tiles(tiles: DataFrame, cities: list[str] | None = None, min_measurements: int = 10) -> DataFrame:
    """Fitted tiles with enough measurements."""
    kept = tiles.where((F.col("n_measurements") >= min_measurements) & finite(F.col("gamma")))
    return kept if cities is None else kept.where(F.col("city").isin(cities))


def stack(tiles: DataFrame, splits: DataFrame, role: str) -> DataFrame:
    """The tiles of the cities that have a role in each fold."""
    return tiles.join(F.broadcast(splits.where(F.col("role") == role)), "city")  # folds x cities rows


def read_campaign_csv(spark: SparkSession, path: str, mapping: dict[str, str], city: str | None = None) -> DataFrame:
    """Drive-test CSVs in the one schema; mapping: canonical name to the campaign's.  Without `city` the files lie in
    folders city=..., which name it, and all are read at once."""
    raw = spark.read.csv(path, header=True)
    if city is None and "city" not in raw.columns:
        raise ValueError(f"no city and no folders city=... in {path}")
    if missing := sorted(set(mapping.values()) - set(raw.columns)):
        raise ValueError(f"columns missing in {path}: {missing}")
    names = mapping if city is not None else {**mapping, "city": "city"}
    known = {f.name: f.dataType for f in MEASUREMENTS}
    cols = [(F.col(f"`{names[n]}`").try_cast(t) if n in names else F.lit(city if n == "city" else None).cast(t)).alias(n) for n, t in known.items()]
    return raw.select(*cols)


def read_geojson(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """feature_id, tags, type and vertices (array of x, y) of each polygon of a GeoJSON collection; a
    multipolygon gives one row for each part, inner rings are left out.  Without `multi_line`, each line is a
    collection."""
    rows = spark.read.schema(GEOJSON).json(path, multiLine=multi_line).select(F.explode("features").alias("f")).select("f.id", F.col("f.properties").alias("tags"), "f.geometry.*")
    ring = "array<array<array<double>>>"
    one = F.array(F.from_json("coordinates", ring))
    many = F.from_json("coordinates", f"array<{ring}>")
    parts = rows.where(F.col("type").isin("Polygon", "MultiPolygon")).withColumn("part", F.explode(F.when(F.col("type") == "Polygon", one).otherwise(many)))
    points = F.transform(F.get("part", 0), lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y")))
    return parts.select(F.col("id").alias("feature_id"), "tags", "type", points.alias("vertices"))


def scan_eval_records(spark: SparkSession, pattern: str) -> DataFrame:
    """eval.json records with the name of the run's folder."""
    return spark.read.json(pattern, multiLine=True).withColumn("run", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def write_tiles(tiles: DataFrame, path: str) -> None:
    """By city; only the cities in `tiles` are replaced."""
    tiles.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("city").parquet(path)


def refreshed(tiles: DataFrame, update: DataFrame, keys: tuple[str, ...] = ("city", "m", "z")) -> DataFrame:
    """Tiles with the columns of `update` put in by key; its columns replace those of the same name."""
    new = [c for c in update.columns if c not in keys]
    return tiles.drop(*new).join(update, list(keys), "left")


def write_result(df: DataFrame, path: str, form: str = "csv") -> None:
    df.write.mode("overwrite").option("header", True).format(form).save(path)


def provenance(measurements: DataFrame) -> DataFrame:
    """Counts, ranges, frequencies and origin (the mean transmitter position) by city."""
    return measurements.groupBy("city").agg(
        F.count("*").alias("n_measurements"),
        F.countDistinct("bs_id").alias("n_bs"),
        F.min("pathloss_db").alias("pl_min"),
        F.max("pathloss_db").alias("pl_max"),
        F.min("freq_mhz").alias("freq_min_mhz"),
        F.max("freq_mhz").alias("freq_max_mhz"),
        F.avg("tx_lat").alias("origin_lat"),
        F.avg("tx_lon").alias("origin_lon"),
    )


def union_measurements(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def with_transmit_power(rows: DataFrame, scenarios: DataFrame, key: str, received: str) -> DataFrame:
    """`rows` with pathloss_db, the scenario's p_tx_dbm less the received power; `scenarios` is a short table by `key`."""
    return rows.join(F.broadcast(scenarios.select(key, "p_tx_dbm")), key).withColumn("pathloss_db", F.col("p_tx_dbm") - F.col(received))
