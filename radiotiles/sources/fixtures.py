"""Measurement, structure, tile, prediction and cover tables made from the driver's tables, as SQL that
Spark and DuckDB both accept.  `element(v, i)` stands for the i-th value of an array, from 1."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "embeddings")

FIXTURES: dict[str, str] = {
    "fx_measurements": """
SELECT *, 40 + ((cell_m + cell_z) % 5) + 10 * (2.0 + 0.3 * city_idx) * log10(dist_m) + noise_db AS pathloss_db
FROM (
  SELECT *, sqrt((rx_x - tx_x) * (rx_x - tx_x) + (rx_y - tx_y) * (rx_y - tx_y) + (tx_h - rx_h) * (tx_h - rx_h)) AS dist_m,
    lat0 + rx_y / CAST(111320 AS DOUBLE) AS rx_lat, lon0 + rx_x / (CAST(111320 AS DOUBLE) * cos(radians(lat0))) AS rx_lon,
    lat0 + tx_y / CAST(111320 AS DOUBLE) AS tx_lat, lon0 + tx_x / (CAST(111320 AS DOUBLE) * cos(radians(lat0))) AS tx_lon,
    CAST(floor((rx_y + 1500) / CAST(300 AS DOUBLE)) AS BIGINT) AS cell_m, CAST(floor((rx_x + 1500) / CAST(300 AS DOUBLE)) AS BIGINT) AS cell_z
  FROM (
    SELECT r_name AS city, r_regionkey AS city_idx, l_suppkey AS bs_id, l_orderkey, l_linenumber, l_partkey,
      CAST(40 + 3 * r_regionkey AS DOUBLE) AS lat0, CAST(2 + 5 * r_regionkey AS DOUBLE) AS lon0,
      (l_orderkey * 7919 + l_partkey * 104729 + l_linenumber * 31) % 3000 - CAST(1499.5 AS DOUBLE) AS rx_x,
      (l_orderkey * 104723 + l_partkey * 7907 + l_linenumber * 17) % 3000 - CAST(1499.5 AS DOUBLE) AS rx_y,
      CAST(1.5 AS DOUBLE) AS rx_h,
      (l_suppkey * 6151) % 2400 - CAST(1199.5 AS DOUBLE) AS tx_x,
      (l_suppkey * 3079) % 2400 - CAST(1199.5 AS DOUBLE) AS tx_y,
      CAST(20 + l_suppkey % 30 AS DOUBLE) AS tx_h,
      CAST(40 * (l_discount + l_tax - 0.09) AS DOUBLE) AS noise_db
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey))""",
    "fx_structures": """
SELECT r_name AS city, o_orderkey AS structure_id,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'water' WHEN o_orderpriority = '2-HIGH' THEN 'vegetation' ELSE 'building' END AS kind,
  (o_orderkey * 7919 + o_custkey * 31) % 3000 - CAST(1499.5 AS DOUBLE) AS cx,
  (o_orderkey * 104723 + o_custkey * 17) % 3000 - CAST(1499.5 AS DOUBLE) AS cy,
  CAST(8 + o_orderkey % 25 AS DOUBLE) AS width_m, CAST(8 + o_custkey % 31 AS DOUBLE) AS depth_m,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(2 + o_custkey % 70 AS STRING) ELSE NULL END AS height_tag,
  CASE WHEN o_orderkey % 3 = 1 THEN CAST(1 + o_custkey % 12 AS STRING) WHEN o_orderkey % 30 = 2 THEN 'n/a' ELSE NULL END AS levels_tag
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "fx_tiles": """
SELECT vec_id AS tile, concat('c', CAST(label AS STRING)) AS city, embedding AS v,
  2.5 + CAST(element(embedding, 1) AS DOUBLE) + 0.5 * CAST(element(embedding, 2) AS DOUBLE) AS gamma,
  30 + 10 * CAST(element(embedding, 3) AS DOUBLE) AS pl0, 5 + vec_id % 20 AS n_measurements
FROM embeddings""",
    "fx_predictions": """
SELECT model, city AS fold, tile, target, truth, CASE WHEN model = 'c' THEN CAST(2.5 AS DOUBLE) ELSE truth + amp * ((tile * 3) % 7 - CAST(2.5 AS DOUBLE)) END AS pred,
  0.1 + CAST(tile % 5 AS DOUBLE) / 10 AS sigma
FROM (
  SELECT tile, city, 'gamma' AS target, gamma AS truth FROM fx_tiles UNION ALL SELECT tile, city, 'pl0' AS target, pl0 AS truth FROM fx_tiles) AS t
CROSS JOIN (SELECT 'a' AS model, CAST(0.05 AS DOUBLE) AS amp UNION ALL SELECT 'b', CAST(0.1 AS DOUBLE) UNION ALL SELECT 'c', CAST(0 AS DOUBLE)) AS k""",
    "fx_paths": """
SELECT l_suppkey AS bs_id, l_orderkey, l_linenumber, l_partkey, -60 - CAST(l_quantity AS DOUBLE) AS p1,
  CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE -70 - CAST(l_partkey % 40 AS DOUBLE) END AS p2, CAST(l_linenumber % 4 AS INT) AS hops FROM lineitem""",
    "fx_points": """
SELECT c_custkey AS point_id, (c_custkey * 7919) % 3000 - CAST(1499.5 AS DOUBLE) AS px, (c_custkey * 104729) % 3000 - CAST(1499.5 AS DOUBLE) AS py FROM customer""",
    "fx_sites": """
SELECT s_suppkey AS candidate_id, (s_suppkey * 6151) % 2400 - CAST(1199.5 AS DOUBLE) AS sx, (s_suppkey * 3079) % 2400 - CAST(1199.5 AS DOUBLE) AS sy FROM supplier""",
    "fx_corners": """
SELECT city, k, lat0 + radius * sin(angle) / CAST(111320 AS DOUBLE) AS lat, lon0 + radius * cos(angle) / (CAST(111320 AS DOUBLE) * cos(radians(lat0))) AS lon
FROM (
  SELECT r_name AS city, c_custkey, row_number() OVER (PARTITION BY r_name ORDER BY c_custkey) AS k, CAST(40 + 3 * r_regionkey AS DOUBLE) AS lat0, CAST(2 + 5 * r_regionkey AS DOUBLE) AS lon0,
    2 * pi() * row_number() OVER (PARTITION BY r_name ORDER BY c_custkey) / count(*) OVER (PARTITION BY r_name) AS angle, CAST(500.5 + (c_custkey * 7919) % 1400 AS DOUBLE) AS radius
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "fx_dem": """
SELECT p_partkey AS point_id, (p_partkey * 7919) % 3000 - CAST(1499.5 AS DOUBLE) AS x, (p_partkey * 104729) % 3000 - CAST(1499.5 AS DOUBLE) AS y, p_retailprice AS asl, p_retailprice / 10 AS agl FROM part""",
    "fx_climate": """
SELECT CAST(floor(n_nationkey / CAST(5 AS DOUBLE)) AS BIGINT) AS gi, CAST(n_nationkey % 5 AS BIGINT) AS gj, year(o_orderdate) * 12 + month(o_orderdate) AS time, month(o_orderdate) AS month,
  avg(o_totalprice) / 1000 AS t2m, avg(CAST(o_custkey % 100 AS DOUBLE)) / 7 AS rh, avg(CAST(o_orderkey % 50 AS DOUBLE)) / 9 AS tp
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3, 4""",
    "fx_stations": """
SELECT s_suppkey AS point_id, CAST((s_suppkey * 7919) % 450 AS DOUBLE) / 100 AS lat, CAST((s_suppkey * 104729) % 450 AS DOUBLE) / 100 AS lon FROM supplier""",
}
NEEDS = {"fx_predictions": ("fx_tiles",)}


def spark_sql(text: str) -> str:
    return re.sub(r"element\((\w+), (\d+)\)", r"element_at(\1, \2)", text)


def duck_sql(text: str) -> str:
    return re.sub(r"element\((\w+), (\d+)\)", r"\1[\2]", text).replace("AS STRING", "AS VARCHAR")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    for t in BASE:
        if re.search(rf"\b{t}\b", FIXTURES[name] + "".join(FIXTURES[n] for n in NEEDS.get(name, ()))):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    for n in NEEDS.get(name, ()):
        fixture(spark, sf_dir, n).createOrReplaceTempView(n)
    return spark.sql(spark_sql(FIXTURES[name]))


def cte(*names: str) -> str:
    """Fixtures as DuckDB CTEs, for the head of a WITH clause."""
    order = list(dict.fromkeys(x for n in names for x in (*NEEDS.get(n, ()), n)))
    return ",\n".join(f"{n} AS ({duck_sql(FIXTURES[n])})" for n in order)
