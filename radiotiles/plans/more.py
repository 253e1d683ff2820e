"""More named queries: sources and sinks, polygons, descriptor vectors, rasters, and models on descriptors.  Importing
this module adds them to `radiotiles.plans.queries`."""

from __future__ import annotations

from pyspark.sql import functions as F

from radiotiles.functions import geo, radio
from radiotiles.operators import boosting, descriptors, fits, grid, metrics, robustness, siting, splits, structures, transfer
from radiotiles.plans.queries import COVER, GRID, HEIGHT, METRIC_TILE, OFF, ORACLE, PRED, RADIUS_M, RIDGE, TILE_M, TOUCH, _buildings, _splits, _stacked, greedy_sql, query, r, recursive, rows, solved
from radiotiles.sources import tables
from radiotiles.sources.fixtures import cte
from radiotiles.sources.scratch import scratch_path, stage

# ---- sources and sinks ----


def _measurements(spark, sf):
    """Measurements in the one schema."""
    m = rows(spark, sf)
    return tables.union_measurements(m.select(F.col("bs_id").cast("string").alias("bs_id"), F.lit(3500.0).alias("freq_mhz"), "tx_lat", "tx_lon", "tx_h", "rx_lat", "rx_lon", "rx_h", "dist_m", "pathloss_db", F.lit(None).cast("boolean").alias("los"), "city"))


@query(f"WITH {cte('fx_measurements')} SELECT city, count(*) AS n, count(DISTINCT bs_id) AS n_bs, round(avg(pathloss_db), 5) AS mean_db FROM fx_measurements WHERE city IN ('ASIA', 'EUROPE') GROUP BY city")
def a1_scan_measurements(spark, sf):
    """Written by city and read back for two cities, whose folders alone are listed by the scan."""
    path = scratch_path(spark, "measurements")
    tables.write_tiles(_measurements(spark, sf), path)
    back = tables.scan_measurements(spark, path, ["ASIA", "EUROPE"])
    return back.groupBy("city").agg(F.count("*").alias("n"), F.countDistinct("bs_id").alias("n_bs"), r(F.avg("pathloss_db"), 5, "mean_db"))


@query(f"WITH {cte('fx_measurements')} SELECT city, count(*) AS n, round(avg(pathloss_db), 5) AS mean_db, round(max(rx_lat), 6) AS top FROM fx_measurements GROUP BY city")
def a4_campaign_csv(spark, sf):
    """Drive-test CSVs in a folder for each city with names of their own, read at once in the one schema."""
    names = {"bs_id": "Cell ID", "rx_lat": "Latitude", "rx_lon": "Longitude", "pathloss_db": "Path loss"}
    path = scratch_path(spark, "campaign")
    rows(spark, sf).select("city", *[F.col(c).alias(n) for c, n in names.items()]).write.partitionBy("city").option("header", True).csv(path)
    back = tables.read_campaign_csv(spark, path, names)
    return back.groupBy("city").agg(F.count("*").alias("n"), r(F.avg("pathloss_db"), 5, "mean_db"), r(F.max("rx_lat"), 6, "top"))


@query(PRED + f" SELECT model, fold, round(avg(abs(pred - truth)) FILTER (target = 'gamma') + {OFF}, 6) AS gamma_mae, round(avg(abs(pred - truth)) FILTER (target = 'pl0') + {OFF}, 6) AS pl0_mae FROM fx_predictions GROUP BY ALL")
def a6_eval_records(spark, sf):
    """Each run's eval.json is written to its folder and all are read by one pattern."""
    root = scratch_path(spark, "runs")
    report = metrics.errors(rows(spark, sf, "fx_predictions")).groupBy("model", "fold").pivot("target", ["gamma", "pl0"]).agg(F.first("mae"))
    named = report.select(F.format_string("%s_loco_%s_s0", "model", "fold").alias("run"), F.col("gamma").alias("gamma_mae"), F.col("pl0").alias("pl0_mae"))
    named.write.partitionBy("run").json(root)
    part = lambda k: F.regexp_extract("run", r"^(?:run=)?(.*)_loco_(.+)_s\d+$", k)
    return tables.scan_eval_records(spark, f"{root}/*/*.json").select(part(1).alias("model"), part(2).alias("fold"), r(F.col("gamma_mae") + OFF, 6, "gamma_mae"), r(F.col("pl0_mae") + OFF, 6, "pl0_mae"))


@query(f"WITH {cte('fx_tiles')} SELECT city, count(*) AS n, round(sum(CASE WHEN city = 'c1' THEN gamma + 1 ELSE gamma END), 4) AS gamma FROM fx_tiles GROUP BY city")
def a7_tile_sink(spark, sf):
    """All cities are written, then one again with other values: the others stay."""
    path, t = scratch_path(spark, "tiles"), rows(spark, sf, "fx_tiles").select("tile", "city", "gamma")
    tables.write_tiles(t, path)
    tables.write_tiles(t.where("city = 'c1'").withColumn("gamma", F.col("gamma") + 1), path)
    return spark.read.parquet(path).groupBy("city").agg(F.count("*").alias("n"), r(F.sum("gamma"), 4, "gamma"))


@query(PRED + f" SELECT form, model, fold, target, count(*) AS n, round(avg(abs(pred - truth)) + {OFF}, 5) AS mae FROM fx_predictions CROSS JOIN (VALUES ('csv'), ('json')) f(form) GROUP BY ALL")
def a9_result_sinks(spark, sf):
    """The report as CSV and as JSON, read back."""
    report = metrics.errors(rows(spark, sf, "fx_predictions")).select(*metrics.KEYS, "n", "mae")
    out = None
    for form in ("csv", "json"):
        path = scratch_path(spark, form)
        tables.write_result(report, path, form)
        back = spark.read.schema(report.schema).option("header", True).format(form).load(path).withColumn("form", F.lit(form))
        out = back if out is None else out.unionByName(back)
    return out.select("form", *metrics.KEYS, "n", r(F.col("mae") + OFF, 5, "mae"))


@query(f"WITH {cte('fx_paths')} SELECT hops, count(*) AS n, round(avg(-p1 + CASE hops WHEN 0 THEN 30 WHEN 1 THEN 33 WHEN 2 THEN 36 END), 4) AS mean_pl FROM fx_paths WHERE hops < 3 GROUP BY hops")
def b3_transmit_power(spark, sf):
    """Received power and the scenario's transmit power give the loss; a scenario without one gives no rows."""
    scenarios = spark.createDataFrame([(0, 30.0), (1, 33.0), (2, 36.0)], "hops int, p_tx_dbm double")
    return tables.with_transmit_power(rows(spark, sf, "fx_paths"), scenarios, "hops", "p1").groupBy("hops").agg(F.count("*").alias("n"), r(F.avg("pathloss_db"), 4, "mean_pl"))


@query(f"WITH {cte('fx_measurements')} SELECT city, round(max(abs(lat0 + rx_y / 111320 - rx_lat)) * 1e9, 1) AS off_lat, round(avg(lon0 + tx_x / (111320 * cos(radians(lat0)))), 6) AS mean_lon, round(avg(sqrt(pow(rx_x - tx_x, 2) + pow(rx_y - tx_y, 2) + pow(rx_h - tx_h, 2))), 4) AS mean_m FROM fx_measurements GROUP BY city")
def b6_local_metres(spark, sf):
    """Origins come from a table of cities."""
    m = rows(spark, sf)
    origins = m.select("city", "lat0", "lon0").distinct()
    placed = m.drop("lat0", "lon0").join(F.broadcast(origins), "city")  # a row for each city
    off = F.max(F.abs(geo.local_to_lat(F.col("rx_y"), F.col("lat0")) - F.col("rx_lat"))) * 1e9
    dist = geo.euclid3d_m(F.col("rx_x") - F.col("tx_x"), F.col("rx_y") - F.col("tx_y"), F.col("rx_h") - F.col("tx_h"))
    return placed.groupBy("city").agg(r(off, 1, "off_lat"), r(F.avg(geo.local_to_lon(F.col("tx_x"), F.col("lat0"), F.col("lon0"))), 6, "mean_lon"), r(F.avg(dist), 4, "mean_m"))


@query(f"WITH {cte('fx_measurements')} SELECT bs_id, count(*) AS n, count(*) FILTER (city_idx <= 2) AS n_indexed, round(sum(pathloss_db), 3) AS total FROM fx_measurements GROUP BY bs_id")
def b10_union(spark, sf):
    """Two frames that lack different columns."""
    m = rows(spark, sf)
    a, b = m.where("city_idx <= 2").select("bs_id", "city_idx", "pathloss_db"), m.where("city_idx > 2").select("bs_id", "pathloss_db", "dist_m")
    both = tables.union_measurements(a, b)
    return both.groupBy("bs_id").agg(F.count("*").alias("n"), F.count("city_idx").alias("n_indexed"), r(F.sum("pathloss_db"), 3, "total"))


# ---- polygons ----

NOTCH = "array(named_struct('x', cx - width_m / 2, 'y', cy - depth_m / 2), named_struct('x', cx + width_m / 2, 'y', cy - depth_m / 2), named_struct('x', cx + width_m / 2, 'y', cy + depth_m / 2), named_struct('x', cx, 'y', cy + depth_m / 6), named_struct('x', cx - width_m / 2, 'y', cy + depth_m / 2))"


def _polygons(spark, sf):
    """Structures as concave footprints: boxes with a notch of a sixth of the area."""
    return rows(spark, sf, "fx_structures").withColumn("vertices", F.expr(NOTCH))


@query(f"WITH {cte('fx_structures')} SELECT city, structure_id, round(width_m * depth_m * 5 / 6, 4) AS area_m2, round(cx, 6) AS cx, round(cy - depth_m * 7 / 90, 6) AS cy FROM fx_structures")
def c13_polygon_area(spark, sf):
    return grid.footprints(_polygons(spark, sf)).select("city", "structure_id", r("area_m2"), r("cx", 6), r("cy", 6))


@query(f"WITH {cte('fx_structures')} SELECT city, structure_id, round(width_m * depth_m * 5 / 6, 4) AS area_m2 FROM fx_structures")
def c8_structure_clip(spark, sf):
    """The parts of a footprint in all tiles sum to it; a test compares single parts."""
    parts = grid.clipped_polygons(_polygons(spark, sf), METRIC_TILE)
    return parts.groupBy("city", "structure_id").agg(r(F.sum("area_m2"), 4, "area_m2"))


# Fixed values: (tag, value or any, kind).
RULES = [("building", None, "building"), ("natural", "water", "water"), ("waterway", "riverbank", "water"), ("waterway", "dock", "water"), ("landuse", "reservoir", "water")] + [
    *[("landuse", x, "vegetation") for x in ("grass", "forest", "meadow", "village_green")],
    *[("leisure", x, "vegetation") for x in ("park", "garden")],
    *[("natural", x, "vegetation") for x in ("wood", "scrub")],
]


@query(f"""WITH {cte('fx_structures')}, f AS (SELECT city, structure_id, CASE WHEN structure_id % 7 = 0 THEN 1.0 / 4 ELSE 1 END AS shrink, kind, width_m * depth_m * 5 / 6 AS a FROM fx_structures WHERE structure_id % 11 <> 0),
k AS (SELECT city, kind, a * shrink * shrink AS a FROM f UNION ALL SELECT city, 'vegetation', a * shrink * shrink FROM f WHERE kind = 'building' AND structure_id % 5 = 0)
SELECT city, kind, count(*) AS n, round(sum(a), 4) AS area_m2 FROM k WHERE a >= 40.3 GROUP BY ALL""")
def d1_tag_classes(spark, sf):
    """Structures go out as GeoJSON collections (some as multipolygons, some as points, which are left out), come back by
    the reader, are classed by their tags and lose slivers.  A building in a park has two kinds."""
    s = _polygons(spark, sf).withColumn("shrink", F.when(F.col("structure_id") % 7 == 0, 0.25).otherwise(1.0))
    ring = F.transform("vertices", lambda p: F.array(F.col("cx") + (p["x"] - F.col("cx")) * F.col("shrink"), F.col("cy") + (p["y"] - F.col("cy")) * F.col("shrink")))
    one = F.to_json(F.array(ring))
    shape = F.when(F.col("structure_id") % 11 == 0, F.struct(F.lit("Point").alias("type"), F.lit("[0,0]").alias("coordinates")))
    shape = shape.when(F.col("structure_id") % 3 == 0, F.struct(F.lit("MultiPolygon").alias("type"), F.concat(F.lit("["), one, F.lit("]")).alias("coordinates")))
    shape = shape.otherwise(F.struct(F.lit("Polygon").alias("type"), one.alias("coordinates")))
    tags = F.when(F.col("kind") == "building", F.when(F.col("structure_id") % 5 == 0, F.expr("map('building', 'yes', 'leisure', 'park')")).otherwise(F.expr("map('building', 'house')")))
    tags = tags.when(F.col("kind") == "water", F.expr("map('natural', 'water', 'name', 'x')")).otherwise(F.expr("map('landuse', 'forest', 'natural', 'wood')"))
    text = F.format_string('{"type":"Feature","id":"%s/%s","properties":%s,"geometry":{"type":"%s","coordinates":%s}}', F.col("city"), F.col("structure_id").cast("string"), F.to_json(tags), shape["type"], shape["coordinates"])
    path = scratch_path(spark, "geojson")
    # a collection for each thousand features
    files = s.select("city", F.expr("structure_id div 1000").alias("part"), text.alias("f")).groupBy("city", "part").agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list("f"), ","), F.lit("]}")).alias("value"))
    files.select("value").write.text(path)
    features = tables.read_geojson(spark, path, multi_line=False)
    kinds = structures.classify(features, spark.createDataFrame(RULES, "tag string, value string, kind string"))
    shapes = grid.footprints(features, 40.3).join(kinds, "feature_id")
    return shapes.groupBy(F.split("feature_id", "/")[0].alias("city"), "kind").agg(F.count("*").alias("n"), r(F.sum("area_m2"), 4, "area_m2"))


def _sums(first: str, coefficients: tuple[float, ...], sign: str, f: str, g: str, a: str, b: str) -> str:
    return first + "".join(f" {sign} {c!r} * {f}({2 * j} * {a}) * {g}({2 * j} * {b})" for j, c in enumerate(coefficients, 1))


def utm_sql(rows_: str, lat: str, lon: str, zone: str, names: str) -> str:
    """Rows of a table north of the equator with e and n, by the transverse Mercator series."""
    k = geo.SCALE * geo._A
    return f"""(SELECT {names}, {geo.FALSE_EASTING} + {k!r} * ({_sums("eta", geo._ALPHA, "+", "cos", "sinh", "xi", "eta")}) AS e, {k!r} * ({_sums("xi", geo._ALPHA, "+", "sin", "cosh", "xi", "eta")}) AS n
FROM (SELECT *, atan2(t, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + t * t)) AS eta FROM (SELECT *, sinh(atanh(sn) - {geo._E!r} * atanh({geo._E!r} * sn)) AS t FROM (SELECT *, sin(radians({lat})) AS sn, radians({lon}) - radians({zone} * 6.0 - 183.0) AS dl FROM {rows_}))))"""


def utm_inverse_sql(rows_: str, names: str) -> str:
    """Rows with e, n and zone, north of the equator, with lat and lon in degrees."""
    k = geo.SCALE * geo._A
    lat = "chi" + "".join(f" + {c!r} * sin({2 * j} * chi)" for j, c in enumerate(geo._DELTA, 1))
    return f"""(SELECT {names}, degrees({lat}) AS lat, degrees(radians(zone * 6.0 - 183.0) + atan2(sinh(e2), cos(x2))) AS lon FROM (SELECT *, asin(sin(x2) / cosh(e2)) AS chi
FROM (SELECT *, {_sums("xi", geo._BETA, "-", "sin", "cosh", "xi", "eta")} AS x2, {_sums("eta", geo._BETA, "-", "cos", "sinh", "xi", "eta")} AS e2 FROM (SELECT *, (e - {geo.FALSE_EASTING}) / {k!r} AS eta, n / {k!r} AS xi FROM {rows_}))))"""


ORIGINS = f"WITH {cte('fx_measurements')}, og AS (SELECT DISTINCT city, lat0, lon0, (floor((lon0 + 180) / 6) + 1)::INT AS zone FROM fx_measurements)"


@query(ORIGINS + f""", c0 AS (SELECT city, zone, e AS e0, n AS n0 FROM {utm_sql("og", "lat0", "lon0", "zone", "city, zone")}),
co AS (SELECT city, zone, e0 + x AS e, n0 + y AS n FROM c0, (VALUES (-1600.0), (1600.0)) a(x), (VALUES (-1600.0), (1600.0)) b(y))
SELECT city, round(min(lat), 7) AS south, round(min(lon), 7) AS west, round(max(lat), 7) AS north, round(max(lon), 7) AS east FROM {utm_inverse_sql("co", "city")} GROUP BY city""")
def c12_scene_box(spark, sf):
    m = rows(spark, sf).select("city", "lat0", "lon0").distinct()
    return grid.scene_boxes(m, 3000.0, 100.0).select("city", *[r(c, 7) for c in ("south", "west", "north", "east")])


LOCAL = "city, bs_id, l_orderkey, l_linenumber, l_partkey, e0, n0"


@query(ORIGINS + f""", c0 AS (SELECT city, zone, e AS e0, n AS n0 FROM {utm_sql("og", "lat0", "lon0", "zone", "city, zone")}), me AS (SELECT * FROM fx_measurements JOIN c0 USING (city))
SELECT city, bs_id, l_orderkey, l_linenumber, l_partkey, round(e - e0, 2) AS x, round(n - n0, 2) AS y, 0.0::DOUBLE AS error_deg FROM {utm_sql("me", "rx_lat", "rx_lon", "zone", LOCAL)}""")
def c11_local_frame(spark, sf):
    """Metres east and north of the city's origin for each receiver, and the error of the way back, which is none; a test
    compares published positions."""
    m = rows(spark, sf).select("city", "bs_id", "l_orderkey", "l_linenumber", "l_partkey", "lat0", "lon0", "rx_lat", "rx_lon")
    x, y = geo.local_frame(F.col("rx_lat"), F.col("rx_lon"), F.col("lat0"), F.col("lon0"))
    lat, lon = geo.local_frame_inverse(F.col("x"), F.col("y"), F.col("lat0"), F.col("lon0"))
    back = m.withColumn("x", x).withColumn("y", y).withColumn("error_deg", F.greatest(F.abs(lat - F.col("rx_lat")), F.abs(lon - F.col("rx_lon"))))
    return back.select("city", "bs_id", "l_orderkey", "l_linenumber", "l_partkey", r("x", 2), r("y", 2), r("error_deg", 7))


SIZES = (1000.0, 800.0, 600.0, 500.0, 300.0, 200.0)


@query("SELECT * FROM (" + ") UNION ALL SELECT * FROM (".join(GRID.replace(str(TILE_M), f"{s}::DOUBLE") + f" SELECT {s}::DOUBLE AS tile_size, city, count(DISTINCT (m, z)) AS n_tiles, max(n) AS most FROM (SELECT city, m, z, count(*) AS n FROM pts GROUP BY ALL) GROUP BY city" for s in SIZES) + ")")
def c14_tile_sizes(spark, sf):
    m = rows(spark, sf)
    each = grid.assign_sizes(m, grid.sweep_sizes(grid.region_boxes(m), SIZES)).groupBy("tile_size", "city", "m", "z").agg(F.count("*").alias("n"))
    return each.groupBy("tile_size", "city").agg(F.count("*").alias("n_tiles"), F.max("n").alias("most"))


# ---- descriptor vectors and rasters ----

CELLS_XY = "(SELECT r_name AS city, m, z FROM region CROSS JOIN range(-5, 5) AS a(m) CROSS JOIN range(-5, 5) AS b(z))"
MONTHS = f"""WITH {cte("fx_climate")}, st AS (SELECT m, z, (m + 5) * 0.4 + 0.05 AS lat, (z + 5) * 0.4 + 0.05 AS lon FROM range(-5, 5) AS a(m) CROSS JOIN range(-5, 5) AS b(z)),
cn AS (SELECT m, z, floor(lat)::BIGINT AS i, floor(lon)::BIGINT AS j, lat - floor(lat) AS u, lon - floor(lon) AS v FROM st),
co AS (SELECT m, z, i AS gi, j AS gj, (1 - u) * (1 - v) AS w FROM cn UNION ALL SELECT m, z, i, j + 1, (1 - u) * v FROM cn UNION ALL SELECT m, z, i + 1, j, u * (1 - v) FROM cn UNION ALL SELECT m, z, i + 1, j + 1, u * v FROM cn),
bl AS (SELECT m, z, month, time, sum(w * t2m) AS t2m, sum(w * rh) AS rh, sum(w * tp) AS tp FROM co JOIN fx_climate USING (gi, gj) WHERE w > 0 GROUP BY ALL HAVING sum(w) > 1 - 1e-9),
mo AS (SELECT m, z, month, avg(t2m) - 273.15 AS t2m_mean, stddev_pop(t2m) AS t2m_std, avg(rh) AS rh_mean, stddev_pop(rh) AS rh_std, avg(tp) AS tp_mean, stddev_pop(tp) AS tp_std FROM bl GROUP BY ALL)
SELECT m, z, {", ".join(f"max({n.rsplit('_', 1)[0]}) FILTER (month = {n.rsplit('_', 1)[1]}) AS {n}" for n in descriptors.CLIMATE)} FROM mo GROUP BY m, z"""


def _off(name: str) -> float:
    """Added before rounding: climate values have few decimals, and then never fall on a half."""
    return 3.14159e-7 if name in descriptors.CLIMATE else 0.0


def _digits(name: str) -> int:
    """Digits that a number is told with: means of tenths fall on halves of the third."""
    return 6 if name in (*descriptors.TOPOGRAPHY, *structures.BUILT, *descriptors.CLIMATE) or "share" in name else 3


def vectors(spark, sf):
    """The 116 numbers of every tile of the metric grid."""
    side = F.sequence(F.lit(-5).cast("long"), F.lit(4).cast("long"))
    tiles = spark.read.parquet(f"{sf}/region.parquet").select(F.col("r_name").alias("city"), F.explode(side).alias("m")).withColumn("z", F.explode(side)).withColumn("tile_area", F.lit(1.0))
    built, all_ = grid.cells_touched(_buildings(spark, sf), METRIC_TILE), grid.cells_touched(rows(spark, sf, "fx_structures"), METRIC_TILE)
    dem = rows(spark, sf, "fx_dem").withColumn("m", F.floor(F.col("y") / METRIC_TILE)).withColumn("z", F.floor(F.col("x") / METRIC_TILE))
    places = tiles.select("m", "z").distinct().select(((F.col("m") + 100) * 1000 + F.col("z") + 100).alias("point_id"), ((F.col("m") + 5) * 0.4 + 0.05).alias("lat"), ((F.col("z") + 5) * 0.4 + 0.05).alias("lon"))
    monthly = robustness.climate_features(rows(spark, sf, "fx_climate"), places, descriptors.VARIABLES, kelvin=("t2m",))
    climate = descriptors.by_month(monthly, "point_id").withColumn("m", F.expr("point_id div 1000 - 100")).withColumn("z", F.col("point_id") % 1000 - 100).drop("point_id")
    keys = ("city", "m", "z")
    parts = [(structures.terrain_features(dem, "m", "z").drop("agl_min"), ("m", "z")), (structures.built_features(built, METRIC_TILE**2), keys), (structures.plane_features(built), keys), (structures.cover_features(all_, METRIC_TILE**2), keys), (climate, ("m", "z"))]
    return descriptors.assemble(tiles, parts)


@query(f"""SELECT city, m, z, unnest(range(116)) AS i, unnest([{", ".join(f"round(coalesce({n}, 0)::DOUBLE + {_off(n)}, {_digits(n)})" for n in descriptors.NAMES)}]) AS value
FROM (SELECT *, 1.0::DOUBLE AS tile_area FROM {CELLS_XY}) LEFT JOIN ({ORACLE["d5_terrain_features"]}) USING (m, z) LEFT JOIN ({ORACLE["d6_built_features"]}) USING (city, m, z) LEFT JOIN ({ORACLE["d7_plane_features"]}) USING (city, m, z)
LEFT JOIN ({ORACLE["d8_cover_features"]}) USING (city, m, z) LEFT JOIN ({MONTHS}) USING (m, z)""")
def d10_descriptor_vectors(spark, sf):
    """One row for each tile and number."""
    at = lambda f: F.get(F.array(*[F.lit(f(n)) for n in descriptors.NAMES]), F.col("i"))
    moved = F.col("value") + at(_off)
    value = F.when(at(_digits) == 6, F.round(moved, 6)).otherwise(F.round(moved, 3))
    return vectors(spark, sf).select("city", "m", "z", F.posexplode("v").alias("i", "value")).select("city", "m", "z", F.col("i").cast("long").alias("i"), value.alias("value"))


PX = METRIC_TILE / 128


@query(HEIGHT + f", {cte('fx_dem')}" + """, al AS (SELECT city, structure_id, kind, cx, cy, width_m, depth_m, height FROM h UNION ALL SELECT city, structure_id, kind, cx, cy, width_m, depth_m, 0 FROM fx_structures WHERE kind <> 'building')""" + TOUCH.format("al") + f""",
px AS (SELECT *, unnest(range(greatest(ceil((cx - width_m / 2 - z * 300) / {PX} - 0.5), 0)::BIGINT, least(ceil((cx + width_m / 2 - z * 300) / {PX} - 0.5), 128)::BIGINT)) AS px FROM
  (SELECT *, unnest(range(greatest(ceil((cy - depth_m / 2 - m * 300) / {PX} - 0.5), 0)::BIGINT, least(ceil((cy + depth_m / 2 - m * 300) / {PX} - 0.5), 128)::BIGINT)) AS py FROM t)),
cv AS (SELECT city, m, z, py, px, coalesce(max(height) FILTER (kind = 'building'), 0) AS b, max((kind = 'vegetation')::INT) AS v, max((kind = 'water')::INT) AS w FROM px GROUP BY ALL),
gr AS (SELECT floor(y / 300)::BIGINT AS m, floor(x / 300)::BIGINT AS z, least(floor((y - floor(y / 300) * 300) / {PX}), 127)::BIGINT AS py, least(floor((x - floor(x / 300) * 300) / {PX}), 127)::BIGINT AS px, avg(asl) AS asl FROM fx_dem GROUP BY ALL)
SELECT city, m, z, count(*) AS n, round(sum(b), 3) AS height_sum, sum(v)::BIGINT AS vegetation, sum(w)::BIGINT AS water, sum((py * 128 + px) * (1 + v + 2 * w))::BIGINT AS place_sum, count(asl) AS n_terrain, round(sum(asl), 2) AS asl_sum FROM cv LEFT JOIN gr USING (m, z, py, px) GROUP BY city, m, z""")
def d11_tile_rasters(spark, sf):
    """128 x 128 pixels of each tile, told by counts and sums."""
    other = rows(spark, sf, "fx_structures").where("kind <> 'building'").withColumn("height", F.lit(0.0))
    both = _buildings(spark, sf).select(*other.columns).unionByName(other)
    p = descriptors.rasterised(grid.cells_touched(both, METRIC_TILE), rows(spark, sf, "fx_dem"), METRIC_TILE)
    place = (F.col("py") * 128 + F.col("px")) * (1 + F.col("vegetation") + 2 * F.col("water"))
    return p.groupBy("city", "m", "z").agg(
        F.count("*").alias("n"), r(F.sum("building_height"), 3, "height_sum"), F.sum("vegetation").alias("vegetation"), F.sum("water").alias("water"), F.sum(place).alias("place_sum"), F.count("terrain_asl").alias("n_terrain"), r(F.sum("terrain_asl"), 2, "asl_sum")
    )


#: Pixel centres of the box around each notched footprint that an odd number of its sides lies to the right of.
FILL = HEIGHT + f""", fp AS (SELECT city, structure_id, kind, cx, cy, width_m, depth_m, height FROM h UNION ALL SELECT city, structure_id, kind, cx, cy, width_m, depth_m, 0 FROM fx_structures WHERE kind <> 'building'),
vs AS (SELECT *, [cx - width_m / 2, cx + width_m / 2, cx + width_m / 2, cx, cx - width_m / 2] AS vx, [cy - depth_m / 2, cy - depth_m / 2, cy + depth_m / 2, cy + depth_m / 6, cy + depth_m / 2] AS vy FROM fp),
pr AS (SELECT *, unnest(range(floor((cy - depth_m / 2) / {PX})::BIGINT - 1, ceil((cy + depth_m / 2) / {PX})::BIGINT + 1)) AS pr FROM vs),
pp AS (SELECT *, unnest(range(floor((cx - width_m / 2) / {PX})::BIGINT - 1, ceil((cx + width_m / 2) / {PX})::BIGINT + 1)) AS pc FROM pr),
ps AS (SELECT *, unnest(range(1, 6)) AS i FROM pp), pq AS (SELECT city, structure_id, kind, height, pr, pc, vx[i] AS xa, vy[i] AS ya, vx[i % 5 + 1] AS xb, vy[i % 5 + 1] AS yb FROM ps),
fl AS (SELECT city, structure_id, kind, height, pr, pc FROM pq GROUP BY ALL HAVING count(*) FILTER (least(ya, yb) <= (pr + 0.5) * {PX} AND (pr + 0.5) * {PX} < greatest(ya, yb) AND round((xa + (xb - xa) * ((pr + 0.5) * {PX} - ya) / nullif(yb - ya, 0)) / {PX}, 9) > pc + 0.5) % 2 = 1),
cv AS (SELECT city, floor(pr / 128)::BIGINT AS m, floor(pc / 128)::BIGINT AS z, pr - 128 * floor(pr / 128)::BIGINT AS py, pc - 128 * floor(pc / 128)::BIGINT AS px, coalesce(max(height) FILTER (kind = 'building'), 0) AS b, max((kind = 'vegetation')::INT) AS v, max((kind = 'water')::INT) AS w FROM fl GROUP BY ALL)"""


@query(FILL + " SELECT city, m, z, count(*) AS n, round(sum(b), 3) AS height_sum, sum(v)::BIGINT AS vegetation, sum(w)::BIGINT AS water, sum((py * 128 + px) * (1 + v + 2 * w))::BIGINT AS place_sum FROM cv GROUP BY ALL")
def d11_polygon_rasters(spark, sf):
    """Rasters of concave footprints, told by counts and sums."""
    heights = _buildings(spark, sf).select("city", "structure_id", "height")
    shapes = _polygons(spark, sf).join(heights, ["city", "structure_id"], "left").withColumn("height", F.coalesce("height", F.lit(0.0)))
    p = descriptors.rasterised_polygons(shapes, rows(spark, sf, "fx_dem"), METRIC_TILE)
    place = (F.col("py") * 128 + F.col("px")) * (1 + F.col("vegetation") + 2 * F.col("water"))
    return p.groupBy("city", "m", "z").agg(F.count("*").alias("n"), r(F.sum("building_height"), 3, "height_sum"), F.sum("vegetation").alias("vegetation"), F.sum("water").alias("water"), F.sum(place).alias("place_sum"))


# ---- models on descriptors ----


@query()
def h5_boosted_trees(spark, sf):
    """Rows only here: 600 trees of every fold and target; tests compare both ways of growing them with each other and with
    plain trees."""
    t, sp, shape = rows(spark, sf, "fx_tiles"), _splits(spark, sf), boosting.Shape()
    models, edges = boosting.boosted_models(t, sp, shape)
    return boosting.boosted_predictions(models, edges, tables.stack(t, sp, "test"), shape.depth).select("fold", "tile", "target", r("pred"))


SOURCES = ("train", "val")


ANCHORED = RIDGE.replace("role = 'train'", f"role IN {SOURCES}") + f""",
te AS (SELECT fold, target, tile, v, truth, pred FROM lp WHERE role = 'test'),
g AS (SELECT te.*, k AS shots, draw, row_number() OVER (PARTITION BY fold, target, k, draw ORDER BY md5(concat_ws('|', '0', k::VARCHAR, draw::VARCHAR, tile::VARCHAR)), tile) AS place FROM te, (VALUES {", ".join(f"({k})" for k in splits.KS)}) ks(k), range({splits.DRAWS}) ds(draw)),
an AS (SELECT fold, target, shots, draw, place, v, truth - pred AS e FROM g WHERE place <= shots),
ce AS (SELECT fold, target, shots, draw, list(x ORDER BY i) AS c FROM (SELECT fold, target, shots, draw, i, avg(x) AS x FROM (SELECT fold, target, shots, draw, unnest(v) AS x, unnest(range(64)) AS i FROM an) GROUP BY ALL) GROUP BY ALL),
sh AS (SELECT fold, target, shots, draw, avg(e) AS shift FROM an GROUP BY ALL),
ac AS (SELECT an.*, list_transform(v, lambda x, i: x - c[i]) AS u, e - shift AS y FROM an JOIN ce USING (fold, target, shots, draw) JOIN sh USING (fold, target, shots, draw)),
du AS (SELECT a.fold, a.target, a.shots, a.draw, a.place, a.y, list(list_dot_product(a.u, b.u) + CASE WHEN a.place = b.place THEN 10 ELSE 0 END ORDER BY b.place) AS l FROM ac a JOIN ac b USING (fold, target, shots, draw) GROUP BY ALL),
d0 AS (SELECT fold, target, shots, draw, list(list_append(l, y) ORDER BY place) AS mat FROM du GROUP BY ALL),
{solved("ds", "fold, target, shots, draw", "d0")},
be AS (SELECT fold, target, shots, draw, unnest(list_transform(mat, lambda w: w[len(mat) + 1])) AS beta, unnest(range(1, len(mat) + 1)) AS place FROM ds WHERE k = len(mat) + 1),
ws AS (SELECT fold, target, shots, draw, list(x ORDER BY i) AS w FROM (SELECT fold, target, shots, draw, i, sum(x) AS x FROM (SELECT fold, target, shots, draw, unnest(list_transform(u, lambda x: x * beta)) AS x, unnest(range(64)) AS i FROM ac JOIN be USING (fold, target, shots, draw, place)) GROUP BY ALL) GROUP BY ALL),
ex AS (SELECT g.fold, g.target, shots, draw, truth - pred AS e, shift, list_dot_product(v, w) - list_dot_product(c, w) AS more FROM g JOIN sh USING (fold, target, shots, draw) JOIN ce USING (fold, target, shots, draw) JOIN ws USING (fold, target, shots, draw) WHERE place > shots),
rm AS (SELECT fold, target, shots, draw, sqrt(avg(pow(e - shift, 2))) AS bias, sqrt(avg(pow(e - shift - more, 2))) AS residual FROM ex GROUP BY ALL
  UNION ALL SELECT fold, target, 0, 0, sqrt(avg(pow(truth - pred, 2))), sqrt(avg(pow(truth - pred, 2))) FROM te GROUP BY ALL)"""


@query(ANCHORED + " SELECT target, shots::INT AS k, round(avg(bias), 5) AS bias, round(avg(residual), 5) AS residual FROM rm GROUP BY target, shots")
def h7_residual_ridge(spark, sf):
    """Error by k of the shot curve with the anchors' mean and with the anchors' residual ridge on the ridge model's
    predictions, both targets; a test compares the dual with the plain form."""
    t, sp = rows(spark, sf, "fx_tiles"), _splits(spark, sf)
    sums = stage(transfer.fold_products(stage(transfer.city_products(t), "cities"), sp, SOURCES), "folds")
    test = tables.stack(t, sp, "test")
    base = stage(transfer.linear_predictions(transfer.ridge_fits(sums), test), "base")
    scaled = transfer.normalised(test, transfer.fold_scales(sums))
    drawn = splits.anchors(t.select("city", "tile")).withColumnRenamed("city", "fold")
    out = None
    for target in transfer.TARGETS:
        own = base.where(F.col("target") == target).drop("target").join(scaled.select("fold", "tile", "v", F.col(target).alias("truth")), ["fold", "tile"])
        known = drawn.join(own, ["fold", "tile"])
        one = transfer.shot_table({"bias": transfer.bias_corrected(known), "residual": transfer.residual_corrected(known)}, own).withColumn("target", F.lit(target))
        out = one if out is None else out.unionByName(one)
    return out.select("target", "k", r("bias", 5), r("residual", 5))


SECOND = RIDGE + f""",
lz AS (SELECT fold, target, tile, ln(greatest(pow(truth - pred, 2), {transfer.LEAST_SQUARE})) AS z FROM lp WHERE role = 'train'),
r2 AS (SELECT fold, i, [covar_pop(x, z) FILTER (target = 'gamma') * count(*) / 2, covar_pop(x, z) FILTER (target = 'pl0') * count(*) / 2] AS y FROM el JOIN lz USING (fold, tile) GROUP BY ALL),
m2 AS (SELECT fold, list(list_concat(l, y) ORDER BY i) AS mat FROM lf JOIN r2 USING (fold, i) GROUP BY fold),
{solved("s2", "fold", "m2")},
w2 AS (SELECT fold, unnest(['gamma', 'pl0']) AS target, unnest([list_transform(mat, lambda w: w[65]), list_transform(mat, lambda w: w[66])]) AS w FROM s2 WHERE k = 65),
ma AS (SELECT fold, target, avg(z) AS mz FROM lz GROUP BY ALL)"""


@query(SECOND + " SELECT target, fold, tile, round(exp(greatest(least(f, 4), -8) / 2), 5) AS sigma, round(f, 3) AS log_variance FROM (SELECT *, mz + list_dot_product(v, w) - list_dot_product(mv, w) AS f FROM nl JOIN w2 USING (fold) JOIN ma USING (fold, target) JOIN me USING (fold) WHERE role = 'test')")
def h11_second_stage_sigma(spark, sf):
    """The sigma of both targets by a second regression; a test plants a spread that depends on a descriptor."""
    t, sp = rows(spark, sf, "fx_tiles"), _splits(spark, sf)
    fitted, test, out = transfer.ridge_by_fold(t, sp), tables.stack(t, sp, "test"), None
    for target in transfer.TARGETS:
        one = transfer.second_sigma(transfer.log_variance_fits(t, sp, fitted, target), test).withColumn("target", F.lit(target))
        out = one if out is None else out.unionByName(one)
    return out.select("target", "fold", "tile", r("sigma", 5), r("log_variance", 3))


@query()
def l3_domain_classifier(spark, sf):
    """Rows only here: how well tiles of two cities are told from the others by their descriptors, by classifiers that have
    not seen them, and the conformal quantile of each model's errors weighted by the odds; a test plants a shift."""
    side = F.col("city").isin("c0", "c1").cast("int")
    own = rows(spark, sf, "fx_tiles").select("tile", side.alias("side"), F.col("v").cast("array<double>").alias("v"))
    told, auc = transfer.domain_separability(own)
    odds = told.where("side = 0").select("tile", F.col("weight").alias("w"))
    q = metrics.weighted_conformal_quantile(rows(spark, sf, "fx_predictions").join(odds, "tile"), "model", "target")
    return q.select("model", "target", r("q", 5), F.lit(round(auc, 5)).alias("auc"))


def described_tiles(spark, sf):
    """Tiles of the metric grid with their 116 numbers and the shrunk fit of their measurements: from raw rows."""
    m, z = (F.floor(F.col(c) / METRIC_TILE) for c in ("rx_y", "rx_x"))
    d = geo.haversine_m(F.col("tx_lat"), F.col("tx_lon"), F.col("rx_lat"), F.col("rx_lon"))
    points = rows(spark, sf).select("city", m.alias("m"), z.alias("z"), radio.log_distance(d).alias("x"), F.col("pathloss_db").alias("y"))
    moments = fits.tile_moments(points)
    fitted = fits.fit_ridge(moments.select("city", "m", "z"), moments)
    tile = (F.col("m") + 5) * 10 + F.col("z") + 5
    return vectors(spark, sf).join(fitted.select("city", "m", "z", "gamma", "pl0"), ["city", "m", "z"]).where("gamma is not null").select("city", tile.alias("tile"), "v", "gamma", "pl0")


@query()
def h_fold_scores(spark, sf):
    """The whole way from measurements, structures, terrain and climate to errors of each model in each fold: descriptors and
    fits of all tiles, folds of cities, then the median, Gaussian transfer at the fold's best width, ridge and boosted
    trees.  Rows only here; a test follows it with numpy from the tiles on."""
    t = stage(described_tiles(spark, sf), "tiles")
    sp = splits.leave_one_city_out(t.select("city").distinct())
    part = {role: tables.stack(t, sp, role) for role in ("train", "val", "test")}
    shape = boosting.Shape(trees=100, step=0.1)
    models, edges = boosting.boosted_models(t, sp, shape)
    scale = transfer.column_max(part["train"])
    near = {role: transfer.normalised(part[role], scale) for role in part}
    widths = transfer.select_sigma(near["val"], near["train"])
    unpivot = lambda df: df.unpivot(["fold", "tile"], ["gamma_pred", "pl0_pred"], "target", "pred").withColumn("target", F.regexp_replace("target", "_pred", ""))
    preds = {
        "median": unpivot(part["test"].select("fold", "tile").join(transfer.median_predictor(part["train"]), "fold")),
        "gaussian": unpivot(transfer.gaussian_predict_at(near["test"], near["train"], widths)),
        "ridge": transfer.linear_predictions(transfer.ridge_by_fold(t, sp), part["test"]),
        "trees": boosting.boosted_predictions(models, edges, part["test"], shape.depth),
    }
    truth = part["test"].unpivot(["fold", "tile"], ["gamma", "pl0"], "target", "truth")
    out = None
    for name, p in preds.items():
        one = metrics.errors(p.join(truth, ["fold", "tile", "target"]).withColumn("model", F.lit(name))).select("model", "fold", "target", "n", r("rmse", 4), r("mae", 4))
        out = one if out is None else out.unionByName(one)
    return out


@query(recursive(COVER + ", er AS (SELECT ed.* FROM ed JOIN fx_points USING (point_id) WHERE py > 0)" + greedy_sql("need", "er") + " SELECT * FROM g_need"))
def k3_set_cover(spark, sf):
    """Sites until all points of the northern half that can be covered are."""
    points = rows(spark, sf, "fx_points")
    required = points.join(points.where("py > 0").select("point_id"), "point_id", "left_semi")
    return siting.greedy_cover(siting.disc_places(rows(spark, sf, "fx_sites"), required, RADIUS_M)).select("step", "candidate_id", "gain")
