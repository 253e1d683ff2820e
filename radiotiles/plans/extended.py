"""More named queries: rays, climate, robustness, frames and placement comparison.  Importing this module
adds them to `radiotiles.plans.queries`."""

from __future__ import annotations

from pyspark.sql import functions as F

from radiotiles.operators import descriptors, folds, grid, paths, robustness, siting, structures, transfer
from radiotiles.plans.queries import GRID, HEIGHT, ORACLE, POWER, THRESHOLD_DBM, TILE_M, TOUCH, _scores, _splits, greedy_sql, power_sites, query, r, rows, solved
from radiotiles.sources import tables
from radiotiles.sources.fixtures import cte
from radiotiles.sources.scratch import stage

CELL = 300.0
LEVELS = (0.0, 0.1, 0.2, 0.4)

RAYS = f"""WITH {cte("fx_measurements")},
cut AS (SELECT *, list_sort(list_concat([0.0::DOUBLE, 1.0::DOUBLE], list_concat(
  list_transform(range(floor(least(tx_x, rx_x) / 300)::BIGINT + 1, ceil(greatest(tx_x, rx_x) / 300)::BIGINT), lambda k: (k * 300.0::DOUBLE - tx_x) / (rx_x - tx_x)),
  list_transform(range(floor(least(tx_y, rx_y) / 300)::BIGINT + 1, ceil(greatest(tx_y, rx_y) / 300)::BIGINT), lambda k: (k * 300.0::DOUBLE - tx_y) / (rx_y - tx_y))))) AS ts,
  sqrt((rx_x - tx_x) * (rx_x - tx_x) + (rx_y - tx_y) * (rx_y - tx_y)) AS len FROM fx_measurements),
pc AS (SELECT *, ts[i] AS a, ts[i + 1] AS b FROM (SELECT *, unnest(range(1, len(ts))) AS i FROM cut)),
sg AS (SELECT city, floor((tx_y + (rx_y - tx_y) * (a + b) / 2) / 300)::BIGINT AS m, floor((tx_x + (rx_x - tx_x) * (a + b) / 2) / 300)::BIGINT AS z, (b - a) * len AS len_m FROM pc WHERE (b - a) * len > 1e-6)"""


@query(RAYS + " SELECT city, m, z, count(*) AS n, round(sum(len_m), 2) AS len_m FROM sg GROUP BY ALL")
def c10_ray_split(spark, sf):
    pieces = paths.ray_split(rows(spark, sf), CELL)
    return pieces.groupBy("city", "m", "z").agg(F.count("*").alias("n"), r(F.sum("len_m"), 2, "len_m"))


TILE_RAYS = GRID + """,
gp AS (SELECT f.*, (radians(tx_lon) - p.lon0) / dlam + 0.5 AS a, (radians(tx_lat) - p.lat0) / dphi + 0.5 AS b, (radians(rx_lon) - p.lon0) / dlam + 0.5 AS c, (radians(rx_lat) - p.lat0) / dphi + 0.5 AS d FROM fx_measurements f JOIN par2 p USING (city)),
cu AS (SELECT *, list_sort(list_concat([0.0::DOUBLE, 1.0::DOUBLE], list_concat(
  list_transform(range(floor(least(a, c))::BIGINT + 1, ceil(greatest(a, c))::BIGINT), lambda k: (k - a) / (c - a)), list_transform(range(floor(least(b, d))::BIGINT + 1, ceil(greatest(b, d))::BIGINT), lambda k: (k - b) / (d - b))))) AS ts FROM gp),
pc AS (SELECT *, ts[i] AS s, ts[i + 1] AS t FROM (SELECT *, unnest(range(1, len(ts))) AS i FROM cu)),
pe AS (SELECT city, floor(round(b + (d - b) * (s + t) / 2, 9))::BIGINT AS m, floor(round(a + (c - a) * (s + t) / 2, 9))::BIGINT AS z, tx_lat + (rx_lat - tx_lat) * s AS la, tx_lon + (rx_lon - tx_lon) * s AS lo, tx_lat + (rx_lat - tx_lat) * t AS lb, tx_lon + (rx_lon - tx_lon) * t AS lp FROM pc),
ln AS (SELECT city, m, z, 111000.0 * sqrt(pow(lb - la, 2) + pow(lp - lo, 2)) AS flat_m, 2 * 6371000.0 * asin(sqrt(pow(sin((radians(lb) - radians(la)) / 2), 2) + cos(radians(la)) * cos(radians(lb)) * pow(sin((radians(lp) - radians(lo)) / 2), 2))) AS arc_m FROM pe)"""


@query(TILE_RAYS + " SELECT mode, city, m, z, count(*) AS n, round(sum(len_m), 1) AS len_m FROM (SELECT 'haversine' AS mode, city, m, z, arc_m AS len_m FROM ln UNION ALL SELECT 'deg111', city, m, z, flat_m FROM ln) WHERE len_m > 1e-6 GROUP BY ALL")
def c10_ray_tiles(spark, sf):
    """Rays cut at the borders of the spherical tiles, by both measures of length."""
    m = rows(spark, sf)
    par = grid.grid_parameters(grid.region_boxes(m), TILE_M)
    return paths.lengths_by_tile(m, par).select("mode", "city", "m", "z", "n", r("len_m", 1))


MIXED = TILE_RAYS.replace("WITH", "WITH RECURSIVE", 1).replace("pe AS (SELECT city,", "pe AS (SELECT city, concat_ws('-', l_orderkey, l_linenumber, l_partkey, bs_id) AS ray, pathloss_db,").replace("ln AS (SELECT city,", "ln AS (SELECT city, ray, pathloss_db,") + f""",
pt AS (SELECT city, ray, m, z, sum(arc_m) AS len_m, first(pathloss_db) AS y FROM ln WHERE arc_m > 1e-6 GROUP BY ALL),
tm AS (SELECT city, ray, m, z, y, unnest([0, 1]) AS o, unnest([10 * log10(greatest(len_m, 1)), len_m / greatest(sum(len_m) OVER (PARTITION BY city, ray), 1)]) AS a FROM pt),
id AS (SELECT city, m, z, o, row_number() OVER (PARTITION BY city ORDER BY m, z, o) AS i, sum(a * y) AS b, count(*) AS n FROM tm GROUP BY city, m, z, o),
tn AS (SELECT city, ray, i, a FROM tm JOIN id USING (city, m, z, o)),
gr AS (SELECT p.city, p.i, q.i AS j, sum(p.a * q.a) AS g FROM tn p JOIN tn q USING (city, ray) GROUP BY ALL),
al AS (SELECT p.city, p.i, p.b, list(coalesce(g, 0) + CASE WHEN p.i = q.i THEN 1e-6 ELSE 0 END ORDER BY q.i) AS l FROM id p JOIN id q USING (city) LEFT JOIN gr ON gr.city = p.city AND gr.i = p.i AND gr.j = q.i GROUP BY ALL),
e0 AS (SELECT city, list(list_append(l, b) ORDER BY i) AS mat FROM al GROUP BY city),
{solved("es", "city", "e0")},
ea AS (SELECT city, unnest(list_transform(mat, lambda w: w[len(mat) + 1])) AS x, unnest(range(1, len(mat) + 1)) AS i FROM es WHERE k = len(mat) + 1)"""


@query(MIXED + " SELECT city, m, z, max(n) AS n, round(max(x) FILTER (o = 0), 3) AS gamma, round(max(x) FILTER (o = 1), 2) AS pl0 FROM ea JOIN id USING (city, i) GROUP BY city, m, z")
def e5_mixed_path(spark, sf):
    """The joint fit on the tiles of the fits by tile; a test plants the parameters of two tiles and finds them."""
    m = rows(spark, sf)
    par = grid.grid_parameters(grid.region_boxes(m), TILE_M)
    fitted = paths.tile_path_fit(m, par, ("l_orderkey", "l_linenumber", "l_partkey", "bs_id"))
    return fitted.select("city", "m", "z", "n", r("gamma", 3), r("pl0", 2))


CLIMATE = f"""WITH {cte("fx_climate", "fx_stations")},
cn AS (SELECT point_id, lat, lon, floor(lat)::BIGINT AS i, floor(lon)::BIGINT AS j, lat - floor(lat) AS u, lon - floor(lon) AS v FROM fx_stations),
co AS (SELECT point_id, i AS gi, j AS gj, (1 - u) * (1 - v) AS w FROM cn UNION ALL SELECT point_id, i, j + 1, (1 - u) * v FROM cn UNION ALL SELECT point_id, i + 1, j, u * (1 - v) FROM cn UNION ALL SELECT point_id, i + 1, j + 1, u * v FROM cn),
bl AS (SELECT point_id, month, time, sum(w * t2m) AS t2m, sum(w * rh) AS rh FROM co JOIN fx_climate USING (gi, gj) WHERE w > 0 GROUP BY ALL HAVING sum(w) > 1 - 1e-9)"""


@query(CLIMATE + " SELECT point_id, month, round(avg(t2m) - 273.15, 3) AS t2m_mean, round(stddev_pop(t2m), 3) AS t2m_std, round(avg(rh), 4) AS rh_mean, round(stddev_pop(rh), 4) AS rh_std FROM bl GROUP BY point_id, month")
def d9_climate_features(spark, sf):
    f = robustness.climate_features(rows(spark, sf, "fx_climate"), rows(spark, sf, "fx_stations"), ("t2m", "rh"), kelvin=("t2m",))
    return f.select("point_id", "month", r("t2m_mean", 3), r("t2m_std", 3), r("rh_mean"), r("rh_std"))


NOISE = f"""WITH {cte("fx_tiles")}, lv AS (SELECT unnest([{", ".join(f"{x}::DOUBLE" for x in LEVELS)}]) AS level),
ex AS (SELECT tile, level, i, x, md5(concat_ws('|', '0', tile::VARCHAR, i::VARCHAR, round(level * 1000)::INT::VARCHAR)) AS h FROM (SELECT tile, unnest(v)::DOUBLE AS x, unnest(range(64)) AS i FROM fx_tiles) CROSS JOIN lv),
no AS (SELECT *, x + level * sqrt(-2 * ln((('0x' || substr(h, 1, 8))::BIGINT + 1) / 4294967297.0::DOUBLE)) * cos(2 * 3.141592653589793::DOUBLE * (('0x' || substr(h, 9, 8))::BIGINT / 4294967296.0::DOUBLE)) AS y FROM ex)"""


@query(NOISE + " SELECT tile, level, round(sum(y), 3) AS total, round(sqrt(sum((y - x) * (y - x)) / 64), 4) AS rms FROM no GROUP BY tile, level")
def d15_descriptor_noise(spark, sf):
    clean = rows(spark, sf, "fx_tiles").select("tile", F.col("v").cast("array<double>").alias("v"), F.col("v").cast("array<double>").alias("x"))
    total = F.aggregate("v", F.lit(0.0), lambda a, y: a + y)
    square = F.aggregate(F.zip_with("v", "x", lambda y, x: (y - x) * (y - x)), F.lit(0.0), lambda a, y: a + y)
    return robustness.noisy(clean, LEVELS).select("tile", "level", r(total, 3, "total"), r(F.sqrt(square / 64), 4, "rms"))


_GROUPS = ", ".join(f"('{n}', {a}, {b})" for n, (a, b) in {"none": (-1, -1), **descriptors.GROUPS}.items())


@query(NOISE + f" SELECT without, level, count(DISTINCT tile) AS n, round(sum(CASE WHEN i BETWEEN a AND b THEN 0 ELSE y END), 2) AS total FROM no, (VALUES {_GROUPS}) g(without, a, b) GROUP BY without, level")
def d14_robustness_sweep(spark, sf):
    """Every group of descriptors left out at every level of noise."""
    tiles = rows(spark, sf, "fx_tiles").select("tile", F.col("v").cast("array<double>").alias("v"))
    total = F.sum(F.aggregate("v", F.lit(0.0), lambda a, y: a + y))
    return robustness.swept(tiles, descriptors.GROUPS, LEVELS).groupBy("without", "level").agg(F.countDistinct("tile").alias("n"), r(total, 2, "total"))


@query()
def d14_robustness_errors(spark, sf):
    """Rows only here: errors of the ridge fits of all folds on test tiles of each kind of the sweep; a test finds that
    more noise and a group left out make them larger."""
    t, sp = rows(spark, sf, "fx_tiles"), _splits(spark, sf)
    fits = transfer.ridge_by_fold(t, sp)
    test = tables.stack(t, sp, "test").withColumn("v", F.col("v").cast("array<double>"))
    kinds = robustness.swept(test.select("fold", "tile", "v", *transfer.TARGETS), descriptors.GROUPS, LEVELS)
    told = kinds.join(fits.select("fold", "target", "b", "w"), "fold")
    e = F.col("b") + transfer.dot("v", "w") - F.when(F.col("target") == "gamma", F.col("gamma")).otherwise(F.col("pl0"))
    return told.groupBy("target", "without", "level").agg(F.count("*").alias("n"), r(F.sqrt(F.avg(e * e)), 5, "rmse"))


DRIFT = f"""WITH {cte("fx_structures")}, od AS (SELECT f.* FROM fx_structures f JOIN orders ON o_orderkey = structure_id WHERE o_orderdate < TIMESTAMP '1998-01-01')""" + TOUCH.format("fx_structures") + TOUCH.format("od").replace(", c AS", ", c2 AS").replace("t AS", "t2 AS").replace("FROM c\n", "FROM c2\n") + """,
nw AS (SELECT city, m, z, count_if(kind = 'water')::DOUBLE AS w, count_if(kind = 'vegetation')::DOUBLE AS v FROM t GROUP BY ALL), ol AS (SELECT city, m, z, count_if(kind = 'water')::DOUBLE AS w, count_if(kind = 'vegetation')::DOUBLE AS v FROM t2 GROUP BY ALL)"""


@query(DRIFT + " SELECT city, m, z, ol.w IS NOT NULL AS in_old, nw.w IS NOT NULL AS in_new, coalesce(nw.w, 0) - coalesce(ol.w, 0) AS water_count_delta, coalesce(nw.v, 0) - coalesce(ol.v, 0) AS veg_count_delta FROM ol FULL JOIN nw USING (city, m, z)")
def d16_snapshot_drift(spark, sf):
    """The geometry of today against that of orders before 1998."""
    now = rows(spark, sf, "fx_structures")
    dated = spark.read.parquet(f"{sf}/orders.parquet").where("o_orderdate < timestamp'1998-01-01'").select(F.col("o_orderkey").alias("structure_id"))
    made = [structures.cover_features(grid.cells_touched(s, CELL), CELL**2) for s in (now.join(dated, "structure_id"), now)]
    return robustness.drift(*made, ("city", "m", "z"), ("water_count", "veg_count"))


@query(POWER + greedy_sql("nominal", "en") + greedy_sql("averse", "ea") + " SELECT method, step, candidate_id, sum(gain) OVER (PARTITION BY method ORDER BY step)::BIGINT AS covered FROM (SELECT 'nominal' AS method, * FROM g_nominal UNION ALL SELECT 'averse', * FROM g_averse)")
def k6_placement_comparison(spark, sf):
    """Greedy sites by expected power and by its conformal lower bound, until none gains."""
    sites, points = stage(power_sites(spark, sf), "sites"), rows(spark, sf, "fx_points")
    methods = {"nominal": sites.withColumn("margin_db", F.lit(0.0)), "averse": sites}
    return siting.compare({m: siting.greedy_cover(siting.power_places(own, points, THRESHOLD_DBM)) for m, own in methods.items()})


@query()
def k6_median_comparison(spark, sf):
    """Rows only here, as medians of what is left are no SQL: the greedy sites by the lower bound against median-seeking
    placement by the same; a test follows the placement by hand."""
    sites, points = stage(power_sites(spark, sf), "sites"), rows(spark, sf, "fx_points")
    placed = siting.median_placement(sites, points, threshold_dbm=THRESHOLD_DBM, station={"p_tx_dbm": 35.0, "gamma": 2.5, "pl0": 42.0, "margin_db": 2.0})
    return siting.compare({"averse": siting.greedy_cover(siting.power_places(sites, points, THRESHOLD_DBM)), "median": placed})


_OFF = "sqrt(pow({0}.x - {1}, 2) + pow({0}.y - {2}, 2))"
#: Each step carries the points that are left and the sites that are used, as lists.
MEDIANS = f"""WITH RECURSIVE {cte("fx_sites", "fx_points")}, si AS (SELECT list({{id: candidate_id, x: sx, y: sy}} ORDER BY candidate_id) AS sites FROM fx_sites),
rr AS (SELECT -1 AS step, NULL::BIGINT AS candidate_id, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0::BIGINT AS gain, list({{id: point_id, x: px, y: py}} ORDER BY point_id) AS open, []::BIGINT[] AS used FROM fx_points
UNION ALL SELECT step + 1, id, ax, ay, len(open) - len(after), after, CASE WHEN id IS NULL THEN used ELSE list_append(used, id) END FROM (
  SELECT *, list_filter(open, lambda p: {_OFF.format("p", "ax", "ay")} >= 400) AS after FROM (
    SELECT *, best.id AS id, coalesce(best.x, mx) AS ax, coalesce(best.y, my) AS ay FROM (
      SELECT *, list_sort(list_transform(list_filter(sites, lambda s: NOT list_contains(used, s.id) AND {_OFF.format("s", "star.x", "star.y")} < 400), lambda s: {{d: {_OFF.format("s", "star.x", "star.y")}, id: s.id, x: s.x, y: s.y}}))[1] AS best FROM (
        SELECT *, list_sort(list_transform(open, lambda p: {{d: {_OFF.format("p", "mx", "my")}, id: p.id, x: p.x, y: p.y}}))[1] AS star FROM (
          SELECT step, used, open, list_aggregate(list_transform(open, lambda p: p.x), 'median') AS mx, list_aggregate(list_transform(open, lambda p: p.y), 'median') AS my FROM rr WHERE len(open) > 0 AND NOT (step >= 0 AND candidate_id IS NULL AND gain = 0))), si))))"""


@query(MEDIANS + " SELECT step, candidate_id, round(x, 6) AS x, round(y, 6) AS y, gain, len(open) AS uncovered FROM rr WHERE step >= 0")
def k4_median_placement(spark, sf):
    points = rows(spark, sf, "fx_points")
    return siting.with_uncovered(siting.median_placement(rows(spark, sf, "fx_sites"), points, 400.0), points).select("step", "candidate_id", r("x", 6), r("y", 6), "gain", "uncovered")


@query(f"""WITH j AS (SELECT * FROM ({ORACLE['j1_bootstrap']}) JOIN ({ORACLE['j2_paired_t']}) USING (model) LEFT JOIN (SELECT model, wilcoxon, p_w FROM ({ORACLE['j3_wilcoxon']})) USING (model)),
k AS (SELECT *, split_part(model, '/', 2) AS target, row_number() OVER (PARTITION BY split_part(model, '/', 2) ORDER BY p_t, model) - 1 AS i, count(*) OVER (PARTITION BY split_part(model, '/', 2)) AS mm FROM j)
SELECT split_part(model, '/', 1) AS model, target, 'a' AS reference, diff_mean, ci_lo, ci_hi, significant, n_folds, t, p_t, cohens_dz_folds, wilcoxon, p_w, min((p_t <= 0.05 / (mm - i))::INT) OVER (PARTITION BY target ORDER BY i) = 1 AS rejected FROM k""")
def j7_model_report(spark, sf):
    """Each target by itself."""
    scores, out = _scores(spark, sf), None
    for target in ("gamma", "pl0"):
        one = folds.model_report(scores.where(F.col("target") == target)).withColumn("target", F.lit(target))
        out = one if out is None else out.unionByName(one)
    return out.select("model", "target", "reference", r("diff_mean", 5), r("ci_lo", 5), r("ci_hi", 5), "significant", "n_folds", r("t"), r("p_t", 6), r("cohens_dz_folds"), "wilcoxon", r("p_w", 6), "rejected")


#: Roofs are taken one by one in their order, with those taken before as a list.
ROOFS = HEIGHT.replace("WITH ", "WITH RECURSIVE ", 1) + """, rc AS (SELECT city, min({low: -height, id: structure_id, x: cx, y: cy}) AS p FROM h WHERE height > 6 GROUP BY city, floor(cx / 25), floor(cy / 25)),
ro AS (SELECT city, p, row_number() OVER (PARTITION BY city ORDER BY p.low, p.id) AS i FROM rc),
tk AS (SELECT city, 0::BIGINT AS i, false AS ok, []::STRUCT(x DOUBLE, y DOUBLE)[] AS taken FROM (SELECT DISTINCT city FROM ro)
  UNION ALL SELECT city, i, ok, CASE WHEN ok THEN list_append(taken, {x: p.x, y: p.y}) ELSE taken END FROM (SELECT ro.city, ro.i, p, taken, len(list_filter(taken, lambda q: sqrt(pow(q.x - p.x, 2) + pow(q.y - p.y, 2)) < 250)) = 0 AS ok FROM tk JOIN ro ON ro.city = tk.city AND ro.i = tk.i + 1)),
ap AS (SELECT city, p, row_number() OVER (PARTITION BY city ORDER BY i) AS k FROM tk JOIN ro USING (city, i) WHERE ok),
fi AS (SELECT * FROM ap WHERE k <= 20), nn AS (SELECT city, count(*) AS n FROM fi GROUP BY city),
mo AS (SELECT city, p, n + row_number() OVER (PARTITION BY city ORDER BY md5(concat_ws('|', '0', p.id::VARCHAR)), p.low, p.id) AS k FROM ro JOIN nn USING (city) WHERE p.id NOT IN (SELECT p.id FROM fi))
SELECT city, (k - 1)::INT AS rank, p.id AS structure_id, round(p.x, 2) AS cx, round(p.y, 2) AS cy, round(3 - p.low, 3) AS z FROM (SELECT * FROM fi UNION ALL SELECT city, p, k FROM mo WHERE k <= 20)"""


@query(ROOFS)
def k5_rooftop_sites(spark, sf):
    buildings = structures.with_heights(rows(spark, sf, "fx_structures").where("kind = 'building'"))
    return siting.rooftop_sites(buildings, 20, 3.0).select("city", "rank", "structure_id", r("cx", 2), r("cy", 2), r("z", 3))
