"""Named queries: each operator over whole tables, with its SQL for DuckDB where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from radiotiles.functions import radio
from radiotiles.functions.geo import haversine_m
from radiotiles.operators import descriptors, fits, folds, grid, measure, metrics, siting, splits, structures, transfer
from radiotiles.sources import tables
from radiotiles.sources.fixtures import cte, fixture

TILE_M, METRIC_TILE = 300.0, 300.0
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def r(c: str | Column, digits: int = 4, name: str | None = None) -> Column:
    out = F.round(F.col(c) if isinstance(c, str) else c, digits)
    return out.alias(name or c) if name or isinstance(c, str) else out


def rows(spark, sf, name="fx_measurements"):
    return fixture(spark, sf, name)


def placed(spark, sf):
    """Measurements with tile and x, and the grid's parameters."""
    m = rows(spark, sf)
    par = grid.grid_parameters(grid.region_boxes(m), TILE_M)
    d = haversine_m(F.col("tx_lat"), F.col("tx_lon"), F.col("rx_lat"), F.col("rx_lon"))
    return grid.assign_tiles(m, par).withColumn("x", radio.log_distance(d)).withColumn("y", F.col("pathloss_db")), par


GRID = f"""WITH {cte("fx_measurements")},
box AS (SELECT city, min(rx_lat) - 0.002 AS lat_lo, max(rx_lat) + 0.002 AS lat_hi, min(rx_lon) - 0.002 AS lon_lo, max(rx_lon) + 0.002 AS lon_hi FROM fx_measurements GROUP BY city),
corner AS (SELECT city, radians(unnest([lat_lo, lat_lo, lat_hi, lat_hi])) AS a, radians(unnest([lon_lo, lon_hi, lon_lo, lon_hi])) AS b FROM box),
cen AS (SELECT city, atan2(avg(sin(a)), sqrt(pow(avg(cos(a) * cos(b)), 2) + pow(avg(cos(a) * sin(b)), 2))) AS lat0, atan2(avg(cos(a) * sin(b)), avg(cos(a) * cos(b))) AS lon0 FROM corner GROUP BY city),
par AS (SELECT box.*, lat0, lon0, {TILE_M} / 6371000.0 AS dphi, {TILE_M} / (6371000.0 * abs(cos(lat0))) AS dlam FROM box JOIN cen USING (city)),
par2 AS (SELECT *, ceil(round((radians(lat_lo) - lat0) / dphi, 9) - 0.5)::BIGINT AS m_lo, floor(round((radians(lat_hi) - lat0) / dphi, 9) + 0.5)::BIGINT AS m_hi,
  ceil(round((radians(lon_lo) - lon0) / dlam, 9) - 0.5)::BIGINT AS z_lo, floor(round((radians(lon_hi) - lon0) / dlam, 9) + 0.5)::BIGINT AS z_hi FROM par),
tiles AS (SELECT city, m, z, (m - m_lo) * (z_hi - z_lo + 1) + z - z_lo AS tile_index, lat0, lon0, dphi, dlam FROM (SELECT *, unnest(range(z_lo, z_hi + 1)) AS z FROM (SELECT *, unnest(range(m_lo, m_hi + 1)) AS m FROM par2))),
pts AS (SELECT f.city, bs_id, pathloss_db AS y, floor(round((radians(rx_lat) - p.lat0) / dphi, 9) + 0.5)::BIGINT AS m, floor(round((radians(rx_lon) - p.lon0) / dlam, 9) + 0.5)::BIGINT AS z,
  10 * log10(greatest(2 * 6371000.0 * asin(sqrt(pow(sin((radians(rx_lat) - radians(tx_lat)) / 2), 2) + cos(radians(tx_lat)) * cos(radians(rx_lat)) * pow(sin((radians(rx_lon) - radians(tx_lon)) / 2), 2))), 1.0)) AS x
  FROM fx_measurements f JOIN par2 p USING (city))"""
STATS = "count(*)::DOUBLE AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) * count(*) AS cxx, covar_pop(x, y) * count(*) AS cxy, var_pop(y) * count(*) AS cyy"
PRIOR = f""",
prior AS (SELECT city, cxy / cxx AS g0, my - cxy / cxx * mx AS p0, 50.0::DOUBLE AS lam FROM (SELECT city, {STATS} FROM pts GROUP BY city))"""


def ridge_sql(name: str, keys: str, least: int) -> str:
    """CTE of shrunk fits by keys, of groups with at least so many rows."""
    return f""",
{name} AS (SELECT *, sqrt({fits.SSE} / n) AS fit_rmse_db, lam / (lam + n * greatest(cxx / n, 1e-9)) AS shrinkage,
  sqrt(greatest({fits.SSE} / greatest(n - 2, 1) * {fits.VAR_GAMMA}, 0)) AS gamma_se, sqrt(greatest({fits.SSE} / greatest(n - 2, 1) * {fits.VAR_PL0}, 0)) AS pl0_se
  FROM (SELECT *, {fits.RIDGE_GAMMA} AS gamma, {fits.RIDGE_PL0} AS pl0 FROM (SELECT {keys}, {STATS} FROM pts_{name} GROUP BY {keys} HAVING count(*) >= {least}) JOIN prior USING (city)))"""


RIDGE = GRID + PRIOR + ", pts_rf AS (SELECT * FROM pts)" + ridge_sql("rf", "city, m, z", 100)


@query(RIDGE + """
SELECT t.city, t.m, t.z, coalesce(c.n, 0)::BIGINT AS n, round(gamma, 4) AS gamma, round(pl0, 3) AS pl0, round(fit_rmse_db, 4) AS fit_rmse_db, round(shrinkage, 4) AS shrinkage
FROM tiles t LEFT JOIN (SELECT city, m, z, count(*) AS n FROM pts GROUP BY ALL) c USING (city, m, z) LEFT JOIN rf USING (city, m, z)""")
def e4_ridge_tiles(spark, sf):
    pts, par = placed(spark, sf)
    out = fits.fit_ridge(grid.grid_tiles(par), fits.tile_moments(pts), min_count=100)
    return out.select("city", "m", "z", "n", r("gamma"), r("pl0", 3), r("fit_rmse_db"), r("shrinkage"))


@query(GRID + """
SELECT t.city, t.m, t.z, coalesce(n, 0)::BIGINT AS n, round(cxy / cxx, 4) AS gamma, round(my - cxy / cxx * mx, 3) AS pl0
FROM tiles t LEFT JOIN (SELECT city, m, z, """ + STATS + """ FROM pts GROUP BY ALL HAVING count(*) >= 10) USING (city, m, z)""")
def e3_local_tiles(spark, sf):
    pts, par = placed(spark, sf)
    out = fits.fit_local(grid.grid_tiles(par), fits.tile_moments(pts), 10)
    return out.select("city", "m", "z", F.when(F.col("gamma").isNull(), 0).otherwise(F.col("n")).cast("long").alias("n"), r("gamma"), r("pl0", 3))


@query(GRID + PRIOR + " SELECT city, round(g0, 4) AS gamma, round(p0, 3) AS pl0 FROM prior")
def e1_global_fit(spark, sf):
    return fits.fit_global(fits.tile_moments(placed(spark, sf)[0])).select("city", r("gamma"), r("pl0", 3))


@query(GRID + PRIOR + " SELECT city, count(*) AS n, round(avg(p0 + g0 * x), 3) AS mean_pred, round(sqrt(avg(pow(p0 + g0 * x - y, 2))), 3) AS rmse FROM pts JOIN prior USING (city) GROUP BY city")
def e2_predict(spark, sf):
    pts, _ = placed(spark, sf)
    prior = fits.priors_of(fits.tile_moments(pts))
    d = haversine_m(F.col("tx_lat"), F.col("tx_lon"), F.col("rx_lat"), F.col("rx_lon"))
    p = pts.join(F.broadcast(prior), "city").withColumn("p", radio.predict_db(d, F.col("g0"), F.col("p0")))  # a row for each city
    return p.groupBy("city").agg(F.count("*").alias("n"), r(F.avg("p"), 3, "mean_pred"), r(F.sqrt(F.avg(F.pow(F.col("p") - F.col("y"), F.lit(2)))), 3, "rmse"))


@query(RIDGE + " SELECT city, count(*) AS n_fitted, round(quantile_cont(gamma, 0.5), 4) AS median_gamma, round(quantile_cont(fit_rmse_db, 0.5), 4) AS median_rmse_db FROM rf GROUP BY city")
def e6_fit_summary(spark, sf):
    pts, par = placed(spark, sf)
    return fits.fit_summary(fits.fit_ridge(grid.grid_tiles(par), fits.tile_moments(pts), 100)).select("city", "n_fitted", r("median_gamma"), r("median_rmse_db"))


@query(RIDGE + " SELECT pts.city, round(avg(pow(pl0 + gamma * x - y, 2)), 4) AS mse_db2 FROM pts JOIN rf USING (city, m, z) GROUP BY pts.city")
def e8_physics_residual(spark, sf):
    pts, par = placed(spark, sf)
    moments = fits.tile_moments(pts)
    return fits.physics_residual(fits.fit_ridge(grid.grid_tiles(par), moments, 100), moments).select("city", r("mse_db2"))


@query(RIDGE + " SELECT city, m, z, round(gamma_se, 5) AS gamma_se, round(pl0_se, 4) AS pl0_se FROM rf")
def f1_standard_errors(spark, sf):
    pts, par = placed(spark, sf)
    return fits.fit_ridge(grid.grid_tiles(par), fits.tile_moments(pts), 100).where("gamma is not null").select("city", "m", "z", r("gamma_se", 5), r("pl0_se"))


HALVES = GRID + PRIOR + """,
st AS (SELECT city, bs_id, row_number() OVER (PARTITION BY city ORDER BY bs) <= floor(count(*) OVER (PARTITION BY city) / 2) AS in_first FROM (SELECT DISTINCT city, bs_id, bs_id::VARCHAR AS bs FROM pts)),
pts_hf AS (SELECT pts.*, in_first FROM pts JOIN st USING (city, bs_id))""" + ridge_sql("hf", "city, m, z, in_first", 20) + """,
df AS (SELECT a.city, a.m, a.z, a.gamma - b.gamma AS gamma_diff, a.pl0 - b.pl0 AS pl0_diff FROM hf a JOIN hf b USING (city, m, z) WHERE a.in_first AND NOT b.in_first)"""


@query(HALVES + " SELECT city, m, z, round(gamma_diff, 4) AS gamma_diff, round(pl0_diff, 3) AS pl0_diff FROM df")
def f2_split_half(spark, sf):
    return fits.split_half(fits.station_moments(placed(spark, sf)[0]), 20).select("city", "m", "z", r("gamma_diff"), r("pl0_diff", 3))


NOISE = HALVES + ", pts_rf AS (SELECT * FROM pts)" + ridge_sql("rf", "city, m, z", 100) + """,
su AS (SELECT * FROM (SELECT city, count(*) AS n_tiles, sqrt(avg(gamma_se * gamma_se)) AS ga, sqrt(avg(pl0_se * pl0_se)) AS pa FROM rf GROUP BY city)
  LEFT JOIN (SELECT city, count(*) AS n_split, stddev_pop(gamma_diff) / sqrt(2) AS gs, stddev_pop(pl0_diff) / sqrt(2) AS ps FROM df GROUP BY city) USING (city))"""


def _noise(spark, sf):
    pts, par = placed(spark, sf)
    moments = fits.station_moments(pts)
    return fits.noise_summary(fits.fit_ridge(grid.grid_tiles(par), moments, 100), fits.split_half(moments, 20))


@query(NOISE + " SELECT city, n_tiles, n_split, round(ga, 5) AS gamma_se_analytic, round(gs, 4) AS gamma_se_split, round(pa, 4) AS pl0_se_analytic, round(ps, 3) AS pl0_se_split FROM su")
def f3_noise_summary(spark, sf):
    return _noise(spark, sf).select("city", "n_tiles", "n_split", r("gamma_se_analytic", 5), r("gamma_se_split"), r("pl0_se_analytic"), r("pl0_se_split", 3))


@query(NOISE + " SELECT round(sqrt(avg(ga * ga)), 5) AS gamma_rms_analytic, round(sqrt(avg(gs * gs)), 4) AS gamma_rms_split FROM su")
def f4_corpus_rms(spark, sf):
    return fits.corpus_rms(_noise(spark, sf)).select(r("gamma_rms_analytic", 5), r("gamma_rms_split"))


@query(GRID + " SELECT city, round(degrees(lat0), 7) AS lat0, round(degrees(lon0), 7) AS lon0, round(dphi * 1e6, 5) AS dphi_u, round(dlam * 1e6, 5) AS dlam_u, m_lo, m_hi, z_lo, z_hi, round(lat_lo, 7) AS lat_lo, round(lon_hi, 7) AS lon_hi FROM par2")
def c3_grid_parameters(spark, sf):
    _, par = placed(spark, sf)
    return par.select("city", r(F.degrees("lat0"), 7, "lat0"), r(F.degrees("lon0"), 7, "lon0"), r(F.col("dphi") * 1e6, 5, "dphi_u"), r(F.col("dlam") * 1e6, 5, "dlam_u"), "m_lo", "m_hi", "z_lo", "z_hi", r("lat_lo", 7), r("lon_hi", 7))


@query(GRID + " SELECT city, m, z, tile_index, round(degrees(lat0 + (m - 0.5) * dphi), 7) AS south, round(degrees(lon0 + (z + 0.5) * dlam), 7) AS east FROM tiles")
def c4_grid_tiles(spark, sf):
    _, par = placed(spark, sf)
    return grid.tile_bounds(grid.grid_tiles(par)).select("city", "m", "z", "tile_index", r("south", 7), r("east", 7))


@query(GRID + " SELECT city, m, z, count(*) AS n FROM pts GROUP BY ALL")
def c7_assign_tiles(spark, sf):
    return placed(spark, sf)[0].groupBy("city", "m", "z").agg(F.count("*").alias("n"))


@query(f"WITH {cte('fx_measurements')} SELECT city, count(*) AS n_measurements, count(DISTINCT bs_id) AS n_bs, round(min(pathloss_db), 4) AS pl_min, round(max(pathloss_db), 4) AS pl_max, 700.0::DOUBLE + 100 * min(bs_id % 9) AS freq_min_mhz, 700.0::DOUBLE + 100 * max(bs_id % 9) AS freq_max_mhz, round(avg(tx_lat), 6) AS origin_lat, round(avg(tx_lon), 6) AS origin_lon FROM fx_measurements GROUP BY city")
def a10_provenance(spark, sf):
    m = rows(spark, sf).withColumn("freq_mhz", 700.0 + 100 * (F.col("bs_id") % 9))
    return tables.provenance(m).select("city", "n_measurements", "n_bs", r("pl_min"), r("pl_max"), "freq_min_mhz", "freq_max_mhz", r("origin_lat", 6), r("origin_lon", 6))


@query(f"WITH {cte('fx_measurements')} SELECT city FROM (SELECT r_name AS city FROM region UNION ALL SELECT n_name FROM nation) WHERE city NOT IN (SELECT city FROM fx_measurements)")
def a1_missing_cities(spark, sf):
    """Of all names of regions and nations, those without a measurement."""
    name = lambda t: spark.read.parquet(f"{sf}/{t}.parquet").select(F.col(f"{t[0]}_name").alias("city"))
    return tables.missing_cities(rows(spark, sf), name("region").unionByName(name("nation")))


@query(f"WITH {cte('fx_tiles')} SELECT tile, city, round(gamma, 4) AS gamma FROM fx_tiles WHERE n_measurements >= 15")
def a2_scan_tiles(spark, sf):
    return tables.scan_tiles(rows(spark, sf, "fx_tiles"), None, 15).select("tile", "city", r("gamma"))


@query(f"WITH {cte('fx_tiles')} SELECT tile, city, round(gamma + 1, 4) AS gamma, n_measurements FROM fx_tiles")
def a8_refresh_columns(spark, sf):
    t = rows(spark, sf, "fx_tiles").select("tile", "city", "gamma", "n_measurements")
    return tables.refreshed(t, t.select("tile", (F.col("gamma") + 1).alias("gamma")), ("tile",)).select("tile", "city", r("gamma"), "n_measurements")


@query(f"""WITH {cte('fx_paths')} SELECT bs_id, count(*) AS n, round(avg(-10 * log10(pow(10, p1 / 10) + coalesce(pow(10, p2 / 10), 0)) + 30), 3) AS mean_pl, count_if(hops = 0) AS n_los FROM fx_paths GROUP BY bs_id""")
def b1_power_sum(spark, sf):
    p = rows(spark, sf, "fx_paths")
    nan = F.coalesce(F.col("p2"), F.lit(float("nan")))
    loss = radio.power_sum_db(F.array("p1", nan)) + 30.0
    return measure.drop_unreached(p.withColumn("pathloss_db", loss)).groupBy("bs_id").agg(F.count("*").alias("n"), r(F.avg("pathloss_db"), 3, "mean_pl"), F.count_if(radio.line_of_sight(F.array("hops"))).alias("n_los"))


@query(f"""WITH {cte('fx_measurements')}, c AS (SELECT *, row_number() OVER (PARTITION BY city, bs_id ORDER BY md5(concat_ws('|', '5', l_orderkey::VARCHAR, l_linenumber::VARCHAR, l_partkey::VARCHAR)), l_orderkey, l_linenumber, l_partkey) AS k FROM fx_measurements WHERE pathloss_db <= 130)
SELECT city, bs_id, count(*) AS n, sum(l_orderkey)::BIGINT AS keys FROM c WHERE k <= 40 GROUP BY ALL""")
def b7_cells_to_measurements(spark, sf):
    cells = rows(spark, sf).withColumn("path_gain", F.pow(F.lit(10.0), -F.col("pathloss_db") / 10))
    return measure.cells_to_measurements(cells.drop("pathloss_db"), 130.0, 40, 5, "l_orderkey", "l_linenumber", "l_partkey").groupBy("city", "bs_id").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"))


@query(f"WITH {cte('fx_measurements')} SELECT DISTINCT city, bs_id FROM fx_measurements f WHERE NOT EXISTS (SELECT 1 FROM fx_measurements g WHERE g.city = f.city AND g.bs_id = f.bs_id AND g.pathloss_db <= 85)")
def b8_silent_stations(spark, sf):
    m = rows(spark, sf)
    return measure.silent_stations(m.select("city", "bs_id").distinct(), m.where("pathloss_db <= 85"))


@query(f"WITH {cte('fx_measurements')} SELECT city, bs_id, count(*) AS n_total, count(pathloss_db) AS n_valid, round(min(pathloss_db), 4) AS pl_min, round(max(pathloss_db), 4) AS pl_max, round(avg((dist_m < 600)::INT) FILTER (l_linenumber <> 3), 5) AS los_share FROM fx_measurements GROUP BY ALL")
def b9_ingest_summary(spark, sf):
    """Line of sight within 600 m, unknown for some rows."""
    m = rows(spark, sf).withColumn("los", F.when(F.col("l_linenumber") != 3, F.col("dist_m") < 600))
    return measure.ingest_summary(m).select("city", "bs_id", "n_total", "n_valid", r("pl_min"), r("pl_max"), r("los_share", 5))


_RANGE = "(44.9 - 6.55 * log10(30)) * log10(greatest(dist_m / 1000, 1e-3))"
_SMALL = "((1.1 * log10({f}) - 0.7) * 1.5 - (1.56 * log10({f}) - 0.8))"
_HATA = "69.55 + 26.16 * log10({f}) - 13.82 * log10(30) - {a} + " + _RANGE
_LARGE = "(3.2 * pow(log10(11.75 * 1.5), 2) - 4.97)"
_COST = "46.3 + 33.9 * log10(3500) - 13.82 * log10(30) - " + _SMALL.format(f=3500) + " + " + _RANGE


@query(f"""WITH {cte('fx_measurements')} SELECT city, round(avg({_HATA.format(f=3500, a=_LARGE)}), 3) AS hata, round(avg({_HATA.format(f=150, a=_SMALL.format(f=150))}), 3) AS hata_low, round(avg({_HATA.format(f=900, a=_SMALL.format(f=900))}), 3) AS hata_small,
 round(avg({_COST} + 3), 3) AS cost231, round(avg({_COST}), 3) AS cost231_medium, round(avg(13.54 + 39.08 * log10(greatest(dist_m, 1)) + 20 * log10(3.5)), 3) AS uma, round(avg(13.54 + 39.08 * log10(greatest(dist_m, 1)) + 20 * log10(3.5) - 0.6 * 8.5), 3) AS uma_high FROM fx_measurements GROUP BY city""")
def e7_empirical_models(spark, sf):
    """Every branch: under 300 MHz, small cities, medium-sized cities, and a receiver above the street."""
    d, f = F.col("dist_m"), F.lit(3500.0)
    models = {"hata": radio.hata_db(d, f), "hata_low": radio.hata_db(d, F.lit(150.0)), "hata_small": radio.hata_db(d, F.lit(900.0), large_city=False), "cost231": radio.cost231_db(d, f), "cost231_medium": radio.cost231_db(d, f, metropolitan=False), "uma": radio.uma_nlos_db(d, F.lit(3.5)), "uma_high": radio.uma_nlos_db(d, F.lit(3.5), h_ut=10.0)}
    return rows(spark, sf).groupBy("city").agg(*[r(F.avg(v), 3, k) for k, v in models.items()])


PRED = f"WITH {cte('fx_predictions')}"
#: Added to mean errors before they are rounded: those of the fixture have few decimals, and could fall on a half.
OFF = 3.14159e-9
PEARSON = "CASE WHEN stddev_pop({0}) >= 1e-12 AND stddev_pop({1}) >= 1e-12 THEN covar_pop({0}, {1}) / (stddev_pop({0}) * stddev_pop({1})) END"


@query(PRED + f""", rk AS (SELECT *, rank() OVER (PARTITION BY model, fold, target ORDER BY pred) + (count(*) OVER (PARTITION BY model, fold, target, pred) - 1) / 2.0 AS rp,
  rank() OVER (PARTITION BY model, fold, target ORDER BY truth) + (count(*) OVER (PARTITION BY model, fold, target, truth) - 1) / 2.0 AS rt FROM fx_predictions)
SELECT model, fold, target, count(*) AS n, round(sum(pow(pred - truth, 2)) / greatest(sum(truth * truth), 1e-12), 6) AS nmse, round(sqrt(avg(pow(pred - truth, 2))), 5) AS rmse, round(avg(abs(pred - truth)) + {OFF}, 5) AS mae,
 round({PEARSON.format('pred', 'truth')}, 5) AS pearson, round({PEARSON.format('rp::DOUBLE', 'rt::DOUBLE')}, 5) AS spearman FROM rk GROUP BY model, fold, target""")
def i5_full_report(spark, sf):
    return metrics.full_report(rows(spark, sf, "fx_predictions")).select(*metrics.KEYS, "n", r("nmse", 6), r("rmse", 5), r(F.col("mae") + OFF, 5, "mae"), r("pearson", 5), r("spearman", 5))


@query(PRED + " SELECT model, fold, target, round(count_if(pred >= 2.5 AND truth >= 2.5) / greatest(count_if(pred >= 2.5 OR truth >= 2.5), 1)::DOUBLE, 5) AS coverage_iou, round(avg(((pred >= 2.5) = (truth >= 2.5))::INT), 5) AS coverage_acc FROM fx_predictions GROUP BY ALL")
def i4_coverage_agreement(spark, sf):
    return metrics.coverage_agreement(rows(spark, sf, "fx_predictions"), 2.5).select(*metrics.KEYS, r("coverage_iou", 5), r("coverage_acc", 5))


CONF = PRED + """, sc AS (SELECT model, target, abs(truth - pred) / greatest(sigma, 1e-6) AS s FROM fx_predictions WHERE tile % 2 = 0),
q AS (SELECT model, target, s AS q FROM (SELECT *, row_number() OVER (PARTITION BY model, target ORDER BY s) AS k, count(*) OVER (PARTITION BY model, target) AS n FROM sc) WHERE k = least(ceil((n + 1) * 0.9 - 1e-9), n))"""


@query(CONF + " SELECT model, target, round(q, 5) AS q, round(avg((abs(truth - pred) <= q * sigma + 1e-12)::INT), 5) AS coverage, round(avg(2 * q * sigma), 5) AS mean_width FROM fx_predictions JOIN q USING (model, target) WHERE tile % 2 = 1 GROUP BY model, target, q")
def i7_conformal(spark, sf):
    p = rows(spark, sf, "fx_predictions")
    q = metrics.conformal_quantile(p.where("tile % 2 = 0"), "model", "target")
    w = F.col("q") + 1e-12
    cover = metrics.conformal_coverage(p.where("tile % 2 = 1"), q.withColumn("q", w), "model", "target")
    return q.join(F.broadcast(cover), ["model", "target"]).select("model", "target", r("q", 5), r("coverage", 5), r("mean_width", 5))  # a row for each model and target


@query(PRED + """, sc AS (SELECT model, target, 1 + tile % 3 AS w, abs(truth - pred) / greatest(sigma, 1e-6) AS s FROM fx_predictions),
ru AS (SELECT *, sum(w) OVER (PARTITION BY model, target ORDER BY s) AS run, sum(w) OVER (PARTITION BY model, target) AS total FROM sc)
SELECT model, target, round(min(s), 5) AS q FROM ru WHERE run >= 0.9 * total - 1e-9 GROUP BY ALL""")
def i8_weighted_conformal(spark, sf):
    p = rows(spark, sf, "fx_predictions").withColumn("w", 1 + F.col("tile") % 3)
    return metrics.weighted_conformal_quantile(p, "model", "target").select("model", "target", r("q", 5))


_Z = ", ".join(f"({a}, {z})" for a, z in metrics.INTERVAL_Z.items())


@query(PRED + f" SELECT model, target, a::DOUBLE AS nominal, round(avg((abs(truth - pred) <= z * sigma)::INT), 5) AS empirical, round(avg(2 * z * sigma), 5) AS avg_width, round(avg((abs(truth - pred) <= z * sigma)::INT) - a, 5) AS gap FROM fx_predictions CROSS JOIN (VALUES {_Z}) l(a, z) GROUP BY model, target, a")
def i9_interval_coverage(spark, sf):
    return metrics.interval_coverage(rows(spark, sf, "fx_predictions")).select("model", "target", "nominal", r("empirical", 5), r("avg_width", 5), r("gap", 5))


_L = ", ".join(f"({(i + 1) / 20}, {z})" for i, z in enumerate(metrics.LEVEL_Z))


@query(PRED + f" SELECT model, target, round(sum(abs(e - a)) / 20, 5) AS ece FROM (SELECT model, target, a, avg(((truth - pred) / greatest(sigma, 1e-9) <= z)::INT) AS e FROM fx_predictions CROSS JOIN (VALUES {_L}) l(a, z) GROUP BY model, target, a) GROUP BY model, target")
def i10_regression_ece(spark, sf):
    return metrics.regression_ece(rows(spark, sf, "fx_predictions")).select("model", "target", r("ece", 5))


@query(PRED + " SELECT model, target, round(avg(0.5 * (2 * ln(sigma) + pow(truth - pred, 2) / (sigma * sigma))), 4) AS nll FROM fx_predictions GROUP BY ALL")
def i11_gaussian_nll(spark, sf):
    return metrics.gaussian_nll(rows(spark, sf, "fx_predictions")).select("model", "target", r("nll"))


FOLDS = PRED + ", sc AS (SELECT model, fold, target, sqrt(avg(pow(pred - truth, 2))) AS rmse, avg(abs(pred - truth)) AS mae FROM fx_predictions GROUP BY ALL)"


@query(FOLDS + " SELECT model, target, round(avg(rmse), 5) AS rmse_mean, round(stddev_samp(rmse), 5) AS rmse_std, round(avg(mae), 5) AS mae_mean, round(stddev_samp(mae), 5) AS mae_std FROM sc GROUP BY ALL")
def i12_model_summary(spark, sf):
    return metrics.model_summary(metrics.errors(rows(spark, sf, "fx_predictions"))).select("model", "target", *[r(c, 5) for c in ("rmse_mean", "rmse_std", "mae_mean", "mae_std")])


@query(PRED + " SELECT tile, target, round(avg(pred), 5) AS mean, round(avg(sigma * sigma), 5) AS aleatoric, round(var_pop(pred), 5) AS epistemic FROM fx_predictions GROUP BY ALL")
def h9_ensemble(spark, sf):
    return metrics.ensemble(rows(spark, sf, "fx_predictions")).select("tile", "target", r("mean", 5), r("aleatoric", 5), r("epistemic", 5))


@query(PRED + " SELECT model, tile, target, round(CASE WHEN target = 'gamma' THEN 1 + 5 / (1 + exp(-(pred - 2.5))) ELSE -40 + 130 / (1 + exp(-(pred - 30) / 10)) END, 5) AS value, round(greatest(least(20 * ln(sigma), 4), -8), 5) AS log_variance FROM fx_predictions")
def h10_squash(spark, sf):
    gamma, pl0 = radio.squash(F.col("pred") - 2.5, 1.0, 6.0), radio.squash((F.col("pred") - 30) / 10, -40.0, 90.0)
    value = F.when(F.col("target") == "gamma", gamma).otherwise(pl0)
    return rows(spark, sf, "fx_predictions").select("model", "tile", "target", r(value, 5, "value"), r(radio.clamp_log_variance(20 * F.log("sigma")), 5, "log_variance"))


def _scores(spark, sf):
    return metrics.errors(rows(spark, sf, "fx_predictions"), "model", "fold", "target").select("model", "fold", "target", F.col("rmse").alias("value"))


def _diffs(spark, sf):
    """Against model a, each target by itself; models are named with their target."""
    scores = _scores(spark, sf)
    each = [folds.paired(scores.where(F.col("target") == t), "a").withColumn("model", F.concat("model", F.lit(f"/{t}"))) for t in transfer.TARGETS]
    return each[0].unionByName(each[1])


DIFF = FOLDS + ", df AS (SELECT s.model || '/' || s.target AS model, s.fold, s.rmse - q.rmse AS d FROM sc s JOIN sc q USING (fold, target) WHERE q.model = 'a' AND s.model <> 'a')"


@query(DIFF + """, rr AS (SELECT range AS run, unnest(range(0, n)) AS k, n FROM range(10000), (SELECT count(DISTINCT fold) AS n FROM df)),
ix AS (SELECT run, k, ('0x' || substr(md5(concat_ws('|', '0', run::VARCHAR, k::VARCHAR)), 1, 8))::BIGINT % n AS i FROM rr),
nu AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY fold) - 1 AS i FROM df),
bm AS (SELECT model, run, avg(d) AS b FROM ix JOIN nu USING (i) GROUP BY model, run)
SELECT model, round(any_value(dm), 5) AS diff_mean, round(quantile_cont(b, 0.025), 5) AS ci_lo, round(quantile_cont(b, 0.975), 5) AS ci_hi, quantile_cont(b, 0.025) > 0 OR quantile_cont(b, 0.975) < 0 AS significant FROM bm JOIN (SELECT model, avg(d) AS dm FROM df GROUP BY model) USING (model) GROUP BY model""")
def j1_bootstrap(spark, sf):
    ci = folds.bootstrap_ci(_diffs(spark, sf))
    return ci.select("model", r("diff_mean", 5), r("ci_lo", 5), r("ci_hi", 5), "significant")


# p by the finite cosine series; with ten folds there are nine degrees of freedom
T_TEST = DIFF + """, tt AS (SELECT model, count(*) AS n_folds, avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t, avg(d) / greatest(stddev_samp(d), 1e-12) AS dz FROM df GROUP BY model),
th AS (SELECT *, atan(abs(t) / 3) AS a, pow(cos(atan(abs(t) / 3)), 2) AS c FROM tt)"""
T_P = "CASE WHEN n_folds = 10 THEN 1 - 2 / pi() * (a + sin(a) * cos(a) * (1 + c * 2 / 3 * (1 + c * 4 / 5 * (1 + c * 6 / 7)))) END"


@query(T_TEST + f" SELECT model, n_folds, round(t, 4) AS t, round({T_P}, 6) AS p_t, round(dz, 4) AS cohens_dz_folds FROM th")
def j2_paired_t(spark, sf):
    return folds.paired_t(_diffs(spark, sf)).select("model", "n_folds", r("t"), r("p_t", 6), r("cohens_dz_folds"))


# p exact over all signs
SIGNED = DIFF + """, rk AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY abs(d)) + (count(*) OVER (PARTITION BY model, abs(d)) - 1) / 2.0 AS r, row_number() OVER (PARTITION BY model ORDER BY abs(d), fold) - 1 AS k FROM df WHERE d <> 0),
wx AS (SELECT model, count(*) AS n, least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END))::DOUBLE AS w FROM rk GROUP BY model),
ms AS (SELECT model, mask, sum(CASE WHEN (mask >> k) & 1 = 1 THEN r ELSE 0 END) AS s FROM rk JOIN (SELECT model, unnest(range(0, (1 << n)::BIGINT)) AS mask FROM wx) USING (model) GROUP BY model, mask),
px AS (SELECT model, any_value(n) AS n, any_value(w) AS wilcoxon, least(1, 2 * avg((s <= w + 1e-9)::INT)) AS p_w FROM ms JOIN wx USING (model) GROUP BY model)"""


@query(SIGNED + " SELECT model, n, wilcoxon, round(p_w, 6) AS p_w FROM px")
def j3_wilcoxon(spark, sf):
    return folds.wilcoxon(_diffs(spark, sf)).select("model", "n", "wilcoxon", r("p_w", 6))


@query("""WITH p AS (SELECT l_returnflag AS family, l_suppkey::VARCHAR AS name, (sum(l_orderkey) % 997)::DOUBLE / 4000 AS p FROM lineitem GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, name) - 1 AS i, count(*) OVER (PARTITION BY family) AS mm FROM p)
SELECT family, name, round(p, 6) AS p, min((p <= 0.05 / (mm - i))::INT) OVER (PARTITION BY family ORDER BY i) = 1 AS rejected FROM rk""")
def j4_holm(spark, sf):
    p = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy(F.col("l_returnflag").alias("family"), F.col("l_suppkey").cast("string").alias("name")).agg((F.sum("l_orderkey") % 997).alias("s"))
    return folds.holm(p.select("family", "name", (F.col("s").cast("double") / 4000).alias("p"))).select("family", "name", r("p", 6), "rejected")


@query("""SELECT 'net_' || (s_suppkey % 3)::VARCHAR AS model, 'city_' || s_nationkey::VARCHAR || '_sea' AS city, count(*) AS n, sum(s_suppkey)::BIGINT AS seeds FROM supplier GROUP BY ALL""")
def j5_parse_run(spark, sf):
    runs = spark.read.parquet(f"{sf}/supplier.parquet").select(F.format_string("net_%d_loco_city_%d_sea_s%d", F.col("s_suppkey") % 3, "s_nationkey", "s_suppkey").alias("run"))
    return folds.parse_run(runs).groupBy("model", "city").agg(F.count("*").alias("n"), F.sum("seed").alias("seeds"))


@query(FOLDS + " SELECT fold, target, round(max(CASE WHEN model = 'a' THEN rmse END), 5) AS a, round(max(CASE WHEN model = 'b' THEN rmse END), 5) AS b, round(max(CASE WHEN model = 'c' THEN rmse END), 5) AS c FROM sc GROUP BY fold, target")
def j6_fold_table(spark, sf):
    return folds.fold_table(_scores(spark, sf), ["a", "b", "c"], "fold", "target").select("fold", "target", r("a", 5), r("b", 5), r("c", 5))


SPLIT = """ct AS (SELECT DISTINCT city FROM fx_tiles), pr AS (SELECT a.city AS fold, b.city FROM ct a CROSS JOIN ct b),
sp AS (SELECT fold, city, CASE WHEN city = fold THEN 'test' WHEN row_number() OVER (PARTITION BY fold, city = fold ORDER BY md5(concat_ws('|', '0', fold, city))) <= 1 THEN 'val' ELSE 'train' END AS role FROM pr)"""
TILES = f"WITH {cte('fx_tiles')}, {SPLIT}"


def _splits(spark, sf):
    return splits.leave_one_city_out(rows(spark, sf, "fx_tiles").select("city").distinct())


@query(TILES + " SELECT * FROM sp")
def g1_leave_one_city_out(spark, sf):
    return _splits(spark, sf)


@query(f"""WITH {cte('fx_measurements')}, e AS (SELECT city, list_distinct(quantile_cont(rx_lat, [0.2, 0.4, 0.6, 0.8])) AS ea, list_distinct(quantile_cont(rx_lon, [0.2, 0.4, 0.6, 0.8])) AS eo FROM fx_measurements GROUP BY city),
b AS (SELECT city, (len(list_filter(ea, lambda x: rx_lat > x)) * 5 + len(list_filter(eo, lambda x: rx_lon > x)))::INT AS block FROM fx_measurements JOIN e USING (city)),
c AS (SELECT city, block, row_number() OVER (PARTITION BY city ORDER BY md5(concat_ws('|', '0', city, block::VARCHAR))) <= greatest(1, floor(count(*) OVER (PARTITION BY city) / 5)) AS is_val FROM (SELECT DISTINCT city, block FROM b))
SELECT city, block, is_val, count(*) AS n FROM b JOIN c USING (city, block) GROUP BY ALL""")
def g2_geographic_blocks(spark, sf):
    return splits.geographic_blocks(rows(spark, sf).select("city", "rx_lat", "rx_lon"), "rx_lat", "rx_lon").groupBy("city", "block", "is_val").agg(F.count("*").alias("n"))


@query(f"WITH {cte('fx_tiles')} SELECT city, tile, row_number() OVER (PARTITION BY city ORDER BY md5(concat_ws('|', '0', tile::VARCHAR)), tile) <= floor(count(*) OVER (PARTITION BY city) * 0.15 + 1e-9) AS is_val FROM fx_tiles")
def g3_holdout(spark, sf):
    return splits.holdout(rows(spark, sf, "fx_tiles").select("city", "tile"))


ANCHOR = f"""WITH {cte('fx_tiles')}, g AS (SELECT city, tile, k, draw, row_number() OVER (PARTITION BY city, k, draw ORDER BY md5(concat_ws('|', '0', k::VARCHAR, draw::VARCHAR, tile::VARCHAR)), tile) <= k AS is_anchor,
  gamma AS truth, gamma + 0.1 + 0.02 * ((tile % 9) - 4) AS pred FROM fx_tiles, (VALUES {", ".join(f"({k})" for k in splits.KS)}) ks(k), range({splits.DRAWS}) ds(draw))"""


@query(ANCHOR + " SELECT city, k, draw, count_if(is_anchor) AS n_anchors, sum(CASE WHEN is_anchor THEN tile ELSE 0 END)::BIGINT AS tiles FROM g GROUP BY ALL")
def g4_anchors(spark, sf):
    return splits.anchors(rows(spark, sf, "fx_tiles")).groupBy("city", "k", "draw").agg(F.count_if("is_anchor").alias("n_anchors"), F.sum(F.when(F.col("is_anchor"), F.col("tile")).otherwise(0)).alias("tiles"))


@query(ANCHOR + """, s AS (SELECT city, k, draw, avg(truth - pred) AS shift FROM g WHERE is_anchor GROUP BY ALL),
e AS (SELECT 'bias' AS mode, g.city, g.k, g.draw, sqrt(avg(pow(truth - pred - shift, 2))) AS rmse FROM g JOIN s USING (city, k, draw) WHERE NOT is_anchor GROUP BY ALL
  UNION ALL SELECT 'none', city, k, draw, sqrt(avg(pow(truth - pred, 2))) FROM g WHERE NOT is_anchor GROUP BY ALL
  UNION ALL SELECT mode, city, 0, 0, sqrt(avg(pow(truth - pred, 2))) FROM g, (VALUES ('none'), ('bias')) ms(mode) WHERE k = 3 AND draw = 0 GROUP BY ALL)
SELECT k::INT AS k, round(avg(rmse) FILTER (mode = 'none'), 5) AS none, round(avg(rmse) FILTER (mode = 'bias'), 5) AS bias FROM e GROUP BY k""")
def h8_shot_curve(spark, sf):
    """Error by the number of anchors, one column for each mode of correction; 0: without any."""
    t = rows(spark, sf, "fx_tiles")
    own = t.select("tile", F.col("gamma").alias("truth"), (F.col("gamma") + 0.1 + 0.02 * ((F.col("tile") % 9) - 4)).alias("pred"))
    drawn = splits.anchors(t).join(own, "tile").withColumnRenamed("city", "fold")
    zero = t.select(F.col("city").alias("fold"), "tile").join(own, "tile")
    return transfer.shot_table({"none": drawn.where("not is_anchor"), "bias": transfer.bias_corrected(drawn)}, zero).select("k", r("none", 5), r("bias", 5))


@query(TILES + " SELECT fold, round(quantile_cont(gamma, 0.5), 5) AS gamma_pred, round(quantile_cont(pl0, 0.5), 5) AS pl0_pred FROM fx_tiles JOIN sp USING (city) WHERE role = 'train' GROUP BY fold")
def h1_median(spark, sf):
    return transfer.median_predictor(tables.stack(rows(spark, sf, "fx_tiles"), _splits(spark, sf), "train")).select("fold", r("gamma_pred", 5), r("pl0_pred", 5))


SCALE = TILES + """, st AS (SELECT fold, role, tile, gamma, pl0, v FROM fx_tiles JOIN sp USING (city)),
sc AS (SELECT fold, i, CASE WHEN max(abs(x)) = 0 THEN 1 ELSE max(abs(x)) END AS s FROM (SELECT fold, unnest(v)::DOUBLE AS x, unnest(range(64)) AS i FROM st WHERE role = 'train') GROUP BY fold, i)"""


def _stacked(spark, sf):
    t, sp = rows(spark, sf, "fx_tiles").withColumn("v", F.col("v").cast("array<double>")), _splits(spark, sf)
    scale = transfer.column_max(tables.stack(t, sp, "train"))
    return {role: transfer.normalised(tables.stack(t, sp, role), scale) for role in ("train", "val", "test")}, scale


@query(SCALE + " SELECT fold, i::INT AS i, round(s, 5) AS s FROM sc")
def d13_column_max(spark, sf):
    return _stacked(spark, sf)[1].select("fold", F.posexplode("scale").alias("i", "s")).select("fold", "i", r("s", 5))


NORMAL = SCALE + """, nl AS (SELECT st.fold, role, tile, gamma, pl0, list(x / s ORDER BY i) AS v FROM (SELECT fold, role, tile, gamma, pl0, unnest(v)::DOUBLE AS x, unnest(range(64)) AS i FROM st) st JOIN sc USING (fold, i) GROUP BY ALL)"""


@query(NORMAL + """, pw AS (SELECT a.fold, a.tile, exp(-pow(list_distance(a.v, b.v), 2) / 2) AS w, b.gamma, b.pl0 FROM nl a JOIN nl b USING (fold) WHERE a.role = 'test' AND b.role = 'train')
SELECT fold, tile, round(sum(w * gamma) / greatest(sum(w), 1e-30), 4) AS gamma_pred, round(sum(w * pl0) / greatest(sum(w), 1e-30), 3) AS pl0_pred FROM pw GROUP BY ALL""")
def h2_gaussian_transfer(spark, sf):
    s, _ = _stacked(spark, sf)
    return transfer.gaussian_predict(s["test"], s["train"], 1.0).select("fold", "tile", r("gamma_pred"), r("pl0_pred", 3))


@query(NORMAL + f""", pw AS (SELECT a.fold, a.tile, a.gamma AS gt, a.pl0 AS pt, pow(list_distance(a.v, b.v), 2) AS d2, b.gamma, b.pl0 FROM nl a JOIN nl b USING (fold) WHERE a.role = 'val' AND b.role = 'train'),
pp AS (SELECT fold, tile, s, gt, pt, sum(exp(-d2 / (2 * s * s)) * gamma) / greatest(sum(exp(-d2 / (2 * s * s))), 1e-30) AS g, sum(exp(-d2 / (2 * s * s)) * pl0) / greatest(sum(exp(-d2 / (2 * s * s))), 1e-30) AS p FROM pw, (VALUES {", ".join(f"({s})" for s in transfer.SIGMAS)}) k(s) GROUP BY ALL),
er AS (SELECT fold, s, sum(pow(g - gt, 2) + pow(p - pt, 2)) / (2 * count(*)) AS err FROM pp GROUP BY ALL)
SELECT fold, arg_min(s, err)::DOUBLE AS sigma, round(min(err), 3) AS err FROM er GROUP BY fold""")
def h3_select_sigma(spark, sf):
    s, _ = _stacked(spark, sf)
    return transfer.select_sigma(s["val"], s["train"]).select("fold", "sigma", r("err", 3))


def solved(name: str, key: str, start: str) -> str:
    """A recursive part of a WITH clause that solves the systems `mat` (rows of coefficients, then right sides) of `start` by
    elimination, one unknown a step; they are positive definite, so no row is exchanged.  At k = len(mat) + 1 the
    right sides are the solutions."""
    less = "list_transform(mat, lambda w, i: CASE WHEN i = k THEN list_transform(w, lambda x: x / mat[k][k]) ELSE list_transform(w, lambda x, j: x - w[k] / mat[k][k] * mat[k][j]) END)"
    return f"{name} AS (SELECT {key}, 1::BIGINT AS k, mat FROM {start} UNION ALL SELECT {key}, k + 1, {less} FROM {name} WHERE k <= len(mat))"


RIDGE = NORMAL.replace("WITH", "WITH RECURSIVE", 1) + f""",
tr AS (SELECT fold, tile, gamma, pl0, v FROM nl WHERE role = 'train'),
el AS (SELECT fold, tile, gamma, pl0, unnest(v) AS x, unnest(range(64)) AS i FROM tr),
gm AS (SELECT a.fold, a.i, b.i AS j, covar_pop(a.x, b.x) * count(*) + max((a.i = b.i)::INT) AS g FROM el a JOIN el b USING (fold, tile) GROUP BY ALL),
lf AS (SELECT fold, i, list(g ORDER BY j) AS l FROM gm GROUP BY ALL),
rt AS (SELECT fold, i, [covar_pop(x, gamma) * count(*), covar_pop(x, pl0) * count(*)] AS y FROM el GROUP BY ALL),
m0 AS (SELECT fold, list(list_concat(l, y) ORDER BY i) AS mat FROM lf JOIN rt USING (fold, i) GROUP BY fold),
{solved("sv", "fold", "m0")},
me AS (SELECT fold, list(x ORDER BY i) AS mv FROM (SELECT fold, i, avg(x) AS x FROM el GROUP BY ALL) GROUP BY fold),
wt AS (SELECT fold, list_transform(mat, lambda w: w[65]) AS wg, list_transform(mat, lambda w: w[66]) AS wp FROM sv WHERE k = 65),
bs AS (SELECT fold, mv, wg, wp, mg - list_dot_product(mv, wg) AS bg, mp - list_dot_product(mv, wp) AS bp FROM wt JOIN me USING (fold) JOIN (SELECT fold, avg(gamma) AS mg, avg(pl0) AS mp FROM tr GROUP BY fold) USING (fold)),
lp AS (SELECT fold, role, tile, v, unnest(['gamma', 'pl0']) AS target, unnest([gamma, pl0]) AS truth, unnest([bg + list_dot_product(v, wg), bp + list_dot_product(v, wp)]) AS pred FROM nl JOIN bs USING (fold))"""


@query(RIDGE + " SELECT fold, tile, target, round(pred, 4) AS pred FROM lp WHERE role = 'test'")
def h4_descriptor_ridge(spark, sf):
    """Every fold's ridge regressions on the descriptors; tests/test_transfer.py compares them with the closed form too."""
    t, sp = rows(spark, sf, "fx_tiles"), _splits(spark, sf)
    return transfer.linear_predictions(transfer.ridge_by_fold(t, sp), tables.stack(t, sp, "test")).select("fold", "tile", "target", r("pred"))


@query(f"WITH {cte('fx_tiles')} SELECT city, count(DISTINCT i) AS n_nonzero FROM (SELECT city, unnest(v) AS x, unnest(range(64)) AS i FROM fx_tiles) WHERE x <> 0 GROUP BY city")
def d17_nonzero_dimensions(spark, sf):
    return transfer.nonzero_dimensions(rows(spark, sf, "fx_tiles"))


@query(f"WITH {cte('fx_tiles')} SELECT tile, round(list_sum(list_transform(v[1:6], lambda x: x::DOUBLE)) + list_sum(list_transform(v[39:64], lambda x: x::DOUBLE)), 3) AS s FROM fx_tiles")
def d14_group_masking(spark, sf):
    v = transfer.masked(F.col("v").cast("array<double>"), 6, 37)
    return rows(spark, sf, "fx_tiles").select("tile", r(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 3, "s"))


@query(f"""WITH {cte('fx_tiles')}, e AS (SELECT (city IN ('c0', 'c1'))::INT AS side, tile, unnest(v)::DOUBLE AS x, unnest(range(64)) AS i FROM fx_tiles),
c AS (SELECT a.side, a.i, b.i AS j, covar_samp(a.x, b.x) AS c FROM e a JOIN e b USING (side, tile) GROUP BY ALL)
SELECT round(sum(pow(p.c - q.c, 2)) / (4 * 64 * 64) * 1e6, 3) AS coral_u FROM c p JOIN c q USING (i, j) WHERE p.side = 0 AND q.side = 1""")
def l1_coral(spark, sf):
    side = F.col("city").isin("c0", "c1").cast("int")
    return transfer.coral(rows(spark, sf, "fx_tiles").select(side.alias("side"), F.col("v").cast("array<double>").alias("v"))).select(r(F.col("coral") * 1e6, 3, "coral_u"))


@query(f"""WITH {cte('fx_tiles')}, e AS (SELECT (city IN ('c0', 'c1'))::INT AS side, v FROM fx_tiles), p AS (SELECT a.side AS sa, b.side AS sb, pow(list_distance(a.v::DOUBLE[], b.v::DOUBLE[]), 2) AS d2 FROM e a CROSS JOIN e b),
k AS (SELECT sa, sb, avg((exp(-d2 / 2) + exp(-d2 / 8) + exp(-d2 / 32) + exp(-d2 / 128)) / 4) AS k FROM p GROUP BY ALL) SELECT round(sum(CASE WHEN sa = sb THEN k ELSE -k END), 5) AS mmd2 FROM k""")
def l2_mmd2(spark, sf):
    side = F.col("city").isin("c0", "c1").cast("int")
    return transfer.mmd2(rows(spark, sf, "fx_tiles").select("tile", side.alias("side"), "v")).select(r("mmd2", 5))


@query(f"""WITH {cte('fx_tiles')}, nb AS (SELECT ceil(count(*) / 100.0)::BIGINT AS blocks, count(*) FILTER (city NOT IN ('c0', 'c1'))::DOUBLE AS s, count(*) FILTER (city IN ('c0', 'c1'))::DOUBLE AS t FROM fx_tiles),
e AS (SELECT tile, ('0x' || substr(md5(concat_ws('|', '0', tile::VARCHAR)), 1, 8))::BIGINT % blocks AS block, (city IN ('c0', 'c1'))::INT AS side, v::DOUBLE[] AS v FROM fx_tiles, nb),
p AS (SELECT a.block, a.side AS sa, b.side AS sb, pow(list_distance(a.v, b.v), 2) AS d2 FROM e a JOIN e b ON a.block = b.block AND a.tile <> b.tile),
k AS (SELECT block, sa, sb, sum((exp(-d2 / 2) + exp(-d2 / 8) + exp(-d2 / 32) + exp(-d2 / 128)) / 4) AS k, count(*)::DOUBLE AS n FROM p GROUP BY ALL),
w AS (SELECT block, coalesce(sum(k) FILTER (sa = 0 AND sb = 0), 0) AS kss, coalesce(sum(n) FILTER (sa = 0 AND sb = 0), 0) AS nss, coalesce(sum(k) FILTER (sa = 1 AND sb = 1), 0) AS ktt, coalesce(sum(n) FILTER (sa = 1 AND sb = 1), 0) AS ntt, coalesce(sum(k) FILTER (sa = 0 AND sb = 1), 0) AS kst, coalesce(sum(n) FILTER (sa = 0 AND sb = 1), 0) AS nst FROM (SELECT DISTINCT block FROM e) LEFT JOIN k USING (block) GROUP BY block),
a AS (SELECT sum(kss) AS a1, sum(nss) AS a2, sum(ktt) AS a3, sum(ntt) AS a4, sum(kst) AS a5, sum(nst) AS a6 FROM w),
j AS (SELECT (a1 / a2 * (s - 1) + 1) / s + (a3 / a4 * (t - 1) + 1) / t - 2 * a5 / a6 AS value, ((a1 - kss) / (a2 - nss) * (s - 1) + 1) / s + ((a3 - ktt) / (a4 - ntt) * (t - 1) + 1) / t - 2 * (a5 - kst) / (a6 - nst) AS without FROM w, a, nb)
SELECT round(max(value), 6) AS mmd2, round(sqrt((count(*) - 1) * var_pop(without)), 6) AS error, count(*) AS n_blocks FROM j""")
def l2_mmd2_blocks(spark, sf):
    """The estimate from blocks of about 100 rows, with its error."""
    side = F.col("city").isin("c0", "c1").cast("int")
    return transfer.mmd2_blocks(rows(spark, sf, "fx_tiles").select("tile", side.alias("side"), "v"), per_block=100).select(r("mmd2", 6), r("error", 6), "n_blocks")


HEIGHT = f"""WITH {cte('fx_structures')}, k AS (SELECT *, coalesce(try_cast(height_tag AS DOUBLE), try_cast(levels_tag AS DOUBLE) * 3.2) AS known,
 CASE WHEN try_cast(height_tag AS DOUBLE) IS NOT NULL THEN 'tag' WHEN try_cast(levels_tag AS DOUBLE) IS NOT NULL THEN 'levels' ELSE 'imputed' END AS src FROM fx_structures WHERE kind = 'building'),
h AS (SELECT k.*, least(greatest(coalesce(known, med, 10), 2), 500) AS height FROM k JOIN (SELECT city, quantile_cont(known, 0.5) AS med FROM k GROUP BY city) USING (city))"""


def _buildings(spark, sf):
    return structures.with_heights(rows(spark, sf, "fx_structures").where("kind = 'building'"))


@query(HEIGHT + " SELECT city, count(*) AS n_buildings, round(avg((src = 'tag')::INT), 5) AS frac_tag, round(avg((src = 'levels')::INT), 5) AS frac_levels, round(avg((src = 'imputed')::INT), 5) AS frac_imputed, round(quantile_cont(height, 0.5), 4) AS median_height_m FROM h GROUP BY city")
def d4_height_provenance(spark, sf):
    return structures.height_provenance(_buildings(spark, sf)).select("city", "n_buildings", r("frac_tag", 5), r("frac_levels", 5), r("frac_imputed", 5), r("median_height_m"))


TOUCH = """, c AS (SELECT *, unnest(range(floor((cx - width_m / 2) / 300)::BIGINT, floor((cx + width_m / 2) / 300)::BIGINT + 1)) AS z FROM (SELECT *, unnest(range(floor((cy - depth_m / 2) / 300)::BIGINT, floor((cy + depth_m / 2) / 300)::BIGINT + 1)) AS m FROM {0})),
t AS (SELECT *, width_m * depth_m AS area_m2, (least(cx + width_m / 2, (z + 1) * 300) - greatest(cx - width_m / 2, z * 300)) * (least(cy + depth_m / 2, (m + 1) * 300) - greatest(cy - depth_m / 2, m * 300)) AS clip_m2 FROM c
  WHERE least(cx + width_m / 2, (z + 1) * 300) > greatest(cx - width_m / 2, z * 300) AND least(cy + depth_m / 2, (m + 1) * 300) > greatest(cy - depth_m / 2, m * 300))"""


@query(f"WITH {cte('fx_structures')}" + TOUCH.format("fx_structures") + " SELECT city, m, z, count(*) AS n, round(sum(area_m2), 3) AS area_m2, round(sum(clip_m2), 3) AS clip_m2 FROM t GROUP BY ALL")
def c9_structures_by_tile(spark, sf):
    t = grid.cells_touched(rows(spark, sf, "fx_structures"), METRIC_TILE)
    return t.groupBy("city", "m", "z").agg(F.count("*").alias("n"), r(F.sum("area_m2"), 3, "area_m2"), r(F.sum("clip_m2"), 3, "clip_m2"))


def _cells(spark, sf):
    """The tiles of the metric grid of every city."""
    side = F.sequence(F.lit(-5).cast("long"), F.lit(4).cast("long"))
    return spark.read.parquet(f"{sf}/region.parquet").select(F.col("r_name").alias("city"), F.explode(side).alias("m")).withColumn("z", F.explode(side))


CELLS = "(SELECT r_name AS city, m, z FROM region CROSS JOIN range(-5, 5) AS a(m) CROSS JOIN range(-5, 5) AS b(z))"


def zero_filled(sql: str, names: tuple[str, ...]) -> str:
    """A query by city, m, z for all tiles of the grid, 0 where a tile has no row."""
    return f"SELECT city, m, z, {', '.join(f'coalesce({n}, 0)::DOUBLE AS {n}' for n in names)} FROM {CELLS} LEFT JOIN ({sql}) USING (city, m, z)"


def _cls(i: int) -> str:
    lo, hi = structures.CLASSES[i], (*structures.CLASSES[1:], 1e9)[i]
    return f"height >= {lo} AND height < {hi}"


@query(zero_filled(HEIGHT + TOUCH.format("h") + " SELECT city, m, z, " + ", ".join(f"round(sum(CASE WHEN {_cls(i)} THEN area_m2 ELSE 0 END) / 90000, 6) AS base_area_ratio_h{i}, count_if({_cls(i)})::DOUBLE AS n_buildings_h{i}" for i in range(5)) + ", " + ", ".join(f"round(avg({e}), 6) AS {n}_mean, round(stddev_pop({e}), 6) AS {n}_std" for e, n in (("area_m2", "base_area"), ("height", "height"), ("area_m2 * height", "volume"))) + ", round(sum(area_m2) / 90000, 6) AS building_density FROM t GROUP BY ALL", structures.BUILT))
def d6_built_features(spark, sf):
    f = structures.built_features(grid.cells_touched(_buildings(spark, sf), METRIC_TILE), METRIC_TILE**2)
    f = descriptors.filled(f, _cells(spark, sf))
    return f.select("city", "m", "z", *[r(c, 6) for c in f.columns[3:]])


@query(zero_filled(HEIGHT + TOUCH.format("h") + ", p AS (SELECT a.city, a.m, a.z, sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2)) AS d, least(a.height, b.height) AS hh FROM t a JOIN t b ON a.city = b.city AND a.m = b.m AND a.z = b.z AND a.structure_id < b.structure_id), g AS (SELECT city, m, z, " + ", ".join(f"avg(d) FILTER (hh >= {p}) AS a{p}, stddev_pop(d) FILTER (hh >= {p}) AS s{p}" for p in structures.PLANES) + " FROM p GROUP BY ALL) SELECT n.city, n.m, n.z, " + ", ".join(f"n{p} AS plane{p}_n, round(coalesce(a{p}, 0), 3) AS plane{p}_dist_mean, round(coalesce(s{p}, 0), 3) AS plane{p}_dist_std" for p in structures.PLANES) + " FROM (SELECT city, m, z, " + ", ".join(f"count_if(height >= {p})::DOUBLE AS n{p}" for p in structures.PLANES) + " FROM t GROUP BY ALL) n LEFT JOIN g USING (city, m, z)", structures.PLANED))
def d7_plane_features(spark, sf):
    f = descriptors.filled(structures.plane_features(grid.cells_touched(_buildings(spark, sf), METRIC_TILE)), _cells(spark, sf))
    return f.select("city", "m", "z", *[r(c, 3) for c in f.columns[3:]])


@query(zero_filled(f"WITH {cte('fx_structures')}" + TOUCH.format("fx_structures") + " SELECT city, m, z, " + ", ".join(f"round(count_if(kind = '{k}') / 0.09, 3) AS {n}_density, round(sum(CASE WHEN kind = '{k}' THEN area_m2 ELSE 0 END) / 90000, 6) AS {n}_area_share, count_if(kind = '{k}')::DOUBLE AS {n}_count" for k, n in (("water", "water"), ("vegetation", "veg"))) + " FROM t GROUP BY ALL", structures.COVER))
def d8_cover_features(spark, sf):
    f = descriptors.filled(structures.cover_features(grid.cells_touched(rows(spark, sf, "fx_structures"), METRIC_TILE), METRIC_TILE**2), _cells(spark, sf))
    return f.select("city", "m", "z", *[r(c, 6 if "share" in c else 3) for c in f.columns[3:]])


@query(f"WITH {cte('fx_dem')} SELECT floor(y / 300)::BIGINT AS m, floor(x / 300)::BIGINT AS z, " + ", ".join(f"round(min({c}), 6) AS {c}_min, round(avg({c}), 6) AS {c}_mean, round(stddev_pop({c}), 6) AS {c}_std" for c in ("asl", "agl")) + " FROM fx_dem GROUP BY ALL")
def d5_terrain_features(spark, sf):
    dem = rows(spark, sf, "fx_dem").withColumn("m", F.floor(F.col("y") / METRIC_TILE)).withColumn("z", F.floor(F.col("x") / METRIC_TILE))
    f = structures.terrain_features(dem, "m", "z")
    return f.select("m", "z", *[r(c, 6) for c in f.columns[2:]])


@query(HEIGHT + TOUCH.format("h") + """, p AS (SELECT a.city, a.m, a.z, a.structure_id AS a, b.structure_id AS b, sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2)) AS d FROM t a JOIN t b ON a.city = b.city AND a.m = b.m AND a.z = b.z AND a.structure_id <> b.structure_id),
kn AS (SELECT *, row_number() OVER (PARTITION BY city, m, z, a ORDER BY d, b) AS r FROM p) SELECT city, m, z, a, b, round(d, 3) AS d, round(1 / nullif(d, 0), 6) AS weight FROM kn WHERE r <= 4""")
def d12_neighbour_graph(spark, sf):
    g = structures.neighbour_graph(grid.cells_touched(_buildings(spark, sf), METRIC_TILE))
    return g.select("city", "m", "z", "a", "b", r("d", 3), r("weight", 6))


COVER = f"WITH {cte('fx_sites', 'fx_points')}, ed AS (SELECT candidate_id, point_id FROM fx_sites, fx_points WHERE pow(sx - px, 2) + pow(sy - py, 2) < 90000)"


RADIUS_M = 300.0


@query(COVER + " SELECT candidate_id, count(*) AS n FROM ed GROUP BY ALL")
def k1_cover_relation(spark, sf):
    return siting.disc_counts(rows(spark, sf, "fx_sites"), rows(spark, sf, "fx_points"), RADIUS_M)


def greedy_sql(name: str, edges: str) -> str:
    """CTE g_name of greedy steps over a CTE of edges until none gains: sites as bitmaps of their points, up to 150,000."""
    return f""", i_{name} AS (SELECT point_id, row_number() OVER (ORDER BY point_id) - 1 AS b FROM (SELECT DISTINCT point_id FROM {edges})),
b_{name} AS (SELECT candidate_id, bitstring_agg(b::INT, 0, 149999) AS bits FROM {edges} JOIN i_{name} USING (point_id) GROUP BY candidate_id),
r_{name} AS (SELECT -1 AS step, -1::BIGINT AS candidate_id, 0::BIGINT AS gain, any_value(bits) & ~any_value(bits) AS cov FROM b_{name}
  UNION ALL SELECT * FROM (SELECT step + 1, b.candidate_id::BIGINT, bit_count(bits & ~cov)::BIGINT AS gain, bits | cov FROM r_{name}, b_{name} b ORDER BY gain DESC, b.candidate_id LIMIT 1) WHERE gain > 0),
g_{name} AS (SELECT step::INT AS step, candidate_id, gain FROM r_{name} WHERE step >= 0)"""


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query(recursive(COVER + greedy_sql("all", "ed") + " SELECT * FROM g_all"))
def k2_greedy_cover(spark, sf):
    """All steps until no site gains."""
    return siting.greedy_cover(siting.disc_places(rows(spark, sf, "fx_sites"), rows(spark, sf, "fx_points"), RADIUS_M)).select("step", "candidate_id", "gain")


THRESHOLD_DBM = -62.0
#: Sites with the parameters of their station's measurements (half of them) and the conformal margin of the city's others.
POWER = f"""WITH RECURSIVE {cte('fx_sites', 'fx_points', 'fx_measurements')}, me AS (SELECT city, bs_id, l_orderkey % 2 = 0 AS fit, 10 * log10(greatest(dist_m, 1)) AS x, pathloss_db AS y FROM fx_measurements),
mo AS (SELECT bs_id, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) / nullif(var_pop(x), 0) AS gamma FROM me WHERE fit GROUP BY bs_id),
rs AS (SELECT city, abs(y - (my + gamma * (x - mx))) AS s FROM me JOIN mo USING (bs_id) WHERE NOT fit AND gamma IS NOT NULL),
mg AS (SELECT city, min(s) AS margin_db FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY s) AS k, count(*) OVER (PARTITION BY city) AS n FROM rs) WHERE k >= least(ceil((n + 1) * 0.9 - 1e-9), n) GROUP BY city),
pw AS (SELECT candidate_id, sx, sy, 30.0::DOUBLE + candidate_id % 10 AS p_tx_dbm, gamma, my - gamma * mx AS pl0, margin_db FROM fx_sites JOIN mo ON bs_id = candidate_id JOIN (SELECT DISTINCT city, bs_id FROM me) USING (bs_id) JOIN mg USING (city)),
rc AS (SELECT *, p_tx_dbm - pl0 - gamma * 10 * log10(greatest(sqrt(pow(sx - px, 2) + pow(sy - py, 2)), 1)) AS power FROM pw, fx_points WHERE gamma > 0),
en AS (SELECT candidate_id, point_id FROM rc WHERE power >= {THRESHOLD_DBM}), ea AS (SELECT candidate_id, point_id, power - margin_db AS power_dbm FROM rc WHERE power - margin_db >= {THRESHOLD_DBM})"""


def power_sites(spark, sf):
    """Sites with transmit power, the fit of their station's measurements (even order keys) and their city's conformal
    margin: the 0.9 quantile of the absolute errors of the fit on the other measurements."""
    m = rows(spark, sf).select("city", "bs_id", (F.col("l_orderkey") % 2 == 0).alias("fit"), radio.log_distance(F.col("dist_m")).alias("x"), F.col("pathloss_db").alias("y"))
    own = fits.with_least_squares(fits.statistics(m.where("fit"), "city", "bs_id")).where("gamma is not null").select("city", "bs_id", "gamma", "pl0")
    told = m.where("not fit").join(own, ["city", "bs_id"]).select("city", F.col("y").alias("truth"), (F.col("pl0") + F.col("gamma") * F.col("x")).alias("pred"))
    margin = metrics.conformal_quantile(told, "city", normalized=False).withColumnRenamed("q", "margin_db")
    sites = rows(spark, sf, "fx_sites").join(own, F.col("candidate_id") == F.col("bs_id")).join(margin, "city")
    return sites.select("candidate_id", "sx", "sy", (30.0 + F.col("candidate_id") % 10).alias("p_tx_dbm"), "gamma", "pl0", "margin_db")


@query(POWER + " SELECT candidate_id, count(*) AS n, sum(point_id)::BIGINT AS points, round(min(power_dbm), 3) AS least_dbm FROM ea GROUP BY candidate_id")
def k1_power_cover(spark, sf):
    """A candidate covers a point where the lower bound of its received power passes the threshold."""
    counts = siting.power_counts(power_sites(spark, sf), rows(spark, sf, "fx_points"), THRESHOLD_DBM)
    return counts.select("candidate_id", "n", "points", r("least_dbm", 3))


# ---- region polygons ----

#: All tiles of the box around a region, kept where a side enters the tile or the tile's centre is inside.
REGIONS = f"""WITH {cte("fx_corners")},
rc AS (SELECT city, atan2(avg(sin(radians(lat))), sqrt(pow(avg(cos(radians(lat)) * cos(radians(lon))), 2) + pow(avg(cos(radians(lat)) * sin(radians(lon))), 2))) AS lat0, atan2(avg(cos(radians(lat)) * sin(radians(lon))), avg(cos(radians(lat)) * cos(radians(lon)))) AS lon0 FROM fx_corners GROUP BY city),
rs AS (SELECT *, {TILE_M} / 6371000.0 AS dphi, {TILE_M} / (6371000.0 * abs(cos(lat0))) AS dlam FROM rc),
rp AS (SELECT city, k, round((radians(lon) - lon0) / dlam + 0.5, 9) AS x, round((radians(lat) - lat0) / dphi + 0.5, 9) AS y, lat0, lon0, dphi, dlam FROM fx_corners JOIN rs USING (city)),
re AS (SELECT city, x AS x0, y AS y0, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x1, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y1 FROM rp WINDOW w AS (PARTITION BY city ORDER BY k)),
rb AS (SELECT city, floor(min(x))::BIGINT AS xl, floor(max(x))::BIGINT AS xh, floor(min(y))::BIGINT AS yl, floor(max(y))::BIGINT AS yh FROM rp GROUP BY city),
rt AS (SELECT city, m, unnest(range(xl, xh + 1)) AS z FROM (SELECT *, unnest(range(yl, yh + 1)) AS m FROM rb)),
cl AS (SELECT city, m, z, x0, y0, x1, y1, x1 - x0 AS dx, y1 - y0 AS dy FROM rt JOIN re USING (city)),
tt AS (SELECT *, greatest(0, CASE WHEN dx <> 0 THEN least((z - x0) / dx, (z + 1 - x0) / dx) WHEN x0 >= z AND x0 < z + 1 THEN 0 ELSE 2 END, CASE WHEN dy <> 0 THEN least((m - y0) / dy, (m + 1 - y0) / dy) WHEN y0 >= m AND y0 < m + 1 THEN 0 ELSE 2 END) AS t0,
  least(1, CASE WHEN dx <> 0 THEN greatest((z - x0) / dx, (z + 1 - x0) / dx) ELSE 1 END, CASE WHEN dy <> 0 THEN greatest((m - y0) / dy, (m + 1 - y0) / dy) ELSE 1 END) AS t1 FROM cl),
kt AS (SELECT city, m, z FROM tt GROUP BY ALL HAVING bool_or(t0 <= t1) OR count(*) FILTER (least(y0, y1) <= m + 0.5 AND m + 0.5 < greatest(y0, y1) AND x0 + dx * (m + 0.5 - y0) / nullif(dy, 0) > z + 0.5) % 2 = 1)"""


def regions(spark, sf):
    """One polygon for each city: a concave star whose corners are at distances of their own."""
    corner = F.struct("k", F.struct(F.col("lon").alias("x"), F.col("lat").alias("y")).alias("p"))
    own = rows(spark, sf, "fx_corners").groupBy("city").agg(F.array_sort(F.collect_list(corner)).alias("c"))
    return own.select("city", F.transform("c", lambda e: e["p"]).alias("vertices"))


@query(REGIONS + " SELECT city, m, z, row_number() OVER (PARTITION BY city ORDER BY m, z) - 1 AS tile_index, round(degrees(lat0 + (m - 0.5) * dphi), 7) AS south, round(degrees(lon0 + (z + 0.5) * dlam), 7) AS east FROM kt JOIN rs USING (city)")
def c4_region_tiles(spark, sf):
    """The tiles of concave regions with their dense index."""
    return grid.tile_bounds(grid.region_tiles(regions(spark, sf), TILE_M)).select("city", "m", "z", "tile_index", r("south", 7), r("east", 7))


# ---- composite loss ----


@query(f"""SELECT model, round(avg(nll), 4) AS nll, round(any_value(physics), 3) AS physics, round(any_value(shift) * 1e6, 3) AS shift_u, round(avg(nll) + 0.1 * any_value(physics) + 0.1 * any_value(shift), 3) AS loss
FROM ({PRED} SELECT model, target, avg(0.5 * (2 * ln(sigma) + pow(truth - pred, 2) / (sigma * sigma))) AS nll FROM fx_predictions GROUP BY ALL) CROSS JOIN (SELECT avg(mse_db2) AS physics FROM ({ORACLE["e8_physics_residual"]})) CROSS JOIN (SELECT coral_u / 1e6 AS shift FROM ({ORACLE["l1_coral"]})) GROUP BY model""")
def i11_composite_loss(spark, sf):
    """Likelihood of the predictions, physics residual of the tile fits and shift of the descriptors in one number."""
    pts, par = placed(spark, sf)
    moments = fits.tile_moments(pts)
    physics = fits.physics_residual(fits.fit_ridge(grid.grid_tiles(par), moments, 100), moments)
    side = F.col("city").isin("c0", "c1").cast("int")
    shift = transfer.coral(rows(spark, sf, "fx_tiles").select(side.alias("side"), F.col("v").cast("array<double>").alias("v")))
    own = metrics.composite_loss(metrics.gaussian_nll(rows(spark, sf, "fx_predictions")), physics, shift)
    return own.select("model", r("nll"), r("physics", 3), r(F.col("shift") * 1e6, 3, "shift_u"), r("loss", 3))
