"""Planted truths: rays over two tiles, stations among two clusters, published positions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from radiotiles.functions import geo
from radiotiles.operators import descriptors, folds, paths, robustness, siting


def test_a_ray_is_cut_where_it_crosses_lines(spark):
    rays = spark.createDataFrame([(1, 10.0, 10.0, 250.0, 10.0), (2, 5.0, 5.0, 5.0, 5.0)], "ray int, tx_x double, tx_y double, rx_x double, rx_y double")
    got = [(r.ray, r.m, r.z, round(r.len_m, 6)) for r in paths.ray_split(rays, 100.0).orderBy("ray", "z").collect()]
    assert got == [(1, 0, 0, 90.0), (1, 0, 1, 100.0), (1, 0, 2, 50.0)]


def test_mixed_path_finds_the_planted_tiles(spark):
    rng = np.random.default_rng(3)
    gamma, pl0, rows = (2.0, 3.5), (20.0, 35.0), []
    for i in range(600):
        a, b = (float(x) for x in rng.uniform(20, 200, 2))
        y = sum(10 * g * np.log10(s) + p * s / (a + b) for g, p, s in zip(gamma, pl0, (a, b), strict=True))
        rows += [("x", i, t, s, float(y)) for t, s in enumerate((a, b))]
    seg = spark.createDataFrame(rows, "city string, ray long, tile long, len_m double, pathloss_db double")
    got = {r.tile: r for r in paths.mixed_path_fit(seg).collect()}
    for t in (0, 1):
        assert got[t].n == 600 and got[t].gamma == pytest.approx(gamma[t], abs=0.01) and got[t].pl0 == pytest.approx(pl0[t], abs=0.1)


def test_cities_beyond_one_task_are_solved_alike(spark):
    rng = np.random.default_rng(4)
    rows = []
    for city, tiles in (("x", 2), ("y", 4), ("z", 3)):
        for i in range(200):
            cut = [(t, float(rng.uniform(20, 200))) for t in range(tiles) if t != i % 5]
            y = float(rng.uniform(80, 140)) if city != "z" else 0.0  # all zero: nothing to solve
            rows += [(city, i, t, s, y) for t, s in cut]
    seg = spark.createDataFrame(rows, "city string, ray long, tile long, len_m double, pathloss_db double")
    dense = {(r.city, r.tile): r for r in paths.mixed_path_fit(seg).collect()}
    split = {(r.city, r.tile): r for r in paths.mixed_path_fit(seg, max_unknowns=4).collect()}
    assert len(dense) == 9 and dense.keys() == split.keys()
    for k, r in dense.items():
        assert split[k].n == r.n and split[k].gamma == pytest.approx(r.gamma, abs=1e-5) and split[k].pl0 == pytest.approx(r.pl0, abs=1e-4)


def test_median_placement_takes_a_site_then_a_new_station(spark):
    points = spark.createDataFrame([(i, float(i), 0.0) for i in range(5)] + [(10, 1000.0, 0.0)], "point_id long, px double, py double")
    sites = spark.createDataFrame([(7, 3.0, 0.0), (8, 4.0, 0.0)], "candidate_id long, sx double, sy double")
    got = [tuple(r) for r in siting.median_placement(sites, points, 50.0).collect()]
    assert got == [(0, 7, 3.0, 0.0, 5), (1, None, 1000.0, 0.0, 1)]


def test_median_placement_ends_where_a_step_changes_nothing(spark):
    # a ring around an empty middle: the new station at the median reaches no point
    ring = [(i, 100 * float(np.cos(i * np.pi / 4)), 100 * float(np.sin(i * np.pi / 4))) for i in range(8)]
    points = spark.createDataFrame(ring, "point_id long, px double, py double")
    sites = spark.createDataFrame([(7, 100.0, 0.0)], "candidate_id long, sx double, sy double")
    steps = siting.median_placement(sites.where("false"), points, 50.0)
    assert [(r.step, r.candidate_id, r.gain, r.uncovered) for r in siting.with_uncovered(steps, points).collect()] == [(0, None, 0, 8)]
    assert siting.median_placement(sites, points.where("false"), 50.0).count() == 0


def test_median_placement_goes_on_past_twelve_steps(spark):
    xs = [1000.0 * i for i in range(15)]
    points = spark.createDataFrame([(i, x, 0.0) for i, x in enumerate(xs)], "point_id long, px double, py double")
    sites = points.selectExpr("point_id AS candidate_id", "px AS sx", "py AS sy")
    last = siting.with_uncovered(siting.median_placement(sites, points, 50.0), points).orderBy("step").collect()[-1]
    assert (last.step, last.uncovered) == (14, 0)


def test_the_registered_median_placement_is_the_whole_one(spark):
    from radiotiles.plans import extended  # noqa: F401
    from radiotiles.plans import queries as plans

    got = plans.QUERIES["k4_median_placement"](spark, "/root/testdata/sf0.001").orderBy("step").collect()
    assert len(got) == 3 and got[-1].candidate_id is None and (got[-1].gain, got[-1].uncovered) == (0, 138)


def test_local_frame_has_the_known_grid_position_and_goes_back(spark):
    # the tower in Toronto: zone 17, 630084 m east, 4833438 m north
    one = spark.range(1).select(F.lit(43.642567).alias("lat"), F.lit(-79.387139).alias("lon"))
    e, n = geo.utm(F.col("lat"), F.col("lon"), geo.utm_zone(F.col("lon")), F.col("lat") < 0)
    row = one.select(e.alias("e"), n.alias("n")).first()
    assert abs(row.e - 630084) < 1 and abs(row.n - 4833438) < 1
    lat, lon = geo.utm_inverse(F.lit(row.e), F.lit(row.n), F.lit(17), F.lit(False))
    back = one.select(lat.alias("a"), lon.alias("o")).first()
    assert abs(back.a - 43.642567) < 1e-7 and abs(back.o + 79.387139) < 1e-7


def test_noise_has_its_spread_and_climate_its_order(spark):
    tiles = spark.range(200).select(F.col("id").alias("tile"), F.array_repeat(F.lit(0.0), 64).alias("v"))
    by = {r.level: r.s for r in robustness.noisy(tiles, (0.0, 0.4)).select("level", F.explode("v").alias("x")).groupBy("level").agg(F.stddev_pop("x").alias("s")).collect()}
    assert by[0.0] == 0 and abs(by[0.4] - 0.4) < 0.01
    cube = spark.createDataFrame([(i, j, t, t % 12 + 1, 280.0 + i + 2 * j, float(t % 12), 5.0) for i in (0, 1) for j in (0, 1) for t in range(24)], "gi long, gj long, time int, month int, t2m double, rh double, tp double")
    at = spark.createDataFrame([(1, 0.5, 0.25), (2, 1.5, 0.5)], "point_id long, lat double, lon double")
    out = descriptors.by_month(robustness.climate_features(cube, at, descriptors.VARIABLES, kelvin=("t2m",)), "point_id").collect()
    assert len(out) == 1 and out[0].point_id == 1
    for month in range(12):  # by month, then variable, mean and spread
        assert list(out[0])[1 + 6 * month : 7 + 6 * month] == pytest.approx([281.0 - 273.15, 0, month, 0, 5, 0])


@pytest.mark.parametrize("n_sites", [4, 60])
def test_rooftop_sites_agree_with_a_plain_loop(spark, n_sites):
    rng = np.random.default_rng(5)
    rows = [("x", i, float(x), float(y), float(h)) for i, (x, y, h) in enumerate(zip(rng.uniform(-500, 500, 300), rng.uniform(-500, 500, 300), rng.integers(3, 40, 300), strict=True))]
    made = siting.rooftop_sites(spark.createDataFrame(rows, "city string, structure_id long, cx double, cy double, height double"), n_sites, 3.0)
    got = {r["rank"]: (r["structure_id"], r["z"]) for r in made.collect()}
    cells = {}
    for _, i, x, y, h in rows:
        if h > 6:
            key = (x // 25, y // 25)
            cells[key] = min(cells.get(key, (0.0, 0, 0.0, 0.0)), (-h, i, x, y))
    taken = []
    for p in sorted(cells.values()):
        if len(taken) < n_sites and all(np.hypot(p[2] - t[2], p[3] - t[3]) >= 250 for t in taken):
            taken.append(p)
    assert [got[k] for k in range(len(taken))] == [(p[1], 3.0 - p[0]) for p in taken]
    assert len(got) == min(n_sites, len(cells)) and len({v[0] for v in got.values()}) == len(got)


def test_model_report_holds_every_test(spark):
    scores = spark.createDataFrame([(m, f"f{k}", 1.0 + 0.1 * k + add * (k + 1)) for k in range(8) for m, add in (("a", 0.0), ("b", 0.5), ("c", (-1) ** k * 0.01))], "model string, fold string, value double")
    got = {r.model: r for r in folds.model_report(scores, 200).collect()}
    assert set(got) == {"b", "c"} and got["b"].reference == "a"
    assert got["b"].rejected and got["b"].significant and not got["c"].rejected and got["b"].p_w == pytest.approx(2 / 256)
