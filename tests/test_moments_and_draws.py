"""Fits from merged statistics, draws by least hash, block estimates, and the way from raw rows to fold scores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from radiotiles.functions.radio import hash_rank_key
from radiotiles.operators import draws, fits, transfer
from radiotiles.plans import extended, more  # noqa: F401
from radiotiles.plans import queries as plans


def points(spark, rng, n=3000):
    rows = [("xy"[i % 2], int(rng.integers(0, 3)), int(rng.integers(0, 2)), int(rng.integers(0, 9)), float(rng.uniform(10, 35)), 0.0) for i in range(n)]
    rows = [(*r[:5], 40 + 2.2 * r[4] + float(rng.normal())) for r in rows]
    return spark.createDataFrame(rows, "city string, m int, z int, bs_id int, x double, y double"), rows


def test_merged_statistics_are_those_of_the_rows(spark):
    df, rows = points(spark, np.random.default_rng(1))
    far = df.withColumn("y", F.col("y") + 1e7)  # far from 0: digits would be lost without a shift
    for frame, add in ((df, 0.0), (far, 1e7)):
        moments = fits.station_moments(frame)
        for keys in (("city",), ("city", "m", "z")):
            got = {tuple(r[k] for k in keys): r for r in fits.merged(moments, *keys).collect()}
            want = {}
            for r in rows:
                want.setdefault((r[0],) if len(keys) == 1 else (r[0], r[1], r[2]), []).append((r[4], r[5] + add))
            assert got.keys() == want.keys()
            for k, own in want.items():
                x, y = np.array(own).T
                r = got[k]
                assert r.n == len(own) and r.mx == pytest.approx(x.mean()) and r.my == pytest.approx(y.mean())
                assert r.cxx == pytest.approx(((x - x.mean()) ** 2).sum(), rel=1e-9)
                assert r.cxy == pytest.approx(((x - x.mean()) * (y - y.mean())).sum(), rel=1e-6)
                assert r.cyy == pytest.approx(((y - y.mean()) ** 2).sum(), rel=1e-6)


def test_all_fits_come_from_one_pass(spark):
    df, rows = points(spark, np.random.default_rng(2))
    seen = spark.sparkContext.accumulator(0)
    counted = df.rdd.map(lambda r: (seen.add(1), r)[1]).toDF(df.schema)
    moments, tiles = fits.station_moments(counted), df.select("city", "m", "z").distinct()
    fitted = fits.fit_ridge(tiles, moments)
    noise = fits.noise_summary(fitted, fits.split_half(moments, 20)).collect()
    assert len(noise) == 2 and fits.physics_residual(fitted, moments).count() == 2 and fits.fit_global(moments).count() == 2
    assert seen.value == len(rows)
    plan = fits.noise_summary(fitted, fits.split_half(moments, 20))._jdf.queryExecution().executedPlan().toString()
    assert "moments" in plan
    # the error of the tiles' parameters, from the rows
    par = {(r.city, r.m, r.z): r for r in fitted.collect()}
    for city, mse in fits.physics_residual(fitted, moments).collect():
        e = [par[r[0], r[1], r[2]].pl0 + par[r[0], r[1], r[2]].gamma * r[4] - r[5] for r in rows if r[0] == city]
        assert mse == pytest.approx(np.mean(np.square(e)), rel=1e-8)


@pytest.mark.parametrize("digits", [1, 3])
def test_least_hashes_of_a_group(spark, digits):
    rng = np.random.default_rng(3)
    rows = [(g, int(i)) for g, n in (("a", 900), ("b", 7), (None, 40), ("c", 1)) for i in rng.integers(0, 500, n)]
    df = spark.createDataFrame(rows, "g string, i long").repartition(3)
    key = hash_rank_key(0, F.col("i"))
    hashed = {r.i: r.h for r in df.select("i", key.alias("h")).collect()}
    for limit in (lambda n: F.lit(0), lambda n: F.lit(5), lambda n: F.floor(n * 0.3), lambda n: n, lambda n: F.lit(10_000)):
        got = draws.flag_least(df, ("g",), key, ("i",), limit, "in", digits)
        assert got.columns == ["g", "i", "in"]
        own = {}
        for r in got.collect():
            own.setdefault(r.g, []).append((hashed[r.i], r.i, not r["in"]))
        sizes = {g: sum(1 for x, _ in rows if x == g) for g in ("a", "b", None, "c")}
        for g, found in own.items():
            assert len(found) == sizes[g]
            n = spark.range(1).select(limit(F.lit(sizes[g])).alias("k")).first().k
            want = sorted((h, i) for h, i, _ in found)[: int(n)]
            assert sorted((h, i) for h, i, out in found if not out) == want
    assert draws.flag_least(df.where("false"), ("g",), key, ("i",), lambda n: F.lit(1), "in").count() == 0


def test_block_estimate_is_near_the_exact_discrepancy(spark):
    rng = np.random.default_rng(4)
    for shift in (0.0, 0.8):
        x = rng.normal(size=(1200, 4)) + np.where(np.arange(1200) % 3 == 0, shift, 0.0)[:, None]
        x[:300] = x[0]  # copies of one row lie in all blocks
        df = spark.createDataFrame([(i, int(i % 3 == 0), x[i].tolist()) for i in range(1200)], "tile long, side int, v array<double>")
        exact = transfer.mmd2(df).first().mmd2
        told = transfer.mmd2_blocks(df, per_block=100).first()
        assert told.n_blocks == 12 and 0 < told.error < 0.1 and abs(told.mmd2 - exact) < 3 * told.error
    one = transfer.mmd2_blocks(df, per_block=5000).first()  # all pairs
    assert one.mmd2 == pytest.approx(exact, abs=1e-9) and one.error is None and one.n_blocks == 1


def test_fold_scores_follow_from_the_tiles(spark):
    sf = "/root/testdata/sf0.001"
    tiles = more.described_tiles(spark, sf).collect()
    got = {(r.model, r.fold, r.target): r for r in plans.QUERIES["h_fold_scores"](spark, sf).collect()}
    cities = sorted({t.city for t in tiles})
    assert len(tiles) > 100 and len(got) == 4 * len(cities) * 2 and len(tiles[0].v) == 116
    roles = {}
    from radiotiles.operators import splits

    for r in splits.leave_one_city_out(spark.createDataFrame([(c,) for c in cities], "city string")).collect():
        roles[r.fold, r.city] = r.role
    for fold in cities:
        train, test = [t for t in tiles if roles[fold, t.city] == "train"], [t for t in tiles if t.city == fold]
        x, z = np.array([t.v for t in train]), np.array([t.v for t in test])
        scale = np.abs(x).max(0)
        scale[scale == 0] = 1
        for target in ("gamma", "pl0"):
            y, truth = np.array([t[target] for t in train]), np.array([t[target] for t in test])
            c = x / scale - (x / scale).mean(0)
            w = np.linalg.solve(c.T @ c + np.eye(116), c.T @ (y - y.mean()))
            ridge = y.mean() + (z / scale - (x / scale).mean(0)) @ w
            for model, pred in (("median", np.median(y)), ("ridge", ridge)):
                r = got[model, fold, target]
                assert r.n == len(test) and r.rmse == pytest.approx(np.sqrt(np.mean((pred - truth) ** 2)), abs=2e-4)


def test_noise_and_left_out_groups_make_errors_larger(spark):
    got = {(r.target, r.without, r.level): r for r in plans.QUERIES["d14_robustness_errors"](spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == 2 * 5 * 4 and len({r.n for r in got.values()}) == 1
    for target in ("gamma", "pl0"):
        clean = [got[target, "none", level].rmse for level in (0.0, 0.1, 0.2, 0.4)]
        assert clean == sorted(clean) and clean[-1] > 2 * clean[0]
        assert got[target, "topographic", 0.0].rmse > 2 * clean[0]  # the fixture's targets depend on the first three values


def test_scans_prune_cities_and_columns(spark, tmp_path):
    from radiotiles.sources import tables

    rows = spark.createDataFrame([("1", 3500.0, *[float(k)] * 8, None, c) for c in "abc" for k in range(3)], tables.MEASUREMENTS)
    tables.write_tiles(rows, str(tmp_path / "m"))
    scan = tables.scan_measurements(spark, str(tmp_path / "m"), ["a", "c"]).select("city", "pathloss_db").where("pathloss_db > 0")
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [city" in plan and "GreaterThan(pathloss_db,0.0)" in plan and "ReadSchema: struct<pathloss_db:double>" in plan
    assert {r.city for r in scan.collect()} == {"a", "c"}
    tiles = spark.createDataFrame([("a", 12, 2.0), ("b", 50, 2.0), ("c", 11, None), ("a", 3, 2.0)], "city string, n_measurements int, gamma double")
    assert [(r.city, r.n_measurements) for r in tables.scan_tiles(tiles, ["a", "c"]).collect()] == [("a", 12)]


def test_largest_values_by_city(spark):
    t = spark.createDataFrame([("a", [1.0, -3.0, 0.0]), ("a", [2.0, 1.0, 0.0]), ("b", [0.5, 0.0, 7.0])], "city string, v array<double>")
    assert {r.city: r.scale for r in transfer.column_max(t, "city").collect()} == {"a": [2.0, 3.0, 1.0], "b": [0.5, 1.0, 7.0]}
