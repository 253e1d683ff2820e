"""Forms of operators whose work grows with the rows, against the plain ones."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from radiotiles.operators import descriptors, grid, paths, robustness, siting, structures, transfer

RAY = "city string, ray long, tx_lat double, tx_lon double, rx_lat double, rx_lon double, pathloss_db double"


def made_rays(spark, n=300):
    rng = np.random.default_rng(5)
    rows = [(c, i, *(float(40 + v) for v in rng.uniform(-0.01, 0.01, 4)), float(rng.uniform(80, 120))) for c in ("x", "y") for i in range(n)]
    rows += rows[:20] + [("x", 9999, None, 40.0, 40.0, 40.0, 90.0)]  # rays that are there twice, and one without an end
    rays = spark.createDataFrame(rows, RAY)
    return rays, grid.grid_parameters(grid.region_boxes(rays), 300.0).localCheckpoint()


def test_rays_fitted_in_tasks_are_those_fitted_by_pieces(spark):
    rays, par = made_rays(spark)
    got = {(r.city, r.m, r.z): r for r in paths.tile_path_fit(rays, par, ("ray",)).collect()}
    pieces = paths.ray_split_tiles(rays, par).withColumn("tile", (F.col("m") + 1000) * 10_000 + F.col("z") + 1000)
    rows = pieces.groupBy("city", "ray", "tile").agg(F.sum("len_m").alias("len"), F.first("pathloss_db").alias("y")).toPandas()
    for city, own in rows.groupby("city"):
        tiles, at = np.unique(own.tile, return_inverse=True)
        _, i = np.unique(own.ray, return_inverse=True)
        a, y = np.zeros((i.max() + 1, 2 * len(tiles))), np.zeros(i.max() + 1)
        total = np.maximum(np.bincount(i, own.len), 1.0)
        a[i, 2 * at], a[i, 2 * at + 1], y[i] = 10 * np.log10(np.maximum(own.len, 1.0)), own.len / total[i], own.y
        x = np.linalg.solve(a.T @ a + 1e-6 * np.eye(a.shape[1]), a.T @ y)
        mine = [got[city, t // 10_000 - 1000, t % 10_000 - 1000] for t in tiles]
        assert sum(k[0] == city for k in got) == len(tiles)
        assert [r.n for r in mine] == list(np.bincount(at))
        fitted = a @ np.array([v for r in mine for v in (r.gamma, r.pl0)])
        assert fitted == pytest.approx(a @ x, abs=1e-3)


def test_products_are_given_out_when_they_grow(monkeypatch):
    rng = np.random.default_rng(6)
    i, tile = np.repeat(np.arange(60), 3), np.concatenate([rng.choice(30, 3, replace=False) for _ in range(60)])
    length, y = rng.uniform(1, 300, 180), rng.uniform(80, 120, 60)

    def summed(most):
        monkeypatch.setattr(paths, "MOST_TILES", most)
        held, out = paths._Products(), {}
        for batch in [*held.add("x", i, tile, length, y), *held.rest()]:
            for r in batch.to_pylist():
                g, n = out.get((r["i"], r["j"]), (0.0, 0))
                out[r["i"], r["j"]] = g + r["g"], n + r["n"]
        return out

    whole, parts = summed(1000), summed(8)
    assert whole.keys() == parts.keys()
    assert all(parts[k] == (pytest.approx(g), n) for k, (g, n) in whole.items())


def test_lengths_by_tile_are_the_sums_of_pieces(spark):
    rays, par = made_rays(spark)
    got = {(r.mode, r.city, r.m, r.z): (r.n, r.len_m) for r in paths.lengths_by_tile(rays, par).collect()}
    for mode in paths.MODES:
        want = paths.ray_split_tiles(rays, par, mode).groupBy("city", "m", "z").agg(F.count("*").alias("n"), F.sum("len_m").alias("l")).collect()
        assert {k[1:]: v for k, v in got.items() if k[0] == mode} == {(r.city, r.m, r.z): (r.n, pytest.approx(r.l)) for r in want}
    whole = {r.city: r.d for r in rays.groupBy("city").agg(F.sum(111_000 * F.hypot(F.col("rx_lat") - F.col("tx_lat"), F.col("rx_lon") - F.col("tx_lon"))).alias("d")).collect()}
    for city, d in whole.items():
        assert math.fsum(v[1] for k, v in got.items() if k[:2] == ("deg111", city)) == pytest.approx(d)


SITE = "candidate_id long, sx double, sy double, p_tx_dbm double, gamma double, pl0 double, margin_db double"


def crowded(spark):
    """Sites and points of which many share a place, one of each with two places."""
    rng = np.random.default_rng(7)
    spots = [(float(x), float(y)) for x, y in rng.integers(-20, 20, (12, 2)) * 25]
    sites = [(int(i), *spots[rng.integers(12)], float(rng.integers(15, 45)), float(rng.choice([2.0, 2.5, 3.0])), 56.0, 1.0) for i in rng.permutation(60)]
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.integers(-20, 20, (400, 2)) * 50)]
    points += [(i + 1000, x, y) for i, x, y in points[:300]] + [(3, 10.0, 10.0)]
    sites.append((sites[0][0], 500.0, 500.0, *sites[0][3:]))
    return spark.createDataFrame(sites, SITE), spark.createDataFrame(points, "point_id long, px double, py double")


def steps_of(edges):
    return [(r.candidate_id, r.gain) for r in siting.greedy_cover(edges).orderBy("step").collect()]


def test_steps_by_places_are_those_of_all_pairs(spark):
    sites, points = crowded(spark)
    plain, merged = siting.cover_edges(sites, points, 300.0), siting.disc_places(sites, points, 300.0)
    assert len(steps_of(plain)) > 3 and steps_of(merged) == steps_of(plain) and merged.count() * 2 < plain.count()
    plain, merged = siting.cover_by_power(sites, points, -62.0), siting.power_places(sites, points, -62.0)
    assert len(steps_of(plain)) > 3 and steps_of(merged) == steps_of(plain) and merged.count() * 2 < plain.count()


def test_counts_by_places_are_those_of_all_pairs(spark):
    sites, points = crowded(spark)
    want = siting.cover_edges(sites, points, 300.0).groupBy("candidate_id").count()
    assert {tuple(r) for r in siting.disc_counts(sites, points, 300.0).collect()} == {tuple(r) for r in want.collect()}
    want = siting.cover_by_power(sites, points, -62.0).groupBy("candidate_id").agg(F.count("*"), F.sum("point_id"), F.min("power_dbm"))
    assert {tuple(r) for r in siting.power_counts(sites, points, -62.0).collect()} == {tuple(r) for r in want.collect()}


def test_placement_writes_its_tables_once(spark, monkeypatch):
    sites, points = crowded(spark)
    station = {"p_tx_dbm": 35.0, "gamma": 2.5, "pl0": 42.0, "margin_db": 2.0}
    written, plain = [], siting.stage
    monkeypatch.setattr(siting, "stage", lambda df, name: written.append((name, df.count())) or plain(df, name))
    steps = siting.median_placement(sites, points, threshold_dbm=-62.0, station=station, max_steps=3).orderBy("step").collect()
    left, all_sites, used = [tuple(r) for r in points.collect()], sites.collect(), set()
    power = lambda q, x, y: q["p_tx_dbm"] - q["margin_db"] - q["pl0"] - q["gamma"] * 10 * math.log10(max(math.hypot(*[a - b for a, b in zip((x, y), q["at"], strict=True)]), 1.0))
    for r in steps:
        x, y = np.median([p[1] for p in left]), np.median([p[2] for p in left])
        _, _, px, py = min((math.sqrt((p[1] - x) ** 2 + (p[2] - y) ** 2), *p) for p in left)
        own = [q.asDict() | {"at": (q.sx, q.sy)} for q in all_sites if q.candidate_id not in used]
        near = [(-power(q, px, py), q["candidate_id"], q["sx"], q["sy"], q) for q in own if power(q, px, py) >= -62.0]
        best = min(near, key=lambda n: n[:4])[4] if near else station | {"at": (x, y), "candidate_id": None}
        used.add(best["candidate_id"])
        after = [p for p in left if power(best, *p[1:]) < -62.0]
        assert (r.candidate_id, r.gain) == (best["candidate_id"], len(left) - len(after))
        left = after
    assert ("sites", sites.count()) in written and written[0] == ("left", points.select("px", "py").distinct().count())


def test_clipping_names_each_step_once(spark):
    # each of four sides names the polygon it cuts several times: written out in full that is some hundred copies
    box = [F.lit(float(v)) for v in (0, 0, 10, 10)]
    assert len(str(grid.clip_to_box(F.col("v"), *box))) < 30_000
    rows = [(i, [(5.0 + i, -3.0), (17.0 + i, 4.0), (6.0 + i, 9.0), (7.0 + i, 2.0)]) for i in range(4)] + [(9, [(1.0, 1.0), (4.0, 1.0), (1.0, 4.0)])]
    got = grid.clipped_polygons(spark.createDataFrame(rows, "id long, vertices array<struct<x: double, y: double>>"), 10.0)
    area = {r.id: r.a for r in got.groupBy("id").agg(F.sum("area_m2").alias("a")).collect()}
    want = {i: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(v, v[1:] + v[:1], strict=True))) / 2 for i, v in rows}
    assert area == pytest.approx(want)


def recorded(monkeypatch, module):
    """What a module writes: (name, rows, table)."""
    written, plain = {}, module.stage

    def keep(df, name):
        written[name] = plain(df, name)
        return written[name]

    monkeypatch.setattr(module, "stage", keep)
    return written


def buildings(spark):
    """Crowded tiles of which many buildings share a place, with a far one, ids that are there twice, and a null."""
    rng = np.random.default_rng(8)
    spots = rng.integers(0, 60, (150, 2)) * 1.0
    rows = [("x", 0, 0, int(i), *map(float, spots[rng.integers(150)]), float(rng.integers(1, 120))) for i in rng.permutation(500)]
    rows += [("x", 0, 1, i, float(rng.uniform(0, 300)), float(rng.uniform(0, 300)), 20.0) for i in range(150)]
    rows += [("x", 0, 0, 900, 4000.0, -50.0, 70.0), ("x", 0, 0, 7, 3.5, 3.5, 65.0), ("x", 0, 1, 9, 1.0, 1.0, 20.0), ("x", 0, 1, 901, None, 3.0, 20.0), ("y", 2, 2, 1, 0.0, 0.0, 9.0), ("y", 2, 2, 2, 1.0, 0.0, 3.0)]
    return rows, spark.createDataFrame(rows, "city string, m long, z long, structure_id long, cx double, cy double, height double")


def test_neighbours_are_found_by_places_and_blocks(spark, monkeypatch):
    rows, df = buildings(spark)
    written, want = recorded(monkeypatch, structures), set()
    got = {(r.city, r.m, r.z, r.a, r.b, round(r.d, 9)) for r in structures.neighbour_graph(df, per_block=12).collect()}
    for tile in {r[:3] for r in rows}:
        own = [r for r in rows if r[:3] == tile and r[4] is not None]
        for a in {r[3] for r in own}:
            near = sorted((math.hypot(p[4] - q[4], p[5] - q[5]), q[3]) for p in own if p[3] == a for q in own if q[3] != a)
            want |= {(*tile, a, b, round(d, 9)) for d, b in near[:4]}
    assert got == want
    # places, not buildings, meet, and the far one does not put all others into one block
    assert written["blocks"].where("m = 0 and z = 0").count() <= 153
    assert written["blocks"].groupBy("city", "m", "z", "bx", "by").count().agg(F.max("count")).first()[0] <= 40


def test_planes_are_summed_by_places(spark, monkeypatch):
    rows, _ = buildings(spark)
    rows = [r for r in rows if r[4] is not None]
    rows += [("z", 0, 0, i, *r[4:6], r[6]) for i, r in enumerate(rows[:500])] + [("z", 0, 0, 3, 5.5, 7.25, 200.0)]  # a lattice of a quarter
    df = spark.createDataFrame(rows, "city string, m long, z long, structure_id long, cx double, cy double, height double")
    written, blocks = recorded(monkeypatch, structures), []
    plain = structures.block_pairs
    monkeypatch.setattr(structures, "block_pairs", lambda a, *more, **named: blocks.append(a.count()) or plain(a, *more, **named))
    got = {(r.city, r.m, r.z): r for r in structures.plane_features(df).collect()}
    for tile in {r[:3] for r in rows}:
        own = [r for r in rows if r[:3] == tile]
        for p in structures.PLANES:
            high = [r for r in own if r[6] >= p]
            d = [math.hypot(a[4] - b[4], a[5] - b[5]) for a in high for b in high if a[3] < b[3]]
            want = (len(high), np.mean(d) if d else 0.0, np.std(d) if d else 0.0)
            assert tuple(got[tile][f"plane{p}_{c}"] for c in ("n", "dist_mean", "dist_std")) == pytest.approx(want, rel=1e-6, abs=1e-4), (tile, p)
    # 500 buildings at 151 places; pairs of places meet only where no lattice holds them
    assert written["places"].where("city = 'x' and m = 0 and z = 0").count() <= 152
    assert len(rows) > 1150 and blocks[0] < 310


def test_pixels_are_filled_band_by_band(spark, monkeypatch):
    rng = np.random.default_rng(9)
    kinds = ["building", "vegetation", "water", None]
    rows = [("x" if i % 3 else "y", kinds[i % 4], None if i % 11 == 0 else float(rng.integers(1, 90)), *map(float, rng.uniform(-90, 90, 2)), *map(float, rng.uniform(5, 40, 2))) for i in range(300)]
    df = spark.createDataFrame(rows, "city string, kind string, height double, cx double, cy double, width_m double, depth_m double")
    terrain = spark.createDataFrame([(3.0, 3.0, 7.0)], "x double, y double, asl double")
    size, want, sent, plain = 100 / 16, {}, [], descriptors._covered
    monkeypatch.setattr(descriptors, "_covered", lambda s, strips, n: sent.append(s.count()) or plain(s, strips, n))
    for city, kind, height, cx, cy, w, d in rows:
        for y in range(-20, 20):
            for x in range(-20, 20):
                if cx - w / 2 <= (x + 0.5) * size < cx + w / 2 and cy - d / 2 <= (y + 0.5) * size < cy + d / 2:
                    want.setdefault((city, y // 16, x // 16, y % 16, x % 16), []).append((kind, height))
    for k, v in want.items():
        tall, known = [h for q, h in v if q == "building" and h is not None], [q for q, _ in v if q is not None]
        want[k] = (max(tall, default=0.0), *(int(q in known) if known else None for q in kinds[1:3]))
    corners = F.array(*[F.struct((F.col("cx") + a * F.col("width_m") / 2).alias("x"), (F.col("cy") + b * F.col("depth_m") / 2).alias("y")) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))])
    for made in (descriptors.rasterised(grid.cells_touched(df, 100.0), terrain, 100.0, 16), descriptors.rasterised_polygons(df.withColumn("vertices", corners), terrain, 100.0, 16)):
        got = {(r.city, r.m, r.z, r.py, r.px): (r.building_height, r.vegetation, r.water) for r in made.collect()}
        assert got == want
    assert max(sent) < 6 * len(rows)  # shapes are sent, by tile and band, and not their pixels


def test_blocks_of_kernels_meet_once(spark, monkeypatch):
    rng = np.random.default_rng(10)
    v, side = rng.normal(0, 0.5, (70, 5)), rng.integers(0, 2, 70)
    df = spark.createDataFrame([(i, int(side[i]), v[i].tolist()) for i in range(70)], "tile long, side int, v array<double>")
    d2 = ((v[:, None] - v[None]) ** 2).sum(2)
    k = sum(np.exp(-d2 / (2 * s * s)) for s in transfer.WIDTHS) / len(transfer.WIDTHS)
    want = sum((1 if i == j else -1) * k[np.ix_(side == i, side == j)].mean() for i in (0, 1) for j in (0, 1))
    for per_block in (20, 1000):
        assert transfer.mmd2(df, per_block=per_block).first()[0] == pytest.approx(want)
    for s, got in transfer._kernels(d2, transfer.SIGMAS).items():
        assert got == pytest.approx(np.exp(-d2 / (2 * s * s)), rel=1e-9, abs=1e-300)
    y = rng.normal(size=(70, 3))
    monkeypatch.setattr(transfer, "TALL", 16)
    monkeypatch.setattr(transfer, "WIDE", 9)
    got = transfer.kernel_products(v, v[:50], y[:50], transfer.SIGMAS)
    assert all(got[i] == pytest.approx(np.exp(-d2[:, :50] / (2 * s * s)) @ y[:50]) for i, s in enumerate(transfer.SIGMAS))
    # a fold of 4,000 tiles is one block: a row is sent once, not once for each 2,000 of the other side
    many = spark.range(4000).select(F.lit("f").alias("fold"), F.col("id").alias("tile"), F.array(F.col("id") / 1000).alias("v"), F.lit(1.0).alias("gamma"), F.lit(2.0).alias("pl0"))
    assert transfer.PER_BLOCK >= 4000 and transfer.gaussian_predict(many, many, 1.0).agg(F.count("*"), F.max(F.abs(F.col("gamma_pred") - 1))).first() == (4000, pytest.approx(0))


def test_climate_is_worked_out_by_places(spark, monkeypatch):
    cube = spark.createDataFrame([(i, j, t, 1 + t % 2, float(10 * i + j + t)) for i in range(3) for j in range(3) for t in range(6)], "gi long, gj long, time long, month long, t2m double")
    points = spark.createDataFrame([(i, 0.25 + (i % 4) / 4, 0.5) for i in range(40)], "point_id long, lat double, lon double")
    written = recorded(monkeypatch, robustness)
    got = {(r.point_id, r.month): (r.t2m_mean, r.t2m_std) for r in robustness.climate_features(cube, points, ("t2m",)).collect()}
    times = {1: (0, 2, 4), 2: (1, 3, 5)}
    want = {(i, m): (10 * (0.25 + (i % 4) / 4) + 0.5 + np.mean(t), np.std(t)) for i in range(40) for m, t in times.items()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert written["places"].count() == 4 * 2
