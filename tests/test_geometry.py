"""Polygons, scene boxes, rasters, vectors and covers against plain Python."""

import math

import pytest
from pyspark.sql import functions as F

from radiotiles.functions import geo
from radiotiles.operators import descriptors, grid, siting


def polygons(spark, shapes):
    rows = [(i, [(float(x), float(y)) for x, y in s]) for i, s in shapes.items()]
    return spark.createDataFrame(rows, "id long, vertices array<struct<x: double, y: double>>")


def test_polygons_are_cut_by_tiles(spark):
    shapes = {1: [(-5, -5), (15, -5), (15, 5), (-5, 5)], 2: [(1, 1), (25, 1), (1, 25)], 3: [(2, 2), (8, 2), (8, 8), (5, 4), (2, 8)], 4: [(0, 0), (10, 0)], 5: []}
    got = {(r["id"], r["m"], r["z"]): r["area_m2"] for r in grid.clipped_polygons(polygons(spark, shapes), 10.0).collect()}
    assert {k: v for k, v in got.items() if k[0] == 1} == {(1, -1, -1): 25, (1, -1, 0): 50, (1, -1, 1): 25, (1, 0, -1): 25, (1, 0, 0): 50, (1, 0, 1): 25}
    assert sum(v for k, v in got.items() if k[0] == 2) == pytest.approx(288)
    assert got[2, 0, 0] == pytest.approx(81) and got[2, 1, 1] == pytest.approx(18) and got[2, 0, 1] == pytest.approx(82)
    assert {k: v for k, v in got.items() if k[0] >= 3} == {(3, 0, 0): pytest.approx(24)}


def test_area_and_centroid(spark):
    shapes = {1: [(0, 0), (4, 0), (4, 2), (0, 2)], 2: [(0, 2), (4, 2), (4, 0), (0, 0)], 3: [(0, 0), (6, 0), (6, 6), (3, 2), (0, 6)], 4: [(0, 0), (1, 0), (1, 1)]}
    got = {r["id"]: (r["area_m2"], r["cx"], r["cy"]) for r in grid.footprints(polygons(spark, shapes)).collect()}
    assert got[1] == got[2] == (8.0, 2.0, 1.0)
    assert got[3] == (24.0, 3.0, pytest.approx((36 * 3 - 12 * (2 + 6 + 6) / 3) / 24)) and 4 not in got


def test_scene_box_holds_its_corners(spark):
    lat0, lon0 = 48.1, 11.6
    origin = spark.createDataFrame([("c", lat0, lon0)], "city string, lat0 double, lon0 double")
    r = [x for pad in (0.0, 500.0) for x in list(grid.scene_boxes(origin, 2000.0, pad).first())[1:]]
    for (s, w, n, e), half in ((r[:4], 1000), (r[4:], 1500)):
        assert s < lat0 < n and w < lon0 < e
        assert (n - s) * 111_200 == pytest.approx(2 * half, rel=0.06)
        assert (e - w) * 111_320 * math.cos(math.radians(lat0)) == pytest.approx(2 * half, rel=0.06)
    x, y = geo.local_frame(F.lit(r[0]), F.lit(r[1]), F.lit(lat0), F.lit(lon0))
    assert max(spark.range(1).select(x, y).first()) < -990


def test_raster_pixels(spark):
    rows = [("c", "building", 5.0, 5.0, 4.0, 2.0, 9.0), ("c", "building", 5.0, 5.0, 2.0, 2.0, 12.0), ("c", "water", 9.0, 9.0, 4.0, 4.0, 0.0)]
    boxes = grid.cells_touched(spark.createDataFrame(rows, "city string, kind string, cx double, cy double, width_m double, depth_m double, height double"), 10.0)
    ground = spark.createDataFrame([(5.2, 5.2, 100.0), (5.4, 5.4, 102.0), (0.1, 0.1, 7.0)], "x double, y double, asl double")
    got = {(r["m"], r["z"], r["py"], r["px"]): r for r in descriptors.rasterised(boxes, ground, 10.0, 10).collect()}
    buildings = {k[2:]: v["building_height"] for k, v in got.items() if v["building_height"]}
    assert buildings == {(y, x): 12.0 if x in (4, 5) else 9.0 for y in (4, 5) for x in (3, 4, 5, 6)}
    assert {k for k, v in got.items() if v["water"]} == {(m, z, y, x) for m, ys in ((0, (7, 8, 9)), (1, (0,))) for z, xs in ((0, (7, 8, 9)), (1, (0,))) for y in ys for x in xs}
    assert got[0, 0, 5, 5]["terrain_asl"] == 101.0 and got[0, 0, 4, 4]["terrain_asl"] is None


def test_vector_of_a_tile_without_rows_is_zero_but_for_its_area(spark):
    tiles = spark.createDataFrame([("c", 0, 0, 1.0), ("c", 0, 1, 1.0)], "city string, m long, z long, tile_area double")
    cover = spark.createDataFrame([("c", 0, 1, 3.0, None)], "city string, m long, z long, water_count double, veg_count double")
    got = {r["z"]: r["v"] for r in descriptors.assemble(tiles, [(cover, ("city", "m", "z"))]).collect()}
    assert len(descriptors.NAMES) == 116 and descriptors.GROUPS["climate"] == (44, 115)
    assert got[0] == [1.0] + [0.0] * 115
    at = descriptors.NAMES.index("water_count")
    assert got[1] == [1.0] + [3.0 if i == at else 0.0 for i in range(1, 116)]


def test_set_cover_takes_sites_until_all_that_can_be_are_covered(spark):
    edges = [(1, p) for p in range(6)] + [(2, p) for p in range(4, 9)] + [(3, p) for p in (8, 9)] + [(4, 100)]
    required = spark.createDataFrame([(p,) for p in range(12)], "point_id long")
    got = siting.greedy_set_cover(spark.createDataFrame(edges, "candidate_id long, point_id long"), required).collect()
    assert [(r["step"], r["candidate_id"], r["gain"]) for r in got] == [(0, 1, 6), (1, 2, 3), (2, 3, 1)]
    many = spark.createDataFrame([(s, s) for s in range(9)], "candidate_id long, point_id long")
    assert siting.greedy_cover(many).count() == 9 and siting.greedy_cover(many, 3).count() == 3
