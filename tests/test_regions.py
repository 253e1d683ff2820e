"""Region polygons, polygon rasters and rays on spherical tiles against plain geometry."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from radiotiles.operators import descriptors, grid, paths
from radiotiles.plans import extended  # noqa: F401
from radiotiles.plans import queries as plans

POLYGON = "city string, vertices array<struct<x: double, y: double>>"


def holds(vertices, x, y):
    """Even-odd rule."""
    n = 0
    for (xa, ya), (xb, yb) in zip(vertices, vertices[1:] + vertices[:1], strict=True):
        if min(ya, yb) <= y < max(ya, yb) and xa + (xb - xa) * (y - ya) / (yb - ya) > x:
            n += 1
    return n % 2 == 1


def meets(a, b, c, d):
    """Do the segments a-b and c-d share a point (none are parallel here but to the axes)."""
    cross = lambda o, p, q: (p[0] - o[0]) * (q[1] - o[1]) - (p[1] - o[1]) * (q[0] - o[0])
    return cross(a, b, c) * cross(a, b, d) < 0 and cross(c, d, a) * cross(c, d, b) < 0


def touched(vertices, z, m):
    """A tile meets a polygon: a corner or the middle of one is in the other, or sides cross."""
    box = [(z, m), (z + 1, m), (z + 1, m + 1), (z, m + 1)]
    if any(z <= x <= z + 1 and m <= y <= m + 1 for x, y in vertices) or any(holds(vertices, x, y) for x, y in [*box, (z + 0.5, m + 0.5)]):
        return True
    sides = list(zip(vertices, vertices[1:] + vertices[:1], strict=True))
    return any(meets(a, b, c, d) for a, b in sides for c, d in zip(box, box[1:] + box[:1], strict=True))


SHAPES = {
    "ell": [(0.1, 0.2), (7.3, 0.2), (7.3, 1.7), (2.4, 1.7), (2.4, 6.6), (0.1, 6.6)],
    "comb": [(-3.2, -2.1), (5.7, -2.1), (5.3, 4.2), (4.9, -1.3), (2.1, 4.4), (1.6, -1.2), (-1.3, 4.7), (-1.9, -1.4)],
    "sliver": [(0.4, 0.4), (0.6, 0.4), (9.2, 8.3)],
    "small": [(0.2, 0.3), (0.5, 0.35), (0.3, 0.7)],
}


def test_region_tiles_are_those_that_share_a_point(spark):
    # corners in degrees near the equator, where a tile is about the same each way
    step = math.degrees(300 / 6_371_000)
    rows = [(k, [{"x": 10 + x * step, "y": 0.01 + y * step} for x, y in v]) for k, v in SHAPES.items()] + [("line", [{"x": 1.0, "y": 1.0}, {"x": 1.1, "y": 1.1}]), ("none", None)]
    regions = spark.createDataFrame(rows, POLYGON)
    edges = {}
    for r in grid.region_edges(regions.where(F.size("vertices") >= 3), 300.0).collect():
        edges.setdefault(r.city, []).append((r.x0, r.y0))
    got = {}
    for r in grid.region_tiles(regions, 300.0).collect():
        got.setdefault(r.city, []).append((r.tile_index, r.m, r.z))
    assert got.keys() == SHAPES.keys()
    for k, own in got.items():
        xs, ys = zip(*edges[k], strict=True)
        want = {(m, z) for m in range(math.floor(min(ys)) - 2, math.ceil(max(ys)) + 2) for z in range(math.floor(min(xs)) - 2, math.ceil(max(xs)) + 2) if touched(edges[k], z, m)}
        assert {(m, z) for _, m, z in own} == want
        assert [(m, z) for _, m, z in sorted(own)] == sorted(want) and sorted(i for i, _, _ in own) == list(range(len(want)))
    assert len(got["ell"]) < 8 * 8  # concave: the notch is left out


def test_polygon_pixels_are_the_centres_inside(spark):
    rng = np.random.default_rng(1)
    shapes = {k: [(x * 10, y * 10) for x, y in v] for k, v in SHAPES.items()}
    shapes |= {f"r{i}": [(float(a), float(b)) for a, b in rng.uniform(-30, 30, (7, 2))] for i in range(5)}  # these cross themselves
    df = spark.createDataFrame([(k, [{"x": x, "y": y} for x, y in v]) for k, v in shapes.items()] + [("none", []), ("null", None)], POLYGON)
    got = {}
    for r in descriptors.polygon_pixels(df, 1.7).collect():
        got.setdefault(r.city, set()).add((r.row, r.px))
    for k, v in shapes.items():
        want = {(j, i) for j in range(-30, 60) for i in range(-30, 60) if holds(v, (i + 0.5) * 1.7, (j + 0.5) * 1.7)}
        assert got.get(k, set()) == want, k


def test_rasters_of_boxes_agree_with_those_of_polygons(spark):
    rng = np.random.default_rng(2)
    rows = [("c", ("building", "water", "vegetation")[i % 3], float(i % 7), *(float(v) for v in rng.uniform(-40, 40, 2)), *(float(v) for v in rng.uniform(2, 30, 2))) for i in range(60)]
    boxes = spark.createDataFrame(rows, "city string, kind string, height double, cx double, cy double, width_m double, depth_m double")
    corner = lambda a, b: F.struct((F.col("cx") + a * F.col("width_m") / 2).alias("x"), (F.col("cy") + b * F.col("depth_m") / 2).alias("y"))
    shapes = boxes.withColumn("vertices", F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1)))
    dem = spark.createDataFrame([(1.0, 2.0, 5.0)], "x double, y double, asl double")
    a = descriptors.rasterised(grid.cells_touched(boxes, 50.0), dem, 50.0, 32)
    b = descriptors.rasterised_polygons(shapes, dem, 50.0, 32)
    assert a.columns == b.columns and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() and not a.isEmpty()


def test_pieces_of_a_ray_add_up_and_lie_in_their_tiles(spark):
    rays = spark.createDataFrame([(1, "x", 48.0, 11.0, 48.013, 11.021), (2, "x", 48.005, 11.002, 48.005, 11.002), (3, "x", 48.001, 11.0, 48.001, 11.02)], "ray int, city string, tx_lat double, tx_lon double, rx_lat double, rx_lon double")
    par = grid.grid_parameters(grid.region_boxes(rays), 300.0)
    total = {1: 2129.7, 3: 1487.9}
    pieces = paths.ray_split_tiles(rays, par).collect()
    assert {r.ray for r in pieces} == {1, 3}  # a ray without length has no pieces
    for k in (1, 3):
        own = [r for r in pieces if r.ray == k]
        assert sum(r.len_m for r in own) == pytest.approx(total[k], rel=2e-3) and len(own) > 4
        assert len({(r.m, r.z) for r in own}) == len(own) and all(r.len_m < 300 * 2**0.5 * 1.01 for r in own)
    ends = {(r.m, r.z) for r in grid.assign_tiles(rays, par).where("ray = 1").collect()} | {(r.m, r.z) for r in grid.assign_tiles(rays, par, "tx_lat", "tx_lon").where("ray = 1").collect()}
    assert ends <= {(r.m, r.z) for r in pieces if r.ray == 1}
    flat = {k: sum(r.len_m for r in paths.ray_split_tiles(rays, par, "deg111").collect() if r.ray == k) for k in (1, 3)}
    assert flat == pytest.approx({1: 111_000 * math.hypot(0.013, 0.021), 3: 111_000 * 0.02})
    with pytest.raises(ValueError, match="length_mode"):
        paths.ray_split_tiles(rays, par, "miles")


def test_mixed_path_fit_and_tile_fit_share_their_tiles(spark):
    sf = "/root/testdata/sf0.001"
    joint = {(r.city, r.m, r.z) for r in plans.QUERIES["e5_mixed_path"](spark, sf).collect()}
    tiles = {(r.city, r.m, r.z) for r in plans.QUERIES["e4_ridge_tiles"](spark, sf).collect()}
    assert joint and joint <= tiles
