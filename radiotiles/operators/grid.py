"""Spherical tile grids."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from radiotiles.functions.geo import span_lat, span_lon, utm, utm_inverse, utm_zone


def spherical_centroid(points: DataFrame, by: str = "city", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """The direction of the mean unit vector, in radians; points in degrees."""
    a, b = F.radians(lat), F.radians(lon)
    mean = points.groupBy(by).agg(F.avg(F.cos(a) * F.cos(b)).alias("x"), F.avg(F.cos(a) * F.sin(b)).alias("y"), F.avg(F.sin(a)).alias("s"))
    return mean.select(by, F.atan2("s", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))).alias("lat0"), F.atan2("y", "x").alias("lon0"))


def region_boxes(points: DataFrame, pad_deg: float = 0.002, lat: str = "rx_lat", lon: str = "rx_lon") -> DataFrame:
    """city, lat_lo, lat_hi, lon_lo, lon_hi in degrees."""
    return points.groupBy("city").agg(
        (F.min(lat) - pad_deg).alias("lat_lo"), (F.max(lat) + pad_deg).alias("lat_hi"), (F.min(lon) - pad_deg).alias("lon_lo"), (F.max(lon) + pad_deg).alias("lon_hi")
    )


def grid_parameters(boxes: DataFrame, tile_m: Column | float) -> DataFrame:
    """One row for each box (of a city, or of a city and tile size): origin and spans of its grid, and the ranges of the tile indexes."""
    corner = lambda a, b: F.struct(F.col(a).alias("lat"), F.col(b).alias("lon"))
    corners = boxes.select("city", F.explode(F.array(*[corner(a, b) for a in ("lat_lo", "lat_hi") for b in ("lon_lo", "lon_hi")])).alias("c")).select("city", "c.*")
    origin = boxes.join(spherical_centroid(corners), "city").withColumn("dphi", span_lat(tile_m)).withColumn("dlam", span_lon(tile_m, F.col("lat0")))

    def ends(lo: str, hi: str, at: str, step: str) -> tuple[Column, Column]:
        place = lambda v: F.round((F.radians(v) - F.col(at)) / F.col(step), 9)
        return F.ceil(place(lo) - 0.5), F.floor(place(hi) + 0.5)

    (m_lo, m_hi), (z_lo, z_hi) = ends("lat_lo", "lat_hi", "lat0", "dphi"), ends("lon_lo", "lon_hi", "lon0", "dlam")
    return origin.select("*", m_lo.alias("m_lo"), m_hi.alias("m_hi"), z_lo.alias("z_lo"), z_hi.alias("z_hi"))


def grid_tiles(parameters: DataFrame) -> DataFrame:
    """Every tile of every city with its dense index, row by row."""
    tiles = parameters.withColumn("m", F.explode(F.sequence("m_lo", "m_hi"))).withColumn("z", F.explode(F.sequence("z_lo", "z_hi")))
    index = (F.col("m") - F.col("m_lo")) * (F.col("z_hi") - F.col("z_lo") + 1) + F.col("z") - F.col("z_lo")
    return tiles.withColumn("tile_index", index)


def region_edges(regions: DataFrame, tile_m: float) -> DataFrame:
    """The sides of regions (city, vertices: an array of lon x and lat y in degrees) in units of tiles: city, lat0, lon0,
    dphi, dlam and x0, y0, x1, y1, where tile (m, z) is the square [z, z + 1) x [m, m + 1).  The origin is the spherical
    centroid of the vertices."""
    corners = regions.select("city", F.explode("vertices").alias("p")).select("city", F.col("p.y").alias("lat"), F.col("p.x").alias("lon"))
    origin = spherical_centroid(corners, "city").withColumn("dphi", span_lat(tile_m)).withColumn("dlam", span_lon(tile_m, F.col("lat0")))
    place = lambda v, at, step: F.round((F.radians(v) - F.col(at)) / F.col(step) + 0.5, 9)
    sides = F.zip_with("vertices", _after(F.col("vertices")), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    rows = regions.join(origin, "city").select("city", "lat0", "lon0", "dphi", "dlam", F.explode(sides).alias("s"))
    ends = [place(f"s.{end}.{axis}", at, step).alias(f"{axis}{k}") for k, end in ((0, "p"), (1, "q")) for axis, at, step in (("x", "lon0", "dlam"), ("y", "lat0", "dphi"))]
    return rows.select("city", "lat0", "lon0", "dphi", "dlam", *ends)


def region_runs(edges: DataFrame) -> DataFrame:
    """(city, m, runs): for each row of tiles the disjoint runs [lo, hi] of tiles that share a point with the region, by
    scanlines.  The part of each side within the row's band touches the tiles from its least to its largest x; tiles that
    no side touches are inside or outside as a whole, and the crossings of the band's middle line, taken in pairs, tell
    which.  A group is one row of tiles of one region, whatever its area."""
    rows = edges.withColumn("m", F.explode(F.sequence(F.floor(F.least("y0", "y1")), F.floor(F.greatest("y0", "y1")))))
    at = lambda y: F.col("x0") + (F.col("x1") - F.col("x0")) * (y - F.col("y0")) / (F.col("y1") - F.col("y0"))
    level = F.col("y0") == F.col("y1")
    low, high = F.greatest(F.least("y0", "y1"), F.col("m")), F.least(F.greatest("y0", "y1"), F.col("m") + 1)
    xs = F.when(level, F.array("x0", "x1")).otherwise(F.array(at(low), at(high)))
    touched = F.struct(F.floor(F.round(F.array_min(xs), 9)).alias("lo"), F.floor(F.round(F.array_max(xs), 9)).alias("hi"))
    middle = F.col("m") + 0.5
    crossing = F.when((F.least("y0", "y1") <= middle) & (middle < F.greatest("y0", "y1")), at(middle))
    own = rows.groupBy("city", "m").agg(F.collect_list(touched).alias("touched"), F.array_sort(F.collect_list(crossing)).alias("xs"))  # the sides of one row of tiles
    pairs = F.when(F.size("xs") >= 2, F.sequence(F.lit(0), F.size("xs") - 2, F.lit(2))).otherwise(F.array().cast("array<int>"))
    inside = F.transform(pairs, lambda i: F.struct(F.floor(F.get("xs", i)).alias("lo"), F.floor(F.get("xs", i + 1)).alias("hi")))
    every = F.array_sort(F.concat("touched", inside))
    empty = F.array().cast("array<struct<lo:bigint,hi:bigint>>")

    def add(runs: Column, run: Column) -> Column:
        last = F.element_at(runs, -1)
        joined = F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], run["hi"]).alias("hi"))))
        return F.when((F.size(runs) > 0) & (F.try_element_at(runs, F.lit(-1))["hi"] + 1 >= run["lo"]), joined).otherwise(F.concat(runs, F.array(run)))

    return own.select("city", "m", F.aggregate(every, empty, add).alias("runs"))


def region_tiles(regions: DataFrame, tile_m: float) -> DataFrame:
    """Every tile that shares a point with its city's region polygon (simple, maybe concave; one for each city), with
    the grid's parameters and tile_index, its place row by row without gaps.  Counts run over rows of tiles and over runs
    within a row, not over tiles.  Regions of fewer than three vertices have no tiles."""
    edges = region_edges(regions.where(F.size("vertices") >= 3), tile_m)
    runs = region_runs(edges).select("city", "m", F.posexplode("runs").alias("k", "run")).select("city", "m", "k", "run.lo", "run.hi").withColumn("n", F.col("hi") - F.col("lo") + 1)
    sums = runs.groupBy("city", "m").agg(F.sum("n").alias("in_row"))
    before = sums.withColumn("before", F.sum("in_row").over(Window.partitionBy("city").orderBy("m")) - F.col("in_row"))  # a row for each row of tiles
    inside = F.sum("n").over(Window.partitionBy("city", "m").orderBy("k")) - F.col("n")
    placed = runs.withColumn("inside", inside).join(before, ["city", "m"]).join(edges.select("city", "lat0", "lon0", "dphi", "dlam").distinct(), "city")
    tiles = placed.withColumn("z", F.explode(F.sequence("lo", "hi")))
    return tiles.select("city", "m", "z", (F.col("before") + F.col("inside") + F.col("z") - F.col("lo")).alias("tile_index"), "lat0", "lon0", "dphi", "dlam")


def tile_bounds(tiles: DataFrame) -> DataFrame:
    """Degrees of the four sides of each tile."""
    side = lambda at, step, k, h: F.degrees(F.col(at) + (F.col(k) + h) * F.col(step))
    return tiles.select(
        "*", side("lat0", "dphi", "m", -0.5).alias("south"), side("lat0", "dphi", "m", 0.5).alias("north"), side("lon0", "dlam", "z", -0.5).alias("west"), side("lon0", "dlam", "z", 0.5).alias("east")
    )


def assign_tiles(points: DataFrame, parameters: DataFrame, lat: str = "rx_lat", lon: str = "rx_lon", more: tuple[str, ...] = ()) -> DataFrame:
    """The tile (m, z) of each point, by arithmetic: cells are half open, so each point has one in each grid of its city;
    `more` columns of the parameters are kept."""
    own = F.broadcast(parameters.select("city", *more, "lat0", "lon0", "dphi", "dlam").withColumnsRenamed({"lat0": "g_lat0", "lon0": "g_lon0"}))  # a row for each city
    index = lambda v, at, step: F.floor(F.round((F.radians(v) - F.col(at)) / F.col(step), 9) + 0.5)
    placed = points.join(own, "city")
    return placed.withColumn("m", index(lat, "g_lat0", "dphi")).withColumn("z", index(lon, "g_lon0", "dlam")).drop("g_lat0", "g_lon0", "dphi", "dlam")


def sweep_sizes(boxes: DataFrame, sizes: tuple[float, ...]) -> DataFrame:
    """Grid parameters for several tile sizes, with tile_size as another key."""
    return grid_parameters(boxes.withColumn("tile_size", F.explode(F.array(*[F.lit(float(s)) for s in sizes]))), F.col("tile_size"))


def assign_sizes(points: DataFrame, swept: DataFrame, lat: str = "rx_lat", lon: str = "rx_lon") -> DataFrame:
    """The tile of each point for each tile_size of `sweep_sizes`: a row for each, from one join with the grids."""
    return assign_tiles(points, swept, lat, lon, ("tile_size",))


def cells_touched(structures: DataFrame, tile_m: float, clip: bool = False) -> DataFrame:
    """Structures (cx, cy, width_m, depth_m: upright rectangles in metres) by each cell of a metric grid that
    they share area with; `area_m2` is the whole footprint, or with `clip` the shared part."""
    lo = lambda c, s: F.floor((F.col(c) - F.col(s) / 2) / tile_m)
    hi = lambda c, s: F.floor((F.col(c) + F.col(s) / 2) / tile_m)
    cells = structures.withColumn("m", F.explode(F.sequence(lo("cy", "depth_m"), hi("cy", "depth_m")))).withColumn("z", F.explode(F.sequence(lo("cx", "width_m"), hi("cx", "width_m"))))

    def shared(c: str, s: str, k: str) -> Column:
        return F.least(F.col(c) + F.col(s) / 2, (F.col(k) + 1) * tile_m) - F.greatest(F.col(c) - F.col(s) / 2, F.col(k) * tile_m)

    dx, dy = shared("cx", "width_m", "z"), shared("cy", "depth_m", "m")
    return cells.withColumn("clip_m2", F.greatest(dx, F.lit(0.0)) * F.greatest(dy, F.lit(0.0))).where("clip_m2 > 0").withColumn("area_m2", F.col("clip_m2") if clip else F.col("width_m") * F.col("depth_m"))


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def polygon_area(vertices: Column) -> Column:
    """Shoelace area of an array of (x, y) vertices."""
    return _once(vertices, lambda own: F.abs(F.aggregate(_cross(own), F.lit(0.0), lambda a, c: a + c)) / 2)


def polygon_centroid(vertices: Column) -> tuple[Column, Column]:
    """x and y of a polygon's centre of mass, whichever way it runs; null where it has no area."""
    cross = _cross(vertices)
    twice = F.nullif(F.aggregate(cross, F.lit(0.0), lambda a, c: a + c), F.lit(0.0))

    def mean(axis: str) -> Column:
        sums = F.zip_with(vertices, _after(vertices), lambda p, q: p[axis] + q[axis])
        return F.aggregate(F.zip_with(sums, cross, lambda s, c: s * c), F.lit(0.0), lambda a, c: a + c) / (3 * twice)

    return mean("x"), mean("y")


def _after(vertices: Column) -> Column:
    return F.concat(F.slice(vertices, 2, F.greatest(F.size(vertices) - 1, F.lit(0))), F.slice(vertices, 1, 1))


def _cross(vertices: Column) -> Column:
    return F.zip_with(vertices, _after(vertices), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])


def clip_to_box(vertices: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A polygon's vertices cut by the four sides of a box, one half plane after another."""

    def side(points: Column, axis: str, bound: Column, keep_above: bool) -> Column:
        other = "y" if axis == "x" else "x"
        inside = lambda p: p[axis] >= bound if keep_above else p[axis] <= bound

        def crossing(p: Column, q: Column) -> Column:
            t = (bound - p[axis]) / F.nullif(q[axis] - p[axis], F.lit(0.0))
            parts = {axis: bound.cast("double"), other: p[other] + t * (q[other] - p[other])}
            return F.struct(parts["x"].alias("x"), parts["y"].alias("y"))

        after = _after(points)
        edge = lambda p, q: F.concat(F.when(inside(p), F.array(p)).otherwise(F.slice(F.array(p), 1, 0)), F.when(inside(p) != inside(q), F.array(crossing(p, q))).otherwise(F.slice(F.array(p), 1, 0)))
        return F.flatten(F.zip_with(points, after, edge))

    def at(axis: str, bound: Column, above: bool) -> Callable[[Column], Column]:
        return lambda own: side(own, axis, bound, above)

    for axis, bound, above in (("x", x0, True), ("x", x1, False), ("y", y0, True), ("y", y1, False)):
        # a side names its polygon several times: without this, four of them would work the first out hundreds of times
        vertices = _once(vertices, at(axis, bound, above))
    return vertices


def _cut_side(x: np.ndarray, y: np.ndarray, own: np.ndarray, bound: np.ndarray, above: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Corners (x, y) of polygons, one after another, cut where x passes `bound`; `own` tells a corner's polygon, and rises."""
    if not len(own):
        return x, y, own
    last = np.append(own[1:] != own[:-1], True)
    after = np.arange(1, len(own) + 1)
    after[last] = np.flatnonzero(np.append(True, last[:-1]))
    inside = x >= bound if above else x <= bound
    crossed = inside != inside[after]
    many = inside.astype(np.int64) + crossed
    to = np.cumsum(many) - many
    out = np.empty(many.sum()), np.empty(many.sum())
    out[0][to[inside]], out[1][to[inside]] = x[inside], y[inside]
    p, q = np.flatnonzero(crossed), after[crossed]
    at = to[p] + inside[p]
    out[0][at], out[1][at] = bound[p], y[p] + (bound[p] - x[p]) / (x[q] - x[p]) * (y[q] - y[p])
    return *out, np.repeat(own, many)


def _clipped(batch: pa.RecordBatch, tile_m: float) -> Iterator[pa.RecordBatch]:
    vertices = batch.column("vertices")
    of, flat = pc.list_parent_indices(vertices).to_numpy(), pc.list_flatten(vertices)
    x, y = (np.asarray(flat.field(c).to_numpy(zero_copy_only=False), dtype=np.float64) for c in "xy")
    size = np.bincount(of, minlength=len(batch))
    whole = (size >= 3) & (np.bincount(of, ~np.isfinite(x + y), len(batch)) == 0)
    x, y, rows, size, begin = x[whole[of]], y[whole[of]], np.flatnonzero(whole), size[whole], np.cumsum(size[whole]) - size[whole]
    if not len(rows):
        return
    cell = lambda f, v: np.floor(f.reduceat(v, begin) / tile_m).astype(np.int64)
    m0, z0, high, wide = cell(np.minimum, y), cell(np.minimum, x), cell(np.maximum, y), cell(np.maximum, x)
    high, wide = high - m0 + 1, wide - z0 + 1
    if (high * wide * size).sum() > 5_000_000 and len(batch) > 1:
        half = len(batch) // 2
        yield from _clipped(batch.slice(0, half), tile_m)
        yield from _clipped(batch.slice(half), tile_m)
        return
    poly = np.repeat(np.arange(len(rows)), high * wide)
    k = np.arange(len(poly)) - np.repeat(np.cumsum(high * wide) - high * wide, high * wide)
    m, z = m0[poly] + k // wide[poly], z0[poly] + k % wide[poly]
    n = size[poly]
    own = np.repeat(np.arange(len(poly)), n)
    corner = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + begin[poly][own]
    x, y = x[corner], y[corner]
    for above in (True, False):
        x, y, own = _cut_side(x, y, own, (z[own] + (not above)) * tile_m, above)
    for above in (True, False):
        y, x, own = _cut_side(y, x, own, (m[own] + (not above)) * tile_m, above)
    left = np.bincount(own, minlength=len(poly))
    last = np.append(own[1:] != own[:-1], True) if len(own) else np.zeros(0, bool)
    after = np.arange(1, len(own) + 1)
    after[last] = np.flatnonzero(np.append(True, last[:-1])) if len(own) else []
    area = np.abs(np.bincount(own, x * y[after] - x[after] * y, len(poly))) / 2
    real = area > 0
    points = pa.StructArray.from_arrays([pa.array(v[real[own]]) for v in (x, y)], ["x", "y"])
    clipped = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(left[real])), pa.int32()), points)
    kept = batch.take(pa.array(rows[poly[real]]))
    yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(m[real]), pa.array(z[real]), clipped, pa.array(area[real])], [*batch.schema.names, "m", "z", "clipped", "area_m2"])


def clipped_polygons(polygons: DataFrame, tile_m: float) -> DataFrame:
    """Polygons (vertices: array of x, y) by each cell of a metric grid that they share area with: `clipped`, the part inside,
    and its `area_m2`.  Candidate cells are those of the bounding box; the sides cut the polygon one after another, so a
    concave one may keep edges of no width, which do not change its area.  Batches are cut as arrays of corners."""
    made = ("m", "z", "clipped", "area_m2")
    own = polygons.select(*[c for c in polygons.columns if c not in made])
    types = StructType([*own.schema.fields]).add("m", "long").add("z", "long").add("clipped", ArrayType(StructType().add("x", "double").add("y", "double"))).add("area_m2", "double")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _clipped(batch, tile_m)

    return own.mapInArrow(work, types)


def footprints(features: DataFrame, least_m2: float = 4.0) -> DataFrame:
    """Polygons with an area of at least `least_m2` (slivers go), with area_m2 and centroid cx, cy."""
    x, y = polygon_centroid(F.col("vertices"))
    return features.withColumn("area_m2", polygon_area(F.col("vertices"))).where(F.col("area_m2") >= least_m2).withColumn("cx", x).withColumn("cy", y)


def scene_boxes(origins: DataFrame, size_m: float, pad_m: float = 0.0, by: str = "city") -> DataFrame:
    """South, west, north and east in degrees of a square scene around each origin (lat0, lon0).  All four corners
    count, as the frame's north is not the meridian's."""
    h = size_m / 2 + pad_m
    corner = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in (-h, h) for y in (-h, h)]))
    zone, south = utm_zone(F.col("lon0")), F.col("lat0") < 0
    e0, n0 = utm(F.col("lat0"), F.col("lon0"), F.col("zone"), F.col("south"))
    placed = origins.select(by, "lat0", "lon0", zone.alias("zone"), south.alias("south")).withColumn("e0", e0).withColumn("n0", n0).withColumn("corner", corner)
    lat, lon = utm_inverse(F.col("e"), F.col("n"), F.col("zone"), F.col("south"))
    at = placed.select(by, "zone", "south", (F.col("e0") + F.col("corner.x")).alias("e"), (F.col("n0") + F.col("corner.y")).alias("n")).select(by, lat.alias("lat"), lon.alias("lon"))
    return at.groupBy(by).agg(F.min("lat").alias("south"), F.min("lon").alias("west"), F.max("lat").alias("north"), F.max("lon").alias("east"))
