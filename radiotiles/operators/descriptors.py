"""The descriptor vector of a tile, and rasters of a tile's geometry."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radiotiles.operators.structures import BUILT, COVER, PLANED

# The names and the order of the 116 numbers of a tile.
TOPOGRAPHY = ("tile_area", "asl_min", "asl_mean", "asl_std", "agl_mean", "agl_std")
VARIABLES = ("t2m", "rh", "tp")
CLIMATE = tuple(f"{x}_{s}_{month}" for month in range(1, 13) for x in VARIABLES for s in ("mean", "std"))
NAMES = (*TOPOGRAPHY, *BUILT, *PLANED, *COVER, *CLIMATE)
GROUPS = {"topographic": (0, 5), "built": (6, 37), "landcover": (38, 43), "climate": (44, 115)}


def by_month(monthly: DataFrame, *keys: str) -> DataFrame:
    """Monthly climate rows (keys, month, <variable>_mean, <variable>_std) as one row of columns CLIMATE."""
    pick = lambda name: F.max(F.when(F.col("month") == int(name.rsplit("_", 1)[1]), F.col(name.rsplit("_", 1)[0])))
    return monthly.groupBy(*keys).agg(*[pick(c).alias(c) for c in CLIMATE])


def assemble(tiles: DataFrame, parts: list[tuple[DataFrame, tuple[str, ...]]], keys: tuple[str, ...] = ("city", "m", "z")) -> DataFrame:
    """`tiles` with v, the values of NAMES in their order.  Each part is a table of features with those of the
    keys that it has; a tile without a row in a part, and a null, count as 0.  `tiles` has tile_area."""
    joined = reduce(lambda df, part: df.join(part[0], list(part[1]), "left"), parts, tiles)
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in joined.columns else F.lit(0.0)
    return joined.select(*keys, F.array(*[value(c) for c in NAMES]).alias("v"))


def filled(features: DataFrame, tiles: DataFrame, keys: tuple[str, ...] = ("city", "m", "z")) -> DataFrame:
    """Features for every tile: 0 where a tile has no row."""
    own = [c for c in features.columns if c not in keys]
    return tiles.select(*keys).join(features, list(keys), "left").select(*keys, *[F.coalesce(c, F.lit(0).cast(features.schema[c].dataType)).alias(c) for c in own])


def polygon_pixels(polygons: DataFrame, size: float) -> DataFrame:
    """Polygons (vertices: array of x, y in metres) by each pixel of a metric raster whose centre they hold, by scanlines:
    row (py of the whole plane), and px.  The sides that cross a pixel row's middle line, sorted by where they do, bound the
    filled runs in pairs (even-odd, so holes and concave parts come out right); a centre on the left end of a
    run counts, one on the right end does not.  No join and no shuffle: pixels come from arithmetic on the polygon itself."""
    ys = F.transform("vertices", lambda p: p["y"])
    first, last = F.ceil(F.array_min(ys) / size - 0.5), F.ceil(F.array_max(ys) / size - 0.5) - 1
    sides = F.zip_with("vertices", F.concat(F.slice("vertices", 2, F.greatest(F.size("vertices") - 1, F.lit(0))), F.slice("vertices", 1, 1)), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    rows = polygons.where(F.size("vertices") >= 3).withColumn("__sides", sides)
    rows = rows.withColumn("row", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    y = (F.col("row") + 0.5) * size
    crossed = F.filter("__sides", lambda s: (F.least(s["p"]["y"], s["q"]["y"]) <= y) & (y < F.greatest(s["p"]["y"], s["q"]["y"])))
    xs = F.array_sort(F.transform(crossed, lambda s: s["p"]["x"] + (s["q"]["x"] - s["p"]["x"]) * (y - s["p"]["y"]) / (s["q"]["y"] - s["p"]["y"])))
    rows = rows.withColumn("__xs", xs).drop("__sides").where(F.size("__xs") >= 2)
    place = lambda x: F.ceil(F.round(x / size, 9) - 0.5)
    runs = F.transform(F.sequence(F.lit(0), F.size("__xs") - 2, F.lit(2)), lambda i: F.struct(place(F.get("__xs", i)).alias("a"), (place(F.get("__xs", i + 1)) - 1).alias("b")))
    filled_ = F.transform(F.filter(runs, lambda r: r["a"] <= r["b"]), lambda r: F.sequence(r["a"], r["b"]))
    return rows.withColumn("px", F.explode(F.flatten(filled_))).drop("__xs")


def rasterised_polygons(polygons: DataFrame, terrain: DataFrame, tile_m: float, n: int = 128) -> DataFrame:
    """As `rasterised`, for footprints of any shape: polygons with city, kind, height and vertices.  Scanlines as those of
    `polygon_pixels`, worked out for a batch of sides at once; a polygon is sent to each band that its box meets."""
    size, high = tile_m / n, -(-n // BANDS)
    values = lambda axis: F.transform("vertices", lambda p: p[axis])
    ends = [f(values(axis)) for axis in "yx" for f in (F.array_min, F.array_max)]
    # a pixel more on either side, for what the places of crossings are rounded by
    y0, y1, x0, x1 = (F.floor(e / size) + k for e, k in zip(ends, (-1, 1, -1, 1), strict=True))
    sent = polygons.where(F.size("vertices") >= 3).select("city", "kind", "height", "vertices", y0.alias("y0"), y1.alias("y1"), x0.alias("x0"), x1.alias("x1"))
    sent = sent.withColumn("m", F.explode(F.sequence(F.floor(F.col("y0") / n), F.floor(F.col("y1") / n)))).withColumn("z", F.explode(F.sequence(F.floor(F.col("x0") / n), F.floor(F.col("x1") / n))))
    row = lambda c: F.least(F.greatest(F.col(c) - F.col("m") * n, F.lit(0)), F.lit(n - 1))
    sent = sent.withColumn("band", F.explode(F.sequence(F.floor(row("y0") / high), F.floor(row("y1") / high))))
    sent = sent.select("city", "m", "z", "band", "kind", F.col("height").cast("double").alias("height"), F.transform("vertices", lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))).alias("vertices"))

    def strips(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        listed, at = batch.column("vertices"), lambda c: batch.column(c).to_numpy()
        of, flat = pc.list_parent_indices(listed).to_numpy(), pc.list_flatten(listed)
        x, y = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in "xy")
        last = np.append(of[1:] != of[:-1], True)
        after = np.arange(1, len(of) + 1)
        after[last] = np.flatnonzero(np.append(True, last[:-1]))
        low, top = np.minimum(y, y[after]), np.maximum(y, y[after])
        begin = at("m") * n + at("band") * high
        stop = np.minimum(begin + high, (at("m") + 1) * n) - 1
        known = np.isfinite(low + top + x + x[after])
        a = np.maximum(np.floor(np.where(known, low, 0.0) / size).astype(np.int64) - 1, begin[of])
        b = np.minimum(np.floor(np.where(known, top, 0.0) / size).astype(np.int64) + 1, stop[of])
        side, r = _spread(np.where(known, a, 1), np.where(known, b, 0))
        middle = (r + 0.5) * size
        kept = (low[side] <= middle) & (middle < top[side])
        side, r, middle = side[kept], r[kept], middle[kept]
        to = after[side]
        cross = x[side] + (x[to] - x[side]) * (middle - y[side]) / (y[to] - y[side])
        order = np.lexsort((cross, r, of[side]))
        of, r, cross = of[side][order], r[order], np.ceil(np.round(cross[order] / size, 9) - 0.5).astype(np.int64)
        # crossings of a row in pairs
        first = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (r[1:] != r[:-1]))) if len(of) else np.empty(0, np.int64)
        place = np.arange(len(of)) - np.repeat(first, np.diff(np.append(first, len(of))))
        i = np.flatnonzero((place[1:] % 2 == 1) & (place[:-1] % 2 == 0) & (place[1:] == place[:-1] + 1)) if len(of) else np.empty(0, np.int64)
        own, left = of[i], at("z")[of[i]] * n
        return own, r[i] - at("m")[own] * n, np.maximum(cross[i] - left, 0), np.minimum(cross[i + 1] - 1 - left, n - 1)

    return _with_terrain(_covered(sent, strips, n), terrain, tile_m, n)


def rasterised(footprints: DataFrame, terrain: DataFrame, tile_m: float, n: int = 128) -> DataFrame:
    """(city, m, z, py, px, building_height, terrain_asl, vegetation, water) of the pixels of n x n tiles that something
    lies on, in long form.  `footprints`: structures by tile (upright boxes, as `cells_touched` gives them) with kind
    and height; the highest building counts.  `terrain`: x, y, asl points of all cities; their mean counts.  A pixel
    without terrain points has null there.  Pixels come from arithmetic on each box, no join."""
    size, high = tile_m / n, -(-n // BANDS)

    def ends(c: str, s: str, k: str) -> tuple[Column, Column]:
        """Numbers of the first and the last pixel of the tile whose centres lie in the box."""
        at = lambda x: F.ceil((x - F.col(k) * tile_m) / size - 0.5)
        return F.greatest(at(F.col(c) - F.col(s) / 2), F.lit(0)), F.least(at(F.col(c) + F.col(s) / 2) - 1, F.lit(n - 1))

    (y0, y1), (x0, x1) = ends("cy", "depth_m", "m"), ends("cx", "width_m", "z")
    sent = footprints.select("city", "m", "z", "kind", F.col("height").cast("double").alias("height"), y0.alias("y0"), y1.alias("y1"), x0.alias("x0"), x1.alias("x1")).where("y0 <= y1 and x0 <= x1")
    sent = sent.withColumn("band", F.explode(F.sequence(F.floor(F.col("y0") / high), F.floor(F.col("y1") / high))))

    def strips(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        at = lambda c: batch.column(c).to_numpy()
        begin = at("band") * high
        own, y = _spread(np.maximum(at("y0"), begin), np.minimum(at("y1"), begin + high - 1))
        return own, y, at("x0")[own], at("x1")[own]

    return _with_terrain(_covered(sent, strips, n), terrain, tile_m, n)


#: Parts of a tile's rows that are filled one by one.
BANDS = 4


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and number of all numbers first..last of each place."""
    many = np.maximum(last - first + 1, 0)
    own = np.repeat(np.arange(len(many)), many)
    return own, first[own] + np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)


def _covered(sent: DataFrame, strips: Callable[[pa.RecordBatch], tuple[np.ndarray, ...]], n: int) -> DataFrame:
    """(city, m, z, py, px, building_height, vegetation, water) of the pixels under shapes by city, m, z and band.  `strips`: of a
    batch of shapes the filled runs, as place in the batch, py, and first and last px.  A band's shapes follow one another, so a task
    holds a batch and the pixels of one band, however many shapes lie there."""
    keys, high = ["city", "m", "z", "band"], -(-n // BANDS)
    out = f"city {sent.schema['city'].dataType.simpleString()}, m long, z long, py long, px long, building_height double, vegetation int, water int"

    def empty() -> tuple[np.ndarray, np.ndarray]:
        return np.full(high * n, -np.inf), np.zeros(high * n, np.uint8)

    def pixels(key: tuple, city: pa.DataType, top: np.ndarray, seen: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(seen)
        bits, same = seen[at], lambda v, t: pa.array([v] * len(at), t)
        flag = lambda k: pa.array(((bits & k) > 0).astype(np.int32), mask=(bits & 2) == 0)
        height = np.where((bits & 16) > 0, top[at], 0.0)
        columns = [same(key[0], city), same(key[1], pa.int64()), same(key[2], pa.int64()), pa.array(at // n + key[3] * high), pa.array(at % n), pa.array(height), flag(4), flag(8)]
        return pa.RecordBatch.from_arrays(columns, names=["city", "m", "z", "py", "px", "building_height", "vegetation", "water"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, city, top, seen = None, None, *empty()
        for batch in batches:
            if not len(batch):
                continue
            city = batch.schema.field("city").type
            kind, height = batch.column("kind"), batch.column("height")
            is_ = lambda name: pc.fill_null(pc.equal(kind, name), False).to_numpy(zero_copy_only=False)  # noqa: E731,B023
            tall = is_("building") & pc.is_valid(height).to_numpy(zero_copy_only=False)
            bits = (1 + 2 * pc.is_valid(kind).to_numpy(zero_copy_only=False) + 4 * is_("vegetation") + 8 * is_("water") + 16 * tall).astype(np.uint8)
            value = np.where(tall, pc.fill_null(height, 0.0).to_numpy(zero_copy_only=False), -np.inf)
            own, py, x0, x1 = strips(batch)
            order = np.argsort(own, kind="stable")
            own, py, x0, x1 = own[order], py[order], x0[order], x1[order]
            names = list(zip(*(batch.column(c).to_pylist() for c in keys), strict=True))
            begins = [i for i, name in enumerate(names) if i == 0 or name != names[i - 1]]
            for i, j in zip(begins, [*begins[1:], len(names)], strict=True):
                if names[i] != key:
                    if key is not None and seen.any():
                        yield pixels(key, city, top, seen)
                    key, (top, seen) = names[i], empty()
                a, b = np.searchsorted(own, (i, j))
                run, px = _spread(x0[a:b], x1[a:b])
                shape = own[a:b][run]
                at = (py[a:b][run] - key[3] * high) * n + px
                np.maximum.at(top, at, value[shape])
                for bit in (1, 2, 4, 8, 16):
                    seen[at[(bits[shape] & bit) > 0]] |= bit
        if key is not None and seen.any():
            yield pixels(key, city, top, seen)

    return sent.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(fill, out)


def _with_terrain(cover: DataFrame, terrain: DataFrame, tile_m: float, n: int) -> DataFrame:
    """The ground under the pixels of `cover`."""
    size = tile_m / n
    m, z = F.floor(F.col("y") / tile_m), F.floor(F.col("x") / tile_m)
    pixel = lambda c, k: F.least(F.floor((F.col(c) - k * tile_m) / size), F.lit(n - 1))
    ground = terrain.select(m.alias("m"), z.alias("z"), pixel("y", m).alias("py"), pixel("x", z).alias("px"), "asl").groupBy("m", "z", "py", "px").agg(F.avg("asl").alias("terrain_asl"))
    return cover.join(ground, ["m", "z", "py", "px"], "left").select("city", "m", "z", "py", "px", "building_height", "terrain_asl", "vegetation", "water")
