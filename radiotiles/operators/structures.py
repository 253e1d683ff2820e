"""Buildings, vegetation and water: heights and tile features."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from radiotiles.operators.blocks import block_pairs
from radiotiles.sources.scratch import stage

# Lower bounds of the height classes, and height planes, in metres.
CLASSES = (0, 5, 10, 30, 60)
PLANES = (5, 10, 30, 60, 100)
#: Names of the features.
BUILT = (*(f"{n}{i}" for n in ("base_area_ratio_h", "n_buildings_h") for i in range(5)), *(f"{n}_{s}" for n in ("base_area", "height", "volume") for s in ("mean", "std")), "building_density")
PLANED = tuple(f"plane{p}_{s}" for p in PLANES for s in ("n", "dist_mean", "dist_std"))
COVER = tuple(f"{n}_{s}" for n in ("water", "veg") for s in ("density", "area_share", "count"))


def classify(features: DataFrame, rules: DataFrame) -> DataFrame:
    """(feature_id, kind): every kind whose rule (tag, value or null for any, kind) a feature's tags meet."""
    tags = features.select("feature_id", F.explode("tags").alias("tag", "value"))
    own = F.broadcast(rules.withColumnsRenamed({"tag": "r_tag", "value": "r_value"}))  # a short list of rules
    return tags.join(own, (F.col("tag") == F.col("r_tag")) & (F.col("r_value").isNull() | (F.col("r_value") == F.col("value")))).select("feature_id", "kind").distinct()


def with_heights(buildings: DataFrame, per_level: float = 3.2, fallback: float = 10.0, low: float = 2.0, high: float = 500.0) -> DataFrame:
    """height and height_source: the tag, else levels, else the city's median, else a fallback; clipped."""
    tag, levels = F.col("height_tag").try_cast("double"), F.col("levels_tag").try_cast("double") * per_level
    known = buildings.withColumn("known", F.coalesce(tag, levels)).withColumn("height_source", F.when(tag.isNotNull(), "tag").when(levels.isNotNull(), "levels").otherwise("imputed"))
    median = known.groupBy("city").agg(F.percentile("known", F.lit(0.5)).alias("median"))
    filled = known.join(F.broadcast(median), "city").withColumn("height", F.coalesce("known", "median", F.lit(fallback)))  # a row for each city
    return filled.withColumn("height", F.least(F.greatest("height", F.lit(low)), F.lit(high))).drop("known", "median")


def height_provenance(buildings: DataFrame) -> DataFrame:
    share = lambda s: F.avg((F.col("height_source") == s).cast("double"))
    return buildings.groupBy("city").agg(F.count("*").alias("n_buildings"), share("tag").alias("frac_tag"), share("levels").alias("frac_levels"), share("imputed").alias("frac_imputed"), F.percentile("height", F.lit(0.5)).alias("median_height_m"))


def height_class(h: Column) -> Column:
    out = F.lit(0)
    for i, edge in enumerate(CLASSES[1:], 1):
        out = F.when(h >= edge, i).otherwise(out)
    return out


def built_features(rows: DataFrame, tile_m2: float) -> DataFrame:
    """Height classes and moments of each tile's buildings (city, m, z, area_m2, height)."""
    c, a, h = height_class(F.col("height")), F.col("area_m2"), F.col("height")
    v = a * h
    moments = [f(x).alias(f"{n}_{s}") for x, n in ((a, "base_area"), (h, "height"), (v, "volume")) for f, s in ((F.avg, "mean"), (F.stddev_pop, "std"))]
    return rows.groupBy("city", "m", "z").agg(
        *[(F.sum(F.when(c == i, a).otherwise(0.0)) / tile_m2).alias(f"base_area_ratio_h{i}") for i in range(5)],
        *[F.count_if(c == i).cast("double").alias(f"n_buildings_h{i}") for i in range(5)],
        *moments,
        (F.sum(a) / tile_m2).alias("building_density"),
    )


#: Steps of a lattice that a tile's places may lie on, in metres, and the most steps of its extent.
STEPS, MOST_STEPS = (1.0, 0.5, 0.25, 0.125), 1024


def _length(n: int) -> int:
    """The least length of a fast transform that holds n."""
    return min(f << max(0, (-(-n // f) - 1).bit_length()) for f in (1, 3, 5))


def _lattice_sums(n: np.ndarray, i: np.ndarray, j: np.ndarray, step: float) -> list[float]:
    """Sums of the distances of all ordered pairs of rows and of their squares, for each column of `n`, the rows at places (i, j)
    of a lattice: pairs are counted by their difference, with a transform of the counts."""
    high, wide = int(i.max()) + 1, int(j.max()) + 1
    shape, out = (_length(2 * high - 1), _length(2 * wide - 1)), []
    dy, dx = (np.minimum(np.arange(s), s - np.arange(s)) * step for s in shape)
    d = np.hypot(dy[:, None], dx[None, :])
    for own in n.T:
        here = np.zeros(shape)
        here[i, j] = own
        pairs = np.rint(np.fft.irfft2(np.abs(np.fft.rfft2(here)) ** 2, shape))
        out += [float((pairs * d).sum()), float((pairs * d * d).sum())]
    return out


def plane_features(rows: DataFrame) -> DataFrame:
    """Of the buildings that reach each height plane: their number, and mean and spread of the distances of
    all pairs in a tile.  Buildings at one place are one row with their numbers.  Where a tile's places lie on a lattice, as
    places of whole metres do, their pairs are counted by difference, in time of the tile's extent; blocks of the
    places of other tiles meet as matrices and give the same sums."""
    keys, planes = ("city", "m", "z"), range(len(PLANES))
    counts = rows.groupBy(*keys).agg(*[F.count_if(F.col("height") >= p).cast("double").alias(f"plane{p}_n") for p in PLANES])
    own = stage(rows.select(*keys, "structure_id", F.col("cx").cast("double").alias("cx"), F.col("cy").cast("double").alias("cy"), "height").where(F.col("height") >= PLANES[0]), "structures")
    places = own.groupBy(*keys, "cx", "cy").agg(*[F.count_if((F.col("height") >= p) & ~F.isnan("height")).cast("double").alias(f"n{i}") for i, p in enumerate(PLANES)])
    places = stage(places, "places")
    corner = places.groupBy(*keys).agg(F.min("cx").alias("x0"), F.min("cy").alias("y0"), F.greatest(F.max("cx") - F.min("cx"), F.max("cy") - F.min("cy")).alias("extent"))
    whole = lambda c, s: F.col(c) / s == F.floor(F.col(c) / s)
    from_corner = places.join(corner, list(keys)).withColumn("dx", F.col("cx") - F.col("x0")).withColumn("dy", F.col("cy") - F.col("y0"))
    fits = [F.coalesce(F.bool_and(whole("dx", s) & whole("dy", s) & F.col("dx").isNotNull() & F.col("dy").isNotNull() & (F.col("extent") / s < MOST_STEPS)), F.lit(False)) for s in STEPS]
    step = None
    for s, good in zip(STEPS, fits, strict=True):
        step = F.when(good, s) if step is None else step.when(good, s)
    tiles = stage(from_corner.groupBy(*keys).agg(step.alias("step"), F.first("x0").alias("x0"), F.first("y0").alias("y0")), "tiles")  # a row for each tile
    placed = places.join(tiles, list(keys))
    numbers = [f"n{i}" for i in planes]

    def row(a: pa.Table, sums: list[float]) -> pa.Table:
        return a.slice(0, 1).select(list(keys)).append_column("s", pa.array([sums], pa.list_(pa.float64())))

    def counted(a: pa.Table) -> pa.Table:
        col = lambda c: a.column(c).to_numpy()
        step = a.column("step")[0].as_py()
        i, j = (np.rint((col(c) - col(f"{c[1]}0")) / step).astype(np.int64) for c in ("cy", "cx"))
        return row(a, _lattice_sums(np.stack([col(c) for c in numbers], 1), i, j, step))

    def work(a: pa.Table, b: pa.Table) -> pa.Table:
        col = lambda t, c: t.column(c).to_numpy()
        d = np.hypot(col(a, "cx")[:, None] - col(b, "cx")[None, :], col(a, "cy")[:, None] - col(b, "cy")[None, :])
        return row(a if a.num_rows else b, [float(col(a, n) @ x @ col(b, n)) for n in numbers for x in (d, d * d)])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keys) + ", s array<double>"
    on = placed.where("step is not null").groupBy(*keys).applyInArrow(counted, kinds)  # a row for each place of the lattice
    off = placed.where("step is null").withColumn("place", F.concat_ws(" ", "cx", "cy"))
    pairs = on.unionByName(block_pairs(off, off, keys, "place", work, kinds, per_block=1000))
    # buildings have no pair with another row of their own id
    again = own.groupBy(*keys, "structure_id").count().where("count > 1").drop("count")
    twice = own.join(again, [*keys, "structure_id"]).select(*keys, "structure_id", "cx", "cy", "height")
    other = twice.select(*keys, "structure_id", *[F.col(c).alias(f"b_{c}") for c in ("cx", "cy", "height")])
    low, d = F.least("height", "b_height"), F.hypot(F.col("cx") - F.col("b_cx"), F.col("cy") - F.col("b_cy"))
    of = [F.sum(F.when((low >= p) & ~F.isnan(low), x).otherwise(0.0)) for p in PLANES for x in (F.lit(1.0), d, d * d)]
    less = twice.join(other, [*keys, "structure_id"]).groupBy(*keys).agg(F.array(*of).alias("less"))
    alone = twice.groupBy(*keys).agg(F.array(*[F.count_if((F.col("height") >= p) & ~F.isnan("height")) for p in PLANES]).alias("alone"))
    at = lambda i, k: F.sum(F.get("s", 2 * i + k))
    sums = pairs.groupBy(*keys).agg(*[at(i, k).alias(f"s{i}_{k + 1}") for i in planes for k in range(2)])
    stats = places.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in numbers]).join(sums, list(keys)).join(less.join(alone, list(keys)), list(keys), "left")
    gone = lambda i, k: F.coalesce(F.get("less", 3 * i + k), F.lit(0.0))
    out = []
    for i, p in enumerate(PLANES):
        # of ordered pairs, each row's with itself among them
        own_id = F.coalesce(gone(i, 0) - F.get("alone", i), F.lit(0.0))
        n = F.nullif((F.col(f"n{i}") * (F.col(f"n{i}") - 1) - own_id) / 2, F.lit(0.0))
        mean = (F.col(f"s{i}_1") - gone(i, 1)) / 2 / n
        spread = F.sqrt(F.greatest((F.col(f"s{i}_2") - gone(i, 2)) / 2 / n - mean * mean, F.lit(0.0)))
        out += [F.coalesce(f"plane{p}_n", F.lit(0.0)).alias(f"plane{p}_n"), F.coalesce(mean, F.lit(0.0)).alias(f"plane{p}_dist_mean"), F.coalesce(spread, F.lit(0.0)).alias(f"plane{p}_dist_std")]
    return counts.join(stats, list(keys), "left").select(*keys, *out)


def cover_features(rows: DataFrame, tile_m2: float) -> DataFrame:
    """Density, area share and number of water and vegetation polygons."""
    out = []
    for kind, n in (("water", "water"), ("vegetation", "veg")):
        own = F.col("kind") == kind
        out += [(F.count_if(own) / (tile_m2 / 1e6)).alias(f"{n}_density"), (F.sum(F.when(own, F.col("area_m2")).otherwise(0.0)) / tile_m2).alias(f"{n}_area_share"), F.count_if(own).cast("double").alias(f"{n}_count")]
    return rows.groupBy("city", "m", "z").agg(*out)


def terrain_features(points: DataFrame, *keys: str) -> DataFrame:
    """Of DEM points in a tile: least, mean and population spread of both elevations."""
    return points.groupBy(*keys).agg(*[f(c).alias(f"{c}_{n}") for c in ("asl", "agl") for f, n in ((F.min, "min"), (F.avg, "mean"), (F.stddev_pop, "std"))])


def _nearest(asked: pa.Table, known: pa.Table, need: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place of `asked` the `need` rows nearest to it among those of `known` (cx, cy, ids), by distance and id: place,
    distance and id, place after place.  Places meet some thousand at a time."""
    col = lambda t, c: t.column(c).to_numpy()
    qx, qy, kx, ky = col(asked, "cx"), col(asked, "cy"), col(known, "cx"), col(known, "cy")
    listed = known.column("ids").combine_chunks()
    of, ids = np.repeat(np.arange(known.num_rows), listed.value_lengths().to_numpy()), listed.flatten().to_numpy()
    kx, ky, out = kx[of], ky[of], []
    step = max(1, 2_000_000 // max(len(ids), 1))
    for first in range(0, len(qx) if len(ids) else 0, step):
        x, y = qx[first : first + step], qy[first : first + step]
        square = (x[:, None] - kx[None, :]) ** 2 + (y[:, None] - ky[None, :]) ** 2
        if len(ids) > need:
            most = np.partition(square, need - 1, axis=1)[:, need - 1]
            at, near = np.nonzero(square <= (most * (1 + 1e-12))[:, None])  # ties stay
        else:
            at, near = (v.ravel() for v in np.indices(square.shape))
        d = np.hypot(x[at] - kx[near], y[at] - ky[near])
        order = np.lexsort((ids[near], d, at))
        at, near, d = at[order], near[order], d[order]
        kept = np.arange(len(at)) - np.searchsorted(at, at) < need
        out.append((at[kept] + first, d[kept], ids[near[kept]]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0), ids[:0])


def neighbour_graph(rows: DataFrame, k: int = 4, per_block: int = 500) -> DataFrame:
    """Edges of each building to its k nearest in the tile, weighted by inverse distance; ties go to the least id.  Buildings at
    one place share their neighbours, so places look for them, and each gives its first few ids only.  A tile's places are
    dealt to a grid of about `per_block` in a block; a place whose last neighbour is as far as the border of its block looks
    into all blocks that are no farther than that."""
    keys = ("city", "m", "z")
    own = stage(rows.select(*keys, "structure_id", "cx", "cy").where("abs(cx) < double('inf') and abs(cy) < double('inf')"), "structures")
    # an id has no edge to itself, so lists are longer by the most rows that an id has in a tile
    most = own.groupBy(*keys, "structure_id").count().agg(F.max("count")).first()[0] or 1
    need, place = k + most, (*keys, "cx", "cy")
    first = F.row_number().over(Window.partitionBy(*place).orderBy("structure_id"))
    places = own.withColumn("r", first).where(F.col("r") <= need).groupBy(*place).agg(F.array_sort(F.collect_list("structure_id")).alias("ids"))  # `need` at most
    places = stage(places, "places")
    # a tile's blocks: outermost ones have no border, so far places do not widen the others
    side = F.ceil(F.sqrt(F.count("*") / per_block))
    lo = lambda c: F.percentile_approx(c, 0.01, 1000).alias(f"{c}0")
    hi = lambda c: F.percentile_approx(c, 0.99, 1000).alias(f"{c}1")
    tiles = places.groupBy(*keys).agg(side.alias("g"), *[f(c) for c in ("cx", "cy") for f in (lo, hi)])
    tiles = stage(tiles.select(*keys, "g", *[e for c in ("cx", "cy") for e in (F.col(f"{c}0"), (F.greatest(F.col(f"{c}1") - F.col(f"{c}0"), F.lit(1e-9)) / F.col("g")).alias(f"{c}w"))]), "tiles")  # a row for each tile
    last = F.col("g") - 1
    block = lambda c, v: F.greatest(F.least(F.floor((v - F.col(f"{c}0")) / F.col(f"{c}w")), last), F.lit(0).cast("long"))
    dealt = stage(places.join(tiles, list(keys)).withColumn("bx", block("cx", F.col("cx"))).withColumn("by", block("cy", F.col("cy"))), "blocks")

    def listed(a: pa.Table, b: pa.Table) -> pa.Table:
        at, d, ids = _nearest(a, b, need)
        ends = pa.array(np.append(0, np.cumsum(np.bincount(at, minlength=a.num_rows))), pa.int32())
        near = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(d), pa.array(ids)], ["d", "b"]))
        return a.select([*place]).append_column("near", near)

    types = ", ".join(f"{c} {own.schema[c].dataType.simpleString()}" for c in place) + f", near array<struct<d: double, b: {own.schema['structure_id'].dataType.simpleString()}>>"
    inside = dealt.select(*place, "ids", "bx", "by").groupBy(*keys, "bx", "by").applyInArrow(lambda a: listed(a, a), types)
    inside = stage(inside.withColumn("far", F.when(F.size("near") < need, F.lit(float("inf"))).otherwise(F.element_at("near", -1)["d"])), "inside")
    # blocks within that distance, a little more than it for rounding
    asked = inside.join(tiles, list(keys)).withColumn("reach", F.col("far") * (1 + 1e-9) + 1e-9)
    around = lambda c: F.explode(F.sequence(block(c, F.col(c) - F.col("reach")), block(c, F.col(c) + F.col("reach"))))
    home = (F.col("bx") == block("cx", F.col("cx"))) & (F.col("by") == block("cy", F.col("cy")))
    asked = asked.withColumn("bx", around("cx")).withColumn("by", around("cy")).where(~home).select(*place, "bx", "by")
    others = asked.groupBy(*keys, "bx", "by").cogroup(dealt.select(*place, "ids", "bx", "by").groupBy(*keys, "bx", "by")).applyInArrow(listed, types)
    more = others.groupBy(*place).agg(F.flatten(F.collect_list("near")).alias("more"))  # `need` from each block within reach
    near = F.when(F.col("more").isNull(), F.col("near")).otherwise(F.slice(F.array_sort(F.concat("near", "more")), 1, need))
    found = inside.join(more, list(place), "left").select(*place, near.alias("near"))
    edges = own.withColumnRenamed("structure_id", "a").join(found, list(place))
    edges = edges.select(*keys, "a", F.explode(F.slice(F.filter("near", lambda e: e["b"] != F.col("a")), 1, k)).alias("e")).select(*keys, "a", "e.b", "e.d")
    if most > 1:
        edges = edges.withColumn("r", F.row_number().over(Window.partitionBy(*keys, "a").orderBy("d", "b"))).where(F.col("r") <= k)  # k for each of an id's rows
    return edges.select(*keys, "a", "b", "d", (1 / F.nullif("d", F.lit(0.0))).alias("weight"))
