"""Rays cut at tile borders, and the joint fit of all tiles that they cross."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from radiotiles.functions.geo import EARTH_RADIUS_M
from radiotiles.sources.scratch import stage

SHORTEST_M = 1e-6
#: A tile's number of its m and z.
STRIDE, OFFSET = 1_000_000_000, 400_000_000


def _crossings(a: Column, b: Column, size: float) -> Column:
    """Shares of the way from a to b at which a grid line is crossed."""
    first, last = F.floor(F.least(a, b) / size) + 1, F.ceil(F.greatest(a, b) / size) - 1
    lines = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    return F.transform(lines, lambda k: (k * size - a) / (b - a))


def _ray_pieces(rays: DataFrame, a: Column, b: Column, c: Column, d: Column, size: float, taken: tuple[str, ...]) -> DataFrame:
    """The columns of `rays` but `taken`, and s and t (`__p`): the shares of the way from (a, b) to (c, d) between which a
    ray is in one square cell."""
    cuts = F.array_sort(F.concat(F.array(F.lit(0.0), F.lit(1.0)), _crossings(a, c, size), _crossings(b, d, size)))
    kept = [F.col(f"`{n}`") for n in rays.columns if n not in taken]
    ends = F.struct(a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d")).alias("__e")
    with_cuts = rays.select("*", ends).withColumn("__cuts", cuts)
    spans = F.zip_with(F.slice("__cuts", F.lit(1), F.size("__cuts") - 1), F.slice("__cuts", F.lit(2), F.size("__cuts") - 1), lambda s, t: F.struct(s.alias("s"), t.alias("t")))
    return with_cuts.select(*kept, "__e", F.explode(spans).alias("__p"))


def ray_split(rays: DataFrame, size: float, x0: str = "tx_x", y0: str = "tx_y", x1: str = "rx_x", y1: str = "rx_y") -> DataFrame:
    """A row for each piece of a ray in a square cell: the columns of `rays`, m, z, len_m.  The cell is that
    of the piece's middle; pieces of no length, and rays of none, give no rows.  No shuffle."""
    a, b, c, d = (F.col(n).cast("double") for n in (x0, y0, x1, y1))
    pieces = _ray_pieces(rays, a, b, c, d, size, ("m", "z", "len_m"))
    e = {k: F.col(f"__e.{k}") for k in "abcd"}
    mid, share = (F.col("__p.s") + F.col("__p.t")) / 2, F.col("__p.t") - F.col("__p.s")
    out = pieces.select(
        *[F.col(f"`{n}`") for n in pieces.columns[:-2]],
        F.floor((e["b"] + (e["d"] - e["b"]) * mid) / size).alias("m"),
        F.floor((e["a"] + (e["c"] - e["a"]) * mid) / size).alias("z"),
        (share * F.sqrt((e["c"] - e["a"]) * (e["c"] - e["a"]) + (e["d"] - e["b"]) * (e["d"] - e["b"]))).alias("len_m"),
    )
    return out.where(F.col("len_m") > SHORTEST_M)


#: Metres for a degree, whichever way it runs, of the mode deg111.
FLAT_M = 111_000.0
MODES = ("haversine", "deg111")
#: Ends of a ray in degrees, and the grid of its city.
ENDS, GRID = ("tx_lat", "tx_lon", "rx_lat", "rx_lon"), ("lat0", "lon0", "dphi", "dlam")


def _on_grid(rays: DataFrame, parameters: DataFrame) -> DataFrame:
    """`rays` with the parameters of their city's grid as `__lat0` and so on."""
    own = parameters.select("city", *[F.col(c).alias(f"__{c}") for c in GRID])
    return rays.join(F.broadcast(own), "city")  # a row for each city


def _numbers(table: pa.Table | pa.RecordBatch, column: str) -> np.ndarray:
    return np.asarray(table.column(column).to_numpy(zero_copy_only=False), dtype=np.float64)


def _cut(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ray, s and t of each piece: the shares of the way from (a, b) to (c, d) between which a ray is in one unit cell."""
    rays, cuts = [np.arange(len(a))] * 2, [np.zeros(len(a)), np.ones(len(a))]
    for lo, hi in ((a, c), (b, d)):
        first, last = np.floor(np.minimum(lo, hi)) + 1, np.ceil(np.maximum(lo, hi)) - 1
        many = np.maximum(last - first + 1, 0).astype(np.int64)
        own = np.repeat(np.arange(len(a)), many)
        line = first[own] + np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
        rays, cuts = [*rays, own], [*cuts, (line - lo[own]) / (hi - lo)[own]]
    ray, cut = np.concatenate(rays), np.concatenate(cuts)
    order = np.lexsort((cut, ray))
    ray, cut = ray[order], cut[order]
    same = ray[1:] == ray[:-1]
    return ray[:-1][same], cut[:-1][same], cut[1:][same]


def _tile_pieces(batch: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Row, m, z and ends in degrees of the pieces of a batch of `_on_grid`; rays without all ends give none."""
    ends = [_numbers(batch, c) for c in ENDS]
    lat0, lon0, dphi, dlam = (_numbers(batch, f"__{c}") for c in GRID)
    whole = np.flatnonzero(np.isfinite(np.sum(ends, axis=0)))
    ends = [e[whole] for e in ends]
    at = lambda v, origin, step: (np.radians(v) - origin[whole]) / step[whole] + 0.5
    b, a, d, c = at(ends[0], lat0, dphi), at(ends[1], lon0, dlam), at(ends[2], lat0, dphi), at(ends[3], lon0, dlam)
    i, s, t = _cut(a, b, c, d)
    mid = (s + t) / 2
    m, z = (np.floor(np.round(lo[i] + (hi - lo)[i] * mid, 9)).astype(np.int64) for lo, hi in ((b, d), (a, c)))
    return whole[i], m, z, [lo[i] + (hi - lo)[i] * k for k in (s, t) for lo, hi in (ends[::2], ends[1::2])]


def _length(ends: list[np.ndarray], mode: str) -> np.ndarray:
    if mode == "deg111":
        return FLAT_M * np.hypot(ends[2] - ends[0], ends[3] - ends[1])
    lat, lon, to_lat, to_lon = (np.radians(e) for e in ends)
    square = np.sin((to_lat - lat) / 2) ** 2 + np.cos(lat) * np.cos(to_lat) * np.sin((to_lon - lon) / 2) ** 2
    return 2 * EARTH_RADIUS_M * np.arcsin(np.sqrt(square))


def ray_split_tiles(rays: DataFrame, parameters: DataFrame, length_mode: str = "haversine") -> DataFrame:
    """A row for each piece of a ray (city; tx_lat, tx_lon, rx_lat, rx_lon in degrees) in a tile of the spherical grid:
    the columns of `rays`, m, z, len_m.  The tiles are those of `grid.assign_tiles`, whose borders lie half a tile from the
    centres.  A ray is straight in degrees; a piece has the great-circle length between its ends, or with "deg111"
    its length in degrees times 111,000, which counts a degree of longitude like one of latitude.  No shuffle; grid
    parameters (a row for each city) are sent."""
    if length_mode not in MODES:
        raise ValueError("length_mode is haversine or deg111")
    kept = [c for c in rays.columns if c not in ("m", "z", "len_m")]
    schema = StructType([rays.schema[c] for c in kept]).add("m", "long").add("z", "long").add("len_m", "double")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, m, z, ends = _tile_pieces(batch)
            length = _length(ends, length_mode)
            real = length > SHORTEST_M
            own = batch.select(kept).take(pa.array(i[real]))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(m[real]), pa.array(z[real]), pa.array(length[real])], [*kept, "m", "z", "len_m"])

    return _on_grid(rays, parameters).mapInArrow(work, schema)


def lengths_by_tile(rays: DataFrame, parameters: DataFrame, modes: tuple[str, ...] = MODES) -> DataFrame:
    """(mode, city, m, z, n, len_m): number and length of the pieces of `ray_split_tiles` in each tile, by several measures
    of length.  Batches are cut once and summed before they are shuffled."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, m, z, ends = _tile_pieces(batch)
            city = batch.column("city").dictionary_encode()
            if not len(i):
                continue
            low, high, wide = m.min(), m.max() - m.min() + 1, z.max() - z.min() + 1
            number, at = np.unique((city.indices.to_numpy()[i] * high + m - low) * wide + z - z.min(), return_inverse=True)
            spot = number // (high * wide), number // wide % high + low, number % wide + z.min()
            for mode in modes:
                length = _length(ends, mode)
                real = length > SHORTEST_M
                n, total = np.bincount(at[real], minlength=len(number)), np.bincount(at[real], length[real], len(number))
                some = n > 0
                names = city.dictionary.take(pa.array(spot[0][some]))
                yield pa.RecordBatch.from_arrays([pa.array([mode] * len(names), pa.string()), names, *(pa.array(x[some]) for x in (spot[1], spot[2], n, total))], ["mode", "city", "m", "z", "n", "len_m"])

    own = _on_grid(rays.select("city", *ENDS), parameters)
    sums = own.mapInArrow(work, "mode string, city string, m long, z long, n long, len_m double")
    return sums.groupBy("mode", "city", "m", "z").agg(F.sum("n").alias("n"), F.sum("len_m").alias("len_m"))


def conjugate_gradients(gram: DataFrame, right: DataFrame, close: float = 1e-10, most: int = 5000) -> DataFrame:
    """(city, i, x) with gram x = b in every city, by conjugate gradients scaled by the diagonal.  gram: city, i, j, g
    with both triangles; right: city, i, b.  Chronopoulos and Gear's form needs both of a step's sums at one point, so a
    step is one join and sum over the entries of `gram`, one table written, and two numbers of each city that reach the
    driver.  Cities that have settled take no more steps.  Not settled after `most` steps is an error."""
    diagonal = gram.where("i = j").select("city", "i", F.col("g").alias("d"))
    zero = [F.lit(0.0).alias(c) for c in ("x", "p", "s")]
    now = right.join(diagonal, ["city", "i"]).select("city", "i", "d", F.col("b").alias("r"), *zero)
    spark, open_, first = gram.sparkSession, None, True
    goal: dict[str, float] = {}
    old: dict[str, tuple[float, float]] = {}  # of each city the size of r, and the last step
    u = F.col("r") / F.col("d")
    for _ in range(most):
        ahead = now.select("city", F.col("i").alias("j"), u.alias("u"))
        if not first:
            ahead = ahead.where(F.col("city").isin(open_)) if len(open_) <= 1000 else ahead.join(spark.createDataFrame([(c,) for c in open_], "city string"), "city", "left_semi")
        ways = gram.join(ahead, ["city", "j"]).groupBy("city", "i").agg(F.sum(F.col("g") * F.col("u")).alias("w"))
        now = stage(now.join(ways, ["city", "i"], "left").fillna(0.0, ["w"]), "gradients")
        steps, open_ = [], []
        for city, size, product in now.groupBy("city").agg(F.sum(F.col("r") * u), F.sum(F.col("w") * u)).collect():  # a row for each city
            goal.setdefault(city, size)
            if size <= close * close * goal[city]:
                continue
            before, step = old.get(city, (0.0, 0.0))
            beta = size / before if before else 0.0
            alpha = size / (product - (beta * size / step if step else 0.0))
            old[city] = (size, alpha)
            open_.append(city)
            steps.append((city, alpha, beta))
        if not open_:
            return now.select("city", "i", "x")
        sent = F.broadcast(spark.createDataFrame(steps, "city string, alpha double, beta double"))  # a row for each city
        alpha, beta = F.coalesce("alpha", F.lit(0.0)), F.coalesce("beta", F.lit(0.0))
        turned = now.join(sent, "city", "left").withColumns({"alpha": alpha, "p": u + beta * F.col("p"), "s": F.col("w") + beta * F.col("s")})
        now = turned.withColumns({"x": F.col("x") + F.col("alpha") * F.col("p"), "r": F.col("r") - F.col("alpha") * F.col("s")}).drop("w", "alpha", "beta")
        first = False
    raise RuntimeError("conjugate gradients did not settle")


#: Tiles of a city whose products a task holds as one matrix, and entries of all its matrices after which they are given out.
MOST_TILES, MOST_ENTRIES = 1000, 8_000_000
PRODUCTS = "city string, i long, j long, g double, n long"


class _Products:
    """Sums of products of the columns of rays by city, as matrices of the tiles that occur.  Entries (i, j, g) with
    i <= j are those of the columns; with j = -1, of a column and the losses, with the number of rays."""

    def __init__(self) -> None:
        self.own: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}

    def add(self, city: str, i: np.ndarray, tile: np.ndarray, length: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Pieces (ray i, rising, with tile and length) of the rays with losses y."""
        tiles, at = np.unique(tile, return_inverse=True)
        if len(tiles) > MOST_TILES and len(y) > 1:
            half = len(y) // 2
            first = i < half
            yield from self.add(city, i[first], tile[first], length[first], y[:half])
            yield from self.add(city, i[~first] - half, tile[~first], length[~first], y[half:])
            return
        held = self.own.get(city)
        ids = tiles if held is None else np.union1d(held[0], tiles)
        if held is not None and len(ids) > MOST_TILES:
            yield from self.given(city)
            held, ids = None, tiles
        if held is None or len(ids) > len(held[0]):
            grown = ids, np.zeros((2 * len(ids), 2 * len(ids))), np.zeros(2 * len(ids)), np.zeros(len(ids), np.int64)
            if held is not None:
                to = np.searchsorted(ids, held[0])
                both = np.stack([2 * to, 2 * to + 1], 1).ravel()
                grown[1][np.ix_(both, both)], grown[2][both], grown[3][to] = held[1:]
            self.own[city] = held = grown
        to = np.searchsorted(ids, tiles)
        both, step = np.stack([2 * to, 2 * to + 1], 1).ravel(), max(1, 2_000_000 // max(1, 2 * len(tiles)))
        for begin in range(0, len(y), step):
            n = min(step, len(y) - begin)
            lo, hi = np.searchsorted(i, (begin, begin + n))
            summed = np.zeros((n, len(tiles)))
            np.add.at(summed, (i[lo:hi] - begin, at[lo:hi]), length[lo:hi])  # a ray may have several pieces in a tile
            a = np.zeros((n, len(tiles), 2))
            a[:, :, 0] = 10 * np.log10(np.maximum(summed, 1.0))
            a[:, :, 1] = summed / np.maximum(summed.sum(1), 1.0)[:, None]
            a = a.reshape(n, -1)
            held[1][np.ix_(both, both)] += a.T @ a
            held[2][both] += a.T @ y[begin : begin + n]
            held[3][to] += (summed > 0).sum(0)
        if sum(h[1].size for h in self.own.values()) > MOST_ENTRIES:
            yield from self.rest()

    def given(self, city: str) -> Iterator[pa.RecordBatch]:
        ids, gram, right, n = self.own.pop(city)
        unknown = np.stack([2 * ids, 2 * ids + 1], 1).ravel()
        i, j = np.nonzero(np.triu(gram != 0) | np.eye(len(gram), dtype=bool))
        none = np.zeros(len(i), np.int64)
        entry = [np.concatenate(x) for x in ((unknown[i], unknown), (unknown[j], np.full(len(unknown), -1)), (gram[i, j], right), (none, np.repeat(n, 2)))]
        yield pa.RecordBatch.from_arrays([pa.array([city] * len(entry[0]), pa.string()), *map(pa.array, entry)], ["city", "i", "j", "g", "n"])

    def rest(self) -> Iterator[pa.RecordBatch]:
        for city in list(self.own):
            yield from self.given(city)

    def add_batch(self, city: pa.Array, i: np.ndarray, tile: np.ndarray, length: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Pieces of the rows of a batch, of which each has its city and loss."""
        code = city.dictionary_encode()
        of, names = code.indices.to_numpy(), code.dictionary.to_pylist()
        for k, name in enumerate(names):
            some, own = of == k, of[i] == k
            yield from self.add(name, (np.cumsum(some) - 1)[i[own]], tile[own], length[own], y[some])


def _losses(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(pc.fill_null(batch.column("y"), 0.0).to_numpy(zero_copy_only=False), dtype=np.float64)


def mixed_path_fit(segments: DataFrame, damp: float = 1e-3, max_unknowns: int = 3000) -> DataFrame:
    """(city, tile, n, gamma, pl0) of the damped least-squares fit of

        pathloss = sum over tiles of  10 gamma log10(max(len, 1)) + pl0 len / total length

    `segments`: city, ray (unique in its city), tile (long), len_m, pathloss_db.  The products of the columns
    of rays are summed within each task first; a city's task gets only its normal equations, with two unknowns for each
    tile.  Cities with over `max_unknowns` unknowns are solved by conjugate gradients over all tasks."""
    piece = F.struct("tile", F.col("len_m").cast("double").alias("len_m"))
    own = segments.groupBy("city", "ray").agg(F.collect_list(piece).alias("pieces"), F.first("pathloss_db").cast("double").alias("y"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Products()
        for batch in batches:
            pieces = batch.column("pieces")
            i, inner = pc.list_parent_indices(pieces).to_numpy(), pc.list_flatten(pieces)
            yield from sums.add_batch(batch.column("city"), i, inner.field("tile").to_numpy().astype(np.int64), inner.field("len_m").to_numpy(), _losses(batch))
        yield from sums.rest()

    return _solved(own.mapInArrow(work, PRODUCTS), damp, max_unknowns)


def tile_path_fit(rays: DataFrame, parameters: DataFrame, key: tuple[str, ...], damp: float = 1e-3, max_unknowns: int = 3000) -> DataFrame:
    """(city, m, z, n, gamma, pl0): `mixed_path_fit` of rays (city, key, tx_lat, tx_lon, rx_lat, rx_lon, pathloss_db) on the
    spherical tiles.  Rows of a city with the same key have the same ends and are one ray, as often as they are there.  Rays
    are shuffled, not their pieces: a task cuts a batch and adds it up."""
    keyed = rays.select("city", *key, *ENDS, F.col("pathloss_db").alias("y")).repartition("city", *key)
    once = keyed.groupBy("city", *key).agg(*[F.first(c).alias(c) for c in (*ENDS, "y")], F.count("*").alias("times"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Products()
        for batch in batches:
            i, m, z, ends = _tile_pieces(batch)
            length = _length(ends, "haversine")
            real = length > SHORTEST_M
            i, tile = i[real], (m[real] + OFFSET) * STRIDE + z[real] + OFFSET
            yield from sums.add_batch(batch.column("city"), i, tile, length[real] * _numbers(batch, "times")[i], _losses(batch))
        yield from sums.rest()

    fitted = _solved(_on_grid(once.drop(*key), parameters).mapInArrow(work, PRODUCTS), damp, max_unknowns)
    return fitted.select("city", (F.expr(f"tile div {STRIDE}") - OFFSET).alias("m"), (F.col("tile") % STRIDE - OFFSET).alias("z"), "n", "gamma", "pl0")


def _solved(products: DataFrame, damp: float, max_unknowns: int) -> DataFrame:
    """The damped solutions of the equations that `_Products` gives in parts."""
    system = stage(products.groupBy("city", "i", "j").agg(F.sum("g").alias("g"), F.sum("n").alias("n")), "products")
    fine = system.where("j < 0").groupBy("city").count().where(F.col("count") > max_unknowns).select("city")
    coarse = system.join(fine, "city", "left_anti")

    def solve(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        b, g = own[own.j < 0].sort_values("i"), own[own.j >= 0]
        ids = b.i.to_numpy()
        full = np.zeros((len(ids), len(ids)))
        at, to = np.searchsorted(ids, g.i.to_numpy()), np.searchsorted(ids, g.j.to_numpy())
        full[at, to] = full[to, at] = g.g.to_numpy()
        x = np.linalg.solve(full + damp * damp * np.eye(len(ids)), b.g.to_numpy())
        return pd.DataFrame({"city": key[0], "tile": ids[::2] // 2, "n": b.n.to_numpy(dtype=np.int64)[::2], "gamma": x[::2], "pl0": x[1::2]})

    solved = coarse.groupBy("city").applyInPandas(solve, "city string, tile long, n long, gamma double, pl0 double")
    if fine.isEmpty():
        return solved
    large = system.join(fine, "city", "left_semi")
    large, b = large.where("j >= 0").drop("n"), large.where("j < 0").select("city", "i", F.col("g").alias("b"), "n")
    damped = large.select("city", "i", "j", (F.col("g") + F.when(F.col("i") == F.col("j"), F.lit(damp * damp)).otherwise(0.0)).alias("g"))
    mirrored = damped.where("i < j").select("city", F.col("j").alias("i"), F.col("i").alias("j"), "g")
    x = conjugate_gradients(stage(damped.unionByName(mirrored), "gram"), b.select("city", "i", "b"))
    value = lambda odd: F.max(F.when(F.col("i") % 2 == odd, F.col("x")))
    found = x.join(b.select("city", "i", "n"), ["city", "i"]).groupBy("city", F.expr("i div 2").alias("tile")).agg(F.max("n").alias("n"), value(0).alias("gamma"), value(1).alias("pl0"))
    return solved.unionByName(found)
