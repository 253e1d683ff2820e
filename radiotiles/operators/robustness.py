"""Climate features of points, noise on descriptors, and drift between two snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radiotiles.operators.transfer import masked
from radiotiles.sources.scratch import stage

KELVIN = 273.15


def climate_features(cube: DataFrame, points: DataFrame, variables: tuple[str, ...], step: float = 1.0, kelvin: tuple[str, ...] = ()) -> DataFrame:
    """Mean and population spread of each variable for each point and calendar month.

    `cube`: gi, gj (whole grid steps), time, month and the variables.  `points`: point_id, lat, lon.  A point
    meets the corners of its grid cell by an equi-join and takes their bilinear mean at each time; a time at
    which a corner with weight is missing does not count.  The means of `kelvin` variables are in Celsius.  Points at
    one place share what is worked out for it."""
    places = points.select("lat", "lon").distinct()
    gi, gj = F.floor(F.col("lat") / step), F.floor(F.col("lon") / step)
    u, v = F.col("lat") / step - gi, F.col("lon") / step - gj
    corner = lambda i, j, w: F.struct((gi + i).alias("gi"), (gj + j).alias("gj"), w.alias("w"))
    corners = F.explode(F.array(corner(0, 0, (1 - u) * (1 - v)), corner(0, 1, (1 - u) * v), corner(1, 0, u * (1 - v)), corner(1, 1, u * v)))
    weighted = places.select("lat", "lon", corners.alias("c")).select("lat", "lon", "c.*").where("w > 0")
    at = (
        weighted.join(cube, ["gi", "gj"])
        .groupBy("lat", "lon", "month", "time")
        .agg(F.sum("w").alias("w"), *[F.sum(F.col("w") * F.col(x)).alias(x) for x in variables])
        .where("w > 1 - 1e-9")
    )
    mean = lambda x: F.avg(x) - KELVIN if x in kelvin else F.avg(x)
    told = at.groupBy("lat", "lon", "month").agg(*[c for x in variables for c in (mean(x).alias(f"{x}_mean"), F.stddev_pop(x).alias(f"{x}_std"))])
    months = stage(told.select(F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"), *[c for c in told.columns if c not in ("lat", "lon")]), "places")
    own = points.join(months, (F.col("lat") == F.col("p_lat")) & (F.col("lon") == F.col("p_lon")))
    return own.select("point_id", *months.columns[2:])


def hash_normal(*key: Column) -> Column:
    """A standard normal deviate decided by the key (Box-Muller on two pieces of an MD5)."""
    digest = F.md5(F.concat_ws("|", *key))
    piece = lambda a: F.conv(F.substring(digest, a, 8), 16, 10).cast("double")
    u1, u2 = (piece(1) + 1) / 4294967297.0, piece(9) / 4294967296.0
    return F.sqrt(-2 * F.log(u1)) * F.cos(2 * 3.141592653589793 * u2)


def noisy(tiles: DataFrame, levels: tuple[float, ...], seed: int = 0) -> DataFrame:
    """The tiles once for each level, with normal noise of that spread added to each value of v."""
    each = tiles.withColumn("level", F.explode(F.array(*[F.lit(float(s)) for s in levels])))
    deviate = lambda i: hash_normal(F.lit(str(seed)), F.col("tile").cast("string"), i.cast("string"), F.round(F.col("level") * 1000).cast("int").cast("string"))
    return each.withColumn("v", F.transform("v", lambda x, i: x + F.col("level") * deviate(i)))


def swept(tiles: DataFrame, groups: dict[str, tuple[int, int]], levels: tuple[float, ...], seed: int = 0) -> DataFrame:
    """The tiles once for each level of noise and each group of descriptors (first to last place) that is left out, and
    once with none left out: columns level and without."""
    rows = {"none": (-1, -1), **groups}
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("without"), F.lit(a).alias("first"), F.lit(b).alias("last")) for n, (a, b) in rows.items()]))
    out = noisy(tiles, levels, seed).withColumn("__g", each)
    return out.withColumn("v", masked(F.col("v"), F.col("__g.first"), F.col("__g.last"))).withColumn("without", F.col("__g.without")).drop("__g")


def drift(old: DataFrame, new: DataFrame, keys: tuple[str, ...], values: tuple[str, ...]) -> DataFrame:
    """Every tile of either snapshot with the change of each value; a snapshot without the tile counts as 0."""
    pick = lambda df, tag: df.select(*keys, F.lit(True).alias(f"in_{tag}"), *[F.col(c).cast("double").alias(f"{c}_{tag}") for c in values])
    both = pick(old, "old").join(pick(new, "new"), list(keys), "full")
    change = [(F.coalesce(f"{c}_new", F.lit(0.0)) - F.coalesce(f"{c}_old", F.lit(0.0))).alias(f"{c}_delta") for c in values]
    return both.select(*keys, F.coalesce("in_old", F.lit(False)).alias("in_old"), F.coalesce("in_new", F.lit(False)).alias("in_new"), *change)
