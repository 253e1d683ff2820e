"""Log-distance fits per tile, from mergeable statistics, and their standard errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from radiotiles.sources.scratch import stage

#: With n rows of (x, y): means mx, my and centred sums cxx, cxy, cyy.  lam pulls to (g0, p0).
SX, SY = "(n * mx)", "(n * my)"
SXX, SXY = "(cxx + n * mx * mx)", "(cxy + n * mx * my)"
DET = f"(({SXX} + lam) * (n + lam) - {SX} * {SX})"
RIDGE_GAMMA = f"((n + lam) * ({SXY} + lam * g0) - {SX} * ({SY} + lam * p0)) / {DET}"
RIDGE_PL0 = f"(({SXX} + lam) * ({SY} + lam * p0) - {SX} * ({SXY} + lam * g0)) / {DET}"
SSE = "greatest(cyy - 2 * gamma * cxy + gamma * gamma * cxx + n * (my - gamma * mx - pl0) * (my - gamma * mx - pl0), 0)"
VAR_GAMMA = f"((n + lam) * (n + lam) * {SXX} - 2 * (n + lam) * {SX} * {SX} + {SX} * {SX} * n) / ({DET} * {DET})"
VAR_PL0 = f"({SX} * {SX} * {SXX} - 2 * {SX} * ({SXX} + lam) * {SX} + ({SXX} + lam) * ({SXX} + lam) * n) / ({DET} * {DET})"


def statistics(points: DataFrame, *keys: str, x: str = "x", y: str = "y") -> DataFrame:
    """n, mx, my, cxx, cxy, cyy for each key: one hash aggregate with partial sums before the shuffle."""
    return points.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg(x).alias("mx"),
        F.avg(y).alias("my"),
        (F.var_pop(x) * F.count("*")).alias("cxx"),
        (F.covar_pop(x, y) * F.count("*")).alias("cxy"),
        (F.var_pop(y) * F.count("*")).alias("cyy"),
    )


def tile_moments(points: DataFrame) -> DataFrame:
    """The statistics of each tile, written: the one pass over the rows from which all fits come."""
    return stage(statistics(points, "city", "m", "z"), "moments")


def station_moments(points: DataFrame) -> DataFrame:
    """As `tile_moments`, for each station (bs_id, as text) within a tile, for fits of halves."""
    return stage(statistics(points.withColumn("bs_id", F.col("bs_id").cast("string")), "city", "m", "z", "bs_id"), "moments")


def merged(moments: DataFrame, *keys: str) -> DataFrame:
    """Statistics of larger groups from those of their parts.  Products are taken about the mean of the city, so that no digits
    go to the distance of the values from 0."""
    about = moments.groupBy("city").agg((F.sum(F.expr("n * mx")) / F.sum("n")).alias("ax"), (F.sum(F.expr("n * my")) / F.sum("n")).alias("ay"))
    own = moments.join(F.broadcast(about), "city")  # a row for each city
    shift = {"dx": "mx - ax", "dy": "my - ay"}
    sums = own.withColumns({k: F.expr(v) for k, v in shift.items()}).groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.first("ax").alias("ax"),
        F.first("ay").alias("ay"),
        F.expr("sum(n * dx) / sum(n)").alias("ex"),
        F.expr("sum(n * dy) / sum(n)").alias("ey"),
        *[F.expr(f"sum({c} + n * {u} * {v})").alias(c) for c, u, v in (("cxx", "dx", "dx"), ("cxy", "dx", "dy"), ("cyy", "dy", "dy"))],
    )
    centred = {c: F.expr(f"{c} - n * {u} * {v}") for c, u, v in (("cxx", "ex", "ex"), ("cxy", "ex", "ey"), ("cyy", "ey", "ey"))}
    return sums.select(*keys, "n", F.expr("ax + ex").alias("mx"), F.expr("ay + ey").alias("my"), *[v.alias(c) for c, v in centred.items()])


def _slope() -> Column:
    return F.when(F.col("cxx") > 1e-9, F.col("cxy") / F.nullif(F.col("cxx"), F.lit(0.0)))


def with_least_squares(stats: DataFrame) -> DataFrame:
    """gamma and pl0 by least squares (null where x is constant), and the root mean squared residual."""
    fitted = stats.withColumn("gamma", _slope()).withColumn("pl0", F.col("my") - F.col("gamma") * F.col("mx"))
    return fitted.withColumn("fit_rmse_db", F.sqrt(F.expr(SSE) / F.col("n")))


def fit_global(moments: DataFrame) -> DataFrame:
    return with_least_squares(merged(moments, "city")).select("city", "n", "gamma", "pl0", "fit_rmse_db")


def fit_local(tiles: DataFrame, moments: DataFrame, min_count: int = 10) -> DataFrame:
    """One row for each tile of the grid; gamma, pl0 and rmse are null below `min_count` rows.  `moments`: those of tiles
    or of their stations."""
    fitted = with_least_squares(by_tile(moments))
    enough = F.col("n") >= min_count
    own = fitted.select("city", "m", "z", "n", *[F.when(enough, F.col(c)).alias(c) for c in ("gamma", "pl0", "fit_rmse_db")])
    return tiles.select("city", "m", "z").join(own, ["city", "m", "z"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def with_ridge(stats: DataFrame, priors: DataFrame, n_prior: float = 50.0) -> DataFrame:
    """Fits shrunk to the city's global fit (city, g0, p0), with rmse, shrinkage and standard errors."""
    pulled = stats.join(F.broadcast(priors), "city").withColumn("lam", F.lit(float(n_prior)))  # a row for each city
    fitted = pulled.withColumn("gamma", F.expr(RIDGE_GAMMA)).withColumn("pl0", F.expr(RIDGE_PL0))
    s2 = F.expr(f"{SSE} / greatest(n - 2, 1)")
    return fitted.select(
        "*",
        F.sqrt(F.expr(SSE) / F.col("n")).alias("fit_rmse_db"),
        F.expr("lam / (lam + n * greatest(cxx / n, 1e-9D))").alias("shrinkage"),
        F.sqrt(F.greatest(s2 * F.expr(VAR_GAMMA), F.lit(0.0))).alias("gamma_se"),
        F.sqrt(F.greatest(s2 * F.expr(VAR_PL0), F.lit(0.0))).alias("pl0_se"),
    )


def by_tile(moments: DataFrame) -> DataFrame:
    return merged(moments, "city", "m", "z") if "bs_id" in moments.columns else moments


def priors_of(moments: DataFrame) -> DataFrame:
    return fit_global(moments).select("city", F.col("gamma").alias("g0"), F.col("pl0").alias("p0"))


def fit_ridge(tiles: DataFrame, moments: DataFrame, min_count: int = 10, n_prior: float = 50.0) -> DataFrame:
    """Shrunk fits of the tiles with at least `min_count` rows; other tiles of the grid have nulls."""
    names = ("gamma", "pl0", "fit_rmse_db", "shrinkage", "gamma_se", "pl0_se")
    fitted = with_ridge(by_tile(moments), priors_of(moments), n_prior)
    own = fitted.select("city", "m", "z", "n", *[F.when(F.col("n") >= min_count, F.col(c)).alias(c) for c in names])
    return tiles.select("city", "m", "z").join(own, ["city", "m", "z"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def fit_summary(fits: DataFrame) -> DataFrame:
    return fits.where("gamma is not null").groupBy("city").agg(
        F.count("*").alias("n_fitted"), F.percentile("gamma", F.lit(0.5)).alias("median_gamma"), F.percentile("fit_rmse_db", F.lit(0.5)).alias("median_rmse_db")
    )


def physics_residual(fits: DataFrame, moments: DataFrame) -> DataFrame:
    """Mean squared error of the tiles' parameters against their measurements, which their statistics tell."""
    joined = by_tile(moments).join(fits.select("city", "m", "z", "gamma", "pl0"), ["city", "m", "z"]).where("gamma is not null")
    return joined.groupBy("city").agg((F.sum(F.expr(SSE)) / F.greatest(F.sum("n"), F.lit(1))).alias("mse_db2"))


def station_halves(moments: DataFrame) -> DataFrame:
    """city, bs_id, in_first: the first half of each city's stations by name."""
    names = moments.select("city", "bs_id").distinct()
    by = Window.partitionBy("city")  # the stations of a city, not its rows
    return names.select("city", "bs_id", (F.row_number().over(by.orderBy("bs_id")) <= F.floor(F.count("*").over(by) / 2)).alias("in_first"))


def split_half(moments: DataFrame, min_half: int = 30, n_prior: float = 50.0) -> DataFrame:
    """Differences of the shrunk fits of two halves of the stations, tile by tile; `moments`: those of stations."""
    named = moments.join(station_halves(moments), ["city", "bs_id"])
    fitted = with_ridge(merged(named, "city", "m", "z", "in_first"), priors_of(moments), n_prior).where(F.col("n") >= min_half)
    of = lambda c, first: F.max(F.when(F.col("in_first") == first, F.col(c)))
    both = fitted.groupBy("city", "m", "z").agg((of("gamma", True) - of("gamma", False)).alias("gamma_diff"), (of("pl0", True) - of("pl0", False)).alias("pl0_diff"))
    return both.where("gamma_diff is not null")


def noise_summary(fits: DataFrame, halves: DataFrame) -> DataFrame:
    """Label noise of each city: analytic (root mean square of the errors) and from split halves."""
    rms = lambda c: F.sqrt(F.avg(F.col(c) * F.col(c)))
    analytic = fits.where("gamma_se is not null").groupBy("city").agg(F.count("*").alias("n_tiles"), rms("gamma_se").alias("gamma_se_analytic"), rms("pl0_se").alias("pl0_se_analytic"))
    split = halves.groupBy("city").agg(F.count("*").alias("n_split"), (F.stddev_pop("gamma_diff") / 2**0.5).alias("gamma_se_split"), (F.stddev_pop("pl0_diff") / 2**0.5).alias("pl0_se_split"))
    return analytic.join(split, "city", "left")


def corpus_rms(summary: DataFrame) -> DataFrame:
    rms = lambda c: F.sqrt(F.avg(F.col(c) * F.col(c)))
    return summary.agg(rms("gamma_se_analytic").alias("gamma_rms_analytic"), rms("gamma_se_split").alias("gamma_rms_split"))
