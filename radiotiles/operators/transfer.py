"""Parameters for a city without measurements, from the tiles of others."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radiotiles.functions.radio import hash_rank_key
from radiotiles.operators.blocks import block_pairs, matrix, squared_distances
from radiotiles.operators.metrics import average_ranks
from radiotiles.sources.scratch import stage

# The widths that are tried.
SIGMAS = (0.05, 0.1, 0.2, 0.3, 0.5, 0.8, 1.0, 1.5, 2.0)
TARGETS = ("gamma", "pl0")
#: The least squared residual of which a log is taken.
LEAST_SQUARE = 1e-12


def column_max(stacked: DataFrame, by: str = "fold") -> DataFrame:
    """(by, scale): the largest absolute value of each dimension, 1 where all are 0."""
    dims = stacked.select(by, F.posexplode("v").alias("i", "x")).groupBy(by, "i").agg(F.max(F.abs("x")).alias("a"))
    listed = dims.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("i", "a"))).alias("s"))  # a value for each dimension
    return listed.select(by, F.transform("s", lambda e: F.when(e["a"] == 0, F.lit(1.0)).otherwise(e["a"])).alias("scale"))


def normalised(stacked: DataFrame, scales: DataFrame, by: str = "fold") -> DataFrame:
    return stacked.join(F.broadcast(scales), by).withColumn("v", F.zip_with("v", "scale", lambda x, s: x / s)).drop("scale")  # a row for each fold


def masked(v: Column, first: Column | int, last: Column | int) -> Column:
    """Zeros in dimensions first..last (from 0)."""
    return F.transform(v, lambda x, i: F.when(i.between(first, last), F.lit(0.0)).otherwise(x))


def nonzero_dimensions(tiles: DataFrame, by: str = "city") -> DataFrame:
    dims = tiles.select(by, F.posexplode("v").alias("i", "x")).groupBy(by, "i").agg(F.sum(F.abs("x")).alias("s"))
    return dims.groupBy(by).agg(F.count_if(F.col("s") != 0).alias("n_nonzero"))


def _kernels(d2: np.ndarray, sigmas: tuple[float, ...]) -> dict[float, np.ndarray]:
    """exp(-d2 / 2 sigma^2) of each width; where the squares of two widths have a whole ratio, the narrower one's is a power of
    the wider one's, which takes a few products in place of an exponential."""
    out: dict[float, np.ndarray] = {}
    for s in sorted(set(sigmas), reverse=True):
        ratios = sorted((round((w / s) ** 2), w) for w in out if abs((w / s) ** 2 - round((w / s) ** 2)) < 1e-9 and round((w / s) ** 2) <= 25)
        if not ratios:
            out[s] = np.exp(d2 * (-0.5 / (s * s)))
            continue
        power, base = ratios[0][0], out[ratios[0][1]]
        found = None
        while power:
            if power & 1:
                found = base if found is None else found * base
            power >>= 1
            if power:
                base = base * base
        out[s] = found
    return out


#: Rows of either side of the products that are held at one time.
TALL, WIDE = 128, 512
#: Rows of a block where blocks of tiles meet: with more, fewer copies are sent.
PER_BLOCK = 16_000


def kernel_products(x: np.ndarray, z: np.ndarray, y: np.ndarray, sigmas: tuple[float, ...]) -> np.ndarray:
    """(width, row of x, column of y): the kernels of the rows of x and z times y, in parts that stay in a core's cache."""
    out = np.zeros((len(sigmas), len(x), y.shape[1]))
    for j in range(0, len(z), WIDE):
        near, values = z[j : j + WIDE], y[j : j + WIDE]
        for i in range(0, len(x), TALL):
            own = _kernels(squared_distances(x[i : i + TALL], near), sigmas)
            for k, s in enumerate(sigmas):
                out[k, i : i + TALL] += own[s] @ values
    return out


def kernel_sums(test: DataFrame, train: DataFrame, sigmas: tuple[float, ...]) -> DataFrame:
    """(fold, tile, i, w, gamma, pl0): for each test tile and width i the sums of the weights exp(-d2 / 2 sigma^2) of the
    fold's train tiles, alone and times their parameters.  Blocks of tiles meet as matrix products."""

    def work(a: pa.Table, b: pa.Table) -> pa.Table:
        y = np.stack([np.ones(b.num_rows), *(b.column(t).to_numpy() for t in TARGETS)], 1)
        names = a.select(["fold", "tile"])
        parts = [names.append_column("i", pa.array(np.full(a.num_rows, i, np.int32))) for i in range(len(sigmas))]
        if not a.num_rows or not b.num_rows:
            sums = np.zeros((len(sigmas), a.num_rows, y.shape[1]))
        else:
            sums = kernel_products(matrix(a, "v"), matrix(b, "v"), y, sigmas)
        for k, c in enumerate(("w", *TARGETS)):
            parts = [t.append_column(c, pa.array(sums[i][:, k])) for i, t in enumerate(parts)]
        return pa.concat_tables(parts)

    left, right = test.select("fold", "tile", "v"), train.select("fold", "tile", "v", *TARGETS)
    part = block_pairs(left, right, ("fold",), "tile", work, f"fold {test.schema['fold'].dataType.simpleString()}, tile {test.schema['tile'].dataType.simpleString()}, i int, w double, gamma double, pl0 double", per_block=PER_BLOCK)
    return part.groupBy("fold", "tile", "i").agg(*[F.sum(c).alias(c) for c in ("w", *TARGETS)])


def _mean(t: str) -> Column:
    return F.col(t) / F.greatest("w", F.lit(1e-30))


def gaussian_predict(test: DataFrame, train: DataFrame, sigma: float) -> DataFrame:
    """Weighted means of the fold's train parameters, weights exp(-d2 / 2 sigma^2); 0 where all underflow."""
    return kernel_sums(test, train, (sigma,)).select("fold", "tile", *[_mean(t).alias(f"{t}_pred") for t in TARGETS])


def gaussian_predict_at(test: DataFrame, train: DataFrame, widths: DataFrame, grid: tuple[float, ...] = SIGMAS) -> DataFrame:
    """As `gaussian_predict`, at a width of its own for each fold (fold, sigma: one of `grid`)."""
    own = kernel_sums(test, train, grid).withColumn("sigma", F.get(F.array(*[F.lit(float(s)) for s in grid]), F.col("i")))
    return own.join(widths.select("fold", "sigma"), ["fold", "sigma"]).select("fold", "tile", *[_mean(t).alias(f"{t}_pred") for t in TARGETS])


def select_sigma(validation: DataFrame, train: DataFrame, grid: tuple[float, ...] = SIGMAS) -> DataFrame:
    """(fold, sigma, err): the width of least squared error on validation tiles; the first wins ties."""
    truth = validation.select("fold", "tile", *[F.col(t).alias(f"{t}_true") for t in TARGETS])
    off = kernel_sums(validation, train, grid).join(truth, ["fold", "tile"])
    error = sum(F.pow(_mean(t) - F.col(f"{t}_true"), F.lit(2)) for t in TARGETS)
    errs = off.groupBy("fold", "i").agg((F.sum(error) / (len(TARGETS) * F.count("*"))).alias("err"))
    best = errs.groupBy("fold").agg(F.min(F.struct("err", "i")).alias("b"))
    return best.select("fold", F.get(F.array(*[F.lit(float(s)) for s in grid]), F.col("b.i")).alias("sigma"), F.col("b.err").alias("err"))


def median_predictor(train: DataFrame) -> DataFrame:
    return train.groupBy("fold").agg(*[F.percentile(t, F.lit(0.5)).alias(f"{t}_pred") for t in TARGETS])


def city_products(tiles: DataFrame, targets: tuple[str, ...] = TARGETS) -> DataFrame:
    """(city, n, width, products, largest): what ridge fits of any set of cities need, from one pass over the tiles.  products:
    the sums of the products of (1, v, targets) with one another, row by row; largest: the largest absolute value of
    each dimension.  Tiles with a null or a non-finite target are left out.  Each batch gives a matrix for each of its
    cities, Spark sums them."""
    finite_ = [F.col(t).isNotNull() & ~F.isnan(t) for t in targets]
    kept = tiles.where(reduce(lambda x, y: x & y, finite_)).select("city", F.col("v").cast("array<double>").alias("v"), *[F.col(t).cast("double").alias(t) for t in targets])
    schema = f"city {tiles.schema['city'].dataType.simpleString()}, products array<double>, largest array<double>"

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not table.num_rows:
                continue
            x = np.column_stack([np.ones(table.num_rows), matrix(table, "v"), *(table.column(t).to_numpy() for t in targets)])
            names, place = np.unique(np.array(table.column("city").to_pylist(), object).astype(str), return_inverse=True)
            first = [int(np.flatnonzero(place == k)[0]) for k in range(len(names))]
            own = [x[place == k] for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(
                [table.column("city").take(pa.array(first)).combine_chunks(), pa.array([(o.T @ o).ravel().tolist() for o in own], pa.list_(pa.float64())), pa.array([np.abs(o[:, 1 : -len(targets)]).max(0).tolist() for o in own], pa.list_(pa.float64()))],
                names=["city", "products", "largest"],
            )

    parts = stage(kept.mapInArrow(products, schema), "products")  # a few rows for each city and task
    sums = summed(parts, ("city",), "products", F.sum)
    most = summed(parts, ("city",), "largest", F.max)
    return sums.join(most, "city").select("city", F.get("products", 0).cast("long").alias("n"), F.sqrt(F.size("products")).cast("int").alias("width"), "products", "largest")


def summed(rows: DataFrame, keys: tuple[str, ...], column: str, by) -> DataFrame:
    """Arrays of equal length added up (or whatever `by` does) place by place."""
    cells = rows.select(*keys, F.posexplode(column).alias("at", "x")).groupBy(*keys, "at").agg(by("x").alias("x"))
    listed = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("s"))  # an array for each key
    return listed.select(*keys, F.transform("s", lambda e: e["x"]).alias(column))


def fold_products(cities: DataFrame, splits: DataFrame, roles: tuple[str, ...] = ("train",)) -> DataFrame:
    """(fold, products, largest) of the cities with these roles.  Sums are those of all cities less those of the
    fold's few others, so they cost a row for each fold and not one for each pair of cities."""
    out = splits.where(~F.col("role").isin(*roles)).join(cities, "city")
    folds = splits.select("fold").distinct()
    total = summed(cities.select("products"), (), "products", F.sum)
    less = folds.join(summed(out, ("fold",), "products", F.sum).withColumnRenamed("products", "less"), "fold", "left")
    left = F.when(F.col("less").isNull(), F.col("products")).otherwise(F.zip_with("products", "less", lambda x, y: x - y))
    # the largest value has no inverse: of each dimension the three largest cities would do for two others; all are taken
    most = summed(splits.where(F.col("role").isin(*roles)).join(cities, "city"), ("fold",), "largest", F.max)
    return less.crossJoin(F.broadcast(total)).select("fold", left.alias("products")).join(most, "fold")  # one row


def ridge_fits(products: DataFrame, alpha: float = 1.0, targets: tuple[str, ...] = TARGETS, fitted: tuple[str, ...] | None = None) -> DataFrame:
    """(fold, target, n, b, w): ridge regressions with a free intercept on descriptors divided by the fold's largest
    values, as coefficients of the raw ones; `products` has the sums of (1, v, targets).  A task solves a fold's
    equations of one unknown for each dimension."""
    fitted = fitted or targets

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for fold, sums, most in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                g = np.array(sums).reshape(int(round(len(sums) ** 0.5)), -1)
                d, n = len(most), g[0, 0]
                if round(n) < 1:
                    continue
                scale = np.array([m or 1.0 for m in most])
                mean = g[0, 1 : d + 1] / n
                centred = (g[1 : d + 1, 1 : d + 1] - n * np.outer(mean, mean)) / np.outer(scale, scale)
                for t in fitted:
                    k = d + 1 + targets.index(t)
                    right = (g[1 : d + 1, k] - n * mean * (g[0, k] / n)) / scale
                    w = np.linalg.solve(centred + alpha * np.eye(d), right) / scale
                    out.append((fold, t, int(round(n)), float(g[0, k] / n - mean @ w), w.tolist()))
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1]), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.float64()), pa.array(columns[4], pa.list_(pa.float64()))], names=["fold", "target", "n", "b", "w"])

    return products.select("fold", "products", "largest").mapInArrow(solve, f"fold {products.schema['fold'].dataType.simpleString()}, target string, n long, b double, w array<double>")


def ridge_by_fold(tiles: DataFrame, splits: DataFrame, alpha: float = 1.0, targets: tuple[str, ...] = TARGETS, roles: tuple[str, ...] = ("train",)) -> DataFrame:
    """Ridge fits of every fold and target from one pass over the tiles (city, v, targets), written: a row for each fold
    and target."""
    return stage(ridge_fits(fold_products(stage(city_products(tiles, targets), "cities"), splits, roles), alpha, targets), "fits")


def fold_scales(products: DataFrame) -> DataFrame:
    """(fold, scale): the divisors of `column_max` from the sums of `fold_products`."""
    return products.select("fold", F.transform("largest", lambda x: F.when(x == 0, F.lit(1.0)).otherwise(x)).alias("scale"))


def linear_predictions(fits: DataFrame, test: DataFrame) -> DataFrame:
    """(fold, tile, target, pred) by linear fits (fold, target, b, w): one pass over the test tiles (fold, tile, v)."""
    own = fits.select("fold", "target", "b", "w")
    return test.join(own, "fold").select("fold", "tile", "target", (F.col("b") + dot("v", "w")).alias("pred"))


def log_variance_fits(tiles: DataFrame, splits: DataFrame, fits: DataFrame, target: str = "gamma", alpha: float = 1.0, roles: tuple[str, ...] = ("train",)) -> DataFrame:
    """(fold, target, n, b, w): a second regression in each fold, of the log of the squared residual of its training
    tiles under its own fit, on the descriptors.  The products of the descriptors are those of `city_products`; the
    residuals of a tile in all folds come from one matrix product, so the tiles are read once more and never copied
    by fold.  Fits are sent to all tasks in groups of 256 folds."""
    cities = stage(city_products(tiles, (target,)), "cities")
    base = fold_products(cities, splits, roles)
    models = fits.where(F.col("target") == target).join(splits.where(F.col("role").isin(*roles)).groupBy("fold").agg(F.collect_list("city").alias("cities")), "fold")
    known = models.select("fold", "b", "w", "cities").orderBy("fold").toLocalIterator()
    own = tiles.where(F.col(target).isNotNull() & ~F.isnan(target)).select("city", F.col("v").cast("array<double>").alias("v"), F.col(target).cast("double").alias("y"))
    fold_type, out = fits.schema["fold"].dataType.simpleString(), None
    while group := list(islice(known, 256)):
        b, w = np.array([r["b"] for r in group]), np.array([r["w"] for r in group]).T
        member: dict = {}
        for k, r in enumerate(group):
            for c in r["cities"]:
                member.setdefault(c, []).append(k)
        names = [r["fold"] for r in group]

        def second(batches: Iterator[pa.RecordBatch], b=b, w=w, member=member, names=names) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((w.shape[1], w.shape[0] + 1))
            for batch in batches:
                table = pa.Table.from_batches([batch])
                if not table.num_rows:
                    continue
                x, y = matrix(table, "v"), table.column("y").to_numpy()
                z = np.log(np.maximum((y[:, None] - b[None, :] - x @ w) ** 2, LEAST_SQUARE))
                mine = np.zeros(z.shape, bool)
                for i, c in enumerate(table.column("city").to_pylist()):
                    mine[i, member.get(c, [])] = True
                z[~mine] = 0.0
                sums += z.T @ np.column_stack([np.ones(len(y)), x])
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(sums.tolist(), pa.list_(pa.float64()))], names=["fold", "right"])

        one = own.mapInArrow(second, f"fold {fold_type}, right array<double>")
        out = one if out is None else out.unionByName(one)
    if out is None:
        return fits.where("false")
    right = summed(out, ("fold",), "right", F.sum)
    # the sums of (1, v, log square): those of (1, v) with the new column; its own square is not needed
    d = F.size("largest")
    row = lambda i: F.concat(F.slice("products", i * (d + 2) + 1, d + 1), F.array(F.get("right", i)))
    square = F.concat(F.flatten(F.transform(F.sequence(F.lit(0), d), row)), F.col("right"), F.array(F.lit(0.0)))
    joined = base.join(right, "fold").select("fold", square.alias("products"), "largest")
    return stage(ridge_fits(joined, alpha, ("log_square",)), "fits")


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def second_sigma(fits: DataFrame, test: DataFrame, least: float = -8.0, most: float = 4.0) -> DataFrame:
    """(fold, tile, sigma, log_variance): sigma = exp(f / 2) of the predicted log variance f, clamped."""
    f = F.least(F.greatest("pred", F.lit(least)), F.lit(most))
    return linear_predictions(fits, test).select("fold", "tile", F.exp(f / 2).alias("sigma"), F.col("pred").alias("log_variance"))


def domain_separability(rows: DataFrame, side: str = "side", iterations: int = 100, reg: float = 1e-3, parts: int = 5, unit: str = "tile", seed: int = 0) -> tuple[DataFrame, float]:
    """A logistic classifier of two sides (0 source, 1 target) by v: the rows with `weight`, the odds p / (1 - p) of the
    target corrected for the sizes of the sides, and the area under the curve.  Rows fall into `parts` by a seeded hash of
    `unit`, and each part is told by a classifier of the others, so neither odds nor area come from rows that were
    learned from.  0.5: the sides cannot be told apart."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    part = F.pmod(F.conv(F.substring(hash_rank_key(seed, F.col(unit)), 1, 8), 16, 10).cast("long"), F.lit(parts))
    wide = stage(rows.withColumn("__part", part), "sides").withColumn("features", array_to_vector("v"))
    size = {r[side]: r["count"] for r in rows.groupBy(side).count().collect()}
    p = F.least(F.greatest(vector_to_array("probability")[1], F.lit(1e-6)), F.lit(1 - 1e-6))
    out = None
    for k in range(parts):
        model = LogisticRegression(featuresCol="features", labelCol=side, maxIter=iterations, regParam=reg).fit(wide.where(F.col("__part") != k))
        one = model.transform(wide.where(F.col("__part") == k)).withColumn("weight", p / (1 - p) * F.lit(size.get(0, 0) / max(size.get(1, 0), 1)))
        out = one if out is None else out.unionByName(one)
    told = stage(out.drop("features", "rawPrediction", "probability", "prediction", "__part"), "told")
    # the rank sum of the target's rows, ties at their mean
    ranks = average_ranks(told.withColumn("__all", F.lit(0)), ("weight",), "__all").select("value", "rank")
    total = told.where(F.col(side) == 1).join(ranks, F.col("weight") == F.col("value")).agg(F.sum("rank")).first()[0]
    a, b = size.get(0, 0), size.get(1, 0)
    return told, float((total - b * (b + 1) / 2) / (a * b)) if a and b else float("nan")


def bias_corrected(rows: DataFrame) -> DataFrame:
    """(fold, k, draw, tile, truth, pred, is_anchor): the anchors' mean residual is added for the others."""
    keys = ["fold", "k", "draw"]
    shift = rows.where("is_anchor").groupBy(*keys).agg(F.avg(F.col("truth") - F.col("pred")).alias("shift"))
    return rows.where("not is_anchor").join(F.broadcast(shift), keys).withColumn("pred", F.col("pred") + F.col("shift")).drop("shift")  # folds x k x draws rows


def residual_corrected(rows: DataFrame, alpha: float = 10.0) -> DataFrame:
    """As `bias_corrected`, by a ridge regression of the anchors' residuals on their v with a free intercept.  It
    is solved in its dual form of k x k, so a task holds a draw's anchors only."""
    keys = ["fold", "k", "draw"]

    def solve(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        x, y = np.stack(own["v"].to_list()), (own["truth"] - own["pred"]).to_numpy()
        centre = x.mean(0)
        c = x - centre
        w = c.T @ np.linalg.solve(c @ c.T + alpha * np.eye(len(y)), y - y.mean())
        return pd.DataFrame({"fold": [key[0]], "k": [key[1]], "draw": [key[2]], "b": [float(y.mean() - centre @ w)], "w": [w.tolist()]})

    types = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in keys]
    fits = rows.where("is_anchor").select(*keys, "v", "truth", "pred").groupBy(*keys).applyInPandas(solve, ", ".join([*types, "b double", "w array<double>"]))
    return rows.where("not is_anchor").join(fits, keys).withColumn("pred", F.col("pred") + F.col("b") + dot("v", "w")).drop("b", "w")


def shot_curve(rows: DataFrame, *keys: str) -> DataFrame:
    """Root mean squared error by k (and further keys), averaged over folds and draws."""
    e = F.col("truth") - F.col("pred")
    each = rows.groupBy("fold", *keys, "k", "draw").agg(F.sqrt(F.avg(e * e)).alias("rmse"))
    return each.groupBy(*keys, "k").agg(F.avg("rmse").alias("rmse"), F.count("*").alias("n_draws"))


def shot_table(modes: dict[str, DataFrame], unshot: DataFrame) -> DataFrame:
    """k and a column of errors for each mode of correction; `unshot` (fold, tile, truth, pred) gives the row of k = 0,
    which is the same in all modes."""
    zero = unshot.select("fold", "tile", "truth", "pred", F.lit(0).alias("k"), F.lit(0).alias("draw"))
    out = None
    for mode, rows in modes.items():
        both = rows.select("fold", "tile", "truth", "pred", "k", "draw").unionByName(zero)
        one = both.withColumn("mode", F.lit(mode))
        out = one if out is None else out.unionByName(one)
    return shot_curve(out, "mode").groupBy("k").pivot("mode", list(modes)).agg(F.first("rmse"))


def coral(rows: DataFrame, side: str = "side") -> DataFrame:
    """Squared Frobenius distance of the covariances of two sides (0 and 1), over 4 d^2.  Each batch of rows gives
    one product matrix for each side; their sums make the covariances."""

    def products(batches):
        for batch in batches:
            v, s = matrix(pa.Table.from_batches([batch]), "v"), batch.column(1).to_numpy()
            for k in (0, 1):
                own = np.column_stack([np.ones((s == k).sum()), v[s == k]]) if len(s) else np.empty((0, 1))
                if len(own):
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([(own.T @ own).ravel().tolist()], pa.list_(pa.float64()))], names=["side", "p"])

    parts = rows.select(F.col("v").cast("array<double>").alias("v"), F.col(side).cast("int").alias("side")).where("v is not null").mapInArrow(products, "side int, p array<double>")
    width = F.sqrt(F.size("p")).cast("int")  # one more than there are dimensions: the first row and column hold counts and sums
    cells = parts.select("side", width.alias("d"), F.posexplode("p").alias("at", "x")).groupBy("side", "d", "at").agg(F.sum("x").alias("x"))
    cells = cells.select("side", "d", F.expr("at div d").cast("int").alias("i"), (F.col("at") % F.col("d")).alias("j"), "x")
    first = cells.where("i = 0").select("side", F.col("j").alias("c"), F.col("x").alias("s"))  # a row for each dimension
    n = first.where("c = 0").select("side", F.col("s").alias("n"))
    cov = cells.where("i > 0 and j > 0").join(n, "side").join(first.withColumnsRenamed({"c": "i", "s": "si"}), ["side", "i"]).join(first.withColumnsRenamed({"c": "j", "s": "sj"}), ["side", "j"])
    cov = cov.groupBy("i", "j", "d").agg(F.sum(F.when(F.col("side") == 0, 1).otherwise(-1) * F.coalesce((F.col("x") - F.col("si") * F.col("sj") / F.col("n")) / F.nullif(F.col("n") - 1, F.lit(0.0)), F.lit(0.0))).alias("gap"))
    return cov.agg((F.sum(F.col("gap") * F.col("gap")) / (4 * F.pow(F.max("d") - 1, F.lit(2)))).alias("coral"))


#: Widths of the mixture of kernels.
WIDTHS = (1.0, 2.0, 4.0, 8.0)


def kernel(a: pa.Table, b: pa.Table, widths: tuple[float, ...]) -> np.ndarray:
    d2 = squared_distances(matrix(a, "v"), matrix(b, "v"))
    return sum(np.exp(-d2 / (2 * s * s)) for s in widths) / len(widths)


def mmd2(rows: DataFrame, side: str = "side", widths: tuple[float, ...] = WIDTHS, unit: str = "tile", per_block: int = PER_BLOCK) -> DataFrame:
    """Squared mean discrepancy with a mixture of Gaussian kernels, the diagonal included, from all pairs of rows:
    work grows with the square of the rows (`mmd2_blocks` does not).  Two blocks of rows meet once, as matrix products, and
    give one sum for each pair of sides.  `unit` tells rows apart."""

    def work(a: pa.Table, b: pa.Table) -> pa.Table:
        cells = []
        if a.num_rows and b.num_rows:
            of = [(t.column("side").to_numpy()[:, None] == np.arange(2)).astype(np.float64) for t in (a, b)]
            k = of[0].T @ kernel_products(matrix(a, "v").astype(np.float64), matrix(b, "v").astype(np.float64), of[1], widths).sum(0) / len(widths)
            n = of[0].sum(0)[:, None] * of[1].sum(0)[None, :]
            cells = [(i, j, float(k[i, j]), int(n[i, j])) for i in (0, 1) for j in (0, 1)]
            if a.column("__a")[0] != a.column("__b")[0]:  # two blocks stand for both orders
                cells += [(j, i, v, m) for i, j, v, m in cells]
        return pa.table([pa.array([c[i] for c in cells], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.float64(), pa.int64()))], names=["sa", "sb", "k", "n"])

    own = rows.select(F.lit(0).alias("all"), F.col(side).cast("int").alias("side"), "v", F.col(unit).alias("unit"))
    sums = block_pairs(own, own, ("all",), "unit", work, "sa int, sb int, k double, n long", per_block=per_block, once=True).groupBy("sa", "sb").agg((F.sum("k") / F.sum("n")).alias("k"))
    return sums.agg(F.sum(F.when(F.col("sa") == F.col("sb"), F.col("k")).otherwise(-F.col("k"))).alias("mmd2"))


def mmd2_blocks(rows: DataFrame, side: str = "side", widths: tuple[float, ...] = WIDTHS, unit: str = "tile", per_block: int = 2000, seed: int = 0) -> DataFrame:
    """(mmd2, error, n_blocks): `mmd2` estimated from the pairs within blocks of about `per_block` rows, dealt by a seeded
    hash of `unit`, and its standard error.  Every row is in one block, so work grows with the rows.  Pairs of different rows
    of a block stand for those of all rows; the diagonal, which is known, is added in its share.  The error is the jackknife's
    over blocks; null with one block."""
    n = rows.count()
    blocks = max(1, -(-n // per_block))
    digits = F.conv(F.substring(hash_rank_key(seed, F.col(unit)), 1, 8), 16, 10).cast("long")
    own = rows.select(F.pmod(digits, F.lit(blocks)).alias("block"), F.col(side).cast("int").alias("side"), F.col("v").cast("array<double>").alias("v"))

    def work(a: pa.Table) -> pa.Table:
        k, s = kernel(a, a, widths), a.column("side").to_numpy()
        np.fill_diagonal(k, 0.0)
        sums = [[a.column("block")[0].as_py()]]
        for i, j in ((0, 0), (1, 1), (0, 1)):
            x, y = (s == i).sum(), (s == j).sum()
            sums += [[float(k[np.ix_(s == i, s == j)].sum())], [float(x * (y - (i == j)))]]
        return pa.table(sums, names=["block", *names])

    names = [f"{c}{p}" for p in ("ss", "tt", "st") for c in ("k", "n")]
    each = stage(own.groupBy("block").applyInArrow(work, "block long, " + ", ".join(f"{c} double" for c in names)), "blocks")
    sizes = own.agg(F.count_if(F.col("side") == 0).cast("double").alias("s"), F.count_if(F.col("side") == 1).cast("double").alias("t"))
    totals = each.agg(*[F.sum(c).alias(f"all_{c}") for c in names]).crossJoin(sizes)  # one row

    def value(of: Callable[[str], Column]) -> Column:
        mean = lambda p: of(f"k{p}") / F.nullif(of(f"n{p}"), F.lit(0.0))
        within = lambda p, m: (mean(p) * (F.col(m) - 1) + 1) / F.col(m)
        return within("ss", "s") + within("tt", "t") - 2 * mean("st")

    left = each.crossJoin(F.broadcast(totals)).select(value(lambda c: F.col(f"all_{c}")).alias("value"), value(lambda c: F.col(f"all_{c}") - F.col(c)).alias("without"))  # one row is sent
    m = F.count("without")
    error = F.when(m > 1, F.sqrt((m - 1) * F.var_pop("without")))
    return left.agg(F.max("value").alias("mmd2"), error.alias("error"), F.count("*").alias("n_blocks"))
