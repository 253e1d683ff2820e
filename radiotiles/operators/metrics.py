"""Scores of predictions: (model, fold, target, truth, pred, sigma) in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radiotiles.operators.blocks import running_total

KEYS = ("model", "fold", "target")
#: Quantiles of the standard normal distribution at (1 + level) / 2.
INTERVAL_Z = {0.5: 0.674489750196082, 0.8: 1.281551565544600, 0.9: 1.644853626951473, 0.95: 1.959963984540054}
#: Quantiles of the standard normal distribution at 0.05, 0.10, ... 0.95.
LEVEL_Z = (
    -1.644853626951473, -1.281551565544600, -1.036433389493790, -0.841621233572914, -0.674489750196082, -0.524400512708041, -0.385320466407568,
    -0.253347103135800, -0.125661346855074, 0.0, 0.125661346855074, 0.253347103135800, 0.385320466407568, 0.524400512708041, 0.674489750196082,
    0.841621233572914, 1.036433389493790, 1.281551565544600, 1.644853626951473,
)


def pearson(a: str, b: str) -> Column:
    """From moments; null where either side is constant."""
    spread = F.stddev_pop(a), F.stddev_pop(b)
    return F.when((spread[0] >= 1e-12) & (spread[1] >= 1e-12), F.covar_pop(a, b) / F.nullif(spread[0] * spread[1], F.lit(0.0)))


def errors(predictions: DataFrame, *keys: str) -> DataFrame:
    e = F.col("pred") - F.col("truth")
    return predictions.groupBy(*(keys or KEYS)).agg(
        F.count("*").alias("n"),
        (F.sum(e * e) / F.greatest(F.sum(F.col("truth") * F.col("truth")), F.lit(1e-12))).alias("nmse"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        pearson("pred", "truth").alias("pearson"),
    )


def average_ranks(rows: DataFrame, values: tuple[str, ...], *keys: str) -> DataFrame:
    """(keys, which, value, rank) of each of the columns `values`: ranks with ties at their mean, from counts of equal
    values of all columns in one table, which is put in order once."""
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("which"), F.col(v).cast("double").alias("value")) for v in values])).alias("e")
    counts = rows.select(*keys, each).select(*keys, "e.*").groupBy(*keys, "which", "value").agg(F.count("*").alias("__n"))
    run = running_total(counts, (*keys, "which"), ("value",), "__n", "__run")
    return run.select(*keys, "which", "value", (F.col("__run") - (F.col("__n") - 1) / 2).alias("rank"))


def spearman(predictions: DataFrame, *keys: str) -> DataFrame:
    """Pearson's coefficient of the ranks."""
    keys = keys or KEYS
    ranks = average_ranks(predictions, ("pred", "truth"), *keys)
    ranked = predictions.select(*keys, F.col("pred").cast("double").alias("pred"), F.col("truth").cast("double").alias("truth"))
    for value, name in (("pred", "rp"), ("truth", "rt")):
        own = ranks.where(F.col("which") == value).select(*keys, F.col("value").alias(value), F.col("rank").alias(name))
        ranked = ranked.join(own, [*keys, value])
    return ranked.groupBy(*keys).agg(pearson("rp", "rt").alias("spearman"))


def full_report(predictions: DataFrame) -> DataFrame:
    return errors(predictions).join(spearman(predictions), list(KEYS))


def report_long(report: DataFrame) -> DataFrame:
    names = ("nmse", "rmse", "mae", "pearson", "spearman")
    return report.unpivot(list(KEYS), list(names), "metric", "value")


def coverage_agreement(predictions: DataFrame, threshold: float) -> DataFrame:
    p, t = F.col("pred") >= threshold, F.col("truth") >= threshold
    tp, either = F.count_if(p & t), F.count_if(p | t)
    return predictions.groupBy(*KEYS).agg((tp / F.greatest(either, F.lit(1))).alias("coverage_iou"), F.avg((p == t).cast("double")).alias("coverage_acc"))


def model_summary(report: DataFrame) -> DataFrame:
    return report.groupBy("model", "target").agg(*[f(c).alias(f"{c}_{n}") for c in ("rmse", "mae") for f, n in ((F.avg, "mean"), (F.stddev_samp, "std"))])


def _score(normalized: bool) -> Column:
    r = F.abs(F.col("truth") - F.col("pred"))
    return r / F.greatest("sigma", F.lit(1e-6)) if normalized else r


def _running_scores(calibration: DataFrame, keys: tuple[str, ...], weight: Column, normalized: bool) -> DataFrame:
    """(keys, score, run, all): the weight of the scores up to each, and of all of its keys."""
    sums = calibration.withColumn("score", _score(normalized)).groupBy(*keys, "score").agg(F.sum(weight).alias("__w"))
    run = running_total(sums, keys, ("score",), "__w", "run")
    return run.join(F.broadcast(sums.groupBy(*keys).agg(F.sum("__w").alias("all"))), list(keys))  # a row for each key


def conformal_quantile(calibration: DataFrame, *keys: str, alpha: float = 0.1, normalized: bool = True) -> DataFrame:
    """The order statistic min(ceil((n + 1)(1 - alpha)), n) of the scores (no interpolation)."""
    run = _running_scores(calibration, keys, F.lit(1), normalized)
    return run.where(F.col("run") >= F.least(F.ceil((F.col("all") + 1) * (1 - alpha) - 1e-9), F.col("all"))).groupBy(*keys).agg(F.min("score").alias("q"))


def weighted_conformal_quantile(calibration: DataFrame, *keys: str, weight: str = "w", alpha: float = 0.1, normalized: bool = True) -> DataFrame:
    """The least score at which the running weight passes (1 - alpha) of all weight."""
    run = _running_scores(calibration, keys, F.col(weight), normalized)
    return run.where(F.col("run") >= (1 - alpha) * F.col("all") - 1e-9).groupBy(*keys).agg(F.min("score").alias("q"))


def conformal_coverage(test: DataFrame, quantiles: DataFrame, *keys: str, normalized: bool = True) -> DataFrame:
    """Empirical coverage and mean width of the intervals."""
    w = F.col("q") * (F.greatest("sigma", F.lit(1e-6)) if normalized else F.lit(1.0))
    inside = F.col("truth").between(F.col("pred") - w, F.col("pred") + w)
    return test.join(F.broadcast(quantiles), list(keys)).groupBy(*keys).agg(F.avg(inside.cast("double")).alias("coverage"), F.avg(2 * w).alias("mean_width"))  # a row for each key


def interval_coverage(predictions: DataFrame) -> DataFrame:
    levels = F.explode(F.array(*[F.struct(F.lit(a).alias("nominal"), F.lit(z).alias("zq")) for a, z in INTERVAL_Z.items()]))
    half = F.col("l.zq") * F.col("sigma")
    inside = F.col("truth").between(F.col("pred") - half, F.col("pred") + half)
    rows = predictions.withColumn("l", levels).groupBy("model", "target", "l.nominal").agg(F.avg(inside.cast("double")).alias("empirical"), F.avg(2 * half).alias("avg_width"))
    return rows.withColumn("gap", F.col("empirical") - F.col("nominal"))


def regression_ece(predictions: DataFrame) -> DataFrame:
    """Mean distance of the share of truths below each predicted quantile from its level (20 levels)."""
    bins = len(LEVEL_Z) + 1
    standard = (F.col("truth") - F.col("pred")) / F.greatest("sigma", F.lit(1e-9))
    gaps = [F.abs(F.avg((standard <= z).cast("double")) - (i + 1) / bins) for i, z in enumerate(LEVEL_Z)]
    return predictions.groupBy("model", "target").agg((sum(gaps[1:], gaps[0]) / bins).alias("ece"))


def gaussian_nll(predictions: DataFrame, scale: float = 1.0) -> DataFrame:
    logvar = 2 * F.log("sigma")
    e = (F.col("truth") - F.col("pred")) / scale
    return predictions.groupBy("model", "target").agg(F.avg(0.5 * (logvar + e * e * F.exp(-logvar))).alias("nll"))


def composite_loss(nll: DataFrame, physics: DataFrame, shift: DataFrame, w_physics: float = 0.1, w_shift: float = 0.1) -> DataFrame:
    """(model, nll, physics, shift, loss): each model's mean likelihood term plus weighted physics residual and shift
    measure; `nll` (model, target, nll), `physics` (mse_db2 of cities) and `shift` (one value)."""
    own = nll.groupBy("model").agg(F.avg("nll").alias("nll"))
    more = physics.agg(F.avg("mse_db2").alias("physics")).crossJoin(shift.toDF("shift"))  # one row
    return own.crossJoin(F.broadcast(more)).withColumn("loss", F.col("nll") + w_physics * F.col("physics") + w_shift * F.col("shift"))


def ensemble(members: DataFrame) -> DataFrame:
    """Mean, aleatoric variance and epistemic variance over members (member, tile, target, pred, sigma)."""
    return members.groupBy("tile", "target").agg(F.avg("pred").alias("mean"), F.avg(F.col("sigma") * F.col("sigma")).alias("aleatoric"), F.var_pop("pred").alias("epistemic"))
