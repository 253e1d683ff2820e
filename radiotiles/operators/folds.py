"""Statistics over folds: (model, fold, value) in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from radiotiles.operators.blocks import running_total


def paired(scores: DataFrame, reference: str) -> DataFrame:
    """(model, fold, d): each model's value less the reference's."""
    ref = scores.where(F.col("model") == reference).select("fold", F.col("value").alias("ref"))
    return scores.where(F.col("model") != reference).join(ref, "fold").select("model", "fold", (F.col("value") - F.col("ref")).alias("d"))


def bootstrap_ci(diffs: DataFrame, n_boot: int = 10_000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """Mean difference with the bootstrap interval of its mean; draws come from a portable hash."""
    listed = diffs.groupBy("model").agg(F.transform(F.array_sort(F.collect_list(F.struct("fold", "d"))), lambda s: s["d"]).alias("ds"))  # a value for each fold
    n = F.size("ds")
    runs = listed.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    digits = lambda k: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("run").cast("string"), k.cast("string"))), 1, 8), 16, 10).cast("long")
    drawn = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.get("ds", F.pmod(digits(k), n).cast("int")))
    means = runs.select("model", "ds", (F.aggregate(drawn, F.lit(0.0), lambda a, x: a + x) / n).alias("b"))
    ci = means.groupBy("model").agg(F.percentile("b", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("q"), F.first("ds").alias("ds"))
    out = ci.select("model", (F.aggregate("ds", F.lit(0.0), lambda a, x: a + x) / F.size("ds")).alias("diff_mean"), F.get("q", 0).alias("ci_lo"), F.get("q", 1).alias("ci_hi"))
    return out.withColumn("significant", (F.col("ci_lo") > 0) | (F.col("ci_hi") < 0))


def student_p(t: Column, df: Column) -> Column:
    """Two-sided p-value of t with a whole number of degrees of freedom, by the finite cosine series."""
    theta = F.atan(F.abs(t) / F.sqrt(df))
    c2 = F.pow(F.cos(theta), F.lit(2))

    def series(first: int, terms: Column) -> Column:
        """1 + f/(f+1) c2 + f(f+2)/((f+1)(f+3)) c2^2 + ... of so many terms."""
        steps = F.when(terms > 1, F.sequence(F.lit(1), terms - 1)).otherwise(F.array().cast("array<int>"))
        start = F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("last"))

        def add(acc: Column, k: Column) -> Column:
            last = acc["last"] * (2 * k - 2 + first) / (2 * k - 1 + first) * c2
            return F.struct((acc["sum"] + last).alias("sum"), last.alias("last"))

        return F.aggregate(steps, start, add)["sum"]

    odd = (2 / 3.141592653589793) * (theta + F.when(df > 1, F.sin(theta) * F.cos(theta) * series(2, F.floor((df - 1) / 2).cast("int"))).otherwise(0.0))
    even = F.sin(theta) * series(1, F.floor(df / 2).cast("int"))
    return 1.0 - F.when(df % 2 == 1, odd).otherwise(even)


def paired_t(diffs: DataFrame) -> DataFrame:
    base = diffs.groupBy("model").agg(F.count("*").alias("n_folds"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"))
    t = F.col("mean") / F.nullif(F.col("sd") / F.sqrt("n_folds"), F.lit(0.0))
    out = base.withColumn("t", t).withColumn("cohens_dz_folds", F.col("mean") / F.greatest("sd", F.lit(1e-12)))
    return out.withColumn("p_t", student_p(F.col("t"), (F.col("n_folds") - 1).cast("int"))).select("model", "n_folds", "t", "p_t", "cohens_dz_folds")


def wilcoxon(diffs: DataFrame) -> DataFrame:
    """Signed ranks: W = min(W+, W-); p exact over all signs to 15 folds, normal beyond; zero differences go."""
    by = Window.partitionBy("model")
    d = diffs.where("d <> 0").withColumn("size", F.abs("d"))
    ranked = d.withColumn("r", F.rank().over(by.orderBy("size")) + (F.count("*").over(Window.partitionBy("model", "size")) - 1) / 2)
    sums = ranked.groupBy("model").agg(F.count("*").alias("n"), F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)).alias("plus"), F.sum(F.when(F.col("d") < 0, F.col("r")).otherwise(0.0)).alias("minus"), F.collect_list("r").alias("rs"))
    w = F.least("plus", "minus")
    masks = F.sequence(F.lit(0), (F.pow(F.lit(2.0), F.col("n")) - 1).cast("int"))
    small = sums.where("n <= 15").withColumn("w", w).withColumn("mask", F.explode(masks)).withColumn("s", _sum_of_mask())
    exact = small.groupBy("model").agg(F.least(F.lit(1.0), 2 * F.count_if(F.col("s") <= F.col("w") + 1e-9) / F.count("*")).alias("p_exact"))
    mean, var = F.col("n") * (F.col("n") + 1) / 4, F.col("n") * (F.col("n") + 1) * (2 * F.col("n") + 1) / 24
    zscore = F.abs(w - mean) / F.sqrt(var)
    both = sums.withColumn("wilcoxon", w).withColumn("p_normal", 2 * normal_tail(zscore)).join(exact, "model", "left")
    return both.select("model", "n", "wilcoxon", F.coalesce("p_exact", "p_normal").alias("p_w"))


def _sum_of_mask() -> Column:
    """Sum of the ranks whose bit is set."""
    bit = lambda k: F.pmod(F.floor(F.col("mask") / F.pow(F.lit(2.0), k)), F.lit(2))
    return F.aggregate(F.transform("rs", lambda r, k: r * bit(k)), F.lit(0.0), lambda a, x: a + x)


def normal_tail(z: Column) -> Column:
    """P(Z > z) for z >= 0, to 1e-7 (a five-term rational approximation)."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) / (2 * 3.141592653589793) ** 0.5 * poly


def holm(pvalues: DataFrame, alpha: float = 0.05, by: str = "family") -> DataFrame:
    """Step-down: a hypothesis is rejected while each smaller p-value was.  Ranks are running counts, so a family
    may be of any size."""
    ranked = running_total(pvalues.withColumn("one", F.lit(1)), (by,), ("p", "name"), "one", "i")
    sizes = pvalues.groupBy(by).agg(F.count("*").alias("mm"))
    tested = ranked.join(F.broadcast(sizes), by).withColumn("ok", F.col("p") <= alpha / (F.col("mm") - F.col("i") + 1))  # a row for each family
    first = tested.where("not ok").groupBy(by).agg(F.min("i").alias("stop"))
    return tested.join(F.broadcast(first), by, "left").select(by, "name", "p", (F.col("stop").isNull() | (F.col("i") < F.col("stop"))).alias("rejected"))  # a row for each family


def parse_run(runs: DataFrame) -> DataFrame:
    """model, city and seed of a run's folder name `<model>_loco_<city>_s<seed>`."""
    part = lambda k: F.regexp_extract("run", r"^(.*)_loco_(.+)_s(\d+)$", k)
    return runs.select("*", part(1).alias("model"), part(2).alias("city"), part(3).try_cast("int").alias("seed"))


def fold_table(scores: DataFrame, models: list[str], *keys: str) -> DataFrame:
    return scores.groupBy(*(keys or ("fold",))).pivot("model", models).avg("value")


def model_report(scores: DataFrame, n_boot: int = 10_000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """Each model against the first by name: interval of the mean difference, t, signed ranks, and whether
    Holm's procedure rejects by the p-values of the t-tests."""
    reference = scores.agg(F.min("model")).first()[0]
    d = paired(scores, reference)
    means = paired_t(d)
    tested = holm(means.select(F.lit("all").alias("family"), F.col("model").alias("name"), F.col("p_t").alias("p")), alpha)
    all_ = bootstrap_ci(d, n_boot, alpha, seed).join(means, "model").join(wilcoxon(d).drop("n"), "model", "left")
    return all_.join(tested.select(F.col("name").alias("model"), "rejected"), "model", "left").withColumn("reference", F.lit(reference))
