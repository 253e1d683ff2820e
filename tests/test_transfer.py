"""Models on descriptors, block products and running totals against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from radiotiles.operators import blocks, boosting, folds, metrics, splits, transfer
from radiotiles.plans import extended, more  # noqa: F401
from radiotiles.plans import queries as plans
from radiotiles.sources import tables
from radiotiles.sources.fixtures import fixture


def frame(spark, rng, n=120, d=5, folds_=("p", "q"), noise=0.05):
    w = rng.normal(size=d)
    rows = []
    for f in folds_:
        x = rng.normal(size=(n, d))
        y = x @ w + 1.5 + noise * rng.normal(size=n)
        rows += [(f, i, x[i].tolist(), float(y[i]), float(-2 * y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "fold string, tile long, v array<double>, gamma double, pl0 double"), rows


def by_fold(rows, fold):
    own = [r for r in rows if r[0] == fold]
    return np.array([r[2] for r in own]), np.array([r[3] for r in own])


def ridge(x, y, alpha):
    c = x - x.mean(0)
    w = np.linalg.solve(c.T @ c + alpha * np.eye(x.shape[1]), c.T @ (y - y.mean()))
    return w, y.mean() - x.mean(0) @ w


def in_cities(spark, rng, n=300, d=5, cities=("a", "b", "c", "d"), noise=0.05):
    """Tiles of cities with a constant dimension and one unfitted tile, and the splits of all folds."""
    w, rows = rng.normal(size=d), []
    for i in range(n):
        x = rng.normal(size=d) * [1, 10, 0.1, 1, 1]
        x[4] = 0.0
        rows.append((cities[i % 7 % len(cities)], i, x.tolist(), float(x @ w + 1.5 + noise * rng.normal()), float(rng.normal())))
    rows.append((cities[0], n, [1e9] * d, float("nan"), None))
    tiles = spark.createDataFrame(rows, "city string, tile long, v array<double>, gamma double, pl0 double").repartition(3)
    return tiles, rows, splits.leave_one_city_out(spark.createDataFrame([(c,) for c in cities], "city string"))


def closed_form(rows, roles, fold, k, alpha, kept=("train",)):
    own = [r for r in rows if roles[fold, r[0]] in kept and r[1] < 300]
    x, y = np.array([r[2] for r in own]), np.array([r[k] for r in own])
    scale = np.abs(x).max(0)
    scale[scale == 0] = 1
    w, b = ridge(x / scale, y, alpha)
    return w / scale, b, x, y


def test_ridge_of_all_folds_is_the_closed_form(spark):
    tiles, rows, sp = in_cities(spark, np.random.default_rng(0))
    roles = {(r.fold, r.city): r.role for r in sp.collect()}
    for kept in (("train",), ("train", "val")):
        fits = {(r.fold, r.target): r for r in transfer.ridge_by_fold(tiles, sp, 3.0, roles=kept).collect()}
        assert len(fits) == 8
        for (fold, target), r in fits.items():
            w, b, x, _ = closed_form(rows, roles, fold, 3 + (target == "pl0"), 3.0, kept)
            assert r.n == len(x) and r.b == pytest.approx(b, abs=1e-8) and r.w == pytest.approx(w, abs=1e-8)
    got = transfer.linear_predictions(transfer.ridge_by_fold(tiles, sp, 3.0), tables.stack(tiles, sp, "test")).where("target = 'gamma' and tile = 7").first()
    w, b, _, _ = closed_form(rows, roles, got.fold, 3, 3.0)
    assert got.pred == pytest.approx(np.array(rows[7][2]) @ w + b, abs=1e-8)


def test_registered_ridge_is_the_closed_form_of_every_fold(spark):
    sf = "/root/testdata/sf0.01"
    t = {r.tile: r for r in fixture(spark, sf, "fx_tiles").collect()}
    roles = {(r.fold, r.city): r.role for r in plans.QUERIES["g1_leave_one_city_out"](spark, sf).collect()}
    rows = [(r.city, 0, [float(x) for x in r.v], r.gamma, r.pl0) for r in t.values()]
    got = plans.QUERIES["h4_descriptor_ridge"](spark, sf).collect()
    assert len(got) == 2 * len(t)
    models = {(f, k): closed_form(rows, roles, f, k, 1.0)[:2] for f in {r.fold for r in got} for k in (3, 4)}
    for r in got:
        w, b = models[r.fold, 3 + (r.target == "pl0")]
        assert r.pred == pytest.approx(np.array(t[r.tile].v, float) @ w + b, abs=1e-4)


def plain_trees(x, y, shape):
    """Boosting by trying every split of every node over all rows."""
    now, unit = np.full(len(y), y.mean()), max(y.max() - y.mean(), y.mean() - y.min()) / boosting.UNITS
    for t in range(shape.trees):
        g, feats, nodes = np.rint((now - y) / unit), shape.features(t, x.shape[1]), [np.arange(len(y))]
        for _ in range(shape.depth):
            after = []
            for own in nodes:
                best = (1e-9 * (g[own].sum() ** 2 / len(own) + 1), None)
                for f in feats:
                    for b in range(shape.bins - 1):
                        right = x[own, f] > b
                        n, m = (~right).sum(), right.sum()
                        if min(n, m) >= shape.least_rows:
                            gain = g[own][~right].sum() ** 2 / n + g[own][right].sum() ** 2 / m - g[own].sum() ** 2 / len(own)
                            if gain > best[0]:
                                best = (gain, right)
                after += [own] if best[1] is None else [own[~best[1]], own[best[1]]]
            nodes = after
        for own in nodes:
            now[own] -= shape.step * unit * g[own].sum() / len(own)
    return now


def test_boosted_trees_are_those_of_all_splits(spark):
    tiles, rows, sp = in_cities(spark, np.random.default_rng(1), n=240)
    shape = boosting.Shape(trees=4, step=0.3, depth=3, least_rows=8, share=0.6, bins=12)
    models, edges = boosting.boosted_models(tiles, sp, shape)
    roles = {(r.fold, r.city): r.role for r in sp.collect()}
    same = tables.stack(tiles, sp, "train").where("tile < 240")  # predictions of the rows that the trees grew from
    got = {(r.fold, r.tile): r.pred for r in boosting.boosted_predictions(models, edges, same, 3).where("target = 'gamma'").collect()}
    for fold in {f for f, _ in got}:
        own = [r for r in rows if roles[fold, r[0]] == "train" and r[1] < 240]
        x = np.stack([np.searchsorted(e, [r[2][i] for r in own], "left") for i, e in enumerate(edges)], 1)
        want = plain_trees(x, np.array([r[3] for r in own]), shape)
        assert [got[fold, r[1]] for r in own] == pytest.approx(want, abs=1e-9)


def test_trees_grown_over_all_tasks_are_the_same(spark, monkeypatch):
    tiles, rows, sp = in_cities(spark, np.random.default_rng(2), n=200, cities=("a", "b", "c"))
    shape = boosting.Shape(trees=3, step=0.3, depth=2, least_rows=8, bins=12)
    monkeypatch.setattr(boosting, "WRITTEN", 2)
    one = {(r.fold, r.target): r for r in boosting.boosted_models(tiles, sp, shape)[0].collect()}
    other = {(r.fold, r.target): r for r in boosting.boosted_models(tiles, sp, shape, in_task=0)[0].collect()}
    assert one.keys() == other.keys() and len(one) == 6
    assert all(one[k] == other[k] for k in one)


@pytest.mark.parametrize("paired", [1, 10**9])
@pytest.mark.parametrize("copies", [0, 2500])
def test_models_of_a_task_are_those_of_all_splits(monkeypatch, paired, copies):
    monkeypatch.setattr(boosting, "PAIRED", paired)
    rng = np.random.default_rng(6)
    x = rng.integers(0, 12, (400, 5), dtype=np.uint8)
    x = np.concatenate([x, np.tile(x[:1], (copies, 1))])  # a bin with over 2,048 rows keeps counts and sums apart
    y = x[:, 0] / 3 - x[:, 3] / 5 + 0.3 * rng.normal(size=len(x))
    shape = boosting.Shape(trees=6, step=0.3, depth=4, least_rows=15, share=0.6, bins=12)
    trees = boosting.grow_model(x, y, y.mean(), max(y.max() - y.mean(), y.mean() - y.min()), shape)
    got = y.mean() + sum(t.value[t.place(x, shape.depth)] for t in trees)
    assert got == pytest.approx(plain_trees(x, y, shape), abs=1e-9)


@pytest.mark.parametrize("rows", [3000, 33_000])
def test_a_tree_reads_rows_three_times_at_most(monkeypatch, rows):
    rng, read, count = np.random.default_rng(7), [], np.bincount
    x = rng.integers(0, 64, (rows, 8), dtype=np.uint8)
    y = x[:, 0] / 3 + x[:, 1] / 5 + rng.normal(size=rows)

    def counted(cells, *rest, **more):
        read.append(np.size(cells))
        return count(cells, *rest, **more)

    monkeypatch.setattr(np, "bincount", counted)
    shape = boosting.Shape(trees=6)
    trees = boosting.grow_model(x, y, y.mean(), np.abs(y - y.mean()).max(), shape)
    assert (trees[-1].feature[15:] >= 0).any()  # it has all its levels
    columns = 8 if rows < boosting.PAIRED else 4
    assert sum(read) <= columns * rows * (1 + shape.trees * (1 + (shape.depth - 1) / 2))


def test_each_model_has_a_task(spark):
    tiles, _, sp = in_cities(spark, np.random.default_rng(8), n=200)
    models, _ = boosting.boosted_models(tiles, sp, boosting.Shape(trees=2, depth=2, least_rows=8, bins=12))
    assert models.select(F.input_file_name()).distinct().count() == models.count() == 8


def test_boosted_trees_beat_the_median(spark):
    tiles, rows, sp = in_cities(spark, np.random.default_rng(3), n=300, noise=0.01)
    shape = boosting.Shape(trees=60, step=0.2, depth=3, least_rows=5)
    models, edges = boosting.boosted_models(tiles, sp, shape)
    got = {r.tile: r.pred for r in boosting.boosted_predictions(models, edges, tables.stack(tiles, sp, "test"), 3).where("target = 'gamma' and tile < 300").collect()}
    y = np.array([r[3] for r in rows[:300]])
    e = np.array([got[i] for i in range(300)]) - y
    assert np.sqrt((e**2).mean()) < 0.6 * y.std()


def test_residual_ridge_is_the_plain_form(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 8))
    truth, pred = x @ rng.normal(size=8) + 3, rng.normal(size=30)
    anchor = np.arange(30) < 6
    rows = [("f", 6, 0, i, x[i].tolist(), float(truth[i]), float(pred[i]), bool(anchor[i])) for i in range(30)]
    df = spark.createDataFrame(rows, "fold string, k int, draw int, tile long, v array<double>, truth double, pred double, is_anchor boolean")
    w, b = ridge(x[anchor], (truth - pred)[anchor], 10.0)
    got = {r["tile"]: r["pred"] for r in transfer.residual_corrected(df).collect()}
    assert set(got) == set(range(6, 30))
    for i in got:
        assert got[i] == pytest.approx(pred[i] + x[i] @ w + b, abs=1e-9)


def test_second_stage_finds_a_spread_that_depends_on_a_descriptor(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(-1, 1, size=(900, 3))
    sigma = np.exp(0.9 * x[:, 0] - 1)
    rows = [("abc"[i % 3], i, x[i].tolist(), float(sigma[i] * rng.normal() + 2)) for i in range(900)]
    tiles = spark.createDataFrame(rows, "city string, tile long, v array<double>, gamma double").repartition(3)
    sp = splits.leave_one_city_out(spark.createDataFrame([("a",), ("b",), ("c",)], "city string"), n_val=0)
    fits = transfer.ridge_by_fold(tiles, sp, targets=("gamma",))
    second = transfer.log_variance_fits(tiles, sp, fits)
    test = tables.stack(tiles, sp, "test")
    got = {r["tile"]: r["sigma"] for r in transfer.second_sigma(second, test).collect()}
    found = np.array([got[i] for i in range(900)])
    assert np.corrcoef(np.log(found), np.log(sigma))[0, 1] > 0.95
    # the fit itself: of the log squares of the fold's own residuals
    own = {r.fold: r for r in fits.collect()}
    for r in second.collect():
        mine = [i for i in range(900) if "abc"[i % 3] != r.fold]
        resid = np.array([rows[i][3] for i in mine]) - own[r.fold].b - x[mine] @ own[r.fold].w
        scale = np.abs(x[mine]).max(0)
        w, b = ridge(x[mine] / scale, np.log(resid**2), 1.0)
        assert r.n == 600 and r.b == pytest.approx(b, abs=1e-7) and r.w == pytest.approx(w / scale, abs=1e-7)
    wild = test.withColumn("v", F.transform("v", lambda y: y * 1e3))
    ends = [r["sigma"] for r in transfer.second_sigma(second, wild).collect()]
    assert min(ends) == pytest.approx(np.exp(-4)) and max(ends) == pytest.approx(np.exp(2))


def test_domain_classifier_tells_a_planted_shift(spark):
    rng = np.random.default_rng(4)
    for shift, low, high in ((0.0, 0.4, 0.6), (3.0, 0.95, 1.0)):
        x = rng.normal(size=(400, 4)) + np.where(np.arange(400) % 4 == 0, shift, 0.0)[:, None] * [1, 0, 0, 0]
        df = spark.createDataFrame([(i, int(i % 4 == 0), x[i].tolist()) for i in range(400)], "tile long, side int, v array<double>")
        told, auc = transfer.domain_separability(df)
        assert low <= auc <= high
        if shift:
            w = {r["side"]: r["w"] for r in told.groupBy("side").agg(F.avg("weight").alias("w")).collect()}
            assert w[1] > 10 * w[0]


def test_block_products(spark, monkeypatch):
    df, rows = frame(spark, np.random.default_rng(5), n=60)
    x, y = by_fold(rows, "p")
    d2 = ((x[:, None] - x[None]) ** 2).sum(-1)
    want = {s: (np.exp(-d2 / (2 * s * s)) @ y) / np.exp(-d2 / (2 * s * s)).sum(1) for s in (0.3, 1.0)}
    plain = blocks.block_pairs
    monkeypatch.setattr(transfer, "block_pairs", lambda *a, **k: plain(*a, **(k | {"per_block": 7})))
    got = {(r["fold"], r["tile"]): r["gamma_pred"] for r in transfer.gaussian_predict(df, df, 0.3).collect()}
    assert [got["p", i] for i in range(60)] == pytest.approx(want[0.3], abs=1e-8)
    errors = {s: np.mean([(w - y) ** 2, 4 * (w - y) ** 2]) for s, w in want.items()}
    r = transfer.select_sigma(df.where("fold = 'p'"), df, (0.3, 1.0)).first()
    assert (r["sigma"], r["err"]) == (min(errors, key=errors.get), pytest.approx(min(errors.values())))
    sides = df.withColumn("side", (F.col("fold") == "q").cast("int"))
    both = np.array([r[2] for r in rows])
    k = np.mean([np.exp(-((both[:, None] - both[None]) ** 2).sum(-1) / (2 * s * s)) for s in (1.0, 2.0, 4.0, 8.0)], 0)
    assert transfer.mmd2(sides).first()[0] == pytest.approx(k[:60, :60].mean() + k[60:, 60:].mean() - 2 * k[:60, 60:].mean(), abs=1e-9)
    c = [np.cov(both[i : i + 60].T) for i in (0, 60)]
    assert transfer.coral(sides).first()[0] == pytest.approx(((c[0] - c[1]) ** 2).sum() / (4 * 25), rel=1e-8)


def test_running_totals_and_ranks(spark):
    rng = np.random.default_rng(6)
    rows = [(int(k), int(v), int(w)) for k, v, w in zip(rng.integers(0, 3, 500), rng.integers(0, 40, 500), rng.integers(1, 5, 500), strict=True)]
    df = spark.createDataFrame(rows, "k int, v int, w int")
    got = blocks.running_total(df, ("k",), ("v",), "w", "run").collect()
    assert len(got) == 500
    for r in got:
        assert r["run"] == sum(w for k, v, w in rows if k == r["k"] and v <= r["v"])
    for r in metrics.average_ranks(df, ("v",), "k").collect():
        own = sorted(v for k, v, _ in rows if k == r["k"])
        assert r["rank"] == np.mean([i + 1 for i, v in enumerate(own) if v == r["value"]])


def test_holm(spark):
    rows = [("a", "x", 0.001), ("a", "y", 0.02), ("a", "z", 0.03), ("a", "w", 0.012), ("b", "x", 0.6), ("b", "y", 0.01)]
    got = {(r["family"], r["name"]): r["rejected"] for r in folds.holm(spark.createDataFrame(rows, "family string, name string, p double")).collect()}
    assert got == {("a", "x"): True, ("a", "w"): True, ("a", "y"): True, ("a", "z"): True, ("b", "y"): True, ("b", "x"): False}
    late = [("a", "x", 0.001), ("a", "y", 0.04), ("a", "z", 0.04)]
    assert {r["name"]: r["rejected"] for r in folds.holm(spark.createDataFrame(late, "family string, name string, p double")).collect()} == {"x": True, "y": False, "z": False}


def test_p_values(spark):
    rows = [(("m" if i < 10 else "n"), f"f{i % 10}", d) for i, d in enumerate([0.3, 0.1, -0.2, 0.5, 0.4, 0.25, 0.35, -0.05, 0.15, 0.45, *([0.1] * 9), -0.3])]
    df = spark.createDataFrame(rows, "model string, fold string, d double")
    t = {r["model"]: r for r in folds.paired_t(df).collect()}["m"]
    x = np.array([r[2] for r in rows[:10]])
    stat = x.mean() / (x.std(ddof=1) / np.sqrt(10))
    grid = np.linspace(abs(stat), 400, 4_000_001)
    tail = np.trapezoid((1 + grid**2 / 9) ** -5, grid) * 0.38803490887166867  # density of Student's t, 9 degrees
    assert t["t"] == pytest.approx(stat) and t["p_t"] == pytest.approx(2 * tail, rel=1e-5)
    ranks = np.argsort(np.argsort(np.abs(x))) + 1
    w = min(ranks[x > 0].sum(), ranks[x < 0].sum())
    sums = [sum(k + 1 for k in range(10) if mask >> k & 1) for mask in range(1024)]
    assert {r["model"]: r["p_w"] for r in folds.wilcoxon(df).collect()}["m"] == pytest.approx(min(1, 2 * np.mean([s <= w for s in sums])))
