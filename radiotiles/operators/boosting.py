"""Boosted regression trees of every fold and target at once, from histograms of binned descriptors.

Descriptors become bytes: the numbers of their quantile bins over all tiles.  Each tree grows level by level; a
level needs, for each fold, target, node, feature and bin, the number of rows and the sum of their gradients, and the
best split of a node is read off the sums up to each bin.  Gradients are whole numbers of a fixed step, so sums are
exact and trees do not depend on how rows are dealt.  Trees see a share of the features, drawn by a seed for each tree; all
rows count in each.

Where the training rows of a fold fit into a task (`in_task` bytes of bins, and `all_tasks` for the copies of all folds)
the levels of a model are grown there, one task for each fold and target.  Beyond that rows stay where they are: each
level is one aggregate by fold, target, node, feature and bin over all of them, and the rows' running predictions are
written every few trees.  Both ways give the same trees.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radiotiles.operators.blocks import block_pairs, matrix
from radiotiles.operators.transfer import TARGETS
from radiotiles.sources.scratch import stage

#: Steps of a gradient as large as the largest residual; a float holds sums of eight million such numbers exactly.
UNITS = 2.0**30
#: Trees after which the way over all tasks writes the running predictions, and models that it grows together.
WRITTEN, TOGETHER = 25, 64
#: Rows from which two features share a column: eight for each pair of 64 bins.
PAIRED = 8 * 64**2
#: Ranges of rows for each model: with a few for each, no two models of like size share a task.
RANGES = 4


@dataclass(frozen=True)
class Shape:
    """How trees grow."""

    trees: int = 600
    step: float = 0.05
    depth: int = 5
    least_rows: int = 40
    share: float = 0.8
    seed: int = 0
    bins: int = 64

    def features(self, tree: int, d: int) -> np.ndarray:
        return np.sort(np.random.default_rng([self.seed, tree]).permutation(d)[: max(1, round(self.share * d))])


def bin_edges(tiles: DataFrame, bins: int) -> list[list[float]]:
    """Inner edges of the quantile bins of each dimension: `bins` numbers for each, at most."""
    each = tiles.select(F.posexplode("v").alias("i", "x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    inner = [k / bins for k in range(1, bins)]
    found = each.groupBy("i").agg(F.array_distinct(F.percentile_approx(F.col("x").cast("double"), inner, 1_000_000)).alias("e")).collect()
    edges = {r["i"]: sorted(r["e"]) for r in found}
    return [edges.get(i, []) for i in range(max(edges, default=-1) + 1)]


def binned(tiles: DataFrame, edges: list[list[float]]) -> DataFrame:
    """`tiles` with the numbers of the bins, a byte for each dimension, in place of v.  An edge belongs to the bin below it."""
    others = [c for c in tiles.columns if c not in ("v", "bins")]
    own = tiles.select(*others, F.col("v").cast("array<double>").alias("v"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(pa.Table.from_batches([batch]), "v")
            x = np.stack([np.searchsorted(e, v[:, i], "left") for i, e in enumerate(edges)], 1).astype(np.uint8) if len(v) else np.empty((0, len(edges)), np.uint8)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([r.tobytes() for r in x], pa.binary())], names=[*others, "bins"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1])
    return own.mapInArrow(work, f"{types}, bins binary")


def unpacked(column: pa.ChunkedArray, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, d)


def best_split(n: np.ndarray, g: np.ndarray, least_rows: int) -> tuple[int, int, float, float] | None:
    """(feature, bin, rows, gradient) of the left side of the best split of a node, by (features, bins) counts and sums;
    None without one.  Ties go to the first feature and bin."""
    left, sums = n.cumsum(1)[:, :-1], g.cumsum(1)[:, :-1]
    right, other = n[0].sum() - left, g[0].sum() - sums
    good = (left >= least_rows) & (right >= least_rows)
    if not good.any():
        return None
    whole = g[0].sum() ** 2 / n[0].sum()
    gain = np.where(good, sums**2 / np.maximum(left, 1) + other**2 / np.maximum(right, 1) - whole, -1.0)
    at = int(gain.argmax())
    f, b = divmod(at, gain.shape[1])
    return (f, b, float(left[f, b]), float(sums[f, b])) if gain[f, b] > 1e-9 * (whole + 1) else None


class Growing:
    """One tree of one model as it grows: complete levels of (feature, bin); a node that does not split sends
    all rows left, and its place below is its leaf."""

    def __init__(self, shape: Shape, tree: int, d: int):
        self.shape, self.feats = shape, shape.features(tree, d)
        self.feature, self.bin = np.full(2**shape.depth - 1, -1, np.int16), np.zeros(2**shape.depth - 1, np.uint8)
        self.value, self.open = np.zeros(2**shape.depth), [0]

    def place(self, x: np.ndarray, level: int) -> np.ndarray:
        """The node of each row on a level."""
        node = np.zeros(len(x), np.int64)
        for k in range(level):
            at = node + 2**k - 1
            f = self.feature[at]
            right = (f >= 0) & (x[np.arange(len(x)), np.maximum(f, 0)] > self.bin[at])
            node = 2 * node + right
        return node

    def leaf(self, node: int, level: int, n: float, g: float, unit: float) -> None:
        self.value[node << (self.shape.depth - level)] = -self.shape.step * g * unit / n if n else 0.0

    def grown(self, level: int, splits: dict, unit: float) -> None:
        """Take the splits of a level: {node: (split or None, rows, gradient)}."""
        following = []
        for node, (split, n, g) in splits.items():
            if split is None:
                self.leaf(node, level, n, g, unit)
                continue
            f, b, left, sums = split
            at = node + 2**level - 1
            self.feature[at], self.bin[at] = self.feats[f], b
            for child, rows, total in ((2 * node, left, sums), (2 * node + 1, n - left, g - sums)):
                if level + 1 == self.shape.depth:
                    self.leaf(child, level + 1, rows, total, unit)
                elif rows >= 2 * self.shape.least_rows:
                    following.append(child)
                else:
                    self.leaf(child, level + 1, rows, total, unit)
        self.open = following

    def histograms(self, x: np.ndarray, g: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(open nodes, features, bins) counts and sums."""
        rank = np.full(int(max(self.open)) + 1, -1)
        rank[self.open] = np.arange(len(self.open))
        at = np.where(node < len(rank), rank[np.minimum(node, len(rank) - 1)], -1)
        mine = at >= 0
        shape = (len(self.open), len(self.feats), self.shape.bins)
        cell = (at[mine, None] * shape[1] + np.arange(shape[1])) * shape[2] + x[mine][:, self.feats]
        size = shape[0] * shape[1] * shape[2]
        n = np.bincount(cell.ravel(), minlength=size).reshape(shape)
        return n, np.bincount(cell.ravel(), np.repeat(g[mine], shape[1]), size).reshape(shape)


class Columns:
    """Counts and sums of gradients by bin, of the rows of a task.  With many rows, two features are one column of
    their pairs of bins, read once for both."""

    def __init__(self, x: np.ndarray, bins: int):
        self.bins, self.rows, d = bins, len(x), x.shape[1]
        self.x = np.ascontiguousarray(x.T)
        self.width = 2 if bins <= 64 and self.rows >= PAIRED else 1
        self.codes = self.x
        if self.width == 2:
            self.codes = self.x[0::2].astype(np.uint16) * bins
            self.codes[: d // 2] += self.x[1::2]
        self.cells = bins**self.width
        self.code, self.cell = np.empty(self.rows, self.codes.dtype), np.empty(self.rows, np.intp)
        tables = [np.bincount(own, minlength=self.cells) for own in self.codes]
        self.most = [int(t.max(initial=0)) for t in tables]
        self.all = np.stack([self.one(tables[f // self.width], f % self.width)[0] for f in range(d)])

    def of(self, feats: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """(column, [(place in `feats`, half)]) of the columns that hold `feats`."""
        found: dict[int, list[tuple[int, int]]] = {}
        for i, f in enumerate(feats):
            found.setdefault(int(f) // self.width, []).append((i, int(f) % self.width))
        yield from found.items()

    def one(self, table: np.ndarray, half: int) -> np.ndarray:
        """(parts, bins) of one feature, from the cells of its column."""
        if self.width == 1:
            return table.reshape(-1, self.bins)
        return table.reshape(-1, self.bins, self.bins).sum(2 - half)

    def whole(self, feats: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(features, bins) of all rows."""
        sums = np.empty((len(feats), self.bins))
        for c, own in self.of(feats):
            np.copyto(self.cell, self.codes[c])
            table = np.bincount(self.cell, g, self.cells)
            for i, half in own:
                sums[i] = self.one(table, half)[0]
        return self.all[feats], sums

    def parts(self, feats: np.ndarray, parts: list[np.ndarray], g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(parts, features, bins), each part the numbers of its rows."""
        at = np.concatenate(parts)
        first, own_g = np.repeat(np.arange(len(parts)) * self.cells, [len(p) for p in parts]), g[at]
        n, sums = (np.empty((len(parts), len(feats), self.bins), t) for t in (np.int64, np.float64))
        code, cell, size = self.code[: len(at)], self.cell[: len(at)], len(parts) * self.cells
        largest, both = int(np.abs(own_g).max(initial=0)), {}
        for c, own in self.of(feats):
            np.take(self.codes[c], at, out=code, mode="clip")  # checked modes fill a copy first
            np.add(code, first, out=cell)
            place = (self.most[c] * largest).bit_length() + 1
            if (self.most[c] + 1) << place <= 2**53:  # a double holds a cell's rows above its gradients, both exactly
                if place not in both:
                    both[place] = own_g + 2.0**place
                packed = np.bincount(cell, both[place], size)
                rows = np.rint(packed * 2.0**-place)
                tables = rows, packed - rows * 2.0**place
            else:
                tables = np.bincount(cell, minlength=size), np.bincount(cell, own_g, size)
            for i, half in own:
                n[:, i], sums[:, i] = (self.one(t, half) for t in tables)
        return n, sums


def grow_tree(tree: Growing, columns: Columns, g: np.ndarray, now: np.ndarray, unit: float) -> None:
    """Grow a tree by gradients `g`, and move `now` by its leaves.  Each node keeps the numbers of its rows.  Of the two
    sides of a split only the smaller is read: what it leaves of the node's whole-number sums is the larger."""
    depth, least = tree.shape.depth, tree.shape.least_rows
    rows, found = {0: np.arange(columns.rows)}, {0: columns.whole(tree.feats, g)}
    for level in range(depth):
        splits = {i: (best_split(*found[i], least), found[i][0][0].sum(), found[i][1][0].sum()) for i in tree.open}
        tree.grown(level, splits, unit)
        small, following, left = [], set(tree.open), {}
        for i, own in rows.items():
            at = i + 2**level - 1
            if i not in splits or tree.feature[at] < 0:
                now[own] += tree.value[i << (depth - level)]
                continue
            right = columns.x[tree.feature[at]].take(own, mode="clip") > tree.bin[at]
            if not following:  # both sides are leaves, as on the last level
                now[own] += np.where(right, *(tree.value[k << (depth - level - 1)] for k in (2 * i + 1, 2 * i)))
                continue
            left[2 * i], left[2 * i + 1] = own.take(np.flatnonzero(~right)), own.take(np.flatnonzero(right))
            if following & {2 * i, 2 * i + 1}:
                small.append(min(2 * i, 2 * i + 1, key=lambda k: len(left[k])))
        after = {}
        if small:
            n, sums = columns.parts(tree.feats, [left[k] for k in small], g)
            for j, k in enumerate(small):
                after[k] = n[j], sums[j]
                after[k ^ 1] = found[k >> 1][0] - n[j], found[k >> 1][1] - sums[j]
        rows, found = left, after
        if not rows:
            break


def grow_model(x: np.ndarray, y: np.ndarray, mean: float, most: float, shape: Shape) -> list[Growing]:
    """All trees of a model whose rows are here."""
    now, unit, out, columns = np.full(len(y), mean), (most or 1.0) / UNITS, [], Columns(x, shape.bins)
    g = np.empty(len(y))
    for t in range(shape.trees):
        tree = Growing(shape, t, x.shape[1])
        np.subtract(now, y, out=g)
        np.divide(g, unit, out=g)
        grow_tree(tree, columns, np.rint(g, out=g), now, unit)
        out.append(tree)
    return out


def statistics(rows: DataFrame, splits: DataFrame, roles: tuple[str, ...], targets: tuple[str, ...]) -> DataFrame:
    """(fold, target, n, mean, most): training rows, their mean, and the largest distance from it, from one row for
    each city and target."""
    value = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).cast("double").alias("y")) for t in targets])).alias("u")
    cities = rows.select("city", value).select("city", "u.*").groupBy("city", "target").agg(F.count("*").alias("n"), F.sum("y").alias("s"), F.min("y").alias("lo"), F.max("y").alias("hi"))
    own = splits.where(F.col("role").isin(*roles)).join(cities, "city").groupBy("fold", "target").agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("mean"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return stage(own.select("fold", "target", "n", "mean", F.greatest(F.col("hi") - F.col("mean"), F.col("mean") - F.col("lo")).alias("most")), "statistics")


MODEL = "target string, mean double, feature array<smallint>, bin binary, value array<double>"


def as_arrays(trees: list[Growing]) -> tuple[list[int], bytes, list[float]]:
    return np.concatenate([t.feature for t in trees]).tolist(), b"".join(t.bin.tobytes() for t in trees), np.concatenate([t.value for t in trees]).tolist()


def boosted_models(tiles: DataFrame, splits: DataFrame, shape: Shape = Shape(), targets: tuple[str, ...] = TARGETS, roles: tuple[str, ...] = ("train",), in_task: int = 256 << 20, all_tasks: int = 64 << 30) -> tuple[DataFrame, list[list[float]]]:
    """(fold, target, mean, feature, bin, value), written: the trees of every fold and target, end to end; and the bins'
    edges.  `tiles`: city, v and the targets; tiles with a null or NaN target are left out."""
    edges = bin_edges(tiles, shape.bins)
    known = tiles.select("city", "v", *targets)
    for t in targets:
        known = known.where(F.col(t).isNotNull() & ~F.isnan(t))
    rows = stage(binned(known, edges), "bins")
    stats, d = statistics(rows, splits, roles, targets), len(edges)
    sizes = stats.agg(F.max("n").alias("most"), F.sum("n").alias("all"), F.count("*").alias("models")).first()
    fold = splits.schema["fold"].dataType.simpleString()
    if (sizes["most"] or 0) * d <= in_task and (sizes["all"] or 0) * d <= all_tasks:
        return stage(_in_tasks(rows, splits, stats, sizes["models"], shape, targets, roles, d, fold), "models"), edges
    return _over_tasks(rows, splits, stats, shape, targets, roles, d, fold), edges


def _in_tasks(rows: DataFrame, splits: DataFrame, stats: DataFrame, models: int, shape: Shape, targets: tuple[str, ...], roles: tuple[str, ...], d: int, fold: str) -> DataFrame:
    value = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).cast("double").alias("y")) for t in targets])).alias("u")
    long = rows.join(splits.where(F.col("role").isin(*roles)).select("fold", "city"), "city").select("fold", "bins", value).select("fold", "bins", "u.*")
    about = F.broadcast(stats.select("fold", "target", "mean", "most"))  # a row for each fold and target
    keys = ("fold", "target")
    dealt = long.join(about, [*keys]).repartitionByRange(RANGES * max(models, 1), *keys)

    def train(key: tuple[pa.Scalar, ...], own: pa.Table) -> pa.Table:
        mean, most = (own.column(c)[0].as_py() for c in ("mean", "most"))
        trees = grow_model(unpacked(own.column("bins"), d), own.column("y").to_numpy(), mean, most, shape)
        f, b, v = as_arrays(trees)
        types = [own.schema.field("fold").type, pa.string(), pa.float64(), pa.list_(pa.int16()), pa.binary(), pa.list_(pa.float64())]
        return pa.table([pa.array([c], t) for c, t in zip((*(k.as_py() for k in key), mean, f, b, v), types, strict=True)], names=["fold", "target", "mean", "feature", "bin", "value"])

    return dealt.groupBy(*keys).applyInArrow(train, f"fold {fold}, {MODEL}")


def _over_tasks(rows: DataFrame, splits: DataFrame, stats: DataFrame, shape: Shape, targets: tuple[str, ...], roles: tuple[str, ...], d: int, fold: str) -> DataFrame:
    """The same trees by one aggregate for each level of all models (in groups of TOGETHER).  The driver holds the
    trees, whose number does not depend on the rows."""
    spark = rows.sparkSession
    training = {}
    for r in splits.where(F.col("role").isin(*roles)).select("fold", "city").collect():  # a row for each fold and city
        training.setdefault(r["fold"], set()).add(r["city"])
    every, out = stats.orderBy("fold", "target").collect(), None
    for first in range(0, len(every), TOGETHER):
        models = every[first : first + TOGETHER]
        grown: list[list[Growing]] = [[] for _ in models]
        units = [(m["most"] or 1.0) / UNITS for m in models]
        member = [training[m["fold"]] for m in models]
        state = stage(rows.withColumn("now", F.array(*[F.lit(float(m["mean"])) for m in models])), "state")
        written = 0
        for t in range(shape.trees):
            trees = [Growing(shape, t, d) for _ in models]
            for level in range(shape.depth):
                if not any(tree.open for tree in trees):
                    break
                for k, found in _level(state, models, member, [own[written:] for own in grown], trees, level, units, shape, d).items():
                    trees[k].grown(level, found, units[k])
            for own, tree in zip(grown, trees, strict=True):
                own.append(tree)
            if t + 1 - written == WRITTEN and t + 1 < shape.trees:
                state, written = stage(_moved(state, [own[written:] for own in grown], d), "state"), t + 1
        made = [(m["fold"], m["target"], m["mean"], *as_arrays(own)) for m, own in zip(models, grown, strict=True)]
        one = stage(spark.createDataFrame([(a, b, c, f, bytearray(g), v) for a, b, c, f, g, v in made], f"fold {fold}, {MODEL}"), "models")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], f"fold {fold}, {MODEL}")


def _predictions(table: pa.Table, recent: list[list[Growing]], d: int) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the rows, and their running predictions with the trees that are not written yet."""
    x, now = unpacked(table.column("bins"), d), matrix(table, "now").copy()
    for k, own in enumerate(recent):
        for tree in own:
            now[:, k] += tree.value[tree.place(x, tree.shape.depth)]
    return x, now


def _moved(state: DataFrame, recent: list[list[Growing]], d: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, now = _predictions(pa.Table.from_batches([batch]), recent, d)
            yield batch.set_column(batch.schema.get_field_index("now"), "now", pa.array(now.tolist(), pa.list_(pa.float64())))

    return state.mapInArrow(work, state.schema)


def _level(state: DataFrame, models: list, member: list[set], recent: list[list[Growing]], trees: list[Growing], level: int, units: list[float], shape: Shape, d: int) -> dict[int, dict]:
    """{model: {node: (split, rows, gradient)}} of the open nodes of a level."""
    targets = [m["target"] for m in models]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not table.num_rows:
                continue
            x, now = _predictions(table, recent, d)
            city = np.array(table.column("city").to_pylist(), object)
            y = {t: table.column(t).to_numpy() for t in set(targets)}
            for k, tree in enumerate(trees):
                mine = np.array([c in member[k] for c in city])
                if tree.open and mine.any():
                    g = np.rint((now[mine, k] - y[targets[k]][mine]) / units[k])
                    found = tree.histograms(x[mine], g, tree.place(x[mine], level))
                    sums[k] = [a + b for a, b in zip(sums[k], found, strict=True)] if k in sums else list(found)
        for k, (n, g) in sums.items():
            node, f, b = np.nonzero(n)
            columns = [np.full(len(node), k), np.array(trees[k].open)[node], f, b, n[node, f, b], g[node, f, b]]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["model", "node", "feature", "bin", "n", "g"])

    cells = state.mapInArrow(count, "model long, node long, feature long, bin long, n long, g long").groupBy("model", "node", "feature", "bin").agg(F.sum("n").alias("n"), F.sum("g").alias("g"))

    def best(own: pa.Table) -> pa.Table:
        c = {name: own.column(name).to_numpy() for name in own.column_names}
        k = int(c["model"][0])
        n, g = (np.zeros((len(trees[k].feats), shape.bins)) for _ in range(2))
        n[c["feature"], c["bin"]], g[c["feature"], c["bin"]] = c["n"], c["g"]
        split = best_split(n, g, shape.least_rows)
        row = (k, int(c["node"][0]), *(split or (-1, -1, 0.0, 0.0)), float(n[0].sum()), float(g[0].sum()))
        return pa.table([pa.array([v], pa.int64() if i < 4 else pa.float64()) for i, v in enumerate(row)], names=["model", "node", "feature", "bin", "left", "sums", "n", "g"])

    out: dict[int, dict] = {}
    schema = "model long, node long, feature long, bin long, left double, sums double, n double, g double"
    for r in cells.groupBy("model", "node").applyInArrow(best, schema).collect():  # a row for each open node
        split = None if r["feature"] < 0 else (r["feature"], r["bin"], r["left"], r["sums"])
        out.setdefault(r["model"], {})[r["node"]] = (split, r["n"], r["g"])
    return out


def boosted_predictions(models: DataFrame, edges: list[list[float]], test: DataFrame, depth: int) -> DataFrame:
    """(fold, tile, target, pred) of the test tiles (fold, tile, v) by the trees of their fold.  Blocks of tiles meet
    their fold's models, so neither a fold's tiles nor all models are in one place."""
    own, d, types = binned(test.select("fold", "tile", "v"), edges), len(edges), test.schema
    inner, leaves = 2**depth - 1, 2**depth

    def work(a: pa.Table, b: pa.Table) -> pa.Table:
        x, parts = unpacked(a.column("bins"), d), []
        rows = np.arange(len(x))
        for m in b.to_pylist():
            f, cut, value = np.array(m["feature"], np.int64).reshape(-1, inner), np.frombuffer(m["bin"], np.uint8).reshape(-1, inner), np.array(m["value"]).reshape(-1, leaves)
            pred = np.full(len(x), m["mean"])
            for k in range(len(f)):
                node = np.zeros(len(x), np.int64)
                for level in range(depth):
                    at = node + 2**level - 1
                    node = 2 * node + ((f[k, at] >= 0) & (x[rows, np.maximum(f[k, at], 0)] > cut[k, at]))
                pred += value[k, node]
            parts.append(a.select(["fold", "tile"]).append_column("target", pa.array([m["target"]] * len(x), pa.string())).append_column("pred", pa.array(pred)))
        return pa.concat_tables(parts)

    schema = f"fold {types['fold'].dataType.simpleString()}, tile {types['tile'].dataType.simpleString()}, target string, pred double"
    return block_pairs(own, models.withColumn("tile", F.lit(0).cast(types["tile"].dataType)), ("fold",), "tile", work, schema, per_block=20_000)
