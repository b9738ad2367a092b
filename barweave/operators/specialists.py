"""Specialists of a study, trained per fold by sums over rows.

Rows are never gathered: each step of training is one pass in which tasks add up what the step needs (gradient and curvature,
histograms), one exchange of those sums by fold, and a driver that keeps a fold's parameters.  What reaches the driver
grows with folds and features, not with rows.

``standardised`` gives the design matrix, ``elastic_net`` and ``boosted_trees`` the models as tables, ``linear_scores`` and
``tree_scores`` apply such tables, and ``platt`` calibrates scores.  What a fold cannot be trained on (one class only, a constant
feature, too few rows, no convergence) is an error that names it.  Folds are longs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barweave.sources.shared import written


def standardised(rows: DataFrame, names: list[str], train: Column) -> tuple[DataFrame, DataFrame]:
    """rows with x, their standardised features, and weight, and the scales: fold, n, positives, means, scales.

    Means and population deviations are of the fold's training rows.  Classes weigh the same where fewer than 30 or more
    than 70 per cent of them are positive.  rows: fold, positive and the features."""
    y = F.col("positive").cast("double")
    made = [F.array(*[f(n) for n in names]).alias(a) for a, f in (("means", F.avg), ("scales", F.stddev_pop))]
    scales = written(rows.where(train).groupBy("fold").agg(F.count("*").alias("n"), F.sum(y).cast("bigint").alias("positives"), *made), "scales")
    flat = F.filter(F.arrays_zip(F.array(*map(F.lit, names)).alias("name"), F.col("scales").alias("scale")), lambda z: ~(z["scale"] > 0))
    bad = scales.select("fold", F.when((F.col("positives") == 0) | (F.col("positives") == F.col("n")), "one class only").otherwise(F.concat_ws(", ", F.transform(flat, lambda z: z["name"]))).alias("why"))
    _none(bad.where("why <> ''"), "cannot be trained: one class or constant features")
    part = F.col("positives") / F.col("n")
    of_class = F.when(F.col("positive"), F.col("n") / (2 * F.col("positives"))).otherwise(F.col("n") / (2 * (F.col("n") - F.col("positives"))))
    x = F.transform(F.arrays_zip(F.array(*names).alias("v"), F.col("means").alias("m"), F.col("scales").alias("s")), lambda z: (z["v"] - z["m"]) / z["s"])
    joined = rows.join(scales, "fold").withColumns({"x": x, "weight": F.when(part.between(0.30, 0.70), 1.0).otherwise(of_class)})
    return joined.drop("n", "positives", "means", "scales"), scales


def _none(bad: DataFrame, what: str) -> None:
    some = bad.limit(5).collect()
    if some:
        raise ValueError(f"folds that {what}: {'; '.join(str(tuple(r)) for r in some)}")


# Elastic net ----------------------------------------------------------------------------------------------------
def _log_sums(train: DataFrame, at: dict[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Weighted log loss, its gradient and curvature by fold, each at the fold's coefficients (the intercept last)."""
    width = len(next(iter(at.values())))
    upper = np.triu_indices(width)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            fold, y, w = (batch.column(i).to_numpy() for i in range(3))
            x = np.column_stack([batch.column(3).flatten().to_numpy().reshape(-1, width - 1), np.ones(len(fold))])
            for f in np.unique(fold).tolist():
                rows = fold == f
                z = x[rows] @ at[f]
                p = 1 / (1 + np.exp(-z))
                loss = w[rows] @ (np.logaddexp(0, z) - y[rows] * z)
                curve = (x[rows] * (w[rows] * p * (1 - p))[:, None]).T @ x[rows]
                sums = np.concatenate([[loss], x[rows].T @ (w[rows] * (p - y[rows])), curve[upper]])
                total[f] = total[f] + sums if f in total else sums
        yield pa.record_batch([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.list_(pa.float64()))], names=["fold", "sums"])

    mine = train.where(F.col("fold").isin(list(at))).select("fold", F.col("positive").cast("double").alias("y"), "weight", "x")
    parts = mine.mapInArrow(add, "fold bigint, sums array<double>").select("fold", F.posexplode("sums").alias("place", "value"))
    found = parts.groupBy("fold", "place").agg(F.sum("value").alias("value")).toPandas()  # folds x features squared
    out = {}
    for f, g in found.groupby("fold"):
        sums = g.sort_values("place")["value"].to_numpy()
        curve = np.zeros((width, width))
        curve[upper] = sums[1 + width :]
        out[int(f)] = float(sums[0]), sums[1 : 1 + width], curve + np.triu(curve, 1).T
    return out


def _penalised_step(b: np.ndarray, slope: np.ndarray, curve: np.ndarray, l1: float, l2: float) -> np.ndarray:
    """Where the quadratic model at b and the penalties are least; the last coordinate is not penalised.

    Coordinates in turn find which are not zero and their signs, and for these the minimum is a linear system; it is the
    whole one's if no sign turns and no other coordinate's pull is over l1."""
    new, pull = b.copy(), slope.copy()  # pull: the model's gradient at new
    ridge = np.append(np.full(len(b) - 1, l2), 1e-12)
    free = np.append(np.zeros(len(b) - 1, bool), True)
    for sweep in range(2_000):
        for j in range(len(b)):
            goal = curve[j, j] * new[j] - pull[j]
            to = (goal if free[j] else np.sign(goal) * max(abs(goal) - l1, 0.0)) / (curve[j, j] + ridge[j])
            if to != new[j]:
                pull += curve[j] * (to - new[j])
                new[j] = to
        if sweep % 10 == 9:
            some = (new != 0) | free
            signs = np.where(free, 0.0, np.sign(new))[some]
            exact = np.zeros(len(b))
            exact[some] = np.linalg.solve(curve[np.ix_(some, some)] + np.diag(ridge[some]), (curve @ b - slope)[some] - l1 * signs)
            left = slope + curve @ (exact - b)
            if (np.sign(exact[some]) * np.abs(signs) == signs).all() and (np.abs(left[~some]) <= l1 * (1 + 1e-9)).all():
                return exact
    return new


def elastic_net(train: DataFrame, names: list[str], c: float = 1.0, l1_ratio: float = 0.5, tolerance: float = 1e-8, most: int = 100) -> DataFrame:
    """fold, names, coefficients, intercept and steps of the logistic model that minimises c times the weighted log loss
    plus l1_ratio of absolute and the rest of half squared coefficients.

    Each step goes to the minimum of a quadratic model, and half the way back where that did not lessen the objective."""
    l1, l2 = l1_ratio / c, (1 - l1_ratio) / c
    folds = [r["fold"] for r in train.select("fold").distinct().collect()]
    at = {f: np.zeros(len(names) + 1) for f in folds}
    seen: dict[int, tuple[float, np.ndarray]] = {}
    done: list[tuple] = []
    for step in range(most):
        if not at:
            break
        for f, (loss, slope, curve) in _log_sums(train, at).items():
            b = at[f]
            value = loss + l1 * np.abs(b[:-1]).sum() + l2 / 2 * (b[:-1] ** 2).sum()
            if f in seen and value > seen[f][0] + 1e-9 * abs(seen[f][0]):
                at[f] = (b + seen[f][1]) / 2
                continue
            new = _penalised_step(b, slope, curve, l1, l2)
            if np.abs(new - b).max() <= tolerance:
                done.append((f, names, [float(v) for v in new[:-1]], float(new[-1]), step + 1))
                del at[f]
            else:
                seen[f], at[f] = (value, b), new
    if at:
        raise ValueError(f"folds that did not converge in {most} steps: {sorted(at)}")
    return train.sparkSession.createDataFrame(done, "fold bigint, names array<string>, coefficients array<double>, intercept double, steps int")


def linear_scores(rows: DataFrame, model: DataFrame, name: str = "score") -> DataFrame:
    """rows with the sum of coefficients and standardised features x and the intercept of their fold's model."""
    joined = rows.join(model.select("fold", "coefficients", "intercept"), "fold")
    total = F.aggregate(F.zip_with("x", "coefficients", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) + F.col("intercept")
    return joined.withColumn(name, total).drop("coefficients", "intercept")


# Boosted trees --------------------------------------------------------------------------------------------------
#: About as many rows make a task of a pass; fewer are one task.
ROWS = 2**17


def _cuts(train: DataFrame, width: int, bins: int) -> dict[int, list[np.ndarray]]:
    """For each fold and feature values that part its rows about evenly: folds x features x bins numbers."""
    at = [k / bins for k in range(1, bins)]
    made = [F.percentile_approx(F.col("x")[i], at, 100 * bins).alias(f"c{i}") for i in range(width)]
    return {r["fold"]: [np.unique(np.array(r[f"c{i}"])) for i in range(width)] for r in train.groupBy("fold").agg(*made).collect()}


def _binned(train: DataFrame, cuts: dict[int, list[np.ndarray]], width: int) -> DataFrame:
    """fold, y, score and bins, a byte for each feature: how many cuts are below its value."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold, y, score = (batch.column(i).to_numpy() for i in range(3))
            x = batch.column(3).flatten().to_numpy().reshape(-1, width)
            out = np.zeros(x.shape, np.uint8)
            for f in np.unique(fold).tolist():
                rows = fold == f
                for i in range(width):
                    out[rows, i] = np.searchsorted(cuts[f][i], x[rows, i], "left")
            yield pa.record_batch([batch.column(0), pa.array(y), pa.array(score), pa.array([r.tobytes() for r in out], pa.binary())], names=["fold", "y", "score", "bins"])

    return train.select("fold", F.col("positive").cast("double").alias("y"), "score", "x").mapInArrow(place, "fold bigint, y double, score double, bins binary")


def _route(bins: np.ndarray, tree: dict[int, tuple]) -> np.ndarray:
    """The node of each row; a tree maps nodes that split to (feature, last bin that goes left)."""
    node = np.zeros(len(bins), np.int64)
    for at in sorted(tree):
        feature, last = tree[at][:2]
        here = node == at
        node[here] = 2 * at + 1 + (bins[here, feature] > last)
    return node


def _level(binned: DataFrame, grown: dict[int, list[tuple[dict, dict]]], now: dict[int, dict], level: int, width: int, bins: int, rate: float, leaf: int, alone: bool) -> dict[int, dict[int, dict]]:
    """Of each fold's nodes at a level the best split, if any, and the sums of residuals and curvature on both sides.

    grown: trees after those in the rows' scores (splits, values), now: the splits of the tree that grows.  A histogram is
    one row of bytes for a task, fold, node and feature; those of a feature are added in the order of tasks.  alone: the
    rows are few enough to be one partition, whose histograms need no exchange."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            fold, y, score = (batch.column(i).to_numpy() for i in range(3))
            placed = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, width)
            for f in np.unique(fold).tolist():
                rows = np.flatnonzero(fold == f)
                mine = placed[rows]
                p = 1 / (1 + np.exp(-_raised(score[rows], mine, grown[f], rate)))
                node = _route(mine, now[f])
                for at in np.unique(node[node >= 2**level - 1]).tolist():
                    here = node == at
                    place = (np.arange(width) * bins + mine[here]).ravel()
                    r, h = (y[rows] - p)[here], (p * (1 - p))[here]
                    sums = np.array([np.bincount(place, np.repeat(v, width), width * bins) for v in (np.ones(len(r)), r, h)])
                    total[f, at] = total[f, at] + sums if (f, at) in total else sums
        task = TaskContext.get().partitionId()
        for (f, at), sums in total.items():
            each = sums.reshape(3, width, bins).transpose(1, 0, 2)
            columns = [pa.array(np.full(width, v)) for v in (f, at)] + [pa.array(np.arange(width)), pa.array(np.full(width, task)), pa.array([s.tobytes() for s in each], pa.binary())]
            yield pa.record_batch(columns, names=["fold", "node", "feature", "task", "sums"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int, int], np.ndarray] = {}
        for batch in batches:
            for *key, sums in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4))):
                sums, key = np.frombuffer(sums).reshape(3, bins), tuple(key)
                total[key] = total[key] + sums if key in total else sums
        if not total:
            return
        left = np.cumsum(list(total.values()), axis=2)
        (n, r, _), (of, ar, ah) = left.transpose(1, 0, 2), left[:, :, -1:].transpose(1, 0, 2)
        more = of - n
        some = (n >= max(leaf, 1)) & (more >= max(leaf, 1))
        between = n * more / of * (r / np.where(some, n, 1) - (ar - r) / np.where(some, more, 1)) ** 2
        gain = np.where(some, np.round(between, 10), 0.0)
        cut, one = gain.argmax(1), np.arange(len(gain))  # of equal gains the lowest cut
        columns = [*np.array(list(total)).T, cut, gain[one, cut], left[one, 1, cut], left[one, 2, cut], ar[:, 0], ah[:, 0]]
        yield pa.record_batch([pa.array(c) for c in columns], names=["fold", "node", "feature", "bin", "gain", "lr", "lh", "r", "h"])

    keys, schema = ["fold", "node", "feature"], "fold bigint, node bigint, feature bigint, bin bigint, gain double, lr double, lh double, r double, h double"
    if alone:
        told = binned.mapInArrow(lambda batches: split(add(batches)), schema)
    else:
        found = binned.mapInArrow(add, "fold bigint, node bigint, feature bigint, task bigint, sums binary")
        told = found.repartition(*keys).sortWithinPartitions(*keys, "task").mapInArrow(split, schema)
    out: dict[int, dict[int, dict]] = {}
    for row in sorted(told.collect(), key=lambda row: row["feature"]):  # folds x features
        at = out.setdefault(row["fold"], {}).setdefault(row["node"], {"best": None})
        at |= {"r": row["r"], "h": row["h"]}
        if row["gain"] > (at["best"]["gain"] if at["best"] else 0):  # of equal gains the first feature
            at["best"] = row
    return out


def _raised(score: np.ndarray, placed: np.ndarray, grown: list[tuple[dict, dict]], rate: float) -> np.ndarray:
    """Scores after the trees that are not in them yet."""
    score = score.copy()
    for splits, values in grown:
        node = _route(placed, splits)
        score += rate * np.array([values.get(i, 0.0) for i in range(int(node.max()) + 1)])[node]
    return score


def boosted_trees(train: DataFrame, names: list[str], trees: int = 150, rate: float = 0.03, depth: int = 2, leaf: int = 100, bins: int = 256, every: int = 25) -> DataFrame:
    """The nodes of each fold's trees, grown on log loss: fold, tree, node (0 is the root; 2 i + 1 and 2 i + 2 are i's children),
    feature, name and threshold (values at or below it go left; null at a leaf), value (a leaf's) and rate.  Tree -1 has
    one leaf, the score that all rows begin with, at rate 1.

    Splits are between at most ``bins`` quantiles of a feature and need ``leaf`` rows on either side; each level is one pass.  Every
    ``every`` trees the rows' scores are written anew."""
    width = len(names)
    seen = train.groupBy("fold").agg(F.count("*").alias("n"), F.avg(F.col("positive").cast("double")).alias("p")).collect()
    starts = {r["fold"]: float(np.log(r["p"] / (1 - r["p"]))) for r in seen}
    tasks = max(1, -(-sum(r["n"] for r in seen) // ROWS))  # at most; whatever the session's number of shuffle partitions is
    cuts = _cuts(train, width, bins)
    first = F.element_at(F.create_map(*[F.lit(v) for item in starts.items() for v in item]), F.col("fold"))
    # side by side a task has few folds, and few histograms
    dealt = _binned(train.withColumn("score", first), cuts, width).repartitionByRange("fold", "bins").coalesce(tasks)
    binned = written(dealt.sortWithinPartitions("fold", "bins", "y"), "binned").coalesce(tasks)
    nodes = [(f, -1, 0, None, None, None, start, 1.0) for f, start in starts.items()]
    grown: dict[int, list[tuple[dict, dict]]] = {f: [] for f in starts}
    for tree in range(trees):
        splits: dict[int, dict] = {f: {} for f in starts}
        values: dict[int, dict] = {f: {} for f in starts}
        for level in range(depth):
            for f, found in _level(binned, grown, splits, level, width, bins, rate, leaf, tasks == 1).items():
                for at, told in found.items():
                    best = told["best"]
                    values[f][at] = told["r"] / told["h"] if told["h"] > 1e-150 else 0.0
                    if best:
                        splits[f][at] = (best["feature"], best["bin"])
                        del values[f][at]
                        for child, r, h in ((2 * at + 1, best["lr"], best["lh"]), (2 * at + 2, told["r"] - best["lr"], told["h"] - best["lh"])):
                            values[f][child] = r / h if h > 1e-150 else 0.0
        for f in starts:
            grown[f].append((splits[f], values[f]))
            nodes += [(f, tree, at, i, names[i], float(cuts[f][i][b]), None, rate) for at, (i, b) in splits[f].items()]
            nodes += [(f, tree, at, None, None, None, float(v), rate) for at, v in values[f].items()]
        if (tree + 1) % every == 0 and tree + 1 < trees:
            binned, grown = written(_rescored(binned, grown, width, rate), "binned").coalesce(tasks), {f: [] for f in starts}
    schema = "fold bigint, tree int, node int, feature int, name string, threshold double, value double, rate double"
    return train.sparkSession.createDataFrame([(f, t, n, None if i is None else int(i), *rest) for f, t, n, i, *rest in nodes], schema)


def _rescored(binned: DataFrame, grown: dict[int, list[tuple[dict, dict]]], width: int, rate: float) -> DataFrame:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold, score = batch.column(0).to_numpy(), batch.column(2).to_numpy().copy()
            placed = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, width)
            for f in np.unique(fold).tolist():
                rows = np.flatnonzero(fold == f)
                score[rows] = _raised(score[rows], placed[rows], grown[f], rate)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(score), batch.column(3)], names=["fold", "y", "score", "bins"])

    return binned.mapInArrow(add, binned.schema)


def tree_scores(rows: DataFrame, nodes: DataFrame, depth: int = 2, name: str = "score") -> DataFrame:
    """rows with the sum of their leaves' values, times the rate, over the trees of their fold; x as trained on.

    A model is one row a fold, an array of trees of nodes by their numbers, and goes to all tasks, so that rows are not
    exchanged and no tree is searched for."""
    node = F.struct("feature", "threshold", (F.col("value") * F.col("rate")).alias("value"))
    places = F.array(*[F.max(F.when(F.col("node") == i, node)) for i in range(2 ** (depth + 1) - 1)])
    trees = nodes.groupBy("fold", "tree").agg(places.alias("nodes"))
    model = trees.groupBy("fold").agg(F.array_sort(F.collect_list(F.struct("tree", "nodes"))).alias("trees"))

    def leaf(tree: Column) -> Column:
        def down(at: Column, _: Column) -> Column:
            here = tree["nodes"][at]
            return F.when(here["threshold"].isNull(), at).when(F.col("x")[here["feature"]] <= here["threshold"], 2 * at + 1).otherwise(2 * at + 2)

        return tree["nodes"][F.aggregate(F.array(*map(F.lit, range(depth))), F.lit(0), down)]["value"]

    total = F.aggregate("trees", F.lit(0.0), lambda s, t: s + leaf(t))
    return rows.join(F.broadcast(model), "fold").withColumn(name, total).drop("trees")


# Calibration ----------------------------------------------------------------------------------------------------
def platt(scores: DataFrame, rows: int = 200, positives: int = 40, negatives: int = 40, tolerance: float = 1e-12, most: int = 100) -> DataFrame:
    """fold, slope, intercept, low and high (the probabilities' range), n and n_positive: a logistic calibration of scores
    (fold, score, positive) by Newton steps, each of five sums a fold.  A fold of fewer rows of a kind is an error."""
    y = F.col("positive").cast("double")
    counts = scores.groupBy("fold").agg(F.count("*").alias("n"), F.sum(y).cast("bigint").alias("n_positive"))
    counts = {r["fold"]: (r["n"], r["n_positive"]) for r in counts.collect()}
    short = [f for f, (n, p) in counts.items() if n < rows or p < positives or n - p < negatives]
    if short:
        raise ValueError(f"folds with fewer than {rows} scores, {positives} positive or {negatives} negative ones: {sorted(short)}")
    at = {f: (0.0, float(np.log(p / (n - p)))) for f, (n, p) in counts.items()}
    done: dict = {}
    kind = scores.schema["fold"].dataType.simpleString()
    for _ in range(most):
        if not at:
            break
        now = scores.sparkSession.createDataFrame([(f, a, b) for f, (a, b) in at.items()], f"fold {kind}, a double, b double")
        p = sigmoid(F.col("a") * F.col("score") + F.col("b"))
        w, e, s = p * (1 - p), p - y, F.col("score")
        sums = scores.join(now, "fold").groupBy("fold").agg(*[F.sum(v).alias(k) for k, v in (("gs", e * s), ("gi", e), ("ss", w * s * s), ("si", w * s), ("ii", w))])
        for r in sums.collect():
            ss, ii, f = r["ss"] + 1e-12, r["ii"] + 1e-12, r["fold"]
            det = ss * ii - r["si"] ** 2
            if not np.isfinite(det) or abs(det) <= 1e-12:
                raise ValueError(f"the calibration of fold {f} is singular")
            da, db = (r["gs"] * ii - r["gi"] * r["si"]) / det, (r["gi"] * ss - r["gs"] * r["si"]) / det
            at[f] = at[f][0] - da, at[f][1] - db
            if max(abs(da), abs(db)) <= tolerance * max(1.0, *map(abs, at[f])):
                done[f] = at.pop(f)
    if at:
        raise ValueError(f"folds whose calibration did not converge: {sorted(at)}")
    fits = scores.sparkSession.createDataFrame([(f, a, b) for f, (a, b) in done.items()], f"fold {kind}, slope double, intercept double")
    p = sigmoid(F.col("slope") * F.col("score") + F.col("intercept"))
    return scores.join(fits, "fold").groupBy("fold", "slope", "intercept").agg(F.min(p).alias("low"), F.max(p).alias("high"), F.count("*").alias("n"), F.sum(y).cast("bigint").alias("n_positive"))


def sigmoid(z: Column) -> Column:
    """Without overflow on either side."""
    return F.when(z >= 0, 1 / (1 + F.exp(-F.abs(z)))).otherwise(F.exp(-F.abs(z)) / (1 + F.exp(-F.abs(z))))


def calibrated(rows: DataFrame, fits: DataFrame, score: str, name: str) -> DataFrame:
    """rows with the probability of their score by their fold's calibration."""
    joined = rows.join(fits.select("fold", F.col("slope").alias("_a"), F.col("intercept").alias("_b")), "fold")
    return joined.withColumn(name, sigmoid(F.col("_a") * F.col(score) + F.col("_b"))).drop("_a", "_b")


def return_maps(rows: DataFrame, p: str) -> DataFrame:
    """fold, slope, intercept, low and high of the line from probability to gross return; a constant probability is an error."""
    fit = rows.groupBy("fold").agg(F.regr_slope("gross_return", p).alias("slope"), F.regr_intercept("gross_return", p).alias("intercept"), F.min(p).alias("low"), F.max(p).alias("high"))
    fit = written(fit, "maps")
    _none(fit.where("slope IS NULL OR low = high").select("fold"), "have no variance in their probabilities")
    return fit


def expected(rows: DataFrame, maps: DataFrame, p: str, name: str) -> DataFrame:
    """rows with what their probability, clamped to the range that the map was fitted on, lets expect."""
    joined = rows.join(maps.select("fold", *[F.col(k).alias(f"_{k}") for k in ("slope", "intercept", "low", "high")]), "fold")
    held = F.least(F.greatest(F.col(p), F.col("_low")), F.col("_high"))
    return joined.withColumn(name, F.col("_intercept") + F.col("_slope") * held).drop("_slope", "_intercept", "_low", "_high")


def entry_thresholds(rows: DataFrame, p: str, eligible: Column, percentiles: tuple[float, ...] = (0.70, 0.75, 0.80), floor: float = 0.50, least: int = 40) -> DataFrame:
    """fold, percentile, n, quantile and threshold: quantiles of the eligible probabilities, not under the floor.  A fold with
    fewer eligible rows is an error."""
    found = rows.groupBy("fold").agg(F.count_if(eligible).alias("n"), F.percentile(F.when(eligible, F.col(p)), F.array(*map(F.lit, percentiles))).alias("q"))
    found = written(found, "thresholds")
    _none(found.where(F.col("n") < least).select("fold", "n"), f"have fewer than {least} eligible rows")
    each = found.select("fold", "n", F.posexplode("q").alias("at", "quantile"))
    return each.select("fold", F.array(*map(F.lit, percentiles))[F.col("at")].alias("percentile"), "n", "quantile", F.greatest("quantile", F.lit(floor)).alias("threshold"))
