"""Training by sums against plain fits that hold all rows."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from barweave.operators import specialists as sp


def made(n=240, width=4, folds=2, seed=1, unbalanced=False):
    rng = np.random.default_rng(seed)
    out = []
    for f in range(folds):
        x = rng.normal(3, 2, (n, width)).round(2)
        x[:, 1] = x[:, 0] * 0.9 + rng.normal(0, 0.2, n).round(2)  # nearly the same
        z = (x[:, 0] - 3) * 0.8 - (x[:, 2] - 3) * 0.5 + rng.normal(0, 1, n) - (3 if unbalanced else 0)
        out += [(f, i, bool(z[i] > 0), *map(float, x[i])) for i in range(n)]
    return out


NAMES = ["a", "b", "c", "d"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "fold long, i long, positive boolean, " + ", ".join(f"{n} double" for n in NAMES)).repartition(5)


def plain(rows, fold):
    mine = [r for r in rows if r[0] == fold]
    x, y = np.array([r[3:] for r in mine]), np.array([r[2] for r in mine], float)
    return (x - x.mean(0)) / x.std(0), y


def proximal_gradient(x, y, w, c=1.0, ratio=0.5):
    """The same objective by many small steps."""
    x1 = np.column_stack([x, np.ones(len(x))])
    b = np.zeros(x1.shape[1])
    step = 1 / (np.linalg.eigvalsh((x1 * w[:, None]).T @ x1)[-1] / 4 * c + 1)
    v, t = b.copy(), 1.0
    for _ in range(40_000):
        p = 1 / (1 + np.exp(-(x1 @ v)))
        g = c * (x1.T @ (w * (p - y)))
        g[:-1] += (1 - ratio) * v[:-1]
        new = v - step * g
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * ratio, 0)
        if (new - v) @ (new - b) < 0 and t > 1:
            t = 1.0
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, b, t = new + (t - 1) / t2 * (new - b), new, t2
    return b


@pytest.mark.parametrize("unbalanced,c,ratio", [(False, 1.0, 0.5), (True, 1.0, 0.5), (False, 0.05, 0.9)])
def test_elastic_net_matches_a_plain_fit(spark, unbalanced, c, ratio):
    rows = made(unbalanced=unbalanced)
    train, _ = sp.standardised(frame(spark, rows), NAMES, F.lit(True))
    train = train.cache()
    model = sp.elastic_net(train, NAMES, c, ratio)
    for r in model.collect():
        x, y = plain(rows, r["fold"])
        part = y.mean()
        w = np.ones(len(y)) if 0.3 <= part <= 0.7 else np.where(y == 1, 1 / (2 * part), 1 / (2 * (1 - part)))
        assert unbalanced == (w[0] != 1)
        want = proximal_gradient(x, y, w, c, ratio)
        assert np.abs(np.array([*r["coefficients"], r["intercept"]]) - want).max() < 1e-6
        scores = {s["i"]: s["score"] for s in sp.linear_scores(train.where(F.col("fold") == r["fold"]), model).collect()}
        assert np.abs(np.array([scores[i] for i in range(len(y))]) - (x @ np.array(r["coefficients"]) + r["intercept"])).max() < 1e-12


def test_no_convergence_is_an_error(spark):
    train, _ = sp.standardised(frame(spark, made(60, folds=1)), NAMES, F.lit(True))
    with pytest.raises(ValueError, match="did not converge in 2 steps: \\[0\\]"):
        sp.elastic_net(train, NAMES, most=2)


def plain_boosting(x, y, trees, rate, leaf):
    """Depth two, splits between any two values."""
    score = np.full(len(y), np.log(y.mean() / (1 - y.mean())))

    def split(rows, r):
        best = None
        for i in range(x.shape[1]):
            for cut in np.unique(x[rows, i])[:-1]:
                left = x[rows, i] <= cut
                nl, nr = left.sum(), (~left).sum()
                if nl >= leaf and nr >= leaf:
                    gain = round(nl * nr / (nl + nr) * (r[rows][left].mean() - r[rows][~left].mean()) ** 2, 10)
                    if gain > 0 and (best is None or gain > best[0]):
                        best = (gain, i, cut)
        return best

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        r, h = y - p, p * (1 - p)
        todo = [(np.arange(len(y)), 0)]
        while todo:
            rows, depth = todo.pop()
            best = split(rows, r) if depth < 2 else None
            if best:
                left = x[rows, best[1]] <= best[2]
                todo += [(rows[left], depth + 1), (rows[~left], depth + 1)]
            else:
                score[rows] += rate * r[rows].sum() / h[rows].sum()
    return score


@pytest.mark.parametrize("every", [2, 25])
def test_trees_match_plain_boosting_and_their_table(spark, every):
    rows = [(f, i, p, *[round(v) for v in x]) for f, i, p, *x in made(150, seed=4)]
    rows = [(f, i, p, *map(float, x)) for f, i, p, *x in rows]
    train, _ = sp.standardised(frame(spark, rows), NAMES, F.lit(True))
    train = train.cache()
    nodes = sp.boosted_trees(train, NAMES, trees=5, rate=0.3, leaf=10, every=every)
    got = {(r["fold"], r["i"]): r["score"] for r in sp.tree_scores(train, nodes).collect()}
    for fold in (0, 1):
        x, y = plain(rows, fold)
        want = plain_boosting(x, y, 5, 0.3, 10)
        assert np.abs(np.array([got[fold, i] for i in range(len(y))]) - want).max() < 1e-12
    splits = nodes.where("threshold IS NOT NULL")
    assert splits.count() > 10 and splits.where("value IS NOT NULL OR name IS NULL").count() == 0


@pytest.mark.parametrize("parts,trees", [(1, 150), (3, 30)])
def test_all_trees_of_the_policy_match_plain_boosting(spark, monkeypatch, parts, trees):
    """Of rows in one partition and in several; rows' scores are written anew on the way."""
    real, told = sp._level, []
    rows = [(0, i, p, *[float(round(v)) for v in x]) for _, i, p, *x in made(150, seed=4, folds=1)]
    train, _ = sp.standardised(frame(spark, rows), NAMES, F.lit(True))
    train = train.cache()
    keep = sp.written

    def dealt(made, label):
        return keep(made.repartition(parts), label) if label == "binned" else keep(made, label)

    monkeypatch.setattr(sp, "ROWS", 150 // parts)
    monkeypatch.setattr(sp, "written", dealt)
    monkeypatch.setattr(sp, "_level", lambda *a: told.append(a[-1]) or real(*a))
    spark.conf.set("spark.sql.files.openCostInBytes", str(2**27))  # a file a partition
    try:
        nodes = sp.boosted_trees(train, NAMES, trees=trees, leaf=10)
        assert nodes.where("tree >= 0").select("tree").distinct().count() == trees
        got = {r["i"]: r["score"] for r in sp.tree_scores(train, nodes).collect()}
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert told == [parts == 1] * 2 * trees
    x, y = plain(rows, 0)
    assert np.abs(np.array([got[i] for i in range(len(y))]) - plain_boosting(x, y, trees, 0.03, 10)).max() < 1e-11


@pytest.mark.parametrize("query", ["arbitration_schedule", "fold_disagreement", "fold_entry_thresholds", "specialist_threshold_events"])
def test_queries_of_the_bundle_grow_all_trees_of_the_policy(spark, monkeypatch, query):
    """150 of depth two at rate 0.03 with leaves of 100 rows; they grew 8."""
    import inspect

    import __spark_entry__
    from barweave.plans import specialist

    class Asked(Exception):
        pass

    def boosted_trees(*a, **k):
        raise Asked(asked.bind(*a, **k))

    asked, rng = inspect.signature(sp.boosted_trees), np.random.default_rng(3)
    rows = [(0, "train", bool(rng.random() < 0.5), True, *map(float, rng.normal(0, 1, len(specialist._NAMES)))) for _ in range(200)]
    panel = spark.createDataFrame(rows, "fold long, role string, positive boolean, stretch boolean, " + ", ".join(f"{n} double" for n in specialist._NAMES))
    zeros = spark.createDataFrame([(0, [0.0] * len(specialist.TREND), 0.0)], "fold long, coefficients array<double>, intercept double")
    monkeypatch.setattr(specialist, "_MADE", {})
    monkeypatch.setattr(specialist, "_daily", lambda *a: panel)
    monkeypatch.setattr(specialist, "panel", lambda *a: panel)
    monkeypatch.setattr(sp, "elastic_net", lambda *a: zeros)
    monkeypatch.setattr(sp, "boosted_trees", boosted_trees)
    with pytest.raises(Asked) as found:
        __spark_entry__.queries()[query](spark, "made")
    found.value.args[0].apply_defaults()
    told = found.value.args[0].arguments
    assert {k: told[k] for k in ("trees", "rate", "depth", "leaf")} == {"trees": 150, "rate": 0.03, "depth": 2, "leaf": 100}


def test_no_split_leaves_one_value(spark):
    train, _ = sp.standardised(frame(spark, made(30, folds=1)), NAMES, F.lit(True))
    nodes = sp.boosted_trees(train, NAMES, trees=1, leaf=16).orderBy("tree").collect()
    assert [(r["tree"], r["node"], r["threshold"]) for r in nodes] == [(-1, 0, None), (0, 0, None)]


def test_what_cannot_be_trained_is_named(spark):
    rows = made(20)
    same = [(*r[:3], 5.0, *r[4:]) if r[0] == 1 else r for r in rows]
    with pytest.raises(ValueError, match="\\(1, 'a'\\)"):
        sp.standardised(frame(spark, same), NAMES, F.lit(True))
    with pytest.raises(ValueError, match="\\(0, 'one class only'\\)"):
        sp.standardised(frame(spark, [(f, i, p or f == 0, *x) for f, i, p, *x in rows]), NAMES, F.lit(True))


def test_platt_matches_a_plain_fit_and_keeps_its_minima(spark):
    rng = np.random.default_rng(2)
    rows = [(f, float(s), bool(rng.random() < 1 / (1 + np.exp(-(1.7 * s - 0.4 + f))))) for f in range(3) for s in rng.normal(0, 1.5, 300)]
    scores = spark.createDataFrame(rows, "fold long, score double, positive boolean")
    for r in sp.platt(scores).collect():
        s, y = (np.array([row[k] for row in rows if row[0] == r["fold"]], float) for k in (1, 2))
        b = proximal_gradient(s[:, None], y, np.ones(len(y)), 1e6, 0.0)  # hardly penalised
        assert abs(r["slope"] - b[0]) < 1e-3 and abs(r["intercept"] - b[1]) < 1e-3
        p = 1 / (1 + np.exp(-(r["slope"] * s + r["intercept"])))
        assert abs((p - y) @ s) < 1e-6 and abs((p - y).sum()) < 1e-6  # where the loss is least
        assert (r["n"], r["n_positive"]) == (300, y.sum()) and abs(r["low"] - p.min()) < 1e-12 and abs(r["high"] - p.max()) < 1e-12
    for least in ({"rows": 301}, {"positives": 299}, {"negatives": 299}):
        with pytest.raises(ValueError, match="fewer than"):
            sp.platt(scores, **least)


def test_return_map_and_thresholds(spark):
    rows = spark.createDataFrame([(0, 0.40 + 0.005 * i, 0.01 * i - 0.2) for i in range(50)], "fold long, p double, gross_return double")
    maps = sp.return_maps(rows, "p")
    some = spark.createDataFrame([(0, p) for p in (0.1, 0.5, 0.9)], "fold long, p double")
    assert [round(r["e"], 9) for r in sp.expected(some, maps, "p", "e").orderBy("p").collect()] == [-0.2, 0.0, 0.29]
    with pytest.raises(ValueError, match="no variance"):
        sp.return_maps(rows.withColumn("p", F.lit(0.5)), "p")
    got = sp.entry_thresholds(rows, "p", F.col("p") < 0.6 - 1e-9, (0.5, 0.8)).orderBy("percentile").collect()
    assert [(r["n"], round(r["quantile"], 9), round(r["threshold"], 9)) for r in got] == [(40, 0.4975, 0.5), (40, 0.556, 0.556)]
    with pytest.raises(ValueError, match="fewer than 41"):
        sp.entry_thresholds(rows, "p", F.col("p") < 0.6 - 1e-9, least=41)


def test_item_bars_hash_their_rows_and_keep_the_order_of_lines(spark, tmp_path):
    """Order, then line, from end to end of their types; rows compared by a struct were sorted to be aggregated."""
    from barweave.sources import bars

    keys = [(-(2**63), 2**31 - 1), (-(2**63), -(2**31)), (-1, 5), (-1, -5), (0, 2), (7, 1), (7, 2), (2**63 - 1, -(2**31)), (2**63 - 1, 2**31 - 1)]
    random = np.random.default_rng(3)
    schema = "l_orderkey bigint, l_linenumber int, l_returnflag string, l_shipdate timestamp_ntz, l_extendedprice double, l_quantity double"
    for low, high in ((0, 9), (0, 5), (2, 7), (5, 9)):
        made = [(*keys[i], "A", datetime(2024, 1, 1), 100.0 + i, 1.0) for i in random.permutation(range(low, high)).tolist()]
        path = tmp_path / f"{low}-{high}"
        spark.createDataFrame(made, schema).write.parquet(f"{path}/lineitem.parquet")
        found = bars.item_bars(spark, str(path))
        row = found.collect()[0]
        order = sorted(range(low, high), key=lambda i: keys[i])
        assert (row["open"], row["close"]) == (100.0 + order[0], 100.0 + order[-1])
        assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()


def test_panel_reads_line_items_once(spark, monkeypatch):
    from barweave.plans import specialist
    from barweave.sources import bars

    read, real = [], bars.item_bars
    monkeypatch.setattr(bars, "item_bars", lambda *a: read.append(a) or real(*a))
    specialist.panel(spark, "/root/testdata/sf0.001")
    assert len(read) == 1
