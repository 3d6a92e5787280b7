"""L5a, L5e, L6: own trees, the kernel model's probability, the out-of-fold table."""

import os

import duckdb
import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from riskscope.operators import dataset as DS
from riskscope.operators import extratrees as ET
from riskscope.operators import ml as ML
from riskscope.plans import catalog as CAT
from riskscope.plans import train as TR

from conftest import SF_ORACLE


def _rows(spark, n=400, parts=4):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(n, 4)), 2)
    x[:, 3] = 5.0  # never varies: never drawn
    y = ((x[:, 0] + x[:, 1] ** 2 + rng.normal(size=n) * 0.3) > 0.8).astype(int)
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], int(y[i])) for i in range(n)], "id int, x array<double>, label int")
    return df.repartition(parts, "id").persist(), x, y


def _plain_tree(x, y, tree, depth, k, weights, seed, min_leaf=2):
    """One tree by plain recursion over row sets; {node: (n0, n1, feature, cut)}."""
    out = {}

    def grow(rows, node, left):
        ones = int(y[rows].sum())
        n0, n1 = len(rows) - ones, ones
        best = None
        if left and n0 and n1 and len(rows) >= 2 * min_leaf:
            vary = [f for f in range(x.shape[1]) if x[rows, f].max() > x[rows, f].min()]
            vary.sort(key=lambda f: ET.draw(seed, "pick", tree, node, f))
            for f in vary[:k]:
                v = x[rows, f]
                cut = v.min() + int(ET.draw(seed, "cut", tree, node, f)[:8], 16) / 2.0**32 * (v.max() - v.min())
                a, b = rows[v <= cut], rows[v > cut]
                if min(len(a), len(b)) < min_leaf:
                    continue
                gain = 0.0
                for part in (a, b):
                    p1 = y[part].sum() * weights[1]
                    p0 = (len(part) - y[part].sum()) * weights[0]
                    gain += (p0 * p0 + p1 * p1) / (p0 + p1)
                if best is None or gain > best[0]:
                    best = (gain, f, cut, a, b)
        out[node] = (n0, n1, best[1] if best else -1, best[2] if best else 0.0)
        if best:
            grow(best[3], 2 * node + 1, left - 1)
            grow(best[4], 2 * node + 2, left - 1)

    grow(np.arange(len(y)), 0, depth)
    return out


def test_trees_equal_plain_recursion(spark):
    df, x, y = _rows(spark)
    model = ET.fit(df, 4, n_trees=5, max_depth=6, max_features=2, seed=7, group=2)
    n = model.nodes
    for t in range(5):
        mine = n["tree"] == t
        got = {int(i): (int(a), int(b), int(f), float(c)) for i, a, b, f, c in
               zip(*(n[k][mine] for k in ("node", "n0", "n1", "feature", "cut")))}
        want = _plain_tree(x, y, t, 6, 2, model.weights, 7)
        assert got.keys() == want.keys()
        for node, w in want.items():
            assert got[node][:3] == w[:3] and abs(got[node][3] - w[3]) < 1e-12
    assert len(n["tree"]) > 50 and model.importances(4)[3] == 0 and abs(model.importances(4).sum() - 1) < 1e-9


def test_trees_do_not_depend_on_partitions_and_reload(spark):
    df, _, _ = _rows(spark)
    one = ET.fit(df.coalesce(1), 4, n_trees=3, max_depth=5)
    two = ET.fit(df.repartition(7), 4, n_trees=3, max_depth=5, group=1)
    # Groups change the order in the arrays, not the nodes.
    key = lambda m: sorted(zip(*(m.nodes[k].tolist() for k in ("tree", "node", "n0", "n1", "feature", "cut"))))
    assert key(one) == key(two)
    back = ET.ExtraTrees.of_table(one.table(spark), one.weights)
    p = df.select(one.probability(F.col("x")).alias("a"), back.probability(F.col("x")).alias("b")).collect()
    assert all(r["a"] == r["b"] and 0 <= r["a"] <= 1 for r in p)


def test_trees_without_rows_or_with_one_label(spark):
    df, _, _ = _rows(spark)
    empty = ET.fit(df.limit(0), 4, n_trees=2)
    assert len(empty.nodes["tree"]) == 2 and list(empty.value()) == [0.5, 0.5]
    ones = ET.fit(df.where("label = 1"), 4, n_trees=2)
    assert list(ones.value()) == [1.0, 1.0]
    same = ET.fit(df.withColumn("x", F.array(*[F.lit(1.0)] * 4)), 4, n_trees=1)
    assert len(same.nodes["tree"]) == 1
    assert df.limit(0).select(ones.probability(F.col("x")).alias("p")).count() == 0


def test_trees_about_as_good_as_the_forest(spark):
    train, test, feats = CAT._train_test(spark, SF_ORACLE)
    cfg = ML.TrainConfig(n_extra_trees=60, n_random_forest=60, max_depth=10)
    auc = {}
    for name in ("extra_trees", "random_forest"):
        m = ML.fit_model(name, ML.with_weights(train), feats, cfg)
        auc[name] = ML._metrics(m.score(test)).first()["roc_auc"]
    assert auc["extra_trees"] >= auc["random_forest"] - 0.01, auc


def test_kernel_probability_is_a_rising_sigmoid(spark, tmpdir_path):
    df, _, _ = _rows(spark)
    feats = ["f0", "f1", "f2"]
    wide = df.select(F.concat(F.lit("u"), "id").alias("url"), *[F.col("x")[i].alias(f) for i, f in enumerate(feats)], "label")
    cfg = ML.TrainConfig(rff_dim=64, svc_max_iter=30)
    m = ML.fit_model("svc_rbf", ML.with_weights(wide), feats, cfg)
    assert abs(m.rff["gamma"] - 1 / 3) < 1e-9  # three features of unit population variance
    z3 = np.vstack([r[0].toArray() for r in m.rff["prep"].transform(wide).select("features").collect()])
    assert np.allclose(z3.mean(axis=0), 0, atol=1e-9) and np.allclose(z3.std(axis=0), 1, atol=1e-9)
    assert m.rff["sigmoid"][0] > 0
    z = ML.rff_transform(m.rff["prep"].transform(wide), 3, 64, m.rff["gamma"])
    margin = {r["url"]: r["m"] for r in m.rff["svc"].transform(z).select("url", ML._margin().alias("m")).collect()}
    p = {r["url"]: r["p"] for r in m.score(wide).select("url", "p").collect()}
    order = sorted(p, key=margin.get)
    assert all(0 <= v <= 1 for v in p.values())
    assert all(p[a] <= p[b] for a, b in zip(order, order[1:]))
    assert ML._metrics(m.score(wide)).first()["roc_auc"] > 0.85
    labels = {r["url"]: r["label"] for r in wide.collect()}
    assert abs(np.mean(list(p.values())) - np.mean(list(labels.values()))) < 0.05
    # Saved and loaded: the same probabilities, for both models with state of their own.
    for name, model in (("svc_rbf", m), ("extra_trees", ML.fit_model("extra_trees", ML.with_weights(wide), feats, ML.TrainConfig(n_extra_trees=5, max_depth=5)))):
        ens = ML.CalibratedEnsemble([(model, ML.isotonic_map(model.score(wide, out="iso_in")))], feats)
        TR.save_ensemble(ens, f"{tmpdir_path}/{name}")
        back = TR.load_ensemble(spark, f"{tmpdir_path}/{name}")
        a = {r["url"]: r["scam_probability"] for r in ens.transform(wide).collect()}
        b = {r["url"]: r["scam_probability"] for r in back.transform(wide).collect()}
        assert a == b


def test_sigmoid_never_falls(spark):
    df = spark.createDataFrame([(float(i), int(i < 5)) for i in range(10)], "margin double, label int")
    assert ML.fit_sigmoid(df)[0] == 0.0


def test_board_follows_from_the_out_of_fold_table(spark, tmpdir_path):
    """DuckDB recomputes each mean and deviation from the written rows."""
    df, _, _ = _rows(spark)
    feats = ["f0", "f1", "f2"]
    wide = df.select(F.concat(F.lit("u"), "id").alias("url"), *[F.col("x")[i].alias(f) for i, f in enumerate(feats)], "label")
    cfg = ML.TrainConfig(n_extra_trees=8, max_depth=4, lr_max_iter=30, models=("extra_trees", "logistic_regression"))
    path = os.path.join(tmpdir_path, "oof")
    board, _ = ML.cross_validate(wide, feats, cfg, k=4, path=path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW oof AS SELECT * FROM read_parquet('{path}/*/*/*.parquet', hive_partitioning = true)")
    assert con.execute("SELECT model, count(*), count(DISTINCT url) FROM oof GROUP BY 1 ORDER BY 1").fetchall() == [
        ("extra_trees", 400, 400), ("logistic_regression", 400, 400)]
    folds = {r["url"]: r["fold"] for r in DS.stratified_folds(wide, 4, ML.SEED, "url", "label").collect()}
    assert all(folds[u] == f for u, f in con.execute("SELECT url, fold FROM oof").fetchall())
    want = con.execute("""
        WITH c AS (SELECT model, fold, count(*) AS n, sum((p >= 0.5)::INT * label) AS tp, sum((p >= 0.5)::INT * (1 - label)) AS fp,
                          sum((p < 0.5)::INT * label) AS fn, sum(((p >= 0.5)::INT = label)::INT) AS hit FROM oof GROUP BY 1, 2),
        u AS (SELECT a.model, a.fold, avg(CASE WHEN a.p > b.p THEN 1 WHEN a.p = b.p THEN 0.5 ELSE 0 END) AS auc
              FROM oof a JOIN oof b ON a.model = b.model AND a.fold = b.fold AND a.label = 1 AND b.label = 0 GROUP BY 1, 2)
        SELECT model, avg(hit / n), stddev_pop(hit / n), avg(tp / (tp + fp)), stddev_pop(tp / (tp + fp)), avg(tp / (tp + fn)), stddev_pop(tp / (tp + fn)),
               avg(2 * tp / (2 * tp + fp + fn)), stddev_pop(2 * tp / (2 * tp + fp + fn)), avg(auc), stddev_pop(auc)
        FROM c JOIN u USING (model, fold) GROUP BY 1 ORDER BY 8 DESC, 10 DESC""").fetchall()
    got = [tuple(r) for r in board.collect()]
    assert [g[0] for g in got] == [w[0] for w in want]
    for g, w in zip(got, want):
        assert np.allclose(g[1:], w[1:], atol=1e-6), (g, w)


def test_metrics_by_group_equal_those_of_each_group(spark):
    """One pass over all models and folds: the rows that one pass for each gives,
    ties in the score, a group of one label and a group of one row included."""
    rows = [(m, f, i % 2 if f else 1, (i * 7 % 5) / 4 if m == "a" else (i % 3) / 3) for m in ("a", "b") for f in range(3) for i in range(12)] + [("c", 0, 0, 0.9)]
    df = spark.createDataFrame(rows, "model string, fold int, label int, p double")
    by = {(r["model"], r["fold"]): r[2:] for r in ML._metrics(df, by=("model", "fold")).collect()}
    assert len(by) == 7
    for m, f in by:
        assert tuple(by[m, f]) == tuple(ML._metrics(df.where((F.col("model") == m) & (F.col("fold") == f))).first())
    assert ML._metrics(df.limit(0), by=("model", "fold")).count() == 0


def test_fits_side_by_side_raise_the_first_failure(spark):
    def fails():
        raise ValueError("no rows")

    assert ML._side_by_side(spark, [lambda i=i: spark.range(i).count() for i in range(5)], 3) == [0, 1, 2, 3, 4]
    assert ML._side_by_side(spark, [], 3) == []
    try:
        ML._side_by_side(spark, [lambda: 1, fails], 2)
    except ValueError as e:
        assert str(e) == "no rows"
    else:
        raise AssertionError
