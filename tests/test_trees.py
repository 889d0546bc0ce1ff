"""The tree engine: queries against DuckDB, training against a plain numpy trainer, odd inputs."""

import os

import duckdb
import numpy as np
import pytest

from arborwell.operators import bins
from arborwell.params import GBDTParams
from arborwell.plans import predict, queries, train
from arborwell.sources import sparse

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("lineitem", "orders", "documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are absent")
@pytest.mark.parametrize("name", ["libsvm_parse", "quantile_cuts", "feature_info", "hist_default_fill", "hist_subtract", "split_scan", "split_categorical_best", "leaf_weights_l1_clamped", "predict_fixed_forest", "metric_auc", "metric_cross_entropy_multi", "pred_after_tree1", "best_root_split", "train_depth2", "train_leafwise", "best_split_multi", "leaf_weights_multi", "predict_class", "quantiles_at", "table_functions", "kll_cuts", "feature_group_layout"])
def test_query_matches_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    want = duck.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == cols
    show = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    got = sorted(tuple(show(r[c]) for c in cols) for r in df.collect())
    assert got == sorted(tuple(show(r[names.index(c)]) for c in cols) for r in want.fetchall())


def mirror(x, y, p, q):
    """Plain trainer for numerical features, squared loss or logistic."""
    cuts = [np.unique(np.sort(c[c != 0])[(len(c[c != 0]) * np.arange(q)) // q]) for c in x.T]
    b = np.stack([np.where(c == 0, max(np.searchsorted(k, 0.0, "right") - 1, 0), np.maximum(np.searchsorted(k, c, "right") - 1, 0)) for c, k in zip(x.T, cuts, strict=True)], axis=1)
    m = np.zeros(len(y))
    for _ in range(p.num_tree):
        s = 1 / (1 + np.exp(-m))
        g, h = (s - y, np.maximum(s * (1 - s), 1e-8)) if p.loss == "binary:logistic" else (m - y, np.ones(len(y)))
        gain = lambda a, c: a * a / (c + p.lam) if a else 0.0

        def grow(rows, depth):
            best = (0.0, None)
            if depth < p.max_depth and len(rows) > p.min_node_instance:
                for f in range(x.shape[1]):
                    for t in range(len(cuts[f]) - 1):
                        left = b[rows, f] <= t
                        gl, hl, gt, ht = g[rows][left].sum(), h[rows][left].sum(), g[rows].sum(), h[rows].sum()
                        v = gain(gl, hl) + gain(gt - gl, ht - hl) - gain(gt, ht) - p.lam
                        if v > best[0] + 1e-9:
                            best = (v, (f, t))
            if best[1] is None:
                m[rows] -= p.learning_rate * g[rows].sum() / (h[rows].sum() + p.lam)
                return
            f, t = best[1]
            left = b[rows, f] <= t
            grow(rows[left], depth + 1), grow(rows[~left], depth + 1)

        grow(np.arange(len(y)), 0)
    return m


@pytest.mark.parametrize("subtraction", [True, False])
def test_training_matches_mirror(spark, tmp_path, subtraction):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 3)).round(2)
    x[rng.random((600, 3)) < 0.1] = 0
    y = ((x[:, 0] * x[:, 1] > 0) | (x[:, 2] > 1)).astype(float)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y, strict=True)], "x0 double, x1 double, x2 double, y double")
    p = GBDTParams(num_tree=3, max_depth=3, num_split=10, min_node_instance=20, learning_rate=0.5, enum_threshold=1, hist_subtraction=subtraction, metrics=("log-loss", "auc"))
    model = train.train(df.repartition(3), "y", ["x0", "x1", "x2"], p, valid=df.limit(100))
    want = mirror(x, y, p, 10)
    got = predict.score(df, model).toPandas()
    assert np.allclose(np.sort(got["margin"]), np.sort(want), atol=1e-9)
    loss = [h["log-loss"] for h in model.history]
    assert loss == sorted(loss, reverse=True) and "valid_auc" in model.history[0]
    if subtraction:
        predict.save(model, spark, str(tmp_path / "m"))
        again = predict.load(spark, str(tmp_path / "m"))
        both = predict.score_case(predict.score(df, again).withColumnRenamed("margin", "a"), model)
        assert both.where("abs(a - margin) > 1e-12").count() == 0
        row = got.iloc[5]
        assert np.isclose(predict.predict_one(again, {k: row[f"x{k}"] for k in range(3)})[0], row["margin"])


def test_categories_absent_and_unseen(spark):
    rows = [(c, float(c in (2.0, 9.0))) for c in (1.0, 2.0, 5.0, 9.0) for _ in range(30)] + [(None, 0.0)] * 20
    df = spark.createDataFrame(rows, "c double, y double")
    m = train.train(df, "y", ["c"], GBDTParams(num_tree=1, max_depth=2, min_node_instance=5))
    test = spark.createDataFrame([(2.0,), (5.0,), (None,), (77.0,), (9.0,)], "c double")
    assert [r.predicted for r in predict.predict(test, m).collect()] == [1, 0, 0, 0, 1]


def test_multi_class_and_leaf_growth(spark):
    rng = np.random.default_rng(1)
    rows = [(float(a), float(b), int(a > 0.5) + int(b > 0.5)) for a, b in rng.random((400, 2)) + 0.01]
    df = spark.createDataFrame(rows, "a double, b double, y int")
    p = GBDTParams(loss="multi:logistic", num_class=3, num_tree=3, max_depth=3, min_node_instance=10, num_split=20, growth="leaf", max_node_num=9, metrics=("error",))
    m = train.train(df, "y", ["a", "b"], p)
    assert all(len(t) <= 9 for t in m.trees) and m.history[-1]["error"] < 0.2


def test_bad_inputs(spark):
    y = lambda vs: spark.createDataFrame([(float(v), 1.0) for v in vs], "y double, x double")
    with pytest.raises(ValueError):
        sparse.remap_labels(y([0, 1, 2]), "y", 2)
    with pytest.raises(ValueError):
        sparse.remap_labels(y([0.5, 1]), "y", 3)
    assert {r.y for r in sparse.remap_labels(y([1, 2, 3]), "y", 3).collect()} == {0.0, 1.0, 2.0}
    nan = spark.createDataFrame([(0.0, float("nan")), (1.0, 1.0)], "y double, x double")
    with pytest.raises(ValueError):
        train.train(nan, "y", ["x"], GBDTParams(num_tree=1))
    small = train.train(y([0, 1] * 10), "y", ["x"], GBDTParams(num_tree=1))
    assert list(small.trees[0]) == [0]
    with pytest.raises(ValueError):
        GBDTParams.from_conf({"spark.gbdt.max.depth": "0"})
    assert GBDTParams.from_conf({"spark.ml.eval.metric": "auc, error"}).metrics == ("auc", "error")


def test_text_source(spark, tmp_path):
    path = str(tmp_path / "t.txt")
    with open(path, "w") as f:
        f.write("# note\n\n1 3:2.5,7:1\n 0 1:0 \n")
    rows = sorted((r.label, r.fids, r["values"]) for r in sparse.read_libsvm(spark, f"file://{path}").collect())
    assert rows == [(0.0, [1], [0.0]), (1.0, [3, 7], [2.5, 1.0])]
    cells = sparse.explode_cells(sparse.read_libsvm(spark, f"file://{path}"))
    assert {r.fid: r.nnz for r in bins.nnz(cells).collect()} == {1: 1, 3: 1, 7: 1}
    assert np.allclose(train.full_hessian_weight([1.0, 0.0], [1.0, 0.0, 1.0], GBDTParams()), [-0.5, 0.0])


def test_sketch_cuts_are_close_to_exact_ranks(spark):
    rng = np.random.default_rng(3)
    x = rng.lognormal(size=20_000)
    cells = spark.createDataFrame([(0, float(v)) for v in x] + [(1, float(k % 3 + 1)) for k in range(50)], "fid int, value double").repartition(5)
    cuts = {}
    for r in bins.kll_cuts(cells, 20).collect():
        cuts.setdefault(r.fid, []).append((r.idx, r.cut))
    got = [c for _, c in sorted(cuts[0])]
    ranks = np.searchsorted(np.sort(x), got) / len(x)
    assert len(got) == 20 and got[0] == x.min() and np.abs(ranks - np.arange(20) / 20).max() < 0.01
    assert [c for _, c in sorted(cuts[1])] == [1.0, 2.0, 3.0]
    p = GBDTParams(num_tree=1, max_depth=2, num_split=10, min_node_instance=10, cuts="kll", float32=True, fast_math=True)
    df = spark.createDataFrame([(float(v), float(v > 1)) for v in x[:2000]], "a double, y double")
    assert train.train(df, "y", ["a"], p).trees[0][0].fid == 0


def test_multi_output_split_matches_plain_search(spark):
    from arborwell.operators import histogram, split

    rng = np.random.default_rng(5)
    n, k = 400, 4
    b, y = rng.integers(0, 6, (n, 3)), rng.integers(0, k, n)
    y[b[:, 1] > 3] = 2
    p = GBDTParams(loss="multi:logistic", num_class=k, min_node_instance=1, reg_alpha=0.5)
    g, h = 1 / k - (y[:, None] == np.arange(k)), np.full((n, k), (1 / k) * (1 - 1 / k))
    rows = spark.createDataFrame([(i % 2, g[i].tolist(), h[i].tolist(), *map(int, b[i])) for i in range(n)], "node long, g array<double>, h array<double>, b0 int, b1 int, b2 int")
    info = spark.createDataFrame([(0, False, [float(v) for v in range(6)], 6, 0), (1, False, [float(v) for v in range(6)], 6, 0), (2, True, [float(v) for v in range(1, 6)], 6, 5)], "fid int, is_categorical boolean, splits array<double>, num_bin int, default_bin int")
    found = {r.node: r for r in split.best_splits(histogram.build_arrow(rows, [0, 1, 2], k), info, p).collect()}

    def gain(rows):
        s, t = g[rows].sum(axis=0), h[rows].sum(axis=0)
        s = np.sign(s) * np.maximum(np.abs(s) - 0.5, 0)
        return (s * s / (t + p.lam)).sum() / k

    for node in (0, 1):
        own = np.arange(n) % 2 == node
        best = max((gain(own & (b[:, f] <= t)) + gain(own & (b[:, f] > t)) - gain(own) - p.lam, -f, -t) for f in (0, 1) for t in range(5))
        r = found[node]
        assert r.split_type == 0 and (r.fid, r.bin) == (-best[1], -best[2]) and r.gain == pytest.approx(best[0])
        left = own & (b[:, r.fid] <= r.bin)
        assert r.nl == left.sum() and r.l_g1 == pytest.approx(g[left, 1].sum()) and r.fvalue == r.bin + 1


def test_training_for_ten_classes_on_64_features_is_quick(spark):
    import time

    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(300, 64)), rng.integers(0, 10, 300)
    df = spark.createDataFrame([(*map(float, r), int(c)) for r, c in zip(x, y, strict=True)], ", ".join(f"f{k} double" for k in range(64)) + ", y int")
    p = GBDTParams(loss="multi:logistic", num_class=10, num_tree=1, max_depth=2, num_split=8, min_node_instance=16)
    start = time.time()
    m = train.train(df, "y", [f"f{k}" for k in range(64)], p)
    assert len(m.trees[0]) >= 3 and time.time() - start < 60


def test_jobs_and_stream_from_a_configuration(spark, tmp_path):
    from arborwell import streaming
    from arborwell.plans import jobs

    rng = np.random.default_rng(2)
    lines = [f"{int(a > 0.5)} 0:{a:.3f} 2:{b:.3f}" for a, b in rng.random((300, 2)) + 0.01]
    (tmp_path / "train.txt").write_text("\n".join(lines))
    conf = {"spark.ml.train.path": f"file://{tmp_path}/train.txt", "spark.ml.predict.path": f"file://{tmp_path}/train.txt", "spark.ml.model.path": f"file://{tmp_path}/model", "spark.ml.feature.num": "3", "spark.ml.loss.func": "binary:logistic", "spark.gbdt.tree.num": "2", "spark.gbdt.max.depth": "2", "spark.gbdt.min.node.instance": "10", "spark.ml.worker.num": "2"}
    model = jobs.train_job(spark, conf)
    assert "valid_log-loss" in model.history[0]
    scored = jobs.predict_job(spark, conf, f"file://{tmp_path}/out")
    assert scored.where("label = predicted").count() > 280 and spark.read.text(f"file://{tmp_path}/out").count() == 300
    with pytest.raises(ValueError):
        jobs.train_job(spark, conf | {"spark.ml.feature.num": "0"})
    rows = scored.select("label", "f0", "f1", "f2")
    rows.limit(100).write.parquet(f"{tmp_path}/in")
    for more in (100, 150):  # the second run takes what is new only
        streaming.score_stream(spark, model, "label double, f0 double, f1 double, f2 double", f"{tmp_path}/in", f"{tmp_path}/scored", f"{tmp_path}/ck").awaitTermination()
        assert spark.read.parquet(f"{tmp_path}/scored").count() == more
        rows.limit(50).write.mode("append").parquet(f"{tmp_path}/in")
    both = spark.read.parquet(f"{tmp_path}/scored").join(predict.score(spark.read.parquet(f"{tmp_path}/in"), model).withColumnRenamed("margin", "m"), ["f0", "f2"])
    assert both.where("abs(m - margin) > 1e-12").count() == 0
