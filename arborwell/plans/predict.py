"""Scoring wide rows with a model; saving and loading models."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import objective
from ..params import GBDTParams
from .train import Model, Node

FOREST = "tree_id int, node_id long, is_leaf boolean, n long, fid int, split_type int, gain double, fvalue double, bin int, left_bins array<int>, right_values array<double>, weight array<double>, sum_g array<double>, sum_h array<double>"


def forest_rows(model: Model) -> list[tuple]:
    return [(t, a, n.fid < 0, n.n, n.fid, n.split_type, n.gain, n.fvalue, n.bin, n.left_bins, n.right_values, n.weight, n.g, n.h) for t, tree in enumerate(model.trees) for a, n in sorted(tree.items())]


def save(model: Model, spark: SparkSession, path: str) -> None:
    spark.createDataFrame(forest_rows(model), FOREST).coalesce(1).write.mode("overwrite").parquet(f"{path}/forest")
    meta = json.dumps({"params": asdict(model.params), "features": model.features, "history": model.history})
    spark.createDataFrame([(meta,)], "meta string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load(spark: SparkSession, path: str) -> Model:
    meta = json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])
    meta["params"]["metrics"] = tuple(meta["params"]["metrics"])
    rows = spark.read.parquet(f"{path}/forest").collect()
    trees: list[dict[int, Node]] = [{} for _ in range(1 + max((r["tree_id"] for r in rows), default=-1))]
    for r in rows:
        trees[r["tree_id"]][r["node_id"]] = Node(r["n"], r["sum_g"], r["sum_h"], r["fid"], r["split_type"], r["gain"], r["fvalue"], r["bin"], r["left_bins"], r["right_values"], r["weight"])
    return Model(GBDTParams(**meta["params"]), meta["features"], trees, meta["history"])


def tree_margin(tree: dict[int, Node], features: list[str], lr: float, out: int = 0, at: int = 0) -> Column:
    """One tree as nested CASE expressions over raw values; absent is 0.0 for points and left for sets."""
    n = tree[at]
    if n.fid < 0:
        return F.lit(lr * n.weight[out])
    x = F.coalesce(F.col(features[n.fid]).cast("double"), F.lit(0.0))
    right = x >= n.fvalue if n.split_type == 0 else x.isin(n.right_values) & (x != 0)
    return F.when(right, tree_margin(tree, features, lr, out, 2 * at + 2)).otherwise(tree_margin(tree, features, lr, out, 2 * at + 1))


def score_case(df: DataFrame, model: Model) -> DataFrame:
    """df with margin, by whole-stage code; for small forests."""
    lr, k = model.params.learning_rate, model.params.outputs
    total = [sum((tree_margin(t, model.features, lr, i) for t in model.trees), F.lit(0.0)) for i in range(k)]
    return df.withColumn("margin", total[0] if k == 1 else F.array(*total))


def score(df: DataFrame, model: Model) -> DataFrame:
    """df with margin, by numpy walks over Arrow batches: the model travels with the function, rows are not shuffled."""
    k, lr, features = model.params.outputs, model.params.learning_rate, model.features
    kind = "double" if k == 1 else "array<double>"
    cols, trees = df.columns, model.trees

    def walk(tree: dict[int, Node], x: list[np.ndarray], rows: np.ndarray, at: int, out: np.ndarray) -> None:
        n = tree[at]
        if n.fid < 0:
            out[rows] += lr * np.asarray(n.weight)
            return
        v = x[n.fid][rows]
        right = v >= n.fvalue if n.split_type == 0 else np.isin(v, n.right_values) & (v != 0)
        for side, child in ((rows[~right], 2 * at + 1), (rows[right], 2 * at + 2)):
            if len(side):
                walk(tree, x, side, child, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [np.nan_to_num(b.column(len(cols) + j).to_numpy(zero_copy_only=False).astype(np.float64)) for j in range(len(features))]
            out = np.zeros((b.num_rows, k))
            for t in trees:
                walk(t, x, np.arange(b.num_rows), 0, out)
            margin = pa.array(out[:, 0]) if k == 1 else pa.array(list(out), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[b.column(j) for j in range(len(cols))], margin], names=[*cols, "margin"])

    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in cols] + [f"margin {kind}"])
    return df.select(*cols, *[F.col(c).cast("float" if model.params.float32 else "double").cast("double").alias(f"_x{j}") for j, c in enumerate(features)]).mapInArrow(run, schema)


def classify(margin: Column, num_class: int) -> Column:
    """Class from 0: margin > 0, or the place of the largest."""
    return (margin > 0).cast("int") if num_class == 2 else objective.argmax(margin)


def predict(df: DataFrame, model: Model) -> DataFrame:
    """df with margin, probability and predicted class."""
    k = model.params.num_class
    d = score(df, model)
    prob = objective.sigmoid(F.col("margin")) if k == 2 else objective.softmax(F.col("margin"))
    return d.withColumns({"probability": prob, "predicted": classify(F.col("margin"), k)})


def predict_one(model: Model, values: dict[int, float]) -> list[float]:
    """Margins of one sparse row {fid: value}."""
    out = np.zeros(model.params.outputs)
    for tree in model.trees:
        at = 0
        while tree[at].fid >= 0:
            n, x = tree[at], values.get(tree[at].fid) or 0.0
            right = x >= n.fvalue if n.split_type == 0 else x != 0 and x in n.right_values
            at = 2 * at + 1 + int(right)
        out += model.params.learning_rate * np.asarray(tree[at].weight)
    return out.tolist()


def write_predictions(df: DataFrame, label: str, path: str) -> None:
    df.select(F.concat_ws(",", F.col(label).cast("string"), F.col("margin").cast("string")).alias("value")).write.mode("overwrite").text(path)
