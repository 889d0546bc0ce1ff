"""Losses as gradient columns and metrics as aggregate columns. Margins and multi-class values are arrays of K doubles."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-8


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def _table(index: Column, values: list[float]) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


#: Fixed values of the table functions: steps of both tables, and the bound beyond which the sigmoid is 0 or 1.
STEPS, BOUND = 512, 8


def table_sigmoid(x: Column) -> Column:
    """The sigmoid at the left end of one of STEPS steps between -BOUND and BOUND, in single precision; 0 below, 1 above."""
    ends = np.arange(STEPS + 1) * (2.0 * BOUND / STEPS) - BOUND
    values = (np.float32(1) / (np.float32(1) + np.exp(-ends).astype(np.float32))).astype(float).tolist()
    x = x.cast("float")
    step = F.floor((x + BOUND) * STEPS / BOUND / 2)
    return F.when(x < -BOUND, 0.0).when(x > BOUND, 1.0).otherwise(_table(step, values))


def table_log(x: Column) -> Column:
    """The logarithm of a step's left end (and a little more) for x from 0 to 1, in single precision; 0 above."""
    values = np.log((np.arange(STEPS + 1) + 1e-5) / STEPS).astype(np.float32).astype(float).tolist()
    x = x.cast("float")
    return F.when(x > 1, 0.0).otherwise(_table(F.floor(x * STEPS), values))


def softmax(m: Column) -> Column:
    """Probabilities of a margin array, shifted by its maximum."""
    e = F.transform(m, lambda v: F.exp(v - F.array_max(m)))
    total = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    return F.transform(e, lambda v: v / total)


def one_hot(y: Column, k: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.when(y == i, 1.0).otherwise(0.0))


def logistic(margin: Column, y: Column, fast: bool = False) -> tuple[Column, Column]:
    p = table_sigmoid(margin) if fast else sigmoid(margin)
    return p - y, F.greatest(p * (1 - p), F.lit(EPS))


def squared(margin: Column, y: Column) -> tuple[Column, Column]:
    return margin - y, F.lit(1.0)


def multinomial(margin: Column, y: Column, k: int) -> tuple[Column, Column]:
    p = softmax(margin)
    return F.zip_with(p, one_hot(y, k), lambda a, b: a - b), F.transform(p, lambda a: F.greatest(a * (1 - a), F.lit(EPS)))


def squared_multi(margin: Column, y: Column, k: int) -> tuple[Column, Column]:
    return F.zip_with(margin, one_hot(y, k), lambda a, b: a - b), F.transform(margin, lambda _: F.lit(1.0))


def full_hessian(margin: Column, k: int) -> Column:
    """Lower triangle, row by row, of the softmax Hessian; off the diagonal min(-p_i p_j, -EPS)."""
    p = softmax(margin)
    at = lambda i: F.get(p, F.lit(i))
    return F.array(*[F.greatest(at(i) * (1 - at(i)), F.lit(EPS)) if i == j else F.least(-at(i) * at(j), F.lit(-EPS)) for i in range(k) for j in range(i + 1)])


#: Loss names and each one's default metric.
LOSSES = {"rmse": "rmse", "binary:logistic": "log-loss", "multi:logistic": "cross-entropy"}
METRICS = ("rmse", "error", "precision", "log-loss", "cross-entropy", "auc")


def loss_name(name: str, num_class: int = 2) -> str:
    n = name.lower()
    if n not in LOSSES:
        raise ValueError(f"unknown loss {name}")
    if (n == "binary:logistic" and num_class != 2) or (n == "multi:logistic" and num_class == 2):
        raise ValueError(f"{name} doesn't fit {num_class} classes")
    return n


def gradients(loss: str, margin: Column, y: Column, num_class: int, fast: bool = False) -> tuple[Column, Column]:
    n = loss_name(loss, num_class)
    if num_class == 2:
        return logistic(margin, y, fast) if n == "binary:logistic" else squared(margin, y)
    return multinomial(margin, y, num_class) if n == "multi:logistic" else squared_multi(margin, y, num_class)


def argmax(m: Column) -> Column:
    """Place of the first maximum, from 0."""
    return (F.array_position(m, F.array_max(m)) - 1).cast("int")


def _binary_metrics(p: Column, y: Column) -> dict[str, Column]:
    prob = F.least(F.greatest(sigmoid(p), F.lit(EPS)), F.lit(1 - EPS))
    return {
        "rmse": F.sqrt(F.avg((p - y) * (p - y))),
        "error": F.avg(F.when(p >= 0, 1 - y).otherwise(y)),
        "precision": F.avg(F.when(p < 0, 1 - y).otherwise(y)),
        "log-loss": F.avg(-(y * F.ln(prob) + (1 - y) * F.ln(1 - prob))),
    }


def _multi_metrics(m: Column, y: Column, k: int) -> dict[str, Column]:
    sq = F.aggregate(F.zip_with(m, one_hot(y, k), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, v: a + v)
    own = F.get(softmax(m), y.cast("int"))
    return {
        "rmse": F.sqrt(F.avg(sq)),
        "error": F.avg((argmax(m) != y).cast("double")),
        "precision": F.avg((argmax(m) == y).cast("double")),
        "cross-entropy": F.avg(-F.ln(F.greatest(own, F.lit(EPS)))),
    }


def metric(name: str, margin: Column, y: Column, num_class: int = 2) -> Column:
    """An aggregate column (AUC needs ranks: see auc)."""
    found: dict[str, Callable] = _binary_metrics(margin, y) if num_class == 2 else _multi_metrics(margin, y, num_class)
    if name.lower() not in found:
        raise ValueError(f"metric {name} doesn't exist for {num_class} classes")
    return found[name.lower()]


def auc(df: DataFrame, margin: str, y: str) -> DataFrame:
    """One row, column auc: Mann-Whitney with mid-ranks. Rows are first counted by margin; ranks run over distinct margins.

    Margins are cut into ranges whose totals carry the running sums, so no task sees all margins.
    """
    d = df.groupBy(F.col(margin).alias("m")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col(y) > 0, 1).otherwise(0)).alias("p"))
    d = d.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "m").withColumn("part", F.spark_partition_id())
    inside = Window.partitionBy("part").orderBy("m").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("lower", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    r = d.groupBy("part").agg(F.sum("n").alias("n"), F.sum("p").alias("p"), F.sum(F.col("p") * (F.col("lower") + (F.col("n") + 1) / 2.0)).alias("s"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    r = r.agg(F.sum(F.col("s") + F.col("p") * F.col("base")).alias("s"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    negatives = F.col("n") - F.col("p")
    return r.select(((F.col("s") - F.col("p") * (F.col("p") + 1) / 2.0) / F.nullif((F.col("p") * negatives).cast("double"), F.lit(0.0))).alias("auc"))
