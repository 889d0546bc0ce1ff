"""Training and scoring as a configuration says: sparse text in, a saved model or predictions out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import GBDTParams
from ..sources import sparse
from . import predict as predicting
from . import train as training


def _wide(spark: SparkSession, path: str, p: GBDTParams) -> tuple[DataFrame, list[str]]:
    """label, f0.. of a sparse text file."""
    if p.num_feature < 1:
        raise ValueError("the number of features is required")
    rows = sparse.read_libsvm(spark, path)
    rows = rows.repartition(p.num_worker) if p.num_worker else rows
    at = lambda k: F.element_at(F.map_from_arrays("fids", "values"), k)
    features = [f"f{k}" for k in range(p.num_feature)]
    return rows.select("label", *[at(k).alias(f) for k, f in enumerate(features)]), features


def train_job(spark: SparkSession, conf: dict[str, str]) -> training.Model:
    """Train on spark.ml.train.path and save to spark.ml.model.path. Without a validation path, rows are split off by spark.ml.valid.ratio."""
    p = GBDTParams.from_conf(conf)
    rows, features = _wide(spark, p.train_path, p)
    if p.valid_path:
        valid = _wide(spark, p.valid_path, p)[0]
    elif p.valid_ratio > 0:
        rows, valid = sparse.random_split(rows, F.struct(*rows.columns), p.valid_ratio, p.seed)
    else:
        valid = None
    model = training.train(rows, "label", features, p, valid)
    if p.model_path:
        predicting.save(model, spark, p.model_path)
    return model


def predict_job(spark: SparkSession, conf: dict[str, str], out: str | None = None) -> DataFrame:
    """Score spark.ml.predict.path with the model of spark.ml.model.path; label and margin go to out as text, if given."""
    p = GBDTParams.from_conf(conf)
    model = predicting.load(spark, p.model_path)
    scored = predicting.predict(_wide(spark, p.predict_path, GBDTParams(num_feature=len(model.features)))[0], model)
    if out:
        predicting.write_predictions(scored, "label", out)
    return scored
