"""Scoring streams: a projection without state, so rows are scored as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans import predict as predicting
from ..plans.train import Model


def score_stream(spark: SparkSession, model: Model, schema: str, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Parquet files that arrive in source, scored into target once each; start the returned query's next run with the same checkpoint."""
    rows: DataFrame = spark.readStream.schema(schema).parquet(source)
    scored = predicting.predict(rows, model)
    return scored.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
