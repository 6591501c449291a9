"""Scoring of instances that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.build import place
from ..sources.model import Model


def score_stream(spark: SparkSession, folder: str, schema, model: Model) -> DataFrame:
    """Rows of new Parquet files in a folder, placed by a model as they come."""
    return place(spark.readStream.schema(schema).parquet(folder), model)


def write_scores(scored: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append scored rows as Parquet, each input row once, until all files present are done."""
    return scored.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
