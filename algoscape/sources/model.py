"""Stored models: a folder with JSON parameters and Parquet tables, readable by any executor."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..operators import footprint
from ..spec import Options
from .metadata import MissingInput


@dataclass
class Model:
    options: Options
    algos: list[str]
    features: list[str]
    selected: list[str]
    preparation: list[dict]
    projection: list[list[float]]
    reconstruction: list[list[float]]
    prediction: dict[str, Any] | None = None
    precision: list[float | None] = field(default_factory=list)
    default: int = 1
    footprints: DataFrame | None = None

    def save(self, spark: SparkSession, path: str) -> None:
        """JSON goes through Spark too, so the path may be any that Spark can write."""
        plain = {k: getattr(self, k) for k in ("algos", "features", "selected", "preparation", "projection", "reconstruction", "prediction", "precision", "default")}
        rows = (self.prediction or {}).get("rows")
        if rows is not None:
            plain["prediction"] = {k: v for k, v in self.prediction.items() if k != "rows"}
            rows.write.mode("overwrite").parquet(f"{path}/voters")
        text = json.dumps({"options": self.options.to_json()} | plain)
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/model.json")
        if self.footprints is not None:
            self.footprints.coalesce(1).write.mode("overwrite").parquet(f"{path}/footprints")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Model:
        from pyspark.errors import AnalysisException

        try:
            raw = json.loads(spark.read.text(f"{path}/model.json", wholetext=True).first()["value"])
        except AnalysisException as e:
            raise MissingInput(f"{path}/model.json") from e
        options = Options.from_json(raw.pop("options"))
        try:
            prints = spark.read.schema(footprint.SCHEMA).parquet(f"{path}/footprints")
        except AnalysisException:
            prints = None
        if raw["prediction"] and raw["prediction"]["knn"]:
            try:
                raw["prediction"]["rows"] = spark.read.parquet(f"{path}/voters")
            except AnalysisException as e:
                raise MissingInput(f"{path}/voters") from e
        return Model(options=options, footprints=prints, **raw)
