"""A record of the finished steps of a job, so that the job can be started again after it died."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from lakesteward.sources.manifest import path_exists


class Journal:
    """Steps and their results below ``folder`` in the shared storage; with ``folder=None`` nothing is recorded.

    A step is finished once its record is complete. One that was killed before is done again, so
    what it writes must replace what a killed attempt left behind.
    """

    def __init__(self, spark: SparkSession, folder: str | None) -> None:
        self.spark, self.folder = spark, None if folder is None else folder.rstrip("/")

    def _place(self, step: str) -> str:
        return f"{self.folder}/steps/{re.sub('[^A-Za-z0-9_.-]', '_', step)}"

    def once(self, step: str, work: Callable[[], dict]) -> dict:
        """What ``work`` returned when the step was finished; it is called only if that has not happened yet."""
        if self.folder is None:
            return work()
        place = self._place(step)
        if path_exists(self.spark, f"{place}/_SUCCESS"):
            return json.loads(self.spark.read.text(place).first()[0])
        result = work()
        self.record(place, result)
        return result

    def record(self, place: str, result: dict) -> None:
        self.spark.createDataFrame([(json.dumps(result),)], "value STRING").coalesce(1).write.mode("overwrite").text(place)

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written once below the journal and read back, also by a later start."""

        def write() -> dict:
            path = f"{self.folder}/data/{name}"
            df.write.mode("overwrite").parquet(path)
            return {"path": path, "schema": df.schema.json()}

        kept = self.once(f"stored-{name}", write)
        return self.spark.read.schema(StructType.fromJson(json.loads(kept["schema"]))).parquet(kept["path"])
