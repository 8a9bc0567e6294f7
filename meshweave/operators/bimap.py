"""A map with unique keys and unique values, as a DataFrame (key, value)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bimap:
    pairs: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession) -> Bimap:
        return cls(spark.createDataFrame([], "key string, value string"))

    def insert(self, more: DataFrame) -> Bimap:
        """more(key, value), unique both ways; pairs that hold one of its keys or values go."""
        kept = self.pairs.join(more.select("key"), "key", "left_anti").join(more.select("value"), "value", "left_anti")
        return Bimap(kept.select("key", "value").unionByName(more.select("key", "value")))

    def by_key(self, key: str) -> str | None:
        got = self.pairs.where(F.col("key") == key).take(1)
        return got[0]["value"] if got else None

    def by_value(self, value: str) -> str | None:
        got = self.pairs.where(F.col("value") == value).take(1)
        return got[0]["key"] if got else None

    def remove_key(self, key: str) -> Bimap:
        return Bimap(self.pairs.where(F.col("key") != key))

    def remove_value(self, value: str) -> Bimap:
        return Bimap(self.pairs.where(F.col("value") != value))
