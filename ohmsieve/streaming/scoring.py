"""Structured Streaming sink and sources for rule scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import features, rules
from ..sources import schema as S


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of normalised Parquet rows."""
    return spark.readStream.schema(S.table_struct(labelled=False)).parquet(path)


def flagged(rows: DataFrame, active: list[str] | None = None) -> DataFrame:
    """(Id, device_family, hard_override_anomaly) of each row, batch or stream."""
    out = features.family_columns(rows, *rules.NEEDS)
    return out.select("Id", "device_family", rules.override(active).alias("hard_override_anomaly"))


def write_flags(rows: DataFrame, path: str, checkpoint: str, active: list[str] | None = None):
    """Starts the query that writes flags as Parquet, exactly once by the sink's own log."""
    return flagged(rows, active).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
