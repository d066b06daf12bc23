"""Streams of query points against a static field.

A point query has no aggregate over points, so the plan that serves tables serves streams: every join is of a stream with a static side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.field import Field


def read_points(spark: SparkSession, path: str, schema: str = "pid long, lon double, lat double, z double, t timestamp") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def at(field: Field, stream: DataFrame, **kw) -> DataFrame:
    """stream plus the field's value, row by row; points out of the time range give null, since one of them must not end a stream."""
    return field.at(stream, strict=False, **kw)


def window_means(values: DataFrame, value: str, t: str = "t", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count and mean of values per window of event time; points later than the watermark are dropped."""
    return values.withWatermark(t, late).groupBy(F.window(t, width)).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))


def write(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
