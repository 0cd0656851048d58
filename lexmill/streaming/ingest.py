"""Incremental ingest as Structured Streaming: new files are merged into the index batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lexmill.operators.index import Index
from lexmill.operators.records import split_good_bad
from lexmill.sources.readers import write_dead_letters


def stream_into_index(spark: SparkSession, folder: str, schema: T.StructType, index: Index, config: dict, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df, key: str = "doc_id") -> StreamingQuery:
    """Merge every new Parquet file of a folder into the index; ends when what is there is done.

    A batch may be run again after a failure: a merge replaces whole documents, so it comes out the same.
    """

    def merge(batch: DataFrame, _: int) -> None:
        latest = prepare(batch)
        if not latest.isEmpty():
            index.merge(latest, config, partition=None, sort=[key])

    return spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_records(spark: SparkSession, folder: str, schema: T.StructType, good_path: str, dead_path: str, checkpoint: str) -> StreamingQuery:
    """Split new records into good ones and dead letters."""

    def write(batch: DataFrame, _: int) -> None:
        good, bad = split_good_bad(batch)
        good.write.mode("append").parquet(good_path)
        write_dead_letters(bad, dead_path)

    return spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, at: str, late: str, window: str, slide: str | None, by: list[str]) -> DataFrame:
    """Counts per window of event time and group; works on streams, where rows later than ``late`` are left out."""
    frame = F.window(at, window, slide) if slide else F.window(at, window)
    return events.withWatermark(at, late).groupBy(frame.alias("frame"), *by).agg(F.count("*").alias("n"))
