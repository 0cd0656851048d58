"""The index: versioned Parquet with merge, prune, incremental skip, facets, paging and a manifest.

A version is a folder; a pointer file names the current one and is replaced in one step, so readers see a whole version
or the one before it. Merges are anti-joins on doc_id and a union: one shuffle of keys, none of texts that stay.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import vectors as V

#: Text columns that are not stored.
NOT_STORED = ["text", "source_text", "retrieval_text", "embedding_text", "full_unit_text"]
KEPT_EVENTS = 2000


def stored(chunks: DataFrame) -> DataFrame:
    """Chunks without the texts that can be had otherwise."""
    return chunks.drop(*NOT_STORED)


def replace_documents(current: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """All points of the documents in ``new`` exchanged for the new ones."""
    return current.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def delete(current: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Points without those named."""
    return current.join(gone.select(key).distinct(), key, "left_anti")


def stale(current: DataFrame, active: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents of the index that are no longer active."""
    return current.select(key).distinct().join(active.select(key).distinct(), key, "left_anti")


def to_process(candidates: DataFrame, cache: DataFrame, counts: DataFrame, version: int, key: str = "doc_id") -> DataFrame:
    """Adds skip: nothing changed since a document was indexed, and all its chunks are there.

    candidates: key, sha256, fingerprint. cache: key, sha256, fingerprint, chunks, version. counts: key, indexed.
    """
    c = cache.select(key, F.col("sha256").alias("_sha"), F.col("fingerprint").alias("_fp"), F.col("chunks").alias("_n"), F.col("version").alias("_v"))
    joined = candidates.join(c, key, "left").join(counts.select(key, "indexed"), key, "left")
    same = (F.col("sha256") == F.col("_sha")) & (F.col("fingerprint") == F.col("_fp")) & (F.col("_v") == version) & (F.col("_n") == F.col("indexed")) & (F.col("indexed") > 0)
    return joined.withColumn("skip", F.coalesce(same, F.lit(False))).drop("_sha", "_fp", "_n", "_v", "indexed")


def changed(current: DataFrame, new: DataFrame, key: str, ignore: list[str]) -> DataFrame:
    """New rows that differ from the current ones in more than the ignored columns."""
    cols = sorted(set(new.columns) - set(ignore) - {key})
    digest = F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)
    have = current.select(key, digest.alias("_d"))
    return new.withColumn("_d", digest).join(have, [key, "_d"], "left_anti").drop("_d")


def facet(points: DataFrame, field: str) -> DataFrame:
    """Exact counts of a field's values; of an array's entries where it is one."""
    many = points.schema[field].dataType.typeName() == "array"
    values = points.select(F.explode(F.array_distinct(field)).alias("value") if many else F.col(field).alias("value"))
    return values.where(F.col("value").isNotNull()).groupBy("value").agg(F.count("*").alias("n"))


def page(points: DataFrame, key: str, after: object | None, size: int) -> DataFrame:
    """The next ``size`` points after a key, a page that is asked for: keyset paging, no offset is scanned."""
    rows = points if after is None else points.where(F.col(key) > F.lit(after))
    return rows.orderBy(key).limit(size)


def vector_faults(points: DataFrame, vector: str, size: int, key: str) -> DataFrame:
    """Points whose vector can't be used, with the reason."""
    return points.select(key, V.fault(F.col(vector), size).alias("reason")).where(F.col("reason").isNotNull())


def pooled(vectors: DataFrame, group: list[str], vector: str, weight: Column) -> DataFrame:
    """Weighted mean of each group's vectors, scaled to length one. Places are summed apart, so no group is gathered."""
    parts = vectors.where(F.col(vector).isNotNull()).select(*group, weight.cast("double").alias("_w"), F.posexplode(vector).alias("_i", "_x"))
    sums = parts.groupBy(*group, "_i").agg((F.sum(F.col("_x").cast("double") * F.col("_w")) / F.sum("_w")).alias("_m"))
    return sums.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("_i", "_m"))).alias("_v")).select(*group, V.unit(F.col("_v._m")).alias("vector"))


def _file_system(spark: SparkSession, path: str):
    """The file system of a path, whatever its scheme, and the path in it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def read_file(spark: SparkSession, path: str) -> str | None:
    """A small text file on any file system; null where there is none."""
    fs, at = _file_system(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def replace_file(spark: SparkSession, path: str, text: str) -> None:
    """A small text file written beside its place and then renamed to it."""
    fs, at = _file_system(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex[:8]}.tmp")
    stream = fs.create(beside, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration())
    overwrite = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(beside, at, overwrite)


class Index:
    """An index in a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _pointer(self) -> str:
        return f"{self.root}/current.json"

    def manifest(self) -> dict:
        """The current manifest; empty where nothing was written."""
        try:
            return json.loads(read_file(self.spark, self._pointer()) or "{}")
        except ValueError:
            return {}

    def read(self) -> DataFrame | None:
        """The current version."""
        at = self.manifest().get("version")
        return self.spark.read.parquet(f"{self.root}/{at}") if at else None

    def write(self, points: DataFrame, config: dict, partition: str | None = "source_role", sort: list[str] = (), events: list[dict] = ()) -> str:
        """Write a version, then point to it. Sorted within files so that their statistics prune."""
        version = f"v-{uuid.uuid4().hex[:12]}"
        rows = points.sortWithinPartitions(*sort) if sort else points
        writer = rows.write.mode("errorifexists")
        (writer.partitionBy(partition) if partition and partition in points.columns else writer).parquet(f"{self.root}/{version}")
        old = self.manifest()
        new = {"version": version, "config": config, "events": ([*old.get("events", []), *events])[-KEPT_EVENTS:]}
        replace_file(self.spark, self._pointer(), json.dumps(new, ensure_ascii=False, sort_keys=True))
        return version

    def check(self, config: dict) -> list[str]:
        """Keys in which the index was built otherwise; empty where it can be used."""
        held = self.manifest().get("config", {})
        return sorted(k for k in set(held) | set(config) if held.get(k) != config.get(k))

    def merge(self, new: DataFrame, config: dict, **how) -> str:
        """Replace the documents of ``new`` in a new version."""
        if faults := self.check(config) if self.manifest() else []:
            raise ValueError("the index was built with other settings: " + ", ".join(faults))
        current = self.read()
        return self.write(new if current is None else replace_documents(current, new), config, **how)
