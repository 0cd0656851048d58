"""The catalogue of sources: selection, limits of a run, failures that count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as X

LEGISLATION = ["norma"]


def select_sources(catalogue: DataFrame, roles: list[str] | None = None, only: list[str] | None = None, following: bool | None = None, most_level: int | None = None) -> DataFrame:
    """Sources by role, id, whether links are followed and authority; what isn't asked for doesn't restrict."""
    ok = F.lit(True)
    if roles is not None:
        ok = ok & F.col("source_role").isin(*roles)
    if only is not None:
        ok = ok & F.col("id").isin(*only)
    if following is not None:
        ok = ok & (F.coalesce("follow_links", F.lit(False)) == following)
    if most_level is not None:
        ok = ok & (F.col("authority_level") <= most_level)
    return catalogue.where(ok)


def faults(catalogue: DataFrame) -> DataFrame:
    """id, reason: sources of a catalogue that can't be used; an id that stands twice is named once."""
    twice = catalogue.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("id", F.lit("id twice").alias("reason"))
    checks = [
        F.when(F.length(F.trim(F.coalesce("title", F.lit("")))) == 0, "title"),
        F.when(F.size(F.coalesce("urls", F.array().cast("array<string>"))) == 0, "urls"),
        F.when(~F.coalesce(F.col("authority_level").between(1, 4), F.lit(False)), "authority_level"),
        F.when(F.coalesce("follow_links", F.lit(False)) & F.col("max_follow").isNull(), "max_follow"),
    ]
    each = catalogue.select("id", F.explode(F.filter(F.array(*checks), lambda x: x.isNotNull())).alias("reason"))
    return twice.unionByName(each)


def unknown_ids(catalogue: DataFrame, only: list[str]) -> DataFrame:
    """Ids asked for that the catalogue doesn't have."""
    asked = catalogue.sparkSession.createDataFrame([(x,) for x in only], "id string")
    return asked.join(catalogue.select("id"), "id", "left_anti")


def with_limit(catalogue: DataFrame, most: int) -> DataFrame:
    """max_follow lowered to the limit of a run, for sources that follow links."""
    return catalogue.withColumn("max_follow", F.when(F.col("follow_links"), F.least(F.coalesce("max_follow", F.lit(most)), F.lit(most))).otherwise(F.col("max_follow")))


def urls(catalogue: DataFrame) -> DataFrame:
    """id, place, url: the addresses of each source, each once, in order."""
    return catalogue.select("id", F.posexplode(F.array_distinct("urls")).alias("place", "url"))


def one_per_host(catalogue: DataFrame, roles: list[str] = LEGISLATION) -> DataFrame:
    """The first source of each host, for a quick trial run."""
    w = Window.partitionBy("host").orderBy("id")
    rows = select_sources(catalogue, roles).withColumn("host", X.host(F.element_at("urls", 1)))
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")


def failures_that_count(catalogue: DataFrame, failed: DataFrame, optional: Column) -> DataFrame:
    """Failed sources other than optional ones, in the order of the catalogue's ids."""
    return catalogue.join(failed.select("id").distinct(), "id", "left_semi").where(~F.coalesce(optional, F.lit(False))).select("id").orderBy("id")
