"""A question answered from an index: two arms, fusion, weighting, cap, neighbours, base context, budgeted context.

The corpus's figures for the sparse arm are counted while the plan is made (two small jobs and a checkpoint); the rest is one
lazy plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import vectors as V
from lexmill.operators import retrieval as R
from lexmill.plans import filters
from lexmill.settings import Settings


def candidates(index: DataFrame, plan: filters.Plan, query_vector: list[float] | None, settings: Settings = Settings()) -> DataFrame:
    """doc_id, score, rank of the fused arms; the plan's predicate is put below both, so it reaches the scan."""
    spark = index.sparkSession
    rows = index.where(plan.predicate(index))
    asked = spark.createDataFrame([(0, plan.search)], "query_id bigint, query string")
    arms = [R.bm25_top_k(rows, asked, settings.candidates_k, settings=settings)]
    if query_vector is not None and "embedding" in index.columns:
        like = V.cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query_vector]))
        dense = rows.select(F.lit(0).cast("bigint").alias("query_id"), "doc_id", F.round(like, 6).alias("score")).where(F.col("score").isNotNull())
        arms.append(R.top_k(dense, settings.candidates_k))
    return R.fuse(arms, settings.candidates_k, settings=settings)


def retrieve(spark: SparkSession, index: DataFrame, question: str, query_vector: list[float] | None = None, settings: Settings = Settings(), base_sources: list[str] = ()) -> DataFrame:
    """Context rows of a question in their order, numbered after what fits into the budget.

    index: doc_id, text, source, unit_id, unit_kind, chunk_index, authority_level, normative_rank, jurisdicao,
    extraction_confidence, and what filters ask for. base_sources: of each of these the nearest row by vector is put after
    what was found, as context only; where nothing was found they don't stand in for it.
    """
    plan = filters.plan(question)
    asked = plan.filters.get("jurisdicao")
    fused = candidates(index, plan, query_vector, settings).select("query_id", "doc_id", F.col("score").alias("fused"))
    points = fused.join(index, "doc_id").withColumn("logit", 4 * F.col("fused") - 1)
    scored = R.weighted(points, F.lit(asked.any_of[0] if asked and asked.any_of else None).cast("string"))
    hits = R.rerank(scored, settings.final_k, settings)
    around = R.expand(hits.select("source", "unit_id", "chunk_index", "evidence"), index.select("source", "unit_id", "unit_kind", "chunk_index", "doc_id", "text"), settings)
    around = around.withColumn("context_only", ~F.col("is_hit"))
    if base_sources and query_vector is not None and "embedding" in index.columns:
        asked_vector = spark.createDataFrame([(0, [float(x) for x in query_vector])], "query_id bigint, embedding array<double>")
        best = R.dense_best_per_group(index.where(F.col("source").isin(*base_sources)), asked_vector, "source", key="doc_id").select("doc_id")
        rows = index.join(F.broadcast(best), "doc_id").select("source", "unit_id", "unit_kind", "chunk_index", "doc_id", "text")  # a row for each base source
        base = rows.withColumns({"evidence": F.lit(None).cast("double"), "distance": F.lit(None).cast("int"), "priority": F.lit(None).cast("double"), "is_hit": F.lit(False), "context_only": F.lit(True)})
        found = hits.select(F.lit(1).alias("_one")).limit(1)
        around = R.append_base(around, base.join(F.broadcast(found)).drop("_one"), ["doc_id"])
    else:
        around = around.withColumn("stage", F.lit(0))
    # at most final_k units with their neighbours, and the base: a bounded list
    order = F.struct(F.col("stage").alias("s"), (~F.col("is_hit")).alias("a"), (-F.coalesce("evidence", F.lit(-1.0))).alias("b"), (-F.col("priority")).alias("c"), F.col("distance").alias("d"), F.col("source").alias("e"), F.col("unit_id").alias("f"), F.col("chunk_index").alias("g"))
    listed = around.agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("doc_id").alias("key"), F.length("text").cast("bigint").alias("size"), F.col("is_hit").alias("primary")))).alias("items"))
    kept = listed.select(R.within_budget(F.transform("items", lambda x: F.struct(x["key"].alias("key"), x["size"].alias("size"), x["primary"].alias("primary"))), settings.max_context_chars)["kept"].alias("kept"))
    numbered = kept.select(F.posexplode("kept").alias("pos", "doc_id")).select((F.col("pos") + 1).alias("number"), "doc_id")
    return numbered.join(around, "doc_id").select("number", "doc_id", "source", "unit_id", "chunk_index", "is_hit", "context_only", "evidence", "text").orderBy("number")
