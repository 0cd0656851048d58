"""Physical plans are the ones meant to hold at scale."""

from pyspark.sql import functions as F

from lexmill import queries_core as q
from lexmill.operators import records, retrieval


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_caps_limit_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    p = plan(records.group_cap(df, ["g"], [F.col("id")], 5))
    assert p.count("WindowGroupLimit") == 2 and p.index("Exchange hashpartitioning") > p.index("WindowGroupLimit")


def test_choosing_one_row_is_an_aggregation(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    assert "Window" not in plan(records.keep_best(df, ["g"], F.struct("id")))


def test_no_cross_or_nested_loop_joins(spark, data):
    for name in ("q_expand_neighbors", "q_headings_in_force", "q_page_of_offset", "q_merge_replace", "q_prune_stale", "q_eval_join", "q_join_aggregate", "q_source_semi", "q_weighted_score", "q_bm25_topk"):
        p = plan(q.QUERIES[name](spark, data))
        assert "CartesianProduct" not in p and "NestedLoop" not in p, name


def test_no_pairs_of_query_and_document_are_shuffled(spark, data):
    """Before the best are chosen nothing moves: scores are made where a document's terms lie."""
    for name in ("q_bm25_topk", "q_dense_topk"):
        p = plan(q.QUERIES[name](spark, data)).split("Initial Plan")[-1]
        lines = p.splitlines()
        first = next(i for i, x in enumerate(lines) if "MapInPandas" in x)
        before = [x for x in lines[:first] if "Exchange" in x]
        assert len(before) == 1 and "WindowGroupLimit" in p[p.index("Exchange") :] and not any("Exchange" in x for x in lines[first:]), name


def test_columns_are_pruned(spark, data):
    p = plan(q.QUERIES["q_facet_counts"](spark, data))
    assert "ReadSchema: struct<l_returnflag:string,l_linestatus:string>" in p
    assert "inteiro_teor" not in plan(q.QUERIES["q_filter_match"](spark, data)).split("ReadSchema")[1]


def test_top_k_is_limited_early(spark):
    s = spark.range(100).select((F.col("id") % 2).alias("query_id"), F.col("id").alias("doc_id"), F.col("id").cast("double").alias("score"))
    assert "WindowGroupLimit" in plan(retrieval.top_k(s, 3))
