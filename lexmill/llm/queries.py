"""Queries on training data: name -> query over a data folder; SQL where it can express them on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import contamination, encoding, furniture, markup, mixing, quality, representative, scans, splitter
from lexmill.session import table


def p1_clean(spark: SparkSession, d: str) -> DataFrame:
    """Clean text of every value with leftover notation."""
    return markup.clean_fields(table(spark, d, "decisions"), "record_id", ["ementa", "tese"])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Values with leftover notation."""
    return p1_clean(spark, d).select("record_id", "field_name").distinct()


def p2_restored(spark: SparkSession, d: str) -> DataFrame:
    """Restored text of every value with a wrongly decoded stretch."""
    return encoding.restore_fields(table(spark, d, "decisions"), "record_id", ["ementa", "inteiro_teor"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Values with a wrongly decoded stretch."""
    return p2_restored(spark, d).select("record_id", "field_name").distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The rows that supply the fields of decisions collected more than once."""
    return representative.field_sources(table(spark, d, "decisions"), table(spark, d, "source_catalogue"))


def p3_survivors(spark: SparkSession, d: str) -> DataFrame:
    """One record for each decision."""
    return representative.survivors(table(spark, d, "decisions"), table(spark, d, "source_catalogue"))


def p4_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Repaired text of everything with faults of scanning, and its faults by kind."""
    nodes = table(spark, d, "legal_nodes").select(F.lit("legal_nodes").alias("table_name"), F.col("node_id").alias("row_key"), F.col("source_text").alias("text"))
    decisions = table(spark, d, "decisions").select(F.lit("decisions").alias("table_name"), F.col("record_id").cast("string").alias("row_key"), F.col("inteiro_teor").alias("text"))
    return scans.repair_scans(nodes.unionByName(decisions))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Texts with faults of scanning."""
    return p4_repaired(spark, d).select("table_name", "row_key").distinct()


def p5_main(spark: SparkSession, d: str) -> DataFrame:
    """The main text of every value mixed with page furniture."""
    return furniture.main_text(table(spark, d, "decisions"), "record_id", ["inteiro_teor", "ementa"], "url_oficial")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Values that hold page furniture."""
    return furniture.template_elements(table(spark, d, "decisions"), "record_id", ["inteiro_teor", "ementa"], "url_oficial").select("record_id", "field_name").distinct()


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Texts above their limit as ordered pieces."""
    nodes = table(spark, d, "legal_nodes").select(F.lit("legal_nodes").alias("table_name"), F.col("node_id").alias("row_key"), "kind", F.col("source_text").alias("text"))
    excerpts = table(spark, d, "excerpts").select(F.lit("excerpts").alias("table_name"), F.col("source_id").alias("row_key"), F.col("role").alias("kind"), "text")
    return splitter.split_oversized(nodes.unionByName(excerpts), table(spark, d, "size_limits"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Texts above their limit: those the splitter cut."""
    return p6_pieces(spark, d).where(F.col("piece_no") == 2).select("table_name", "row_key").distinct()


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Every leaked part of a test item with its place in the document."""
    return contamination.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the test items they leak."""
    return p8_leaks(spark, d).select("doc_id", "item_id").distinct()


def p8_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Documents that leak, without the leaked spans."""
    return contamination.remove_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mix of documents."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares reached by the mix."""
    return mixing.shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p10_quality(spark: SparkSession, d: str) -> DataFrame:
    """Figures of every document and its shares of prose, list, table and junk."""
    return quality.quality(table(spark, d, "documents"), table(spark, d, "common_words"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents more than half of whose characters are no running sentences."""
    got = p10_quality(spark, d)
    return got.where(F.col("list_share") + F.col("table_share") + F.col("junk_share") > 0.5).select("doc_id").distinct()


QUERIES = {
    "p1_found": p1_found,
    "p1_clean": p1_clean,
    "p2_found": p2_found,
    "p2_restored": p2_restored,
    "p3_found": p3_found,
    "p3_survivors": p3_survivors,
    "p4_found": p4_found,
    "p4_repaired": p4_repaired,
    "p5_found": p5_found,
    "p5_main": p5_main,
    "p6_found": p6_found,
    "p6_pieces": p6_pieces,
    "p8_found": p8_found,
    "p8_leaks": p8_leaks,
    "p8_cleaned": p8_cleaned,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_quality": p10_quality,
}
ORACLES = {
    "p6_found": """
        SELECT DISTINCT t.table_name, t.row_key
        FROM (SELECT 'legal_nodes' AS table_name, node_id AS row_key, kind, source_text AS text FROM legal_nodes
              UNION ALL SELECT 'excerpts', source_id, role, text FROM excerpts) t
        JOIN size_limits l ON l.table_name = t.table_name AND l.kind = t.kind
        WHERE length(t.text) > l.max_chars
    """,
}
