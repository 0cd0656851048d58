"""Pages of documents: splitting, offsets, quality, repeated edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.operators.ordering import as_of


def split_pages(docs: DataFrame, key: str, text: str, mark: str = "\f") -> DataFrame:
    """key, page (from 1), page_text."""
    return docs.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(F.col(text), mark))).select(key, (F.col("pos") + 1).alias("page"), F.col("col").alias("page_text"))


def page_offsets(pages: DataFrame, key: str) -> DataFrame:
    """Adds start: where a page begins in its document, one character between pages."""
    w = Window.partitionBy(key).orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("start", F.coalesce(F.sum(F.length("page_text") + 1).over(w), F.lit(0)).cast("bigint"))


def page_of(offsets: DataFrame, points: DataFrame, key: str, at: str) -> DataFrame:
    """Adds page: the last page that starts at or before an offset."""
    marks = offsets.select(key, F.col("start").cast("bigint").alias(at), "page")
    return as_of(points.withColumn(at, F.col(at).cast("bigint")), marks, [key], at, "page")


def confidence(c: Column) -> Column:
    """Trust in extracted text: visible share x letters and digits x amount x share of characters not lost."""
    t = F.coalesce(c, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1)).cast("double")
    solid = F.length(F.regexp_replace(t, r"\s+", ""))
    visible = F.length(F.regexp_replace(t, r"[^\P{C}\r\n\t]+", "")) / n
    alnum = F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]+", "")) / F.greatest(solid, F.lit(1)).cast("double")
    lost = (F.length(t) - F.length(F.regexp_replace(t, "�", ""))) / n
    value = visible * F.least(F.lit(1.0), alnum * 1.15) * F.least(F.lit(1.0), solid / 180.0) * (1 - lost)
    return F.when(solid == 0, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)), 4))


def _lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\r?\n"), X.squeeze), lambda x: F.length(x) > 0)


def repeated_edges(pages: DataFrame, key: str, least: int = 2) -> DataFrame:
    """key, line, pages: first and last lines that stand on several pages of a document and are no legal text."""
    lines = pages.select(key, "page", _lines(F.col("page_text")).alias("l")).where(F.size("l") > 0)
    edges = lines.select(key, "page", F.explode(F.array_distinct(F.array(F.lower(F.element_at("l", 1)), F.lower(F.element_at("l", -1))))).alias("line"))
    legal = F.col("line").rlike(r"(?i)^(lei|decreto|decreto-lei|portaria|resolução|resolucao|instrução|instrucao|emenda|medida|art(igo)?\b|§|cap[ií]tulo|t[ií]tulo|se[cç][aã]o|subse[cç][aã]o|parte|livro|anexo)")
    return edges.where(~legal & (F.length("line") <= 180)).groupBy(key, "line").agg(F.count("*").alias("pages")).where(F.col("pages") >= least)


def without_edges(pages: DataFrame, key: str) -> DataFrame:
    """Pages without the repeated lines at their edges, however many follow one another."""
    noise = repeated_edges(pages, key).groupBy(key).agg(F.collect_set("line").alias("_noise"))  # edge lines of one document
    joined = pages.join(noise, key, "left")
    lines = _lines(F.col("page_text"))
    bad = lambda x: F.coalesce(F.array_contains("_noise", F.lower(x)), F.lit(False))
    keep = F.transform(lines, lambda x, i: F.when(~bad(x), i))
    first, last = F.array_min(keep), F.array_max(keep)
    text = F.when(first.isNull(), F.lit("")).otherwise(F.array_join(F.slice(lines, first + 1, last - first + 1), "\n"))
    return joined.withColumn("page_text", text).drop("_noise")


def sanitize(c: Column) -> Column:
    """A page's text: spaces collapsed, broken words joined, page numbers taken out, at most one blank line running."""
    t = F.array_join(F.transform(F.split(F.coalesce(c, F.lit("")), r"\r?\n"), X.squeeze), "\n")
    t = F.regexp_replace(t, r"(?<=[\p{L}\p{N}_])-\s+(?=[\p{L}\p{N}_])", "")
    t = F.regexp_replace(t, r"(?imu)^(?:p[aá]gina|page)\s*[:\-]?\s*[0-9]+[a-z-]*\s*$", "")
    t = F.regexp_replace(t, r"(?m)^[0-9]{1,5}(?:\s*[-/]\s*[0-9]+)?\s*$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\n+|\n+$", ""))


def repeated_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no, line: lines equal to the line before them."""
    lines = docs.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(F.col(text), "\n"))).select(key, (F.col("pos") + 1).alias("line_no"), F.trim("col").alias("line"))
    w = Window.partitionBy(key).orderBy("line_no")
    return lines.withColumn("_b", F.lag("line").over(w)).where((F.length("line") > 0) & (F.col("line") == F.col("_b"))).drop("_b")


def span_quality(spans: DataFrame, keys: list[str]) -> DataFrame:
    """First and last page, origin (native, ocr or mixed) and mean confidence of the pages of each span."""
    kinds = F.array_sort(F.collect_set("text_origin"))
    return spans.groupBy(*keys).agg(
        F.min("page").alias("page"), F.max("page").alias("page_end"), F.when(F.size(kinds) > 1, "mixed").otherwise(kinds[0]).alias("text_origin"), F.round(F.avg("extraction_confidence"), 4).alias("extraction_confidence")
    )


def ocr_confidence(words: Column) -> Column:
    """Mean of the words' confidences (0 to 100, negative where there is no word) as a share."""
    known = F.filter(words, lambda c: c >= 0)
    mean = F.try_divide(F.aggregate(known, F.lit(0.0), lambda s, c: s + c.cast("double")), F.size(known)) / 100
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(mean, F.lit(0.0)))), 4)


def choose_text(native: Column, native_conf: Column, ocr: Column, ocr_conf: Column) -> Column:
    """Struct (text, text_origin, extraction_confidence): the native text unless it is short or doubtful and a scan was
    read; where reading failed (null) a doubtful text keeps at most 0.35."""
    doubtful = (F.length(F.trim(F.coalesce(native, F.lit("")))) < 80) | (native_conf < 0.60)
    read = doubtful & ocr.isNotNull()
    return F.struct(
        F.when(read, ocr).otherwise(native).alias("text"),
        F.when(read, "ocr").otherwise("native").alias("text_origin"),
        F.when(read, ocr_conf).when(doubtful, F.least(native_conf, F.lit(0.35))).otherwise(native_conf).alias("extraction_confidence"),
    )
