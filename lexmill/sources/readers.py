"""Readers of documents, sidecars, tables, feeds and envelopes; writers of records and dead letters."""

from __future__ import annotations

import json
import os
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.functions import text as X

ROW_KEYS = ["documentos", "data", "items", "acordaos", "resultados"]


def text_documents(spark: SparkSession, root: str) -> DataFrame:
    """name, stem, text of every .txt file under a folder, whole files."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(root, wholetext=True)
    named = files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))
    return named.withColumn("stem", F.regexp_replace("name", r"\.[^.]+$", ""))


def binary_documents(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """path, name, sha256, content of files of a kind."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return files.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("sha256"), "content")


def sidecars(spark: SparkSession, root: str, schema: str | T.StructType) -> DataFrame:
    """stem and fields of JSON files beside documents; what can't be read gives nulls."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(root, wholetext=True)
    return files.select(F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1).alias("stem"), F.from_json("value", schema).alias("meta")).select("stem", "meta.*")


def kind_of(content: Column, content_type: Column, path: Column) -> Column:
    """pdf, xml or html by type, first bytes or path."""
    head = F.lower(F.decode(F.substring(content, 1, 64), "ISO-8859-1"))
    ct, p = F.lower(F.coalesce(content_type, F.lit(""))), F.lower(F.coalesce(path, F.lit("")))
    return F.when(head.startswith("%pdf") | ct.contains("pdf") | p.endswith(".pdf"), "pdf").when(head.startswith("<?xml") | ct.contains("xml") | p.endswith(".xml"), "xml").otherwise("html")


#: What Windows-1252 has where Latin-1 has control characters.
_C1 = [(chr(b), bytes([b]).decode("cp1252")) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 where they are, else as Windows-1252; a byte order mark is left out."""
    western = F.translate(F.decode(content, "ISO-8859-1"), "".join(a for a, _ in _C1), "".join(b for _, b in _C1))
    return F.regexp_replace(F.coalesce(F.try_validate_utf8(content.cast("string")), western), "^\ufeff", "")


def csv_table(spark: SparkSession, path: str, encoding: str = "UTF-8", place: str | None = None) -> DataFrame:
    """A CSV whose delimiter is the commonest of , ; | and tab in its first line; upper-case trimmed headers and trimmed values.

    place: name of a column that rises from row to row of a file: it is numbered where the file is read, by one task from its
    beginning, so it doesn't depend on what comes after.
    """
    first = spark.read.option("encoding", encoding).text(path).limit(1).collect()
    line = first[0][0] if first else ""
    sep = max([";", ",", "|", "\t"], key=lambda s: line.count(s)) if line else ";"
    df = spark.read.csv(path, header=True, sep=sep, encoding=encoding, multiLine=True, escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    df = df.toDF(*[c.strip("﻿ ").upper() for c in df.columns])
    return df.withColumn(place, F.monotonically_increasing_id()) if place else df


def json_rows(raw: Column, schema: str) -> Column:
    """Array of rows in a JSON answer: the first list among the known keys, at the top or under ``result``."""
    row = f"array<struct<{schema}>>"
    flat = "struct<" + ",".join(f"{k}:{row}" for k in ROW_KEYS) + f",result:struct<{','.join(f'{k}:{row}' for k in ROW_KEYS)}>>"
    j = F.from_json(raw, flat)
    listed = F.when(F.ltrim(raw).startswith("["), F.from_json(raw, row))
    return F.coalesce(listed, *[j[k] for k in ROW_KEYS], *[j["result"][k] for k in ROW_KEYS], F.array().cast(row))


def search_hits(raw: Column, schema: str) -> Column:
    """Array of sources in a search engine's envelope, result.hits.hits[]._source."""
    j = F.from_json(raw, f"result struct<hits:struct<hits:array<struct<_id:string,_source:struct<{schema}>>>>>")
    return F.transform(j["result"]["hits"]["hits"], lambda h: h["_source"])


def sitemap_urls(xml: Column) -> Column:
    """All <loc> texts whatever the namespace."""
    return F.transform(F.regexp_extract_all(F.coalesce(xml, F.lit("")), F.lit(r"<(?:\w+:)?loc>\s*([^<\s]+)\s*</"), F.lit(1)), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))


def feed_links(xml: Column) -> Column:
    """Links of RSS items and Atom entries, each once, in order."""
    x = F.coalesce(xml, F.lit(""))
    rss = F.regexp_extract_all(x, F.lit(r"(?s)<item\b.*?<link>\s*([^<\s]+)\s*</link>"), F.lit(1))
    atom = F.regexp_extract_all(x, F.lit(r"(?s)<entry\b.*?<link\b[^>]*href=[\"']([^\"']+)[\"']"), F.lit(1))
    return F.array_distinct(F.concat(rss, atom))


def sumula_blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, number, statement, status: numbered statements cut from a text that holds many, notes of history left out."""
    parts = df.select(key, F.posexplode(F.split(F.col(text), r"(?m)^(?=\s*S[ÚU]MULA\s+N[ºo°]?\s*\d)"))).where(F.col("col").rlike(r"(?i)^\s*S[ÚU]MULA\s+N[ºo°]?\s*\d"))
    number = F.regexp_extract("col", r"(?i)S[ÚU]MULA\s+N[ºo°]?\s*(\d+)", 1).cast("int")
    body = F.regexp_replace(F.regexp_replace("col", r"(?is)^\s*S[ÚU]MULA\s+N[ºo°]?\s*\d+\s*[-–—:]?\s*", ""), r"(?is)\n\s*(HIST[ÓO]RICO|FUNDAMENTO).*$", "")
    out = parts.select(key, number.alias("number"), X.squeeze(F.regexp_replace(body, r"(?i)\(?\b(cancelada|revogada)\b\)?", "")).alias("statement"), X.decision_status(F.col("col")).alias("status"))
    return out.where(F.length("statement") > 0)


# --- sinks ------------------------------------------------------------------------------------------------------------


def write_json_file(path: str, value: object) -> None:
    """A JSON file replaced in one step."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    temporary = target.with_suffix(f".{uuid.uuid4().hex[:8]}.tmp")
    temporary.write_text(json.dumps(value, ensure_ascii=False, sort_keys=True, default=str), encoding="utf-8")
    os.replace(temporary, target)


def write_dead_letters(bad: DataFrame, path: str) -> None:
    """Rejected rows appended as JSON lines, a folder for each stage."""
    rows = bad.select(F.current_timestamp().alias("timestamp"), "stage", F.col("error"), F.to_json(F.struct(*[c for c in bad.columns if c not in ("stage", "error")])).alias("record"))
    rows.write.mode("append").partitionBy("stage").json(path)


def answer_json(df: DataFrame, number: str = "score") -> Column:
    """A row as JSON, its score to six places."""
    return F.to_json(F.struct(*[F.round(c, 6).alias(c) if c == number else F.col(c) for c in df.columns]))
