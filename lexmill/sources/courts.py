"""Answers of courts projected to records: tables of results, search envelopes, súmula and bulletin tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import dates as D
from lexmill.functions import text as X
from lexmill.operators.records import sumula_number
from lexmill.sources import html as H

PROCESS = r"\b(?:TC[- /]?)?\d{1,7}[./-]\d{2,6}(?:[./-]\d{2,4})?(?:[./-]\d{1,2})?\b|\b\d{7}-\d{2}\.\d{4}\.\d\.\d{2}\.\d{4}\b"
#: Phrases of pages that keep programs out.
BLOCKED = ["captcha", "não sou um robô", "nao sou um robo", "acesso negado", "access denied", "unusual traffic", "verifique que você é humano", "cloudflare"]


def process_number(c: Column) -> Column:
    """First process number in a text."""
    return F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), f"({PROCESS})", 1), F.lit(""))


def labelled(c: Column, *labels: str) -> Column:
    """What follows any of some labels up to the end of the line."""
    return F.coalesce(*[F.nullif(F.trim(F.regexp_extract(c, rf"(?im)^[ \t]*{x}[ \t]*:[ \t]*([^\n]+)", 1)), F.lit("")) for x in labels])


def summary_text(c: Column) -> Column:
    """The summary within a decision's text: what stands between its heading and the next."""
    return F.nullif(X.squeeze(F.regexp_extract(c, r"(?is)\bEMENTA\b\s*:?\s*(.+?)(?=\n\s*(?:AC[ÓO]RD[ÃA]O|RELAT[ÓO]RIO|VOTO|DECIS[ÃA]O|TESE|INTEIRO TEOR)\b|\z)", 1)), F.lit(""))


def is_blocked(page: Column) -> Column:
    """Pages that keep programs out; they are reported, never worked around."""
    return X.holds_any(page, [w for w in BLOCKED if w.isascii()]) | F.lower(F.coalesce(page, F.lit(""))).contains("robô")


def result_table(pages: DataFrame, key: str, page: str) -> DataFrame:
    """Records from tables of results: rows of seven cells or more hold document, process, date, two parties, subject and object; a row of one cell after it is its excerpt."""
    rows = pages.select(key, F.posexplode(H.rows_of(F.col(page))).alias("place", "cells"))
    after = F.lead("cells").over(Window.partitionBy(key).orderBy("place"))
    wide = rows.withColumn("_next", after).where(F.size("cells") >= 7)
    cell = lambda i: F.nullif(F.col("cells")[i], F.lit(""))
    return wide.select(
        key, "place", cell(0).alias("documento"), process_number(cell(1)).alias("numero_processo"), D.web_date(cell(2)).alias("data"),
        F.filter(F.array(cell(3), cell(4)), lambda x: x.isNotNull()).alias("partes"), cell(5).alias("assunto"), cell(6).alias("objeto"), F.when(F.size("_next") == 1, F.col("_next")[0]).alias("trecho"),
    )


def result_count(page: Column) -> Column:
    """N of ``Foram encontrados N registros``; null where it isn't said."""
    return F.try_to_number(F.regexp_replace(F.nullif(F.regexp_extract(page, r"(?i)foram\s+encontrad[oa]s\s+([\d.]+)\s+(?:registros|documentos|resultados)", 1), F.lit("")), r"\.", ""), F.lit("999999999")).cast("int")


def search_body(terms: list[str], size: int) -> dict:
    """Body of a search engine's question: all terms, close spellings too, best first then newest; 1 to 250 rows."""
    return {"query": {"query_string": {"query": " AND ".join(f"({t})" for t in terms), "fuzziness": "AUTO"}}, "size": max(1, min(250, size)), "sort": [{"_score": "desc"}, {"julgamento_data": "desc"}]}


def envelope_records(hits: DataFrame, source: str) -> DataFrame:
    """Records from a search engine's sources (column ``source`` of structs)."""
    s = F.col(source)
    return hits.select(
        X.squeeze(s["processo_codigo_completo"]).alias("numero_processo"), s["orgao_julgador"].alias("orgao_julgador"), s["relator_acordao_nome"].alias("relator"), D.web_date(s["julgamento_data"]).alias("data"),
        D.web_date(s["publicacao_data"]).alias("data_publicacao"), X.blank_to_null(s["ementa_texto"]).alias("ementa"), X.blank_to_null(s["documental_tese_texto"]).alias("tese"), X.blank_to_null(s["inteiro_teor_texto"]).alias("inteiro_teor"),
    )


def sumula_table(rows: DataFrame, place: str | None = None) -> DataFrame:
    """Records from a table with NUMERO, ENUNCIADO, VIGENTE and more; rows without number or statement are left out; the last row of a number counts.

    place: the column that tells where a row stands in its file (``readers.csv_table`` gives one). Without it, of rows of a number
    the one whose content sorts last counts, which no partitioning changes.
    """
    have = set(rows.columns)
    col = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    status = F.when(F.upper(F.trim(col("VIGENTE"))).startswith("S"), "VIGENTE").when(F.upper(F.trim(col("VIGENTE"))).startswith("N"), "REVOGADA").otherwise(X.decision_status(col("ENUNCIADO")))
    approved = F.nullif(F.concat_ws("/", X.blank_to_null(col("NUMAPROVACAO")), X.blank_to_null(col("ANOAPROVACAO"))), F.lit(""))
    made = rows.select(
        sumula_number(col("NUMERO")).alias("numero"), X.squeeze(F.regexp_replace(col("ENUNCIADO"), r"<[^<>]*>", " ")).alias("tese"), status.alias("situacao"), approved.alias("aprovacao"), X.blank_to_null(col("COLEGIADO")).alias("orgao_julgador"),
        F.filter(F.array(*[X.blank_to_null(col(c)) for c in ("AREA", "TEMA", "SUBTEMA")]), lambda x: x.isNotNull()).alias("assunto"), (F.col(place).cast("bigint") if place else F.lit(0).cast("bigint")).alias("_place"),
    )
    good = made.where(F.col("numero").isNotNull() & (F.length("tese") > 0))
    others = [c for c in good.columns if c not in ("numero", "_place")]
    return good.groupBy("numero").agg(F.max(F.struct("_place", F.struct(*others).alias("r")))["r"].alias("r")).select("numero", "r.*")


def sumula_text(c: Column) -> Column:
    """Struct (numero, enunciado) of one súmula's text, its notes left out."""
    p = r"(?is)S[ÚU]MULA\s+(?:TCU\s+)?N?[ºo°.]*\s*(\d+)\s*[:–—-]?\s*(.+?)(?=\s*(?:Fundamento|Precedente|Refer[êe]ncia|Hist[óo]rico|Dados de aprova)|\z)"
    return F.struct(F.try_to_number(F.nullif(F.regexp_extract(c, p, 1), F.lit("")), F.lit("999999")).cast("int").alias("numero"), F.nullif(X.squeeze(F.regexp_extract(c, p, 2)), F.lit("")).alias("enunciado"))


def too_few_sumulas(records: DataFrame, least: int) -> DataFrame:
    """One row (n, distinct_n) where there are fewer than asked for or some twice; none where all is well."""
    return records.agg(F.count("*").alias("n"), F.count_distinct("numero").alias("distinct_n")).where((F.col("n") < least) | (F.col("n") != F.col("distinct_n")))
