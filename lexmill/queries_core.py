"""Queries of the core over a data folder, and the same in SQL where SQL can say it on whole tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions import dates as D
from lexmill.functions import scores as S
from lexmill.functions import text as X
from lexmill.functions import vectors as V
from lexmill.operators import acceptance, ann, evaluation, gate, index, legal, metadata, pages, records, retrieval, timestamps
from lexmill.plans import filters
from lexmill.session import cut, table
from lexmill.sources import catalog, courts, html

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def fold_sql(c: str) -> str:
    """Folding as in the expressions."""
    return f"lower(translate({c}, '{X.MARKED}', '{X.PLAIN}'))"


def tokens_sql(c: str) -> str:
    """Tokens as in the expressions."""
    return f"regexp_extract_all({fold_sql(c)}, '{X.TOKEN}')"


#: File names beside the data's, so that every rule meets one.
NAMES = [
    "TCESP_manual.pdf", "acordao_tcu.txt", "stj-1.txt", "stf.pdf", "tjsp_2.txt", "constituicao_federal.pdf", "constituicao_estadual.txt", "L14133.pdf", "lei-14.133-sp.txt", "guia_sustentavel.pdf", "obras.txt", "norma_sp_1.txt", "lei_8666.txt",
    "decretolei.txt", "lindb.txt", "doutrina.txt", "direito_administrativo.txt", "improbidade.md", "resolucao_3.txt", "aviso.txt", "tribunal de contas do estado de são paulo.txt", "espera.txt",
]


def rules_sql(n: str) -> str:
    """What a file name says, as a struct; rule after rule."""
    has = lambda *ms: "(" + " OR ".join(f"contains({n}, '{m}')" for m in ms) + ")"
    sp = rf"regexp_matches({n}, '(^|[_\-.])sp([_\-.]|$)')"
    law = rf"(regexp_matches({n}, '(^|[_\-.])(l|lei)?14[ ._\-]?133([_\-.]|$)') OR regexp_matches({n}, 'lei.?14[ ._\-]?133'))"

    def row(orgao: str | None, jurisdicao: str | None, tribunal: str | None, kind: str | None, role: str, level: int | None, ambiguous: bool = False) -> str:
        v = lambda x: "NULL" if x is None else f"'{x}'"
        sphere = {"estadual_sp": "estadual", "federal": "federal"}.get(jurisdicao)
        return f"{{'orgao': {v(orgao)}::VARCHAR, 'jurisdicao': {v(jurisdicao)}::VARCHAR, 'esfera': {v(sphere)}::VARCHAR, 'tribunal': {v(tribunal)}::VARCHAR, 'tipo_documento': {v(kind)}::VARCHAR, 'source_role': '{role}', 'authority_level': {level or 'NULL'}::INT, 'ambiguous': {str(ambiguous).lower()}}}"

    state, nation = "estadual_sp", "federal"
    rules = [
        (f"{sp} AND {law}", row(None, None, None, None, "desconhecido", None, True)),
        (has("tcesp", "tribunal de contas do estado de são paulo", "tribunal de contas do estado de sao paulo"), row("TCESP", state, "TCESP", "jurisprudencia", "jurisprudencia_controle", 2)),
        (has("tcu"), row("TCU", nation, "TCU", "jurisprudencia", "jurisprudencia_controle", 2)),
        (has("stj"), row("STJ", nation, "STJ", "jurisprudencia", "jurisprudencia", 2)),
        (has("stf"), row("STF", nation, "STF", "jurisprudencia", "jurisprudencia", 2)),
        (has("tjsp"), row("TJSP", state, "TJSP", "jurisprudencia", "jurisprudencia", 2)),
        (has("constituicao") + f" AND {has('estadual')}", row("Constituição", state, None, "constituicao", "norma", 1)),
        (has("constituicao"), row("Constituição", nation, None, "constituicao", "norma", 1)),
        (law, row("Legislação Federal", nation, None, "lei", "norma", 1)),
        (has("sustent", "ambient", "engenharia", "obras"), row("AGU", nation, None, "guia", "orientacao_oficial", 3)),
        (sp, row("Estado de São Paulo", state, None, None, "norma", 1)),
        (has("lei_", "decreto_", "decretolei", "resolucao_", "lindb"), row("Legislação Federal", nation, None, "norma", "norma", 1)),
        (has("doutrina"), row(None, None, None, "doutrina", "doutrina", 4)),
        (has("direito_administrativo", "lindb", "improbidade"), row("Legislação Federal", nation, None, "mapa_fontes", "orientacao_oficial", 3)),
    ]
    return "CASE " + " ".join(f"WHEN {c} THEN {r}" for c, r in rules) + f" ELSE {row(None, None, None, None, 'desconhecido', None)} END"


_CONFIDENCE_SQL = r"""CASE WHEN length(regexp_replace(coalesce({0}, ''), '\s', '', 'g')) = 0 THEN 0.0 ELSE round(greatest(0, least(1,
    (length({0}) - len(regexp_extract_all({0}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{{9f}}\x{{ad}}]')))::DOUBLE / length({0})
    * least(1.0, length(regexp_replace({0}, '[^\p{{L}}\p{{N}}]', '', 'g'))::DOUBLE / length(regexp_replace({0}, '\s', '', 'g')) * 1.15)
    * least(1.0, length(regexp_replace({0}, '\s', '', 'g')) / 180.0) * (1 - (length({0}) - length(replace({0}, '�', '')))::DOUBLE / length({0})))), 4) END"""
DATE_FIELDS = ["data", "data_publicacao", "data_autuacao"]


# --- timestamps -------------------------------------------------------------------------------------------------------


_MONTH_NAMES = [
    "janeiro|january|jan", "fevereiro|february|fev|feb", "março|marco|march|mar", "abril|april|abr|apr", "maio|may|mai", "junho|june|jun", "julho|july|jul", "agosto|august|ago|aug", "setembro|september|sept|set|sep", "outubro|october|out|oct",
    "novembro|november|nov", "dezembro|december|dez|dec",
]
_WEEKDAY_NAMES = "segunda|terça|terca|quarta|quinta|sexta|sábado|sabado|domingo|seg|ter|qua|qui|sex|sáb|sab|dom|monday|tuesday|wednesday|thursday|friday|saturday|sunday|mon|tue|wed|thu|fri|sat|sun"
_NORMAL_SQL = r"' ' || lower(trim(regexp_replace(v, '\s+', ' ', 'g'))) || ' '"
for _i, _names in enumerate(_MONTH_NAMES, 1):
    _NORMAL_SQL = rf"regexp_replace({_NORMAL_SQL}, '([^\p{{L}}])(?:{_names})([^\p{{L}}])', '\1m{_i:02d}\2', 'g')"
_NORMAL_SQL = rf"regexp_replace({_NORMAL_SQL}, '([^\p{{L}}])(?:{_WEEKDAY_NAMES})([^\p{{L}}])', '\1w\2', 'g')"
_ZONE_RE = r"( ?z| ?(?:utc|gmt)? ?[+-]\d\d?(?::?\d\d)?| ?[a-z]{3,4})?(?: ?\[[a-z/_]+\])?"
_TIME_RE = r"(?:,| -|t|)(?: ?às| ?as)? ?(\d\d?)(?:[:h](\d\d)(?:[:m](\d\d)s?(?:[.,]\d{1,9})?)?(?:min)?|h) ?([ap]\.?m\.?)?" + _ZONE_RE + r"(?: ?\((?:horário|horario) (?:de|oficial de) (?:brasília|brasilia)\))?"
_ZONES = {"z": 0, "utc": 0, "gmt": 0, "brt": -180, "brst": -120, "amt": -240, "amst": -180, "act": -300, "fnt": -120}


@query(
    rf"""
    WITH f AS (SELECT record_id, unnest(['data', 'data_publicacao', 'data_autuacao']) AS field_name, unnest([data, data_publicacao, data_autuacao]) AS v FROM decisions),
    n AS (SELECT record_id, field_name, trim({_NORMAL_SQL}) AS t FROM f WHERE v IS NOT NULL),
    p AS (SELECT record_id, field_name, t,
            regexp_extract(t, '^(\d{{4}})([-./])(m?\d\d?)([-./])(\d\d?){_TIME_RE}$', ['y', 's', 'm', 's2', 'd', 'h', 'mi', 'se', 'pm', 'z']) AS a,
            regexp_extract(t, '^(?:w(?:-feira)?,? )?(\d\d?)([-./ ])(m?\d\d?)([-./ ])(\d{{4}}|\d\d){_TIME_RE}$', ['d', 's', 'm', 's2', 'y', 'h', 'mi', 'se', 'pm', 'z']) AS b,
            regexp_extract(t, '^(?:w(?:-feira)?,? )?(\d\d?)[ºo°]? de (m\d\d) de (\d{{4}}){_TIME_RE}$', ['d', 'm', 'y', 'h', 'mi', 'se', 'pm', 'z']) AS c,
            regexp_extract(t, '^(\d{{4}})(\d\d)(\d\d)t(\d\d)(\d\d)(?:(\d\d)(?:[.,]\d{{1,9}})?)?{_ZONE_RE}$', ['y', 'm', 'd', 'h', 'mi', 'se', 'z']) AS e FROM n),
    g AS (SELECT record_id, field_name, CASE WHEN a.y <> '' AND a.s = a.s2 THEN [a.y, a.m, a.d, a.h, a.mi, a.se, a.pm, a.z] WHEN b.y <> '' AND b.s = b.s2 THEN [b.y, b.m, b.d, b.h, b.mi, b.se, b.pm, b.z] WHEN c.y <> '' THEN [c.y, c.m, c.d, c.h, c.mi, c.se, c.pm, c.z]
                 WHEN e.y <> '' THEN [e.y, e.m, e.d, e.h, e.mi, e.se, '', e.z] END AS x FROM p),
    k AS (SELECT record_id, field_name, CASE WHEN length(x[1]) = 2 THEN '20' || x[1] ELSE x[1] END::INT AS y, try_cast(ltrim(x[2], 'm') AS INT) AS m, try_cast(x[3] AS INT) AS d, try_cast(x[4] AS INT) AS h0, coalesce(nullif(x[5], ''), '0')::INT AS mi, coalesce(nullif(x[6], ''), '0')::INT AS se, left(x[7], 1) AS pm, trim(x[8]) AS z FROM g WHERE x IS NOT NULL AND x[4] <> ''),
    w AS (SELECT *, CASE WHEN pm = '' THEN h0 ELSE h0 % 12 + CASE pm WHEN 'p' THEN 12 ELSE 0 END END AS h, regexp_extract(z, '^(?:utc|gmt)? ?([+-])(\d\d?):?(\d\d)?$', ['s', 'h', 'm']) AS o,
                 try_cast(printf('%04d-%02d-%02d', y, m, d) AS DATE) AS day FROM k WHERE NOT (pm <> '' AND (h0 < 1 OR h0 > 12))),
    i AS (SELECT *, day + to_hours(h) + to_minutes(mi) + to_seconds(se) AS local,
                 CASE {' '.join(f"WHEN z = '{k}' THEN {v}" for k, v in _ZONES.items())} WHEN o.s <> '' AND try_cast(o.h AS INT) <= 18 AND coalesce(nullif(o.m, ''), '0')::INT <= 59 THEN CASE o.s WHEN '+' THEN 1 ELSE -1 END * (try_cast(o.h AS INT) * 60 + coalesce(nullif(o.m, ''), '0')::INT) END AS off
          FROM w WHERE day IS NOT NULL AND h <= 23 AND mi <= 59 AND se <= 59)
    SELECT DISTINCT record_id, field_name FROM i
    WHERE day <> CASE WHEN z = '' THEN (timezone('America/Sao_Paulo', local) AT TIME ZONE 'UTC')::DATE WHEN off IS NOT NULL THEN (local - to_minutes(off))::DATE ELSE day END
    """
)
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Values that write a day and a time whose day in UTC is another."""
    got = p7_timestamps(spark, d)
    return got.where((F.col("kind") == "instant") & (F.col("day") != F.col("day_utc"))).select("record_id", "field_name").distinct()


@query()
def p7_timestamps(spark: SparkSession, d: str) -> DataFrame:
    """Every date field of every decision as one unambiguous day or instant."""
    return timestamps.normalise_timestamps(table(spark, d, "decisions"), "record_id", DATE_FIELDS)


# --- search -----------------------------------------------------------------------------------------------------------
# Query sets: rows whose id is divisible by 20, against all rows.


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").where(F.col("item_id") % 20 == 0).select(F.col("item_id").alias("query_id"), "query")


def _bm25(spark: SparkSession, d: str, where: object = True, k: int = 40) -> DataFrame:
    docs = table(spark, d, "documents").where(F.lit(where) if isinstance(where, bool) else where)
    return retrieval.bm25_top_k(docs, _questions(spark, d), k)


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "embedding", F.col("label").cast("int").alias("label"))


def _vector_questions(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), "embedding")


def _dense(spark: SparkSession, d: str, k: int, exclude_self: bool = False) -> DataFrame:
    return retrieval.dense_top_k(_vectors(spark, d), _vector_questions(spark, d), k, extra=["label"], exclude_self=exclude_self)


def bm25_sql(where: str = "true", k: int = 40) -> str:
    """CTEs up to ``sparse``: query_id, doc_id, score, rank."""
    return f"""
    q AS (SELECT item_id AS query_id, unnest(list_distinct({tokens_sql('query')})) AS term FROM eval_items WHERE item_id % 20 = 0),
    docs AS (SELECT doc_id, {tokens_sql("coalesce(text, '')")} AS t FROM documents WHERE {where}),
    sized AS (SELECT doc_id, t, len(t)::DOUBLE AS dl FROM docs),
    whole AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM sized),
    words AS (SELECT doc_id, dl, unnest(t) AS term FROM sized),
    tf AS (SELECT doc_id, dl, term, count(*)::DOUBLE AS tf FROM words WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term),
    scored AS (SELECT q.query_id, tf.doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
               FROM tf JOIN df USING (term) JOIN q USING (term), whole GROUP BY ALL),
    sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored QUALIFY rank <= {k})"""


def dense_sql(k: int, exclude_self: bool = False) -> str:
    """CTEs up to ``dense``: query_id, vec_id, label, score, rank."""
    return f"""
    v AS (SELECT vec_id, label::INT AS label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
    sims AS (SELECT a.vec_id AS query_id, b.vec_id, b.label, round(list_cosine_similarity(a.e, b.e), 6) AS score
             FROM v a JOIN v b ON a.vec_id % 20 = 0 {"AND a.vec_id <> b.vec_id" if exclude_self else ""}),
    dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM sims QUALIFY rank <= {k})"""


@query(f"WITH {bm25_sql()} SELECT query_id, doc_id, score, rank::INT AS rank FROM sparse")
def q_bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """Sparse search: 40 best documents of each question."""
    return _bm25(spark, d)


@query(f"WITH {dense_sql(20)} SELECT query_id, vec_id, score, label, rank::INT AS rank FROM dense")
def q_dense_topk(spark: SparkSession, d: str) -> DataFrame:
    """Dense search: 20 nearest vectors of each query vector."""
    return _dense(spark, d, 20)


def _dense_docs(spark: SparkSession, d: str, k: int = 40) -> DataFrame:
    """The dense arm of the questions: a question's vector is the one of its id, a document's too."""
    asked = _questions(spark, d).join(_vectors(spark, d).withColumnRenamed("vec_id", "query_id"), "query_id").select("query_id", "embedding")
    return retrieval.dense_top_k(_vectors(spark, d), asked, k).withColumnRenamed("vec_id", "doc_id").select("query_id", "doc_id", "score", "rank")


@query()
def q_ann_topk(spark: SparkSession, d: str) -> DataFrame:
    """Approximate dense search: 10 nearest from an inverted-file index of all rows."""
    v = _vectors(spark, d)
    c = ann.fit(v, 16)
    return ann.search(ann.assign(v, c), c, _vector_questions(spark, d), 10, 12)  # these vectors have hardly any clusters


@query("SELECT true AS enough")
def q_ann_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether its mean recall against the exact search is 0.9 or more."""
    r = ann.recall(q_ann_topk(spark, d), _dense(spark, d, 10).select("query_id", "vec_id"))
    return r.agg((F.avg("recall") >= 0.9).alias("enough"))


_ARM_SQL = """
    v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
    sims AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_cosine_similarity(a.e, b.e), 6) AS score
             FROM v a JOIN v b ON a.vec_id IN (SELECT item_id FROM eval_items WHERE item_id % 20 = 0)),
    dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sims QUALIFY rank <= 40)"""
_FUSED_SQL = """
    fused AS (SELECT query_id, doc_id, sum(1.0 / (2 + rank - 1)) AS s FROM (SELECT query_id, doc_id, rank FROM sparse UNION ALL SELECT query_id, doc_id, rank FROM dense) GROUP BY ALL),
    hybrid AS (SELECT query_id, doc_id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank FROM fused QUALIFY rank <= 40)"""


def _hybrid(spark: SparkSession, d: str, where: object = True) -> DataFrame:
    dense = _dense_docs(spark, d)
    if not isinstance(where, bool):
        allowed = table(spark, d, "documents").where(where).select("doc_id")
        asked = _questions(spark, d).join(_vectors(spark, d).withColumnRenamed("vec_id", "query_id"), "query_id").select("query_id", "embedding")
        rows = _vectors(spark, d).join(allowed, F.col("vec_id") == F.col("doc_id"), "left_semi")
        dense = retrieval.dense_top_k(rows, asked, 40).withColumnRenamed("vec_id", "doc_id").select("query_id", "doc_id", "score", "rank")
    arms = [_bm25(spark, d, where).select("query_id", "doc_id", "rank"), dense]
    return retrieval.fuse(arms, 40).withColumn("score", F.round("score", 6))


@query(f"WITH {bm25_sql()}, {_ARM_SQL}, {_FUSED_SQL} SELECT query_id, doc_id, score, rank::INT AS rank FROM hybrid")
def q_rrf_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Fusion of the sparse and the dense arm."""
    return _hybrid(spark, d)


@query(
    f"WITH {bm25_sql(chr(108) + 'ang = ' + repr('pt'))}, "
    + _ARM_SQL.replace("ON a.vec_id IN", "ON b.vec_id IN (SELECT doc_id FROM documents WHERE lang = 'pt') AND a.vec_id IN")
    + f", {_FUSED_SQL} SELECT query_id, doc_id, score, rank::INT AS rank FROM hybrid"
)
def q_hybrid_filtered(spark: SparkSession, d: str) -> DataFrame:
    """The same with one filter put below both arms."""
    return _hybrid(spark, d, F.col("lang") == "pt")


def _catalogue(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_catalogue").select(F.col("id").alias("source"), "authority_level", F.col("source_role").alias("role"))


def _points(spark: SparkSession, d: str, ids: DataFrame) -> DataFrame:
    """The documents named, as points: units are a process or the document, confidence stands for the text's quality and is taken of these alone."""
    docs = table(spark, d, "documents").join(F.broadcast(ids.select("doc_id").distinct()), "doc_id")  # at most 40 ids a question
    docs = docs.select("doc_id", "source", F.coalesce("numero_processo", F.col("doc_id").cast("string")).alias("unit_id"), pages.confidence(F.col("text")).alias("extraction_confidence"))
    return docs.join(_catalogue(spark, d), "source", "left").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "unit_id", "extraction_confidence", "authority_level", metadata.normative_rank(F.col("role"), F.lit("lei")).alias("normative_rank"), F.lit("federal").alias("jurisdicao"))


@query(
    f"""
    WITH {bm25_sql()}, {_ARM_SQL}, {_FUSED_SQL},
    p AS (SELECT h.query_id, h.doc_id, coalesce(d.source, '') AS source, coalesce(d.numero_processo, d.doc_id::VARCHAR) AS unit_id, h.score AS fused, {_CONFIDENCE_SQL.format('d.text')} AS quality, c.authority_level,
                 CASE c.authority_level WHEN 1 THEN CASE WHEN c.source_role = 'norma' THEN 0.92 ELSE 0.76 END WHEN 2 THEN 0.62 WHEN 3 THEN 0.40 WHEN 4 THEN 0.20 ELSE 0.10 END AS a
          FROM hybrid h JOIN documents d USING (doc_id) LEFT JOIN source_catalogue c ON c.id = d.source),
    e AS (SELECT *, 1 / (1 + exp(-greatest(-30, least(30, 4 * fused - 1)))) AS evidence FROM p),
    s AS (SELECT *, greatest(0, least(1, 0.68 * evidence * quality + 0.20 * a + 0.12)) AS retrieval FROM e),
    u AS (SELECT *, row_number() OVER (PARTITION BY query_id, source, unit_id ORDER BY round(retrieval, 9) DESC, round(evidence, 9) DESC, a DESC, coalesce(authority_level, 9), doc_id) AS u FROM s QUALIFY u <= 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(retrieval, 9) DESC, round(evidence, 9) DESC, a DESC, coalesce(authority_level, 9), doc_id) AS rank FROM u QUALIFY rank <= 6)
    SELECT query_id, doc_id, source, unit_id, round(evidence, 6) AS evidence, round(retrieval, 6) AS retrieval, rank::INT AS rank FROM r WHERE evidence >= 0.20
    """
)
def q_hybrid_weighted(spark: SparkSession, d: str) -> DataFrame:
    """Fusion, then weighting by evidence, authority and quality, a cap of two for a unit, the best six of each question."""
    fused = cut(_hybrid(spark, d).select("query_id", "doc_id", F.col("score").alias("fused")))
    scored = retrieval.weighted(fused.join(_points(spark, d, fused), "doc_id").withColumn("logit", 4 * F.col("fused") - 1), F.lit("federal"))
    got = retrieval.rerank(scored, 6)
    return got.select("query_id", "doc_id", "source", "unit_id", F.round("evidence", 6).alias("evidence"), F.round("retrieval", 6).alias("retrieval"), "rank")


@query("SELECT vec_id AS query_id, vec_id, label FROM embeddings WHERE false")
def q_empty_search(spark: SparkSession, d: str) -> DataFrame:
    """A search with no query gives nothing: base context never replaces missing evidence."""
    none = _vector_questions(spark, d).where(F.lit(False))
    return retrieval.dense_top_k(_vectors(spark, d), none, 5, extra=["label"]).select("query_id", "vec_id", "label")


@query(f"WITH {dense_sql(10**9)} SELECT query_id, label, arg_max(vec_id, (score, -vec_id)) AS vec_id, max(score) AS score FROM sims GROUP BY query_id, label")
def q_base_context_top1(spark: SparkSession, d: str) -> DataFrame:
    """The nearest vector of each label for each query: one scan, one small aggregation."""
    return retrieval.dense_best_per_group(_vectors(spark, d), _vector_questions(spark, d), "label").select("query_id", "label", "vec_id", "score")


@query(
    """
    SELECT doc_id, round(e, 6) AS evidence, round(a, 6) AS authority, round(greatest(0, least(1, 0.68 * e + 0.20 * a + 0.12 * j)), 6) AS retrieval
    FROM (SELECT doc_id, 1 / (1 + exp(-greatest(-30, least(30, n_chars / 1000.0 - 2)))) AS e,
                 CASE authority_level WHEN 1 THEN 0.92 WHEN 2 THEN 0.62 WHEN 3 THEN 0.40 WHEN 4 THEN 0.20 ELSE 0.10 END AS a,
                 CASE WHEN lang IS NULL THEN 0.5 WHEN lang = 'pt' THEN 1.0 ELSE 0.25 END AS j
          FROM documents d LEFT JOIN source_catalogue c ON d.source = c.id)
    """
)
def q_weighted_score(spark: SparkSession, d: str) -> DataFrame:
    """Evidence, authority, jurisdiction and their weighted sum for every document."""
    docs = table(spark, d, "documents").join(_catalogue(spark, d), "source", "left")
    own = F.when(F.col("lang") == "pt", "federal").when(F.col("lang").isNotNull(), "estadual_sp")
    e, a = S.evidence_score(F.col("n_chars") / 1000.0 - 2), S.authority_score(F.col("authority_level"), F.lit(2))
    r = S.retrieval_score(e, F.lit(1.0), a, S.jurisdiction_score(F.lit("federal"), own))
    return docs.select("doc_id", F.round(e, 6).alias("evidence"), F.round(a, 6).alias("authority"), F.round(r, 6).alias("retrieval"))


@query(
    """
    WITH p AS (SELECT o_orderkey, o_custkey, o_orderpriority, round(o_totalprice, 2) AS s FROM orders),
    c AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY s DESC, o_orderkey) AS u FROM p QUALIFY u <= 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY s DESC, o_orderkey) AS rank FROM c QUALIFY rank <= 50)
    SELECT o_orderpriority, o_orderkey, o_custkey, s AS total, rank::INT AS rank FROM r WHERE s >= 1000
    """
)
def q_rerank_cap(spark: SparkSession, d: str) -> DataFrame:
    """At most two of a unit, then the best fifty of a query, then a threshold: orders of customers by priority."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.round("o_totalprice", 2).alias("total"))
    order = [F.col("total").desc(), F.col("o_orderkey")]
    capped = records.group_cap(rows, ["o_orderpriority", "o_custkey"], order, 2).drop("place")
    ranked = records.group_cap(capped, ["o_orderpriority"], order, 50).withColumnRenamed("place", "rank")
    return ranked.where(F.col("total") >= 1000).select("o_orderpriority", "o_orderkey", "o_custkey", "total", "rank")


@query(
    """
    WITH h AS (SELECT l_orderkey AS u, l_linenumber AS c, round(l_discount, 4) AS e FROM lineitem WHERE l_quantity >= 45),
    f AS (SELECT l.l_orderkey, l.l_linenumber, h.e, abs(l.l_linenumber - h.c) AS d FROM lineitem l JOIN h ON l.l_orderkey = h.u WHERE abs(l.l_linenumber - h.c) <= 1 OR l.l_linenumber = 1)
    SELECT l_orderkey, l_linenumber::INT AS l_linenumber, max(e) AS priority, min(d)::INT AS distance, min(d) = 0 AS is_hit FROM f GROUP BY ALL
    """
)
def q_expand_neighbors(spark: SparkSession, d: str) -> DataFrame:
    """Chunks within one of a hit and the first chunk of its unit: lines of orders, hits are large quantities."""
    lines = table(spark, d, "lineitem")
    chunks = lines.select(F.lit("o").alias("source"), F.col("l_orderkey").cast("string").alias("unit_id"), F.lit("artigo").alias("unit_kind"), F.col("l_linenumber").cast("int").alias("chunk_index"))
    hits = lines.where(F.col("l_quantity") >= 45).select(F.lit("o").alias("source"), F.col("l_orderkey").cast("string").alias("unit_id"), F.col("l_linenumber").cast("int").alias("chunk_index"), F.round("l_discount", 4).alias("evidence"))
    got = retrieval.expand(hits, chunks, first=1)
    return got.select(F.col("unit_id").cast("bigint").alias("l_orderkey"), F.col("chunk_index").alias("l_linenumber"), "priority", F.col("distance").cast("int").alias("distance"), "is_hit")


@query(
    """
    SELECT doc_id, source, 0 AS stage FROM documents WHERE lang = 'es'
    UNION ALL
    SELECT d.doc_id, d.source, 1 FROM documents d JOIN source_catalogue c ON d.source = c.id WHERE c.source_role = 'doutrina' AND d.doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'es')
    """
)
def q_base_append(spark: SparkSession, d: str) -> DataFrame:
    """Base documents that aren't among the primary ones, after them."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    base = docs.join(_catalogue(spark, d).where(F.col("role") == "doutrina"), "source", "left_semi")
    return retrieval.append_base(docs.where(F.col("lang") == "es").select("doc_id", "source"), base.select("doc_id", "source"), ["doc_id"])


@query(
    f"""
    WITH RECURSIVE {bm25_sql()},
    b AS (SELECT s.query_id, s.rank, s.doc_id, length(d.text)::BIGINT AS size, s.rank % 4 <> 0 AS main FROM sparse s JOIN documents d USING (doc_id)),
    w AS (SELECT query_id, 0::BIGINT AS rank, 0::BIGINT AS used, false AS stop, []::BIGINT[] AS kept FROM b GROUP BY query_id
          UNION ALL
          SELECT w.query_id, b.rank, CASE WHEN NOT w.stop AND w.used + b.size <= 16000 THEN w.used + b.size ELSE w.used END, w.stop OR (NOT (NOT w.stop AND w.used + b.size <= 16000) AND b.main),
                 CASE WHEN NOT w.stop AND w.used + b.size <= 16000 THEN list_append(w.kept, b.doc_id) ELSE w.kept END
          FROM w JOIN b ON b.query_id = w.query_id AND b.rank = w.rank + 1)
    SELECT query_id, used, stop AS stopped, len(kept)::INT AS n_kept, array_to_string(kept, ',') AS kept FROM w QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank DESC) = 1
    """
)
def q_context_budget(spark: SparkSession, d: str) -> DataFrame:
    """What fits into 16 000 characters for each question: the best forty documents in order, every fourth only as context."""
    best = _bm25(spark, d).join(table(spark, d, "documents").select("doc_id", F.length("text").cast("bigint").alias("size")), "doc_id")
    items = best.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("doc_id").alias("key"), "size", (F.col("rank") % 4 != 0).alias("primary")))).alias("items"))
    kept = retrieval.within_budget(F.col("items"), 16_000)
    return items.select("query_id", kept["used"].alias("used"), kept["stop"].alias("stopped"), F.size(kept["kept"]).alias("n_kept"), F.array_join(F.transform(kept["kept"], lambda x: x.cast("string")), ",").alias("kept"))


@query("SELECT l_returnflag || l_linestatus AS value, count(*) AS n FROM lineitem GROUP BY 1")
def q_facet_counts(spark: SparkSession, d: str) -> DataFrame:
    """Exact counts of a field's values."""
    return index.facet(table(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("flag")), "flag")


@query("SELECT value, count(*) AS n FROM (SELECT record_id, unnest(list_distinct(assunto)) AS value FROM decisions) WHERE value IS NOT NULL GROUP BY 1")
def q_facet_array(spark: SparkSession, d: str) -> DataFrame:
    """Exact counts of an array field's entries, each once a row."""
    return index.facet(table(spark, d, "decisions"), "assunto")


@query("SELECT count(*) AS points, count(DISTINCT source) AS sources, count(*) FILTER (lang IS NULL) AS without_lang FROM documents")
def q_point_count(spark: SparkSession, d: str) -> DataFrame:
    """Exact counts of a collection."""
    return table(spark, d, "documents").agg(F.count("*").alias("points"), F.count_distinct("source").alias("sources"), F.count_if(F.col("lang").isNull()).alias("without_lang"))


@query("SELECT doc_id, source FROM documents WHERE doc_id > 100 ORDER BY doc_id LIMIT 256")
def q_scroll_page(spark: SparkSession, d: str) -> DataFrame:
    """The next page of 256 points after a key."""
    return index.page(table(spark, d, "documents").select("doc_id", "source"), "doc_id", 100, 256)


@query("SELECT coalesce(source_role, '-') AS role, coalesce(lang, '-') AS lang, grouping(source_role, lang)::INT AS level, count(*) AS n FROM documents GROUP BY CUBE (source_role, lang)")
def q_facet_cube(spark: SparkSession, d: str) -> DataFrame:
    """Counts by role and language with all their totals."""
    return table(spark, d, "documents").cube("source_role", "lang").agg(F.grouping_id("source_role", "lang").cast("int").alias("level"), F.count("*").alias("n")).select(F.coalesce("source_role", F.lit("-")).alias("role"), F.coalesce("lang", F.lit("-")).alias("lang"), "level", "n")


# --- filters ----------------------------------------------------------------------------------------------------------


@query("SELECT record_id, tribunal FROM decisions WHERE situacao = 'vigente' AND tipo_documento = 'acordao'")
def q_filter_match(spark: SparkSession, d: str) -> DataFrame:
    """Equality; a row without a value doesn't match."""
    f = filters.Filter
    return table(spark, d, "decisions").where(f(["vigente"]).column(F.col("situacao")) & f(["acordao"]).column(F.col("tipo_documento"))).select("record_id", "tribunal")


@query("SELECT record_id FROM decisions WHERE tribunal IN ('TCU', 'STJ') AND list_has_any(assunto, ['Licitação', 'Reajuste'])")
def q_filter_any(spark: SparkSession, d: str) -> DataFrame:
    """Any of some values, of a field and of an array's entries."""
    f = filters.Filter
    return table(spark, d, "decisions").where(f(["TCU", "STJ"]).column(F.col("tribunal")) & f(["Licitação", "Reajuste"]).column(F.col("assunto"), True)).select("record_id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 20 AND l_shipdate >= DATE '1995-01-01'")
def q_filter_range(spark: SparkSession, d: str) -> DataFrame:
    """Bounds, pushed down to the scan."""
    f = filters.Filter(bounds={">=": 10, "<": 20})
    return table(spark, d, "lineitem").where(f.column(F.col("l_quantity")) & (F.col("l_shipdate") >= F.to_date(F.lit("1995-01-01")))).select("l_orderkey", "l_linenumber")


@query("SELECT record_id, situacao FROM decisions WHERE NOT coalesce(situacao IN ('superada', 'N/D'), false)")
def q_filter_must_not(spark: SparkSession, d: str) -> DataFrame:
    """Exclusion that keeps rows without a value."""
    return table(spark, d, "decisions").where(filters.none_of(F.col("situacao"), ["superada", "N/D"])).select("record_id", "situacao")


@query("SELECT doc_id FROM documents WHERE coalesce(lang = 'en', false) OR coalesce(source = 'atas-sessao', false) OR coalesce(n_chars > 5000, false)")
def q_filter_should(spark: SparkSession, d: str) -> DataFrame:
    """At least one of several conditions."""
    return table(spark, d, "documents").where(filters.any_of(F.col("lang") == "en", F.col("source") == "atas-sessao", F.col("n_chars") > 5000)).select("doc_id")


def _intervals(spark: SparkSession, d: str) -> DataFrame:
    """Orders as validity intervals: from the order's day to 90 days on; open where the status is O."""
    o = table(spark, d, "orders")
    start = F.date_format("o_orderdate", "yyyy-MM-dd")
    end = F.when(F.col("o_orderstatus") == "F", F.date_format(F.date_add(F.to_date("o_orderdate"), 90), "yyyy-MM-dd"))
    status = F.when(F.col("o_orderstatus") == "O", "open_end")
    return o.select("o_orderkey", D.validity(start, end, status).alias("v")).select("o_orderkey", F.col("v.from_day").alias("effective_from_day"), F.col("v.to_day").alias("effective_to_day"), F.col("v.status").alias("status"), F.col("v.error").alias("error"))


_INTERVALS_SQL = """
    iv AS (SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d')::INT AS effective_from_day,
             CASE WHEN o_orderstatus = 'O' THEN 99991231 WHEN o_orderstatus = 'F' THEN strftime(o_orderdate::DATE + 90, '%Y%m%d')::INT END AS effective_to_day,
             CASE WHEN o_orderstatus = 'O' THEN 'open_end' WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'unknown' END AS status FROM orders)"""


@query(f"WITH {_INTERVALS_SQL} SELECT o_orderkey, effective_from_day::VARCHAR AS from_day, effective_to_day::VARCHAR AS to_day, status, coalesce(NULL, '-') AS error FROM iv")
def q_effective_range(spark: SparkSession, d: str) -> DataFrame:
    """Validity as day numbers, with sentinels only for ends declared open."""
    return _intervals(spark, d).select("o_orderkey", F.col("effective_from_day").cast("string").alias("from_day"), F.col("effective_to_day").cast("string").alias("to_day"), "status", F.coalesce("error", F.lit("-")).alias("error"))


@query(f"WITH {_INTERVALS_SQL} SELECT o_orderkey FROM iv WHERE effective_from_day <= 19960615 AND effective_to_day >= 19960615")
def q_validity_point(spark: SparkSession, d: str) -> DataFrame:
    """In force on a day; unknown intervals never are."""
    return _intervals(spark, d).where(filters.valid_on(date(1996, 6, 15))).select("o_orderkey")


@query(f"WITH {_INTERVALS_SQL} SELECT o_orderkey FROM iv WHERE effective_from_day <= 19971231 AND effective_to_day >= 19970101")
def q_validity_overlap(spark: SparkSession, d: str) -> DataFrame:
    """In force on some day of a year."""
    return _intervals(spark, d).where(filters.valid_in(date(1997, 1, 1), date(1997, 12, 31))).select("o_orderkey")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d')::INT AS day FROM orders")
def q_date_key(spark: SparkSession, d: str) -> DataFrame:
    """Days as numbers."""
    return table(spark, d, "orders").select("o_orderkey", D.date_key(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"))


#: Questions about times beside the test set's: (id, text).
TIMES = [
    (-5, "o que valia em março de 2022"), (-4, "antes de 2021-04-01 e depois de maio de 2023"), (-3, "em 05/10/2020"), (-2, "durante 2019 e em 2024"), (-1, "lei 14.133, de 1º de abril de 2021"), (-6, "em 31/02/2021 e no ano de 2020"),
    (-7, "depois de 2020 e antes de 31/12/2019, na fevereiro de 2024"), (-8, "a 2021-04-30 e em 2021-04-30"),
]
_MONTHS_SQL = "['janeiro', 'fevereiro', 'marco', 'abril', 'maio', 'junho', 'julho', 'agosto', 'setembro', 'outubro', 'novembro', 'dezembro']"
_MONTH_RE = "(?:janeiro|fevereiro|marco|abril|maio|junho|julho|agosto|setembro|outubro|novembro|dezembro)"
_TIME_RES = {
    "a": rf"\b(?:antes|depois)\s+de\s+(?:20\d\d-\d{{1,2}}-\d{{1,2}}|\d{{1,2}}/\d{{1,2}}/20\d\d|{_MONTH_RE}\s+de\s+20\d\d|20\d\d)\b",
    "i": r"20\d\d-\d{1,2}-\d{1,2}", "d": r"\b\d{1,2}/\d{1,2}/20\d\d\b", "m": rf"\b(?:em|no|na|durante)\s+{_MONTH_RE}\s+de\s+20\d\d\b", "y": r"\b(?:em|no|na|durante|ano\s+de)\s+20\d\d\b",
}


def _times_sql() -> str:
    """CTEs up to ``found``: item_id, what: phrases, those of a kind taken out before the next kind is looked for."""
    steps = ["t_a AS (SELECT item_id, " + fold_sql("coalesce(query, '')") + " AS t FROM asked)"]
    for here, after in zip("aidmy", "idmyz", strict=True):
        steps.append(f"t_{after} AS (SELECT item_id, regexp_replace(t, '{_TIME_RES[here]}', '#', 'g') AS t FROM t_{here})")
    every = " UNION ALL ".join(f"SELECT item_id, unnest(regexp_extract_all(t, '{_TIME_RES[k]}')) AS what FROM t_{k}" for k in "aidmy")
    return ", ".join([*steps, f"found AS ({every})"])


@query(
    rf"""
    WITH asked AS (SELECT item_id, query FROM eval_items UNION ALL SELECT * FROM (VALUES {", ".join(f"({i}, '{q}')" for i, q in TIMES)}) AS x(item_id, query)), {_times_sql()},
    p AS (SELECT item_id, regexp_extract(what, '^(antes|depois)', 1) AS turn, regexp_extract(what, '(20\d\d)-(\d\d)-(\d\d)$', ['y', 'm', 'd']) AS i, regexp_extract(what, '(\d{{1,2}})/(\d{{1,2}})/(20\d\d)$', ['d', 'm', 'y']) AS b,
                 regexp_extract(what, '({_MONTH_RE})\s+de\s+(20\d\d)$', ['m', 'y']) AS n, regexp_extract(what, '\s(20\d\d)$', ['y']) AS y FROM found),
    w AS (SELECT item_id, turn, CASE WHEN i.y <> '' THEN try_cast(i.y || '-' || i.m || '-' || i.d AS DATE) WHEN b.y <> '' THEN try_cast(b.y || '-' || lpad(b.m, 2, '0') || '-' || lpad(b.d, 2, '0') AS DATE) END AS day,
                 CASE WHEN n.y <> '' THEN try_cast(n.y || '-' || lpad(list_position({_MONTHS_SQL}, n.m)::VARCHAR, 2, '0') || '-01' AS DATE) WHEN i.y = '' AND b.y = '' AND y.y <> '' THEN try_cast(y.y || '-01-01' AS DATE) END AS low,
                 CASE WHEN n.y <> '' THEN last_day(try_cast(n.y || '-' || lpad(list_position({_MONTHS_SQL}, n.m)::VARCHAR, 2, '0') || '-01' AS DATE)) WHEN i.y = '' AND b.y = '' AND y.y <> '' THEN try_cast(y.y || '-12-31' AS DATE) END AS high FROM p)
    SELECT DISTINCT item_id, CASE turn WHEN 'antes' THEN coalesce(day, low) - 1 WHEN 'depois' THEN coalesce(day, high) + 1 ELSE day END::VARCHAR AS "on", CASE WHEN turn = '' THEN low END::VARCHAR AS start, CASE WHEN turn = '' THEN high END::VARCHAR AS "end"
    FROM w WHERE day IS NOT NULL OR low IS NOT NULL
    """
)
def q_temporal_parse(spark: SparkSession, d: str) -> DataFrame:
    """Days and spans that questions name: the fixed test questions and some that compare times, read as on the driver for one."""
    asked = [(r["item_id"], r["query"] or "") for r in table(spark, d, "eval_items").select("item_id", "query").collect()] + TIMES
    rows = [(i, *(str(x) if x else None for x in (w.on, w.start, w.end))) for i, q in asked for w in filters.windows(q)]
    return spark.createDataFrame(rows, "item_id bigint, on string, start string, end string")


@query(
    "SELECT record_id, tribunal, tipo_documento FROM decisions WHERE tribunal IN ('TCU', 'TCESP') AND tipo_documento = 'acordao'"
)
def q_inline_filters(spark: SparkSession, d: str) -> DataFrame:
    """A question with inline filters made into one pushed predicate over the decisions."""
    plan = filters.plan("@tribunal=TCU,TCESP @tipo_documento=acordao o que diz a lei sobre reajuste")
    df = table(spark, d, "decisions")
    return df.where(plan.predicate(df)).select("record_id", "tribunal", "tipo_documento")


#: Questions beside the test set's, so that every rule meets one: (id, text).
QUESTIONS = [
    (-1, "O que mudou do regime anterior para a Lei 14.133?"), (-2, "Como era a dispensa à época da Lei 8.666/1993?"), (-3, "O manual de licitações do TCU explica a Lei 14.133/2021?"), (-4, "Segundo o Manual de Licitações, o que diz o TCU?"),
    (-5, "O que diz a Constituição paulista?"), (-6, "Segundo a Constituição, o que é dever da União?"), (-7, "constituição"), (-8, "Súmula do TCE-SP sobre reajuste"), (-9, "Decisões do Tribunal de Justiça de São Paulo e do STJ"),
    (-10, "Comparação do pregão na Lei 10.520/2002 e do RDC na Lei 12.462"), (-11, "vou aguardar a paulista"), (-12, "estava vigente antes de 2020?"),
]
_QUESTIONS_SQL = "asked AS (SELECT item_id, query FROM eval_items UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in QUESTIONS) + ") AS x(item_id, query)), low AS (SELECT item_id, " + fold_sql("coalesce(query, '')") + " AS q FROM asked)"


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").select("item_id", "query").unionByName(spark.createDataFrame(QUESTIONS, "item_id bigint, query string"))


def _holds_sql(marks: list[str]) -> str:
    return "(" + " OR ".join(f"contains(q, '{m}')" for m in marks) + ")"


_COMPARE_SQL = _holds_sql(["transicao", "regime anterior", "antes e depois", "diferenca entre", "diferencas entre", "comparar", "comparacao", "comparativo", "versus", " vs ", "em relacao", "o que mudou", "o que muda", "mudancas da nova lei", "mudancas entre"])
_PAST_SQL = _holds_sql(["historico", "historica", "a epoca", "naquela epoca", "era aplicavel", "estava vigente", "estava em vigor", "quando era aplicavel", "antes de", "depois de"])
_CROSS_SQL = "((contains(q, 'lei 14.133') OR contains(q, 'lei 14133') OR contains(q, '14.133/2021')) AND contains(q, 'manual de licitacoes') AND contains(q, 'tcu'))"


@query(f"WITH {_QUESTIONS_SQL} SELECT item_id, {_COMPARE_SQL} AS comparative, {_PAST_SQL} AS historical, {_CROSS_SQL} AS cross_source FROM low")
def q_query_flags(spark: SparkSession, d: str) -> DataFrame:
    """Marks of comparison, of the past and of two sources in questions, accents aside."""
    return _asked(spark, d).select("item_id", filters.inferred_columns(F.col("query")).alias("i")).select("item_id", "i.comparative", "i.historical", "i.cross_source")


@query(
    f"""
    WITH {_QUESTIONS_SQL}, w AS (SELECT *, ' ' || regexp_replace(q, '[^a-z0-9-]+', ' ', 'g') || ' ' AS words FROM low),
    j AS (SELECT *, len(list_filter(['uniao', 'federal', 'tcu', 'stf', 'stj', 'agu'], lambda x: contains(words, ' ' || x || ' '))) > 0 AS f, len(list_filter(['sao paulo', 'tcesp', 'tjsp', 'tce-sp', 'paulista'], lambda x: contains(words, ' ' || x || ' '))) > 0 AS s FROM w)
    SELECT item_id,
           CASE WHEN {_CROSS_SQL} THEN NULL WHEN {_holds_sql(['tcesp', 'tce-sp', 'tribunal de contas do estado de sao paulo'])} THEN 'tcesp' WHEN contains(q, 'tcu') THEN 'tcu' WHEN contains(q, 'stj') THEN 'stj' WHEN contains(q, 'stf') THEN 'stf'
                WHEN {_holds_sql(['tjsp', 'tribunal de justica de sao paulo'])} THEN 'tjsp' END AS tribunal,
           CASE WHEN {_holds_sql(['constituicao do estado de sao paulo', 'constituicao estadual de sao paulo', 'constituicao paulista'])} THEN 'sp-const' WHEN q = 'constituicao' OR {_holds_sql(['constituicao federal', 'segundo a constituicao'])} THEN 'cf1988'
                WHEN contains(q, 'manual de licitacoes') AND contains(q, 'tcu') AND NOT {_CROSS_SQL} THEN 'tcu-manual-licitacoes' END AS source_id,
           CASE WHEN f AND NOT s THEN 'federal' WHEN s AND NOT f THEN 'estadual_sp' END AS jurisdicao,
           concat_ws(',', CASE WHEN {_holds_sql(['lei 14.133', 'lei 14133', '14.133/2021'])} THEN 'lei_14133' END, CASE WHEN {_holds_sql(['lei 8.666', 'lei 8666', '8.666/1993'])} THEN 'lei_8666' END,
                     CASE WHEN {_holds_sql(['lei 10.520', 'lei 10520', '10.520/2002'])} THEN 'lei_10520' END, CASE WHEN {_holds_sql(['lei 12.462', 'lei 12462', '12.462/2011'])} THEN 'lei_12462' END) AS regimes
    FROM j
    """
)
def q_query_inferred(spark: SparkSession, d: str) -> DataFrame:
    """Filters that questions ask for in words: court, source, jurisdiction, regimes."""
    i = _asked(spark, d).select("item_id", filters.inferred_columns(F.col("query")).alias("i"))
    return i.select("item_id", "i.tribunal", "i.source_id", "i.jurisdicao", F.array_join("i.regimes", ",").alias("regimes"))


def terms_sql(c: str) -> str:
    """Distinct terms in order of first occurrence."""
    every = f"regexp_extract_all({fold_sql(c)}, '{X.TERM}')"
    return f"list_filter({every}, lambda t, i: list_position({every}, t) = i AND t NOT IN ({', '.join(repr(w) for w in X.TERM_STOPWORDS)}) AND NOT regexp_full_match(t, '[0-9]{{1,3}}') AND length(t) > 1)"


@query(f"SELECT item_id, array_to_string({terms_sql('query')}, ' ') AS terms, len({terms_sql('query')})::INT AS n FROM eval_items")
def q_query_terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms of the questions."""
    t = X.query_terms(F.col("query"))
    return table(spark, d, "eval_items").select("item_id", F.array_join(t, " ").alias("terms"), F.size(t).alias("n"))


_ASKED = "reajuste de preços, contrato e vinculação ao edital"


def hits_sql(c: str) -> str:
    words = f"' ' || regexp_replace({fold_sql(c)}, '[^a-z0-9./]+', ' ', 'g')"
    return f"len(list_filter({terms_sql(repr(_ASKED))}, lambda t: contains({words}, ' ' || t)))::INT"


@query(f"SELECT doc_id, {hits_sql('text')} AS hits FROM documents WHERE text IS NOT NULL")
def q_query_score(spark: SparkSession, d: str) -> DataFrame:
    """How many terms of a question begin a word of each document."""
    return table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", X.term_hits(X.query_terms(F.lit(_ASKED)), F.col("text")).alias("hits"))


@query(f"SELECT record_id FROM (SELECT record_id, {hits_sql('ementa')} AS h, len({terms_sql(repr(_ASKED))}) AS n FROM decisions WHERE ementa IS NOT NULL) WHERE h >= greatest(2, ceil(n / 2.0))")
def q_query_match(spark: SparkSession, d: str) -> DataFrame:
    """Decisions that hold at least half of a question's terms."""
    t = X.query_terms(F.lit(_ASKED))
    return table(spark, d, "decisions").where(F.col("ementa").isNotNull()).where(X.terms_match(t, X.term_hits(t, F.col("ementa")))).select("record_id")


@query(f"SELECT item_id, unnest(list_distinct(list_filter([trim(query), array_to_string(({terms_sql('query')})[1:2], ' ')] || {terms_sql('query')}, lambda x: length(x) > 0))) AS variant FROM eval_items")
def q_query_variants(spark: SparkSession, d: str) -> DataFrame:
    """Variants of each question: whole, first two terms, each term."""
    return table(spark, d, "eval_items").select("item_id", F.explode(X.query_variants(F.col("query"))).alias("variant"))


# --- acceptance -------------------------------------------------------------------------------------------------------

_SUBST = "len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: length(trim(x)) >= 40))"
_SHELL = " + ".join(f"contains({fold_sql(chr(99) + 'oalesce(text, ' + repr('') + ')')}, '{s}')::INT" for s in acceptance.SHELL)


@query(
    f"""
    SELECT doc_id, CASE WHEN length(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) < 800 THEN 'short' WHEN {_SUBST} < 6 THEN 'few lines'
        WHEN ({_SHELL}) >= 2 AND {_SUBST} <= 8 THEN 'shell' END AS reason, {_SUBST}::INT AS lines FROM documents
    """
)
def q_doc_validate(spark: SparkSession, d: str) -> DataFrame:
    """Why a document is rejected; null where it is accepted."""
    return table(spark, d, "documents").select("doc_id", acceptance.reject_reason(F.col("text"), F.lit(False)).alias("reason"), acceptance.substantive_lines(F.col("text")).alias("lines"))


@query("SELECT doc_id, round(CASE WHEN length(coalesce(text, '')) = 0 THEN 0 ELSE length(regexp_replace(text, '\\s', '', 'g')) / length(text) END, 6) AS density FROM documents")
def q_text_density(spark: SparkSession, d: str) -> DataFrame:
    """Share of characters that are no white space."""
    return table(spark, d, "documents").select("doc_id", F.round(acceptance.density(F.col("text")), 6).alias("density"))


@query(
    f"""
    SELECT doc_id FROM (SELECT doc_id, {fold_sql("coalesce(title, '')")} AS t, {fold_sql("coalesce(text, '')")} AS b FROM documents)
    WHERE contains(t, 'licitacao') OR contains(t, 'contrato') OR (contains(b, 'licitacao')::INT + contains(b, 'contrato')::INT >= 2 AND NOT contains(b, 'pregao'))
    """
)
def q_topic_match(spark: SparkSession, d: str) -> DataFrame:
    """Documents about a topic: in the title, or twice in the text without an excluded word."""
    return table(spark, d, "documents").where(acceptance.topic_match(F.col("title"), F.col("text"), ["licitacao", "contrato"], ["pregao"])).select("doc_id")


# --- gate -------------------------------------------------------------------------------------------------------------

_STOP = ", ".join(repr(w) for w in X.EVIDENCE_STOPWORDS)


def evidence_sql(c: str) -> str:
    return f"list_filter(list_distinct({tokens_sql(c)}), lambda t: t NOT IN ({_STOP}))"


def stem_sql(t: str) -> str:
    return "CASE " + " ".join(f"WHEN ends_with({t}, '{s}') AND length({t}) >= {len(s) + 4} THEN left({t}, length({t}) - {len(s)})" for s in X.STEM_SUFFIXES) + f" ELSE {t} END"


@query(f"SELECT item_id, array_to_string(list_sort({evidence_sql('answer')}), ' ') AS tokens FROM eval_items")
def q_gate_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of answers that carry evidence."""
    return table(spark, d, "eval_items").select("item_id", F.array_join(F.array_sort(X.evidence_tokens(F.col("answer"))), " ").alias("tokens"))


@query(f"SELECT item_id, array_to_string(list_sort(list_distinct(list_transform({evidence_sql('answer')}, lambda t: {stem_sql('t')}))), ' ') AS stems FROM eval_items")
def q_gate_stems(spark: SparkSession, d: str) -> DataFrame:
    """Stems of the tokens of answers."""
    return table(spark, d, "eval_items").select("item_id", F.array_join(F.array_sort(X.evidence_stems(F.col("answer"))), " ").alias("stems"))


@query(
    f"""
    WITH e AS (SELECT item_id, {evidence_sql('answer')} AS a, {evidence_sql('passage')} AS b FROM eval_items),
    s AS (SELECT item_id, a, b, list_distinct(list_transform(a, lambda t: {stem_sql('t')})) AS sa, list_distinct(list_transform(b, lambda t: {stem_sql('t')})) AS sb FROM e)
    SELECT item_id, round(len(list_intersect(a, b)) / len(a), 6) AS direct, round(len(list_intersect(sa, sb)) / len(sa), 6) AS stems, len(list_intersect(sa, sb))::INT AS shared FROM s
    """
)
def q_gate_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Shares of an answer's tokens and stems that its passage holds."""
    o = gate.overlap(F.col("answer"), F.col("passage"))
    return table(spark, d, "eval_items").select("item_id", F.round(o["direct"], 6).alias("direct"), F.round(o["stems"], 6).alias("stems"), o["shared"].alias("shared"))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers with citations: of the passage, of a source that isn't there, or none, by the case's type."""
    items = table(spark, d, "eval_items")
    mark = F.when(F.col("case_type") == "false_premise", "").when(F.col("case_type") == "uncited", "").when(F.col("case_type") == "out_of_corpus", " [F7]").otherwise(" 【 F1 】")
    return items.select("item_id", "expected_accept", F.concat(F.coalesce("answer", F.lit("")), mark).alias("answer"), F.array("passage", "query").alias("sources"))


@query(
    """
    SELECT item_id, coalesce(answer, '') || CASE WHEN case_type IN ('false_premise', 'uncited') THEN '' WHEN case_type = 'out_of_corpus' THEN ' [F7]' ELSE ' [F1]' END AS answer,
           CASE WHEN case_type IN ('false_premise', 'uncited') THEN '' WHEN case_type = 'out_of_corpus' THEN '7' ELSE '1' END AS cited FROM eval_items
    """
)
def q_gate_citations(spark: SparkSession, d: str) -> DataFrame:
    """Citations of answers in their normal form."""
    a = _answers(spark, d)
    n = gate.normal_answer(F.col("answer"))
    return a.select("item_id", n.alias("answer"), F.array_join(F.transform(gate.citations(n), lambda x: x.cast("string")), ",").alias("cited"))


_FREE, _COMPARING = (", ".join(repr(w) for w in ws) for ws in (gate.FREE, gate.COMPARATIVE))
_CITE = r"(?:\[|【|\()\s*[Ff](\d+)\s*(?:\]|】|\))"


def _key_of(c: str) -> str:
    return f"regexp_replace({fold_sql(c)}, '[^a-z0-9]+', '', 'g')"


def _strip(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace({c}, '{_CITE}', '', 'g'), '^[ .,:;-]+|[ .,:;-]+$', '', 'g'))"


_IDENTIFIERS_SQL = "list_concat(list_concat(" + "), ".join(f"regexp_extract_all(claim, '{p}'" for p in (r"(?i)\blei\s+(?:n[ºo.]*\s*)?\d+[.]?\d*(?:/\d{4})?", r"(?i)\bart(?:igo)?[.]?\s*\d+[A-Za-z-]*(?:\s*,?\s*§\s*\d+[ºo]?)?")) + r")), regexp_extract_all(claim, '\b\d{1,7}[/-]\d{1,7}(?:[/-]\d{2,4})?\b'))"
#: CTEs up to ``verdicts``: item_id, expected_accept, reason; the gate's rules one after the other.
_VERDICT_SQL = rf"""
    raw AS (SELECT item_id, expected_accept, coalesce(answer, '') || CASE WHEN case_type IN ('false_premise', 'uncited') THEN '' WHEN case_type = 'out_of_corpus' THEN ' [F7]' ELSE ' 【 F1 】' END AS t, passage, query FROM eval_items),
    n AS (SELECT * REPLACE (regexp_replace(regexp_replace(regexp_replace(trim(t), '{_CITE}', '[F\1]', 'g'), '[ \t\r]*\n\s*', chr(10), 'g'), '(\S)\n((?:[ \t]*\[F\d+\])+[ \t]*)(\n|$)', '\1 \2\3', 'g') AS t) FROM raw),
    c AS (SELECT *, list_distinct(list_transform(regexp_extract_all(t, '{_CITE}', 1), lambda x: x::INT)) AS nos, {evidence_sql('t')} AS words FROM n),
    l AS (SELECT item_id, passage, query, unnest(string_split_regex(t, '\n+')) AS line, generate_subscripts(string_split_regex(t, '\n+'), 1) AS k FROM c),
    f AS (SELECT item_id, k, line, {_strip('line')} AS claim, list_distinct(list_transform(regexp_extract_all(line, '{_CITE}', 1), lambda x: x::INT)) AS nos, passage, query FROM l WHERE length(trim(line)) > 0),
    g AS (SELECT *, {evidence_sql('claim')} AS w, array_to_string(list_transform(list_sort(nos), lambda i: coalesce(([passage, query])[i], '')), ' ') AS cited FROM f),
    h AS (SELECT *, {evidence_sql('cited')} AS cw, len(list_filter([{_COMPARING}], lambda m: contains({fold_sql('claim')}, m))) > 0 AND len(list_filter([{_COMPARING}], lambda m: contains({fold_sql('cited')}, m))) = 0 AS compares,
                 len(list_filter({_IDENTIFIERS_SQL}, lambda i: NOT contains({_key_of('cited')}, {_key_of('i')}))) > 0 AS unknown FROM g),
    s AS (SELECT *, list_distinct(list_transform(w, lambda t: {stem_sql('t')})) AS sw, list_distinct(list_transform(cw, lambda t: {stem_sql('t')})) AS sc FROM h),
    faults AS (SELECT item_id, k, CASE
                 WHEN regexp_matches(line, '^\s*(#{{1,6}}\s.*|\*\*[^*]+\*\*:?|__[^_]+__:?|[-*_=]{{3,}})\s*$') THEN NULL
                 WHEN len(nos) = 0 THEN CASE WHEN len(list_filter(w, lambda x: x NOT IN ({_FREE}))) > 0 THEN 'uncited' END
                 WHEN compares THEN 'comparison' WHEN unknown THEN 'identifier'
                 WHEN len(w) >= 3 AND len(list_intersect(w, cw)) / len(w) < 0.25 AND NOT (len(list_intersect(sw, sc)) >= 2 AND len(list_intersect(sw, sc)) / len(sw) >= 0.20) THEN 'overlap' END AS fault FROM s),
    first_fault AS (SELECT item_id, arg_min(fault, k) AS fault FROM faults WHERE fault IS NOT NULL GROUP BY 1),
    verdicts AS (SELECT c.item_id, c.expected_accept, CASE WHEN length(t) = 0 THEN 'empty' WHEN len(nos) = 0 THEN CASE WHEN len(words) > 0 THEN 'no citation' END
                 WHEN len(list_filter(nos, lambda i: i < 1 OR i > 2)) > 0 THEN 'out of range' ELSE fault END AS reason FROM c LEFT JOIN first_fault USING (item_id))"""


@query(f"WITH {_VERDICT_SQL} SELECT item_id, reason FROM verdicts")
def q_gate_verdict(spark: SparkSession, d: str) -> DataFrame:
    """The gate's verdict on every answer."""
    return _answers(spark, d).select("item_id", gate.verdict(F.col("answer"), F.col("sources")).alias("reason"))


@query(
    f"""
    WITH {_VERDICT_SQL}, v AS (SELECT expected_accept AS e, reason IS NULL AS a FROM verdicts WHERE expected_accept IS NOT NULL)
    SELECT count(*) AS cases, avg((e = a)::INT) AS accuracy, avg((NOT a)::INT) FILTER (NOT e) AS correct_rejection, avg(a::INT) FILTER (NOT e) AS false_accept, avg(a::INT) FILTER (e) AS correct_acceptance, avg((NOT a)::INT) AS observed_rejection FROM v
    """
)
def q_gate_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates of the gate over all answers."""
    v = _answers(spark, d).select("expected_accept", gate.verdict(F.col("answer"), F.col("sources")).isNull().alias("accepted")).where(F.col("expected_accept").isNotNull())
    return evaluation.gate_rates(v)


# --- evaluation -------------------------------------------------------------------------------------------------------


def _rankings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Ten nearest of each query vector (not itself), and its own label as what is expected."""
    got = _dense(spark, d, 10, exclude_self=True).select(F.col("query_id").alias("case_id"), "rank", F.col("label").cast("string").alias("source"))
    cases = _vectors(spark, d).where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("case_id"), F.array(F.col("label").cast("string")).alias("expected"))
    return got, cases


_RANK_SQL = f"{dense_sql(10, True)}, r AS (SELECT d.query_id AS case_id, d.rank, d.label = v.label AS hit FROM dense d JOIN v ON v.vec_id = d.query_id)"


@query(f"WITH {_RANK_SQL} SELECT case_id, max((hit AND rank <= 1)::INT)::DOUBLE AS recall_1, max((hit AND rank <= 5)::INT)::DOUBLE AS recall_5, max(hit::INT)::DOUBLE AS recall_10 FROM r GROUP BY 1")
def q_recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    """Share of expected sources among the first k."""
    return evaluation.case_metrics(*_rankings(spark, d), [1, 5, 10]).select("case_id", "recall_1", "recall_5", "recall_10")


@query(f"WITH {_RANK_SQL} SELECT case_id, round(coalesce(1.0 / min(rank) FILTER (hit), 0), 6) AS reciprocal_rank FROM r GROUP BY 1")
def q_mrr(spark: SparkSession, d: str) -> DataFrame:
    """Reciprocal rank of the first expected source."""
    return evaluation.case_metrics(*_rankings(spark, d), [10]).select("case_id", F.round("reciprocal_rank", 6).alias("reciprocal_rank"))


@query(f"WITH {_RANK_SQL} SELECT case_id, round(sum(CASE WHEN hit THEN 1 / log2(rank + 1) ELSE 0 END), 6) AS ndcg_raw_10, round(coalesce(1 / log2(min(rank) FILTER (hit) + 1), 0), 6) AS ndcg_10 FROM r GROUP BY 1")
def q_ndcg(spark: SparkSession, d: str) -> DataFrame:
    """Discounted gain against the ideal, by point and by distinct source."""
    return evaluation.case_metrics(*_rankings(spark, d), [10]).select("case_id", F.round("ndcg_raw_10", 6).alias("ndcg_raw_10"), F.round("ndcg_10", 6).alias("ndcg_10"))


@query(f"WITH {_RANK_SQL} SELECT case_id, round(avg((NOT hit)::INT), 6) AS fp_rate_10 FROM r GROUP BY 1")
def q_fp_rate(spark: SparkSession, d: str) -> DataFrame:
    """Share of the first ten that isn't expected."""
    return evaluation.case_metrics(*_rankings(spark, d), [10]).select("case_id", F.round("fp_rate_10", 6).alias("fp_rate_10"))


@query(
    f"""WITH {_RANK_SQL}, m AS (SELECT case_id, coalesce(1.0 / min(rank) FILTER (hit), 0) AS rr, max(hit::INT) AS rc FROM r GROUP BY 1)
    SELECT count(*) AS cases, round(avg(rr), 6) AS reciprocal_rank, round(avg(rc), 6) AS recall_10 FROM m"""
)
def q_eval_summary(spark: SparkSession, d: str) -> DataFrame:
    """Means over the cases."""
    s = evaluation.summary(evaluation.case_metrics(*_rankings(spark, d), [10]))
    return s.select("cases", F.round("reciprocal_rank", 6).alias("reciprocal_rank"), F.round("recall_10", 6).alias("recall_10"))


def _item_cases(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Ten best documents of each question by their sources and what these tell, and its item as the case."""
    told = table(spark, d, "documents").select("doc_id", "source", metadata.source_rules(F.col("source"))["jurisdicao"].alias("jurisdicao"))
    got = _bm25(spark, d, k=10).join(told, "doc_id").select(F.col("query_id").alias("case_id"), "rank", "source", "jurisdicao")
    cases = table(spark, d, "eval_items").where(F.col("item_id") % 20 == 0).select(F.col("item_id").alias("case_id"), F.col("expected_source_ids").alias("expected"), "expected_jurisdicao")
    return got, cases


@query(
    f"""
    WITH {bm25_sql(k=10)},
    r AS (SELECT query_id AS case_id, rank, source, ({rules_sql('lower(source)')}).jurisdicao AS jurisdicao FROM sparse JOIN documents USING (doc_id)),
    j AS (SELECT e.item_id AS case_id, e.expected_source_ids AS expected, e.expected_jurisdicao, r.rank, r.source, r.jurisdicao, list_contains(e.expected_source_ids, r.source) AS hit
          FROM eval_items e LEFT JOIN r ON r.case_id = e.item_id WHERE e.item_id % 20 = 0)
    SELECT case_id, round(count(DISTINCT source) FILTER (hit) / len(list_distinct(any_value(expected)))::DOUBLE, 6) AS recall_10, round(coalesce(1.0 / min(rank) FILTER (hit), 0), 6) AS reciprocal_rank,
           coalesce(bool_or(hit) FILTER (rank = 1), false) AS regime_correct,
           CASE WHEN len(any_value(expected_jurisdicao)) > 0 THEN coalesce(bool_or(list_contains(expected_jurisdicao, jurisdicao)) FILTER (rank = 1), false) END AS jurisdiction_correct, count(rank) = 0 AS retrieval_rejected
    FROM j GROUP BY 1
    """
)
def q_case_metrics(spark: SparkSession, d: str) -> DataFrame:
    """What is right of the search for each question of the evaluation."""
    m = evaluation.case_metrics(*_item_cases(spark, d), [10])
    return m.select("case_id", F.round("recall_10", 6).alias("recall_10"), F.round("reciprocal_rank", 6).alias("reciprocal_rank"), "regime_correct", "jurisdiction_correct", "retrieval_rejected")


_REFS_SQL = """
    n AS (SELECT DISTINCT doc_id, edition, node_id, ref, source_start FROM legal_nodes WHERE kind = 'artigo'),
    r AS (SELECT doc_id || '@' || edition AS case_id, trim(CASE WHEN source_start % 5 = 0 THEN ' ' ELSE ref END) AS ref, row_number() OVER (PARTITION BY doc_id, edition ORDER BY source_start, node_id) AS rank FROM n),
    c AS (SELECT doc_id || '@' || edition AS case_id, list_distinct(list(trim(ref)) FILTER (source_start % 3 = 0 AND length(trim(ref)) > 0)) AS e FROM n GROUP BY 1)"""


@query(
    f"""
    WITH {_REFS_SQL}, j AS (SELECT c.case_id, c.e, r.rank, coalesce(r.ref, '') AS ref FROM c LEFT JOIN r ON r.case_id = c.case_id AND r.rank <= 5)
    SELECT case_id, round(CASE WHEN len(any_value(e)) > 0 THEN count(DISTINCT ref) FILTER (list_contains(e, ref) AND length(ref) > 0) / len(any_value(e))::DOUBLE END, 6) AS recall_5,
           round(CASE WHEN len(any_value(e)) > 0 THEN avg((length(ref) > 0 AND NOT list_contains(e, ref))::INT) END, 6) AS fp_rate_5 FROM j GROUP BY 1
    """
)
def q_article_recall(spark: SparkSession, d: str) -> DataFrame:
    """Of the articles expected of each edition (every third by its place), those among the first five; some points have no reference."""
    n = table(spark, d, "legal_nodes").where(F.col("kind") == "artigo").select(F.concat_ws("@", "doc_id", F.col("edition").cast("string")).alias("case_id"), "node_id", "ref", "source_start").distinct()
    w = Window.partitionBy("case_id").orderBy("source_start", "node_id")  # the articles of one edition
    ranked = n.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 5)
    points = ranked.select("case_id", "rank", evaluation.device_key(F.when(F.col("source_start") % 5 != 0, F.col("ref")), F.lit(" ")).alias("ref"))
    cases = n.groupBy("case_id").agg(F.collect_set(F.when(F.col("source_start") % 3 == 0, F.col("ref"))).alias("expected"))
    m = evaluation.reference_metrics(points, cases, [5])
    return m.select("case_id", F.round("recall_5", 6).alias("recall_5"), F.round("fp_rate_5", 6).alias("fp_rate_5"))


@query(
    """
    SELECT item_id, array_to_string(list_filter([
        CASE WHEN case_id IS NULL THEN 'case_id' END, CASE WHEN query IS NULL THEN 'query' END, CASE WHEN expected_source_ids IS NULL THEN 'expected_source_ids' END,
        CASE WHEN len(expected_source_ids) = 0 THEN 'no source expected' END, CASE WHEN len(expected_jurisdicao) > list_count(expected_jurisdicao) THEN 'expected_jurisdicao: type' END,
        CASE WHEN case_id IS NOT NULL AND count(*) OVER (PARTITION BY case_id) > 1 THEN 'duplicate' END], lambda x: x IS NOT NULL), ',') AS faults FROM eval_items
    """
)
def q_case_faults(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with each case of the evaluation."""
    return evaluation.case_faults(table(spark, d, "eval_items"), expected="expected_source_ids").select("item_id", F.array_join("faults", ",").alias("faults"))


@query(
    """
    SELECT item_id, array_to_string(list_filter([
        CASE WHEN case_id IS NULL THEN 'case_id' END, CASE WHEN answer IS NULL THEN 'answer' END, CASE WHEN expected_accept IS NULL THEN 'expected_accept' END,
        CASE WHEN coalesce(passage, '') = '' OR coalesce(query, '') = '' THEN 'source without text' END,
        CASE WHEN case_id IS NOT NULL AND count(*) OVER (PARTITION BY case_id) > 1 THEN 'duplicate' END], lambda x: x IS NOT NULL), ',') AS faults FROM eval_items
    """
)
def q_gate_case_faults(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with each case of the gate; its sources are the passage and the question."""
    items = table(spark, d, "eval_items").withColumn("sources", F.array("passage", "query"))
    return evaluation.gate_case_faults(items).select("item_id", F.array_join("faults", ",").alias("faults"))


@query(f"WITH {_INTERVALS_SQL} SELECT o_orderkey, CASE WHEN effective_to_day IS NOT NULL THEN effective_from_day <= 19951231 AND effective_to_day >= 19950101 END AS matches FROM iv")
def q_temporal_match(spark: SparkSession, d: str) -> DataFrame:
    """Whether an interval meets a span; null where it is unknown."""
    none = F.lit(None).cast("int")
    return _intervals(spark, d).select("o_orderkey", evaluation.temporal_match(none, F.lit(19950101), F.lit(19951231), F.col("effective_from_day"), F.col("effective_to_day")).alias("matches"))


# --- records ----------------------------------------------------------------------------------------------------------

_SQ = lambda c: f"coalesce(trim(regexp_replace({c}, '\\s+', ' ', 'g')), '')"
_URL = "regexp_replace(url_oficial, '(?i);jsessionid=[^?#]*', '')"
_KEY_SQL = (
    "left(sha256(concat_ws('|', "
    + ", ".join(_SQ(c) for c in ("tribunal", "tipo_documento", "numero_processo", "numero_sumula", "numero_decisao", "tipo_decisao"))
    + f", CASE WHEN length({_SQ('numero_decisao')}) = 0 THEN left({_SQ('ementa')}, 800) END, CASE WHEN length({_SQ('numero_processo')}) = 0 THEN regexp_replace({_SQ('url_oficial')}, '(?i);jsessionid=[^?#]*', '') END)), 20)"
)


@query(f"SELECT record_id, {_KEY_SQL} AS document_key FROM decisions")
def q_document_key(spark: SparkSession, d: str) -> DataFrame:
    """Key of every record."""
    df = table(spark, d, "decisions")
    return df.select("record_id", records.document_key(df).alias("document_key"))


@query(
    r"SELECT record_id, sha256(to_json({'assunto': assunto, 'decisao': decisao, 'ementa': ementa, 'inteiro_teor': inteiro_teor, 'relator': relator, 'tese': tese, 'url_oficial': regexp_replace(url_oficial, '(?i);jsessionid=[^?#]*', '')})) AS version FROM decisions"
)
def q_version_hash(spark: SparkSession, d: str) -> DataFrame:
    """Hash of every record's content."""
    df = table(spark, d, "decisions")
    return df.select("record_id", records.version_hash(df, ["ementa", "tese", "decisao", "inteiro_teor", "url_oficial", "relator", "assunto"]).alias("version"))


@query("SELECT record_id, coalesce(nullif(trim(ementa), ''), nullif(trim(tese), ''), nullif(trim(decisao), '')) AS summary, coalesce(nullif(trim(numero_decisao), ''), nullif(trim(numero_sumula), '')) AS number FROM decisions")
def q_alias_coalesce(spark: SparkSession, d: str) -> DataFrame:
    """Canonical columns from the first filled of their aliases."""
    df = table(spark, d, "decisions")
    return records.alias_values(df, {"record_id": ["record_id"], "summary": ["resumo", "ementa", "tese", "decisao"], "number": ["numero_decisao", "numero_sumula"]}).withColumn("record_id", F.col("record_id").cast("bigint"))


@query(
    """
    SELECT record_id, array_to_string(list_filter([
        CASE WHEN NOT coalesce(upper(trim(tribunal)) IN ('TCU', 'TCESP', 'STJ', 'STF', 'TJSP'), false) THEN 'tribunal' END,
        CASE WHEN NOT coalesce(tipo_documento = 'sumula', false) AND length(trim(coalesce(numero_processo, ''))) = 0 THEN 'numero_processo' END,
        CASE WHEN coalesce(tipo_documento = 'sumula', false) AND NOT coalesce(regexp_full_match(numero_sumula, '[0-9]+'), false) THEN 'numero_sumula' END,
        CASE WHEN length(trim(coalesce(url_oficial, ''))) > 0 AND NOT regexp_matches(url_oficial, '^https?://') THEN 'url_oficial' END], lambda x: x IS NOT NULL), ',') AS faults FROM decisions
    """
)
def q_record_validate(spark: SparkSession, d: str) -> DataFrame:
    """Everything wrong with each record."""
    df = table(spark, d, "decisions")
    return df.select("record_id", F.array_join(records.faults(df), ",").alias("faults"))


def _label_sql(name: str, c: str, part: bool = False) -> str:
    head = f"chr(10) || '{name}:' || chr(10)" if part else f"'{name}: '"
    return f"CASE WHEN length(trim(coalesce({c}, ''))) > 0 THEN {head} || trim({c}) END"


_LABELS_SQL = ", ".join(
    [_label_sql(n, c) for n, c in (("TRIBUNAL", "tribunal"), ("PROCESSO", "numero_processo"), ("SÚMULA", "numero_sumula"), ("DECISÃO Nº", "numero_decisao"), ("RELATOR", "relator"), ("ÓRGÃO", "orgao_julgador"), ("SITUAÇÃO", "situacao"))]
    + [_label_sql(n, c, True) for n, c in (("EMENTA", "ementa"), ("TESE", "tese"), ("DECISÃO", "decisao"), ("INTEIRO TEOR", "inteiro_teor"))]
)


@query(
    f"""
    WITH t AS (SELECT record_id, concat_ws(chr(10), {_LABELS_SQL}) AS t FROM decisions)
    SELECT record_id, length(t)::INT AS n_chars, sha256(t) AS sha256 FROM t
    """
)
def q_index_text(spark: SparkSession, d: str) -> DataFrame:
    """Records as labelled text, by its hash and length."""
    df = table(spark, d, "decisions")
    t = records.index_text(df)
    return df.select("record_id", F.length(t).alias("n_chars"), F.sha2(t, 256).alias("sha256"))


@query(
    "SELECT numero_processo, arg_min(record_id, record_id) AS record_id, arg_min(tribunal, record_id) AS tribunal FROM decisions GROUP BY numero_processo"
)
def q_dedup_first(spark: SparkSession, d: str) -> DataFrame:
    """The first row of each key; an aggregation, as one key may hold much of the table."""
    return records.keep_best(table(spark, d, "decisions").select("numero_processo", "record_id", "tribunal"), ["numero_processo"], F.struct("record_id")).select("numero_processo", "record_id", "tribunal")


@query("SELECT numero_sumula, max(record_id) AS record_id FROM decisions WHERE regexp_full_match(numero_sumula, '[0-9]+') GROUP BY 1")
def q_dedup_last(spark: SparkSession, d: str) -> DataFrame:
    """The last row of each number."""
    df = table(spark, d, "decisions").where(records.sumula_number(F.col("numero_sumula")).isNotNull()).select("numero_sumula", "record_id")
    return records.keep_best(df, ["numero_sumula"], F.struct((-F.col("record_id")).alias("o"))).select("numero_sumula", "record_id")


@query("SELECT tribunal, record_id, row_number() OVER (PARTITION BY tribunal ORDER BY retrieved_at, record_id)::INT AS place FROM decisions QUALIFY place <= 200")
def q_group_cap(spark: SparkSession, d: str) -> DataFrame:
    """At most 200 records of a court, the limit of a collection."""
    return records.group_cap(table(spark, d, "decisions").select("tribunal", "record_id", "retrieved_at"), ["tribunal"], [F.col("retrieved_at").asc_nulls_last(), F.col("record_id")], 200).select("tribunal", "record_id", "place")


@query("SELECT regexp_replace(lower(regexp_extract(url_oficial, '^[A-Za-z]+://([^/:;?#]+)', 1)), '^www\\.', '') AS host, min(record_id) AS record_id FROM decisions WHERE url_oficial IS NOT NULL GROUP BY 1")
def q_domain_first(spark: SparkSession, d: str) -> DataFrame:
    """The first record of each host."""
    return table(spark, d, "decisions").where(F.col("url_oficial").isNotNull()).groupBy(X.host(F.col("url_oficial")).alias("host")).agg(F.min("record_id").alias("record_id"))


@query("SELECT tipo_documento, record_id, row_number() OVER (PARTITION BY tipo_documento ORDER BY record_id)::INT AS turn FROM decisions WHERE tipo_documento IS NOT NULL")
def q_interleave(spark: SparkSession, d: str) -> DataFrame:
    """Rows of several arms in turn."""
    df = table(spark, d, "decisions").where(F.col("tipo_documento").isNotNull()).select("tipo_documento", "record_id")
    return records.interleave(df, "tipo_documento", [F.col("record_id")])


@query("SELECT tribunal, count(*) AS n FROM decisions GROUP BY 1 HAVING count(*) < 150")
def q_too_few(spark: SparkSession, d: str) -> DataFrame:
    """Courts with fewer records than asked for."""
    return records.too_few(table(spark, d, "decisions"), "tribunal", 150)


_COURT_SQL = """CASE upper(strip_accents(trim(tribunal)))
        WHEN 'TRIBUNAL DE CONTAS DA UNIAO' THEN 'TCU' WHEN 'TCE-SP' THEN 'TCESP' WHEN 'TCE SP' THEN 'TCESP' WHEN 'TRIBUNAL DE CONTAS DO ESTADO DE SAO PAULO' THEN 'TCESP'
        WHEN 'SUPERIOR TRIBUNAL DE JUSTICA' THEN 'STJ' WHEN 'SUPREMO TRIBUNAL FEDERAL' THEN 'STF' WHEN 'TJ-SP' THEN 'TJSP' WHEN 'TRIBUNAL DE JUSTICA DE SAO PAULO' THEN 'TJSP' ELSE upper(trim(tribunal)) END"""
_NORMAL_SQL = f"(SELECT * REPLACE ({_COURT_SQL} AS tribunal) FROM decisions)"


@query(ORACLES["q_record_validate"].replace("FROM decisions", f"FROM {_NORMAL_SQL}"))
def q_normal_validate(spark: SparkSession, d: str) -> DataFrame:
    """Everything wrong with each record once it is normalised."""
    df = records.normalized(table(spark, d, "decisions"))
    return df.select("record_id", F.array_join(records.faults(df), ",").alias("faults"))


@query(f"SELECT record_id, {_KEY_SQL} AS document_key FROM {_NORMAL_SQL}")
def q_normal_key(spark: SparkSession, d: str) -> DataFrame:
    """Key of every record, the same for all spellings of its court."""
    df = records.normalized(table(spark, d, "decisions"))
    return df.select("record_id", records.document_key(df).alias("document_key"))


@query(ORACLES["q_group_cap"].replace("FROM decisions", f"FROM {_NORMAL_SQL}"))
def q_normal_cap(spark: SparkSession, d: str) -> DataFrame:
    """At most 200 records of a court, whatever its spellings."""
    df = records.normalized(table(spark, d, "decisions").select("tribunal", "record_id", "retrieved_at"))
    return records.group_cap(df, ["tribunal"], [F.col("retrieved_at").asc_nulls_last(), F.col("record_id")], 200).select("tribunal", "record_id", "place")


@query(ORACLES["q_too_few"].replace("FROM decisions", f"FROM {_NORMAL_SQL}"))
def q_normal_too_few(spark: SparkSession, d: str) -> DataFrame:
    """Courts with fewer records than asked for, whatever their spellings."""
    return records.too_few(records.normalized(table(spark, d, "decisions").select("tribunal")), "tribunal", 150)


@query("SELECT record_id, trim(p) AS part FROM (SELECT record_id, unnest(regexp_split_to_array(decisao, '[;\\n|,]+')) AS p FROM decisions WHERE decisao IS NOT NULL) WHERE length(trim(p)) > 0")
def q_list_split(spark: SparkSession, d: str) -> DataFrame:
    """Lists written in one text, as rows."""
    return table(spark, d, "decisions").where(F.col("decisao").isNotNull()).select("record_id", F.explode(X.split_list(F.regexp_replace("decisao", ",", ";"))).alias("part"))


@query(
    r"""
    WITH d AS (SELECT record_id, unnest([data, data_publicacao]) AS v, unnest([1, 2]) AS f FROM decisions),
    m AS (SELECT record_id, f, regexp_extract(v, '(?:^|[^0-9])(\d{4})[-/](\d{1,2})[-/](\d{1,2})(?:[^0-9]|$)', ['y', 'm', 'd']) AS a, regexp_extract(v, '(?:^|[^0-9])(\d{1,2})/(\d{1,2})/(\d{4})(?:[^0-9]|$)', ['d', 'm', 'y']) AS b,
                 regexp_extract(v, '(?i)(\d{1,2})º?\s+de\s+([a-zç]{3,9})\s+de\s+(\d{4})', ['d', 'm', 'y']) AS c, regexp_extract(v, '(?i)(\d{1,2})\.([a-zç]{3})[a-zç]*\.(\d{4})', ['d', 'm', 'y']) AS e, regexp_extract(v, '(?i)(\d{4})-([a-zç]{3})-(\d{1,2})', ['y', 'm', 'd']) AS g FROM d),
    n AS (SELECT record_id, f, a, b, [c, e, {'d': g.d, 'm': g.m, 'y': g.y}] AS named FROM m),
    r AS (SELECT record_id, f, coalesce(try_cast(a.y || '-' || lpad(a.m, 2, '0') || '-' || lpad(a.d, 2, '0') AS DATE), try_cast(b.y || '-' || lpad(b.m, 2, '0') || '-' || lpad(b.d, 2, '0') AS DATE),
          list_filter(list_transform(named, lambda x: try_cast(x.y || '-' || lpad(nullif(list_position(['jan', 'fev', 'mar', 'abr', 'mai', 'jun', 'jul', 'ago', 'set', 'out', 'nov', 'dez'], left(lower(strip_accents(x.m)), 3)), 0)::VARCHAR, 2, '0') || '-' || lpad(x.d, 2, '0') AS DATE)), lambda z: z IS NOT NULL)[1]) AS day FROM n)
    SELECT record_id, strftime(max(day) FILTER (f = 1), '%Y-%m-%d') AS data, strftime(max(day) FILTER (f = 2), '%Y-%m-%d') AS publicacao FROM r GROUP BY 1
    """
)
def q_web_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dates as pages write them."""
    return table(spark, d, "decisions").select("record_id", D.web_date(F.col("data")).cast("string").alias("data"), D.web_date(F.col("data_publicacao")).cast("string").alias("publicacao"))


# --- index ------------------------------------------------------------------------------------------------------------


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The current index (documents loaded before 2024) and what comes in (collected since 2023)."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars", "loaded_at", "collected_at")
    cols = ["doc_id", "source", "lang", "n_chars"]
    return docs.where(F.col("loaded_at") < F.lit("2024-01-01").cast("timestamp")).select(*cols), docs.where(F.col("collected_at") >= F.lit("2023-01-01").cast("timestamp")).select("doc_id", "source", "lang", (F.col("n_chars") + 1).alias("n_chars"))


_CUR = "cur AS (SELECT doc_id, source, lang, n_chars FROM documents WHERE loaded_at < TIMESTAMP '2024-01-01'), new AS (SELECT doc_id, source, lang, n_chars + 1 AS n_chars FROM documents WHERE collected_at >= TIMESTAMP '2023-01-01')"


@query(f"WITH {_CUR} SELECT * FROM cur WHERE doc_id NOT IN (SELECT doc_id FROM new) UNION ALL SELECT * FROM new")
def q_merge_replace(spark: SparkSession, d: str) -> DataFrame:
    """An index after a merge: documents replaced whole, new ones added."""
    return index.replace_documents(*_halves(spark, d))


@query(f"WITH {_CUR} SELECT doc_id FROM cur EXCEPT SELECT doc_id FROM new")
def q_prune_stale(spark: SparkSession, d: str) -> DataFrame:
    """Indexed documents that are no longer active."""
    return index.stale(*_halves(spark, d))


@query(f"WITH {_CUR} SELECT new.* FROM new LEFT JOIN cur USING (doc_id) WHERE cur.doc_id IS NULL OR cur.n_chars IS DISTINCT FROM new.n_chars OR cur.lang IS DISTINCT FROM new.lang")
def q_skip_unchanged(spark: SparkSession, d: str) -> DataFrame:
    """Incoming rows that differ from the current ones in more than what is ignored."""
    cur, new = _halves(spark, d)
    return index.changed(cur, new, "doc_id", ["source"])


@query(
    """
    WITH c AS (SELECT doc_id, sha256(coalesce(text, '')) AS sha FROM documents), n AS (SELECT doc_id, 1 + length(coalesce(text, '')) // 1000 AS chunks, n_chars // 1000 + 1 AS indexed FROM documents)
    SELECT c.doc_id, coalesce(chunks = indexed AND indexed > 0, false) AS skip FROM c JOIN n USING (doc_id)
    """
)
def q_incremental_skip(spark: SparkSession, d: str) -> DataFrame:
    """Documents to skip: unchanged, and all their chunks indexed (stated sizes stand for the index)."""
    docs = table(spark, d, "documents")
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    cand = docs.select("doc_id", sha.alias("sha256"), F.lit("f1").alias("fingerprint"))
    cache = cand.join(docs.select("doc_id", (1 + F.floor(F.length(F.coalesce("text", F.lit(""))) / 1000)).alias("chunks")), "doc_id").withColumn("version", F.lit(3))
    counts = docs.select("doc_id", (F.floor(F.col("n_chars") / 1000) + 1).alias("indexed"))
    return index.to_process(cand, cache, counts, 3).select("doc_id", "skip")


@query(
    """
    WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(concat_ws('|', doc_id::VARCHAR, coalesce(source, ''), '0'))) AS h FROM documents)
    SELECT doc_id, concat_ws('-', h[1:8], h[9:12], '5' || h[14:16], substr('89ab', 1 + (strpos('0123456789abcdef', h[17:17]) - 1) % 4, 1) || h[18:20], h[21:32]) AS point_id FROM h
    """
)
def q_point_id(spark: SparkSession, d: str) -> DataFrame:
    """Name-based ids of points."""
    return table(spark, d, "documents").select("doc_id", metadata.uuid5(F.concat_ws("|", F.col("doc_id").cast("string"), F.coalesce("source", F.lit("")), F.lit("0"))).alias("point_id"))


@query(
    """
    WITH p AS (SELECT label::INT AS label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x, (1 + vec_id % 3)::DOUBLE AS w FROM embeddings),
    m AS (SELECT label, i, sum(x * w) / sum(w) AS m FROM p GROUP BY ALL), n AS (SELECT label, sqrt(sum(m * m)) AS n FROM m GROUP BY 1)
    SELECT m.label, (i - 1)::INT AS place, round(m / n, 6) AS value FROM m JOIN n USING (label)
    """
)
def q_pool_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Weighted mean of each label's vectors, scaled to length one."""
    got = index.pooled(_vectors(spark, d), ["label"], "embedding", 1 + F.col("vec_id") % 3)
    return got.select("label", F.posexplode("vector").alias("place", "v")).select("label", "place", F.round("v", 6).alias("value"))


@query("SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN 'missing' WHEN vec_id % 7 = 1 THEN 'dimension' WHEN vec_id % 7 IN (2, 3) THEN 'not finite' ELSE 'zero' END AS reason FROM embeddings WHERE vec_id % 7 <= 4")
def q_vector_validate(spark: SparkSession, d: str) -> DataFrame:
    """Vectors that can't be used: five of seven are spoilt, each in its way."""
    how, v = F.col("vec_id") % 7, F.col("embedding").cast("array<double>")
    spoilt = F.when(how == 1, F.slice(v, 1, 63)).when(how == 2, F.transform(v, lambda x, i: F.when(i == 5, float("nan")).otherwise(x))).when(how == 3, F.transform(v, lambda x, i: F.when(i == 9, float("inf")).otherwise(x))).when(how == 4, F.transform(v, lambda x: F.lit(0.0)))
    return index.vector_faults(_vectors(spark, d).withColumn("embedding", F.when(how > 4, v).when(how > 0, spoilt)), "embedding", 64, "vec_id")


@query(f"SELECT source_id, 32 AS n, CASE WHEN len({tokens_sql('text')}) = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS norm FROM excerpts WHERE text IS NOT NULL")
def q_hashed_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Default vectors of excerpts: hashed bags of tokens."""
    v = V.hashed_bag(X.tokens(F.col("text")), 32)
    return table(spark, d, "excerpts").where(F.col("text").isNotNull()).select("source_id", F.size(v).alias("n"), F.round(V.norm(v), 6).alias("norm"))


# --- pages ------------------------------------------------------------------------------------------------------------


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return pages.split_pages(table(spark, d, "documents"), "doc_id", "text", "\n\n")


_PAGES_SQL = "pg AS (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS page_text, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS page FROM documents WHERE text IS NOT NULL)"


@query(f"WITH {_PAGES_SQL} SELECT doc_id, page::INT AS page, length(page_text)::INT AS n FROM pg")
def q_page_split(spark: SparkSession, d: str) -> DataFrame:
    """Documents as pages (paragraphs stand for pages)."""
    return _pages(spark, d).select("doc_id", "page", F.length("page_text").alias("n"))


@query(f"WITH {_PAGES_SQL} SELECT doc_id, page::INT AS page, coalesce(sum(length(page_text) + 1) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM pg")
def q_page_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Where each page begins."""
    return pages.page_offsets(_pages(spark, d), "doc_id").select("doc_id", "page", "start")


@query(
    f"""WITH {_PAGES_SQL}, o AS (SELECT doc_id, page, coalesce(sum(length(page_text) + 1) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM pg),
    pt AS (SELECT doc_id, unnest([0, 500, 1000, 2000]) AS at FROM documents WHERE text IS NOT NULL)
    SELECT pt.doc_id, pt.at::INT AS at, max(o.page)::INT AS page FROM pt JOIN o ON o.doc_id = pt.doc_id AND o.start <= pt.at GROUP BY ALL"""
)
def q_page_of_offset(spark: SparkSession, d: str) -> DataFrame:
    """The page of an offset: as-of join."""
    offsets = pages.page_offsets(_pages(spark, d), "doc_id")
    points = table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", F.explode(F.array(*[F.lit(x) for x in (0, 500, 1000, 2000)])).alias("at"))
    return pages.page_of(offsets, points, "doc_id", "at").select("doc_id", F.col("at").cast("int").alias("at"), "page")


@query(
    f"SELECT doc_id, {_CONFIDENCE_SQL.format('text')} AS confidence FROM documents"
)
def q_extract_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Trust in each document's text."""
    return table(spark, d, "documents").select("doc_id", pages.confidence(F.col("text")).alias("confidence"))


@query(
    f"""WITH {_PAGES_SQL} SELECT doc_id, min(page)::INT AS page, max(page)::INT AS page_end, CASE WHEN bool_and(length(page_text) < 80) THEN 'ocr' WHEN bool_or(length(page_text) < 80) THEN 'mixed' ELSE 'native' END AS text_origin,
    round(avg({_CONFIDENCE_SQL.format('page_text')})::DECIMAL(20, 16), 4)::DOUBLE AS extraction_confidence FROM pg GROUP BY doc_id"""
)
def q_page_quality(spark: SparkSession, d: str) -> DataFrame:
    """Pages, origin and mean confidence of each document's pages."""
    rows = _pages(spark, d).withColumns({"extraction_confidence": pages.confidence(F.col("page_text")), "text_origin": F.when(F.length("page_text") < 80, "ocr").otherwise("native")})
    return pages.span_quality(rows, ["doc_id"])


def _decision_pages(spark: SparkSession, d: str) -> DataFrame:
    """Decisions as pages (paragraphs stand for pages); those from scans have running headers."""
    return pages.split_pages(table(spark, d, "decisions"), "record_id", "inteiro_teor", "\n\n")


_EDGES_SQL = r"""
    pg AS (SELECT record_id, unnest(string_split(inteiro_teor, chr(10) || chr(10))) AS t, generate_subscripts(string_split(inteiro_teor, chr(10) || chr(10)), 1) AS page FROM decisions WHERE inteiro_teor IS NOT NULL),
    ls AS (SELECT record_id, page, list_filter(list_transform(string_split_regex(t, '\r?\n'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: length(x) > 0) AS l FROM pg),
    ed AS (SELECT record_id, page, unnest(list_distinct([lower(l[1]), lower(l[-1])])) AS line FROM ls WHERE len(l) > 0),
    noise AS (SELECT record_id, line, count(*) AS pages FROM ed WHERE length(line) <= 180 AND NOT regexp_matches(line, '(?i)^(lei|decreto|decreto-lei|portaria|resolução|resolucao|instrução|instrucao|emenda|medida|art(igo)?\b|§|cap[ií]tulo|t[ií]tulo|se[cç][aã]o|subse[cç][aã]o|parte|livro|anexo)')
              GROUP BY ALL HAVING count(*) >= 2)"""


@query(f"WITH {_EDGES_SQL} SELECT record_id, line, pages FROM noise")
def q_edge_noise(spark: SparkSession, d: str) -> DataFrame:
    """Lines that stand at the edges of several pages of a decision."""
    return pages.repeated_edges(_decision_pages(spark, d), "record_id")


@query(
    f"""
    WITH {_EDGES_SQL}, per AS (SELECT record_id, list(line) AS bad FROM noise GROUP BY 1),
    kept AS (SELECT record_id, page, l, list_filter(range(1, len(l) + 1), lambda i: NOT coalesce(list_contains(bad, lower(l[i])), false)) AS k FROM ls LEFT JOIN per USING (record_id))
    SELECT record_id, page::INT AS page, CASE WHEN len(k) = 0 THEN 0 ELSE length(array_to_string(l[list_min(k):list_max(k)], chr(10))) END::INT AS n FROM kept
    """
)
def q_without_edges(spark: SparkSession, d: str) -> DataFrame:
    """Pages without repeated lines at their edges."""
    return pages.without_edges(_decision_pages(spark, d), "record_id").select("record_id", "page", F.length("page_text").alias("n"))


@query(
    """
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents WHERE text IS NOT NULL),
    b AS (SELECT doc_id, line_no, trim(line) AS line, lag(trim(line)) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM l)
    SELECT doc_id, line_no::INT AS line_no, line FROM b WHERE length(line) > 0 AND line = before
    """
)
def q_consecutive_dups(spark: SparkSession, d: str) -> DataFrame:
    """Lines equal to the line before them."""
    return pages.repeated_lines(table(spark, d, "documents"), "doc_id", "text")


@query(
    r"""
    WITH a AS (SELECT DISTINCT node_id, array_to_string(list_transform(string_split_regex(source_text, '\r?\n'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), chr(10)) AS t FROM legal_nodes WHERE source_text IS NOT NULL),
    b AS (SELECT node_id, regexp_replace(regexp_replace(t, '([\p{L}\p{N}_])-\s+([\p{L}\p{N}_])', '\1\2', 'g'), '([\p{L}\p{N}_])-\s+([\p{L}\p{N}_])', '\1\2', 'g') AS t FROM a),
    c AS (SELECT node_id, regexp_replace(regexp_replace(t, '(?im)^(?:p[aáÁ]gina|page)\s*[:\-]?\s*[0-9]+[a-z-]*\s*$', '', 'g'), '(?m)^[0-9]{1,5}(?:\s*[-/]\s*[0-9]+)?\s*$', '', 'g') AS t FROM b)
    SELECT DISTINCT node_id, sha256(trim(regexp_replace(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g'))) AS sha256 FROM c
    """
)
def q_sanitize(spark: SparkSession, d: str) -> DataFrame:
    """Texts of nodes put in order: spaces, broken words, page numbers."""
    return table(spark, d, "legal_nodes").where(F.col("source_text").isNotNull()).select("node_id", F.sha2(pages.sanitize(F.col("source_text")), 256).alias("sha256")).distinct()


# --- metadata ---------------------------------------------------------------------------------------------------------


@query(
    r"""
    WITH n AS (SELECT DISTINCT node_id, regexp_extract(left(source_text, 12000), '(?m)^\s*(LEI COMPLEMENTAR|LEI|DECRETO-LEI|DECRETO|PORTARIA|RESOLUÇÃO|INSTRUÇÃO NORMATIVA|EMENDA CONSTITUCIONAL)\s+N[ºo°]?\.?\s*([0-9][0-9.]*)[^\n]{0,60}?((?:19|20)[0-9]{2})', ['k', 'n', 'y']) AS h
               FROM legal_nodes WHERE kind = 'norma')
    SELECT node_id, lower(strip_accents(nullif(h.k, ''))) AS kind, replace(nullif(h.n, ''), '.', '') AS number, nullif(h.y, '')::INT AS year FROM n
    """
)
def q_norm_headers(spark: SparkSession, d: str) -> DataFrame:
    """Kind, number and year of every norm."""
    n = table(spark, d, "legal_nodes").where(F.col("kind") == "norma").select("node_id", metadata.norm_header(F.col("source_text")).alias("h")).distinct()
    return n.select("node_id", "h.kind", "h.number", "h.year")


@query(
    "SELECT id, authority_level, source_role, CASE source_role WHEN 'norma' THEN 1 WHEN 'jurisprudencia' THEN 2 WHEN 'jurisprudencia_controle' THEN 2 WHEN 'controle_estadual' THEN 2 WHEN 'orientacao_oficial' THEN 3 WHEN 'taxonomia' THEN 3 WHEN 'descoberta_legislativa' THEN 3 WHEN 'doutrina' THEN 4 END::INT AS level_of_role FROM source_catalogue"
)
def q_authority_level(spark: SparkSession, d: str) -> DataFrame:
    """Level of each source's role beside the catalogue's."""
    return table(spark, d, "source_catalogue").select("id", "authority_level", "source_role", metadata.authority_level(F.col("source_role")).alias("level_of_role"))


_CATALOGUE_SQL = """c AS (SELECT id, title, urls, authority_level, follow_links, max_follow FROM source_catalogue UNION ALL
    SELECT id || CASE WHEN authority_level = 4 THEN '' ELSE '-2' END, CASE WHEN authority_level = 3 THEN ' ' ELSE title END, CASE WHEN authority_level = 2 THEN [] ELSE urls END, authority_level * 2, follow_links, NULL FROM source_catalogue)"""
@query(f"WITH {_CATALOGUE_SQL} SELECT id, 'id twice' AS reason FROM c GROUP BY id HAVING count(*) > 1 UNION ALL SELECT id, 'title' FROM c WHERE trim(coalesce(title, '')) = '' UNION ALL SELECT id, 'urls' FROM c WHERE coalesce(len(urls), 0) = 0 UNION ALL SELECT id, 'authority_level' FROM c WHERE coalesce(authority_level NOT BETWEEN 1 AND 4, true) UNION ALL SELECT id, 'max_follow' FROM c WHERE follow_links AND max_follow IS NULL")
def q_catalogue_check(spark: SparkSession, d: str) -> DataFrame:
    """Faults of a catalogue: the project's beside a spoilt copy of it."""
    c = table(spark, d, "source_catalogue").select("id", "title", "urls", "authority_level", "follow_links", "max_follow")
    level = F.col("authority_level")
    spoilt = c.select(
        F.when(level == 4, F.col("id")).otherwise(F.concat("id", F.lit("-2"))).alias("id"), F.when(level == 3, " ").otherwise(F.col("title")).alias("title"), F.when(level == 2, F.array().cast("array<string>")).otherwise(F.col("urls")).alias("urls"),
        (level * 2).alias("authority_level"), "follow_links", F.lit(None).cast("int").alias("max_follow"),
    )
    return catalog.faults(c.unionByName(spoilt))


_NAMED_SQL = r"(?i)\blei\s*(?:n[ºo°.]*\s*)?(?:14[.\- ]133|8[.\- ]666|10[.\- ]520|12[.\- ]462)\b|\b(?:lei\s+complementar|lc)\s*(?:n[ºo°.]*\s*)?123\b"
_KEYS_SQL = "MAP {'14133': 'lei_14133', '8666': 'lei_8666', '10520': 'lei_10520', '12462': 'lei_12462', '123': 'lei_123'}"


def named_sql(c: str) -> str:
    """The regime a text names first."""
    return f"{_KEYS_SQL}[nullif(regexp_replace(regexp_extract({c}, '{_NAMED_SQL}'), '[^0-9]', '', 'g'), '')]"


def cited_sql(c: str) -> str:
    """Regimes a text names, in the order of the table."""
    every = f"list_transform(regexp_extract_all({c}, '{_NAMED_SQL}'), lambda m: regexp_replace(m, '[^0-9]', '', 'g'))"
    return f"list_transform(list_filter(['14133', '8666', '10520', '12462', '123'], lambda k: list_contains({every}, k)), lambda k: {_KEYS_SQL}[k])"


def regime_sql(source: str, title: str, text: str, role: str) -> str:
    """A document's own regime, rule after rule."""
    turn = r"(?i)\b(transi[cç][aã]o(\s+legislativa|\s+entre\s+regimes?)?|compara[cç][aã]o(\s+entre\s+regimes?)?|regimes?\s+comparados|aplica[cç][aã]o\s+temporal\s+das\s+leis)\b"
    header = rf"regexp_extract(array_to_string(string_split({text}, chr(10))[1:12], chr(10)), '(?im)^\s*((?:lei|lc|decreto|portaria|resolu[cç][aã]o|instru[cç][aã]o)\b[^\n]*)', 1)"
    return (
        f"coalesce(CASE WHEN regexp_matches({source}, '{turn}') THEN 'transicao' END, {named_sql(source)}, CASE WHEN regexp_matches({title}, '{turn}') THEN 'transicao' END, {named_sql(title)}, {named_sql(header)}, {named_sql(f'left({text}, 40000)')}, "
        f"CASE WHEN {role} IN ('jurisprudencia', 'jurisprudencia_controle') THEN 'jurisprudencia' END, 'nao_especificado')"
    )


@query(f"SELECT doc_id, {regime_sql('source', 'title', 'text', 'source_role')} AS regime, array_to_string(coalesce({cited_sql('text')}, []), ',') AS cited FROM documents")
def q_regime(spark: SparkSession, d: str) -> DataFrame:
    """Own and cited regimes of every document."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", metadata.regime(F.coalesce("source", F.lit("")), F.coalesce("title", F.lit("")), F.col("text"), F.col("source_role")).alias("regime"), F.array_join(metadata.cited_regimes(F.col("text")), ",").alias("cited"))


@query("SELECT doc_id, CASE WHEN contains(lower(coalesce(text, '')), 'pregão eletrônico') THEN 'Pregão Eletrônico' WHEN contains(lower(coalesce(text, '')), 'pregão presencial') THEN 'Pregão Presencial' WHEN contains(lower(coalesce(text, '')), 'concorrência eletrônica') THEN 'Concorrência Eletrônica' WHEN contains(lower(coalesce(text, '')), 'concorrência') THEN 'Concorrência' WHEN contains(lower(coalesce(text, '')), 'dispensa eletrônica') THEN 'Dispensa Eletrônica' WHEN contains(lower(coalesce(text, '')), 'inexigibilidade de licitação') THEN 'Inexigibilidade de Licitação' WHEN contains(lower(coalesce(text, '')), 'chamamento público') THEN 'Chamamento Público' WHEN contains(lower(coalesce(text, '')), 'credenciamento') THEN 'Credenciamento' WHEN contains(lower(coalesce(text, '')), 'leilão') THEN 'Leilão' END AS modality FROM documents")
def q_modality(spark: SparkSession, d: str) -> DataFrame:
    """Kind of tender that each document names."""
    return table(spark, d, "documents").select("doc_id", metadata.first_named(F.col("text"), metadata.MODALITIES).alias("modality"))


@query("SELECT source_id, sha256 = sha256(text) AS fresh FROM excerpts")
def q_stale_hash(spark: SparkSession, d: str) -> DataFrame:
    """Whether an excerpt's stated hash is its text's."""
    return table(spark, d, "excerpts").select("source_id", (F.col("sha256") == F.sha2("text", 256)).alias("fresh"))


@query(
    f"""
    WITH n AS (SELECT DISTINCT doc_id || '.txt' AS name FROM legal_nodes UNION SELECT id || '.pdf' FROM source_catalogue UNION SELECT unnest([{", ".join(repr(x) for x in NAMES)}])),
    r AS (SELECT name, {rules_sql('lower(name)')} AS r FROM n)
    SELECT name, r.orgao, r.jurisdicao, r.esfera, r.tribunal, r.tipo_documento, r.source_role, r.authority_level::VARCHAR AS authority_level, r.ambiguous FROM r
    """
)
def q_source_rules(spark: SparkSession, d: str) -> DataFrame:
    """What file names tell: those of norms, of sources, and one for every rule."""
    names = table(spark, d, "legal_nodes").select(F.concat("doc_id", F.lit(".txt")).alias("name")).union(table(spark, d, "source_catalogue").select(F.concat("id", F.lit(".pdf")))).union(spark.createDataFrame([(x,) for x in NAMES], "name string"))
    return names.distinct().select("name", metadata.source_rules(F.col("name")).alias("r")).select("name", "r.*").withColumn("authority_level", F.col("authority_level").cast("string"))


@query("SELECT doc_id, '[REGIME: - | SOURCE: ' || coalesce(nullif(trim(source), ''), '-') || ' | STATUS: - | ESFERA: - | JURISDIÇÃO: ' || coalesce(nullif(trim(lang), ''), '-') || ']' AS prefix FROM documents")
def q_embedding_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Headings put before embedded texts."""
    none = F.lit(None).cast("string")
    return table(spark, d, "documents").select("doc_id", metadata.embedding_prefix(none, F.col("source"), none, none, F.col("lang")).alias("prefix"))


_EXTRACT_HEAD = "left(coalesce(text, ''), 30000)"


@query(
    rf"""
    WITH d AS (SELECT doc_id, text, {_EXTRACT_HEAD} AS head, lower({_EXTRACT_HEAD}) AS low, coalesce(source, 'local') || '.txt' AS name FROM documents),
    r AS (SELECT *, {rules_sql('lower(name)')} AS r, nullif(trim(regexp_extract(head, '(?im)^[ \t]*TRIBUNAL[ \t]*:[ \t]*(.+)$', 1)), '') AS court,
                 regexp_extract(left(text, 12000), '(?m)^\s*(LEI COMPLEMENTAR|LEI|DECRETO-LEI|DECRETO|PORTARIA|RESOLUÇÃO|INSTRUÇÃO NORMATIVA|EMENDA CONSTITUCIONAL)\s+N[ºo°]?\.?\s*([0-9][0-9.]*)[^\n]{{0,60}}?((?:19|20)[0-9]{{2}})', ['k', 'n', 'y']) AS h FROM d),
    m AS (SELECT *, CASE WHEN court IN ('TCU', 'TCESP') THEN 'jurisprudencia_controle' WHEN court IN ('STF', 'STJ', 'TJSP') THEN 'jurisprudencia' ELSE r.source_role END AS role, CASE WHEN court IS NOT NULL THEN 'jurisprudencia' ELSE r.tipo_documento END AS kind,
                 coalesce(court, r.tribunal) AS tribunal FROM r),
    g AS (SELECT *, {regime_sql("''", "''", "head", "role")} AS regime FROM m)
    SELECT doc_id, list_filter([{", ".join(repr(x) for x in metadata.MODALITIES)}], lambda x: contains(low, lower(x)))[1] AS modalidade, list_filter([{", ".join(repr(x) for x in metadata.AWARDS)}], lambda x: contains(low, lower(x)))[1] AS tipo,
           coalesce(nullif(trim(regexp_extract(head, '(?im)^[ \t]*PROCESSO[ \t]*:[ \t]*(.+)$', 1)), ''), nullif(regexp_replace(regexp_extract(head, '(?i)processo\s*(?:administrativo)?\s*n[ºo°.]*\s*[:\-]?\s*([0-9./\-]{{4,30}})', 1), '^[ .-]+|[ .-]+$', '', 'g'), '')) AS processo,
           replace(nullif(h.n, ''), '.', '') AS norm_numero,
           coalesce(nullif(regexp_extract(left(text, 12000), '(?im)^\s*(?:lei|decreto|decreto-lei|portaria|resolu[cç][aã]o|instru[cç][aã]o\s+normativa|emenda\s+constitucional|lei\s+complementar)\s+(?:federal\s+)?n?[ºo°.]*\s*[0-9.\-/A-Za-z]*\s*,?\s*de\s+(?:[0-9]{{1,2}}[ºo]?\s+de\s+)?[^\n0-9]{{3,40}}\s+de\s+(20[0-9]{{2}})\b', 1), ''), nullif(h.y, '')) AS norm_ano,
           role AS source_role,
           CASE WHEN upper(tribunal) IN ('STF', 'STJ', 'TCU', 'TCESP', 'TJSP') THEN 2 ELSE CASE role WHEN 'norma' THEN 1 WHEN 'jurisprudencia' THEN 2 WHEN 'jurisprudencia_controle' THEN 2 WHEN 'orientacao_oficial' THEN 3 WHEN 'doutrina' THEN 4 END END::VARCHAR AS authority_level,
           CASE WHEN role = 'norma' THEN CASE WHEN contains(coalesce(kind, ''), 'constituicao') THEN 1 WHEN kind IN ('lei', 'decreto_lei', 'emenda_constitucional') OR starts_with(kind, 'lei_') THEN 2 WHEN kind = 'decreto' OR starts_with(kind, 'decreto_') THEN 3 ELSE 4 END END::VARCHAR AS normative_rank,
           regime AS regime_juridico, array_to_string(list_filter(coalesce({cited_sql('head')}, []), lambda x: x <> regime), ',') AS cited
    FROM g
    """
)
def q_extract_metadata(spark: SparkSession, d: str) -> DataFrame:
    """All metadata of every document, from its source, text and nothing given."""
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.coalesce("source", F.lit("local")), F.lit(".txt")).alias("name"), "text")
    m = metadata.extract(docs, "name", "text")
    whole = [F.col(c).cast("string").alias(c) for c in ("norm_ano", "authority_level", "normative_rank")]
    return m.select("doc_id", "modalidade", "tipo", "processo", "norm_numero", "source_role", *whole, "regime_juridico", F.array_join("cited_regimes", ",").alias("cited"))


@query("SELECT id, authority_level FROM source_catalogue WHERE source_role IN ('orientacao_oficial', 'norma') AND coalesce(follow_links, false) = true AND authority_level <= 3")
def q_select_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources of a run: official guidance and norms whose links are followed."""
    return catalog.select_sources(table(spark, d, "source_catalogue"), ["orientacao_oficial", "norma"], following=True, most_level=3).select("id", "authority_level")


@query("SELECT id, host FROM (SELECT id, regexp_replace(lower(regexp_extract(urls[1], '^[A-Za-z]+://([^/:;?#]+)', 1)), '^www\\.', '') AS host FROM source_catalogue WHERE source_role = 'orientacao_oficial') QUALIFY row_number() OVER (PARTITION BY host ORDER BY id) = 1")
def q_one_per_host(spark: SparkSession, d: str) -> DataFrame:
    """The first source of each host."""
    return catalog.one_per_host(table(spark, d, "source_catalogue"), ["orientacao_oficial"]).select("id", "host")


@query("SELECT id, CASE WHEN follow_links THEN least(coalesce(max_follow, 12), 12) ELSE max_follow END::VARCHAR AS max_follow FROM source_catalogue")
def q_runtime_limits(spark: SparkSession, d: str) -> DataFrame:
    """Limits of following in a run of at most twelve links a page."""
    return catalog.with_limit(table(spark, d, "source_catalogue"), 12).select("id", F.col("max_follow").cast("string").alias("max_follow"))


@query("SELECT id, (generate_subscripts(list_distinct(urls), 1) - 1)::INT AS place, len(list_distinct(urls))::INT AS n FROM source_catalogue")
def q_source_urls(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of each source, each once."""
    u = catalog.urls(table(spark, d, "source_catalogue"))
    n = table(spark, d, "source_catalogue").select("id", F.size(F.array_distinct("urls")).alias("n"))
    return u.join(n, "id").select("id", "place", "n")


@query(
    f"""
    SELECT record_id, nullif(regexp_extract(inteiro_teor, '({courts.PROCESS})', 1), '') AS processo FROM decisions WHERE inteiro_teor IS NOT NULL
    """
)
def q_process_numbers(spark: SparkSession, d: str) -> DataFrame:
    """First process number in the full text of decisions."""
    return table(spark, d, "decisions").where(F.col("inteiro_teor").isNotNull()).select("record_id", courts.process_number(F.col("inteiro_teor")).alias("processo"))


# --- legal texts ------------------------------------------------------------------------------------------------------


def _editions(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "legal_nodes").where((F.col("kind") == "norma") & F.col("source_text").isNotNull())
    return n.select(F.concat_ws("@", "doc_id", F.col("edition").cast("string")).alias("doc_id"), F.col("source_text").alias("text")).distinct()


@query()
def q_legal_tree(spark: SparkSession, d: str) -> DataFrame:
    """The tree of every edition, read from its text."""
    t = legal.tree(_editions(spark, d))
    return t.select("doc_id", "node_id", "parent_id", "kind", "ref", "source_start", "source_end", F.array_join("path", " > ").alias("path"), "anexo_ref")


@query()
def q_legal_tree_recall(spark: SparkSession, d: str) -> DataFrame:
    """Of the table's nodes, how many the reader finds with the same kind, start and end."""
    have = table(spark, d, "legal_nodes").where(F.col("source_text").isNotNull()).select(F.concat_ws("@", "doc_id", F.col("edition").cast("string")).alias("doc_id"), "kind", "source_start", "source_end").distinct()
    got = legal.tree(_editions(spark, d)).select("doc_id", "kind", "source_start", "source_end", F.lit(1).alias("hit"))
    return have.join(got, ["doc_id", "kind", "source_start", "source_end"], "left").groupBy("kind").agg(F.count("*").alias("nodes"), F.sum(F.coalesce("hit", F.lit(0))).alias("found"))


@query()
def q_legal_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of every excerpt with their place, path and changes."""
    ex = table(spark, d, "excerpts").select(F.col("source_id").alias("doc_id"), "text")
    c = legal.chunks(ex)
    return c.select("doc_id", "unit_id", "unit_kind", "chunk_index", "start", "end", "segment_kind", F.length("text").alias("n"), "amendment", F.array_join("amendment_operations", ",").alias("operations"), F.array_join("target_articles", ",").alias("targets"))


@query("SELECT 0::BIGINT AS faults")
def q_span_invariant(spark: SparkSession, d: str) -> DataFrame:
    """Chunks whose text isn't the slice of their document: none."""
    ex = table(spark, d, "excerpts").select(F.col("source_id").alias("doc_id"), "text")
    c = legal.chunks(ex).select("doc_id", F.col("start").alias("source_start"), F.col("end").alias("source_end"), F.col("text").alias("source_text"))
    return legal.span_faults(c, ex.withColumnRenamed("text", "full_text"), "doc_id").agg(F.count("*").alias("faults"))


@query(
    """
    WITH n AS (SELECT DISTINCT doc_id, edition, node_id, source_start, source_end, source_text FROM legal_nodes WHERE source_text IS NOT NULL AND kind <> 'norma'),
    t AS (SELECT DISTINCT doc_id, edition, source_text AS full_text FROM legal_nodes WHERE kind = 'norma' AND source_text IS NOT NULL)
    SELECT n.node_id, substr(full_text, source_start + 1, source_end - source_start) = source_text AS exact FROM n JOIN t USING (doc_id, edition)
    """
)
def q_span_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether each node's text is the slice of its edition that its offsets say."""
    n = table(spark, d, "legal_nodes").where(F.col("source_text").isNotNull())
    nodes = n.where(F.col("kind") != "norma").select("doc_id", "edition", "node_id", "source_start", "source_end", "source_text").distinct()
    texts = n.where(F.col("kind") == "norma").select("doc_id", "edition", F.col("source_text").alias("full_text")).distinct()
    exact = F.substring("full_text", F.col("source_start") + 1, F.col("source_end") - F.col("source_start")) == F.col("source_text")
    return nodes.join(texts, ["doc_id", "edition"]).select("node_id", exact.alias("exact"))


@query(
    """
    WITH n AS (SELECT DISTINCT doc_id, edition, kind, ref, source_start FROM legal_nodes),
    a AS (SELECT * FROM n WHERE kind = 'artigo'), h AS (SELECT * FROM n WHERE kind IN ('titulo', 'capitulo'))
    SELECT concat_ws('@', a.doc_id, a.edition::VARCHAR) AS doc, a.source_start AS at, arg_max(h.ref, h.source_start) AS heading FROM a LEFT JOIN h ON h.doc_id = a.doc_id AND h.edition = a.edition AND h.source_start <= a.source_start GROUP BY ALL
    """
)
def q_headings_in_force(spark: SparkSession, d: str) -> DataFrame:
    """The heading in force at each article: as-of join."""
    n = table(spark, d, "legal_nodes").select(F.concat_ws("@", "doc_id", F.col("edition").cast("string")).alias("doc"), "kind", "ref", F.col("source_start").alias("at")).distinct()
    heads = n.where(F.col("kind").isin("titulo", "capitulo")).select("doc", "at", F.col("ref").alias("heading"))
    return legal.headings_in_force(n.where(F.col("kind") == "artigo").select("doc", "at"), heads, "doc")


@query(
    r"""
    SELECT DISTINCT node_id, 'artigo/' || CASE WHEN a IS NULL OR a = len(path) THEN 'caput' ELSE array_to_string(path[a + 1:], '/') END AS device_id
    FROM (SELECT node_id, path, list_position(list_transform(path, lambda p: starts_with(p, 'Art. ')), true) AS a FROM legal_nodes WHERE kind IN ('artigo', 'paragrafo', 'inciso', 'alinea'))
    """
)
def q_device_ids(spark: SparkSession, d: str) -> DataFrame:
    """Unit and place below it for every node of an article."""
    n = table(spark, d, "legal_nodes").where(F.col("kind").isin("artigo", "paragrafo", "inciso", "alinea"))
    return n.select("node_id", legal.device_id(F.col("path"), F.lit("artigo")).alias("device_id")).distinct()


@query()
def q_amendments(spark: SparkSession, d: str) -> DataFrame:
    """What changing acts change."""
    ex = table(spark, d, "excerpts").where(F.col("role") == "alteradora").select(F.col("source_id").alias("doc_id"), "text")
    c = legal.chunks(ex).where(F.col("amendment"))
    return c.select("doc_id", "unit_id", F.array_join("amendment_operations", ",").alias("operations"), F.array_join("target_articles", ",").alias("targets")).distinct()


@query("SELECT kind, count(*) AS n FROM (SELECT DISTINCT node_id, kind FROM legal_nodes WHERE kind IN ('artigo', 'anexo')) GROUP BY 1")
def q_unit_projection(spark: SparkSession, d: str) -> DataFrame:
    """Articles and annexes of all editions."""
    return table(spark, d, "legal_nodes").where(F.col("kind").isin("artigo", "anexo")).select("node_id", "kind").distinct().groupBy("kind").agg(F.count("*").alias("n"))


@query()
def q_split_spans(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents split by size alone."""
    c = legal.chunks(table(spark, d, "documents").select("doc_id", "text"), role=F.lit("doutrina"))
    return c.select("doc_id", "chunk_index", "start", "end")


# --- pages of the web -------------------------------------------------------------------------------------------------


@query()
def q_html_text(spark: SparkSession, d: str) -> DataFrame:
    """Visible text of summaries that hold tags."""
    return table(spark, d, "decisions").where(F.col("ementa").rlike("<[a-zA-Z/]")).select("record_id", html.text_of(F.col("ementa")).alias("text"))


@query()
def q_html_tables(spark: SparkSession, d: str) -> DataFrame:
    """Rows of tables in summaries."""
    rows = table(spark, d, "decisions").where(F.col("ementa").contains("<td")).select("record_id", F.posexplode(html.rows_of(F.col("ementa"))))
    return rows.select("record_id", "pos", F.array_join("col", "\t").alias("cells"))


@query()
def q_html_links(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of sources, classified as links."""
    c = table(spark, d, "source_catalogue").select("id", F.explode("urls").alias("url"))
    page = F.concat(F.lit('<a href="/doc/1">Documento 1</a><a href="lista?pagina=2">Próxima</a><a href="teor.pdf">Inteiro teor</a><a href="https://outro.example/x">Fora</a>'))
    found = html.links(c.withColumn("html", page).withColumn("key", F.concat_ws(" ", "id", "url")), "key", "url", F.col("html"))
    return html.discover(found, "key", [], [r"\.png$"], 12).select("key", "link", html.link_kind(F.col("link"), F.col("label")).alias("kind"))


# --- joins ------------------------------------------------------------------------------------------------------------


@query("SELECT d.doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM source_catalogue c WHERE c.id = d.source AND c.source_role = 'norma')")
def q_source_semi(spark: SparkSession, d: str) -> DataFrame:
    """Documents of norms: semi join with the catalogue."""
    return table(spark, d, "documents").join(_catalogue(spark, d).where(F.col("role") == "norma"), "source", "left_semi").select("doc_id")


@query("SELECT i.item_id, count(d.doc_id) AS n FROM (SELECT item_id, unnest(expected_source_ids) AS source FROM eval_items) i LEFT JOIN documents d ON d.source = i.source GROUP BY 1")
def q_eval_join(spark: SparkSession, d: str) -> DataFrame:
    """How many documents the expected sources of each case hold: sources are counted before the join."""
    counts = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    items = table(spark, d, "eval_items").select("item_id", F.explode("expected_source_ids").alias("source"))
    return items.join(counts, "source", "left").groupBy("item_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


@query(
    """
    SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1
    """
)
def q_join_aggregate(spark: SparkSession, d: str) -> DataFrame:
    """Orders by nation of the customer."""
    j = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS hour, count(*) AS n FROM events GROUP BY ALL")
def q_windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts per hour of event time; the batch form of the streaming operator."""
    from lexmill.streaming.ingest import windowed_counts

    got = windowed_counts(table(spark, d, "events"), "ts", "1 day", "1 hour", None, ["event_type"])
    return got.select("event_type", F.col("frame.start").alias("hour"), "n")
