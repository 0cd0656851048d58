"""Search: sparse and dense top-k, fusion, weighting, caps, neighbours, budgeted context.

Queries are a stated set of rows (few) against all rows of an index (many). Nothing pairs rows of the index with one
another, and no list of candidates leaves the cluster.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import scores as S
from lexmill.functions import text as X
from lexmill.session import cut
from lexmill.settings import Settings

#: Terms of a query set that are looked up where the texts lie; a larger set is joined.
VOCABULARY = 10_000
#: Query terms (a term of a query each) that are brought to the texts, and scores that a batch holds at once.
PAIRS, SCORES = 200_000, 4_000_000
#: Query vectors that a batch of rows is compared with at once.
INNER = 256


def _query_terms(queries: DataFrame, query_key: str, query_text: str) -> DataFrame:
    return queries.select(F.col(query_key).alias("query_id"), F.explode(F.array_distinct(X.tokens(F.col(query_text)))).alias("term"))


def bm25_top_k(docs: DataFrame, queries: DataFrame, k: int, key: str = "doc_id", text: str = "text", query_key: str = "query_id", query_text: str = "query", settings: Settings = Settings()) -> DataFrame:
    """query_id, key, score (six places), rank: the k best documents of each query.

    One pass over the texts gives each document's length and its occurrences of the queries' terms; that is written out
    (checkpoint), as the corpus's figures are needed before the scores. Scores are made where a document's terms lie, and each
    batch of documents keeps what may be among the k best of a query, so no row for a query and document is shuffled but
    these. A query set of more than VOCABULARY terms, or PAIRS query terms, is joined instead.
    """
    k1, b = settings.bm25_k1, settings.bm25_b
    pairs = [tuple(r) for r in _query_terms(queries, query_key, query_text).limit(PAIRS + 1).collect()]
    vocabulary = sorted({t for _, t in pairs})
    if len(pairs) > PAIRS or len(vocabulary) > VOCABULARY:
        return top_k(bm25(docs, queries, key, text, query_key, query_text, settings).withColumn("score", F.round("score", 6)), k, "query_id", key)
    found = X.tokens(F.coalesce(F.col(text), F.lit("")))
    sized = cut(docs.select(F.col(key).alias("_key"), found.alias("_t")).select("_key", F.size("_t").cast("double").alias("dl"), F.filter("_t", lambda t: t.isin(*vocabulary)).alias("_t")))
    n, avgdl = sized.agg(F.count("*"), F.avg("dl")).first()
    some = sized.where(F.size("_t") > 0)
    df = {r["term"]: r["n"] for r in some.select(F.explode(F.array_distinct("_t")).alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}  # at most VOCABULARY rows
    asked = sorted({q for q, _ in pairs})
    number = {q: i for i, q in enumerate(asked)}
    idf = {t: float(np.log1p((n - df[t] + 0.5) / (df[t] + 0.5))) for t in vocabulary if t in df}
    of: dict[str, list[int]] = {}
    for q, t in pairs:
        of.setdefault(t, []).append(number[q])
    held = docs.sparkSession.sparkContext.broadcast((asked, idf, {t: np.array(qs) for t, qs in of.items()}, avgdl))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked, idf, of, mean = held.value
        for pdf in batches:
            out = []
            step = max(1, SCORES // max(len(asked), 1))
            for at in range(0, len(pdf), step):
                keys, lengths, lists = (pdf[c].to_numpy()[at : at + step] for c in ("_key", "dl", "_t"))
                scores = np.zeros((len(asked), len(keys)))
                for j, (dl, found) in enumerate(zip(lengths, lists, strict=True)):
                    for t, tf in Counter(found).items():
                        scores[of[t], j] += idf[t] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / mean))
                for i, row in enumerate(scores):
                    hit = np.flatnonzero(row)
                    if len(hit) > k:  # ties to six places stay in
                        hit = hit[row[hit] >= np.partition(row[hit], -k)[-k] - 2e-6]
                    out.append(pd.DataFrame({"query_id": np.full(len(hit), asked[i], dtype=object), key: keys[hit], "score": row[hit]}))
            yield pd.concat(out, ignore_index=True) if out else pd.DataFrame({"query_id": [], key: [], "score": []})

    kinds = dict(queries.dtypes)[query_key], dict(docs.dtypes)[key]
    best = some.mapInPandas(scan, f"query_id {kinds[0]}, `{key}` {kinds[1]}, score double")
    return top_k(best.withColumn("score", F.round("score", 6)), k, "query_id", key)


def bm25(docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", query_key: str = "query_id", query_text: str = "query", settings: Settings = Settings()) -> DataFrame:
    """query_id, key, score: every document that shares a term with a query; a join by terms, for query sets of any size and results without a limit."""
    k1, b = settings.bm25_k1, settings.bm25_b
    terms = _query_terms(queries, query_key, query_text)
    found = X.tokens(F.coalesce(F.col(text), F.lit("")))
    sized = cut(docs.select(F.col(key).alias("_key"), found.alias("_t")).select("_key", F.size("_t").cast("double").alias("dl"), "_t"))
    whole = sized.agg(F.struct(F.count("*").cast("double").alias("n"), F.avg("dl").alias("avgdl")).alias("w")).scalar()
    words = sized.select("_key", "dl", F.explode("_t").alias("term")).join(terms.select("term").distinct(), "term", "left_semi")
    tf = words.groupBy("_key", "dl", "term").agg(F.count("*").cast("double").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").cast("double").alias("df"))
    weights = df.select("term", "df", whole.alias("_w")).select("term", F.col("_w.avgdl").alias("avgdl"), F.log1p((F.col("_w.n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    hits = tf.join(weights, "term").join(terms, "term")
    return hits.groupBy("query_id", F.col("_key").alias(key)).agg(F.sum(part).alias("score"))


def top_k(scored: DataFrame, k: int, by: str = "query_id", key: str = "doc_id", score: str = "score") -> DataFrame:
    """The k best of each query with their rank from 1; ties go to the smaller key."""
    w = Window.partitionBy(by).orderBy(F.col(score).desc(), F.col(key))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; a zero vector stays one, so it is like none."""
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", query_key: str = "query_id", extra: list[str] = (), block: int = 4096, exclude_self: bool = False) -> DataFrame:
    """query_id, key, score (cosine, six places), rank: exact search of a query set against all rows.

    Query vectors go to the workers in blocks; each batch of rows keeps its k best of each query, so what is shuffled is
    k rows a batch and query, whatever the number of rows.
    """
    sc = vectors.sparkSession.sparkContext
    fields = {f.name: f.dataType.simpleString() for f in vectors.schema}
    schema = f"query_id bigint, {key} {fields[key]}, score double" + "".join(f", {c} {fields[c]}" for c in extra)
    names = list(extra)
    out = None
    pending: list[tuple] = []

    def search(rows: list[tuple]) -> DataFrame:
        ids = np.array([r[0] for r in rows], dtype=np.int64)
        q = np.array([r[1] for r in rows], dtype=np.float64)
        held = sc.broadcast((ids, _scaled(q)))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, q = held.value
            for pdf in batches:
                if not len(pdf):
                    continue
                keys = pdf[key].to_numpy()
                x = _scaled(np.stack(pdf[vector].to_numpy()).astype(np.float64))
                n = len(keys)
                for at in range(0, len(ids), INNER):  # a matrix of rows x INNER at a time
                    some = ids[at : at + INNER]
                    sim = np.round(x @ q[at : at + INNER].T, 6)
                    if exclude_self:
                        sim[keys[:, None] == some[None, :]] = -2
                    least = np.partition(sim, n - k, axis=0)[n - k] if n > k else np.full(len(some), -2.0)
                    rows, cols = np.nonzero((sim >= least) & (sim > -2))
                    order = np.lexsort((keys[rows], -sim[rows, cols], cols))
                    rows, cols = rows[order], cols[order]
                    place = np.arange(len(cols)) - np.searchsorted(cols, cols, side="left")
                    rows, cols = rows[place < k], cols[place < k]
                    yield pd.DataFrame({"query_id": some[cols], key: keys[rows], "score": sim[rows, cols], **{c: pdf[c].to_numpy()[rows] for c in names}})

        return vectors.where(F.col(vector).isNotNull()).select(key, vector, *names).mapInPandas(scan, schema)

    for r in queries.select(query_key, vector).where(F.col(vector).isNotNull()).toLocalIterator():
        pending.append((r[0], r[1]))
        if len(pending) == block:
            got, pending = search(pending), []
            out = got if out is None else out.unionByName(got)
    if pending or out is None:
        if not pending:
            return vectors.sparkSession.createDataFrame([], schema + ", rank int")
        got = search(pending)
        out = got if out is None else out.unionByName(got)
    return top_k(out, k, "query_id", key)


def dense_best_per_group(vectors: DataFrame, queries: DataFrame, group: str, key: str = "vec_id", vector: str = "embedding", query_key: str = "query_id", block: int = 4096) -> DataFrame:
    """query_id, group, key, score: the nearest row of each group for each query; one scan for each block of queries.

    Each batch of rows keeps one row a query and group, so what is shuffled is as small as the answer, times batches.
    """
    sc = vectors.sparkSession.sparkContext
    fields = {f.name: f.dataType.simpleString() for f in vectors.schema}
    schema = f"query_id bigint, {group} {fields[group]}, {key} {fields[key]}, score double"
    out: DataFrame | None = None
    rows = queries.select(query_key, vector).where(F.col(vector).isNotNull()).toLocalIterator()
    while pending := [r for _, r in zip(range(block), rows, strict=False)]:
        ids = np.array([r[0] for r in pending], dtype=np.int64)
        q = np.array([r[1] for r in pending], dtype=np.float64)
        held = sc.broadcast((ids, _scaled(q)))

        def scan(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            ids, q = held.value
            for pdf in batches:
                pdf = pdf.sort_values(key)
                sim = np.round(_scaled(np.stack(pdf[vector].to_numpy()).astype(np.float64)) @ q.T, 6)
                for g, at in pdf.reset_index(drop=True).groupby(group, dropna=True).indices.items():
                    best = at[np.argmax(sim[at], axis=0)]  # the first of equals has the smallest key
                    yield pd.DataFrame({"query_id": ids, group: g, key: pdf[key].to_numpy()[best], "score": sim[best, np.arange(len(ids))]})

        got = vectors.where(F.col(vector).isNotNull()).select(key, vector, group).mapInPandas(scan, schema)
        out = got if out is None else out.unionByName(got)
    if out is None:
        return vectors.sparkSession.createDataFrame([], schema)
    return best_per_group(out, ["query_id", group], key)


def fuse(arms: list[DataFrame], k: int, key: str = "doc_id", settings: Settings = Settings()) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (query_id, key, rank from 1): query_id, key, score, rank. Ties go to the smaller key."""
    rows = [a.select("query_id", key, (1.0 / (settings.rrf_k + F.col("rank") - 1 + settings.rank_base)).alias("part")) for a in arms]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    return top_k(every.groupBy("query_id", key).agg(F.sum("part").alias("score")), k, "query_id", key)


def best_per_group(scored: DataFrame, groups: list[str], key: str, score: str = "score") -> DataFrame:
    """The best row of each group; an aggregation, so no group is sorted as a whole."""
    others = [c for c in scored.columns if c not in groups]
    order = F.struct(F.col(score), (-F.col(key)).alias("_k"), F.struct(*others).alias("_r"))
    return scored.groupBy(*groups).agg(F.max(order).alias("_b")).select(*groups, *[F.col(f"_b._r.{c}").alias(c) for c in others])


def weighted(points: DataFrame, asked: Column) -> DataFrame:
    """Adds evidence, authority, jurisdiction, quality and retrieval scores.

    points: logit, authority_level, normative_rank, jurisdicao, extraction_confidence.
    """
    return points.withColumns(
        {
            "evidence": S.evidence_score(F.col("logit")),
            "authority": S.authority_score(F.col("authority_level"), F.col("normative_rank")),
            "jurisdiction": S.jurisdiction_score(asked, F.col("jurisdicao")),
            "quality": S.quality_score(F.col("extraction_confidence")),
        }
    ).withColumn("retrieval", S.retrieval_score(F.col("evidence"), F.col("quality"), F.col("authority"), F.col("jurisdiction")))


def rerank(points: DataFrame, limit: int, settings: Settings = Settings(), by: str = "query_id", key: str = "doc_id") -> DataFrame:
    """At most unit_cap rows of a unit (source, unit_id), then the best ``limit`` of a query, then those with evidence enough.

    The cut comes before the threshold, so fewer than ``limit`` may be left.
    """
    order = [F.round("retrieval", 9).desc(), F.round("evidence", 9).desc(), F.col("authority").desc(), F.col("jurisdiction").desc(), F.coalesce("authority_level", F.lit(9)), F.col(key)]
    capped = points.withColumn("_u", F.row_number().over(Window.partitionBy(by, "source", "unit_id").orderBy(*order))).where(F.col("_u") <= settings.unit_cap)
    ranked = capped.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= limit)
    return ranked.where(F.col("evidence") >= settings.min_evidence_score).drop("_u")


def expand(hits: DataFrame, chunks: DataFrame, settings: Settings = Settings(), first: int = 0) -> DataFrame:
    """Chunks of the hits' units within ``context_neighbors`` of a hit, and the first chunk of an article.

    hits: unit columns source, unit_id, chunk_index, evidence; chunks: source, unit_id, unit_kind, chunk_index and more.
    Each hit names the places it asks for; these are put together by place before an equi-join with the chunks, so a
    unit of many chunks and hits forms no pairs. Adds is_hit, evidence, priority, distance.
    """
    n = settings.context_neighbors
    here = F.col("chunk_index")
    asked = F.array_union(F.sequence(here - n, here + n), F.array(F.lit(first)))
    h = hits.where((F.length("source") > 0) & (F.length("unit_id") > 0)).select("source", "unit_id", F.col("evidence").alias("_e"), here.alias("_c"), F.explode(asked).alias("chunk_index"))
    far = F.abs(F.col("chunk_index") - F.col("_c"))
    near = F.when(far <= n, F.col("_e"))
    wanted = h.groupBy("source", "unit_id", "chunk_index").agg(F.max(F.when(far == 0, F.col("_e"))).alias("evidence"), F.max(near).alias("_near"), F.max("_e").alias("_any"), F.min(far).alias("distance"))
    forced = (F.col("unit_kind") == "artigo") & (F.col("chunk_index") == first)
    # chunks delivered twice count once; the join's partitioning serves
    found = chunks.join(wanted, ["source", "unit_id", "chunk_index"]).where(F.col("_near").isNotNull() | forced).dropDuplicates()
    return found.withColumn("priority", F.when(forced, F.col("_any")).otherwise(F.col("_near"))).withColumn("is_hit", F.col("distance") == 0).drop("_near", "_any")


def context_order() -> list[Column]:
    """Hits first, then by evidence, priority, nearness and place."""
    return [F.col("is_hit").desc(), F.coalesce("evidence", F.lit(-1.0)).desc(), F.col("priority").desc(), F.col("distance"), F.col("source"), F.col("unit_id"), F.col("chunk_index")]


def append_base(primary: DataFrame, base: DataFrame, keys: list[str]) -> DataFrame:
    """Base rows that aren't among the primary ones, placed after them (column stage: 0 primary, 1 base)."""
    extra = base.join(primary.select(*keys), keys, "left_anti")
    return primary.withColumn("stage", F.lit(0)).unionByName(extra.withColumn("stage", F.lit(1)), allowMissingColumns=True)


def within_budget(items: Column, budget: int) -> Column:
    """Items kept in order within a budget of characters.

    items: array of struct (key, size, primary), in order, one query's candidates. An item too large is left out; if it
    is primary, nothing follows.
    """
    zero = F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(False).alias("stop"), F.array().cast("array<bigint>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        fits = ~acc["stop"] & (acc["used"] + x["size"] <= budget)
        return F.struct(
            F.when(fits, acc["used"] + x["size"]).otherwise(acc["used"]).alias("used"),
            (acc["stop"] | (~fits & x["primary"])).alias("stop"),
            F.when(fits, F.concat(acc["kept"], F.array(x["key"].cast("bigint")))).otherwise(acc["kept"]).alias("kept"),
        )

    return F.aggregate(items, zero, step)


#: What is said of a source in the context, and what stands where it isn't known.
TOLD = [
    ("papel", ["source_role"], "desconhecido"), ("autoridade", ["authority_level"], "desconhecida"), ("status", ["status"], "desconhecido"), ("jurisdicao", ["jurisdicao"], "desconhecida"),
]


def context_label(points: DataFrame, number: Column) -> Column:
    """Heading of a source in the context: title, file, pages, unit, role, authority, status, jurisdiction, validity, day of collection, version, origin.

    Columns that the table lacks count as unknown; a version is told by its first twelve characters.
    """
    have = dict(points.dtypes)
    text = lambda *names: F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in names if c in have], F.lit(None).cast("string"))
    said = lambda names, other: F.coalesce(text(*names), F.lit(other))
    flag = lambda c, words: F.when(F.coalesce(F.col(c).cast("boolean"), F.lit(False)), words).otherwise("") if c in have else F.lit("")
    page, last = text("page"), F.coalesce(text("page_end"), text("page"))
    pages = F.when(page.isNull(), "p. desconhecida").when(page == last, F.concat(F.lit("p. "), page)).otherwise(F.concat(F.lit("pp. "), page, F.lit("-"), last))
    version = F.concat(F.lit(" | versão="), F.substring(text("version_sha256"), 1, 12))
    origin = F.lit("")
    if "text_origin" in have or "extraction_confidence" in have:
        trust = F.format_string("%.3f", F.coalesce(text("extraction_confidence").cast("double"), F.lit(0.0)))
        origin = F.concat(F.lit(" | origem_texto="), said(["text_origin"], "desconhecido"), F.lit(" | confianca_extracao="), trust)
    return F.concat(
        F.lit("[F"), number.cast("string"), F.lit("] "), said(["title", "source"], "fonte não identificada"), F.lit(" ("), said(["source"], "arquivo desconhecido"), F.lit("), "), pages, flag("page_uncertain", " (posição incerta)"),
        F.coalesce(F.concat(F.lit(", "), text("unit_ref")), F.lit("")), *[x for name, names, other in TOLD for x in (F.lit(f" | {name}="), said(names, other))],
        F.lit(" | vigencia="), said(["effective_from", "data_vigencia"], "desconhecida"), F.lit(" até "), said(["effective_to"], "indeterminada"), F.lit(" | recuperado_em="), said(["retrieved_at"], "desconhecido"),
        F.coalesce(version, F.lit("")), flag("context_only", " | contexto_vizinho=true"), flag("metadata_ambiguous", " | metadados_ambiguos=true"), origin, F.lit(" | fonte="), said(["fonte_oficial"], "não informada"),
    )


def label(number: Column, title: Column, page: Column, page_end: Column, uncertain: Column, confidence: Column) -> Column:
    """Heading of a source in the context."""
    pages = F.when(page.isNull(), "").when((page_end.isNull()) | (page_end == page), F.concat(F.lit(", p. "), page.cast("string"))).otherwise(F.concat(F.lit(", pp. "), page.cast("string"), F.lit("-"), page_end.cast("string")))
    return F.concat(F.lit("[F"), number.cast("string"), F.lit("] "), F.coalesce(title, F.lit("sem título")), pages, F.when(F.coalesce(uncertain, F.lit(False)), " (página incerta)").otherwise(""), F.when(confidence.isNull(), "").otherwise(F.concat(F.lit(", confiança "), F.format_string("%.3f", confidence))))
