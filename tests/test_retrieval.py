import math

import numpy as np
from pyspark.sql import functions as F

from lexmill.functions import scores as S
from lexmill.functions import vectors as V
from lexmill.operators import retrieval as R
from lexmill.settings import Settings


def test_scores(spark):
    df = spark.createDataFrame([(5.0, 3, None), (3.0, 1, 2)], "logit double, level int, rank int")
    e, a = S.evidence_score(df["logit"]), S.authority_score(df["level"], df["rank"])
    got = [r[0] for r in df.select(S.retrieval_score(e, F.lit(1.0), a, F.lit(0.5))).collect()]
    assert [round(x, 5) for x in got] == [0.81545, 0.89175]
    edge = spark.range(1).select(S.evidence_score(F.lit(1e9)), S.authority_score(F.lit(None).cast("int"), F.lit(1)), S.quality_score(F.lit(None)), S.jurisdiction_score(F.lit("federal"), F.lit("estadual_sp"))).first()
    assert edge[0] <= 1 and tuple(edge)[1:] == (0.10, 1.0, 0.25)


def test_bm25_brute(spark):
    texts = ["contrato de obra pública", "obra obra contrato", None, "nada disso aqui", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    q = spark.createDataFrame([(1, "obra"), (2, "contrato obra"), (3, "zzz")], "query_id long, query string")
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in R.bm25(docs, q).collect()}
    words = [[w for w in (t or "").replace("ú", "u").split() if len(w) > 2] for t in texts]
    n, avg = len(words), sum(map(len, words)) / len(words)

    def score(terms, w):
        s = 0.0
        for t in terms:
            tf, df = w.count(t), sum(t in x for x in words)
            if tf:
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / avg))
        return s

    want = {(i, d): score(t, w) for i, t in ((1, ["obra"]), (2, ["contrato", "obra"])) for d, w in enumerate(words) if score(t, w)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_dense_brute(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 8))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(500, None)], "vec_id long, embedding array<double>").repartition(5)
    q = df.where("vec_id < 7").select(F.col("vec_id").alias("query_id"), "embedding")
    got = R.dense_top_k(df, q, 5, block=3).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(7):
        sims = np.round(u @ u[i], 6)
        want = sorted(range(200), key=lambda j: (-sims[j], j))[:5]
        assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == i), key=lambda r: r["rank"])] == want


def test_fuse_rerank_cap(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, doc_id long, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id long, doc_id long, rank int")
    assert [(r["doc_id"], round(r["score"], 4)) for r in R.fuse([a, b], 10).orderBy("rank").collect()] == [(11, 0.8333), (10, 0.5), (12, 0.3333)]
    pts = spark.createDataFrame([(1, i, "s", "u", 4.0 - i * 0.1, 1, 2, "federal", 1.0) for i in range(5)] + [(1, 9, "t", "v", -9.0, 4, None, None, None)], "query_id long, doc_id long, source string, unit_id string, logit double, authority_level int, normative_rank int, jurisdicao string, extraction_confidence double")
    got = R.rerank(R.weighted(pts, F.lit("federal")), 3)
    assert [r["doc_id"] for r in got.orderBy("rank").collect()] == [0, 1]  # two of a unit, the third is under the threshold after the cut


def test_expand_and_budget(spark):
    chunks = spark.createDataFrame([("s", "u", "artigo", i) for i in range(8)] + [("", "", "x", 0), ("s", "w", "x", 0)], "source string, unit_id string, unit_kind string, chunk_index int")
    hits = spark.createDataFrame([("s", "u", 4, 0.9), ("s", "u", 5, 0.7), ("", "", 0, 1.0)], "source string, unit_id string, chunk_index int, evidence double")
    got = {r["chunk_index"]: r for r in R.expand(hits, chunks).collect()}
    assert sorted(got) == [0, 3, 4, 5, 6] and got[4]["is_hit"] and not got[3]["is_hit"] and got[0]["priority"] == 0.9 and got[6]["priority"] == 0.7
    ordered = [r["chunk_index"] for r in R.expand(hits, chunks).orderBy(*R.context_order()).collect()]
    assert ordered[:2] == [4, 5]
    items = spark.createDataFrame([([(1, 5, True), (2, 90, False), (3, 4, True), (4, 90, True), (5, 1, True)],), ([],)], "i array<struct<key:long,size:long,primary:boolean>>")
    out = items.select(R.within_budget(F.col("i"), 10).alias("r")).collect()
    assert out[0]["r"]["kept"] == [1, 3] and out[0]["r"]["stop"] and out[1]["r"]["kept"] == []


def test_append_and_best(spark):
    a = spark.createDataFrame([(1,), (2,)], "doc_id long")
    b = spark.createDataFrame([(2,), (3,)], "doc_id long")
    assert {tuple(r) for r in R.append_base(a, b, ["doc_id"]).collect()} == {(1, 0), (2, 0), (3, 1)}
    s = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.5), ("b", 3, 0.1)], "g string, k long, score double")
    assert {(r["g"], r["k"]) for r in R.best_per_group(s, ["g"], "k").collect()} == {("a", 1), ("b", 3)}


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([0.0, 0.0],), ([float("nan"), 1.0],), ([1.0],), (None,)], "v array<double>")
    assert [r[0] for r in df.select(V.fault(df["v"], 2)).collect()] == [None, "zero", "not finite", "dimension", "missing"]
    t = spark.createDataFrame([(["a", "b"],), ([],), (None,)], "t array<string>").select(V.hashed_bag(F.col("t"), 8).alias("v"))
    rows = [r["v"] for r in t.collect()]
    assert abs(sum(x * x for x in rows[0]) - 1) < 1e-9 and set(rows[1]) == {0.0} and rows[2] is None


def test_settings():
    assert Settings().checked() is not None
    assert len(Settings(chunk_overlap=2000, final_k=99, weight_evidence=0.9, candidates_k=0).errors()) == 4


def test_inverted_file(spark, tmp_path):
    from lexmill.operators import ann

    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    x = centres[rng.integers(0, 12, 3000)] + 0.4 * rng.normal(size=(3000, 16))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(9000, None), (9001, [0.0] * 16)], "vec_id long, embedding array<double>").repartition(6)
    c = ann.fit(df, 12)
    assert np.allclose(c, ann.fit(df.repartition(3), 12))
    indexed = ann.assign(df, c)
    assert indexed.count() == 3000
    q = df.where("vec_id % 20 = 0 and vec_id < 3000").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = R.dense_top_k(df.where("vec_id < 3000"), q, 10)
    every = ann.search(indexed, c, q, 10, 12)
    assert {tuple(r) for r in every.select("query_id", "vec_id", "rank").collect()} == {tuple(r) for r in exact.select("query_id", "vec_id", "rank").collect()}
    indexed.write.partitionBy("list_id").parquet(str(tmp_path / "ivf"))
    few = ann.search(spark.read.parquet(str(tmp_path / "ivf")), c, q, 10, 3, block=40)
    assert ann.recall(few, exact).agg(F.avg("recall")).first()[0] >= 0.9
    none = df.limit(0)
    assert ann.search(ann.assign(none, ann.fit(none, 4)), ann.fit(none, 4), q, 3, 2).count() == 0


def test_zero_vectors_and_ties(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0]), (4, [0.0, 1.0]), (5, None)], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(9, [0.0, 0.0]), (8, [3.0, 0.0])], "query_id long, embedding array<double>")
    got = [(r["query_id"], r["vec_id"], r["score"], r["rank"]) for r in R.dense_top_k(rows, asked, 2).orderBy("query_id", "rank").collect()]
    assert got == [(8, 2, 1.0, 1), (8, 3, 1.0, 2), (9, 1, 0.0, 1), (9, 2, 0.0, 2)]
    assert R.dense_top_k(rows, asked.limit(0), 2).count() == 0


def test_bm25_top_k_is_the_join_cut_short(spark, monkeypatch):
    import random

    r = random.Random(5)
    words = [f"palavra{'abcdefghij'[i]}{'abcdefghij'[j]}" for i in range(6) for j in range(6)]
    docs = spark.createDataFrame([(i, " ".join(r.choice(words) for _ in range(r.randint(0, 30)))) for i in range(300)] + [(900, None), (901, "")], "doc_id long, text string").repartition(5)
    asked = spark.createDataFrame([(1, " ".join(words[:4])), (2, words[0] + " nada " + words[0]), (3, "xyz"), (4, None)], "query_id long, query string")
    whole = R.top_k(R.bm25(docs, asked).withColumn("score", F.round("score", 6)), 7)
    take = lambda df: sorted((x["query_id"], x["rank"], x["doc_id"], x["score"]) for x in df.collect())
    assert take(R.bm25_top_k(docs, asked, 7)) == take(whole)
    monkeypatch.setattr(R, "VOCABULARY", 2)  # a larger query set is joined
    assert take(R.bm25_top_k(docs, asked, 7)) == take(whole)
    assert R.bm25_top_k(docs.limit(0), asked, 7).count() == 0


def test_context_label(spark):
    rows = [(1, "Lei de Tal", "lei.pdf", 3, 4, "Art. 5º", "norma", 1, "vigente", "federal", "2021-04-01", None, "abcdefghijklmnop", True, 0.5), (2, None, None, None, None, None, None, None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "n int, title string, source string, page int, page_end int, unit_ref string, source_role string, authority_level int, status string, jurisdicao string, effective_from string, effective_to string, version_sha256 string, context_only boolean, extraction_confidence double")
    a, b = [x[0] for x in df.orderBy("n").select(R.context_label(df, F.col("n"))).collect()]
    assert a == (
        "[F1] Lei de Tal (lei.pdf), pp. 3-4, Art. 5º | papel=norma | autoridade=1 | status=vigente | jurisdicao=federal | vigencia=2021-04-01 até indeterminada | recuperado_em=desconhecido | versão=abcdefghijkl"
        " | contexto_vizinho=true | origem_texto=desconhecido | confianca_extracao=0.500 | fonte=não informada"
    )
    assert b.startswith("[F2] fonte não identificada (arquivo desconhecido), p. desconhecida | papel=desconhecido | autoridade=desconhecida") and "versão" not in b
