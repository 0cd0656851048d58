import uuid

from pyspark.sql import functions as F

from lexmill.operators import index as I
from lexmill.operators import metadata as M
from lexmill.operators import pages as P
from lexmill.operators import records as R


def test_index_versions(spark, tmp_path):
    ix = I.Index(spark, str(tmp_path / "ix"))
    assert ix.read() is None and ix.manifest() == {}
    a = spark.createDataFrame([("d1", 0, "x", "norma"), ("d2", 0, "y", "norma")], "doc_id string, n int, t string, source_role string")
    ix.write(a, {"v": 1}, sort=["doc_id"])
    b = spark.createDataFrame([("d2", 0, "new", "norma"), ("d2", 1, "more", "norma"), ("d3", 0, "z", "doutrina")], a.schema)
    ix.merge(b, {"v": 1})
    got = {(r["doc_id"], r["n"], r["t"]) for r in ix.read().collect()}
    assert got == {("d1", 0, "x"), ("d2", 0, "new"), ("d2", 1, "more"), ("d3", 0, "z")}
    assert ix.check({"v": 2}) == ["v"]
    try:
        ix.merge(b, {"v": 2})
        raise AssertionError
    except ValueError:
        pass
    ix.merge(b, {"v": 1})  # the same again changes nothing
    assert {(r["doc_id"], r["n"], r["t"]) for r in ix.read().collect()} == got


def test_stale_skip_changed(spark):
    cur = spark.createDataFrame([("a", 1, "u"), ("b", 2, "v")], "doc_id string, n int, seen string")
    new = spark.createDataFrame([("a", 1, "w"), ("b", 3, "v"), ("c", 1, "x")], cur.schema)
    assert [r[0] for r in I.stale(cur, new.where("doc_id <> 'a'")).collect()] == ["a"]
    assert sorted(r[0] for r in I.changed(cur, new, "doc_id", ["seen"]).collect()) == ["b", "c"]
    cand = spark.createDataFrame([("a", "s", "f"), ("b", "s2", "f"), ("c", "s", "f")], "doc_id string, sha256 string, fingerprint string")
    cache = spark.createDataFrame([("a", "s", "f", 3, 1), ("b", "s", "f", 3, 1), ("c", "s", "f", 3, 1)], "doc_id string, sha256 string, fingerprint string, chunks int, version int")
    counts = spark.createDataFrame([("a", 3), ("b", 3), ("c", 2)], "doc_id string, indexed int")
    assert {r["doc_id"]: r["skip"] for r in I.to_process(cand, cache, counts, 1).collect()} == {"a": True, "b": False, "c": False}
    assert not any(r["skip"] for r in I.to_process(cand, cache, counts, 2).collect())


def test_pages_and_facets(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], ["x", "x", str(i % 3)]) for i in range(10)], "k int, f string, t array<string>")
    assert {r["value"]: r["n"] for r in I.facet(df, "f").collect()} == {"a": 5, "b": 5}
    assert {r["value"]: r["n"] for r in I.facet(df, "t").collect()}["x"] == 10
    assert [r["k"] for r in I.page(df, "k", 3, 2).collect()] == [4, 5]


def test_uuid(spark):
    names = ["", "a|b|0|texto", "ção|ü", "x" * 1000]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(M.uuid5(F.col("n"))).collect()] == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]


def test_records(spark):
    cols = "tribunal string, tipo_documento string, numero_processo string, numero_sumula string, numero_decisao string, tipo_decisao string, ementa string, url_oficial string, relator string, orgao_julgador string, situacao string, tese string, decisao string, inteiro_teor string"
    row = ("TCU", "acordao", "1/2", None, "3", None, "e", "https://a.b/c;jsessionid=XX?q=1", "r", "o", "s", None, "d", " t ")
    df = spark.createDataFrame([row, ("TCU", "acordao", None, None, "3", None, "e", "ftp://x", None, None, None, None, None, None), ("XX", "sumula", None, "7a", None, None, None, None, None, None, None, None, None, None)], cols)
    assert [r[0] for r in df.select(R.faults(df)).collect()] == [[], ["numero_processo", "url_oficial"], ["tribunal", "numero_sumula"]]
    good, bad = R.split_good_bad(df)
    assert good.count() == 1 and bad.where("size(error) > 0 and stage = 'validate'").count() == 2
    keys = [r[0] for r in df.select(R.document_key(df)).collect()]
    assert len(set(keys)) == 3 and all(len(k) == 20 for k in keys)
    again = spark.createDataFrame([(*row[:7], "https://a.b/c;jsessionid=YY?q=1", *row[8:])], cols)
    v = lambda d: d.select(R.version_hash(d, d.columns)).first()[0]
    assert v(again) == v(df.limit(1))
    text = df.select(R.index_text(df)).first()[0]
    assert text.startswith("TRIBUNAL: TCU\nPROCESSO: 1/2\n") and text.endswith("\nINTEIRO TEOR:\nt")
    assert [r[0] for r in spark.createDataFrame([("247.0",), ("12",), ("x",), (None,)], "n string").select(R.sumula_number(F.col("n"))).collect()] == [247, 12, None, None]


def test_keep(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3)], "k string, o int")
    assert {tuple(r) for r in R.keep_one(df, ["k"], [F.col("o")]).collect()} == {("a", 1), ("b", 3)} == {tuple(r) for r in R.keep_best(df, ["k"], F.struct("o")).collect()}


def test_pages(spark):
    docs = spark.createDataFrame([(1, "TOPO\num texto\n9\fTOPO\noutro con-\n texto\n10\fLEI X\nfim"), (2, None)], "doc_id int, t string")
    p = P.split_pages(docs, "doc_id", "t")
    assert [(r["page"], r["start"]) for r in P.page_offsets(p, "doc_id").orderBy("page").collect()] == [(1, 0), (2, 16), (3, 42)]
    pts = spark.createDataFrame([(1, 0), (1, 15), (1, 16), (1, 999)], "doc_id int, at int")
    assert sorted((r["at"], r["page"]) for r in P.page_of(P.page_offsets(p, "doc_id"), pts, "doc_id", "at").collect()) == [(0, 1), (15, 1), (16, 2), (999, 3)]
    assert [(r["line"], r["pages"]) for r in P.repeated_edges(p, "doc_id").collect()] == [("topo", 2)]
    assert {r["page"]: r["page_text"] for r in P.without_edges(p, "doc_id").collect()}[1] == "um texto\n9"
    clean = [r[0] for r in p.orderBy("page").select(P.sanitize(F.col("page_text"))).collect()]
    assert clean == ["TOPO\num texto", "TOPO\noutro contexto", "LEI X\nfim"]
    c = spark.createDataFrame([("",), ("a" * 180,), ("�" * 100 + "b" * 100,), (None,)], "t string").select(P.confidence(F.col("t"))).collect()
    assert [r[0] for r in c][0:2] == [0.0, 1.0] and 0 < c[2][0] < 0.5 and c[3][0] == 0.0


def test_metadata(spark):
    t = spark.createDataFrame([("LEI Nº 14.133, DE 1º DE ABRIL DE 2021\nPROCESSO: 12/2020\nPregão Eletrônico. Cita a Lei 8.666 e a lei nº 10.520.",)], "t string")
    r = t.select(M.norm_header(F.col("t")).alias("h"), M.header_value(F.col("t"), "PROCESSO").alias("p"), M.first_named(F.col("t"), M.MODALITIES).alias("m"), M.cited_regimes(F.col("t")).alias("c"), M.regime(F.lit("x"), F.lit("y"), F.col("t"), F.lit("norma")).alias("r")).first()
    assert tuple(r["h"]) == ("lei", "14133", 2021) and r["p"] == "12/2020" and r["m"] == "Pregão Eletrônico" and r["c"] == ["lei_14133", "lei_8666", "lei_10520"] and r["r"] == "lei_14133"
    names = spark.createDataFrame([("sp-lei14133.txt",), ("acordao_tcu.pdf",), ("lei_1.txt",), ("nada.txt",)], "n string")
    assert [(x["ambiguous"], x["source_role"]) for x in (r[0] for r in names.select(M.source_rules(F.col("n"))).collect())] == [(True, "desconhecido"), (False, "jurisprudencia_controle"), (False, "norma"), (False, "desconhecido")]


def test_numbered_and_as_of(spark):
    from lexmill.operators.ordering import as_of, numbered

    rows = [("a" if i % 5 else None, (i * 7919) % 1000, i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, o int, i int").repartition(9)
    got = {(r["g"], r["i"]): r["place"] for r in numbered(df, ["g"], [F.col("o"), F.col("i")], "place").collect()}
    for g in ("a", None):
        want = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2]))
        assert [got[(g, r[2])] for r in want] == list(range(1, len(want) + 1))
    assert numbered(df.limit(0), ["g"], [F.col("i")], "place").count() == 0
    pts = spark.createDataFrame([("k", 1, "p"), ("k", 5, "q"), ("k", 5, "r"), ("m", 3, "s")], "key string, at int, x string")
    marks = spark.createDataFrame([("k", 5, "five"), ("k", 2, "two"), ("z", 1, "no")], "key string, at int, v string")
    assert {(r["x"], r["v"]) for r in as_of(pts, marks, ["key"], "at", "v").collect()} == {("p", None), ("q", "five"), ("r", "five"), ("s", None)}


def test_pointer_is_replaced_on_any_file_system(spark, tmp_path):
    from lexmill.operators import index as ix

    at = f"file://{tmp_path}/a/current.json"
    assert ix.read_file(spark, at) is None
    for text in ("{}", '{"versão": 2}'):
        ix.replace_file(spark, at, text)
        assert ix.read_file(spark, at) == text
    assert [p.name for p in (tmp_path / "a").iterdir() if not p.name.startswith(".")] == ["current.json"]


def test_no_folder_of_one_machine_on_a_cluster(monkeypatch):
    import pytest

    from lexmill import session

    class Conf:
        def get(self, *_):
            return None

    class Here:
        master = "spark://x:7077"

        class _jsc:
            @staticmethod
            def sc():
                class S:
                    @staticmethod
                    def getCheckpointDir():
                        class O:
                            @staticmethod
                            def isEmpty():
                                return True

                        return O

                return S

    class Session:
        conf, sparkContext = Conf(), Here()

    with pytest.raises(RuntimeError):
        session.checkpoint_dir(Session())
