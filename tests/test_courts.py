import json

from pyspark.sql import functions as F

from lexmill import cli
from lexmill.functions import dates as D
from lexmill.operators import legal, metadata, pages
from lexmill.sources import catalog, courts, crawl, ports


def test_result_table(spark):
    page = "<p>Foram encontrados 1.234 registros</p><table><tr><th>a</th></tr><tr><td>Voto</td><td>TC-001.002/989/20</td><td>05/03/2021</td><td>A</td><td></td><td>Obra</td><td>Ponte</td><td>2021</td></tr><tr><td>trecho da decisão</td></tr></table>"
    df = spark.createDataFrame([(1, page), (2, None)], "k int, h string")
    r = courts.result_table(df, "k", "h").collect()
    assert len(r) == 1 and str(r[0]["data"]) == "2021-03-05" and r[0]["partes"] == ["A"] and r[0]["trecho"] == "trecho da decisão" and r[0]["numero_processo"]
    assert [x[0] for x in df.select(courts.result_count(F.col("h"))).collect()] == [1234, None]
    assert [x[0] for x in spark.createDataFrame([("Resolva o captcha",), ("ok",), (None,)], "p string").select(courts.is_blocked(F.col("p"))).collect()] == [True, False, False]


def test_envelope(spark):
    raw = json.dumps({"result": {"hits": {"hits": [{"_id": "1", "_source": {"processo_codigo_completo": " RE  1 ", "julgamento_data": "2020-05-01", "ementa_texto": "E", "documental_tese_texto": " "}}]}}})
    schema = "processo_codigo_completo:string,orgao_julgador:string,relator_acordao_nome:string,julgamento_data:string,publicacao_data:string,ementa_texto:string,documental_tese_texto:string,inteiro_teor_texto:string"
    from lexmill.sources import readers

    hits = spark.createDataFrame([(raw,)], "r string").select(F.explode(readers.search_hits(F.col("r"), schema)).alias("s"))
    r = courts.envelope_records(hits, "s").first()
    assert r["numero_processo"] == "RE 1" and str(r["data"]) == "2020-05-01" and r["tese"] is None
    assert courts.search_body(["a", "b"], 900)["size"] == 250


def test_sumulas(spark):
    rows = spark.createDataFrame([("247.0", "Uma <b>regra</b>", "SIM", "3", "2004", "Obra", None, 1), ("247", "Outra", "NÃO", None, None, None, "x", 2), ("", "Sem número", "SIM", None, None, None, None, 3), ("9", " ", "SIM", None, None, None, None, 4)], "NUMERO string, ENUNCIADO string, VIGENTE string, NUMAPROVACAO string, ANOAPROVACAO string, AREA string, TEMA string, at int")
    got = courts.sumula_table(rows.repartition(3), "at").collect()  # the last in its file, whatever the partitions
    assert [(r["numero"], r["tese"], r["situacao"], r["assunto"]) for r in got] == [(247, "Outra", "REVOGADA", ["x"])]
    assert courts.too_few_sumulas(courts.sumula_table(rows), 2).count() == 1 and courts.too_few_sumulas(courts.sumula_table(rows), 1).count() == 0
    t = spark.createDataFrame([("SÚMULA TCU 12: O prazo é de dez dias. Fundamento legal: x",), ("nada",)], "t string").select(courts.sumula_text(F.col("t")).alias("s")).collect()
    assert tuple(t[0]["s"]) == (12, "O prazo é de dez dias.") and tuple(t[1]["s"]) == (None, None)


def test_catalogue(spark):
    c = spark.createDataFrame([("a", "norma", ["https://www.x.gov/1", "https://www.x.gov/1"], 1, True, None), ("b", "norma", ["https://x.gov/2"], 1, False, None), ("c", "doutrina", ["https://y.com"], 4, True, 50)], "id string, source_role string, urls array<string>, authority_level int, follow_links boolean, max_follow int")
    assert [r["id"] for r in catalog.one_per_host(c).collect()] == ["a"]
    assert {r["id"]: r["max_follow"] for r in catalog.with_limit(c, 12).collect()} == {"a": 12, "b": None, "c": 12}
    assert catalog.urls(c).count() == 3 and [r[0] for r in catalog.unknown_ids(c, ["a", "z"]).collect()] == ["z"]
    assert [r[0] for r in catalog.select_sources(c, following=True, most_level=2).select("id").collect()] == ["a"]
    failed = spark.createDataFrame([("b",), ("c",), ("c",)], "id string")
    assert [r[0] for r in catalog.failures_that_count(c, failed, F.col("source_role") == "doutrina").collect()] == ["b"]


def test_crawl(spark):
    class Site:
        pages = {"https://a.gov/": (200, b'<a href="/doc/1">Um</a><a href="/doc/2">Dois</a><a href="https://b.gov/doc/3">Fora</a><a href="/quebrado">X</a>', "text/html"), "https://a.gov/doc/1": (200, b"<p>um</p>", "text/html"), "https://a.gov/doc/2": (500, b"", "text/html")}

        def fetch(self, url, etag=None):
            if url not in self.pages:
                raise ports.ProviderNetwork(url)
            return self.pages[url]

    c = crawl.Crawl(include=[r"/doc/\d", "quebrado"])
    assert [u for u, _, _ in c.pages(Site(), ["https://a.gov/"])] == ["https://a.gov/", "https://a.gov/doc/1"] and len(c.failed) == 2
    assert crawl.first_good(Site(), ["https://z", "https://a.gov/doc/2", "https://a.gov/doc/1"], lambda b: None)[0] == "https://a.gov/doc/1"
    assert crawl.to_table(spark, crawl.Crawl(most_pages=1).pages(Site(), ["https://a.gov/"])).count() == 1


def test_pages_and_dates(spark):
    df = spark.createDataFrame([([90.0, -1.0, 70.0],), ([],), (None,)], "c array<double>")
    assert [r[0] for r in df.select(pages.ocr_confidence(F.col("c"))).collect()] == [0.8, 0.0, 0.0]
    rows = [("x" * 100, 0.9, "o", 0.5), ("curto", 0.9, "lido", 0.7), ("curto", 0.9, None, None)]
    got = [tuple(r[0]) for r in spark.createDataFrame(rows, "n string, c double, o string, oc double").select(pages.choose_text(*[F.col(c) for c in ("n", "c", "o", "oc")])).collect()]
    assert got == [("x" * 100, "native", 0.9), ("lido", "ocr", 0.7), ("curto", "native", 0.35)]
    assert [str(r[0]) for r in spark.createDataFrame([("D:20240405120000",), ("x",)], "d string").select(D.pdf_date(F.col("d"))).collect()] == ["2024-04-05", "None"]


def test_metadata_extract(spark):
    df = spark.createDataFrame([("lei_14133_01022021.pdf", "LEI Nº 14.133, DE 1º DE ABRIL DE 2021\nMunicípio: Nova Lori\nProcesso nº 12/2020. Pregão Eletrônico. Menor preço. Lei 8.666.", None), ("acordao_tcu.txt", None, "XYZ"), ("acordao_tcu_2.txt", None, " "), ("x.txt", "TRIBUNAL: TJSP\nPROCESSO: 77/2019\nRELATOR: Ana", None), ("y.txt", "TRIBUNAL: TJMG\n", None)], "name string, text string, meta_orgao string")
    r = {x["name"]: x for x in metadata.extract(df, "name", "text", ["orgao"]).collect()}
    a, b = r["lei_14133_01022021.pdf"], r["acordao_tcu.txt"]
    assert (a["municipio"], a["modalidade"], a["tipo"], a["processo"], a["norm_numero"], a["norm_ano"], a["data_versao"]) == ("Nova Lori", "Pregão Eletrônico", "Menor Preço", "12/2020.", "14133", 2021, "2021-02-01") or a["processo"].startswith("12/2020")
    assert a["authority_level"] == 1 and a["normative_rank"] == 2 and a["regime_juridico"] == "lei_14133" and a["cited_regimes"] == ["lei_8666"]
    assert (b["orgao"], b["source_role"], b["regime_juridico"], b["jurisdicao"]) == ("XYZ", "desconhecido", "nao_especificado", None)  # a given scope: the name says nothing
    c, x, y = r["acordao_tcu_2.txt"], r["x.txt"], r["y.txt"]
    assert (c["orgao"], c["tribunal"], c["source_role"], c["authority_level"], c["regime_juridico"], c["norma_canonica"]) == ("TCU", "TCU", "jurisprudencia_controle", 2, "jurisprudencia", "Jurisprudência")
    assert (x["orgao"], x["jurisdicao"], x["esfera"], x["authority_level"], x["processo"], x["relator"], x["status"], x["metadata_ambiguous"]) == ("TJSP", "estadual_sp", "estadual", 2, "77/2019", "Ana", "jurisprudencia", False)
    assert (y["tribunal"], y["jurisdicao"], y["authority_level"], y["metadata_ambiguous"]) == ("TJMG", None, None, True)


def test_titles_and_budget():
    t = "CAPÍTULO I\nDAS DISPOSIÇÕES GERAIS\nArt. 1º Um."
    assert [n.ref for n in legal.parse(t)][1] == "CAPÍTULO I — DAS DISPOSIÇÕES GERAIS"
    assert legal.budget(1000, 150, 512, 30) == (418, 150)


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "lei_1.txt").write_text("LEI Nº 1, DE 2 DE MAIO DE 2020.\nArt. 1º O prazo de recurso é de dez dias úteis.\nArt. 2º A dispensa de licitação exige parecer.", encoding="utf-8")
    assert cli.main(["index", str(tmp_path / "docs"), str(tmp_path / "ix")]) == 0
    assert cli.main(["ask", str(tmp_path / "ix"), "-q", "prazo de recurso", "--json"]) == 0
    assert "dez dias" in capsys.readouterr().out
    assert cli.main(["ask", str(tmp_path / "nada"), "-q", "x"]) == 1
