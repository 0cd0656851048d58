import json

import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.operators import acceptance
from lexmill.sources import html as H
from lexmill.sources import ports, readers

PAGE = """<html><head><title>T</title><meta property="og:title" content="Manchete"><script type="application/ld+json">{"@graph":[{"@type":"Article","headline":"Título LD","datePublished":"2024-04-05","author":[{"name":"Ana"}]}]}</script></head>
<body><nav>Menu</nav><main><h1>H</h1><p>Um <b>texto</b> com <span style="text-decoration:line-through">riscado</span> fim.</p><ul><li>a<li>b</ul>
<table><tr><td>1</td><td>dois &amp; três</td></tr><tr><th>x</th></tr></table><a href="/doc/1#x">Doc</a><a href="/doc/1">De novo</a><a href="javascript:void(0)">J</a><a href="http://fora.example/y.pdf">PDF</a></main><footer>Rodapé</footer><script>var a=1;</script></body>"""


def test_html():
    text = H.page_text(PAGE)
    assert "Um texto com fim." in text.replace("  ", " ") and "Menu" not in text and "Rodapé" not in text and "riscado" not in text and "var a" not in text
    a = H.article(PAGE)
    assert (a["title"], a["date"], a["author"]) == ("Título LD", "2024-04-05", "Ana")
    for bad in ("", "<", "<p", "<<<>>>", "<div>" * 3000, "&#xFFFFFFF;", "<script>", "</p></p>"):
        H.page_text(bad)
    assert H.is_shell('<div id="root"></div><script src="x"></script>') and not H.is_shell(PAGE)


def test_links(spark):
    df = spark.createDataFrame([(1, "https://a.example/base", PAGE), (2, "https://a.example", None)], "k int, u string, h string")
    found = H.links(df, "k", "u", F.col("h"))
    assert [r["link"] for r in found.orderBy("place").collect()] == ["https://a.example/doc/1", "http://fora.example/y.pdf"]
    assert [r["link"] for r in H.discover(found, "k", [r"/doc/\d+"], [], 5).collect()] == ["https://a.example/doc/1"]
    assert H.discover(found, "k", [], ["doc"], 5, cross_host=True).count() == 1
    kinds = [r[0] for r in found.orderBy("place").select(H.link_kind(F.col("link"), F.col("label"))).collect()]
    assert kinds == ["page", "pdf"]
    rows = df.select(H.rows_of(F.col("h"))).collect()
    assert rows[0][0] == [["1", "dois & três"], ["x"]] and rows[1][0] == []


def test_readers(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "um.txt").write_text("p1\fp2", encoding="utf-8")
    (tmp_path / "a" / "um.json").write_text(json.dumps({"title": "T", "n": 1}), encoding="utf-8")
    (tmp_path / "a" / "dois.json").write_text("{", encoding="utf-8")
    docs = readers.text_documents(spark, str(tmp_path))
    assert [(r["stem"], r["text"]) for r in docs.collect()] == [("um", "p1\fp2")]
    side = {r["stem"]: r["title"] for r in readers.sidecars(spark, str(tmp_path), "title string, n int").collect()}
    assert side == {"um": "T", "dois": None}
    assert readers.binary_documents(spark, str(tmp_path), "*.txt").count() == 1
    (tmp_path / "s.csv").write_text("key; Numero ;ENUNCIADO\n1;247.0; um texto \n2;248;outro\n", encoding="utf-8")
    csv = readers.csv_table(spark, str(tmp_path / "s.csv"))
    assert csv.columns == ["KEY", "NUMERO", "ENUNCIADO"] and csv.first()["ENUNCIADO"] == "um texto"


def test_envelopes(spark):
    raws = ['{"documentos":[{"K":"1"}]}', '{"result":{"items":[{"K":"2"},{"K":"3"}]}}', '[{"K":"4"}]', "x", None]
    df = spark.createDataFrame([(r,) for r in raws], "r string")
    assert [[x["K"] for x in (r[0] or [])] for r in df.select(readers.json_rows(F.col("r"), "K:string")).collect()] == [["1"], ["2", "3"], ["4"], [], []]
    hit = spark.createDataFrame([('{"result":{"hits":{"hits":[{"_id":"a","_source":{"t":"x"}}]}}}',)], "r string")
    assert hit.select(readers.search_hits(F.col("r"), "t:string")).first()[0][0]["t"] == "x"
    xml = '<urlset><s:url><s:loc> https://a/b?x=1&amp;y=2 </s:loc></s:url><url><loc>https://c</loc></url></urlset>'
    rss = '<rss><item><title>a</title><link>https://x/1</link></item></rss><feed><entry><link rel="alternate" href="https://x/2"/></entry></feed>'
    r = spark.createDataFrame([(xml, rss)], "x string, f string").select(readers.sitemap_urls(F.col("x")), readers.feed_links(F.col("f"))).first()
    assert r[0] == ["https://a/b?x=1&y=2", "https://c"] and r[1] == ["https://x/1", "https://x/2"]


def test_sumulas(spark):
    t = "SÚMULAS\nSÚMULA Nº 1 - Primeira regra.\nHISTÓRICO: algo\nSÚMULA Nº 2 - Segunda (CANCELADA)\nSÚMULA Nº 3 -\n"
    got = readers.sumula_blocks(spark.createDataFrame([(1, t)], "k int, t string"), "k", "t").orderBy("number").collect()
    assert [(r["number"], r["statement"], r["status"]) for r in got] == [(1, "Primeira regra.", "VIGENTE"), (2, "Segunda", "CANCELADA")]


def test_decoding(spark):
    df = spark.createDataFrame([(bytearray("ação".encode()),), (bytearray("ação".encode("cp1252")),)], "c binary")
    assert [r[0] for r in df.select(readers.decoded(F.col("c"))).collect()] == ["ação", "ação"]
    k = spark.createDataFrame([(bytearray(b"%PDF-1.4"), None, None), (bytearray(b"<?xml v"), None, None), (bytearray(b"<html>"), "text/html", "a")], "c binary, t string, p string")
    assert [r[0] for r in k.select(readers.kind_of(F.col("c"), F.col("t"), F.col("p"))).collect()] == ["pdf", "xml", "html"]


def test_dead_letters(spark, tmp_path):
    bad = spark.createDataFrame([(1, ["x"], "validate"), (2, ["y"], "fetch")], "id int, error array<string>, stage string")
    readers.write_dead_letters(bad, str(tmp_path / "dlq"))
    readers.write_dead_letters(bad.limit(1), str(tmp_path / "dlq"))
    assert spark.read.json(str(tmp_path / "dlq")).groupBy("stage").count().count() == 2
    readers.write_json_file(str(tmp_path / "m" / "x.json"), {"a": "ç"})
    assert json.loads((tmp_path / "m" / "x.json").read_text(encoding="utf-8")) == {"a": "ç"}


def test_acceptance(spark):
    good = "LEI Nº 1\n" + "\n".join(f"Art. {i} Uma linha com mais de quarenta caracteres de texto corrido, sem dúvida, e ainda outro tanto para chegar lá." for i in range(10))
    rows = [(good, True), ("curto", False), ("x" * 900, False), ("carregando javascript " + "palavra longa que segue sem fim " * 40, False), (good.replace("LEI", "NOTA"), True), (None, False)]
    df = spark.createDataFrame(rows, "t string, n boolean")
    assert [r[0] for r in df.select(acceptance.reject_reason(df["t"], df["n"])).collect()] == [None, "short", "few lines", "few lines", "no header", "short"]


def test_ports():
    class Fake:
        size = 2

        def embed(self, texts):
            if len(texts) > 1:
                raise ports.ProviderError("too long")
            return [[1.0, float(len(texts[0]))]]

    assert ports.embed_all(Fake(), ["a", "bb", "ccc"]) == [[1.0, 1.0], [1.0, 2.0], [1.0, 3.0]]
    assert ports.split_long("um dois tres quatro", len, 8) == ["um dois", "tres", "quatro"] or all(len(x) <= 8 for x in ports.split_long("um dois tres quatro", len, 8))
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise ports.provider_error(429, "x")
        return "ok"

    assert ports.retried(flaky, sleep=lambda s: None) == "ok"
    assert isinstance(ports.provider_error(408, ""), ports.ProviderTimeout) and isinstance(ports.provider_error(None, ""), ports.ProviderNetwork)

    class Gen:
        def __init__(self, out):
            self.out = list(out)

        def generate(self, prompt, max_tokens):
            return self.out.pop(0)

    check = lambda a: None if "[F1]" in a else "no citation"
    assert ports.ask_with_repair(Gen(["x [F1]"]), "p", check, "não sei") == "x [F1]"
    assert ports.ask_with_repair(Gen(["x", "x [F1]"]), "p", check, "não sei") == "x [F1]"
    assert ports.ask_with_repair(Gen(["x", "y"]), "p", check, "não sei") == "não sei"


@pytest.mark.parametrize(("text", "terms"), [("Quais os prazos da Lei 14.133/2021 em 99 dias?", ["quais", "prazos", "lei", "14.133/2021", "dias"]), ("", []), (None, None)])
def test_terms(spark, text, terms):
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(X.query_terms(F.col("t"))).first()[0]
    assert got == terms


def test_stems(spark):
    words = ["licitacoes", "pagamento", "contratos", "ver", "administradores", "rapidamente"]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(X.stem(F.col("w"))).collect()]
    assert got == ["licit", "pagamento", "contrat", "ver", "administr", "rapida"]


def test_model_columns(spark):
    class Lengths:
        size = 1

        def embed(self, texts):
            return [[float(len(t))] for t in texts]

        def rerank(self, question, texts):
            return [float(len(set(question.split()) & set(t.split()))) for t in texts]

    df = spark.createDataFrame([("a b", "a b c"), ("a b", "x"), ("q", None), (None, "b")], "q string, t string").coalesce(1)
    assert [r[0] for r in df.select(ports.embedded(Lengths(), F.col("t"), 2)).collect()] == [[5.0], [1.0], None, [1.0]]
    assert [r[0] for r in df.select(ports.reranked(Lengths(), F.col("q"), F.col("t"))).collect()] == [2.0, 0.0, None, None]


def test_main_text_and_article_node():
    from lexmill.sources import html as H

    page = "<html><body><nav>Menu</nav><div id='x-conteudo'><p>Primeiro.</p><p>Ruído</p><p style='text-decoration: line-through'>Fora</p></div><p>Depois.</p></body></html>"
    assert H.main_text(page, frozenset(["Ruído"])) == "Primeiro." and H.page_text(page) == "Primeiro.\nRuído\nDepois."
    assert H.main_text(page.replace("<div", "<main><p>Núcleo</p></main><div")) == "Núcleo"
    assert H.main_text("<p>" + "a" * 10_001 + "</p><p>b</p>") == "b" and H.main_text("") == ""
    long = "<p>" + "Uma frase do artigo. " * 50 + "</p>"
    art = f"<body><p>Topo</p><article><p>curto</p></article><div class='post-content extra'>{long}<div class='share-box'>Compartilhe</div></div><footer>Fim</footer></body>"
    got = H.article(art)["body"]
    assert got.startswith("Uma frase") and "Topo" not in got and "Compartilhe" not in got and "Fim" not in got
    assert H.article("<body><p>Topo</p><article>curto</article></body>")["body"] == "Topo\ncurto"
