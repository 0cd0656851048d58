import pytest

from lexmill.operators import legal as L

LAW = """LEI Nº 1.234, DE 5 DE MAIO DE 2020.
Dispõe sobre obras.
TÍTULO I – DAS REGRAS
CAPÍTULO I – DO PRAZO
Art. 1º O prazo é de dez dias, conforme o art. 5 da Lei 9.999:
I - em obras;
a) grandes;
b) pequenas;
II - em serviços.
§ 1º Não corre prazo nos feriados.
§ 2º A lei fixará:
I - o modo.
CAPÍTULO II – DO RESTO
Art. 2º-A. Fica acrescido o art. 7º à Lei 8.888, com a seguinte redação:
“Art. 7º Novo texto.”
ANEXO I
1. Tabela
"""


def test_tree():
    nodes = L.parse(LAW, "d")
    kinds = [(n.kind, n.ref) for n in nodes]
    assert kinds == [("norma", None), ("titulo", "TÍTULO I – DAS REGRAS"), ("capitulo", "CAPÍTULO I – DO PRAZO"), ("artigo", "1º"), ("inciso", "I"), ("alinea", "a"), ("alinea", "b"), ("inciso", "II"), ("paragrafo", "§ 1º"), ("paragrafo", "§ 2º"), ("inciso", "I"), ("capitulo", "CAPÍTULO II – DO RESTO"), ("artigo", "2º-A"), ("anexo", "ANEXO I")]
    by = {(n.kind, n.ref, n.start): n for n in nodes}
    assert all(0 <= n.start <= n.end <= len(LAW) for n in nodes)
    last = [n for n in nodes if n.kind == "inciso"][-1]
    assert last.parent.ref == "§ 2º" and last.path[:2] == ["TÍTULO I – DAS REGRAS", "CAPÍTULO I – DO PRAZO"]
    assert [n.node_id for n in nodes if n.kind == "alinea"] == [f"d/artigo:1@{nodes[3].start}/inciso:I/alinea:a", f"d/artigo:1@{nodes[3].start}/inciso:I/alinea:b"]
    assert LAW[nodes[3].start : nodes[3].end].startswith("Art. 1º") and LAW[nodes[3].start : nodes[3].end].endswith("o modo.") and len(by) == len(nodes)


def test_scanned_marks_keep_offsets():
    t = "Artig0 1º Um.\nArt1go 2º Dois."
    assert len(L.view(t)) == len(t) and [n.ref for n in L.parse(t) if n.kind == "artigo"] == ["1º", "2º"]


@pytest.mark.parametrize("text", ["", " ", "sem nada", "Art.", "§", "a) b) c)", "Art. 5 da CF é citado.", "x" * 100_000, "Art. 1º " * 2000, "“" * 5000, "I - " * 3000])
def test_odd_texts(text):
    for n in L.parse(text):
        assert 0 <= n.start <= n.end <= len(text)


def test_amendment():
    n = [x for x in L.parse(LAW) if x.ref == "2º-A"][0]
    a = L.amendment(LAW[n.start : n.end], n.ref)
    assert a["operations"][0] == "acrescimo" and a["articles"] == ["7º"]
    assert L.amendment("Art. 3º O prazo é de dez dias.", "3º") is None
    assert L.operations("fica revogado o § 1º")[0] == "revogacao"


@pytest.mark.parametrize(("most", "overlap"), [(1, 0), (7, 3), (50, 10), (400, 399), (10_000, 0)])
def test_split_spans(most, overlap):
    spans = L.split_spans(LAW, most, overlap)
    assert all(b - a <= most for a, b in spans)
    covered = set()
    for a, b in spans:
        covered.update(range(a, b))
    assert {i for i, c in enumerate(LAW) if not c.isspace()} <= covered
    assert all(x[0] <= y[0] for x, y in zip(spans, spans[1:]))


def test_chunks_are_slices(spark):
    docs = spark.createDataFrame([("d", LAW), ("e", None), ("f", ""), ("g", "TRIBUNAL: TCU\nPROCESSO: 1/2\nEMENTA\nObra.\nVOTO\nSim.\nTRIBUNAL: STF\nSÚMULA: 7\nTexto.")], "doc_id string, text string")
    c = L.chunks(docs, most=80, overlap=10).collect()
    text = {"d": LAW, "g": docs.where("doc_id = 'g'").first()["text"]}
    assert all(text[r["doc_id"]][r["start"] : r["end"]] == r["text"] for r in c)
    assert all(len(r["page_content"]) <= 80 for r in c)
    assert {r["unit_kind"] for r in c if r["doc_id"] == "g"} == {"jurisprudencia"} and {r["segment_ref"] for r in c if r["doc_id"] == "g"} >= {"ementa", "voto", "metadados"}
    g = [r["chunk_index"] for r in c if r["doc_id"] == "g"]
    assert g == list(range(len(g)))
    assert [r["segment_kind"] for r in c if r["doc_id"] == "d" and r["unit_ref"] == "1º"][0] == "caput"


def test_other_units():
    assert [u[:2] for u in L.units("Início\nSúmula nº 12 Texto.\nSúmula nº 13 Outro.")] == [("generic", None), ("sumula", "Súmula nº 12"), ("sumula", "Súmula nº 13")]
    assert [u[0] for u in L.units("Tema nº 5 Um\nTema nº 6 Dois")] == ["tema", "tema"]
    assert L.units("texto solto", normative=False) == [("generic", None, 0, 11)] and L.units("  ") == []


def test_reads_the_table(spark, data):
    from lexmill.queries_core import QUERIES

    rows = {r["kind"]: r for r in QUERIES["q_legal_tree_recall"](spark, data).collect()}
    assert sum(r["found"] for r in rows.values()) >= 0.93 * sum(r["nodes"] for r in rows.values())


def test_child_kind(spark):
    from pyspark.sql import functions as F

    marks = ["§ 1º", "Parágrafo único", "IV -", "a)", "(b)", "3)", "12 -", "texto"]
    got = [r[0] for r in spark.createDataFrame([(m,) for m in marks], "m string").select(L.child_kind(F.col("m"))).collect()]
    assert got == ["paragrafo", "paragrafo", "inciso", "alinea", "alinea", "item", "item", None]


def test_composed_drops_general_levels_first():
    import pytest

    path = ["LEI Nº 1", "CAPÍTULO II", "Art. 3º"]
    assert L.composed("[P]", path, "corpo", False, 1000) == ("[P] [HIERARQUIA: LEI Nº 1 > CAPÍTULO II > Art. 3º]\ncorpo", path)
    text, kept = L.composed("[P]", path, "corpo", False, 45)
    assert kept == ["CAPÍTULO II", "Art. 3º"] and len(text) <= 45
    assert L.composed("[P]", path, "LEI Nº 1 > CAPÍTULO II > Art. 3º corpo", False, 1000)[0].count("LEI") == 1
    assert "HIERARQUIA" not in L.composed("[P]", path, "corpo", True, 1000)[0]
    with pytest.raises(ValueError):
        L.composed("[P]", path, "corpo " * 40, False, 100)


def test_articles_quoted_by_a_change_are_no_articles():
    text = 'Art. 1º A Lei passa a vigorar com a seguinte redação:\n"Art. 9º O novo texto vale."\nArt. 2º Esta lei entra em vigor.'
    assert [n.ref for n in L.parse(text) if n.kind == "artigo"] == ["1º", "2º"]
    closed = 'Art. 1º A Lei passa a vigorar com a redação "nova" e assim fica.\nArt. 2º Esta lei entra em vigor.'
    assert [n.ref for n in L.parse(closed) if n.kind == "artigo"] == ["1º", "2º"]
