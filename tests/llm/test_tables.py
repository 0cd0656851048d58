"""Operators over tables: nulls, ties, repeated rows, empty tables, clashing columns, brute force."""

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lexmill.llm import contamination, encoding, furniture, markup, mixing, quality, queries, representative, scans, splitter

LOREM = "A câmara decidiu que o contrato da empresa é válido, conforme o art. 5º da lei, e negou o recurso. "


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs_over_whole_tables(name, spark, data):
    df = queries.QUERIES[name](spark, data)
    assert df.columns and df.count() >= 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(name, same):
    same(queries.QUERIES[name], queries.ORACLES[name])


def test_nothing_else_imports_the_subpackage():
    root = Path(__file__).resolve().parents[2]
    for p in (root / "lexmill").rglob("*.py"):
        if "llm" not in p.parts:
            assert "lexmill.llm" not in p.read_text(encoding="utf-8"), p


# --- p1, p2, p4, p5, p10: a table of odd rows -------------------------------------------------------------------------

ODD = [(1, None, None, None), (2, "", " ", ""), (3, LOREM * 400, "<b>" + LOREM, "http://a.gov/x"), (3, LOREM * 400, "<b>" + LOREM, "http://a.gov/x"), (None, "Voltar ao topo", "&nbsp;", None), (4, "Ã§Ã£o �", "x", "nada")]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "record_id long, ementa string, tese string, url_oficial string")
    clash = ["p", "_key", "text", "field_name", "key", "host", "page", "element", "gram", "n", "c", "r"]
    return df.withColumns({c: F.lit("clash") for c in clash})


def test_markup_table(odd):
    got = markup.clean_fields(odd, "record_id", ["ementa", "tese"])
    assert sorted((r["record_id"] or 0, r["field_name"]) for r in got.collect()) == [(0, "tese"), (3, "tese"), (3, "tese")]
    assert markup.clean_fields(odd.limit(0), "record_id", ["ementa"]).count() == 0


def test_encoding_table(odd):
    got = encoding.restore_fields(odd, "record_id", ["ementa", "tese"]).collect()
    assert [(r["record_id"], r["field_name"], r["complete"]) for r in got] == [(4, "ementa", False)]
    assert encoding.restore_fields(odd.limit(0), "record_id", ["ementa"]).count() == 0


def test_scan_table(spark):
    rows = [("t", "1", None), ("t", "2", ""), ("t", "3", LOREM * 300), ("t", "4", "a deci-\nsão da câ-\nmara"), ("t", "4", "a deci-\nsão da câ-\nmara"), (None, None, "fls. 3\n" + LOREM)]
    df = spark.createDataFrame(rows, "table_name string, row_key string, text string").withColumns({"a": F.lit(1), "b": F.lit(2), "n": F.lit(3)})
    got = scans.repair_scans(df).collect()
    assert sorted((r["row_key"] or "") for r in got) == ["", "4", "4"]
    assert scans.repair_scans(df.limit(0)).count() == 0


def test_furniture_table(spark):
    page = lambda i, h: (i, f"Sobe tudo\n{LOREM}\nQuintais", None, f"https://{h}.gov/doc/{i}")
    rows = [page(1, "a"), page(2, "a"), page(3, "a"), page(3, "a"), (9, "Vai ao rol\n" + LOREM, None, "https://b.gov/1"), (10, None, None, None), (11, LOREM, "", "https://a.gov/doc/11")]
    df = spark.createDataFrame(rows, "record_id long, ementa string, inteiro_teor string, url_oficial string").withColumns({c: F.lit("x") for c in ("host", "page", "element", "place", "keys", "found", "text")})
    got = furniture.main_text(df, "record_id", ["ementa", "inteiro_teor"], "url_oficial")
    assert sorted(r["record_id"] for r in got.select("record_id").distinct().collect()) == [1, 2, 3]  # what stands on one page alone is no template
    assert {r["main_text"] for r in got.collect()} == {LOREM.strip()}
    assert furniture.template_elements(df.limit(0), "record_id", ["ementa"], "url_oficial").count() == 0


def test_furniture_pages_without_address_make_no_host(spark):
    rows = [(i, f"Sobe tudo\n{LOREM}", None) for i in range(20)]
    df = spark.createDataFrame(rows, "record_id long, ementa string, url_oficial string")
    assert furniture.template_elements(df, "record_id", ["ementa"], "url_oficial").count() == 0


def test_furniture_counts_against_sentences(spark):
    """Words broken off at a line end, or often the beginning of sentences, are no template however often they recur."""
    rows = [(i, f"Conforme o relato de ontem\nRui {i} saiu cedo da vila. Conforme o relato de ontem Ana {i} ficou até tarde na horta.\nQuintais e pomares", f"https://a.gov/{i}") for i in range(12)]
    df = spark.createDataFrame(rows, "record_id long, ementa string, url_oficial string")
    got = furniture.main_text(df, "record_id", ["ementa"], "url_oficial").collect()
    assert len(got) == 12 and all(r["main_text"].startswith("Conforme o relato") and "Quintais" not in r["main_text"] for r in got)


def test_furniture_found_alike_in_a_hot_host(spark, monkeypatch):
    """Hot keys by broadcast or not: the same."""
    rows = [(i, f"Sobe tudo | Quintais | Vai ao começo\n{LOREM}\nQuero {'ler' if i % 3 else 'ouvir'} mais", f"https://{'a' if i % 4 else 'b'}.gov/{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "record_id long, ementa string, url_oficial string")
    take = lambda: sorted(map(tuple, furniture.template_elements(df, "record_id", ["ementa"], "url_oficial").collect()))
    few = take()
    monkeypatch.setattr(furniture, "HOT_SHARE", 2.0)
    assert take() == few and len(few) == 60 * 4


def test_quality_table(spark):
    rows = [(1, LOREM), (2, None), (3, ""), (4, "1;2;3\n" * 50), (4, "1;2;3\n" * 50), (5, "}{][*&" * 500), (6, "uma palavra " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("cells", "sizes", "n_words", "kind")})
    words = spark.createDataFrame([("pt", w) for w in ("a", "o", "que", "da", "de", "e")] + [("pt", None)], "lang string, word string")
    got = {r["doc_id"]: r for r in quality.quality(df, words).collect()}
    assert len(got) == 6 and got[1]["kind"] == "prose" and got[2]["kind"] == got[3]["kind"] == "empty" and got[4]["kind"] in ("table", "list") and got[5]["kind"] == "junk"
    assert got[2]["n_words"] == 0 and quality.quality(df.limit(0), words).count() == 0 and quality.quality(df, words.limit(0)).count() == 7


# --- p3 ---------------------------------------------------------------------------------------------------------------

DECISION = (
    "record_id long, tribunal string, tipo_documento string, numero_processo string, numero_sumula string, orgao_julgador string, relator string, data string, data_publicacao string, ementa string, tese string, "
    "decisao string, inteiro_teor string, url_oficial string, tipo_decisao string, numero_decisao string, origem string, data_autuacao string, situacao string, retrieved_at timestamp, version_sha256 string, mask int, trust int, best string"
)


def decision(i, **kw):
    base = dict(tribunal="TCU", tipo_documento="acordao", numero_processo="TC 1/2", numero_decisao="5/2020", origem="Bom", data="2020-01-01", relator="R", situacao="vigente", retrieved_at=dt.datetime(2024, 1, 1), mask=1, trust=2, best="clash")
    base |= kw | {"record_id": i}
    return tuple(base.get(c.split()[0]) for c in DECISION.split(", "))


def brute_sources(rows, levels):
    """The rule said plainly, row by row."""
    names = [c.split()[0] for c in DECISION.split(", ")]
    groups = {}
    for r in (dict(zip(names, t)) for t in rows):
        k = "".join(c for c in f"{r['numero_processo']}|{r['numero_decisao']}".upper() if c.isalnum() or c == "|")
        groups.setdefault(k, []).append(r)
    out = set()
    for rs in groups.values():
        if len(rs) < 2:
            continue
        for f in representative.FIELDS:
            ok = [r for r in rs if r[f] and r[f].strip() and r[f].strip().lower() not in ("-", "n/d", "não informado", "a publicar") and r[f] != "31/02/2020"]
            if ok:
                best = min(ok, key=lambda r: (levels.get(r["origem"], 99), -(r["retrieved_at"].timestamp() if r["retrieved_at"] else -1e18), r["record_id"]))
                out.add((best["record_id"], f))
    return out


def test_representative_brute(spark):
    import random

    r = random.Random(7)
    rows = []
    for i in range(300):
        pick = lambda *v: r.choice(v)
        rows.append(decision(i, numero_processo=pick("TC 1/2", "tc-1.2", "TC 3/4"), numero_decisao=pick("5/2020", "5-2020", "6/2020", "7/2020", str(i)), origem=pick("Bom", "Ruim", None, "Outro"), data=pick("2020-01-01", "31/02/2020", None, " ", "05/05/2020"),
                             data_publicacao=pick(None, "a publicar", "1 de maio de 2020"), relator=pick("R", "-", "não informado", None), orgao_julgador=pick("O", "N/D", ""), situacao=pick("vigente", None), retrieved_at=pick(None, dt.datetime(2024, 1, 1), dt.datetime(2025, 1, 1))))
    levels = {"Bom": 1, "Ruim": 3}
    cat = spark.createDataFrame([("Bom", 1), ("Ruim", 3)], "title string, authority_level int")
    got = {tuple(x) for x in representative.field_sources(spark.createDataFrame(rows, DECISION), cat).collect()}
    assert got == brute_sources(rows, levels)


def test_representative_edges(spark):
    cat = spark.createDataFrame([("Bom", 1)], "title string, authority_level int")
    rows = [decision(1), decision(2, tribunal="Tribunal de Contas da União"), decision(3, tribunal=None), decision(4, numero_processo=None, numero_decisao=None), decision(5, tipo_documento="sumula", numero_processo="", numero_decisao=None, numero_sumula="12"), decision(6, tipo_documento=None, numero_processo=None, numero_decisao=None, numero_sumula="12", relator=None), decision(7, numero_decisao="9", relator=None), decision(8, numero_decisao="9", relator="X", origem=None)]
    df = spark.createDataFrame(rows, DECISION)
    got = {tuple(x) for x in representative.field_sources(df, cat).collect()}
    assert got == {(1, "data"), (1, "relator"), (1, "situacao"), (5, "data"), (5, "relator"), (5, "situacao"), (7, "data"), (8, "relator"), (7, "situacao")}
    s = {r["group_key"]: r for r in representative.survivors(df, cat).collect()}
    assert len(s) == 5 and s["D|TCU|TC12|9"]["relator"] == "X" and s["D|TCU|TC12|9"]["n_rows"] == 2 and s["S|TCU|12"]["n_rows"] == 2
    assert representative.field_sources(df.limit(0), cat).count() == 0 and representative.survivors(df.limit(0), cat).count() == 0


# --- p6 ---------------------------------------------------------------------------------------------------------------


def test_splitter(spark):
    long = ("Uma frase curta. Outra frase, com vírgula; e mais uma.\n\nNovo parágrafo aqui. " * 300).strip()
    limits = [("t", "a", 100, 20), ("t", "b", 10, 30), ("t", "c", 1, 0), ("t", "d", 0, 0), ("t", "e", 7, None), ("t", "f", 1000, 150)]
    rows = [("t", k, k, long) for k in "abcdef"] + [("t", "a2", "a", long), ("t", "a2", "a", long), ("t", "n", "a", None), ("t", "s", "a", "x" * 100), ("t", "u", "a", "x" * 101), ("t", "z", None, long), ("t", "e2", "a", "𝒜é" * 120)]
    df = spark.createDataFrame(rows, "table_name string, row_key string, kind string, text string").withColumns({"_max": F.lit(1), "_over": F.lit(2), "max_chars": F.lit(3)})
    lim = spark.createDataFrame(limits, "table_name string, kind string, max_chars int, overlap_chars int")
    got = splitter.split_oversized(df, lim).collect()
    by = {}
    for r in got:
        by.setdefault(r["row_key"], []).append(r)
    assert set(by) == {"a", "b", "c", "e", "f", "a2", "u", "e2"}
    size = {"a": 100, "b": 10, "c": 1, "e": 7, "f": 1000}
    text = {r[1]: r[3] for r in rows}
    for k, ps in by.items():
        ps.sort(key=lambda r: r["piece_no"])
        assert [p["piece_no"] for p in ps] == list(range(1, len(ps) + 1))
        assert "".join(p["piece_text"][p["overlap"] :] for p in ps) == text[k]
        assert all(len(p["piece_text"]) <= size.get(k, 100) for p in ps)
        assert all(text[k][p["start_char"] : p["start_char"] + len(p["piece_text"])] == p["piece_text"] for p in ps)
    assert all(p["overlap"] == 20 for p in by["a"][1:]) and all(p["overlap"] <= 9 for p in by["b"]) and all(p["overlap"] == 150 for p in by["f"][1:])
    assert sum(p["piece_text"].rstrip()[-1] in ".;," for p in by["a"]) > 0.9 * len(by["a"])
    assert splitter.split_oversized(df.limit(0), lim).count() == 0 and splitter.split_oversized(df, lim.limit(0)).count() == 0


# --- p8 ---------------------------------------------------------------------------------------------------------------


def test_contamination_table(spark):
    passage = "o vigia noturno contou duas vezes os extintores vencidos ao som da banda marcial na praça"
    items = spark.createDataFrame([(1, passage, "q", "a"), (2, passage, None, None), (3, None, None, None)], "item_id long, passage string, query string, answer string")
    docs = spark.createDataFrame([(1, "Antes " + passage.upper() + " depois"), (1, "Antes " + passage.upper() + " depois"), (2, None), (3, ""), (4, LOREM * 2000)], "doc_id long, text string").withColumns({c: F.lit("x") for c in ("spans", "share", "item_id")})
    assert sorted({(r["doc_id"], r["item_id"]) for r in contamination.find_leaks(docs, items).collect()}) == [(1, 1), (1, 2)]
    clean = contamination.remove_leaks(docs, items).collect()
    assert {r["text"] for r in clean} == {"Antes  depois"} and all(r["n_items"] == 2 for r in clean)
    assert contamination.find_leaks(docs.limit(0), items).count() == 0 and contamination.find_leaks(docs, items.limit(0)).count() == 0


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(contamination, "BLOCK_WORDS", 20)
    text = [f"frase numero {i} com palavras bem proprias do caso {i} e mais nada que repita {i * 7}" for i in range(5)]
    items = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(text)], "item_id long, passage string, query string, answer string")
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(text)], "doc_id long, text string")
    assert {(i, i) for i in range(5)} <= {(r["doc_id"], r["item_id"]) for r in contamination.find_leaks(docs, items).collect()}


# --- p9 ---------------------------------------------------------------------------------------------------------------


def test_tokens_of_long_texts_are_those_of_the_whole(spark):
    texts = ["uma palavra e outra, " * 20_000, "a" * 250_000, "ação" * 60_000, " " * 210_000 + "fim", ""]
    got = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", mixing.token_count(F.col("t"), spark).alias("n")).collect()
    enc = mixing._encoding(Path(mixing.TOKENIZER).read_bytes())
    assert {r["i"]: r["n"] for r in got} == {i: len(enc.encode_ordinary(t)) for i, t in enumerate(texts)}


def test_mix_moves_texts_once(spark):
    docs = spark.createDataFrame([(i, f"texto {i}", "a") for i in range(50)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    plan = mixing.mix(docs, targets)._jdf.queryExecution().executedPlan().toString()
    moves = [x for x in plan.split("Initial Plan")[-1].splitlines() if "Exchange hashpartitioning" in x and "text_sha" in x]
    assert 0 < len(moves) <= 2 and "rangepartitioning" not in plan  # texts, and the ids of the chosen


def test_mix(spark):
    rows = [(i, f"texto {i} da fonte " + "palavra " * (i % 13), "a" if i % 3 else "b") for i in range(1500)] + [(9000 + i, "texto repetido", "b") for i in range(200)] + [(9900, None, "a"), (9901, "x", None), (9902, "y", "sem meta"), (9903, "", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("z") for c in ("n_tokens", "copies", "text_sha", "_u")})
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.6, 3), ("c", 0.1, 2), ("d", None, None)], "source string, target_share double, max_repeats int")
    result = mixing.mix(docs, targets)
    parts = result.select(F.spark_partition_id().alias("part"), *result.columns).collect()
    mix = sorted((r for r in result.collect()), key=lambda r: r["shuffle_key"])
    times = {}
    for r in mix:
        times[(r["source"], r["text"])] = times.get((r["source"], r["text"]), 0) + 1
    assert all(n <= (1 if s == "a" else 3) for (s, _), n in times.items()) and times[("b", "texto repetido")] <= 3
    for part in {r["part"] for r in parts}:  # each partition in the order of the hash
        keys = [r["shuffle_key"] for r in parts if r["part"] == part]
        assert keys == sorted(keys)
    size = {s: sum(r["n_tokens"] for r in mix if r["source"] == s) for s in "ab"}
    assert abs(size["a"] / (size["a"] + size["b"]) - 0.4) < 0.04
    again = sorted(mixing.mix(docs.repartition(7), targets).collect(), key=lambda r: r["shuffle_key"])
    assert [tuple(r) for r in again] == [tuple(r) for r in mix]
    rep = {r["source"]: r for r in mixing.shares(docs, targets).collect()}
    assert rep["a"]["mix_tokens"] == size["a"] and rep["c"]["mix_tokens"] == 0 and abs(rep["a"]["reached_share"] + rep["b"]["reached_share"] - 1) < 1e-9
    assert mixing.mix(docs.limit(0), targets).count() == 0 and mixing.mix(docs, targets.limit(0)).count() == 0 and mixing.shares(docs.limit(0), targets).count() == 4
