from lexmill.operators import records as R
from lexmill.streaming import ingest

COLS = "tribunal string, tipo_documento string, numero_processo string, numero_sumula string, numero_decisao string, tipo_decisao string, ementa string, url_oficial string"


def test_courts(spark):
    names = {"TCE-SP": "TCESP", " tce sp\t": "TCESP", "Tribunal de Contas da União": "TCU", "Tribunal de Contas da Unia\u0303o": "TCU", "tribunal de justica de sao paulo": "TJSP", "STJ ": "STJ", "tcu": "TCU", "Foro X": "FORO X", "": "", None: None}
    df = spark.createDataFrame([(k,) for k in names], "tribunal string")
    assert [r[0] for r in R.normalized(df).collect()] == list(names.values())


def test_spellings_are_one_court(spark):
    df = R.normalized(spark.createDataFrame([(t, "acordao", "1/2", None, "3", None, "e", None) for t in ("TCU", "Tribunal de Contas da União")], COLS))
    assert df.select(R.document_key(df)).distinct().count() == 1
    assert {r[0] for r in R.group_cap(df, ["tribunal"], [df["numero_processo"]], 1).select("tribunal").collect()} == {"TCU"}
    assert R.group_cap(df, ["tribunal"], [df["numero_processo"]], 1).count() == 1 and R.too_few(df, "tribunal", 2).count() == 0


def test_aliases_and_lists(spark):
    df = spark.createDataFrame([(7, "TJ-SP", "", "9/8", "ab; c\n|d", ["x ", ""]), (8, None, "1/1", "2/2", None, None)], "n int, siglaTribunal string, numero_processo string, NUMPROCESSO string, TEMA string, partes array<string>")
    a, b = R.normalized(df).orderBy("n").collect()
    assert (a["n"], a["tribunal"], a["numero_processo"], a["assunto"], a["partes"]) == (7, "TJSP", "9/8", ["ab", "c", "d"], ["x"])
    assert (b["tribunal"], b["numero_processo"], b["assunto"], b["partes"]) == (None, "1/1", [], [])
    upper = R.normalized(spark.createDataFrame([("tce-sp", "Fulano")], "TRIBUNAL string, RELATOR string"))
    assert sorted(upper.columns) == ["relator", "tribunal"] and upper.first()["tribunal"] == "TCESP"


def test_stream_keeps_spelled_courts(spark, tmp_path):
    df = spark.createDataFrame([(t, "acordao", "1", None, None, None, None, None) for t in ("Supremo Tribunal Federal", "TCE SP", "ZZ")], COLS)
    df.write.parquet(str(tmp_path / "in"))
    ingest.stream_records(spark, str(tmp_path / "in"), df.schema, str(tmp_path / "good"), str(tmp_path / "dead"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "good")).select("tribunal").collect()) == ["STF", "TCESP"]
    assert [r[0] for r in spark.read.json(str(tmp_path / "dead")).select("error").collect()] == [["tribunal"]]
