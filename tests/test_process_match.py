import datetime as dt

from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.operators import records as R


def test_process_match(spark):
    rows = [("o que decidiu o 2019/0012345?", "201900123456", None), ("REsp 1.234.567", "TC-1234567/026/20", ""), ("12345", "12345", ""), ("999999", None, "nada"), ("reajuste 999999", "1", "Reajustes do contrato"), ("de que", "1", "x"), (None, "1", "x")]
    df = spark.createDataFrame(rows, "q string, n string, t string")
    assert [r[0] for r in df.select(X.process_match(F.col("q"), F.col("n"), F.col("t"))).collect()] == [True, True, False, False, True, False, False]


def test_article_text(spark):
    cols = "orgao string, title string, date_publicacao date, autor string, secao string, palavras_chave string, url string, texto string"
    df = spark.createDataFrame([("TCU", "T", dt.date(2024, 4, 5), "A", None, "", "https://a.b", "um\ndois \n")], cols)
    assert df.select(R.article_text(df)).first()[0] == "FONTE: TCU\nTÍTULO: T\nDATA_PUBLICACAO: 2024-04-05\nAUTOR: A\nURL: https://a.b\n\num\ndois"
