import pytest
from pyspark.sql import functions as F

from lexmill.operators import evaluation as E
from lexmill.operators import gate as G

SOURCES = ["A Lei 14.133/2021, em seu art. 75, permite a dispensa de licitação para obras até cem mil reais.", "O pregão eletrônico é obrigatório para bens comuns."]


@pytest.mark.parametrize(
    ("answer", "reason"),
    [
        ("A dispensa de licitação é permitida para obras até cem mil reais [F1].", None),
        ("A dispensa de licitação é permitida para obras até cem mil reais.\n[F1]", None),
        ("A dispensa é permitida 【 F1 】 e o pregão eletrônico obrigatório (F2).", None),
        ("", "empty"),
        (None, "empty"),
        ("A dispensa de licitação é permitida.", "no citation"),
        ("É.", None),
        ("A dispensa é permitida [F7].", "out of range"),
        ("Conforme segue abaixo a resposta\nA dispensa de licitação é permitida para obras [F1].", None),
        ("A dispensa de licitação é permitida para obras [F1].\nO prefeito pode contratar livremente.", "uncited"),
        ("O art. 99 permite a dispensa de licitação para obras [F1].", "identifier"),
        ("A Lei 14.133/2021 permite a dispensa de licitação para obras [F1].", None),
        ("A dispensa sempre prevalece sobre a licitação para obras [F1].", "comparison"),
        ("Gatos pretos dormem tranquilamente durante tardes chuvosas [F1].", "overlap"),
        ("## Dispensa de licitação\n**Resumo**\nA dispensa de licitação é permitida para obras [F1].", None),
    ],
)
def test_verdict(spark, answer, reason):
    df = spark.createDataFrame([(answer, SOURCES)], "a string, s array<string>")
    assert df.select(G.verdict(df["a"], df["s"])).first()[0] == reason


def test_rates(spark):
    v = spark.createDataFrame([(True, True), (True, False), (False, False), (False, True)], "expected_accept boolean, accepted boolean")
    r = E.gate_rates(v).first()
    assert (r["accuracy"], r["correct_rejection"], r["false_accept"], r["correct_acceptance"], r["observed_rejection"]) == (0.5, 0.5, 0.5, 0.5, 0.5)


def test_metrics(spark):
    rank = spark.createDataFrame([(1, 1, "x"), (1, 2, "a"), (1, 3, "a"), (2, 1, "b"), (3, 1, "c")], "case_id long, rank int, source string")
    cases = spark.createDataFrame([(1, ["a", "z"]), (2, ["b"]), (3, []), (4, ["q"])], "case_id long, expected array<string>")
    got = {r["case_id"]: r.asDict() for r in E.case_metrics(rank, cases, [1, 3]).collect()}
    assert got[1]["recall_1"] == 0 and got[1]["recall_3"] == 0.5 and got[1]["reciprocal_rank"] == 0.5
    assert got[2]["recall_1"] == 1 and got[2]["ndcg_1"] == 1 and got[3]["recall_1"] is None and got[4]["reciprocal_rank"] == 0
    assert got[1]["ndcg_raw_3"] > got[1]["ndcg_3"] and abs(got[1]["fp_rate_3"] - 1 / 3) < 1e-9
    assert E.summary(E.case_metrics(rank, cases, [1])).first()["recall_1"] == pytest.approx(1 / 3)
    assert E.below({"recall_1": 0.3}, {"recall_1": 0.8}) and not E.below({"recall_1": 0.9}, {"recall_1": 0.8})


def test_temporal(spark):
    rows = [(20200615, None, None, 20200101, 20201231), (20210615, None, None, 20200101, 20201231), (None, 20201201, 20210101, 20200101, 20201231), (None, None, None, 1, 2), (20200101, None, None, None, None)]
    df = spark.createDataFrame(rows, "o int, s int, e int, a int, b int")
    assert [r[0] for r in df.select(E.temporal_match(*[F.col(c) for c in "oseab"])).collect()] == [True, False, True, None, None]
