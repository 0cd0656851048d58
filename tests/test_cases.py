import datetime as dt

import pytest

from lexmill import cli
from lexmill.operators import evaluation as E

D = dt.date


def test_metrics_of_a_case(spark):
    rank = spark.createDataFrame(
        [(1, 1, "a", "federal", D(2021, 1, 1), None), (1, 2, "b", "estadual_sp", None, None), (2, 1, "x", "federal", D(2021, 1, 1), None), (2, 2, "a", None, D(2021, 1, 1), D(2022, 1, 1)), (4, 1, "a", None, None, D(2019, 1, 1)), (5, 1, "a", None, None, None)],
        "case_id long, rank int, source string, jurisdicao string, effective_from date, effective_to date",
    )
    cases = spark.createDataFrame(
        [
            (1, ["a"], ["federal"], D(2021, 6, 1), None, None, None, None, None, None),
            (2, ["a"], ["estadual_sp"], None, D(2022, 1, 1), D(2023, 1, 1), None, None, True, False),
            (3, [], None, None, None, None, True, True, None, None),
            (4, ["a"], ["federal"], D(2020, 1, 1), None, None, None, None, True, None),
            (5, [], None, None, None, None, True, True, None, None),
        ],
        "case_id long, expected array<string>, expected_jurisdicao array<string>, effective_on date, effective_from date, effective_to date, rejection_test boolean, expected_rejection boolean, temporal_rejection_test boolean, expected_temporal_rejection boolean",
    )
    m = E.case_metrics(rank, cases, [1, 2])
    got = {r["case_id"]: tuple(r[c] for c in ("regime_correct", "jurisdiction_correct", "temporal_correct", "retrieval_rejected", "rejection_correct", "temporal_rejection_correct_1", "temporal_rejection_correct_2")) for r in m.collect()}
    assert got == {
        1: (True, True, True, False, None, None, None),
        2: (False, False, False, False, None, False, True),
        3: (None, None, None, True, True, None, None),
        4: (True, False, False, False, None, True, True),
        5: (None, None, None, False, False, None, None),
    }
    s = E.summary(m).first()
    assert (s["cases"], s["rejection_correct"], s["regime_correct"]) == (5, 0.5, pytest.approx(2 / 3))


def test_one_jurisdiction_and_dates_as_text(spark):
    rank = spark.createDataFrame([(i, 1, "a", "federal", "2021-01-01", "") for i in (1, 2)], "case_id long, rank int, source string, jurisdicao string, effective_from string, effective_to string")
    cases = spark.createDataFrame([(1, ["a"], "federal", "2020-12-31"), (2, ["a"], None, "")], "case_id long, expected array<string>, expected_jurisdicao string, effective_on string")
    assert [(r["jurisdiction_correct"], r["temporal_correct"]) for r in E.case_metrics(rank, cases, [1]).orderBy("case_id").collect()] == [(True, False), (None, None)]


def test_case_twice(spark):
    rank = spark.createDataFrame([(1, 1, "a")], "case_id long, rank int, source string")
    with pytest.raises(Exception, match="stands twice: 1"):
        E.case_metrics(rank, spark.createDataFrame([(1, ["a"]), (1, ["b"])], "case_id long, expected array<string>"), [1]).collect()


def test_case_faults(spark):
    rows = [("a", "q", ["s"], None, "2021-01-01"), ("b", None, [], True, None), ("c", "q", [], None, "1/1/21"), ("a", "q", None, None, None), (None, "q", ["s"], None, "")]
    df = spark.createDataFrame(rows, "case_id string, query string, expected array<string>, rejection_test boolean, effective_on string")
    got = sorted((r["case_id"] or "", r["faults"]) for r in E.case_faults(df).collect())
    assert got == [("", ["case_id"]), ("a", ["duplicate"]), ("a", ["expected", "duplicate"]), ("b", ["query"]), ("c", ["no source expected", "effective_on: date"])]
    assert {tuple(r["faults"]) for r in E.case_faults(df.drop("query")).where("case_id = 'b'").collect()} == {("query",)}
    assert E.case_faults(df.where("case_id = 'b'").selectExpr("case_id", "'q' AS query", "expected", "'yes' AS rejection_test")).first()["faults"] == ["no source expected", "rejection_test: type"]


def test_gate_case_faults(spark):
    rows = [("a", "x", True, ["s"]), ("b", None, True, []), ("b", "x", None, ["", "s"]), ("c", "x", True, None)]
    df = spark.createDataFrame(rows, "case_id string, answer string, expected_accept boolean, sources array<string>")
    assert [r["faults"] for r in E.gate_case_faults(df).orderBy("case_id", "answer").collect()] == [[], ["answer", "no sources", "duplicate"], ["expected_accept", "source without text", "duplicate"], ["sources"]]
    of = spark.createDataFrame([("a", "x", True, [("", "p")]), ("b", "x", True, [("", None)])], "case_id string, answer string, expected_accept boolean, sources array<struct<text string, page_content string>>")
    assert [r["faults"] for r in E.gate_case_faults(of).orderBy("case_id").collect()] == [[], ["source without text"]]


def test_cli_refuses_wrong_cases(spark, tmp_path, capsys):
    spark.createDataFrame([("a", 1, "s")], "case_id string, rank int, source string").write.parquet(str(tmp_path / "r"))
    spark.createDataFrame([("a", "q", ["s"]), ("a", "q", ["t"])], "case_id string, query string, expected array<string>").write.parquet(str(tmp_path / "c"))
    assert cli.main(["evaluate", str(tmp_path / "r"), str(tmp_path / "c")]) == 1 and "a: duplicate" in capsys.readouterr().err
    spark.createDataFrame([("a", "q", ["s"])], "case_id string, query string, expected array<string>").write.parquet(str(tmp_path / "d"))
    assert cli.main(["evaluate", str(tmp_path / "r"), str(tmp_path / "d"), "--k", "1", "--strict"]) == 0
