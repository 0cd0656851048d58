import datetime as dt

import numpy as np
import pandas as pd
import pytest

from lexmill.operators import timestamps as t

UTC = dt.timezone.utc


@pytest.fixture(scope="module")
def zone(spark):
    return t.zone_table(spark)


def one(zone, value):
    r = t.parse_values(pd.Series([value], dtype=object), zone).iloc[0]
    at = None if pd.isna(r["instant"]) else dt.datetime(1970, 1, 1, tzinfo=UTC) + dt.timedelta(microseconds=int(r["instant"]))
    day = None if pd.isna(r["day"]) else (dt.date(1970, 1, 1) + dt.timedelta(days=int(r["day"]))).isoformat()
    return r["kind"], day, at.strftime("%Y-%m-%dT%H:%M:%S.%f") if at else None


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("2019-01-06T22:54:18Z", ("instant", "2019-01-06", "2019-01-06T22:54:18.000000")),
        ("2006-02-17T22:59:55.053-0300", ("instant", "2006-02-17", "2006-02-18T01:59:55.053000")),
        ("2024-11-16T23:44:31-04:00[America/Manaus]", ("instant", "2024-11-16", "2024-11-17T03:44:31.000000")),
        ("2020-01-30T09:05+02:00", ("instant", "2020-01-30", "2020-01-30T07:05:00.000000")),
        ("20250706T094820.569769", ("instant", "2025-07-06", "2025-07-06T12:48:20.569769")),
        ("11/11/2008 22:36 (horário de Brasília)", ("instant", "2008-11-11", "2008-11-12T00:36:00.000000")),  # summer time
        ("11/07/2008 22:36", ("instant", "2008-07-11", "2008-07-12T01:36:00.000000")),
        ("12/06/2022 às 20h18", ("instant", "2022-06-12", "2022-06-12T23:18:00.000000")),
        ("18/02/2018 12:00 AM", ("instant", "2018-02-18", "2018-02-18T03:00:00.000000")),
        ("20/01/2023 12:13 PM", ("instant", "2023-01-20", "2023-01-20T15:13:00.000000")),
        ("02/07/2008 21:30:29 BRST", ("instant", "2008-07-02", "2008-07-02T23:30:29.000000")),
        ("13/09/2017 21:43:15 BRT", ("instant", "2017-09-13", "2017-09-14T00:43:15.000000")),
        ("15.08.2021 23:13:45 UTC-3", ("instant", "2021-08-15", "2021-08-16T02:13:45.000000")),
        ("21.07.2017 18:52:09 GMT", ("instant", "2017-07-21", "2017-07-21T18:52:09.000000")),
        ("13 de agosto de 2017, 18:16", ("instant", "2017-08-13", "2017-08-13T21:16:00.000000")),
        ("Thu, 06 Jul 2023 22:23:29 -0200", ("instant", "2023-07-06", "2023-07-07T00:23:29.000000")),
        ("04/09/12", ("day", "2012-09-04", None)),
        ("03-ABR-14", ("day", "2014-04-03", None)),
        ("1º de março de 2025", ("day", "2025-03-01", None)),
        ("domingo, 18 de Setembro de 2011", ("day", "2011-09-18", None)),
        ("/2021-dez-08/", ("day", "2021-12-08", None)),
        ("2011.03.22", ("day", "2011-03-22", None)),
        ("20191220", ("day", "2019-12-20", None)),
        ("  15/04/2025 ", ("day", "2025-04-15", None)),
        ("1318696553", ("epoch", "2011-10-15", "2011-10-15T16:35:53.000000")),
        ("1324629237523", ("epoch", "2011-12-23", "2011-12-23T08:33:57.523000")),
        ("31/02/2017", ("unreadable", None, None)),
        ("00/00/0000", ("unreadable", None, None)),
        ("30 de fevereiro de 2015", ("unreadable", None, None)),
        ("10/10/2020 25:10", ("unreadable", None, None)),
        ("29/02/2020", ("day", "2020-02-29", None)),
        ("qualquer texto", ("unreadable", None, None)),
        ("x" * 5000, ("unreadable", None, None)),
        ("não informado", ("missing", None, None)),
        ("-", ("missing", None, None)),
        ("", ("missing", None, None)),
        (None, ("missing", None, None)),
    ],
)
def test_values(zone, value, want):
    assert one(zone, value) == want


def test_clock_changes(zone):
    # the clock went from 23:59:59 back to 23:00 on 2018-02-17: the first of both is taken
    assert one(zone, "17/02/2018 23:30")[2].startswith("2018-02-18T01:30")
    # it skipped 00:00 to 00:59 on 2018-11-04: moved on by the skip
    assert one(zone, "04/11/2018 00:30")[2].startswith("2018-11-04T03:30")


def test_against_the_zone_library(zone):
    from zoneinfo import ZoneInfo

    tz = ZoneInfo("America/Sao_Paulo")
    at = dt.datetime(2005, 1, 1, 13, 7)
    values, want = [], []
    while at.year < 2026:
        values.append(at.strftime("%d/%m/%Y %H:%M"))
        want.append(at.replace(tzinfo=tz).astimezone(UTC))
        at += dt.timedelta(hours=61, minutes=13)
    got = t.parse_values(pd.Series(values), zone)["instant"].astype("int64")
    assert [dt.datetime.fromtimestamp(x / 1e6, UTC) for x in got] == want


def test_table(spark):
    rows = [(1, "12/06/2022 22:18", None, "2020-01-01", "clash"), (1, "12/06/2022 22:18", None, "2020-01-01", "clash"), (None, "?", "x", None, None)]
    df = spark.createDataFrame(rows, "record_id long, data string, data_publicacao string, data_autuacao string, field_name string")
    got = t.normalise_timestamps(df, "record_id", ["data", "data_publicacao", "data_autuacao"])
    assert got.count() == 9
    r = got.where("record_id = 1 and field_name = 'data'").first()
    assert (str(r["day"]), str(r["day_utc"]), r["zone_version"].startswith("America/Sao_Paulo@")) == ("2022-06-12", "2022-06-13", True)
    assert t.normalise_timestamps(df.limit(0), "record_id", ["data"]).count() == 0


def test_long_values_and_far_years():
    wide = "12/05/2020" + " " * 300 + "às" + " " * 200 + "23:30"
    zone = t.ZoneTable("x", "1", [], [-10_800])
    got = t.parse_values(pd.Series([wide, "palavra " * 40, "31/12/9998 23:30"]), zone)
    assert got["kind"].tolist() == ["instant", "unreadable", "instant"] and got["day"][0] == 18394


def test_rules_repeat_after_the_table():
    year = 365 * 86_400
    at = [t.CYCLE + 1000 * year + k * year // 2 for k in range(4)]
    local = np.array([at[-1] - t.CYCLE + 5, at[-1] + 5, at[-1] + t.CYCLE + 5])
    assert (t._within_table(local, np.array(at)) == local[0]).all()
