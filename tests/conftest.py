import os
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("LEXMILL_DRIVER_MEMORY", "4g")

DATA = os.environ.get("LEXMILL_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from lexmill.session import local_session

    s = local_session(4, "lexmill-tests")
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in sorted(os.listdir(data)):
        path = f"{data}/{f}"
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return c


def plain(df: pd.DataFrame) -> list[tuple]:
    """Rows in a form and order that don't depend on the engine."""
    df = df[sorted(df.columns)]

    def cell(x):
        if x is None or (not hasattr(x, "__len__") and pd.isna(x)):
            return "∅"
        if isinstance(x, float) and x == int(x) and abs(x) < 1e15:
            return f"{x:.6f}"
        return f"{x:.6f}" if isinstance(x, float) else str(x)

    return sorted(tuple(cell(x) for x in t) for t in df.itertuples(index=False))


@pytest.fixture(scope="session")
def same(spark, data, duck):
    def check(query, sql):
        a, b = query(spark, data).toPandas(), duck.execute(sql).df()
        assert sorted(a.columns) == sorted(b.columns)
        for c in a.columns:  # a column of whole numbers with nulls is read as floats
            if a[c].dtype.kind in "iu" and b[c].dtype.kind == "f" or a[c].dtype.kind == "f" and b[c].dtype.kind in "iu":
                a[c], b[c] = a[c].astype(float), b[c].astype(float)
        x, y = plain(a), plain(b)
        assert len(x) == len(y)
        assert x == y

    return check
