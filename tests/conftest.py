import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from veldra.session import build_session

    s = build_session("tests", "8", 4, "6g")
    s.sparkContext.setLogLevel("ERROR")
    return s


DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    import decimal

    if isinstance(v, float):
        return None if v != v else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="session")
def same_rows(spark, duck):
    """Compare a query with its SQL on the smallest tables: column names and all rows."""

    def check(run, sql):
        df = run(spark, DATA)
        names = sorted(df.columns)
        want = duck.sql(sql)
        assert sorted(want.columns) == names
        at = [want.columns.index(c) for c in names]
        got = sorted(repr(tuple(plain(r[c]) for c in names)) for r in df.collect())
        assert got == sorted(repr(tuple(plain(r[i]) for i in at)) for r in want.fetchall())

    return check
