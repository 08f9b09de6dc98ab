from __future__ import annotations

import os
import sys

import duckdb
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))

from lodestone.session import local_session

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def cell(v):
    if hasattr(v, "item"):
        v = v.item()
    if v is None or pd.isna(v):
        return "null"
    if isinstance(v, float):
        return repr(round(v, 9)) if v != int(v) else str(int(v))
    return str(v)


def multiset(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(cell, row)) for row in frame[columns].astype(object).itertuples(index=False))
