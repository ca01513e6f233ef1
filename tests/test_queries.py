"""Every query beside its SQL in DuckDB, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from heliograph.plans import more as plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}" if v else "0"
    return str(v)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted(tuple(shown(r[c]) for c in cols) for r in df.collect())
    if name not in plans.ORACLE_SQL:
        assert rows
        return
    got = duck.execute(plans.ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    assert rows == sorted(tuple(shown(dict(zip(names, r, strict=True))[c]) for c in cols) for r in got.fetchall())
