"""Every query with SQL gives DuckDB's rows; the others give rows."""

from pathlib import Path

import duckdb
import pytest

from spikeloom import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in Path(SF).iterdir():
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def rows(df):
    cols = sorted(df.columns)
    df = df[cols].copy()
    for c in cols:
        if df[c].dtype.kind == "f":
            df[c] = [float(f"{x:.9g}") if abs(x) > 1e9 else round(x, 5) + 0.0 for x in df[c]]
    return cols, sorted(map(tuple, df.astype(object).where(df.notna(), None).astype(str).values))


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, db, name):
    got = Q.queries()[name](spark, SF).toPandas()
    if name in Q.oracle_sql():
        assert rows(got) == rows(db.sql(Q.oracle_sql()[name]).df())
    else:
        assert len(got)
