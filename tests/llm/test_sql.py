import duckdb
import pytest

from setlist.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_as_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "pages"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name])
    columns = sorted(c[0] for c in want.description)
    place = [[c[0] for c in want.description].index(c) for c in columns]
    df = QUERIES[name](spark, sf)
    assert sorted(df.columns) == columns
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(tuple(r[i] for i in place) for r in want.fetchall())
