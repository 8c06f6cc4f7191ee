"""Every query with a SQL twin gives DuckDB's rows."""

import duckdb
import pytest

from setlist.plans.adapters import registry
from setlist.plans.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(str(float(r[i])) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_as_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    want = duck.execute(ORACLE_SQL[name])
    assert canonical(df.columns, df.collect()) == canonical([c[0] for c in want.description], want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_others_run(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_drift_names_songs_without_tracks(spark, sf):
    cards = registry(spark, sf).select("song_id", "winner_track_id").collect()
    lost = {r.song_id for r in cards if r.winner_track_id // 3 % 10 == 0}
    assert lost and {r.song_id for r in QUERIES["registry_drift"](spark, sf).collect()} == lost
    # of those that stay some have a track that has changed
    assert any(t % 10 == 0 for r in cards if r.song_id not in lost for t in range(r.winner_track_id // 3 * 3, r.winner_track_id // 3 * 3 + 3))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
