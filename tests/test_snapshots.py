"""Snapshots, dense numbers and the ledger."""

import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from setlist.operators import ledger, registry
from setlist.operators.ledger import Altered, Ledger
from setlist.sources import positions, snapshots, tables
from setlist.sources.snapshots import Conflict, Table


def frame(spark, lo, hi):
    return spark.range(lo, hi).selectExpr("id", "concat('r', id) as name")


def test_versions(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    assert t.version() is None
    with pytest.raises(FileNotFoundError):
        t.read()
    assert t.commit(frame(spark, 0, 3)) == 0 and t.commit(frame(spark, 3, 5), append=True) == 1
    first = t.entry(1)["data"][0]
    assert t.read().count() == 5 and t.read(0).count() == 3 and t.entry(0)["data"] == [first]  # the append left what was there
    assert t.commit(t.read().where("id > 0").withColumn("x", F.lit(1))) == 2  # a table may be made from itself
    assert t.read().columns == ["id", "name", "x"] and t.read(1).columns == ["id", "name"]
    assert t.commit(frame(spark, 9, 10), append=True, token="once") == 3 == t.commit(frame(spark, 9, 10), append=True, token="once")
    assert t.read().count() == 5 and t.read().where("x is null").count() == 1
    with pytest.raises(Conflict):
        t.commit(frame(spark, 0, 1), based_on=2)  # version 3 came in between
    assert t.read().count() == 5


def test_pruning(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    for i in range(4):
        t.commit(frame(spark, 0, i + 1))
    orphan = tmp_path / "t" / "data" / "dead"
    orphan.mkdir()
    assert t.prune(2) == []  # young data may belong to a commit that is under way
    assert t.versions() == [2, 3] and t.read(2).count() == 3
    assert len(t.prune(2, grace=-1)) == 3 and not orphan.exists()
    assert t.read().count() == 4 and t.read(2).count() == 3
    with pytest.raises(FileNotFoundError):
        t.read(0)


def test_a_writer_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    t = Table(spark, str(tmp_path / "t"))
    t.commit(frame(spark, 0, 3))
    monkeypatch.setattr(snapshots.Store, "write", lambda *a, **b: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError):
        t.commit(frame(spark, 0, 9))
    monkeypatch.undo()
    assert t.version() == 0 and t.read().count() == 3
    assert t.commit(frame(spark, 0, 4)) == 1 and len(t.prune(1, grace=-1)) == 2


def test_a_reader_never_misses_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.publish(frame(spark, 0, 10), path)
    seen, stop = [], threading.Event()

    def read():
        while not stop.is_set():
            try:
                seen.append(tables.read_table(spark, path, "x").count())
            except Exception as e:
                seen.append(e)

    reader = threading.Thread(target=read)
    reader.start()
    for i in range(1, 9):
        tables.publish(frame(spark, 0, 10 * (i + 1)), path)
    stop.set()
    reader.join()
    assert len(seen) > 3 and all(isinstance(n, int) and n % 10 == 0 and n > 0 for n in seen), seen


def test_of_two_writers_one_wins(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    t.commit(frame(spark, 0, 1))
    got, barrier = [], threading.Barrier(2)

    def write(n):
        barrier.wait()
        try:
            got.append(("ok", Table(spark, t.path).commit(frame(spark, 0, n), based_on=0)))
        except Conflict:
            got.append(("conflict", n))

    both = [threading.Thread(target=write, args=(n,)) for n in (20, 30)]
    [w.start() for w in both]
    [w.join() for w in both]
    assert sorted(g[0] for g in got) in (["conflict", "ok"], ["ok", "ok"]) and t.versions() == [0, 1]
    assert t.read().count() in (20, 30)


def test_dense_numbers(spark):
    rows = [(i * 37 % 100, f"n{i % 7}", i % 3) for i in range(1000)]
    df = spark.createDataFrame(rows, "a int, b string, c int").repartition(13)
    got = positions.dense(df, ["a", F.col("b").desc()], start=5).collect()
    assert sorted(r.seq for r in got) == list(range(5, 1005))
    ranked = sorted(got, key=lambda r: r.seq)
    assert all((x.a, [-ord(c) for c in x.b]) <= (y.a, [-ord(c) for c in y.b]) for x, y in zip(ranked, ranked[1:]))
    again = positions.dense(df.repartition(3), ["a", F.col("b").desc()], start=5).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))  # ties are settled
    assert positions.dense(df.limit(0), ["a"]).count() == 0


def test_places_within_a_key(spark):
    rows = [(None if i % 11 == 0 else "hot" if i % 3 else f"k{i % 5}", i * 7 % 101) for i in range(600)]
    got = positions.within(spark.createDataFrame(rows, "k string, a int").repartition(7), "k", ["a"]).collect()
    for k in {r[0] for r in rows}:
        mine = sorted((r.place, r.a) for r in got if r.k == k)
        assert [p for p, _ in mine] == list(range(1, len(mine) + 1)) and [a for _, a in mine] == sorted(a for _, a in mine)
    assert len(got) == 600


def test_numbers_by_file(spark, tmp_path):
    for k, (name, n) in enumerate([("a", 5), ("b", 1), ("c", 4000)]):
        spark.range(n).selectExpr("id", f"{k} as k").coalesce(1).write.parquet(str(tmp_path / f"run={name}"))
    spark.range(3).selectExpr("id", "9 as k").repartition(3, "id").write.parquet(str(tmp_path / "run=d"))
    got = positions.by_file(spark, str(tmp_path), spark.createDataFrame([], "id long, k int, run string").schema)
    rows = sorted(got.collect(), key=lambda r: r.seq)
    assert [r.seq for r in rows] == list(range(4009))
    assert [(r.run, r.id) for r in rows[:4006]] == [(f, i) for f, n in (("a", 5), ("b", 1), ("c", 4000)) for i in range(n)]


CARD = "card_id string, song_id string, printed_status string, printed_at string, year int"


def cards(spark, lo, hi):
    return spark.createDataFrame([(f"c{i:05d}", f"s{i}", "pending", None, None if i % 5 == 0 else 1900 + i % 99) for i in range(lo, hi)], CARD)


def test_ledger(spark, tmp_path):
    book = Ledger(spark, str(tmp_path / "r"), size=8)
    assert book.appends() == []
    book.append(cards(spark, 0, 100).repartition(4), ["card_id"], token="a")
    book.append(cards(spark, 0, 100), ["card_id"], token="a")  # the same job again
    book.append(cards(spark, 100, 130), ["card_id"], token="b")
    rows = sorted(book.read().collect(), key=lambda r: r.seq)
    assert [r.seq for r in rows] == list(range(130)) and [r.card_id for r in rows] == [f"c{i:05d}" for i in range(130)]
    assert [(p["start"], p["end"]) for p in book.appends()] == [(0, 100), (100, 130)] and book.verify().isEmpty()
    good = book.read()
    book.update(registry.mark_printed(good.withColumn("version", F.lit("v")), None, "now").drop("version"), token="p")
    assert book.read().where("printed_status = 'printed'").count() == 130 and book.verify().isEmpty()
    bad = lambda df: sorted(tuple(r) for r in book.verify(df).collect())
    swapped = good.withColumn("seq", F.when(F.col("seq") == 3, 20).when(F.col("seq") == 20, 3).otherwise(F.col("seq")))
    assert bad(swapped) == [(0, 0, "changed"), (0, 2, "changed")]
    near = good.withColumn("seq", F.when(F.col("seq") == 3, 4).when(F.col("seq") == 4, 3).otherwise(F.col("seq")))
    assert bad(near) == [(0, 0, "changed")]
    assert bad(good.where("seq <> 129")) == [(1, 3, "changed")]
    assert bad(good.where("seq < 100 or seq >= 108")) == [(1, 0, "missing")]
    assert bad(good.withColumn("year", F.coalesce("year", F.lit(0)))) != []
    with pytest.raises(Altered):
        book.update(swapped)
    book.append(cards(spark, 130, 131), ["card_id"])
    assert book.verify().isEmpty() and book.read().count() == 131
    book.reseal(registry.delete_pending(book.read()))
    assert book.read().count() == 130 and len(book.appends()) == 1 and book.verify().isEmpty()


def test_an_append_reads_the_last_append_only(spark, tmp_path):
    book = Ledger(spark, str(tmp_path / "r"), size=8)
    for i in range(3):
        book.append(cards(spark, 10 * i, 10 * i + 10), ["card_id"])
    log = book.table.entry()
    for d in (log["data"][0], log["note"]["appends"][0]["digests"]):  # what is older may be out of reach
        Path(book.path, d).rename(Path(book.path, f"{d}-away"))
    book.append(cards(spark, 30, 40), ["card_id"])
    assert book.appends()[-1]["end"] == 40
    last = Path(book.path, book.table.entry()["added"])
    changed = spark.read.parquet(str(last)).withColumn("song_id", F.lit("x"))
    changed.coalesce(1).write.parquet(str(tmp_path / "changed"))
    last.rename(f"{last}-away")
    Path(tmp_path / "changed").rename(last)
    with pytest.raises(Altered):
        book.append(cards(spark, 40, 41), ["card_id"])


def test_a_chain_that_was_cut_shows(spark, tmp_path):
    book = Ledger(spark, str(tmp_path / "r"), size=4)
    for i in range(2):
        book.append(cards(spark, 40 * i, 40 * i + 40), ["card_id"])
    entry = book.table.entry()
    entry["note"]["appends"][0]["rows"] = 39
    book.table.store.write(f"{book.path}/log/{1:020d}.json", __import__("json").dumps(entry), replace=True)
    assert ("chain" in {r.why for r in book.verify().collect()}) and ledger.BLOCK == 4096
