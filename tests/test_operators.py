import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from setlist.operators import catalog, identity, registry, selection
from setlist.sources.playlists import ITEM_SCHEMA
from setlist.streaming import scans


def song(i, year=2000, owners=("a", "b"), artist=None, album=None, pop=50, guard=None):
    return (f"s{i:03d}", year, list(owners), artist, album, pop, guard)


POOL = "song_id string, year_final int, owner_ids array<string>, artist_key string, album_id string, popularity int, guardrail string"
LOCKED = "song_id string, expansion_anchor string, year int"


def naive_deck(songs, locked, targets, artist_cap, album_cap):
    """The selector as its specification reads: every song is looked at for every pick."""
    by_id = {s[0]: s for s in songs}
    state = {o: dict(n=0, y=Counter(), a=Counter(), al=Counter(), sets=Counter(), o=Counter()) for o in sorted(targets)}

    def add(o, s):
        st = state[o]
        st["y"][s[1]] += 1
        st["a"][s[3]] += s[3] is not None
        st["al"][s[4]] += s[4] is not None
        st["sets"][tuple(sorted(s[2]))] += 1
        st["o"].update(x for x in s[2] if x != o)

    used, guards = {x[0] for x in locked}, set()
    for sid, o, year in locked:
        if sid in by_id and by_id[sid][6]:
            guards.add(by_id[sid][6])
        if o in state:
            state[o]["n"] += 1
            if sid in by_id:
                add(o, by_id[sid])
            else:
                state[o]["y"][year] += 1
    out, closed = [], set()
    while True:
        todo = [(state[o]["n"] - targets[o], o) for o in state if o not in closed and targets[o] > state[o]["n"]]
        if not todo:
            return out
        o = min(todo)[1]
        st = state[o]
        fit = [s for s in songs if o in s[2] and s[1] is not None and s[0] not in used and (s[6] is None or s[6] not in guards) and (s[3] is None or st["a"][s[3]] < artist_cap) and (s[4] is None or st["al"][s[4]] < album_cap)]
        if not fit:
            closed.add(o)
            continue

        def key(s):
            co = [st["o"][x] for x in s[2] if x != o]
            return (st["y"][s[1]] > 0, st["y"][s[1]], -(len(s[2]) - 1), st["sets"][tuple(sorted(s[2]))], sum(co) / len(co) if co else 0.0, st["a"][s[3]], s[5] is None, -(s[5] or 0), s[1], s[0])

        s = min(fit, key=key)
        used.add(s[0])
        if s[6]:
            guards.add(s[6])
        st["n"] += 1
        add(o, s)
        out.append((s[0], o, len(out) + 1))


@pytest.mark.parametrize("seed", range(4))
def test_greedy_deck_equals_specification(spark, seed):
    rng = random.Random(seed)
    songs = [song(i, rng.choice([1990, 1991, 1995, None]), sorted(rng.sample("abc", rng.randint(1, 3))), rng.choice([None, "x", "y", "z"]), rng.choice([None, "l1", "l2"]), rng.choice([None, 10, 50]), rng.choice([None, "g1", "g2", f"g{i}"])) for i in range(70)]
    locked = [("s001", "a", 1990), ("s002", "b", 1991), ("gone", "a", 1980), ("s003", "q", 1999)]
    rng.shuffle(songs)
    targets = {"a": 12, "b": 9, "c": 9}
    got = selection.greedy_deck(spark.createDataFrame(songs, POOL), spark.createDataFrame(locked, LOCKED), targets, 3, 4)
    assert sorted(tuple(r) for r in got.collect()) == sorted(naive_deck(songs, locked, targets, 3, 4))
    picks, pool, lock = got, spark.createDataFrame(songs, POOL), spark.createDataFrame(locked, LOCKED)
    assert all(r.n_rows == 0 for r in selection.selection_violations(picks, lock, pool).collect())
    summary = {r.expansion_anchor: r for r in selection.expansion_summary(picks, lock.where("expansion_anchor in ('a', 'b')"), pool, targets).collect()}
    assert summary["a"].locked_cards == 2 and all(r.total_cards + r.underfilled_by == r.target_size for r in summary.values())


def naive_candidates(songs, target):
    years, artists, owners, left, out = Counter(), Counter(), Counter(), dict((s[0], s) for s in songs if s[1] is not None), []

    def m(s):
        c = [owners[o] for o in s[3]]
        return (sum(c) / len(c), max(c), sum(x == 0 for x in c)) if c else (0.0, 0, 0)

    def take(s, phase):
        years[s[1]] += 1
        artists[s[4] or "\0"] += 1
        owners.update(s[3])
        del left[s[0]]
        out.append((s[0], len(out) + 1, phase))

    for y in sorted({s[1] for s in left.values()}):
        if len(out) < target:
            take(min((s for s in left.values() if s[1] == y), key=lambda s: (-s[2], m(s)[0], m(s)[1], -m(s)[2], artists[s[4] or "\0"], s[0])), "phase1_year_cover")
    while left and len(out) < target:

        def key(s):
            a, b, n = m(s)
            score = s[2] - 0.35 * years[s[1]] - 0.20 * a - 0.05 * b + 0.20 * n - 0.10 * artists[s[4] or "\0"]
            return -score, -s[2], years[s[1]], a, b, -n, artists[s[4] or "\0"], s[0]

        take(min(left.values(), key=key), "phase2_fill")
    return out


def test_greedy_candidates_equal_specification(spark):
    rng = random.Random(2)
    songs = [(f"s{i:03d}", rng.choice([1990, 1992, 1999, None]), rng.randint(0, 4), sorted(rng.sample("abcd", rng.randint(0, 3))), rng.choice([None, "x", "y"])) for i in range(90)]
    df = spark.createDataFrame(songs, "song_id string, year_final int, owners_count int, owner_ids array<string>, primary_artist_name string")
    assert sorted(tuple(r) for r in selection.greedy_candidates(df, 40).collect()) == sorted(naive_candidates(songs, 40))


def rows_into_the_task(spark, monkeypatch, run):
    seen = []
    for name in ("pick_candidates", "pick_deck"):
        monkeypatch.setattr(selection, name, lambda songs, *a: iter([("n", len(songs), "x")] if a[0] == 5 else [("n", "x", len(songs))]))
    seen = run().collect()
    return seen[0].selection_rank if "selection_rank" in seen[0] else seen[0].pick_order


@pytest.mark.parametrize("seed", range(2))
def test_selectors_hand_over_what_picks_can_reach(spark, monkeypatch, seed):
    rng = random.Random(seed)
    # every song has its own artist and album, so classes do not bound anything
    songs = [(f"s{i:04d}", rng.choice([1990, 1992]), 2, rng.choice([["a", "b"], ["b", "c"]]), f"x{i}" if i % 3 else f"x{i % 30}") for i in range(1500)]
    df = spark.createDataFrame(songs, "song_id string, year_final int, owners_count int, owner_ids array<string>, primary_artist_name string")
    assert sorted(tuple(r) for r in selection.greedy_candidates(df, 5).collect()) == sorted(naive_candidates(songs, 5))
    deck = [song(i, rng.choice([1990, 1991]), ("a", "b"), f"x{i}" if i % 3 else f"x{i % 30}", f"l{i}" if i % 4 else f"l{i % 40}", rng.choice([None, 10, 50]), rng.choice([None, f"g{i}", f"g{i % 200}"])) for i in range(1500)]
    # registered keys fill the class of the most popular songs
    deck += [song(2000 + i, 1990, ("a", "b"), "hot", "hot", 99, "k" if i % 2 else f"k{i}") for i in range(12)] + [song(3000, 1990, ("a", "b"), "hot", "hot", 98)] + [song(4000 + i, 1990, ("c",), None, None, 1, f"k{i}") for i in range(12)] + [song(5000, 1990, ("c",), None, None, 1, "k")]
    locked = [(f"s{4000 + i}", "c", 1990) for i in range(12)] + [("s5000", "c", 1990)]
    targets = {"a": 3, "b": 2}
    pool, lock = spark.createDataFrame(deck, POOL), spark.createDataFrame(locked, LOCKED)
    got = selection.greedy_deck(pool, lock, targets, 3, 2)
    want = naive_deck(deck, locked, targets, 3, 2)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and "s3000" in {w[0] for w in want}
    assert 5 < rows_into_the_task(spark, monkeypatch, lambda: selection.greedy_candidates(df, 5)) <= 5 * 4
    assert 20 < rows_into_the_task(spark, monkeypatch, lambda: selection.greedy_deck(pool, lock, targets, 3, 2)) <= 400


def test_islands_equal_transitive_closure(spark):
    rng = random.Random(3)
    rows = [(rng.choice("xyz"), i, rng.randint(0, 120_000)) for i in range(120)]
    got = defaultdict(set)
    for r in identity.islands(spark.createDataFrame(rows, "k string, id int, ms int"), ["k"], "ms", ["id"]).collect():
        got[r.k, r.island].add(r.id)
    up = {i: i for _, i, _ in rows}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, i, a in rows:
        for q, j, b in rows:
            if k == q and abs(a - b) <= 8000:
                up[top(i)] = top(j)
    want = defaultdict(set)
    for _, i, _ in rows:
        want[top(i)].add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_flatten_and_reasons(spark):
    t = lambda **k: dict(dict(id="t1", name="n", type="track", artists=[{"id": "a", "name": "A"}, {"id": "b", "name": "B"}], album={"id": "l"}), **k)
    rows = [
        dict(owner_id="o", ordinal=0, added_at="2020", track=t()), dict(owner_id="o", ordinal=1, added_at="2019", item=t()), dict(owner_id="o", ordinal=2, track=None), dict(owner_id="o", ordinal=3, track=t(id=" ")),
        dict(owner_id="o", ordinal=4, track=t(episode=True)), dict(owner_id="o", ordinal=5, is_local=True, track=t()), dict(owner_id="o", ordinal=6, is_local=True, track=t(is_local=False)), dict(owner_id="o", ordinal=7, track=t(type="episode", id=None)),
    ]
    import json

    schema = spark.createDataFrame([], ITEM_SCHEMA).schema
    items = spark.read.schema(schema).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))
    flat = catalog.flatten_items(items)
    got = {r.ordinal: r for r in flat.collect()}
    assert [got[i].reason for i in range(8)] == [None, None, "null", "null", "non_track", "local", None, "non_track"]
    assert (got[0].primary_artist_id, got[0].secondary_artist_names, got[0].album_id) == ("a", ["B"], "l")
    first = catalog.earliest_instances(flat.where("reason is null"), ["ordinal"], ["ordinal"]).collect()
    assert [(r.track_id, r.ordinal) for r in first] == [("t1", 1)]


def test_registry_rules(spark):
    rows = [("s1", "DECK_A_001", "A", "A|B", "printed", "v1", None), ("s2", "DECK_A_002", "A", "A", "pending", "v1", None)]
    schema = "song_id string, card_id string, expansion_anchor string, owners string, printed_status string, version string, printed_at string"
    reg = spark.createDataFrame(rows, schema)
    registry.require_valid(reg)
    more = spark.createDataFrame([("s3", "DECK_B_001", "B", "B", "pending", "v2", None)], schema)
    both = registry.append(reg, more)
    assert both.count() == 3 and reg.exceptAll(both).isEmpty()
    with pytest.raises(ValueError, match="already registered"):
        registry.append(reg, more.withColumn("song_id", F.lit("s1")))
    with pytest.raises(ValueError, match="bad_card_id"):
        registry.require_valid(more.withColumn("card_id", F.lit("DECK_B_1000")))
    assert registry.mark_printed(both, "v2", "now").where("printed_at = 'now'").count() == 1
    assert registry.delete_pending(both).count() == 1


def test_debounce_and_stream(spark, tmp_path):
    hold = [("d", "x", t) for t in (1000, 1200, 1419, 1420, 1900, 2319, 2320)] + [("d", "y", 2500), ("d", "x", 2600), ("d", "x", 3400), ("d", "x", 4201), ("e", "x", 5000)]
    df = spark.createDataFrame(hold, "device string, raw string, ms long")
    want = [("d", "x", 1420), ("d", "x", 2320), ("d", "x", 3400)]
    assert sorted(tuple(r) for r in scans.debounce(df, "device", "raw", "ms", []).collect()) == want
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = scans.debounce_stream(stream, "device", "raw", "ms", forget=None).writeStream.format("memory").queryName("accepted").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(tuple(r) for r in spark.table("accepted").collect()) == want


def test_listening_budget(spark):
    rows = [("t", 0, True), ("t", 30_000, False), ("t", 50_000, True), ("t", 90_000, False), ("u", 0, True), ("u", 1000, False)]
    got = {r.track: (r.played, r.time_up) for r in scans.listening(spark.createDataFrame(rows, "track string, ms long, playing boolean"), "track", "ms", "playing", []).collect()}
    assert got == {"t": (60_000, 80_000), "u": (1000, None)}


def test_connection_rules():
    link = scans.Link()
    steps = [("connect:a", 0), ("connect:a", 1000), ("stop", 2000), ("connect:a", 2600), ("connect:a", 6000), ("connect:a", 6100), ("connect:b", 6200), ("connected", 6300), ("stop", 6400), ("connect:b", 6500), ("failed", 6600), ("stop", 6700), ("connect:b", 6800), ("disconnect", 6900)]
    # a: starts, is on its way, survives an early stop, has hung and tries again, has hung twice and is blocked
    want = ["CONNECTING", "CONNECTING", "CONNECTING", "CONNECTING", "HUNG", "HUNG", "CONNECTING", "CONNECTED", "IDLE", "CONNECTING", "FAILED", "FAILED", "FAILED", "IDLE"]
    assert [link.step(e, t) for e, t in steps] == want


def test_streams(spark, tmp_path):
    rows = [("d", "playing", 0), ("d", "paused", 50_000), ("d", "playing", 60_000), ("d", "playing", 80_000), ("d", "reset", 90_000), ("e", "playing", 0)]
    spark.createDataFrame(rows, "k string, v string, t long").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("k string, v string, t long").parquet(str(tmp_path / "in"))
    for name, stream in (("budget", scans.listening_stream(source, "k", "v", "t", forget=None)), ("links", scans.connections_stream(source.withColumn("v", F.lit("connect:x")), "k", "v", "t", forget=None)), ("holds", scans.debounce_stream(source, "k", "v", "t", forget=None))):
        query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert query.awaitTermination(60)
    assert [tuple(r) for r in spark.table("budget").collect()] == [("d", 70_000)]
    assert sorted(r.state for r in spark.table("links").where("k = 'd'").collect()) == ["CONNECTING", "CONNECTING", "HUNG", "HUNG", "HUNG"]
    assert spark.table("holds").count() == 0
