"""Timers and watermarks: a stream gives the rows of the finished set, whatever order events come in."""

import random

import pytest
from pyspark.sql import functions as F

from setlist.streaming import frames, scans, timers

EVENTS = "device string, what string, ms long"


def drain(spark, stream, name, tmp_path, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    return q, spark.table(name)


@pytest.fixture
def rocks(spark):
    spark.conf.set(*timers.STATE_STORE)
    yield
    spark.conf.unset(timers.STATE_STORE[0])


def land(spark, rows, schema, tmp_path, files=3):
    """Rows in files that a stream reads one after the other."""
    per = -(-len(rows) // files)
    for i in range(files):
        spark.createDataFrame(rows[i * per : (i + 1) * per], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{i}"))
    return [str(tmp_path / f"in{i}") for i in range(files)]


def feed(spark, folders, schema, tmp_path):
    """One file a trigger, in the order of ``folders``."""
    import shutil
    import time
    from pathlib import Path

    Path(tmp_path / "feed").mkdir()
    for i, f in enumerate(folders):
        for p in Path(f).glob("*.parquet"):
            shutil.copy(p, tmp_path / "feed" / f"{i}.parquet")
            time.sleep(0.02)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "feed"))


def test_deadlines_of_a_finished_set(spark):
    rows = [("a", "connect:x", 0), ("b", "connect:x", 0), ("b", "connected", 2499), ("c", "connect:x", 0), ("c", "connect:x", 9000), ("d", "connect:x", 10_000), ("e", "connect:x", 0), ("e", "connected", 2500), (None, "connect:x", 0)]
    got = sorted(tuple(r) for r in timers.walk(spark.createDataFrame(rows, EVENTS), "device", "what", "ms", "connection", 2500, until=12_000).collect())
    assert got == [
        ("a", 0, "connect:x", "CONNECTING"), ("a", 2500, "timer", "HUNG"),
        ("b", 0, "connect:x", "CONNECTING"), ("b", 2499, "connected", "CONNECTED"),
        ("c", 0, "connect:x", "CONNECTING"), ("c", 2500, "timer", "HUNG"), ("c", 9000, "connect:x", "CONNECTING"), ("c", 11_500, "timer", "HUNG"),
        ("d", 10_000, "connect:x", "CONNECTING"),
        ("e", 0, "connect:x", "CONNECTING"), ("e", 2500, "connected", "CONNECTED"), ("e", 2500, "timer", "HUNG"),
    ]
    play = [("a", "playing", 0), ("b", "playing", 0), ("b", "paused", 400), ("b", "playing", 5000), ("c", "playing", 0), ("c", "reset", 700), ("c", "playing", 800), ("d", "playing", 11_500)]
    ups = sorted(tuple(r)[:2] for r in timers.walk(spark.createDataFrame(play, EVENTS), "device", "what", "ms", "listening", 1000, until=12_000).collect())
    assert ups == [("a", 1000), ("b", 5600), ("c", 1800)]
    assert timers.walk(spark.createDataFrame([], EVENTS), "device", "what", "ms", "listening", 1000, until=5).count() == 0


@pytest.mark.parametrize("machine,words,limit", [("connection", ["connect:x", "connect:y", "connected", "failed", "stop", "disconnect"], 2500), ("listening", ["playing", "playing", "paused", "reset"], 4000)])
def test_stream_equals_the_finished_set(spark, tmp_path, rocks, machine, words, limit):
    rng = random.Random(7)
    rows = sorted({(f"d{rng.randrange(6)}", rng.choice(words), rng.randrange(0, 60_000)) for _ in range(150)}, key=lambda r: r[2])
    silent = [("silent", words[0], 1000)]  # nothing ever comes after this one
    late = [(d, w, t) for d, w, t in rows if t % 7 == 0]  # some come a file later than they should
    first = [r for r in rows if r[2] < 30_000 and r not in late] + silent
    second = [r for r in rows if r[2] >= 30_000 and r not in late] + [r for r in late if r[2] >= 15_000]
    rng.shuffle(first)
    rng.shuffle(second)
    on_time = first + [r for r in late if r[2] < 15_000] + second
    end = [("other", "stop" if machine == "connection" else "paused", 200_000)]  # moves the watermark on, for other devices
    folders = []
    for i, part in enumerate((first + [r for r in late if r[2] < 15_000], second, end)):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
        folders.append(str(tmp_path / f"in{i}"))
    stream = timers.watch(feed(spark, folders, EVENTS, tmp_path), "device", "what", "ms", machine, limit, delay="20 seconds")
    _, got = drain(spark, stream, f"watch_{machine}", tmp_path)
    until = 200_000 - 20_000
    want = timers.walk(spark.createDataFrame(on_time + end, EVENTS), "device", "what", "ms", machine, limit, until)
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted((tuple(r) for r in want.collect()), key=key)
    mine = [(r.t, r.state) for r in got.where("k = 'silent' and event = 'timer'").collect()]
    assert mine == [(1000 + limit, "HUNG" if machine == "connection" else "TIME_UP")]


def test_a_silent_key_is_forgotten(spark, tmp_path, rocks):
    folders = []
    for i, part in enumerate(([("a", "connect:x", 5), ("a", "connected", 10)], [("b", "stop", 50_000)], [("b", "stop", 100_000)], [("b", "stop", 150_000)])):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
        folders.append(str(tmp_path / f"in{i}"))
    stream = timers.watch(feed(spark, folders, EVENTS, tmp_path), "device", "what", "ms", "connection", 2500, delay="1 second", forget=5000)
    q, got = drain(spark, stream, "forgetting", tmp_path)
    assert got.where("k = 'a'").count() == 2
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4  # one key's state, its timer, and what waits


DETECTIONS = "device string, at timestamp, frame long, raw string, area double, x double, y double"


def seconds(s):
    import datetime

    return datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(seconds=s)


def region():
    return scans.viewfinder_region(F.lit(1080.0), F.lit(1920.0), F.lit(720.0), F.lit(1280.0))


def test_frames_in_batch_and_stream(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"d{i % 3}", seconds(s), s * 10 + i, rng.choice("abc"), float(rng.randrange(1, 9)), rng.random(), rng.random()) for s in range(40) for i in range(3)]
    rows.append(("d0", seconds(20), 200, "z", 99.0, 0.5, 0.001))  # large, but outside of the viewfinder
    late = ("d1", seconds(1), 11, "late", 99.0, 0.5, 0.5)
    folders = []
    for i, part in enumerate((rows[:60], rows[40:], [("d9", seconds(300), 1, "q", 5.0, 0.5, 0.5)], [late])):  # 20 detections come twice
        spark.createDataFrame(part, DETECTIONS).coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
        folders.append(str(tmp_path / f"in{i}"))
    pick = lambda df: frames.candidates(df, region(), "x", "y", "area", 2.0)
    stream = frames.latest_stream(pick(feed(spark, folders, DETECTIONS, tmp_path)), "device", "at", "frame", "raw", "area", "10 seconds", "5 seconds")
    q, got = drain(spark, stream, "frames", tmp_path)
    want = frames.latest(pick(spark.createDataFrame(rows, DETECTIONS)), "device", "at", "frame", "raw", "area", "10 seconds")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 8
    assert got.where("raw in ('late', 'z')").count() == 0
    dropped = sum(op.get("numRowsDroppedByWatermark", 0) for p in q.recentProgress for op in p["stateOperators"])
    assert dropped >= 1  # the late one
    assert sum(op["numRowsTotal"] for op in q.lastProgress["stateOperators"]) <= 3  # what is closed is forgotten
    inside = [r for r in rows if r[4] >= 2.0 and 0.1334 <= r[5] <= 0.8666 and 0.2938 <= r[6] <= 0.7062]
    assert pick(spark.createDataFrame(rows, DETECTIONS)).count() == len(inside) < len(rows)
    none = scans.viewfinder_region(F.lit(0.0), F.lit(1920.0), F.lit(720.0), F.lit(1280.0))
    assert frames.candidates(spark.createDataFrame(rows, DETECTIONS), none, "x", "y", "area", 2.0).count() == sum(r[4] >= 2.0 for r in rows)
