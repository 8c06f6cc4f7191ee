"""The run as a graph of steps: end to end, resumed after every step, and by commands."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from setlist.operators import identity, registry
from setlist.plans import jobs
from setlist.plans.jobs import Jobs, Settings
from setlist.plans.steps import Step
from setlist.sources import playlists, tables
from setlist.sources.snapshots import Table


def track(i, name, artist, isrc=None, ms=200_000, date="1999-05-07", others=()):
    return {"id": f"t{i}", "name": name, "type": "track", "artists": [{"id": a, "name": a.title()} for a in (artist, *others)], "album": {"id": f"l{i % 3}", "name": "x", "release_date": date}, "external_ids": {"isrc": isrc}, "duration_ms": ms, "popularity": i}


def landed(spark, tmp_path):
    a = [track(1, "Song", "ana", "I1", 271_280, "2004"), track(2, "Song - Remastered 2009", "ana", "I2", 269_906, "1994-02-01"), track(3, "Song (Club Remix)", "ana", "I3", 270_000), track(4, "Song", "ana", "I4", 271_000, others=["eve"]), track(5, "Song (Live)", "ana", "I5", 270_500)]
    b = [track(1, "Song", "ana", "I1", 271_280, "2004"), *[track(10 + i, f"Other {i}", f"art{i % 4}", None, 100_000 + i, str(1980 + i)) for i in range(12)]]
    rows = [(o, i, json.dumps({"added_at": "2020-01-01", "track": t})) for o, ts in (("ann", a), ("bob", b)) for i, t in enumerate(ts)]
    rows.append(("bob", 99, json.dumps({"track": None})))
    playlists.land(spark.createDataFrame(rows, "owner_id string, ordinal long, json string"), str(tmp_path / "raw"))


def settings(tmp_path, run_id="r1", **more):
    config = playlists.Config([{"owner_id": "ann", "owner_name": "Ann A"}, {"owner_id": "bob"}], 4, {})
    base = dict(run_id=run_id, root=str(tmp_path / "runs"), store=str(tmp_path / "store"), raw=str(tmp_path / "raw"), config=config, now="2024-02-02T00:00:00", as_of_year=2030, mirror=str(tmp_path / "mirror"), style="p {}", script="let x = '</b>';", split="both")
    return Settings(**base | more)


def year_of(key):
    return {"recordings": [{"first-release-date": "1990"}]} if key == "I1" else None


class Killed(Exception):
    pass


def killed_after(steps, name):
    """The same steps; the one after ``name`` dies when half done, its tables written and nothing put down."""

    def dies(step):
        def work():
            step.work()
            raise Killed(step.name)

        return Step(step.name, work, step.reads, step.writes, step.files, step.exports, step.params)

    at = [s.name for s in steps].index(name)
    return steps[:at] + [dies(steps[at])]


def test_jobs_end_to_end(spark, tmp_path):
    landed(spark, tmp_path)
    s = settings(tmp_path)
    work = Jobs(spark, s)
    names = [x.name for x in work.steps()]
    assert names == ["instances", "identity", "years", "catalogs", "state", "curated", "candidates", "template", "audits", "select", "register", "exports"]
    # each step dies once, half done, and is all that a new start repeats
    for i, name in enumerate(names):
        with pytest.raises(Killed, match=name):
            Jobs(spark, s).run(killed_after(Jobs(spark, s).steps(), name))
        done = Jobs(spark, s).run(Jobs(spark, s).steps()[: i + 1])
        assert done == [name], (name, done)
    assert Jobs(spark, s).run() == []
    out = s.out
    read = lambda n: tables.read_table(spark, f"{out}/{n}", "x")
    named = {r.track_id: r for r in read("tracks").collect()}
    assert named["t1"].song_id == named["t2"].song_id and named["t1"].match_type == "postpass_conservative"
    assert named["t1"].winner_track_id == "t1" and named["t1"].song_release_date == "1994-02-01"
    assert len({named[f"t{i}"].song_id for i in (1, 3, 4, 5)}) == 4 and len(named) == 17
    assert identity.colliding_songs(read("tracks")).count() == 0
    cards = work.registered()
    assert cards.count() == 7 and cards.select("song_id").distinct().count() == 7  # killed twice, registered once
    registry.require_valid(cards)
    assert work.ledger.verify().isEmpty()
    # what people get
    sheet = tables.read_review(spark, f"{s.reports}/candidates_review_template.csv")
    assert sheet.count() == 16 and {"song_id", "year_override", "ai_year", "owners"} <= set(sheet.columns)
    assert "Ann A, bob" in {r.owners for r in sheet.collect()}
    deck = spark.read.text(f"{s.reports}/deck")
    assert sorted(r.value for r in deck.collect()) == sorted(r.value for r in spark.read.text(str(tmp_path / "mirror")).collect()) and deck.count() == 2
    pages = [r.value for r in spark.read.text(f"{s.reports}/deck_report", wholetext=True).collect()]
    assert len(pages) == 2 and all("<style>p {}</style>" in p and "'<\\/b>'" in p for p in pages)
    payload = json.loads(pages[0].split('id="payload">')[1].split("</script>")[0])
    assert payload["expansion"] in ("ann", "bob") and len(payload["cards"]) in (3, 4) and [o["owner_id"] for o in payload["owners"]] == ["ann", "bob"] and payload["meta"]["version"] == "v1"
    plan = spark.read.option("header", True).csv(f"{s.reports}/print_plan.csv")
    assert {r.job: r["count"] for r in plan.groupBy("job").count().collect()} == {"full_deck": 7, "expansion_ann": 3, "expansion_bob": 4}
    jobs.filtered_report(cards, str(tmp_path / "found.csv"), "SONG", 1990, None, by="year", descending=True)
    found = tables.read_review(spark, str(tmp_path / "found.csv"))
    assert found.count() > 0 and all("song" in r.title.lower() for r in found.collect())


def test_corrections_reach_the_deck(spark, tmp_path):
    landed(spark, tmp_path)
    first = settings(tmp_path, fetcher="tests.test_jobs.year_of")
    Jobs(spark, first).run()
    found = tables.read_table(spark, f"{first.out}/review_template", "x")
    row = found.where("winner_track_id = 't1'").first()
    assert (row.mb_first_release_year, row.mb_match, row.year_candidate) == (1990, "diff", 1994) and "lookup_mismatch" in row.suspect_reason
    song = row.song_id
    # people fill the sheet in, and it comes back with the next run
    sheet = tmp_path / "reviewed.csv"
    sheet.mkdir()
    rows = [("song_id", "year_override", "ai_year", "artists_display_override", "title_display_override", "note", "ai_note"), (song, "1991", "1985", "", "New", "seen", "guess")]
    other = found.where(F.col("song_id") != song).first().song_id
    rows += [(other, "", "1970", "X feat. Y", "", "", "")]
    (sheet / "a.csv").write_text("\n".join(",".join(r) for r in rows) + "\n")
    second = settings(tmp_path, "r2", sheet=str(sheet), now="2024-03-03T00:00:00", as_of_year=2031)
    names = [x.name for x in Jobs(spark, second).steps()]
    assert names[4:7] == ["state-before", "import", "state"]
    for name in ("import", "state"):
        with pytest.raises(Killed):
            Jobs(spark, second).run(killed_after(Jobs(spark, second).steps(), name))
    Jobs(spark, second).run()
    assert Jobs(spark, second).run() == []
    events = jobs.runs.history(spark, second.store, jobs.EVENT).orderBy("seq").collect()
    assert [(r.entity_id, r.year_override, r.seq, r.run_id) for r in events] == [(song, 1991, 0, "r2"), (other, 1970, 1, "r2")]  # the sheet's order, once
    r = tables.read_table(spark, f"{second.out}/songs_curated", "x").where(F.col("song_id") == song).first()
    assert (r.title, r.owner_ids, r.note) == ("New", ["ann", "bob"], "seen")
    assert tables.read_table(spark, f"{second.out}/years_curated", "x").where(F.col("song_id") == song).first().year_final == 1991
    assert tables.read_table(spark, f"{second.out}/curation_apply_qc", "x").first().songs_with_year_override == 2
    # the second run found the targets met, and the first run's cards where they were
    cards = Jobs(spark, second).registered()
    assert cards.count() == 7 and Jobs(spark, second).ledger.verify().isEmpty()
    # a third run that discards what was never printed builds anew, with the corrected titles
    third = settings(tmp_path, "r3", discard_pending=True, as_of_year=2031)
    Jobs(spark, third).run()
    cards = Jobs(spark, third).registered()
    assert cards.count() == 7 and {r.run_id for r in cards.collect()} == {"r3"} and "New" in {r.title for r in cards.collect()}
    # new playlists concern what hangs on them
    assert Jobs(spark, third).run() == []
    more = [("ann", 50, json.dumps({"added_at": "2021", "track": track(50, "Late", "zoe", None, 1000, "2001")}))]
    playlists.land(spark.createDataFrame(more, "owner_id string, ordinal long, json string"), str(tmp_path / "raw"), mode="append")
    again = Jobs(spark, third).run(Jobs(spark, third).ingest())
    assert again == ["instances", "identity", "years", "catalogs"]
    assert Table(spark, f"{third.store}/track_catalog").read().count() == 18


def test_commands(spark, tmp_path, capsys):
    from setlist.__main__ import main

    landed(spark, tmp_path)
    (tmp_path / "c.json").write_text(json.dumps({"owners": [{"owner_id": "ann"}, {"owner_id": "bob"}], "deck": {"expansion_size": 4}}))
    common = ["--config", str(tmp_path / "c.json"), "--runs", str(tmp_path / "runs"), "--store", str(tmp_path / "store")]
    assert main(["run", *common, "--raw", str(tmp_path / "raw"), "--version", "v7", "--run-id", "r1", "--as-of-year", "2030"], spark) == 0
    assert json.loads(Path(tmp_path, "runs", "r1", "manifest.json").read_text())["run_id"] == "r1"
    assert main(["registry", "show", *common], spark) == 0
    assert "7 cards" in capsys.readouterr().out
    assert main(["registry", "mark-printed", *common, "--version", "v0"], spark) == 0
    assert "marked 0" in capsys.readouterr().out
    assert main(["registry", "mark-printed", *common, "--version", "v7"], spark) == 0
    assert "marked 7" in capsys.readouterr().out
    assert main(["registry", "validate", *common], spark) == 0
    # a card that was changed by hand
    book = jobs.Ledger(spark, f"{tmp_path / 'store'}/registry")
    book.table.commit(book.read().withColumn("card_id", F.lit("DECK_ann_1")), note=book.table.entry()["note"])
    assert main(["registry", "validate", *common], spark) == 1
    said = capsys.readouterr().out
    assert "duplicate_card_id" in said and "changed" in said
    # curate alone, in the last run
    assert main(["curate", *common, "--raw", str(tmp_path / "raw"), "--as-of-year", "2031"], spark) == 0
