import json
import subprocess
import sys
import uuid
import zipfile
from pathlib import Path

import pytest

from setlist.sources import playlists, tables, xlsx


def pages(playlist, offset, limit):
    """A client over 250 made-up items."""
    return {"items": [{"track": {"id": f"{playlist}{i}", "type": "track", "name": "n"}, "added_at": None} for i in range(offset, min(offset + limit, 250))], "total": 250}


def test_playlists(spark, tmp_path):
    spark.dataSource.register(playlists.PlaylistSource)
    df = spark.read.format("playlists").options(client="tests.test_sources.pages", playlists=json.dumps({"ana": "p", "bob": "q"})).load()
    assert df.count() == 500
    playlists.land(df, str(tmp_path / "raw"))
    back = playlists.scan(spark, str(tmp_path / "raw"))
    assert back.count() == 500 and back.where("owner_id = 'bob' and ordinal = 249").first().track.id == "q249"
    bad = tmp_path / "bad" / "owner_id=x"
    bad.mkdir(parents=True)
    (bad / "a.json").write_text('{"ordinal": 1, "raw": "{oops"}\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        playlists.scan(spark, str(tmp_path / "bad")).collect()


def counted(folder, offset, limit):
    """A client whose playlist is a folder: it says how long it is, and every page that is asked for leaves a mark there."""
    total = int(Path(folder, "total").read_text())
    got = [{"track": {"id": f"i{i}"}} for i in range(offset, min(offset + limit, total))]
    if limit > 1:
        Path(folder, f"page-{offset}-{limit}-{uuid.uuid4().hex}").touch()
    return {"items": got, "total": total}


def test_long_playlists_are_many_partitions(spark, tmp_path):
    spark.dataSource.register(playlists.PlaylistSource)
    folder = tmp_path / "p"
    folder.mkdir()
    (folder / "total").write_text("10000")
    options = dict(client="tests.test_sources.counted", playlists=json.dumps({"ana": str(folder)}))
    read = lambda **more: spark.read.format("playlists").options(**options, **more).load()
    ten = read()
    assert ten.rdd.getNumPartitions() == 10
    rows = sorted(ten.collect())
    assert [r.ordinal for r in rows] == list(range(10_000)) and len(list(folder.glob("page-*"))) == 100
    assert rows == sorted(read(pagesPerPartition=1000).collect())
    (folder / "total").write_text("0")
    assert read().count() == 0


def test_a_stream_fetches_new_pages_only(spark, tmp_path):
    spark.dataSource.register(playlists.PlaylistSource)
    folder = tmp_path / "p"
    folder.mkdir()

    def run(total):
        (folder / "total").write_text(str(total))
        for mark in folder.glob("page-*"):
            mark.unlink()
        stream = spark.readStream.format("playlists").options(client="tests.test_sources.counted", playlists=json.dumps({"ana": str(folder), "bob": str(folder)})).load()
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return sorted(int(m.name.split("-")[1]) for m in folder.glob("page-*"))

    assert run(250) == sorted([0, 100, 200] * 2)
    assert run(250) == []
    assert run(430) == sorted([250, 350] * 2)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.owner_id, r.ordinal) for r in rows) == [(o, i) for o in ("ana", "bob") for i in range(430)]


def test_config(tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"owners": [{"owner_id": "a"}, {"owner_id": "b"}], "deck": {"expansion_size": 40, "expansion_size_overrides": {"b": 5}}}))
    assert playlists.Config.load(str(p)).targets() == {"a": 40, "b": 5}
    p.write_text(json.dumps({"owners": [{"owner_id": "a"}], "deck": {"expansion_size_overrides": {"z": 1}}}))
    with pytest.raises(ValueError, match="unknown"):
        playlists.Config.load(str(p))


def test_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError, match="ingest"):
        tables.read_table(spark, path, "ingest")
    assert tables.read_or_empty(spark, path, "a int, b string").count() == 0
    for n in (1, 2):
        tables.publish(spark.range(n).selectExpr("cast(id as int) a"), path)
    got = tables.read_or_empty(spark, path, "a int, b string")
    assert got.count() == 2 and got.columns == ["a", "b"]
    reg = spark.createDataFrame([("s", "w" * 22, "DECK_A_001", 'q "x", y', None, 1999, "a|b", "a")], "song_id string, winner_track_id string, card_id string, title string, artists string, year int, owners string, expansion_anchor string")
    full = tables.read_or_empty(spark, path + "none", tables.REGISTRY_SCHEMA).unionByName(reg, allowMissingColumns=True)
    tables.write_csv(full, str(tmp_path / "csv"), quote_all=True)
    back = tables.read_registry(spark, str(tmp_path / "csv")).first()
    assert (back.title, back.year, back.artists) == ('q "x", y', 1999, None)
    assert tables.read_review(spark, str(tmp_path / "csv")).first().artists == ""
    tables.deck_json(reg).select("value").coalesce(1).write.text(str(tmp_path / "deck"))
    card = tables.read_deck(spark, str(tmp_path / "deck")).first()
    assert (card.card_id, card.owners) == ("DECK_A_001", ["a", "b"])
    (tmp_path / "broken.json").write_text("{no")
    assert tables.read_deck(spark, str(tmp_path / "broken.json")).count() == 0
    assert "<\\/script" in tables.report_html('{"a": "</script>"}', "t")


def test_xlsx(spark, tmp_path):
    path = str(tmp_path / "b.xlsx")
    one = spark.createDataFrame([("s<1>", 1999, ["a", "b"], True, 2.0), (None, None, [], False, 2.5)], "song_id string, year int, tags array<string>, ok boolean, x double")
    xlsx.write_book(path, {"review/1": one, "other": spark.createDataFrame([("z",)], "k string")})
    spark.dataSource.register(xlsx.XlsxSource)
    rows = [tuple(r) for r in spark.read.format("xlsx").option("sheet", "review_1").load(path).collect()]
    assert rows == [("s<1>", "1999", "a | b", "TRUE", "2"), ("", "", "", "FALSE", "2.5")]
    assert spark.read.format("xlsx").option("sheet", "other").load(path).first().k == "z"
    with pytest.raises(ValueError, match="no sheet"):
        list(xlsx.read_rows(path, "nope"))
    with pytest.raises(ValueError, match="equal names"):
        xlsx.write_book(path, {"a/b": one, "a:b": one})
    assert [xlsx.column_index(xlsx.column_name(i)) for i in (0, 25, 26, 701, 702)] == [0, 25, 26, 701, 702]


def test_xlsx_in_partitions(spark, tmp_path):
    path = str(tmp_path / "b.xlsx")
    xlsx.write_book(path, {"s": spark.range(2500).selectExpr("id", "concat('n', id) as name", "id % 2 = 0 as even")})
    spark.dataSource.register(xlsx.XlsxSource)
    df = spark.read.format("xlsx").option("rowsPerPartition", 300).load(path)
    assert df.rdd.getNumPartitions() == 9
    assert sorted((int(r.id), r.name, r.even) for r in df.collect()) == [(i, f"n{i}", str(i % 2 == 0).upper()) for i in range(2500)]
    two = spark.read.format("xlsx").option("columns", "even, id").load(path)
    assert two.columns == ["even", "id"] and two.where("even = 'TRUE'").count() == 1250
    with pytest.raises(Exception, match="no columns"):
        spark.read.format("xlsx").option("columns", "nope").load(path)


LARGE = """
import resource, sys
sys.path.insert(0, sys.argv[2])
from setlist.sources.xlsx import read_rows
n = 0
for row in read_rows(sys.argv[1]):
    n += 1
print(n, row[0], row[1], resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""


def test_a_large_sheet_in_little_memory(tmp_path):
    path = tmp_path / "large.xlsx"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{xlsx._NS["m"]}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="s" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{xlsx._NS["m"]}"><si><t>zero</t></si><si><r><t>o</t></r><r><t>ne</t></r></si></sst>')
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(f'<worksheet xmlns="{xlsx._NS["m"]}"><sheetData>'.encode())
            for i in range(1_000_000):
                f.write(f'<row r="{i + 1}"><c r="A{i + 1}"><v>{i}</v></c><c r="B{i + 1}" t="s"><v>{i % 2}</v></c></row>'.encode())
            f.write(b"</sheetData></worksheet>")
    out = subprocess.run([sys.executable, "-c", LARGE, str(path), str(Path(__file__).parents[1])], capture_output=True, text=True, timeout=300)
    n, first, second, mb = out.stdout.split()
    assert (n, first, second) == ("1000000", "999999", "one") and int(mb) < 500, out.stdout
