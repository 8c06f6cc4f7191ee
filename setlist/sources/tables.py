"""Files of the pipeline: tables, registry, review sheets, deck export."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .snapshots import Store, Table

REGISTRY_SCHEMA = "song_id string, winner_track_id string, card_id string, title string, artists string, year int, owners string, expansion_anchor string, printed_status string, version string, identity_version string, run_id string, created_at string, printed_at string"


def exists(spark: SparkSession, path: str) -> bool:
    return Store(spark, path).exists(path)


def read_table(spark: SparkSession, path: str, made_by: str) -> DataFrame:
    """The last version of a table, or a plain Parquet folder; if it is missing, the error names the step that
    makes it (S07)."""
    if not exists(spark, path):
        raise FileNotFoundError(f"{path} is missing: run the step {made_by!r} first")
    table = Table(spark, path)
    return table.read() if table.version() is not None else spark.read.parquet(path)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table with the columns of ``schema``: missing ones are null, a missing table is
    empty (S08, S26)."""
    empty = spark.createDataFrame([], schema)
    if not exists(spark, path):
        return empty
    return empty.unionByName(read_table(spark, path, "bootstrap"), allowMissingColumns=True)


def publish(df: DataFrame, path: str, backup: str | None = None) -> None:
    """Commit ``df`` as the table's next version: readers see whole tables at any moment, and versions before
    stay readable (S09). ``backup`` names the version that is replaced, for :func:`read_backup` (S28)."""
    table = Table(df.sparkSession, path)
    before = table.version()
    table.commit(df, note={"backups": {**(table.entry()["note"].get("backups", {}) if before is not None else {}), **({backup: before} if backup and before is not None else {})}})


def read_backup(spark: SparkSession, path: str, backup: str) -> DataFrame:
    """The version that was replaced under that name."""
    table = Table(spark, path)
    return table.read(table.entry()["note"]["backups"][backup])


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The registry's CSV: text, empty is null, the year a number."""
    return spark.read.option("header", True).option("nullValue", "").option("multiLine", True).option("escape", '"').csv(path, schema=REGISTRY_SCHEMA)


def read_review(spark: SparkSession, path: str) -> DataFrame:
    """A reviewed CSV sheet: text only, blanks stay blank."""
    raw = spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).option("escape", '"').csv(path)
    return raw.na.fill("")


def write_csv(df: DataFrame, path: str, quote_all: bool = False) -> None:
    """One header per part, arrays joined by pipes with a blank on either side."""
    flat = [F.array_join(c, " | ").alias(c) if kind.startswith("array") else F.col(c) for c, kind in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).option("quoteAll", quote_all).option("escape", '"').csv(path)


def latest_run(runs: DataFrame) -> str | None:
    """The last run by name."""
    return runs.agg(F.max("run_id").alias("r")).first()["r"]


def deck_json(registry: DataFrame) -> DataFrame:
    """One JSON text per expansion for the app's deck file."""
    card = F.struct("card_id", "title", "artists", "year", F.split("owners", "[|]").alias("owners"), F.col("expansion_anchor").alias("expansion"), F.col("winner_track_id").alias("track_id"))
    return registry.groupBy("expansion_anchor").agg(F.to_json(F.array_sort(F.collect_list(card))).alias("value"))


def export_deck(registry: DataFrame, path: str, mirror: str | None = None) -> None:
    """The deck's files, one folder per expansion, and the same again at ``mirror``."""
    texts = deck_json(registry)
    for to in filter(None, (path, mirror)):
        texts.write.mode("overwrite").partitionBy("expansion_anchor").text(to)


def read_deck(spark: SparkSession, path: str) -> DataFrame:
    """Cards of a deck file by track id: valid ids only, the last of equal ids wins; a file that
    cannot be parsed is an empty deck (S18)."""
    card = "array<struct<card_id: string, title: string, artists: string, year: int, owners: array<string>, expansion: string, track_id: string>>"
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", card).alias("cards"))
    rows = text.select(F.posexplode("cards").alias("place", "c")).select("place", "c.*").where(F.col("track_id").rlike("^[A-Za-z0-9]{22}$"))
    return rows.groupBy("track_id").agg(F.max_by(F.struct("card_id", "title", "artists", "year", "owners", "expansion"), "place").alias("c")).select("track_id", "c.*")


def report_html(payload: str, title: str, style: str = "", script: str = "") -> str:
    """A page that carries its data and its assets; ``</`` is escaped inside scripts and styles, the title as text."""
    safe = lambda t: t.replace("</", "<\\/")
    return (
        f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{escape(title)}</title><style>{safe(style)}</style></head><body><div id="report"></div>'
        f'<script type="application/json" id="payload">{safe(payload)}</script><script>{safe(script)}</script></body></html>'
    )


def report_pages(parts: DataFrame, title: str, style: str = "", script: str = "") -> DataFrame:
    """A page per expansion from the parts of :func:`report.document` (``part, key, json``): its own counts and cards,
    and the report's meta and owners, which are one row an owner. Pages are put together by Spark (S19)."""
    marker = "\x00payload\x00"
    head, tail = report_html(marker, title, style, script).split(marker)
    common = parts.where("part in ('meta', 'owner')").agg(F.array_sort(F.collect_list(F.struct("part", "key", "json"))).alias("common"))
    own = parts.where("part in ('expansion', 'cards')").groupBy("key").agg(F.max(F.when(F.col("part") == "expansion", F.col("json"))).alias("counts"), F.max(F.when(F.col("part") == "cards", F.col("json"))).alias("cards"))
    rows = own.crossJoin(F.broadcast(common))  # one row
    name = F.regexp_extract(F.to_json(F.array("key")), r"(?s)^\[(.*)\]$", 1)
    meta = F.transform(F.filter("common", lambda x: x["part"] == "meta"), lambda x: x["json"])
    owners = F.transform(F.filter("common", lambda x: x["part"] == "owner"), lambda x: F.to_json(F.struct(x["key"].alias("owner_id"), x["json"].alias("counts"))))
    body = F.concat(F.lit('{"expansion":'), name, F.lit(',"counts":'), F.coalesce("counts", F.lit("null")), F.lit(',"cards":'), F.coalesce("cards", F.lit("[]")), F.lit(',"meta":'), F.coalesce(F.try_element_at(meta, F.lit(1)), F.lit("null")), F.lit(',"owners":['), F.array_join(owners, ","), F.lit("]}"))
    return rows.select(F.col("key").alias("expansion_anchor"), F.concat(F.lit(head), F.replace(body, F.lit("</"), F.lit("<\\/")), F.lit(tail)).alias("value"))
