"""Playlist items: landing, scanning and the paginated API as a data source."""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

_TRACK = (
    "struct<id: string, name: string, type: string, episode: boolean, is_local: boolean, explicit: boolean, duration_ms: bigint, popularity: int, "
    "artists: array<struct<id: string, name: string>>, album: struct<id: string, name: string, release_date: string>, external_ids: struct<isrc: string>, external_urls: struct<spotify: string>>"
)
ITEM_SCHEMA = f"owner_id string, ordinal long, added_at string, is_local boolean, track {_TRACK}, item {_TRACK}"
#: Fixed value: items per page of the API.
PAGE = 100
#: Pages of a partition.
PAGES = 10


@dataclass
class Config:
    """Owners and deck sizes."""

    owners: list[dict]
    expansion_size: int = 60
    overrides: dict[str, int] = field(default_factory=dict)
    artist_cap: int = 3
    album_cap: int = 2

    @classmethod
    def load(cls, path: str) -> Config:
        raw = json.loads(Path(path).read_text(encoding="utf-8"))
        deck = raw.get("deck") or {}
        out = cls(raw.get("owners") or [], deck.get("expansion_size", 60), deck.get("expansion_size_overrides") or {}, deck.get("artist_cap_per_expansion", 3), deck.get("album_cap_per_expansion", 2))
        ids = [o.get("owner_id") for o in out.owners]
        if not ids or any(not i for i in ids) or len(set(ids)) < len(ids):
            raise ValueError("the config needs at least one owner, each with an id of its own")
        if unknown := set(out.overrides) - set(ids):
            raise ValueError(f"sizes for unknown owners: {sorted(unknown)}")
        return out

    def targets(self) -> dict[str, int]:
        return {o["owner_id"]: self.overrides.get(o["owner_id"], self.expansion_size) for o in self.owners}


def playlist_id(text: F.Column) -> F.Column:
    """The id in a playlist URL, or the text itself."""
    return F.coalesce(F.nullif(F.regexp_extract(text, r"playlist[/:]([A-Za-z0-9]+)", 1), F.lit("")), F.trim(text))


class PlaylistSource(DataSource):
    """Playlists by pages (S01). ``client`` is the import path of a
    callable ``(playlist, offset, limit) -> {"items": [...], "total": n}``, ``playlists`` a JSON object of owners and playlists; register
    it with ``spark.dataSource.register(PlaylistSource)``.

    One item of each playlist is asked for first, which says how many there are: then ``pagesPerPartition`` pages make a
    partition, so a long playlist is many tasks. The last partition goes on for as long as there are items. As a stream, a
    trigger fetches what was added since the one before; what was taken away in between is not seen."""

    @classmethod
    def name(cls) -> str:
        return "playlists"

    def schema(self) -> str:
        return "owner_id string, ordinal long, json string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _PlaylistReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _PlaylistStream(self.options)


class _Range(InputPartition):
    """Items ``first`` up to ``last`` of a playlist; without a last one, all that follow."""

    def __init__(self, owner: str, playlist: str, first: int, last: int | None):
        self.owner, self.playlist, self.first, self.last = owner, playlist, first, last


class _Pages:
    """What the batch and the stream have in common."""

    def __init__(self, options: dict):
        self.module, self.function = options["client"].rsplit(".", 1)
        self.playlists: dict[str, str] = dict(sorted(json.loads(options["playlists"]).items()))
        self.size = PAGE * int(options.get("pagesPerPartition", PAGES))

    def client(self) -> Callable:
        return getattr(importlib.import_module(self.module), self.function)

    def totals(self) -> dict[str, int | None]:
        client = self.client()
        return {o: client(p, 0, 1).get("total") for o, p in self.playlists.items()}

    def ranges(self, owner: str, first: int, last: int, open_end: bool) -> list[_Range]:
        cuts = list(range(first, last, self.size)) or [first]
        ends = [*cuts[1:], None if open_end else last]
        return [_Range(owner, self.playlists[owner], a, b) for a, b in zip(cuts, ends, strict=True)]

    def fetch(self, part: _Range) -> Iterator[tuple]:
        client, offset = self.client(), part.first
        while part.last is None or offset < part.last:
            asked = PAGE if part.last is None else min(PAGE, part.last - offset)
            page = client(part.playlist, offset, asked)
            got = page.get("items") or []
            for i, item in enumerate(got):
                yield part.owner, offset + i, json.dumps(item, ensure_ascii=False)
            offset += len(got)
            if len(got) < asked or offset >= page.get("total", offset + 1):
                return


class _PlaylistReader(DataSourceReader):
    def __init__(self, options: dict):
        self.pages = _Pages(options)

    def partitions(self) -> list[_Range]:
        return [r for owner, total in self.pages.totals().items() for r in self.pages.ranges(owner, 0, total or 0, open_end=True)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        return self.pages.fetch(partition)


class _PlaylistStream(DataSourceStreamReader):
    """Offsets are how many items of each owner have been seen."""

    def __init__(self, options: dict):
        self.pages = _Pages(options)

    def initialOffset(self) -> dict:
        return dict.fromkeys(self.pages.playlists, 0)

    def latestOffset(self) -> dict:
        return {o: n or 0 for o, n in self.pages.totals().items()}

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        return [r for owner in self.pages.playlists if end.get(owner, 0) > start.get(owner, 0) for r in self.pages.ranges(owner, start.get(owner, 0), end[owner], open_end=False)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        return self.pages.fetch(partition)

    def commit(self, end: dict) -> None:
        pass


def land(items: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write raw items as JSON lines, one folder per owner, with their place kept."""
    items.select("owner_id", F.to_json(F.struct("ordinal", F.col("json").alias("raw"))).alias("value")).write.mode(mode).partitionBy("owner_id").text(path)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Landed items in :data:`ITEM_SCHEMA`; a malformed line raises."""
    lines = spark.read.schema("ordinal long, raw string, owner_id string").option("mode", "FAILFAST").json(path)
    inner = f"struct<added_at: string, is_local: boolean, track: {_TRACK}, item: {_TRACK}>"
    return lines.select("owner_id", "ordinal", F.from_json("raw", inner, {"mode": "FAILFAST"}).alias("r")).select("owner_id", "ordinal", "r.*")


def playlist_counts(items: DataFrame, totals: DataFrame) -> DataFrame:
    """Per owner what the API announced, what was fetched, and items with and without a track.
    ``totals``: ``owner_id, tracks_total, items_total``, of which the first that is known counts."""
    there = F.coalesce(F.col("track").isNotNull() | F.col("item").isNotNull(), F.lit(False))
    counts = items.groupBy("owner_id").agg(F.count(F.lit(1)).alias("fetched"), F.count_if(there).cast("long").alias("with_track"), F.count_if(~there).cast("long").alias("without_track"))
    known = totals.select("owner_id", F.coalesce("tracks_total", "items_total").alias("announced"))
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return known.join(counts, "owner_id", "left").select("owner_id", "announced", none("fetched"), none("with_track"), none("without_track"))
