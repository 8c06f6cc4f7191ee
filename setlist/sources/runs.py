"""Runs: their ids, folders, manifests and the global store."""

from __future__ import annotations

import json
import random
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.keys import IDENTITY_VERSION
from . import positions
from .snapshots import Store, Table

FOLDERS = ("raw", "processed", "reports", "renders")


def run_id(now: datetime, seed: int) -> str:
    """A sortable id: the time, then six letters or digits drawn from the seed and the time."""
    draw = random.Random(seed + int(now.timestamp()))
    return f"{now:%Y%m%d_%H%M%S}_{''.join(draw.choices('abcdefghijklmnopqrstuvwxyz0123456789', k=6))}"


def create(spark: SparkSession, root: str, name: str) -> dict[str, str]:
    """The folders of a run, in whatever store ``root`` is; all but the renders are made at once."""
    store = Store(spark, root)
    paths = {f: f"{root}/{name}/{f}" for f in FOLDERS}
    for f in FOLDERS[:3]:
        store.fs.mkdirs(store.at(paths[f]))
    return paths


def write_manifest(spark: SparkSession, root: str, name: str, config: str, owners: list[dict], seed: int, now: datetime) -> None:
    """``manifest.json`` and ``params.json`` of a run; a run that goes on keeps what it began with."""
    manifest = {"run_id": name, "config_path": config, "identity_version": IDENTITY_VERSION, "owners": owners, "created_at": now.isoformat(timespec="seconds")}
    store = Store(spark, root)
    for file, content in (("manifest.json", manifest), ("params.json", {"seed": seed, "identity_version": IDENTITY_VERSION})):
        if not store.exists(f"{root}/{name}/{file}"):
            store.write(f"{root}/{name}/{file}", json.dumps(content, indent=2, ensure_ascii=False))


def manifest(spark: SparkSession, root: str, name: str) -> dict:
    return json.loads(Store(spark, root).read(f"{root}/{name}/manifest.json"))


def latest(spark: SparkSession, root: str) -> str | None:
    """The last run by name."""
    return max((n for n in Store(spark, root).names(root) if not n.startswith(".")), default=None)


def bootstrap(spark: SparkSession, store: str, schemas: dict[str, str]) -> None:
    """Empty tables for those that the store lacks."""
    for name, schema in schemas.items():
        table = Table(spark, f"{store}/{name}")
        if table.version() is None:
            table.commit(spark.createDataFrame([], StructType.fromDDL(schema)))


def append_history(events: DataFrame, store: str, run: str) -> None:
    """A run's events, in the order they have (S27, U09). A run that is repeated writes its own events again and no others';
    an empty table leaves none."""
    path = f"{store}/curation_history/run_id={run}"
    if events.isEmpty():
        Store(events.sparkSession, path).delete(path)
    else:
        events.drop("run_id").write.mode("overwrite").parquet(path)


def history(spark: SparkSession, store: str, schema: str, without: str | None = None) -> DataFrame:
    """Events of all runs (but one), with ``run_id`` and ``seq``: runs by name, then as each run wrote them."""
    path = f"{store}/curation_history"
    wanted = StructType.fromDDL(f"{schema}, run_id string")
    if not Store(spark, path).listing(path):
        return spark.createDataFrame([], StructType.fromDDL(f"{schema}, run_id string, seq long"))
    rows = positions.by_file(spark, path, wanted)
    return rows if without is None else rows.where(F.col("run_id") != without)
