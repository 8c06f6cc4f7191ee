"""Release years from a web service, by way of a cache.

The caller names the function that fetches: ``(key) -> dict | None``, None for an unknown key. Nothing
here opens a connection. The service's rate limit makes it one partition, whatever the cluster's size.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import norm
from ..operators import curation
from .positions import dense
from .shared import cut
from .snapshots import Table

#: Fixed value: seconds between two requests at least.
PAUSE = 1.1
#: Keys between two commits, about a minute of asking; data folders that a cache may have before it is put in one.
FLUSH, MOST_FOLDERS = 50, 100


def earliest_year(payload: dict | None) -> int | None:
    """The smallest leading year among the recordings' first release dates."""
    dates = [str(r.get("first-release-date") or "").strip() for r in (payload or {}).get("recordings") or []]
    years = [int(d[:4]) for d in dates if d[:4].isascii() and d[:4].isdigit() and len(d) >= 4]
    return min(years, default=None)


def fetched(missing: DataFrame, key: str, fetcher: str, pause: float = PAUSE) -> DataFrame:
    """``key, year, fetched_at, failed`` of the keys that the service answered; an unknown key has a null year. A transient
    failure leaves no row, so that the next run asks again. Any other failure ends the task's work, not the task: what
    was fetched before it comes out, and a last row says what ``failed``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        module, name = fetcher.rsplit(".", 1)
        fetch: Callable = getattr(importlib.import_module(module), name)
        last = 0.0
        for b in batches:
            for k in b[key]:
                time.sleep(max(0.0, last + pause - time.monotonic()))
                last = time.monotonic()
                year, failed = None, None
                try:
                    year = earliest_year(fetch(k))
                except (OSError, ValueError):  # a transient failure
                    continue
                except Exception as e:
                    failed = f"{type(e).__name__}: {e}"
                yield pd.DataFrame({key: [k], "year": pd.array([year], "Int32"), "fetched_at": [pd.Timestamp.now("UTC").isoformat()], "failed": pd.array([failed], "string")})
                if failed:
                    return

    return missing.select(key).coalesce(1).sortWithinPartitions(key).mapInPandas(run, f"{key} string, year int, fetched_at string, failed string")


def cached(spark: SparkSession, path: str, key: str) -> DataFrame:
    """``key, year, fetched_at``: the last row of each key, known nulls included."""
    table = Table(spark, path)
    if table.version() is None:
        return spark.createDataFrame([], f"{key} string, year int, fetched_at string")
    return table.read().groupBy(key).agg(F.max_by(F.struct("year", "fetched_at"), "fetched_at").alias("r")).select(key, "r.*")


def fill(spark: SparkSession, wanted: DataFrame, path: str, key: str, fetcher: str, pause: float = PAUSE, flush: int = FLUSH) -> int:
    """Ask for the keys that the cache at ``path`` lacks, and add what comes back; returns how many keys were answered.

    Keys are asked in order, ``flush`` of them to a commit: what is committed stays, whatever happens to the task, the executor or
    the driver later, and the next call goes on from there. A failure that is not transient is raised once the keys before
    it are in the cache. Known keys, those with a null year too, are not asked for again (S16)."""
    table = Table(spark, path)
    cleaned = wanted.select(norm(F.col(key)).alias(key))
    misses = dense(curation.cache_misses(cleaned, cached(spark, path, key), key), [key], "__seq")
    answered = 0
    for at in range(0, misses.count(), flush):
        block = cut(fetched(misses.where(F.col("__seq").between(at, at + flush - 1)), key, fetcher, pause))
        good = block.where("failed is null").drop("failed")
        n = good.count()
        if n:
            table.commit(good, append=True)
            answered += n
        bad = block.where("failed is not null").first()
        if bad:
            raise RuntimeError(f"{bad[key]}: {bad['failed']}")
    if table.version() is not None and len(table.entry()["data"]) > MOST_FOLDERS:
        table.commit(cached(spark, path, key))
    return answered
