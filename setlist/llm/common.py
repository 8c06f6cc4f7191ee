"""Helpers that several training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; only a local session without one (tests) gets a
    folder of its own, which other machines could not see."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="setlist-checkpoint-"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a job that runs meanwhile go at its end: what it made is kept elsewhere. Spark looks at the setting
    when a plan is made, so the plan has to be made anew meanwhile: ``select("*")`` does that."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Paths that were made since :func:`swept` began, if it has.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Tables and checkpoints that :func:`written`, :func:`cut` and :func:`cut_dealt` make meanwhile are deleted at the end: what
    was made of them has been written elsewhere by then."""
    paths: list[str] = []
    token = _made.set(paths)
    try:
        yield
    finally:
        _made.reset(token)
        for p in paths:
            discard(spark, p)


def _note(df: DataFrame) -> DataFrame:
    """Remember where a checkpoint is."""
    if (paths := _made.get()) is not None:
        file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            paths.append(file.get())
    return df


def written(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again: it cuts the lineage as
    :func:`cut` does, in compressed columns."""
    path = shared_folder(df.sparkSession, "table")
    if (paths := _made.get()) is not None:
        paths.append(path)
    with _tidy(df.sparkSession):
        df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing will read again, in whatever store it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and continue from there."""
    ensure_checkpoint_dir(df.sparkSession)
    with _tidy(df.sparkSession):
        return _note(df.select("*").checkpoint(eager=True))


def release(df: DataFrame) -> None:
    """Let the driver drop shuffle files that no live plan needs, such as those behind :func:`cut_dealt`.
    Spark removes them when the driver's garbage is collected, which may be long after. Plans hold on to
    each other across Python and the JVM, and each collection frees only what nothing held before it."""
    for _ in range(3):
        gc.collect()
        df.sparkSession._jvm.System.gc()
        time.sleep(0.3)


def trim() -> None:
    """Give memory that a finished task has freed back to the system: Python workers live on and
    do other work next, beside an executor whose own memory has grown meanwhile."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def cut_dealt(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    """:func:`cut` of rows dealt by ``keys``, which keeps how they were dealt: grouping by
    these keys needs no exchange afterwards. A plan that adapts itself forgets that, so this one
    plan is made without adapting."""
    ensure_checkpoint_dir(df.sparkSession)
    conf = df.sparkSession.conf
    adaptive = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        with _tidy(df.sparkSession):
            return _note(df.repartition(parts, *keys).checkpoint(eager=True))
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)


def whole_text(name: str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def match_spans(df: DataFrame, text: str, patterns: dict[str, str], prefix: str = "m_") -> DataFrame:
    """Add one array column per pattern with every leftmost, non-overlapping match.

    Each entry is ``struct<start: long, end: long, value: string>`` in code points, end
    exclusive. Spark has no function that returns match offsets, so a text is both matched and
    split by the same pattern: the lengths of the pieces and of the matches add up to offsets.
    Only texts with a match are split. All of it stays in the JVM.
    """
    kinds = list(patterns)
    keep = [F.col(f"`{c}`") for c in df.columns]
    df = df.select("*", *[F.regexp_extract_all(F.col(text), F.lit(patterns[k]), F.lit(0)).alias(f"__v_{k}") for k in kinds])
    df = df.select("*", *[F.when(F.size(f"__v_{k}") > 0, F.transform(F.split(F.col(text), patterns[k], -1), lambda x: F.length(x).cast("long"))).alias(f"__g_{k}") for k in kinds])
    # by how much each match moves on, from the end of the one before it
    step = lambda k: F.zip_with(F.slice(f"__g_{k}", 1, F.size(f"__v_{k}")), f"__v_{k}", lambda g, v: g + F.length(v))
    df = df.select("*", *[F.when(F.size(f"__v_{k}") > 0, step(k)).alias(f"__s_{k}") for k in kinds])
    df = df.select("*", *[_block_sums(f"__s_{k}").alias(f"__b_{k}") for k in kinds])
    df = df.select("*", *[_block_sums(f"__b_{k}").alias(f"__c_{k}") for k in kinds])
    return df.select(*keep, *[_spans(k).alias(prefix + k) for k in kinds])


#: Offsets are running sums. Spark copies what an aggregation carries at each step, so sums are carried
#: and arrays are not: sums of blocks of matches, sums of blocks of those, and what a match has before it in its own blocks.
MATCH_BLOCK = 48


def _total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda t, x: t + x)


def _block_sums(steps: str) -> Column:
    firsts = F.sequence(F.lit(1), F.size(steps), F.lit(MATCH_BLOCK))
    return F.when(F.size(steps) > 0, F.transform(firsts, lambda i: _total(F.slice(F.col(steps), i, F.lit(MATCH_BLOCK)))))


def _spans(kind: str) -> Column:
    values, gaps, steps, sums, tops = (F.col(f"__{c}_{kind}") for c in "vgsbc")

    def one(i):
        block = F.floor((i - 1) / MATCH_BLOCK).cast("int")
        top = F.floor(block / MATCH_BLOCK).cast("int")
        part = lambda array, size, start: _total(F.slice(array, start + 1, size))
        before = part(tops, top, F.lit(0)) + part(sums, block - top * MATCH_BLOCK, top * MATCH_BLOCK) + part(steps, i - 1 - block * MATCH_BLOCK, block * MATCH_BLOCK)
        start, value = before + F.element_at(gaps, i), F.element_at(values, i)
        return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"))

    # a column that only a lambda reads would be computed anew for every match; so each is read here too
    found = (F.size(values) > 0) & (F.size(gaps) > 0) & (F.size(steps) > 0) & (F.size(sums) > 0) & (F.size(tops) > 0)
    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    return F.when(found, F.transform(F.sequence(F.lit(1), F.size(values)), one)).otherwise(none)


#: Code points of a block of :func:`in_blocks`.
BLOCK = 4096


def in_blocks(text: Column) -> Column:
    """The text in pieces of :data:`BLOCK` code points. To take some out of a piece does not mean to walk the text."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def from_blocks(blocks: Column, start: Column, end: Column) -> Column:
    """The code points from ``start`` up to ``end`` of a text in blocks."""
    first, last = F.floor(start / BLOCK).cast("int"), F.floor(end / BLOCK).cast("int")
    of = lambda i: F.coalesce(F.try_element_at(blocks, i + 1), F.lit(""))
    here = lambda x, i: (x - i * BLOCK).cast("int")
    head = F.substring(of(first), here(start, first) + 1, F.lit(BLOCK))
    between = F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    within = F.substring(of(first), here(start, first) + 1, (end - start).cast("int"))
    return F.when(end <= start, "").when(first == last, within).otherwise(F.concat(head, between, F.substring(of(last), F.lit(1), here(end, last))))


def span_list(kinds: list[str], prefix: str = "m_") -> Column:
    """All spans of ``kinds`` as ``array<struct<start, kind_order, end, kind>>`` in report order."""

    def named(order: int, kind: str) -> Column:
        return F.transform(F.col(prefix + kind), lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("kind_order"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    return F.array_sort(F.concat(*[named(i, k) for i, k in enumerate(kinds)]))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


SALTS = 256


def salted_lookup(rows: DataFrame, table: DataFrame, key: str, salt_by: list[str], salts: int = SALTS) -> DataFrame:
    """Left join of ``rows`` to a table with one row per ``key``, for keys that many rows share.

    A row's salt comes from a hash of ``salt_by``. The table sends a key once per salt that
    occurs, and rows meet it by (key, salt), so a hot key is spread over ``salts`` groups."""
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in salt_by]), F.lit(salts)))
    wanted = salted.where(F.col(key).isNotNull()).select(key, "__salt").distinct()
    return salted.join(wanted.join(table, key), [key, "__salt"], "left").drop("__salt")
