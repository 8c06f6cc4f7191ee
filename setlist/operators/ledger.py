"""An append-only table that proves its rows unchanged and in order.

Rows have dense numbers. Of each append, blocks of :data:`BLOCK` rows get a digest of their rows in order, blocks of
these digests get digests in turn until one is left, and that root is chained to the head before it: head' = sha256(head, root,
rows). Rows that change, move, go or are slipped in alter a digest, whichever append they belong to.

An append reads the log's head and the last append's rows, which it proves again, and nothing older: its cost does not
grow with the table. :meth:`Ledger.verify` proves all of it in parallel: each block by itself from its rows, each append's root from
its blocks, and the chain from one root an append. Columns that may change later (print marks) are left out of the digests.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.positions import dense
from ..sources.snapshots import Table

#: Rows of a block, and digests of a block of digests.
BLOCK = 4096
#: Columns of a card that an update may change.
MUTABLE = ("printed_status", "printed_at")
START = "0" * 64


class Altered(ValueError):
    """Rows are not those that were appended."""


def row_text(columns: list[str]) -> Column:
    """A row as text, whatever order its columns have; null is told from empty."""
    return F.concat_ws("\x1f", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in sorted(columns)])


def digests(rows: DataFrame, columns: list[str], size: int = BLOCK, seq: str = "seq", key: tuple[str, ...] = ()) -> DataFrame:
    """``block, n, digest`` (after ``key``) of rows numbered by ``seq``: a block holds ``size`` rows at most."""
    each = rows.select(*key, F.floor(F.col(seq) / size).alias("block"), F.struct(F.col(seq).alias("at"), F.sha2(row_text(columns), 256).alias("d")).alias("r"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["d"]), "")
    return each.groupBy(*key, "block").agg(F.count(F.lit(1)).alias("n"), F.sha2(joined, 256).alias("digest"))


def root(blocks: DataFrame, size: int = BLOCK) -> str:
    """The digest over all blocks in order, level by level until ``size`` are left."""
    level = blocks.select("block", "digest")
    while level.count() > size:
        level = digests(level, ["digest"], size, "block").select("block", "digest")
    return hashlib.sha256("".join(r["digest"] for r in level.orderBy("block").collect()).encode()).hexdigest()


def chained(head: str, of: str, n: int) -> str:
    return hashlib.sha256(f"{head}{of}{n}".encode()).hexdigest()


def findings(expected: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """``key`` and ``why`` of blocks that are missing, new or different."""
    a, b = expected.select(*key, F.col("digest").alias("was")), found.select(*key, F.col("digest").alias("now"))
    why = F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "new").otherwise("changed")
    return a.join(b, key, "full").where(~F.col("was").eqNullSafe(F.col("now"))).select(*key, why.alias("why"))


class Ledger:
    """Rows at ``path`` as snapshots, each with ``seq`` and ``append`` (the number of its append)."""

    def __init__(self, spark: SparkSession, path: str, mutable: tuple[str, ...] = MUTABLE, size: int = BLOCK):
        self.spark, self.path, self.mutable, self.size = spark, path, mutable, size
        self.table = Table(spark, path)

    def read(self, version: int | None = None) -> DataFrame:
        return self.table.read(version)

    def appends(self, version: int | None = None) -> list[dict]:
        """What the log says of each append: its rows, digests, root and head."""
        return self.table.entry(version)["note"]["appends"] if self.table.version() is not None else []

    def _fixed(self, df: DataFrame, known: list[str] | None) -> list[str]:
        return known or sorted(c for c in df.columns if c not in (*self.mutable, "seq", "append"))

    def append(self, new: DataFrame, order: list[Column | str], token: str | None = None) -> int:
        """Add ``new`` behind the rows there are, numbered in ``order``. Raises if the last append is not as it was."""
        if token is not None and (earlier := self.table.done(token)):
            return earlier["version"]
        base = self.table.version()
        past = self.appends()
        if past:
            last = past[-1]
            if last["rows"] and not (bad := self.verify(only=len(past) - 1)).isEmpty():
                raise Altered(f"{self.path}: rows of the last append have changed: {[tuple(r) for r in bad.limit(5).collect()]}")
        start, head = (past[-1]["end"], past[-1]["head"]) if past else (0, START)
        rows = dense(new.drop("seq", "append"), order, "seq", start).withColumn("append", F.lit(len(past)))
        return self._commit(rows, rows, past, start, head, base, token, append=True)

    def _commit(self, rows: DataFrame, sealed: DataFrame, past: list[dict], start: int, head: str, base: int | None, token: str | None, append: bool) -> int:
        columns = self._fixed(sealed, None)
        folder = f"digests/{uuid.uuid4().hex}"
        digests(sealed.withColumn("seq", F.col("seq") - start), columns, self.size).write.parquet(f"{self.path}/{folder}")
        blocks = self.spark.read.parquet(f"{self.path}/{folder}")
        n = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
        top = root(blocks, self.size)
        made = {"rows": n, "start": start, "end": start + n, "digests": folder, "columns": columns, "root": top, "head": chained(head, top, n)}
        return self.table.commit(rows, append=append, token=token, note={"appends": [*past, made]}, based_on=base)

    def update(self, rows: DataFrame, token: str | None = None) -> int:
        """The same rows with other values in the columns that may change; raises if anything else differs."""
        base, past = self.table.version(), self.appends()
        if token is not None and (earlier := self.table.done(token)):
            return earlier["version"]
        if not (bad := self.verify(rows)).isEmpty():
            raise Altered(f"{self.path}: an update changes more than {self.mutable}: {[tuple(r) for r in bad.limit(5).collect()]}")
        return self.table.commit(rows, token=token, note={"appends": past}, based_on=base)

    def reseal(self, rows: DataFrame, token: str | None = None) -> int:
        """Start anew from ``rows``, numbered as they were: for rows that were taken out on purpose."""
        if token is not None and (earlier := self.table.done(token)):
            return earlier["version"]
        base = self.table.version()
        fresh = dense(rows.drop("append"), ["seq"], "seq").withColumn("append", F.lit(0))
        return self._commit(fresh, fresh, [], 0, START, base, token, append=False)

    def verify(self, rows: DataFrame | None = None, only: int | None = None) -> DataFrame:
        """``append, block, why`` of blocks that are not as the log says; block -1 is the chain. ``only``: one append."""
        past = self.appends()
        if rows is None:
            entry = self.table.entry()
            # what was added last has a folder of its own
            rows = self.spark.read.schema(StructType.fromJson(entry["schema"])).parquet(f"{self.path}/{entry['added']}") if only is not None and only == len(past) - 1 else self.read()
        wanted, found, head, broken = None, None, START, []
        for i, p in enumerate(past):
            if p["head"] != chained(head, p["root"], p["rows"]):
                broken.append((i, -1, "chain"))
            head = p["head"]
            if only is not None and i != only:
                continue
            blocks = self.spark.read.parquet(f"{self.path}/{p['digests']}").withColumn("append", F.lit(i))
            if root(blocks, self.size) != p["root"]:
                broken.append((i, -1, "root"))
            own = rows.where(F.col("append") == i).withColumn("seq", F.col("seq") - p["start"])
            seen = digests(own, p["columns"], self.size, key=("append",))
            wanted = blocks.select("append", "block", "digest") if wanted is None else wanted.union(blocks.select("append", "block", "digest"))
            found = seen.select("append", "block", "digest") if found is None else found.union(seen.select("append", "block", "digest"))
        marks = self.spark.createDataFrame(broken, "append int, block long, why string")
        return marks if wanted is None else findings(wanted, found, ["append", "block"]).union(marks)
