"""Tables as a log of snapshots.

A table is a folder of data folders, which are written once and never changed, and a log with one small file per
version that names the data folders of that version. A commit is one rename of a finished log file to the next number,
which fails if that number is taken. So a reader sees the version before or the one after and never half of one,
a writer that dies leaves data that no version names, and of two writers from one version the second raises
:class:`Conflict`. Older versions stay readable until :meth:`Table.prune`.

An append adds a data folder and leaves the others alone, whatever their size. A commit may carry a ``token``: a second commit
with it does nothing, so a job that is run again does not append twice.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer has committed since the version that a commit was based on."""


class Store:
    """Small files in whatever store Hadoop's file systems reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.jvm = spark, spark._jvm
        self.fs = self.at(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.at(path))

    def names(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.at(path))) if self.exists(path) else []

    def read(self, path: str) -> str:
        stream = self.fs.open(self.at(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, content: str | bytes, replace: bool = False) -> None:
        """The whole file appears at once. Without ``replace`` a file that is there raises."""
        staged = self.at(f"{path}.{uuid.uuid4().hex}.tmp")
        out = self.fs.create(staged, True)
        try:
            out.write(bytearray(content.encode() if isinstance(content, str) else content))
        finally:
            out.close()
        mode = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        modes = self.spark.sparkContext._gateway.new_array(mode, 1)
        modes[0] = mode.OVERWRITE if replace else mode.NONE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(staged, self.at(path), modes)
        except Exception as e:
            self.fs.delete(staged, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"{path} is there already") from None
            raise

    def delete(self, path: str) -> None:
        self.fs.delete(self.at(path), True)

    def age(self, path: str) -> float:
        """Seconds since the last change."""
        return time.time() - self.fs.getFileStatus(self.at(path)).getModificationTime() / 1000

    def listing(self, path: str, skip: str | None = None) -> list[tuple[str, int, int]]:
        """Names, lengths and times of the files below ``path``; none if it is missing. ``skip``: part of a path."""
        if not self.exists(path):
            return []
        if self.fs.getFileStatus(self.at(path)).isFile():
            s = self.fs.getFileStatus(self.at(path))
            return [("", s.getLen(), s.getModificationTime())]
        found, each, root = [], self.fs.listFiles(self.at(path), True), self.fs.getFileStatus(self.at(path)).getPath().toString()
        while each.hasNext():
            s = each.next()
            name = s.getPath().toString().removeprefix(root)
            if not s.getPath().getName().startswith((".", "_")) and not (skip and skip in name):
                found.append((name, s.getLen(), s.getModificationTime()))
        return sorted(found)


class Table:
    """One table of snapshots at ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.store = spark, path, Store(spark, path)

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.store.names(f"{self.path}/log") if n.endswith(".json") and not n.startswith(".")]

    def version(self) -> int | None:
        return max(self.versions(), default=None)

    def entry(self, version: int | None = None) -> dict:
        """What the log says of a version, the last one if none is named."""
        version = self.version() if version is None else version
        if version is None or not self.store.exists(self._log(version)):
            raise FileNotFoundError(f"{self.path} has no version {version}")
        return json.loads(self.store.read(self._log(version)))

    def _log(self, version: int) -> str:
        return f"{self.path}/log/{version:020d}.json"

    def read(self, version: int | None = None) -> DataFrame:
        entry = self.entry(version)
        schema = StructType.fromJson(entry["schema"])
        if not entry["data"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{d}" for d in entry["data"]])

    def done(self, token: str) -> dict | None:
        """The entry that carries ``token``, newest first."""
        return next((e for v in sorted(self.versions(), reverse=True) if (e := self.entry(v))["token"] == token), None)

    def commit(self, df: DataFrame, append: bool = False, token: str | None = None, note: dict | None = None, based_on: int | None = None) -> int:
        """Write ``df`` as the next version, in place of the rows before or after them; ``based_on`` is the version it was
        made from, the last one if none is named. Returns the version."""
        if token is not None and (earlier := self.done(token)):
            return earlier["version"]
        base = self.version() if based_on is None else based_on
        before = self.entry(base) if base is not None else None
        folder = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        schema, data = df.schema, [folder]
        if append and before:
            old = StructType.fromJson(before["schema"])
            schema = StructType(old.fields + [f for f in df.schema.fields if f.name not in old.names])
            data = before["data"] + data
        version = 0 if base is None else base + 1
        entry = {"version": version, "data": data, "added": folder, "append": append, "token": token, "note": note or {}, "schema": schema.jsonValue()}
        self.store.write(self._log(version), json.dumps(entry))
        return version

    def prune(self, keep: int, grace: float = 86_400) -> list[str]:
        """Forget all but the last ``keep`` versions, and delete data that no version names and that nobody has
        written to for ``grace`` seconds: a commit may be under way. Returns the folders deleted."""
        old = sorted(self.versions())
        for v in old[: max(0, len(old) - max(keep, 1))]:
            self.store.delete(self._log(v))
        used = {d for v in self.versions() for d in self.entry(v)["data"]}
        gone = [f"data/{n}" for n in self.store.names(f"{self.path}/data") if f"data/{n}" not in used and self.store.age(f"{self.path}/data/{n}") >= grace]
        for d in gone:
            self.store.delete(f"{self.path}/{d}")
        return gone
