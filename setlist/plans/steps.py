"""A run's steps, each done once for the same inputs.

A step names the tables it reads and writes and the parameters it looks at. Its key is a digest of these: of the versions of
tables, of names, lengths and times of files. When a step is done, its key and the versions it wrote are put down beside the run, in one
atomic file. Before a step runs, the file is looked at: same key and the outputs still there, and the step is skipped. So
a run that was killed, or that is started again with one input changed, repeats what that concerns and nothing else.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from ..sources.snapshots import Store, Table

#: Raise it when a step's results change for the same inputs.
REVISION = 1


@dataclass(frozen=True)
class Step:
    """``reads`` and ``writes`` are paths of tables, ``files`` of folders or files that others write; ``exports`` are
    paths of files that the step makes."""

    name: str
    work: Callable[[], None]
    reads: tuple[str, ...] = ()
    writes: tuple[str, ...] = ()
    files: tuple[tuple[str, str | None], ...] = ()
    exports: tuple[str, ...] = ()
    params: dict = field(default_factory=dict)


class Runner:
    """Steps of one run; ``path`` is the run's folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.store = spark, path, Store(spark, path)
        self.performed: list[str] = []

    def identity(self, path: str) -> list[str] | None:
        """The data folders of a table's last version: their names are never used twice."""
        table = Table(self.spark, path)
        return None if (v := table.version()) is None else table.entry(v)["data"]

    def key(self, step: Step) -> str:
        seen = {"step": step.name, "revision": REVISION, "params": step.params, "reads": {p: self.identity(p) for p in step.reads}, "files": {p: self.store.listing(p, skip) for p, skip in step.files}}
        return hashlib.sha256(json.dumps(seen, sort_keys=True, default=str).encode()).hexdigest()

    def _note(self, step: Step) -> str:
        return f"{self.path}/steps/{step.name}.json"

    def done(self, step: Step) -> bool:
        if not self.store.exists(self._note(step)):
            return False
        note = json.loads(self.store.read(self._note(step)))
        there = all(self.identity(p) == was for p, was in note["writes"].items()) and all(self.store.exists(p) for p in step.exports)
        return there and note["key"] == self.key(step)

    def perform(self, steps: list[Step]) -> list[str]:
        """Work through ``steps``; returns the names of those that were not done yet."""
        for step in steps:
            if self.done(step):
                continue
            key = self.key(step)
            step.work()
            self.store.write(self._note(step), json.dumps({"key": key, "writes": {p: self.identity(p) for p in step.writes}}), replace=True)
            self.performed.append(step.name)
        return self.performed

    def pinned(self, name: str, value: Callable[[], object]) -> object:
        """A value that is worked out when the run first asks for it and stays the same for it."""
        path = f"{self.path}/steps/pin-{name}.json"
        if not self.store.exists(path):
            self.store.write(path, json.dumps(value()), replace=True)
        return json.loads(self.store.read(path))
