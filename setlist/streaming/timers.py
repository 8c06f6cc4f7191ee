"""Operators that act when time has passed and no event has come: the listening budget and the watchdog of a
connection (R02, R03).

A machine takes events of one key in time order and may have a deadline. What happens at a deadline is a row of its own,
whether the key's next event comes later or never. In a finished set of events (:func:`walk`) deadlines up to ``until`` pass. In
a stream (:func:`watch`) the clock is the watermark: events wait in the key's state until it has passed them, are then
taken in time order, and a timer wakes the key at its next event or deadline. So late arrival within the watermark's delay changes
nothing, and the stream gives the rows of the finished set up to the watermark. What a key holds is its events of one
delay and a few numbers; a key that waits for nothing and has been silent for ``forget`` is dropped by a timer too.

Streams need the RocksDB state store (:data:`STATE_STORE`). Events without a key or a time are left out; equal times go by the event's text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .scans import BUDGET_MS, FORGET_MS, WATCHDOG_MS, Budget, Link

STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
SCHEMA = "k string, t long, event string, state string"


@dataclass
class Watchdog:
    """A connection that hangs at a set time after it began (R03): every event gives its state, every hang a row of its own."""

    link: Link
    watchdog: int = WATCHDOG_MS
    FIELDS = ("state", "track", "tries", "since", "blocked")

    def deadline(self) -> int | None:
        return self.link.since + self.watchdog if self.link.state == "CONNECTING" else None

    def expire(self, t: int) -> str | None:
        # the link finds by itself that it hangs; an unknown event changes nothing else
        return self.link.step("", t, watchdog=self.watchdog)

    def step(self, event: str, t: int) -> str | None:
        return self.link.step(event, t, watchdog=self.watchdog)

    def save(self) -> tuple:
        return tuple(getattr(self.link, f) for f in self.FIELDS)


@dataclass
class Listening:
    """A budget of playing time (R02): one row when it is used up, none for other events."""

    used: Budget
    budget: int = BUDGET_MS
    FIELDS = ("used", "at", "playing", "up")

    def deadline(self) -> int | None:
        b = self.used
        return b.at + self.budget - b.used if b.playing and not b.up else None

    def expire(self, t: int) -> str | None:
        self.used.step("playing", t, self.budget)
        return "TIME_UP"

    def step(self, event: str, t: int) -> str | None:
        self.used.step(event, t, self.budget)
        return None

    def save(self) -> tuple:
        return tuple(getattr(self.used, f) for f in self.FIELDS)


#: State columns of a machine, and how it is made from them and its limit.
MACHINES: dict[str, tuple[str, Callable]] = {
    "connection": ("state string, track string, tries long, since long, blocked boolean", lambda saved, limit: Watchdog(Link(*saved) if saved else Link(), limit)),
    "listening": ("used long, at long, playing boolean, up boolean", lambda saved, limit: Listening(Budget(*saved) if saved else Budget(), limit)),
}


def passed(machine, events: Iterator[tuple[int, str]], until: int) -> Iterator[tuple[int, str, str]]:
    """``t, event, state`` of events and deadlines up to ``until``, in time order; a deadline comes before an event of
    its moment. A deadline's event is ``timer``."""
    for t, event in events:
        while (d := machine.deadline()) is not None and d <= t:
            if (out := machine.expire(d)) is not None:
                yield d, "timer", out
        if (out := machine.step(event, t)) is not None:
            yield t, event, out
    while (d := machine.deadline()) is not None and d <= until:
        if (out := machine.expire(d)) is not None:
            yield d, "timer", out


def _rows(events: DataFrame, key: str, event: str, millis: str) -> DataFrame:
    rows = events.select(F.col(key).cast("string").alias("k"), F.col(millis).cast("long").alias("t"), F.coalesce(F.col(event).cast("string"), F.lit("")).alias("event"))
    return rows.where("k is not null and t is not null")


def walk(events: DataFrame, key: str, event: str, millis: str, machine: str, limit: int, until: int) -> DataFrame:
    """``k, t, event, state`` of a finished set of events, as known at ``until``. Keys are dealt, their events sorted, and
    one key's state is held at a time."""
    make = MACHINES[machine][1]
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _rows(events, key, event, millis).where(F.col("t") <= until).repartition(parts, "k").sortWithinPartitions("k", "t", "event")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, last = None, None, None
        for b in batches:
            out = []
            for k, t, e in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if k != current:
                    if held is not None:
                        out += [(current, *r) for r in passed(held, iter(()), until)]
                    current, held = k, make(None, limit)
                out += [(k, *r) for r in passed(held, iter([(t, e)]), t - 1)]
            last = b
            yield _batch(out)
        if last is not None and held is not None:
            yield _batch([(current, *r) for r in passed(held, iter(()), until)])

    return dealt.mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(4)], ["k", "t", "event", "state"])


class _Processor(StatefulProcessor):
    """One key of a stream."""

    def __init__(self, machine: str, limit: int, forget: int):
        self.machine, self.limit, self.forget = machine, limit, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.saved = handle.getValueState("saved", MACHINES[self.machine][0])
        self.waiting = handle.getListState("waiting", "t long, event string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            if len(frame):
                self.waiting.appendList([(int(t), e) for t, e in zip(frame["t"], frame["event"], strict=True)])
        yield from self._advance(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, timerValues, expiredTimerInfo.getExpiryTimeInMs())

    def _advance(self, key, timers, woken: int | None = None) -> Iterator[pd.DataFrame]:
        now = timers.getCurrentWatermarkInMs()
        events = sorted((int(t), e) for t, e in self.waiting.get()) if self.waiting.exists() else []
        due, later = [x for x in events if x[0] <= now], [x for x in events if x[0] > now]
        machine = MACHINES[self.machine][1](tuple(self.saved.get()) if self.saved.exists() else None, self.limit)
        out = list(passed(machine, iter(due), now))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        next_ = [t for t in (machine.deadline(), later[0][0] if later else None) if t is not None]
        if later:
            self.waiting.put(later)
        elif events:
            self.waiting.clear()
        if not next_ and woken is not None and not due:
            self.saved.clear()  # silent since ``forget`` milliseconds, and nothing to wait for
        else:
            self.saved.update(machine.save())
            self.handle.registerTimer(min(next_) if next_ else now + self.forget)
        if out:
            yield pd.DataFrame({"k": key[0], "t": [r[0] for r in out], "event": [r[1] for r in out], "state": [r[2] for r in out]})

    def close(self) -> None:
        pass


def watch(events: DataFrame, key: str, event: str, millis: str, machine: str, limit: int, delay: str = "10 seconds", forget: int = FORGET_MS) -> DataFrame:
    """:func:`walk` over a stream, as far as the watermark, which follows the latest event by ``delay``."""
    rows = _rows(events, key, event, millis).withColumn("at", F.timestamp_millis("t")).withWatermark("at", delay)
    return rows.groupBy("k").transformWithStateInPandas(_Processor(machine, limit, forget), SCHEMA, "append", "eventTime")
