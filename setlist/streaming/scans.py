"""Stateful operators over scan and player events.

Debounce, listening budget and connection state have a batch form, which deals events by key, sorts
each partition and walks it once with the state of one key, and a streaming form with the same step
function and keyed state. State is dropped when a key has been silent for ``FORGET_MS``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import astuple, dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

#: Fixed values, in milliseconds: hold to accept, gap that ends a hold, pause between accepts.
HOLD_MS, STALE_MS, COOLDOWN_MS = 420, 800, 900
#: The viewfinder's share of the view's width, its margin as a share of its side.
FRAME, MARGIN = 0.78, 0.03
#: Fixed value: listening time per card.
BUDGET_MS = 60_000
#: How long a connection may hang, how many attempts one track has, and how soon after
#: its start an attempt is not given up when the screen goes.
WATCHDOG_MS, ATTEMPTS, GRACE_MS = 2_500, 2, 5_000
#: A device that has been silent for this long starts afresh.
FORGET_MS = 3_600_000


@dataclass
class Hold:
    """What the debounce remembers of one device."""

    value: str | None = None
    since: int = 0
    seen: int = 0
    fired: int = 0

    def step(self, value: str, t: int, hold: int = HOLD_MS, stale: int = STALE_MS, cooldown: int = COOLDOWN_MS) -> bool:
        """Whether the value seen at ``t`` (milliseconds) is accepted."""
        if value != self.value or t - self.seen > stale:
            self.value, self.since, self.seen = value, t, t
            return False
        self.seen = t
        if t - self.since >= hold and t - self.fired >= cooldown:
            self.fired = t
            return True
        return False


@dataclass
class Budget:
    """Listening time of one device: what is used, since when it plays, and whether time is up."""

    used: int = 0
    at: int = 0
    playing: bool = False
    up: bool = False

    def step(self, value: str, t: int, budget: int = BUDGET_MS) -> int | None:
        """The moment the budget ran out, if it is before ``t``. ``value``: ``playing`` or not, or
        ``reset`` for a new card."""
        out = None
        if self.playing and not self.up:
            span = t - self.at
            if self.used + span >= budget:
                out, self.up = self.at + budget - self.used, True
            self.used = min(budget, self.used + span)
        if value == "reset":
            self.used, self.up = 0, False
        self.at, self.playing = t, value == "playing"
        return out


@dataclass
class Link:
    """The connection of one device to its player."""

    state: str = "IDLE"
    track: str | None = None
    tries: int = 0
    since: int = 0
    blocked: bool = False

    def step(self, event: str, t: int, watchdog: int = WATCHDOG_MS, attempts: int = ATTEMPTS, grace: int = GRACE_MS) -> str:
        """The state after an event: ``connect:<track>``, ``connected``, ``failed``, ``stop`` or
        ``disconnect``. A connection without an answer for ``watchdog`` hangs, whoever asks next."""
        if self.state == "CONNECTING" and t - self.since >= watchdog:
            self.state = "HUNG"
            self.blocked |= self.tries >= attempts
        kind, _, track = event.partition(":")
        if kind == "connect":
            if track != self.track:
                self.track, self.tries, self.blocked = track, 0, False
            if self.blocked or self.state == "CONNECTING":
                return self.state
            if self.tries >= attempts:
                self.state, self.blocked = "FAILED", True
            else:
                self.state, self.tries, self.since = "CONNECTING", self.tries + 1, t
        elif kind == "connected":
            self.state = "CONNECTED"
        elif kind == "failed":
            self.state = "FAILED"
        elif kind == "disconnect":
            self.state = "IDLE"
        elif kind == "stop":
            early = self.state == "CONNECTING" and t - self.since < grace
            if not early and self.state not in ("HUNG", "FAILED"):
                self.state = "IDLE"
        return self.state


def _ordered(events: DataFrame, key: str, value: str, millis: str, tie: list[str]) -> DataFrame:
    rows = events.select(F.col(key).alias("k"), F.col(value).cast("string").alias("v"), F.col(millis).cast("long").alias("t"), *[F.col(c).alias(f"tie_{c}") for c in tie])
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "k").sortWithinPartitions("k", "t", *[f"tie_{c}" for c in tie])


def _walk(dealt: DataFrame, state: type, step: Callable, out: str) -> DataFrame:
    """``k, v, t`` and ``out`` of every event, by ``step(state, value, millis)``; one key's state is held
    at a time, however many events it has."""
    schema = dealt.select("k", "v", "t", F.lit(None).cast(out.split()[1]).alias(out.split()[0])).schema
    kind = {"boolean": pa.bool_(), "long": pa.int64(), "string": pa.string()}[out.split()[1]]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = object(), state()
        for b in batches:
            made = []
            for k, v, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if k != current:
                    current, held = k, state()
                made.append(step(held, v, t))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(made, kind)], names=["k", "v", "t", out.split()[0]])

    return dealt.mapInArrow(walk, schema)


def _stream(events: DataFrame, key: str, value: str, millis: str, state: type, kept: str, step: Callable, out: str, forget: int | None) -> DataFrame:
    """The same over a stream; within a trigger events are taken in time order. A key that has been
    silent for ``forget`` milliseconds of processing time is dropped, so state does not grow with devices
    gone. Waiting for that keeps a query alive; one whose trigger ends by itself takes None."""
    rows = events.select(F.col(key).cast("string").alias("k"), F.col(value).cast("string").alias("v"), F.col(millis).cast("long").alias("t"))

    def update(k: tuple, frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        if group.hasTimedOut:
            group.remove()
            return
        held = state(*group.get) if group.exists else state()
        seen = pd.concat(list(frames)).sort_values("t", kind="stable")
        made = [step(held, v, int(t)) for v, t in zip(seen["v"], seen["t"], strict=True)]
        group.update(astuple(held))
        if forget is not None:
            group.setTimeoutDuration(forget)
        kind = {"boolean": "boolean", "long": "Int64", "string": "object"}[out.split()[1]]
        yield pd.DataFrame({"k": k[0], "v": seen["v"], "t": seen["t"], out.split()[0]: pd.array(made, kind)})

    return rows.groupBy("k").applyInPandasWithState(update, f"k string, v string, t long, {out}", kept, "append", GroupStateTimeout.NoTimeout if forget is None else GroupStateTimeout.ProcessingTimeTimeout)


_HOLD = "value string, since long, seen long, fired long"
_BUDGET = "used long, at long, playing boolean, up boolean"
_LINK = "state string, track string, tries long, since long, blocked boolean"


def debounce(events: DataFrame, key: str, value: str, millis: str, tie: list[str], **limits: int) -> DataFrame:
    """Accepted ``key, value, millis`` of a finished set of events."""
    hits = _walk(_ordered(events, key, value, millis, tie), Hold, lambda h, v, t: h.step(v, t, **limits), "hit boolean")
    return hits.where("hit").drop("hit").toDF(key, value, millis)


def debounce_stream(events: DataFrame, key: str, value: str, millis: str, forget: int | None = FORGET_MS, **limits: int) -> DataFrame:
    """The same over a stream."""
    hits = _stream(events, key, value, millis, Hold, _HOLD, lambda h, v, t: h.step(v, t, **limits), "hit boolean", forget)
    return hits.where("hit").drop("hit").toDF(key, value, millis)


def connections(events: DataFrame, key: str, event: str, millis: str, tie: list[str], **limits: int) -> DataFrame:
    """The connection's state after each event."""
    return _walk(_ordered(events, key, event, millis, tie), Link, lambda h, v, t: h.step(v, t, **limits), "state string").toDF(key, event, millis, "state")


def connections_stream(events: DataFrame, key: str, event: str, millis: str, forget: int | None = FORGET_MS, **limits: int) -> DataFrame:
    """The same over a stream."""
    return _stream(events, key, event, millis, Link, _LINK, lambda h, v, t: h.step(v, t, **limits), "state string", forget).toDF(key, event, millis, "state")


def listening_stream(events: DataFrame, key: str, value: str, millis: str, forget: int | None = FORGET_MS, budget: int = BUDGET_MS) -> DataFrame:
    """``key, time_up`` whenever a device's budget has run out (R02); the moment is known with the
    first event after it. ``value``: ``playing``, ``paused`` or ``reset``."""
    hits = _stream(events, key, value, millis, Budget, _BUDGET, lambda h, v, t: h.step(v, t, budget), "time_up long", forget)
    return hits.where("time_up is not null").select(F.col("k").alias(key), "time_up")


def keep_latest(frames: DataFrame, key: str, millis: str, tie: list[str], every: int) -> DataFrame:
    """Of the frames of a device within each ``every`` milliseconds only the last (R06): what a reader
    that is busy that long gets to see."""
    slot = F.floor(F.col(millis) / every).alias("slot")
    rest = [c for c in frames.columns if c != key]
    last = frames.groupBy(F.col(key), slot).agg(F.max_by(F.struct(*rest), F.struct(millis, *tie)).alias("f"))
    return last.select(key, "f.*")


def lookup(scanned: DataFrame, deck: DataFrame, track: str = "track_id") -> DataFrame:
    """Scans with their cards (J18). A track that is not in the deck stays, playable and without a card;
    of several cards of a track the last by id counts. ``scanned`` may be a stream."""
    card = F.struct(*[c for c in deck.columns if c != track])
    one = deck.groupBy(track).agg(F.max_by(card, "card_id").alias("card"))
    out = scanned.join(one, track, "left")
    return out.select(*scanned.columns, F.col("card").isNotNull().alias("known"), "card.*")


def listening(events: DataFrame, key: str, millis: str, playing: str, tie: list[str], budget: int = BUDGET_MS) -> DataFrame:
    """Per key the time played and the moment the budget ran out, null if it did not.

    An event holds until the next one of its key; the last one holds for no time."""
    w = Window.partitionBy(key).orderBy(millis, *tie)
    spans = events.select(key, millis, *tie, F.when(F.col(playing), F.lead(millis).over(w) - F.col(millis)).otherwise(0).alias("span"))
    run = spans.withColumn("span", F.coalesce("span", F.lit(0))).withColumn("before", F.coalesce(F.sum("span").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    crossing = F.when((F.col("before") < budget) & (F.col("before") + F.col("span") >= budget), F.col(millis) + (budget - F.col("before")))
    return run.groupBy(key).agg(F.least(F.sum("span"), F.lit(budget)).alias("played"), F.min(crossing).alias("time_up"))


def viewfinder_region(view_width: Column, view_height: Column, width: Column, height: Column, frame: float = FRAME, margin: float = MARGIN) -> Column:
    """The viewfinder on the upright camera image, as shares of its sides (S30). The image covers
    the view and both have one centre, so the square is centred on the image too. Null while a
    size is unknown."""
    scale = F.greatest(view_width / width, view_height / height)
    half = view_width * frame * (0.5 - margin) / scale
    side = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    known = (view_width > 0) & (view_height > 0) & (width > 0) & (height > 0)
    region = F.struct(side(0.5 - half / width).alias("left"), side(0.5 - half / height).alias("top"), side(0.5 + half / width).alias("right"), side(0.5 + half / height).alias("bottom"))
    return F.when(known, region)


def largest_per_frame(detections: DataFrame, frame: list[str], value: str, area: str, least_area: float) -> DataFrame:
    """The largest code of each frame, small ones ignored; ties by value."""
    return detections.where(F.col(area) >= least_area).groupBy(*frame).agg(F.max(F.struct(area, value)).alias("b")).select(*frame, f"b.{value}", f"b.{area}")
