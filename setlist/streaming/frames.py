"""What a busy reader gets to see of a camera: the region it aims at, and the latest frame only.

Batch and stream share one expression each. The stream forgets: its windows close when the watermark passes them, detections
later than that are dropped, and repeats of a detection are known for as long as the watermark's delay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def within(region: Column, x: Column, y: Column) -> Column:
    """Whether a point (shares of the image's sides) is in the region; everything is, while the region is unknown."""
    inside = (x >= region["left"]) & (x <= region["right"]) & (y >= region["top"]) & (y <= region["bottom"])
    return F.coalesce(region.isNull() | inside, F.lit(False))


def candidates(detections: DataFrame, region: Column, x: str, y: str, area: str, least_area: float) -> DataFrame:
    """Detections whose centre is in the region and that are large enough."""
    return detections.where(within(region, F.col(x), F.col(y)) & (F.col(area) >= least_area))


def latest(detections: DataFrame, device: str, time: str, frame: str, value: str, area: str, every: str) -> DataFrame:
    """Of each device and window of ``every``, the last frame's largest code; ties of time go by frame, ties of area
    by value (A33, R06). ``time`` is a timestamp, with a watermark in a stream, where windows come out once closed."""
    best = F.max_by(F.struct(frame, value, area), F.struct(time, frame, area, value))
    out = detections.groupBy(F.window(time, every).alias("w"), device).agg(best.alias("b"))
    return out.select(device, F.col("w.start").alias("window_start"), f"b.{frame}", f"b.{value}", f"b.{area}")


def latest_stream(detections: DataFrame, device: str, time: str, frame: str, value: str, area: str, every: str, delay: str) -> DataFrame:
    """:func:`latest` over a stream. A reader that is restarted may send a detection twice: it counts once."""
    once = detections.withWatermark(time, delay).dropDuplicatesWithinWatermark([device, frame, value])
    return latest(once, device, time, frame, value, area, every)
