"""What the player's answers mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Answers of a call that say that no device plays.
NO_DEVICE = {"GET devices": [404], "GET player": [204], "PUT seek": [404], "PUT play": [403, 404], "PUT pause": [403, 404]}
#: Texts of an answer, whatever its letters' case.
NO_DEVICE_TEXTS, PREMIUM_TEXT = ["NO_ACTIVE_DEVICE", "No active device"], "PREMIUM_REQUIRED"
#: Fixed value: a seek stays this far before the end, in milliseconds.
END_MS = 1000


def error_state(call: Column, status: Column, body: Column, signed_in: Column) -> Column:
    """The state that an answer which is not a success leads to. ``call`` is a method and the last part of its path; a
    null ``status`` is a connection that failed. ``signed_in``: the login has been tried already, so a refused one is an error."""
    says = lambda text: F.contains(F.lower(F.coalesce(body, F.lit(""))), F.lit(text.lower()))
    idle = (status == 404) & (says(NO_DEVICE_TEXTS[0]) | says(NO_DEVICE_TEXTS[1]))
    for name, codes in NO_DEVICE.items():
        idle = idle | ((call == name) & status.isin(codes))
    return (
        F.when(status.isNull(), "network")
        .when(status == 401, F.when(signed_in, "api_error").otherwise("login_required"))
        .when(F.coalesce(idle, F.lit(False)), "no_device")
        .when(says(PREMIUM_TEXT), "premium_required")
        .otherwise("api_error")
    )


def choose_device(devices: DataFrame, key: str, device: str, active: Column, order: list[str]) -> DataFrame:
    """``key`` and the device to play on: the first active one, else the first."""
    best = F.min(F.struct((~active).alias("idle"), *order, device)).alias("d")
    return devices.groupBy(key).agg(best).select(key, F.col(f"d.{device}").alias(device))


def seek_position(asked_ms: Column, duration_ms: Column) -> Column:
    """Within the track and not in its last second."""
    return F.greatest(F.lit(0), F.least(asked_ms, F.greatest(duration_ms - END_MS, F.lit(0)))).cast("long")
