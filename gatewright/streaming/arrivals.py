"""Results that arrive apart: a sample waits for each of its results, and goes on without it in the end.

Scanner, reviewer and guarded reviewer send their results for a sample as streams of their
own. Each is joined by a left outer join on the key within a bounded time, so the state that
a join keeps is bounded by that time and the watermarks: once they have passed a sample's
last moment, it is given out with nulls for what has not come. A batch runs the same plan
without watermarks.

Time is cut into pieces as long as a sample waits. A result joins the samples of its own
piece and of the one before, so the piece is a second key of the join: a key with many rows
is dealt over its pieces, and only rows near in time are compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_arrivals(samples: DataFrame, sides: dict[str, DataFrame], key: str, patience: str, late: str = "2 hours") -> DataFrame:
    """``samples`` (key, ts, ...) with ``<side>_ts`` and ``<side>_value`` of each of ``sides`` (key, ts, value).

    A result belongs to a sample of its key if it comes at the sample's time or up to
    ``patience`` after it; of several each gives a row. A null key or time matches nothing.
    On streams a row that is more than ``late`` behind the newest of its stream may be
    dropped, and a sample is given out once no result can come any more. ``patience`` is an
    interval of days or less.
    """
    streaming = samples.isStreaming
    wait = F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"interval {patience}"))
    piece = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / wait)
    out = (samples.withWatermark("ts", late) if streaming else samples).withColumn("_piece", piece)
    for name, side in sides.items():
        # the next join takes one event time only, so a result's own time goes on as a plain copy
        plain = F.col("ts") + F.expr("interval 0 seconds")
        pieces = F.explode(F.array(piece, piece - 1)).alias("_of")
        renamed = side.select(F.col(key).alias("_key"), F.col("ts").alias("_ts"), plain.alias(f"{name}_ts"), F.col("value").alias(f"{name}_value"), pieces)
        if streaming:
            renamed = renamed.withWatermark("_ts", late)
        in_time = (F.col("_ts") >= F.col("ts")) & (F.col("_ts") <= F.col("ts") + F.expr(f"interval {patience}"))
        out = out.join(renamed, (F.col(key) == F.col("_key")) & (F.col("_piece") == F.col("_of")) & in_time, "left_outer").drop("_key", "_ts", "_of")
    return out.drop("_piece")


def settled(joined: DataFrame, sides: list[str]) -> DataFrame:
    """``joined`` with n_arrived, the seconds that the last of its results took, and a status: complete, partial or missing."""
    n = sum((F.col(f"{s}_ts").isNotNull().cast("int") for s in sides), F.lit(0))
    last = F.greatest(*(F.col(f"{s}_ts") for s in sides)) if len(sides) > 1 else F.col(f"{sides[0]}_ts")
    status = F.when(n == len(sides), "complete").when(n > 0, "partial").otherwise("missing")
    waited = F.timestamp_diff("SECOND", F.col("ts"), last)
    return joined.withColumns({"n_arrived": n, "waited_seconds": waited, "status": status})


#: The part that an event plays where the stream of events stands for samples and their results.
EVENT_SIDES = {"scanner": "click", "reviewer": "error", "guarded": "purchase"}


def event_arrivals(events: DataFrame, patience: str = "12 hours", late: str = "2 hours") -> DataFrame:
    """Views as samples, clicks, errors and purchases of the same user as the results that come in later."""
    samples = events.where("event_type = 'view'").select("event_id", "user_id", "ts")
    sides = {n: events.where(F.col("event_type") == kind).select("user_id", "ts", F.col("event_id").alias("value")) for n, kind in EVENT_SIDES.items()}
    return settled(with_arrivals(samples, sides, "user_id", patience, late), list(EVENT_SIDES))
