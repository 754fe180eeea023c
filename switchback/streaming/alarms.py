"""Windows over the operation log, for batch rows and for streams alike.

On a stream the watermark bounds the state; on a table it has no effect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LATE = "10 minutes"
PAUSE_S = 3600


def _dated(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE) if rows.isStreaming else rows


def compute_budget(rows: DataFrame, most: float, seconds: str = "value", window: str = "5 minutes") -> DataFrame:
    """Tumbling windows whose summed compute time is over ``most``."""
    sums = _dated(rows).groupBy(F.window("ts", window)).agg(F.sum(seconds).alias("total"), F.count("*").alias("n"))
    return sums.where(F.col("total") > most).select(F.col("window.start").alias("start"), "total", "n")


def errors(rows: DataFrame, window: str = "15 minutes") -> DataFrame:
    """Tumbling windows with an error, and the worst duration in each."""
    sums = _dated(rows).groupBy(F.window("ts", window)).agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.max("value").alias("worst"))
    return sums.where("errors > 0").select(F.col("window.start").alias("start"), "errors", "worst")


def slow_windows(rows: DataFrame, most: float, window: str = "15 minutes") -> DataFrame:
    """Windows whose 95th percentile of duration is over ``most``; approximate, so that it streams."""
    sums = _dated(rows).groupBy(F.window("ts", window)).agg(F.percentile_approx("value", 0.95, 10000).alias("p95"))
    return sums.where(F.col("p95") > most).select(F.col("window.start").alias("start"), "p95")


def pause_intervals(trips: DataFrame, pause_s: int = PAUSE_S) -> DataFrame:
    """(service, start, end) of the pauses that trips cause: each trip pauses for ``pause_s``
    seconds, and a trip during a pause postpones its end. A trip by budget (``budget`` true)
    has no end of its own. The same rule as a keyed state machine, as islands of a table."""
    from pyspark.sql import Window as W

    order = W.partitionBy("service").orderBy("ts")
    until = F.when(F.col("budget"), F.lit(None)).otherwise(F.col("ts") + F.make_interval(secs=F.lit(pause_s)))
    rows = trips.withColumn("until", until)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    open_end = F.max(F.coalesce("until", F.lit("9999-12-31").cast("timestamp"))).over(before)
    marked = rows.withColumn("island", F.sum(F.when(open_end.isNull() | (F.col("ts") > open_end), 1).otherwise(0)).over(order))
    return marked.groupBy("service", "island").agg(F.min("ts").alias("start"), F.when(F.bool_or("budget"), None).otherwise(F.max("until")).alias("end")).drop("island")


EVENTS = "service string, event string, at timestamp"


def _pause_machine(pause_s: int):
    """(key, rows, state) → events. The state is the end of the pause in epoch seconds; -1 has no end."""
    import pandas as pd

    def run(key, frames, state):
        events, until = [], state.get[0] if state.exists else None
        if state.hasTimedOut:
            if until is not None and until >= 0:
                events.append((key[0], "resume", pd.Timestamp(until, unit="s")))
            state.remove()
        else:
            rows = sorted(((t.timestamp() if t.tzinfo else t.tz_localize("UTC").timestamp()), bool(b)) for pdf in frames for t, b in zip(pdf.ts, pdf.budget, strict=True))
            for at, budget in rows:
                if until is not None and 0 <= until < at:
                    events.append((key[0], "resume", pd.Timestamp(until, unit="s")))
                    until = None
                if until is None:
                    events.append((key[0], "pause", pd.Timestamp(at, unit="s")))
                until = -1.0 if budget or until == -1.0 else max(until or 0.0, at + pause_s)
            state.update((until,))
            now = state.getCurrentWatermarkMs()
            if until >= 0:
                state.setTimeoutTimestamp(max(int(until * 1000), now + 1))
        yield pd.DataFrame(events, columns=["service", "event", "at"])

    return run


def pause_events(trips: DataFrame, pause_s: int = PAUSE_S) -> DataFrame:
    """A stream of pause and resume events from a stream of trips (service, ts, budget): the state
    machine behind ``pause_intervals``, resumed by event time."""
    rows = _dated(trips)
    return rows.groupBy("service").applyInPandasWithState(_pause_machine(pause_s), EVENTS, "until double", "append", "EventTimeTimeout")
