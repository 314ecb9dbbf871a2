"""Streaming forms: windowed statistics with watermarks, sessions of events, and the forgetting estimator as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_rate(events: DataFrame, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(start, event_type, count, total): hopping (or tumbling) windows over (ts TIMESTAMP, event_type, value)."""
    span = F.window("ts", size, slide) if slide else F.window("ts", size)
    grouped = events.withWatermark("ts", late).groupBy(span.alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("count"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "count", "total")


def event_sessions(events: DataFrame, threshold: float, gap: str, late: str = "1 hour") -> DataFrame:
    """(event_type, start, end, peak): values above a threshold, merged while their gap is shorter than ``gap``."""
    grouped = events.filter(F.col("value") > threshold).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "event_type")
    return grouped.agg(F.max("value").alias("peak")).select("event_type", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "peak")


def running_moments(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, count, mean, variance): running count, mean and sample variance of every key, merged as Spark merges partial moments."""
    return rows.groupBy(key).agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.var_samp(value).alias("variance"))


def forgetting_stream(observations: DataFrame, states: int, rate: float, tau: float) -> DataFrame:
    """(signal_id, n, p array) updates of (signal_id, n, obs): state decays by 1 - 1 / (rate tau) per tick and adds observations.

    State is the last tick and one number per symbol, so it is bounded by the number of keys. Ticks at or before the last one seen
    are late and dropped.
    """
    decay = 1 - 1 / (rate * tau)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, *sums = state.get if state.exists else (-1, *([0.0] * states))
        rows = pd.concat(list(batches)).sort_values("n")
        for n, obs in zip(rows["n"].tolist(), rows["obs"].tolist(), strict=True):
            if n <= last:
                continue
            sums = [v * decay ** (n - last if last >= 0 else 0) for v in sums]
            if obs > 0:
                sums[obs - 1] += 1
            last = n
        state.update((last, *sums))
        total = sum(v + 0.1 for v in sums)
        yield pd.DataFrame({"signal_id": [key[0]], "n": [last], "p": [[(v + 0.1) / total for v in sums]]})

    kept = "last long, " + ", ".join(f"s{i} double" for i in range(states))
    return observations.groupBy("signal_id").applyInPandasWithState(update, "signal_id string, n long, p array<double>", kept, "update", GroupStateTimeout.NoTimeout)
