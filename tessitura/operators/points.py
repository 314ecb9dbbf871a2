"""Point processes: (train_id, t) event times; histograms, coincidences, range joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_pairs(left: DataFrame, right: DataFrame, reach: float) -> DataFrame:
    """(t1, t2) with |t1 - t2| <= reach, as an equi-join on time buckets of that width.

    The left side asks its own bucket and both neighbours, so every pair meets once and no bucket holds more than its times.
    """
    bucket = F.floor(F.col("t") / reach)
    a = left.select(F.col("t").alias("t1"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"))
    b = right.select(F.col("t").alias("t2"), bucket.alias("bucket"))
    return a.join(b, "bucket").filter(F.abs(F.col("t1") - F.col("t2")) <= reach).select("t1", "t2")


def joint_isi(first: DataFrame, second: DataFrame, window: float = 0.5, bin_size: float = 0.001) -> DataFrame:
    """(bin, edge, count): histogram of t1 - t2 within half a window; edges are the bins' left ends."""
    half = int(window / 2 / bin_size)
    pairs = range_pairs(first, second, window / 2)
    counts = pairs.groupBy((F.rint((F.col("t1") - F.col("t2")) / bin_size) + half).cast("int").alias("bin")).agg(F.count("*").alias("count"))
    grid = first.sparkSession.range(2 * half + 1).select(F.col("id").cast("int").alias("bin"))
    return grid.join(counts, "bin", "left").select("bin", ((F.col("bin") - half - 0.5) * bin_size).alias("edge"), F.coalesce("count", F.lit(0)).alias("count"))


def _near_counts(spikes: DataFrame, reach: float, rate: float, bins: int) -> DataFrame:
    """(bin, c): events within ``reach`` of bin / rate; an event explodes into the bins it is near."""
    first = F.greatest(F.ceil((F.col("t") - reach) * rate), F.lit(0)).cast("int")
    last = F.least(F.floor((F.col("t") + reach) * rate), F.lit(bins - 1)).cast("int")
    near = spikes.filter(first <= last).select(F.explode(F.sequence(first, last)).alias("bin"))
    return near.groupBy("bin").agg(F.count("*").alias("c"))


def xcorr_hist(first: DataFrame, second: DataFrame, duration: float, window: float = 0.001, rate: float = 1000.0, normalize: bool = True) -> DataFrame:
    """(bin, t, value): product of both trains' counts within half a window of each bin, over window * bins."""
    bins = int(duration * rate)
    a = _near_counts(first, window / 2, rate, bins).withColumnRenamed("c", "a")
    b = _near_counts(second, window / 2, rate, bins).withColumnRenamed("c", "b")
    grid = first.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    scale = window * bins if normalize else 1.0
    return grid.join(a, "bin", "left").join(b, "bin", "left").select("bin", (F.col("bin") / rate).alias("t"), (F.coalesce("a", F.lit(0)) * F.coalesce("b", F.lit(0)) / scale).alias("value"))


def psth(trials: DataFrame, n_trials: int | None, duration: float, bin_size: float = 0.001, offset: float = 0.0) -> DataFrame:
    """(bin, edge, rate): events per bin in kHz and per trial (trials without events count); offset <= t <= duration.

    Without ``n_trials`` the trials are those with an event or a row of null time.
    There are ceil(duration / bin_size) bins from the offset on, so an offset leaves the last ones empty.
    """
    bins = math.ceil(duration / bin_size - 1e-9)
    place = F.floor((F.col("t") - offset) / bin_size).cast("int")
    kept = trials.filter((F.col("t") >= offset) & (F.col("t") <= duration)).select(place.alias("bin")).filter(F.col("bin") < bins)
    counts = kept.groupBy("bin").agg(F.count("*").alias("c"))
    grid = trials.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    full = grid.join(counts, "bin", "left")
    if n_trials is None:  # one row, joined instead of collected
        full = full.crossJoin(F.broadcast(trials.agg(F.count_distinct("train_id").alias("trials"))))
    return full.select("bin", (offset + F.col("bin") * bin_size).alias("edge"), (F.coalesce("c", F.lit(0)) / (bin_size * 1000) / (F.lit(n_trials) if n_trials is not None else F.col("trials"))).alias("rate"))


def spike_matrix(trains: DataFrame, bin_size: float, start: float, duration: float) -> DataFrame:
    """(train_id, bin, count) over start <= t < start + duration; only bins with events."""
    bins = int(round(duration / bin_size))
    kept = trains.filter((F.col("t") >= start) & (F.col("t") < start + duration))
    place = F.least(F.floor((F.col("t") - start) / bin_size), F.lit(bins - 1)).cast("int")
    return kept.groupBy("train_id", place.alias("bin")).agg(F.count("*").alias("count"))


def spike_envelope(trains: DataFrame, start: float, duration: float, bin_size: float = 0.001, count_all: bool = False, smooth: bool = False, win_size: float = 3.0, thresh_percentile: float | None = None) -> DataFrame:
    """(bin, env): number of trains with an event in the bin, over its largest; ``count_all`` counts events instead.

    ``smooth`` convolves with 30 taps exp(-u^2 / win_size^2), u from -50 to 50, mirrored at the ends; what is then under the
    ``thresh_percentile`` of all bins becomes 0.
    """
    bins = int(duration / bin_size + 1e-9)
    place = F.least(F.floor((F.col("t") - start) / bin_size), F.lit(bins - 1)).cast("int")
    kept = trains.filter((F.col("t") >= start) & (F.col("t") <= start + duration)).select("train_id", place.alias("bin"))
    per = kept.groupBy("bin").agg((F.count("*") if count_all else F.count_distinct("train_id")).cast("double").alias("c"))
    if smooth:
        taps = [(o, math.exp(-(((o + 15) * 100 / 29 - 50) ** 2) / win_size**2)) for o in range(-15, 15)]
        at = F.explode(F.array(F.col("bin"), -1 - F.col("bin"), F.lit(2 * bins - 1) - F.col("bin"))).alias("at")
        reach = F.explode(F.array(*[F.struct(F.lit(o).alias("o"), F.lit(w).alias("w")) for o, w in taps])).alias("k")
        spread = per.select("c", at).select("c", "at", reach).select((F.col("at") + F.col("k.o")).alias("bin"), (F.col("c") * F.col("k.w")).alias("c"))
        per = spread.filter((F.col("bin") >= 0) & (F.col("bin") < bins)).groupBy("bin").agg(F.sum("c").alias("c"))
    grid = trains.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    full = grid.join(per, "bin", "left").select("bin", F.coalesce("c", F.lit(0.0)).alias("c"))
    facts = full.agg(F.max("c").alias("top"), *([F.percentile("c", F.lit(thresh_percentile / 100)).alias("cut")] if thresh_percentile is not None else []))
    joined = full.crossJoin(F.broadcast(facts))
    value = F.col("c") / F.col("top")
    return joined.select("bin", (F.when(F.col("c") < F.col("cut"), 0.0).otherwise(value) if thresh_percentile is not None else value).alias("env"))


def _occupied(spikes: DataFrame, duration: float, bin_size: float) -> Column:
    return F.least(F.greatest(F.floor(F.col("t") / bin_size), F.lit(0)), F.lit(int(duration / bin_size) - 1)).cast("int")


def synchrony(trains: DataFrame, first: str, second: str, duration: float, bin_size: float = 0.1) -> DataFrame:
    """Shared occupied bins over the geometric mean of both trains' occupied bins."""
    per = trains.filter(F.col("train_id").isin(first, second)).groupBy(_occupied(trains, duration, bin_size).alias("bin")).agg(
        F.max((F.col("train_id") == first).cast("int")).alias("a"), F.max((F.col("train_id") == second).cast("int")).alias("b")
    )
    return per.agg((F.sum(F.col("a") * F.col("b")) / F.sqrt(F.sum("a").cast("double") * F.sum("b"))).alias("synchrony"))


def _binary(trains: DataFrame, duration: float, bin_size: float) -> DataFrame:
    return trains.select("train_id", _occupied(trains, duration, bin_size).alias("bin")).distinct()


def _spread(trains: DataFrame, duration: float, bin_size: float, taps: list[tuple[int, float]], mirror: bool) -> DataFrame:
    bins = int(duration / bin_size)
    at = F.array(F.col("bin"), -1 - F.col("bin"), F.lit(2 * bins - 1) - F.col("bin")) if mirror else F.array("bin")
    reach = F.explode(F.array(*[F.struct(F.lit(o).alias("o"), F.lit(float(w)).alias("w")) for o, w in taps]))
    hits = _binary(trains, duration, bin_size).select("train_id", F.explode(at).alias("at")).select("train_id", "at", reach.alias("k"))
    sums = hits.select("train_id", (F.col("at") + F.col("k.o")).alias("bin"), F.col("k.w").alias("w")).filter((F.col("bin") >= 0) & (F.col("bin") < bins))
    sums = sums.groupBy("train_id", F.col("bin").cast("int").alias("bin")).agg(F.sum("w").alias("v"))
    grid = trains.select("train_id").distinct().select("train_id", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(sums, ["train_id", "bin"], "left").select("train_id", "bin", F.coalesce("v", F.lit(0.0)).alias("value"))


def causal_smooth(trains: DataFrame, duration: float, bin_size: float = 0.001, tau: float = 0.001, length: float = 0.005, points: int = 11) -> DataFrame:
    """Occupied bins smoothed by a one-sided exponential on ``points`` taps (area 1), mirrored ends."""
    half = points // 2
    raw = [(i - half, math.exp(-((i - half) * length / half) / tau) if i >= half else 0.0) for i in range(points)]
    total = sum(w for _, w in raw)
    return _spread(trains, duration, bin_size, [(o, w / total) for o, w in raw if w], True)


def exp_conv(trains: DataFrame, duration: float, tau: float, bin_size: float, causal: bool = True) -> DataFrame:
    """Occupied bins convolved with exp(-|t| / tau), one- or two-sided, over 2 tau (whole bins of it) on a side.

    Events at t <= 0 or t >= duration don't count; the window must be shorter than the series.
    """
    reach = 2 * int(tau / bin_size)
    if 2 * reach + 1 >= int(duration / bin_size):
        raise ValueError("the series is too short for this time constant")
    taps = [(o, math.exp(-abs(o) * bin_size / tau)) for o in range(0 if causal else -reach, reach + 1)]
    return _spread(trains.filter((F.col("t") > 0) & (F.col("t") < duration)), duration, bin_size, taps, False)
