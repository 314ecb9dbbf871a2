"""Operators on long signals (signal_id, n, x): maps that need the whole signal's extremes, events, peaks, smoothing.

A signal is a partition of its key, so many signals run in parallel; the samples of one are a window's partition.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Callable
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = "signal_id"


def gather(signals: DataFrame, *keys: str, order: str = "n") -> DataFrame:
    """(keys, x): every signal as one array, in the order of its samples."""
    keys = keys or (KEY,)
    return signals.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "x"))), lambda s: s["x"]).alias("x"))


def rows_of(arrays: DataFrame, kernel: Callable[[np.ndarray], dict[str, np.ndarray]], schema: str, column: str = "x", key: str = KEY) -> DataFrame:
    """(key, schema's columns): every signal's rows by a kernel that returns columns of equal length."""

    def run(batches):
        for rows in batches:
            for name, x in zip(rows[key], rows[column], strict=True):
                out = kernel(np.asarray(x, float))
                yield pd.DataFrame({key: [name] * len(next(iter(out.values()))), **out})

    return arrays.select(key, column).mapInPandas(run, f"{key} string, {schema}")


def _whole():
    return Window.partitionBy(KEY)


def _order():
    return Window.partitionBy(KEY).orderBy("n")


def log_transform(signals: DataFrame, db_noise: float = 100, normalize: bool = False) -> DataFrame:
    """x / max in decibels (20 log10) above -db_noise, never under 0; ``normalize`` divides by the largest."""
    top = F.max("x").over(_whole())
    db = F.when(F.col("x") / top > 0, F.greatest(20 * F.log10(F.col("x") / top) + db_noise, F.lit(0.0))).otherwise(0.0)
    out = signals.select(KEY, "n", db.alias("x"))
    return out.select(KEY, "n", (F.col("x") / F.max("x").over(_whole())).alias("x")) if normalize else out


def power_amplifier(signals: DataFrame, thresh: float, power: float = 2) -> DataFrame:
    """((x / max + 1 - thresh)^power - (1 - thresh)^power), divided by its largest value."""
    raised = F.pow(F.col("x") / F.max("x").over(_whole()) + (1 - thresh), F.lit(float(power))) - (1 - thresh) ** power
    out = signals.select(KEY, "n", raised.alias("x"))
    return out.select(KEY, "n", (F.col("x") / F.max("x").over(_whole())).alias("x"))


def roll_and_subtract(signals: DataFrame, amount: int = 1, rectify: bool = False) -> DataFrame:
    """x[n] - x[n + amount], with 0 past the end; ``rectify`` keeps what is above 0."""
    value = F.col("x") - F.coalesce(F.lead("x", amount).over(_order()), F.lit(0.0))
    return signals.select(KEY, "n", (F.greatest(value, F.lit(0.0)) if rectify else value).alias("x"))


def discretize(signals: DataFrame, levels: int = 3) -> DataFrame:
    """Level 1..levels of every sample by its signal's quantiles at int(100 (k + 1) / levels) percent, strictly above."""
    shares = [int((k + 1) * 100 / levels) / 100 for k in range(levels - 1)]
    cuts = signals.groupBy(KEY).agg(F.percentile("x", F.array(*map(F.lit, shares))).alias("cuts"))
    level = sum((F.when(F.col("x") > F.col("cuts")[i], 1).otherwise(0) for i in range(levels - 1)), F.lit(1))
    return signals.join(cuts, KEY).select(KEY, "n", "x", level.cast("int").alias("level"))


# --- events and peaks -----------------------------------------------------------------------------------------------


def extrema(signals: DataFrame) -> DataFrame:
    """(signal_id, n, x, kind): strict local minima and maxima; ends and plateaus are neither."""
    before, after = F.lag("x").over(_order()), F.lead("x").over(_order())
    kind = F.when((F.col("x") < before) & (F.col("x") < after), "min").when((F.col("x") > before) & (F.col("x") > after), "max")
    return signals.select(KEY, "n", "x", kind.alias("kind")).filter("kind is not null")


def detect_peaks(signals: DataFrame, least: float | None = None, distance: int = 1, threshold: float = 0, edge: str | None = "rising", keep_same: bool = False, valley: bool = False) -> DataFrame:
    """(signal_id, n, x) of local peaks.

    ``least``: height at least; ``threshold``: height above both neighbours at least; ``edge``: which edge of a flat peak
    counts (rising, falling, both, None for strict peaks only); ``valley``: minima instead. ``distance`` > 1 keeps peaks by
    falling height and drops others within the distance (ties to the later sample, ``keep_same`` keeps equal heights).
    """
    value = -F.col("x") if valley else F.col("x")
    base = signals.select(KEY, "n", "x", value.alias("v"))
    base = base.select("*", F.lag("v").over(_order()).alias("b"), F.lead("v").over(_order()).alias("a"))
    up, down = F.col("v") - F.col("b"), F.col("a") - F.col("v")
    strict = (up > 0) & (down < 0)
    rules = {None: strict, "rising": (up > 0) & (down <= 0), "falling": (up >= 0) & (down < 0)}
    rules["both"] = rules["rising"] | rules["falling"]
    clear = ~(F.isnan("v") | F.isnan("b") | F.isnan("a"))
    found = base.filter(F.col("b").isNotNull() & F.col("a").isNotNull() & clear & rules[edge])
    if least is not None:
        found = found.filter(F.col("v") >= (-least if valley else least))
    if threshold > 0:
        found = found.filter(F.least(F.col("v") - F.col("b"), F.col("v") - F.col("a")) >= threshold)
    if distance <= 1:
        return found.select(KEY, "n", "x")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        own = dict(zip(rows["n"].tolist(), rows["v"].tolist(), strict=True))
        return rows[rows["n"].isin(thin_peaks(own, distance, keep_same))][[KEY, "n", "x"]]

    return found.select(KEY, "n", "x", "v").groupBy(KEY).applyInPandas(run, signals.select(KEY, "n", "x").schema)


def thin_peaks(heights: dict[int, float], distance: int, keep_same: bool = False) -> list[int]:
    """Places kept, rising: a place stays if no kept place within the distance is higher, or as high and later.

    Places come by falling height, and the kept ones stay sorted, so each place looks at its two neighbours among them.
    With ``keep_same`` equal heights don't see each other: they join the kept places together.
    """
    kept: list[int] = []

    def free(place: int) -> bool:
        at = bisect_left(kept, place)
        return not ((at < len(kept) and kept[at] - place <= distance) or (at and place - kept[at - 1] <= distance))

    ranked = sorted(heights.items(), key=lambda item: (-item[1], -item[0]))
    for _, level in groupby(ranked, key=lambda item: item[1] if keep_same else item):
        for place in [p for p, _ in level if free(p)]:
            insort(kept, place)
    return kept


def break_into_events(signals: DataFrame, threshold: float = 0, merge: float | None = None, least_peak: float | None = None) -> DataFrame:
    """(signal_id, start, end, max_amp) of runs above the threshold.

    end is the first sample at or below it, or the last sample of the signal for a run that never ends. The onset sample's
    height doesn't count for max_amp, so a run of one sample reports the threshold. Runs whose peak is under ``least_peak`` go,
    then runs closer than ``merge`` become one.
    """
    last = F.max("n").over(_whole())
    above = signals.select(KEY, "n", "x", last.alias("last")).filter(F.col("x") > threshold)
    runs = above.select("*", (F.col("n") - F.row_number().over(_order())).alias("island"))
    onset = F.min("n").over(Window.partitionBy(KEY, "island"))
    inner = F.when(F.col("n") > onset, F.col("x")).otherwise(F.lit(float(threshold)))
    events = runs.select(KEY, "n", "last", "island", inner.alias("inner")).groupBy(KEY, "island", "last").agg(F.min("n").alias("start"), F.max("n").alias("stop"), F.max("inner").alias("max_amp"))
    events = events.select(KEY, "start", F.least(F.col("stop") + 1, F.col("last")).alias("end"), "max_amp")
    if least_peak is not None:
        events = events.filter(F.col("max_amp") >= least_peak)
    if merge is None:
        return events
    by_start = Window.partitionBy(KEY).orderBy("start")
    gap = F.when(F.col("start") - F.lag("end").over(by_start) < merge, 0).otherwise(1)
    grouped = events.select("*", gap.alias("gap")).select("*", F.sum("gap").over(by_start).alias("group"))
    return grouped.groupBy(KEY, "group").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("max_amp").alias("max_amp")).drop("group")


def envelope_end(signals: DataFrame) -> DataFrame:
    """(signal_id, end): one past the last sample that differs from the next."""
    steps = signals.select(KEY, "n", (F.lead("x").over(_order()) - F.col("x")).alias("step"))
    return steps.groupBy(KEY).agg(F.coalesce(F.max(F.when(F.abs("step") > 0, F.col("n"))) + 1, F.lit(0)).cast("int").alias("end"))


# --- kernels --------------------------------------------------------------------------------------------------------


def convolve_reflect(signals: DataFrame, weights: list[float]) -> DataFrame:
    """Centred convolution with ``weights`` (odd length); the signal is mirrored at its ends, edge sample included.

    Every sample goes to the places it reaches (a map, no join), and places are summed with map-side combine.
    """
    half = len(weights) // 2
    size = F.count("*").over(_whole())
    offsets = F.explode(F.array(*[F.struct(F.lit(i - half).alias("o"), F.lit(float(w)).alias("w")) for i, w in enumerate(weights)]))
    spread = signals.select(KEY, "n", "x", size.alias("size"))
    # output m reads reflected index m - o; each sample n is read from at most three places for each offset
    mirrored = spread.select(KEY, "size", "x", F.explode(F.array(F.col("n"), -1 - F.col("n"), 2 * F.col("size") - 1 - F.col("n"))).alias("at"))
    near = mirrored.filter((F.col("at") >= -half) & (F.col("at") < F.col("size") + half)).select(KEY, "size", "x", "at", offsets.alias("k"))
    out = near.select(KEY, "size", (F.col("at") + F.col("k.o")).alias("n"), (F.col("x") * F.col("k.w")).alias("v"))
    inside = out.filter((F.col("n") >= 0) & (F.col("n") < F.col("size")))
    return inside.groupBy(KEY, F.col("n").cast("int").alias("n")).agg(F.sum("v").alias("x"))


def simple_smooth(signals: DataFrame, window: int) -> DataFrame:
    """Smoothing by a Hann window (zeros at its ends) of area 1."""
    raw = [0.5 - 0.5 * math.cos(2 * math.pi * i / (window - 1)) if window > 1 else 1.0 for i in range(window)]
    return convolve_reflect(signals, [w / sum(raw) for w in raw])


def temporal_smooth(signals: DataFrame, rate: float, tau: float, half: int = 20) -> DataFrame:
    """Smoothing by exp(-t^2 / tau) of area 1."""
    raw = [math.exp(-((i / rate) ** 2) / tau) for i in range(-half, half + 1)]
    return convolve_reflect(signals, [w / sum(raw) for w in raw])


def instantaneous_frequency(analytic: DataFrame, rate: float) -> DataFrame:
    """(signal_id, n, freq) of (signal_id, n, re, im) by first differences; 0 at the first sample."""
    re, im = F.col("re"), F.col("im")
    d_re, d_im = re - F.lag("re").over(_order()), im - F.lag("im").over(_order())
    freq = (re * d_im - im * d_re) / (2 * math.pi * (re * re + im * im)) * rate
    return analytic.select(KEY, "n", F.coalesce(freq, F.lit(0.0)).alias("freq"))


def chunk(signals: DataFrame, size: int = 1024, overlap: float = 0.5, group: list[str] | None = None) -> DataFrame:
    """(group, signal_id, frame, m, x): frames of ``size`` samples, the last zero-padded; samples map to their frames without a join."""
    keys, hop = [*(group or []), KEY], size - int(size * overlap)
    length = F.max("n").over(Window.partitionBy(*keys)) + 1
    frames = F.greatest(F.floor((F.col("len") - hop) / hop) + F.when(F.col("len") % hop != 0, 1).otherwise(0), F.lit(1))
    sized = signals.select(*keys, "n", "x", length.alias("len")).select("*", frames.cast("int").alias("frames"))
    first = F.greatest(F.ceil((F.col("n") - size + 1) / hop), F.lit(0)).cast("int")
    last = F.least(F.floor(F.col("n") / hop), F.col("frames") - 1).cast("int")
    held = sized.filter(first <= last).select(*keys, F.explode(F.sequence(first, last)).alias("frame"), "n", "x")
    held = held.select(*keys, "frame", (F.col("n") - F.col("frame") * hop).cast("int").alias("m"), "x")
    grid = sized.select(*keys, "frames").distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.col("frames") - 1)).alias("frame"))
    grid = grid.select(*keys, "frame", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("m"))
    return grid.join(held, [*keys, "frame", "m"], "left").select(*keys, "frame", "m", F.coalesce("x", F.lit(0.0)).alias("x"))


def sliding_windows(n: Column, rate: float, increment: float, window: float) -> Column:
    """Array of (center, start, end) sample indices: one per hop, odd length; starts may be negative, ends past n."""
    hop, size = int(increment * rate), int(window * rate)
    size += 1 - size % 2
    half = (size - 1) // 2
    steps = F.sequence(F.lit(0).cast("long"), F.floor(n / hop) - 1)
    return F.transform(steps, lambda k: F.struct((k * hop).alias("center"), (k * hop - half).alias("start"), (k * hop + half + 1).alias("end")))


def forgetting(observations: DataFrame, states: int, rate: float, tau: float) -> DataFrame:
    """(signal_id, state, p) after the last of (signal_id, n, obs): decay 1 - 1 / (rate tau) per tick, 0 observes nothing.

    The closed form of the running update: a state is the sum of the decays of its observations.
    """
    decay = 1 - 1 / (rate * tau)
    last = F.max("n").over(_whole())
    weights = observations.select(KEY, "obs", F.pow(F.lit(decay), last - F.col("n")).alias("w"))
    sums = weights.groupBy(KEY).agg(*[F.sum(F.when(F.col("obs") == s, F.col("w")).otherwise(0.0)).alias(f"s{s}") for s in range(1, states + 1)])
    total = sum((F.col(f"s{s}") + 0.1 for s in range(1, states + 1)), F.lit(0.0))
    out = F.array(*[F.struct(F.lit(s).alias("state"), ((F.col(f"s{s}") + 0.1) / total).alias("p")) for s in range(1, states + 1)])
    return sums.select(KEY, F.explode(out).alias("o")).select(KEY, "o.state", "o.p")


# --- convolution with filters ---------------------------------------------------------------------------------------


def fast_conv(samples: DataFrame, weights: list[tuple[str, int, float]], bias: float = 0.0, group: str | None = None) -> DataFrame:
    """(n, y): y[n] = sum of x[n - lag, channel] * w over (channel, lag, w), plus bias; zero edges, any lags.

    ``samples``: (signal_id as channel, n, x), and a group column if given: then groups don't bleed and n restarts in each.
    """
    keys = [group] if group else []
    place = F.row_number().over(Window.partitionBy(*keys, KEY).orderBy("n")) - 1 if group else F.col("n")
    own = samples.select(*keys, KEY, "n", place.alias("i"), "x")
    size = F.max("i").over(Window.partitionBy(*keys)) if group else F.max("i").over(Window.partitionBy(KEY))
    lags: dict[str, list[tuple[int, float]]] = {}
    for channel, lag, w in weights:
        lags.setdefault(channel, []).append((lag, w))
    taps = F.lit(None)
    for channel, pairs in lags.items():
        taps = F.when(F.col(KEY) == channel, F.array(*[F.struct(F.lit(lag).alias("lag"), F.lit(float(w)).alias("w")) for lag, w in pairs])).otherwise(taps)
    own = own.select("*", size.alias("size"), taps.alias("taps"))
    reach = own.select(*keys, "size", "i", "x", F.explode("taps").alias("t")).select(*keys, "size", (F.col("i") + F.col("t.lag")).alias("i"), (F.col("x") * F.col("t.w")).alias("v"))
    sums = reach.filter((F.col("i") >= 0) & (F.col("i") <= F.col("size"))).groupBy(*keys, "i").agg(F.sum("v").alias("v"))
    grid = own.select(*keys, "i", "n").distinct() if group else own.select("i", F.col("i").alias("n")).distinct()
    return grid.join(sums, [*keys, "i"], "left").select(*keys, F.col("n").cast("int").alias("n"), (F.coalesce("v", F.lit(0.0)) + bias).alias("y"))


def toeplitz(samples: DataFrame, lags: list[int], bias: bool = True, group: str | None = None) -> DataFrame:
    """(n, column, value): design matrix in long form, column = channel rank * lags + place of the lag; lag > 0 is the past.

    With a ``group`` column lags stay inside a group's own samples, in the order of n, which numbers rows over all groups.
    """
    keys = [group] if group else []
    rank = F.dense_rank().over(Window.orderBy(KEY)) - 1  # one row a channel
    channels = samples.select(KEY).distinct().select(KEY, rank.alias("channel"))
    shift = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(lag).alias("lag")) for i, lag in enumerate(lags)])
    own = Window.partitionBy(*keys, KEY)
    place = F.row_number().over(own.orderBy("n")) - 1 if group else F.col("n")
    placed = samples.select(*keys, KEY, "n", place.alias("i"), "x")
    moved = placed.select(*keys, KEY, "n", "i", "x", F.max("i").over(own).alias("size"), F.explode(shift).alias("s"))
    grid = moved.select(*keys, KEY, "n", "i", F.col("s.at").alias("at"))
    values = moved.select(*keys, KEY, (F.col("i") + F.col("s.lag")).alias("i"), F.col("s.at").alias("at"), "x", "size").filter((F.col("i") >= 0) & (F.col("i") <= F.col("size"))).drop("size")
    full = grid.join(values, [*keys, KEY, "i", "at"], "left").join(channels, KEY)
    out = full.select("n", (F.col("channel") * len(lags) + F.col("at")).cast("int").alias("column"), F.coalesce("x", F.lit(0.0)).alias("value"))
    if not bias:
        return out
    ones = samples.select("n").distinct().crossJoin(F.broadcast(channels.agg((F.count("*") * len(lags)).cast("int").alias("column"))))
    return out.unionByName(ones.select("n", "column", F.lit(1.0).alias("value")))
