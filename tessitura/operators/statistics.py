"""Aggregations: correlation, phase locking, histograms, moments, entropies."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessitura.functions.columns import EULER_GAMMA
from tessitura.operators.samples import KEY


def r_squared(df: DataFrame, x: str, y: str) -> DataFrame:
    """Squared Pearson correlation."""
    return df.agg(F.pow(F.corr(x, y), F.lit(2.0)).alias("r2"))


def sample_std(signals: DataFrame) -> DataFrame:
    """Standard deviation over n - 1, per signal."""
    return signals.groupBy(KEY).agg(F.stddev_samp("x").alias("std"))


def correlation_function(signals: DataFrame, first: str, second: str, lags: list[int], subtract_mean: bool = True, normalize: bool = True) -> DataFrame:
    """(lag, cf): sum of s1[t] s2[t + lag] over N - |lag|, after subtracting means, over the product of sample deviations.

    Lags become keys of an equi-join on the shifted sample index, so a lag is a row and the sum is combined map-side.
    """
    stats = signals.filter(F.col(KEY).isin(first, second)).groupBy(KEY).agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.count("*").alias("size"))
    centered = signals.join(F.broadcast(stats), KEY)
    value = (F.col("x") - F.col("mean")) if subtract_mean else F.col("x")
    a = centered.filter(F.col(KEY) == first).select("n", value.alias("a"), F.col("std").alias("std_a"), "size", F.explode(F.array(*map(F.lit, lags))).alias("lag"))
    b = centered.filter(F.col(KEY) == second).select(F.col("n").alias("m"), value.alias("b"), F.col("std").alias("std_b"))
    pairs = a.join(b, a["n"] + a["lag"] == b["m"])
    scale = F.first("std_a") * F.first("std_b") if normalize else F.lit(1.0)
    return pairs.groupBy("lag").agg((F.sum(F.col("a") * F.col("b")) / (F.first("size") - F.abs(F.first("lag"))) / scale).alias("cf"))


def quantify_correlogram(cf: DataFrame) -> DataFrame:
    """Twelve figures of a correlogram (lag, cf): peak size and its delay, area under the size, mean, deviation and skew
    of the lag, anisotropy (right less left area over the area off 0), mean lag and signed area of each half, value at 0.

    Lags are weighed by |cf|; areas are times the largest step between lags. The lags of one correlogram are few, so
    their order is found in one task.
    """
    stepped = cf.select("lag", "cf", F.abs("cf").alias("w"), (F.col("lag") - F.lag("lag").over(Window.orderBy("lag"))).alias("step"))
    total = stepped.agg(
        F.sum("w").alias("total"), F.sum(F.col("w") * F.col("lag")).alias("first"), F.max("w").alias("top"), F.max_by("lag", F.struct("w", -F.col("lag"))).alias("delay"), F.max("step").alias("dt")
    )
    m = stepped.crossJoin(F.broadcast(total)).withColumn("mean", F.col("first") / F.col("total"))
    off, p = F.col("lag") - F.col("mean"), F.col("w") / F.col("total")
    side = {"left": F.col("lag") < 0, "right": F.col("lag") > 0}
    area = {k: F.sum(F.when(v, F.col("w")).otherwise(0.0)) for k, v in side.items()}
    centre = {k: F.sum(F.when(v, F.col("w") * F.col("lag"))) / F.nullif(area[k], F.lit(0.0)) for k, v in side.items()}
    signed = {k: F.sum(F.when(v, F.col("cf")).otherwise(0.0)) * F.first("dt") for k, v in side.items()}
    sd = F.sqrt(F.sum(p * off * off))
    return m.agg(
        F.first("top").alias("peak"),
        F.first("delay").alias("delay"),
        (F.first("total") * F.first("dt")).alias("width"),
        F.first("mean").alias("mean_lag"),
        sd.alias("std_lag"),
        (F.sum(p * off * off * off) / F.pow(sd, F.lit(3.0))).alias("skew_lag"),
        ((area["right"] - area["left"]) / F.nullif(area["right"] + area["left"], F.lit(0.0))).alias("anisotropy"),
        centre["left"].alias("left_lag"),
        centre["right"].alias("right_lag"),
        signed["left"].alias("left_sum"),
        signed["right"].alias("right_sum"),
        F.max(F.when(F.col("lag") == 0, F.col("cf"))).alias("cc0"),
    )


def phase_locking(pairs: DataFrame, first: str, second: str) -> DataFrame:
    """|mean of exp(i (second - first))| of two phase columns."""
    d = F.col(second) - F.col(first)
    return pairs.agg(F.hypot(F.avg(F.cos(d)), F.avg(F.sin(d))).alias("plv"))


def frequencies(df: DataFrame, *symbols: str) -> DataFrame:
    """Relative frequency of every distinct symbol."""
    counts = df.groupBy(*symbols).agg(F.count("*").alias("count"))
    total = F.broadcast(counts.agg(F.sum("count").alias("_total")))
    return counts.crossJoin(total).select(*symbols, (F.col("count") / F.col("_total")).alias("p"))


def entropy(df: DataFrame, *symbols: str, base: float = 2) -> DataFrame:
    """Shannon entropy of the joint distribution of the symbol columns."""
    counts = df.groupBy(*symbols).agg(F.count("*").alias("c"))
    total = counts.agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log("c")).alias("s"))
    return total.select(((F.log("n") - F.col("s") / F.col("n")) / math.log(base)).alias("entropy"))


def _grouped_entropies(df: DataFrame, sets: list[list[str]], base: float) -> DataFrame:
    """One row of entropies h0, h1, ... of several column sets, from one pass with grouping sets."""
    names = sorted({c for s in sets for c in s})
    spec = [[F.col(c) for c in s] for s in sets]
    grouped = df.groupingSets(spec, *[F.col(c) for c in names]).agg(F.count("*").alias("c"), F.grouping_id().alias("g"))
    masks = [sum(1 << (len(names) - 1 - i) for i, c in enumerate(names) if c not in s) for s in sets]
    sums = grouped.groupBy("g").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log("c")).alias("s"))
    h = (F.log("n") - F.col("s") / F.col("n")) / math.log(base)
    return sums.agg(*[F.max(F.when(F.col("g") == m, h)).alias(f"h{i}") for i, m in enumerate(masks)])


def mutual_information(df: DataFrame, x: str, y: str, base: float = 2) -> DataFrame:
    """H(X) + H(Y) - H(X, Y) of two discrete columns."""
    return _grouped_entropies(df, [[x], [y], [x, y]], base).select((F.col("h0") + F.col("h1") - F.col("h2")).alias("mi"))


def conditional_mutual_information(df: DataFrame, x: str, y: str, z: str, base: float = 2) -> DataFrame:
    """H(Y, Z) + H(X, Z) - H(X, Y, Z) - H(Z)."""
    h = _grouped_entropies(df, [[y, z], [x, z], [x, y, z], [z]], base)
    return h.select((F.col("h0") + F.col("h1") - F.col("h2") - F.col("h3")).alias("cmi"))


#: Ranges that a pass of exact_percentiles counts in each interval that it cuts.
CUT_RANGES = 4096


def exact_percentiles(df: DataFrame, x: str, shares: list[float]) -> list[float]:
    """The interpolated percentiles of a column, as ``F.percentile`` has them; none if it has no value.

    ``F.percentile`` holds every distinct value in one task. Here a pass counts the rows of even ranges of the values, with each one's
    least and largest; the ranges that hold a rank in question are cut in the next pass, until they hold one value. A task sees
    ``CUT_RANGES`` rows at most for each interval and input split, the driver as many for each interval, two a share at most.
    """
    values = df.select(F.col(x).cast("double").alias("v")).filter("v is not null")
    v, top = F.col("v"), F.lit(math.inf)
    finite = (v > -top) & (v < top)
    facts = values.agg(F.count("*").alias("n"), F.count_if(v == -top).alias("below"), F.count_if(finite).alias("inside"), F.count_if(v == top).alias("above"), F.min(F.when(finite, v)).alias("lo"), F.max(F.when(finite, v)).alias("hi")).first()
    if not facts["n"]:
        return []
    places = [(facts["n"] - 1) * s for s in shares]
    ranks = sorted({f(p) for p in places for f in (math.floor, math.ceil)})
    # intervals as (rank of the first row, rows, least, largest value)
    whole = facts["below"], facts["inside"], facts["lo"], facts["hi"]
    spans = [(0, facts["below"], -math.inf, -math.inf), whole, (whole[0] + whole[1], facts["above"], math.inf, math.inf), (whole[0] + whole[1] + facts["above"], facts["n"], math.nan, math.nan)]
    found: dict[int, float] = {}
    while True:
        cut = []
        for first, size, lo, hi in spans:
            own = [k for k in ranks if first <= k < first + size and k not in found]
            if own and lo < hi:
                cut.append((first, lo, hi))
            else:
                found.update(dict.fromkeys(own, lo))
        if not cut:
            break
        place = F.lit(None).cast("long")
        for i, (_, lo, hi) in enumerate(cut):
            width = max(hi / CUT_RANGES - lo / CUT_RANGES, 5e-324)
            own = F.floor(F.least((v - lo) / F.lit(width), F.lit(CUT_RANGES - 1.0))) + i * CUT_RANGES
            place = F.when((v >= lo) & (v <= hi), own).otherwise(place)
        rows = values.select(place.alias("at"), "v").filter("at is not null").groupBy("at").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        spans, first, last = [], 0, -1
        for r in sorted(rows):
            first, last = cut[r["at"] // CUT_RANGES][0] if r["at"] // CUT_RANGES != last else first, r["at"] // CUT_RANGES
            spans.append((first, r["n"], r["lo"], r["hi"]))
            first += r["n"]
    out = []
    for p in places:
        lower, higher = math.floor(p), math.ceil(p)
        a, b = found[lower], found[higher]
        out.append(a if a == b or lower == higher else (higher - p) * a + (p - lower) * b)
    return out


def binned_mean(df: DataFrame, x: str, y: str, bins: int = 20, by_quantile: bool = False) -> DataFrame:
    """(bin, center, mean, se, count) of y over bins of x, half-open, so the largest x is left out.

    Bins are of equal width, or with ``by_quantile`` end at the percentiles int(100 k / (bins + 1)), k = 1 to bins - 1, of x (of
    equal width all the same if these aren't distinct).
    """
    shares = [int(k * 100 / (bins + 1)) / 100 for k in range(1, bins)]
    facts = [F.min(x).cast("double").alias("lo"), F.max(x).cast("double").alias("hi")]
    cuts = exact_percentiles(df, x, shares) if by_quantile else []
    ends = df.agg(*facts)
    even = F.array(*[F.col("lo") + (F.col("hi") - F.col("lo")) * (k / bins) for k in range(bins)], F.col("hi"))
    edges = F.array(F.col("lo"), *map(F.lit, cuts), F.col("hi")) if by_quantile and len(np.unique(cuts)) == bins - 1 else even
    edged = ends.select("lo", "hi", edges.alias("edges"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.size(F.filter("edges", lambda e: e <= F.col(x))) - 1 if by_quantile else F.least(F.floor((F.col(x) - F.col("lo")) / width), F.lit(bins - 1))
    placed = df.select(x, y).crossJoin(F.broadcast(edged)).filter(F.col(x) < F.col("hi")).select(place.cast("int").alias("bin"), F.col(y).alias("y"))
    binned = placed.groupBy("bin").agg(F.avg("y").alias("mean"), (F.stddev_samp("y") / F.sqrt(F.count("*"))).alias("se"), F.count("*").alias("count"))
    # an array in the aggregate would make Spark sort all rows
    center = F.element_at("edges", F.col("bin") + 1) / 2 + F.element_at("edges", F.col("bin") + 2) / 2
    return binned.crossJoin(F.broadcast(edged)).select("bin", center.alias("center"), "mean", "se", "count")


def smooth_bins(binned: DataFrame, points: int) -> DataFrame:
    """(i, center, mean, se): binned means (one row a bin, so few) resampled at ``points`` even places by not-a-knot cubics."""
    import pandas as pd

    from tessitura.functions import kernels as K

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("center")
        at = rows["center"].to_numpy()
        grid = np.linspace(at.min(), at.max(), points)
        return pd.DataFrame({"i": np.arange(points), "center": grid, **{c: K.cubic_spline(at, rows[c].to_numpy(), grid) for c in ("mean", "se")}})

    return binned.select("center", "mean", "se").withColumn("one", F.lit(1)).groupBy("one").applyInPandas(run, "i int, center double, mean double, se double")


def percentile_knots(df: DataFrame, x: str, knots: int = 3) -> list[float]:
    """Knots of a spline at the percentiles int(100 k / (knots + 1)) of a column; 10, 50 and 90 if these aren't distinct."""
    shares = [int(k * 100 / (knots + 1)) / 100 for k in range(1, knots + 1)]
    both = exact_percentiles(df, x, [*shares, 0.1, 0.5, 0.9])
    own, wide = both[:knots], both[knots:]
    found = own if len(set(own)) == knots else wide
    if not found or len(set(found)) != len(found):
        raise ValueError("the column has too few distinct values for knots")
    return found


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) of every two columns, each pair once, from one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = df.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])).alias("o")).select("o.*")


def categorical_summary(df: DataFrame, category: str, y: str) -> DataFrame:
    """Share of every category, with mean and population deviation of y."""
    g = df.groupBy(category).agg(F.count("*").alias("count"), F.avg(y).alias("mean"), F.stddev_pop(y).alias("std"))
    total = F.broadcast(g.agg(F.sum("count").alias("_total")))
    return g.crossJoin(total).select(category, (F.col("count") / F.col("_total")).alias("share"), "mean", "std")


def pairwise_correlation(df: DataFrame, features: list[str], dependent: str) -> DataFrame:
    """(feature, r2, rank) of every feature against the dependent column, by falling |correlation|."""
    row = df.agg(*[F.corr(f, dependent).alias(f) for f in features])
    long = row.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("r")) for f in features])).alias("o")).select("o.*")
    rank = F.row_number().over(Window.orderBy(F.desc(F.abs("r")), "feature"))
    return long.select("feature", (F.col("r") * F.col("r")).alias("r2"), rank.alias("rank"))


def weighted_histogram(df: DataFrame, x: str, bins: int) -> DataFrame:
    """(bin, share): equal-width histogram with weights 1 / N; the last bin is closed."""
    ends = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(x).alias("size"))
    place = F.least(F.floor((F.col(x) - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1)).cast("int")
    placed = df.filter(F.col(x).isNotNull()).crossJoin(F.broadcast(ends)).select(place.alias("bin"), "size")
    return placed.groupBy("bin").agg((F.count("*") / F.first("size")).alias("share"))


def weighted_moments(df: DataFrame, key: list[str], at: str, weight: str, quartiles: bool = False) -> DataFrame:
    """Mean, std, skew, (non-excess) kurtosis and normalised entropy of ``at`` under weights, per key.

    ``quartiles`` adds q1..q3: the last place whose running share is at most 25, 50, 75 %, 0 if none.
    """
    whole = Window.partitionBy(*key)
    p = df.select(*key, F.col(at).cast("double").alias("v"), (F.col(weight) / F.sum(weight).over(whole)).alias("p"))
    p = p.select("*", F.sum(F.col("p") * F.col("v")).over(whole).alias("mean"), F.sum("p").over(whole.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
    off = F.col("v") - F.col("mean")
    sd = F.sqrt(F.sum(F.col("p") * off * off))
    quarter = [F.coalesce(F.max(F.when(F.col("run") <= q, F.col("v"))), F.lit(0.0)).alias(f"q{i}") for i, q in ((1, 0.25), (2, 0.5), (3, 0.75))]
    return p.groupBy(*key).agg(
        F.first("mean").alias("mean"),
        sd.alias("std"),
        (F.sum(F.col("p") * off * off * off) / F.pow(sd, F.lit(3.0))).alias("skew"),
        (F.sum(F.col("p") * off * off * off * off) / F.pow(sd, F.lit(4.0))).alias("kurtosis"),
        (-F.sum(F.when(F.col("p") > 0, F.col("p") * F.log2("p")).otherwise(0.0)) / F.log2(F.count("*").cast("double"))).alias("entropy"),
        *(quarter if quartiles else []),
    )


# --- order and nearest neighbours in one dimension ------------------------------------------------------------------

#: Rows of a range partition, about.
RANGE_ROWS = 500_000


def _ranges(df: DataFrame, *by: str) -> DataFrame:
    """``df`` with _pid: rows dealt over ranges of ``by``, numbered in its order; written, so that the deal is final."""
    from tessitura.session import shared_table

    parts = max(1, -(-df.count() // RANGE_ROWS))
    return shared_table(df.repartitionByRange(parts, *by).withColumn("_pid", F.spark_partition_id()), "ranges")


def count_up_to(points: DataFrame, probes: DataFrame, x: str, strictly: bool = False) -> DataFrame:
    """``probes`` with _count: how many ``points`` have a value of at most (or under) theirs.

    Both are dealt over ranges together; a running count inside each range adds to the number of points in the ranges before, a
    table of one row a range. No task sees more than a range.
    """
    order = F.lit(1 if strictly else 0)
    both = points.select(F.col(x).cast("double").alias(x), order.alias("_turn"), F.lit(True).alias("_point")).unionByName(
        probes.withColumns({x: F.col(x).cast("double"), "_turn": 1 - order, "_point": F.lit(False)}), allowMissingColumns=True
    )
    dealt = _ranges(both, x)
    own = dealt.groupBy("_pid").agg(F.count_if("_point").alias("_own"))
    # one row for each range of RANGE_ROWS rows
    before = own.select("_pid", (F.sum("_own").over(Window.orderBy("_pid")) - F.col("_own")).alias("_before"))
    running = F.count_if("_point").over(Window.partitionBy("_pid").orderBy(x, "_turn").rowsBetween(Window.unboundedPreceding, 0))
    counted = dealt.withColumn("_run", running).filter("not _point").join(before, "_pid")
    return counted.withColumn("_count", F.col("_run") + F.col("_before")).select(*probes.columns, "_count")


def digamma_int(n: Column, most: int = 40) -> Column:
    """digamma of a whole number: the harmonic sum for small ones, the asymptotic series above."""
    small = F.element_at(F.array(*[F.lit(-EULER_GAMMA + math.fsum(1 / k for k in range(1, m))) for m in range(1, most + 1)]), n.cast("int"))
    x = n.cast("double")
    series = F.log(x) - 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x * x * x * x)
    return F.when(n <= most, small).otherwise(series)


def _neighbour_radius(df: DataFrame, x: str, k: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(x)
    near = F.array_sort(F.filter(F.array(*[F.abs(F.col(x) - F.lag(x, i).over(order)) for i in range(1, k + 1)], *[F.abs(F.lead(x, i).over(order) - F.col(x)) for i in range(1, k + 1)]), lambda v: v.isNotNull()))
    return df.select("*", near.alias("_near")).select("*", F.get("_near", F.lit(k - 1)).alias("radius")).drop("_near")


def knn_radius(df: DataFrame, x: str, k: int = 3, key: str | None = None) -> DataFrame:
    """Every row's distance to its k-th nearest other value, from k neighbours on each side in sorted order.

    With a ``key`` neighbours are those of the same key. Without one, rows are dealt over ranges of the value, and each range
    borrows the k rows before and after it, so no task sorts the whole column.
    """
    if key is not None:
        return _neighbour_radius(df, x, k, key)
    dealt = _ranges(df, x)
    own = Window.partitionBy("_pid").orderBy(x)
    ends = dealt.select("_pid", x, F.row_number().over(own).alias("_n"), F.count("*").over(Window.partitionBy("_pid")).alias("_size")).filter((F.col("_n") <= k) | (F.col("_n") > F.col("_size") - k))
    # 2 k values for each range of RANGE_ROWS rows; the nearest k beyond a range may lie in several
    rows = sorted((r["_pid"], r[x]) for r in ends.select("_pid", x).collect())
    halo, start = [], 0
    while start < len(rows):
        pid, end = rows[start][0], start
        while end < len(rows) and rows[end][0] == pid:
            end += 1
        halo += [(pid, float(v)) for _, v in rows[max(0, start - k) : start] + rows[end : end + k]]
        start = end
    borrowed = df.sparkSession.createDataFrame(halo, f"_pid int, `{x}` double").withColumn("_own", F.lit(False))
    whole = dealt.withColumn("_own", F.lit(True)).withColumn(x, F.col(x).cast("double")).unionByName(borrowed, allowMissingColumns=True)
    return _neighbour_radius(whole, x, k, "_pid").filter("_own").drop("_own", "_pid")


def knn_entropy(df: DataFrame, x: str, k: int = 3, base: float = 2, key: str | None = None) -> DataFrame:
    """Kozachenko-Leonenko entropy of one column (of each key's rows): psi(N) - psi(k) + ln 2 + mean ln r, in units of ``base``.

    Ties at distance 0 have no logarithm and are left out; a key with k rows or fewer has a null entropy.
    """
    keys = [key] if key else []
    r = knn_radius(df.select(*keys, x), x, k, key)
    psi_k = -EULER_GAMMA + math.fsum(1 / i for i in range(1, k))
    agg = r.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.when(F.col("radius") > 0, F.log("radius"))).alias("mean_log"))
    value = (digamma_int(F.col("n")) - psi_k + math.log(2) + F.col("mean_log")) / math.log(base)
    return agg.select(*keys, *(["n"] if keys else []), value.alias("entropy"))


def mean_digamma(df: DataFrame, x: str, radius: float) -> DataFrame:
    """Mean digamma of the number of rows within ``radius``, the row itself included: two counts by rank, no join on distances."""
    own = df.select(F.col(x).cast("double").alias(x), F.monotonically_increasing_id().alias("_id"))
    high = count_up_to(own, own.select("_id", (F.col(x) + radius).alias(x)), x).select("_id", F.col("_count").alias("high"))
    low = count_up_to(own, own.select("_id", (F.col(x) - radius).alias(x)), x, True).select("_id", F.col("_count").alias("low"))
    return high.join(low, "_id").select(digamma_int(F.col("high") - F.col("low")).alias("psi")).agg(F.avg("psi").alias("mean_digamma"))
