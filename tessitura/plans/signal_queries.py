"""Queries over signals made of the driver's tables, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tessitura.functions import columns as C
from tessitura.operators import samples as S
from tessitura.operators import spectra as P
from tessitura.operators import statistics as A
from tessitura.plans.tables import HOURS, MULTI, SIG, r, signal, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


TAU = 2 * math.pi

# --- spectra --------------------------------------------------------------------------------------------------------

SPEC = f"""
spec AS (
  SELECT signal_id, k, sum(x * cos({TAU!r} * ((k * n) % {HOURS}) / {HOURS})) AS re, -sum(x * sin({TAU!r} * ((k * n) % {HOURS}) / {HOURS})) AS im
  FROM sig CROSS JOIN range({HOURS // 2}) f(k) GROUP BY 1, 2
)"""


@query("q_power_spectrum", f"WITH {SIG}, {SPEC} SELECT CAST(k AS INTEGER) AS k, round(k * 1.0 / CAST({HOURS} AS DOUBLE), 8) + 0.0 AS freq, round((re * re + im * im) / 1e6, 3) + 0.0 AS power FROM spec")
def power_spectrum(spark, d):
    out = P.power_spectrum(signal(spark, d), HOURS, 1.0)
    return out.select("k", r("freq", 8).alias("freq"), r(F.col("power") / 1e6, 3).alias("power"))


@query(
    "q_log_power_spectrum",
    f"WITH {SIG}, h AS (SELECT signal_id, n, x * (0.5 - 0.5 * cos({TAU!r}::DOUBLE * n / {HOURS - 1})) AS x FROM sig), {SPEC.replace('FROM sig', 'FROM h')} "
    "SELECT CAST(k AS INTEGER) AS k, round(20 * log10((re * re + im * im) / max(re * re + im * im) OVER ()), 4) + 0.0 AS power FROM spec",
)
def log_power_spectrum(spark, d):
    return P.power_spectrum(signal(spark, d), HOURS, 1.0, log=True, hann=True).select("k", r("power", 4).alias("power"))


@query(
    "q_spectrum_moments",
    f"""WITH {SIG}, {SPEC}, p AS (SELECT k, (re * re + im * im) / sum(re * re + im * im) OVER () AS p FROM spec WHERE k > 0),
    m AS (SELECT *, sum(p * k) OVER () AS mean, sum(p) OVER (ORDER BY k) AS run FROM p),
    s AS (SELECT max(mean) AS mean, sqrt(sum(p * (k - mean) ** 2)) AS sd, sum(p * (k - mean) ** 3) AS m3, sum(p * (k - mean) ** 4) AS m4, -sum(p * log2(p)) / log2(count(*)) AS entropy,
      max(k) FILTER (run <= 0.25) AS q1, max(k) FILTER (run <= 0.5) AS q2, max(k) FILTER (run <= 0.75) AS q3 FROM m)
    SELECT round(mean, 4) AS mean, round(sd, 4) AS std, round(m3 / sd ** 3, 4) AS skew, round(m4 / sd ** 4, 4) AS kurtosis, round(entropy, 6) AS entropy,
      coalesce(CAST(q1 AS DOUBLE), 0) AS q1, coalesce(CAST(q2 AS DOUBLE), 0) AS q2, coalesce(CAST(q3 AS DOUBLE), 0) AS q3 FROM s""",
)
def spectrum_moments(spark, d):
    spec = P.power_spectrum(signal(spark, d), HOURS, 1.0).filter("k > 0")
    m = A.weighted_moments(spec, ["signal_id"], "k", "power", quartiles=True)
    return m.select(*[r(c, 6 if c == "entropy" else 4).alias(c) for c in ("mean", "std", "skew", "kurtosis", "entropy")], "q1", "q2", "q3")


FRAMES = f"""
fr AS (
  SELECT signal_id, CAST(f.i AS INTEGER) AS frame, CAST(n - f.i * 24 AS INTEGER) AS m, x FROM sig JOIN range(29) f(i) ON n BETWEEN f.i * 24 AND f.i * 24 + 47
)"""
CROSS = f"""
tap AS (SELECT signal_id, frame, m, (x - avg(x) OVER (PARTITION BY signal_id, frame)) * (0.5 - 0.5 * cos({TAU!r} * m / 48)) AS x FROM fr),
sp AS (SELECT signal_id, frame, k, sum(x * cos({TAU!r} * ((k * m) % 48) / 48)) AS re, -sum(x * sin({TAU!r} * ((k * m) % 48) / 48)) AS im FROM tap CROSS JOIN range(1, 24) f(k) GROUP BY 1, 2, 3),
cr AS (SELECT a.k, a.signal_id AS a, b.signal_id AS b, sum(a.re * b.re + a.im * b.im) AS re, sum(a.re * b.im - a.im * b.re) AS im
  FROM sp a JOIN sp b ON a.frame = b.frame AND a.k = b.k AND a.signal_id <= b.signal_id GROUP BY 1, 2, 3)"""


def _frames(spark, d):
    return S.chunk(signal(spark, d, True), 48, 0.5).filter("frame < 29")


@query(
    "q_coherence_welch",
    f"WITH {MULTI}, {FRAMES}, {CROSS} SELECT CAST(c.k AS INTEGER) AS k, c.a, c.b, round(c.re / sqrt(p.re * q.re), 6) + 0.0 AS re, round(c.im / sqrt(p.re * q.re), 6) + 0.0 AS im, round((c.re ** 2 + c.im ** 2) / (p.re * q.re), 6) + 0.0 AS coherence "
    "FROM cr c JOIN cr p ON p.k = c.k AND p.a = c.a AND p.b = c.a JOIN cr q ON q.k = c.k AND q.a = c.b AND q.b = c.b WHERE c.a < c.b",
)
def coherence_welch(spark, d):
    out = P.welch_coherence(_frames(spark, d), 48, list(range(1, 24)))
    return out.select("k", "a", "b", r("re").alias("re"), r("im").alias("im"), r("coherence").alias("coherence"))


@query("q_cross_spectra", f"WITH {MULTI}, {FRAMES}, {CROSS} SELECT CAST(k AS INTEGER) AS k, a, b, round(re, 2) + 0.0 AS re, round(im, 2) + 0.0 AS im FROM cr")
def cross_spectra(spark, d):
    frames = _frames(spark, d)
    from pyspark.sql import Window

    tapered = frames.withColumn("x", (F.col("x") - F.avg("x").over(Window.partitionBy("signal_id", "frame"))) * (0.5 - 0.5 * F.cos(TAU * F.col("m") / 48)))
    pairs = P.cross_spectra(P.dft(tapered, ["signal_id", "frame"], "m", 48, list(range(1, 24))), ["frame", "k"])
    return pairs.groupBy("k", "a", "b").agg(r(F.sum("re"), 2).alias("re"), r(F.sum("im"), 2).alias("im"))


@query(
    "q_power_jackknife",
    f"""WITH {SIG}, {FRAMES}, sp AS (SELECT frame, k, sum(x * cos({TAU!r} * ((k * m) % 48) / 48)) AS re, -sum(x * sin({TAU!r} * ((k * m) % 48) / 48)) AS im FROM fr CROSS JOIN range(1, 24) f(k) GROUP BY 1, 2),
    l AS (SELECT *, count(*) OVER w AS n, sqrt(((sum(re) OVER w - re) / (count(*) OVER w - 1)) ** 2 + ((sum(im) OVER w - im) / (count(*) OVER w - 1)) ** 2) AS loo FROM sp WINDOW w AS (PARTITION BY k)),
    o AS (SELECT *, (loo - avg(loo) OVER (PARTITION BY k)) ** 2 AS off FROM l)
    SELECT CAST(k AS INTEGER) AS k, round(avg(re * re + im * im), 2) AS power, round(sum(off) * (max(n) - 1) / max(n), 4) + 0.0 AS variance, round(atan2(sum(im), sum(re)), 6) + 0.0 AS phase FROM o GROUP BY k""",
)
def power_jackknife(spark, d):
    frames = S.chunk(signal(spark, d), 48, 0.5).filter("frame < 29")
    out = P.jackknife_power(P.dft(frames, ["frame"], "m", 48, list(range(1, 24))))
    return out.select("k", r("power", 2).alias("power"), r("variance", 4).alias("variance"), r("phase").alias("phase"))


@query(
    "q_spec_stats",
    f"""WITH {SIG}, {FRAMES}, sp AS (SELECT frame AS t, k AS f, sum(x * cos({TAU!r} * ((k * m) % 48) / 48)) ** 2 + sum(x * sin({TAU!r} * ((k * m) % 48) / 48)) ** 2 AS x FROM fr CROSS JOIN range(1, 24) f(k) GROUP BY 1, 2),
    l AS (SELECT t, f, x - min(x) OVER () AS x FROM sp), p AS (SELECT t, f, x / sum(x) OVER (PARTITION BY t) AS p FROM l), c AS (SELECT *, sum(p) OVER (PARTITION BY t ORDER BY f) AS run FROM p)
    SELECT t, round(sum(p * f), 6) AS mean_freq, coalesce(CAST(max(f) FILTER (run <= 0.25) AS DOUBLE), 0) AS q1, coalesce(CAST(max(f) FILTER (run <= 0.5) AS DOUBLE), 0) AS q2, coalesce(CAST(max(f) FILTER (run <= 0.75) AS DOUBLE), 0) AS q3 FROM c GROUP BY t""",
)
def spec_stats(spark, d):
    frames = S.chunk(signal(spark, d), 48, 0.5).filter("frame < 29")
    spec = P.dft(frames, ["frame"], "m", 48, list(range(1, 24)))
    out = P.spec_stats(spec.select(F.col("frame").alias("t"), F.col("k").alias("f"), (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("x")))
    return out.select("t", r("mean_freq").alias("mean_freq"), *[F.col(q).cast("double").alias(q) for q in ("q1", "q2", "q3")])


# --- events and peaks -----------------------------------------------------------------------------------------------

THRESHOLD = 150.0
ISLANDS = f"""
isl AS (SELECT signal_id, n, x, max(n) OVER (PARTITION BY signal_id) AS last FROM sig),
run AS (SELECT *, n - row_number() OVER (PARTITION BY signal_id ORDER BY n) AS island FROM isl WHERE x > {THRESHOLD}),
evt AS (SELECT signal_id, min(n) AS start, least(max(n) + 1, max(last)) AS "end", max(CASE WHEN n > first THEN x ELSE {THRESHOLD} END) AS max_amp
  FROM (SELECT *, min(n) OVER (PARTITION BY signal_id, island) AS first FROM run) GROUP BY signal_id, island)"""


@query("q_event_segments", f'WITH {MULTI}, {ISLANDS} SELECT signal_id, start, "end", round(max_amp, 6) AS max_amp FROM evt')
def event_segments(spark, d):
    return S.break_into_events(signal(spark, d, True), THRESHOLD).select("signal_id", "start", "end", r("max_amp").alias("max_amp"))


@query(
    "q_segments_merged",
    f"""WITH {MULTI}, {ISLANDS}, k AS (SELECT * FROM evt WHERE max_amp >= 200), g AS (SELECT *, CASE WHEN start - lag("end") OVER (PARTITION BY signal_id ORDER BY start) < 4 THEN 0 ELSE 1 END AS gap FROM k),
    h AS (SELECT *, sum(gap) OVER (PARTITION BY signal_id ORDER BY start) AS grp FROM g) SELECT signal_id, min(start) AS start, max("end") AS "end", round(max(max_amp), 6) AS max_amp FROM h GROUP BY signal_id, grp""",
)
def segments_merged(spark, d):
    return S.break_into_events(signal(spark, d, True), THRESHOLD, merge=4, least_peak=200).select("signal_id", "start", "end", r("max_amp").alias("max_amp"))


LEADLAG = "nb AS (SELECT *, lag(x) OVER w AS b, lead(x) OVER w AS a FROM sig WINDOW w AS (PARTITION BY signal_id ORDER BY n))"


@query("q_extrema", f"WITH {MULTI}, {LEADLAG} SELECT signal_id, n, round(x, 6) AS x, CASE WHEN x < a THEN 'min' ELSE 'max' END AS kind FROM nb WHERE (x < b AND x < a) OR (x > b AND x > a)")
def extrema(spark, d):
    return S.extrema(signal(spark, d, True)).select("signal_id", "n", r("x").alias("x"), "kind")


@query("q_peaks", f"WITH {MULTI}, {LEADLAG} SELECT signal_id, n, round(x, 6) AS x FROM nb WHERE x > b AND a <= x AND x >= 300 AND least(x - b, x - a) >= 20")
def peaks(spark, d):
    return S.detect_peaks(signal(spark, d, True), least=300, threshold=20).select("signal_id", "n", r("x").alias("x"))


@query("q_peaks_distance")
def peaks_distance(spark, d):
    return S.detect_peaks(signal(spark, d, True), least=300, distance=12).select("signal_id", "n", r("x").alias("x"))


@query("q_envelope_end", f"WITH {MULTI}, st AS (SELECT signal_id, n, lead(x) OVER (PARTITION BY signal_id ORDER BY n) - x AS step FROM sig) SELECT signal_id, CAST(coalesce(max(n) FILTER (abs(step) > 0) + 1, 0) AS INTEGER) AS \"end\" FROM st GROUP BY 1")
def envelope_end(spark, d):
    return S.envelope_end(signal(spark, d, True))


# --- maps -----------------------------------------------------------------------------------------------------------


@query("q_modulate_wave", f"WITH {SIG} SELECT n, round(x * sin({TAU * 0.1!r} * (n / CAST(1 AS DOUBLE))), 6) + 0.0 AS x FROM sig")
def modulate_wave(spark, d):
    return signal(spark, d).select("n", r(C.modulate_wave(F.col("x"), F.col("n"), 1.0, 0.1)).alias("x"))


@query(
    "q_add_ramp",
    f"""WITH {SIG}, u AS (SELECT n, CASE WHEN n < 48 THEN x * (0.5 * (1 - cos({math.pi!r} * n / CAST(48 AS DOUBLE)))) ELSE x END AS x FROM sig)
    SELECT n, round(CASE WHEN n >= 672 THEN x * (0.5 * (1 + cos({math.pi!r} * (n - 672) / CAST(47 AS DOUBLE)))) ELSE x END, 6) + 0.0 AS x FROM u""",
)
def add_ramp(spark, d):
    return signal(spark, d).select("n", r(C.add_ramp(F.col("x"), F.col("n"), F.lit(HOURS), 1000, 48)).alias("x"))


@query("q_log_transform", f"WITH {MULTI}, t AS (SELECT *, x / max(x) OVER (PARTITION BY signal_id) AS y FROM sig) SELECT signal_id, n, round(CASE WHEN y > 0 THEN greatest(20 * log10(y) + 50, 0) ELSE 0 END, 6) + 0.0 AS x FROM t")
def log_transform(spark, d):
    return S.log_transform(signal(spark, d, True), 50).select("signal_id", "n", r("x").alias("x"))


@query("q_log_spectrogram", f"WITH {SIG}, {SPEC} SELECT CAST(k AS INTEGER) AS k, round(CASE WHEN re * re + im * im > 0 THEN greatest(10 * log10(re * re + im * im) - 60, 0) ELSE 0 END, 4) + 0.0 AS db FROM spec")
def log_spectrogram(spark, d):
    return P.power_spectrum(signal(spark, d), HOURS, 1.0).select("k", r(C.log_spectrogram(F.col("power"), -60), 4).alias("db"))


@query("q_power_amplifier", f"WITH {MULTI}, t AS (SELECT signal_id, n, power(x / max(x) OVER (PARTITION BY signal_id) + 0.5, 2) - 0.25 AS y FROM sig) SELECT signal_id, n, round(y / max(y) OVER (PARTITION BY signal_id), 6) + 0.0 AS x FROM t")
def power_amplifier(spark, d):
    return S.power_amplifier(signal(spark, d, True), 0.5).select("signal_id", "n", r("x").alias("x"))


@query("q_roll_subtract", f"WITH {MULTI} SELECT signal_id, n, round(greatest(x - coalesce(lead(x, 2) OVER (PARTITION BY signal_id ORDER BY n), 0), 0), 6) + 0.0 AS x FROM sig")
def roll_subtract(spark, d):
    return S.roll_and_subtract(signal(spark, d, True), 2, True).select("signal_id", "n", r("x").alias("x"))


@query("q_frequency_bands", "SELECT CAST(i AS INTEGER) AS band, CAST(floor(power(10, log10(180) + (log10(7000) - log10(180)) * i / CAST(31 AS DOUBLE))) AS INTEGER) AS edge FROM range(1, 31) r(i)")
def frequency_bands(spark, d):
    edges = C.frequency_bands(180, 7000, 32)
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("band"), F.lit(e).alias("edge")) for i, e in enumerate(edges) if 0 < i < 31]))
    return spark.range(1).select(rows.alias("o")).select("o.band", "o.edge")


@query("q_discretize", "WITH c AS (SELECT event_type, quantile_cont(value, 0.33) AS a, quantile_cont(value, 0.66) AS b FROM events GROUP BY 1) SELECT event_id, CAST(1 + CASE WHEN value > a THEN 1 ELSE 0 END + CASE WHEN value > b THEN 1 ELSE 0 END AS INTEGER) AS level FROM events JOIN c USING (event_type)")
def discretize(spark, d):
    ev = table(spark, d, "events").select(F.col("event_type").alias("signal_id"), F.col("event_id").alias("n"), F.col("value").alias("x"))
    return S.discretize(ev, 3).select(F.col("n").alias("event_id"), "level")


@query("q_radial_basis", "SELECT p_partkey, round(exp(-power(p_retailprice / 1000 - 1.2, 2) / CAST(0.25 AS DOUBLE)), 6) AS b FROM part")
def radial_basis(spark, d):
    return table(spark, d, "part").select("p_partkey", r(C.radial_basis(F.col("p_retailprice") / 1000, 1.2, 0.25)).alias("b"))


@query("q_cubic_spline", "SELECT p_partkey, p_size * 1.0::DOUBLE AS b1, p_size ** 2 + 0.0 AS b2, p_size ** 3 + 0.0 AS b3, greatest(p_size - 12.5::DOUBLE, 0) ** 3 AS b4, greatest(p_size - 25::DOUBLE, 0) ** 3 AS b5, greatest(p_size - 37.5::DOUBLE, 0) ** 3 AS b6 FROM part")
def cubic_spline(spark, d):
    terms = C.cubic_terms(F.col("p_size").cast("double"), [12.5, 25.0, 37.5])
    return table(spark, d, "part").select("p_partkey", *[t.alias(f"b{i + 1}") for i, t in enumerate(terms)])


def _cube(k: float) -> str:
    return f"((greatest(p_size - {k}::DOUBLE, 0) ** 3 - greatest(p_size - 45::DOUBLE, 0) ** 3) / ({45 - k}::DOUBLE))"


@query("q_natural_spline", f"SELECT p_partkey, p_size * 1.0::DOUBLE AS b1, round({_cube(5.0)} - {_cube(30.0)}, 6) + 0.0 AS b2, round({_cube(15.0)} - {_cube(30.0)}, 6) + 0.0 AS b3 FROM part")
def natural_spline(spark, d):
    terms = C.natural_terms(F.col("p_size").cast("double"), [5.0, 15.0, 30.0, 45.0])
    return table(spark, d, "part").select("p_partkey", terms[0].alias("b1"), r(terms[1]).alias("b2"), r(terms[2]).alias("b3"))


@query("q_find_index", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def find_index(spark, d):
    return table(spark, d, "orders").filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey")


@query("q_vector_lists", "SELECT p_partkey, CAST(p_size AS DOUBLE) AS first, p_retailprice AS second FROM part")
def vector_lists(spark, d):
    one = C.as_vectors(F.array(F.col("p_size").cast("double")))
    two = C.as_vectors(F.array("p_retailprice"))
    pair = C.zip_vectors(one, two)[0]
    return table(spark, d, "part").select("p_partkey", pair[0].alias("first"), pair[1].alias("second"))


@query("q_elog", "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount <= 0 OR l_discount >= 1 THEN 0 ELSE l_discount * ln(l_discount) END, 6) + 0.0 AS v FROM lineitem")
def elog(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r(C.elog(F.col("l_discount"))).alias("v"))


@query("q_finite_or_zero", "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_tax = 0 THEN 0 ELSE l_discount / l_tax END, 6) + 0.0 AS v FROM lineitem")
def finite_or_zero(spark, d):
    ratio = F.when(F.col("l_tax") == 0, F.lit(float("inf"))).otherwise(F.try_divide("l_discount", "l_tax"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r(C.finite_or_zero(ratio)).alias("v"))


# --- windows and smoothing ------------------------------------------------------------------------------------------


@query("q_frames", f"WITH {MULTI}, g AS (SELECT signal_id, i AS frame, j AS m FROM (SELECT DISTINCT signal_id FROM sig), range(15) f(i), range(100) s(j)) SELECT g.signal_id, CAST(frame AS INTEGER) AS frame, CAST(m AS INTEGER) AS m, round(coalesce(x, 0), 6) AS x FROM g LEFT JOIN sig ON sig.signal_id = g.signal_id AND sig.n = frame * 50 + m WHERE frame < 14")
def frames(spark, d):
    return S.chunk(signal(spark, d, True), 100, 0.5).select("signal_id", "frame", "m", r("x").alias("x"))


@query("q_sliding_windows", "SELECT i * 12 AS center, i * 12 - 18 AS start, i * 12 + 19 AS \"end\" FROM range(60) r(i)")
def sliding_windows(spark, d):
    spans = signal(spark, d).agg(F.count("*").alias("n")).select(F.explode(S.sliding_windows(F.col("n"), 1.0, 12, 36)).alias("o"))
    return spans.select("o.center", "o.start", "o.end")


@query("q_gaussian_window", "WITH g AS (SELECT i, exp(-((i - 24) ** 2) / CAST(2 * 64 AS DOUBLE)) AS w FROM range(49) r(i)) SELECT CAST(i AS INTEGER) AS i, round(w / sum(w) OVER (), 10) AS w FROM g")
def gaussian_window(spark, d):
    rows = F.posexplode(F.array(*map(F.lit, C.gaussian_window(48, 6))))
    return spark.range(1).select(rows.alias("i", "w")).select("i", r("w", 10).alias("w"))


def _reflect(weights: str) -> str:
    """SQL: convolution with the relation k(o, w), mirrored ends."""
    return f"""mir AS (SELECT signal_id, n AS pos, x FROM sig UNION ALL SELECT signal_id, -1 - n, x FROM sig UNION ALL SELECT signal_id, {2 * HOURS - 1} - n, x FROM sig), k AS ({weights})
    SELECT signal_id, CAST(pos + o AS INTEGER) AS n, round(sum(x * w), 6) + 0.0 AS x FROM mir CROSS JOIN k WHERE pos + o >= 0 AND pos + o < {HOURS} GROUP BY 1, 2"""


@query("q_simple_smooth", f"WITH {MULTI}, " + _reflect(f"SELECT i - 5 AS o, (0.5 - 0.5 * cos({TAU!r}::DOUBLE * i / 10)) / 5 AS w FROM range(11) r(i)"))
def simple_smooth(spark, d):
    return S.simple_smooth(signal(spark, d, True), 11).select("signal_id", "n", r("x").alias("x"))


@query("q_temporal_smooth", f"WITH {MULTI}, " + _reflect("SELECT i - 20 AS o, exp(-((i - 20) ** 2) / CAST(30 AS DOUBLE)) / sum(exp(-((i - 20) ** 2) / CAST(30 AS DOUBLE))) OVER () AS w FROM range(41) r(i)"))
def temporal_smooth(spark, d):
    return S.temporal_smooth(signal(spark, d, True), 1.0, 30.0).select("signal_id", "n", r("x").alias("x"))


@query(
    "q_instantaneous_frequency",
    f"WITH {SIG}, z AS (SELECT n, x AS re, coalesce(x - lag(x) OVER (ORDER BY n), 1) AS im FROM sig), y AS (SELECT *, re - lag(re) OVER (ORDER BY n) AS dr, im - lag(im) OVER (ORDER BY n) AS di FROM z) "
    f"SELECT n, round(coalesce((re * di - im * dr) / ({TAU!r} * (re * re + im * im)), 0), 6) + 0.0 AS freq FROM y WHERE re * re + im * im > 0",
)
def instantaneous_frequency(spark, d):
    from pyspark.sql import Window

    z = signal(spark, d).select("signal_id", "n", F.col("x").alias("re"), F.coalesce(F.col("x") - F.lag("x").over(Window.partitionBy("signal_id").orderBy("n")), F.lit(1.0)).alias("im"))
    live = z.filter("re * re + im * im > 0").select("signal_id", "n")
    safe = z.select("signal_id", "n", "re", F.when(F.col("re") * F.col("re") + F.col("im") * F.col("im") > 0, F.col("im")).otherwise(1e-300).alias("im"))
    return S.instantaneous_frequency(safe, 1.0).join(live, ["signal_id", "n"], "left_semi").select("n", r("freq").alias("freq"))


@query(
    "q_forgetting",
    """WITH o AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS obs FROM events),
    w AS (SELECT user_id, obs, power(0.95::DOUBLE, max(n) OVER (PARTITION BY user_id) - n) AS w FROM o), s AS (SELECT user_id, st AS state, sum(CASE WHEN obs = st THEN w ELSE 0 END) AS v FROM w, range(1, 6) r(st) GROUP BY 1, 2)
    SELECT user_id, CAST(state AS INTEGER) AS state, round((v + 0.1) / sum(v + 0.1) OVER (PARTITION BY user_id), 6) AS p FROM s""",
)
def forgetting(spark, d):
    from pyspark.sql import Window

    ev = table(spark, d, "events")
    kinds = ["click", "error", "purchase", "signup", "view"]
    obs = sum((F.when(F.col("event_type") == k, i + 1).otherwise(0) for i, k in enumerate(kinds)), F.lit(0))
    o = ev.select(F.col("user_id").alias("signal_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("n"), obs.alias("obs"))
    return S.forgetting(o, 5, 1.0, 20.0).select(F.col("signal_id").alias("user_id"), "state", r("p").alias("p"))


# --- filters and correlation ----------------------------------------------------------------------------------------

TAPS = [("click", -1, 0.5), ("click", 0, 1.0), ("error", 0, -0.25), ("error", 2, 0.75), ("view", 1, 2.0)]
TAPS_SQL = "k(signal_id, lag, w) AS (VALUES " + ", ".join(f"('{c}', {lag}, {w}::DOUBLE)" for c, lag, w in TAPS) + ")"


@query("q_fast_conv", f"WITH {MULTI}, {TAPS_SQL}, v AS (SELECT n + lag AS n, sum(x * w) AS v FROM sig JOIN k USING (signal_id) GROUP BY 1) SELECT CAST(g.n AS INTEGER) AS n, round(coalesce(v, 0) + 1.5, 6) AS y FROM range({HOURS}) g(n) LEFT JOIN v ON v.n = g.n")
def fast_conv(spark, d):
    return S.fast_conv(signal(spark, d, True), TAPS, 1.5).select("n", r("y").alias("y"))


@query(
    "q_fast_conv_grouped",
    f"WITH {MULTI}, {TAPS_SQL}, u AS (SELECT *, n // 24 AS day, n % 24 AS i FROM sig), v AS (SELECT day, i + lag AS i, sum(x * w) AS v FROM u JOIN k USING (signal_id) GROUP BY 1, 2) "
    f"SELECT CAST(g.n // 24 AS INTEGER) AS day, CAST(g.n AS INTEGER) AS n, round(coalesce(v, 0), 6) + 0.0 AS y FROM range({HOURS}) g(n) LEFT JOIN v ON v.day = g.n // 24 AND v.i = g.n % 24",
)
def fast_conv_grouped(spark, d):
    sig = signal(spark, d, True).withColumn("day", F.floor(F.col("n") / 24).cast("int"))
    return S.fast_conv(sig, TAPS, 0.0, group="day").select("day", "n", r("y").alias("y"))


@query("q_toeplitz", f"WITH {MULTI}, l(pos, lag) AS (VALUES (0, -1), (1, 0), (2, 3)), c AS (SELECT signal_id, row_number() OVER (ORDER BY signal_id) - 1 AS ch FROM (SELECT DISTINCT signal_id FROM sig)) SELECT a.n, CAST(ch * 3 + pos AS INTEGER) AS \"column\", round(coalesce(b.x, 0), 6) AS value FROM sig a JOIN c USING (signal_id) CROSS JOIN l LEFT JOIN sig b ON b.signal_id = a.signal_id AND b.n = a.n - lag UNION ALL SELECT DISTINCT n, 15, 1.0 FROM sig")
def toeplitz(spark, d):
    return S.toeplitz(signal(spark, d, True), [-1, 0, 3]).select("n", "column", r("value").alias("value"))


@query(
    "q_xcorr",
    f"""WITH {MULTI}, a AS (SELECT n, x - avg(x) OVER () AS x, stddev_samp(x) OVER () AS s FROM sig WHERE signal_id = 'click'), b AS (SELECT n, x - avg(x) OVER () AS x, stddev_samp(x) OVER () AS s FROM sig WHERE signal_id = 'view')
    SELECT CAST(lag AS INTEGER) AS lag, round(sum(a.x * b.x) / ({HOURS} - abs(lag)) / max(a.s) / max(b.s), 6) + 0.0 AS cf FROM range(-24, 25) r(lag) JOIN a ON true JOIN b ON b.n = a.n + lag GROUP BY lag""",
)
def xcorr(spark, d):
    return A.correlation_function(signal(spark, d, True), "click", "view", list(range(-24, 25))).select("lag", r("cf").alias("cf"))


@query("q_acf", f"WITH {SIG}, a AS (SELECT n, x - avg(x) OVER () AS x, stddev_samp(x) OVER () AS s FROM sig) SELECT CAST(lag AS INTEGER) AS lag, round(sum(a.x * b.x) / ({HOURS} - lag) / max(a.s) / max(b.s), 6) + 0.0 AS cf FROM range(49) r(lag) JOIN a ON true JOIN a b ON b.n = a.n + lag GROUP BY lag")
def acf(spark, d):
    return A.correlation_function(signal(spark, d), "hourly", "hourly", list(range(49))).select("lag", r("cf").alias("cf"))


@query(
    "q_quantify_cf",
    ORACLES["q_xcorr"].replace("SELECT CAST(lag AS INTEGER) AS lag, round(sum", ", cf AS (SELECT lag, round(sum") + """), w AS (SELECT lag, cf, abs(cf) AS w FROM cf), t AS (SELECT *, sum(w) OVER () AS total, sum(w * lag) OVER () / sum(w) OVER () AS mean, max(w) OVER () AS top FROM w),
    s AS (SELECT max(top) AS peak, CAST(arg_max(lag, w) AS INTEGER) AS delay, sum(w) AS width, max(mean) AS mean, sqrt(sum(w / total * (lag - mean) ** 2)) AS sd, sum(w / total * (lag - mean) ** 3) AS m3, sum(w) FILTER (lag < 0) AS l, sum(w) FILTER (lag > 0) AS r,
      sum(w * lag) FILTER (lag < 0) / sum(w) FILTER (lag < 0) AS ll, sum(w * lag) FILTER (lag > 0) / sum(w) FILTER (lag > 0) AS rl, sum(cf) FILTER (lag < 0) AS ls, sum(cf) FILTER (lag > 0) AS rs, max(cf) FILTER (lag = 0) AS cc0 FROM t)
    SELECT round(peak, 6) AS peak, delay, round(width, 6) AS width, round(mean, 6) AS mean_lag, round(sd, 6) AS std_lag, round(m3 / sd ** 3, 6) AS skew_lag, round((r - l) / (r + l), 6) AS anisotropy, round(ll, 6) AS left_lag, round(rl, 6) AS right_lag, round(ls, 6) + 0.0 AS left_sum, round(rs, 6) + 0.0 AS right_sum, round(cc0, 6) AS cc0 FROM s""",
)
def quantify_cf(spark, d):
    out = A.quantify_correlogram(xcorr(spark, d))
    return out.select(*[c if c == "delay" else r(c).alias(c) for c in out.columns])


@query("q_plv", f"WITH {MULTI}, a AS (SELECT n, x AS a FROM sig WHERE signal_id = 'click'), b AS (SELECT n, x AS b FROM sig WHERE signal_id = 'view') SELECT round(sqrt(avg(cos((b - a) / 100)) ** 2 + avg(sin((b - a) / 100)) ** 2), 6) AS plv FROM a JOIN b USING (n)")
def plv(spark, d):
    wide = signal(spark, d, True).groupBy("n").agg((F.max(F.when(F.col("signal_id") == "click", F.col("x"))) / 100).alias("a"), (F.max(F.when(F.col("signal_id") == "view", F.col("x"))) / 100).alias("b"))
    return A.phase_locking(wide, "a", "b").select(r("plv").alias("plv"))
