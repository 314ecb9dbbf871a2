"""Queries over point processes, symbols, graphs and generated sources, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tessitura.functions.columns import EULER_GAMMA
from tessitura.operators import graphs as G
from tessitura.operators import points as P
from tessitura.operators import spectra as T
from tessitura.operators import statistics as A
from tessitura.plans.tables import EDGES, MULTI, SIG, TRAINS, nation_edges, r, seconds, signal, table, trains
from tessitura.session import shared_table
from tessitura.sources import generators as S

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


TAU = f"{2 * math.pi!r}::DOUBLE"
DAY = 86400
SPAN = 30 * DAY

# --- point processes ------------------------------------------------------------------------------------------------


def _train(spark, d, name):
    return trains(spark, d).filter(F.col("train_id") == name).select("t")


@query(
    "q_joint_isi",
    f"WITH {TRAINS}, c AS (SELECT CAST(round_even((a.t - b.t) / 600, 0) + 12 AS INTEGER) AS bin, count(*) AS c FROM tr a JOIN tr b ON a.train_id = 'click' AND b.train_id = 'purchase' AND abs(a.t - b.t) <= 7200 GROUP BY 1) "
    "SELECT CAST(g.b AS INTEGER) AS bin, (g.b - 12.5::DOUBLE) * 600 AS edge, coalesce(c, 0) AS count FROM range(25) g(b) LEFT JOIN c ON c.bin = g.b",
)
def joint_isi(spark, d):
    return P.joint_isi(_train(spark, d, "click"), _train(spark, d, "purchase"), 14400.0, 600.0)


@query(
    "q_xcorr_hist",
    f"""WITH {TRAINS}, g AS (SELECT CAST(b AS INTEGER) AS bin FROM range(720) r(b)), c AS (SELECT bin, train_id, count(*) AS c FROM g JOIN tr ON t BETWEEN bin * 3600 - 1800 AND bin * 3600 + 1800 GROUP BY 1, 2)
    SELECT g.bin, g.bin * 3600::DOUBLE AS t, round(coalesce(a.c, 0) * coalesce(b.c, 0) / (3600.0 * 720)::DOUBLE, 10) AS value FROM g LEFT JOIN c a ON a.bin = g.bin AND a.train_id = 'click' LEFT JOIN c b ON b.bin = g.bin AND b.train_id = 'view'""",
)
def xcorr_hist(spark, d):
    out = P.xcorr_hist(_train(spark, d, "click"), _train(spark, d, "view"), SPAN, 3600.0, 1 / 3600)
    return out.select("bin", r("t", 3).alias("t"), r("value", 10).alias("value"))


def _trials(spark, d):
    ev = table(spark, d, "events").select("user_id", seconds().alias("s"))
    return ev.select(F.concat_ws("-", "user_id", F.floor(F.col("s") / DAY)).alias("train_id"), (F.col("s") - F.floor(F.col("s") / DAY) * DAY).alias("t"))


TRIALS = f"ev AS (SELECT user_id, (epoch_us(ts) - 1704067200000000) / CAST(1000000 AS DOUBLE) AS s FROM events), tr AS (SELECT user_id || '-' || CAST(floor(s / {DAY}) AS BIGINT) AS train_id, s - floor(s / {DAY}) * {DAY} AS t FROM ev)"


@query("q_psth", f"WITH {TRIALS}, c AS (SELECT CAST(floor(t / 1800) AS INTEGER) AS bin, count(*) AS c FROM tr GROUP BY 1) SELECT CAST(g.b AS INTEGER) AS bin, g.b * 1800::DOUBLE AS edge, round(coalesce(c, 0) / 1800000::DOUBLE / (SELECT count(DISTINCT train_id) FROM tr) * 1e6, 8) AS rate FROM range(48) g(b) LEFT JOIN c ON c.bin = g.b")
def psth(spark, d):
    out = P.psth(_trials(spark, d), None, float(DAY), 1800.0)
    return out.select("bin", "edge", r(F.col("rate") * 1e6, 8).alias("rate"))


@query("q_psth_offset", f"WITH {TRIALS}, c AS (SELECT CAST(floor((t - 3600) / 1800) AS INTEGER) AS bin, count(*) AS c FROM tr WHERE t >= 3600 AND t <= 80000 GROUP BY 1) SELECT CAST(g.b AS INTEGER) AS bin, 3600 + g.b * 1800::DOUBLE AS edge, round(coalesce(c, 0) / 1800000::DOUBLE / 40 * 1e6, 8) AS rate FROM range(45) g(b) LEFT JOIN c ON c.bin = g.b")
def psth_offset(spark, d):
    return P.psth(_trials(spark, d), 40, 80000.0, 1800.0, 3600.0).select("bin", "edge", r(F.col("rate") * 1e6, 8).alias("rate"))


@query("q_spike_matrix", f"WITH {TRAINS} SELECT train_id, CAST(least(floor((t - {DAY}) / 3600), 239) AS INTEGER) AS bin, count(*) AS count FROM tr WHERE t >= {DAY} AND t < {11 * DAY} GROUP BY 1, 2")
def spike_matrix(spark, d):
    return P.spike_matrix(trains(spark, d), 3600.0, float(DAY), 10.0 * DAY)


@query("q_spike_envelope", f"WITH {TRIALS}, c AS (SELECT CAST(least(floor(t / 900), 95) AS INTEGER) AS bin, count(DISTINCT train_id) AS c FROM tr GROUP BY 1), f AS (SELECT CAST(g.b AS INTEGER) AS bin, coalesce(c, 0) AS c FROM range(96) g(b) LEFT JOIN c ON c.bin = g.b) SELECT bin, round(c / (max(c) OVER ())::DOUBLE, 8) AS env FROM f")
def spike_envelope(spark, d):
    return P.spike_envelope(_trials(spark, d), 0.0, float(DAY), 900.0).select("bin", r("env", 8).alias("env"))


@query("q_synchrony", f"WITH {TRAINS}, o AS (SELECT DISTINCT train_id, least(floor(t / 600), 4319) AS bin FROM tr) SELECT round((SELECT count(*) FROM o a JOIN o b ON a.bin = b.bin AND a.train_id = 'click' AND b.train_id = 'error') / sqrt((SELECT count(*) FROM o WHERE train_id = 'click') * (SELECT count(*) FROM o WHERE train_id = 'error')::DOUBLE), 8) AS synchrony")
def synchrony(spark, d):
    return P.synchrony(trains(spark, d), "click", "error", float(SPAN), 600.0).select(r("synchrony", 8).alias("synchrony"))


def _kernel(weights: str, mirror: bool, guard: str = "true") -> str:
    at = "UNION ALL SELECT train_id, -1 - bin FROM o UNION ALL SELECT train_id, 1439 - bin FROM o" if mirror else ""
    return f"""WITH {TRAINS}, o AS (SELECT DISTINCT train_id, least(floor(t / 3600), 719) AS bin FROM tr WHERE {guard}), m AS (SELECT train_id, bin FROM o {at}), k AS ({weights}),
    v AS (SELECT train_id, bin + o AS bin, sum(w) AS v FROM m CROSS JOIN k WHERE bin + o BETWEEN 0 AND 719 GROUP BY 1, 2)
    SELECT t.train_id, CAST(g.b AS INTEGER) AS bin, round(coalesce(v, 0), 6) + 0.0 AS value FROM (SELECT DISTINCT train_id FROM tr) t CROSS JOIN range(720) g(b) LEFT JOIN v ON v.train_id = t.train_id AND v.bin = g.b"""


@query("q_causal_smooth", _kernel("SELECT i AS o, exp(-(i * 14400::DOUBLE / 5) / 7200) / sum(exp(-(i * 14400::DOUBLE / 5) / 7200)) OVER () AS w FROM range(6) r(i)", True))
def causal_smooth(spark, d):
    return P.causal_smooth(trains(spark, d), float(SPAN), 3600.0, 7200.0, 14400.0).select("train_id", "bin", r("value").alias("value"))


@query("q_exp_conv", _kernel("SELECT i AS o, exp(-abs(i) * 3600::DOUBLE / 7200) AS w FROM range(-4, 5) r(i)", False, "t > 0 AND t < 2592000"))
def exp_conv(spark, d):
    return P.exp_conv(trains(spark, d), float(SPAN), 7200.0, 3600.0, causal=False).select("train_id", "bin", r("value").alias("value"))


# --- statistics -----------------------------------------------------------------------------------------------------


@query("q_r2", "SELECT round(corr(l_quantity, l_extendedprice) ** 2, 8) AS r2 FROM lineitem")
def r2(spark, d):
    return A.r_squared(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice").select(r("r2", 8).alias("r2"))


@query("q_sample_std", f"WITH {MULTI} SELECT signal_id, round(stddev_samp(x), 6) AS std FROM sig GROUP BY 1")
def sample_std(spark, d):
    return A.sample_std(signal(spark, d, True)).select("signal_id", r("std").alias("std"))


@query("q_symbol_frequencies", "SELECT l_returnflag, l_linestatus, round(count(*) / (sum(count(*)) OVER ())::DOUBLE, 10) AS p FROM lineitem GROUP BY 1, 2")
def symbol_frequencies(spark, d):
    return A.frequencies(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus").select("l_returnflag", "l_linestatus", r("p", 10).alias("p"))


def _h(*cols: str) -> str:
    return f"(SELECT -sum(p * log2(p)) FROM (SELECT count(*) / (sum(count(*)) OVER ())::DOUBLE AS p FROM lineitem GROUP BY {', '.join(cols)}))"


@query("q_entropy", f"SELECT round({_h('l_returnflag', 'l_linestatus')}, 8) AS entropy")
def entropy(spark, d):
    return A.entropy(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus").select(r("entropy", 8).alias("entropy"))


@query("q_mutual_information", f"SELECT round({_h('l_returnflag')} + {_h('l_linestatus')} - {_h('l_returnflag', 'l_linestatus')}, 8) + 0.0 AS mi")
def mutual_information(spark, d):
    return A.mutual_information(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus").select(r("mi", 8).alias("mi"))


@query("q_conditional_mi", f"SELECT round({_h('l_linestatus', 'l_linenumber')} + {_h('l_returnflag', 'l_linenumber')} - {_h('l_returnflag', 'l_linestatus', 'l_linenumber')} - {_h('l_linenumber')}, 8) + 0.0 AS cmi")
def conditional_mi(spark, d):
    return A.conditional_mutual_information(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", "l_linenumber").select(r("cmi", 8).alias("cmi"))


@query(
    "q_binned_mean",
    """WITH e AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem), p AS (SELECT least(floor((l_quantity - lo) / ((hi - lo) / 20)), 19) AS bin, lo, (hi - lo) / 20 AS width, l_extendedprice AS y FROM lineitem, e WHERE l_quantity < hi)
    SELECT CAST(bin AS INTEGER) AS bin, round(max(lo) + (bin + 0.5) * max(width), 6) AS center, round(avg(y), 4) AS mean, round(stddev_samp(y) / sqrt(count(*)), 4) AS se, count(*) AS count FROM p GROUP BY bin""",
)
def binned_mean(spark, d):
    out = A.binned_mean(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")
    return out.select("bin", r("center").alias("center"), r("mean", 4).alias("mean"), r("se", 4).alias("se"), "count")


@query("q_categorical_summary", "SELECT o_orderpriority, round(count(*) / (sum(count(*)) OVER ())::DOUBLE, 8) AS share, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS std FROM orders GROUP BY 1")
def categorical_summary(spark, d):
    out = A.categorical_summary(table(spark, d, "orders"), "o_orderpriority", "o_totalprice")
    return out.select("o_orderpriority", r("share", 8).alias("share"), r("mean", 4).alias("mean"), r("std", 4).alias("std"))


@query(
    "q_pairwise_correlation",
    "WITH c AS (SELECT 'l_quantity' AS feature, corr(l_quantity, l_extendedprice) AS r FROM lineitem UNION ALL SELECT 'l_discount', corr(l_discount, l_extendedprice) FROM lineitem UNION ALL SELECT 'l_tax', corr(l_tax, l_extendedprice) FROM lineitem) SELECT feature, round(r * r, 8) + 0.0 AS r2, CAST(row_number() OVER (ORDER BY abs(r) DESC, feature) AS INTEGER) AS rank FROM c",
)
def pairwise_correlation(spark, d):
    return A.pairwise_correlation(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice").select("feature", r("r2", 8).alias("r2"), "rank")


@query("q_weighted_histogram", "WITH e AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi, count(c_acctbal) AS n FROM customer) SELECT CAST(least(floor((c_acctbal - lo) / ((hi - lo) / 16)), 15) AS INTEGER) AS bin, round(count(*) / max(n)::DOUBLE, 8) AS share FROM customer, e GROUP BY 1")
def weighted_histogram(spark, d):
    return A.weighted_histogram(table(spark, d, "customer"), "c_acctbal", 16).select("bin", r("share", 8).alias("share"))


NEAR = "nn AS (SELECT list_sort([v FOR v IN [c_acctbal - lag(c_acctbal, 1) OVER w, c_acctbal - lag(c_acctbal, 2) OVER w, c_acctbal - lag(c_acctbal, 3) OVER w, lead(c_acctbal, 1) OVER w - c_acctbal, lead(c_acctbal, 2) OVER w - c_acctbal, lead(c_acctbal, 3) OVER w - c_acctbal] IF v IS NOT NULL])[3] AS radius FROM customer WINDOW w AS (ORDER BY c_acctbal))"
HARMONIC = f"psi AS (SELECT n, -{EULER_GAMMA}::DOUBLE + coalesce(sum(1 / n::DOUBLE) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS psi FROM range(1, 200001) r(n))"


@query("q_knn_entropy", f"WITH {NEAR}, {HARMONIC}, a AS (SELECT count(*) AS n, avg(ln(radius)) FILTER (radius > 0) AS m FROM nn) SELECT round(((SELECT psi FROM psi WHERE psi.n = a.n) - (SELECT psi FROM psi WHERE psi.n = 3) + ln(2) + m) / ln(2), 6) AS entropy FROM a")
def knn_entropy(spark, d):
    return A.knn_entropy(table(spark, d, "customer"), "c_acctbal", 3).select(r("entropy").alias("entropy"))


@query("q_mean_digamma", f"WITH {HARMONIC}, c AS (SELECT count(*) OVER (ORDER BY c_acctbal RANGE BETWEEN 25.0::DOUBLE PRECEDING AND 25.0::DOUBLE FOLLOWING) AS n FROM customer) SELECT round(avg(psi), 6) AS mean_digamma FROM c JOIN psi USING (n)")
def mean_digamma(spark, d):
    return A.mean_digamma(table(spark, d, "customer"), "c_acctbal", 25.0).select(r("mean_digamma").alias("mean_digamma"))


# --- graphs ---------------------------------------------------------------------------------------------------------


@query("q_symmetric_weights", f"WITH {EDGES} SELECT src, dst, weight FROM w")
def symmetric_weights(spark, d):
    return G.symmetric_weights(nation_edges(spark, d))


@query("q_affinity", f"WITH {EDGES} SELECT src, dst, round(weight / sum(weight) OVER (PARTITION BY src), 10) AS value FROM w")
def affinity(spark, d):
    return G.affinity(nation_edges(spark, d)).select("src", "dst", r("value", 10).alias("value"))


MATRIX = "s AS (SELECT src AS node, sum(weight) AS s FROM w GROUP BY 1), b AS (SELECT a.node AS i, c.node AS j, coalesce(w.weight, 0) - a.s * c.s / (SELECT sum(s) FROM s) AS value FROM s a CROSS JOIN s c LEFT JOIN w ON w.src = a.node AND w.dst = c.node)"


@query("q_modularity_matrix", f"WITH {EDGES}, {MATRIX} SELECT i, j, round(value, 6) + 0.0 AS value FROM b")
def modularity_matrix(spark, d):
    return G.modularity_matrix(nation_edges(spark, d)).select("i", "j", r("value").alias("value"))


@query("q_modularity", f"WITH {EDGES}, {MATRIX} SELECT round(sum(value) / (SELECT sum(s) FROM s), 10) + 0.0 AS modularity FROM b JOIN nation p ON p.n_nationkey = i JOIN nation q ON q.n_nationkey = j WHERE p.n_regionkey = q.n_regionkey")
def modularity(spark, d):
    communities = table(spark, d, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("community"))
    return G.modularity(nation_edges(spark, d), communities).select(r("modularity", 10).alias("modularity"))


@query("q_generalized_modularity", f"WITH {EDGES}, {MATRIX}, m AS (SELECT n_nationkey AS node FROM nation WHERE n_regionkey = 1), u AS (SELECT * FROM b WHERE i IN (FROM m) AND j IN (FROM m)) SELECT i, j, round(value - CASE WHEN i = j THEN sum(value) OVER (PARTITION BY i) ELSE 0 END, 6) + 0.0 AS value FROM u")
def generalized_modularity(spark, d):
    members = table(spark, d, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("node"))
    return G.generalized_modularity(G.modularity_matrix(nation_edges(spark, d)), members).select("i", "j", r("value").alias("value"))


@query("q_generalized_modularity_directed", f"WITH {EDGES}, {MATRIX}, m AS (SELECT n_nationkey AS node FROM nation WHERE n_regionkey = 1), u AS (SELECT i, j, value * (1 + i / 100::DOUBLE) AS value FROM b WHERE i IN (FROM m) AND j IN (FROM m)) SELECT i, j, round(value - CASE WHEN i = j THEN (SELECT sum(v.value) FROM u v WHERE v.i = u.i) / 2 + (SELECT sum(v.value) FROM u v WHERE v.j = u.i) / 2 ELSE 0 END, 6) + 0.0 AS value FROM u")
def generalized_modularity_directed(spark, d):
    members = table(spark, d, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("node"))
    skewed = G.modularity_matrix(nation_edges(spark, d)).withColumn("value", F.col("value") * (1 + F.col("i") / 100))
    return G.generalized_modularity(skewed, members, True).select("i", "j", r("value").alias("value"))


@query("q_google_matrix", f"WITH {EDGES}, n AS (SELECT count(*) AS n FROM (SELECT src FROM e UNION SELECT dst FROM e)) SELECT src AS i, dst AS j, round(0.85::DOUBLE * weight / sum(weight) OVER (PARTITION BY src) + 0.15::DOUBLE / n, 10) AS value FROM e, n")
def google_matrix(spark, d):
    return G.google_matrix(nation_edges(spark, d)).select("i", "j", r("value", 10).alias("value"))


@query(
    "q_link_rank",
    f"""WITH RECURSIVE {EDGES}, st AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM e), nd AS (SELECT src AS node FROM e UNION SELECT dst FROM e), n AS (SELECT count(*) AS n FROM nd),
    st2 AS (SELECT src, dst, share FROM st UNION ALL SELECT k.node, nd.node, 1 / (SELECT n FROM n)::DOUBLE FROM nd k, nd WHERE k.node NOT IN (SELECT src FROM e)),
    pr(it, node, rank) AS (SELECT 0, node, 1 / (SELECT n FROM n)::DOUBLE FROM nd UNION ALL (
      SELECT p.it + 1, s.dst, 0.85::DOUBLE * sum(p.rank * s.share) + 0.15::DOUBLE / (SELECT n FROM n) FROM pr p JOIN st2 s ON s.src = p.node WHERE p.it < 12 GROUP BY p.it, s.dst)),
    f AS (SELECT node, rank FROM pr WHERE it = 12)
    SELECT src AS i, dst AS j, round(a.rank * (0.85::DOUBLE * share + 0.15::DOUBLE / (SELECT n FROM n)), 8) AS link,
      round(a.rank * (0.85::DOUBLE * share + 0.15::DOUBLE / (SELECT n FROM n)) - a.rank * b.rank, 8) + 0.0 AS value FROM st JOIN f a ON a.node = src JOIN f b ON b.node = dst""",
)
def link_rank(spark, d):
    return G.link_rank_matrix(shared_table(nation_edges(spark, d), "edges"), iterations=12).select("i", "j", r("link", 8).alias("link"), r("value", 8).alias("value"))


@query("q_prune_graph", "SELECT DISTINCT c_custkey AS node FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def prune_graph(spark, d):
    nodes = table(spark, d, "customer").select(F.col("c_custkey").alias("node"))
    return G.prune(nodes, table(spark, d, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("src")))


# --- generated sources ----------------------------------------------------------------------------------------------


@query("q_sine_wave", f"SELECT CAST(n AS INTEGER) AS n, round(sin({TAU} * 440 * (n / 8000::DOUBLE)), 8) + 0.0 AS x FROM range(4000) r(n)")
def sine_wave(spark, d):
    return S.sine_wave(spark, 0.5, 440.0, 8000.0).select("n", r("x", 8).alias("x"))


@query("q_simple_stack", f"SELECT CAST(n AS INTEGER) AS n, round(sum(sin({TAU} * 200 * k * (n / 8000::DOUBLE))), 8) + 0.0 AS x FROM range(4000) r(n), range(1, 6) h(k) GROUP BY n")
def simple_stack(spark, d):
    return S.simple_stack(spark, 0.5, 200.0, 8000.0, 5).select("n", r("x", 8).alias("x"))


@query("q_harmonic_stack", f"SELECT CAST(n AS INTEGER) AS n, round(sum(sin({TAU} * 100 * power(2, k) * (n / 8000::DOUBLE))), 8) + 0.0 AS x FROM range(4000) r(n), range(5) h(k) GROUP BY n")
def harmonic_stack(spark, d):
    return S.harmonic_stack(spark, 0.5, 100.0, 8000.0, 5).select("n", r("x", 8).alias("x"))


TS, FS = [i * 0.01 for i in range(31)], [300.0 * j for j in range(21)]
STRF = "g AS (SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, i * 0.01::DOUBLE AS t, j * 300::DOUBLE AS f FROM range(31) a(i), range(21) b(j))"


@query("q_onset_strf", f"WITH {STRF}, v AS (SELECT i, j, sin({TAU} * 10 * (t - 0.15::DOUBLE)) * exp(-((f - 3000) ** 2) / 500000) * exp(-((t - 0.15::DOUBLE) ** 2) / 0.125::DOUBLE) AS w FROM g) SELECT i, j, round(w / max(abs(w)) OVER (), 8) + 0.0 AS w FROM v")
def onset_strf(spark, d):
    return S.onset_strf(spark, TS, FS).select("i", "j", r("w", 8).alias("w"))


@query("q_checkerboard_strf", f"WITH {STRF}, v AS (SELECT i, j, cos({TAU} * 10 * t) * cos({TAU} * 1e-4 * f) * exp(-((f - 3000) ** 2) / 500000) * exp(-((t - 0.15::DOUBLE) ** 2) / 0.005::DOUBLE) AS w FROM g) SELECT i, j, round(w / max(abs(w)) OVER (), 8) + 0.0 AS w FROM v")
def checkerboard_strf(spark, d):
    return S.checkerboard_strf(spark, TS, FS, f_freq=1e-4).select("i", "j", r("w", 8).alias("w"))


@query("q_sweep_strf", f"WITH {STRF}, v AS (SELECT i, j, t / 0.3::DOUBLE * cos(0.5::DOUBLE) + (f - 3000) / 3000 * sin(0.5::DOUBLE) AS a, -t / 0.3::DOUBLE * sin(0.5::DOUBLE) + (f - 3000) / 3000 * cos(0.5::DOUBLE) AS b FROM g) SELECT i, j, round(exp(-(a * a + b * b) / 2) * cos({TAU} * a / 0.5::DOUBLE), 8) + 0.0 AS w FROM v")
def sweep_strf(spark, d):
    return S.sweep_strf(spark, TS, FS, theta=0.5, f_c=3000.0).select("i", "j", r("w", 8).alias("w"))


SHORT_T, SHORT_F = [i * 0.01 for i in range(16)], [300.0 * j for j in range(11)]


@query(
    "q_strf_correlation",
    f"""WITH g AS (SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, i * 0.01::DOUBLE AS t, j * 300::DOUBLE AS f FROM range(16) a(i), range(11) b(j)),
    o AS (SELECT i, j, sin({TAU} * 10 * (t - 0.07::DOUBLE)) * exp(-((f - 1500) ** 2) / 500000) * exp(-((t - 0.07::DOUBLE) ** 2) / 0.125::DOUBLE) AS w FROM g),
    c AS (SELECT i, j, cos({TAU} * 10 * t) * cos({TAU} * 1e-4 * f) * exp(-((f - 1500) ** 2) / 500000) * exp(-((t - 0.08::DOUBLE) ** 2) / 0.005::DOUBLE) AS w FROM g),
    s AS (SELECT delay, roll, sum(o.w * c.w) AS dot FROM range(-4, 5) d(delay), range(11) r(roll), o JOIN c ON c.i = o.i + delay AND c.j = (o.j + roll) % 11 GROUP BY 1, 2),
    n AS (SELECT delay, roll, dot / (SELECT sqrt(sum(w * w)) FROM o) / (SELECT sqrt(sum(w * w)) FROM c) AS corr FROM s)
    SELECT CAST(delay AS INTEGER) AS delay, CAST(roll AS INTEGER) AS roll, round(corr, 8) AS corr FROM n ORDER BY round(abs(corr), 9) DESC, delay, roll LIMIT 1""",
)
def strf_correlation(spark, d):
    a = S.onset_strf(spark, SHORT_T, SHORT_F, t_c=0.07, f_c=1500.0)
    b = S.checkerboard_strf(spark, SHORT_T, SHORT_F, f_freq=1e-4, t_c=0.08, f_c=1500.0)
    return T.strf_correlation(a, b, 16, 11, 4).select("delay", "roll", r("corr", 8).alias("corr"))


@query("q_simulate_poisson")
def simulate_poisson(spark, d):
    rate = signal(spark, d).select("n", (F.col("x") / 2000).alias("rate"))
    return S.simulate_poisson(rate, 1.0, 10, 7)


@query("q_simulate_gamma")
def simulate_gamma(spark, d):
    rate = signal(spark, d).select("n", (F.col("x") / 2000).alias("rate"))
    return S.simulate_gamma(rate, S.simulate_poisson(rate, 1.0, 10, 7), 1.0, 10, 8)


@query("q_random_psth")
def random_psth(spark, d):
    return S.random_psth(spark, 1.0)
