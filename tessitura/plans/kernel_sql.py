"""SQL twins of the queries whose kernels run in NumPy: transforms as sums, filters as recursions, tapers as literal tables."""

from __future__ import annotations

import math

import numpy as np

from tessitura.functions import kernels as K
from tessitura.plans.tables import HOURS, MULTI

TAU = 2 * math.pi
ORACLES: dict[str, str] = {}


def num(value: float) -> str:
    return f"CAST({float(value)!r} AS DOUBLE)"


def rounded(value: str, digits: int) -> str:
    return f"round({value}, {digits}) + 0.0"


def values_table(name: str, columns: str, rows) -> str:
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(str(v) if isinstance(v, (int, np.integer)) else num(v) for v in row) + ")" for row in rows) + ")"


# --- filters --------------------------------------------------------------------------------------------------------


def _pass(name: str, source: str, sos: np.ndarray) -> str:
    """One pass of second-order sections over ``source`` (signal_id, i, x), from the steady state of its first sample."""
    steady, k = K.sos_steady(sos), len(sos)
    states = [f"s{j}_{m}" for j in range(k) for m in (1, 2)]
    start = ", ".join(f"{num(steady[j][m - 1])} * x AS s{j}_{m}" for j in range(k) for m in (1, 2))
    inner = f"SELECT e.signal_id, e.i, e.x AS v0, {', '.join('f.' + s for s in states)} FROM {name} f JOIN {source} e ON e.signal_id = f.signal_id AND e.i = f.i + 1"
    for j, (b0, *_rest) in enumerate(sos):
        inner = f"SELECT *, {num(b0)} * v{j} + s{j}_1 AS v{j + 1} FROM ({inner})"
    after = []
    for j, (_b0, b1, b2, _a0, a1, a2) in enumerate(sos):
        after += [f"{num(b1)} * v{j} - {num(a1)} * v{j + 1} + s{j}_2", f"{num(b2)} * v{j} - {num(a2)} * v{j + 1}"]
    return f"""{name}(signal_id, i, y, {', '.join(states)}) AS (
      SELECT signal_id, CAST(-1 AS BIGINT), CAST(0 AS DOUBLE), {start} FROM {source} WHERE i = 0
      UNION ALL SELECT signal_id, i, v{k}, {', '.join(after)} FROM ({inner}))"""


def zero_phase(sos: np.ndarray, source: str = "sig") -> str:
    """Common tables that end in filtered(signal_id, n, x): forward and backward over an odd extension of ``source``."""
    taps = 2 * len(sos) + 1 - min((sos[:, 2] == 0).sum(), (sos[:, 5] == 0).sum())
    pad = min(3 * int(taps), HOURS - 1)
    size = HOURS + 2 * pad
    return f"""ends AS (SELECT signal_id, max(x) FILTER (n = 0) AS x0, max(x) FILTER (n = {HOURS - 1}) AS x1 FROM {source} GROUP BY 1),
    ext AS (
      SELECT signal_id, CAST(n + {pad} AS BIGINT) AS i, x FROM {source}
      UNION ALL SELECT signal_id, CAST({pad} - n AS BIGINT), 2 * x0 - x FROM {source} JOIN ends USING (signal_id) WHERE n BETWEEN 1 AND {pad}
      UNION ALL SELECT signal_id, CAST({2 * (HOURS - 1) + pad} - n AS BIGINT), 2 * x1 - x FROM {source} JOIN ends USING (signal_id) WHERE n BETWEEN {HOURS - 1 - pad} AND {HOURS - 2}
    ),
    {_pass("forth", "ext", sos)},
    turned AS (SELECT signal_id, {size - 1} - i AS i, y AS x FROM forth WHERE i >= 0),
    {_pass("back", "turned", sos)},
    filtered AS (SELECT signal_id, CAST({size - 1 - pad} - i AS INTEGER) AS n, y AS x FROM back WHERE i BETWEEN {pad} AND {size - 1 - pad})"""


def _filtered(sos: np.ndarray) -> str:
    return f"WITH RECURSIVE {MULTI}, {zero_phase(sos)} SELECT signal_id, n, {rounded('x', 4)} AS x FROM filtered"


ORACLES["q_lowpass"] = _filtered(K.butter_sos(5, 2 * 2.0 / 24, "low"))
ORACLES["q_highpass"] = _filtered(K.butter_sos(5, 2 * 2.0 / 24, "high"))
ORACLES["q_bandpass"] = _filtered(K.butter_sos(3, (2 * 0.8 / 24, 2 * 1.2 / 24), "band"))
RECTIFIED = "rectified AS (SELECT signal_id, n, abs(x - avg(x) OVER (PARTITION BY signal_id)) AS x FROM sig)"
ORACLES["q_envelope"] = f"WITH RECURSIVE {MULTI}, {RECTIFIED}, {zero_phase(K.butter_sos(4, 2 * 1.0 / 24, 'low'), 'rectified')} SELECT signal_id, n, {rounded('greatest(x, 0)', 4)} AS x FROM filtered"

# --- transforms of whole signals ------------------------------------------------------------------------------------


def angle(product: str, size: int) -> str:
    return f"{TAU!r} * (({product}) % {size}) / {size}"


ORACLES["q_fft_segments"] = f"""WITH {MULTI} SELECT signal_id, CAST(k AS INTEGER) AS k, {rounded(f"sum(x * cos({angle('k * n', HOURS)}))", 3)} AS re, {rounded(f"-sum(x * sin({angle('k * n', HOURS)}))", 3)} AS im
FROM sig CROSS JOIN range({HOURS}) f(k) GROUP BY 1, 2"""

ORACLES["q_analytic_signal"] = f"""WITH {MULTI} SELECT a.signal_id, a.n, {rounded('max(a.x)', 5)} AS re, {rounded(f"sum(b.x * 2 / {HOURS} / tan(pi() * (a.n - b.n) / {HOURS}))", 5)} AS im
FROM sig a JOIN sig b ON b.signal_id = a.signal_id AND (a.n + b.n) % 2 = 1 GROUP BY 1, 2"""

ORACLES["q_resample"] = f"""WITH {MULTI} SELECT signal_id, CAST(m AS INTEGER) AS n,
  {rounded(f"sum(x * CASE WHEN (2 * m - n) % {HOURS} = 0 THEN 361 ELSE sin(361 * pi() * (2 * m - n) / {HOURS}) / sin(pi() * (2 * m - n) / {HOURS}) END) / {HOURS}", 5)} AS x
FROM sig CROSS JOIN range({HOURS // 2}) r(m) GROUP BY 1, 2"""

ORACLES["q_inverse_spectrogram"] = f"WITH {MULTI} SELECT signal_id, n, {rounded('x', 5)} AS x FROM sig"
ORACLES["q_mode_sums"] = ORACLES["q_multichannel_mode_sums"] = ORACLES["q_inverse_spectrogram"]
ORACLES["q_surrogate_power"] = f"""WITH {MULTI}, z AS (SELECT signal_id, k, sum(x * cos({angle('k * n', HOURS)})) AS re, sum(x * sin({angle('k * n', HOURS)})) AS im FROM sig CROSS JOIN range({HOURS // 2 + 1}) f(k) GROUP BY 1, 2)
SELECT signal_id, CAST(c AS INTEGER) AS copy, CAST(k AS INTEGER) AS k, {rounded('(re * re + im * im) / 1e6', 4)} AS power FROM z CROSS JOIN range(3) g(c)"""

BANDS = ((0.5, 0.2), (1.0, 0.2), (3.0, 1.0))
ORACLES["q_band_analytic"] = f"""WITH {MULTI}, z AS (
  SELECT signal_id, k, sum(x * cos({angle('k * n', 1024)})) AS re, -sum(x * sin({angle('k * n', 1024)})) AS im FROM sig CROSS JOIN range(513) f(k) GROUP BY 1, 2
), {values_table("b", "band, c, w", [(i, c, w) for i, (c, w) in enumerate(BANDS)])}, g AS (
  SELECT signal_id, band, k, re * gain AS re, im * gain AS im FROM (
    SELECT *, exp(-((k * 24::DOUBLE / 1024 - c) ** 2) / (2 * w * w)) * CASE WHEN k = 0 THEN 1 WHEN k = 512 THEN 0 ELSE 2 END AS gain FROM z CROSS JOIN b)
)
SELECT signal_id, CAST(band AS INTEGER) AS band, CAST(n AS INTEGER) AS n, {rounded(f"sum(re * cos({angle('k * n', 1024)}) - im * sin({angle('k * n', 1024)})) / 1024", 5)} AS re,
  {rounded(f"sum(re * sin({angle('k * n', 1024)}) + im * cos({angle('k * n', 1024)})) / 1024", 5)} AS im FROM g CROSS JOIN range({HOURS}) t(n) GROUP BY 1, 2, 3"""

# --- short-time spectra ---------------------------------------------------------------------------------------------


def stft(window: int, hop: int, size: int, nstd: float = 6, name: str = "tf", last: int | None = None) -> str:
    """Common tables that end in ``name``(signal_id, t_idx, k, re, im): Gaussian frames of odd ``window``, ``size`` points."""
    w, half = K.gaussian(window, nstd), window // 2
    return f"""{values_table(f"w_{name}", "j, w", enumerate(w))}, f_{name} AS (
      SELECT s.signal_id, t AS t_idx, j, x * w AS v FROM range({-(-HOURS // hop)}) g(t) CROSS JOIN w_{name} JOIN sig s ON s.n = t * {hop} + j - {half}
    ), {name} AS (
      SELECT signal_id, t_idx, k, sum(v * cos({angle('k * j', size)})) AS re, -sum(v * sin({angle('k * j', size)})) AS im FROM f_{name} CROSS JOIN range({last or (size + 1) // 2}) h(k) GROUP BY 1, 2, 3
    )"""


ORACLES["q_gaussian_stft"] = f"""WITH {MULTI}, {stft(49, 12, 50)} SELECT signal_id, CAST(t_idx AS BIGINT) AS t_idx, CAST(k AS BIGINT) AS f_idx, {rounded('t_idx * 12 / 24::DOUBLE', 6)} AS t, {rounded('k * 24 / 50::DOUBLE', 6)} AS f,
  {rounded('re', 5)} AS re, {rounded('im', 5)} AS im FROM tf"""

ORACLES["q_wavelet_scalogram"] = f"""WITH {MULTI}, f AS (SELECT i, power(2, 3 - 4 * i / 11::DOUBLE) AS f FROM range(12) r(i)), b AS (
  SELECT i, f, j, exp(-((j * f / 24) ** 2)) * sqrt(f) AS g, {TAU!r} * f * j / 24 AS phase FROM f CROSS JOIN range(-144, 145) r(j)
)
SELECT signal_id, CAST(t AS BIGINT) AS t_idx, CAST(i AS BIGINT) AS f_idx, t * 1.0::DOUBLE AS t, {rounded('max(f)', 6)} AS f, {rounded('sum(x * g * cos(phase))', 4)} AS re, {rounded('-sum(x * g * sin(phase))', 4)} AS im
FROM range(30) r(t) CROSS JOIN b JOIN sig s ON s.n = t * 24 + j GROUP BY 1, 2, 3, 4"""

ORACLES["q_modulation_spectrum"] = f"""WITH {MULTI}, {stft(45, 6, 45)}, db AS (SELECT signal_id, t_idx AS t, k AS f, 20 * log10(sqrt(re * re + im * im) + 1e-9) AS s FROM tf),
lifted AS (SELECT signal_id, t, f, greatest(s, max(s) OVER (PARTITION BY signal_id) - 50) AS s FROM db),
z AS (SELECT signal_id, t, f, (s - avg(s) OVER (PARTITION BY signal_id)) / stddev_pop(s) OVER (PARTITION BY signal_id) AS s FROM lifted),
low AS (SELECT signal_id, min(s) AS low FROM z GROUP BY 1), {values_table("w", "j, w", enumerate(K.gaussian(13, 6) / K.gaussian(13, 6).max()))},
pieces AS (SELECT l.signal_id, p, f.f, j, coalesce(z.s, l.low) * w AS v FROM low l CROSS JOIN range(60) g(p) CROSS JOIN range(23) f(f) CROSS JOIN w LEFT JOIN z ON z.signal_id = l.signal_id AND z.f = f.f AND z.t = 2 * p + j - 6),
rows_ AS (SELECT signal_id, p, f, kt, sum(v * cos({angle('kt * j', 13)})) AS re, -sum(v * sin({angle('kt * j', 13)})) AS im FROM pieces CROSS JOIN range(13) k(kt) GROUP BY 1, 2, 3, 4),
both_ AS (SELECT signal_id, p, kt, kf, sum(re * cos({angle('kf * f', 23)}) + im * sin({angle('kf * f', 23)})) AS re, sum(im * cos({angle('kf * f', 23)}) - re * sin({angle('kf * f', 23)})) AS im FROM rows_ CROSS JOIN range(23) k(kf) GROUP BY 1, 2, 3, 4)
SELECT signal_id, {rounded('CASE WHEN kf > 11 THEN kf - 23 ELSE kf END / 23::DOUBLE / (24::DOUBLE / 45)', 6)} AS wf, {rounded('CASE WHEN kt > 6 THEN kt - 13 ELSE kt END / 13::DOUBLE / 0.25::DOUBLE', 6)} AS wt, {rounded('avg(re * re + im * im)', 4)} AS power
FROM both_ GROUP BY signal_id, kf, kt"""


def _decibels(name: str, window: int, size: int) -> str:
    """Decibels of one window length at the 16 bands from 0.5 to 10 Hz, by linear interpolation between frequencies."""
    step = 24 / size
    first, last = math.ceil(0.5 / step), math.floor(10 / step)
    return f"""{stft(window, 24, size, name=name)}, a_{name} AS (SELECT signal_id, t_idx, k, sqrt(re * re + im * im) AS a FROM {name} WHERE k BETWEEN {first} AND {last}),
    d_{name} AS (SELECT signal_id, t_idx, k, greatest(CASE WHEN a > 0 THEN 20 * log10(greatest(a, 1e-12) / greatest(max(a) OVER (PARTITION BY signal_id), 1e-12)) + 80 ELSE 0 END, 0) AS d FROM a_{name}),
    g_{name} AS (SELECT band, least(greatest(floor(g / {num(step)}), {first}), {last}) AS lo, least(greatest(floor(g / {num(step)}), {first}) + 1, {last}) AS hi, least(greatest(g / {num(step)} - least(greatest(floor(g / {num(step)}), {first}), {last}), 0), 1) AS u FROM grid),
    o_{name} AS (SELECT l.signal_id, l.t_idx, band, l.d + u * (h.d - l.d) AS x FROM g_{name} JOIN d_{name} l ON l.k = lo JOIN d_{name} h ON h.k = hi AND h.signal_id = l.signal_id AND h.t_idx = l.t_idx)"""


ORACLES["q_mean_spectrogram"] = f"""WITH {MULTI}, grid AS (SELECT band, 0.5::DOUBLE + 9.5::DOUBLE * band / 15 AS g FROM range(16) r(band)), {_decibels("short", 49, 50)}, {_decibels("long", 97, 100)},
m AS (SELECT signal_id, t_idx, band, avg(x) AS x, stddev_samp(x) AS sd FROM (SELECT * FROM o_short UNION ALL SELECT * FROM o_long) GROUP BY 1, 2, 3),
q AS (SELECT signal_id, quantile_cont(sd, 0.95) AS top FROM m GROUP BY 1)
SELECT signal_id, CAST(t_idx AS BIGINT) AS t_idx, CAST(band AS BIGINT) AS band, {rounded('x / (1 + exp(3 * (sd / top - 0.5)))', 5)} AS x FROM m JOIN q USING (signal_id)"""

# --- tapers ---------------------------------------------------------------------------------------------------------


def tapered(source: str, size: int, frames: str, nw: float = 3) -> str:
    """Common tables that end in spectra(signal_id, frame, taper, k, re, im); ``frames`` is SQL for f(signal_id, frame, m, x)."""
    tapers = K.dpss(size, nw, int(2 * nw - 1))[0]
    mid = num((size - 1) / 2)
    return f"""f AS ({frames}), {values_table("w", "taper, m, w", [(i, m, v) for i, row in enumerate(tapers) for m, v in enumerate(row)])},
    line AS (SELECT signal_id, frame, avg(x) AS mean, sum(x * (m - {mid})) / sum((m - {mid}) ** 2) AS slope FROM f GROUP BY 1, 2),
    flat AS (SELECT f.signal_id, f.frame, m, x - mean - slope * (m - {mid}) AS x FROM f JOIN line USING (signal_id, frame)),
    spectra AS (SELECT signal_id, frame, taper, k, sum(x * w * cos({angle('k * m', size)})) AS re, -sum(x * w * sin({angle('k * m', size)})) AS im FROM flat JOIN w USING (m) CROSS JOIN range({size // 2 + 1}) g(k) GROUP BY 1, 2, 3, 4)"""


def cut(source: str, size: int, hop: int, count: int) -> str:
    return f"SELECT signal_id, frame, n - frame * {hop} AS m, x FROM range({count}) g(frame) JOIN {source} s ON s.n BETWEEN frame * {hop} AND frame * {hop} + {size - 1}"


ORACLES["q_multitaper_frames"] = f"""WITH {MULTI}, {values_table("w", "taper, j, w", [(i, j, v) for i, row in enumerate(K.dpss(97, 3, 5)[0]) for j, v in enumerate(row)])},
z AS (SELECT s.signal_id, t, taper, k, sum(x * w * cos({angle('k * j', 97)})) AS re, sum(x * w * sin({angle('k * j', 97)})) AS im FROM range(30) r(t) CROSS JOIN w JOIN sig s ON s.n = t * 24 + j - 48 CROSS JOIN range(49) h(k) GROUP BY 1, 2, 3, 4)
SELECT signal_id, CAST(t AS BIGINT) AS t_idx, CAST(k AS BIGINT) AS f_idx, {rounded('avg(re * re + im * im)', 4)} AS power FROM z GROUP BY 1, 2, 3"""

ORACLES["q_multitaper_power"] = f"""WITH {MULTI}, {tapered("sig", 120, cut("sig", 120, 120, 5))}, p AS (SELECT signal_id, frame, k, avg(re * re + im * im) AS p FROM spectra GROUP BY 1, 2, 3)
SELECT signal_id, CAST(k AS INTEGER) AS k, {rounded('k * 24 / 120::DOUBLE', 6)} AS freq, {rounded('avg(p)', 4)} AS power, {rounded('stddev_samp(p)', 4)} AS std FROM p GROUP BY signal_id, k"""


def coherence(keys: str = "") -> str:
    """From spectra to out(keys, a, b, k, re, im, coherence, lower, upper); ``keys`` ends in a comma if given."""
    on = "".join(f" AND q.{c} = p.{c}" for c in keys.replace(",", " ").split())
    own = "".join(f" AND o.{c} = s.{c}" for c in keys.replace(",", " ").split())
    own_b = own.replace("o.", "o2.")
    ks = "".join(f"p.{c}, " for c in keys.replace(",", " ").split())
    return f"""pairs AS (SELECT {ks}p.frame, p.k, p.signal_id AS a, q.signal_id AS b, avg(p.re * q.re + p.im * q.im) AS re, avg(p.re * q.im - p.im * q.re) AS im FROM spectra p JOIN spectra q ON q.frame = p.frame AND q.taper = p.taper AND q.k = p.k{on} AND p.signal_id <= q.signal_id GROUP BY {ks}p.frame, p.k, p.signal_id, q.signal_id),
    summed AS (SELECT *, sum(re) OVER w AS sre, sum(im) OVER w AS sim, count(*) OVER w AS n FROM pairs WINDOW w AS (PARTITION BY {keys} k, a, b)),
    met AS (SELECT s.*, o.re AS pa, o.sre AS spa, o2.re AS pb, o2.sre AS spb FROM summed s JOIN summed o ON o.a = s.a AND o.b = s.a AND o.k = s.k AND o.frame = s.frame{own} JOIN summed o2 ON o2.a = s.b AND o2.b = s.b AND o2.k = s.k AND o2.frame = s.frame{own_b} WHERE s.a < s.b),
    ps AS (SELECT {keys} a, b, k, sre / sqrt(spa * spb) AS cre, sim / sqrt(spa * spb) AS cim,
      n * atanh(least(sqrt(sre ** 2 + sim ** 2) / sqrt(spa * spb), 1 - 1e-12)) - (n - 1) * atanh(least(sqrt((sre - re) ** 2 + (sim - im) ** 2) / sqrt((spa - pa) * (spb - pb)), 1 - 1e-12)) AS g FROM met),
    jack AS (SELECT {keys} a, b, k, max(cre) AS re, max(cim) AS im, avg(g) AS g, sqrt(var_pop(g) / count(*)) AS se FROM ps GROUP BY {keys} a, b, k)"""


def squashed(value: str) -> str:
    return rounded(f"tanh(greatest({value}, 0)) ** 2", 6)


ORACLES["q_multitaper_coherence"] = f"""WITH {MULTI}, {tapered("sig", 120, cut("sig", 120, 60, 11))}, {coherence()}
SELECT a, b, CAST(k AS INTEGER) AS k, {rounded('k * 24 / 120::DOUBLE', 6)} AS freq, {rounded('re', 6)} AS re, {rounded('im', 6)} AS im, {squashed('g')} AS coherence, {squashed('g - 2 * se')} AS lower, {squashed('g + 2 * se')} AS upper FROM jack"""

#: Halves by the first bit of an MD5, per permutation and trial.
HALVES = """trials AS (SELECT signal_id || '-' || CAST(n // 240 AS INTEGER) AS trial, CAST(n % 240 AS INTEGER) AS n, x FROM sig),
means AS (SELECT CAST(perm AS INTEGER) AS perm, CASE WHEN substr(md5('0|' || perm || '|' || trial), 1, 1) < '8' THEN 'a' ELSE 'b' END AS signal_id, n, avg(x) AS x FROM trials CROSS JOIN range(2) g(perm) GROUP BY 1, 2, 3)"""


def _with_key(sql: str, key: str) -> str:
    """The taper tables with a further key beside the signal's name."""
    return sql.replace("signal_id, frame", f"{key}, signal_id, frame").replace("f.perm, signal_id, frame", "f.perm, f.signal_id, f.frame").replace("SELECT f.signal_id, f.frame", f"SELECT f.{key}, f.signal_id, f.frame").replace("GROUP BY 1, 2, 3, 4", "GROUP BY 1, 2, 3, 4, 5").replace("GROUP BY 1, 2)", "GROUP BY 1, 2, 3)")


ORACLES["q_split_half_coherence"] = f"""WITH {MULTI}, {HALVES}, {_with_key(tapered("means", 48, cut("means", 48, 24, 9)), "perm")}, {coherence("perm,")}
SELECT perm, CAST(k AS INTEGER) AS k, {rounded('k * 24 / 48::DOUBLE', 6)} AS freq, {squashed('g')} AS coherence FROM jack"""

# --- correlograms ---------------------------------------------------------------------------------------------------


def correlogram(name: str, a: str, b: str) -> str:
    return f"""{name} AS (SELECT lag, sum(p.x * q.x) / ({HOURS} - abs(lag)) AS cf FROM range(-24, 25) r(lag) JOIN z p ON p.signal_id = '{a}' JOIN z q ON q.signal_id = '{b}' AND q.n = p.n + lag GROUP BY 1)"""


CENTERED = "z AS (SELECT signal_id, n, (x - avg(x) OVER w) / stddev_samp(x) OVER w AS x FROM sig WINDOW w AS (PARTITION BY signal_id))"


def dft49(source: str, column: str = "cf", count: int = 49) -> str:
    """(k, re, im) of a correlogram whose lag 0 comes first."""
    turn = angle("(k * lag) % 49 + 49", 49)
    return f"(SELECT k, sum({column} * cos({turn})) AS re, -sum({column} * sin({turn})) AS im FROM {source} CROSS JOIN range({count}) g(k) GROUP BY 1)"


ORACLES["q_lag_coherency"] = f"""WITH {MULTI}, {CENTERED}, {correlogram("c", "click", "view")}, {correlogram("a", "click", "click")}, {correlogram("b", "view", "view")},
s AS (SELECT k, c.re / sqrt(sqrt(a.re ** 2 + a.im ** 2) * sqrt(b.re ** 2 + b.im ** 2)) AS re, c.im / sqrt(sqrt(a.re ** 2 + a.im ** 2) * sqrt(b.re ** 2 + b.im ** 2)) AS im FROM {dft49("c")} c JOIN {dft49("a")} a USING (k) JOIN {dft49("b")} b USING (k))
SELECT CAST(lag AS INTEGER) AS lag, {rounded(f"sum(re * cos({angle('(k * lag) % 49 + 49', 49)}) - im * sin({angle('(k * lag) % 49 + 49', 49)})) / 49", 6)} AS coherency FROM s CROSS JOIN range(-24, 25) r(lag) GROUP BY 1"""

HANN49 = f"(0.5 - 0.5 * cos({TAU!r} * (lag + 24) / 48))"
ORACLES["q_wiener_filter"] = f"""WITH {MULTI}, {CENTERED}, {correlogram("c", "click", "view")}, {correlogram("a", "click", "click")}, cw AS (SELECT lag, cf * {HANN49} AS cf FROM c), aw AS (SELECT lag, cf * {HANN49} AS cf FROM a)
SELECT CAST(k AS INTEGER) AS k, {rounded('c.re / sqrt(a.re ** 2 + a.im ** 2)', 6)} AS re, {rounded('c.im / sqrt(a.re ** 2 + a.im ** 2)', 6)} AS im, {rounded('(c.re ** 2 + c.im ** 2) / (sqrt(a.re ** 2 + a.im ** 2) * sqrt(b.re ** 2 + b.im ** 2))', 6)} AS coherence
FROM {dft49("cw", count=25)} c JOIN {dft49("aw", count=25)} a USING (k) JOIN {dft49("bw", count=25)} b USING (k)""".replace("cw AS (", f"{correlogram('b', 'view', 'view')}, bw AS (SELECT lag, cf * {HANN49} AS cf FROM b), cw AS (")

ORACLES["q_acf_spectrum"] = f"""WITH {MULTI}, {CENTERED}, {correlogram("a", "click", "click")} SELECT CAST(k AS INTEGER) AS k, {rounded('re * re + im * im', 6)} AS power FROM {dft49("a", count=25)}"""

# --- prediction -----------------------------------------------------------------------------------------------------


def _det(m: list[list[str]]) -> str:
    (a, b, c), (d, e, f), (g, h, i) = m
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


_G = [["g11", "g12", "g13"], ["g12", "g22", "g23"], ["g13", "g23", "g33"]]
_SOLVE = ", ".join(f"{_det([[('b' + str(r + 1)) if c == k else _G[r][c] for c in range(3)] for r in range(3)])} / {_det(_G)} AS w{k + 1}" for k in range(3))
ORACLES["q_whiten"] = f"""WITH {MULTI}, z AS (SELECT signal_id, n, x - avg(x) OVER (PARTITION BY signal_id) AS x FROM sig),
l AS (SELECT signal_id, n, x, lag(x, 1) OVER w AS l1, lag(x, 2) OVER w AS l2, lag(x, 3) OVER w AS l3 FROM z WINDOW w AS (PARTITION BY signal_id ORDER BY n)),
s AS (SELECT signal_id, {", ".join(f"sum(l{i} * l{j}) AS g{i}{j}" for i in (1, 2, 3) for j in range(i, 4))}, {", ".join(f"sum(l{i} * x) AS b{i}" for i in (1, 2, 3))} FROM l WHERE l3 IS NOT NULL GROUP BY 1),
w AS (SELECT signal_id, {_SOLVE} FROM s)
SELECT signal_id, n, {rounded('x - w1 * l1 - w2 * l2 - w3 * l3', 5)} AS x FROM l JOIN w USING (signal_id) WHERE l3 IS NOT NULL"""

ORACLES["q_linear_prediction"] = f"""WITH {MULTI}, r AS (SELECT a.signal_id, sum(a.x * a.x) AS r0, sum(a.x * b.x) AS r1, sum(a.x * c.x) AS r2 FROM sig a LEFT JOIN sig b ON b.signal_id = a.signal_id AND b.n = a.n + 1 LEFT JOIN sig c ON c.signal_id = a.signal_id AND c.n = a.n + 2 GROUP BY 1)
SELECT signal_id, 1.0::DOUBLE AS a0, {rounded('-r1 * (r0 - r2) / (r0 * r0 - r1 * r1)', 6)} AS a1, {rounded('-(r0 * r2 - r1 * r1) / (r0 * r0 - r1 * r1)', 6)} AS a2 FROM r"""

# --- files, neighbours ----------------------------------------------------------------------------------------------

ORACLES["q_wav_round_trip"] = f"""WITH {MULTI}, top AS (SELECT signal_id, max(abs(x)) AS top FROM sig GROUP BY 1)
SELECT signal_id, CAST(24 AS DOUBLE) AS sr, CAST(count(*) AS BIGINT) AS samples, CAST(max(abs(trunc(x / top * 32767))) AS DOUBLE) AS peak, CAST(sum(trunc(x / top * 32767)) AS DOUBLE) AS total FROM sig JOIN top USING (signal_id) GROUP BY 1"""
