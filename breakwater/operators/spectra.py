"""Statistics of spectra and wavelet coefficients, compression and reconstruction.

Spectra come from one small function of an array (the oracle sums sines and cosines instead);
their shape, and wavelet transforms as a whole, are SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breakwater.functions import arrays
from breakwater.operators import pooled
from breakwater.plans.family import dealt, family, spread, way

PI = "3.141592653589793"
SQRT2 = "1.4142135623730951"
X = {"x": "scoped_suppliers"}
KEYS = "id, scope, period"

# Each scope's segments by the first one's mean and deviation, with the place t in the segment.
_SIZES = ("sn", "SELECT id, scope, BIG(PRE(count(*))) AS n0, BIG(POST(count(*))) AS n1, PRE(avg(value)) AS m, PRE(stddev_pop(value)) AS sd FROM {x} GROUP BY id, scope", way(lambda have: pooled.sizes(have["x"]), "x"))


def _standard(least: int) -> tuple[str, str]:
    return ("sz", f"SELECT x.id, x.scope, period, seq, CASE WHEN period = 0 THEN n0 ELSE n1 END AS n, CASE WHEN period = 0 THEN n0 - pos ELSE pos - 1 END AS t, CASE WHEN sd < 1e-10 THEN 0 ELSE (value - m) / sd END AS value FROM {{x}} x JOIN {{sn}} s ON x.id = s.id AND x.scope = s.scope WHERE least(n0, n1) >= {least}")


def _terms(rows: DataFrame, keys: list[str], function) -> DataFrame:
    """``keys, n, k, p``: the function's array of each segment, a row for each frequency."""
    one = dealt(rows).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("t", F.col("value").cast("double").alias("v")))).alias("s"))
    xs = F.transform("s", lambda p: p["v"])
    return one.select(*keys, F.size("s").cast("long").alias("n"), F.posexplode(function(xs)).alias("k", "p")).select(*keys, "n", F.col("k").cast("long").alias("k"), "p")


def _wave(source: str, keys: str, window: str, below: str) -> str:
    """Sums of sines and cosines at each frequency of each segment."""
    turn = f"2 * {PI} * ((k * t) % n) / n"
    return f"SELECT {keys}, n, k, power(sum(value * {window} * cos({turn})), 2) + power(sum(value * {window} * sin({turn})), 2) AS p FROM {{{source}}} CROSS JOIN (SELECT unnest(range(0, (SELECT max(n) FROM {{{source}}}))) AS k) f WHERE {below} GROUP BY {keys}, n, k"


_POWER = ("pw", _wave("sz", KEYS, f"(0.5 - 0.5 * cos(2 * {PI} * t / (n - 1)))", "k <= n // 2"), lambda have: _terms(have["sz"], KEYS.split(", "), arrays.power))
_SHARE = ("pn", f"SELECT {KEYS}, k, k * (DBL(1) / n) AS f, p / (sum(p) OVER (PARTITION BY {KEYS}) + 1e-12) AS q FROM {{pw}}")
_RUN = ("pc", f"SELECT {KEYS}, k, f, q, sum(q) OVER (PARTITION BY {KEYS} ORDER BY k) AS c, lead(q) OVER (PARTITION BY {KEYS} ORDER BY k) AS nx, sum(f * q) OVER (PARTITION BY {KEYS}) AS centre FROM {{pn}}")
SHAPE = {
    "log_low_high": "LN((sum(CASE WHEN f <= 0.08 THEN q ELSE 0 END) + 1e-12) / (sum(CASE WHEN f > 0.08 THEN q ELSE 0 END) + 1e-12))",
    "spec_entropy": "-sum((q + 1e-12) * LN(q + 1e-12)) / LN(DBL(count(*)))",
    "peak_ratio": "max(CASE WHEN k >= 1 THEN q END)",
    "flatness": "exp(avg(LN(q + 1e-12))) / avg(q + 1e-12)",
    "flux": "avg(power(nx - q, 2))",
    "rolloff50": "coalesce(min(CASE WHEN c >= 0.5 THEN f END), max(f))",
    "bandwidth": "sqrt(sum(power(f - centre, 2) * q))",
    "hf_power": "sum(CASE WHEN f > 0.15 THEN q ELSE 0 END)",
}
_FORM = ("ps", f"SELECT {KEYS}, " + ", ".join(f"{e} AS {n}" for n, e in SHAPE.items()) + f" FROM {{pc}} GROUP BY {KEYS}", way(lambda have: pooled.spectral_shapes(have["x"], list(SHAPE), 8), "x"))
_FORMS = ("pf", "SELECT s.id, s.scope, s.n0, s.n1, " + ", ".join(f"max(CASE WHEN period = {i} THEN {n} END) AS {n}{i}" for n in SHAPE for i in (0, 1)) + " FROM {sn} s LEFT JOIN {ps} p ON s.id = p.id AND s.scope = p.scope GROUP BY s.id, s.scope, s.n0, s.n1")
_SPECTRAL = {}
for _n in ("log_low_high", "spec_entropy"):
    _SPECTRAL |= {f"{_n}_pre": f"coalesce({_n}0, 0)", f"{_n}_post": f"coalesce({_n}1, 0)"}
for _n in SHAPE:
    _SPECTRAL[f"delta_{_n}"] = f"coalesce({_n}1 - {_n}0, 0)" if _n in ("log_low_high", "spec_entropy") else f"CASE WHEN least(n0, n1) >= 16 THEN {_n}1 - {_n}0 ELSE 0 END"

# Amplitudes of whole segments as they are, compared as far as both go.
_PLAIN = ("sa", "SELECT id, period, CASE WHEN period = 0 THEN count(*) OVER (PARTITION BY id, period) - pos ELSE pos - 1 END AS t, count(*) OVER (PARTITION BY id, period) AS n, value FROM {seg}")
_AMPLITUDE = ("am", "SELECT id, period, n, k, sqrt(p) AS p FROM (" + _wave("sa", "id, period", "1", "k < n // 2 AND n > 1") + ") z", lambda have: _terms(have["sa"], ["id", "period"], arrays.amplitude))
_SHARES = ("ah", "SELECT id, period, k, p / (sum(p) OVER (PARTITION BY id, period) + 1e-8) AS q FROM {am}")
_BOTH = ("ab", "SELECT a.id, a.k, a.q AS p, b.q AS q, count(*) OVER (PARTITION BY a.id) AS n FROM {ah} a JOIN {ah} b ON a.id = b.id AND a.k = b.k AND a.period = 0 AND b.period = 1")
_APART = (
    "ad",
    "SELECT id, sum(abs(p - q)) AS l1, sum((p + 1e-8) * LN((p + 1e-8) / (q + 1e-8))) AS kl, abs(MAXBY(k, q) - MAXBY(k, p)) / DBL(max(n)) AS shift, coalesce(sum(CASE WHEN k < floor(n / 4) THEN q * q END), 0) / (coalesce(sum(CASE WHEN k < floor(n / 4) THEN p * p END), 0) + 1e-8) AS low FROM {ab} GROUP BY id",
)
_IDS = ("ids", "SELECT DISTINCT id FROM {seg}")

# Wavelets. The low-pass decomposition filter with four vanishing moments.
DB4 = (-0.010597401785069032, 0.0328830116668852, 0.030841381835560764, -0.18703481171909309, -0.027983769416859854, 0.6308807679298589, 0.7148465705529157, 0.2303778133088965)


def _filtered(xs: str, high: bool) -> str:
    """One step of the transform with half-point symmetric extension: every second value of the filtered array."""
    taps = [(-1) ** (j + 1) * DB4[7 - j] for j in range(8)] if high else DB4
    turn = f"(2 * LEN({xs}))"
    place = lambda j: f"((2 * k + {1 - j} + {turn}) % {turn})"
    terms = " + ".join(f"{h!r} * ITEM({xs}, least({place(j)}, {turn} - 1 - {place(j)}))" for j, h in enumerate(taps))
    return f"OVER(0, floor((LEN({xs}) + 7) / 2) - 1, {terms})"


def _steps(start: str, keys: str) -> tuple[tuple, ...]:
    """Steps that end in ``w3``: approximation ``a3`` and details ``d1`` (the finest) to ``d3`` of an array ``a0``."""
    made, have = [], []
    source = start
    for level in (1, 2, 3):
        above = f"a{level - 1}"
        made.append((f"w{level}", f"SELECT {', '.join([keys, *have])}, {_filtered(above, False)} AS a{level}, {_filtered(above, True)} AS d{level} FROM {{{source}}}"))
        have.append(f"d{level}")
        source = f"w{level}"
    return tuple(made)


def _energy(xs: str) -> str:
    return f"FOLD(0, LEN({xs}) - 1, 0, acc + ITEM({xs}, k) * ITEM({xs}, k))"


_SERIES = spread(("wa", f"SELECT {KEYS}, SERIES(value, seq, period >= 0) AS a0 FROM {{sz}} GROUP BY {KEYS}"), "sz")
_ENERGIES = ("we", f"SELECT {KEYS}, {_energy('d1')} AS e1, {_energy('d2')} AS e2, {_energy('d3')} AS e3 FROM {{w3}}", way(lambda have: pooled.wavelet_energies(have["x"], DB4, 16), "x"))
_WSHARES = ("wh", f"SELECT {KEYS}, e1, e2, e3, e1 / (e1 + e2 + e3 + 1e-12) AS h1, e2 / (e1 + e2 + e3 + 1e-12) AS h2, e3 / (e1 + e2 + e3 + 1e-12) AS h3 FROM {{we}}")
_WSTATS = ("ws", f"SELECT {KEYS}, -(h1 * LN(h1 + 1e-12) + h2 * LN(h2 + 1e-12) + h3 * LN(h3 + 1e-12)) / LN(DBL(3)) AS entropy, h3 AS low_energy_share, h1 AS high_energy_share, LN(e1 + 1e-12) AS l1, LN(e2 + 1e-12) AS l2, LN(e3 + 1e-12) AS l3 FROM {{wh}}")
_WNAMES = ("entropy", "low_energy_share", "high_energy_share", "l1", "l2", "l3")
_WSIDES = ("wf", "SELECT s.id, s.scope, " + ", ".join(f"coalesce(max(CASE WHEN period = {i} THEN {n} END), 0) AS {n}{i}" for n in _WNAMES for i in (0, 1)) + " FROM {sn} s LEFT JOIN {ws} w ON s.id = w.id AND s.scope = w.scope GROUP BY s.id, s.scope")
_WAVELET = {f"wav_{n}_{s}": f"{n}{i}" for n in _WNAMES[:3] for i, s in ((0, "pre"), (1, "post"))} | {f"delta_wav_{n}": f"{n}1 - {n}0" for n in _WNAMES[:3]} | {f"delta_wav_energy_{n}": f"{n}1 - {n}0" for n in _WNAMES[3:]}

# All levels of whole segments: the approximation, and details from the coarsest (d1) to the finest (d3).
_FULL = spread(("fa", "SELECT id, period, SERIES(value, seq, period >= 0) AS raw FROM {seg} GROUP BY id, period"), "seg")
_PADDED = ("fp", "SELECT id, period, OVER(0, greatest(LEN(raw), 8) - 1, ITEM(raw, least(k, LEN(raw) - 1))) AS a0 FROM {fa}")
_LEVELS = ("fl", " UNION ALL ".join(f"SELECT id, period, '{n}' AS lv, {c} AS c FROM {{w3}}" for n, c in (("a", "a3"), ("d1", "d3"), ("d2", "d2"), ("d3", "d1"))))
_LSUMS = ("fs", f"SELECT id, period, lv, c, DBL(LEN(c)) AS n, {_energy('c')} AS energy, FOLD(0, LEN(c) - 1, 0, acc + ITEM(c, k)) AS s, FOLD(0, LEN(c) - 1, 0, acc + abs(ITEM(c, k))) AS size FROM {{fl}}")
_LSTATS = ("ft", "SELECT id, period, lv, energy, sqrt(greatest(energy / n - power(s / n, 2), 0)) AS std, size / n AS mean_abs, CASE WHEN energy > 0 THEN FOLD(0, LEN(c) - 1, 0, acc - (CASE WHEN power(ITEM(c, k), 2) / energy > 0 THEN power(ITEM(c, k), 2) / energy * LN(power(ITEM(c, k), 2) / energy) ELSE 0 END)) ELSE 0 END AS entropy, sum(energy) OVER (PARTITION BY id, period) AS total FROM {fs}")
_LNAMES = ("energy", "std", "mean_abs", "entropy", "energy_pct")


def _level(lv: str, name: str, side: int) -> str:
    value = "energy / (total + 1e-8)" if name == "energy_pct" else name
    return f"max(CASE WHEN lv = '{lv}' AND period = {side} THEN {value} END)"


_LCOLUMNS = {f"{lv}_{n}{i}": _level(lv, n, i) for lv in ("a", "d1", "d2", "d3") for n in _LNAMES for i in (0, 1)} | {f"total_energy{i}": f"max(CASE WHEN period = {i} THEN total END)" for i in (0, 1)}
_LWIDE = ("fw", "SELECT id, " + ", ".join(f"{e} AS {n}" for n, e in _LCOLUMNS.items()) + " FROM {ft} GROUP BY id")
_WLEVELS = {}
for _k in [f"{lv}_{n}" for lv in ("a", "d1", "d2", "d3") for n in _LNAMES] + ["total_energy"]:
    _WLEVELS |= {f"wavelet_{_k}_ratio": f"{_k}1 / ({_k}0 + 1e-8)", f"wavelet_{_k}_diff": f"{_k}1 - {_k}0", f"wavelet_{_k}_abs_change": f"abs({_k}1 - {_k}0)"}
_WLEVELS |= {f"wavelet_{lv}_energy_shift": f"{lv}_energy_pct1 - {lv}_energy_pct0" for lv in ("a", "d1", "d2", "d3")}

# The two-point transform; a value past the end is zero, which is what padding to a power of two gives.
HAAR = 5
_HAAR_STEPS = []
for _l in range(1, HAAR + 1):
    _a, _from = f"a{_l - 1}", "hz" if _l == 1 else f"h{_l - 1}"
    _old = "".join(f", d{i}" for i in range(1, _l))
    _end = f"ceil(LEN({_a}) / 2) - 1"
    _pair = f"(ITEM({_a}, 2 * k) {{}} coalesce(ITEM({_a}, 2 * k + 1), 0)) / {SQRT2}"
    _HAAR_STEPS.append((f"h{_l}", f"SELECT id, period{_old}, OVER(0, {_end}, {_pair.format('+')}) AS a{_l}, OVER(0, CASE WHEN LEN({_a}) > 1 THEN {_end} ELSE -1 END, {_pair.format('-')}) AS d{_l} FROM {{{_from}}}"))
_HAAR_START = ("hz", "SELECT id, period, SERIES(value, seq, period >= 0) AS a0 FROM {sz} WHERE scope = 'full' GROUP BY id, period")
_HAAR_E = ("he", "SELECT id, period, " + ", ".join(f"CASE WHEN LEN(d{i}) > 0 THEN {_energy(f'd{i}')} ELSE 0 END AS e{i}" for i in range(1, HAAR + 1)) + f" FROM {{h{HAAR}}}")
_HAAR_ALL = "(" + " + ".join(f"e{i}" for i in range(1, HAAR + 1)) + " + 1e-12)"
_HAAR = {f"haar_share_l{i}_{s}": f"coalesce(V{k}(e{i} / {_HAAR_ALL}), 0)" for i in range(1, HAAR + 1) for k, s in ((0, "pre"), (1, "post"))} | {f"delta_haar_share_l{i}": f"coalesce(V1(e{i} / {_HAAR_ALL}), 0) - coalesce(V0(e{i} / {_HAAR_ALL}), 0)" for i in range(1, HAAR + 1)}


def _r8(pairs: dict[str, str], keys: str) -> str:
    return keys + ", " + ", ".join(f"R8({e}) AS {n}" for n, e in pairs.items())


# Compression: sizes of deflated segments, halves, joined segments and surroundings of the boundary.
def _deflated(x: DataFrame) -> DataFrame:
    """``id, scope, n0, n1, near, s, z0, z1``: sizes in the order whole (2), halves (4), joined, near (2), near joined; phrases."""
    side = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("period") == k, F.struct("seq", F.col("value").cast("double").alias("v"))))), lambda p: p["v"])
    both = dealt(x).groupBy("id", "scope").agg(side(0).alias("a"), side(1).alias("b"))
    half = lambda c: (F.slice(c, 1, F.floor(F.size(c) / 2).cast("int")), F.slice(c, F.floor(F.size(c) / 2).cast("int") + 1, F.size(c)))
    both = both.withColumn("near", F.least(F.lit(100), F.floor(F.size("a") / 4), F.floor(F.size("b") / 4)).cast("int"))
    last, first = F.slice("a", F.size("a") - F.col("near") + 1, F.col("near")), F.slice("b", 1, F.col("near"))
    parts = F.array("a", "b", *half(F.col("a")), *half(F.col("b")), F.concat("a", "b"), last, first, F.concat(last, first))
    return both.select("id", "scope", F.size("a").alias("n0"), F.size("b").alias("n1"), "near", arrays.deflated(parts).alias("s"), arrays.phrases("a").alias("z0"), arrays.phrases("b").alias("z1"))


def _ncd(a: int, b: int, both: int) -> str:
    return f"least(greatest(DBL(s[{both}] - least(s[{a}], s[{b}])) / greatest(s[{a}], s[{b}]), 0), 1)"


_WHOLE = f"CASE WHEN n0 > 0 AND n1 > 0 THEN {_ncd(0, 1, 6)} ELSE DBL(1) END"
_RATE = {"r0": "coalesce(DIV(s[0], 4 * n0), 1)", "r1": "coalesce(DIV(s[1], 4 * n1), 1)"}
for _i in (0, 1):
    _lo, _hi = 2 + 2 * _i, 3 + 2 * _i
    _RATE[f"u{_i}"] = f"CASE WHEN n{_i} >= 100 THEN abs(s[{_lo}] / DBL(4 * floor(n{_i} / 2)) - s[{_hi}] / DBL(4 * (n{_i} - floor(n{_i} / 2)))) ELSE DBL(0) END"
_RATES = ("cr", "SELECT id, scope, n0, n1, near, z0, z1, " + ", ".join(f"{e} AS {n}" for n, e in _RATE.items()) + f", {_WHOLE} AS whole, CASE WHEN near > 10 THEN {_ncd(7, 8, 9)} ELSE {_WHOLE} END AS edge FROM {{cs}}")
_COMPRESSION = {
    "zlib_pre": "r0", "zlib_post": "r1", "zlib_diff": "r1 - r0", "zlib_ratio": "r1 / (r0 + 1e-8)", "compressibility_increase": "r0 - r1",
    "lz_complexity_pre": "DBL(1)", "lz_complexity_post": "DBL(1)", "lz_complexity_diff": "DBL(0)", "lz_complexity_ratio": "1 / (1 + 1e-8)",
    "lz_density_pre": "DBL(1) / (n0 + 1)", "lz_density_post": "DBL(1) / (n1 + 1)", "lz_density_diff": "DBL(1) / (n1 + 1) - DBL(1) / (n0 + 1)",
    "ncd_pre_post": "whole", "ncd_boundary": "edge", "zlib_pre_consistency": "u0", "zlib_post_consistency": "u1", "zlib_consistency_change": "u1 - u0", "lz76_pre": "DBL(z0)", "lz76_post": "DBL(z1)",
}


def _rebuilt(rows: DataFrame) -> DataFrame:
    side = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("period") == k, F.struct("seq", F.col("value").cast("double").alias("v"))))), lambda p: p["v"])
    both = dealt(rows.where("scope = 'full'")).groupBy("id").agg(side(0).alias("a"), side(1).alias("b"))
    return both.select("id", arrays.rebuilt("a", "b").alias("e"))


_RECONSTRUCTION = {"ae_recon_error_pre": "e[0]", "ae_recon_error_post": "e[1]", "ae_recon_error_ratio": "e[1] / (e[0] + 1e-8)", "ae_recon_error_diff": "e[1] - e[0]"}

FAMILIES = [
    family("spectral", _SIZES, _standard(8), _POWER, _SHARE, _RUN, _FORM, _FORMS, "SELECT " + _r8(_SPECTRAL, "id, scope") + " FROM {pf}", **X),
    family("spectral_advanced", _PLAIN, _AMPLITUDE, _SHARES, _BOTH, _APART, _IDS, "SELECT x.id, R8(coalesce(l1, 0)) AS spectral_l1_distance, R8(coalesce(kl, 0)) AS spectral_kl_divergence, R8(coalesce(shift, 0)) AS spectral_dominant_freq_shift, R(coalesce(low, 1)) AS spectral_low_freq_ratio FROM {ids} x LEFT JOIN {ad} d ON x.id = d.id"),
    family("wavelet", _SIZES, _standard(16), _SERIES, *_steps("wa", KEYS), _ENERGIES, _WSHARES, _WSTATS, _WSIDES, "SELECT " + _r8(_WAVELET, "id, scope") + " FROM {wf}", **X),
    family("wavelet_levels", _FULL, _PADDED, *_steps("fp", "id, period"), _LEVELS, _LSUMS, _LSTATS, _LWIDE, "SELECT id, " + ", ".join(f"R({e}) AS {n}" for n, e in _WLEVELS.items()) + " FROM {fw}"),
    family("haar_dwt", _SIZES, _standard(1), _HAAR_START, *_HAAR_STEPS, _HAAR_E, "SELECT " + _r8(_HAAR, "id") + " FROM {he} GROUP BY id", **X),
]
#: Families with a function that DuckDB lacks; tests compare them with brute force.
PLAIN = [
    family("compression", ("cs", "", lambda have: _deflated(have["x"])), _RATES, "SELECT " + _r8(_COMPRESSION, "id, scope") + " FROM {cr}", **X),
    family("autoencoder_substitute", _SIZES, _standard(1), ("rb", "", lambda have: _rebuilt(have["sz"])), "SELECT " + _r8(_RECONSTRUCTION, "id") + " FROM {rb}", **X),
]
