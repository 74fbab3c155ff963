"""Data profile, segments and preprocessing."""

from __future__ import annotations

from breakwater.plans.family import family

_MED = ("med", "SELECT id, period, PCT(value, 0.5) AS med FROM {seg} GROUP BY id, period")
_MAD = ("mad", "SELECT s.id, s.period, max(med) AS med, PCT(abs(value - med), 0.5) AS mad FROM {seg} s JOIN {med} m ON s.id = m.id AND s.period = m.period GROUP BY s.id, s.period")
_EACH = "SELECT s.id, s.seq, s.period, {} FROM {{seg}} s JOIN {{{}}} m ON s.id = m.id AND s.period = m.period"
_SUPPLIER_LABEL = ("lab", "SELECT s_suppkey AS id, CASE WHEN s_acctbal < 0 THEN 1 ELSE 0 END AS y FROM {sup}")

FAMILIES = [
    family("dataset_profile", _SUPPLIER_LABEL, "SELECT BIG(count(DISTINCT s.id)) AS n_series, BIG(count(*)) AS n_points, BIG(count(DISTINCT CASE WHEN y = 1 THEN s.id END)) AS n_breaks, R(DIV(count(DISTINCT CASE WHEN y = 1 THEN s.id END), count(DISTINCT s.id))) AS break_rate FROM {seg} s LEFT JOIN {lab} l ON s.id = l.id", seg="seg_suppliers", sup="supplier"),
    family("label_balance", "SELECT quality, toxic, BIG(count(*)) AS n, R(count(*) / DBL(sum(count(*)) OVER ())) AS share FROM {lab} GROUP BY quality, toxic", lab="labels"),
    family("first_label", "SELECT user_id AS id, MINBY(event_type, event_id) AS label FROM {ev} GROUP BY user_id", ev="events"),
    family("per_label_stats", _SUPPLIER_LABEL, ("per_id", "SELECT id, avg(abs(value)) AS mean_abs, var_samp(value) AS variance FROM {seg} GROUP BY id"), "SELECT y, BIG(count(*)) AS n, R(avg(mean_abs)) AS mean_abs, R(avg(variance)) AS variance FROM {per_id} p JOIN {lab} l ON p.id = l.id GROUP BY y", seg="seg_suppliers", sup="supplier"),
    family("series_lengths", "SELECT id, BIG(count(*)) AS n, BIG(PRE(count(*))) AS n_pre, BIG(POST(count(*))) AS n_post FROM {seg} GROUP BY id"),
    family("series_lengths_users", "SELECT id, BIG(count(*)) AS n, BIG(PRE(count(*))) AS n_pre, BIG(POST(count(*))) AS n_post FROM {seg} GROUP BY id", seg="seg_users"),
    family("segment_split", "SELECT id, seq, period, pos, R(value) AS value FROM {seg}"),
    family("boundary_windows", "SELECT id, scope, period, BIG(count(*)) AS n, BIG(min(seq)) AS first_seq, BIG(max(seq)) AS last_seq, R(avg(value)) AS mean FROM {x} GROUP BY id, scope, period", x="scoped_suppliers"),
    family("robust_scale", _MED, _MAD, _EACH.format("R((value - med) / (mad + 1e-8)) AS scaled", "mad")),
    family("clip_outliers", _MED, _MAD, _EACH.format("R(least(greatest(value, med - 5 * (mad + 1e-8)), med + 5 * (mad + 1e-8))) AS clipped", "mad")),
    family("robust_scale_factor", _MED, _MAD, "SELECT id, period, R(CASE WHEN 1.4826 * mad < 1e-12 THEN DBL(1) ELSE 1.4826 * mad END) AS scale FROM {mad}"),
    family("robust_zscore", _MED, _MAD, _EACH.format("R((value - med) / CASE WHEN 1.4826 * mad < 1e-12 THEN DBL(1) ELSE 1.4826 * mad END) AS z", "mad")),
    family("detrend", ("ix", "SELECT id, seq, period, value, DBL(row_number() OVER (PARTITION BY id, period ORDER BY seq) - 1) AS t FROM {seg}"), ("fit", "SELECT id, period, regr_slope(value, t) AS b, regr_intercept(value, t) AS a FROM {ix} GROUP BY id, period"), "SELECT s.id, s.seq, s.period, R(CASE WHEN b IS NULL THEN value ELSE value - a - b * t END) AS residual FROM {ix} s JOIN {fit} f ON s.id = f.id AND s.period = f.period"),
    family("winsorize", ("q", "SELECT id, period, PCT(value, 0.05) AS lo, PCT(value, 0.95) AS hi FROM {seg} GROUP BY id, period"), _EACH.format("R(least(greatest(value, lo), hi)) AS clipped", "q")),
    family("prestandardize", ("q", "SELECT id, avg(value) AS m, stddev_pop(value) AS sd FROM {seg} WHERE period = 0 GROUP BY id"), "SELECT s.id, s.seq, s.period, R(CASE WHEN sd < 1e-10 THEN DBL(0) ELSE DIV(value - m, sd) END) AS z FROM {seg} s JOIN {q} q ON s.id = q.id"),
    family("prewinsor_standardize", ("q", "SELECT id, PCT(value, 0.01) AS lo, PCT(value, 0.99) AS hi FROM {seg} WHERE period = 0 GROUP BY id"), ("c", "SELECT s.id, seq, period, least(greatest(value, lo), hi) AS v FROM {seg} s JOIN {q} q ON s.id = q.id"), ("f", "SELECT id, avg(v) AS m, stddev_pop(v) AS sd FROM {c} WHERE period = 0 GROUP BY id"), "SELECT c.id, c.seq, c.period, R(CASE WHEN sd < 1e-10 THEN DBL(0) ELSE DIV(v - m, sd) END) AS z FROM {c} c JOIN {f} f ON c.id = f.id"),
    family("prestandardize_sample", ("q", "SELECT id, avg(value) AS m, stddev_samp(value) AS sd FROM {seg} WHERE period = 0 GROUP BY id"), "SELECT s.id, s.seq, s.period, R(CASE WHEN coalesce(sd, 0) < 1e-8 THEN value - m ELSE DIV(value - m, sd) END) AS z, CASE WHEN coalesce(sd, 0) < 1e-8 THEN 1 ELSE 0 END AS constant_pre FROM {seg} s JOIN {q} q ON s.id = q.id", seg="seg_users"),
]
