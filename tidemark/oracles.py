"""SQL that the registered queries are held against."""

from __future__ import annotations

from tidemark.queries import BETA, BLOCKS, HOURS, LAG, LAM, MANY, PAIR_BETA, PAIR_LAM, PALETTE, PAST, REASSIGN, SPLIT_SEED, TYPES, K, N, W

_LAST = HOURS - W  # the last window
_KEYS = ", ".join(f"({i}, '{t}')" for i, t in enumerate(TYPES))
_PARTS: dict[str, str] = {
    "x": f"""SELECT t, i::INT AS s, round(coalesce(v, 0), 4) AS v
        FROM (SELECT unnest(range(0, {HOURS})) AS t) CROSS JOIN (VALUES {_KEYS}) AS k(i, event_type)
        LEFT JOIN (SELECT (floor(epoch(ts) / 3600) - 473352)::BIGINT AS t, event_type, sum(value) AS v FROM events GROUP BY ALL) USING (t, event_type)""",
    "y": "SELECT t, s, (v - avg(v) OVER p) / nullif(max(v) OVER p - min(v) OVER p, 0) AS v FROM x WINDOW p AS (PARTITION BY s)",
    "st": f"""SELECT a.t, k::INT AS k, a.s, (k * {N} + a.s)::INT AS d, coalesce(b.v, 0) AS v, ((a.t // 120) % {K})::INT AS c
        FROM y a CROSS JOIN (SELECT unnest(range(0, {W})) AS k) LEFT JOIN y b ON b.t = a.t + k AND b.s = a.s AND b.t <= {_LAST} WHERE a.t <= {_LAST}""",
    "cov": "SELECT a.c AS cluster, a.d AS i, b.d AS j, covar_samp(a.v, b.v) AS v, covar_pop(a.v, b.v) AS p FROM st a JOIN st b USING (t) GROUP BY ALL",
    "theta": f"SELECT cluster, i % {N} AS s, 1 / (avg(v) + {LAM}) AS q FROM cov WHERE i = j GROUP BY ALL",
    "mu": "SELECT c AS cluster, d, avg(v) AS m FROM st GROUP BY ALL",
    "ld": f"SELECT cluster, -{W} * sum(ln(q)) AS ld FROM theta GROUP BY ALL",
    "cost": f"""SELECT t, cluster, CASE WHEN t > {_LAST - W + 1} THEN 0 ELSE sum((v - m) * (v - m) * q) + any_value(ld) END AS l
        FROM st JOIN mu USING (d) JOIN theta USING (cluster, s) JOIN ld USING (cluster) GROUP BY t, cluster""",
    "l": "SELECT t, " + ", ".join(f"max(l) FILTER (cluster = {k}) AS l{k}" for k in range(K)) + " FROM cost GROUP BY t",
    "f": f"""SELECT {_LAST}::BIGINT AS t, 0.0::DOUBLE AS f0, 0.0::DOUBLE AS f1, 0.0::DOUBLE AS f2 UNION ALL
        SELECT f.t - 1, least(f0 + l0, least(f0 + l0, f1 + l1, f2 + l2) + {BETA}), least(f1 + l1, least(f0 + l0, f1 + l1, f2 + l2) + {BETA}), least(f2 + l2, least(f0 + l0, f1 + l1, f2 + l2) + {BETA})
        FROM f JOIN l USING (t) WHERE f.t > 0""",
    "g": "SELECT t, [f0 + l0, f1 + l1, f2 + l2] AS g FROM f JOIN l USING (t)",
    "path": f"""SELECT t, (list_position(g, list_min(g)) - 1)::INT AS cluster FROM g WHERE t = 0 UNION ALL
        SELECT g.t, (list_position(list_transform(g, lambda v, i: v + CASE WHEN i - 1 = p.cluster THEN 0 ELSE {BETA} END), list_min(list_transform(g, lambda v, i: v + CASE WHEN i - 1 = p.cluster THEN 0 ELSE {BETA} END))) - 1)::INT
        FROM path p JOIN g ON g.t = p.t + 1""",
    "seg": """SELECT segment_id::BIGINT AS segment_id, any_value(cluster) AS cluster, min(t) AS t_start, max(t) AS t_end, count(*) AS len FROM (
        SELECT *, sum(new) OVER (ORDER BY t) - 1 AS segment_id FROM (SELECT *, CASE WHEN cluster IS DISTINCT FROM lag(cluster) OVER (ORDER BY t) THEN 1 ELSE 0 END AS new FROM path)) GROUP BY segment_id""",
    "pairs": f"SELECT a::INT AS truth, b::INT AS cluster FROM (SELECT unnest(range(0, {K})) AS a), (SELECT unnest(range(0, {K})) AS b)",
    "conf": f"SELECT p.truth, p.cluster, count(path.t) AS cnt FROM pairs p LEFT JOIN path ON path.cluster = p.cluster AND (t // 120) % {K} = p.truth GROUP BY ALL",
    "m": f"""SELECT -1 AS truth, -1 AS cluster, []::INT[] AS used UNION ALL
        SELECT m.truth + 1, (SELECT c.cluster FROM conf c WHERE c.truth = m.truth + 1 AND NOT list_contains(m.used, c.cluster) ORDER BY cnt DESC, c.cluster LIMIT 1),
        list_append(m.used, (SELECT c.cluster FROM conf c WHERE c.truth = m.truth + 1 AND NOT list_contains(m.used, c.cluster) ORDER BY cnt DESC, c.cluster LIMIT 1)) FROM m WHERE m.truth < {K - 1}""",
    "match": "SELECT truth::INT AS truth, cluster::INT AS cluster FROM m WHERE truth >= 0",
    "train": f"SELECT t FROM range(0, {_LAST + 1}) AS r(t) WHERE (t * 7919) % 997 < 0.9 * 997 OR t IN (0, {_LAST})",
    "draws": f"SELECT t, row_number() OVER (ORDER BY ('0x' || substr(md5('0:' || t || ':{SPLIT_SEED}'), 1, 13))::BIGINT, t) AS nth FROM range(0, {_LAST + 1}) AS r(t)",
    "test": f"SELECT t FROM range(0, {_LAST + 1}) AS r(t) WHERE t NOT IN (SELECT t FROM train)",
    "ranked": f"SELECT t, dense_rank() OVER (ORDER BY t) - 1 AS rank, s, v FROM y WHERE t <= {_LAST} AND (t * 7919) % 997 < 0.9 * 997",
    "moved": f"SELECT ((a.t // 120) % {K})::INT AS cluster, var_samp(a.v) + 0.002 AS p, var_samp(b.v) + 0.002 AS r, covar_samp(a.v, b.v) AS z FROM y a JOIN y b USING (t) WHERE a.s = 0 AND b.s = 1 GROUP BY 1",
    "two": "SELECT cluster, p, r, sign(z) * greatest(abs(z) - 0.002, 0) AS q FROM moved",
    # The two-sensor model with all its entries: a round from labels, for several rounds.
    "pair": "SELECT a.t, a.v AS a, b.v AS b FROM y a JOIN y b USING (t) WHERE a.s = 0 AND b.s = 1",
    "path0": f"SELECT t, ((t // 120) % {K})::INT AS cluster FROM pair",
    # Online labels: costs of windows that hold data to their end, and the cheapest way to every end.
    "whole": f"""SELECT t, cluster, sum((v - m) * (v - m) * q) + any_value(ld) AS l FROM (SELECT a.t, k * {N} + a.s AS d, a.s, b.v FROM y a CROSS JOIN (SELECT unnest(range(0, {W})) AS k) JOIN y b ON b.t = a.t + k AND b.s = a.s WHERE a.t <= {_LAST})
        JOIN mu USING (d) JOIN theta USING (cluster, s) JOIN ld USING (cluster) GROUP BY t, cluster""",
    "ends": "SELECT t, " + ", ".join(f"max(l) FILTER (cluster = {k}) AS l{k}" for k in range(K)) + " FROM whole GROUP BY t",
    "online": f"""SELECT t, [l0, l1, l2] AS p, [1, 2, 3] AS stay FROM ends WHERE t = 0 UNION ALL
        SELECT ends.t, [l0 + least(p[1], list_min(p) + {BETA}), l1 + least(p[2], list_min(p) + {BETA}), l2 + least(p[3], list_min(p) + {BETA})],
          list_transform([1, 2, 3], lambda k: CASE WHEN p[k] <= list_min(p) + {BETA} THEN k ELSE list_position(p, list_min(p)) END) FROM online JOIN ends ON ends.t = online.t + 1""",
    "late": f"""SELECT t AS seen, t, list_position(p, list_min(p)) AS k FROM online UNION ALL
        SELECT seen, late.t - 1, online.stay[k] FROM late JOIN online ON online.t = late.t WHERE late.t > greatest(0, seen - {LAG})""",
    "near": "SELECT test.t, (SELECT max(t) FROM train WHERE train.t < test.t) AS l, (SELECT min(t) FROM train WHERE train.t > test.t) AS r FROM test",
}


_SHARES = [f"((t // 120 + {k}) % {K} * 2 + t * {k + 1} % 5 + 1)" for k in range(K)]
for _name, _only in (("mix", "true"), ("mixtrain", "t IN (SELECT t FROM train)")):
    _PARTS[f"shared{_name}"] = f"SELECT t, a, b, k AS cluster, [{', '.join(_SHARES)}][k + 1] / ({' + '.join(_SHARES)})::DOUBLE AS w FROM pair, range(0, {K}) AS r(k) WHERE {_only}"
    _PARTS[f"centred{_name}"] = f"SELECT cluster, sum(w) AS n, sum(w * a) / sum(w) AS ma, sum(w * b) / sum(w) AS mb FROM shared{_name} GROUP BY cluster"
    _PARTS[_name] = f"""SELECT cluster::INT AS cluster, any_value(n) / sum(any_value(n)) OVER () AS weight, any_value(ma) AS ma, any_value(mb) AS mb, sum(w * (a - ma) * (a - ma)) / any_value(n) AS aa,
        sum(w * (a - ma) * (b - mb)) / any_value(n) AS ab, sum(w * (b - mb) * (b - mb)) / any_value(n) AS bb FROM shared{_name} JOIN centred{_name} USING (cluster) GROUP BY cluster"""
for _b in BLOCKS:
    _PARTS[f"roll{_b}"] = f"""SELECT t + {_b} AS t, 1 AS s, [l0, l1, l2] AS p FROM l UNION ALL
        SELECT roll{_b}.t, s + 1, [l0 + least(p[1], list_min(p) + {BETA}), l1 + least(p[2], list_min(p) + {BETA}), l2 + least(p[3], list_min(p) + {BETA})] FROM roll{_b} JOIN l ON l.t = roll{_b}.t - {_b} + s WHERE s < {_b}"""


def _dense(n: int | str, before: str, k: int = K) -> dict[str, str]:
    """Parts of one round of the two-sensor fit of ``k`` clusters, from the labels ``before``."""
    switched = f"list_transform(g, lambda v, i: v + CASE WHEN i - 1 = p.cluster THEN 0 ELSE {PAIR_BETA} END)"
    each = [f"f{c} + l{c}" for c in range(k)]
    step = ", ".join(f"least({e}, least({', '.join(each)}) + {PAIR_BETA})" for e in each)
    return {
        f"ds{n}": f"SELECT cluster, avg(a) AS ma, avg(b) AS mb, var_samp(a) AS sa, var_samp(b) AS sb, covar_samp(a, b) AS z, var_samp(a) + {PAIR_LAM} AS p, var_samp(b) + {PAIR_LAM} AS r, sign(covar_samp(a, b)) * greatest(abs(covar_samp(a, b)) - {PAIR_LAM}, 0) AS q FROM pair JOIN {before} USING (t) GROUP BY cluster",
        f"dc{n}": f"SELECT t, cluster, (r * (a - ma) * (a - ma) - 2 * q * (a - ma) * (b - mb) + p * (b - mb) * (b - mb)) / (p * r - q * q) + ln(p * r - q * q) AS l FROM pair CROSS JOIN ds{n}",
        f"dl{n}": "SELECT t, " + ", ".join(f"max(l) FILTER (cluster = {c}) AS l{c}" for c in range(k)) + f" FROM dc{n} GROUP BY t",
        f"df{n}": f"SELECT {HOURS - 1}::BIGINT AS t, {', '.join(f'0.0::DOUBLE AS f{c}' for c in range(k))} UNION ALL SELECT df{n}.t - 1, {step} FROM df{n} JOIN dl{n} USING (t) WHERE df{n}.t > 0",
        f"dg{n}": f"SELECT t, [{', '.join(each)}] AS g FROM df{n} JOIN dl{n} USING (t)",
        f"path{n}": f"SELECT t, (list_position(g, list_min(g)) - 1)::INT AS cluster FROM dg{n} WHERE t = 0 UNION ALL SELECT dg{n}.t, (list_position({switched}, list_min({switched})) - 1)::INT FROM path{n} p JOIN dg{n} ON dg{n}.t = p.t + 1",
    }


def _repaired(n: str, norms: str, rows: int) -> dict[str, str]:
    """Given labels of ``rows`` windows after repair: clusters K to MANY - 1 are empty, donors go by falling norm."""
    return {
        f"donor{n}": f"SELECT cluster, row_number() OVER (ORDER BY norm DESC, cluster DESC) - 1 AS place FROM ({norms})",
        f"member{n}": f"SELECT t, ((t // 120) % {K})::INT AS c, ('0x' || substr(md5('0:' || t || ':103'), 1, 13))::BIGINT AS draw FROM range(0, {rows}) AS r(t)",
        f"picks{n}": f"""SELECT -1 AS e, []::BIGINT[] AS used UNION ALL SELECT p.e + 1, list_append(p.used, (SELECT min_by(m.t, m.draw) FROM member{n} m JOIN donor{n} d ON d.cluster = m.c
            WHERE d.place = (p.e + 1) % {K} AND NOT coalesce(list_bool_or(list_transform(p.used, lambda u: abs(u - m.t) < {REASSIGN})), false))) FROM picks{n} p WHERE p.e < {MANY - K - 1}""",
        f"repaired{n}": f"""SELECT m.t, coalesce((SELECT max({K} + e) FROM picks{n} WHERE e >= 0 AND m.t BETWEEN used[e + 1] AND used[e + 1] + {REASSIGN - 1}), m.c)::INT AS cluster FROM member{n} m""",
    }


_PARTS |= _repaired("w", f"SELECT cluster, sqrt({W} * sum(1 / (q * q))) AS norm FROM theta GROUP BY cluster", HOURS - W + 1)
_PARTS |= _repaired("d", "SELECT cluster, sqrt(p * p + r * r + 2 * q * q) AS norm FROM ds1", HOURS)
_PARTS |= _dense("d", "repairedd", MANY)
for _turn in (1, 2, 3):
    _PARTS |= _dense(_turn, f"path{_turn - 1}")


def _needed(text: str, found: dict[str, None]) -> dict[str, None]:
    """Parts that ``text`` names, each after those it needs itself."""
    import re

    for name in _PARTS:
        if name not in found and re.search(rf"\b(FROM|JOIN|,)\s+{name}\b(?![(.])", text):
            rest = re.sub(rf"\b(FROM|JOIN)\s+{name}\b", "", _PARTS[name])
            _needed(rest, found)
            found[name] = None
    return found


def _with(sql: str) -> str:
    parts = ",\n".join(f"{n} AS ({_PARTS[n]})" for n in _needed(sql, {}))
    return f"WITH RECURSIVE {parts}\n{sql}" if parts else sql


_RUNS = """SELECT segment_id::BIGINT AS segment_id, any_value(cluster) AS cluster, min(t) AS t_start, max(t) AS t_end, count(*) AS len FROM (
    SELECT *, sum(new) OVER (ORDER BY t) - 1 AS segment_id FROM (SELECT *, CASE WHEN cluster IS DISTINCT FROM lag(cluster) OVER (ORDER BY t) THEN 1 ELSE 0 END AS new FROM path1)) GROUP BY segment_id"""
_BIC = f"""SELECT round(n * ln({HOURS}) - 2 * fit, 1) AS bic FROM
    (SELECT {{how}}(-ld - tr) AS fit FROM ld JOIN (SELECT cluster, sum(v * q) AS tr FROM cov JOIN theta USING (cluster) WHERE i = j AND i % {N} = s GROUP BY cluster) USING (cluster) WHERE {{used}}),
    (SELECT {W * N} * count(*) AS n FROM {{each}})"""
_F1 = "CASE WHEN {tp} > 0 THEN 2 * {tp} / ({a} + {b}) ELSE 0 END"
_RAW: dict[str, str] = {
    "series_hourly": "SELECT t, s AS sensor, round(v, 6) AS v FROM x",
    "ffill_series": "SELECT t, s AS sensor, round(last_value(CASE WHEN v > 100 THEN v END IGNORE NULLS) OVER (PARTITION BY s ORDER BY t ROWS UNBOUNDED PRECEDING), 6) AS v FROM x",
    "normalize_range": "SELECT t - 165 AS t, s AS sensor, round(v, 6) AS v FROM y WHERE t >= 165",
    "window_stack_zero_tail": "SELECT t, k, s AS sensor, round(v, 6) AS v FROM st",
    "window_stack_full": f"SELECT t, k, s AS sensor, round(v, 6) AS v FROM st WHERE t <= {_LAST - W + 1}",
    "window_stack_gaps": """SELECT a.rank AS t, (b.rank - a.rank)::INT AS k, a.s AS sensor, round(b.v, 6) AS v
        FROM ranked a JOIN ranked b ON a.s = b.s AND b.rank BETWEEN a.rank AND a.rank + 1 WHERE a.rank <= (SELECT max(rank) - 1 FROM ranked)""",
    "split_train": "SELECT t FROM train",
    "split_test": "SELECT t FROM test",
    "split_exact_train": f"SELECT t FROM draws WHERE nth <= {HOURS * 9 // 10} OR t IN (0, {_LAST})",
    "split_exact_test": f"SELECT t FROM range(0, {HOURS}) AS r(t) WHERE t NOT IN (SELECT t FROM draws WHERE nth <= {int(HOURS * 0.99)})",
    "subsample_even": "SELECT t, s AS sensor, round(v, 6) AS v FROM x WHERE t % 10 = 0",
    "asof_neighbours": 'SELECT t, l AS "left", r AS "right" FROM near',
    "cluster_counts": f"SELECT each::INT AS cluster, count(DISTINCT t) AS n FROM (SELECT unnest(range(0, {K + 1})) AS each) LEFT JOIN st ON c = each GROUP BY each",
    "cluster_means": "SELECT cluster, d AS at, round(m, 4) AS v FROM mu",
    "cluster_cov_unbiased": "SELECT cluster, i, j, round(v, 5) + 0.0 AS v FROM cov",
    "cluster_cov_lagged": "SELECT cluster, i, j, round(v, 5) + 0.0 AS v FROM cov",
    "cluster_cov_biased": "SELECT cluster, i, j, round(p, 5) + 0.0 AS v FROM cov",
    "lag_cov_toeplitz_mean": f"SELECT cluster, (j // {N} - i // {N})::INT AS lag, (i % {N})::INT AS j, (j % {N})::INT AS k, round(avg(v), 5) + 0.0 AS v FROM cov WHERE i // {N} < j // {N} OR (i // {N} = j // {N} AND i <= j) GROUP BY 1, 2, 3, 4",
    "symmetric_unpack": "SELECT cluster, i, j, round(CASE WHEN abs(v) < 0.001 THEN 0 ELSE v END, 5) + 0.0 AS v FROM cov",
    "threshold_mask": "SELECT cluster, count(*) FILTER (abs(v) > 0.01) AS n_edges FROM cov GROUP BY cluster",
    "mrf_diag": f"SELECT cluster, (k * {N} + s)::INT AS i, round(q, 3) AS v FROM theta, (SELECT unnest(range(0, {W})) AS k)",
    "mrf_2var": """SELECT cluster, i::INT AS i, j::INT AS j, round(CASE WHEN i <> j THEN -q WHEN i = 0 THEN r ELSE p END / (p * r - q * q), 2) + 0.0 AS v FROM two, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS e(i, j)""",
    "cost_matrix_diag": "SELECT t, cluster, round(l, 4) + 0.0 AS cost FROM cost",
    "viterbi_labels": "SELECT t, cluster FROM path",
    "fit_given_labels": "SELECT t, cluster FROM path",
    "heldout_assign": f"""SELECT t, min_by(cluster, (total, cluster)) AS cluster FROM (
        SELECT near.t, mu.cluster, sum((CASE WHEN a.k = 0 THEN o.v ELSE a.v END - m) * (CASE WHEN a.k = 0 THEN o.v ELSE a.v END - m) * q) + any_value(ld)
          + CASE WHEN (any_value(near.l) // 120) % {K} <> mu.cluster THEN {BETA} ELSE 0 END + CASE WHEN (any_value(near.r) // 120) % {K} <> mu.cluster THEN {BETA} ELSE 0 END AS total
        FROM near JOIN st a ON a.t = near.l JOIN y o ON o.t = near.t AND o.s = a.s JOIN mu ON mu.d = a.d JOIN theta ON theta.cluster = mu.cluster AND theta.s = a.s JOIN ld ON ld.cluster = mu.cluster
        GROUP BY near.t, mu.cluster) GROUP BY t""",
    "segments": "SELECT segment_id, cluster, t_start, t_end, len FROM seg",
    "segment_lengths": "SELECT cluster, count(*) AS n_segments, max(len) AS longest, sum(len)::BIGINT AS rows FROM seg GROUP BY cluster",
    "confusion_periodic": f"SELECT p.truth, p.cluster, count(path.t) AS cnt FROM pairs p LEFT JOIN path ON path.cluster = p.cluster AND (t // 400) % {K} = p.truth GROUP BY ALL",
    "confusion_pattern": "SELECT p.truth, p.cluster, count(path.t) AS cnt FROM pairs p LEFT JOIN path ON path.cluster = p.cluster AND [0, 1, 1, 0, 2, 2, 2, 0][(t // 50) % 8 + 1] = p.truth GROUP BY ALL",
    "confusion_aba": "SELECT p.truth, p.cluster, count(path.t) AS cnt FROM pairs p LEFT JOIN path ON path.cluster = p.cluster AND CASE WHEN t < 100 THEN 0 WHEN t < 300 THEN 1 ELSE 0 END = p.truth GROUP BY ALL",
    "greedy_matching": "SELECT truth, cluster FROM match",
    "accuracy": "SELECT round(sum(cnt) FILTER (match.cluster = conf.cluster) / sum(cnt), 6) AS accuracy FROM conf JOIN match USING (truth)",
    "accuracy_two_class": "SELECT round(greatest(a, 1 - a), 6) AS accuracy FROM (SELECT sum(cnt) FILTER (truth = cluster) / sum(cnt) AS a FROM conf WHERE truth < 2 AND cluster < 2)",
    "baseline_networks": """SELECT cluster, i::INT AS i, j::INT AS j, round(CASE WHEN i <> j THEN -z WHEN i = 0 THEN r - 0.002 ELSE p - 0.002 END / ((p - 0.002) * (r - 0.002) - z * z), 3) + 0.0 AS v
        FROM moved, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS e(i, j)""",
    "macro_f1": f"""SELECT round(avg({_F1.format(tp="cnt", a="a", b="b")}), 6) AS macro_f1 FROM conf JOIN match USING (truth, cluster)
        JOIN (SELECT truth, sum(cnt) AS a FROM conf GROUP BY truth) USING (truth) JOIN (SELECT cluster, sum(cnt) AS b FROM conf GROUP BY cluster) USING (cluster)""",
    "network_f1": f"""SELECT cluster, round(({_F1.format(tp="tp", a="(tp + fp)", b="(tp + fn)")} + {_F1.format(tp="tn", a="(tn + fn)", b="(tn + fp)")}) / 2, 6) AS f1, round({_F1.format(tp="tp", a="(tp + fp)", b="(tp + fn)")}, 6) AS edge_f1 FROM (
        SELECT a.cluster, count(*) FILTER (abs(a.v) > 0.002 AND abs(b.v) > 0.002) AS tp, count(*) FILTER (abs(a.v) <= 0.002 AND abs(b.v) > 0.002) AS fp,
          count(*) FILTER (abs(a.v) > 0.002 AND abs(b.v) <= 0.002) AS fn, count(*) FILTER (abs(a.v) <= 0.002 AND abs(b.v) <= 0.002) AS tn
        FROM cov a JOIN cov b ON (b.cluster + 1) % {K} = a.cluster AND a.i = b.i AND a.j = b.j GROUP BY a.cluster)""",
    "bic_per_segment": _BIC.format(how="sum", each="seg", used="true"),
    "bic_per_cluster": _BIC.format(how="avg", each="(SELECT DISTINCT cluster FROM path)", used="cluster IN (SELECT cluster FROM path)"),
    "mrf_edges": f"""SELECT cluster, ({W - 1} - j // {N})::INT AS lag, (j % {N})::INT AS src, (i - {(W - 1) * N})::INT AS dst, round(v, 5) AS weight FROM cov
        WHERE i >= {(W - 1) * N} AND abs(v) > 0.002 AND (j < {(W - 1) * N} OR j < i)""",
    "cluster_norm_rank": "SELECT cluster, round(norm, 4) AS norm, (row_number() OVER (ORDER BY norm DESC, cluster DESC) - 1)::INT AS place FROM (SELECT cluster, sqrt(sum(v * v)) AS norm FROM cov GROUP BY cluster)",
    "export_colours": "SELECT t, '\"' || [" + ", ".join(f"'{c}'" for c in PALETTE) + "][cluster + 1] || '\"' AS colour FROM path WHERE t % 10 = 0 AND t < 40000",
    "export_channels": "SELECT t, ch::INT AS channel, ('0x' || substr([" + ", ".join(f"'{c}'" for c in PALETTE) + "][cluster + 1], 2 + 2 * ch, 2))::INT / 256.0::DOUBLE AS v FROM path, (VALUES (0), (1), (2)) AS c(ch) WHERE t % 10 = 0",
    "gmm_round": "SELECT cluster, round(weight, 6) + 0.0 AS weight, round(ma, 6) + 0.0 AS mean_a, round(mb, 6) + 0.0 AS mean_b, round(aa, 6) + 0.0 AS aa, round(ab, 6) + 0.0 AS ab, round(bb, 6) + 0.0 AS bb FROM mix",
    "gmm_labels": "SELECT t, max_by(cluster, (d + ln(weight), -cluster)) AS cluster FROM (SELECT t, cluster, weight, -((bb * (a - ma) * (a - ma) - 2 * ab * (a - ma) * (b - mb) + aa * (b - mb) * (b - mb)) / (aa * bb - ab * ab) + ln(aa * bb - ab * ab)) / 2 AS d FROM pair CROSS JOIN mix) GROUP BY t",
    "heldout_mixture_round": "SELECT t, max_by(cluster, (d, -cluster)) AS cluster FROM (SELECT t, cluster, -((bb * (a - ma) * (a - ma) - 2 * ab * (a - ma) * (b - mb) + aa * (b - mb) * (b - mb)) / (aa * bb - ab * ab) + ln(aa * bb - ab * ab)) / 2 AS d FROM pair CROSS JOIN mixtrain WHERE t IN (SELECT t FROM test)) GROUP BY t",
    "export_locations": "SELECT t, 'new GLatLng(' || (t % 90) || ', ' || (t % 180) || ')' AS point FROM path WHERE t % 10 = 0",
    "cost_matrix_dense": "SELECT t, cluster, round(l, 3) + 0.0 AS cost FROM dc1",
    "viterbi_labels_dense": "SELECT t, cluster FROM path1",
    "fit_dense_round": "SELECT t, cluster FROM path1",
    "fit_three_rounds": "SELECT t, cluster FROM path3",
    "segments_dense": _RUNS,
    "bic_dense": f"""SELECT round(n * ln({HOURS}) - 2 * fit, 0) AS bic FROM
        (SELECT sum(-ln(p * r - q * q) - (sa * r + sb * p - 2 * z * q) / (p * r - q * q)) AS fit FROM ds1),
        (SELECT sum(CASE WHEN abs(q / (p * r - q * q)) > 2e-5 THEN 4 ELSE 2 END) AS n FROM ({_RUNS}) JOIN ds1 USING (cluster))""",
    "lasso_zero_penalty": f"""SELECT cluster, i::INT AS i, j::INT AS j, round(CASE WHEN i <> j THEN -z WHEN i = 0 THEN sb ELSE sa END / (sa * sb - z * z), 1) + 0.0 AS v FROM ds1, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS e(i, j)""",
    "random_init": f"SELECT t, (('0x' || substr(md5('0:' || t || ':102'), 1, 8))::BIGINT % {K})::INT AS cluster FROM range(0, {_LAST + 1}) AS r(t)",
    "stream_score": "SELECT t, (list_position(p, list_min(p)) - 1)::INT AS cluster FROM online",
    "stream_score_lagged": f"SELECT t, (k - 1)::INT AS cluster FROM late WHERE t = seen - {LAG}",
    "stream_handover": f"SELECT t, (k - 1)::INT AS cluster FROM late WHERE t = seen - {LAG} AND t > {PAST} - {W} - {LAG}",
    "repaired_labels": "SELECT t, cluster FROM repairedw",
    "repaired_round": "SELECT t, cluster FROM pathd",
    "rolling_block": f"SELECT t, (list_position(p, list_min(p)) - 1)::INT AS cluster FROM roll{BLOCKS[0]} WHERE s = {BLOCKS[0]} AND t <= {_LAST} UNION ALL SELECT t, cluster FROM path WHERE t < {BLOCKS[0]}",
    "rolling_block_wide": f"SELECT t, (list_position(p, list_min(p)) - 1)::INT AS cluster FROM roll{BLOCKS[1]} WHERE s = {BLOCKS[1]} AND t <= {_LAST}",
    "cluster_raw_means": "SELECT cluster, s AS sensor, round(avg(v), 4) AS mean FROM path JOIN x USING (t) GROUP BY ALL",
}
_RAW["network_accuracy"] = f"SELECT round(avg(f1), 5) AS network_accuracy FROM ({_RAW['network_f1']})"
ORACLES = {name: _with(sql) for name, sql in _RAW.items()}
