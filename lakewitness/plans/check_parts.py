"""Shared parts of the check SQL: the same versions, profiled with another engine's own functions."""

from __future__ import annotations

import re

from lakewitness.plans.registry import part
from lakewitness.plans.workspace import VERSION_ROWS, VERSION_SQL

# Columns and type families of every version.
COLUMNS = {
    1: "order_id int, customer_key int, order_state str, total_price num, order_date str, priority str, price_with_tax num",
    2: "order_id int, customer_key int, order_state str, total_price num, order_date str, priority str, price_with_tax num, ship_mode str",
    3: "order_id int, customer_key int, order_state str, total_price num, order_date str, priority str, order_state_label str, final_outcome str",
    4: "order_key int, part_key int, supplier_key int, line_number int, quantity num, extended_price num, discount num, tax num, return_flag str, line_state str",
    5: "order_key int, part_key int, supplier_key int, line_number int, quantity num, extended_price num, discount num, tax num, return_flag str, line_state str",
    6: "customer_key int, customer_name str, nation_name str, region_name str, account_balance num, segment str",
    7: "customer_key int, nation_name str, region_name str, account_balance num, final_account_balance num, segment str",
    8: "event_id int, user_id int, outcome_class str, amount num, event_kind str",
    9: "event_id int, user_id int, outcome_class str, amount num, event_kind str, amount_double num, channel str",
    10: "doc_id int, body str, lang str, source str, n_chars int, quality str",
    11: "doc_id int, body str, lang str, source str, n_chars int, quality str",
}
SCHEMA = {v: [tuple(c.split()) for c in text.split(", ")] for v, text in COLUMNS.items()}
BASE = {"int": "int64", "num": "float64", "str": "object"}


def lit(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, list):
        return "[" + ", ".join(lit(v) for v in value) + "]::VARCHAR[]"
    return str(value) if isinstance(value, (int, float)) else "'" + value.replace("'", "''") + "'"


def cell(version: int, name: str, kind: str) -> str:
    if kind == "str":
        return f"SELECT {version}::BIGINT AS version_id, '{name}' AS col, {name} AS value, NULL::DOUBLE AS num FROM v{version}"
    return f"SELECT {version}::BIGINT AS version_id, '{name}' AS col, NULL::VARCHAR AS value, {name}::DOUBLE AS num FROM v{version}"


def digest_sql(version: int) -> str:
    """SHA-256 of a row of a version, from cell texts spelled out here."""
    cells = []
    for n, kind in SCHEMA[version]:
        text = n if kind == "str" else f"{n}::VARCHAR"
        if kind == "num":
            g = f"floor(log2(abs({n})))::INT"
            e = f"({g} - (pow(2.0::DOUBLE, {g}) > abs({n}))::INT + (pow(2.0::DOUBLE, {g} + 1) <= abs({n}))::INT)"
            whole = f"abs({n}) < 9007199254740992 AND {n} = floor({n})"
            # zero has no logarithm
            text = f"CASE WHEN {whole} THEN {n}::BIGINT::VARCHAR WHEN {n} <> 0 THEN CASE WHEN {n} < 0 THEN '-' ELSE '' END || (abs({n}) / pow(2.0::DOUBLE, {e}) * 4503599627370496)::BIGINT || 'p' || {e} END"
        cells.append(f"CASE WHEN {n} IS NULL THEN '-' ELSE octet_length(encode({text})) || ':' || ({text}) END")
    return "sha256(" + " || ".join(cells) + ")"


for name, statement in VERSION_SQL.items():
    part(name, re.sub(r"{(\w+)}", r"\1", statement))

part("cells", "\nUNION ALL ".join(cell(v, n, k) for v, cols in SCHEMA.items() for n, k in cols))
part("cat", "SELECT * FROM (VALUES " + ", ".join(
    f"({v}::BIGINT, {i}, '{n}', '{BASE[k]}')" for v, cols in SCHEMA.items() for i, (n, k) in enumerate(cols, 1)
) + ") AS c(version_id, pos, col, base)")
part("reg", "SELECT version_id::BIGINT AS version_id, study_id::BIGINT AS study_id, dataset_id::BIGINT AS dataset_id, dataset_name, version_number, parent_version_id::BIGINT AS parent_version_id, method, notes, created_at, task, target, metric, validation, mode, selected, scaling FROM (VALUES "
     + ", ".join("(" + ", ".join(lit(x) for x in row) + ")" for row in VERSION_ROWS)
     + ") AS r(version_id, study_id, dataset_id, dataset_name, version_number, parent_version_id, method, notes, created_at, task, target, metric, validation, mode, selected, scaling)")
part("vc", "SELECT version_id, col, value, num, count(*) AS cnt FROM cells GROUP BY ALL")
part("stats", """
SELECT version_id, col, count(*) AS row_count, count(*) FILTER (value IS NULL AND num IS NULL) AS missing,
       count(DISTINCT value) + count(DISTINCT num) AS uniq, count(num) AS n, min(num) AS mn, max(num) AS mx, avg(num) AS mean,
       quantile_cont(num, 0.25) AS q25, quantile_cont(num, 0.5) AS med, quantile_cont(num, 0.75) AS q75,
       stddev_samp(num) AS sd, CASE WHEN count(num) >= 3 THEN skewness(num) END AS skew
FROM cells GROUP BY ALL""")
part("outl", """
SELECT c.version_id, c.col, count(*) FILTER (q75 <> q25 AND (num < q25 - 1.5 * (q75 - q25) OR num > q75 + 1.5 * (q75 - q25))) AS outliers
FROM cells c JOIN stats s ON c.version_id = s.version_id AND c.col = s.col WHERE num IS NOT NULL GROUP BY ALL""")
part("cp", """
SELECT k.version_id, k.pos, k.col, k.base, k.base <> 'object' AS isnum,
       CASE WHEN k.base = 'int64' AND missing > 0 THEN 'float64' ELSE k.base END AS dtype,
       CASE WHEN k.col = r.target THEN 'target' ELSE 'feature' END AS role,
       row_count, missing, missing::DOUBLE / row_count AS exact_missing, round(missing::DOUBLE / row_count, 6) AS missing_ratio, uniq, round(uniq::DOUBLE / row_count, 6) AS unique_ratio,
       mn, q25, med, q75, mx, mean, sd, skew, outliers, round(outliers::DOUBLE / row_count, 6) AS outlier_ratio
FROM cat k JOIN stats s ON k.version_id = s.version_id AND k.col = s.col
LEFT JOIN outl o ON k.version_id = o.version_id AND k.col = o.col JOIN reg r ON r.version_id = k.version_id""")
part("top", """
SELECT version_id, col, rk, value, cnt FROM (
  SELECT vc.version_id, vc.col, value, cnt, row_number() OVER (PARTITION BY vc.version_id, vc.col ORDER BY cnt DESC, value) AS rk
  FROM vc JOIN cat ON vc.version_id = cat.version_id AND vc.col = cat.col WHERE base = 'object' AND value IS NOT NULL) WHERE rk <= 10""")
part("dup", "\nUNION ALL ".join(
    f"SELECT {v}::BIGINT AS version_id, CAST(sum(c - 1) AS BIGINT) AS dups FROM (SELECT {', '.join(n for n, _ in cols)}, count(*) AS c FROM v{v} GROUP BY ALL)"
    for v, cols in SCHEMA.items()
))
part("hc", "SELECT version_id, l, r, round(c, 6) AS corr FROM (" + "\nUNION ALL ".join(
    f"SELECT {v}::BIGINT AS version_id, '{a}' AS l, '{b}' AS r, corr({a}, {b}) AS c FROM v{v}"
    for v, cols in SCHEMA.items()
    for nums in [[n for n, k in cols if k != "str"]]
    for i, a in enumerate(nums)
    for b in nums[i + 1 :]
) + ") WHERE c IS NOT NULL AND abs(c) >= 0.8")
part("tp", """
SELECT cp.version_id, max(row_count) AS row_count, count(*) AS column_count, CAST(sum(missing) AS BIGINT) AS missing_cells,
       round(sum(missing)::DOUBLE / (max(row_count) * count(*)), 6) AS missing_ratio, max(dups) AS duplicate_rows,
       round(max(dups)::DOUBLE / max(row_count), 6) AS duplicate_ratio,
       count(*) FILTER (isnum) AS numeric_columns, count(*) FILTER (NOT isnum) AS categorical_columns
FROM cp JOIN dup ON cp.version_id = dup.version_id GROUP BY cp.version_id""")
part("cls", """
SELECT vc.version_id, value AS class, cnt, round(cnt::DOUBLE / sum(cnt) OVER (PARTITION BY vc.version_id), 6) AS class_ratio
FROM vc JOIN reg ON vc.version_id = reg.version_id AND col = target WHERE task = 'classification' AND value IS NOT NULL""")
part("cls1", """
SELECT version_id, count(*) AS class_count, CAST(sum(cnt) AS BIGINT) AS labelled, min(cnt) AS mincls, max(cnt) AS maxcls,
       arg_min(class, (cnt, class)) AS minority, round(max(cnt)::DOUBLE / min(cnt), 4) AS ratio FROM cls GROUP BY 1""")
part("regr", """
SELECT cp.version_id, skew AS target_skew, outliers AS target_outliers, cp.* EXCLUDE (version_id) FROM cp JOIN reg ON cp.version_id = reg.version_id AND col = target
WHERE task = 'regression'""")
part("clus", """
SELECT cp.version_id, count(*) AS selected_numeric, coalesce(max(nullif(sd, 0)) / min(nullif(sd, 0)), 1.0) AS spread, max(row_count) AS row_count
FROM cp JOIN reg ON cp.version_id = reg.version_id WHERE task = 'clustering' AND isnum AND (len(selected) = 0 OR list_contains(selected, col)) GROUP BY 1""")

# ---- pairs ----
part("pp", "SELECT version_id AS pair_id, parent_version_id AS prev, version_id AS cur, target FROM reg WHERE parent_version_id IS NOT NULL")


def pair_parts(pairs: str, p: str) -> None:
    """The comparison parts for one relation of pairs; their names start with ``p``."""
    part(f"{p}pc", f"""
SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.col, b.col) AS col, p.target,
       CASE WHEN a.col IS NULL THEN 'added' WHEN b.col IS NULL THEN 'removed' ELSE 'common' END AS status,
       coalesce(a.dtype <> b.dtype, false) AS dtype_changed, coalesce(coalesce(a.col, b.col) = p.target, false) AS is_target,
       coalesce(a.isnum AND b.isnum, false) AS both_num,
       a.dtype AS adt, b.dtype AS bdt, a.row_count AS an, b.row_count AS bn, a.missing AS am, b.missing AS bm,
       a.exact_missing AS ar, b.exact_missing AS br, a.missing_ratio AS amr, b.missing_ratio AS bmr, a.uniq AS au, b.uniq AS bu,
       a.mean AS a_mean, b.mean AS b_mean, a.med AS a_median, b.med AS b_median, a.sd AS a_std, b.sd AS b_std, a.mn AS a_min, b.mn AS b_min, a.mx AS a_max, b.mx AS b_max
FROM (SELECT pair_id, cp.* FROM {pairs} JOIN cp ON version_id = prev) a
FULL JOIN (SELECT pair_id, cp.* FROM {pairs} JOIN cp ON version_id = cur) b ON a.pair_id = b.pair_id AND a.col = b.col
JOIN {pairs} p ON p.pair_id = coalesce(a.pair_id, b.pair_id)""")
    part(f"{p}ev", f"""
SELECT pair_id, col, change, CASE change WHEN 'target_removed' THEN 0.65 WHEN 'target_added' THEN 0.3 WHEN 'target_dtype_changed' THEN 0.35
       WHEN 'feature_dtype_changed' THEN 0.1 WHEN 'feature_removed' THEN 0.08 ELSE 0.05 END::DOUBLE AS severity
FROM (SELECT pair_id, col, (CASE WHEN is_target THEN 'target' ELSE 'feature' END) ||
      (CASE WHEN status <> 'common' THEN '_' || status WHEN dtype_changed THEN '_dtype_changed' END) AS change FROM {p}pc) WHERE change IS NOT NULL""")
    part(f"{p}ss", f"SELECT p.pair_id, least(coalesce(sum(severity), 0), 1)::DOUBLE AS s, coalesce(sum(severity), 0)::DOUBLE AS raw FROM {pairs} p LEFT JOIN {p}ev e ON p.pair_id = e.pair_id GROUP BY 1")
    part(f"{p}mo", f"""
SELECT p.pair_id, a.n AS rows_prev, b.n AS rows_cur, b.k - a.k AS column_change, a.m AS ma, b.m AS mb
FROM {pairs} p JOIN (SELECT version_id, max(row_count) AS n, count(*) AS k, avg(exact_missing) AS m FROM cp GROUP BY 1) a ON a.version_id = prev
JOIN (SELECT version_id, max(row_count) AS n, count(*) AS k, avg(exact_missing) AS m FROM cp GROUP BY 1) b ON b.version_id = cur""")
    part(f"{p}mc", f"""
SELECT pair_id, col, is_target, am, bm, bm - am AS dc, round(ar, 6) AS ar6, round(br, 6) AS br6, round(br - ar, 6) AS dr
FROM {p}pc WHERE status = 'common' AND (am <> bm OR abs(br - ar) > 1e-8)""")
    part(f"{p}ms", f"SELECT pair_id, least(1.0, 0.65 * avg(abs(br - ar)) + 0.35 * max(abs(br - ar)))::DOUBLE AS s FROM {p}pc WHERE status = 'common' GROUP BY 1")
    part(f"{p}sk", f"""
SELECT pair_id, rk, col FROM (SELECT pair_id, col, row_number() OVER (PARTITION BY pair_id ORDER BY col) AS rk FROM {p}pc
WHERE status = 'common' AND (lower(col) IN ('id', 'uuid', 'guid', 'key') OR lower(col) LIKE '%id' OR lower(col) LIKE '%uuid%' OR lower(col) LIKE '%guid%')
AND am = 0 AND bm = 0 AND au = an AND bu = bn) WHERE rk <= 2""")
    part(f"{p}vv", f"""
SELECT pair_id, col, value, num, CAST(sum(o) AS BIGINT) AS o, CAST(sum(w) AS BIGINT) AS w FROM (
  SELECT pair_id, col, value, num, cnt AS o, 0 AS w FROM {pairs} JOIN vc ON version_id = prev
  UNION ALL SELECT pair_id, col, value, num, 0, cnt FROM {pairs} JOIN vc ON version_id = cur) GROUP BY ALL""")
    part(f"{p}ns", f"""
WITH x AS (SELECT v.pair_id, v.col, num, o, w FROM {p}vv v JOIN {p}pc c ON v.pair_id = c.pair_id AND v.col = c.col WHERE status = 'common' AND both_num AND num IS NOT NULL),
t AS (SELECT pair_id, col, sum(o) AS no, sum(w) AS nw, min(num) AS lo, max(num) AS hi FROM x GROUP BY 1, 2),
f AS (SELECT x.pair_id, x.col, num, sum(o) OVER g / no AS fo, sum(w) OVER g / nw AS fw, lead(num) OVER (PARTITION BY x.pair_id, x.col ORDER BY num) AS nx
      FROM x JOIN t ON x.pair_id = t.pair_id AND x.col = t.col WINDOW g AS (PARTITION BY x.pair_id, x.col ORDER BY num ROWS UNBOUNDED PRECEDING)),
d AS (SELECT pair_id, col, coalesce(sum(abs(fo::DOUBLE - fw::DOUBLE) * (nx - num)), 0) AS dist FROM f GROUP BY 1, 2),
e AS (SELECT pair_id, col, unnest(range(o + w)) AS i, num FROM x),
s AS (SELECT pair_id, col, quantile_cont(num, 0.75) - quantile_cont(num, 0.25) AS iqr, stddev_samp(num) AS sd FROM e GROUP BY 1, 2)
SELECT d.pair_id, d.col, CASE WHEN no = 0 OR nw = 0 THEN 0 ELSE least(1.0, dist / CASE WHEN iqr > 1e-12 THEN iqr WHEN sd > 1e-12 THEN sd ELSE greatest(hi - lo, 1.0) END) END::DOUBLE AS shift
FROM d JOIN s ON d.pair_id = s.pair_id AND d.col = s.col JOIN t ON d.pair_id = t.pair_id AND d.col = t.col""")
    part(f"{p}cc", f"""
SELECT pair_id, col, label, is_target, both_num, CAST(sum(o) AS BIGINT) AS o, CAST(sum(w) AS BIGINT) AS w, max(an) AS an, max(bn) AS bn,
       round(sum(o)::DOUBLE / max(an), 6) AS po, round(sum(w)::DOUBLE / max(bn), 6) AS pw, round(sum(w)::DOUBLE / max(bn) - sum(o)::DOUBLE / max(an), 6) AS dr
FROM (
  SELECT v.pair_id, v.col, is_target, both_num, an, bn, o, 0 AS w, CASE WHEN value IS NULL AND num IS NULL THEN '<MISSING>' WHEN value IS NOT NULL THEN value WHEN adt = 'int64' THEN num::BIGINT::VARCHAR ELSE num::VARCHAR END AS label
  FROM {p}vv v JOIN {p}pc c ON v.pair_id = c.pair_id AND v.col = c.col WHERE status = 'common' AND (NOT both_num OR is_target) AND o > 0
  UNION ALL
  SELECT v.pair_id, v.col, is_target, both_num, an, bn, 0, w, CASE WHEN value IS NULL AND num IS NULL THEN '<MISSING>' WHEN value IS NOT NULL THEN value WHEN bdt = 'int64' THEN num::BIGINT::VARCHAR ELSE num::VARCHAR END
  FROM {p}vv v JOIN {p}pc c ON v.pair_id = c.pair_id AND v.col = c.col WHERE status = 'common' AND (NOT both_num OR is_target) AND w > 0)
GROUP BY 1, 2, 3, 4, 5""")
    part(f"{p}cs", f"""
SELECT pair_id, col, is_target, both_num, least(1.0, sqrt(greatest(sum(
         0.5 * (CASE WHEN po > 0 THEN po * log2(po / greatest((po + pw) / 2, 1e-12)) ELSE 0 END) + 0.5 * (CASE WHEN pw > 0 THEN pw * log2(pw / greatest((po + pw) / 2, 1e-12)) ELSE 0 END)), 0)))::DOUBLE AS jsd,
       count(*) FILTER (o = 0 AND w > 0) AS added, count(*) FILTER (o > 0 AND w = 0) AS removed, count(*) AS labels
FROM {p}cc GROUP BY 1, 2, 3, 4""")
    part(f"{p}sh", f"""
SELECT n.pair_id, n.col, is_target, 'numeric' AS kind, round(shift * 100, 3) AS score FROM {p}ns n JOIN {p}pc c ON n.pair_id = c.pair_id AND n.col = c.col
UNION ALL SELECT pair_id, col, is_target, 'categorical', round(jsd * 100, 3) FROM {p}cs WHERE NOT both_num""")
    part(f"{p}ds", f"""
SELECT pair_id, t::DOUBLE / (n * 100000) AS m, mo::DOUBLE / 100000 AS x, k::DOUBLE / n AS d, ((2 * (65 * t + 20 * mo * n + 1500000 * k) + 100 * n) // (200 * n))::DOUBLE / 1000 AS dsi FROM (
  SELECT p.pair_id, coalesce(sum(round(score * 1000)::BIGINT), 0)::BIGINT AS t, coalesce(max(round(score * 1000)::BIGINT), 0) AS mo, count(*) FILTER (score >= 20) AS k, greatest(count(score), 1) AS n
  FROM {pairs} p LEFT JOIN (SELECT * FROM {p}sh WHERE NOT is_target) s ON p.pair_id = s.pair_id GROUP BY 1)""")
    part(f"{p}st", f"SELECT pair_id, avg(least(1.0, 0.6 * jsd + 0.4 * ((added + removed)::DOUBLE / labels)))::DOUBLE AS s FROM {p}cs GROUP BY 1")
    part(f"{p}sc", f"""
SELECT p.pair_id, prev, cur, round(a.s * 100, 3) AS scm_schema, round(coalesce(ratio, 0) * 100, 3) AS scm_rows, round(coalesce(m.s, 0) * 100, 3) AS scm_missingness, round(coalesce(t.s, 0) * 100, 3) AS scm_structure,
       round(d.m * 100, 3) AS dsi_mean, round(d.x * 100, 3) AS dsi_max, round(d.d * 100, 3) AS dsi_ratio,
       round(100 * (0.30 * a.s + 0.35 * coalesce(ratio, 0) + 0.20 * coalesce(m.s, 0) + 0.15 * coalesce(t.s, 0)), 3)::DOUBLE AS scm,
       d.dsi AS dsi
FROM {pairs} p JOIN {p}ss a ON a.pair_id = p.pair_id LEFT JOIN {p}rd r ON r.pair_id = p.pair_id LEFT JOIN {p}ms m ON m.pair_id = p.pair_id
LEFT JOIN {p}st t ON t.pair_id = p.pair_id JOIN {p}ds d ON d.pair_id = p.pair_id""")


def row_parts(p: str, pairs: list[tuple[int, int, int]], keyed: dict[int, str]) -> None:
    """Row comparison: keyed by full join where a stable key exists, by EXCEPT ALL otherwise."""
    out = []
    for pair, old, new in pairs:
        common = sorted({n for n, _ in SCHEMA[old]} & {n for n, _ in SCHEMA[new]})
        kinds = dict(SCHEMA[old])
        norm = lambda t, n: f"round_sig({t}{n})" if kinds[n] != "str" else f"{t}{n}"
        pick = ", ".join(f"{n}::DOUBLE AS {n}" if kinds[n] != "str" else n for n in common)
        key = keyed.get(pair)
        if key:
            same = " AND ".join(f"a.{n} IS NOT DISTINCT FROM b.{n}" for n in common)
            out.append(f"""SELECT {pair}::BIGINT AS pair_id, 'stable_identifier_hash' AS method, '{key}' AS keys, count(*) FILTER (a.{key} IS NULL) AS added, count(*) FILTER (b.{key} IS NULL) AS removed,
 count(*) FILTER (a.{key} IS NOT NULL AND b.{key} IS NOT NULL AND NOT ({same})) AS modified, count(*) FILTER (a.{key} IS NOT NULL AND b.{key} IS NOT NULL AND {same}) AS unchanged,
 count(*) AS denom, count(a.{key}) + count(b.{key}) AS sides FROM (SELECT {pick} FROM v{old}) a FULL JOIN (SELECT {pick} FROM v{new}) b ON a.{key} = b.{key}""")
        else:
            out.append(f"""SELECT {pair}::BIGINT, 'row_hash_multiset', '', (SELECT count(*) FROM (SELECT {pick} FROM v{new} EXCEPT ALL SELECT {pick} FROM v{old})),
 (SELECT count(*) FROM (SELECT {pick} FROM v{old} EXCEPT ALL SELECT {pick} FROM v{new})), 0,
 (SELECT count(*) FROM (SELECT {pick} FROM v{old} INTERSECT ALL SELECT {pick} FROM v{new})),
 (SELECT count(*) FROM v{old}) + (SELECT count(*) FROM v{new}), (SELECT count(*) FROM v{old}) + (SELECT count(*) FROM v{new})""")
    part(f"{p}rd", "SELECT *, round((added + removed + modified)::DOUBLE / denom, 6) AS ratio, round((added + removed)::DOUBLE / sides, 6) AS turnover FROM (\n" + "\nUNION ALL ".join(out) + ")")


pair_parts("pp", "p")
row_parts("p", [(2, 1, 2), (3, 2, 3), (5, 4, 5), (7, 6, 7), (9, 8, 9), (11, 10, 11)], {2: "order_id", 3: "order_id", 9: "event_id", 11: "doc_id"})
part("ap", "SELECT a.version_id * 4294967296 + b.version_id AS pair_id, a.version_id AS prev, b.version_id AS cur, b.target FROM reg a JOIN reg b ON a.dataset_id = b.dataset_id AND a.version_number < b.version_number")
pair_parts("ap", "q")
ANY = {(a << 32) + b: (a, b) for a, b in ((1, 2), (1, 3), (2, 3), (4, 5), (6, 7), (8, 9), (10, 11))}
row_parts("q", [(pair, *ids) for pair, ids in ANY.items()], {pair: key for pair, (old, _) in ANY.items() for key in ({1: "order_id", 2: "order_id", 8: "event_id", 10: "doc_id"}.get(old),) if key})
