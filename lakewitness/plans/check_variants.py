"""Check SQL of built variants: the planned steps over rows in long form, then the same profile and diagnosis parts.

A table is (rid, pos, col, base, value, num), one row per cell. Steps are written once each, for any table; the chains below
are those the planner gives for the build requests, and a variant counts only where the planner's steps say so too.
"""

from __future__ import annotations

import re

from lakewitness.plans.check_parts import BASE, SCHEMA, lit
from lakewitness.plans.registry import PARTS, part
from lakewitness.plans.workspace import VERSION_ROWS

# version, goal, candidates, most features
BUILD = [(2, "maximize_accuracy", 4, None), (5, "lightweight_dataset", 4, 4), (7, "explainable_model", 2, None)]
FIRST_VARIANT = 1001
CHAINS = {
    2: ["onehot_encoding,mutual_information,standard_scaler", "label_encoding,correlation_filter,robust_scaler", "onehot_encoding,variance_threshold,minmax_scaler", "label_encoding,mutual_information,standard_scaler"],
    5: ["drop_duplicates,label_encoding,variance_threshold,minmax_scaler", "drop_duplicates,onehot_encoding,correlation_filter,standard_scaler", "drop_duplicates,label_encoding,variance_threshold,robust_scaler", "drop_duplicates,onehot_encoding,correlation_filter,minmax_scaler"],
    7: ["label_encoding,iqr_filtering,standard_scaler", "onehot_encoding,clip_outliers,minmax_scaler"],
}
TARGET = {row[0]: row[10] or "" for row in VERSION_ROWS}


def cells(table: str, version: int) -> str:
    """The long form of a wide table that has row numbers."""
    out = []
    for pos, (name, kind) in enumerate(SCHEMA[version], 1):
        value, num = (name, "NULL::DOUBLE") if kind == "str" else ("NULL::VARCHAR", f"{name}::DOUBLE")
        out.append(f"SELECT rid, {pos} AS pos, '{name}' AS col, '{BASE[kind]}' AS base, {value} AS value, {num} AS num FROM {table}")
    return "\nUNION ALL ".join(out)


def scaled(centre: str, spread: str):
    return lambda r, numeric, text: f"""
WITH med AS (SELECT col AS c, quantile_cont(num, 0.5) AS m FROM {r} WHERE {numeric} GROUP BY 1),
full_ AS (SELECT rid, pos, col, base, value, CASE WHEN {numeric} THEN coalesce(num, m) ELSE num END AS num FROM {r} LEFT JOIN med ON c = col),
fit AS (SELECT col AS c, {centre} AS centre, {spread} AS spread FROM full_ WHERE {numeric} GROUP BY 1)
SELECT rid, pos, col, CASE WHEN {numeric} THEN 'float64' ELSE base END AS base, value,
  CASE WHEN {numeric} THEN (num - centre) / CASE WHEN spread = 0 THEN 1 ELSE spread END ELSE num END AS num FROM full_ LEFT JOIN fit ON c = col"""


def limited(r: str, numeric: str, target: str, k: int) -> str:
    """The widest numeric features; only tables without a target are limited here."""
    assert not target
    return f"""
SELECT * FROM {r} WHERE col IN (SELECT col FROM (SELECT col, bool_or({numeric}) AS isnum, coalesce(var_samp(num), 0) AS v FROM {r} GROUP BY 1) ORDER BY isnum DESC, CASE WHEN isnum THEN -v ELSE 0 END, col LIMIT {k})"""


STEPS = {
    "label_encoding": lambda r, numeric, text: f"""
SELECT rid, pos, col, CASE WHEN {text} THEN 'float64' ELSE base END AS base, CASE WHEN NOT ({text}) THEN value END AS value, CASE WHEN {text} THEN code ELSE num END::DOUBLE AS num
FROM {r} LEFT JOIN (SELECT col AS c, value AS v, row_number() OVER (PARTITION BY col ORDER BY value) - 1 AS code FROM (SELECT DISTINCT col, value FROM {r} WHERE {text} AND value IS NOT NULL)) ON c = col AND v = value""",
    "onehot_encoding": lambda r, numeric, text: f"""
WITH seen AS (SELECT DISTINCT pos, col, value FROM {r} WHERE {text} AND value IS NOT NULL),
few AS (SELECT col FROM seen GROUP BY 1 HAVING count(*) <= 20),
named AS (SELECT col AS c, value AS v, row_number() OVER (PARTITION BY col ORDER BY value) AS nth, row_number() OVER (PARTITION BY lower(col || '_' || value) ORDER BY pos, value) AS k FROM seen WHERE col IN (SELECT col FROM few)),
flags AS (SELECT c, v, nth, c || '_' || v || CASE WHEN k > 1 THEN '_' || k ELSE '' END AS name FROM named)
SELECT * FROM {r} WHERE col NOT IN (SELECT col FROM few)
UNION ALL SELECT rid, 1000 + pos * 100 + nth, name, 'int64', NULL, coalesce(value = v, false)::INT::DOUBLE FROM {r} JOIN flags ON c = col""",
    "variance_threshold": lambda r, numeric, text: f"SELECT * FROM {r} WHERE col NOT IN (SELECT col FROM {r} WHERE {numeric} GROUP BY 1 HAVING var_samp(num) < 0.01)",
    "correlation_filter": lambda r, numeric, text: f"""
WITH n AS (SELECT rid, pos, col, num FROM {r} WHERE {numeric} AND num IS NOT NULL),
strong AS (SELECT a.col AS l, b.col AS r FROM n a JOIN n b ON a.rid = b.rid AND a.pos < b.pos GROUP BY 1, 2 HAVING isfinite(corr(a.num, b.num)) AND abs(corr(a.num, b.num)) >= 0.9),
vars AS (SELECT col AS c, var_samp(num) AS v FROM n GROUP BY 1)
SELECT * FROM {r} WHERE col NOT IN (SELECT CASE WHEN y.v < x.v THEN r ELSE l END FROM strong JOIN vars x ON x.c = l JOIN vars y ON y.c = r)""",
    # at most 20 numeric features: all stay
    "mutual_information": lambda r, numeric, text: f"SELECT * FROM {r} WHERE (SELECT count(DISTINCT col) FROM {r} WHERE {numeric}) <= 20",
    "iqr_filtering": lambda r, numeric, text: f"""
WITH f AS (SELECT col AS c, quantile_cont(num, 0.25) AS a, quantile_cont(num, 0.75) AS b FROM {r} WHERE {numeric} GROUP BY 1)
SELECT * FROM {r} WHERE rid NOT IN (SELECT rid FROM {r} JOIN f ON c = col WHERE num < a - 1.5 * (b - a) OR num > b + 1.5 * (b - a))""",
    "clip_outliers": lambda r, numeric, text: f"""
WITH f AS (SELECT col AS c, quantile_cont(num, 0.01) AS a, quantile_cont(num, 0.99) AS b FROM {r} WHERE {numeric} GROUP BY 1)
SELECT rid, pos, col, CASE WHEN {numeric} THEN 'float64' ELSE base END AS base, value, CASE WHEN {numeric} AND num IS NOT NULL THEN least(greatest(num, a), b) ELSE num END AS num FROM {r} LEFT JOIN f ON c = col""",
    "standard_scaler": scaled("avg(num)", "stddev_pop(num)"),
    "robust_scaler": scaled("quantile_cont(num, 0.5)", "quantile_cont(num, 0.75) - quantile_cont(num, 0.25)"),
    "minmax_scaler": scaled("min(num)", "max(num) - min(num)"),
}


def chain_parts(version: int, chain: str, most: int | None) -> str:
    """Registers the parts of a chain; the name of the last one."""
    steps = chain.split(",")
    numeric, text = f"(base <> 'object' AND col <> '{TARGET[version]}')", f"(base = 'object' AND col <> '{TARGET[version]}')"
    distinct = steps[0] == "drop_duplicates"
    name = f"b{version}" + "d" * distinct
    part(f"{name}w", f"SELECT *, row_number() OVER () AS rid FROM {f'(SELECT DISTINCT * FROM v{version})' if distinct else f'v{version}'}")
    part(name, cells(f"{name}w", version))
    for step in steps[distinct:]:
        if most is not None and step.endswith("_scaler"):
            part(f"{name}_lim", limited(name, numeric, TARGET[version], most))
            name = f"{name}_lim"
        part(f"{name}_{step[:4]}", STEPS[step](name, numeric, text))
        name = f"{name}_{step[:4]}"
    return name


FINAL = {(v, chain): chain_parts(v, chain, most) for v, _, _, most in BUILD for chain in CHAINS[v]}
SOURCES = ", ".join(str(v) for v, *_ in BUILD)
part("bplan", f"""
SELECT {FIRST_VARIANT - 1} + row_number() OVER (ORDER BY request_id, candidate) AS version_id, request_id AS job_id, goal, candidate, 'V' || request_id || '-' || pipeline_id AS pipeline_id, version_id AS source_version_id, estimated_cost, steps
FROM ccost WHERE """ + " OR ".join(f"(version_id = {v} AND goal = '{g}' AND candidate < {n})" for v, g, n, _ in BUILD))
part("bcells", "\nUNION ALL ".join(
    f"SELECT version_id, rid, pos, col, base, value, num FROM {name} JOIN (SELECT version_id FROM bplan WHERE source_version_id = {v} AND steps = '{chain}') ON true" for (v, chain), name in FINAL.items()
))
part("xcells", f"SELECT version_id, col, value, num FROM bcells UNION ALL SELECT version_id, col, value, num FROM cells WHERE version_id IN ({SOURCES})")
part("xcat", f"SELECT version_id, row_number() OVER (PARTITION BY version_id ORDER BY pos) AS pos, col, base FROM (SELECT DISTINCT version_id, pos, col, base FROM bcells) UNION ALL SELECT * FROM cat WHERE version_id IN ({SOURCES})")
part("xreg", f"""
SELECT p.version_id, study_id, dataset_id, dataset_name, highest + row_number() OVER (PARTITION BY dataset_id ORDER BY p.version_id) AS version_number, p.source_version_id AS parent_version_id, 'variant_generator' AS method,
  'Auto-generated variant — ' || pipeline_id || ' (Job ' || job_id || ')' AS notes, created_at, task, target, metric, validation, mode, selected, scaling
FROM bplan p JOIN reg ON reg.version_id = p.source_version_id JOIN (SELECT dataset_id AS d, max(version_number) AS highest FROM reg GROUP BY 1) ON d = dataset_id
UNION ALL SELECT version_id, study_id, dataset_id, dataset_name, version_number, NULL, method, notes, created_at, task, target, metric, validation, mode, selected, scaling FROM reg WHERE version_id IN ({SOURCES})""")
part("xdup", f"""
SELECT version_id, count(*) - count(DISTINCT row_) AS dups FROM (SELECT version_id, rid, list((value, num) ORDER BY pos) AS row_ FROM bcells GROUP BY 1, 2) GROUP BY 1 UNION ALL SELECT version_id, dups FROM dup WHERE version_id IN ({SOURCES})""")
part("xhc", f"""
SELECT a.version_id, a.col AS l, b.col AS r, round(corr(a.num, b.num), 6) AS corr FROM bcells a JOIN bcells b ON a.version_id = b.version_id AND a.rid = b.rid AND a.pos < b.pos
WHERE a.base <> 'object' AND b.base <> 'object' AND a.num IS NOT NULL AND b.num IS NOT NULL GROUP BY 1, 2, 3 HAVING isfinite(corr(a.num, b.num)) AND abs(corr(a.num, b.num)) >= 0.8
UNION ALL SELECT version_id, l, r, corr FROM hc WHERE version_id IN ({SOURCES})""")
part("xpsc", "SELECT NULL::BIGINT AS cur, NULL::DOUBLE AS scm, NULL::DOUBLE AS dsi WHERE false")

COPIED = ["vc", "stats", "outl", "cp", "tp", "cls", "cls1", "regr", "clus", "edges", "reach", "clu", "pp", "ppc", "pmo", "pmc", "wor", "fx", "flg", "assoc", "lk", "imb", "rc", "rs", "fnd0", "fnd", "alone", "bal", "sch"]
_OWN = ["cells", "cat", "reg", "dup", "hc", "psc"]


def copy_parts() -> None:
    """The profile and diagnosis parts once more, over the built variants; their names start with x."""
    names = re.compile(r"\b(" + "|".join(COPIED + _OWN) + r")\b")
    for name in COPIED:
        part(f"x{name}", names.sub(r"x\1", PARTS[name]))


__all__ = ["BUILD", "CHAINS", "FIRST_VARIANT", "copy_parts", "lit"]
