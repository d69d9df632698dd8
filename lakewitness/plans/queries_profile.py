"""Queries over the profile and comparison evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakewitness.operators import diff, profile
from lakewitness.plans.check_parts import pair_parts, row_parts
from lakewitness.plans.registry import part, query

r6 = lambda name: F.round(name, 6).alias(name)
# Means and deviations are compared at four decimals: at six, sums taken in another order can fall
# on either side of a rounding tie.
r4 = lambda name: F.round(name, 4).alias(name)


@query("D1_missing", "SELECT version_id, col AS \"column\", missing AS missing_count, missing_ratio FROM cp")
def _(ws):
    return ws.columns.select("version_id", "column", "missing_count", "missing_ratio")


@query("D2_unique", "SELECT version_id, col AS \"column\", uniq AS unique_count, unique_ratio FROM cp")
def _(ws):
    return ws.columns.select("version_id", "column", "unique_count", "unique_ratio")


@query("D3_numeric_statistics", """
SELECT version_id, col AS "column", round(mn, 4) AS min, round(q25, 4) AS q25, round(med, 4) AS median, round(q75, 4) AS q75, round(mx, 4) AS max,
       round(mean, 4) AS mean, round(sd, 4) AS std, round(skew, 4) + 0.0 AS skewness FROM cp WHERE isnum""")
def _(ws):
    # a skewness of zero has no sign
    return ws.columns.where("is_numeric").select("version_id", "column", *[r4(s) for s in profile.STATISTICS]).withColumn("skewness", F.col("skewness") + F.lit(0.0))


@query("D4_outliers", "SELECT version_id, col AS \"column\", outliers AS outlier_count, outlier_ratio FROM cp WHERE isnum")
def _(ws):
    return ws.columns.where("is_numeric").select("version_id", "column", "outlier_count", "outlier_ratio")


@query("D5_top_values", "SELECT version_id, col AS \"column\", rk AS rank, value, cnt FROM top")
def _(ws):
    return ws.tops


@query("D6_types_and_roles", "SELECT version_id, col AS \"column\", pos AS position, dtype AS logical_dtype, role FROM cp")
def _(ws):
    return ws.columns.select("version_id", "column", "position", "logical_dtype", "role")


@query("D7_high_correlations", "SELECT version_id, l AS \"left\", r AS \"right\", corr AS correlation FROM hc")
def _(ws):
    return ws.correlations


@query("D8_table_summary", "SELECT version_id, row_count, column_count, missing_cells, missing_ratio, numeric_columns, categorical_columns FROM tp")
def _(ws):
    return ws.tables.drop("duplicate_rows", "duplicate_ratio")


@query("D9_duplicate_rows", "SELECT version_id, duplicate_rows, duplicate_ratio FROM tp")
def _(ws):
    return ws.tables.select("version_id", "duplicate_rows", "duplicate_ratio")


@query("D10_class_distribution", "SELECT version_id, class, cnt, class_ratio FROM cls")
def _(ws):
    return ws.classes


@query("D10_classification_target", """
SELECT version_id, class_count, labelled AS labelled_rows, mincls AS min_class, maxcls AS max_class, minority AS minority_class, ratio AS imbalance_ratio FROM cls1""")
def _(ws):
    return ws.classification


@query("D11_regression_target", """
SELECT version_id, round(skew, 6) AS target_skewness, outliers AS target_outlier_count, missing_ratio AS target_missing_ratio, row_count - missing AS target_count,
       round(mn, 6) AS target_min, round(q25, 6) AS target_q25, round(med, 6) AS target_median, round(q75, 6) AS target_q75, round(mx, 6) AS target_max,
       round(mean, 6) AS target_mean, round(sd, 6) AS target_std FROM regr""")
def _(ws):
    rounded = ["target_skewness", *[f"target_{s}" for s in ("min", "q25", "median", "q75", "max", "mean", "std")]]
    return ws.regression.select("version_id", "target_outlier_count", "target_missing_ratio", "target_count", *[r6(c) for c in rounded])


@query("D12_clustering_features", """
SELECT version_id, selected_numeric, round(spread, 4) AS spread_ratio, spread > 10 AS scaling_required,
       round(selected_numeric::DOUBLE / row_count, 6) AS dimensionality_ratio, selected_numeric > greatest(20, row_count / 10) AS high_dimensional FROM clus""")
def _(ws):
    return ws.clustering


@query("D13_low_information", """
SELECT cp.version_id, cp.col AS "column", uniq AS unique_count, coalesce(cnt, 0) AS top_count FROM cp LEFT JOIN top ON cp.version_id = top.version_id AND cp.col = top.col AND rk = 1
WHERE role <> 'target' AND (uniq <= 1 OR coalesce(cnt, 0)::DOUBLE / row_count >= 0.98)""")
def _(ws):
    return profile.low_information(ws.columns, ws.tops)


@query("D14_worst_by_missing", """
SELECT version_id, rank, "column", measure FROM (SELECT version_id, col AS "column", missing_ratio AS measure, row_number() OVER (PARTITION BY version_id ORDER BY missing_ratio DESC, pos) AS rank
FROM cp WHERE missing > 0) WHERE rank <= 8""")
def _(ws):
    return profile.worst_columns(ws.columns, "missing")


@query("D14_worst_by_outliers", """
SELECT version_id, row_number() OVER (PARTITION BY version_id ORDER BY outliers DESC, pos) AS rank, col AS "column", outliers::DOUBLE AS measure FROM cp WHERE outliers > 0""")
def _(ws):
    return profile.worst_columns(ws.columns, "outlier", None)


@query("D15_compact_profile", """
SELECT cp.version_id, cp.col AS "column", role, dtype AS logical_dtype, missing AS missing_count, missing_ratio, uniq AS unique_count, outliers AS outlier_count, round(med, 6) AS median, t.top
FROM cp LEFT JOIN (SELECT version_id, col, string_agg(value || '=' || cnt, '|' ORDER BY rk) AS top FROM top WHERE rk <= 5 GROUP BY 1, 2) t ON cp.version_id = t.version_id AND cp.col = t.col""")
def _(ws):
    return profile.compact_profile(ws.columns, ws.tops).withColumn("median", F.round("median", 6))


# ------------------------------------------------------------------ version comparison

@query("E1_column_changes", "SELECT pair_id, col AS \"column\", status, dtype_changed FROM ppc")
def _(ws):
    return ws.diff.paired.select("pair_id", "column", "status", "dtype_changed")


@query("E2_changed_column_identity", """
SELECT pair_id, col AS "column", status, coalesce(bdt, adt) AS logical_dtype, coalesce(bm, am) AS missing_count, coalesce(bmr, amr) AS missing_ratio, coalesce(bu, au) AS unique_count
FROM ppc WHERE status <> 'common'""")
def _(ws):
    return diff.changed_column_identity(ws.diff.paired)


@query("E3_schema_events", "SELECT pair_id, col AS \"column\", change, severity FROM pev")
def _(ws):
    return diff.schema_events(ws.diff.paired)


@query("E3_schema_severity", "SELECT pair_id, round(raw, 6) AS raw_severity, round(s, 6) AS schema_score FROM pss")
def _(ws):
    scores = diff.schema_scores(ws.pairs, diff.schema_events(ws.diff.paired))
    return scores.select("pair_id", "raw_severity", r6("schema_score"))


@query("E4_missing_overall", """
SELECT pair_id, rows_prev AS row_count_previous, rows_cur AS row_count_current, column_change AS column_count_change, round(ma, 6) AS missing_ratio_previous,
       round(mb, 6) AS missing_ratio_current, round(mb - ma, 6) AS missing_ratio_change FROM pmo""")
def _(ws):
    return ws.diff.overall


@query("E5_missingness_changes", """
SELECT pair_id, col AS "column", is_target, am AS previous_count, bm AS current_count, dc AS count_delta, ar6 AS previous_ratio, br6 AS current_ratio, dr AS ratio_delta FROM pmc""")
def _(ws):
    return diff.missingness_changes(ws.diff.paired)


@query("E5_missingness_score", "SELECT pair_id, round(s, 6) AS missingness_score FROM pms")
def _(ws):
    return diff.missingness_scores(ws.diff.paired).select("pair_id", r6("missingness_score"))


@query("E6_duplicate_changes", """
SELECT pair_id, a.dups AS duplicates_previous, b.dups AS duplicates_current, b.dups - a.dups AS duplicates_delta FROM pp JOIN dup a ON a.version_id = prev JOIN dup b ON b.version_id = cur""")
def _(ws):
    return ws.diff.duplicates


@query("E7_stable_keys", "SELECT pair_id, rk AS rank, col AS \"column\" FROM psk")
def _(ws):
    return ws.diff.keys


ROWS_SQL = """
SELECT pair_id, method, keys AS key_columns, added AS rows_added, removed AS rows_removed, modified AS rows_modified, unchanged AS rows_unchanged, ratio AS change_ratio, turnover AS turnover_ratio
FROM prd WHERE method = '{}'"""


@query("E8_keyed_row_diff", ROWS_SQL.format("stable_identifier_hash"))
def _(ws):
    return ws.diff.rows.where(F.col("method") == "stable_identifier_hash")


@query("E9_multiset_row_diff", ROWS_SQL.format("row_hash_multiset"))
def _(ws):
    return ws.diff.rows.where(F.col("method") == "row_hash_multiset")


@query("E10_normalised_distinct_rows", """
SELECT 2::BIGINT AS version_id, count(*) AS distinct_rows, CAST(sum(c) AS BIGINT) AS row_count FROM (
  SELECT order_id, customer_key, order_state, format('{:.14e}', total_price) AS a, order_date, priority, format('{:.14e}', price_with_tax) AS b, ship_mode, count(*) AS c FROM v2 GROUP BY ALL)
UNION ALL
SELECT 5, count(*), CAST(sum(c) AS BIGINT) FROM (SELECT *, count(*) AS c FROM v5 GROUP BY ALL)""")
def _(ws):
    from lakewitness.functions.columns import row_digest
    from lakewitness.operators.value_counts import union_all

    rows = union_all([
        ws.frames[v].select(F.lit(v).cast("long").alias("version_id"), row_digest(ws.frames[v], ws.frames[v].columns, exact=[]).alias("row")) for v in (2, 5)
    ])
    counted = rows.groupBy("version_id", "row").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("version_id").agg(F.count(F.lit(1)).alias("distinct_rows"), F.sum("n").alias("row_count"))


SIDE_SQL = ", ".join(
    [f"round(round({s}_{m}, 6), 4) AS {n}_{m}" for s, n in (("a", "previous"), ("b", "current")) for m in ("mean", "median", "std", "min", "max")]
    + [f"round(round(coalesce(round(b_{m}, 6), 0) - coalesce(round(a_{m}, 6), 0), 6), 4) AS delta_{m}" for m in ("mean", "median", "std", "min", "max")]
)


@query("E11_numeric_summary", f"SELECT pair_id, col AS \"column\", is_target, {SIDE_SQL} FROM ppc WHERE status = 'common' AND both_num")
def _(ws):
    summary = diff.numeric_summary(ws.diff.paired)
    return summary.select("pair_id", "column", "is_target", *[r4(c) for c in summary.columns[3:]])


@query("E12_numeric_shift", "SELECT pair_id, col AS \"column\", round(shift, 6) AS shift FROM pns")
def _(ws):
    return ws.diff.numeric.select("pair_id", "column", r6("shift"))


@query("E13_change_level", """
SELECT pair_id, col AS "column", score AS shift_score, CASE WHEN score < 1 THEN 'negligible' WHEN score < 10 THEN 'minor' WHEN score < 30 THEN 'moderate' ELSE 'major' END AS level
FROM psh WHERE kind = 'numeric'""")
def _(ws):
    return ws.diff.shifts.where(F.col("kind") == "numeric").select(
        "pair_id", "column", "shift_score", diff.change_level(F.col("shift_score")).alias("level")
    )


@query("E14_category_changes", """
SELECT pair_id, col AS "column", label, o AS previous_count, w AS current_count, w - o AS count_delta, po AS previous_ratio, pw AS current_ratio, dr AS ratio_delta FROM pcc WHERE NOT both_num""")
def _(ws):
    return ws.diff.changes.where(~F.col("numeric_pair")).drop("is_target", "numeric_pair")


@query("E15_jensen_shannon", "SELECT pair_id, col AS \"column\", round(jsd, 6) AS distance FROM pcs WHERE NOT both_num")
def _(ws):
    return ws.diff.categories.where(~F.col("numeric_pair")).select("pair_id", "column", r6("distance"))


@query("E16_changed_labels", """
SELECT pair_id, col AS "column", label, CASE WHEN o = 0 THEN 'added' ELSE 'removed' END AS change FROM pcc WHERE NOT both_num AND (o = 0 OR w = 0)""")
def _(ws):
    return diff.changed_labels(ws.diff.changes)


@query("E17_top_category_changes", """
SELECT pair_id, "column", rank, label, previous_count, current_count, ratio_delta FROM (
  SELECT pair_id, col AS "column", is_target, row_number() OVER (PARTITION BY pair_id, col ORDER BY abs(dr) DESC, label) AS rank, label, o AS previous_count, w AS current_count, dr AS ratio_delta
  FROM pcc WHERE NOT both_num) WHERE rank <= CASE WHEN is_target THEN 20 ELSE 10 END""")
def _(ws):
    return diff.top_category_changes(ws.diff.changes)


@query("E18_target_shift", """
SELECT pair_id, col AS "column", CASE WHEN kind = 'numeric' THEN 'continuous' ELSE 'categorical' END AS mode, score AS shift_score FROM psh WHERE is_target""")
def _(ws):
    return diff.target_shift(ws.diff.shifts)


@query("E19_top_shifted_features", """
SELECT pair_id, rank, "column", kind, shift_score FROM (SELECT pair_id, row_number() OVER (PARTITION BY pair_id ORDER BY score DESC, col) AS rank, col AS "column", kind, score AS shift_score
FROM psh WHERE NOT is_target) WHERE rank <= 10""")
def _(ws):
    return diff.top_shifted(ws.diff.shifts)


@query("E20_categorical_structure", "SELECT pair_id, round(s, 6) AS structure_score FROM pst")
def _(ws):
    return diff.structure_scores(ws.diff.categories).select("pair_id", r6("structure_score"))


@query("E21_dsi", """
SELECT pair_id, round(m, 6) AS mean_feature_shift, round(x, 6) AS max_feature_shift, round(d, 6) AS drifted_feature_ratio, dsi AS dsi_score FROM pds""")
def _(ws):
    return diff.dsi_components(ws.pairs, ws.diff.shifts).select(
        "pair_id", r6("mean_feature_shift"), r6("max_feature_shift"), r6("drifted_feature_ratio"), "dsi_score"
    )


SCORES_SQL = """
SELECT pair_id, prev AS previous_version_id, cur AS current_version_id, scm_schema, scm_rows, scm_missingness, scm_structure AS scm_categorical_structure,
       dsi_mean AS dsi_mean_feature_shift, dsi_max AS dsi_max_feature_shift, dsi_ratio AS dsi_drifted_feature_ratio, scm AS scm_score, dsi AS dsi_score FROM {}"""


@query("E22_scm_dsi", SCORES_SQL.format("psc"))
def _(ws):
    return ws.diff.scores


@query("E23_compare_any_versions", SCORES_SQL.format("qsc"))
def _(ws):
    return ws.all_pairs.scores


# Requested: forwards, backwards, twice, a version with itself, across datasets, an unknown one.
REQUESTED = [(1, 3), (3, 1), (1, 3), (4, 4), (7, 6), (2, 5), (6, 99), (98, 99)]
part("rp", "SELECT DISTINCT a.version_id * 4294967296 + b.version_id AS pair_id, a.version_id AS prev, b.version_id AS cur, b.target FROM (VALUES "
     + ", ".join(f"({a}, {b})" for a, b in REQUESTED) + ") AS asked(p, c) JOIN reg a ON a.version_id = p JOIN reg b ON b.version_id = c WHERE a.dataset_id = b.dataset_id")
pair_parts("rp", "r")
row_parts("r", [((a << 32) + b, a, b) for a, b in ((1, 3), (3, 1), (4, 4), (7, 6))], {(1 << 32) + 3: "order_id", (3 << 32) + 1: "order_id"})


def requested(ws):
    return ws.spark.createDataFrame(REQUESTED, "previous_version_id long, current_version_id long")


@query("E23_compare_requested", SCORES_SQL.format("rsc"))
def _(ws):
    return ws.compare(requested(ws)).scores


@query("E23_refused_requests", "SELECT 2::BIGINT AS previous_version_id, 5::BIGINT AS current_version_id, 'different_datasets' AS reason UNION ALL SELECT 6, 99, 'unknown_version' UNION ALL SELECT 98, 99, 'unknown_version'")
def _(ws):
    return diff.refused_pairs(requested(ws), ws.registry)


DELTAS_SQL = ", ".join(f"round(coalesce(round(b_{m}, 6), 0) - coalesce(round(a_{m}, 6), 0), 6) AS delta_{m}" for m in ("mean", "median", "std", "min", "max"))


@query("E24_compact_diff", f"""
SELECT pair_id, "column", shift_score, round(delta_mean, 4) AS delta_mean, round(delta_median, 4) AS delta_median, round(delta_std, 4) AS delta_std, round(delta_min, 4) AS delta_min, round(delta_max, 4) AS delta_max FROM (SELECT c.pair_id, c.col AS "column", score AS shift_score, {DELTAS_SQL} FROM ppc c JOIN psh s ON c.pair_id = s.pair_id AND c.col = s.col AND kind = 'numeric')
WHERE shift_score > 0.001 OR abs(delta_mean) > 1e-6 OR abs(delta_median) > 1e-6 OR abs(delta_std) > 1e-6 OR abs(delta_min) > 1e-6 OR abs(delta_max) > 1e-6""")
def _(ws):
    compact = diff.compact_numeric_changes(diff.numeric_summary(ws.diff.paired), ws.diff.shifts)
    return compact.select("pair_id", "column", "shift_score", *[r4(c) for c in compact.columns[3:]])


part("facts0", """
SELECT pp.pair_id, cur AS version_id, (SELECT count(*) FROM ppc c WHERE c.pair_id = pp.pair_id AND status = 'added') AS added, (SELECT count(*) FROM ppc c WHERE c.pair_id = pp.pair_id AND status = 'removed') AS removed,
       (SELECT count(*) FROM ppc c WHERE c.pair_id = pp.pair_id AND dtype_changed) AS dtypes, (SELECT count(*) FROM pmc c WHERE c.pair_id = pp.pair_id) AS missings,
       (SELECT count(*) FROM psh s WHERE s.pair_id = pp.pair_id AND kind = 'numeric') AS nums, (SELECT count(*) FROM psh s WHERE s.pair_id = pp.pair_id AND kind = 'categorical' AND score > 0) AS cats,
       rows_cur - rows_prev AS row_change, round(mb - ma, 6) AS missing_change, b.dups - a.dups AS dup_change, rows_prev, rows_cur, ma, mb
FROM pp JOIN pmo ON pmo.pair_id = pp.pair_id JOIN dup a ON a.version_id = prev JOIN dup b ON b.version_id = cur""")


@query("E25_transition_label", """
SELECT reg.version_id, CASE WHEN parent_version_id IS NULL THEN 'Initial registration' WHEN added > 0 AND removed = 0 AND dtypes = 0 THEN 'Schema expansion' WHEN removed > 0 AND added = 0 THEN 'Schema reduction'
  WHEN added > 0 OR removed > 0 OR dtypes > 0 THEN 'Mixed structural update' WHEN row_change <> 0 THEN 'Row update' WHEN missing_change <> 0 THEN 'Metadata-quality update' ELSE 'Minimal measurable change' END AS transition
FROM reg LEFT JOIN facts0 ON reg.version_id = facts0.version_id""")
def _(ws):
    return diff.transition_labels(ws.registry, ws.diff.facts)


@query("E26_inferred_transformations", """
SELECT version_id, concat_ws('|', m, CASE WHEN t LIKE '%duplicate%' OR dup_change < 0 THEN 'Duplicate Removal' END, CASE WHEN regexp_matches(t, 'missing|imput') OR missings > 0 THEN 'Missing Value Handling' END,
  CASE WHEN removed > 0 THEN 'Feature Reduction' END, CASE WHEN added > 0 THEN 'Feature Addition' END) AS transformations
FROM (SELECT reg.version_id, CASE WHEN method <> 'manual' THEN replace(method, '_', ' ') END AS m, method || ' ' || coalesce(lower(notes), '') AS t, dup_change, missings, removed, added
      FROM reg LEFT JOIN facts0 ON reg.version_id = facts0.version_id)""")
def _(ws):
    return diff.inferred_transformations(ws.registry, ws.diff.facts)


@query("E28_significant_transitions", "SELECT pair_id, scm AS scm_score, dsi AS dsi_score FROM psc WHERE scm >= 30 OR dsi >= 30")
def _(ws):
    return diff.significant_transitions(ws.diff.scores)


@query("E29_change_story", """
SELECT pair_id, CASE WHEN s = '' THEN 'Revision has no material semantic changes reported.' ELSE s END AS story,
  CASE WHEN added > 0 OR removed > 0 OR dtypes > 0 THEN 'Schema changed, so feature compatibility and experiment comparability need review.'
       WHEN nums > 0 OR cats > 0 THEN 'Distribution changed, so downstream metrics and findings may shift.'
       WHEN missings > 0 THEN 'Missingness changed, so preprocessing and diagnosis should be reviewed.' ELSE 'No major semantic movement reported; this version appears comparable with its parent.' END AS implication
FROM (SELECT *, concat_ws(', ', CASE WHEN row_change <> 0 THEN (CASE WHEN row_change > 0 THEN '+' ELSE '' END) || row_change || ' net rows' END, CASE WHEN added > 0 THEN added || ' columns added' END,
  CASE WHEN removed > 0 THEN removed || ' columns removed' END, CASE WHEN missings > 0 THEN missings || ' missingness changes' END, CASE WHEN nums > 0 THEN nums || ' numeric shifts' END) AS s FROM facts0)""")
def _(ws):
    return diff.change_stories(ws.diff.facts)


@query("E30_reconstructed_quality", """
SELECT pair_id, 'previous' AS side, CAST(round(round(ma, 6) * rows_prev * column_count) AS BIGINT) AS missing_cells, dups AS duplicate_rows FROM facts0 JOIN pp USING (pair_id) JOIN tp ON tp.version_id = prev JOIN dup ON dup.version_id = prev
UNION ALL SELECT pair_id, 'current', CAST(round(round(mb, 6) * rows_cur * column_count) AS BIGINT), dups FROM facts0 JOIN pp USING (pair_id) JOIN tp ON tp.version_id = cur JOIN dup ON dup.version_id = cur""")
def _(ws):
    unprofiled = ws.tables.where(F.col("missing_ratio") < 0)
    return diff.reconstructed_quality(ws.pairs, ws.diff.overall, ws.diff.duplicates, ws.versions, unprofiled)
