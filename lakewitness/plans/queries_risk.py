"""Queries over findings, risk scores and the diagnosis contract."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakewitness.lookups import RISK_FAMILIES
from lakewitness.operators import contract, diagnosis, diff
from lakewitness.plans.check_parts import SCHEMA
from lakewitness.plans.check_parts_risk import COMPONENT_SQL
from lakewitness.plans.registry import part, query
from lakewitness.session import cut

V = "version_id"


def finding_query(name: str, code: str) -> None:
    sql = f"SELECT version_id, code, severity, array_to_string(cols, ',') AS columns, round(measure, 6) AS measure FROM fnd WHERE code = '{code}'"

    @query(name, sql)
    def _(ws):
        return ws.findings.where(F.col("code") == code).select(
            V, "code", "severity", F.concat_ws(",", "columns").alias("columns"), F.round("measure", 6).alias("measure")
        )


for name, code in {
    "F1_missingness_finding": "MISSINGNESS",
    "F2_duplicates_finding": "DUPLICATES",
    "F3_outliers_finding": "OUTLIERS",
    "F4_correlation_finding": "CORRELATION",
    "F5_class_imbalance_finding": "CLASS_IMBALANCE",
    "F6_target_skew_finding": "TARGET_SKEW",
    "F7_scaling_finding": "SCALING",
    "F8_target_leakage_finding": "TARGET_LEAKAGE",
}.items():
    finding_query(name, code)


@query("F9_all_findings", "SELECT version_id, ordinal, code, severity, issue, risk, recommendation FROM fnd")
def _(ws):
    return ws.findings.select(V, "ordinal", "code", "severity", "issue", "risk", "recommendation")


def component_query(name: str, family: str, component: str) -> None:
    sql = f"SELECT version_id, round(score, 4) AS score FROM rc WHERE family = '{family}' AND component = '{component}'"

    @query(name, sql)
    def _(ws):
        rows = ws.components.where((F.col("family") == family) & (F.col("component") == component))
        return rows.select(V, F.round("score", 4).alias("score"))


for name, family, component in [
    ("F11_missingness_points", "mlrs", "missingness"),
    ("F12_duplicates_points", "mlrs", "duplicates"),
    ("F13_imbalance_points", "mlrs", "imbalance"),
    ("F14_outliers_points", "mlrs", "outliers"),
    ("F15_correlation_points", "mlrs", "correlation_redundancy"),
    ("F17_target_quality_points", "mlrs", "target_quality"),
    ("F18_evolution_readiness_points", "mlrs", "evolution_readiness"),
]:
    component_query(name, family, component)


@query("F10_component_scores", "SELECT version_id, family, component, round(score, 2) AS score FROM rc")
def _(ws):
    return ws.components.select(V, "family", "component", F.round("score", 2).alias("score"))


@query("F16_correlation_clusters", "SELECT version_id, cluster, col AS \"column\", size FROM clu")
def _(ws):
    return ws.correlation_clusters


@query("F19_worsened_columns", "SELECT pair_id, col AS \"column\", dr AS ratio_delta FROM pmc WHERE dr > 0 AND NOT is_target")
def _(ws):
    changes = diff.missingness_changes(ws.diff.paired)
    return changes.where((F.col("ratio_delta") > 0) & ~F.col("is_target")).select("pair_id", "column", "ratio_delta")


@query("F20_mlrs", "SELECT version_id, mlrs_score FROM rs")
def _(ws):
    return ws.risks.select(V, "mlrs_score")


def leak_query(name: str, kinds: list[str]) -> None:
    listed = ", ".join(f"'{k}'" for k in kinds)

    @query(name, f"SELECT version_id, col AS \"column\", kind FROM lk WHERE kind IN ({listed})")
    def _(ws):
        return ws.leakage.where(F.col("kind").isin(*kinds))


leak_query("F21_target_like_names", ["target_like"])
leak_query("F22_post_outcome_names", ["post_outcome"])
leak_query("F23_identifier_columns", ["identifier"])
leak_query("F25_direct_and_proxy_features", ["direct", "proxy"])


@query("F24_target_associations", "SELECT version_id, feature, association, 'numeric_correlation' AS association_type FROM assoc")
def _(ws):
    return diagnosis.target_association_pairs(ws.correlations, ws.configurations)


@query("F26_diminishing_points", """
SELECT version_id, count(*) AS identifiers, round(least(8, 2.5 * (1 - pow(0.6::DOUBLE, count(*))) / 0.4), 6)::DOUBLE AS points FROM lk WHERE kind = 'identifier' GROUP BY 1""")
def _(ws):
    counts = ws.leakage.where(F.col("kind") == "identifier").groupBy(V).agg(F.count(F.lit(1)).alias("identifiers"))
    return counts.withColumn("points", F.round(diagnosis.diminishing(F.col("identifiers"), 2.5, 8.0), 6))


@query("F27_lrs_components", "SELECT version_id, component, round(score, 2) AS score, lrs_score FROM rc JOIN rs USING (version_id) WHERE family = 'lrs'")
def _(ws):
    return ws.components.where(F.col("family") == "lrs").join(ws.risks, V).select(V, "component", F.round("score", 2).alias("score"), "lrs_score")


@query("F28_reproducibility", """
SELECT version_id, CASE WHEN parent_version_id IS NOT NULL OR version_number = 1 THEN 0 ELSE 25 END::DOUBLE AS missing_parent, CASE WHEN coalesce(notes, '') = '' THEN 15 ELSE 0 END::DOUBLE AS undocumented_version,
       round(least(50, coalesce(scm, 0) * 0.5), 2)::DOUBLE AS semantic_change, round(least(35, coalesce(dsi, 0) * 0.35), 2)::DOUBLE AS dataset_shift FROM fx""")
def _(ws):
    return diagnosis.reproducibility_components(ws.facts)


def details(ws):
    behind = diagnosis.component_columns(
        ws.columns, ws.correlations, ws.leakage, diff.missingness_changes(ws.diff.paired), ws.configurations
    )
    return diagnosis.component_details(ws.components, behind)


@query("F29_component_details", "SELECT * FROM cdet")
def _(ws):
    return details(ws)


@query("F30_component_evidence", """
SELECT version_id, missing_ratio AS overall_missing_ratio, round(affected, 6) AS affected_feature_ratio, maxmiss AS max_feature_missing_ratio, mw AS overall_missingness_worsening,
       cw AS max_feature_missingness_worsening, round(dw, 6) AS duplicate_ratio_worsening, tw AS target_missingness_worsened FROM fx""")
def _(ws):
    return diagnosis.component_evidence(ws.facts)


@query("F31_intervention_hints", """
SELECT version_id, row_number() OVER (PARTITION BY version_id ORDER BY score DESC, ordinal) AS rank, family, component, score, columns, next_action AS recommended_action, effect AS expected_effect FROM cdet WHERE score > 0""")
def _(ws):
    return diagnosis.intervention_hints(details(ws))


CONFLICT_SQL = """
SELECT {v}::BIGINT AS version_id, CAST(coalesce(sum(n) FILTER (t > 1), 0) AS BIGINT) AS conflicting_rows, round(coalesce(sum(n) FILTER (t > 1), 0)::DOUBLE / sum(n), 6) AS conflict_ratio
FROM (SELECT count(DISTINCT coalesce({target}, '<none>')) AS t, count(*) AS n FROM v{v} GROUP BY {features})"""


@query("F32_conflicting_duplicates", CONFLICT_SQL.format(v=5, target="line_state", features="order_key, part_key, supplier_key, line_number, quantity, extended_price, discount, tax, return_flag")
       + " UNION ALL " + """
SELECT 901, CAST(coalesce(sum(n) FILTER (t > 1), 0) AS BIGINT), round(coalesce(sum(n) FILTER (t > 1), 0)::DOUBLE / sum(n), 6) FROM (SELECT count(DISTINCT order_state) AS t, count(*) AS n FROM v1 GROUP BY priority, customer_key)""")
def _(ws):
    narrow = ws.frames[1].select("priority", "customer_key", "order_state")
    return diagnosis.conflicting_duplicates(ws.frames[5], 5, "line_state").unionByName(
        diagnosis.conflicting_duplicates(narrow, 901, "order_state")
    )


@query("F33_split_overlap", """
SELECT 10::BIGINT AS version_id, count(*) FILTER (s > 1) AS overlapping_entities, CAST(coalesce(sum(n) FILTER (s > 1), 0) AS BIGINT) AS overlapping_rows, round(coalesce(sum(n) FILTER (s > 1), 0)::DOUBLE / sum(n), 6) AS overlap_ratio
FROM (SELECT body, count(DISTINCT source IN ('src0', 'src1', 'src2')) AS s, count(*) AS n FROM v10 GROUP BY body)""")
def _(ws):
    marked = ws.frames[10].withColumn("split", F.when(F.col("source").isin("src0", "src1", "src2"), "test").otherwise("train"))
    return diagnosis.split_overlap(marked, 10, "split", ["body"])


ASSOC_SQL = """
SELECT {v}::BIGINT AS version_id, feature, 1.0::DOUBLE AS association, CASE WHEN same = n THEN 'exact_copy' WHEN vals = 2 AND images = 2 THEN 'inverse_mapping' ELSE 'deterministic_mapping' END AS association_type FROM (
  SELECT feature, count(*) AS vals, max(k) AS k, sum(n) AS n, sum(same) AS same, count(DISTINCT t) AS images FROM (
    SELECT feature, v, count(DISTINCT t) AS k, count(*) AS n, min(t) AS t, count(*) FILTER (v = t) AS same FROM (
      {cells}) WHERE v IS NOT NULL AND t IS NOT NULL GROUP BY 1, 2) GROUP BY 1)
WHERE k = 1 AND (same = n OR (vals = 2 AND images = 2) OR vals * 2 <= n)"""


def assoc_cells(v: int, target: str) -> str:
    from lakewitness.plans.check_parts import SCHEMA

    return " UNION ALL ".join(
        f"SELECT '{n}' AS feature, {n + '::DOUBLE::VARCHAR' if k != 'str' else n} AS v, {target} AS t FROM v{v}" for n, k in SCHEMA[v] if n != target
    )


@query("F34_target_association_producer", " UNION ALL ".join(ASSOC_SQL.format(v=v, cells=assoc_cells(v, t)) for v, t in ((3, "order_state"), (8, "outcome_class"))))
def _(ws):
    return diagnosis.target_associations(ws.frames[3], 3, "order_state").unionByName(
        diagnosis.target_associations(ws.frames[8], 8, "outcome_class")
    )


# ---- the same scores with what F32 to F34 measure, for three versions
MEASURED = {3: "order_state", 8: "outcome_class", 10: "quality"}
part("mconf", " UNION ALL ".join(CONFLICT_SQL.format(v=v, target=t, features=", ".join(n for n, _ in SCHEMA[v] if n != t)) for v, t in MEASURED.items()))
part("mover", """
SELECT 10::BIGINT AS version_id, round(coalesce(sum(n) FILTER (s > 1), 0)::DOUBLE / sum(n), 6) AS overlap_ratio FROM (SELECT body, count(DISTINCT source) AS s, count(*) AS n FROM v10 GROUP BY body)""")
part("massoc", " UNION ALL ".join(ASSOC_SQL.format(v=v, cells=assoc_cells(v, t)) for v, t in MEASURED.items()))
part("mlk", "SELECT version_id, col, kind FROM lk UNION SELECT version_id, feature, 'direct' FROM massoc WHERE association >= 0.999")
MEASURED_SQL = COMPONENT_SQL | {
    ("mlrs", "duplicates"): "least(10, duplicate_ratio * 100) + least(8, coalesce(conflict_ratio, 0) * 120)",
    ("lrs", "split_contamination"): "CASE WHEN coalesce(overlap_ratio, 0) > 0 THEN least(12, overlap_ratio * 100) ELSE least(4, duplicate_ratio * 25) END",
}
part("mrc", "\nUNION ALL ".join(
    f"SELECT fx.version_id, '{f}' AS family, '{k}' AS component, {i} AS ordinal, ({sql.replace('lk WHERE lk.', 'mlk WHERE mlk.')})::DOUBLE AS score FROM fx JOIN imb ON imb.version_id = fx.version_id "
    "LEFT JOIN mconf ON mconf.version_id = fx.version_id LEFT JOIN mover ON mover.version_id = fx.version_id"
    for i, ((f, k), sql) in enumerate(MEASURED_SQL.items())
))


@query("F27_measured_scores", """
SELECT version_id, round(max(CASE WHEN component = 'duplicates' THEN score END), 4) AS duplicates, round(max(CASE WHEN component = 'direct_target_leakage' THEN score END), 4) AS direct, round(max(CASE WHEN component = 'split_contamination' THEN score END), 4) AS split,
  round_even(least(100, sum(score ORDER BY ordinal) FILTER (family = 'mlrs')), 2)::DOUBLE AS mlrs_score, round_even(least(100, sum(score ORDER BY ordinal) FILTER (family = 'lrs')), 2)::DOUBLE AS lrs_score FROM mrc GROUP BY 1""")
def _(ws):
    conflicts, overlap, associations = diagnosis.measured_evidence({v: ws.frames[v] for v in MEASURED}, ws.configurations, {10: ("source", ["body"])})
    leakage = diagnosis.leakage_features(ws.columns, ws.correlations, ws.configurations, associations)
    components = cut(diagnosis.risk_components(ws.facts, leakage, conflicts, overlap))
    of = lambda name: F.round(F.max(F.when(F.col("component") == name, F.col("score"))), 4)
    parts = components.groupBy("version_id").agg(of("duplicates").alias("duplicates"), of("direct_target_leakage").alias("direct"), of("split_contamination").alias("split"))
    return parts.join(diagnosis.risk_scores(components), "version_id")


@query("F35_severity_counts", """
SELECT version_id, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low,
       arg_max(severity, sr) AS highest FROM fnd JOIN sevrank USING (severity) GROUP BY 1""")
def _(ws):
    return diagnosis.severity_counts(ws.findings)


TONE = "CASE WHEN {0} >= 70 THEN 'critical' WHEN {0} >= 45 THEN 'high' WHEN {0} >= 20 THEN 'medium' ELSE 'low' END"


@query("F36_risk_tone", f"SELECT version_id, {TONE.format('mlrs_score')} AS mlrs_tone, {TONE.format('lrs_score')} AS lrs_tone FROM rs")
def _(ws):
    return ws.risks.select(
        V, diagnosis.risk_tone(F.col("mlrs_score")).alias("mlrs_tone"), diagnosis.risk_tone(F.col("lrs_score")).alias("lrs_tone")
    )


part("cons", """
SELECT version_id, col, CAST(sum(cnt) AS BIGINT) AS cells_n, CAST(coalesce(sum(cnt) FILTER (sp > 1), 0) AS BIGINT) AS affected FROM (
  SELECT vc.version_id, vc.col, cnt, count(*) OVER (PARTITION BY vc.version_id, vc.col, trim(regexp_replace(lower(replace(replace(value, '_', ' '), '-', ' ')), '\\s+', ' ', 'g'))) AS sp
  FROM vc JOIN cp ON vc.version_id = cp.version_id AND vc.col = cp.col WHERE value IS NOT NULL AND NOT isnum AND role <> 'target') GROUP BY 1, 2""")


@query("F37_quality_scores", """
SELECT fx.version_id, round(100 - missing_ratio * 100, 2) AS completeness, round(100 - duplicate_ratio * 100, 2) AS uniqueness, round(100 - coalesce(bad, 0) * 100, 2) AS consistency,
       round(100 - outs::DOUBLE / greatest(row_count * greatest(nf, 1), 1) * 100, 2) AS outlier_health, round(least(100, coalesce(mincls::DOUBLE / labelled * 100, 0) * 2), 2) AS class_balance,
       round(100 - lrs_score, 2) AS leakage_safety, round(100 - cst::DOUBLE / column_count * 50 - hic::DOUBLE / column_count * 30, 2) AS schema_quality,
       round(100 - coalesce(inv, 0) * 100, 2) AS validity
FROM fx JOIN rs USING (version_id)
JOIN (SELECT version_id, coalesce(sum(outliers) FILTER (role <> 'target' AND isnum), 0) AS outs, count(*) FILTER (role <> 'target' AND isnum) AS nf, count(*) FILTER (uniq <= 1) AS cst,
        count(*) FILTER (role <> 'target' AND NOT isnum AND unique_ratio >= 0.5 AND uniq >= 20) AS hic FROM cp GROUP BY 1) s USING (version_id)
LEFT JOIN (SELECT version_id, sum(affected)::DOUBLE / sum(cells_n) AS bad FROM cons GROUP BY 1) c USING (version_id)
LEFT JOIN (SELECT version_id, (sum(cnt) - coalesce(sum(cnt) FILTER (lower(trim(class)) IN ('f', 'o', 'ok', 'error', 'good', 'bad')), 0))::DOUBLE / sum(cnt) AS inv FROM cls GROUP BY 1) d USING (version_id)""")
def _(ws):
    ws.ahead()
    valid = diagnosis.valid_target_rows(ws.classes, ["f", "o", "ok", "error", "good", "bad"])
    return diagnosis.quality_scores(ws.facts, ws.columns, diagnosis.categorical_consistency(ws.vc, ws.columns), ws.risks, valid)


@query("F38_categorical_consistency", "SELECT version_id, col AS \"column\", cells_n AS cells, affected AS affected_cells FROM cons")
def _(ws):
    return diagnosis.categorical_consistency(ws.vc, ws.columns)


@query("F39_leakage_features", "SELECT version_id, array_to_string(list_sort(list_distinct(list(col))), ',') AS features FROM lk GROUP BY 1")
def _(ws):
    return diagnosis.leakage_feature_list(ws.leakage)


@query("F40_score_deltas", """
SELECT version_id, mlrs_score, lrs_score, round(mlrs_score - lag(mlrs_score) OVER w, 2) AS mlrs_delta, round(lrs_score - lag(lrs_score) OVER w, 2) AS lrs_delta FROM reg JOIN rs USING (version_id)
WINDOW w AS (PARTITION BY dataset_id ORDER BY version_number)""")
def _(ws):
    return diagnosis.score_deltas(ws.registry, ws.risks)


part("figures", """
SELECT version_id, unnest(['Rows', 'Columns/features', 'Missing cells', 'Duplicates', 'MLRS', 'LRS']) AS metric, unnest(['n', 'n', 'l', 'l', 'l', 'l']) AS mode,
  unnest([row_count::DOUBLE, column_count::DOUBLE, missing_cells::DOUBLE, duplicate_rows::DOUBLE, mlrs_score, lrs_score]) AS figure FROM tp JOIN rs USING (version_id)""")


@query("E27_before_after", """
SELECT version_id, metric, before, after, delta, direction, CASE WHEN direction = 'flat' THEN 'Stable' WHEN mode = 'n' THEN 'Changed' WHEN direction = 'down' THEN 'Improved' ELSE 'Increased risk' END AS meaning FROM (
  SELECT c.version_id, f.metric, f.mode, p.figure AS before, f.figure AS after, round(f.figure - p.figure, 6) AS delta, CASE WHEN round(f.figure - p.figure, 6) > 0 THEN 'up' WHEN round(f.figure - p.figure, 6) < 0 THEN 'down' ELSE 'flat' END AS direction
  FROM reg c JOIN figures f ON f.version_id = c.version_id JOIN figures p ON p.version_id = c.parent_version_id AND p.metric = f.metric)""")
def _(ws):
    ws.ahead()
    return diff.before_after(ws.registry, ws.tables, ws.risks)


# ------------------------------------------------------------------ contract

@query("G1_affected_columns", "SELECT version_id, code, array_to_string(list_sort(list_distinct(cols)), ',') AS columns FROM fnd")
def _(ws):
    return contract.affected_columns(ws.findings)


@query("G2_risk_families", "SELECT * FROM fam")
def _(ws):
    return contract.risk_families(ws.findings)


@query("G3_interventions", "SELECT version_id, intervention_id, code, title, severity, status, decision FROM iv")
def _(ws):
    return contract.interventions(ws.findings).drop("impact", "columns")


@query("G3_operations", "SELECT version_id, code, step, operation, array_to_string(cols, ',') AS columns, purpose FROM ops")
def _(ws):
    return contract.operations(ws.findings).withColumn("columns", F.concat_ws(",", "columns"))


@query("G4_metric_impact", "SELECT version_id, code, impact, array_to_string(metrics, ',') AS metrics, gain, loss, implication FROM mi")
def _(ws):
    impacts = contract.metric_impact(contract.interventions(ws.findings), ws.configurations)
    return impacts.withColumn("metrics", F.concat_ws(",", "metrics"))


@query("G5_readiness", """
SELECT r.version_id, CASE WHEN w = 4 THEN 'requires review before experiment' WHEN w = 3 OR coalesce(ic, 0) > 0 THEN 'variant generation recommended' WHEN coalesce(fc, 0) > 0 THEN 'ready with caution' ELSE 'ready for baseline experiment' END AS status,
  coalesce(fc, 0) AS finding_count, coalesce(ic, 0) AS intervention_count, coalesce(dc, 0) AS required_decision_count, coalesce(families, '') AS families, mlrs_score, lrs_score
FROM reg r LEFT JOIN (SELECT version_id, count(*) AS fc, max(sr) AS w FROM fnd JOIN sevrank USING (severity) GROUP BY 1) f USING (version_id)
LEFT JOIN (SELECT version_id, count(*) AS ic, count(decision) AS dc FROM iv GROUP BY 1) i USING (version_id)
LEFT JOIN (SELECT version_id, array_to_string(list_sort(list(family)), ',') AS families FROM fam GROUP BY 1) g USING (version_id) JOIN rs USING (version_id)""")
def _(ws):
    return contract.readiness(ws.registry, ws.findings, contract.interventions(ws.findings), contract.risk_families(ws.findings), ws.risks)


@query("G6_selected_plan", """
SELECT version_id, operation_count, affected_columns, unresolved_decisions, selected_options FROM (SELECT version_id, count(*) AS operation_count, array_to_string(list_sort(list_distinct(flatten(list(cols)))), ',') AS affected_columns FROM ops GROUP BY 1)
JOIN (SELECT version_id, count(decision) AS unresolved_decisions, array_to_string(list_sort(list(intervention_id)), ',') AS selected_options FROM iv GROUP BY 1) USING (version_id)""")
def _(ws):
    return contract.selected_plan(contract.operations(ws.findings), contract.interventions(ws.findings))


@query("G7_experiment_handoff", """
SELECT version_id, task AS task_type, 'V' || version_number AS required_baseline, coalesce(m, '') AS recommended_metrics FROM reg
LEFT JOIN (SELECT version_id, array_to_string(list_sort(list_distinct(flatten(list(metrics)))), ',') AS m FROM mi GROUP BY 1) USING (version_id)""")
def _(ws):
    return contract.experiment_handoff(ws.registry, contract.metric_impact(contract.interventions(ws.findings), ws.configurations))


@query("G8_column_impact", """
SELECT version_id, ci.col AS "column", role, dtype AS logical_dtype, missing_ratio, uniq AS unique_count, outliers AS outlier_count, risk_families, operation_count FROM ci JOIN cp USING (version_id, col)""")
def _(ws):
    return contract.column_impact(ws.findings, ws.columns)


@query("G9_finding_families", "SELECT version_id, code, family FROM ff")
def _(ws):
    return contract.finding_families(ws.findings)


@query("G10_risk_map", "SELECT version_id, col AS \"column\", count(DISTINCT family) AS family_count, "
       + ", ".join(f"bool_or(coalesce(family = '{k}', false)) AS {k}" for k in RISK_FAMILIES) + " FROM rmap GROUP BY 1, 2")
def _(ws):
    return contract.risk_map(ws.findings, contract.column_impact(ws.findings, ws.columns))


@query("G11_intervention_scope", """
SELECT version_id, intervention_id, CASE WHEN len(cols) = 1 THEN '1 column' WHEN len(cols) > 1 THEN len(cols) || ' columns' WHEN code = 'CLASS_IMBALANCE' THEN 'Target distribution' ELSE 'Dataset-level' END AS scope FROM iv""")
def _(ws):
    return contract.scope_label(contract.interventions(ws.findings))
