"""Parts of the check SQL for diagnosis and contract."""

from __future__ import annotations

from lakewitness import lookups as L
from lakewitness.plans.check_parts import lit
from lakewitness.plans.registry import part


def values(rows, names: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(lit(x) for x in r) + ")" for r in rows) + f") AS t({names})"


part("edges", """
SELECT hc.version_id, l AS a, r AS b FROM hc JOIN reg ON hc.version_id = reg.version_id WHERE coalesce(l <> target AND r <> target, true)
UNION SELECT hc.version_id, r, l FROM hc JOIN reg ON hc.version_id = reg.version_id WHERE coalesce(l <> target AND r <> target, true)""")
part("reach", "/* RECURSION */ SELECT version_id, a, b FROM edges UNION SELECT reach.version_id, reach.a, edges.b FROM reach JOIN edges ON reach.version_id = edges.version_id AND reach.b = edges.a")
part("clu", """
SELECT version_id, col, cluster, count(*) OVER (PARTITION BY version_id, cluster) AS size FROM (SELECT version_id, a AS col, least(min(b), a) AS cluster FROM reach GROUP BY version_id, a)""")
part("wor", """
SELECT cur AS version_id, greatest(round(mb - ma, 6), 0)::DOUBLE AS mw, coalesce((SELECT max(dr) FROM pmc WHERE pmc.pair_id = pp.pair_id AND dr > 0), 0)::DOUBLE AS cw,
       greatest((b.dups - a.dups)::DOUBLE / rows_cur, 0) AS dw, coalesce((SELECT bool_or(is_target) FROM pmc WHERE pmc.pair_id = pp.pair_id AND dr > 0), false) AS tw
FROM pp JOIN pmo ON pmo.pair_id = pp.pair_id JOIN dup a ON a.version_id = prev JOIN dup b ON b.version_id = cur""")
part("fx", """
SELECT r.version_id, dataset_id, version_number, parent_version_id, notes, task, r.target, tp.* EXCLUDE (version_id), x.* EXCLUDE (version_id), cls1.* EXCLUDE (version_id),
       target_skew, target_outliers, round(spread, 4) AS spread_ratio, spread > 10 AS scaling, coalesce(clustered, 0) AS clustered, coalesce(largest, 0) AS largest, coalesce(clusters, 0) AS clusters,
       coalesce(mw, 0)::DOUBLE AS mw, coalesce(cw, 0)::DOUBLE AS cw, coalesce(dw, 0)::DOUBLE AS dw, coalesce(tw, false) AS tw, scm, dsi
FROM reg r JOIN tp ON tp.version_id = r.version_id
JOIN (SELECT version_id, count(*) FILTER (missing_ratio > 0)::DOUBLE / count(*) AS affected, max(missing_ratio) AS maxmiss, count(*) FILTER (role <> 'target') AS features,
        count(*) FILTER (role <> 'target' AND outlier_ratio >= 0.05) AS of, avg(CASE WHEN role <> 'target' THEN coalesce(outlier_ratio, 0) END) AS om,
        max(CASE WHEN role = 'target' THEN missing_ratio END) AS tmiss, count(*) FILTER (role = 'target') AS tcols FROM cp GROUP BY 1) x ON x.version_id = r.version_id
LEFT JOIN cls1 ON cls1.version_id = r.version_id LEFT JOIN regr ON regr.version_id = r.version_id LEFT JOIN clus ON clus.version_id = r.version_id
LEFT JOIN (SELECT version_id, count(DISTINCT col) AS clustered, max(size) AS largest, count(DISTINCT cluster) AS clusters FROM clu GROUP BY 1) c ON c.version_id = r.version_id
LEFT JOIN wor ON wor.version_id = r.version_id LEFT JOIN psc ON psc.cur = r.version_id""")
part("flg", """
SELECT cp.version_id, col, coalesce(col = target, false) AS is_target,
  coalesce(lower(col) <> lower(target) AND (contains(lower(col), lower(target)) OR EXISTS (SELECT 1 FROM (SELECT unnest(string_split(replace(lower(target), '-', '_'), '_')) AS t) WHERE length(t) >= 3 AND contains(lower(col), t))), false) AS target_like,
  regexp_matches(lower(col), '(outcome|result|final|after|post|approved|diagnosis|diagnosed|placed|status)') AND NOT coalesce(col = target, false) AS post_outcome,
  NOT coalesce(col = target, false) AND (replace(lower(col), '_', '') IN ('id', 'uuid', 'guid', 'employeeid', 'studentid', 'customerid', 'userid') OR replace(lower(col), '_', '') LIKE '%id'
    OR col ILIKE '%uuid%' OR col ILIKE '%guid%' OR unique_ratio >= 0.95) AS identifier,
  regexp_matches(lower(col), '(target|label|answer|ground_truth|actual)') AS direct_name
FROM cp JOIN reg ON cp.version_id = reg.version_id""")
part("assoc", """
SELECT hc.version_id, CASE WHEN l = target THEN r ELSE l END AS feature, corr AS association FROM hc JOIN reg ON hc.version_id = reg.version_id WHERE l = target OR r = target""")
part("lk", """
SELECT DISTINCT a.version_id, col, CASE WHEN abs(association) >= 0.999 AND (direct_name OR target_like) THEN 'direct' WHEN abs(association) >= 0.98 AND (post_outcome OR direct_name OR target_like) THEN 'proxy' END AS kind
FROM assoc a JOIN flg ON a.version_id = flg.version_id AND feature = col WHERE abs(association) >= 0.98 AND (direct_name OR target_like OR (post_outcome))
UNION ALL SELECT version_id, col, 'target_like' FROM flg WHERE target_like
UNION ALL SELECT version_id, col, 'post_outcome' FROM flg WHERE post_outcome
UNION ALL SELECT version_id, col, 'identifier' FROM flg WHERE identifier""")
part("imb", """
SELECT version_id, CASE WHEN task <> 'classification' OR class_count IS NULL OR class_count < 2 THEN 0 ELSE least(20, greatest(0, 20 * (0.7 * ((maxcls::DOUBLE / labelled - 1.0::DOUBLE / class_count) / (1 - 1.0::DOUBLE / class_count)) + 0.3 * (1 - mincls::DOUBLE / maxcls)))) END::DOUBLE AS imb
FROM fx""")
dim = lambda kind, first, top: f"least({top}, {first} * (1 - pow(0.6::DOUBLE, coalesce((SELECT count(*) FROM lk WHERE lk.version_id = fx.version_id AND kind = '{kind}'), 0))) / 0.4)"
COMPONENT_SQL = {
    ("mlrs", "missingness"): "least(12, missing_ratio * 100) + least(6, affected * 12) + least(7, maxmiss * 35)",
    ("mlrs", "duplicates"): "least(10, duplicate_ratio * 100)",
    ("mlrs", "imbalance"): "imb",
    ("mlrs", "outliers"): "least(9, coalesce(of::DOUBLE / greatest(features, 1), 0) * 9) + least(6, coalesce(om, 0) * 75)",
    ("mlrs", "correlation_redundancy"): "least(10, clustered::DOUBLE / greatest(features, 1) * 6 + largest::DOUBLE / greatest(features, 1) * 3 + least(clusters, 3))",
    ("mlrs", "target_quality"): """CASE WHEN tcols = 0 THEN CASE WHEN task IN ('classification', 'regression') THEN 15 ELSE 0 END
      WHEN task = 'regression' THEN least(8, tmiss * 120) + least(6, coalesce(abs(target_skew), 0) * 3) + least(3, target_outliers::DOUBLE / row_count * 60)
      WHEN task = 'classification' THEN least(8, tmiss * 120) + least(5, imb * 0.25) ELSE least(8, tmiss * 120) END""",
    ("mlrs", "evolution_readiness"): "least(5, mw * 100) + least(6, cw * 45) + least(4, dw * 120)",
    ("lrs", "direct_target_leakage"): dim("direct", 22, 35),
    ("lrs", "proxy_leakage"): dim("proxy", 12, 25),
    ("lrs", "target_name_similarity"): dim("target_like", 3, 8),
    ("lrs", "temporal_post_outcome"): dim("post_outcome", 7, 18),
    ("lrs", "split_contamination"): "least(4, duplicate_ratio * 25)",
    ("lrs", "identifier_memorization"): dim("identifier", 2.5, 8),
}
part("rc", "\nUNION ALL ".join(
    f"SELECT fx.version_id, '{f}' AS family, '{k}' AS component, {i} AS ordinal, ({sql})::DOUBLE AS score FROM fx JOIN imb ON imb.version_id = fx.version_id"
    for i, ((f, k), sql) in enumerate(COMPONENT_SQL.items())
))
part("rs", """
SELECT version_id, round_even(least(100, sum(score ORDER BY ordinal) FILTER (family = 'mlrs')), 2)::DOUBLE AS mlrs_score, round_even(least(100, sum(score ORDER BY ordinal) FILTER (family = 'lrs')), 2)::DOUBLE AS lrs_score FROM rc GROUP BY 1""")
part("fnd0", """
SELECT fx.version_id, 1 AS ordinal, 'MISSINGNESS' AS code, CASE WHEN missing_ratio >= 0.4 THEN 'critical' WHEN missing_ratio >= 0.2 THEN 'high' WHEN missing_ratio >= 0.05 THEN 'medium' END AS severity, []::VARCHAR[] AS cols, missing_ratio::DOUBLE AS measure FROM fx
UNION ALL SELECT version_id, 2, 'DUPLICATES', CASE WHEN duplicate_ratio >= 0.1 THEN 'high' WHEN duplicate_ratio >= 0.01 THEN 'medium' END, [], duplicate_ratio FROM fx
UNION ALL SELECT version_id, 3, 'OUTLIERS', 'medium', list_sort(list(col)), count(*)::DOUBLE FROM cp WHERE role <> 'target' AND outlier_ratio >= 0.05 GROUP BY version_id
UNION ALL SELECT version_id, 4, 'CORRELATION', 'medium', list_sort(list(col)), count(DISTINCT cluster)::DOUBLE FROM clu GROUP BY version_id
UNION ALL SELECT fx.version_id, 5, 'CLASS_IMBALANCE', CASE WHEN imb < 5 THEN NULL WHEN ratio >= 10 THEN 'critical' WHEN ratio >= 4 THEN 'high' ELSE 'medium' END, [], ratio FROM fx JOIN imb ON imb.version_id = fx.version_id WHERE task = 'classification'
UNION ALL SELECT version_id, 6, 'TARGET_SKEW', 'medium', [], target_skew FROM fx WHERE task = 'regression' AND abs(target_skew) >= 1
UNION ALL SELECT version_id, 7, 'SCALING', 'high', [], spread_ratio FROM fx WHERE task = 'clustering' AND scaling
UNION ALL SELECT fx.version_id, 8, 'TARGET_LEAKAGE', CASE WHEN lrs_score >= 55 THEN 'critical' ELSE 'high' END,
  list_sort(list_distinct(list_append(coalesce((SELECT list(col) FROM lk WHERE lk.version_id = fx.version_id AND kind IN ('direct', 'proxy', 'post_outcome')), []), fx.target))), lrs_score
FROM fx JOIN rs ON rs.version_id = fx.version_id WHERE lrs_score >= 30 OR EXISTS (SELECT 1 FROM lk WHERE lk.version_id = fx.version_id AND kind = 'direct')""")
part("ftext", values([(c, *t) for c, t in L.FINDING_TEXT.items()], "code, ord, issue, risk, recommendation"))
part("fnd", "SELECT f.*, issue, risk, recommendation FROM fnd0 f JOIN ftext t ON f.code = t.code WHERE severity IS NOT NULL")
part("sevrank", values(list(L.SEVERITY_ORDER.items()), "severity, sr"))
part("ctext", values([(f, k, *t) for (f, k), t in L.COMPONENT_TEXT.items()], "family, component, label, effect, next_action"))
part("ccols", """
SELECT version_id, 'mlrs' AS family, 'missingness' AS component, col FROM cp WHERE missing > 0
UNION ALL SELECT version_id, 'mlrs', 'imbalance', target FROM reg WHERE target IS NOT NULL
UNION ALL SELECT version_id, 'mlrs', 'outliers', col FROM cp WHERE role <> 'target' AND outlier_ratio >= 0.05
UNION ALL SELECT version_id, 'mlrs', 'correlation_redundancy', unnest([l, r]) FROM hc
UNION ALL SELECT version_id, 'mlrs', 'target_quality', target FROM reg WHERE target IS NOT NULL
UNION ALL SELECT pair_id, 'mlrs', 'evolution_readiness', col FROM pmc WHERE dr > 0 AND NOT is_target
UNION ALL SELECT version_id, 'lrs', CASE kind WHEN 'direct' THEN 'direct_target_leakage' WHEN 'proxy' THEN 'proxy_leakage' WHEN 'target_like' THEN 'target_name_similarity' WHEN 'post_outcome' THEN 'temporal_post_outcome' ELSE 'identifier_memorization' END, col FROM lk""")
part("cdet", """
SELECT rc.version_id, rc.family, rc.component, rc.ordinal, round(score, 2) AS score, coalesce(columns, '') AS columns, label, effect, next_action
FROM rc JOIN ctext USING (family, component) LEFT JOIN (SELECT version_id, family, component, array_to_string(list_sort(list_distinct(list(col))), ',') AS columns FROM ccols GROUP BY 1, 2, 3) c USING (version_id, family, component)""")
part("famlab", values(list(L.FAMILY_LABELS.items()), "code, family"))
part("ivr", values([(c, *r) for c, r in L.INTERVENTIONS.items()], "code, title, impact, decision"))
part("opr", values([(c, i, op[0], int(op[1]), op[2]) for c, ops in L.OPERATIONS.items() for i, op in enumerate(ops, 1)], "code, step, operation, uses, purpose"))
part("mtr", values([(t, m) for t, m in L.TASK_METRICS.items()], "task, metrics"))
part("imp", values([(k, *t) for k, t in L.METRIC_IMPACT.items()], "impact, gain, loss, implication"))
part("evk", values([(c, n) for c, ns in L.FINDING_EVIDENCE.items() for n in ns], "code, txt"))
part("fam", """
SELECT f.version_id, coalesce(family, lower(f.code)) AS family, count(*) AS finding_count, array_to_string(list_sort(list_distinct(flatten(list(cols)))), ',') AS affected_columns, arg_max(f.severity, sr) AS severity
FROM fnd f LEFT JOIN famlab USING (code) JOIN sevrank USING (severity) GROUP BY 1, 2""")
part("iv", """
SELECT version_id, lower(code) || '_v' || version_id AS intervention_id, code, title, severity, CASE WHEN severity IN ('high', 'critical') THEN 'recommended' ELSE 'optional' END AS status, impact, decision, cols FROM fnd JOIN ivr USING (code)""")
part("ops", "SELECT version_id, code, step, operation, CASE WHEN uses = 1 THEN cols ELSE []::VARCHAR[] END AS cols, purpose FROM fnd JOIN opr USING (code)")
part("mi", "SELECT version_id, code, impact, metrics, gain, loss, implication FROM iv JOIN reg USING (version_id) JOIN mtr USING (task) JOIN imp USING (impact)")
NORM = "CASE " + " ".join(
    f"WHEN x = '{k}'" + "".join(f" OR contains(x, '{a}')" for a in al) + f" THEN '{k}'" for k, al in L.RISK_FAMILIES.items()
) + " ELSE x END"


part("ci", """
SELECT version_id, col, array_to_string(list_sort(list_distinct(list(family))), ',') AS risk_families, count(*) AS operation_count
FROM (SELECT version_id, coalesce(family, lower(code)) AS family, unnest(cols) AS col FROM fnd LEFT JOIN famlab USING (code)) GROUP BY 1, 2""")
part("ff", f"""
SELECT DISTINCT version_id, code, family FROM (SELECT version_id, code, {NORM} AS family FROM (
  SELECT version_id, code, replace(replace(lower(txt), '-', '_'), ' ', '_') AS x FROM (
    SELECT version_id, code, unnest([code, issue, risk]) AS txt FROM fnd UNION ALL SELECT version_id, fnd.code, txt FROM fnd JOIN evk ON fnd.code = evk.code)))
WHERE family IN ({", ".join(lit(k) for k in L.RISK_FAMILIES)})""")
part("rmap", f"""
SELECT version_id, col, family FROM (SELECT version_id, col, {NORM} AS family FROM (SELECT version_id, ci.col, replace(replace(unnest(string_split(risk_families, ',')), '-', '_'), ' ', '_') AS x FROM ci))
UNION ALL SELECT g.version_id, col, family FROM (SELECT version_id, code, unnest(CASE WHEN len(cols) > 0 THEN cols ELSE ['Dataset-level'] END) AS col FROM fnd) g LEFT JOIN ff USING (version_id, code)""")
