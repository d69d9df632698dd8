"""Queries over recommended candidates and evaluated variants."""

from __future__ import annotations

import json
from functools import partial

from pyspark.sql import functions as F

from lakewitness import lookups as L
from lakewitness.operators import evaluate as ev
from lakewitness.operators import recommend as rec
from lakewitness.operators import variants as built
from lakewitness.plans import refresh
from lakewitness.plans.check_parts_risk import values
from lakewitness.plans.check_variants import BUILD, FIRST_VARIANT, copy_parts
from lakewitness.plans.evidence import Evidence
from lakewitness.plans.queries_store import fresh
from lakewitness.plans.registry import part, query
from lakewitness.session import cut, together
from lakewitness.sources.store import freeze_version

V = "version_id"
GOALS = list(L.GOAL_WEIGHTS)

# Requests: every version with every goal. Fairness avoids synthetic rows, the light goal limits features.
part("goals", values([(i, g) for i, g in enumerate(GOALS)], "gi, goal"))
part("rq", "SELECT version_id * 100 + gi AS request_id, version_id, goal, 4 AS n, goal = 'fairness' AS nosyn, CASE WHEN goal = 'lightweight_dataset' THEN 4 END AS maxf FROM reg, goals")
part("need", """
SELECT r.version_id, task, CASE WHEN task IN ('classification', 'regression') THEN t.col END AS target_column, row_count, column_count, numeric_columns,
  greatest(categorical_columns - CASE WHEN task IN ('classification', 'regression') AND t.col IS NOT NULL AND NOT t.isnum THEN 1 ELSE 0 END, 0) AS text_features,
  f.* EXCLUDE (version_id), mincls FROM reg r JOIN tp USING (version_id) LEFT JOIN (SELECT version_id, col, isnum FROM cp WHERE role = 'target') t USING (version_id) LEFT JOIN cls1 USING (version_id)
LEFT JOIN (SELECT version_id, bool_or(code = 'MISSINGNESS') AS m, bool_or(code = 'DUPLICATES') AS d, bool_or(code = 'OUTLIERS') AS o, bool_or(code = 'CORRELATION') AS c, bool_or(code = 'CLASS_IMBALANCE') AS i,
  bool_or(code = 'TARGET_LEAKAGE') AS l, bool_or(code = 'TARGET_SKEW') AS k, bool_or(code = 'SCALING') AS s, max(CASE WHEN code = 'MISSINGNESS' THEN measure * 100 END) AS mp,
  max(CASE WHEN code = 'OUTLIERS' THEN severity END) AS os, max(CASE WHEN code = 'CLASS_IMBALANCE' THEN severity END) AS ims FROM fnd GROUP BY 1) f USING (version_id)""")
part("trn", values([(t, c, lab, cost, int(rt), int(co), p, list(L.CATEGORIES).index(c)) for t, c, lab, cost, rt, co, p in L.TRANSFORMATIONS], "tid, category, label, cost, rt, co, params, ord"))
part("appl", """
SELECT * FROM need, trn WHERE (co = 0 OR task = 'classification') AND (rt = 0 OR target_column IS NOT NULL) AND (category <> 'encoding' OR text_features > 0)""")
part("pref", values([(g, c, t, i) for g, cats in L.GOAL_PREFERENCES.items() for c, ts in cats.items() for i, t in enumerate(ts)], "goal, category, tid, pr"))
part("ndd", """
SELECT rq.*, appl.* EXCLUDE (version_id) FROM rq JOIN appl USING (version_id) WHERE category = 'scaling' OR (category = 'duplicate_removal' AND d) OR (category = 'missing_value_handling' AND m) OR (category = 'encoding' AND text_features > 0)
  OR (category = 'outlier_treatment' AND o) OR (category = 'class_balancing' AND i AND task = 'classification') OR (category = 'feature_reduction' AND (c OR maxf IS NOT NULL))""")
part("opt", """
SELECT ndd.*, row_number() OVER (PARTITION BY request_id, ndd.category ORDER BY coalesce(pr, 99), ndd.tid) - 1 AS option, count(*) OVER (PARTITION BY request_id, ndd.category) AS kk
FROM ndd LEFT JOIN pref ON pref.goal = ndd.goal AND pref.category = ndd.category AND pref.tid = ndd.tid WHERE NOT (nosyn AND ndd.tid IN ('smote', 'adasyn'))""")
part("cand", "SELECT opt.*, i2 AS candidate FROM opt, (SELECT unnest(range(4)) AS i2) WHERE i2 % kk = option")
part("ccost", """
SELECT request_id, version_id, goal, candidate, 'Pipeline-' || chr(65 + candidate::INT) AS pipeline_id, CASE WHEN bool_or(cost = 'medium') THEN 'medium' WHEN bool_or(cost = 'low') THEN 'low' ELSE 'very_low' END AS estimated_cost,
  round(sum(CASE cost WHEN 'very_low' THEN 1 WHEN 'low' THEN 5 WHEN 'medium' THEN 30 ELSE 120 END)::DOUBLE * greatest(1, max(row_count) / 1000), 1) AS estimated_seconds,
  sha256('[' || string_agg('{"params": ' || params || ', "transformation_id": "' || tid || '"}', ', ' ORDER BY ord) || ']') AS pipeline_hash, string_agg(tid, ',' ORDER BY ord) AS steps
FROM cand GROUP BY 1, 2, 3, 4""")


def requests(ws):
    goals = F.explode(F.array(*[F.struct(F.lit(i).alias("gi"), F.lit(g).alias("goal")) for i, g in enumerate(GOALS)]))
    return ws.registry.select(V, goals.alias("g")).select(
        (F.col(V) * 100 + F.col("g.gi")).alias("request_id"),
        V,
        F.col("g.goal").alias("goal"),
        F.lit(4).alias("candidates"),
        (F.col("g.goal") == "fairness").alias("avoid_synthetic"),
        F.when(F.col("g.goal") == "lightweight_dataset", 4).alias("max_features"),
    )


def needs(ws):
    ws.ahead()
    return rec.requirements(ws.registry, ws.columns, ws.tables, ws.findings, ws.classification)


def chosen(ws):
    return ws.once("candidates", lambda: rec.candidates(requests(ws), rec.applicable(needs(ws))))


WORD = "coalesce(CASE {} WHEN 'medium' THEN 'moderate' WHEN 'high' THEN 'severe' WHEN 'critical' THEN 'severe' END, 'none')"


@query("H1_requirements", f"""
SELECT version_id, task AS task_type, target_column, row_count, column_count, numeric_columns, text_features, coalesce(m, false) AS needs_missing_value_handling, coalesce(i, false) AND task = 'classification' AS needs_class_balancing,
  coalesce(o, false) AS needs_outlier_treatment, coalesce(c, false) AS needs_feature_reduction, coalesce(l, false) AND target_column IS NOT NULL AS needs_leakage_fix, coalesce(s, false) AS needs_scaling, text_features > 0 AS needs_encoding,
  coalesce(d, false) AS has_duplicates, coalesce(k, false) AS has_target_skew, round(coalesce(mp, 0), 4)::DOUBLE AS missing_values_pct, {WORD.format('os')} AS outlier_severity,
  CASE WHEN task = 'classification' THEN {WORD.format('ims')} ELSE 'none' END AS class_imbalance_severity, CASE WHEN task = 'classification' THEN mincls END AS minority_class_count FROM need""")
def _(ws):
    return needs(ws).withColumn("missing_values_pct", F.round("missing_values_pct", 4))


@query("H2_applicable_steps", "SELECT version_id, category, tid AS transformation_id, label, cost FROM appl")
def _(ws):
    return rec.applicable(needs(ws)).select(V, "category", "transformation_id", "label", "cost")


@query("H3_needed_categories", "SELECT DISTINCT request_id, category FROM ndd")
def _(ws):
    return rec.needed(requests(ws), rec.applicable(needs(ws))).select("request_id", "category").distinct()


@query("H4_ordered_options", "SELECT request_id, category, option, tid AS transformation_id FROM opt")
def _(ws):
    return rec.options(requests(ws), rec.applicable(needs(ws))).select("request_id", "category", "option", "transformation_id")


@query("H5_candidates", "SELECT request_id, candidate, category, tid AS transformation_id, params FROM cand")
def _(ws):
    return chosen(ws).select("request_id", "candidate", "category", "transformation_id", "params")


@query("H6_candidate_cost", "SELECT request_id, candidate, estimated_cost, estimated_seconds FROM ccost")
def _(ws):
    return rec.candidate_costs(chosen(ws)).select("request_id", "candidate", "estimated_cost", "estimated_seconds")


@query("H7_candidate_hash", "SELECT request_id, candidate, steps, pipeline_hash AS plan_hash FROM ccost")
def _(ws):
    return rec.candidate_costs(chosen(ws)).select("request_id", "candidate", "steps", F.col("pipeline_hash").alias("plan_hash"))


part("steptext", values([(row[0], L.STEP_TEXT[row[0]].format(**json.loads(row[6]))) for row in L.TRANSFORMATIONS], "tid, explanation"))
part("goaltext", values(list(L.GOAL_TEXT.items()), "goal, gtext"))


@query("H8_step_explanations", "SELECT request_id, candidate, category, tid AS transformation_id, label, params, explanation FROM cand JOIN steptext USING (tid)")
def _(ws):
    return rec.explanations(chosen(ws))


@query("H8_rationales", """
SELECT request_id, candidate, count(*) || ' step(s) (' || string_agg(label, ', ' ORDER BY ord) || ') to ' || max(gtext) || ', on ' || max(row_count) || ' rows (' || max(task) || ' task).' AS rationale
FROM cand JOIN goaltext USING (goal) GROUP BY 1, 2""")
def _(ws):
    return rec.rationales(chosen(ws))


# ------------------------------------------------------------------ evaluation
# Variants of three versions are built from their candidates, profiled and diagnosed in one job, and judged.
part("alone", """
SELECT version_id, round_even(least(100, sum(score ORDER BY ordinal) FILTER (family = 'mlrs' AND component <> 'evolution_readiness')), 2)::DOUBLE AS mlrs, round_even(least(100, sum(score ORDER BY ordinal) FILTER (family = 'lrs')), 2)::DOUBLE AS lrs FROM rc GROUP BY 1""")
part("bal", """
SELECT reg.version_id, coalesce(b, 1.0)::DOUBLE AS balance FROM reg LEFT JOIN (
  SELECT vc.version_id, CASE WHEN count(*) < 2 THEN 1.0 ELSE round(greatest(0, 1 - abs(max(cnt)::DOUBLE / sum(cnt) - 1.0::DOUBLE / count(*)) / (1 - 1.0::DOUBLE / count(*))), 6) END AS b
  FROM vc JOIN reg ON vc.version_id = reg.version_id AND col = target WHERE value IS NOT NULL OR num IS NOT NULL GROUP BY 1) x ON x.version_id = reg.version_id""")
copy_parts()
part("gw", values([(g, *w) for g, w in L.GOAL_WEIGHTS.items()], "goal, w1, w2, w3, w4, w5"))
part("rec0", """
SELECT v.job_id, v.version_id, v.goal, v.steps, rs.mlrs_score AS mlrs_before, xalone.mlrs AS mlrs_after, xalone.lrs AS lrs_after, balance, w1, w2, w3, w4, w5,
  greatest(0, least(1, (rs.mlrs_score - xalone.mlrs) / greatest(rs.mlrs_score, 1)))::DOUBLE AS rr,
  CASE WHEN a.mp > 0 THEN greatest(0, least(1, (a.mp - b.mp) / greatest(a.mp, 0.01))) ELSE 1 END::DOUBLE AS mr,
  CASE WHEN v.goal IN ('lightweight_dataset', 'faster_training', 'explainable_model') THEN greatest(0, least(1, 1 - b.cc::DOUBLE / a.cc)) ELSE greatest(0, least(1, b.cc::DOUBLE / a.cc)) END::DOUBLE AS fs,
  CASE estimated_cost WHEN 'very_low' THEN 1.0 WHEN 'low' THEN 0.75 WHEN 'medium' THEN 0.5 ELSE 0.25 END::DOUBLE AS cs
FROM bplan v JOIN (SELECT version_id, column_count AS cc, round(missing_cells::DOUBLE / (row_count * column_count) * 100, 6) AS mp FROM tp) a ON a.version_id = source_version_id
JOIN (SELECT version_id, column_count AS cc, round(missing_cells::DOUBLE / (row_count * column_count) * 100, 6) AS mp FROM xtp) b ON b.version_id = v.version_id
JOIN rs ON rs.version_id = source_version_id JOIN xalone ON xalone.version_id = v.version_id JOIN xbal ON xbal.version_id = v.version_id JOIN gw ON gw.goal = v.goal""")
part("rec1", "SELECT *, greatest(0, least(100, round((w1 * rr + w2 * mr + w3 * balance + w4 * fs + w5 * cs) * 100, 2)))::DOUBLE AS vrs FROM rec0")


class BuiltVariants:
    """The variants of the build requests, with their evidence."""

    def __init__(self, ws):
        asked = F.lit(False)
        count, most = F.lit(None).cast("int"), F.lit(None).cast("int")
        for version, goal, n, limit in BUILD:
            here = (F.col(V) == version) & (F.col("goal") == goal)
            asked, count, most = asked | here, F.when(here, n).otherwise(count), F.when(here, F.lit(limit).cast("int")).otherwise(most)
        self.requests = requests(ws).where(asked).withColumns({"candidates": count, "max_features": most})
        needed = needs(ws)
        self.plans = built.plans(rec.candidates(self.requests, rec.applicable(needed)), self.requests, FIRST_VARIANT)
        self.tables = built.build(ws.frames, self.plans, built.contexts(ws.registry, needed))
        self.rows = built.plan_rows(ws.spark, self.plans, self.tables)
        self.frames = {v: b.df for v, b in self.tables.items()}
        self.versions = built.child_versions(ws.registry, self.rows)
        # J1 judges a variant on its own: without a parent there is no comparison.
        self.evidence = Evidence(ws.spark, self.frames, cut(self.versions.withColumn("parent_version_id", F.lit(None).cast("long"))))


def variants(ws) -> BuiltVariants:
    if not hasattr(ws, "built_variants"):
        ws.built_variants = BuiltVariants(ws)
    return ws.built_variants


def own_risks(ws):
    own = variants(ws).evidence
    return ws.once("variant_risks", lambda: ev.variant_risks(own.facts, own.leakage))


def records(ws):
    def build():
        made = variants(ws)
        own = made.evidence
        tables = ws.tables.unionByName(own.tables)
        return ev.evaluate(made.rows.select("job_id", "goal", "source_version_id", V, "estimated_cost", "steps"), ws.risks, own_risks(ws), tables, ev.class_balances(own.vc, own.registry))

    return ws.once("variant_records", build)


@query("J1_variant_rediagnosis", """
SELECT version_id, source_version_id, steps, row_count, column_count, missing_cells, duplicate_rows, mlrs AS mlrs_score, lrs AS lrs_score FROM bplan JOIN xtp USING (version_id) JOIN xalone USING (version_id)""")
def _(ws):
    tables = variants(ws).evidence.tables.select(V, "row_count", "column_count", "missing_cells", "duplicate_rows")
    return variants(ws).rows.select(V, "source_version_id", "steps").join(tables, V).join(own_risks(ws), V)


@query("J1_variant_columns", """
SELECT version_id, pos::INT AS position, col AS "column", dtype AS logical_dtype, missing AS missing_count, uniq AS unique_count, outliers AS outlier_count, round(mean, 4) + 0.0 AS mean, round(sd, 4) + 0.0 AS std FROM xcp WHERE version_id >= 1001""")
def _(ws):
    return variants(ws).evidence.columns.select(
        V, "position", "column", "logical_dtype", "missing_count", "unique_count", "outlier_count", (F.round("mean", 4) + F.lit(0.0)).alias("mean"), (F.round("std", 4) + F.lit(0.0)).alias("std")
    )


@query("I20_built_steps", "SELECT version_id, job_id, candidate::INT AS candidate, pipeline_id, steps, 0 AS failed FROM bplan")
def _(ws):
    return variants(ws).rows.select(V, "job_id", "candidate", "pipeline_id", F.array_join(F.array_remove("applied", built.LIMIT), ",").alias("steps"), F.size("failed").alias("failed"))


@query("J2_vrs_components", """
SELECT job_id, version_id, mlrs_before, mlrs_after, lrs_after, round(rr, 4) AS risk_reduction, round(mr, 4) AS missing_reduction, round(balance, 4) AS balance, round(fs, 4) AS feature_score, round(cs, 4) AS cost_score FROM rec1""")
def _(ws):
    return records(ws).select(
        "job_id", V, "mlrs_before", "mlrs_after", "lrs_after", "risk_reduction", "missing_reduction", "balance", "feature_score", "cost_score"
    )


@query("J3_vrs", "SELECT job_id, version_id, vrs AS vrs_score FROM rec1")
def _(ws):
    return records(ws).select("job_id", V, "vrs_score")


@query("J4_goal_satisfaction", "SELECT job_id, version_id, CASE WHEN vrs >= 80 THEN 'excellent' WHEN vrs >= 60 THEN 'good' WHEN vrs >= 40 THEN 'fair' ELSE 'poor' END AS goal_satisfaction FROM rec1")
def _(ws):
    return records(ws).select("job_id", V, "goal_satisfaction")


@query("J5_leakage_caveat", "SELECT job_id, version_id, CASE WHEN list_contains(string_split(steps, ','), 'mutual_information') THEN 'mi_selection_expected' END AS lrs_caveat FROM rec1")
def _(ws):
    return records(ws).select("job_id", V, "lrs_caveat")


@query("J6_ranked_variants", "SELECT job_id, version_id, vrs AS vrs_score, row_number() OVER (PARTITION BY job_id ORDER BY vrs DESC, version_id) AS vrs_rank FROM rec1")
def _(ws):
    return ev.rank_variants(records(ws)).select("job_id", V, "vrs_score", "vrs_rank")


@query("J7_mlrs_improvement", "SELECT job_id, version_id, round(mlrs_before - mlrs_after, 2) AS mlrs_improvement FROM rec1")
def _(ws):
    return records(ws).select("job_id", V, "mlrs_improvement")


# Variant jobs at the size of the orders table: one job per order, one request per customer and priority.
part("jobs", """
SELECT o_orderkey AS job_id, o_custkey AS version_id, sha256(o_orderpriority || '{"avoid_synthetic_data": false}') AS h, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status, o_orderdate AS created_at FROM orders""")


@query("J8_reusable_jobs", """
SELECT r.version_id, r.h AS constraints_hash, j.job_id AS reused_job_id FROM (SELECT DISTINCT version_id, h FROM jobs) r
LEFT JOIN (SELECT version_id, h, arg_max(job_id, (created_at, job_id)) AS job_id FROM jobs WHERE status = 'completed' GROUP BY 1, 2) j ON j.version_id = r.version_id AND j.h = r.h""")
def _(ws):
    jobs = ws.table("orders").select(
        F.col("o_orderkey").alias("job_id"),
        F.col("o_custkey").alias(V),
        F.sha2(F.concat("o_orderpriority", F.lit('{"avoid_synthetic_data": false}')), 256).alias("constraints_hash"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("failed").alias("status"),
        F.col("o_orderdate").alias("created_at"),
    )
    return ev.reusable_jobs(jobs.select(V, "constraints_hash").distinct(), jobs)


@query("J10_constraint_violations", """
SELECT request_id, version_id, violation FROM (
  SELECT request_id, rq.version_id, unnest([CASE WHEN CASE WHEN goal = 'lightweight_dataset' THEN 6 END >= column_count THEN 'max_features_too_large' END, CASE WHEN goal = 'faster_training' AND column_count < 8 THEN 'max_seconds_too_small' END,
    CASE WHEN goal = 'fairness' AND column_count = 8 THEN 'unknown_goal' END]) AS violation FROM rq JOIN tp USING (version_id)) WHERE violation IS NOT NULL""")
def _(ws):
    asked = requests(ws).join(ws.tables.select(V, "column_count"), V).select(
        "request_id",
        V,
        F.when((F.col("goal") == "fairness") & (F.col("column_count") == 8), "no_such_goal").otherwise(F.col("goal")).alias("goal"),
        F.when(F.col("goal") == "lightweight_dataset", 6).alias("max_features"),
        F.when((F.col("goal") == "faster_training") & (F.col("column_count") < 8), 5).otherwise(60).alias("max_seconds"),
    )
    return ev.constraint_violations(asked, ws.tables.select(V, "column_count"))


@query("J9_register_variant", """
SELECT version_id, dataset_id, version_number::INT AS version_number, parent_version_id, row_count, column_count, method AS generation_method, notes AS version_notes, 'variant.generated' AS event_type,
  '{"generation_method":"variant_generator","job_id":' || job_id || ',"pipeline_id":"' || pipeline_id || '"}' AS evidence, schema_hash,
  sha256('{"job_id":' || job_id || ',"pipeline_id":"' || pipeline_id || '","target_column":' || coalesce('"' || target || '"', 'null') || ',"task_type":"' || task || '"}') AS configuration_hash,
  mlrs_score, lrs_score, findings, compared
FROM bplan JOIN xreg USING (version_id) JOIN xtp USING (version_id) JOIN xsch USING (version_id) JOIN xrs USING (version_id)
LEFT JOIN (SELECT version_id, array_to_string(list_sort(list(code)), ',') AS findings FROM xfnd GROUP BY 1) USING (version_id)
JOIN (SELECT pair_id AS version_id, count(*) AS compared FROM xppc GROUP BY 1) USING (version_id)""")
def _(ws):
    made, root = variants(ws), fresh(ws, "registered")
    # Written once as versions of their datasets; the evidence is made from what was stored.
    rows = made.versions.select(V, "dataset_id", "version_number").collect()
    paths = together(ws.spark, [partial(freeze_version, made.frames[r[V]], f"{root}/versions", r["dataset_id"], r["version_number"]) for r in rows])
    stored = {r[V]: ws.spark.read.schema(made.frames[r[V]].schema).parquet(path) for r, path in zip(rows, paths)}
    versions = ws.registry.unionByName(made.versions)
    hashes = built.variant_configuration_hashes(ws.registry, made.rows)
    outcome = refresh.refresh(ws.spark, root, versions, {**ws.frames, **stored}, only=sorted(stored), configuration_hashes=hashes)
    evidence = lambda name: refresh.read_evidence(ws.spark, root, name)
    found = evidence("findings").groupBy(V).agg(F.array_join(F.sort_array(F.collect_list("code")), ",").alias("findings"))
    compared = evidence("diff_columns").groupBy(V).agg(F.count(F.lit(1)).alias("compared"))
    events = built.lineage_events(ws.registry, made.rows).select(F.col("destination_version_id").alias(V), "event_type", "evidence")
    return (
        made.versions.select(V, "dataset_id", "version_number", "parent_version_id", "generation_method", "version_notes")
        .join(outcome.where("outcome = 'done'").select(V), V).join(events, V)
        .join(evidence("table_profile").select(V, "row_count", "column_count"), V)
        .join(evidence("fingerprints").select(V, "schema_hash", "configuration_hash"), V)
        .join(evidence("risk_scores").select(V, "mlrs_score", "lrs_score"), V).join(found, V, "left").join(compared, V)
    )
