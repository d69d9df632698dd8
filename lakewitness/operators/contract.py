"""From findings to risk families, interventions and the risk map.

The rule tables joined here are fixed and small (tens of rows), so broadcasting them is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewitness.lookups import (
    FAMILY_LABELS,
    FINDING_EVIDENCE,
    INTERVENTIONS,
    METRIC_IMPACT,
    OPERATIONS,
    READINESS_STATUS,
    RISK_FAMILIES,
    SEVERITY_ORDER,
    TASK_METRICS,
)

V = "version_id"
NO_COLUMNS = "Dataset-level"


def _lookup(df: DataFrame, rows: list, schema: str) -> DataFrame:
    return F.broadcast(df.sparkSession.createDataFrame(rows, schema))


def _rank(column: str) -> Column:
    return F.create_map(*[F.lit(x) for item in SEVERITY_ORDER.items() for x in item])[F.col(column)]


def joined(columns: Column) -> Column:
    return F.concat_ws(",", F.array_sort(F.array_distinct(columns)))


def affected_columns(findings: DataFrame) -> DataFrame:
    """G1."""
    return findings.select(V, "code", joined(F.col("columns")).alias("columns"))


def risk_families(findings: DataFrame) -> DataFrame:
    """Findings grouped by family with the dominant severity."""
    labels = _lookup(findings, list(FAMILY_LABELS.items()), "code string, family string")
    known = findings.join(labels, "code", "left").withColumn("family", F.coalesce("family", F.lower("code")))
    return known.groupBy(V, "family").agg(
        F.count(F.lit(1)).alias("finding_count"),
        joined(F.flatten(F.collect_list("columns"))).alias("affected_columns"),
        F.max_by("severity", _rank("severity")).alias("severity"),
    )


def interventions(findings: DataFrame) -> DataFrame:
    """The intervention every finding leads to."""
    rules = _lookup(findings, [(c, *r) for c, r in INTERVENTIONS.items()], "code string, title string, impact string, decision string")
    return findings.join(rules, "code").select(
        V,
        F.concat(F.lower("code"), F.lit("_v"), F.col(V).cast("string")).alias("intervention_id"),
        "code",
        "title",
        "severity",
        F.when(F.col("severity").isin("high", "critical"), "recommended").otherwise("optional").alias("status"),
        "impact",
        "decision",
        "columns",
    )


def operations(findings: DataFrame) -> DataFrame:
    """One row per operation; some name the affected columns, others apply to the whole table."""
    rules = _lookup(
        findings,
        [(c, i, *op) for c, ops in OPERATIONS.items() for i, op in enumerate(ops, 1)],
        "code string, step int, operation string, uses_columns boolean, purpose string",
    )
    none = F.array().cast("array<string>")
    return findings.join(rules, "code").select(
        V, "code", "step", "operation", F.when(F.col("uses_columns"), F.col("columns")).otherwise(none).alias("columns"), "purpose"
    )


def metric_impact(options: DataFrame, configurations: DataFrame) -> DataFrame:
    """Metrics an intervention may move for the task, and in which direction."""
    metrics = _lookup(options, [(t, m) for t, m in TASK_METRICS.items()], "task_type string, metrics array<string>")
    effects = _lookup(options, [(k, *t) for k, t in METRIC_IMPACT.items()], "impact string, gain string, loss string, implication string")
    return (
        options.join(configurations.select(V, "task_type"), V)
        .join(metrics, "task_type", "left")
        .join(effects, "impact", "left")
        .select(V, "code", "impact", F.coalesce("metrics", F.array(F.lit("primary metric"))).alias("metrics"), "gain", "loss", "implication")
    )


def readiness(registry: DataFrame, findings: DataFrame, options: DataFrame, families: DataFrame, risks: DataFrame) -> DataFrame:
    """One of four readiness levels per version, with the counts behind it."""
    f = findings.groupBy(V).agg(F.count(F.lit(1)).alias("finding_count"), F.max(_rank("severity")).alias("worst"))
    o = options.groupBy(V).agg(F.count(F.lit(1)).alias("intervention_count"), F.count("decision").alias("required_decision_count"))
    r = families.groupBy(V).agg(joined(F.collect_list("family")).alias("families"))
    counts = ["finding_count", "worst", "intervention_count", "required_decision_count"]
    status = (
        F.when(F.col("worst") == 4, READINESS_STATUS["critical"])
        .when((F.col("worst") == 3) | (F.col("intervention_count") > 0), READINESS_STATUS["variants"])
        .when(F.col("finding_count") > 0, READINESS_STATUS["caution"])
        .otherwise(READINESS_STATUS["ready"])
    )
    return (
        registry.select(V).join(f, V, "left").join(o, V, "left").join(r, V, "left").join(risks, V, "left")
        .fillna(0, counts).fillna("", ["families"])
        .select(V, status.alias("status"), "finding_count", "intervention_count", "required_decision_count", "families", "mlrs_score", "lrs_score")
    )


def selected_plan(ops: DataFrame, options: DataFrame) -> DataFrame:
    """Operations, columns and open decisions of each version's plan."""
    o = ops.groupBy(V).agg(F.count(F.lit(1)).alias("operation_count"), joined(F.flatten(F.collect_list("columns"))).alias("affected_columns"))
    d = options.groupBy(V).agg(
        F.count("decision").alias("unresolved_decisions"), F.concat_ws(",", F.array_sort(F.collect_list("intervention_id"))).alias("selected_options")
    )
    return o.join(d, V)


def experiment_handoff(registry: DataFrame, impacts: DataFrame) -> DataFrame:
    """Baseline and metrics an experiment on the version has to report."""
    metrics = impacts.groupBy(V).agg(joined(F.flatten(F.collect_list("metrics"))).alias("recommended_metrics"))
    return registry.join(metrics, V, "left").select(
        V,
        "task_type",
        F.concat(F.lit("V"), F.col("version_number").cast("string")).alias("required_baseline"),
        F.coalesce("recommended_metrics", F.lit("")).alias("recommended_metrics"),
    )


def column_impact(findings: DataFrame, columns: DataFrame) -> DataFrame:
    """Risk families and number of findings per column."""
    labels = _lookup(findings, list(FAMILY_LABELS.items()), "code string, family string")
    hit = findings.join(labels, "code", "left").select(V, F.coalesce("family", F.lower("code")).alias("family"), F.explode("columns").alias("column"))
    per_column = hit.groupBy(V, "column").agg(joined(F.collect_list("family")).alias("risk_families"), F.count(F.lit(1)).alias("operation_count"))
    return columns.join(per_column, [V, "column"]).select(
        V, "column", "role", "logical_dtype", "missing_ratio", "unique_count", "outlier_count", "risk_families", "operation_count"
    )


def normalise_family(text: Column) -> Column:
    """The first family whose name the text is or whose fragments it contains; else the text."""
    form = F.translate(F.lower(text), "- ", "__")
    rule = F
    for family, fragments in RISK_FAMILIES.items():
        hit = form == family
        for fragment in fragments:
            hit = hit | form.contains(fragment)
        rule = rule.when(hit, F.lit(family))
    return rule.otherwise(form)


def finding_families(findings: DataFrame) -> DataFrame:
    """Families a finding touches, read from its code, texts and evidence names."""
    names = _lookup(findings, [(c, n) for c, names in FINDING_EVIDENCE.items() for n in names], "code string, text string")
    texts = findings.select(V, "code", F.explode(F.array("code", "issue", "risk")).alias("text"))
    evidence = findings.select(V, "code").join(names, "code").select(V, "code", "text")
    families = texts.unionByName(evidence).withColumn("family", normalise_family(F.col("text")))
    return families.where(F.col("family").isin(*RISK_FAMILIES)).select(V, "code", "family").distinct()


def risk_map(findings: DataFrame, impact: DataFrame) -> DataFrame:
    """One row per column (or the whole dataset) with a flag per family."""
    listed = impact.select(V, "column", F.explode(F.split("risk_families", ",")).alias("label")).select(
        V, "column", normalise_family(F.col("label")).alias("family")
    )
    target = F.when(F.size("columns") > 0, F.col("columns")).otherwise(F.array(F.lit(NO_COLUMNS)))
    found = findings.select(V, "code", F.explode(target).alias("column")).join(finding_families(findings), [V, "code"], "left").select(
        V, "column", "family"
    )
    return listed.unionByName(found).groupBy(V, "column").agg(
        F.count_distinct("family").alias("family_count"),
        *[F.max(F.coalesce(F.col("family") == k, F.lit(False))).alias(k) for k in RISK_FAMILIES],
    )


def scope_label(options: DataFrame) -> DataFrame:
    """What an intervention applies to."""
    n = F.size("columns")
    label = (
        F.when(n == 1, "1 column")
        .when(n > 1, F.concat_ws(" ", n.cast("string"), F.lit("columns")))
        .when(F.col("code").contains("CLASS_IMBALANCE"), "Target distribution")
        .otherwise(NO_COLUMNS)
    )
    return options.select(V, "intervention_id", label.alias("scope"))
