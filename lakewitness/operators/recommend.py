"""From findings to candidate preparation plans, for all versions and goals at once (H1-H8).

``requests``: (request_id, version_id, goal, candidates, avoid_synthetic, max_features).
Rule tables have tens of rows, so broadcasting them is bounded by the rules, not by data.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakewitness import lookups as L

V = "version_id"


def _rules(df: DataFrame, rows: list, schema: str) -> DataFrame:
    return F.broadcast(df.sparkSession.createDataFrame(rows, schema))


def requirements(registry: DataFrame, columns: DataFrame, tables: DataFrame, findings: DataFrame, classification: DataFrame) -> DataFrame:
    """H1: what a version needs, one row per version."""
    has = lambda code: F.max(F.when(F.col("code") == code, True))
    severity = lambda code: F.max(F.when(F.col("code") == code, F.col("severity")))
    fired = findings.groupBy(V).agg(
        has("MISSINGNESS").alias("needs_missing_value_handling"),
        has("DUPLICATES").alias("has_duplicates"),
        has("OUTLIERS").alias("needs_outlier_treatment"),
        has("CORRELATION").alias("needs_feature_reduction"),
        has("CLASS_IMBALANCE").alias("needs_class_balancing"),
        has("TARGET_LEAKAGE").alias("needs_leakage_fix"),
        has("TARGET_SKEW").alias("has_target_skew"),
        has("SCALING").alias("needs_scaling"),
        F.max(F.when(F.col("code") == "MISSINGNESS", F.col("measure") * 100)).alias("missing_values_pct"),
        severity("OUTLIERS").alias("outliers"),
        severity("CLASS_IMBALANCE").alias("imbalance"),
    )
    target = columns.where(F.col("role") == "target").select(V, F.col("column").alias("target"), F.col("is_numeric").alias("numeric_target"))
    word = F.create_map(*[F.lit(x) for item in L.SEVERITY_WORDS.items() for x in item])
    supervised = F.col("task_type").isin("classification", "regression")
    classes = F.col("task_type") == "classification"
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    text_features = F.greatest(
        F.col("categorical_columns") - F.when(supervised & F.col("target").isNotNull() & ~F.col("numeric_target"), 1).otherwise(0), F.lit(0)
    )
    return (
        registry.select(V, "task_type").join(tables, V).join(fired, V, "left").join(target, V, "left")
        .join(classification.select(V, "min_class"), V, "left")
        .select(
            V,
            "task_type",
            F.when(supervised, F.col("target")).alias("target_column"),
            "row_count",
            "column_count",
            "numeric_columns",
            text_features.alias("text_features"),
            flag("needs_missing_value_handling").alias("needs_missing_value_handling"),
            (flag("needs_class_balancing") & classes).alias("needs_class_balancing"),
            flag("needs_outlier_treatment").alias("needs_outlier_treatment"),
            flag("needs_feature_reduction").alias("needs_feature_reduction"),
            (flag("needs_leakage_fix") & supervised & F.col("target").isNotNull()).alias("needs_leakage_fix"),
            flag("needs_scaling").alias("needs_scaling"),
            (text_features > 0).alias("needs_encoding"),
            flag("has_duplicates").alias("has_duplicates"),
            flag("has_target_skew").alias("has_target_skew"),
            F.coalesce("missing_values_pct", F.lit(0.0)).alias("missing_values_pct"),
            F.coalesce(word[F.col("outliers")], F.lit("none")).alias("outlier_severity"),
            F.when(classes, F.coalesce(word[F.col("imbalance")], F.lit("none"))).otherwise("none").alias("class_imbalance_severity"),
            F.when(classes, F.col("min_class")).alias("minority_class_count"),
        )
    )


def _registry_rows():
    order = list(L.CATEGORIES)
    return [(*row, order.index(row[1])) for row in L.TRANSFORMATIONS]


REGISTRY_FIELDS = ["transformation_id", "category", "label", "cost", "requires_target", "classification_only", "params", "category_order"]


def applicable(needs: DataFrame) -> DataFrame:
    """H2: steps that fit the task, the target and the column types of each version."""
    steps = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(REGISTRY_FIELDS, row)]) for row in _registry_rows()])
    every = needs.withColumn("step", F.explode(steps)).select(*needs.columns, "step.*")
    return every.where(
        (~F.col("classification_only") | (F.col("task_type") == "classification"))
        & (~F.col("requires_target") | F.col("target_column").isNotNull())
        & ((F.col("category") != "encoding") | F.col("needs_encoding"))
    )


def needed(requests: DataFrame, steps: DataFrame) -> DataFrame:
    """H3: steps of the categories a request calls for."""
    wanted = F.lit(False)
    for category, flag in L.CATEGORIES.items():
        here = F.col("category") == category
        wanted = wanted | (here if flag is None else here & F.col(flag))
    reduction = (F.col("category") == "feature_reduction") & F.col("max_features").isNotNull()
    return requests.join(steps, V).where(wanted | reduction)


def options(requests: DataFrame, steps: DataFrame) -> DataFrame:
    """H4: the order in which a goal prefers the steps of a category; ``option`` counts from 0."""
    preferred = [(g, c, t, i) for g, cats in L.GOAL_PREFERENCES.items() for c, ts in cats.items() for i, t in enumerate(ts)]
    ranks = _rules(steps, preferred, "known_goal string, category string, transformation_id string, preference int")
    known = F.when(F.col("goal").isin(*L.GOAL_PREFERENCES), F.col("goal")).otherwise(L.DEFAULT_GOAL)
    rows = needed(requests, steps).withColumn("known_goal", known).join(ranks, ["known_goal", "category", "transformation_id"], "left")
    rows = rows.where(~(F.col("avoid_synthetic") & F.col("transformation_id").isin(*L.SYNTHETIC)))
    w = Window.partitionBy("request_id", "category")
    order = w.orderBy(F.coalesce("preference", F.lit(99)), "transformation_id")
    return rows.withColumn("option", F.row_number().over(order) - 1).withColumn("option_count", F.count(F.lit(1)).over(w))


def candidates(requests: DataFrame, steps: DataFrame) -> DataFrame:
    """H5: candidate i takes option ``i mod k`` of every category, in category order.

    A candidate has one step per category and both conflict pairs lie inside one category, so no
    candidate can hold a conflict.
    """
    count = F.least(F.greatest(F.col("candidates"), F.lit(2)), F.lit(8))
    spread = options(requests, steps).withColumn("candidate", F.explode(F.sequence(F.lit(0), count - 1)))
    return spread.where(F.col("candidate") % F.col("option_count") == F.col("option")).select(
        "request_id", V, "goal", "candidate", "category_order", "category", "transformation_id", "label", "cost", "params", "row_count", "task_type"
    )


def candidate_costs(chosen: DataFrame) -> DataFrame:
    """H6 and H7: cost class, estimated seconds, and the hash that tells equal candidates."""
    keys = list(L.COST_SECONDS)
    seconds = F.create_map(*[F.lit(x) for item in L.COST_SECONDS.items() for x in item])
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(keys) for x in (k, i)])
    step = F.concat(F.lit('{"params": '), F.col("params"), F.lit(', "transformation_id": "'), F.col("transformation_id"), F.lit('"}'))
    ordered = F.sort_array(F.collect_list(F.struct("category_order", "transformation_id", step.alias("json"))))  # at most 7 steps
    return (
        chosen.groupBy("request_id", V, "goal", "candidate")
        .agg(ordered.alias("steps"), F.max(rank[F.col("cost")]).alias("rank"), F.sum(seconds[F.col("cost")]).alias("base"), F.max("row_count").alias("row_count"))
        .select(
            "request_id",
            V,
            "goal",
            "candidate",
            F.concat(F.lit("Pipeline-"), F.char(F.lit(65) + F.col("candidate"))).alias("pipeline_id"),
            F.array(*[F.lit(k) for k in keys])[F.col("rank")].alias("estimated_cost"),
            F.round(F.col("base") * F.greatest(F.lit(1.0), F.col("row_count") / 1000), 1).alias("estimated_seconds"),
            F.sha2(F.concat(F.lit("["), F.array_join(F.transform("steps", lambda s: s["json"]), ", "), F.lit("]")), 256).alias("pipeline_hash"),
            F.array_join(F.transform("steps", lambda s: s["transformation_id"]), ",").alias("steps"),
        )
    )


def explanations(chosen: DataFrame) -> DataFrame:
    """H8: what every step of a candidate does, with its parameters filled in."""
    texts = []
    for row in L.TRANSFORMATIONS:
        texts.append((row[0], L.STEP_TEXT[row[0]].format(**json.loads(row[6]))))
    return chosen.join(_rules(chosen, texts, "transformation_id string, explanation string"), "transformation_id").select(
        "request_id", "candidate", "category", "transformation_id", "label", "params", "explanation"
    )


def rationales(chosen: DataFrame) -> DataFrame:
    """H8: one sentence per candidate."""
    goals = _rules(chosen, list(L.GOAL_TEXT.items()), "goal string, goal_text string")
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("category_order", "label"))), lambda s: s["label"]), ", ")
    return (
        chosen.join(goals, "goal", "left").groupBy("request_id", "candidate").agg(
            F.count(F.lit(1)).alias("n"), listed.alias("labels"), F.max(F.coalesce("goal_text", "goal")).alias("text"),
            F.max("row_count").alias("rows"), F.max("task_type").alias("task"),
        )
        .select(
            "request_id",
            "candidate",
            F.format_string("%d step(s) (%s) to %s, on %d rows (%s task).", F.col("n"), F.col("labels"), F.col("text"), F.col("rows"), F.col("task")).alias("rationale"),
        )
    )
