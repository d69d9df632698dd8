"""Findings, readiness risk (MLRS) and leakage risk (LRS) for every version at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewitness.functions.columns import as_text, cap, is_numeric, safe_div
from lakewitness.lookups import (
    COMPONENT_TEXT,
    DIRECT_LEAKAGE_MARKERS,
    EXACT_ASSOCIATIONS,
    FINDING_TEXT,
    IDENTIFIER_NAMES,
    LRS_CAPS,
    LRS_FIRST_POINTS,
    MLRS_CAPS,
    POST_OUTCOME_MARKERS,
    SEVERITY_ORDER,
)
from lakewitness.functions.components import components
from lakewitness.operators.profile import imbalance_points
from lakewitness.operators.value_counts import union_all

V = "version_id"


# ---------------------------------------------------------------- correlation clusters

def correlation_clusters(pairs: DataFrame, configurations: DataFrame) -> DataFrame:
    """F16: groups of features linked by strong correlations, one row per member. The target is left out."""
    edges = (
        pairs.join(configurations.select(V, "target_column"), V, "left")
        .where(~F.coalesce((F.col("left") == F.col("target_column")) | (F.col("right") == F.col("target_column")), F.lit(False)))
        .select(V, "left", "right")
    )
    rows = components(edges, V, "left", "right").select(V, F.col("root").alias("cluster"), F.col("node").alias("column"))
    return rows.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy(V, "cluster")))


# ---------------------------------------------------------------- facts per version

def readiness_worsening(pairs: DataFrame, overall: DataFrame, duplicates: DataFrame, changes: DataFrame) -> DataFrame:
    """Inputs of F18: how much a child version got worse than its parent."""
    worst = changes.where(F.col("ratio_delta") > 0).groupBy("pair_id").agg(
        F.max("ratio_delta").alias("worst_column"), F.max("is_target").alias("target_worsened")
    )
    return (
        pairs.join(overall, "pair_id").join(duplicates, "pair_id", "left").join(worst, "pair_id", "left").select(
            F.col("current_version_id").alias(V),
            F.greatest("missing_ratio_change", F.lit(0.0)).alias("missing_worsening"),
            F.coalesce("worst_column", F.lit(0.0)).alias("column_worsening"),
            F.greatest(safe_div(F.coalesce("duplicates_delta", F.lit(0)), F.col("row_count_current")), F.lit(0.0)).alias("duplicate_worsening"),
            F.coalesce("target_worsened", F.lit(False)).alias("target_worsened"),
        )
    )


def version_facts(registry, columns, tables, classification, regression, clustering, clusters, worsening, scores) -> DataFrame:
    """One row per version with everything the rules read."""
    feature = F.col("role") != "target"
    outlier = F.coalesce("outlier_ratio", F.lit(0.0))
    per_column = columns.groupBy(V).agg(
        (F.count_if(F.col("missing_ratio") > 0) / F.count(F.lit(1))).alias("affected_ratio"),
        F.max("missing_ratio").alias("max_missing"),
        F.count_if(feature).alias("features"),
        F.count_if(feature & (outlier >= 0.05)).alias("outlier_features"),
        F.avg(F.when(feature, outlier)).alias("outlier_mean"),
        F.max(F.when(~feature, F.col("missing_ratio"))).alias("target_missing"),
        F.count_if(~feature).alias("target_columns"),
    )
    per_cluster = clusters.groupBy(V).agg(
        F.count_distinct("column").alias("clustered"), F.max("size").alias("largest"), F.count_distinct("cluster").alias("clusters")
    )
    return (
        registry.select(V, "dataset_id", "version_number", "parent_version_id", "version_notes", "task_type", "target_column")
        .join(tables, V).join(per_column, V)
        .join(classification.select(V, "class_count", "labelled_rows", "min_class", "max_class", "imbalance_ratio", "minority_class"), V, "left")
        .join(regression.select(V, "target_skewness", "target_outlier_count"), V, "left")
        .join(clustering.select(V, "spread_ratio", "scaling_required"), V, "left")
        .join(per_cluster, V, "left").join(worsening, V, "left")
        .join(scores.select(F.col("current_version_id").alias(V), "scm_score", "dsi_score"), V, "left")
        .fillna(0, ["clustered", "largest", "clusters"])
        .fillna(0.0, ["missing_worsening", "column_worsening", "duplicate_worsening"])
    )


# ---------------------------------------------------------------- leakage

def _has_any(text: Column, words) -> Column:
    return text.rlike("|".join(words))


def name_flags(columns: DataFrame, configurations: DataFrame) -> DataFrame:
    """target-like, post-outcome and identifier names per column."""
    name, target = F.lower("column"), F.lower("target_column")
    tokens = F.filter(F.split(F.replace(target, F.lit("-"), F.lit("_")), "_"), lambda t: F.length(t) >= 3)
    like = (name != target) & (name.contains(target) | F.exists(tokens, lambda t: F.contains(name, t)))
    bare = F.replace(name, F.lit("_"), F.lit(""))
    named = bare.isin(*IDENTIFIER_NAMES) | bare.endswith("id") | bare.contains("uuid") | bare.contains("guid")
    is_target = F.coalesce(F.col("column") == F.col("target_column"), F.lit(False))
    return columns.join(configurations.select(V, "target_column"), V).select(
        V,
        "column",
        is_target.alias("is_target"),
        F.coalesce(like, F.lit(False)).alias("target_like"),
        (_has_any(name, POST_OUTCOME_MARKERS) & ~is_target).alias("post_outcome"),
        (~is_target & (named | (F.col("unique_ratio") >= 0.95))).alias("identifier"),
        _has_any(name, DIRECT_LEAKAGE_MARKERS).alias("direct_name"),
    )


def target_association_pairs(correlations: DataFrame, configurations: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """strong correlations with the target and supplied associations."""
    t = correlations.join(configurations.select(V, "target_column"), V)
    pairs = t.where((F.col("left") == F.col("target_column")) | (F.col("right") == F.col("target_column"))).select(
        V,
        F.when(F.col("left") == F.col("target_column"), F.col("right")).otherwise(F.col("left")).alias("feature"),
        F.col("correlation").alias("association"),
        F.lit("numeric_correlation").alias("association_type"),
    )
    return pairs if extra is None else pairs.unionByName(extra.select(*pairs.columns))


def leakage_features(columns: DataFrame, correlations: DataFrame, configurations: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """One row per (version, kind, column) of the leakage evidence."""
    flags = name_flags(columns, configurations)
    pairs = target_association_pairs(correlations, configurations, extra)
    strong = F.abs("association")
    context = F.col("direct_name") | F.col("target_like")
    judged = pairs.join(flags, (pairs[V] == flags[V]) & (F.col("feature") == F.col("column"))).select(
        flags[V],
        "column",
        F.when((strong >= 0.999) & (context | F.col("association_type").isin(*EXACT_ASSOCIATIONS)), "direct")
        .when((strong >= 0.98) & (F.col("post_outcome") | context), "proxy")
        .alias("kind"),
    ).where(F.col("kind").isNotNull()).distinct()
    named = flags.select(
        V,
        "column",
        F.explode(
            F.filter(
                F.array(*[F.when(F.col(k), F.lit(k)) for k in ("target_like", "post_outcome", "identifier")]),
                lambda k: k.isNotNull(),
            )
        ).alias("kind"),
    )
    return judged.unionByName(named)


def diminishing(count: Column, first: float, maximum: float) -> Column:
    """points that grow ever slower with the number of items."""
    return F.when(count <= 0, F.lit(0.0)).otherwise(
        F.least(F.lit(maximum), first * (1 - F.pow(F.lit(0.6), count)) / 0.4)
    )


# ---------------------------------------------------------------- components and scores

def component_scores(facts: DataFrame, leakage: DataFrame, conflicts: DataFrame | None = None, overlap: DataFrame | None = None) -> DataFrame:
    """F11-F18 and F27 as one wide row per version.

    ``conflicts`` (F32) and ``overlap`` (F33) are optional; without them the score falls back to the
    evidence a profile always has.
    """
    kinds = ["direct", "proxy", "target_like", "post_outcome", "identifier"]
    counts = leakage.groupBy(V).agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds])
    base = facts.join(counts, V, "left").fillna(0, [f"n_{k}" for k in kinds])
    base = base.join(conflicts.select(V, "conflict_ratio"), V, "left") if conflicts is not None else base.withColumn("conflict_ratio", F.lit(0.0))
    base = base.join(overlap.select(V, "overlap_ratio"), V, "left") if overlap is not None else base.withColumn("overlap_ratio", F.lit(0.0))
    base = base.fillna(0.0, ["conflict_ratio", "overlap_ratio"])
    c = F.col
    task, width = c("task_type"), F.greatest(c("features"), F.lit(1))
    imbalance = F.when(
        (task == "classification") & c("class_count").isNotNull(),
        imbalance_points(c("max_class"), c("min_class"), c("class_count"), c("labelled_rows"), MLRS_CAPS["imbalance"]),
    ).otherwise(0.0)
    target_missing = cap(c("target_missing") * 120, 8)
    target_quality = (
        F.when(c("target_columns") == 0, F.when(task.isin("classification", "regression"), 15.0).otherwise(0.0))
        .when(task == "regression", target_missing + cap(F.abs("target_skewness") * 3, 6) + cap(c("target_outlier_count") / F.greatest(c("row_count"), F.lit(1)) * 60, 3))
        .when(task == "classification", target_missing + cap(imbalance * 0.25, 5))
        .otherwise(target_missing)
    )
    mlrs = {
        "missingness": cap(c("missing_ratio") * 100, 12) + cap(c("affected_ratio") * 12, 6) + cap(c("max_missing") * 35, 7),
        "duplicates": cap(c("duplicate_ratio") * 100, 10) + cap(c("conflict_ratio") * 120, 8),
        "imbalance": imbalance,
        "outliers": cap(c("outlier_features") / width * 9, 9) + cap(c("outlier_mean") * 75, 6),
        "correlation_redundancy": c("clustered") / width * 6 + c("largest") / width * 3 + F.least(c("clusters"), F.lit(3)),
        "target_quality": target_quality,
        "evolution_readiness": cap(c("missing_worsening") * 100, 5) + cap(c("column_worsening") * 45, 6) + cap(c("duplicate_worsening") * 120, 4),
    }
    counted = {
        "direct_target_leakage": "n_direct",
        "proxy_leakage": "n_proxy",
        "target_name_similarity": "n_target_like",
        "temporal_post_outcome": "n_post_outcome",
        "identifier_memorization": "n_identifier",
    }
    lrs = {k: diminishing(c(n), LRS_FIRST_POINTS[k], LRS_CAPS[k]) for k, n in counted.items()}
    lrs["split_contamination"] = F.when(c("overlap_ratio") > 0, cap(c("overlap_ratio") * 100, LRS_CAPS["split_contamination"])).otherwise(
        cap(c("duplicate_ratio") * 25, 4)
    )
    return base.select(
        V,
        *[cap(mlrs[k], top).alias(f"mlrs_{k}") for k, top in MLRS_CAPS.items()],
        *[cap(lrs[k], top).alias(f"lrs_{k}") for k, top in LRS_CAPS.items()],
    )


def risk_components(facts: DataFrame, leakage: DataFrame, conflicts: DataFrame | None = None, overlap: DataFrame | None = None) -> DataFrame:
    """(version_id, family, component, ordinal, score), unrounded."""
    wide = component_scores(facts, leakage, conflicts, overlap)
    rows = [(f, k) for f, caps in (("mlrs", MLRS_CAPS), ("lrs", LRS_CAPS)) for k in caps]
    return wide.select(
        V,
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(f).alias("family"), F.lit(k).alias("component"), F.lit(i).alias("ordinal"), F.col(f"{f}_{k}").alias("score"))
                    for i, (f, k) in enumerate(rows)
                ]
            )
        ).alias("r"),
    ).select(V, "r.*")


def risk_scores(components: DataFrame) -> DataFrame:
    """capped sums, two decimals.

    The thirteen components of a version are added in their fixed order, so that the last bits, and
    with them ties of the rounding, do not depend on the order of rows.
    """
    def total(family: str) -> Column:
        rows = F.array_sort(F.collect_list(F.when(F.col("family") == family, F.struct("ordinal", "score"))))
        return F.bround(cap(F.aggregate(rows, F.lit(0.0), lambda done, r: done + r["score"]), 100.0), 2)

    return components.groupBy(V).agg(total("mlrs").alias("mlrs_score"), total("lrs").alias("lrs_score"))


# ---------------------------------------------------------------- findings

def findings(facts: DataFrame, columns: DataFrame, clusters: DataFrame, leakage: DataFrame, risks: DataFrame) -> DataFrame:
    """One row per finding, in the fixed order of ``ordinal``."""
    sorted_columns = lambda df: df.groupBy(V).agg(F.array_sort(F.collect_set("column")).alias("columns"))
    outliers = sorted_columns(columns.where((F.col("role") != "target") & (F.col("outlier_ratio") >= 0.05)))
    clustered = sorted_columns(clusters)
    leaking = leakage.where(F.col("kind").isin("direct", "proxy", "post_outcome"))
    direct = leakage.where(F.col("kind") == "direct").groupBy(V).agg(F.count(F.lit(1)).alias("direct_count"))
    wide = (
        facts.join(risks, V)
        .join(outliers.withColumnRenamed("columns", "outlier_columns"), V, "left")
        .join(clustered.withColumnRenamed("columns", "cluster_columns"), V, "left")
        .join(sorted_columns(leaking).withColumnRenamed("columns", "leak_columns"), V, "left")
        .join(direct, V, "left")
    )
    c, none = F.col, F.array().cast("array<string>")
    missing, copies, ratio = c("missing_ratio"), c("duplicate_ratio"), F.coalesce("imbalance_ratio", F.lit(1.0))
    points = imbalance_points(c("max_class"), c("min_class"), c("class_count"), c("labelled_rows"), MLRS_CAPS["imbalance"])
    # code: severity (NULL when the rule does not fire), columns, measure behind it.
    rules = {
        "MISSINGNESS": (F.when(missing >= 0.4, "critical").when(missing >= 0.2, "high").when(missing >= 0.05, "medium"), none, missing),
        "DUPLICATES": (F.when(copies >= 0.1, "high").when(copies >= 0.01, "medium"), none, copies),
        "OUTLIERS": (F.when(c("outlier_columns").isNotNull(), "medium"), c("outlier_columns"), c("outlier_features").cast("double")),
        "CORRELATION": (F.when(c("clusters") > 0, "medium"), c("cluster_columns"), c("clusters").cast("double")),
        "CLASS_IMBALANCE": (
            F.when((c("task_type") == "classification") & (points >= 5), F.when(ratio >= 10, "critical").when(ratio >= 4, "high").otherwise("medium")),
            none,
            ratio,
        ),
        "TARGET_SKEW": (F.when((c("task_type") == "regression") & (F.abs("target_skewness") >= 1), "medium"), none, c("target_skewness")),
        "SCALING": (F.when((c("task_type") == "clustering") & c("scaling_required"), "high"), none, c("spread_ratio")),
        "TARGET_LEAKAGE": (
            F.when((c("lrs_score") >= 30) | (c("direct_count") > 0), F.when(c("lrs_score") >= 55, "critical").otherwise("high")),
            F.array_sort(F.array_compact(F.array_union(F.coalesce(c("leak_columns"), none), F.array(c("target_column"))))),
            c("lrs_score"),
        ),
    }
    return wide.select(
        V,
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(code).alias("code"),
                        F.lit(FINDING_TEXT[code][0]).alias("ordinal"),
                        severity.alias("severity"),
                        F.coalesce(cols, none).alias("columns"),
                        measure.cast("double").alias("measure"),
                        F.lit(FINDING_TEXT[code][1]).alias("issue"),
                        F.lit(FINDING_TEXT[code][2]).alias("risk"),
                        F.lit(FINDING_TEXT[code][3]).alias("recommendation"),
                    )
                    for code, (severity, cols, measure) in rules.items()
                ]
            )
        ).alias("f"),
    ).select(V, "f.*").where(F.col("severity").isNotNull())


# ---------------------------------------------------------------- details around the scores

def reproducibility_components(facts: DataFrame) -> DataFrame:
    """parent, notes and movement of a version."""
    known_origin = F.col("parent_version_id").isNotNull() | (F.col("version_number") == 1)
    return facts.select(
        V,
        F.when(known_origin, 0.0).otherwise(25.0).alias("missing_parent"),
        F.when(F.coalesce("version_notes", F.lit("")) == "", 15.0).otherwise(0.0).alias("undocumented_version"),
        F.round(cap(F.col("scm_score") * 0.5, 50), 2).alias("semantic_change"),
        F.round(cap(F.col("dsi_score") * 0.35, 35), 2).alias("dataset_shift"),
    )


def component_columns(columns: DataFrame, correlations: DataFrame, leakage: DataFrame, missing_changes: DataFrame, configurations: DataFrame) -> DataFrame:
    """F19 and the columns behind every component, one row per (version, component, column)."""
    row = lambda df, family, component: df.select(V, F.lit(family).alias("family"), F.lit(component).alias("component"), "column")
    target = configurations.where(F.col("target_column").isNotNull()).select(V, F.col("target_column").alias("column"))
    ends = correlations.select(V, F.explode(F.array("left", "right")).alias("column")).distinct()
    worse = missing_changes.where((F.col("ratio_delta") > 0) & ~F.col("is_target")).select(F.col("pair_id").alias(V), "column")
    kind = lambda k: leakage.where(F.col("kind") == k)
    return union_all(
        [
            row(columns.where(F.col("missing_count") > 0), "mlrs", "missingness"),
            row(target, "mlrs", "imbalance"),
            row(columns.where((F.col("role") != "target") & (F.col("outlier_ratio") >= 0.05)), "mlrs", "outliers"),
            row(ends, "mlrs", "correlation_redundancy"),
            row(target, "mlrs", "target_quality"),
            row(worse, "mlrs", "evolution_readiness"),
            row(kind("direct"), "lrs", "direct_target_leakage"),
            row(kind("proxy"), "lrs", "proxy_leakage"),
            row(kind("target_like"), "lrs", "target_name_similarity"),
            row(kind("post_outcome"), "lrs", "temporal_post_outcome"),
            row(kind("identifier"), "lrs", "identifier_memorization"),
        ]
    )


def component_details(components: DataFrame, behind: DataFrame) -> DataFrame:
    """score, affected columns, effect and next action of every component."""
    spark = components.sparkSession
    texts = spark.createDataFrame(
        [(f, k, *t) for (f, k), t in COMPONENT_TEXT.items()], "family string, component string, label string, effect string, next_action string"
    )
    listed = behind.groupBy(V, "family", "component").agg(F.concat_ws(",", F.array_sort(F.collect_set("column"))).alias("columns"))
    keys = ["family", "component"]
    return components.join(F.broadcast(texts), keys).join(listed, [V, *keys], "left").select(
        V, *keys, "ordinal", F.round("score", 2).alias("score"), F.coalesce("columns", F.lit("")).alias("columns"), "label", "effect", "next_action"
    )


def component_evidence(facts: DataFrame) -> DataFrame:
    """ratios behind missingness and readiness degradation."""
    return facts.select(
        V,
        F.col("missing_ratio").alias("overall_missing_ratio"),
        F.round("affected_ratio", 6).alias("affected_feature_ratio"),
        F.col("max_missing").alias("max_feature_missing_ratio"),
        F.col("missing_worsening").alias("overall_missingness_worsening"),
        F.col("column_worsening").alias("max_feature_missingness_worsening"),
        F.round("duplicate_worsening", 6).alias("duplicate_ratio_worsening"),
        F.coalesce("target_worsened", F.lit(False)).alias("target_missingness_worsened"),
    )


def intervention_hints(details: DataFrame) -> DataFrame:
    """components with points, highest first; ties in component order."""
    order = Window.partitionBy(V).orderBy(F.col("score").desc(), F.col("ordinal"))
    return details.where(F.col("score") > 0).select(
        V, F.row_number().over(order).alias("rank"), "family", "component", "score", "columns",
        F.col("next_action").alias("recommended_action"), F.col("effect").alias("expected_effect"),
    )


# ---------------------------------------------------------------- producers for optional evidence

def _cells_digest(df: DataFrame, names: list[str]) -> Column:
    from lakewitness.functions.columns import row_digest

    return row_digest(df, names)


def measured_evidence(versions: dict[int, DataFrame], configurations: DataFrame, splits: dict[int, tuple[str, list[str]]]) -> tuple[DataFrame | None, DataFrame | None, DataFrame | None]:
    """F32, F33 and F34 of all versions that have what it takes: a target, a split column, a class target."""
    from lakewitness.operators.value_counts import union_all

    conflicts, overlaps, associations = [], [], []
    for r in configurations.select(V, "task_type", "target_column").orderBy(V).collect():
        v, target = r[V], r["target_column"]
        if v not in versions:
            continue
        if target in versions[v].columns and r["task_type"] == "classification":
            conflicts.append(conflicting_duplicates(versions[v], v, target))
            associations.append(target_associations(versions[v], v, target))
        if v in splits:
            overlaps.append(split_overlap(versions[v], v, *splits[v]))
    return tuple(union_all(parts) if parts else None for parts in (conflicts, overlaps, associations))


def conflicting_duplicates(df: DataFrame, version_id: int, target: str) -> DataFrame:
    """F32: share of rows whose features also occur with another target value.

    (features, target) pairs are counted first, so a hot group of copies shrinks to one row per
    target value before the second grouping.
    """
    features = [c for c in df.columns if c != target]
    pairs = df.select(_cells_digest(df, features).alias("f"), _cells_digest(df, [target]).alias("t")).groupBy("f", "t").agg(
        F.count(F.lit(1)).alias("n")
    )
    groups = pairs.groupBy("f").agg(F.count(F.lit(1)).alias("targets"), F.sum("n").alias("n"))
    return groups.agg(
        F.coalesce(F.sum(F.when(F.col("targets") > 1, F.col("n"))), F.lit(0)).alias("conflicting_rows"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
    ).select(
        F.lit(version_id).cast("long").alias(V),
        "conflicting_rows",
        F.round(safe_div(F.col("conflicting_rows"), F.col("row_count")), 6).alias("conflict_ratio"),
    )


def split_overlap(df: DataFrame, version_id: int, split: str, keys: list[str]) -> DataFrame:
    """entities and rows that occur in more than one split."""
    parts = df.select(_cells_digest(df, keys).alias("k"), F.col(split).alias("s")).groupBy("k", "s").agg(F.count(F.lit(1)).alias("n"))
    entities = parts.groupBy("k").agg(F.count("s").alias("splits"), F.sum("n").alias("n"))
    shared = F.col("splits") > 1
    return entities.agg(
        F.count_if(shared).alias("overlapping_entities"),
        F.coalesce(F.sum(F.when(shared, F.col("n"))), F.lit(0)).alias("overlapping_rows"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
    ).select(
        F.lit(version_id).cast("long").alias(V),
        "overlapping_entities",
        "overlapping_rows",
        F.round(safe_div(F.col("overlapping_rows"), F.col("row_count")), 6).alias("overlap_ratio"),
    )


def target_associations(df: DataFrame, version_id: int, target: str) -> DataFrame:
    """features that copy, invert or determine the target.

    (feature, value, target) triples are counted, then each value keeps its most frequent target;
    the share of rows these cover is the association. Values that occur once prove nothing, so a
    feature needs fewer distinct values than rows to count as a mapping.
    """
    fields = [f for f in df.schema.fields if f.name != target]
    by_name = {f.name: f for f in df.schema.fields}

    def text(field) -> Column:
        from lakewitness.functions.columns import exact_text

        return exact_text(field)

    cells = df.where(text(by_name[target]).isNotNull()).select(
        text(by_name[target]).alias("t"),
        F.explode(F.array(*[F.struct(F.lit(f.name).alias("column"), text(f).alias("v")) for f in fields])).alias("c"),
    ).select("t", "c.*").where(F.col("v").isNotNull())
    triples = cells.groupBy("column", "v", "t").agg(F.count(F.lit(1)).alias("n"))
    values = triples.groupBy("column", "v").agg(
        F.max("n").alias("best"),
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("targets"),
        F.min("t").alias("t"),
        F.sum(F.when(F.col("v") == F.col("t"), F.col("n")).otherwise(0)).alias("same"),
    )
    sizes = values.groupBy("column").agg(
        F.sum("best").alias("best"),
        F.sum("n").alias("n"),
        F.sum("same").alias("same"),
        F.count(F.lit(1)).alias("values"),
        F.max("targets").alias("most_targets"),
        F.count_distinct("t").alias("images"),
    )
    kind = (
        F.when(F.col("most_targets") > 1, F.lit(None).cast("string"))
        .when(F.col("same") == F.col("n"), "exact_copy")
        .when((F.col("values") == 2) & (F.col("images") == 2), "inverse_mapping")
        .when(F.col("values") * 2 <= F.col("n"), "deterministic_mapping")
    )
    return sizes.select(
        F.lit(version_id).cast("long").alias(V),
        F.col("column").alias("feature"),
        F.round(F.col("best") / F.col("n"), 6).alias("association"),
        kind.alias("association_type"),
    ).where(F.col("association_type").isNotNull())


# ---------------------------------------------------------------- views over scores and findings

def severity_counts(findings_df: DataFrame) -> DataFrame:
    """findings per severity and the highest one."""
    rank = F.create_map(*[F.lit(x) for item in SEVERITY_ORDER.items() for x in item])
    return findings_df.groupBy(V).agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITY_ORDER],
        F.max_by("severity", rank[F.col("severity")]).alias("highest"),
    )


def risk_tone(score: Column) -> Column:
    """F36."""
    return F.when(score >= 70, "critical").when(score >= 45, "high").when(score >= 20, "medium").when(score.isNotNull(), "low").otherwise("neutral")


def categorical_consistency(vc: DataFrame, columns: DataFrame) -> DataFrame:
    """cells whose label differs from another only by case, blanks, ``_`` or ``-``.

    Labels may be whole texts. Those of one form are counted under 16 bytes of its SHA-256, in each task before the shuffle, so no
    text is shuffled or sorted.
    """
    text = columns.where((F.col("role") != "target") & ~F.col("is_numeric")).select(V, "column")
    form = F.trim(F.regexp_replace(F.lower(F.translate("value", "_-", "  ")), r"\s+", " "))
    labels = vc.where(F.col("value").isNotNull()).join(F.broadcast(text), [V, "column"])
    forms = labels.groupBy(V, "column", F.unhex(F.substring(F.sha2(form, 256), 1, 32)).alias("form")).agg(F.count(F.lit(1)).alias("spellings"), F.sum("cnt").alias("cnt"))
    return forms.groupBy(V, "column").agg(
        F.sum("cnt").alias("cells"), F.sum(F.when(F.col("spellings") > 1, F.col("cnt")).otherwise(0)).alias("affected_cells")
    )


def quality_scores(facts: DataFrame, columns: DataFrame, consistency: DataFrame, risks: DataFrame, valid_targets: DataFrame) -> DataFrame:
    """eight figures from 0 to 100. ``valid_targets`` holds (version_id, valid_rows, target_rows)."""
    feature = F.col("role") != "target"
    shape = columns.groupBy(V).agg(
        F.sum(F.when(feature & F.col("is_numeric"), F.col("outlier_count")).otherwise(0)).alias("outliers"),
        F.count_if(feature & F.col("is_numeric")).alias("numeric_features"),
        F.count_if(F.col("unique_count") <= 1).alias("constant"),
        F.count_if(feature & ~F.col("is_numeric") & (F.col("unique_ratio") >= 0.5) & (F.col("unique_count") >= 20)).alias("high_cardinality"),
    )
    spelled = consistency.groupBy(V).agg((F.sum("affected_cells") / F.greatest(F.sum("cells"), F.lit(1))).alias("inconsistent"))
    c = F.col
    score = lambda value: F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), value)), 2)
    cells = F.greatest(c("row_count") * F.greatest(c("numeric_features"), F.lit(1)), F.lit(1))
    minority = F.coalesce(c("min_class") / F.greatest(c("labelled_rows"), F.lit(1)) * 100, F.lit(0.0))
    width = F.greatest(c("column_count"), F.lit(1))
    return (
        facts.join(shape, V).join(spelled, V, "left").join(risks, V).join(valid_targets, V, "left")
        .fillna(0.0, ["inconsistent"])
        .select(
            V,
            score(100 - c("missing_ratio") * 100).alias("completeness"),
            score(100 - c("duplicate_ratio") * 100).alias("uniqueness"),
            score(100 - c("inconsistent") * 100).alias("consistency"),
            score(100 - c("outliers") / cells * 100).alias("outlier_health"),
            score(minority * 2).alias("class_balance"),
            score(100 - c("lrs_score")).alias("leakage_safety"),
            score(100 - (c("constant") / width * 50) - (c("high_cardinality") / width * 30)).alias("schema_quality"),
            score(100 - F.coalesce((c("target_rows") - c("valid_rows")) / F.greatest(c("target_rows"), F.lit(1)), F.lit(0.0)) * 100).alias("validity"),
        )
    )


def valid_target_rows(classes: DataFrame, allowed: list[str]) -> DataFrame:
    label = F.lower(F.trim("class"))
    return classes.groupBy(V).agg(
        F.sum(F.when(label.isin(*allowed), F.col("cnt")).otherwise(0)).alias("valid_rows"), F.sum("cnt").alias("target_rows")
    )


def leakage_feature_list(leakage: DataFrame) -> DataFrame:
    """every column with leakage evidence, per version."""
    return leakage.groupBy(V).agg(F.concat_ws(",", F.array_sort(F.collect_set("column"))).alias("features"))


def score_deltas(registry: DataFrame, risks: DataFrame) -> DataFrame:
    """movement of both risk scores from one version of a dataset to the next."""
    w = Window.partitionBy("dataset_id").orderBy("version_number")
    step = lambda s: F.round(F.col(s) - F.lag(s).over(w), 2)
    return registry.select(V, "dataset_id", "version_number").join(risks, V).select(
        V, "mlrs_score", "lrs_score", step("mlrs_score").alias("mlrs_delta"), step("lrs_score").alias("lrs_delta")
    )
