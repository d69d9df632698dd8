"""Queries over the evidence store: versions, lineage, activity, studies and protocols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewitness import lookups as L
from lakewitness.functions.ordered import BUCKETS, numbered_rows
from lakewitness.operators.value_counts import union_all
from lakewitness.session import cut

V = "version_id"


def seconds(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp")).cast("double")


def number_versions(arrivals: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """K1: the next numbers of each dataset in order of arrival; the parent is the one before.

    ``arrivals``: (version_id, dataset_id, created_at, existing) with ``existing`` the highest number so far.
    """
    timed = arrivals.withColumn("at", seconds("created_at"))
    ranked = numbered_rows(timed, ["dataset_id"], "at", V, [V], buckets)
    return ranked.select(
        V, "dataset_id", "created_at", (F.col("rank") + F.coalesce("existing", F.lit(0))).cast("int").alias("version_number"),
        F.col(f"previous_{V}").alias("parent_version_id"),
    )


def lineage_tree(versions: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """K2: depth, ordering path and root of every version below the roots, in a number of rounds that is logarithmic in the depth.

    Every version points at an ancestor and knows how it gets there; a round replaces the pointer by that of the ancestor, which
    doubles its reach. A version on or below a ring never gets to a root: it is returned with nothing but its id. One
    whose chain ends at a version that doesn't exist, or at none of the given roots, is left out. Children of one parent, however
    many, meet its single row, a join that adaptive execution splits.
    """
    step = F.lpad(F.col("version_number").cast("string"), 19, "0")
    given = versions.select(V, "parent_version_id", step.alias("path"))
    if roots is not None:
        tops = roots.select(V, F.lit(True).alias("top")).distinct()
        given = given.join(tops, V, "left")
    top = F.col("parent_version_id").isNull() if roots is None else F.coalesce("top", F.lit(False))
    # A chain that reaches the end of its tree without a given root has nothing to point at.
    nowhere = F.lit(False) if roots is None else F.col("parent_version_id").isNull() & ~F.coalesce("top", F.lit(False))
    start = cut(given.where(~nowhere).select(V, F.when(~top, F.col("parent_version_id")).alias("jump"), F.when(top, F.col(V)).alias("root_id"), F.when(top, 0).otherwise(1).alias("depth"), "path"))
    # Pointers first: rings, on which a path would grow without end, are known before any path is put together.
    placed = _doubled(start.drop("path").withColumn("path", F.lit(None).cast("string")))
    ring = placed.where("root_id IS NULL").select(V, F.lit(None).cast("int").alias("depth"), F.lit(None).cast("string").alias("path"), "root_id")
    rooted = _doubled(start.join(placed.where("root_id IS NOT NULL").select(V), V))
    return rooted.select(V, "depth", "path", "root_id").unionByName(ring)


def _doubled(state: DataFrame) -> DataFrame:
    """Rows (version, jump, root_id, depth, path) after their pointers were followed to the end, or around a ring for long enough."""
    state = cut(state)
    for _ in range(state.count().bit_length() + 1):
        done = state.where(F.col("jump").isNull())
        ahead = state.select(F.col(V).alias("jump"), F.col("jump").alias("next"), F.col("root_id").alias("root"), F.col("depth").alias("more"), F.col("path").alias("above"))
        # no chain is longer than an int says; around a ring the number means nothing
        moved = state.where(F.col("jump").isNotNull()).join(ahead, "jump").select(
            V, F.col("next").alias("jump"), F.col("root").alias("root_id"), F.least(F.col("depth").cast("long") + F.col("more"), F.lit(2**31 - 1)).cast("int").alias("depth"),
            F.when(F.col("path").isNotNull(), F.concat_ws("/", "above", "path")).alias("path"),
        )
        if moved.isEmpty():
            return done
        state = cut(done.unionByName(moved))
    return state


def node_kinds(versions: DataFrame) -> DataFrame:
    """K3: baseline, revision or variant; a root has no parent among the versions."""
    parents = versions.select(F.col(V).alias("parent_version_id"), F.lit(True).alias("found"))
    kind = (
        F.when(F.col("parent_version_id").isNull(), "baseline")
        .when(F.coalesce("generation_method", F.lit("manual")) != "manual", "variant")
        .otherwise("revision")
    )
    return versions.join(parents, "parent_version_id", "left").select(V, kind.alias("node_kind"), F.col("found").isNull().alias("is_root"))


def timeline(versions: DataFrame, selected: DataFrame, diffs: DataFrame) -> DataFrame:
    """K4: versions of a dataset up to the selected one, with their comparison to the parent.

    ``selected`` has one version per dataset.
    """
    upto = selected.join(versions.select(V, "dataset_id", "version_number"), V).select("dataset_id", F.col("version_number").alias("upto"))
    return versions.join(upto, "dataset_id").where(F.col("version_number") <= F.col("upto")).join(diffs, V, "left")


def latest(log: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """K5: newest log row per key, as a mergeable aggregate: a hot key is reduced before the shuffle."""
    newest = F.max_by(F.struct(*order, *[c for c in keep if c not in order]), F.struct(*order))
    return log.groupBy(*keys).agg(newest.alias("row")).select(*keys, *[F.col(f"row.{c}").alias(c) for c in dict.fromkeys([*order, *keep])])


def diagnosis_status(versions: DataFrame, profiles: DataFrame, diagnoses: DataFrame, diffs: DataFrame) -> DataFrame:
    """K6. Evidence relations hold (version_id, ruleset)."""
    def ruled(df: DataFrame, name: str) -> DataFrame:
        return df.select(V, F.col("ruleset").alias(name))

    joined = versions.join(ruled(profiles, "profile_rules"), V, "left").join(ruled(diagnoses, "diagnosis_rules"), V, "left").join(ruled(diffs, "diff_rules"), V, "left")
    stale = (
        F.col("profile_rules").isNull()
        | (F.col("profile_rules") != L.PROFILER)
        | (F.col("diagnosis_rules") != L.DIAGNOSIS_RULES)
        | (F.col("parent_version_id").isNotNull() & F.col("diff_rules").isNull())
        | F.coalesce(F.col("diff_rules") != L.SEMANTIC_RULES, F.lit(False))
    )
    status = F.when(F.col("diagnosis_rules").isNull(), "Not Diagnosed").when(stale, "Recompute Available").otherwise("Diagnosed")
    return joined.select(V, status.alias("diagnosis_status"))


def stale_versions(status: DataFrame) -> DataFrame:
    """K7: the work list of versions whose evidence is missing or outdated."""
    return status.where(F.col("diagnosis_status") != "Diagnosed")


def without_report(versions: DataFrame, reports: DataFrame) -> DataFrame:
    """K8."""
    return versions.join(reports.select(V), V, "left_anti")


def recent_versions(versions: DataFrame, per_study: int, total: int) -> DataFrame:
    """K9: the newest versions of every study, and of these the last ``total``.

    Ranking with a limit prunes inside each task first, so a hot study sends only its top rows.
    """
    newest = F.row_number().over(Window.partitionBy("study_id").orderBy(F.col(V).desc()))
    return versions.withColumn("place", newest).where(F.col("place") <= per_study).orderBy(F.col("study_id").desc(), F.col(V).desc()).limit(total).select("study_id", V)


def dashboard(studies: DataFrame, versions: DataFrame, risks: DataFrame) -> DataFrame:
    """Counts per owner. Counting happens per study before owners are grouped, so an owner with
    very many versions is reduced first."""
    scored = versions.join(risks.select(V, "mlrs_score"), V, "left")
    per_dataset = scored.groupBy("study_id", "dataset_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.coalesce(F.col("mlrs_score") >= 60, F.lit(False))).alias("high"))
    per_study = per_dataset.groupBy("study_id").agg(F.count(F.lit(1)).alias("datasets"), F.sum("n").alias("versions"), F.max("high").alias("high"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return studies.join(per_study, "study_id", "left").groupBy("owner_id").agg(
        F.count(F.lit(1)).alias("total_studies"), zero("datasets").alias("total_datasets"), zero("versions").alias("total_versions"),
        F.count_if(F.coalesce("high", F.lit(False))).alias("high_risk_studies"),
    )


def newest(df: DataFrame, order: list[str], limit: int) -> DataFrame:
    """Top rows by time; planned as a bounded top-k per task."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(limit)


def study_findings(versions: DataFrame, risks: DataFrame, findings: DataFrame) -> DataFrame:
    """Dataset, version and diagnosis side by side, one flat row per version."""
    return versions.join(risks, V, "left").join(findings, V, "left").select(
        "study_id", "dataset_id", V, "version_number", "mlrs_score", "lrs_score", F.coalesce("finding_count", F.lit(0)).alias("finding_count")
    )


def study_summary(versions: DataFrame, risks: DataFrame) -> DataFrame:
    """K13."""
    worst = F.max("mlrs_score")
    return versions.join(risks, V, "left").groupBy("study_id").agg(
        F.count(F.lit(1)).alias("version_count"),
        F.round(F.avg("mlrs_score"), 1).alias("average_mlrs"),
        worst.alias("max_mlrs"),
        F.when(worst.isNull(), "neutral").when(worst >= 70, "high").when(worst >= 40, "medium").otherwise("low").alias("tone"),
    )


def search_studies(studies: DataFrame, text: str | None, task: str | None) -> DataFrame:
    """Name contains the text, whatever the case; newest first."""
    if text:
        studies = studies.where(F.lower("name").contains(text.lower()))
    if task:
        studies = studies.where(F.col("ml_task") == task)
    return studies.orderBy(F.col("updated_at").desc(), F.col("study_id"))


def datasets_overview(versions, configurations, prints, tables, risks, findings, status) -> DataFrame:
    """Every version with its configuration, fingerprint, profile summary, risks and status."""
    counts = findings.groupBy(V).agg(F.count(F.lit(1)).alias("finding_count"))
    return (
        versions.select(V, "dataset_id", "dataset_name", "version_number", "generation_method", "created_at")
        .join(configurations.select(V, "task_type", "target_column"), V, "left")
        .join(prints.select(V, "schema_hash", "configuration_hash"), V, "left")
        .join(tables.select(V, "row_count", "column_count", "missing_ratio", "duplicate_ratio"), V, "left")
        .join(risks, V, "left").join(counts, V, "left").join(status, V, "left")
        .withColumn("finding_count", F.when(F.col("mlrs_score").isNotNull(), F.coalesce("finding_count", F.lit(0))))
    )


def report_metrics(versions, scores, overall, duplicates, risks, findings, tables) -> DataFrame:
    """The figures of a version report."""
    on = lambda df, cols: df.select(F.col("pair_id").alias(V), *cols)
    counts = findings.groupBy(V).agg(F.count(F.lit(1)).alias("finding_count"))
    moved = on(overall.withColumn("row_count_change", F.col("row_count_current") - F.col("row_count_previous")), ["row_count_change", "column_count_change", "missing_ratio_change"])
    return (
        versions.select(V).join(on(scores, ["scm_score", "dsi_score"]), V, "left").join(risks, V, "left").join(counts, V, "left")
        .join(moved, V, "left").join(on(duplicates, [F.col("duplicates_delta").alias("duplicate_row_delta")]), V, "left")
        .join(tables.select(V, F.col("column_count").alias("profile_columns")), V, "left")
        .withColumn("finding_count", F.coalesce("finding_count", F.lit(0)))
    )


def instant_insights(versions, tables, risks, findings, scores) -> DataFrame:
    """One line of text, the most important findings and the threshold actions per version."""
    f = findings.groupBy(V).agg(
        F.count(F.lit(1)).alias("finding_count"),
        F.count_if(F.col("severity").isin("critical", "high")).alias("high_priority"),
        F.array_join(F.slice(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "issue"))), lambda x: x["issue"]), 1, 5), "|").alias("top_findings"),
    )
    s = scores.select(F.col("current_version_id").alias(V), "scm_score", "dsi_score")
    one = lambda c: F.coalesce(F.format_string("%.1f", F.col(c)), F.lit("N/A"))
    semantic = (
        F.when(F.col("scm_score").isNotNull(), F.format_string(L.INSIGHT_TEXT["compared"], F.col("scm_score"), F.col("dsi_score")))
        .when(F.col("parent_version_id").isNotNull(), L.INSIGHT_TEXT["not_compared"])
        .otherwise(L.INSIGHT_TEXT["baseline"])
    )
    actions = F.array_compact(
        F.array(
            F.when(F.col("mlrs_score") >= 45, L.INSIGHT_TEXT["readiness"]),
            F.when(F.col("lrs_score") >= 20, L.INSIGHT_TEXT["leakage"]),
            F.when(F.col("scm_score").isNotNull(), L.INSIGHT_TEXT["movement"]),
        )
    )
    fallback = F.array(F.lit(L.INSIGHT_TEXT["fallback"]))
    return (
        versions.join(tables.select(V, "missing_cells", "duplicate_rows"), V).join(risks, V, "left").join(f, V, "left").join(s, V, "left")
        .select(
            V,
            F.concat(F.col("dataset_name"), F.lit(" V"), F.col("version_number").cast("string"), F.lit(": MLRS "), one("mlrs_score"), F.lit(", LRS "), one("lrs_score"), F.lit(". "), semantic).alias("summary"),
            F.concat(F.col("missing_cells").cast("string"), F.lit(" missing cells, "), F.col("duplicate_rows").cast("string"), F.lit(" duplicate rows")).alias("quality"),
            F.coalesce("finding_count", F.lit(0)).alias("finding_count"),
            F.coalesce("high_priority", F.lit(0)).alias("high_priority"),
            F.coalesce("top_findings", F.lit(L.INSIGHT_TEXT["no_findings"])).alias("top_findings"),
            F.array_join(F.when(F.size(actions) > 0, actions).otherwise(fallback), "|").alias("actions"),
        )
    )


def new_insights(insights: DataFrame, known: DataFrame) -> DataFrame:
    """Insights whose evidence hash is not in the log yet."""
    hashed = insights.withColumn(
        "evidence_hash", F.sha2(F.concat_ws("|", F.col(V).cast("string"), "summary", "quality", F.col("finding_count").cast("string")), 256)
    )
    return hashed.join(known.select("evidence_hash"), "evidence_hash", "left_anti")


def compact_context(versions, configurations, tables, findings, correlations, worst_missing, worst_outliers, shifted) -> DataFrame:
    """The short form of a version's evidence, every list cut to its documented length."""
    def listed(df: DataFrame, item: Column, alias: str, limit: int, key: str = V, rank: str = "rank") -> DataFrame:
        cutoff = df.where(F.col(rank) <= limit)
        pairs = F.sort_array(F.collect_list(F.struct(F.col(rank).alias("r"), item.alias("x"))))
        return cutoff.groupBy(F.col(key).alias(V)).agg(F.array_join(F.transform(pairs, lambda p: p["x"]), ",").alias(alias))

    order = F.row_number().over(Window.partitionBy(V).orderBy("ordinal"))
    r = correlations.groupBy(V).agg(F.count(F.lit(1)).alias("high_correlation_count"))
    base = versions.select(V, "dataset_name", "version_number").join(configurations.select(V, "task_type", "target_column", F.size("selected_features").alias("selected_feature_count")), V)
    return (
        base.join(tables.select(V, "row_count", "column_count", "missing_cells", "duplicate_rows"), V, "left").join(r, V, "left")
        .join(listed(worst_missing, F.col("column"), "top_missing", 8), V, "left")
        .join(listed(worst_outliers, F.col("column"), "top_outliers", 8), V, "left")
        .join(listed(findings.withColumn("rank", order), F.concat_ws(":", "code", "severity"), "findings", 12), V, "left")
        .join(listed(shifted, F.col("column"), "top_shifted", 5, key="pair_id"), V, "left")
        .fillna(0, ["high_correlation_count"]).fillna("", ["top_missing", "top_outliers", "findings", "top_shifted"])
    )


def version_ledger(versions: DataFrame, prints: DataFrame, risks: DataFrame, scores: DataFrame, findings: DataFrame) -> DataFrame:
    """The version and metric tables of a study."""
    s = scores.select(F.col("current_version_id").alias(V), "scm_score", "dsi_score")
    counts = findings.groupBy(V).agg(F.count(F.lit(1)).alias("finding_count"))
    return (
        versions.join(prints.select(V, "schema_hash"), V, "left").join(risks, V, "left").join(s, V, "left").join(counts, V, "left")
        .select(
            V, "study_id", F.concat(F.lit("V"), F.col("version_number").cast("string")).alias("version"),
            F.coalesce(F.col("parent_version_id").cast("string"), F.lit("Baseline")).alias("parent"), "row_count", "column_count",
            F.left("schema_hash", F.lit(16)).alias("schema"), "mlrs_score", "lrs_score", "scm_score", "dsi_score", F.coalesce("finding_count", F.lit(0)).alias("finding_count"),
        )
    )


def study_progress(studies: DataFrame, versions: DataFrame, prints: DataFrame, risks: DataFrame) -> DataFrame:
    """Which stages a study has reached."""
    marks = versions.join(prints.select(V, F.lit(True).alias("printed")), V, "left").join(risks.select(V, F.lit(True).alias("diagnosed")), V, "left")
    per = marks.groupBy("study_id").agg(F.bool_or(F.col("printed").isNotNull()).alias("printed"), F.bool_or(F.col("diagnosed").isNotNull()).alias("diagnosed"), F.count(F.lit(1)).alias("n"))
    done = lambda test, other: F.when(F.coalesce(test, F.lit(False)), "Complete").otherwise(other)
    return studies.join(per, "study_id", "left").select(
        "study_id", F.lit("Complete").alias("protocol"), done(F.col("n") > 0, "Not started").alias("version_created"),
        done(F.col("printed"), "Not available").alias("fingerprint"), done(F.col("diagnosed"), "Not available").alias("diagnosis"),
    )


# ---------------------------------------------------------------- protocols

def filled(column: str) -> Column:
    """A text field counts when it is not empty; the seed counts whenever it is set, zero included."""
    return F.col(column).isNotNull() if column == "random_seed" else F.coalesce(F.col(column) != "", F.lit(False))


def completeness(protocols: DataFrame) -> DataFrame:
    """Ten points per filled field, and the names of the missing ones."""
    gaps = F.array_compact(F.array(*[F.when(~filled(c), F.lit(c)) for c in L.COMPLETENESS_FIELDS]))
    return protocols.withColumn("missing_fields", gaps).withColumn("completeness_score", 100 - 10 * F.size("missing_fields"))


def protocol_hash(fields: list[str]) -> Column:
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat_ws("\u001f", *parts), 256)


def protocol_versions(edits: DataFrame, key: str, order: str, tie: str, fields: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Edits that change nothing are skipped; the others are numbered, and each is valid until the next."""
    timed = edits.withColumn("hash", protocol_hash(fields)).withColumn("at", seconds(order))
    seen = numbered_rows(timed, [key], "at", tie, ["hash"], buckets)
    kept = seen.where(F.col("previous_hash").isNull() | (F.col("previous_hash") != F.col("hash"))).drop("rank", "previous_hash", "next_hash")
    ranked = numbered_rows(kept, [key], "at", tie, [order], buckets)
    return ranked.withColumnRenamed("rank", "version_number").withColumnRenamed(f"next_{order}", "superseded_at").withColumn(
        "status", F.when(F.col("superseded_at").isNull(), "current").otherwise("archived")
    ).drop("at", f"previous_{order}")


def protocol_diffs(protocols: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Each protocol version against the one before: changed, added and removed fields."""
    scored = completeness(protocols)
    keep = [*fields, "completeness_score", "hash"]
    old = scored.select(key, (F.col("version_number") + 1).alias("version_number"), *[F.col(c).alias(f"old_{c}") for c in keep])
    both = scored.join(old, [key, "version_number"])

    def listed(test) -> Column:
        return F.array_join(F.array_compact(F.array(*[F.when(test(c), F.lit(c)) for c in fields])), ",")

    changed = lambda c: ~F.col(c).eqNullSafe(F.col(f"old_{c}"))
    given = lambda name: F.coalesce(F.col(name).cast("string").isin("", "0") == F.lit(False), F.lit(False))
    return both.select(
        key,
        "version_number",
        (F.col("hash") != F.col("old_hash")).alias("hash_changed"),
        (F.col("completeness_score") - F.col("old_completeness_score")).alias("completeness_delta"),
        listed(changed).alias("fields_changed"),
        listed(lambda c: changed(c) & ~given(f"old_{c}") & given(c)).alias("fields_added"),
        listed(lambda c: changed(c) & given(f"old_{c}") & ~given(c)).alias("fields_removed"),
    )


def study_timeline(studies: DataFrame, datasets: DataFrame, versions: DataFrame, prints: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """Dated events of each study; undated ones are left out.

    studies (study_id, created_at), datasets (study_id, dataset_name, created_at), versions (version_id, study_id, version_number,
    created_at), prints (version_id), diagnoses (study_id, created_at).
    """
    event = lambda df, label: df.where(F.col("created_at").isNotNull()).select("study_id", label.alias("event"), "created_at")
    number = F.col("version_number").cast("string")
    return union_all(
        [
            event(studies, F.lit("Study Created")),
            event(datasets, F.concat(F.lit("Dataset Registered: "), F.col("dataset_name"))),
            event(versions, F.concat(F.lit("Version Created: V"), number)),
            event(versions.join(prints.select(V), V, "left_semi"), F.concat(F.lit("Fingerprint Generated: V"), number)),
            event(diagnoses, F.lit("Diagnosis Generated")),
        ]
    )


def study_overviews(studies, datasets, versions, configurations, prints, profiles, diagnoses, diffs, contracts, protocols) -> DataFrame:
    """What the newest version of each study lacks, the claims it supports, and warnings about its evidence.

    studies (study_id), datasets (study_id), versions (version_id, study_id, parent_version_id, created_at), configurations
    (version_id, target_column), prints, profiles, diagnoses and diffs (version_id), contracts (version_id, human_decisions),
    protocols (study_id, target_column). The newest version comes from one mergeable aggregate per study.
    """
    newest = versions.groupBy("study_id").agg(F.max_by(F.struct(V, "parent_version_id"), F.struct("created_at", V)).alias("v")).select("study_id", "v.*")
    mark = lambda df, name: df.select(V).distinct().withColumn(name, F.lit(True))
    rows = (
        studies.select("study_id")
        .join(datasets.select("study_id").distinct().withColumn("registered", F.lit(True)), "study_id", "left")
        .join(newest, "study_id", "left")
        .join(configurations.select(V, "target_column"), V, "left")
        .join(protocols.select("study_id", F.col("target_column").alias("goal")), "study_id", "left")
        .join(contracts.select(V, "human_decisions"), V, "left")
    )
    for df, name in ((prints, "printed"), (profiles, "profiled"), (diagnoses, "diagnosed"), (diffs, "compared")):
        rows = rows.join(mark(df, name), V, "left")
    has = lambda c: F.col(c).isNotNull()
    dataset, version, contract = has("registered"), has(V), has("human_decisions")
    blank = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    listed = lambda items: F.array_join(F.array_compact(F.array(*[F.when(test, F.lit(text)) for text, test in items])), "|")
    gaps = [
        ("No Dataset Registered", ~dataset),
        ("No Immutable Version", dataset & ~version),
        ("Target Column Missing", version & blank("target_column") & blank("goal")),
        ("Diagnosis Not Generated", version & ~has("diagnosed")),
        ("Semantic Diff Unavailable", version & ~has("compared") & has("parent_version_id")),
        ("Recreation Bundle Missing", version & ~has("printed")),
        ("Pending Human Decisions", contract & (F.coalesce("human_decisions", F.lit(0)) > 0)),
        ("Variant Planning Not Started", has("diagnosed") & ~contract),
    ]
    claims = [
        ("Dataset Registered", dataset),
        ("Diagnosis Complete", has("diagnosed")),
        ("Dataset Version Verified", has("printed") & version),
        # These two take an experiment or a verified candidate, which no stored evidence replaces.
        ("Reproducibility Proven", F.lit(False)),
        ("Intervention Improves Performance", F.lit(False)),
        ("Experiments Required", contract),
    ]
    warnings = [
        ("Missing fingerprint", version & ~has("printed")),
        ("Missing profile report", version & ~has("profiled")),
        ("Version has no semantic diff because it is baseline", version & ~has("compared")),
        ("Registration completed but no analysis loaded", version & ~has("profiled")),
    ]
    unsupported = [(title, ~test) for title, test in claims]
    return rows.select(
        "study_id", F.col(V).alias("newest_version_id"), listed(gaps).alias("gaps"), listed(claims).alias("supported_claims"), listed(unsupported).alias("unsupported_claims"),
        listed(warnings).alias("integrity_warnings"),
    )
