"""Comparison of dataset versions: schema, rows, missingness, distributions, SCM and DSI.

All functions take a ``pairs`` relation (pair_id, previous_version_id, current_version_id, target_column)
and compare every pair in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewitness.functions.columns import row_key, safe_div
from lakewitness.lookups import (
    DRIFTED_FEATURE_SHIFT,
    DSI_WEIGHTS,
    KEY_NAMES,
    MISSING_LABEL,
    SCHEMA_SEVERITY,
    SCM_WEIGHTS,
    SIGNIFICANT_TRANSITION,
    STORY_TEXT,
)
from lakewitness.operators.value_counts import is_missing, union_all
from lakewitness.session import cut

PAIR_COLUMN = ["pair_id", "column"]
# Pair numbers are previous * PAIR_BASE + current.
PAIR_BASE = 2**32
SIDES = {"previous": "previous_version_id", "current": "current_version_id"}
SUMMARY = ["mean", "median", "std", "min", "max"]


def parent_pairs(versions: DataFrame, configurations: DataFrame) -> DataFrame:
    """Every version that has a parent, compared with it."""
    children = versions.where(F.col("parent_version_id").isNotNull()).select("version_id", "parent_version_id")
    return children.join(configurations, "version_id").select(
        F.col("version_id").alias("pair_id"),
        F.col("parent_version_id").alias("previous_version_id"),
        F.col("version_id").alias("current_version_id"),
        "target_column",
    )


def pair_number(previous: Column, current: Column) -> Column:
    """One number for two version ids of up to 31 bits; larger ones are refused, as two pairs could share a number."""
    fits = (previous >= 0) & (previous < PAIR_BASE // 2) & (current >= 0) & (current < PAIR_BASE)
    return F.when(fits, previous * PAIR_BASE + current).otherwise(F.raise_error(F.lit("version ids must be below 2^31")).cast("long"))


def any_pairs(versions: DataFrame, configurations: DataFrame) -> DataFrame:
    """Every ordered pair of versions of one dataset; the later one's target counts."""
    v = versions.select("dataset_id", "version_id", "version_number")
    earlier = v.select("dataset_id", F.col("version_id").alias("previous_version_id"), F.col("version_number").alias("pn"))
    later = v.select("dataset_id", F.col("version_id").alias("current_version_id"), F.col("version_number").alias("cn"))
    joined = earlier.join(later, "dataset_id").where(F.col("pn") < F.col("cn"))
    targets = configurations.select(F.col("version_id").alias("current_version_id"), "target_column")
    return joined.join(targets, "current_version_id").select(
        pair_number(F.col("previous_version_id"), F.col("current_version_id")).alias("pair_id"),
        "previous_version_id",
        "current_version_id",
        "target_column",
    )


def requested_pairs(requests: DataFrame, versions: DataFrame, configurations: DataFrame) -> DataFrame:
    """The pairs of a table (previous_version_id, current_version_id) that can be compared: two versions of one dataset, in any
    order. Repeated requests are one pair; the current version's target counts."""
    v = versions.select("version_id", "dataset_id")
    side = lambda name: v.select(F.col("version_id").alias(SIDES[name]), F.col("dataset_id").alias(f"{name}_dataset"))
    targets = configurations.select(F.col("version_id").alias(SIDES["current"]), "target_column")
    asked = requests.select(*SIDES.values()).distinct().join(side("previous"), SIDES["previous"]).join(side("current"), SIDES["current"]).join(targets, SIDES["current"])
    return asked.where("previous_dataset = current_dataset").select(
        pair_number(F.col(SIDES["previous"]), F.col(SIDES["current"])).alias("pair_id"), *SIDES.values(), "target_column"
    )


def refused_pairs(requests: DataFrame, versions: DataFrame) -> DataFrame:
    """Requests that name an unknown version, or versions of different datasets, and why."""
    v = versions.select("version_id", "dataset_id")
    side = lambda name: v.select(F.col("version_id").alias(SIDES[name]), F.col("dataset_id").alias(f"{name}_dataset"))
    asked = requests.select(*SIDES.values()).distinct().join(side("previous"), SIDES["previous"], "left").join(side("current"), SIDES["current"], "left")
    old, new = F.col("previous_dataset"), F.col("current_dataset")
    reason = F.when(old.isNull() | new.isNull(), "unknown_version").when(old != new, "different_datasets")
    return asked.select(*SIDES.values(), reason.alias("reason")).where("reason IS NOT NULL")


def paired_columns(pairs: DataFrame, columns: DataFrame) -> DataFrame:
    """Full outer join of both column catalogs on the name."""
    def side(name: str) -> DataFrame:
        keep = ["base_type", "logical_dtype", "is_numeric", "row_count", "missing_count", "missing_ratio", "unique_count", *SUMMARY]
        return pairs.select("pair_id", F.col(SIDES[name]).alias("version_id")).join(columns, "version_id").select(
            "pair_id", "column", *[F.col(c).alias(f"{name}_{c}") for c in keep]
        )

    both = side("previous").join(side("current"), PAIR_COLUMN, "full")
    old, new = F.col("previous_logical_dtype"), F.col("current_logical_dtype")
    return both.join(pairs.select("pair_id", "target_column"), "pair_id").withColumns(
        {
            "status": F.when(old.isNull(), "added").when(new.isNull(), "removed").otherwise("common"),
            "dtype_changed": F.coalesce(old != new, F.lit(False)),
            "is_target": F.coalesce(F.col("column") == F.col("target_column"), F.lit(False)),
            "numeric_pair": F.coalesce(F.col("previous_is_numeric") & F.col("current_is_numeric"), F.lit(False)),
        }
    )


def changed_column_identity(paired: DataFrame) -> DataFrame:
    """Identity of every added or removed column."""
    return paired.where(F.col("status") != "common").select(
        *PAIR_COLUMN,
        "status",
        *[
            F.coalesce(f"current_{c}", f"previous_{c}").alias(c)
            for c in ("logical_dtype", "missing_count", "missing_ratio", "unique_count")
        ],
    )


def schema_events(paired: DataFrame) -> DataFrame:
    """One row per schema change with its severity."""
    who = F.when(F.col("is_target"), "target").otherwise("feature")
    change = (
        F.when(F.col("status") != "common", F.concat_ws("_", who, F.col("status")))
        .when(F.col("dtype_changed"), F.concat_ws("_", who, F.lit("dtype_changed")))
    )
    severity = F.create_map(*[F.lit(x) for item in SCHEMA_SEVERITY.items() for x in item])
    return (
        paired.withColumn("change", change)
        .where(F.col("change").isNotNull())
        .select(*PAIR_COLUMN, "change", severity[F.col("change")].alias("severity"))
    )


def schema_scores(pairs: DataFrame, events: DataFrame) -> DataFrame:
    total = events.groupBy("pair_id").agg(F.sum("severity").alias("raw"))
    return pairs.select("pair_id").join(total, "pair_id", "left").select(
        "pair_id",
        F.round(F.coalesce("raw", F.lit(0.0)), 6).alias("raw_severity"),
        F.least(F.coalesce("raw", F.lit(0.0)), F.lit(1.0)).alias("schema_score"),
    )


def missing_overall(pairs: DataFrame, columns: DataFrame) -> DataFrame:
    """Mean of the column missing ratios on each side."""
    def side(name: str) -> DataFrame:
        exact = safe_div(F.col("missing_count"), F.col("row_count"))
        return pairs.select("pair_id", F.col(SIDES[name]).alias("version_id")).join(columns, "version_id").groupBy("pair_id").agg(
            F.avg(exact).alias(f"{name}_missing"), F.max("row_count").alias(f"{name}_rows"), F.count(F.lit(1)).alias(f"{name}_columns")
        )

    both = pairs.select("pair_id").join(side("previous"), "pair_id", "left").join(side("current"), "pair_id", "left")
    before, after = F.coalesce("previous_missing", F.lit(0.0)), F.coalesce("current_missing", F.lit(0.0))
    return both.select(
        "pair_id",
        F.coalesce("previous_rows", F.lit(0)).alias("row_count_previous"),
        F.coalesce("current_rows", F.lit(0)).alias("row_count_current"),
        (F.coalesce("current_columns", F.lit(0)) - F.coalesce("previous_columns", F.lit(0))).alias("column_count_change"),
        F.round(before, 6).alias("missing_ratio_previous"),
        F.round(after, 6).alias("missing_ratio_current"),
        F.round(after - before, 6).alias("missing_ratio_change"),
    )


def _ratio(side: str) -> Column:
    return safe_div(F.col(f"{side}_missing_count"), F.col(f"{side}_row_count"))


def missingness_changes(paired: DataFrame) -> DataFrame:
    """E5: common columns whose missing count or ratio moved."""
    delta = _ratio("current") - _ratio("previous")
    moved = (F.col("previous_missing_count") != F.col("current_missing_count")) | (F.abs(delta) > 1e-8)
    return paired.where((F.col("status") == "common") & moved).select(
        *PAIR_COLUMN,
        "is_target",
        F.col("previous_missing_count").alias("previous_count"),
        F.col("current_missing_count").alias("current_count"),
        (F.col("current_missing_count") - F.col("previous_missing_count")).alias("count_delta"),
        F.round(_ratio("previous"), 6).alias("previous_ratio"),
        F.round(_ratio("current"), 6).alias("current_ratio"),
        F.round(delta, 6).alias("ratio_delta"),
    )


def missingness_scores(paired: DataFrame) -> DataFrame:
    delta = F.abs(_ratio("current") - _ratio("previous"))
    return paired.where(F.col("status") == "common").groupBy("pair_id").agg(
        F.least(F.lit(1.0), 0.65 * F.avg(delta) + 0.35 * F.max(delta)).alias("missingness_score")
    )


def duplicate_changes(pairs: DataFrame, tables: DataFrame) -> DataFrame:
    """Duplicate rows on both sides."""
    d = tables.select("version_id", "duplicate_rows")
    return (
        pairs.join(d.select(F.col("version_id").alias("previous_version_id"), F.col("duplicate_rows").alias("duplicates_previous")), "previous_version_id")
        .join(d.select(F.col("version_id").alias("current_version_id"), F.col("duplicate_rows").alias("duplicates_current")), "current_version_id")
        .select("pair_id", "duplicates_previous", "duplicates_current", (F.col("duplicates_current") - F.col("duplicates_previous")).alias("duplicates_delta"))
    )


def stable_keys(paired: DataFrame) -> DataFrame:
    """Up to two id-like columns that are filled and unique on both sides."""
    name = F.lower("column")
    named = name.isin(*KEY_NAMES) | name.endswith("id") | name.contains("uuid") | name.contains("guid")
    whole = [
        (F.col(f"{s}_missing_count") == 0) & (F.col(f"{s}_unique_count") == F.col(f"{s}_row_count")) for s in SIDES
    ]
    rank = F.row_number().over(Window.partitionBy("pair_id").orderBy("column"))
    return (
        paired.where((F.col("status") == "common") & named & whole[0] & whole[1])
        .withColumn("rank", rank)
        .where(F.col("rank") <= 2)
        .select("pair_id", "rank", "column")
    )


ROW_DIFF = [
    "pair_id", "method", "key_columns", "rows_added", "rows_removed", "rows_modified", "rows_unchanged",
    "change_ratio", "turnover_ratio",
]


def row_diffs(versions: dict[int, DataFrame], pairs: DataFrame, keys: DataFrame) -> DataFrame | None:
    """E8 or E9 of every pair: rows matched on the pair's stable key, or else compared as multisets.

    What rows are reduced to follows from the columns both sides have and from the key, so pairs of one shape share it: a version
    is read and digested once for each shape it takes part in, whatever the number of pairs. The digests are handed out to
    the pairs and their sides in one join and meet in one grouped shuffle. To the driver come the shapes and the versions in
    each, never the pairs.
    """
    spark = pairs.sparkSession
    names = {v: tuple(sorted(df.columns)) for v, df in versions.items()}
    kinds = sorted(set(names.values()))
    kind = spark.createDataFrame([(v, kinds.index(n)) for v, n in names.items()], "version_id long, kind int")
    side = lambda name: kind.select(F.col("version_id").alias(SIDES[name]), F.col("kind").alias(f"{name}_kind"))
    listed = keys.groupBy("pair_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "column"))), lambda x: x["column"]), ",").alias("key_columns"))
    shaped = pairs.select("pair_id", *SIDES.values()).join(side("previous"), SIDES["previous"]).join(side("current"), SIDES["current"]).join(listed, "pair_id", "left")
    low, high = F.least("previous_kind", "current_kind"), F.greatest("previous_kind", "current_kind")
    shaped = cut(shaped.select("pair_id", *SIDES.values(), low.alias("low"), high.alias("high"), F.coalesce("key_columns", F.lit("")).alias("key_columns")))
    shape = ["low", "high", "key_columns"]
    used = shaped.select(*shape, F.explode(F.array(*SIDES.values())).alias("version_id")).distinct().orderBy(*shape, "version_id").collect()
    keyed, plain = [], []
    for r in used:
        common = sorted(set(kinds[r["low"]]) & set(kinds[r["high"]]))
        if not common:
            continue
        df, by = versions[r["version_id"]], [c for c in r["key_columns"].split(",") if c]
        here = [F.lit(r[c]).alias(c) for c in (*shape, "version_id")]
        if by:
            keyed.append(df.select(*here, row_key(df, by).alias("key"), row_key(df, common, exact=by).alias("row")))
        else:
            plain.append(df.select(*here, row_key(df, common, exact=[]).alias("row")))

    # Every pair a version takes part in, on one side or on both: a row is read and digested once, whatever its sides.
    sides = shaped.select(
        "pair_id", *shape, F.explode(F.array(*[F.struct(F.col(c).alias("version_id"), F.lit(name == "previous").alias("before")) for name, c in SIDES.items()])).alias("s")
    ).select("pair_id", *shape, "s.*")
    handed = lambda rows: union_all(rows).join(sides, [*shape, "version_id"])
    before = F.col("before")
    parts = []
    if keyed:
        both = handed(keyed).select("pair_id", "key", F.when(before, F.col("row")).alias("old"), F.when(~before, F.col("row")).alias("new"))
        matched = both.groupBy("pair_id", "key").agg(F.max("old").alias("old"), F.max("new").alias("new"))
        old, new = F.col("old"), F.col("new")
        parts.append(
            matched.groupBy("pair_id").agg(
                F.count_if(old.isNull()).alias("rows_added"),
                F.count_if(new.isNull()).alias("rows_removed"),
                F.count_if(old != new).alias("rows_modified"),
                F.count_if(old == new).alias("rows_unchanged"),
                F.count(F.lit(1)).alias("denominator"),
                (F.count("old") + F.count("new")).alias("sides"),
            )
        )
    if plain:
        # Equal rows collapse to one counter in each task before the one shuffle.
        zero = F.lit(0).cast("long")
        met = handed(plain).groupBy("pair_id", "row").agg(F.count_if(before).alias("old"), F.count_if(~before).alias("new"))
        old, new = F.col("old"), F.col("new")
        parts.append(
            met.groupBy("pair_id").agg(
                F.sum(F.greatest(new - old, zero)).alias("rows_added"),
                F.sum(F.greatest(old - new, zero)).alias("rows_removed"),
                zero.alias("rows_modified"),
                F.sum(F.least(old, new)).alias("rows_unchanged"),
                F.sum(old + new).alias("denominator"),
                F.sum(old + new).alias("sides"),
            )
        )
    if not parts:
        return None
    figures = union_all(parts)
    alike = F.lit(False)
    for r in {(r["low"], r["high"]) for r in used if set(kinds[r["low"]]) & set(kinds[r["high"]])}:
        alike = alike | ((F.col("low") == r[0]) & (F.col("high") == r[1]))
    full = shaped.where(alike).join(figures, "pair_id", "left").fillna(0, [c for c in figures.columns if c != "pair_id"])
    turned = F.col("rows_added") + F.col("rows_removed")
    return full.select(
        "pair_id",
        F.when(F.col("key_columns") != "", "stable_identifier_hash").otherwise("row_hash_multiset").alias("method"),
        "key_columns",
        *[F.col(c).cast("long").alias(c) for c in ("rows_added", "rows_removed", "rows_modified", "rows_unchanged")],
        F.round((turned + F.col("rows_modified")) / F.greatest("denominator", F.lit(1)), 6).alias("change_ratio"),
        F.round(turned / F.greatest("sides", F.lit(1)), 6).alias("turnover_ratio"),
    )


def _one_pair(pair_id: int, previous: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    spark = previous.sparkSession
    pair = spark.createDataFrame([(pair_id, 0, 1)], "pair_id long, previous_version_id long, current_version_id long")
    named = spark.createDataFrame([(pair_id, i, k) for i, k in enumerate(keys)], "pair_id long, rank int, column string")
    return row_diffs({0: previous, 1: current}, pair, named)


def keyed_row_diff(pair_id: int, previous: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """E8 of two tables."""
    return _one_pair(pair_id, previous, current, keys)


def multiset_row_diff(pair_id: int, previous: DataFrame, current: DataFrame) -> DataFrame:
    """E9 of two tables."""
    return _one_pair(pair_id, previous, current, [])


def paired_counts(pairs: DataFrame, vc: DataFrame) -> DataFrame:
    """Value counts of both sides of every pair, one row per value; the input of E12 and E14-E18."""
    def side(name: str, old: int) -> DataFrame:
        ids = pairs.select("pair_id", F.col(SIDES[name]).alias("version_id"))
        return vc.join(ids, "version_id").select(
            "pair_id", "column", "value", "num", (F.col("cnt") * old).alias("old"), (F.col("cnt") * (1 - old)).alias("new")
        )

    return side("previous", 1).unionByName(side("current", 0)).groupBy("pair_id", "column", "value", "num").agg(
        F.sum("old").alias("old"), F.sum("new").alias("new")
    )


def numeric_summary(paired: DataFrame) -> DataFrame:
    """Summary of both sides and the movement of each figure."""
    r = lambda c: F.round(c, 6)
    zero = F.lit(0.0)

    def moved(m: str) -> Column:
        # Sums over the same values in another order differ in the last bits; that is no movement.
        old, new = F.coalesce(F.col(f"previous_{m}"), zero), F.coalesce(F.col(f"current_{m}"), zero)
        noise = F.abs(new - old) <= 1e-12 * F.greatest(F.abs(old), F.abs(new))
        return F.when(noise, 0.0).otherwise(r(r(new) - r(old)))

    return paired.where((F.col("status") == "common") & F.col("numeric_pair")).select(
        *PAIR_COLUMN,
        "is_target",
        *[r(F.col(f"{s}_{m}")).alias(f"{s}_{m}") for s in SIDES for m in SUMMARY],
        *[moved(m).alias(f"delta_{m}") for m in SUMMARY],
    )


def numeric_shifts(paired: DataFrame, counts: DataFrame) -> DataFrame:
    """Wasserstein distance between both sides over the combined spread, at most 1.

    Values are put in order over all tasks by range; what lies before a range comes from one row of totals for each range
    and column, so neither a column nor its values meet in one task, and values are joined with nothing but these rows.
    """
    both_numeric = paired.where((F.col("status") == "common") & F.col("numeric_pair"))
    wanted = both_numeric.select(*PAIR_COLUMN, "is_target")
    # Whole numbers beyond the range of doubles may share a value; a gap of zero adds nothing.
    values = counts.where(F.col("num").isNotNull()).join(F.broadcast(wanted.select(*PAIR_COLUMN)), PAIR_COLUMN)
    values = values.select(*PAIR_COLUMN, "num", "old", "new", (F.col("old") + F.col("new")).alias("both"))
    # A row per column and pair is broadcast above, a row per column and range below: both follow the schemas, not the data.
    ranged = cut(values.repartitionByRange(*PAIR_COLUMN, "num").withColumn("range", F.spark_partition_id()))
    totals = ranged.groupBy(*PAIR_COLUMN, "range").agg(
        *[F.sum(c).alias(f"{c}_here") for c in ("old", "new", "both")],
        F.min("num").alias("first"), F.max("num").alias("last"), F.sum(F.col("num") * F.col("both")).alias("total"),
    )
    order = Window.partitionBy(*PAIR_COLUMN).orderBy("range")
    before = lambda c: F.coalesce(F.sum(f"{c}_here").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = Window.partitionBy(*PAIR_COLUMN)
    offsets = totals.select(
        *PAIR_COLUMN, "range", *[before(c).alias(f"{c}_before") for c in ("old", "new", "both")], F.lead("first").over(order).alias("next_first"),
        *[F.sum(f"{c}_here").over(whole).alias(n) for c, n in (("old", "n_old"), ("new", "n_new"), ("both", "n"))],
        F.min("first").over(whole).alias("low"), F.max("last").over(whole).alias("high"),
        (F.sum("total").over(whole) / F.sum("both_here").over(whole)).alias("mean"),
    )
    inside = Window.partitionBy(*PAIR_COLUMN, "range").orderBy("num")
    upto = lambda c: F.col(f"{c}_before") + F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    walk = ranged.join(F.broadcast(cut(offsets)), [*PAIR_COLUMN, "range"]).select(
        *PAIR_COLUMN, "num", "both", "n_old", "n_new", "n", "low", "high", "mean", *[upto(c).alias(f"{c}_upto") for c in ("old", "new", "both")],
        F.coalesce(F.lead("num").over(inside), F.col("next_first")).alias("next_value"),
    )
    gap = F.abs(F.col("old_upto") / F.col("n_old") - F.col("new_upto") / F.col("n_new")) * (F.col("next_value") - F.col("num"))
    deviation = F.col("num") - F.col("mean")
    place = lambda p: F.lit(p) * (F.col("n") - 1)
    holds = lambda at: (at < F.col("both_upto")) & (at >= F.col("both_upto") - F.col("both"))
    figures = ["n_old", "n_new", "n", "low", "high"]
    sums = walk.groupBy(*PAIR_COLUMN, *figures).agg(
        F.coalesce(F.sum(gap), F.lit(0.0)).alias("distance"), F.sum(deviation * deviation * F.col("both")).alias("m2"),
        *[F.max(F.when(holds(end(place(p))), F.col("num"))).alias(f"{name}{i}") for i, p in enumerate((0.25, 0.75)) for name, end in (("floor", F.floor), ("ceil", F.ceil))],
    )
    quartile = lambda i, p: F.col(f"floor{i}") + (F.col(f"ceil{i}") - F.col(f"floor{i}")) * (place(p) - F.floor(place(p)))
    iqr = quartile(1, 0.75) - quartile(0, 0.25)
    std = F.when((F.col("n") > 1) & (F.col("low") < F.col("high")), F.sqrt(F.col("m2") / (F.col("n") - 1))).otherwise(0.0)
    scale = F.when(iqr > 1e-12, iqr).when(std > 1e-12, std).otherwise(F.greatest(F.col("high") - F.col("low"), F.lit(1.0)))
    shift = F.when((F.col("n_old") == 0) | (F.col("n_new") == 0), 0.0).otherwise(
        F.least(F.lit(1.0), F.col("distance") / F.greatest(scale, F.lit(1e-9)))
    )
    found = sums.select(*PAIR_COLUMN, shift.alias("shift"))
    return wanted.join(found, PAIR_COLUMN, "left").select(
        *PAIR_COLUMN, "is_target", F.coalesce("shift", F.lit(0.0)).alias("shift")
    )


def change_level(score: Column) -> Column:
    """E13."""
    return F.when(score < 1, "negligible").when(score < 10, "minor").when(score < 30, "moderate").otherwise("major")


def category_changes(paired: DataFrame, counts: DataFrame) -> DataFrame:
    """Label distribution on both sides, missing cells counted as a label of their own."""
    wanted = paired.where((F.col("status") == "common") & (~F.col("numeric_pair") | F.col("is_target"))).select(
        *PAIR_COLUMN, "is_target", "numeric_pair", "previous_logical_dtype", "current_logical_dtype",
        "previous_row_count", "current_row_count",
    )

    def number(side: str) -> Column:
        whole = F.col(f"{side}_logical_dtype") == "int64"
        return F.when(whole, F.col("num").cast("long").cast("string")).otherwise(F.col("num").cast("string"))

    # A whole number prints differently once its column holds missing values, so each side keeps its own text.
    rows = counts.join(wanted, PAIR_COLUMN).select(
        *wanted.columns,
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.when(is_missing(), F.lit(MISSING_LABEL)).otherwise(F.coalesce(F.col("value"), number(side))).alias("label"),
                        (F.col("old") if side == "previous" else F.lit(0)).alias("old"),
                        (F.col("new") if side == "current" else F.lit(0)).alias("new"),
                    )
                    for side in SIDES
                ]
            )
        ).alias("s"),
    ).select(*wanted.columns, "s.*").where((F.col("old") > 0) | (F.col("new") > 0))
    merged = rows.groupBy(*PAIR_COLUMN, "label").agg(
        F.sum("old").alias("previous_count"),
        F.sum("new").alias("current_count"),
        *[F.first(c).alias(c) for c in ("is_target", "numeric_pair", "previous_row_count", "current_row_count")],
    )
    before = safe_div(F.col("previous_count"), F.col("previous_row_count"))
    after = safe_div(F.col("current_count"), F.col("current_row_count"))
    return merged.select(
        *PAIR_COLUMN,
        "label",
        "is_target",
        "numeric_pair",
        "previous_count",
        "current_count",
        (F.col("current_count") - F.col("previous_count")).alias("count_delta"),
        F.round(before, 6).alias("previous_ratio"),
        F.round(after, 6).alias("current_ratio"),
        F.round(after - before, 6).alias("ratio_delta"),
    )


def category_shifts(changes: DataFrame) -> DataFrame:
    """Jensen-Shannon distance and the number of labels that came or went."""
    p, c = F.col("previous_ratio"), F.col("current_ratio")
    middle = F.greatest((p + c) / 2, F.lit(1e-12))
    part = lambda x: F.when(x > 0, x * F.log2(x / middle)).otherwise(0.0)
    return changes.groupBy(*PAIR_COLUMN, "is_target", "numeric_pair").agg(
        F.least(F.lit(1.0), F.sqrt(F.greatest(F.sum(0.5 * part(p) + 0.5 * part(c)), F.lit(0.0)))).alias("distance"),
        F.count_if((F.col("previous_count") == 0) & (F.col("current_count") > 0)).alias("added_labels"),
        F.count_if((F.col("previous_count") > 0) & (F.col("current_count") == 0)).alias("removed_labels"),
        F.count(F.lit(1)).alias("labels"),
    )


def changed_labels(changes: DataFrame) -> DataFrame:
    """One row per label that exists on one side only."""
    return changes.where(~F.col("numeric_pair")).select(
        *PAIR_COLUMN,
        "label",
        F.when((F.col("previous_count") == 0) & (F.col("current_count") > 0), "added")
        .when((F.col("previous_count") > 0) & (F.col("current_count") == 0), "removed")
        .alias("change"),
    ).where(F.col("change").isNotNull())


def top_category_changes(changes: DataFrame) -> DataFrame:
    """The 10 labels (20 for the target) that moved most; ties by label."""
    order = Window.partitionBy(*PAIR_COLUMN).orderBy(F.abs("ratio_delta").desc(), F.col("label"))
    return (
        changes.where(~F.col("numeric_pair"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= F.when(F.col("is_target"), 20).otherwise(10))
        .select(*PAIR_COLUMN, "rank", "label", "previous_count", "current_count", "ratio_delta")
    )


def shifts(numeric: DataFrame, categories: DataFrame) -> DataFrame:
    """One shift score per common column, numeric and categorical (target included)."""
    n = numeric.select(*PAIR_COLUMN, "is_target", F.lit("numeric").alias("kind"), F.col("shift"))
    c = categories.where(~F.col("numeric_pair")).select(
        *PAIR_COLUMN, "is_target", F.lit("categorical").alias("kind"), F.col("distance").alias("shift")
    )
    return n.unionByName(c).withColumn("shift_score", F.round(F.col("shift") * 100, 3))


def target_shift(all_shifts: DataFrame) -> DataFrame:
    """How far the target moved, and in which mode it was compared."""
    return all_shifts.where("is_target").select(
        "pair_id",
        "column",
        F.when(F.col("kind") == "numeric", "continuous").otherwise("categorical").alias("mode"),
        "shift_score",
    )


def top_shifted(all_shifts: DataFrame, limit: int = 10) -> DataFrame:
    """Features that moved most."""
    order = Window.partitionBy("pair_id").orderBy(F.col("shift_score").desc(), F.col("column"))
    return (
        all_shifts.where(~F.col("is_target"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= limit)
        .select("pair_id", "rank", "column", "kind", "shift_score")
    )


def structure_scores(categories: DataFrame) -> DataFrame:
    """Mean structural movement of label columns and of the target."""
    changed = (F.col("added_labels") + F.col("removed_labels")) / F.greatest(F.col("labels"), F.lit(1))
    score = F.least(F.lit(1.0), 0.6 * F.col("distance") + 0.4 * changed)
    return categories.groupBy("pair_id").agg(F.avg(score).alias("structure_score"))


def dsi_components(pairs: DataFrame, all_shifts: DataFrame) -> DataFrame:
    """Drift score over the features; the target is left out."""
    # shift scores have three decimals: in whole thousandths, sums don't depend on their order and ties round one way
    s = F.round(F.col("shift_score") * 1000).cast("long")
    parts = all_shifts.where(~F.col("is_target")).groupBy("pair_id").agg(
        F.sum(s).alias("total"), F.max(s).alias("most"), F.count_if(s >= DRIFTED_FEATURE_SHIFT * 1000).alias("drifted"), F.count(s).alias("n")
    )
    filled = pairs.select("pair_id").join(parts, "pair_id", "left").fillna(0, ["total", "most", "drifted"]).fillna(1, ["n"])
    hundredths = {k: round(w * 100) for k, w in DSI_WEIGHTS.items()}
    top = hundredths["mean_feature_shift"] * F.col("total") + F.col("n") * hundredths["max_feature_shift"] * F.col("most") + hundredths["drifted_feature_ratio"] * 100_000 * F.col("drifted")
    thousandths = F.expr("(2 * top + 100 * n) div (200 * n)")
    return filled.withColumn("top", top).select(
        "pair_id",
        (F.col("total") / (F.col("n") * 100_000)).alias("mean_feature_shift"),
        (F.col("most") / 100_000).alias("max_feature_shift"),
        (F.col("drifted") / F.col("n")).alias("drifted_feature_ratio"),
        (F.least(F.greatest(thousandths, F.lit(0)), F.lit(100_000)) / 1000).alias("dsi_score"),
    )


def diff_scores(pairs: DataFrame, schema: DataFrame, rows: DataFrame | None, missing: DataFrame, structure: DataFrame, dsi: DataFrame) -> DataFrame:
    """Change score from four components, next to the drift score."""
    base = pairs.select("pair_id", *SIDES.values()).join(schema.select("pair_id", "schema_score"), "pair_id")
    if rows is None:
        base = base.withColumn("change_ratio", F.lit(0.0))
    else:
        base = base.join(rows.select("pair_id", "change_ratio"), "pair_id", "left")
    base = (
        base.join(missing, "pair_id", "left")
        .join(structure, "pair_id", "left")
        .fillna(0.0, ["change_ratio", "missingness_score", "structure_score"])
        .join(dsi, "pair_id")
    )
    parts = {"schema": "schema_score", "rows": "change_ratio", "missingness": "missingness_score", "categorical_structure": "structure_score"}
    total = sum((F.col(c) * SCM_WEIGHTS[k] for k, c in parts.items()), F.lit(0.0))
    return base.select(
        "pair_id",
        *SIDES.values(),
        *[F.round(F.col(c) * 100, 3).alias(f"scm_{k}") for k, c in parts.items()],
        *[F.round(F.col(k) * 100, 3).alias(f"dsi_{k}") for k in DSI_WEIGHTS],
        F.round(F.least(F.greatest(100 * total, F.lit(0.0)), F.lit(100.0)), 3).alias("scm_score"),
        "dsi_score",
    )


def compact_numeric_changes(summary: DataFrame, all_shifts: DataFrame) -> DataFrame:
    """Numeric columns with a visible shift or a moved figure."""
    moved = [F.abs(F.col(f"delta_{m}")) > 1e-6 for m in SUMMARY]
    keep = F.col("shift_score") > 0.001
    for m in moved:
        keep = keep | m
    numeric = all_shifts.where(F.col("kind") == "numeric").select(*PAIR_COLUMN, "shift_score")
    return summary.join(numeric, PAIR_COLUMN).where(keep).select(
        *PAIR_COLUMN, "shift_score", *[f"delta_{m}" for m in SUMMARY]
    )


def transition_facts(pairs: DataFrame, paired: DataFrame, overall: DataFrame, duplicates: DataFrame, all_shifts: DataFrame) -> DataFrame:
    """Counts per pair that the labels and stories below read."""
    cols = paired.groupBy("pair_id").agg(
        F.count_if(F.col("status") == "added").alias("columns_added"),
        F.count_if(F.col("status") == "removed").alias("columns_removed"),
        F.count_if(F.col("dtype_changed")).alias("dtype_changes"),
    )
    missing = missingness_changes(paired).groupBy("pair_id").agg(F.count(F.lit(1)).alias("missing_changes"))
    moved = all_shifts.groupBy("pair_id").agg(
        F.count_if(F.col("kind") == "numeric").alias("numeric_changes"),
        F.count_if((F.col("kind") == "categorical") & (F.col("shift_score") > 0)).alias("category_changes"),
    )
    return (
        pairs.join(cols, "pair_id", "left").join(missing, "pair_id", "left").join(moved, "pair_id", "left")
        .join(overall, "pair_id").join(duplicates, "pair_id", "left")
        .fillna(0, ["columns_added", "columns_removed", "dtype_changes", "missing_changes", "numeric_changes", "category_changes", "duplicates_delta"])
        .withColumn("row_count_change", F.col("row_count_current") - F.col("row_count_previous"))
    )


def transition_labels(versions: DataFrame, facts: DataFrame) -> DataFrame:
    """Short name of what a version changed."""
    f = facts.select(
        F.col("current_version_id").alias("version_id"), "columns_added", "columns_removed", "dtype_changes",
        "row_count_change", "missing_ratio_change",
    )
    a, r, t = F.col("columns_added") > 0, F.col("columns_removed") > 0, F.col("dtype_changes") > 0
    label = (
        F.when(F.col("parent_version_id").isNull(), "Initial registration")
        .when(a & ~r & ~t, "Schema expansion")
        .when(r & ~a, "Schema reduction")
        .when(a | r | t, "Mixed structural update")
        .when(F.col("row_count_change") != 0, "Row update")
        .when(F.col("missing_ratio_change") != 0, "Metadata-quality update")
        .otherwise("Minimal measurable change")
    )
    return versions.join(f, "version_id", "left").select("version_id", label.alias("transition"))


def inferred_transformations(versions: DataFrame, facts: DataFrame) -> DataFrame:
    """Transformations suggested by the notes, the method and the comparison."""
    f = facts.select(
        F.col("current_version_id").alias("version_id"), "columns_added", "columns_removed", "missing_changes", "duplicates_delta"
    )
    method = F.lower(F.coalesce("generation_method", F.lit("")))
    text = F.concat_ws(" ", method, F.lower(F.coalesce("version_notes", F.lit(""))))
    labels = F.array_compact(
        F.array(
            F.when((method != "") & (method != "manual"), F.replace(method, F.lit("_"), F.lit(" "))),
            F.when(text.contains("duplicate") | (F.col("duplicates_delta") < 0), F.lit("Duplicate Removal")),
            F.when(text.rlike("missing|imput") | (F.col("missing_changes") > 0), F.lit("Missing Value Handling")),
            F.when(F.col("columns_removed") > 0, F.lit("Feature Reduction")),
            F.when(F.col("columns_added") > 0, F.lit("Feature Addition")),
        )
    )
    return versions.join(f, "version_id", "left").select(
        "version_id", F.concat_ws("|", F.array_distinct(labels)).alias("transformations")
    )


def significant_transitions(scores: DataFrame) -> DataFrame:
    """E28."""
    return scores.where(
        (F.col("scm_score") >= SIGNIFICANT_TRANSITION) | (F.col("dsi_score") >= SIGNIFICANT_TRANSITION)
    ).select("pair_id", "scm_score", "dsi_score")


def change_stories(facts: DataFrame) -> DataFrame:
    """The counts of a transition as one line, and what they imply."""
    c = F.col
    signed = F.concat(F.when(c("row_count_change") > 0, "+").otherwise(""), c("row_count_change").cast("string"))
    count = lambda name, text: F.when(c(name) > 0, F.concat_ws(" ", c(name).cast("string"), F.lit(text)))
    parts = F.concat_ws(
        ", ",
        F.when(c("row_count_change") != 0, F.concat_ws(" ", signed, F.lit("net rows"))),
        count("columns_added", "columns added"),
        count("columns_removed", "columns removed"),
        count("missing_changes", "missingness changes"),
        count("numeric_changes", "numeric shifts"),
    )
    schema = (c("columns_added") > 0) | (c("columns_removed") > 0) | (c("dtype_changes") > 0)
    implication = (
        F.when(schema, STORY_TEXT["schema"])
        .when((c("numeric_changes") > 0) | (c("category_changes") > 0), STORY_TEXT["distribution"])
        .when(c("missing_changes") > 0, STORY_TEXT["missingness"])
        .otherwise(STORY_TEXT["none"])
    )
    return facts.select(
        "pair_id",
        F.when(parts == "", STORY_TEXT["quiet"]).otherwise(parts).alias("story"),
        implication.alias("implication"),
    )


def before_after(versions: DataFrame, tables: DataFrame, risks: DataFrame) -> DataFrame:
    """Six figures of every child next to its parent, with direction and meaning."""
    facts = tables.join(risks.select("version_id", "mlrs_score", "lrs_score"), "version_id", "left").select(
        "version_id",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(i).alias("ord"), F.lit(label).alias("metric"), F.lit(mode).alias("mode"), F.col(c).cast("double").alias("figure"))
                    for i, (label, c, mode) in enumerate(
                        [
                            ("Rows", "row_count", "neutral"),
                            ("Columns/features", "column_count", "neutral"),
                            ("Missing cells", "missing_cells", "lower"),
                            ("Duplicates", "duplicate_rows", "lower"),
                            ("MLRS", "mlrs_score", "lower"),
                            ("LRS", "lrs_score", "lower"),
                        ]
                    )
                ]
            )
        ).alias("m"),
    ).select("version_id", "m.*")
    children = versions.where(F.col("parent_version_id").isNotNull()).select("version_id", "parent_version_id")
    before = facts.select(F.col("version_id").alias("parent_version_id"), "metric", F.col("figure").alias("before"))
    delta = F.round(F.col("figure") - F.col("before"), 6)
    direction = F.when(delta > 0, "up").when(delta < 0, "down").otherwise("flat")
    meaning = (
        F.when(F.col("direction") == "flat", "Stable")
        .when(F.col("mode") == "neutral", "Changed")
        .when(F.col("direction") == "down", "Improved")
        .otherwise("Increased risk")
    )
    return (
        children.join(facts, "version_id").join(before, ["parent_version_id", "metric"])
        .withColumn("direction", direction)
        .select("version_id", "metric", "before", F.col("figure").alias("after"), delta.alias("delta"), "direction", meaning.alias("meaning"))
    )


def reconstructed_quality(pairs: DataFrame, overall: DataFrame, duplicates: DataFrame, versions: DataFrame, tables: DataFrame) -> DataFrame:
    """Missing cells and duplicates of both sides, taken from the comparison where no profile exists."""
    parts = []
    for side, key in SIDES.items():
        shape = versions.select(F.col("version_id").alias(key), F.col("column_count").alias("width"))
        known = tables.select(F.col("version_id").alias(key), "missing_cells", "duplicate_rows")
        rebuilt = F.round(F.col(f"missing_ratio_{side}") * F.col(f"row_count_{side}") * F.col("width")).cast("long")
        parts.append(
            pairs.join(overall, "pair_id").join(duplicates, "pair_id", "left").join(shape, key).join(known, key, "left").select(
                "pair_id",
                F.lit(side).alias("side"),
                F.coalesce("missing_cells", rebuilt).alias("missing_cells"),
                F.coalesce("duplicate_rows", f"duplicates_{side}").alias("duplicate_rows"),
            )
        )
    return union_all(parts)
