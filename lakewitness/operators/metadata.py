"""Registration metadata, schema inventory, configuration checks and notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakewitness import lookups as L

V = "version_id"


def _ordered(value: str, alias: str):
    pairs = F.array_sort(F.collect_list(F.struct("position", F.col(value).cast("string").alias("x"))))  # one per column
    return F.array_join(F.transform(pairs, lambda p: p["x"]), ",").alias(alias)


def table_metadata(columns: DataFrame, tables: DataFrame) -> DataFrame:
    """B1: shape, names, types and missing counts in column order, and duplicates."""
    lists = columns.groupBy(V).agg(_ordered("column", "column_names"), _ordered("logical_dtype", "data_types"), _ordered("missing_count", "missing_values"))
    return tables.join(lists, V).select(
        V, "row_count", "column_count", "column_names", "data_types", "missing_values",
        F.col("missing_cells").alias("missing_total"), F.col("duplicate_rows").alias("duplicate_count"),
    )


def column_inventory(columns: DataFrame) -> DataFrame:
    """B2."""
    return columns.select(V, "position", "column", "logical_dtype", "missing_count", "missing_ratio")


def suspicious(column):
    return column.rlike(L.SUSPICIOUS_NAME)


def schema_intelligence(columns: DataFrame, search: str | None = None, kind: str = "all", issues_only: bool = False) -> DataFrame:
    """Searchable, paged view of the columns."""
    issue = (F.col("missing_count") > 0) | suspicious(F.col("column"))
    rows = columns.select(
        V,
        "position",
        "column",
        F.when(F.col("logical_dtype").rlike(L.NUMERIC_TYPE), "numeric").otherwise("categorical").alias("kind"),
        "role",
        "missing_count",
        issue.alias("issue"),
    )
    if search:
        rows = rows.where(F.lower("column").contains(search.lower()))
    if kind != "all":
        rows = rows.where(F.col("kind") == kind)
    if issues_only:
        rows = rows.where("issue")
    place = F.row_number().over(Window.partitionBy(V).orderBy("position")) - 1
    return rows.withColumn("page", F.floor(place / L.PAGE_SIZE).cast("int"))


def evidence_quality(columns: DataFrame, tables: DataFrame) -> DataFrame:
    """B4."""
    odd = suspicious(F.col("column"))
    names = lambda test: F.concat_ws(",", F.array_sort(F.collect_set(F.when(test, F.col("column")))))
    sums = columns.groupBy(V).agg(
        F.count_if(F.col("logical_dtype").rlike(L.NUMERIC_TYPE)).alias("numeric_count"),
        F.count_if(~F.col("logical_dtype").rlike(L.NUMERIC_TYPE)).alias("categorical_count"),
        names(odd).alias("suspicious_columns"),
        names(odd | (F.col("missing_count") > 0)).alias("issue_columns"),
    )
    return tables.select(V, "missing_cells", "duplicate_rows").join(sums, V)


def validate_configurations(configurations: DataFrame, columns: DataFrame) -> DataFrame:
    """One row per broken rule. ``configurations`` carries a ``config_id``."""
    names = columns.groupBy(V).agg(F.collect_set("column").alias("names"))  # as many as a version has columns
    task = F.col("task_type")
    supervised = task.isin(*L.METRICS)
    metrics = F.create_map(*[x for t, ms in L.METRICS.items() for x in (F.lit(t), F.array(*[F.lit(m) for m in ms]))])
    extra = F.size(F.array_except(F.coalesce("selected_features", F.array().cast("array<string>")), F.col("names"))) > 0
    broken = F.array_compact(
        F.array(
            F.when(supervised & ~F.coalesce(F.array_contains("names", F.col("target_column")), F.lit(False)), F.lit("target_not_in_columns")),
            F.when(supervised & ~F.array_contains(metrics[task], F.col("primary_metric")), F.lit("metric_not_allowed")),
            F.when(supervised & ~F.col("validation_strategy").isin(*L.VALIDATIONS), F.lit("validation_not_allowed")),
            F.when(~supervised & ~F.col("scaling_strategy").isin(*L.SCALINGS), F.lit("scaling_not_allowed")),
            F.when(~supervised & extra, F.lit("selected_feature_not_in_columns")),
        )
    )
    return configurations.join(names, V).select("config_id", V, F.explode(broken).alias("violation"))


def parse_notes(notes: DataFrame, key: str, text: str) -> DataFrame:
    """``label: value`` lines; lines without a label continue the one before.

    Notes are short texts, so the lines of one note are grouped by an array fold inside the row; no
    shuffle is needed.
    """
    lines = F.filter(F.transform(F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    pattern = r"^([^:]{2,60}):\s*(.*)$"
    entry = "struct<label:string,value:string>"

    def step(done, line):
        # A label is the part before the first colon, 2 to 60 characters long.
        labelled = F.struct(F.trim(F.regexp_extract(line, pattern, 1)).alias("label"), F.trim(F.regexp_extract(line, pattern, 2)).alias("value"))
        last = F.try_element_at(done, F.lit(-1))
        longer = F.struct(last["label"].alias("label"), F.trim(F.concat_ws(" ", last["value"], line)).alias("value"))
        first = F.struct(F.lit("Version notes").alias("label"), line.alias("value"))
        return (
            F.when(line.rlike(pattern), F.concat(done, F.array(labelled)))
            .when(F.size(done) == 0, F.array(first))
            .otherwise(F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer)))
        )

    items = F.aggregate(lines, F.array().cast(f"array<{entry}>"), step)
    known = F.create_map(*[F.lit(x) for item in L.NOTE_LABELS.items() for x in item])
    rows = notes.select(key, F.posexplode(items).alias("position", "item"))
    return rows.select(
        key, "position", F.coalesce(known[F.lower("item.label")], F.col("item.label")).alias("label"), F.col("item.value").alias("value")
    ).where(F.col("value") != "")
