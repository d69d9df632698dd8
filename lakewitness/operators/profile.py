"""Column, table and task profiles, for many versions at once."""

from __future__ import annotations

from collections.abc import Collection
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewitness.functions.columns import as_text, cap, is_numeric, logical_dtype, numeric_columns, present, row_key, safe_div
from lakewitness.functions.wide import figures_together
from lakewitness.operators.value_counts import is_missing, union_all
from lakewitness.session import ship_package, together
from lakewitness.lookups import (
    HIGH_CORRELATION,
    LOW_INFORMATION_SHARE,
    TOP_VALUES,
)

GROUP = ["version_id", "column"]
STATISTICS = ["min", "q25", "median", "q75", "max", "mean", "std", "skewness"]
# Columns correlated with one another in one matrix product per Arrow batch; wider tables take several.
CORRELATION_BLOCK = 200
# Distinct numbers of a column whose quartiles are read off its value counts; that many rows per column come to the driver.
FEW_VALUES = 1000


def skewness(n: Column, m2: Column, m3: Column) -> Column:
    """Bias-corrected sample skewness from sums of squared and cubed deviations."""
    g1 = (m3 / n) / F.pow(m2 / n, F.lit(1.5))
    return F.when(n < 3, F.lit(None).cast("double")).when(m2 == 0, F.lit(0.0)).otherwise(
        g1 * F.sqrt(n * (n - 1)) / (n - 2)
    )


def column_counts(vc: DataFrame) -> DataFrame:
    """Row, missing and distinct counts of every column."""
    return vc.groupBy(*GROUP).agg(
        F.sum("cnt").alias("row_count"),
        F.sum(F.when(is_missing(), F.col("cnt")).otherwise(0)).alias("missing_count"),
        F.sum(F.when(is_missing(), 0).otherwise(1)).alias("unique_count"),
    )


FIGURES_SCHEMA = "version_id long, column string, n long, min double, q25 double, median double, q75 double, max double, mean double, m2 double, m3 double, outlier_count long"


def few_values(vc: DataFrame) -> dict[tuple[int, str], list[tuple[float, int]]]:
    """Values in ascending order and their counts, of the numeric columns with at most ``FEW_VALUES`` of them."""
    numbers = vc.where(F.col("num").isNotNull())
    small = numbers.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= FEW_VALUES).select(*GROUP)
    # Whole numbers beyond the range of doubles may share a value.
    rows = numbers.join(F.broadcast(small), GROUP).groupBy(*GROUP, "num").agg(F.sum("cnt").alias("n")).collect()
    found: dict[tuple[int, str], list[tuple[float, int]]] = {}
    for r in sorted(rows, key=lambda r: r["num"]):
        found.setdefault((r["version_id"], r["column"]), []).append((r["num"], r["n"]))
    return found


def numeric_statistics(
    versions: dict[int, DataFrame], values: dict[int, dict[str, Column]] | None = None, few: dict[tuple[int, str], list[tuple[float, int]]] | None = None
) -> DataFrame:
    """Moments, quartiles and fence outliers of every numeric column, or of the given doubles, in wide passes over the tables.

    ``few``: ``few_values`` of these columns, where value counts are at hand."""
    tables = {}
    for vid, df in versions.items():
        numeric = {f.name: present(f).cast("double") + F.lit(0.0) for f in df.schema.fields if is_numeric(f.dataType)}
        tables[vid] = (df, numeric if values is None else values.get(vid, {}))
    found = figures_together(tables, few) if any(v for _, v in tables.values()) else {}
    spark = next(iter(versions.values())).sparkSession
    rows = [(v, c, f.n, f.low, *f.quantiles, f.high, f.mean, f.m2, f.m3, f.outliers) for (v, c), f in found.items()]
    m2 = F.when(F.col("min") == F.col("max"), F.lit(0.0)).otherwise(F.col("m2"))
    return spark.createDataFrame(rows, FIGURES_SCHEMA).where("n > 0").select(
        *GROUP,
        "min",
        "q25",
        "median",
        "q75",
        "max",
        "mean",
        F.when(F.col("n") > 1, F.sqrt(m2 / (F.col("n") - 1))).alias("std"),
        skewness(F.col("n"), m2, F.col("m3")).alias("skewness"),
        "outlier_count",
    )


def column_profile(vc: DataFrame, catalog: DataFrame, configurations: DataFrame, versions: dict[int, DataFrame]) -> DataFrame:
    """One row per (version, column): D1-D4 and D6."""
    counts = column_counts(vc)
    numeric = F.col("base_type").isin("int64", "float64")
    targets = configurations.select("version_id", "target_column")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    rows = (
        catalog.join(targets, "version_id", "left")
        .join(counts.select(*GROUP, "row_count", "missing_count", "unique_count"), GROUP, "left")
        .join(numeric_statistics(versions, few=few_values(vc)), GROUP, "left")
        .withColumns({c: zero(c) for c in ("row_count", "missing_count", "unique_count")})
    )
    return rows.select(
        "version_id",
        "column",
        "position",
        "base_type",
        logical_dtype(F.col("base_type"), F.col("missing_count")).alias("logical_dtype"),
        numeric.alias("is_numeric"),
        F.when(F.col("column") == F.col("target_column"), "target").otherwise("feature").alias("role"),
        "row_count",
        "missing_count",
        F.round(safe_div(F.col("missing_count"), F.col("row_count")), 6).alias("missing_ratio"),
        "unique_count",
        F.round(safe_div(F.col("unique_count"), F.col("row_count")), 6).alias("unique_ratio"),
        *[F.col(s) for s in STATISTICS],
        F.when(numeric, zero("outlier_count")).alias("outlier_count"),
        F.when(numeric, F.round(safe_div(zero("outlier_count"), F.col("row_count")), 6)).alias("outlier_ratio"),
    )


def top_values(vc: DataFrame, catalog: DataFrame, limit: int = TOP_VALUES) -> DataFrame:
    """The most frequent labels of every non-numeric column; ties by label.

    The columns' names are broadcast: a join by them would bring all values of a column into one task. The ranks are limited
    in each task before values are shuffled.
    """
    text = catalog.where(~F.col("base_type").isin("int64", "float64")).select(*GROUP)
    order = Window.partitionBy(*GROUP).orderBy(F.col("cnt").desc(), F.col("value").asc())
    return (
        vc.where(F.col("value").isNotNull())
        .join(F.broadcast(text), GROUP)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= limit)
        .select(*GROUP, "rank", "value", "cnt")
    )


def rows_that_differ(columns: DataFrame) -> dict[int, str]:
    """Versions with a full column whose values are as many as the rows, and the first such column: no row is a copy of another."""
    whole = (F.col("row_count") > 0) & (F.col("missing_count") == 0) & (F.col("unique_count") == F.col("row_count"))
    found = columns.where(whole).groupBy("version_id").agg(F.min_by("column", "position").alias("column"))
    return {r["version_id"]: r["column"] for r in found.collect()}


def duplicate_rows(versions: dict[int, DataFrame], differing: Collection[int] = ()) -> DataFrame:
    """Copies beyond the first of every row; missing cells compare equal.

    ``differing``: versions known by ``rows_that_differ`` to have none; their rows need not be compared.
    """
    known = next(iter(versions.values())).sparkSession.createDataFrame([(v, 0) for v in versions if v in differing], "version_id long, duplicate_rows long")
    digests = [
        df.select(F.lit(vid).cast("long").alias("version_id"), row_key(df, df.columns).alias("digest"))
        for vid, df in versions.items()
        if vid not in differing
    ]
    if not digests:
        return known
    return (
        union_all(digests).groupBy("version_id", "digest")
        .agg(F.count(F.lit(1)).alias("copies"))
        .groupBy("version_id")
        .agg(F.sum(F.col("copies") - 1).alias("duplicate_rows"))
    ).unionByName(known)


def _block_sums(df: DataFrame, names: list[str], means: dict[str, float], a: int, b: int) -> DataFrame:
    """Six sums for every pair of a column of block a with a later column of block b: one matrix product per Arrow batch."""
    left = list(range(a, min(a + CORRELATION_BLOCK, len(names))))
    right = list(range(b, min(b + CORRELATION_BLOCK, len(names))))
    fields = {f.name: f for f in df.schema.fields}
    used = sorted({*left, *right})
    place = {c: k for k, c in enumerate(used)}
    li, ri = np.array([place[c] for c in left]), np.array([place[c] for c in right])
    centre = np.array([means[names[c]] for c in used])
    later = np.array(left)[:, None] < np.array(right)[None, :]
    i, j = np.where(later)
    i, j = np.array(left)[i], np.array(right)[j]

    def batches(frames):
        import pandas as pd

        sums = None
        for frame in frames:
            x = frame.to_numpy(dtype="float64") - centre
            mask = np.isfinite(x)
            m, z = mask.astype("float64"), np.where(mask, x, 0.0)
            ml, zl, mr, zr = m[:, li], z[:, li], m[:, ri], z[:, ri]
            part = np.stack([ml.T @ mr, zl.T @ mr, ml.T @ zr, (zl * zl).T @ mr, ml.T @ (zr * zr), zl.T @ zr])
            sums = part if sums is None else sums + part
        if sums is not None:
            yield pd.DataFrame({"i": i, "j": j, **{f"s{k}": sums[k][later] for k in range(6)}})

    schema = "i int, j int, " + ", ".join(f"s{k} double" for k in range(6))
    return df.select(*[present(fields[names[c]]).cast("double").alias(f"c{c}") for c in used]).mapInPandas(batches, schema)


def correlations(df: DataFrame, version_id: int, names: list[str] | None = None) -> DataFrame | None:
    """Pairwise-complete Pearson correlation of the numeric columns, for any number of them, in blocks of columns."""
    names = numeric_columns(df) if names is None else names
    if len(names) < 2:
        return None
    ship_package(df.sparkSession)
    fields = {f.name: f for f in df.schema.fields}
    # sums are taken about the means, so that large values lose no digits
    centre = df.agg(*[F.avg(present(fields[n]).cast("double")).alias(f"c{i}") for i, n in enumerate(names)]).first()
    means = {n: v if v is not None and np.isfinite(v) else 0.0 for n, v in zip(names, centre)}
    starts = range(0, len(names), CORRELATION_BLOCK)
    parts = union_all([_block_sums(df, names, means, a, b) for a in starts for b in starts if a <= b])
    total = parts.groupBy("i", "j").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(6)])
    n, sx, sy, sxx, syy, sxy = [F.col(f"s{k}") for k in range(6)]
    vx, vy = sxx - sx * sx / n, syy - sy * sy / n
    names_sql = F.array(*[F.lit(v) for v in names])
    return total.select(
        F.lit(version_id).cast("long").alias("version_id"),
        names_sql[F.col("i")].alias("left"),
        names_sql[F.col("j")].alias("right"),
        F.when((n > 1) & (vx > 0) & (vy > 0), (sxy - sx * sy / n) / F.sqrt(vx * vy)).alias("correlation"),
    )


def high_correlations(versions: dict[int, DataFrame], threshold: float = HIGH_CORRELATION) -> DataFrame | None:
    """Pairs with a strong correlation, for versions with at least 2 numeric columns."""
    wide = {vid: df for vid, df in versions.items() if len(numeric_columns(df)) > 1}
    if not wide:
        return None
    # The means of one table need nothing of the others.
    parts = together(next(iter(wide.values())).sparkSession, [partial(correlations, df, vid) for vid, df in wide.items()])
    r = F.col("correlation")
    return (
        union_all(parts)
        .where(r.isNotNull() & ~F.isnan(r) & (F.abs(r) >= threshold))
        .withColumn("correlation", F.round(r, 6))
    )


def table_profile(columns: DataFrame, duplicates: DataFrame) -> DataFrame:
    """D8 and D9 rolled up per version."""
    return (
        columns.groupBy("version_id")
        .agg(
            F.max("row_count").alias("row_count"),
            F.count(F.lit(1)).alias("column_count"),
            F.sum("missing_count").alias("missing_cells"),
            F.count_if("is_numeric").alias("numeric_columns"),
            F.count_if(~F.col("is_numeric")).alias("categorical_columns"),
        )
        .join(duplicates, "version_id", "left")
        .withColumn("duplicate_rows", F.coalesce("duplicate_rows", F.lit(0)))
        .select(
            "version_id",
            "row_count",
            "column_count",
            "missing_cells",
            F.round(safe_div(F.col("missing_cells"), F.col("row_count") * F.col("column_count")), 6).alias("missing_ratio"),
            "duplicate_rows",
            F.round(safe_div(F.col("duplicate_rows"), F.col("row_count")), 6).alias("duplicate_ratio"),
            "numeric_columns",
            "categorical_columns",
        )
    )


def label_text(columns: DataFrame, vc: DataFrame) -> DataFrame:
    """Value counts with every value as text, numbers in the form their type has."""
    typed = columns.select(*GROUP, "logical_dtype")
    text = F.when(F.col("value").isNotNull(), F.col("value")).when(
        F.col("logical_dtype") == "int64", F.col("num").cast("long").cast("string")
    ).otherwise(F.col("num").cast("string"))
    return vc.join(F.broadcast(typed), GROUP).withColumn("label", text)


def class_distribution(vc: DataFrame, columns: DataFrame, configurations: DataFrame) -> DataFrame:
    """D10, long form: one row per class of a classification target."""
    targets = configurations.where(F.col("task_type") == "classification").select(
        "version_id", F.col("target_column").alias("column")
    )
    counts = label_text(columns, vc.join(F.broadcast(targets), GROUP, "left_semi").where(~is_missing()))
    total = F.sum("cnt").over(Window.partitionBy("version_id"))
    return counts.select("version_id", F.col("label").alias("class"), "cnt", F.round(safe_div(F.col("cnt"), total), 6).alias("class_ratio"))


def classification_profile(classes: DataFrame) -> DataFrame:
    """Class counts, minority class and imbalance ratio."""
    return classes.groupBy("version_id").agg(
        F.count(F.lit(1)).alias("class_count"),
        F.sum("cnt").alias("labelled_rows"),
        F.min("cnt").alias("min_class"),
        F.max("cnt").alias("max_class"),
        F.min_by("class", F.struct("cnt", "class")).alias("minority_class"),
        F.round(F.max("cnt") / F.greatest(F.min("cnt"), F.lit(1)), 4).alias("imbalance_ratio"),
    )


def regression_profile(versions: dict[int, DataFrame], configurations: DataFrame) -> DataFrame:
    """Shape of a regression target, text converted to numbers where it can be."""
    spark, values, sizes = next(iter(versions.values())).sparkSession, {}, []
    for r in configurations.where(F.col("task_type") == "regression").select("version_id", "target_column").collect():
        fields = {f.name: f for f in versions[r["version_id"]].schema.fields} if r["version_id"] in versions else {}
        if r["target_column"] in fields:
            f = fields[r["target_column"]]
            number = present(f).cast("double") if is_numeric(f.dataType) else as_text(f).try_cast("double")
            values[r["version_id"]] = {f.name: number + F.lit(0.0)}
    targets = {v: versions[v] for v in values} or versions
    stats = numeric_statistics(targets, values).drop("column")
    for v, value in values.items():
        (number,) = value.values()
        counts = versions[v].agg(F.count(F.lit(1)).alias("target_rows"), F.count_if(number.isNull()).alias("target_missing"))
        sizes.append(counts.withColumn("version_id", F.lit(v).cast("long")))
    none = spark.createDataFrame([], "target_rows long, target_missing long, version_id long")
    return union_all([none, *sizes]).where("target_rows > 0").join(stats, "version_id", "left").select(
        "version_id",
        F.col("skewness").alias("target_skewness"),
        F.coalesce("outlier_count", F.lit(0)).alias("target_outlier_count"),
        F.round(safe_div(F.col("target_missing"), F.col("target_rows")), 6).alias("target_missing_ratio"),
        (F.col("target_rows") - F.col("target_missing")).alias("target_count"),
        *[F.col(s).alias(f"target_{s}") for s in ("min", "q25", "median", "q75", "max", "mean", "std")],
    )


def clustering_profile(columns: DataFrame, configurations: DataFrame) -> DataFrame:
    """Spread of the selected numeric features and dimensionality."""
    chosen = configurations.where(F.col("task_type") == "clustering").select("version_id", "selected_features")
    wanted = (F.size(F.coalesce("selected_features", F.array().cast("array<string>"))) == 0) | F.array_contains(
        "selected_features", F.col("column")
    )
    features = columns.join(chosen, "version_id").where(F.col("is_numeric")).withColumn("used", wanted)
    spread = F.when(F.col("used") & (F.col("std") != 0), F.col("std"))
    ratio = F.coalesce(F.max(spread) / F.min(spread), F.lit(1.0))
    return features.groupBy("version_id").agg(
        F.count_if("used").alias("selected_numeric"),
        F.max("row_count").alias("row_count"),
        ratio.alias("spread"),
    ).select(
        "version_id",
        "selected_numeric",
        F.round("spread", 4).alias("spread_ratio"),
        (F.col("spread") > 10).alias("scaling_required"),
        F.round(safe_div(F.col("selected_numeric"), F.col("row_count")), 6).alias("dimensionality_ratio"),
        (F.col("selected_numeric") > F.greatest(F.lit(20.0), F.col("row_count") / 10)).alias("high_dimensional"),
    )


def low_information(columns: DataFrame, tops: DataFrame) -> DataFrame:
    """Features that are constant or nearly so."""
    first = tops.where(F.col("rank") == 1).select(*GROUP, F.col("cnt").alias("top_count"))
    share = safe_div(F.coalesce(F.col("top_count"), F.lit(0)), F.col("row_count"))
    return (
        columns.where(F.col("role") != "target")
        .join(first, GROUP, "left")
        .where((F.col("unique_count") <= 1) | (share >= LOW_INFORMATION_SHARE))
        .select(*GROUP, "unique_count", F.coalesce("top_count", F.lit(0)).alias("top_count"))
    )


def worst_columns(columns: DataFrame, by: str, limit: int | None = 8) -> DataFrame:
    """Columns ordered by missing ratio or outlier count; ties by position."""
    count, measure = {"missing": ("missing_count", "missing_ratio"), "outlier": ("outlier_count", "outlier_count")}[by]
    order = Window.partitionBy("version_id").orderBy(F.col(measure).desc(), F.col("position"))
    ranked = columns.where(F.col(count) > 0).withColumn("rank", F.row_number().over(order))
    if limit is not None:
        ranked = ranked.where(F.col("rank") <= limit)
    return ranked.select("version_id", "rank", "column", F.col(measure).cast("double").alias("measure"))


def compact_profile(columns: DataFrame, tops: DataFrame) -> DataFrame:
    """The short column view with the five most frequent labels in one text."""
    five = (
        tops.where(F.col("rank") <= 5)
        .groupBy(*GROUP)
        .agg(F.sort_array(F.collect_list(F.struct("rank", "value", "cnt"))).alias("t"))
        .select(*GROUP, F.concat_ws("|", F.transform("t", lambda x: F.concat_ws("=", x["value"], x["cnt"].cast("string")))).alias("top"))
    )
    return columns.join(five, GROUP, "left").select(
        *GROUP, "role", "logical_dtype", "missing_count", "missing_ratio", "unique_count", "outlier_count", "median", "top"
    )


def imbalance_points(largest: Column, smallest: Column, classes: Column, total: Column, points: float) -> Column:
    """Points for uneven classes, from the largest share and the smallest-to-largest ratio."""
    ideal = 1 / classes
    normalised = (largest / total - ideal) / F.greatest(1 - ideal, F.lit(1e-9))
    penalty = F.greatest(F.lit(0.0), 1 - smallest / F.greatest(largest, F.lit(1)))
    return F.when(classes < 2, F.lit(0.0)).otherwise(cap((0.7 * normalised + 0.3 * penalty) * points, points))
