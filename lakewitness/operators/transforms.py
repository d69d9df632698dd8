"""Preprocessing steps on data tables.

A step is fitted with one small aggregation and applied as a projection or a filter, so a chain of
steps stays one pass over the data per fit. The target is never transformed as a feature.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewitness.functions.columns import as_text, numeric_columns, q, text_columns
from lakewitness.operators import fits
from lakewitness.operators.profile import correlations
from lakewitness.session import cut, is_input_error

INFORMATION_BINS = 10


@dataclass
class Context:
    """What a step needs to know besides its parameters."""

    target: str | None = None
    task: str = "classification"
    seed: int = 42
    minority_count: int | None = None
    applied: list[str] = field(default_factory=list)
    failed: list[tuple[str, str]] = field(default_factory=list)

    def numeric(self, df: DataFrame) -> list[str]:
        return [c for c in numeric_columns(df) if c != self.target]

    def text(self, df: DataFrame) -> list[str]:
        return [c for c in text_columns(df) if c != self.target]


def replace_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    return df.select(*[new[c].alias(c) if c in new else q(c) for c in df.columns])


# ---------------------------------------------------------------- rows and missing values

def drop_duplicates(df: DataFrame, ctx: Context, keep: str = "first") -> DataFrame:
    """Equal rows are interchangeable, so which copy stays does not matter."""
    return df.dropDuplicates()


def _impute(df: DataFrame, ctx: Context, fills: dict[str, float | None]) -> DataFrame:
    new = fits.filled(df, ctx.numeric(df), fills)
    fields = {f.name: f for f in df.schema.fields}
    modes = fits.modes_where_missing(df, ctx.text(df))
    new |= {c: F.coalesce(as_text(fields[c]), F.lit(v)) for c, v in modes.items() if v is not None}
    return replace_columns(df, new)


def median_imputation(df: DataFrame, ctx: Context, strategy: str = "median") -> DataFrame:
    """Medians for numbers, the most frequent value for text. An all-missing column stays as it is."""
    return _impute(df, ctx, fits.medians_where_missing(df, ctx.numeric(df)))


def mean_imputation(df: DataFrame, ctx: Context, strategy: str = "mean") -> DataFrame:
    """I3."""
    return _impute(df, ctx, {c: v["avg"] for c, v in fits.moments(df, ctx.numeric(df), "avg").items()})


def drop_missing_rows(df: DataFrame, ctx: Context, threshold: float = 0.5) -> DataFrame:
    """I4: keep rows with enough cells filled, the target counted like any column."""
    return df.na.drop(thresh=int((1.0 - threshold) * len(df.columns)))


# ---------------------------------------------------------------- encoding

def ranks(values: DataFrame, column: str) -> DataFrame:
    """Position of each distinct value in sorted order, from 0.

    Values are dealt to ranges by the range partitioner, counted per range, and ranked inside their range only. What lies
    before a range is one number, so the broadcast has a row per partition.
    """
    ranged = cut(values.repartitionByRange(column).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(sizes.select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))
    inside = Window.partitionBy("_range").orderBy(column)
    return ranged.join(F.broadcast(offsets), "_range").select(column, (F.col("before") + F.row_number().over(inside) - 1).cast("double").alias("code"))


def label_encoding(df: DataFrame, ctx: Context) -> DataFrame:
    """Text becomes its position among the sorted distinct values; missing stays missing.

    The dictionary is a written table, so the planner knows its size and broadcasts it or not; of a large one, rows with a hot label
    are split by adaptive execution. Missing cells match nothing and are spread over the tasks.
    """
    order, fields = df.columns, {f.name: f for f in df.schema.fields}
    for name in ctx.text(df):
        text = replace_columns(df, {name: as_text(fields[name])})
        codes = cut(ranks(text.select(q(name).alias("_label")).where(F.col("_label").isNotNull()).distinct(), "_label"))
        codes = codes.select("_label", F.col("code").alias("_code"), F.lit(0).cast("long").alias("_spread"))
        spread = F.when(q(name).isNull(), F.xxhash64(*[q(c) for c in order]).bitwiseOR(F.lit(1))).otherwise(F.lit(0).cast("long"))
        keyed = text.withColumn("_key", spread)
        coded = keyed.join(codes, (q(name) == F.col("_label")) & (F.col("_key") == F.col("_spread")), "left")
        df = coded.select(*[F.col("_code").alias(c) if c == name else q(c) for c in order])
    return df


def onehot_encoding(df: DataFrame, ctx: Context, max_categories: int = 20, handle_unknown: str = "ignore") -> DataFrame:
    """An indicator per value for text columns with few values; the source column goes.

    Only columns within the limit send their values to the driver, so that is bounded by the limit
    times the number of columns.
    """
    names, fields = ctx.text(df), {f.name: f for f in df.schema.fields}
    if not names:
        return df
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), as_text(fields[c]).alias("value")) for c in names])).alias("c"))
    distinct = cells.select("c.*").where(F.col("value").isNotNull()).distinct()
    small = distinct.groupBy("column").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= max_categories)
    found: dict[str, list[str]] = {}
    for r in distinct.join(small, "column", "left_semi").orderBy("column", "value").collect():
        found.setdefault(r["column"], []).append(r["value"])
    kept = [c for c in df.columns if c not in found]
    taken, flags = {c.lower() for c in kept}, []
    for c, v in [(c, v) for c in df.columns if c in found for v in found[c]]:
        # Spark tells columns apart without regard to case: of such names the later ones are numbered.
        name, n = f"{c}_{v}", 1
        while name.lower() in taken:
            n += 1
            name = f"{c}_{v}_{n}"
        taken.add(name.lower())
        flags.append(F.coalesce((as_text(fields[c]) == v).cast("int"), F.lit(0)).alias(name))
    return df.select(*[q(c) for c in kept], *flags)


# ---------------------------------------------------------------- outliers

def iqr_filtering(df: DataFrame, ctx: Context, factor: float = 1.5) -> DataFrame:
    """Drop rows with any feature outside its fences; missing values pass."""
    values, keep = fits.clean(df), F.lit(True)
    for name, (low, high) in fits.quantiles(df, ctx.numeric(df), [0.25, 0.75]).items():
        if low is None:
            continue
        reach = factor * (high - low)
        outside = (values[name] < low - reach) | (values[name] > high + reach)
        keep = keep & ~F.coalesce(outside, F.lit(False))
    return df.where(keep)


def clip_outliers(df: DataFrame, ctx: Context, lower: float = 0.01, upper: float = 0.99) -> DataFrame:
    """Values beyond the two percentiles become those percentiles."""
    values = fits.clean(df)
    new = {
        c: F.when(values[c].isNotNull(), F.least(F.greatest(values[c], F.lit(lo)), F.lit(hi)))
        for c, (lo, hi) in fits.quantiles(df, ctx.numeric(df), [lower, upper]).items()
        if lo is not None
    }
    return replace_columns(df, new)


# ---------------------------------------------------------------- feature reduction

def correlation_filter(df: DataFrame, ctx: Context, threshold: float = 0.9) -> DataFrame:
    """Of two strongly correlated features the one with the smaller variance goes."""
    names = ctx.numeric(df)
    if len(names) < 2:
        return df
    r = F.col("correlation")
    strong = correlations(df, 0, names).where(r.isNotNull() & ~F.isnan(r) & (F.abs(r) >= threshold)).collect()
    variance = {c: v["var_samp"] for c, v in fits.moments(df, names, "var_samp").items()}
    # ``right`` is the later column; it goes only when its variance is smaller.
    drop = {p["right"] if variance[p["right"]] < variance[p["left"]] else p["left"] for p in strong}
    return df.drop(*drop)


def variance_threshold(df: DataFrame, ctx: Context, threshold: float = 0.01) -> DataFrame:
    """I16."""
    variance = fits.moments(df, ctx.numeric(df), "var_samp")
    return df.drop(*[c for c, v in variance.items() if v["var_samp"] is not None and v["var_samp"] < threshold])


def _bin(value: Column, cuts: list[float]) -> Column:
    """Number of cut points below the value."""
    return sum(((value > c).cast("int") for c in cuts), F.lit(0))


def information(df: DataFrame, ctx: Context, bins: int = INFORMATION_BINS) -> DataFrame:
    """Mutual information (nats) of every numeric feature with the target.

    Features, and a numeric target of a regression, are cut into bins of equal frequency. Only the
    contingency counts are shuffled: features times bins times classes.
    """
    names, values = ctx.numeric(df), fits.clean(df)
    probs = [i / bins for i in range(1, bins)]
    numeric_target = ctx.task == "regression" and ctx.target in numeric_columns(df)
    cuts = fits.quantiles(df, names + ([ctx.target] if numeric_target else []), [0.5, *probs])
    fields = {f.name: f for f in df.schema.fields}
    target = _bin(values[ctx.target], cuts[ctx.target][1:]).cast("string") if numeric_target else as_text(fields[ctx.target])
    filled = {c: F.coalesce(values[c], F.lit(cuts[c][0])) for c in names if cuts[c][0] is not None}
    cells = df.where(as_text(fields[ctx.target]).isNotNull()).select(
        target.alias("y"),
        F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), _bin(v, cuts[c][1:]).alias("x")) for c, v in filled.items()])).alias("c"),
    )
    counts = cells.select("y", "c.*").groupBy("feature", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("feature"))
    by_x, by_y = F.sum("n").over(Window.partitionBy("feature", "x")), F.sum("n").over(Window.partitionBy("feature", "y"))
    shares = counts.select("feature", "n", total.alias("t"), by_x.alias("nx"), by_y.alias("ny"))
    term = F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("nx") * F.col("ny")))
    return shares.groupBy("feature").agg(F.greatest(F.sum(term), F.lit(0.0)).alias("information"))


def mutual_information(df: DataFrame, ctx: Context, k: int = 20, random_state: int = 42) -> DataFrame:
    """Keep the k numeric features that tell most about the target; ties by name."""
    names = ctx.numeric(df)
    if not ctx.target or ctx.target not in df.columns or len(names) <= k:
        return df
    best = information(df, ctx).orderBy(F.col("information").desc(), "feature").limit(k).collect()
    keep = {r["feature"] for r in best}
    return df.drop(*[c for c in names if c not in keep])


# ---------------------------------------------------------------- scaling

def _filled(df: DataFrame, ctx: Context) -> DataFrame:
    """Numeric features with missing cells at the median."""
    names = ctx.numeric(df)
    return replace_columns(df, fits.filled(df, names, fits.medians_where_missing(df, names)))


def _scale(df: DataFrame, centre: dict, spread: dict) -> DataFrame:
    """(value - centre) / spread; a spread of zero counts as one, an all-missing column stays as it is."""
    return replace_columns(
        df, {c: (q(c) - F.lit(float(m))) / F.lit(float(spread[c]) if spread[c] else 1.0) for c, m in centre.items() if m is not None}
    )


def standard_scaler(df: DataFrame, ctx: Context) -> DataFrame:
    """Mean and population deviation of the median-filled column."""
    full = _filled(df, ctx)
    m = fits.moments(full, ctx.numeric(full), "avg", "stddev_pop")
    return _scale(full, {c: v["avg"] for c, v in m.items()}, {c: v["stddev_pop"] for c, v in m.items()})


def robust_scaler(df: DataFrame, ctx: Context) -> DataFrame:
    """Median and interquartile range of the median-filled column."""
    full = _filled(df, ctx)
    parts = fits.quantiles(full, ctx.numeric(full), [0.25, 0.5, 0.75])
    spread = {c: (v[2] - v[0]) if v[0] is not None else None for c, v in parts.items()}
    return _scale(full, {c: v[1] for c, v in parts.items()}, spread)


def minmax_scaler(df: DataFrame, ctx: Context) -> DataFrame:
    """Smallest value and range."""
    full = _filled(df, ctx)
    m = fits.moments(full, ctx.numeric(full), "min", "max")
    spread = {c: (v["max"] - v["min"]) if v["min"] is not None else None for c, v in m.items()}
    return _scale(full, {c: v["min"] for c, v in m.items()}, spread)


# ---------------------------------------------------------------- chains

def steps() -> dict[str, Callable[..., DataFrame]]:
    from lakewitness.operators import isolation, resample

    own = [
        drop_duplicates, median_imputation, mean_imputation, drop_missing_rows, label_encoding, onehot_encoding,
        iqr_filtering, clip_outliers, correlation_filter, mutual_information, variance_threshold,
        standard_scaler, robust_scaler, minmax_scaler,
    ]
    other = [isolation.isolation_forest, resample.smote, resample.adasyn, resample.random_oversampling, resample.random_undersampling]
    return {fn.__name__: fn for fn in own + other}


def apply_steps(df: DataFrame, chain: list[tuple[str, dict]], ctx: Context) -> DataFrame:
    """Steps in order. A step that fails on the data is recorded and skipped; the others still run.

    Each step's table is written before the next is fitted on it, so an error of the data shows at its step and no fit runs
    the chain again. Errors of the cluster are not caught. Surviving original columns keep their order, new ones follow.
    """
    original, known = df.columns, steps()
    for name, params in chain:
        try:
            df = cut(known[name](df, ctx, **params))
            ctx.applied.append(name)
        except Exception as error:  # noqa: BLE001
            if not is_input_error(error):
                raise
            ctx.failed.append((name, str(error)))
    kept = [c for c in original if c in df.columns]
    return df.select(*[q(c) for c in kept], *[q(c) for c in df.columns if c not in kept])


def class_balance(df: DataFrame, target: str | None) -> DataFrame:
    """Balance of the classes from 0 to 1; 1 without a target or with a single class."""
    if not target or target not in df.columns:
        return df.sparkSession.range(1).select(F.lit(1.0).alias("class_balance"))
    classes = df.where(q(target).isNotNull()).groupBy(q(target).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    ideal = 1 / F.count(F.lit(1))
    uneven = F.abs(F.max("n") / F.sum("n") - ideal) / (1 - ideal)
    return classes.agg(
        F.when(F.count(F.lit(1)) < 2, 1.0).otherwise(F.round(F.greatest(F.lit(0.0), 1 - uneven), 6)).alias("class_balance")
    )


def table_figures(df: DataFrame, target: str | None) -> DataFrame:
    """Rows, columns, missing percentage and class balance of a table, one row."""
    fields = df.schema.fields
    missing = sum((F.when(as_text(f).isNull(), 1).otherwise(0) for f in fields), F.lit(0))
    width = len(fields)
    figures = df.agg(F.count(F.lit(1)).alias("row_count"), F.coalesce(F.sum(missing), F.lit(0)).alias("cells")).select(
        "row_count",
        F.lit(width).alias("column_count"),
        F.when(F.col("row_count") == 0, 0.0).otherwise(F.round(F.col("cells") / (F.col("row_count") * width) * 100, 6)).alias("missing_pct"),
    )
    # Two one-row relations merged into one.
    both = figures.unionByName(class_balance(df, target), allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def build_metrics(before: DataFrame, after: DataFrame, target: str | None) -> DataFrame:
    """The same figures for both ends of a chain of steps."""
    return table_figures(before, target).withColumn("side", F.lit("before")).unionByName(
        table_figures(after, target).withColumn("side", F.lit("after"))
    )
