"""Statistics a transformation is fitted with: a few numbers per column, brought to the driver.

Every function returns one small dictionary keyed by column, never rows of the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewitness.functions import wide
from lakewitness.functions.columns import as_text, present


def clean(df: DataFrame) -> dict:
    """Numeric columns as doubles with NaN turned into NULL."""
    return {f.name: present(f).cast("double") for f in df.schema.fields}


def missing(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Missing cells per column, one pass."""
    fields = [f for f in df.schema.fields if f.name in columns]
    if not fields:
        return {}
    row = df.agg(*[F.count_if(present(f).isNull()).alias(f"c{i}") for i, f in enumerate(fields)]).first()
    return {f.name: row[i] for i, f in enumerate(fields)}


def medians_where_missing(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """Medians of the columns that have missing cells. A full column needs no fill, and its values
    need not be ordered."""
    gaps = [c for c, n in missing(df, columns).items() if n]
    return {c: v[0] for c, v in quantiles(df, gaps, [0.5]).items()}


def quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> dict[str, list[float | None]]:
    """Exact quantiles, in wide passes over the table."""
    if not columns:
        return {}
    values = clean(df)
    tables = {0: (df, {c: values[c] + F.lit(0.0) for c in columns})}
    figures = wide.moments(tables)
    wide.add_quantiles(tables, figures, probs)
    return {c: figures[0, c].quantiles for c in columns}


def moments(df: DataFrame, columns: list[str], *names: str) -> dict[str, dict[str, float | None]]:
    """Any of avg, min, max, var_samp, stddev_pop of the columns, in one pass without a shuffle of values."""
    if not columns:
        return {}
    values = clean(df)
    row = df.agg(*[getattr(F, n)(values[c]).alias(f"{n}{i}") for i, c in enumerate(columns) for n in names]).first()
    return {c: {n: row[f"{n}{i}"] for n in names} for i, c in enumerate(columns)}


def filled(df: DataFrame, columns: list[str], fills: dict[str, float | None]) -> dict:
    """The columns as doubles with missing cells filled where there is a fill."""
    values = clean(df)
    return {c: F.coalesce(values[c], F.lit(float(fills[c]))) if fills.get(c) is not None else values[c] for c in columns}


def modes_where_missing(df: DataFrame, columns: list[str]) -> dict[str, str | None]:
    return modes(df, [c for c, n in missing(df, columns).items() if n])


def modes(df: DataFrame, columns: list[str]) -> dict[str, str | None]:
    """Most frequent value of each text column; ties go to the smallest value."""
    if not columns:
        return {}
    fields = [f for f in df.schema.fields if f.name in columns]
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(f.name).alias("column"), as_text(f).alias("value")) for f in fields])).alias("c"))
    counted = cells.select("c.*").where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    rows = counted.groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode")).collect()
    return {r["column"]: r["mode"] for r in rows}
