"""Long form of a table and the value counts most evidence is computed from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewitness.functions.columns import EXACT_INTEGER, as_text, base_type, is_numeric, exact_text, present

CATALOG_SCHEMA = "version_id long, position int, column string, base_type string"


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def column_catalog(spark: SparkSession, versions: dict[int, DataFrame]) -> DataFrame:
    """Column names, positions and type families of every version (schema only, no data read)."""
    rows = [
        (vid, i, f.name, base_type(f.dataType))
        for vid, df in versions.items()
        for i, f in enumerate(df.schema.fields, start=1)
    ]
    return spark.createDataFrame(rows, CATALOG_SCHEMA)


def _cell(field: T.StructField):
    """Numbers go to ``num``; everything else, and whole numbers a double cannot hold, to ``value``."""
    if is_numeric(field.dataType):
        clean = present(field)
        number = clean.cast("double") + F.lit(0.0)
        text = F.lit(None).cast("string")
        if isinstance(field.dataType, T.LongType):
            text = F.when(F.abs(clean) > EXACT_INTEGER, clean.cast("string"))
        if isinstance(field.dataType, T.DecimalType):
            digits = exact_text(field)
            text = F.when(digits != number.cast("string"), digits)
        return F.struct(F.lit(field.name).alias("column"), text.alias("value"), number.alias("num"))
    return F.struct(
        F.lit(field.name).alias("column"),
        as_text(field).alias("value"),
        F.lit(None).cast("double").alias("num"),
    )


def long_form(df: DataFrame, version_id: int, columns: list[str] | None = None) -> DataFrame:
    """(version_id, column, value, num), one row per cell."""
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    cells = F.explode(F.array(*[_cell(f) for f in fields]))
    return df.select(F.lit(version_id).cast("long").alias("version_id"), cells.alias("cell")).select(
        "version_id", "cell.column", "cell.value", "cell.num"
    )


def value_counts(versions: dict[int, DataFrame], columns: list[str] | None = None) -> DataFrame:
    """(version_id, column, value, num, cnt) over all versions in one grouped aggregation.

    Repeated values collapse before the shuffle, so a hot value costs one row per map task.
    Missing cells are the row where both ``value`` and ``num`` are NULL.
    """
    cells = union_all([long_form(df, vid, columns) for vid, df in versions.items()])
    return cells.groupBy("version_id", "column", "value", "num").agg(F.count(F.lit(1)).alias("cnt"))


def is_missing():
    return F.col("value").isNull() & F.col("num").isNull()
