"""Reading tables: delimited text with inferred types, and columnar files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewitness.functions.columns import q
from lakewitness.lookups import MISSING_TOKENS, TRUE_FALSE

WHOLE = r"^\s*[+-]?\d+\s*$"
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$|^\s*[+-]?(?i:inf|infinity)\s*$"


class InputError(ValueError):
    """The input is not a usable table."""


def headers(spark: SparkSession, path: str) -> list[str]:
    """The different first lines of the files under a path: one pass over their text, which counts a file's lines from its first split."""
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at"))
    first = lines.where("file_block_start = 0").groupBy("file_path").agg(F.min_by("value", "at").alias("line"))
    return sorted(r["line"] for r in first.select("line").distinct().limit(2).collect())


def scan_csv(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """A1: header, missing tokens, and types decided by one aggregation over all rows.

    Rows with fewer fields than the header end in missing cells; rows with more are refused, and so are files whose headers
    differ, in names or only in their order. Whole numbers that
    64 bits can't hold make a column fractional. Dates stay text. ``multiline`` is needed for quoted line breaks; it makes files unsplittable, so
    it is off unless asked for.
    """
    options = {"escape": '"', "multiLine": multiline, "encoding": "UTF-8"}
    head = spark.read.options(**options).csv(path).take(1)
    if not head:
        raise InputError("the input is empty")
    names = list(head[0])
    if not names or any(n is None or not n.strip() for n in names):
        raise InputError("every column needs a name")
    if len(set(names)) != len(names):
        raise InputError("column names are repeated")
    if len(spark.read.text(path).inputFiles()) > 1 and len(headers(spark, path)) > 1:
        raise InputError("the files have different headers")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    beyond = "_" * (1 + max(map(len, names))) + "beyond"
    wide = T.StructType([*schema.fields, T.StructField(beyond, T.StringType())])
    raw = spark.read.options(**options, header=True, enforceSchema=True, mode="PERMISSIVE").schema(wide).csv(path)
    text = raw.select(*[F.when(~q(n).isin(*MISSING_TOKENS), q(n)).alias(n) for n in names], q(beyond))
    counts = text.agg(
        *[
            e.alias(f"{k}{i}")
            for i, n in enumerate(names)
            for k, e in (
                ("n", F.count(q(n))),
                ("all", F.count(F.lit(1))),
                ("whole", F.count_if(q(n).rlike(WHOLE) & F.trim(q(n)).try_cast("long").isNotNull())),
                ("number", F.count_if(q(n).rlike(NUMBER))),
                ("flag", F.count_if(q(n).isin(*TRUE_FALSE))),
            )
        ],
        F.count(q(beyond)).alias("beyond"),
    ).first()
    if counts["beyond"]:
        raise InputError(f"{counts['beyond']} rows have more fields than the header")

    def typed(i: int, name: str):
        n = counts[f"n{i}"]
        if n and counts[f"whole{i}"] == n:
            return F.trim(q(name)).cast("long")
        if counts[f"number{i}"] == n:  # an empty column counts as numeric
            return F.trim(q(name)).cast("double")
        if n == counts[f"all{i}"] and counts[f"flag{i}"] == n:
            return q(name).cast("boolean")
        return q(name)

    return text.select(*[typed(i, n).alias(n) for i, n in enumerate(names)])


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Columnar input; dates and timestamps are treated as text, as in delimited input."""
    df = spark.read.parquet(path)
    dates = (T.DateType, T.TimestampType, T.TimestampNTZType)
    return df.select(*[q(f.name).cast("string").alias(f.name) if isinstance(f.dataType, dates) else q(f.name) for f in df.schema.fields])


def ingest(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    readers = {"csv": scan_csv, "parquet": scan_parquet}
    if fmt not in readers:
        raise InputError(f"unknown format {fmt}")
    return readers[fmt](spark, path)
