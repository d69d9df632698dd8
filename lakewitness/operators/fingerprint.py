"""Fingerprints, recreation bundles and their verification."""

from __future__ import annotations

from decimal import Decimal
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewitness.functions.columns import portable_digests
from lakewitness.lookups import FINGERPRINT_ALGORITHM
from lakewitness.operators.value_counts import union_all
from lakewitness.session import together

V = "version_id"


def text(value: Column) -> Column:
    """A JSON string with quotes, backslashes and control characters escaped; null stays null."""
    one = F.to_json(F.array(value))
    return F.substring(one, F.lit(2), F.length(one) - 2)


def sha(value: Column) -> Column:
    return F.sha2(value, 256)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of whole files. A file must fit one row; larger tables use ``content_hashes``."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", sha(F.col("content")).alias("file_hash"))


def _listed(order: Column, item: Column) -> Column:
    """Items in the given order, joined by commas; one entry per column of a version."""
    pairs = F.array_sort(F.collect_list(F.struct(order.alias("o"), item.alias("x"))))
    return F.array_join(F.transform(pairs, lambda p: p["x"]), ",")


def schema_hashes(columns: DataFrame) -> DataFrame:
    """Names and types in column order."""
    item = F.concat(F.lit('{"dtype":'), text(F.col("logical_dtype")), F.lit(',"name":'), text(F.col("column")), F.lit("}"))
    return columns.groupBy(V).agg(sha(F.concat(F.lit("["), _listed(F.col("position"), item), F.lit("]"))).alias("schema_hash"))


def metadata_hashes(columns: DataFrame, tables: DataFrame) -> DataFrame:
    """Shape, names, types, missing counts and duplicates, keys in sorted order."""
    entry = lambda value: F.concat(text(F.col("column")), F.lit(":"), value)
    parts = columns.groupBy(V).agg(
        _listed(F.col("position"), text(F.col("column"))).alias("names"),
        _listed(F.col("column"), entry(text(F.col("logical_dtype")))).alias("types"),
        _listed(F.col("column"), entry(F.col("missing_count").cast("string"))).alias("missing"),
    )
    doc = F.format_string(
        '{"column_count":%d,"column_names":[%s],"data_types":{%s},"duplicate_count":%d,"missing_total":%d,"missing_values":{%s},"row_count":%d}',
        "column_count", "names", "types", "duplicate_rows", "missing_cells", "missing", "row_count",
    )
    return tables.join(parts, V).select(V, sha(doc).alias("metadata_hash"))


def configuration_hashes(configurations: DataFrame) -> DataFrame:
    """C4: task and configuration, keys in sorted order."""
    features = F.array_join(F.transform(F.coalesce("selected_features", F.array().cast("array<string>")), text), ",")
    t = lambda c: text(F.col(c))
    doc = F.concat(
        F.lit('{"feature_selection_mode":'), t("feature_selection_mode"), F.lit(',"primary_metric":'), t("primary_metric"),
        F.lit(',"scaling_strategy":'), t("scaling_strategy"), F.lit(',"selected_features":['), features,
        F.lit('],"target_column":'), t("target_column"), F.lit(',"task_type":'), t("task_type"),
        F.lit(',"validation_strategy":'), t("validation_strategy"), F.lit("}"),
    )
    return configurations.select(V, sha(doc).alias("configuration_hash"))


# Hexadecimal digits of a row's digest in each of the sums: 60 bits, added up in pieces of so many bits.
PART = 15
PIECE = 20


def content_hash(df: DataFrame) -> DataFrame:
    """Digest of the rows as a multiset, whatever their order or partitioning: one row.

    A row's SHA-256, over cell texts that any engine can make, is cut into four numbers of 60 bits. They are added up over all
    rows, each in three pieces of 20 bits whose sums fit long integers, so a few numbers per task are shuffled, and the hash
    is that of the count and the four sums.
    """
    pieces = range(0, PART * 4, PIECE)
    parts = portable_digests(df, df.columns, "d").select(*[F.conv(F.substring("d", 1 + i * PART, PART), 16, 10).cast("long").alias(f"p{i}") for i in range(4)])
    piece = lambda i, at: F.shiftright(f"p{i}", at).bitwiseAND(F.lit(2**PIECE - 1).cast("long"))
    sums = parts.agg(F.count(F.lit(1)).alias("row_count"), *[F.coalesce(F.sum(piece(i, at)), F.lit(0)).alias(f"s{i}_{at}") for i in range(4) for at in pieces])
    whole = lambda i: sum((F.col(f"s{i}_{at}").cast("decimal(20,0)") * F.lit(Decimal(2**at)) for at in pieces[1:]), F.col(f"s{i}_0").cast("decimal(20,0)"))
    return sums.select("row_count", sha(F.concat_ws("|", F.col("row_count").cast("string"), *[whole(i).cast("decimal(38,0)").cast("string") for i in range(4)])).alias("content_hash"))


def content_hashes(versions: dict[int, DataFrame]) -> DataFrame:
    def hashed(v: int, df: DataFrame) -> DataFrame:
        return content_hash(df).withColumn(V, F.lit(v).cast("long"))

    # Making the plans alone takes a while: a table has some dozen expressions for each column.
    return union_all(together(next(iter(versions.values())).sparkSession, [partial(hashed, v, df) for v, df in versions.items()]))


def fingerprints(content: DataFrame, schemas: DataFrame, metadata: DataFrame, configurations: DataFrame) -> DataFrame:
    """All hashes of a version and the one over them."""
    t = lambda c: text(F.col(c))
    doc = F.concat(
        F.lit(f'{{"algorithm":"{FINGERPRINT_ALGORITHM}","configuration":'), t("configuration_hash"), F.lit(',"file":'), t("content_hash"),
        F.lit(',"metadata":'), t("metadata_hash"), F.lit(',"schema":'), t("schema_hash"), F.lit("}"),
    )
    return content.join(schemas, V).join(metadata, V).join(configurations, V).select(
        V, "row_count", "content_hash", "schema_hash", "metadata_hash", "configuration_hash",
        sha(doc).alias("combined_fingerprint"), F.lit(FINGERPRINT_ALGORITHM).alias("fingerprint_algorithm"),
    )


CHECKS = ["content_hash", "schema_hash", "metadata_hash", "configuration_hash", "combined_fingerprint", "fingerprint_algorithm"]


def recreation_bundles(versions: DataFrame, prints: DataFrame) -> DataFrame:
    """Everything needed to tell whether a table is this version again."""
    return versions.join(prints.drop("row_count"), V).select(
        V, "study_id", "dataset_id", "dataset_name", "version_number", "parent_version_id", "version_notes", "row_count", "column_count", *CHECKS,
        "task_type", "target_column", "primary_metric", "validation_strategy", "feature_selection_mode", "selected_features", "scaling_strategy",
    )


def verify_recreation(candidates: DataFrame, bundles: DataFrame) -> DataFrame:
    """Candidates (with ``bundle_id``) against bundles: six checks, those without an expected value left out."""
    facts = [F.col(c).alias(f"is_{c}") for c in [*CHECKS, "row_count", "column_count"]]
    expected = bundles.select(F.col(V).alias("bundle_id"), *[F.col(c).alias(f"want_{c}") for c in [*CHECKS, "row_count", "column_count"]])
    both = candidates.select(V, "bundle_id", *facts).join(expected, "bundle_id")
    known = [F.col(f"want_{c}").isNotNull() for c in CHECKS]
    hit = [F.coalesce(F.col(f"is_{c}") == F.col(f"want_{c}"), F.lit(False)) for c in CHECKS]
    total = sum((k.cast("int") for k in known), F.lit(0))
    passed = sum(((k & h).cast("int") for k, h in zip(known, hit)), F.lit(0))
    rows = F.col("is_row_count") - F.coalesce("want_row_count", "is_row_count")
    cols = F.col("is_column_count") - F.coalesce("want_column_count", "is_column_count")
    return both.select(
        V,
        "bundle_id",
        *[h.alias(f"{c}_matched") for c, h in zip(CHECKS, hit)],
        passed.alias("passed_checks"),
        total.alias("total_checks"),
        F.when(total > 0, F.round(passed / total * 100, 2)).otherwise(0.0).alias("similarity_rate"),
        rows.alias("row_delta"),
        cols.cast("long").alias("column_delta"),
        ((rows == 0) & (cols == 0)).alias("shape_match"),
        ((total > 0) & (passed == total)).alias("matched"),
    )
