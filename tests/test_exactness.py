"""No size, width or length changes a result."""

from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakewitness.operators import diagnosis, diff, fingerprint, history, profile
from lakewitness.operators.value_counts import column_catalog, value_counts
from lakewitness.sources import ingest

BIG = 2**53


def duplicates(df):
    return profile.duplicate_rows({1: df}).first()["duplicate_rows"]


def test_neighbours_of_the_largest_exact_number_differ(spark):
    df = spark.createDataFrame([(BIG, 1.0), (BIG + 1, 1.0), (BIG + 1, 1.0)], "id long, x double")
    assert duplicates(df) == 1
    assert diagnosis.conflicting_duplicates(df.selectExpr("id", "cast(id % 2 as int) as y"), 1, "y").first()["conflicting_rows"] == 0
    other = df.selectExpr("if(id = 9007199254740993, 9007199254740992, id) as id", "x")
    assert fingerprint.content_hash(df).first() != fingerprint.content_hash(other).first()
    row = diff.keyed_row_diff(1, df.distinct(), df.distinct(), ["id"]).first()
    assert row["rows_unchanged"] == 2
    assert diagnosis.split_overlap(spark.createDataFrame([(BIG, "a"), (BIG + 1, "b")], "id long, s string"), 1, "s", ["id"]).first()["overlapping_entities"] == 0


def test_both_zeros_are_one_and_near_numbers_two(spark):
    assert duplicates(spark.createDataFrame([(0.0,), (-0.0,)], "x double")) == 1
    near = spark.createDataFrame([(0.1 + 0.2,), (0.3,)], "x double")
    assert duplicates(near) == 0
    # a row comparison rounds the cells that are no key
    a = spark.createDataFrame([(1, 0.3)], "id long, x double")
    b = spark.createDataFrame([(1, 0.1 + 0.2)], "id long, x double")
    assert diff.keyed_row_diff(1, a, b, ["id"]).first()["rows_unchanged"] == 1


def test_decimals_keep_their_digits(spark):
    rows = [(Decimal("12345678901234567890.01"),), (Decimal("12345678901234567890.02"),), (Decimal("0.50"),)]
    df = spark.createDataFrame(rows, "x decimal(30,2)")
    assert duplicates(df) == 0
    assert value_counts({1: df}).count() == 3


def test_whole_and_fractional_columns_compare(spark):
    a = spark.createDataFrame([(1, 5), (2, 7)], "id long, x long")
    b = spark.createDataFrame([(1, 5.0), (2, None)], "id long, x double")
    row = diff.keyed_row_diff(1, a, b, ["id"]).first()
    assert (row["rows_unchanged"], row["rows_modified"]) == (1, 1)


def test_long_labels_are_shown_whole(spark):
    label = "x" * 300
    df = spark.createDataFrame([(label,), (label,), (label + "y",)], "t string")
    vc = value_counts({1: df})
    top = profile.top_values(vc, column_catalog(spark, {1: df})).orderBy("rank").collect()
    assert [r["value"] for r in top] == [label, label + "y"]


@pytest.mark.parametrize("width", [3, 201, 405])
def test_correlation_of_any_width(spark, width):
    r = np.random.default_rng(width)
    x = r.normal(size=(40, width))
    x[:, -1] = x[:, 0] * 2 + 1e9
    schema = ", ".join(f"c{i} double" for i in range(width))
    got = profile.high_correlations({1: spark.createDataFrame(x.tolist(), schema)}, 0.8).collect()
    want = np.corrcoef(x.T)
    pairs = {(f"c{i}", f"c{j}"): round(want[i, j], 6) for i in range(width) for j in range(i + 1, width) if abs(want[i, j]) >= 0.8}
    assert ("c0", f"c{width - 1}") in pairs
    assert {(g["left"], g["right"]): pytest.approx(g["correlation"], abs=2e-6) for g in got} == pairs


def test_paths_of_large_version_numbers(spark):
    versions = spark.createDataFrame([(1, None, 1), (2, 1, 999999), (3, 1, 1000000), (4, 1, 10000001)], "version_id long, parent_version_id long, version_number long")
    paths = [r["version_id"] for r in history.lineage_tree(versions).orderBy("path").collect()]
    assert paths == [1, 2, 3, 4]


def test_pair_numbers_do_not_meet(spark):
    df = spark.createDataFrame([(1, 1000002), (2, 2), (1, 2**31 - 1)], "a long, b long").select(diff.pair_number(F.col("a"), F.col("b")).alias("p"))
    assert len({r["p"] for r in df.collect()}) == 3
    with pytest.raises(Exception, match="below 2"):
        spark.createDataFrame([(2**31, 1)], "a long, b long").select(diff.pair_number(F.col("a"), F.col("b"))).collect()


def test_delimited_input_keeps_long_ids(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("id,huge,x,y\n1234567890123456789,99999999999999999999,inf,a\n-5,1,2.5\n")
    df = ingest.scan_csv(spark, str(path))
    assert dict(df.dtypes) == {"id": "bigint", "huge": "double", "x": "double", "y": "string"}
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(-5, 1.0, 2.5, None), (1234567890123456789, 1e20, float("inf"), "a")]
    path.write_text("a,b\n1,2,3\n")
    with pytest.raises(ingest.InputError, match="more fields"):
        ingest.scan_csv(spark, str(path))


def test_json_strings_are_escaped(spark):
    got = spark.sql(r"SELECT 'a\"\\b\n' AS x").select(fingerprint.text(F.col("x"))).first()[0]
    assert got == '"a\\"\\\\b\\n"'
