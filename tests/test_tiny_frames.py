"""Small version pairs with known results."""

import pytest
from pyspark.sql import functions as F


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


@pytest.fixture
def drifted(compare):
    return compare(
        "age long, score long, placed string", [(20, 40, "no"), (21, 50, "no"), (22, 60, "yes"), (23, 70, "yes")],
        "age long, score long, placed string", [(20, 40, "no"), (21, 50, "no"), (22, None, "no"), (80, 95, "yes"), (80, 95, "yes")],
        "placed",
    )


def test_drift_between_versions(drifted):
    rows = one(drifted.diff.rows)
    assert (rows["rows_added"], rows["rows_removed"], rows["rows_unchanged"]) == (3, 2, 2)
    scores = one(drifted.diff.scores)
    assert scores["scm_score"] == pytest.approx(25.48, abs=0.001)
    assert scores["dsi_score"] == pytest.approx(84.457, abs=0.001)
    assert (scores["scm_schema"], scores["scm_rows"], scores["scm_missingness"], scores["scm_categorical_structure"]) == (10.0, 55.556, 11.333, 5.126)
    shifts = {r["column"]: r["shift_score"] for r in drifted.diff.shifts.collect()}
    assert shifts == {"age": 100.0, "score": 52.174, "placed": 8.544}
    changed = one(drifted.diff.paired.where("dtype_changed"))
    assert (changed["column"], changed["previous_logical_dtype"], changed["current_logical_dtype"]) == ("score", "int64", "float64")


def test_drift_profile(drifted):
    assert one(drifted.tables.where("version_id = 2"))["duplicate_rows"] == 1
    pair = one(drifted.correlations.where("version_id = 2"))
    assert (pair["left"], pair["right"], pair["correlation"]) == ("age", "score", 0.991742)
    skew = {r["column"]: r["skewness"] for r in drifted.columns.where("version_id = 2 and is_numeric").collect()}
    assert skew["age"] == pytest.approx(0.606397, abs=1e-6) and skew["score"] == pytest.approx(-0.100882, abs=1e-6)
    assert one(drifted.classification.where("version_id = 2"))["minority_class"] == "yes"


def test_drift_readiness(drifted):
    parts = {r["component"]: round(r["score"], 2) for r in drifted.components.where("version_id = 2 and family = 'mlrs'").collect()}
    assert parts == {
        "missingness": 17.67, "duplicates": 10.0, "imbalance": 4.8, "outliers": 0.0, "correlation_redundancy": 10.0, "target_quality": 1.2, "evolution_readiness": 15.0,
    }
    assert one(drifted.risks.where("version_id = 2"))["mlrs_score"] == 58.67


def test_identical_versions(compare):
    rows = [(1, 20, "no"), (2, 21, "yes"), (3, 22, "yes")]
    ev = compare("id long, age long, placed string", rows, "id long, age long, placed string", rows, "placed")
    scores, diff = one(ev.diff.scores), one(ev.diff.rows)
    assert (scores["scm_score"], scores["dsi_score"]) == (0.0, 0.0)
    assert (diff["method"], diff["rows_unchanged"], diff["rows_modified"]) == ("stable_identifier_hash", 3, 0)


def test_doubled_size_is_no_drift(compare):
    rows = [(10, "a", 0), (20, "a", 1), (30, "b", 0), (40, "b", 1)]
    schema = "score long, segment string, target long"
    scores = one(compare(schema, rows, schema, rows * 2, "target").diff.scores)
    assert (scores["dsi_score"], scores["scm_rows"], scores["scm_score"]) == (0.0, 33.333, 11.667)


def test_stable_identifier(compare):
    schema = "EmployeeID long, salary long, status string"
    ev = compare(schema, [(1, 10, "new"), (2, 20, "new"), (3, 30, "old")], schema, [(1, 10, "new"), (2, 25, "new"), (4, 40, "new")], "status")
    rows, scores = one(ev.diff.rows), one(ev.diff.scores)
    assert (rows["rows_added"], rows["rows_removed"], rows["rows_modified"], rows["rows_unchanged"]) == (1, 1, 1, 1)
    assert (scores["scm_rows"], scores["scm_categorical_structure"], scores["scm_score"], scores["dsi_score"]) == (75.0, 46.213, 33.182, 38.376)
    assert {r["column"]: r["shift_score"] for r in ev.diff.shifts.collect()} == {"EmployeeID": 22.222, "salary": 30.769, "status": 43.689}


def test_readiness_improves_while_change_is_high(compare):
    ev = compare(
        "x double, target string", [(1.0, "yes"), (None, "yes"), (None, "yes"), (1000.0, "yes"), (1000.0, "no")],
        "x long, target string, new_feature long", [(1, "yes", 9), (2, "no", 8), (3, "yes", 7), (4, "no", 6), (5, "yes", 5)],
        "target",
    )
    mlrs = {r["version_id"]: r["mlrs_score"] for r in ev.risks.collect()}
    scores = one(ev.diff.scores)
    assert mlrs == {1: 51.12, 2: 16.0}
    assert (scores["scm_score"], scores["dsi_score"]) == (39.58, 100.0)


def test_repaired_file_pair(compare):
    v1 = [(20, 40, "no"), (21, 50, "no"), (22, None, "no"), (23, 70, "yes"), (24, 80, "yes")]
    v2 = [(20, 40, "no"), (21, 50, "no"), (22, 60, "no"), (23, 70, "yes"), (24, 80, "yes"), (25, 90, "yes")]
    schema = "age long, score long, placed string"
    ev = compare(schema, v1, schema, v2, "placed")
    rows, scores = one(ev.diff.rows), one(ev.diff.scores)
    assert (rows["rows_added"], rows["rows_removed"], rows["rows_unchanged"]) == (2, 1, 4)
    assert (scores["scm_score"], scores["dsi_score"]) == (15.581, 23.909)
    assert {r["version_id"]: r["mlrs_score"] for r in ev.risks.collect()} == {1: 33.67, 2: 10.0}


def test_swapping_sides_exchanges_added_and_removed(compare):
    a = [(1, "x"), (1, "x"), (2, "y")]
    b = [(1, "x"), (3, "z"), (4, None), (4, None)]
    schema = "n long, t string"
    there, back = one(compare(schema, a, schema, b, None).diff.rows), one(compare(schema, b, schema, a, None).diff.rows)
    assert (there["rows_added"], there["rows_removed"]) == (back["rows_removed"], back["rows_added"]) == (3, 2)
    assert there["rows_unchanged"] == back["rows_unchanged"] == 1


def test_edge_cases_profile(spark, compare):
    schema = "constant long, empty double, flag boolean, nan double"
    ev = compare(schema, [(7, None, True, float("nan")), (7, None, False, 2.0), (7, None, None, 2.0)], schema, [(7, None, True, 1.0)], None, "clustering")
    got = {(r["version_id"], r["column"]): r for r in ev.columns.collect()}
    constant, empty, flag, nan = (got[1, c] for c in ("constant", "empty", "flag", "nan"))
    assert (constant["std"], constant["skewness"], constant["outlier_count"]) == (0.0, 0.0, 0)
    assert (empty["missing_count"], empty["unique_count"], empty["mean"]) == (3, 0, None)
    assert (flag["is_numeric"], flag["logical_dtype"], flag["missing_count"]) == (False, "object", 1)
    assert (nan["missing_count"], nan["max"]) == (1, 2.0)
    assert got[2, "constant"]["std"] is None  # one row has no sample deviation


def test_leakage_from_associations(spark):
    from lakewitness.operators import diagnosis

    columns = spark.createDataFrame(
        [(1, "EmployeeID", "feature", 1.0), (1, "placed", "target", 0.5), (1, "placed_label_copy", "feature", 0.5)],
        "version_id long, column string, role string, unique_ratio double",
    )
    configs = spark.createDataFrame([(1, "placed")], "version_id long, target_column string")
    pairs = spark.createDataFrame([(1, "placed", "placed_label_copy", 1.0)], "version_id long, left string, right string, correlation double")
    kinds = {(r["column"], r["kind"]) for r in diagnosis.leakage_features(columns, pairs, configs).collect()}
    assert kinds == {
        ("placed_label_copy", "direct"), ("placed_label_copy", "target_like"), ("placed_label_copy", "post_outcome"), ("EmployeeID", "identifier"),
    }
    points = spark.range(1).select(
        *[diagnosis.diminishing(F.lit(1), *p).alias(n) for n, p in {"a": (22.0, 35.0), "b": (3.0, 8.0), "c": (7.0, 18.0), "d": (2.5, 8.0)}.items()]
    ).first()
    assert sum(points) == pytest.approx(34.5)


def test_target_associations(spark):
    from lakewitness.operators import diagnosis

    rows = [("yes", "yes", "n", i // 5, i) if i % 3 else ("no", "no", "y", i // 5, i) for i in range(30)]
    df = spark.createDataFrame(rows, "target string, copy string, inverse string, loose long, id long")
    got = {r["feature"]: r["association_type"] for r in diagnosis.target_associations(df, 1, "target").collect()}
    assert got == {"copy": "exact_copy", "inverse": "inverse_mapping"}


def test_correlation_clusters(spark):
    from lakewitness.operators import diagnosis

    pairs = spark.createDataFrame(
        [(1, "a", "b", 0.9), (1, "b", "c", 0.9), (1, "d", "e", -0.9), (1, "e", "t", 0.95), (2, "x", "y", 0.8)],
        "version_id long, left string, right string, correlation double",
    )
    configs = spark.createDataFrame([(1, "t"), (2, None)], "version_id long, target_column string")
    got = {(r["version_id"], r["cluster"], r["column"], r["size"]) for r in diagnosis.correlation_clusters(pairs, configs).collect()}
    assert got == {(1, "a", "a", 3), (1, "a", "b", 3), (1, "a", "c", 3), (1, "d", "d", 2), (1, "d", "e", 2), (2, "x", "x", 2), (2, "x", "y", 2)}
