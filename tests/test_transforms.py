"""Preprocessing steps against pandas, and the statistical steps against their defining properties."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lakewitness.operators import isolation, resample, transforms as t


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"x": rng.normal(size=200), "y": rng.gamma(2.0, size=200), "s": rng.choice(["a", "b", "c"], 200), "label": ["p"] * 160 + ["q"] * 40})
    frame.loc[::9, "x"] = np.nan
    frame.loc[::11, "s"] = None
    rows = [tuple(None if pd.isna(v) else v for v in r) for r in frame.itertuples(index=False)]
    return frame, spark.createDataFrame(rows, "x double, y double, s string, label string").repartition(4)


CTX = lambda: t.Context(target="label")


def columns(df, *names):
    return {n: sorted((r[n] for r in df.collect()), key=lambda v: (v is None, v)) for n in names}


def test_median_imputation(table):
    frame, df = table
    got = columns(t.median_imputation(df, CTX()), "x", "s")
    assert got["x"] == pytest.approx(sorted(frame["x"].fillna(frame["x"].median())))
    assert got["s"] == sorted(frame["s"].fillna(frame["s"].mode()[0]))


def test_standard_scaler_equals_population_form(table):
    frame, df = table
    filled = frame["x"].fillna(frame["x"].median())
    assert columns(t.standard_scaler(df, CTX()), "x")["x"] == pytest.approx(sorted((filled - filled.mean()) / filled.std(ddof=0)))


def test_label_encoding_sorted_codes(table):
    frame, df = table
    got = columns(t.label_encoding(df, CTX()), "s")["s"]
    expected = sorted(frame["s"].dropna().map({"a": 0.0, "b": 1.0, "c": 2.0}))
    assert got[: len(expected)] == expected and set(got[len(expected) :]) == {None}


@pytest.mark.parametrize("partitions", ["1", "16"])
def test_ranks_of_many_values(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        values = spark.range(1000).select(F.format_string("v%05d", "id").alias("label"))
        got = {r["label"]: r["code"] for r in t.ranks(values, "label").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == {f"v{i:05d}": float(i) for i in range(1000)}


def test_label_encoding_has_no_nested_loop(spark):
    df = spark.range(500).select(F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("s"), "id")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for size in (threshold, "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
            out = t.label_encoding(df, t.Context())
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "NestedLoop" not in plan and "Cartesian" not in plan
            order = sorted(str(i) for i in range(500) if i % 3)
            assert {(r["id"], r["s"]) for r in out.collect()} == {(i, float(order.index(str(i))) if i % 3 else None) for i in range(500)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_quantiles_are_exact(table):
    from lakewitness.operators import fits

    _, df = table
    probs = [0.1, 0.5, 0.75]
    for name, values in fits.quantiles(df, ["x", "y"], probs).items():
        assert values == pytest.approx(df.agg(F.percentile(F.col(name).cast("double"), probs)).first()[0])


def test_failing_step_is_skipped(table):
    _, df = table
    ctx = CTX()
    out = t.apply_steps(df, [("no_such_step", {}), ("minmax_scaler", {})], ctx)
    assert ctx.applied == ["minmax_scaler"] and ctx.failed[0][0] == "no_such_step"
    low, high = out.agg(F.min("y"), F.max("y")).first()
    assert (low, high) == (0.0, 1.0)


def test_all_missing_column_stays_missing(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0)], "empty double, x double")
    for step in (t.median_imputation, t.standard_scaler, t.robust_scaler, t.minmax_scaler, t.clip_outliers):
        assert [r["empty"] for r in step(df, t.Context()).collect()] == [None, None]


def test_correlation_filter_drops_smaller_variance(spark):
    df = spark.range(50).select(F.col("id").cast("double").alias("a"), (F.col("id") * 3.0).alias("b"), F.sin("id").alias("c"))
    assert t.correlation_filter(df, t.Context()).columns == ["b", "c"]


@pytest.mark.parametrize("step, size", [(resample.random_oversampling, 160), (resample.random_undersampling, 40)])
def test_class_sizes_are_exact_whatever_the_partitions(table, step, size):
    _, df = table
    rows = lambda d: sorted(map(repr, step(d, CTX()).collect()))
    first = rows(df)
    assert len(first) == 2 * size and first == rows(df.repartition(13))


def test_hot_copies_are_sampled_exactly(spark, monkeypatch):
    monkeypatch.setattr(resample, "COPY_CHUNK", 50)
    df = spark.range(900).select(F.when(F.col("id") < 600, 0).otherwise(F.col("id")).alias("v"), F.when(F.col("id") < 800, "p").otherwise("q").alias("label"))
    out = resample.random_undersampling(df, CTX()).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in out} == {"p": 100, "q": 100}
    out = resample.random_oversampling(df, CTX()).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in out} == {"p": 800, "q": 800}


@pytest.mark.parametrize("partitions", [1, 4, 64])
@pytest.mark.parametrize("step", [resample.random_oversampling, resample.random_undersampling, resample.smote, resample.adasyn, isolation.isolation_forest])
def test_draws_do_not_follow_the_partitions(table, step, partitions):
    _, df = table
    rows = lambda d: sorted(repr([round(x, 9) if isinstance(x, float) else x for x in r]) for r in step(d, CTX()).collect())
    assert rows(df) == rows(df.repartition(partitions))


def test_many_classes_without_a_map(spark):
    df = spark.range(60_000).select(F.col("id").alias("v"), F.when(F.col("id") < 30, 0).otherwise(F.floor(F.col("id") / 2)).cast("string").alias("label"))
    out = resample.random_undersampling(df, CTX())
    assert "map" not in out._jdf.queryExecution().executedPlan().toString().lower().replace("mapp", "")
    sizes = out.groupBy("label").count()
    assert sizes.count() == 29_986 and sizes.agg(F.max("count")).first()[0] == 2


@pytest.mark.parametrize("dims", [1, 3])
@pytest.mark.parametrize("block", [4096, 16])
def test_neighbours_equal_brute_force(spark, monkeypatch, block, dims):
    monkeypatch.setattr(resample, "BLOCK", block)
    rng = np.random.default_rng(8)
    pts = np.round(rng.normal(size=(150, dims)) * ([5.0, 1.0, 1.0][:dims]), 1)
    pts[:40] = pts[0]  # equal points fill a cell that cannot be split
    rows = [("gh"[i % 2], str(i), [float(v) for v in p], "c", True) for i, p in enumerate(pts)]
    df = spark.createDataFrame(rows, "grp string, pid string, vec array<double>, payload string, ask boolean")
    got = {}
    for r in resample.neighbours(df, 4, dims).collect():
        got.setdefault(int(r["qid"]), []).append((r["rank"], r["distance"]))
    for i, p in enumerate(pts):
        mates = [j for j in range(150) if j % 2 == i % 2 and j != i]
        assert [d for _, d in sorted(got[i])] == pytest.approx(np.sort(np.linalg.norm(pts[mates] - p, axis=1))[:4])


def test_queries_meet_only_cells_within_reach(spark, monkeypatch):
    monkeypatch.setattr(resample, "BLOCK", 50)
    rng = np.random.default_rng(3)
    pts = rng.random((4000, 2))
    df = spark.createDataFrame([("g", str(i), [float(v) for v in p], "c", True) for i, p in enumerate(pts)], "grp string, pid string, vec array<double>, payload string, ask boolean")
    held, splits, depth = resample.partition_tree(df, 2)
    cells = held.groupBy("cell").count().agg(F.count(F.lit(1)), F.max("count")).first()
    assert cells[0] >= 80 and cells[1] <= 50 and depth <= 9
    reach = held.select("grp", F.col("pid").alias("qid"), "vec", F.lit(0.02).alias("reach"))
    met = resample.reached_cells(reach, splits, depth)
    assert "CartesianProduct" not in met._jdf.queryExecution().executedPlan().toString()
    fan = met.groupBy("qid").count().agg(F.avg("count"), F.max("count")).first()
    assert fan[0] < 2.5 and fan[1] <= 9


@pytest.mark.parametrize("block", [4096, 8])
def test_smote_rows_lie_between_a_row_and_a_near_one(table, monkeypatch, block):
    frame, df = table
    monkeypatch.setattr(resample, "BLOCK", block)
    numeric = [c for c in df.columns if c != "label" and dict(df.dtypes)[c] != "string"]
    mine = frame[frame["label"] == "q"][numeric].astype(float)
    pts = mine.fillna(frame[numeric].astype(float).median()).to_numpy()
    made = resample.smote(df, CTX()).where("label = 'q'").toPandas()[numeric].astype(float).to_numpy()
    new = [m for m in made if not np.isnan(m).any() and np.abs(pts - m).sum(axis=1).min() > 1e-9]
    assert len(new) > 20
    for m in new:
        found = False
        for i, p in enumerate(pts):
            order = np.argsort(np.linalg.norm(pts - p, axis=1), kind="stable")
            far = np.linalg.norm(pts[order[5]] - p) + 1e-9
            for j in np.flatnonzero(np.linalg.norm(pts - p, axis=1) <= far):
                line = pts[j] - p
                size = line @ line
                if size and 0 <= (at := (m - p) @ line / size) <= 1 + 1e-9 and np.allclose(p + at * line, m, atol=1e-7):
                    found = True
                    break
            if found:
                break
        assert found


@pytest.mark.parametrize("block", [4096, 8])
def test_smote_balances_inside_the_class_range(table, monkeypatch, block):
    frame, df = table
    monkeypatch.setattr(resample, "BLOCK", block)
    out = resample.smote(df, CTX())
    made = out.where("label = 'q'").agg(F.count(F.lit(1)), F.min("y"), F.max("y")).first()
    mine = frame[frame["label"] == "q"]["y"]
    assert made[0] == 160 and made[1] >= mine.min() - 1e-9 and made[2] <= mine.max() + 1e-9


def test_smote_of_a_class_of_copies(spark):
    rows = [(1.0, "q")] * 30 + [(float(i), "p") for i in range(60)]
    out = resample.smote(spark.createDataFrame(rows, "x double, label string"), CTX())
    assert out.where("label = 'q'").count() == 60 and out.where("label = 'q' and x <> 1.0").count() == 0


def test_adasyn_grows_near_other_classes(table):
    _, df = table
    sizes = {r["label"]: r["count"] for r in resample.adasyn(df, CTX()).groupBy("label").count().collect()}
    assert sizes["p"] == 160 and abs(sizes["q"] - 160) <= 20


def test_isolation_forest_removes_planted_rows(spark):
    rng = np.random.default_rng(4)
    rows = [tuple(map(float, r)) for r in rng.normal(size=(600, 2))] + [(15.0 + i, -15.0 - i) for i in range(5)]
    kept = isolation.isolation_forest(spark.createDataFrame(rows, "a double, b double"), t.Context())
    assert kept.where("a > 10").count() == 0 and kept.count() > 480
