"""Order statistics split into ranges against plain computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakewitness.functions import wide
from lakewitness.functions.ordered import numbered_rows


@pytest.mark.parametrize("partitions", [1, 7])
@pytest.mark.parametrize("n", [1, 2, 3, 5, 40, 3000])
def test_wide_quantiles(spark, n, partitions):
    rng = np.random.default_rng(n)
    rows = [(float(rng.normal()), float(rng.integers(0, 5)), None if rng.random() < 0.3 else float(rng.exponential()), None, 4.0) for _ in range(n)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double").repartition(partitions)
    probs = [0.0, 0.01, 0.25, 0.5, 0.77, 0.99, 1.0]
    tables = {"t": (df, {c: F.col(c) for c in df.columns})}
    figures = wide.moments(tables)
    wide.add_quantiles(tables, figures, probs, deviations=True)
    for i, c in enumerate(df.columns):
        flat = np.array([r[i] for r in rows if r[i] is not None])
        f = figures["t", c]
        assert f.n == len(flat)
        if len(flat):
            assert f.quantiles == pytest.approx(np.quantile(flat, probs).tolist())
            assert (f.low, f.high, f.mean) == (flat.min(), flat.max(), pytest.approx(flat.mean()))
            assert (f.m2, f.m3) == (pytest.approx(((flat - flat.mean()) ** 2).sum()), pytest.approx(((flat - flat.mean()) ** 3).sum(), abs=1e-9))
        else:
            assert f.quantiles == [None] * len(probs)


def test_wide_passes_join_and_shuffle_no_values(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("a"), (F.col("id") * 2.0).alias("b"))
    plans = []
    real = type(df).collect
    try:
        type(df).collect = lambda self: plans.append(self._jdf.queryExecution().executedPlan().toString()) or real(self)
        found = wide.profile_figures({1: (df, {c: F.col(c) for c in df.columns}), 2: (df, {"a": F.col("a")})})
    finally:
        type(df).collect = real
    assert found[1, "b"].quantiles == [499.5, 999.0, 1498.5] and found[2, "a"].outliers == 0
    assert plans and not any("Join" in p for p in plans) and sum("Generate explode" in p for p in plans) == 1


@pytest.mark.parametrize("buckets", [2, 8])
def test_numbered_rows(spark, buckets):
    df = spark.range(2000).select((F.col("id") % 2).alias("k"), F.floor(F.col("id") / 7).cast("double").alias("at"), "id").repartition(6)
    got = numbered_rows(df, ["k"], "at", "id", ["id"], buckets).orderBy("k", "rank").collect()
    for key in (0, 1):
        mine = [r for r in got if r["k"] == key]
        ids = [r["id"] for r in mine]
        assert ids == list(range(key, 2000, 2)) and [r["rank"] for r in mine] == list(range(1, 1001))
        assert [r["previous_id"] for r in mine] == [None, *ids[:-1]] and [r["next_id"] for r in mine] == [*ids[1:], None]


@pytest.mark.parametrize("partitions", ["1", "16"])
def test_shift_is_that_of_plain_sums(spark, compare, partitions):
    rng = np.random.default_rng(1)
    schema = "x double, y long, z double"
    rows = lambda shift, n: [(float(v), int(v * 3), 7.0) for v in rng.normal(size=n) + shift]
    old, new = rows(0.0, 400), rows(0.4, 300)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        got = {r["column"]: r["shift"] for r in compare(schema, old, schema, new, None, "clustering").diff.numeric.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for i, c in enumerate("xyz"):
        a, b = np.sort([r[i] for r in old]), np.sort([r[i] for r in new])
        points = np.unique(np.concatenate([a, b]))
        cdf = lambda v: np.searchsorted(v, points[:-1], side="right") / len(v)
        distance = float((np.abs(cdf(a) - cdf(b)) * np.diff(points)).sum())
        q1, q3 = np.quantile(np.concatenate([a, b]), [0.25, 0.75])
        assert got[c] == pytest.approx(min(1.0, distance / (q3 - q1)) if q3 > q1 else 0.0)


def test_wide_correlation_equals_pairwise(spark):
    from lakewitness.operators import profile

    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 5))
    base[:, 3] = base[:, 0] * 2 + rng.normal(size=300) * 0.1
    rows = [tuple(None if rng.random() < 0.1 else float(v) for v in r) for r in base]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double").repartition(4)
    key = lambda out: {(r["left"], r["right"]): r["correlation"] for r in out.collect()}
    pairs = {(a, b): df.where(f"{a} is not null and {b} is not null").corr(a, b) for i, a in enumerate(df.columns) for b in df.columns[i + 1 :]}
    assert key(profile.correlations(df, 1)) == pytest.approx(pairs)
