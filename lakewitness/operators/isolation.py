"""Isolation forest (I8): trees grown on a bounded sample, rows scored where they are."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewitness.functions.columns import portable_digest, q
from lakewitness.operators import fits
from lakewitness.operators.resample import expand, seeded, share

TREES = 100
SAMPLE = 256
# Rows drawn for a tree, in its sample sizes: enough that few trees end up short.
OVERSIZE = 1.3
EULER = 0.5772156649015329


def average_path(n: np.ndarray | float):
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype="float64")
    safe = np.maximum(n, 3.0)
    long = 2.0 * (np.log(safe - 1.0) + EULER) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n <= 2, 1.0, long))


def grow(points: np.ndarray, rng: np.random.Generator, limit: int) -> list[list[float]]:
    """Nodes [feature, cut, left, right, depth estimate]; feature -1 marks a leaf."""
    nodes: list[list[float]] = []

    def node(rows: np.ndarray, depth: int) -> int:
        here = len(nodes)
        nodes.append([-1.0, 0.0, 0.0, 0.0, depth + float(average_path(len(rows)))])
        low, high = rows.min(0), rows.max(0)
        open_features = np.flatnonzero(high > low)
        if depth < limit and len(rows) > 1 and len(open_features):
            f = int(rng.choice(open_features))
            cut = rng.uniform(low[f], high[f])
            side = rows[:, f] < cut
            if side.any() and not side.all():
                nodes[here][:2] = [float(f), float(cut)]
                nodes[here][2] = node(rows[side], depth + 1)
                nodes[here][3] = node(rows[~side], depth + 1)
        return here

    node(points, 0)
    return nodes


def scores(points: np.ndarray, trees: list[np.ndarray], sample: int) -> np.ndarray:
    depth = np.zeros(len(points))
    for tree in trees:
        at = np.zeros(len(points), dtype="int64")
        while True:
            feature = tree[at, 0].astype("int64")
            inner = np.flatnonzero(feature >= 0)
            if not len(inner):
                break
            left = points[inner, feature[inner]] < tree[at[inner], 1]
            at[inner] = np.where(left, tree[at[inner], 2], tree[at[inner], 3]).astype("int64")
        depth += tree[at, 4]
    return np.power(2.0, -depth / len(trees) / max(float(average_path(sample)), 1e-9))


def isolation_forest(df: DataFrame, ctx, contamination: str = "auto", random_state: int = 42) -> DataFrame:
    """I8: drop rows whose anomaly score exceeds one half.

    A seeded draw sends a little more than TREES * SAMPLE rows to the trees, each row to as many as that takes (in a large table
    to none or one), and a tree keeps at most SAMPLE of them. The fitted trees hold at most TREES * 2 * SAMPLE nodes, which
    bounds what travels to the tasks.
    """
    names, rows = ctx.numeric(df), df.count()
    if not names or rows <= 10:
        return df
    values = fits.filled(df, names, fits.medians_where_missing(df, names))
    filled = [F.coalesce(values[c], F.lit(0.0)) for c in names]  # an all-missing column tells nothing
    per_tree = min(SAMPLE, rows)
    # Equal rows are counted and each copy draws for itself, so copies spread over the trees and the draw follows only the
    # content, the number of the copy and the seed. A copy joins ``joins`` trees on average, one after another from a drawn one.
    digest = portable_digest(df, df.columns)
    counted = df.select(F.array(*filled).alias("vec"), digest.alias("_digest")).groupBy("_digest").agg(F.count(F.lit(1)).alias("_n"), F.first("vec").alias("vec"))
    each = expand(counted, F.col("_n"))
    joins = min(float(TREES), OVERSIZE * TREES * per_tree / rows)
    draw = seeded(random_state, F.concat("_digest", F.lit("#"), F.col("_copy").cast("string")))
    spun = each.select("vec", draw.alias("draw")).select("vec", "draw", share(F.col("draw")).alias("u"), share(F.substring("draw", 14, 13)).alias("start"))
    times = (F.lit(int(joins)) + F.when(F.col("u") < joins - int(joins), 1).otherwise(0)).cast("int")
    sample = spun.where(times > 0).withColumn("i", F.explode(F.sequence(F.lit(0), times - 1))).select(
        "vec", F.pmod(F.floor(F.col("start") * TREES) + F.col("i"), F.lit(TREES)).cast("int").alias("tree"), F.sha2(F.concat("draw", F.col("i").cast("string")), 256).alias("draw")
    )

    def fit(key, frame):
        import pandas as pd

        rng = np.random.default_rng([random_state, int(key[0])])
        ordered = frame.sort_values(["draw"], kind="stable")["vec"].to_numpy()
        points = np.stack(ordered[:per_tree])
        nodes = grow(points, rng, int(np.ceil(np.log2(max(len(points), 2)))))
        return pd.DataFrame({"tree": [key[0]], "nodes": [np.asarray(nodes).ravel()]})

    fitted = sample.groupBy("tree").applyInPandas(fit, "tree int, nodes array<double>").orderBy("tree").collect()
    forest = df.sparkSession.sparkContext.broadcast([np.asarray(r["nodes"]).reshape(-1, 5) for r in fitted])
    size = per_tree

    @F.pandas_udf(T.DoubleType())
    def score(vec):
        import pandas as pd

        return pd.Series(scores(np.stack(vec.to_numpy()), forest.value, size)) if len(vec) else pd.Series([], dtype="float64")

    return df.withColumn("_score", score(F.array(*filled))).where(F.col("_score") <= 0.5).select(*[q(c) for c in df.columns])
