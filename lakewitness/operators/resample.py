"""Class balancing (I10-I13): replication, exact sampling, and synthetic rows between neighbours.

Class sizes are a table of one row per class and never a map in a plan; only the sizes of the largest and the smallest class
come to the driver. Draws follow the content of a row and the seed, so results do not depend on the partitioning.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewitness.functions.columns import as_text, portable_digest, q, row_digest
from lakewitness.operators import fits
from lakewitness.session import cut

COPY_CHUNK = 100_000
# Points of a cell of the partition tree: a cell's distance matrix stays below about 130 MB.
BLOCK = 4096
# Rows that are ordered together when a boundary is looked for, about.
RANGE_ROWS = 1 << 16


def class_sizes(df: DataFrame, target: str) -> DataFrame:
    """(_class, _size): rows per class, without the rows that have none."""
    label = as_text({f.name: f for f in df.schema.fields}[target])
    return cut(df.where(label.isNotNull()).groupBy(label.alias("_class")).agg(F.count(F.lit(1)).alias("_size")))


def extremes(sizes: DataFrame) -> tuple[int, int, int]:
    """Number of classes, size of the smallest and of the largest."""
    row = sizes.agg(F.count(F.lit(1)), F.coalesce(F.min("_size"), F.lit(0)), F.coalesce(F.max("_size"), F.lit(0))).first()
    return row[0], row[1], row[2]


def seeded(seed: int, digest: Column) -> Column:
    """A draw for every row: the SHA-256 of the seed, a colon and the row's digest."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), digest), 256)


def share(draw: Column) -> Column:
    """A hexadecimal draw as a number in [0, 1): its first 52 bits."""
    return F.conv(F.substring(draw, 1, 13), 16, 10).cast("double") / float(2**52)


def take_exactly(df: DataFrame, label: Column, wanted: DataFrame, seed: int) -> DataFrame:
    """Exactly ``_k`` rows of each class of ``wanted`` (_class, _size, _k), those with the smallest draws.

    The draws of a class fall into ranges of about RANGE_ROWS rows; totals of the ranges, one row each, show which holds the
    boundary. Lower ranges are kept whole by a filter; only the boundary range is ordered, equal rows counted as one, so
    copies of a hot row pile up neither in the window nor in the shuffle. Copies of a row follow each other.
    """
    names = df.columns
    drawn = df.select(*[q(c) for c in names], label.alias("_class"), seeded(seed, portable_digest(df, names)).alias("_draw")).join(wanted, "_class")
    drawn = drawn.withColumn("_range", F.floor(share(F.col("_draw")) * F.ceil(F.col("_size") / RANGE_ROWS)))
    sizes = drawn.groupBy("_class", "_k", "_range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("_class").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    edges = (
        sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .where((F.col("before") < F.col("_k")) & (F.col("before") + F.col("n") >= F.col("_k")))
        .select("_class", F.col("_range").alias("_edge"), (F.col("_k") - F.col("before")).alias("_rest"))
    )
    marked = drawn.join(cut(edges), "_class")
    low = marked.where(F.col("_range") < F.col("_edge")).select(*[q(c) for c in names])
    counted = marked.where(F.col("_range") == F.col("_edge")).groupBy("_class", "_draw", "_rest", *[q(c) for c in names]).agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("_class").orderBy("_draw").rowsBetween(Window.unboundedPreceding, 0))
    taken = counted.withColumn("_take", F.least(F.col("_n"), F.col("_rest") - upto + F.col("_n"))).where(F.col("_take") > 0)
    return low.unionByName(copies(taken, names, F.col("_take")))


def expand(df: DataFrame, times: Column) -> DataFrame:
    """Repeat each row, numbering the copies in ``_copy`` from 1; large counts expand in chunks."""
    chunks = df.withColumn("_times", times).withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_times") - 1) / COPY_CHUNK)))
    )
    here = F.least(F.lit(COPY_CHUNK), F.col("_times") - F.col("_chunk") * COPY_CHUNK).cast("int")
    numbered = chunks.withColumn("_in", F.explode(F.sequence(F.lit(1), here)))
    return numbered.withColumn("_copy", F.col("_chunk") * COPY_CHUNK + F.col("_in")).drop("_times", "_chunk", "_in")


def copies(df: DataFrame, names: list[str], times: Column) -> DataFrame:
    return expand(df, times).select(*[q(c) for c in names])


def random_undersampling(df: DataFrame, ctx, random_state: int = 42) -> DataFrame:
    """Every class cut to the size of the smallest."""
    if ctx.task != "classification" or not ctx.target:
        return df
    sizes = class_sizes(df, ctx.target)
    classes, smallest, _ = extremes(sizes)
    if classes < 2:
        return df
    label = as_text({f.name: f for f in df.schema.fields}[ctx.target])
    return take_exactly(df.where(label.isNotNull()), label, sizes.withColumn("_k", F.lit(smallest).cast("long")), random_state)


def random_oversampling(df: DataFrame, ctx, random_state: int = 42) -> DataFrame:
    """Every class raised to the size of the largest: whole copies plus an exact remainder."""
    if ctx.task != "classification" or not ctx.target:
        return df
    sizes = class_sizes(df, ctx.target)
    classes, _, largest = extremes(sizes)
    if classes < 2:
        return df
    label = as_text({f.name: f for f in df.schema.fields}[ctx.target])
    known, most = df.where(label.isNotNull()), F.lit(largest).cast("long")
    times = sizes.withColumn("_whole", F.floor(most / F.col("_size")))
    keyed = known.select(*[q(c) for c in df.columns], label.alias("_class")).join(times, "_class")
    rest = sizes.withColumn("_k", most % F.col("_size")).where("_k > 0")
    return copies(keyed, df.columns, F.col("_whole")).unionByName(take_exactly(known, label, rest, random_state))


# ---------------------------------------------------------------- neighbours

def _nearest(points: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and distances of the k points nearest to each query."""
    squared = (queries**2).sum(1)[:, None] + (points**2).sum(1)[None, :] - 2 * queries @ points.T
    k = min(k, len(points))
    near = np.argpartition(squared, k - 1, axis=1)[:, :k]
    exact = np.sqrt(((queries[:, None, :] - points[near]) ** 2).sum(2))
    order = np.argsort(exact, axis=1, kind="stable")
    return np.take_along_axis(near, order, 1), np.take_along_axis(exact, order, 1)


def _search(visits: DataFrame, held: DataFrame, bounds: DataFrame, k: int) -> DataFrame:
    """The k nearest points of every visiting query in each part of the visited cell.

    A cell with more than ``BLOCK`` points, equal in all coordinates, is split by hash, and the queries that visit a cell are cut
    into chunks, so a task holds one part and one chunk and emits k rows per query.
    """
    keys = ["grp", "cell"]
    loads = visits.groupBy(*keys).agg(F.count(F.lit(1)).alias("visits"))
    layout = bounds.join(loads, keys).select(
        *keys,
        F.ceil(F.col("points") / BLOCK).cast("int").alias("parts"),
        F.ceil(F.col("visits") / (BLOCK * 8)).cast("int").alias("chunks"),
    )
    asked = (
        visits.join(layout, keys)
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("chunk", F.pmod(F.xxhash64("qid"), F.col("chunks")).cast("int"))
    )
    points = (
        held.join(layout, keys)
        .withColumn("part", F.pmod(F.xxhash64("pid"), F.col("parts")).cast("int"))
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    )

    def best(asked_rows, point_rows):
        import pandas as pd

        if not len(asked_rows) or not len(point_rows):
            return pd.DataFrame({"qid": [], "pid": [], "distance": [], "vec": [], "payload": []})
        p = np.stack(point_rows["point"].to_numpy())
        parts = []
        for start in range(0, len(asked_rows), BLOCK):
            ids = asked_rows["qid"].to_numpy()[start : start + BLOCK]
            # One more than needed: a query that is itself a point finds itself.
            near, distance = _nearest(p, np.stack(asked_rows["vec"].to_numpy()[start : start + BLOCK]), k + 1)
            flat = near.ravel()
            parts.append(
                pd.DataFrame(
                    {
                        "qid": np.repeat(ids, near.shape[1]),
                        "pid": point_rows["pid"].to_numpy()[flat],
                        "distance": distance.ravel(),
                        "vec": point_rows["point"].to_numpy()[flat],
                        "payload": point_rows["payload"].to_numpy()[flat],
                    }
                )
            )
        out = pd.concat(parts)
        return out[out["qid"] != out["pid"]]

    by = ["grp", "cell", "part", "chunk"]
    there = points.select(*[F.col(c).alias(f"p_{c}") for c in by], "pid", F.col("vec").alias("point"), "payload")
    return (
        asked.select(*by, "qid", "vec").groupBy(*by)
        .cogroup(there.groupBy(*[f"p_{c}" for c in by]))
        .applyInPandas(best, "qid string, pid string, distance double, vec array<double>, payload string")
    )


def _closest(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy("distance", "pid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def partition_tree(points: DataFrame, dims: int) -> tuple[DataFrame, DataFrame, int]:
    """Points with their ``cell``, the splits (grp, cell, dim, at) of the cells above, and the depth.

    A group starts as one cell. Cells with more than BLOCK points are split at the sketched median of the coordinate that spreads
    most in them, all cells of a level in one pass; ``2 * cell`` takes the values up to ``at``, ``2 * cell + 1`` the others.
    Points that agree in all coordinates are not split.
    """
    held = cut(points.withColumn("cell", F.lit(1).cast("long")))
    splits, depth = held.select("grp", "cell", F.lit(0).alias("dim"), F.lit(0.0).alias("at")).limit(0), 0
    while True:
        figures = F.array(
            *[F.struct((F.max(F.col("vec")[i]) - F.min(F.col("vec")[i])).alias("spread"), F.lit(-i).alias("i"), F.percentile_approx(F.col("vec")[i], 0.5, 100).alias("median"),
                       F.min(F.col("vec")[i]).alias("low"), F.max(F.col("vec")[i]).alias("high")) for i in range(dims)]
        )
        cells = held.groupBy("grp", "cell").agg(F.count(F.lit(1)).alias("n"), F.array_max(figures).alias("w")).where((F.col("n") > BLOCK) & (F.col("w.spread") > 0))
        # a median that is the greatest value would leave nothing on the right
        at = F.when(F.col("w.median") < F.col("w.high"), F.col("w.median")).otherwise((F.col("w.low") + F.col("w.high")) / 2)
        level = cut(cells.select("grp", "cell", (-F.col("w.i")).alias("dim"), at.alias("at")))
        if level.isEmpty():
            return held, splits, depth
        side = F.when(F.get(F.col("vec"), F.col("dim")) > F.col("at"), 1).otherwise(0)
        moved = held.join(level, ["grp", "cell"], "left")
        held = cut(moved.select(*[F.col(c) for c in held.columns if c != "cell"], F.when(F.col("at").isNull(), F.col("cell")).otherwise(F.col("cell") * 2 + side).alias("cell")))
        splits, depth = cut(splits.unionByName(level)), depth + 1


def reached_cells(visits: DataFrame, splits: DataFrame, depth: int) -> DataFrame:
    """(grp, qid, vec, cell) for every cell that the ball around ``vec`` with ``reach`` touches.

    Queries go down the tree level by level and meet only the split of the cell they are in.
    """
    here = visits.withColumn("cell", F.lit(1).cast("long"))
    for _ in range(depth):
        value = F.get(F.col("vec"), F.col("dim"))
        below, above = value - F.col("reach") <= F.col("at"), value + F.col("reach") >= F.col("at")
        ways = F.array_compact(F.array(F.when(below, F.col("cell") * 2), F.when(above, F.col("cell") * 2 + 1)))
        met = here.join(splits, ["grp", "cell"], "left")
        here = met.select("grp", "qid", "vec", "reach", F.explode(F.when(F.col("at").isNull(), F.array("cell")).otherwise(ways)).alias("cell"))
    return here.drop("reach")


def neighbours(points: DataFrame, k: int, dims: int) -> DataFrame:
    """Exact k nearest points, inside its group, of every point with ``ask`` set. ``points``: (grp, pid, vec, payload, ask).

    A query first searches its own cell, which gives a distance no later neighbour may exceed; it then visits the other cells
    that the ball of this radius touches, and no more. How many that are depends on the data: few where coordinates
    separate the points, in many dimensions more.
    """
    held, splits, depth = partition_tree(points, dims)
    bounds = cut(held.groupBy("grp", "cell").agg(F.count(F.lit(1)).alias("points")))
    home = held.where("ask").select("grp", F.col("pid").alias("qid"), "vec", "cell")
    first = cut(_closest(_search(home, held, bounds, k), k))
    radius = first.groupBy("qid").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("radius"))
    reach = home.select("grp", "qid", "vec", F.col("cell").alias("own")).join(radius, "qid", "left").withColumn("reach", F.coalesce("radius", F.lit(float("inf"))))
    own = reach.select("qid", "own")
    visits = reached_cells(reach.select("grp", "qid", "vec", "reach"), splits, depth).join(own, "qid").where("cell <> own").drop("own")
    return _closest(first.drop("rank").unionByName(_search(visits, held, bounds, k)), k)


def _distinct_rows(df: DataFrame, ctx, label: Column) -> DataFrame:
    """Distinct rows with their number of copies, digest and median-filled feature vector."""
    names = ctx.numeric(df)
    values = fits.filled(df, names, fits.medians_where_missing(df, names))
    vec = F.array(*[F.coalesce(values[c], F.lit(0.0)) for c in names])  # an all-missing column tells nothing
    digest = row_digest(df, df.columns)
    return (
        df.select(*[q(c) for c in df.columns], vec.alias("_vec"), label.alias("_label"), digest.alias("_digest"))
        .groupBy("_digest", "_label")
        .agg(F.count(F.lit(1)).alias("_n"), F.first("_vec").alias("_vec"), *[F.first(q(c)).alias(c) for c in df.columns])
    )


def _pid(ordinal: Column) -> Column:
    """The identity of a copy of a row: its digest and its number."""
    return F.concat(F.hex("_digest"), F.lit("#"), ordinal.cast("string"))


def _points(rows: DataFrame, k: int, group: Column, ask: Column) -> DataFrame:
    """Distinct rows as points. More than k + 1 copies of a row cannot change any k nearest points."""
    return rows.withColumn("_ordinal", F.explode(F.sequence(F.lit(1), F.least("_n", F.lit(k + 1)).cast("int")))).select(
        group.alias("grp"),
        _pid(F.col("_ordinal")).alias("pid"),
        F.col("_vec").alias("vec"),
        F.col("_label").alias("payload"),
        ((F.col("_ordinal") == 1) & ask).alias("ask"),
    )


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends only on its parts."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 40)) / float(1 << 40)


def _even_quota(rows: DataFrame) -> DataFrame:
    """Spread ``_missing`` synthetic rows over the rows of a class of ``_size``: an equal share for each copy, the remainder to the
    copies that come first in hash order (counted through ranges of about RANGE_ROWS rows)."""
    hashed = rows.withColumn("_h", seeded(0, F.hex("_digest"))).withColumn("_b", F.floor(share(F.col("_h")) * F.ceil(F.col("_size") / RANGE_ROWS)))
    counts = hashed.groupBy("_label", "_b").agg(F.sum("_n").alias("m"))
    earlier = Window.partitionBy("_label").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_label", "_b", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_label", "_b").orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_offset") + F.coalesce(F.sum("_n").over(inside), F.lit(0))
    ranked = hashed.join(offsets, ["_label", "_b"]).withColumn("_before", before)
    extra = F.least(F.greatest(F.col("_missing") % F.col("_size") - F.col("_before"), F.lit(0)), F.col("_n"))
    quota = F.floor(F.col("_missing") / F.col("_size")) * F.col("_n") + extra
    return ranked.withColumn("_quota", quota).where(F.col("_quota") > 0).drop("_h", "_b", "_offset", "_before")


def _between(df: DataFrame, ctx, base: DataFrame, near: DataFrame, seed: int) -> DataFrame:
    """``quota`` new rows per base row, each on the line to one of its k neighbours."""
    names = ctx.numeric(df)
    spots = near.withColumnRenamed("qid", "_qid").groupBy("_qid").agg(F.sort_array(F.collect_list(F.struct("rank", "vec"))).alias("_near"))  # k entries per row
    keyed = base.withColumn("_qid", _pid(F.lit(1))).join(spots, "_qid")
    asked = expand(keyed, F.col("_quota"))
    pick = F.floor(uniform(F.lit(seed), F.col("_qid"), F.col("_copy"), F.lit("pick")) * F.size("_near")).cast("int")
    gap = uniform(F.lit(seed), F.col("_qid"), F.col("_copy"), F.lit("gap"))
    made = asked.withColumn("_made", F.zip_with("_vec", F.col("_near")[pick]["vec"], lambda a, b: a + (b - a) * gap))
    return made.select(*[F.col("_made")[names.index(c)].alias(c) if c in names else q(c) for c in df.columns])


def _as_doubles(df: DataFrame, ctx) -> DataFrame:
    names = ctx.numeric(df)
    return df.select(*[q(c).cast("double").alias(c) if c in names else q(c) for c in df.columns])


def _synthesise(df: DataFrame, ctx, k: int, seed: int, quotas) -> DataFrame:
    """Shared course of SMOTE and ADASYN; ``quotas`` decides how many rows each base row gets."""
    if ctx.task != "classification" or not ctx.target or not ctx.numeric(df):
        return df
    sizes = class_sizes(df, ctx.target)
    classes, smallest, largest = extremes(sizes)
    if classes < 2 or smallest == largest:
        return df
    k = min(k, smallest - 1)
    if k < 1:
        return random_oversampling(df, ctx, seed)
    label = as_text({f.name: f for f in df.schema.fields}[ctx.target])
    known, dims = df.where(label.isNotNull()), len(ctx.numeric(df))
    missing = sizes.select(F.col("_class").alias("_label"), "_size", (F.lit(largest) - F.col("_size")).alias("_missing"))
    rows = cut(_distinct_rows(known, ctx, label).join(missing, "_label"))
    minority = rows.where("_missing > 0")
    base = quotas(rows, minority, k, dims)
    near = neighbours(_points(minority, k, F.col("_label"), F.lit(True)), k, dims)
    return _as_doubles(known, ctx).unionByName(_as_doubles(_between(df, ctx, base, near, seed), ctx))


def smote(df: DataFrame, ctx, k_neighbors: int = 5, random_state: int = 42) -> DataFrame:
    """Smaller classes grow to the largest with rows between a row and one of its k nearest of
    the same class. Text columns take the base row's values. Too small a class is copied instead."""
    return _synthesise(df, ctx, k_neighbors, random_state, lambda rows, minority, k, dims: _even_quota(minority))


def _hard_quota(rows: DataFrame, minority: DataFrame, k: int, dims: int) -> DataFrame:
    """Quotas in proportion to the share of other classes among the k nearest rows of any class.

    A class without a single foreign neighbour gets equal shares.
    """
    around = neighbours(_points(rows, k, F.lit("all"), F.col("_missing") > 0), k, dims)
    keyed = minority.withColumn("_qid", _pid(F.lit(1)))
    mixed = around.select(F.col("qid").alias("_qid"), "payload").join(keyed.select("_qid", "_label"), "_qid")
    foreign = mixed.groupBy("_qid").agg(F.avg((F.col("payload") != F.col("_label")).cast("double")).alias("_share"))
    weighted = cut(keyed.join(foreign, "_qid"))
    totals = weighted.groupBy("_label").agg(F.sum((F.col("_share") * F.col("_n")).cast("decimal(38,12)")).cast("double").alias("_total"))
    judged = weighted.join(cut(totals), "_label")
    hard = judged.where("_total > 0").withColumn("_quota", F.round(F.col("_share") * F.col("_n") / F.col("_total") * F.col("_missing")).cast("long")).where("_quota > 0")
    return hard.drop("_qid", "_share", "_total").unionByName(_even_quota(judged.where("_total = 0").drop("_qid", "_share", "_total")))


def adasyn(df: DataFrame, ctx, n_neighbors: int = 5, random_state: int = 42) -> DataFrame:
    """Like SMOTE, with more new rows where neighbours belong to other classes."""
    return _synthesise(df, ctx, n_neighbors, random_state, _hard_quota)
