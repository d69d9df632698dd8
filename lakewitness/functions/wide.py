"""Exact figures of many columns in a few passes, each one wide aggregate.

Cells never become rows, and nothing is joined: a pass brings a few numbers per column to the driver, which are literals of the
next pass. Quantiles come in two steps. A mergeable sketch bounds each wanted position from both sides; then the values below
the lower bound are counted, and only the values between the bounds (some 4 of 10,000) are grouped, put in order and counted
through to the position.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Hashable
from dataclasses import dataclass, field
from functools import partial, reduce
from itertools import accumulate
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewitness.lookups import OUTLIER_FENCE
from lakewitness.session import LANES, together

# The sketch's rank error is one part in this many.
ACCURACY = 10_000
# Quantiles one scan looks for between their bounds: the test for many is a method too long for the JVM to compile.
SLOTS = 6


@dataclass
class Figures:
    """Of one column: rows with a value, their least, greatest and mean value, sums of squared and cubed deviations, quantiles,
    and the rows outside the fences of the quartiles."""

    n: int = 0
    low: float | None = None
    high: float | None = None
    mean: float | None = None
    m2: float | None = None
    m3: float | None = None
    quantiles: list[float | None] = field(default_factory=list)
    outliers: int = 0


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _pass(tables: dict[Hashable, tuple[DataFrame, dict[str, list[Column]]]]) -> dict[Hashable, list[list]]:
    """The aggregates of each column of each table, in one job. All aggregates of a pass are alike in type."""
    keys = list(tables)
    parts = []
    for i, key in enumerate(keys):
        df, columns = tables[key]
        parts.append(df.agg(F.array(*[F.struct(*[a.alias(f"a{j}") for j, a in enumerate(aggregates)]) for aggregates in columns.values()]).alias("x")).withColumn("i", F.lit(i)))
    return {keys[r["i"]]: [list(x) for x in r["x"]] for r in _union(parts).collect()} if parts else {}


def moments(tables: dict[Hashable, tuple[DataFrame, dict[str, Column]]]) -> dict[tuple[Hashable, str], Figures]:
    """Counts, extremes and means of the given doubles; missing is NULL."""
    used = {k: (df, values) for k, (df, values) in tables.items() if values}
    found = _pass({k: (df, {c: [F.count(v), F.min(v), F.max(v), F.avg(v)] for c, v in values.items()}) for k, (df, values) in used.items()})
    return {(k, c): Figures(*row) for k, rows in found.items() for c, row in zip(used[k][1], rows)}


def _margin(p: float, n: int) -> tuple[float, float]:
    """Ranks whose sketched values surely enclose both values that the quantile lies between; 0 and 1 are the extremes."""
    reach = 2 / ACCURACY + 2 / n
    return max(p - reach, 0.0), min(p + reach, 1.0)


def _counted_quantile(counts: list[tuple[float, int]], at: float) -> float:
    """The value at a place counted from 0 among ordered values, interpolated between the two it lies between."""
    upto = list(accumulate(n for _, n in counts))
    low, high = (counts[bisect_right(upto, place)][0] for place in (math.floor(at), math.ceil(at)))
    return low if low == high else low + (high - low) * (at - math.floor(at))


def add_quantiles(tables: dict[Hashable, tuple[DataFrame, dict[str, Column]]], figures: dict[tuple[Hashable, str], Figures], probs: list[float], deviations: bool = False, few: dict[tuple[Hashable, str], list[tuple[float, int]]] | None = None) -> None:
    """Exact quantiles with linear interpolation; with ``deviations`` also the sums of squared and cubed deviations.

    ``few``: values in ascending order and their counts, of columns where these are known; they need no sketch.
    """
    few = few or {}
    some = {k: (df, {c: v for c, v in values.items() if figures[k, c].n}) for k, (df, values) in tables.items()}
    some = {k: x for k, x in some.items() if x[1]}
    for f in figures.values():
        f.quantiles = [None] * len(probs)

    def sketched(k: Hashable, c: str, v: Column) -> list[Column]:
        f = figures[k, c]
        ranks = [r for p in probs for r in _margin(p, f.n)]
        away = v - F.lit(f.mean)
        extra = [F.sum(away * away), F.sum(away * away * away)] if deviations else []
        return [F.lit(None).cast("array<double>") if (k, c) in few else F.percentile_approx(v, ranks, ACCURACY), *extra]

    asked = {k: (df, {c: v for c, v in values.items() if deviations or (k, c) not in few}) for k, (df, values) in some.items()}
    rows = _pass({k: (df, {c: sketched(k, c, v) for c, v in values.items()}) for k, (df, values) in asked.items() if values})
    for key in few.keys() & figures.keys():
        if figures[key].n:
            figures[key].quantiles = [_counted_quantile(few[key], p * (figures[key].n - 1)) for p in probs]
    slots: list[tuple[Hashable, str, int, float, float]] = []
    for k, found in rows.items():
        for c, (bounds, *extra) in zip(asked[k][1], found):
            f = figures[k, c]
            if deviations:
                f.m2, f.m3 = extra
            if (k, c) in few:
                continue
            for j, p in enumerate(probs):
                first, last = _margin(p, f.n)
                low = f.low if first == 0 else bounds[2 * j]
                high = f.high if last == 1 else bounds[2 * j + 1]
                if low == high:
                    f.quantiles[j] = low
                else:
                    slots.append((k, c, j, low, high))
    if not slots:
        return
    by_table: dict[Hashable, list[int]] = {}
    for s, (k, *_) in enumerate(slots):
        by_table.setdefault(k, []).append(s)

    value = lambda s: some[slots[s][0]][1][slots[s][1]]
    below = _pass({k: (some[k][0], {str(s): [F.count_if(value(s) < slots[s][3])] for s in mine}) for k, mine in by_table.items()})
    before = {s: row[0] for k, mine in by_table.items() for s, row in zip(mine, below[k])}
    parts = []
    for k, mine in ((k, mine[i : i + SLOTS]) for k, mine in by_table.items() for i in range(0, len(mine), SLOTS)):
        inside = {s: value(s).between(slots[s][3], slots[s][4]) for s in mine}
        cells = [F.when(inside[s], F.struct(F.lit(s).alias("slot"), value(s).alias("value"))) for s in mine]
        # Most rows lie between no bounds; they make no array.
        parts.append(some[k][0].where(reduce(or_, inside.values())).select(F.explode(F.array_compact(F.array(*cells))).alias("c")).select("c.*"))
    places = {}
    for s, (k, c, j, *_) in enumerate(slots):
        at = probs[j] * (figures[k, c].n - 1)
        places[s] = (math.floor(at) - before[s], math.ceil(at) - before[s], at - math.floor(at))
    # The two places of every slot, counted from its lower bound.
    of = lambda i: F.create_map(*[F.lit(x) for s in places for x in (s, places[s][i])])[F.col("slot")]
    counted = _union(parts).groupBy("slot", "value").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("slot").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    at = lambda i: F.min(F.when(F.col("upto") > of(i), F.col("value")))
    for r in counted.withColumn("upto", upto).groupBy("slot").agg(at(0).alias("low"), at(1).alias("high")).collect():
        k, c, j, *_ = slots[r["slot"]]
        figures[k, c].quantiles[j] = r["low"] + (r["high"] - r["low"]) * places[r["slot"]][2]


def add_outliers(tables: dict[Hashable, tuple[DataFrame, dict[str, Column]]], figures: dict[tuple[Hashable, str], Figures], first: int, third: int) -> None:
    """Rows outside the fences; ``first`` and ``third`` tell which of the quantiles are the quartiles. Without spread there are none."""

    def fences(f: Figures) -> tuple[float, float] | None:
        a, b = f.quantiles[first], f.quantiles[third]
        if a is None or a == b:
            return None
        return a - OUTLIER_FENCE * (b - a), b + OUTLIER_FENCE * (b - a)

    asked = {k: (df, {c: [F.count_if((v < ab[0]) | (v > ab[1]))] for c, v in values.items() if (ab := fences(figures[k, c]))}) for k, (df, values) in tables.items()}
    asked = {k: x for k, x in asked.items() if x[1]}
    for k, rows in _pass(asked).items():
        for c, (n,) in zip(asked[k][1], rows):
            figures[k, c].outliers = n


def profile_figures(
    tables: dict[Hashable, tuple[DataFrame, dict[str, Column]]], few: dict[tuple[Hashable, str], list[tuple[float, int]]] | None = None
) -> dict[tuple[Hashable, str], Figures]:
    """All figures, with the quartiles as quantiles. ``few`` as in ``add_quantiles``."""
    figures = moments(tables)
    add_quantiles(tables, figures, [0.25, 0.5, 0.75], deviations=True, few=few)
    add_outliers(tables, figures, 0, 2)
    return figures


def figures_together(
    tables: dict[Hashable, tuple[DataFrame, dict[str, Column]]], few: dict[tuple[Hashable, str], list[tuple[float, int]]] | None = None
) -> dict[tuple[Hashable, str], Figures]:
    """``profile_figures`` of many tables. The passes over one table follow one another, those over different tables need not wait:
    the tables are dealt to as many groups as run at a time, those with the most columns first."""
    groups: list[dict] = [{} for _ in range(min(LANES, len(tables)))]
    for k in sorted(tables, key=lambda k: -len(tables[k][1])):
        min(groups, key=lambda g: sum(len(values) for _, values in g.values()))[k] = tables[k]
    spark = next(iter(tables.values()))[0].sparkSession
    return {key: f for part in together(spark, [partial(profile_figures, g, few) for g in groups if g]) for key, f in part.items()}
