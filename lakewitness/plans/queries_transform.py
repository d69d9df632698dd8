"""Queries over preprocessing steps on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakewitness.operators import transforms as t
from lakewitness.operators import resample, isolation
from lakewitness.plans.check_parts import SCHEMA, digest_sql
from lakewitness.plans.registry import part, query
from lakewitness.plans.workspace import VERSION_ROWS

TARGET = {row[0]: row[10] for row in VERSION_ROWS}
TASK = {row[0]: row[9] for row in VERSION_ROWS}


def ctx(v: int) -> t.Context:
    return t.Context(target=TARGET[v], task=TASK[v])


def numeric(v: int) -> list[str]:
    return [n for n, k in SCHEMA[v] if k != "str" and n != TARGET[v]]


def text(v: int) -> list[str]:
    return [n for n, k in SCHEMA[v] if k == "str" and n != TARGET[v]]


def rounded(df):
    """Doubles at six decimals, so both engines print them alike."""
    return df.select(*[F.round(f"`{n}`", 6).alias(n) if kind == "double" else F.col(f"`{n}`") for n, kind in df.dtypes])


def select(v: int, change: dict[str, str], doubles: bool = True) -> str:
    """Check SQL of a projection: the changed columns by expression, the others as they are."""
    kinds = dict(SCHEMA[v])
    out = []
    for n, _ in SCHEMA[v]:
        sql = change.get(n, n)
        out.append(f"round({sql}, 6)::DOUBLE AS {n}" if n in change and (kinds[n] != "str" or "code" in sql) else f"round({sql}, 6) AS {n}" if kinds[n] == "num" else f"{sql} AS {n}")
    return ", ".join(out)


def quantile(v: int, name: str, p: float) -> str:
    return f"(SELECT quantile_cont({name}, {p}) FROM v{v})"


def mode(v: int, name: str) -> str:
    return f"(SELECT {name} FROM v{v} WHERE {name} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, {name} LIMIT 1)"


def filled(v: int, name: str) -> str:
    return f"coalesce({name}, {quantile(v, name, 0.5)})"


@query("I1_drop_duplicates", f"SELECT DISTINCT {select(5, {})} FROM v5")
def _(ws):
    return rounded(t.drop_duplicates(ws.frames[5], ctx(5)))


MODES7 = {c: f"coalesce({c}, {mode(7, c)})" for c in text(7)}
MODES2 = {c: f"coalesce({c}, {mode(2, c)})" for c in text(2)}


@query("I2_median_imputation", f"SELECT {select(2, {c: filled(2, c) for c in numeric(2)} | MODES2)} FROM v2")
def _(ws):
    return rounded(t.median_imputation(ws.frames[2], ctx(2)))


@query("I3_mean_imputation", f"SELECT {select(5, {c: f'coalesce({c}, (SELECT avg({c}) FROM v5))' for c in numeric(5)} | {c: f'coalesce({c}, {mode(5, c)})' for c in text(5)})} FROM v5")
def _(ws):
    return rounded(t.mean_imputation(ws.frames[5], ctx(5)))


@query("I4_drop_missing_rows", f"SELECT {select(7, {})} FROM v7 WHERE " + " + ".join(f"({n} IS NOT NULL)::INT" for n, _ in SCHEMA[7]) + " >= 5")
def _(ws):
    return rounded(t.drop_missing_rows(ws.frames[7], ctx(7), threshold=0.1))


def codes(v: int) -> str:
    joins, change = "", {}
    for i, c in enumerate(text(v)):
        joins += f" LEFT JOIN (SELECT x, row_number() OVER (ORDER BY x) - 1 AS code FROM (SELECT DISTINCT {c} AS x FROM v{v} WHERE {c} IS NOT NULL)) d{i} ON {c} = d{i}.x"
        change[c] = f"d{i}.code"
    return f"SELECT {select(v, change)} FROM v{v}{joins}"


@query("I5_label_encoding", codes(1))
def _(ws):
    return rounded(t.label_encoding(ws.frames[1], ctx(1)))


@query("I6_onehot_encoding", "SELECT order_id, customer_key, order_state, round(total_price, 6) AS total_price, order_date, round(price_with_tax, 6) AS price_with_tax, "
       + ", ".join(f"coalesce((priority = '{p}')::INT, 0) AS \"priority_{p}\"" for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"))
       + ", " + ", ".join(f"coalesce((ship_mode = '{p}')::INT, 0) AS ship_mode_{p}" for p in ("freight", "parcel", "repeat")) + " FROM v2")
def _(ws):
    return rounded(t.onehot_encoding(ws.frames[2], ctx(2)))


@query("I7_iqr_filtering", f"SELECT {select(9, {})} FROM v9 WHERE " + " AND ".join(
    f"coalesce({c} BETWEEN {quantile(9, c, 0.25)} - 1.5 * ({quantile(9, c, 0.75)} - {quantile(9, c, 0.25)}) AND {quantile(9, c, 0.75)} + 1.5 * ({quantile(9, c, 0.75)} - {quantile(9, c, 0.25)}), true)" for c in numeric(9)))
def _(ws):
    return rounded(t.iqr_filtering(ws.frames[9], ctx(9)))


@query("I8_isolation_forest")
def _(ws):
    kept = isolation.isolation_forest(ws.frames[9], ctx(9))
    return kept.groupBy("outcome_class").agg(F.count(F.lit(1)).alias("kept_rows"), F.round(F.max("amount"), 6).alias("largest_amount"))


@query("I9_clip_outliers", f"SELECT {select(4, {c: f'least(greatest({c}, {quantile(4, c, 0.01)}), {quantile(4, c, 0.99)})' for c in numeric(4)})} FROM v4")
def _(ws):
    return rounded(t.clip_outliers(ws.frames[4], ctx(4)))


def inside(made, ws, v: int):
    """Rows per class next to whether every value stays inside the range its class has in the source."""
    label = TARGET[v]
    span = lambda df, side: df.groupBy(label).agg(
        F.count(F.lit(1)).alias(f"{side}_rows"),
        *[f(c).cast("double").alias(f"{side}_{n}_{c}") for c in numeric(v) for n, f in (("min", F.min), ("max", F.max))],
    )
    both = span(ws.frames[v], "old").join(span(made, "new"), label)
    fits = F.lit(True)
    for c in numeric(v):
        fits = fits & (F.col(f"new_min_{c}") >= F.col(f"old_min_{c}")) & (F.col(f"new_max_{c}") <= F.col(f"old_max_{c}"))
    return both.withColumn("inside_range", fits)


@query("I10_smote", """
SELECT outcome_class, (SELECT max(n) FROM (SELECT count(*) AS n FROM v9 GROUP BY outcome_class)) AS row_count, true AS inside_range FROM v9 GROUP BY outcome_class""")
def _(ws):
    made = resample.smote(ws.frames[9], ctx(9))
    return inside(made, ws, 9).select("outcome_class", F.col("new_rows").alias("row_count"), "inside_range")


@query("I11_adasyn", """
SELECT outcome_class, count(*) AS source_rows, count(*) < (SELECT max(n) FROM (SELECT count(*) AS n FROM v9 GROUP BY outcome_class)) AS grew, true AS inside_range FROM v9 GROUP BY outcome_class""")
def _(ws):
    made = resample.adasyn(ws.frames[9], ctx(9))
    return inside(made, ws, 9).select(
        "outcome_class", F.col("old_rows").alias("source_rows"), (F.col("new_rows") > F.col("old_rows")).alias("grew"), "inside_range"
    )


# Rows of version 3 in the order of their draws, with the sizes of their own, the smallest and the largest class.
part("drawn", f"""
SELECT *, row_number() OVER (PARTITION BY order_state ORDER BY draw) AS nth, count(*) OVER (PARTITION BY order_state) AS n FROM (SELECT *, sha256('42:' || {digest_sql(3)}) AS draw FROM v3) WHERE order_state IS NOT NULL""")


@query("I12_random_oversampling", f"""
SELECT {select(3, {})} FROM (SELECT *, (SELECT max(n) FROM drawn) AS m FROM drawn), LATERAL (SELECT unnest(range(m // n + (nth <= m % n)::INT)))""")
def _(ws):
    return rounded(resample.random_oversampling(ws.frames[3], ctx(3)))


@query("I13_random_undersampling", f"SELECT {select(3, {})} FROM drawn WHERE nth <= (SELECT min(n) FROM drawn)")
def _(ws):
    return rounded(resample.random_undersampling(ws.frames[3], ctx(3)))


@query("I14_correlation_filter", f"""
SELECT {select(1, {}).replace('round(price_with_tax, 6) AS price_with_tax', '').rstrip(', ').replace('round(total_price, 6) AS total_price, ', '')}, round(price_with_tax, 6) AS price_with_tax FROM v1""")
def _(ws):
    return rounded(t.correlation_filter(ws.frames[1], ctx(1)))


def information_sql(v: int, target: str) -> str:
    cuts = ", ".join(f"quantile_cont({c}, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q_{c}, quantile_cont({c}, 0.5) AS m_{c}" for c in numeric(v))
    cells = " UNION ALL ".join(
        f"SELECT {target} AS y, '{c}' AS feature, len(list_filter(q_{c}, lambda b: b < coalesce({c}, m_{c}))) AS x FROM v{v}, (SELECT {cuts} FROM v{v}) WHERE {target} IS NOT NULL" for c in numeric(v)
    )
    return f"""SELECT feature, round(greatest(0, sum(n / t * ln(n * t / (nx * ny)))), 6)::DOUBLE AS information FROM (
  SELECT feature, n::DOUBLE AS n, (sum(n) OVER (PARTITION BY feature))::DOUBLE AS t, (sum(n) OVER (PARTITION BY feature, x))::DOUBLE AS nx, (sum(n) OVER (PARTITION BY feature, y))::DOUBLE AS ny
  FROM (SELECT feature, x, y, count(*) AS n FROM ({cells}) GROUP BY ALL)) GROUP BY feature"""


@query("I15_mutual_information", information_sql(9, "outcome_class"))
def _(ws):
    return rounded(t.information(ws.frames[9], ctx(9)))


@query("I16_variance_threshold", f"SELECT {', '.join(f'round({n}, 6) AS {n}' if k == 'num' else n for n, k in SCHEMA[4] if n not in ('discount', 'tax'))} FROM v4")
def _(ws):
    return rounded(t.variance_threshold(ws.frames[4], ctx(4), threshold=0.01))


def scaled(v: int, centre: str, spread: str) -> str:
    change = {c: f"({filled(v, c)} - (SELECT {centre.format(filled(v, c))} FROM v{v})) / (SELECT coalesce(nullif({spread.format(filled(v, c))}, 0), 1) FROM v{v})" for c in numeric(v)}
    return f"SELECT {select(v, change)} FROM v{v}"


@query("I17_standard_scaler", scaled(5, "avg({0})", "stddev_pop({0})"))
def _(ws):
    return rounded(t.standard_scaler(ws.frames[5], ctx(5)))


@query("I18_robust_scaler", scaled(2, "quantile_cont({0}, 0.5)", "quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25)"))
def _(ws):
    return rounded(t.robust_scaler(ws.frames[2], ctx(2)))


@query("I19_minmax_scaler", scaled(5, "min({0})", "max({0}) - min({0})"))
def _(ws):
    return rounded(t.minmax_scaler(ws.frames[5], ctx(5)))


CHAIN = [("drop_duplicates", {}), ("median_imputation", {}), ("clip_outliers", {"lower": 0.01, "upper": 0.99}), ("minmax_scaler", {})]
NUM5, TXT5 = numeric(5), text(5)
part("chain1", f"SELECT DISTINCT {', '.join(n for n, _ in SCHEMA[5])} FROM v5")
part("chain2", "SELECT " + ", ".join([f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM chain1))::DOUBLE AS {c}" for c in NUM5] + TXT5) + " FROM chain1")
part("chain3", "SELECT " + ", ".join([f"least(greatest({c}, (SELECT quantile_cont({c}, 0.01) FROM chain2)), (SELECT quantile_cont({c}, 0.99) FROM chain2)) AS {c}" for c in NUM5] + TXT5) + " FROM chain2")


@query("I20_apply_steps", "SELECT " + ", ".join([f"round(({c} - (SELECT min({c}) FROM chain3)) / (SELECT coalesce(nullif(max({c}) - min({c}), 0), 1) FROM chain3), 6)::DOUBLE AS {c}" for c in NUM5] + TXT5) + " FROM chain3")
def _(ws):
    return rounded(t.apply_steps(ws.frames[5], CHAIN, ctx(5)))


def figures_sql(side: str, source: str, v: int, target: str) -> str:
    cells = " + ".join(f"count(*) FILTER ({n} IS NULL)" for n, _ in SCHEMA[v])
    width = len(SCHEMA[v])
    return f"""SELECT count(*) AS row_count, {width} AS column_count, round(({cells})::DOUBLE / (count(*) * {width}) * 100, 6) AS missing_pct,
  (SELECT round(greatest(0, 1 - abs(max(n)::DOUBLE / sum(n) - 1.0::DOUBLE / count(*)) / (1 - 1.0::DOUBLE / count(*))), 6)::DOUBLE FROM (SELECT count(*) AS n FROM {source} WHERE {target} IS NOT NULL GROUP BY {target})) AS class_balance, '{side}' AS side FROM {source}"""


@query("I21_build_metrics", figures_sql("before", "v2", 2, "order_state") + " UNION ALL "
       + figures_sql("after", "(SELECT * FROM v2 WHERE " + " + ".join(f"({n} IS NOT NULL)::INT" for n, _ in SCHEMA[2]) + " >= 8)", 2, "order_state"))
def _(ws):
    return t.build_metrics(ws.frames[2], t.drop_missing_rows(ws.frames[2], ctx(2), threshold=0.0), "order_state")
