"""A working set of dataset versions derived from the given tables, with their evidence.

The version statements are plain SQL over whole tables, so another engine can derive the same
versions for checking. Evidence that many queries read is computed once per session and folder
and written to the checkpoint folder.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from lakewitness.functions.ordered import BUCKETS
from lakewitness.plans.evidence import VERSION_SCHEMA, Evidence
from lakewitness.session import shared

# name, statement; {name} reads a given table or an earlier version.
VERSION_SQL = {
    "v1": """
        SELECT o_orderkey AS order_id, o_custkey AS customer_key, o_orderstatus AS order_state,
               o_totalprice AS total_price, CAST(CAST(o_orderdate AS DATE) AS STRING) AS order_date,
               o_orderpriority AS priority, o_totalprice * 1.08e0 AS price_with_tax
        FROM {orders}""",
    "v2": """
        SELECT order_id, CASE WHEN total_price > 450000 THEN NULL ELSE customer_key END AS customer_key, order_state,
               CASE WHEN order_state = 'P' THEN total_price * 1.25e0 ELSE total_price END AS total_price, order_date,
               CASE WHEN priority = '4-NOT SPECIFIED' THEN NULL ELSE priority END AS priority, price_with_tax,
               CASE WHEN total_price > 250000 THEN 'freight' ELSE 'parcel' END AS ship_mode
        FROM {v1} WHERE order_date >= '1995-07-01'
        UNION ALL
        SELECT order_id + 1000000000, customer_key, order_state, total_price, order_date, priority, price_with_tax, 'repeat'
        FROM {v1} WHERE priority = '1-URGENT' AND order_date >= '2001-01-01'""",
    "v3": """
        SELECT order_id, customer_key,
               CASE WHEN order_state = 'P' AND total_price < 450000 THEN 'O' ELSE order_state END AS order_state,
               total_price, order_date, priority,
               CASE WHEN order_state = 'P' AND total_price < 450000 THEN 'O' ELSE order_state END AS order_state_label,
               CASE WHEN order_state = 'F' THEN 'closed' ELSE 'open' END AS final_outcome
        FROM {v2}""",
    "v4": """
        SELECT l_orderkey AS order_key, l_partkey AS part_key, l_suppkey AS supplier_key, l_linenumber AS line_number,
               l_quantity AS quantity, l_extendedprice AS extended_price, l_discount AS discount, l_tax AS tax,
               l_returnflag AS return_flag, l_linestatus AS line_state
        FROM {lineitem}""",
    "v5": """
        SELECT order_key, part_key, supplier_key, line_number, quantity, extended_price, discount,
               CASE WHEN tax = 0 THEN NULL ELSE tax END AS tax, return_flag, line_state FROM {v4}
        UNION ALL
        SELECT order_key, part_key, supplier_key, line_number, quantity, extended_price, discount, tax, return_flag, line_state
        FROM {v4} WHERE return_flag = 'R' AND tax > 0""",
    "v6": """
        SELECT c_custkey AS customer_key, c_name AS customer_name, n_name AS nation_name, r_name AS region_name,
               c_acctbal AS account_balance, c_mktsegment AS segment
        FROM {customer} LEFT JOIN {nation} ON c_nationkey = n_nationkey LEFT JOIN {region} ON n_regionkey = r_regionkey""",
    "v7": """
        SELECT customer_key, nation_name, region_name,
               CASE WHEN account_balance < 0 THEN NULL WHEN segment = 'MACHINERY' THEN account_balance * account_balance / 100
                    ELSE account_balance END AS account_balance,
               CASE WHEN account_balance < 0 THEN NULL WHEN segment = 'MACHINERY' THEN account_balance * account_balance / 50
                    ELSE account_balance * 2 END AS final_account_balance,
               CASE WHEN region_name = 'ASIA' THEN lower(segment) WHEN region_name = 'EUROPE' THEN concat(' ', segment)
                    ELSE segment END AS segment
        FROM {v6}""",
    "v8": """
        SELECT event_id, user_id, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS outcome_class,
               value AS amount, event_type AS event_kind
        FROM {events}""",
    "v9": """
        SELECT event_id, user_id, CASE WHEN event_kind = 'error' AND amount > 60 THEN 'error' ELSE 'ok' END AS outcome_class,
               CASE WHEN amount > 200 THEN 200.0e0 ELSE amount END AS amount, event_kind,
               amount * 2 AS amount_double, 'web' AS channel
        FROM {v8}""",
    "v10": """
        SELECT d.doc_id AS doc_id, text AS body, lang AS lang, source AS source, n_chars AS n_chars,
               CASE WHEN quality = 1 THEN 'good' WHEN quality = 0 THEN 'bad' END AS quality
        FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    "v11": """
        SELECT doc_id, trim(body) AS body, lang, CASE WHEN source = 'src0' THEN NULL ELSE source END AS source,
               length(trim(body)) AS n_chars, coalesce(quality, 'good') AS quality
        FROM {v10}""",
}

_LINE = ["quantity", "extended_price", "discount", "tax"]
# Registry of the versions above: one row each, in the order of VERSION_SCHEMA.
VERSION_ROWS = [
    (1, 1, 1, "orders", 1, None, "manual", "Evidence role: baseline", "2024-01-01 09:00:00", "classification", "order_state", "accuracy", "stratified_holdout", "all", [], "none"),
    (2, 1, 1, "orders", 2, 1, "manual", "Version notes: repeat orders appended", "2024-01-05 09:00:00", "classification", "order_state", "accuracy", "stratified_holdout", "all", [], "none"),
    (3, 1, 1, "orders", 3, 2, "feature_engineering", None, "2024-01-09 09:00:00", "classification", "order_state", "accuracy", "stratified_holdout", "all", [], "none"),
    (4, 1, 2, "lines", 1, None, "manual", "Evidence role: baseline", "2024-01-02 09:00:00", "clustering", None, "silhouette", "holdout", "selected", _LINE, "standard"),
    (5, 1, 2, "lines", 2, 4, "manual", "Known limitations: missing tax rates, duplicate returns", "2024-01-06 09:00:00", "clustering", None, "silhouette", "holdout", "selected", _LINE, "standard"),
    (6, 2, 3, "customers", 1, None, "manual", "Source description: account ledger", "2024-01-03 09:00:00", "regression", "account_balance", "rmse", "k_fold", "all", [], "none"),
    (7, 2, 3, "customers", 2, 6, "variant", "Version notes: imputation pending", "2024-01-07 09:00:00", "regression", "account_balance", "rmse", "k_fold", "all", [], "none"),
    (8, 2, 4, "events", 1, None, "manual", None, "2024-01-03 10:00:00", "classification", "outcome_class", "f1_macro", "stratified_k_fold", "all", [], "none"),
    (9, 2, 4, "events", 2, 8, "manual", "Version notes: amounts bounded", "2024-01-08 09:00:00", "classification", "outcome_class", "f1_macro", "stratified_k_fold", "all", [], "none"),
    (10, 3, 5, "documents", 1, None, "manual", "Evidence role: baseline", "2024-01-04 09:00:00", "classification", "quality", "f1_weighted", "holdout", "all", [], "none"),
    (11, 3, 5, "documents", 2, 10, "manual", "Version notes: text trimmed", "2024-01-10 09:00:00", "classification", "quality", "f1_weighted", "holdout", "all", [], "none"),
]


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


class Workspace(Evidence):
    """The versions above over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__(spark)
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return load(self.spark, self.sf_dir, name)

    @shared
    def frames(self) -> dict[int, DataFrame]:
        """Version id to DataFrame. Lazy: nothing is read here."""
        known: dict[str, DataFrame] = {}
        for name, statement in VERSION_SQL.items():
            inputs = {i: known.get(i) for i in re.findall(r"{(\w+)}", statement)}
            inputs = {i: df if df is not None else self.table(i) for i, df in inputs.items()}
            known[name] = self.spark.sql(statement, **inputs)
        return {int(name[1:]): df for name, df in known.items()}

    @shared
    def registry(self) -> DataFrame:
        return self.spark.createDataFrame(VERSION_ROWS, VERSION_SCHEMA)


_OPEN: dict[tuple[str, str], Workspace] = {}


def workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    """One workspace per session and folder, so that evidence is computed once."""
    key = (spark.sparkContext.applicationId, str(sf_dir))
    if key not in _OPEN:
        _OPEN[key] = Workspace(spark, str(sf_dir))
    return _OPEN[key]
