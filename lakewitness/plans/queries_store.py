"""Queries over sources, metadata, fingerprints and the evidence store."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakewitness import lookups as L
from lakewitness.operators import contract, diff, fingerprint, history, metadata, profile
from lakewitness.operators.value_counts import union_all
from lakewitness.plans.check_parts import digest_sql, lit
from lakewitness.plans.check_parts_risk import values
from lakewitness.plans import refresh
from lakewitness.plans.registry import part, query
from lakewitness.plans.queries_transform import SCHEMA, rounded
from lakewitness.session import cut, new_path
from lakewitness.sources import ingest, store

V = "version_id"


def fresh(ws, name: str) -> str:
    return new_path(ws.spark, f"{name}-")


# ------------------------------------------------------------------ A: sources and sinks

def csv_of(ws, v: int) -> str:
    path = fresh(ws, "csv")
    ws.frames[v].write.option("header", True).option("escape", '"').option("nullValue", "NA").options(ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return path


@query("A1_scan_csv", "SELECT customer_key, nation_name, region_name, round(account_balance, 6) AS account_balance, round(final_account_balance, 6) AS final_account_balance, segment FROM v7")
def _(ws):
    return rounded(ingest.ingest(ws.spark, csv_of(ws, 7), "csv"))


@query("A1_inferred_types", " UNION ALL ".join(
    f"SELECT '{n}' AS \"column\", '{dict(int='bigint', num='double', str='string')[k]}' AS type, count({n}) AS present FROM v2" for n, k in SCHEMA[2]))
def _(ws):
    df = ingest.scan_csv(ws.spark, csv_of(ws, 2))
    cells = F.array(*[F.struct(F.lit(n).alias("column"), F.lit(t).alias("type"), F.col(f"n_{n}").alias("present")) for n, t in df.dtypes])
    return df.agg(*[F.count(n).alias(f"n_{n}") for n in df.columns]).select(F.explode(cells).alias("c")).select("c.*")


@query("A2_freeze_version", "SELECT 1 AS dataset_id, 2 AS version_number, count(*) AS row_count, true AS second_write_refused FROM v2")
def _(ws):
    root = fresh(ws, "versions")
    store.freeze_version(ws.frames[2], root, 1, 2)
    try:
        store.freeze_version(ws.frames[2], root, 1, 2)
        refused = False
    except Exception:  # noqa: BLE001
        refused = True
    return ws.spark.read.parquet(root).groupBy("dataset_id", "version_number").agg(F.count(F.lit(1)).alias("row_count")).withColumn(
        "second_write_refused", F.lit(refused)
    )


@query("A3_write_variant", "SELECT 'csv' AS format, segment, count(*) AS n FROM v6 GROUP BY 2 UNION ALL SELECT 'parquet', segment, count(*) FROM v6 GROUP BY 2")
def _(ws):
    out = []
    for fmt in ("csv", "parquet"):
        path = store.write_variant(ws.frames[6], fresh(ws, "variant"), fmt)
        out.append(ingest.ingest(ws.spark, path, fmt).groupBy("segment").agg(F.count(F.lit(1)).alias("n")).select(F.lit(fmt).alias("format"), "segment", "n"))
    return union_all(out)


@query("A4_upsert_evidence", "SELECT version_id, col AS \"column\", missing + CASE WHEN version_id IN (2, 3) THEN 1000 ELSE 0 END AS missing_count FROM cp")
def _(ws):
    root, rows = fresh(ws, "evidence"), ws.columns.select(V, "column", "missing_count")
    store.upsert_evidence(root, "column_profile", rows)
    changed = rows.where(F.col(V).isin(2, 3)).withColumn("missing_count", F.col("missing_count") + 1000)
    path = store.upsert_evidence(root, "column_profile", changed)
    return ws.spark.read.schema(rows.schema).parquet(path)


# Version 1 has up-to-date evidence with figures no table gives: it must stay. Version 2 has outdated evidence, with a finding
# it will lose; 3 to 5 have none; 900 cannot be read.
OLD_RULES = "profile-0.9"


@query("A5_recompute_all", """
SELECT version_id, 'done' AS outcome, columns, cells, mlrs_score, lrs_score, findings, scm_score FROM (SELECT version_id FROM reg WHERE version_id BETWEEN 2 AND 5)
  JOIN (SELECT version_id, count(*) AS columns FROM cp GROUP BY 1) USING (version_id) JOIN (SELECT version_id, CAST(sum(cnt) AS BIGINT) AS cells FROM vc GROUP BY 1) USING (version_id)
  JOIN rs USING (version_id) LEFT JOIN (SELECT version_id, array_to_string(list_sort(list(code)), ',') AS findings FROM fnd GROUP BY 1) USING (version_id) LEFT JOIN (SELECT cur AS version_id, scm AS scm_score FROM psc) USING (version_id)
UNION ALL SELECT 1, 'kept', 0, 0, -1, -1, 'UNTOUCHED', NULL UNION ALL SELECT 900, 'failed', 0, 0, NULL, NULL, NULL, NULL""")
def _(ws):
    root = fresh(ws, "evidence")
    broken = ws.frames[1].withColumn("order_id", F.when(F.assert_true(F.col("order_id") < 0, "unreadable version").isNull(), F.col("order_id")))
    versions = ws.registry.where(F.col("study_id") == 1)
    versions = versions.unionByName(versions.where(F.col(V) == 1).withColumns({V: F.lit(900).cast("long"), "study_id": F.lit(0).cast("long")}))
    scores = ws.spark.createDataFrame([(1, -1.0, -1.0), (2, -2.0, -2.0)], "version_id long, mlrs_score double, lrs_score double")
    found = ws.spark.createDataFrame([(1, "UNTOUCHED"), (2, "GONE")], "version_id long, code string")
    refresh.store_evidence(root, {"risk_scores": scores, "findings": found}, versions.where(F.col(V) <= 2))
    old = refresh.read_current(ws.spark, root).where(F.col(V) == 2).withColumn("profile_rules", F.lit(OLD_RULES))
    store.upsert_evidence(root, "current", cut(old))

    outcome = refresh.refresh(ws.spark, root, versions, {**ws.frames, 900: broken})
    evidence = lambda name: refresh.read_evidence(ws.spark, root, name)
    counts = lambda name, **figures: evidence(name).groupBy(V).agg(*[f.alias(n) for n, f in figures.items()])
    return (
        versions.select(V).join(outcome, V, "left")
        .join(counts("column_profile", columns=F.count(F.lit(1))), V, "left")
        .join(counts("value_counts", cells=F.sum("cnt")), V, "left")
        .join(evidence("risk_scores").select(V, "mlrs_score", "lrs_score"), V, "left")
        .join(counts("findings", findings=F.array_join(F.sort_array(F.collect_list("code")), ",")), V, "left")
        .join(evidence("diff_scores").select(V, "scm_score"), V, "left")
        .select(V, F.coalesce("outcome", F.lit("kept")).alias("outcome"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("columns", "cells")], "mlrs_score", "lrs_score", "findings", "scm_score")
    )


@query("A6_delete_version", """
SELECT r.version_id, CASE WHEN r.parent_version_id <> 2 THEN r.parent_version_id END AS parent_version_id, n AS evidence_rows FROM reg r JOIN (SELECT version_id, count(*) AS n FROM cp GROUP BY 1) USING (version_id) WHERE version_id <> 2""")
def _(ws):
    doomed = ws.registry.where(F.col(V) == 2)
    left = store.delete_versions(ws.columns, doomed).groupBy(V).agg(F.count(F.lit(1)).alias("evidence_rows"))
    return store.detach_children(ws.registry, doomed).select(V, "parent_version_id").join(left, V)


def metrics(ws):
    return store.version_metrics(ws.tables, ws.risks, ws.findings)


part("vm", """
SELECT tp.*, round(missing_ratio * 100, 2) AS missing_pct, round(duplicate_ratio * 100, 2) AS duplicate_pct, mlrs_score, lrs_score, coalesce(n, 0) AS findings
FROM tp JOIN rs USING (version_id) LEFT JOIN (SELECT version_id, count(*) AS n FROM fnd GROUP BY 1) USING (version_id)""")
part("vmlong", """
SELECT 'V' || version_number AS v, unnest(['Rows', 'Columns', 'Missing %', 'Duplicate %', 'MLRS', 'LRS', 'Findings']) AS metric,
  unnest([row_count::DOUBLE, column_count::DOUBLE, missing_pct, duplicate_pct, mlrs_score, lrs_score, findings::DOUBLE]) AS figure FROM vm JOIN reg USING (version_id) WHERE dataset_id = 1""")


@query("A7_export_comparison", "SELECT metric, max(figure) FILTER (v = 'V1') AS \"V1\", max(figure) FILTER (v = 'V2') AS \"V2\", max(figure) FILTER (v = 'V3') AS \"V3\" FROM vmlong GROUP BY 1")
def _(ws):
    path = store.export_csv(store.comparison_table(ws.registry, metrics(ws), 1, [1, 2, 3]).coalesce(1), fresh(ws, "comparison"))
    return ws.spark.read.option("header", True).schema("metric string, V1 double, V2 double, V3 double").csv(path)


@query("A8_export_summary_json", "SELECT version_id, row_count, missing_pct, duplicate_pct, findings, mlrs_score, lrs_score FROM vm")
def _(ws):
    path = store.export_summary_json(metrics(ws), fresh(ws, "summary"))
    schema = (
        "version_id long, shape struct<row_count:long,column_count:long>, quality struct<missing_pct:double,duplicate_pct:double,findings:long>, "
        "risk struct<mlrs_score:double,lrs_score:double>"
    )
    return ws.spark.read.schema(schema).json(path).select(V, "shape.row_count", "quality.*", "risk.*")


# ------------------------------------------------------------------ B: metadata

@query("B1_table_metadata", """
SELECT version_id, row_count, column_count, names AS column_names, types AS data_types, missing AS missing_values, missing_cells AS missing_total, duplicate_rows AS duplicate_count
FROM tp JOIN (SELECT version_id, string_agg(col, ',' ORDER BY pos) AS names, string_agg(dtype, ',' ORDER BY pos) AS types, string_agg(missing::VARCHAR, ',' ORDER BY pos) AS missing FROM cp GROUP BY 1) USING (version_id)""")
def _(ws):
    return metadata.table_metadata(ws.columns, ws.tables)


@query("B2_column_inventory", "SELECT version_id, pos AS position, col AS \"column\", dtype AS logical_dtype, missing AS missing_count, missing_ratio FROM cp")
def _(ws):
    return metadata.column_inventory(ws.columns)


part("intel", """
SELECT version_id, pos AS position, col AS "column", CASE WHEN base = 'object' THEN 'categorical' ELSE 'numeric' END AS kind, role, missing AS missing_count,
  missing > 0 OR regexp_matches(lower(col), '(^id$|_id$|uuid|identifier|email|phone)') AS issue FROM cp""")


@query("B3_schema_intelligence", """SELECT *, CAST((row_number() OVER (PARTITION BY version_id ORDER BY position) - 1) // 12 AS INTEGER) AS page FROM intel""")
def _(ws):
    return metadata.schema_intelligence(ws.columns)


@query("B3_schema_search", """SELECT *, CAST((row_number() OVER (PARTITION BY version_id ORDER BY position) - 1) // 12 AS INTEGER) AS page FROM intel WHERE contains(lower("column"), 'i') AND kind = 'numeric' AND issue""")
def _(ws):
    return metadata.schema_intelligence(ws.columns, search="I", kind="numeric", issues_only=True)


@query("B4_evidence_quality", """
SELECT version_id, missing_cells, duplicate_rows, numeric_count, categorical_count, coalesce(s, '') AS suspicious_columns, coalesce(i, '') AS issue_columns FROM tp JOIN (
  SELECT version_id, count(*) FILTER (kind = 'numeric') AS numeric_count, count(*) FILTER (kind <> 'numeric') AS categorical_count,
    string_agg(CASE WHEN regexp_matches(lower("column"), '(^id$|_id$|uuid|identifier|email|phone)') THEN "column" END, ',' ORDER BY "column") AS s, string_agg(CASE WHEN issue THEN "column" END, ',' ORDER BY "column") AS i FROM intel GROUP BY 1) USING (version_id)""")
def _(ws):
    return metadata.evidence_quality(ws.columns, ws.tables)


# Every configuration as it is, and with one setting broken at a time.
BREAKS = ["none", "target", "metric", "validation", "scaling", "features"]
part("cfgs", f"""
SELECT version_id * 10 + bi AS config_id, version_id, task, CASE WHEN b = 'target' THEN 'no_such_column' ELSE target END AS target, CASE WHEN b = 'metric' THEN 'guess' ELSE metric END AS metric,
  CASE WHEN b = 'validation' THEN 'bootstrap' ELSE validation END AS validation, CASE WHEN b = 'scaling' THEN 'log' ELSE scaling END AS scaling, CASE WHEN b = 'features' THEN list_append(selected, 'ghost') ELSE selected END AS selected
FROM reg, ({values(list(enumerate(BREAKS)), 'bi, b')})""")


@query("B5_configuration_violations", f"""
SELECT config_id, version_id, violation FROM (SELECT config_id, c.version_id, unnest([
  CASE WHEN task <> 'clustering' AND NOT coalesce(list_contains(names, target), false) THEN 'target_not_in_columns' END,
  CASE WHEN (task = 'classification' AND metric NOT IN ({', '.join(lit(m) for m in L.METRICS['classification'])})) OR (task = 'regression' AND metric NOT IN ({', '.join(lit(m) for m in L.METRICS['regression'])})) THEN 'metric_not_allowed' END,
  CASE WHEN task <> 'clustering' AND validation NOT IN ({', '.join(lit(m) for m in L.VALIDATIONS)}) THEN 'validation_not_allowed' END,
  CASE WHEN task = 'clustering' AND scaling NOT IN ({', '.join(lit(m) for m in L.SCALINGS)}) THEN 'scaling_not_allowed' END,
  CASE WHEN task = 'clustering' AND NOT list_has_all(names, selected) THEN 'selected_feature_not_in_columns' END]) AS violation
FROM cfgs c JOIN (SELECT version_id, list(col) AS names FROM cat GROUP BY 1) n ON n.version_id = c.version_id) WHERE violation IS NOT NULL""")
def _(ws):
    b = F.explode(F.array(*[F.struct(F.lit(i).alias("bi"), F.lit(x).alias("b")) for i, x in enumerate(BREAKS)]))
    c = ws.configurations.withColumn("x", b)
    broken = lambda name, value, column: F.when(F.col("x.b") == name, F.lit(value)).otherwise(F.col(column)).alias(column)
    configs = c.select(
        (F.col(V) * 10 + F.col("x.bi")).alias("config_id"), V, "task_type", broken("target", "no_such_column", "target_column"),
        broken("metric", "guess", "primary_metric"), broken("validation", "bootstrap", "validation_strategy"), broken("scaling", "log", "scaling_strategy"),
        F.when(F.col("x.b") == "features", F.array_append("selected_features", F.lit("ghost"))).otherwise(F.col("selected_features")).alias("selected_features"),
    )
    return metadata.validate_configurations(configs, ws.columns)


@query("B6_parse_notes", """
SELECT p_partkey AS note_id, unnest([0, 1, 2]) AS position, unnest(['Source description', p_brand, 'Known limitations']) AS label, unnest([p_name || ' ' || p_type, 'size ' || p_size, 'sold at ' || p_retailprice || ' second line']) AS value FROM part
UNION ALL SELECT p_partkey + 1000000000, 0, 'Version notes', p_name || ' ' || p_brand FROM part""")
def _(ws):
    p = ws.table("part")
    labelled = p.select(
        F.col("p_partkey").alias("note_id"),
        F.concat(
            F.lit("source description: "), "p_name", F.lit("\n  "), "p_type", F.lit("\n\n"), "p_brand", F.lit(": size "), F.col("p_size").cast("string"),
            F.lit("\r\nKnown limitations:  sold at "), F.col("p_retailprice").cast("string"), F.lit("\nsecond line"),
        ).alias("text"),
    )
    plain = p.select((F.col("p_partkey") + 1000000000).alias("note_id"), F.concat("p_name", F.lit("\n"), "p_brand").alias("text"))
    return metadata.parse_notes(labelled.unionByName(plain), "note_id", "text")


# ------------------------------------------------------------------ C: fingerprints

part("sch", """SELECT version_id, sha256('[' || string_agg('{"dtype":"' || dtype || '","name":"' || col || '"}', ',' ORDER BY pos) || ']') AS schema_hash FROM cp GROUP BY 1""")
part("mth", """
SELECT version_id, sha256('{"column_count":' || column_count || ',"column_names":[' || names || '],"data_types":{' || types || '},"duplicate_count":' || duplicate_rows || ',"missing_total":' || missing_cells || ',"missing_values":{' || miss || '},"row_count":' || row_count || '}') AS metadata_hash
FROM tp JOIN (SELECT version_id, string_agg('"' || col || '"', ',' ORDER BY pos) AS names, string_agg('"' || col || '":"' || dtype || '"', ',' ORDER BY col) AS types, string_agg('"' || col || '":' || missing, ',' ORDER BY col) AS miss FROM cp GROUP BY 1) USING (version_id)""")
part("cfh", """
SELECT version_id, sha256('{"feature_selection_mode":"' || mode || '","primary_metric":"' || metric || '","scaling_strategy":"' || scaling || '","selected_features":[' || coalesce(array_to_string(list_transform(selected, lambda s: '"' || s || '"'), ','), '')
  || '],"target_column":' || coalesce('"' || target || '"', 'null') || ',"task_type":"' || task || '","validation_strategy":"' || validation || '"}') AS configuration_hash FROM reg""")


part("content", "\nUNION ALL ".join(
    f"SELECT {v}::BIGINT AS version_id, n AS row_count, sha256(concat_ws('|', n::VARCHAR, s0::VARCHAR, s1::VARCHAR, s2::VARCHAR, s3::VARCHAR)) AS content_hash FROM (SELECT count(*) AS n, "
    + ", ".join(f"coalesce(sum(('0x' || substr(d, {1 + 15 * i}, 15))::BIGINT::HUGEINT), 0) AS s{i}" for i in range(4)) + f" FROM (SELECT {digest_sql(v)} AS d FROM v{v}))"
    for v in SCHEMA
))
part("fpr", f"""
SELECT version_id, c.row_count, content_hash, schema_hash, metadata_hash, configuration_hash,
  sha256('{{"algorithm":"{L.FINGERPRINT_ALGORITHM}","configuration":"' || configuration_hash || '","file":"' || content_hash || '","metadata":"' || metadata_hash || '","schema":"' || schema_hash || '"}}') AS combined_fingerprint, '{L.FINGERPRINT_ALGORITHM}' AS fingerprint_algorithm
FROM content c JOIN sch USING (version_id) JOIN mth USING (version_id) JOIN cfh USING (version_id)""")


def prints(ws):
    def build():
        return fingerprint.fingerprints(
            ws.contents, fingerprint.schema_hashes(ws.columns),
            fingerprint.metadata_hashes(ws.columns, ws.tables), fingerprint.configuration_hashes(ws.configurations),
        )

    return ws.once("fingerprints", build)


@query("C1_file_hash")
def _(ws):
    return fingerprint.file_hashes(ws.spark, f"{ws.sf_dir}/*.parquet")


@query("C2_schema_hash", "SELECT * FROM sch")
def _(ws):
    return fingerprint.schema_hashes(ws.columns)


@query("C3_metadata_hash", "SELECT * FROM mth")
def _(ws):
    return fingerprint.metadata_hashes(ws.columns, ws.tables)


# A configuration per order.
CONFIGURATION = {
    "task_type": "CASE WHEN o_orderstatus = 'F' THEN 'classification' ELSE 'regression' END",
    "target_column": "CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END",
    "primary_metric": "CASE WHEN o_orderstatus = 'F' THEN 'f1' ELSE 'rmse' END",
    "validation_strategy": "CASE WHEN o_totalprice > 100000 THEN 'holdout' END",
    "feature_selection_mode": "CASE WHEN o_totalprice > 250000 THEN 'selected' ELSE 'all' END",
    "scaling_strategy": "'none'",
}
part("cfo", f"""
SELECT o_orderkey AS version_id, sha256('{{"feature_selection_mode":' || coalesce(to_json(feature_selection_mode), 'null') || ',"primary_metric":' || coalesce(to_json(primary_metric), 'null') || ',"scaling_strategy":' || coalesce(to_json(scaling_strategy), 'null')
  || ',"selected_features":[' || CASE WHEN feature_selection_mode = 'selected' THEN '"price","' || o_orderpriority || '"' ELSE '' END || '],"target_column":' || coalesce(to_json(target_column), 'null')
  || ',"task_type":' || coalesce(to_json(task_type), 'null') || ',"validation_strategy":' || coalesce(to_json(validation_strategy), 'null') || '}}') AS configuration_hash
FROM (SELECT o_orderkey, o_orderpriority, {", ".join(f"{sql} AS {c}" for c, sql in CONFIGURATION.items())} FROM orders)""")


@query("C4_configuration_hash", "SELECT version_id, configuration_hash FROM cfo")
def _(ws):
    chosen = "CASE WHEN o_totalprice > 250000 THEN array('price', o_orderpriority) END AS selected_features"
    orders = ws.table("orders").selectExpr("o_orderkey AS version_id", chosen, *[f"{sql} AS {c}" for c, sql in CONFIGURATION.items()])
    return fingerprint.configuration_hashes(orders)


@query("C5_combined_fingerprint", "SELECT * FROM fpr")
def _(ws):
    return prints(ws)


def shuffled_contents(ws):
    """Content hashes of the same rows, dealt and ordered in another way."""
    return ws.once("shuffled_contents", lambda: fingerprint.content_hashes({v: df.repartition(7, *[F.col(f"`{c}`") for c in df.columns[:1]]) for v, df in ws.frames.items()}))


@query("C6_content_hash", "SELECT version_id, row_count, content_hash, true AS order_does_not_matter, count(*) OVER (PARTITION BY content_hash) = 1 AS only_here FROM content")
def _(ws):
    again = shuffled_contents(ws).select(V, F.col("content_hash").alias("other"))
    repeated = prints(ws).groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"))
    return prints(ws).join(again, V).join(repeated, "content_hash").select(
        V, "row_count", "content_hash", (F.col("content_hash") == F.col("other")).alias("order_does_not_matter"), (F.col("n") == 1).alias("only_here")
    )


@query("C7_recreation_bundle", """
SELECT version_id, dataset_name, version_number, parent_version_id, row_count, column_count, schema_hash, metadata_hash, configuration_hash, task AS task_type, target AS target_column FROM reg JOIN tp USING (version_id) JOIN sch USING (version_id) JOIN mth USING (version_id) JOIN cfh USING (version_id)""")
def _(ws):
    return fingerprint.recreation_bundles(ws.versions, prints(ws)).select(
        V, "dataset_name", "version_number", "parent_version_id", "row_count", "column_count", "schema_hash", "metadata_hash", "configuration_hash", "task_type", "target_column"
    )


@query("C8_verify_recreation", """
SELECT version_id, bundle_id, content_hash_matched, schema_hash_matched, metadata_hash_matched, configuration_hash_matched, combined_fingerprint_matched, fingerprint_algorithm_matched, passed_checks, 6 AS total_checks,
  round(passed_checks::DOUBLE / 6 * 100, 2) AS similarity_rate, row_delta, column_delta, row_delta = 0 AND column_delta = 0 AS shape_match, passed_checks = 6 AS matched FROM (
  SELECT *, content_hash_matched::INT + schema_hash_matched::INT + metadata_hash_matched::INT + configuration_hash_matched::INT + combined_fingerprint_matched::INT + 1 AS passed_checks FROM (
    SELECT a.version_id, b.version_id AS bundle_id, a.content_hash = b.content_hash AS content_hash_matched, a.schema_hash = b.schema_hash AS schema_hash_matched, a.metadata_hash = b.metadata_hash AS metadata_hash_matched,
      a.configuration_hash = b.configuration_hash AS configuration_hash_matched, a.combined_fingerprint = b.combined_fingerprint AS combined_fingerprint_matched, true AS fingerprint_algorithm_matched, a.row_count - b.row_count AS row_delta, a.column_count - b.column_count AS column_delta
    FROM (SELECT reg.*, fpr.* EXCLUDE (version_id, row_count), tp.row_count, tp.column_count FROM reg JOIN tp USING (version_id) JOIN fpr USING (version_id)) a
    JOIN (SELECT fpr.* EXCLUDE (row_count), tp.row_count, tp.column_count FROM tp JOIN fpr USING (version_id)) b ON b.version_id = a.version_id OR b.version_id = a.parent_version_id))""")
def _(ws):
    bundles = fingerprint.recreation_bundles(ws.versions, prints(ws))
    # The candidates are the same rows in another order, read and hashed again.
    hashes = fingerprint.fingerprints(
        shuffled_contents(ws), fingerprint.schema_hashes(ws.columns), fingerprint.metadata_hashes(ws.columns, ws.tables), fingerprint.configuration_hashes(ws.configurations)
    )
    own = fingerprint.recreation_bundles(ws.versions, hashes).withColumn("bundle_id", F.col(V))
    parent = bundles.where(F.col("parent_version_id").isNotNull()).withColumn("bundle_id", F.col("parent_version_id"))
    return fingerprint.verify_recreation(own.unionByName(parent), bundles)


# ------------------------------------------------------------------ K: evidence store
# A ledger at the size of the orders table: one version per order, one dataset per customer, one study
# per nation, one owner per region. Scores and rulesets follow from the order.
part("led", """
SELECT o_orderkey AS version_id, o_custkey AS dataset_id, c_nationkey::BIGINT AS study_id, n_regionkey::BIGINT AS owner_id, o_orderdate AS created_at, CASE o_orderpriority WHEN '1-URGENT' THEN 'variant' ELSE 'manual' END AS generation_method,
  CASE WHEN o_orderstatus <> 'P' THEN round(o_totalprice / 5000, 2) END AS mlrs_score, o_orderstatus AS st, o_orderpriority AS pr
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
part("num", """
SELECT *, CAST(row_number() OVER w AS INTEGER) AS version_number, lag(version_id) OVER w AS parent_version_id FROM led WINDOW w AS (PARTITION BY dataset_id ORDER BY created_at, version_id)""")


def ledger(ws):
    def build():
        orders, customer, nation = ws.table("orders"), ws.table("customer"), ws.table("nation")
        joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        rows = joined.select(
            F.col("o_orderkey").alias(V),
            F.col("o_custkey").alias("dataset_id"),
            F.col("c_nationkey").cast("long").alias("study_id"),
            F.col("n_regionkey").cast("long").alias("owner_id"),
            F.col("o_orderdate").alias("created_at"),
            F.when(F.col("o_orderpriority") == "1-URGENT", "variant").otherwise("manual").alias("generation_method"),
            F.when(F.col("o_orderstatus") != "P", F.round(F.col("o_totalprice") / 5000, 2)).alias("mlrs_score"),
            F.col("o_orderstatus").alias("st"),
            F.col("o_orderpriority").alias("pr"),
            F.lit(0).alias("existing"),
        )
        numbers = history.number_versions(rows, ws.buckets)
        return rows.drop("existing").join(numbers.select(V, "version_number", "parent_version_id"), V)

    return ws.once("ledger", build)


def ledger_risks(ws):
    return ledger(ws).where(F.col("mlrs_score").isNotNull()).select(V, "mlrs_score", F.lit(0.0).alias("lrs_score"))


@query("K1_number_versions", "SELECT version_id, dataset_id, version_number, parent_version_id FROM num")
def _(ws):
    return ledger(ws).select(V, "dataset_id", "version_number", "parent_version_id")


# A tree per conversation: turn t answers turn (t - 1) / 2.
part("tree", "SELECT conv_id * 100000 + turn AS version_id, CASE WHEN turn > 0 THEN conv_id * 100000 + (turn - 1) // 2 END AS parent_version_id, CAST(turn + 1 AS INTEGER) AS version_number FROM conversations")
part("walk", """/* RECURSION */ SELECT version_id, 0 AS depth, lpad(version_number::VARCHAR, 19, '0') AS path, version_id AS root_id FROM tree WHERE parent_version_id IS NULL
UNION ALL SELECT t.version_id, depth + 1, path || '/' || lpad(t.version_number::VARCHAR, 19, '0'), root_id FROM tree t JOIN walk ON t.parent_version_id = walk.version_id""")


@query("K2_lineage_tree", "SELECT version_id, depth, path, root_id FROM walk")
def _(ws):
    turn = F.col("turn")
    tree = ws.table("conversations").select(
        (F.col("conv_id") * 100000 + turn).alias(V),
        F.when(turn > 0, F.col("conv_id") * 100000 + F.floor((turn - 1) / 2)).alias("parent_version_id"),
        (turn + 1).cast("int").alias("version_number"),
    )
    return history.lineage_tree(tree)


@query("K3_node_kinds", "SELECT version_id, CASE WHEN parent_version_id IS NULL THEN 'baseline' WHEN generation_method <> 'manual' THEN 'variant' ELSE 'revision' END AS node_kind, parent_version_id IS NULL AS is_root FROM num")
def _(ws):
    return history.node_kinds(ledger(ws))


# The selected version of a dataset is its newest diagnosed one.
part("sel", "SELECT dataset_id, max(version_number) AS upto FROM num WHERE mlrs_score IS NOT NULL GROUP BY 1")


@query("K4_timeline", """
SELECT num.version_id, num.dataset_id, version_number, CASE WHEN parent_version_id IS NOT NULL AND pr <> '2-HIGH' THEN coalesce(mlrs_score, 0) END AS scm_score FROM num JOIN sel USING (dataset_id) WHERE version_number <= upto""")
def _(ws):
    led = ledger(ws)
    newest = led.where(F.col("mlrs_score").isNotNull()).groupBy("dataset_id").agg(F.max_by(V, "version_number").alias(V)).select(V)
    diffs = led.where(F.col("parent_version_id").isNotNull() & (F.col("pr") != "2-HIGH")).select(
        V, F.coalesce("mlrs_score", F.lit(0.0)).alias("scm_score")
    )
    return history.timeline(led, newest, diffs).select(V, "dataset_id", "version_number", "scm_score")


@query("K5_latest_log_row", "SELECT event_type AS action, user_id AS entity_id, max(event_id) AS log_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def _(ws):
    log = ws.table("events").select(F.col("event_type").alias("action"), F.col("user_id").alias("entity_id"), "ts", F.col("event_id").alias("log_id"), "value")
    return history.latest(log, ["action", "entity_id"], ["log_id"], ["value"])


part("stat", """
SELECT version_id, study_id, CASE WHEN mlrs_score IS NULL THEN 'Not Diagnosed' WHEN pr = '5-LOW' OR created_at < TIMESTAMP '1996-01-01' OR st = 'O' AND pr = '3-MEDIUM' OR (parent_version_id IS NOT NULL AND pr = '2-HIGH') THEN 'Recompute Available' ELSE 'Diagnosed' END AS diagnosis_status FROM num""")


def status(ws):
    led = ledger(ws)
    profiles = led.where(F.col("pr") != "5-LOW").select(V, F.when(F.col("created_at") < "1996-01-01", "profile-0.9").otherwise(L.PROFILER).alias("ruleset"))
    diagnoses = led.where(F.col("mlrs_score").isNotNull()).select(
        V, F.when((F.col("st") == "O") & (F.col("pr") == "3-MEDIUM"), "diagnosis-1.0").otherwise(L.DIAGNOSIS_RULES).alias("ruleset")
    )
    diffs = led.where(F.col("parent_version_id").isNotNull() & (F.col("pr") != "2-HIGH")).select(V, F.lit(L.SEMANTIC_RULES).alias("ruleset"))
    return history.diagnosis_status(led, profiles, diagnoses, diffs)


@query("K6_diagnosis_status", "SELECT version_id, diagnosis_status FROM stat")
def _(ws):
    return status(ws)


@query("K7_stale_versions", "SELECT version_id, diagnosis_status FROM stat WHERE diagnosis_status <> 'Diagnosed'")
def _(ws):
    return history.stale_versions(status(ws))


@query("K8_without_report", "SELECT version_id FROM num WHERE version_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')")
def _(ws):
    reports = ws.table("lineitem").where(F.col("l_returnflag") == "A").select(F.col("l_orderkey").alias(V))
    return history.without_report(ledger(ws), reports).select(V)


@query("K9_recent_versions", "SELECT study_id, version_id FROM (SELECT study_id, version_id, row_number() OVER (PARTITION BY study_id ORDER BY version_id DESC) AS r FROM num) WHERE r <= 3 ORDER BY study_id DESC, version_id DESC LIMIT 40")
def _(ws):
    return history.recent_versions(ledger(ws), 3, 40)


part("studies", "SELECT n_nationkey::BIGINT AS study_id, n_regionkey::BIGINT AS owner_id, n_name AS name FROM nation")


def studies(ws):
    return ws.table("nation").select(F.col("n_nationkey").cast("long").alias("study_id"), F.col("n_regionkey").cast("long").alias("owner_id"), F.col("n_name").alias("name"))


@query("K10_owner_dashboard", """
SELECT owner_id, count(*) AS total_studies, CAST(coalesce(sum(d), 0) AS BIGINT) AS total_datasets, CAST(coalesce(sum(v), 0) AS BIGINT) AS total_versions, count(*) FILTER (h) AS high_risk_studies FROM studies
LEFT JOIN (SELECT study_id, count(DISTINCT dataset_id) AS d, count(*) AS v, bool_or(coalesce(mlrs_score >= 60, false)) AS h FROM num GROUP BY 1) USING (study_id) GROUP BY 1""")
def _(ws):
    return history.dashboard(studies(ws), ledger(ws).drop("mlrs_score"), ledger_risks(ws))


@query("K11_recent_diagnoses", "SELECT version_id, mlrs_score FROM num WHERE mlrs_score IS NOT NULL ORDER BY created_at DESC, version_id DESC LIMIT 6")
def _(ws):
    return history.newest(ledger(ws).where(F.col("mlrs_score").isNotNull()), ["created_at", V], 6).select(V, "mlrs_score")


@query("K11_recent_activity", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 8")
def _(ws):
    return history.newest(ws.table("events"), ["ts", "event_id"], 8).select("event_id", "event_type")


@query("K12_study_findings", """
SELECT study_id, dataset_id, num.version_id, version_number, mlrs_score, coalesce(n, 0) AS finding_count FROM num LEFT JOIN (SELECT l_orderkey AS version_id, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) f ON f.version_id = num.version_id""")
def _(ws):
    found = ws.table("lineitem").where(F.col("l_returnflag") == "R").groupBy(F.col("l_orderkey").alias(V)).agg(F.count(F.lit(1)).alias("finding_count"))
    return history.study_findings(ledger(ws).drop("mlrs_score"), ledger_risks(ws), found).drop("lrs_score")


@query("K13_study_summary", """
SELECT study_id, count(*) AS version_count, round(avg(mlrs_score), 1) AS average_mlrs, max(mlrs_score) AS max_mlrs, CASE WHEN max(mlrs_score) IS NULL THEN 'neutral' WHEN max(mlrs_score) >= 70 THEN 'high' WHEN max(mlrs_score) >= 40 THEN 'medium' ELSE 'low' END AS tone FROM num GROUP BY 1""")
def _(ws):
    return history.study_summary(ledger(ws).drop("mlrs_score"), ledger_risks(ws))


@query("K14_study_search", "SELECT p_partkey AS study_id, p_name AS name, p_type AS ml_task, p_retailprice AS updated_at FROM part WHERE contains(lower(p_name), 'ring') AND p_type = 'ECONOMY'")
def _(ws):
    shelf = ws.table("part").select(F.col("p_partkey").alias("study_id"), F.col("p_name").alias("name"), F.col("p_type").alias("ml_task"), F.col("p_retailprice").alias("updated_at"))
    return history.search_studies(shelf, "RING", "ECONOMY")


part("own_stat", "SELECT version_id, CASE WHEN scm IS NULL AND parent_version_id IS NOT NULL THEN 'Recompute Available' ELSE 'Diagnosed' END AS diagnosis_status FROM fx")


def own_status(ws):
    ruled = lambda df, rule: df.select(V, F.lit(rule).alias("ruleset"))
    diffs = ws.diff.scores.select(F.col("current_version_id").alias(V))
    return history.diagnosis_status(ws.registry, ruled(ws.tables, L.PROFILER), ruled(ws.risks, L.DIAGNOSIS_RULES), ruled(diffs, L.SEMANTIC_RULES))


@query("K15_datasets_overview", """
SELECT r.version_id, dataset_id, dataset_name, version_number, method AS generation_method, created_at, task AS task_type, target AS target_column, schema_hash, configuration_hash, row_count, column_count, missing_ratio, duplicate_ratio,
  mlrs_score, lrs_score, findings AS finding_count, diagnosis_status FROM reg r JOIN vm USING (version_id) JOIN sch USING (version_id) JOIN cfh USING (version_id) JOIN own_stat USING (version_id)""")
def _(ws):
    return history.datasets_overview(ws.registry, ws.configurations, prints(ws), ws.tables, ws.risks, ws.findings, own_status(ws))


@query("K16_report_metrics", """
SELECT r.version_id, scm AS scm_score, dsi AS dsi_score, mlrs_score, lrs_score, findings AS finding_count, row_change AS row_count_change, column_change AS column_count_change, missing_change AS missing_ratio_change, dup_change AS duplicate_row_delta, column_count AS profile_columns
FROM reg r JOIN vm USING (version_id) LEFT JOIN facts0 f ON f.version_id = r.version_id LEFT JOIN pmo ON pmo.pair_id = f.pair_id LEFT JOIN psc ON psc.pair_id = f.pair_id""")
def _(ws):
    ws.ahead()
    return history.report_metrics(ws.registry, ws.diff.scores, ws.diff.overall, ws.diff.duplicates, ws.risks, ws.findings, ws.tables)


part("ins", """
SELECT r.version_id, dataset_name || ' V' || version_number || ': MLRS ' || printf('%.1f', round(mlrs_score, 1)) || ', LRS ' || printf('%.1f', round(lrs_score, 1)) || '. ' || CASE WHEN scm IS NOT NULL THEN 'SCM ' || printf('%.1f', round(scm, 1)) || ' and DSI ' || printf('%.1f', round(dsi, 1)) || ' versus parent version.' ELSE 'Baseline version; SCM and DSI are not applicable.' END AS summary,
  missing_cells || ' missing cells, ' || duplicate_rows || ' duplicate rows' AS quality, coalesce(fc, 0) AS finding_count, coalesce(hp, 0) AS high_priority, coalesce(tf, 'No deterministic finding crossed reporting thresholds.') AS top_findings,
  CASE WHEN mlrs_score >= 45 OR lrs_score >= 20 OR scm IS NOT NULL THEN concat_ws('|', CASE WHEN mlrs_score >= 45 THEN 'Review readiness findings before model experimentation.' END, CASE WHEN lrs_score >= 20 THEN 'Inspect leakage-related evidence before training.' END,
    CASE WHEN scm IS NOT NULL THEN 'Check whether parent-to-child semantic movement was intentional.' END) ELSE 'Continue with reproducibility review and export the version bundle when needed.' END AS actions
FROM reg r JOIN tp USING (version_id) JOIN rs USING (version_id) LEFT JOIN psc ON psc.cur = r.version_id
LEFT JOIN (SELECT version_id, count(*) AS fc, count(*) FILTER (severity IN ('critical', 'high')) AS hp, string_agg(issue, '|' ORDER BY ordinal) FILTER (rn <= 5) AS tf FROM (SELECT *, row_number() OVER (PARTITION BY version_id ORDER BY ordinal) AS rn FROM fnd) GROUP BY 1) x ON x.version_id = r.version_id""")


def insights(ws):
    ws.ahead()
    return history.instant_insights(ws.registry, ws.tables, ws.risks, ws.findings, ws.diff.scores)


@query("K17_instant_insight", "SELECT * FROM ins")
def _(ws):
    return insights(ws)


@query("K18_new_insights", "SELECT version_id, sha256(version_id || '|' || summary || '|' || quality || '|' || finding_count) AS evidence_hash FROM ins WHERE version_id NOT IN (SELECT version_id FROM reg WHERE parent_version_id IS NULL)")
def _(ws):
    rows = insights(ws)
    baseline = rows.join(ws.registry.where(F.col("parent_version_id").isNull()).select(V), V, "left_semi")
    known = history.new_insights(baseline, ws.spark.createDataFrame([], "evidence_hash string"))
    return history.new_insights(rows, known).select(V, "evidence_hash")


@query("K19_compact_context", """
SELECT r.version_id, dataset_name, version_number, task AS task_type, target AS target_column, CAST(len(selected) AS INTEGER) AS selected_feature_count, row_count, column_count, missing_cells, duplicate_rows,
  (SELECT count(*) FROM hc WHERE hc.version_id = r.version_id) AS high_correlation_count,
  coalesce((SELECT string_agg(col, ',' ORDER BY rk) FROM (SELECT version_id, col, row_number() OVER (PARTITION BY version_id ORDER BY missing_ratio DESC, pos) AS rk FROM cp WHERE missing > 0) m WHERE m.version_id = r.version_id AND rk <= 8), '') AS top_missing,
  coalesce((SELECT string_agg(col, ',' ORDER BY rk) FROM (SELECT version_id, col, row_number() OVER (PARTITION BY version_id ORDER BY outliers DESC, pos) AS rk FROM cp WHERE outliers > 0) m WHERE m.version_id = r.version_id AND rk <= 8), '') AS top_outliers,
  coalesce((SELECT string_agg(code || ':' || severity, ',' ORDER BY ordinal) FROM fnd WHERE fnd.version_id = r.version_id), '') AS findings,
  coalesce((SELECT string_agg(col, ',' ORDER BY rk) FROM (SELECT pair_id, col, row_number() OVER (PARTITION BY pair_id ORDER BY score DESC, col) AS rk FROM psh WHERE NOT is_target) m WHERE m.pair_id = r.version_id AND rk <= 5), '') AS top_shifted
FROM reg r JOIN tp USING (version_id)""")
def _(ws):
    return history.compact_context(
        ws.registry, ws.configurations, ws.tables, ws.findings, ws.correlations, profile.worst_columns(ws.columns, "missing"),
        profile.worst_columns(ws.columns, "outlier"), diff.top_shifted(ws.diff.shifts),
    )


@query("K20_version_ledger", """
SELECT r.version_id, study_id, 'V' || version_number AS version, coalesce(parent_version_id::VARCHAR, 'Baseline') AS parent, row_count, column_count, schema_hash[1:16] AS schema, mlrs_score, lrs_score, scm AS scm_score, dsi AS dsi_score, findings AS finding_count
FROM reg r JOIN vm USING (version_id) JOIN sch USING (version_id) LEFT JOIN psc ON psc.cur = r.version_id""")
def _(ws):
    ws.ahead(lambda: ws.contents)
    return history.version_ledger(ws.versions, prints(ws), ws.risks, ws.diff.scores, ws.findings)


@query("K21_study_status", """
SELECT study_id, 'Complete' AS protocol, CASE WHEN n > 0 THEN 'Complete' ELSE 'Not started' END AS version_created, CASE WHEN p > 0 THEN 'Complete' ELSE 'Not available' END AS fingerprint, CASE WHEN d > 0 THEN 'Complete' ELSE 'Not available' END AS diagnosis
FROM studies LEFT JOIN (SELECT study_id, count(*) AS n, count(*) FILTER (pr = '1-URGENT') AS p, count(mlrs_score) AS d FROM num GROUP BY 1) USING (study_id)""")
def _(ws):
    led = ledger(ws)
    return history.study_progress(studies(ws), led, led.where(F.col("pr") == "1-URGENT"), ledger_risks(ws))


# Protocols at the size of the part table, and protocol edits at the size of the orders table.
PROTOCOL = {
    "ml_task": "p_type", "domain": "CASE WHEN p_size > 25 THEN p_brand END", "research_objective": "p_name", "research_question": "CASE WHEN p_size < 10 THEN '' ELSE p_name END",
    "hypothesis": "CASE WHEN p_retailprice > 920 THEN p_name END", "target_column": "p_brand", "primary_metric": "CASE WHEN p_type = 'ECONOMY' THEN 'accuracy' ELSE '' END",
    "baseline_model": "p_type", "validation_strategy": "CASE WHEN p_size > 40 THEN 'holdout' END", "random_seed": "CASE WHEN p_size = 1 THEN 0 WHEN p_size = 2 THEN NULL ELSE p_size END",
}
GAPS = ", ".join(f"CASE WHEN {sql} IS NULL {'' if c == 'random_seed' else f'OR {sql} = {chr(39)}{chr(39)}'} THEN '{c}' END" for c, sql in PROTOCOL.items())


@query("K22_protocol_completeness", f"SELECT p_partkey AS protocol_id, CAST(100 - 10 * len(g) AS INTEGER) AS completeness_score, array_to_string(g, ',') AS missing_fields FROM (SELECT p_partkey, list_filter([{GAPS}], lambda x: x IS NOT NULL) AS g FROM part)")
def _(ws):
    protocols = ws.table("part").select(F.col("p_partkey").alias("protocol_id"), *[F.expr(sql).alias(c) for c, sql in PROTOCOL.items()])
    return history.completeness(protocols).select("protocol_id", "completeness_score", F.array_join("missing_fields", ",").alias("missing_fields"))


EDIT = {
    "ml_task": "CASE WHEN o_orderstatus = 'F' THEN 'classification' ELSE 'regression' END", "domain": "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'sales' WHEN o_orderpriority = '3-MEDIUM' THEN '' END",
    "data_quality_focus": "CASE WHEN o_totalprice > 200000 THEN 'missingness' WHEN o_totalprice > 100000 THEN 'duplicates' END",
    "research_objective": "'forecast'", "research_question": "CASE WHEN o_orderpriority <> '5-LOW' THEN 'which' END", "hypothesis": "CASE WHEN o_totalprice > 250000 THEN 'large' END", "target_column": "'price'",
    "primary_metric": "CASE WHEN o_orderstatus = 'F' THEN 'accuracy' ELSE 'rmse' END", "baseline_model": "CAST(NULL AS STRING)", "validation_strategy": "'holdout'", "random_seed": "CASE WHEN o_orderstatus = 'O' THEN 0 WHEN o_orderstatus = 'F' THEN 7 END",
    "feature_scope": "CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'all' WHEN o_orderpriority = '2-HIGH' THEN '' END", "intended_use_case": "CASE WHEN o_totalprice < 50000 THEN 'pilot' END",
}
FIELDS = list(EDIT)
assert FIELDS == L.PROTOCOL_FIELDS
part("edits", "SELECT o_custkey AS study_id, o_orderkey AS edit_id, o_orderdate AS created_at, " + ", ".join(f"{sql} AS {c}" for c, sql in EDIT.items()) + " FROM orders")
SAME = " AND ".join(f"{c} IS NOT DISTINCT FROM lag({c}) OVER w" for c in FIELDS)
part("prot", f"""
SELECT *, CAST(row_number() OVER w AS INTEGER) AS version_number, lead(created_at) OVER w AS superseded_at FROM (SELECT * FROM (SELECT *, lag(edit_id) OVER w IS NULL OR NOT ({SAME}) AS moved FROM edits WINDOW w AS (PARTITION BY study_id ORDER BY created_at, edit_id)) WHERE moved)
WINDOW w AS (PARTITION BY study_id ORDER BY created_at, edit_id)""")


def protocols(ws):
    def build():
        edits = ws.table("orders").select(F.col("o_custkey").alias("study_id"), F.col("o_orderkey").alias("edit_id"), F.col("o_orderdate").alias("created_at"), *[F.expr(s).alias(c) for c, s in EDIT.items()])
        return history.protocol_versions(edits, "study_id", "created_at", "edit_id", FIELDS, ws.buckets)

    return ws.once("protocols", build)


@query("K23_protocol_versions", """
SELECT study_id, edit_id, version_number, strftime(superseded_at, '%Y-%m-%d') AS superseded_at, CASE WHEN superseded_at IS NULL THEN 'current' ELSE 'archived' END AS status FROM prot""")
def _(ws):
    return protocols(ws).select("study_id", "edit_id", F.col("version_number").cast("int").alias("version_number"), F.date_format("superseded_at", "yyyy-MM-dd").alias("superseded_at"), "status")


def field_list(test: str) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {test.format(c=c)} THEN '{c}' END" for c in FIELDS) + ")"


SCORE = " + ".join(f"CASE WHEN {{t}}.{c} IS NOT NULL {'' if c == 'random_seed' else f'AND {{t}}.{c} <> {chr(39)}{chr(39)}'} THEN 10 ELSE 0 END" for c in L.COMPLETENESS_FIELDS)
GIVEN = "coalesce({t}.{c}::VARCHAR NOT IN ('', '0'), false)"
CHANGED = "b.{c} IS DISTINCT FROM a.{c}"


@query("K24_protocol_diffs", f"""
SELECT b.study_id, b.version_number, true AS hash_changed, CAST(({SCORE.format(t='b')}) - ({SCORE.format(t='a')}) AS INTEGER) AS completeness_delta, {field_list(CHANGED)} AS fields_changed,
  {field_list(CHANGED + ' AND NOT ' + GIVEN.replace('{t}', 'a') + ' AND ' + GIVEN.replace('{t}', 'b'))} AS fields_added, {field_list(CHANGED + ' AND ' + GIVEN.replace('{t}', 'a') + ' AND NOT ' + GIVEN.replace('{t}', 'b'))} AS fields_removed
FROM prot b JOIN prot a ON a.study_id = b.study_id AND a.version_number + 1 = b.version_number""")
def _(ws):
    rows = protocols(ws).withColumn("version_number", F.col("version_number").cast("int"))
    return history.protocol_diffs(rows, "study_id", FIELDS)


# Studies are nations, their datasets the customers, versions the orders; evidence is missing where an order says so.
part("study0", "SELECT study_id, min(created_at) AS created_at FROM num GROUP BY 1")
part("lastv", "SELECT study_id, arg_max(version_id, (created_at, version_id)) AS version_id FROM num GROUP BY 1")


@query("K25_study_timeline", """
SELECT study_id, event, strftime(created_at, '%Y-%m-%d') AS created_at FROM (
  SELECT study_id, 'Study Created' AS event, created_at FROM study0
  UNION ALL SELECT study_id, 'Dataset Registered: ' || dataset_id, min(created_at) FROM num GROUP BY study_id, dataset_id
  UNION ALL SELECT study_id, 'Version Created: V' || version_number, created_at FROM num
  UNION ALL SELECT study_id, 'Fingerprint Generated: V' || version_number, created_at FROM num WHERE pr <> '4-NOT SPECIFIED'
  UNION ALL SELECT study_id, 'Diagnosis Generated', max(created_at) FROM num WHERE mlrs_score IS NOT NULL GROUP BY 1)""")
def _(ws):
    led = ledger(ws)
    out = history.study_timeline(
        led.groupBy("study_id").agg(F.min("created_at").alias("created_at")),
        led.groupBy("study_id", F.col("dataset_id").cast("string").alias("dataset_name")).agg(F.min("created_at").alias("created_at")),
        led,
        led.where(F.col("pr") != "4-NOT SPECIFIED"),
        led.where(F.col("mlrs_score").isNotNull()).groupBy("study_id").agg(F.max("created_at").alias("created_at")),
    )
    return out.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd"))


def claimed(*tests: str) -> str:
    titles = ("Dataset Registered", "Diagnosis Complete", "Dataset Version Verified", "Reproducibility Proven", "Intervention Improves Performance", "Experiments Required")
    return "concat_ws('|', " + ", ".join(f"CASE WHEN {t} THEN '{title}' END" for title, t in zip(titles, tests)) + ")"


@query("K25_overview_gaps", f"""
SELECT study_id, version_id AS newest_version_id,
  concat_ws('|', CASE WHEN NOT ds THEN 'No Dataset Registered' END, CASE WHEN ds AND version_id IS NULL THEN 'No Immutable Version' END,
    CASE WHEN version_id IS NOT NULL AND pr = '3-MEDIUM' AND study_id % 2 = 0 THEN 'Target Column Missing' END, CASE WHEN version_id IS NOT NULL AND NOT dg THEN 'Diagnosis Not Generated' END,
    CASE WHEN version_id IS NOT NULL AND NOT cmp AND parent_version_id IS NOT NULL THEN 'Semantic Diff Unavailable' END, CASE WHEN version_id IS NOT NULL AND NOT fp THEN 'Recreation Bundle Missing' END,
    CASE WHEN ctr AND st = 'F' THEN 'Pending Human Decisions' END, CASE WHEN dg AND NOT ctr THEN 'Variant Planning Not Started' END) AS gaps,
  {claimed('ds', 'dg', 'fp', 'false', 'false', 'ctr')} AS supported_claims, {claimed('NOT ds', 'NOT dg', 'NOT fp', 'true', 'true', 'NOT ctr')} AS unsupported_claims,
  concat_ws('|', CASE WHEN version_id IS NOT NULL AND NOT fp THEN 'Missing fingerprint' END, CASE WHEN version_id IS NOT NULL AND NOT prof THEN 'Missing profile report' END,
    CASE WHEN version_id IS NOT NULL AND NOT cmp THEN 'Version has no semantic diff because it is baseline' END, CASE WHEN version_id IS NOT NULL AND NOT prof THEN 'Registration completed but no analysis loaded' END) AS integrity_warnings
FROM (SELECT s.study_id, n.version_id, n.parent_version_id, n.pr, n.st, s.study_id IN (SELECT c_nationkey FROM customer) AS ds, coalesce(n.mlrs_score IS NOT NULL, false) AS dg, coalesce(n.pr <> '4-NOT SPECIFIED', false) AS fp,
    coalesce(n.pr <> '5-LOW', false) AS prof, coalesce(n.parent_version_id IS NOT NULL AND n.pr <> '2-HIGH', false) AS cmp, coalesce(n.mlrs_score IS NOT NULL AND n.pr <> '1-URGENT', false) AS ctr
  FROM (SELECT n_nationkey AS study_id FROM nation UNION ALL SELECT 1000 UNION ALL SELECT 1001) s LEFT JOIN lastv l ON l.study_id = s.study_id LEFT JOIN num n ON n.version_id = l.version_id)""".replace("s.study_id IN (SELECT c_nationkey FROM customer)", "(s.study_id IN (SELECT c_nationkey FROM customer) OR s.study_id = 1001)"))
def _(ws):
    led = ledger(ws)
    # Two studies more: one without a dataset, one with a dataset and no version.
    extra = ws.spark.createDataFrame([(1000,), (1001,)], "study_id long")
    diagnosed = led.where(F.col("mlrs_score").isNotNull())
    return history.study_overviews(
        studies(ws).select("study_id").unionByName(extra),
        ws.table("customer").select(F.col("c_nationkey").cast("long").alias("study_id")).unionByName(extra.where("study_id = 1001")),
        led,
        led.select(V, F.when(F.col("pr") != "3-MEDIUM", "price").alias("target_column")),
        led.where(F.col("pr") != "4-NOT SPECIFIED"),
        led.where(F.col("pr") != "5-LOW"),
        diagnosed,
        led.where(F.col("parent_version_id").isNotNull() & (F.col("pr") != "2-HIGH")),
        diagnosed.where(F.col("pr") != "1-URGENT").select(V, F.when(F.col("st") == "F", 1).otherwise(0).alias("human_decisions")),
        studies(ws).select("study_id", F.when(F.col("study_id") % 2 == 1, "price").otherwise("").alias("target_column")),
    )
