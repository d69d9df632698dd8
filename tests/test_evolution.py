"""Built variants, refreshed evidence, lineage and components against plain versions."""

import hashlib
import random
import re

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from lakewitness import lookups as L
from lakewitness.functions.components import components
from lakewitness.operators import evaluate, history, transforms, variants
from lakewitness.plans import refresh
from lakewitness.plans.evidence import VERSION_SCHEMA, Evidence
from lakewitness.sources.store import upsert_evidence

V = "version_id"


def registry(spark, rows):
    """Rows of (version, parent, task, target)."""
    full = [(v, 1, 1, "d", i + 1, parent, "manual", "note", "2024-01-01", task, target, "m", "v", "all", [], "none") for i, (v, parent, task, target) in enumerate(rows)]
    return spark.createDataFrame(full, VERSION_SCHEMA)


# ---- variants
def plan(version, *steps, source=1, most=None):
    return variants.Plan(version, 7, "fairness", version, f"V7-Pipeline-{version}", "h", source, "low", tuple(steps), most)


def test_shared_beginnings_are_made_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(variants, "known_steps", lambda: {n: (lambda name: lambda df, ctx, **p: made.append(name) or df.withColumn(name, F.lit(len(made))))(n) for n in "abcde"})
    df = spark.createDataFrame([(1.0,)], "x double")
    todo = [plan(10, ("a", "{}"), ("b", "{}"), ("c", "{}")), plan(11, ("a", "{}"), ("b", "{}"), ("d", "{}")), plan(12, ("a", '{"k": 1}'), ("b", "{}")), plan(13, ("a", "{}"), ("b", "{}"), ("c", "{}"))]
    out = variants.build({1: df}, todo, {1: transforms.Context()})
    assert made == ["a", "b", "c", "d", "a", "b"]
    assert out[10].df.columns == ["x", "a", "b", "c"] and out[10].df.collect() == out[13].df.collect()
    assert out[11].applied == ("a", "b", "d")


def test_a_step_that_fails_late_is_left_out(spark):
    df = spark.createDataFrame([(1.0, "u"), (3.0, "v")], "x double, t string")
    late = lambda df, ctx: df.withColumn("x", F.when(F.assert_true(F.col("x") > 2, "too small").isNull(), F.col("x")))
    known = variants.known_steps()
    original = variants.known_steps
    try:
        variants.known_steps = lambda: {**known, "late": late}
        out = variants.build({1: df}, [plan(10, ("minmax_scaler", "{}"), ("late", "{}"), ("label_encoding", "{}"))], {1: transforms.Context()})[10]
    finally:
        variants.known_steps = original
    assert out.applied == ("minmax_scaler", "label_encoding") and [n for n, _ in out.failed] == ["late"]
    assert sorted(map(tuple, out.df.collect())) == [(0.0, 0.0), (1.0, 1.0)]


def test_a_lost_worker_is_not_a_failed_step(spark):
    def die(batches):
        import os

        os._exit(3)
        yield

    broken = lambda df, ctx: df.mapInArrow(die, df.schema)
    original = variants.known_steps
    try:
        variants.known_steps = lambda: {"broken": broken}
        with pytest.raises(Py4JJavaError):
            variants.build({1: spark.range(3)}, [plan(10, ("broken", "{}"))], {1: transforms.Context()})
    finally:
        variants.known_steps = original
    ctx = transforms.Context()
    real = transforms.steps
    try:
        transforms.steps = lambda: {"broken": broken}
        with pytest.raises(Py4JJavaError):
            transforms.apply_steps(spark.range(3), [("broken", {})], ctx)
    finally:
        transforms.steps = real


@pytest.mark.parametrize("target", ["y", None])
def test_feature_limit_holds(spark, target):
    r = random.Random(2)
    rows = [(y, float(y * 3), r.random(), 5.0 * r.random(), "ab"[y]) for y in (r.randint(0, 1) for _ in range(200))]
    df = spark.createDataFrame(rows, "y int, told double, noise double, wide double, t string")
    ctx = transforms.Context(target, "classification" if target else "clustering")
    out = variants.feature_limit(df, ctx, 2)
    assert len([c for c in out.columns if c != target]) == 2 and (target is None or "y" in out.columns)
    assert set(out.columns) - {"y"} >= ({"told"} if target else {"wide", "told"})
    assert variants.feature_limit(df, ctx, 9).columns == df.columns


def test_variants_from_candidates_to_ranks(spark):
    r = random.Random(4)
    rows = [(float(k), r.gauss(0, 1) if r.random() > 0.3 else None, r.choice("abc"), "yes" if r.random() < 0.2 else "no") for k in range(300)]
    df = spark.createDataFrame(rows + rows[:40], "a double, b double, c string, y string")
    versions = registry(spark, [(1, None, "classification", "y")])
    ev = Evidence(spark, {1: df}, versions)
    from lakewitness.operators import recommend as rec

    requests = spark.createDataFrame([(70, 1, "lightweight_dataset", 3, False, 2)], "request_id long, version_id long, goal string, candidates int, avoid_synthetic boolean, max_features int")
    needs = rec.requirements(ev.registry, ev.columns, ev.tables, ev.findings, ev.classification)
    todo = variants.plans(rec.candidates(requests, rec.applicable(needs)), requests, 1001)
    assert [p.version_id for p in todo] == [1001, 1002, 1003] and all((variants.LIMIT, '{"k": 2}') in p.steps for p in todo)
    assert all([n for n, _ in p.steps].index(variants.LIMIT) == len(p.steps) - 2 for p in todo)
    built = variants.build({1: df}, todo, variants.contexts(versions, needs))
    for p in todo:
        table = built[p.version_id].df
        assert len([c for c in table.columns if c != "y"]) <= 2
    made = variants.plan_rows(spark, todo, built)
    children = variants.child_versions(versions, made)
    assert [(x.version_number, x.parent_version_id, x.target_column, x.generation_method) for x in children.orderBy(V).collect()] == [(n, 1, "y", "variant_generator") for n in (2, 3, 4)]
    own = Evidence(spark, {v: b.df for v, b in built.items()}, children.withColumn("parent_version_id", F.lit(None).cast("long")))
    risks = evaluate.variant_risks(own.facts, own.leakage)
    records = evaluate.evaluate(
        made.select("job_id", "goal", "source_version_id", V, "estimated_cost", "steps"), ev.risks, risks, ev.tables.unionByName(own.tables), evaluate.class_balances(own.vc, own.registry)
    )
    ranked = evaluate.rank_variants(records).orderBy("vrs_rank").collect()
    assert [x.vrs_rank for x in ranked] == [1, 2, 3] and ranked[0].vrs_score >= ranked[2].vrs_score > 0
    assert all(x.mlrs_after < x.mlrs_before for x in ranked)


def test_one_hot_names_that_differ_by_case(spark):
    df = spark.createDataFrame([("A", 1.0), ("a", 2.0), ("A_2", 3.0)], "t string, T_a_2 double")
    out = transforms.onehot_encoding(df, transforms.Context())
    assert len({c.lower() for c in out.columns}) == len(out.columns) == 4
    assert [sum(r) for r in out.drop("T_a_2").collect()] == [1, 1, 1]


# ---- refresh
def frames_of(spark, n):
    return {v: spark.createDataFrame([(k, float(k % (v + 2)), "ab"[k % 2]) for k in range(30)], "id long, x double, y string") for v in range(1, n + 1)}


def test_refresh_isolates_broken_versions_in_few_jobs(spark, tmp_path, monkeypatch):
    n = 9
    frames = frames_of(spark, n)
    frames[6] = frames[6].withColumn("x", F.when(F.assert_true(F.col("id") > 3, "no").isNull(), F.col("x")))
    frames[8] = frames[8].selectExpr("id", "cast(y as double) as x", "y")
    versions = registry(spark, [(v, v - 1 if v > 1 else None, "classification", "y") for v in range(1, n + 1)])
    calls = []
    real = refresh.value_counts
    monkeypatch.setattr(refresh, "value_counts", lambda some: calls.append(sorted(some)) or real(some))
    monkeypatch.setattr(refresh, "TABLES", {k: refresh.TABLES[k] for k in ("table_profile", "diff_scores", "risk_scores", "findings")})
    out = {r[V]: (r.outcome, r.error) for r in refresh.refresh(spark, str(tmp_path / "s"), versions, frames).collect()}
    assert {v for v, (o, _) in out.items() if o == "failed"} == {6, 8}
    assert out[6][1] == "USER_RAISED_EXCEPTION" and out[8][1] == "CAST_INVALID_INPUT"
    assert len(calls) <= 13  # two broken among nine: far fewer than one job each and one more
    compared = {r[V] for r in refresh.read_evidence(spark, str(tmp_path / "s"), "diff_scores").collect()}
    assert compared == {2, 3, 4, 5}, "children of broken parents have no comparison"
    assert {r[V] for r in refresh.work_list(spark, str(tmp_path / "s"), versions).collect()} == {6, 7, 8, 9}


def test_refresh_replaces_rows_and_leaves_others(spark, tmp_path, monkeypatch):
    root, frames = str(tmp_path / "s"), frames_of(spark, 2)
    monkeypatch.setattr(refresh, "TABLES", {k: refresh.TABLES[k] for k in ("risk_scores", "findings", "table_profile")})
    versions = registry(spark, [(1, None, "classification", "y"), (2, None, "classification", "y")])
    old = spark.createDataFrame([(1, "OLD"), (2, "OLD")], "version_id long, code string")
    refresh.store_evidence(root, {"findings": old}, versions)
    upsert_evidence(root, "current", spark.createDataFrame([("g", "outdated", L.DIAGNOSIS_RULES, None, 2)], refresh.CURRENT_SCHEMA))
    assert [r[V] for r in refresh.work_list(spark, root, versions).collect()] == [2]
    assert [(r[V], r.outcome) for r in refresh.refresh(spark, root, versions, frames).collect()] == [(2, "done")]
    found = {(r[V], r.code) for r in refresh.read_evidence(spark, root, "findings").select(V, "code").collect()}
    assert (1, "OLD") in found and (2, "OLD") not in found
    assert refresh.work_list(spark, root, versions).isEmpty()
    assert refresh.refresh(spark, root, versions, frames).isEmpty()


def test_limit_takes_the_first_of_the_work_list(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(refresh, "TABLES", {"table_profile": refresh.TABLES["table_profile"]})
    versions = registry(spark, [(v, None, "classification", "y") for v in (3, 1, 2)])
    out = refresh.refresh(spark, str(tmp_path / "s"), versions, frames_of(spark, 3), limit=2).collect()
    assert [r[V] for r in out] == [3, 1]
    assert [r[V] for r in refresh.refresh(spark, str(tmp_path / "s"), versions, frames_of(spark, 3), only=[2]).collect()] == [2]


# ---- lineage
def test_lineage_of_a_long_chain_and_of_rings(spark, monkeypatch):
    n = 3000
    rows = [(k, k - 1 if k else None, 1) for k in range(n)]
    rows += [(10_000 + k, 10_000 + (k + 1) % 5, 1) for k in range(5)] + [(10_010, 10_002, 1), (10_020, 10_020, 1), (10_030, 99_999, 1), (10_031, 10_030, 1)]
    rounds = []
    real = history.cut
    monkeypatch.setattr(history, "cut", lambda df: rounds.append(1) or real(df))
    out = {r[V]: r for r in history.lineage_tree(spark.createDataFrame(rows, f"{V} long, parent_version_id long, version_number int")).collect()}
    assert len(rounds) < 36  # two passes of at most log2 rounds
    assert all(out[k].depth == k and out[k].root_id == 0 and out[k].path.count("/") == k for k in range(n))
    ring = {10_000, 10_001, 10_002, 10_003, 10_004, 10_010, 10_020}
    assert {k for k, r in out.items() if r.root_id is None} == ring and all(out[k].depth is None and out[k].path is None for k in ring)
    assert not {10_030, 10_031} & set(out)


def test_lineage_below_given_roots(spark):
    rows = [(1, None, 1), (2, 1, 2), (3, 2, 3), (4, 2, 4), (5, 1, 5), (6, None, 1)]
    df = spark.createDataFrame(rows, f"{V} long, parent_version_id long, version_number int")
    out = {r[V]: (r.depth, r.root_id, r.path.split("/")[-1].lstrip("0")) for r in history.lineage_tree(df, spark.createDataFrame([(2,), (6,)], f"{V} long")).collect()}
    assert out == {2: (0, 2, "2"), 3: (1, 2, "3"), 4: (1, 2, "4"), 6: (0, 6, "1")}


# ---- components
def test_components_of_many_linked_columns(spark):
    n, r = 10_000, random.Random(1)
    chain = [(1, f"c{i:05d}", f"c{i + 1:05d}") for i in range(n - 1)]
    r.shuffle(chain)
    hub = [(2, "hub", f"x{i}") for i in range(5000)] + [(2, "p", "q"), (2, "q", "p"), (2, "s", "s")]
    out = components(spark.createDataFrame(chain + hub, "g long, a string, b string"), "g", "a", "b")
    roots = {(x.g, x.node): x.root for x in out.collect()}
    assert {v for (g, _), v in roots.items() if g == 1} == {"c00000"} and sum(g == 1 for g, _ in roots) == n
    assert roots[2, "x77"] == "hub" and roots[2, "q"] == "p" and (2, "s") not in roots and len(roots) == n + 5003


# ---- protocols
def test_an_edit_of_any_protocol_field_counts(spark):
    blank = {f: None for f in L.PROTOCOL_FIELDS}
    edits, expected = [], []
    for k, f in enumerate(["", *L.PROTOCOL_FIELDS, ""]):
        if f:
            blank = blank | {f: "1"}
        edits.append((1, k, f"2024-01-{k + 1:02d} 00:00:00", *blank.values()))
    df = spark.createDataFrame(edits, "s long, e long, at string, " + ", ".join(f"{f} string" for f in L.PROTOCOL_FIELDS))
    out = history.protocol_versions(df, "s", "at", "e", L.PROTOCOL_FIELDS)
    assert out.count() == 14  # the last edit changes nothing
    found = {r.version_number: (r.fields_added, r.completeness_delta) for r in history.protocol_diffs(out.withColumn("version_number", F.col("version_number").cast("int")), "s", L.PROTOCOL_FIELDS).collect()}
    assert found == {k + 2: (f, 10 if f in L.COMPLETENESS_FIELDS else 0) for k, f in enumerate(L.PROTOCOL_FIELDS)}


# ---- exact cells, measured evidence, requested pairs
def test_portable_numbers(spark):
    import math
    import struct

    from lakewitness.functions.columns import portable_number

    r = random.Random(3)
    values = [0.0, -0.0, 1.0, -2.5, 0.1, 2.0**53, 2.0**53 - 1, 1e300, 5e-324, 2.2250738585072014e-308, float("inf"), float("-inf"), 2.0**-3, 1 - 2.0**-53, 1 + 2.0**-52, 8.000000000000002]
    values += [v for v in (struct.unpack("<d", r.randbytes(8))[0] for _ in range(400)) if v == v] + [2.0**k for k in range(-1074, 1024, 37)] + [math.nextafter(2.0**k, 0) for k in range(-1000, 1024, 41)]

    def text(v):
        if math.isinf(v):
            return "-inf" if v < 0 else "inf"
        if abs(v) < 2**53 and v == math.floor(v):
            return str(int(v))
        m, e = math.frexp(abs(v))
        digits, power = int(m * 2**53), e - 1
        if power < -1022:  # the double behind 2 ** power is exact down to the least one
            digits = int(abs(v) / 2.0**power * 2**52)
        return f"{'-' if v < 0 else ''}{digits}p{power}"

    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(-1, None)], "i long, v double")
    got = {x.i: x.t for x in rows.select("i", portable_number(F.col("v")).alias("t")).collect()}
    assert got.pop(-1) is None and got == {i: text(v) for i, v in enumerate(values)}


def test_measured_evidence_counts_in_the_scores(spark):
    rows = [(k % 6, "ab"[k % 2], "train" if k < 20 else "test", "yes" if k % 2 else "no") for k in range(30)] + [(1, "b", "train", "no")] * 6
    df = spark.createDataFrame(rows, "x long, copy string, part string, y string")
    versions = registry(spark, [(1, None, "classification", "y")])
    plain, measured = Evidence(spark, {1: df}, versions), Evidence(spark, {1: df}, versions).measure({1: ("part", ["x", "copy"])})
    score = lambda ev: {r.component: r.score for r in ev.components.collect()}
    a, b = score(plain), score(measured)
    assert b["duplicates"] > a["duplicates"] and b["split_contamination"] == 12.0 > a["split_contamination"]
    exact = spark.createDataFrame([(k, "yn"[k % 2], "yes" if k % 2 == 0 else "no") for k in range(30)], "x long, mirror string, y string")
    direct = Evidence(spark, {1: exact}, versions).measure()
    assert {r.column for r in direct.leakage.where("kind = 'direct'").collect()} == {"mirror"}


def test_pairs_of_one_shape_share_their_digests(spark):
    from lakewitness.operators import diff

    frames = {v: spark.createDataFrame([(k, (k * v) % 7) for k in range(20)] + [(3, 3)] * v, "a long, b long") for v in range(1, 6)}
    frames[6] = spark.createDataFrame([(1, "x")], "c long, d string")
    versions = registry(spark, [(v, None, "clustering", None) for v in range(1, 7)])
    asked = spark.createDataFrame([(a, b) for a in range(1, 7) for b in range(1, 7)] + [(1, 2), (1, 77)], "previous_version_id long, current_version_id long")
    ev = Evidence(spark, frames, versions)
    pairs = diff.requested_pairs(asked, ev.registry, ev.configurations)
    assert pairs.count() == 36 and [tuple(r) for r in diff.refused_pairs(asked, ev.registry).collect()] == [(1, 77, "unknown_version")]
    none = spark.createDataFrame([], "pair_id long, rank int, column string")
    found = diff.row_diffs(frames, pairs, none)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 2 * 6 + 6  # not one side for each pair
    from collections import Counter

    rows = {v: Counter(map(tuple, f.collect())) for v, f in frames.items()}
    got = {r.pair_id: (r.rows_added, r.rows_removed, r.rows_unchanged) for r in found.collect()}
    alike = [(a, b) for a in range(1, 6) for b in range(1, 6)] + [(6, 6)]
    assert got == {(a << 32) + b: ((rows[b] - rows[a]).total(), (rows[a] - rows[b]).total(), (rows[a] & rows[b]).total()) for a, b in alike}


def test_digests_in_short_projections_are_the_same(spark):
    """Also for numbers next to powers of two, tiny and huge ones, and columns of other types between them."""
    import math
    import struct

    from lakewitness.functions.columns import portable_digest, portable_digests
    from lakewitness.operators.fingerprint import content_hash

    r = random.Random(5)
    values = [None, float("nan"), 0.0, -0.0, 2.0**53, 2.0**53 + 2, 2.0**-10, math.nextafter(2.0**-10, 0), 1e300, -5e-324, float("inf"), 0.05, -123.45]
    values += [x for k in range(-14, 56) for x in (math.nextafter(2.0**k, 0), 2.0**k, math.nextafter(2.0**k, 1e308))] + [struct.unpack("<d", r.randbytes(8))[0] for _ in range(200)]
    rows = [(k, v, None if k % 3 else f"x{k}", values[-k], k % 2 == 0) for k, v in enumerate(values)]
    df = spark.createDataFrame(rows, "k long, `a.b` double, t string, c double, b boolean")
    names = df.columns
    want = sorted(x.d for x in df.select(portable_digest(df, names).alias("d")).collect())
    assert want == sorted(x.d for x in portable_digests(df, names, "d").collect())
    sums = [sum(int(d[i * 15:i * 15 + 15], 16) for d in want) for i in range(4)]
    text = "|".join(str(x) for x in (len(want), *sums))
    assert content_hash(df).first().content_hash == hashlib.sha256(text.encode()).hexdigest()
    assert content_hash(df.where("k < 0")).first().content_hash == hashlib.sha256(b"0|0|0|0|0").hexdigest()


def test_digest_methods_stay_short_enough_to_be_compiled(spark):
    """The JVM compiles no method over 8000 bytes; the digest of a wide table used to be one."""
    from lakewitness.operators.fingerprint import content_hash

    df = spark.range(3).select(*[(F.col("id") / (k + 3)).alias(f"c{k}") for k in range(6)], *[F.col("id").alias(f"i{k}") for k in range(4)])
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = spark._sc._jvm.PythonSQLUtils.explainString(content_hash(df)._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", plan)]
    assert sizes and max(sizes) < 8000


def test_values_are_not_brought_together_by_column_for_a_join(spark):
    """All values of a column in one task are as many as the table has rows."""
    from lakewitness.operators import diagnosis, evaluate, profile
    from lakewitness.operators.value_counts import column_catalog, value_counts

    frames = {1: spark.createDataFrame([(f"T {k}", "yn"[k % 2]) for k in range(40)] + [("t_3", "y")], "name string, y string")}
    catalog = column_catalog(spark, frames)
    configurations = spark.createDataFrame([(1, "classification", "y")], "version_id long, task_type string, target_column string")
    columns = catalog.withColumns({"role": F.when(F.col("column") == "y", "target").otherwise("feature"), "is_numeric": F.lit(False), "logical_dtype": F.lit("object")})
    vc = value_counts(frames)
    tops, classes = profile.top_values(vc, catalog), profile.class_distribution(vc, columns, configurations)
    for found in (tops, classes, diagnosis.categorical_consistency(vc, columns), evaluate.class_balances(vc, configurations)):
        plan = spark._sc._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "simple")
        assert "BroadcastHashJoin" in plan and not re.search(r"SortMergeJoin.*column", plan)
    assert sorted((r["rank"], r.value, r.cnt) for r in tops.where("column = 'y'").collect()) == [(1, "y", 21), (2, "n", 20)]
    assert {r["class"]: r.cnt for r in classes.collect()} == {"y": 21, "n": 20}
