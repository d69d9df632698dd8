"""What a pass reads, shuffles and writes: no more than its result needs."""

import contextlib
import io
import re
import time
from collections import Counter
from pathlib import Path
from threading import Barrier

import numpy as np
from pyspark.sql import functions as F

from lakewitness import session
from lakewitness.functions import wide
from lakewitness.functions.columns import row_digest, row_key
from lakewitness.operators import diagnosis, diff, profile, transforms, value_counts, variants
from lakewitness.plans.evidence import VERSION_SCHEMA, Evidence

PAIRS = "pair_id long, previous_version_id long, current_version_id long"


def chain(spark):
    """Three versions, the middle one on either side of a pair, and one compared with itself."""
    frames = {v: spark.createDataFrame([(k, float(k % (v + 1))) for k in range(v, 12)], "id long, x double") for v in (1, 2, 3)}
    return frames, spark.createDataFrame([(12, 1, 2), (23, 2, 3), (33, 3, 3)], PAIRS)


def digests(df):
    return df._jdf.queryExecution().analyzed().toString().count("sha2(")


def test_a_row_is_digested_once_for_both_sides_of_its_pairs(spark):
    frames, pairs = chain(spark)
    keys = spark.createDataFrame([(p, 1, "id") for p in (12, 23, 33)], "pair_id long, rank int, column string")
    found = diff.row_diffs(frames, pairs, keys)
    assert digests(found) == 2 * len(frames)  # the key and the row of each version
    cells = {v: dict(map(tuple, f.collect())) for v, f in frames.items()}
    for r in found.collect():
        a, b = cells[r["pair_id"] // 10], cells[r["pair_id"] % 10]
        both = a.keys() & b.keys()
        same = sum(a[k] == b[k] for k in both)
        assert (r["rows_added"], r["rows_removed"], r["rows_modified"], r["rows_unchanged"]) == (len(b.keys() - a.keys()), len(a.keys() - b.keys()), len(both) - same, same)


def test_rows_without_a_key_meet_in_one_shuffle(spark):
    frames, pairs = chain(spark)
    frames[2] = frames[2].unionByName(frames[2].limit(3)).unionByName(spark.createDataFrame([(None, None)] * 2, "id long, x double"))
    found = diff.row_diffs(frames, pairs, spark.createDataFrame([], "pair_id long, rank int, column string"))
    plan = found._jdf.queryExecution().analyzed().toString()
    assert digests(found) == len(frames) and plan.count("row#") and "Aggregate [low#" not in plan
    rows = {v: Counter(map(tuple, f.collect())) for v, f in frames.items()}
    got = {r["pair_id"]: (r["rows_added"], r["rows_removed"], r["rows_unchanged"]) for r in found.collect()}
    pair = lambda a, b: ((rows[b] - rows[a]).total(), (rows[a] - rows[b]).total(), (rows[a] & rows[b]).total())
    assert got == {12: pair(1, 2), 23: pair(2, 3), 33: pair(3, 3)}


def test_compared_rows_are_shuffled_as_16_bytes(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (1, None)], "id long, t string")
    assert df.select(F.length(row_key(df, df.columns)).alias("n")).distinct().collect() == [(16,)]
    assert df.select((F.substring(row_digest(df, df.columns), 1, 16) == row_key(df, df.columns)).alias("same")).distinct().collect() == [(True,)]
    plan = profile.duplicate_rows({1: df})._jdf.queryExecution().analyzed().toString()
    assert "substring(unhex(" in plan
    assert profile.duplicate_rows({1: df}).first()["duplicate_rows"] == 1


def test_rows_between_no_bounds_make_no_array(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(float(a) if a > 0.1 else None, float(b)) for a, b in rng.random((4000, 2))]
    df = spark.createDataFrame(rows, "a double, b double")
    parts, union = [], wide._union
    monkeypatch.setattr(wide, "_union", lambda found: parts.extend(found) or union(found))
    figures = wide.profile_figures({1: (df, {c: F.col(c) for c in "ab"})})
    exploded = [p._jdf.queryExecution().analyzed().toString() for p in parts if "explode" in p._jdf.queryExecution().analyzed().toString()]
    assert exploded and all("Filter" in p for p in exploded)
    for i, c in enumerate("ab"):
        values = [r[i] for r in rows if r[i] is not None]
        assert np.allclose(figures[1, c].quantiles, np.quantile(values, [0.25, 0.5, 0.75]), rtol=1e-12)


def test_steps_that_leave_out_or_scale_columns_write_no_table(spark, monkeypatch):
    df = spark.createDataFrame([(float(k % 5), 1.0, "ab"[k % 2], None if k == 3 else k) for k in range(20)], "x double, flat double, t string, n long")
    written, cut = [], variants.cut
    monkeypatch.setattr(variants, "cut", lambda d: written.append(1) or cut(d))
    steps = ["label_encoding", "variance_threshold", "correlation_filter", "standard_scaler"]
    plan = variants.Plan(10, 7, "fairness", 1, "V7", "h", 1, "low", tuple((s, "{}") for s in steps), None)
    built = variants.build({1: df}, [plan], {1: transforms.Context(task="clustering")})[10]
    assert len(written) == 1 and built.applied == tuple(steps) and not built.failed
    whole = transforms.apply_steps(df, [(s, {}) for s in steps], transforms.Context(task="clustering"))
    assert built.df.columns == whole.columns and sorted(built.df.collect()) == sorted(whole.collect())


def method_sizes(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("codegen")
    return [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text.getvalue())]


def test_quantiles_of_many_columns_stay_in_methods_the_jvm_compiles(spark, monkeypatch):
    rng = np.random.default_rng(5)
    names, table = [f"c{i}" for i in range(14)], rng.random((3000, 14))
    df = spark.createDataFrame([tuple(map(float, r)) for r in table], ", ".join(f"{c} double" for c in names))
    scaled = transforms.minmax_scaler(df, transforms.Context(task="clustering"))
    parts, union = [], wide._union
    monkeypatch.setattr(wide, "_union", lambda found: parts.extend(found) or union(found))
    found = {r["column"]: r for r in profile.numeric_statistics({1: scaled}).collect()}
    spread = [p for p in parts if "explode" in p._jdf.queryExecution().analyzed().toString()]
    sizes = [n for p in spread for n in method_sizes(p)]
    assert spread and sizes and max(sizes) < 8000
    for i, c in enumerate(names):
        x = (table[:, i] - table[:, i].min()) / np.ptp(table[:, i])
        assert np.allclose([found[c][q] for q in ("q25", "median", "q75")], np.quantile(x, [0.25, 0.5, 0.75]), rtol=1e-12)


def test_variants_of_different_sources_are_built_together(spark, monkeypatch):
    df = spark.createDataFrame([(float(k % 5), k) for k in range(20)], "x double, n long")
    met = Barrier(2)  # the first steps of both sources must be under way at once

    def step(df, ctx, by, wait=False):
        if wait:
            met.wait(timeout=60)
        return df.withColumn("x", F.col("x") + by)

    monkeypatch.setattr(variants, "known_steps", lambda: {"step": step})
    first = lambda by: ("step", f'{{"by": {by}, "wait": true}}')
    then = lambda by: ("step", f'{{"by": {by}}}')
    plan = lambda v, source, *steps: variants.Plan(v, 7, "fairness", 1, "V7", "h", source, "low", steps)
    ctx = transforms.Context(task="clustering")
    built = variants.build({1: df, 2: df}, [plan(10, 1, first(1), then(1)), plan(12, 2, first(5)), plan(11, 1, first(1), then(2)), plan(13, 2)], {1: ctx, 2: ctx})
    sums = {v: b.df.agg(F.sum("x")).first()[0] for v, b in built.items()}
    assert sums == {10: 80.0, 12: 140.0, 11: 100.0, 13: 40.0} and list(built) == [10, 12, 11, 13]
    assert [len(b.applied) for b in built.values()] == [2, 1, 2, 0] and not any(b.failed for b in built.values())


def test_spellings_of_a_form_are_counted_without_shuffling_texts(spark):
    labels = ["New York", "new_york", " NEW-york ", "Rome", "rome ", "Oslo", "", "-", "x" * 5000, None]
    rows = [(v, c, t, i + 1) for v in (1, 2) for c in ("a", "b") for i, t in enumerate(labels) if (v, t) != (2, "rome ")]
    vc = spark.createDataFrame(rows + [(1, "y", "Q", 3), (1, "y", "q", 4)], "version_id long, column string, value string, cnt long")
    columns = spark.createDataFrame(
        [(v, c, "feature", False) for v in (1, 2) for c in ("a", "b")] + [(1, "y", "target", False)], "version_id long, column string, role string, is_numeric boolean"
    )
    found = diagnosis.categorical_consistency(vc, columns)
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "Window" not in plan and "substring(sha2(" in plan
    got = {(r["version_id"], r["column"]): (r["cells"], r["affected_cells"]) for r in found.collect()}
    # New York x 3 (1 + 2 + 3), Rome x 2 (4 + 5), the two blanks (7 + 8)
    assert got == {(v, c): ((45, 30) if v == 1 else (40, 21)) for v in (1, 2) for c in ("a", "b")}


def test_whole_numbers_are_counted_without_a_decimal_form(spark):
    df = spark.createDataFrame([(1,), (2**53,), (2**53 + 1,), (2**53 + 1,), (None,)], "n long")
    cells = value_counts.long_form(df, 1)
    assert not re.search(r"\+ 0\.0\S*\) as string", cells._jdf.queryExecution().analyzed().toString())
    got = {(r["value"], r["num"]): r["cnt"] for r in value_counts.value_counts({1: df}).collect()}
    assert got == {(None, 1.0): 1, (None, 2.0**53): 1, ("9007199254740993", 2.0**53): 2, (None, None): 1}


def test_quartiles_of_few_values_are_read_off_their_counts(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(int(a), None if a == 3 else float(b), float(c)) for a, b, c in zip(rng.integers(0, 7, 5000), rng.integers(0, 2, 5000), rng.random(5000))]
    df = spark.createDataFrame(rows, "few long, two double, many double")
    sketches, union = [], wide._union
    monkeypatch.setattr(wide, "_union", lambda parts: sketches.extend(p._jdf.queryExecution().analyzed().toString().count("percentile_approx(") for p in parts) or union(parts))
    plain = {r["column"]: r.asDict() for r in profile.numeric_statistics({1: df}).collect()}
    of_all = sum(sketches)
    sketches.clear()
    few = profile.few_values(value_counts.value_counts({1: df}))
    assert set(few) == {(1, "few"), (1, "two")} and few[1, "two"] == sorted(Counter(b for _, b, _ in rows if b is not None).items())
    found = {r["column"]: r.asDict() for r in profile.numeric_statistics({1: df}, few=few).collect()}
    assert 0 < sum(sketches) < of_all and found.keys() == plain.keys()
    for i, c in enumerate(("few", "two", "many")):
        values = [r[i] for r in rows if r[i] is not None]
        assert np.allclose([found[c][x] for x in ("q25", "median", "q75")], np.quantile(values, [0.25, 0.5, 0.75]), rtol=1e-12)
        assert all(np.isclose(found[c][x], plain[c][x], rtol=1e-12) for x in ("mean", "std", "skewness")) and found[c]["outlier_count"] == plain[c]["outlier_count"]


def small_evidence(spark, rows, schema, parents):
    """Evidence of versions 1 to n, and the digested versions of its duplicates."""
    row = lambda v, p: (v, 1, 1, "d", v, p, "manual", "note", "2024-01-01", "clustering", None, "m", "v", "all", [], "none")
    frames = {v: spark.createDataFrame(r, schema) for v, r in rows.items()}
    return Evidence(spark, frames, spark.createDataFrame([row(v, parents.get(v)) for v in frames], VERSION_SCHEMA))


def test_rows_with_a_column_of_different_values_are_not_compared(spark, monkeypatch):
    rows = {
        1: [(k, "a") for k in range(6)], 2: [(k // 2, "a") for k in range(6)], 3: [(k or None, "a") for k in range(6)] + [(None, "a")],
        4: [(2**53 + k, "a") for k in range(4)], 5: [], 6: [(1, str(k)) for k in range(3)],
    }
    found, digest = [], profile.row_key
    monkeypatch.setattr(profile, "row_key", lambda df, names: found.append(df.count()) or digest(df, names))
    evidence = small_evidence(spark, rows, "n long, t string", {})
    got = {r["version_id"]: (r["row_count"], r["duplicate_rows"]) for r in evidence.tables.collect()}
    assert got == {v: (len(r), len(r) - len(set(r))) for v, r in rows.items()}
    assert sorted(found) == [0, 6, 7]  # the empty version and those with copies
    # without the columns all rows are compared
    assert {r["version_id"]: r["duplicate_rows"] for r in profile.duplicate_rows(evidence.frames).collect()} == {1: 0, 2: 3, 3: 1, 4: 0, 6: 0}


def test_evidence_is_made_together_and_once(spark, monkeypatch):
    made, met = Counter(), Barrier(2)  # two relations that need nothing of each other must be under way at once

    def counted(module, name, meet=False):
        fn = getattr(module, name)

        def run(*args, **kwargs):
            made[name] += 1
            if meet:
                met.wait(timeout=60)
            return fn(*args, **kwargs)

        monkeypatch.setattr(module, name, run)

    for name in ("high_correlations", "regression_profile"):
        counted(profile, name, meet=True)
    for module, names in ((profile, ("column_profile", "duplicate_rows")), (diff, ("paired_columns", "paired_counts", "row_diffs", "numeric_shifts", "category_changes"))):
        for name in names:
            counted(module, name)
    rows = {v: [(k, float(k % (v + 1)), float(k)) for k in range(9)] for v in (1, 2)}
    evidence = small_evidence(spark, rows, "n long, x double, y double", {2: 1})
    before = spark.conf.get("spark.sql.broadcastTimeout")
    assert evidence.facts.count() == 2 and evidence.risks.count() == 2
    assert len(made) == 9 and set(made.values()) == {1}
    assert spark.conf.get("spark.sql.broadcastTimeout") == before


def test_broadcasts_wait_while_tasks_run_together(spark):
    before = spark.conf.get("spark.sql.broadcastTimeout")
    asked = lambda: spark.conf.get("spark.sql.broadcastTimeout")
    assert session.together(spark, [asked, lambda: session.together(spark, [asked])[0], asked]) == [str(session.PATIENCE)] * 3
    with contextlib.suppress(ZeroDivisionError):
        session.together(spark, [lambda: 1 / 0])
    assert spark.conf.get("spark.sql.broadcastTimeout") == before


def test_shuffle_files_of_a_written_table_go(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    files = lambda: {p for f in folders for p in Path(f.getAbsolutePath()).glob("**/shuffle_*.data")}
    df = spark.range(200000).selectExpr("id % 1000 AS k").groupBy("k").count()
    before = files()
    assert df.where("count > 0").count() == 1000 and files() - before  # others stay until the driver collects its garbage
    before = files()
    kept = session.cut(df)
    deadline = time.monotonic() + 20
    while files() - before and time.monotonic() < deadline:
        time.sleep(0.2)
    assert kept.count() == 1000 and spark.conf.get(session.SHUFFLE_CLEANUP) == "false"
    assert not {p for p in files() - before if p.stat().st_size > 5000}  # the count above has small ones
    assert df.count() == 1000
