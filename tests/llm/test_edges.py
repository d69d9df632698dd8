"""All queries on awkward tables: nulls, empty and long texts, repeated rows, clashing column names, no rows."""

import random

import pytest

import corpus_pipeline
from llm_tables import SMOKE, against_sql, folder  # noqa: F401
from lakewitness.llm import queries

PER_DOCUMENT = ["op2_secret_ownership", "op4_dart_minhash", "op6_quality_fences", "op7_template_windows", "op8_hash_tree_shards", "op9_ftrl_toxicity", "op10_prefix_doubling", "op11_bpe_matrices", "op12_merkle_manifest"]
CLASHES = ["_row", "node", "m", "kept", "shard", "slot", "host", "path", "rule", "band", "units", "data", "copies", "copy", "order_key", "mix_source", "lang_key", "score", "class_id", "doc_key", "rendered", "digest"]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("aeioustrnl") for _ in range(r.randint(2, 8))) + ("." if r.random() < 0.1 else "") for _ in range(n))


LONG = prose(30_000, 99)
AWKWARD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \n\t ", "en", "a", 4),
    (4, "one", "en", None, 3),
    (None, prose(80, 1), "en", "a", 1),
    (None, prose(90, 2), None, "b", 1),
    (5, prose(100, 3), "en", "a", 1),
    (5, prose(100, 3), "en", "a", 1),
    (5, prose(100, 3), "en", "a", 1),
    (6, prose(100, 3), "de", "b", 1),
    (7, LONG, "en", "b", 1),
    (8, "\U0001f600 é token = abcdefgh1 " + prose(60, 4), "fr", "b", 1),
    (8, "other text with the same id " + prose(60, 5), "fr", "b", 1),
    (9, "la la " * 200, "en", "a", 1),
]
OTHERS = {
    "labels": [(1, None, None), (5, 1, 0), (5, 1, 1), (6, 0, 0), (None, 1, 1), (99, 1, 1)],
    "pages": [(1, None, None), (None, "no address", ""), (2, "HTTP://A.Example.NET/en/x?q#f", "<a href=//b.org>"), (2, "HTTP://A.Example.NET/en/x?q#f", "<a href=//b.org>"), (3, "://", None), (4, "x://h?://y", None)],
    "benchmark": [(1, None), (2, "short one"), (None, prose(30, 6)), (3, prose(30, 6))],
    "conversations": [(1, 1, "user", None), (1, 1, None, "x"), (None, None, "assistant", "y"), (1, 1, "user", None), (2, 0, "a\n<%", "<|im_end|>\n<\\|"), (2, 0, "assistant", "tail <")],
}


@pytest.fixture(scope="module")
def counts():
    return {}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_awkward_rows(spark, folder, name):
    path = folder(extra=CLASHES, documents=AWKWARD, **OTHERS)
    rows = queries.QUERIES[name](spark, path).collect()
    if name in PER_DOCUMENT:
        assert sorted(map(str, (r.doc_id for r in rows))) == sorted(str(d[0]) for d in AWKWARD)
    elif name == "op1_link_graph_filter":
        assert len(rows) == len(OTHERS["pages"])
    elif name == "op3_chat_round_trip":
        assert {r.conv_id: r.n_turns for r in rows} == {-1: 2, 1: 3, 2: 2, None: 1}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_no_rows(spark, folder, name):
    rows = queries.QUERIES[name](spark, folder()).collect()
    assert len(rows) == (1 if name == "op3_chat_round_trip" else 0)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, against_sql, name):
    against_sql(spark, name, SMOKE)


@pytest.mark.parametrize("rows", [[], AWKWARD], ids=["none", "awkward"])
def test_pipeline_stages(spark, folder, rows, tmp_path_factory):
    path = folder(extra=CLASHES, documents=rows, **(OTHERS if rows else {}))
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, last = docs.columns, len(corpus_pipeline.STAGES) - 1
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path_factory.mktemp("stage") / "out")
        docs = stage(spark, docs, path)
        if k < last:
            assert docs.columns == columns
        else:
            assert set(docs.columns) == set(columns) | {"shard"}
        docs.write.parquet(out)
        docs = spark.read.parquet(out)
    texts = {r.text for r in docs.collect()}
    assert None not in texts and texts <= {r[1] for r in rows}


def test_pipeline_on_given_tables(spark):
    out = corpus_pipeline.run(spark, SMOKE).collect()
    given = {r.doc_id: r for r in spark.read.parquet(f"{SMOKE}/documents.parquet").collect()}
    bad = {r.doc_id for r in queries.QUERIES["op6_quality_fences"](spark, SMOKE).collect() if not r.kept}
    assert out and all(given[r.doc_id].text == r.text and 0 <= r.shard < 16 for r in out)
    assert not {r.doc_id for r in out} & bad
    assert len({r.text for r in out}) == len({r.doc_id for r in out})
