"""Tables and fixtures of these tests."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

SMOKE = "/root/testdata/sf0.001"
TABLES = {
    "documents": [("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())],
    "labels": [("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())],
    "pages": [("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())],
    "benchmark": [("item_id", pa.int64()), ("text", pa.string())],
    "conversations": [("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())],
}


@pytest.fixture
def folder(tmp_path):
    """Writes the given tables (rows as tuples), the others empty; ``extra`` adds columns of those names to all."""

    def write(extra=(), **tables):
        for name, fields in TABLES.items():
            rows = tables.get(name, [])
            columns = {f: pa.array([r[i] for r in rows], t) for i, (f, t) in enumerate(fields)}
            columns |= {c: pa.array(["x"] * len(rows), pa.string()) for c in extra}
            pq.write_table(pa.table(columns), tmp_path / f"{name}.parquet")
        return str(tmp_path)

    return write


@pytest.fixture
def against_sql():
    """Compares a query's rows with those of its SQL on the same folder."""

    def check(spark, name, path):
        from lakewitness.llm import queries

        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/{t}.parquet')")
        got = queries.QUERIES[name](spark, path)
        run = con.execute(queries.ORACLES[name])
        there = [c[0] for c in run.description]
        names = sorted(got.columns)
        assert sorted(there) == names
        mine = sorted(repr([r[c] for c in names]) for r in got.collect())
        assert mine == sorted(repr([r[there.index(c)] for c in names]) for r in run.fetchall())

    return check


@pytest.fixture
def docs():
    """Rows of documents from texts, numbered from 0, with languages and sources in turn."""

    def rows(texts, source=lambda i: f"src{i % 3}", lang="en"):
        return [(i, t, lang, source(i), None if t is None else len(t)) for i, t in enumerate(texts)]

    return rows
