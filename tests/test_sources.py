import hashlib

import pytest

from lakewitness.operators import fingerprint, metadata
from lakewitness.sources import ingest, store


def write(path, text):
    path.write_text(text)
    return str(path)


def test_types_and_missing_tokens(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'n,f,s,b,e,d\n1,2.5,"x, ""y""",True,NA,2024-01-02\n2,N/A,null,False,,2024-01-03\n -3,1e3,z,true,NaN,x\n')
    df = ingest.ingest(spark, path, "csv")
    assert dict(df.dtypes) == {"n": "bigint", "f": "double", "s": "string", "b": "boolean", "e": "double", "d": "string"}
    assert [tuple(r)[:4] for r in df.collect()] == [(1, 2.5, 'x, "y"', True), (2, None, None, False), (-3, 1000.0, "z", True)]


@pytest.mark.parametrize("text", ["", "a,a\n1,2\n", "a,\n1,2\n"])
def test_unusable_input(spark, tmp_path, text):
    with pytest.raises(ingest.InputError):
        ingest.scan_csv(spark, write(tmp_path / "bad.csv", text))


def test_ragged_rows_are_refused(spark, tmp_path):
    with pytest.raises(Exception):
        ingest.scan_csv(spark, write(tmp_path / "bad.csv", "a,b\n1,2,3\n")).collect()


def test_files_with_other_headers_are_refused(spark, tmp_path):
    (tmp_path / "d").mkdir()
    write(tmp_path / "d" / "1.csv", "a,b\n1,x\n")
    write(tmp_path / "d" / "2.csv", "a,b\n2,y\n")
    write(tmp_path / "d" / "3.csv", "")
    assert sorted(map(tuple, ingest.scan_csv(spark, str(tmp_path / "d")).collect())) == [(1, "x"), (2, "y")]
    write(tmp_path / "d" / "4.csv", "b,a\nz,3\n")
    with pytest.raises(ingest.InputError, match="headers"):
        ingest.scan_csv(spark, str(tmp_path / "d"))


def test_versions_are_written_once(spark, tmp_path):
    df = spark.range(3)
    store.freeze_version(df, str(tmp_path), 1, 1)
    with pytest.raises(Exception):
        store.freeze_version(df, str(tmp_path), 1, 1)


def test_file_hash(spark, tmp_path):
    path = write(tmp_path / "f.bin", "some bytes")
    got = fingerprint.file_hashes(spark, path).first()
    assert got["file_hash"] == hashlib.sha256(b"some bytes").hexdigest() and got["length"] == 10


def test_content_hash_sees_nulls_and_copies(spark):
    h = lambda rows: fingerprint.content_hash(spark.createDataFrame(rows, "a string, b string")).first()["content_hash"]
    base = h([("x", None), ("y", "z")])
    assert base == h([("y", "z"), ("x", None)])
    assert len({base, h([(None, "x"), ("y", "z")]), h([("x", ""), ("y", "z")]), h([("x", None), ("y", "z"), ("y", "z")])}) == 4


def test_notes_with_continuation(spark):
    df = spark.createDataFrame([(1, "first line\nKnown limitations: few rows\n  and more\nempty:\n")], "id long, text string")
    got = [(r["label"], r["value"]) for r in metadata.parse_notes(df, "id", "text").orderBy("position").collect()]
    assert got == [("Version notes", "first line"), ("Known limitations", "few rows and more")]
