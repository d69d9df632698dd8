"""Small expressions the operators of this subpackage share."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewitness.session import cut, ship_package

EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def packed(df: DataFrame) -> DataFrame:
    """The row as one struct, so that no column of the input can clash with one an operator adds."""
    return df.select(F.struct(F.col("*")).alias("_row"))


def unpacked(df: DataFrame) -> DataFrame:
    return df.select("_row.*")


def text_digest(text: Column) -> Column:
    """128 bits of SHA-256, as 16 bytes: the identity of a distinct text."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def unit_draw(*parts: Column) -> Column:
    """A number in (0, 1) that depends on the parts only: 52 bits of an MD5 of the parts joined by colons."""
    digits = F.substring(F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])), 1, 13)
    return (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))


def column_of(struct: pa.StructArray, name: str) -> pa.Array:
    """A field of a packed row, by its name in any case."""
    return struct.field(next(f.name for f in struct.type if f.name.lower() == name))


# Bytes of results a task holds before it passes them on.
HELD_BYTES = 1 << 22


def with_numbers(df: DataFrame, fn: Callable[[str], np.ndarray | None], name: str) -> DataFrame:
    """The ``text`` column replaced by the 64-bit numbers ``fn`` makes of it, in Arrow pieces of bounded size."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, others = batch.column("text"), batch.drop_columns(["text"])
            held, size, start = [], 0, 0
            for k in range(batch.num_rows):
                held.append(fn(texts[k].as_py()))
                size += 0 if held[-1] is None else held[-1].nbytes
                if size > HELD_BYTES or k == batch.num_rows - 1:
                    columns = others.slice(start, k + 1 - start).columns
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(held, pa.list_(pa.int64()))], [*others.schema.names, name])
                    held, size, start = [], 0, k + 1

    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes if c != "text")
    return df.mapInArrow(run, f"{schema}, `{name}` array<bigint>")


def settled(df: DataFrame) -> DataFrame:
    """``cut``, after which the shuffle files behind ``df`` may go: Spark deletes them when the driver collects its garbage."""
    out = cut(df)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


# DuckDB: CRC-32 by its definition, a table from the reversed polynomial, then one step for each byte.
CRC_TABLE_SQL = "list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b))"


def crc32_sql(text: str, crc: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a text, given the table ``CRC_TABLE_SQL`` as ``crc``."""
    digits = f"hex(encode({text}))"
    code = f"list_transform(range(length({digits}) // 2), lambda i: ('0x' || substr({digits}, 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce({code}, lambda a, x: xor(a >> 8, {crc}[(xor(a, x) & 255) + 1]), 4294967295), 4294967295)"
