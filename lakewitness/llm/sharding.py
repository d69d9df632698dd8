"""Sharding by a hierarchical weighted hash tree.

A document descends region, rack and shard. At each level every child makes a draw -ln(u) / weight, with u hashed
from the key and the child's name, and the smallest draw wins; a child gets a share in proportion to its weight,
and a changed weight moves keys only into or out of that child's subtree. Shards beyond the base layout open a
branch of their own, so one more shard takes rows only into itself.

Law: ``key``; doc_id and the number of shards decide. Defined results: null doc_ids share one key; a null text has
no bytes; repeated rows go to the same shard and take neighbouring slots; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lakewitness.llm.common import packed, table, unit_draw, whole_text

SHARDS = 16
REGIONS, RACKS = 2, 2
# Rows numbered together in one window; more rows mean more buckets, not larger ones.
BUCKET_ROWS = 100_000
# A run of equal rows is spread over slots in pieces of this many.
PIECE = 1 << 16


def tree(shards: int, base: int = SHARDS, regions: int = REGIONS, racks: int = RACKS) -> list[tuple[str, str, int, float]]:
    """(region, rack, shard, weight) of every shard: the base layout, then one region for each further shard."""
    first = min(shards, base)
    nodes = []
    for shard in range(first):
        region = shard * regions // first
        within = [s for s in range(first) if s * regions // first == region]
        nodes.append((f"region{region}", f"rack{within.index(shard) * racks // len(within)}", shard, 1.0))
    return nodes + [(f"region{regions + i}", "rack0", shard, 1.0) for i, shard in enumerate(range(first, shards))]


def _children(nodes: list[tuple[str, str, int, float]], level: int) -> Column:
    """Map from the path of a node to its children with their weights."""
    below: dict[str, dict[str, float]] = {}
    for row in nodes:
        weights = below.setdefault("".join(f"/{part}" for part in row[:level]), {})
        weights[str(row[level])] = weights.get(str(row[level]), 0.0) + row[3]
    pairs = []
    for path, weights in below.items():
        pairs += [F.lit(path), F.array(*[F.struct(F.lit(c).alias("name"), F.lit(w).alias("weight")) for c, w in weights.items()])]
    return F.create_map(*pairs)


def with_shard(df: DataFrame, key: str, nodes: list[tuple[str, str, int, float]], name: str) -> DataFrame:
    """Adds the shard that column ``key`` descends to, level by level, as column ``name``."""
    kept = df.columns
    df = df.withColumn("_path", F.lit(""))
    for level in range(3):
        draw = lambda c: F.struct((-F.ln(unit_draw(F.col(key), F.col("_path"), c["name"])) / c["weight"]).alias("draw"), c["name"].alias("name"))
        first = F.array_min(F.transform(F.element_at(_children(nodes, level), F.col("_path")), draw))
        df = df.withColumn("_child", first["name"]).withColumn("_path", F.concat_ws("/", "_path", "_child"))
    return df.select(*kept, F.col("_child").cast("int").alias(name))


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Every row with its ``shard``, which takes the place of a column of that name."""
    rows = packed(docs).select("_row", F.col("_row.doc_id").alias("_key"))
    others = [F.col("_row").getField(c).alias(c) for c in docs.columns if c.lower() != "shard"]
    return with_shard(rows, "_key", tree(shards), "_shard").select(*others, F.col("_shard").alias("shard"))


def slotted(df: DataFrame, keys: list[str], shard: str, rows: int) -> DataFrame:
    """The rows of ``df`` (columns ``keys``, one of them ``shard``), each with its ``slot``, gapless from 0 in its shard.

    Equal rows are counted first. Buckets of a bounded number of distinct rows are numbered one by one, and their
    totals, one row each, give the offsets.
    """
    buckets = max(1, -(-rows // BUCKET_ROWS))
    runs = df.groupBy(*keys).agg(F.count("*").alias("n"))
    runs = runs.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    totals = runs.groupBy(shard, "bucket").agg(F.sum("n").alias("all"))
    before = W.partitionBy(shard).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(shard, "bucket", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("offset"))
    upto = W.partitionBy(shard, "bucket").orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)
    placed = runs.withColumn("start", F.coalesce(F.sum("n").over(upto), F.lit(0))).join(offsets, [shard, "bucket"])
    placed = placed.select(*keys, "n", (F.col("start") + F.col("offset")).alias("at"))
    pieces = placed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / PIECE))).alias("piece"))
    left = F.least(F.lit(PIECE).cast("long"), F.col("n") - F.col("piece") * PIECE)
    slots = F.explode(F.sequence(F.lit(0).cast("long"), left - 1)).alias("i")
    return pieces.select("*", slots).select(*keys, (F.col("at") + F.col("piece") * PIECE + F.col("i")).cast("long").alias("slot"))


def op8_hash_tree_shards(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = whole_text()
    rows = docs.select("doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = with_shard(rows, "doc_id", tree(SHARDS), "shard")
    out = slotted(rows, rows.columns, "shard", docs.count()).withColumn("law", F.lit("key"))
    out = with_shard(out, "doc_id", tree(SHARDS + 1), "grown_shard")
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _draws(names: list[str], path: str) -> str:
    """SQL for the child with the smallest draw among children of equal weight, from (name, weight) pairs."""
    draw = lambda child, w: f"-ln((('0x' || substr(md5(doc_id || ':' || {path} || ':{child}'), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) / {w}"
    return "list_min([" + ", ".join(f"struct_pack(draw := {draw(c, w)}, child := '{c}')" for c, w in names) + "]).child"


def _oracle() -> str:
    out = []
    for name, shards in (("s", SHARDS), ("g", SHARDS + 1)):
        extra = [(f"region{REGIONS + i}", 1.0) for i in range(shards - SHARDS)]
        regions = _draws([(f"region{r}", float(SHARDS // REGIONS)) for r in range(REGIONS)] + extra, "''")
        racks = _draws([(f"rack{k}", float(SHARDS // REGIONS // RACKS)) for k in range(RACKS)], "r")
        each = SHARDS // REGIONS // RACKS
        leaf = " ".join(
            f"WHEN '/region{r}/rack{k}' THEN " + _draws([(str((r * RACKS + k) * each + i), 1.0) for i in range(each)], "k") for r in range(REGIONS) for k in range(RACKS)
        )
        last = f"WHEN r = '/region{REGIONS}' THEN '{SHARDS}'" if extra else ""
        out.append(f"{name}1 AS (SELECT doc_id, '/' || {regions} AS r FROM documents)")
        out.append(f"{name}2 AS (SELECT *, r || '/' || {racks} AS k FROM {name}1)")
        out.append(f"{name} AS (SELECT doc_id, (CASE {last} ELSE CASE k {leaf} END END)::INT AS shard FROM {name}2)" if extra else f"{name} AS (SELECT doc_id, (CASE k {leaf} END)::INT AS shard FROM {name}2)")
    # CRC-32 by its definition: a table from the reversed polynomial, then one step for each byte
    steps = "list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b))"
    return f"""
WITH t AS (SELECT {steps} AS crc),
d AS (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS digits FROM documents),
b AS (SELECT doc_id, list_transform(range(length(digits) // 2), lambda i: ('0x' || substr(digits, 2 * i + 1, 2))::BIGINT) AS bytes FROM d),
c AS (SELECT doc_id, xor(list_reduce(bytes, lambda a, x: xor(a >> 8, crc[(xor(a, x) & 255) + 1]), 4294967295), 4294967295) AS text_crc32 FROM b, t),
{", ".join(out)},
rows AS (SELECT doc_id, octet_length(encode(text))::BIGINT + 1 AS size, text_crc32::BIGINT AS text_crc32, s.shard, g.shard AS grown_shard FROM d JOIN c USING (doc_id) JOIN s USING (doc_id) JOIN g USING (doc_id))
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, size, text_crc32) - 1 AS slot, grown_shard FROM rows
"""


OP8_SQL = _oracle()
