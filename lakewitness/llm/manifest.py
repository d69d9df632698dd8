"""Merkle manifest of a table of documents, with leaf coordinates from bitmap ranks.

Each row is a leaf; the leaves of a language ascend by doc_id and are hashed together in runs of two, level by level, to a
subroot; the subroots of all languages, ordered by language, are hashed likewise to the root.

Coordinates come without sorting the rows. The doc_ids of a language become bitmaps of 64 ids a word; words that are
empty are not kept. A directory holds the number of rows before each word within its container of 2^16 ids, before each
container within the next 2^16 of them, and so on up (four levels for 64-bit ids), so every directory is summed
in pieces of at most 2^16 entries. The coordinate of a row is the sum of its directory entries and the popcount of the
lower bits of its word. Rows that share a doc_id follow each other by leaf: they are counted by the first 16
bits of the leaf, and ordered only within these.

Leaves then move once more, keyed by (language, coordinate / 1024), into arrays with one slot per coordinate. An array
reduces ten levels in one step; its top is a slot of the next array. Going back down, each array adds its siblings to
the proof that its top got from above. Texts are never shuffled, and no task holds more than 1024 leaves at a time.

Defined results: null fields are ``-``; a null doc_id comes before all others, a null language before all others; rows
equal in all fields have one leaf each, in any order among themselves; a language with one row has its leaf as subroot, a
table with one language its subroot as root; an empty table gives an empty result; other columns are not read. The
languages are ordered in one task, one row each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakewitness.llm.common import CRC_TABLE_SQL, crc32_sql, table
from lakewitness.session import cut, ship_package

# Bits of a slot array's coordinates: it has 2^SLOT_BITS slots and reduces SLOT_BITS levels.
SLOT_BITS = 10
# Rows a task makes at once of one group of equal rows.
PIECE = 4096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# Below the word of the least 64-bit id, and alone in its containers on all levels.
NULL_WORD = -(2**57) - 1
PROOF = "array<struct<side:int,hash:string>>"
_PROOF_ARROW = pa.list_(pa.struct([("side", pa.int32()), ("hash", pa.string())]))


def leaf(**changed: Column) -> Column:
    """Hash of a row's fields; ``changed`` replaces some of them."""
    parts = []
    for f in FIELDS:
        value = changed.get(f, F.col(f)).cast("string")
        parts.append(F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*parts), 256)


def _running(df: DataFrame, within: list[str], by: str, total: str, name: str) -> DataFrame:
    before = W.partitionBy(*within).orderBy(by).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(total).over(before), F.lit(0)))


def _directory(words: DataFrame) -> DataFrame:
    """Words (group, word, total, ...) with ``before``, the rows of the group in lower words, and ``rows``, all of the group.

    Containers hold 2^10 words, those above 2^16 of the ones below them.
    """
    low = words.withColumn("c1", F.shiftright("word", 10))
    one = low.groupBy("group", "c1").agg(F.sum("total").alias("total")).withColumn("c2", F.shiftright("c1", 16))
    two = one.groupBy("group", "c2").agg(F.sum("total").alias("total")).withColumn("c3", F.shiftright("c2", 16))
    three = two.groupBy("group", "c3").agg(F.sum("total").alias("total"))
    three = _running(three, ["group"], "c3", "total", "b3").withColumn("rows", F.sum("total").over(W.partitionBy("group"))).drop("total")
    two = _running(two, ["group", "c3"], "c2", "total", "b2").drop("total").join(three, ["group", "c3"]).drop("c3")
    one = _running(one, ["group", "c2"], "c1", "total", "b1").drop("total").join(two, ["group", "c2"])
    one = one.select("group", "c1", (F.col("b1") + F.col("b2") + F.col("b3")).alias("above"), "rows")
    low = _running(low, ["group", "c1"], "word", "total", "b0").join(one, ["group", "c1"])
    return low.withColumn("before", F.col("b0") + F.col("above")).drop("c1", "b0", "above", "total")


def coordinates(rows: DataFrame) -> DataFrame:
    """Rows (group, doc_id, leaf, ...) with ``pos``, gapless from 0 in each group by doc_id and leaf, and ``rows`` of the group."""
    keys = rows.columns
    word = F.coalesce(F.shiftright(F.col("doc_id").cast("long"), 6), F.lit(NULL_WORD).cast("long"))
    bit = F.coalesce(F.col("doc_id").cast("long").bitwiseAND(F.lit(63)), F.lit(0)).cast("int")
    # Equal rows are one row with a count from here on.
    packs = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    packs = cut(packs.select("*", word.alias("word"), bit.alias("bit"), F.conv(F.substring("leaf", 1, 4), 16, 10).cast("int").alias("head")))

    heads = packs.groupBy("group", "word", "bit", "head").agg(F.sum("n").alias("n")).repartition("group", "word")
    ids = heads.groupBy("group", "word", "bit").agg(F.sum("n").alias("n"))
    more = F.when(F.col("n") > 1, F.struct("bit", (F.col("n") - 1).alias("more")))
    words = ids.groupBy("group", "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"), F.sum("n").alias("total"), F.collect_list(more).alias("more"))
    lower = F.expr("bits & CASE WHEN bit = 0 THEN 0L ELSE shiftrightunsigned(-1L, 64 - bit) END")
    extra = F.expr("aggregate(filter(more, x -> x.bit < bit), 0L, (s, x) -> s + x.more)")
    heads = _running(heads, ["group", "word", "bit"], "head", "n", "of_id").join(_directory(words), ["group", "word"])
    heads = heads.select("group", "word", "bit", "head", "rows", (F.col("before") + F.bit_count(lower) + extra + F.col("of_id")).alias("start"))

    keyed = packs.join(heads, ["group", "word", "bit", "head"])
    keyed = _running(keyed, ["group", "word", "bit", "head"], "leaf", "n", "of_head")
    pieces = keyed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / PIECE))).alias("piece"))
    left = F.least(F.lit(PIECE).cast("long"), F.col("n") - F.col("piece") * PIECE)
    each = pieces.select("*", F.explode(F.sequence(F.lit(0).cast("long"), left - 1)).alias("i"))
    return each.select(*keys, (F.col("start") + F.col("of_head") + F.col("piece") * PIECE + F.col("i")).alias("pos"), "rows")


def _h(texts: list[str]) -> str:
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def _levels(hashes: list[str], count: int) -> list[list[str]]:
    """The levels an array reduces, its own slots first; ``count`` is the number of slots of the whole group."""
    out = [hashes]
    for _ in range(min(SLOT_BITS, (count - 1).bit_length())):
        out.append([_h(out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def _slot_arrays(nodes: DataFrame, carried: list[str]) -> DataFrame:
    slot = F.struct(F.col("pos").bitwiseAND(F.lit((1 << SLOT_BITS) - 1)).cast("int").alias("slot"), "hash", *carried)
    return nodes.groupBy("group", F.shiftright("pos", SLOT_BITS).alias("block")).agg(F.sort_array(F.collect_list(slot)).alias("slots"), F.max("count").alias("count"))


def _one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.StructArray, list[list[str]]]]:
    """Each array as a batch of one row, with its slots and levels."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            slots = row.column("slots").flatten()
            yield row, slots, _levels(slots.field("hash").to_pylist(), row.column("count")[0].as_py())


def _reduced(blocks: DataFrame) -> DataFrame:
    """The top of each array, as a slot of the next ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, _, levels in _one_by_one(batches):
            after = -(-row.column("count")[0].as_py() // (1 << SLOT_BITS))
            yield pa.RecordBatch.from_arrays(
                [row.column("group"), row.column("block"), pa.array(levels[-1], pa.string()), pa.array([after], pa.int64())], ["group", "pos", "hash", "count"]
            )

    return blocks.mapInArrow(run, "group string, pos bigint, hash string, count bigint")


def _climb(nodes: DataFrame, most: int, carried: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """The slot arrays of each step, and the last node of each group; ``most`` is the size of the largest group."""
    steps = []
    while True:
        steps.append(cut(_slot_arrays(nodes, carried)))
        nodes, most, carried = cut(_reduced(steps[-1])), -(-most // (1 << SLOT_BITS)), []
        if most <= 1:
            return steps, nodes


def _proofs(blocks: DataFrame, above: DataFrame, carried: dict[str, str]) -> DataFrame:
    """One row per slot: group, pos, hash, the carried fields, and the siblings from there to the root."""
    kept = [c for c in above.columns if c not in ("group", "block", "proof")]
    types = dict(above.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, slots, levels in _one_by_one(batches):
            n, first = len(slots), row.column("block")[0].as_py() << SLOT_BITS
            upper = row.column("proof")[0].values
            sides, hashes, ends = [], [], [0]
            up_sides, up_hashes = upper.field("side").to_pylist(), upper.field("hash").to_pylist()
            for i in range(n):
                for level in levels[:-1]:
                    other = i ^ 1
                    there = other < len(level)
                    sides.append((1 if other > i else -1) if there else 0)
                    hashes.append(level[other] if there else None)
                    i >>= 1
                sides += up_sides
                hashes += up_hashes
                ends.append(len(sides))
            entries = pa.StructArray.from_arrays([pa.array(sides, pa.int32()), pa.array(hashes, pa.string())], ["side", "hash"])
            proof = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries).cast(_PROOF_ARROW)
            again = pa.array([0] * n)
            columns = [row.column("group").take(again), pa.array(range(first, first + n), pa.int64()), slots.field("hash")]
            columns += [slots.field(c) for c in carried] + [row.column(c).take(again) for c in kept] + [proof]
            yield pa.RecordBatch.from_arrays(columns, ["group", "pos", "hash", *carried, *kept, "proof"])

    schema = ["group string", "pos bigint", "hash string", *[f"`{c}` {t}" for c, t in carried.items()], *[f"`{c}` {types[c]}" for c in kept], f"proof {PROOF}"]
    return blocks.join(above, ["group", "block"]).mapInArrow(run, ", ".join(schema))


def _descend(steps: list[DataFrame], above: DataFrame, carried: dict[str, str]) -> DataFrame:
    """Proofs of the first step's slots, from those of the last nodes (group, proof, ...)."""
    above = above.withColumn("block", F.lit(0).cast("long"))
    for k in reversed(range(len(steps))):
        above = _proofs(steps[k], above, carried if k == 0 else {})
        if k:
            above = above.drop("hash").withColumnRenamed("pos", "block")
    return above


def manifest(docs: DataFrame, **carry: Column) -> DataFrame:
    """One row per document: lang, doc_id, position (in its language), leaf, subroot, root, proof.

    ``proof`` has one entry for each level from the leaf to the root: ``side`` is -1 or 1 where the sibling ``hash`` stands
    left or right, 0 where a node was hashed alone. ``carry`` names strings to compute from each row and keep.
    """
    ship_package(docs.sparkSession)
    group = F.when(F.col("lang").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("lang").cast("string")))
    rows = docs.select(group.alias("group"), F.col("doc_id").cast("long").alias("doc_id"), leaf().alias("leaf"), *[c.alias(n) for n, c in carry.items()])
    carried = {"doc_id": "bigint", **{n: "string" for n in carry}}
    nodes = coordinates(rows).withColumnRenamed("leaf", "hash").withColumnRenamed("rows", "count")

    # The size of the largest group says how many steps there are; the first step's arrays are written before it is asked.
    first = cut(_slot_arrays(nodes, list(carried)))
    most = first.agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    tops = cut(_reduced(first))
    upper, subroots = _climb(tops, -(-most // (1 << SLOT_BITS)), []) if most > 1 << SLOT_BITS else ([], tops)

    order = W.orderBy("group")
    roots = cut(subroots.select("group", "hash", (F.row_number().over(order) - 1).cast("long").alias("pos")))
    languages = roots.count()
    if not languages:
        return _named(first.sparkSession.createDataFrame([], _schema(carried)), list(carry))
    node = roots.select(F.lit("").alias("group"), "pos", "hash", F.lit(languages).cast("long").alias("count"), F.col("group").alias("of"))
    ends, last = _climb(node, languages, ["of"])
    top = last.select("group", F.col("hash").alias("root"), F.lit(None).cast(PROOF).alias("proof")).withColumn("proof", F.array().cast(PROOF))
    above = _descend(ends, top, {"of": "string"}).select(F.col("of").alias("group"), F.col("hash").alias("subroot"), "root", "proof")
    return _named(_descend([first, *upper], above, carried), list(carry))


def _schema(carried: dict[str, str]) -> str:
    fields = {"group": "string", "pos": "bigint", "hash": "string", **carried, "subroot": "string", "root": "string", "proof": PROOF}
    return ", ".join(f"`{c}` {t}" for c, t in fields.items())


def _named(rows: DataFrame, carried: list[str]) -> DataFrame:
    lang = F.when(F.col("group") != "", F.expr("substring(group, 2)"))
    return rows.select(lang.alias("lang"), "doc_id", F.col("pos").alias("position"), F.col("hash").alias("leaf"), "subroot", "root", "proof", *carried)


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings lead to."""

    def up(at: Column, s: Column) -> Column:
        return F.sha2(F.when(s["side"] < 0, F.concat(s["hash"], at)).when(s["side"] > 0, F.concat(at, s["hash"])).otherwise(at), 256)

    return F.aggregate(proof, start, up)


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Manifest of documents; where 7 divides the CRC-32 of the doc_id, the leaf is folded from a row whose n_chars is one more."""
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    more = (F.col("n_chars").cast("decimal(20,0)") + F.lit(1).cast("decimal(20,0)")).cast("decimal(21,0)")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, leaf(n_chars=more))
    rows = manifest(docs, tampered=tampered)
    siblings = F.transform(F.filter("proof", lambda s: s["hash"].isNotNull()), lambda s: s["hash"])
    out = rows.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.array_join(siblings, ""), 256).alias("proof_sha256"),
        folded(F.coalesce("tampered", "leaf"), F.col("proof")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE octet_length(encode(({value})::VARCHAR)) || ':' || ({value})::VARCHAR END"


_LEAF = "sha256(" + " || ".join(_field(f) for f in FIELDS) + ")"
_TAMPERED = "sha256(" + " || ".join(_field("n_chars::HUGEINT + 1" if f == "n_chars" else f) for f in FIELDS) + ")"
_UP = "list_transform(range((len(h) + 1) // 2), lambda i: sha256(h[2 * i + 1] || coalesce(h[2 * i + 2], '')))"
# A sibling as text: where it stands, then its hash; N where there is none.
_SIBLING = "CASE WHEN {p} // (1 << l) % 2 = 1 THEN 'L' || h[{p} // (1 << l)] WHEN {p} // (1 << l) + 2 <= len(h) THEN 'R' || h[{p} // (1 << l) + 2] ELSE 'N' END"
OP12_SQL = f"""
WITH RECURSIVE t AS (SELECT {CRC_TABLE_SQL} AS crc),
leaves AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {_LEAF} AS leaf,
  CASE WHEN {crc32_sql("doc_id::VARCHAR", "crc")} % 7 = 0 THEN {_TAMPERED} ELSE {_LEAF} END AS start FROM documents, t),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, row_number() OVER () AS id FROM leaves),
low AS (SELECT g, 0 AS l, list(leaf ORDER BY p) AS h FROM placed GROUP BY g UNION ALL SELECT g, l + 1, {_UP} FROM low WHERE len(h) > 1),
tops AS (SELECT g, h[1] AS subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS q FROM low WHERE len(h) = 1),
high AS (SELECT 0 AS l, list(subroot ORDER BY q) AS h FROM tops HAVING count(*) > 0 UNION ALL SELECT l + 1, {_UP} FROM high WHERE len(h) > 1),
parts AS (SELECT id, 0 AS part, l, {_SIBLING.format(p="p")} AS s FROM placed JOIN low USING (g) WHERE len(h) > 1
  UNION ALL SELECT id, 1, l, {_SIBLING.format(p="q")} FROM placed JOIN tops USING (g), high WHERE len(h) > 1),
paths AS (SELECT id, list(s ORDER BY part, l) AS path FROM parts GROUP BY id),
every AS (SELECT placed.*, subroot, coalesce(path, []::VARCHAR[]) AS path FROM placed JOIN tops USING (g) LEFT JOIN paths USING (id)),
done AS (SELECT doc_id, leaf, subroot, (SELECT h[1] FROM high WHERE len(h) = 1) AS root, sha256(list_aggregate(list_prepend('', list_transform(path, lambda s: substr(s, 2))), 'string_agg', '')) AS proof_sha256,
  list_reduce(list_prepend(start, path), lambda a, s: sha256(CASE s[1] WHEN 'L' THEN substr(s, 2) || a WHEN 'R' THEN a || substr(s, 2) ELSE a END)) AS folded_root FROM every)
SELECT *, folded_root = root AS verified FROM done
"""
