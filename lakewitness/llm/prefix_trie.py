"""Prefix trie of conversations, as balanced parentheses per shard.

A conversation is the row of its turns' digests, 16 bytes each, so bytewise order puts all that begin alike next to each
other. Equal conversations become one; the others are dealt to shards by ranges of that order. A shard writes its trie as
balanced parentheses, an opening one per node in preorder. The running excess, with minima over blocks of growing size, answers
for all nodes at once: findclose gives the end of each subtree, the same search backwards the parent, rank over ``()`` the
leaves in it, and sums along the preorder the conversations and the tokens that sharing saves.

Only the nodes on the path to a shard's first or last conversation can occur in another shard: the spine. What a shard adds
to them is summed by node. A shard knows how many turns its first conversation shares with the last one before, so that
every node is counted as a child, and with its own tokens, by one shard only.

Texts stay where they are; turns move as digests. A task holds one shard, of about SHARD_TURNS turns, or the digests of one
conversation. The digest of a node's conversation ids is over one ordered text, so equal conversations stream through one
task, in any number, without being held.

Defined results: a null role or text is empty; a null turn comes first; turns with one number follow each other by role,
then by the digest of role and text; rows without conv_id belong to no conversation and are left out; repeated rows are
repeated turns; a conversation without turns ends at the root; an empty table has no nodes; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakewitness.llm.common import CRC_TABLE_SQL, EMPTY_SHA256, crc32_sql, table
from lakewitness.session import cut, ship_package

# Turns of a shard, about; bytes of a turn's digest; conversations that share one beginning, and the turns it may have.
SHARD_TURNS, WIDTH, BLOCK, LEAD = 1 << 20, 16, 20, 4
WORDS = r"[^\x20\x09-\x0D]+"
_MOST = np.iinfo(np.int64).max


class Minima:
    """Minima over blocks of 1, 2, 4, ... values."""

    def __init__(self, values: np.ndarray):
        self.n, self.levels = len(values), [values]
        while len(self.levels[-1]) > 1:
            if len(self.levels[-1]) % 2:
                self.levels[-1] = np.append(self.levels[-1], _MOST)
            self.levels.append(self.levels[-1].reshape(-1, 2).min(axis=1))

    def next_smaller(self, at: np.ndarray) -> np.ndarray:
        """First place after each of ``at`` whose value is smaller; ``n`` where there is none."""
        goal, node = self.levels[0][at], at + 1
        level = np.full(len(at), -1)
        rest = np.arange(len(at))
        for k, low in enumerate(self.levels):
            # An even node is covered by its parent; an odd one is looked at, then left behind.
            rest = rest[node[rest] < len(low)]
            look = rest[(node[rest] % 2 == 1) | (k == len(self.levels) - 1)]
            hit = look[low[node[look]] < goal[look]]
            level[hit] = k
            rest = rest[level[rest] < 0]
            odd = rest[node[rest] % 2 == 1]
            node[odd] += 1
            node[rest] >>= 1
        for k in range(len(self.levels) - 2, -1, -1):
            down = np.flatnonzero(level > k)
            node[down] *= 2
            node[down] += self.levels[k][node[down]] >= goal[down]
        return np.where(level < 0, self.n, node)

    def within(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Least value of each range of places from ``low``, ending before ``high``."""
        low, high, out = low.copy(), high.copy(), np.full(len(low), _MOST)
        for values in self.levels:
            a = np.flatnonzero((low < high) & (low % 2 == 1))
            out[a] = np.minimum(out[a], values[low[a]])
            low[a] += 1
            b = np.flatnonzero((low < high) & (high % 2 == 1))
            high[b] -= 1
            out[b] = np.minimum(out[b], values[high[b]])
            low >>= 1
            high >>= 1
        return out


def common_turns(a: bytes, b: bytes) -> int:
    """Number of turns two conversations begin with alike."""
    n = min(len(a), len(b))
    differ = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return (int(differ.argmax()) if differ.any() else n) // WIDTH


class Trie:
    """The trie of distinct conversations in order: digests, words of their turns, copies of each, the least id of these.

    ``before`` and ``after``: turns that the first and the last one share with their neighbours in other shards, -1 without one.
    """

    def __init__(self, keys: list[bytes], words: list[np.ndarray], copies: np.ndarray, least: np.ndarray, before: int, after: int):
        size = np.array([len(k) // WIDTH for k in keys])
        shared = np.array([0, *map(common_turns, keys, keys[1:])])
        opened = size - shared
        closed = np.append(0, size[:-1]) - shared
        steps = np.concatenate([[1], np.stack([closed, opened], axis=1).ravel(), [size[-1] + 1]])
        # The root opens; each conversation closes what it doesn't share and opens its own; at last all close.
        bits = np.repeat(np.concatenate([[1], np.tile([-1, 1], len(keys)), [-1]]), steps)
        excess = np.cumsum(bits)
        opens = np.flatnonzero(bits > 0)
        closes = Minima(excess).next_smaller(opens)
        self.depth = excess[opens] - 1
        n, at = len(opens), np.arange(len(opens))
        end = at + (closes - opens + 1) // 2
        self.parent = n - 1 - Minima(self.depth[::-1].copy()).next_smaller(n - 1 - at)
        node = np.cumsum(opened)

        tokens = np.concatenate([[0], *(w[s:] for w, s in zip(words, shared))]).astype(np.int64)
        own, ids = np.zeros(n, np.int64), np.full(n, _MOST)
        own[node], ids[node] = copies, least
        total = lambda values: (c := np.append(0, np.cumsum(values)))[end] - c[at]
        self.convs = total(own)
        self.least = Minima(ids).within(at, end)
        pairs = np.append((bits[:-1] > 0) & (bits[1:] < 0), False)
        # The last conversation is no leaf if the next shard goes on from it.
        pairs[opens[node[-1]]] &= after < size[-1]
        rank = np.cumsum(pairs)
        self.leaves = rank[closes] - rank[opens] + pairs[opens]
        new = ~((at <= size[0]) & (self.depth <= before))
        self.children = np.bincount(self.parent[1:], new[1:], n).astype(np.int64)
        self.saved = total((self.convs - new) * tokens)
        on_last = closes >= opens[node[-1]]
        on_last[node[-1] + 1 :] = False
        self.first_path, self.last_path = (at <= size[0]) & (self.depth <= before), on_last & (self.depth <= after)
        self.end_of = np.full(n, -1)
        self.end_of[node] = np.arange(len(keys))

    def spine(self, keys: list[bytes]) -> dict[int, bytes]:
        """Digests of the beginnings that other shards may have too, by node."""
        name = lambda key, nodes: {int(v): hashlib.sha256(key[: WIDTH * int(self.depth[v])]).digest()[:16] for v in nodes}
        return name(keys[0], np.flatnonzero(self.first_path)) | name(keys[-1], np.flatnonzero(self.last_path))


_NODE = "conv bigint, depth bigint, parent_conv bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved bigint, ends string, id binary, parent_id binary"


def _nodes_of(rows: list[tuple]) -> pa.RecordBatch:
    keys, words, copies, least, ends, before, after = zip(*rows)
    t = Trie(list(keys), [np.array(w, np.int64) for w in words], np.array(copies), np.array(least), before[0], after[0])
    names = t.spine(list(keys))
    n = len(t.depth)
    ids = np.full(n, None, object)
    for v, name in names.items():
        ids[v] = name
    inside = t.parent < n
    parent = np.where(inside & (np.arange(n) > 0), t.parent, 0)
    above = ids[parent]
    above[0] = None
    known = np.array([i is None for i in above])
    known[0] = False
    digest = np.array([*ends, None], object)[t.end_of]
    columns = [
        pa.array(t.least), pa.array(t.depth, pa.int64()), pa.array(t.least[parent], pa.int64(), mask=~known), pa.array(t.convs), pa.array(t.children),
        pa.array(t.leaves, pa.int64()), pa.array(t.saved), pa.array(list(digest), pa.string()), pa.array(list(ids), pa.binary()), pa.array(list(above), pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in _NODE.split(", ")])


def _shard_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of each shard, from its conversations in order."""
    held, of = [], None
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("shard", "key", "words", "copies", "conv", "ends", "before", "after")))
        for shard, *row in rows:
            if held and shard != of:
                yield _nodes_of(held)
                held = []
            of = shard
            held.append(tuple(row))
    if held:
        yield _nodes_of(held)


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number, least id and digest of all ids of equal conversations, from rows ordered by digest and id."""
    of, count, least, state = None, 0, 0, None
    done: list[tuple] = []
    schema = pa.schema([("id", pa.binary()), ("copies", pa.int64()), ("conv", pa.int64()), ("ends", pa.string())])
    for batch in batches:
        ids, convs = batch.column("id").to_pylist(), batch.column("conv").to_pylist()
        a = 0
        while a < len(ids):
            b = a + 1
            while b < len(ids) and ids[b] == ids[a]:
                b += 1
            if ids[a] != of:
                if of is not None:
                    done.append((of, count, least, state.hexdigest()))
                of, count, least, state = ids[a], 0, convs[a], hashlib.sha256()
            state.update((("," if count else "") + ",".join(map(str, convs[a:b]))).encode())
            count += b - a
            a = b
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
            done = []
    if of is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((of, count, least, state.hexdigest()), schema)], schema=schema)


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns that a shard's first and last conversation share with their neighbours in other shards."""
    share = lambda a, b: -1 if a is None or b is None else common_turns(a, b)
    for batch in batches:
        first, last, previous, following = (batch.column(c).to_pylist() for c in ("first", "last", "previous", "following"))
        before, after = list(map(share, first, previous)), list(map(share, last, following))
        yield pa.RecordBatch.from_arrays([batch.column("shard"), pa.array(before, pa.int32()), pa.array(after, pa.int32())], ["shard", "before", "after"])


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv, key (the digests of its turns) and words of them, after every block of conversations took its first one's beginning."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH)
    turn = F.struct("turn", role.alias("role"), digest.alias("digest"), F.regexp_count(text, F.lit(WORDS)).alias("words"))
    own = conversations.where("conv_id IS NOT NULL").groupBy(F.col("conv_id").cast("long").alias("conv")).agg(F.sort_array(F.collect_list(turn)).alias("all"))
    own = cut(own.select("conv", F.transform("all", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("own")))
    base = own.where(F.col("conv") % BLOCK == 0).select(F.col("conv").alias("base"), F.slice("own", 1, LEAD - 1).alias("lead"))
    joined = own.withColumn("base", F.col("conv") - F.col("conv") % BLOCK).join(base, "base", "left")
    kept = (F.crc32(F.col("conv").cast("string")) % LEAD).cast("int")
    lead = F.slice(F.coalesce("lead", F.slice("own", 1, 0)), F.lit(1), kept)
    turns = F.concat(lead, F.slice("own", kept + 1, F.greatest(F.size("own") - kept, F.lit(0))))
    digests = F.array_join(F.transform("turns", lambda t: t["digest"]), "")
    return joined.select("conv", turns.alias("turns")).select("conv", F.unhex(digests).alias("key"), F.transform("turns", lambda t: t["words"]).alias("words"))


def trie(convs: DataFrame) -> DataFrame:
    """The nodes of conversations (conv, key, words), one row each."""
    spark = convs.sparkSession
    ship_package(spark)
    convs = cut(convs.withColumn("id", F.unhex(F.substring(F.sha2("key", 256), 1, 32))))
    total = convs.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    # More shards with more turns; with few, as many as there are tasks to use.
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_TURNS))

    copies = convs.select("id", "conv").repartition("id").sortWithinPartitions("id", "conv")
    copies = copies.mapInArrow(_copies, "id binary, copies bigint, conv bigint, ends string")
    distinct = convs.join(copies, ["id", "conv"]).drop("id").repartitionByRange(shards, "key")
    distinct = cut(distinct.withColumn("shard", F.spark_partition_id()))

    order = W.orderBy("shard")
    bounds = distinct.groupBy("shard").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    bounds = bounds.select("*", F.lag("last").over(order).alias("previous"), F.lead("first").over(order).alias("following"))
    # One row of three numbers per shard.
    meetings = cut(bounds.mapInArrow(_meetings, "shard int, before int, after int"))
    dealt = distinct.join(F.broadcast(meetings), "shard").repartition(shards, "shard").sortWithinPartitions("shard", "key")
    nodes = cut(dealt.mapInArrow(_shard_nodes, _NODE))

    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")]
    spine = nodes.where("id IS NOT NULL").groupBy("id", "depth", "parent_id").agg(F.min("conv").alias("conv"), *sums, F.max("ends").alias("ends"))
    spine = cut(spine)
    columns = ["conv", "depth", "n_convs", "n_children", "n_leaves", "saved", "ends"]
    below = nodes.where("id IS NULL AND parent_id IS NOT NULL").select("parent_id", *columns).unionByName(spine.where("parent_id IS NOT NULL").select("parent_id", *columns))
    below = below.join(spine.select(F.col("id").alias("parent_id"), F.col("conv").alias("parent_conv")), "parent_id").drop("parent_id")
    root = spine.where("parent_id IS NULL").select(*columns, F.lit(None).cast("long").alias("parent_conv"))
    return nodes.where("id IS NULL AND parent_id IS NULL").select(*columns, "parent_conv").unionByName(below).unionByName(root)


def op13_conversation_trie(spark, sf_dir: str) -> DataFrame:
    out = trie(rebuilt(table(spark, sf_dir, "conversations")))
    return out.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(EMPTY_SHA256)).alias("ends_sha256"),
    )


OP13_SQL = f"""
WITH crc AS (SELECT {CRC_TABLE_SQL} AS crc),
given AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS said FROM conversations WHERE conv_id IS NOT NULL),
hashed AS (SELECT c, turn, role, substr(sha256(octet_length(encode(role)) || ':' || role || said), 1, 32) AS digest, len(regexp_extract_all(said, '{WORDS}')) AS words FROM given),
own AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, digest) AS i FROM hashed),
convs AS (SELECT c, {crc32_sql("c::VARCHAR", "crc")} % 4 AS h FROM (SELECT DISTINCT c FROM given), crc),
parts AS (SELECT convs.c, 0 AS part, i, digest, words FROM convs JOIN own ON own.c = convs.c - convs.c % 20 AND i <= h
  UNION ALL SELECT convs.c, 1, i, digest, words FROM convs JOIN own ON own.c = convs.c AND i > h),
turns AS (SELECT c, row_number() OVER w AS d, string_agg(digest, '') OVER (w ROWS UNBOUNDED PRECEDING) AS path, words FROM parts WINDOW w AS (PARTITION BY c ORDER BY part, i)),
steps AS (SELECT * FROM turns UNION ALL SELECT c, 0, '', 0 FROM convs),
nodes AS (SELECT path, d, min(c) AS c, count(*) AS n, any_value(words) AS words FROM steps GROUP BY path, d),
children AS (SELECT left(path, length(path) - 32) AS path, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (path)),
sums AS (SELECT s.path, sum((f.n_children = 0)::INT) AS n_leaves, sum((f.n - 1) * f.words) AS saved FROM full_nodes f JOIN steps s ON s.c = f.c AND s.d <= f.d GROUP BY s.path),
lasts AS (SELECT arg_max(path, d) AS path, c FROM steps GROUP BY c),
ends AS (SELECT path, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends FROM lasts GROUP BY path)
SELECT f.c AS conv_id, f.d::BIGINT AS depth, p.c AS parent_conv_id, f.n::BIGINT AS n_convs, f.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves,
  saved::BIGINT AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM full_nodes f JOIN sums USING (path) LEFT JOIN ends USING (path) LEFT JOIN nodes p ON f.d > 0 AND p.path = left(f.path, length(f.path) - 32)
"""
