"""Removal of repeated passages by distributed prefix doubling over sampled places.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else. Ranks of prefixes are 64-bit
fingerprints, so ranking is grouping and no global order has to be kept; places whose rank is unique leave at once,
and the others are ranked again at a longer offset:

1. Rank at GRAM bytes, at sampled places: of the LENGTH - GRAM + 1 grams inside every LENGTH-byte string the least is its
   anchor. Equal strings have equal anchors, so a start can only repeat if its anchor's gram does. Consecutive
   starts with one anchor form a run, about one for 76 bytes.
2. Rank of the whole stretch that the strings of a run cover: where it repeats, all its starts do.
3. In the other runs with a repeated gram, blocks of BLOCK starts, counted from the anchor, are ranked by what all
   their strings share (no repeat: none of them repeats) and by what they cover together (a repeat: all do).
4. Rank at LENGTH bytes, start by start, only in blocks that are still open, and in known ones that share
   their middle with an open one. Runs whose gram occurs more than once in a run of its group skip step 3.

Only fingerprints and places are shuffled; texts move once, and only those with repeated grams are kept.
Work per document is one task's, memory about 60 bytes for each byte of the longest text.

Defined results: a null text has no bytes and the digest of the empty string; texts under LENGTH bytes lose nothing;
equal texts of LENGTH bytes or more lose everything; repeated rows count as copies; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewitness.llm.common import settled, table, text_digest, whole_text
from lakewitness.llm.hashing import C, Stretches, mix, signed
from lakewitness.session import ship_package

LENGTH, GRAM = 200, 50
GRAMS = LENGTH - GRAM + 1
# Of a run: surely repeated; so, but its strings are compared with other runs'; to be found out.
SURE, SHARED, OPEN = 1, 2, 3
# Added to the status where the gram occurs more than once in a run of its group.
LOOPS, STATUS_BITS = 4, 3
BLOCK = 8


def _least(h: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every ``size`` consecutive values, by doubling."""
    have = 1
    while 2 * have <= size:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    rest = size - have
    return np.minimum(h[:-rest], h[rest:]) if rest else h


class Runs:
    """The runs of starts with one anchor gram in a text."""

    def __init__(self, data: bytes):
        self.n = len(data)
        self.places = max(0, self.n - LENGTH + 1)
        if not self.places:
            self.starts = self.ends = np.zeros(0, np.int64)
            self.gram = np.zeros(0, np.uint64)
            return
        self.stretches = Stretches(data)
        self.h = self.stretches.windows(GRAM)
        least = _least(self.h, GRAMS)
        self.starts = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
        self.ends = np.append(self.starts[1:], self.places)
        self.gram = least[self.starts]

    def stretch(self) -> np.ndarray:
        return self.stretches.hashes(self.starts, self.ends + LENGTH - 1)

    def weight(self) -> np.ndarray:
        """2 where the gram occurs more than once within the run's own bytes, else 1."""
        views = sliding_window_view(self.h, GRAMS)
        out = np.ones(len(self.starts), np.int32)
        for a in range(0, len(self.starts), 4096):
            s, e, g = self.starts[a : a + 4096], self.ends[a : a + 4096], self.gram[a : a + 4096, None]
            first, last = views[s] == g, views[e - 1] == g
            again = (first.sum(axis=1) > 1) | (last.sum(axis=1) > 1) | (s + first.argmax(axis=1) != e - 1 + last.argmax(axis=1))
            out[a : a + 4096][again | (e - s > GRAMS)] = 2
        return out

    def blocks(self, run: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Blocks of the given runs, none of which loops: run, first start, rank of the shared middle, rank of the whole, is whole."""
        views = sliding_window_view(self.h, GRAMS)
        anchor = np.zeros(len(run), np.int64)
        for a in range(0, len(run), 4096):
            s = self.starts[run[a : a + 4096]]
            anchor[a : a + 4096] = s + (views[s] == self.gram[run[a : a + 4096], None]).argmax(axis=1)
        low = (self.starts[run] - anchor) // BLOCK
        size = (self.ends[run] - 1 - anchor) // BLOCK - low + 1
        owner = np.repeat(np.arange(len(run)), size)
        first = anchor[owner] + BLOCK * (low[owner] + np.arange(len(owner)) - (np.cumsum(size) - size)[owner])
        gram = self.gram[run[owner]]
        middle = mix(self.stretches.hashes(first + BLOCK - 1, first + LENGTH) + gram * C[10])
        fits = (first >= 0) & (first + BLOCK - 1 < self.places)
        at = np.where(fits, first, 0)
        whole = mix(self.stretches.hashes(at, np.where(fits, at + BLOCK - 1 + LENGTH, 0)) + gram * C[11])
        return run[owner], first, middle, whole, fits

    def numbered(self, run: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Blocks of the given runs: run, first start, number of the middle, number of the whole (-1: not whole); all ranks and their numbers.

        A block that two runs with one gram reach has one number, one at the border of runs with different grams one for each.
        """
        owner, first, middle, whole, fits = self.blocks(run)
        place = np.concatenate([first * 2, first[fits] * 2 + 1])
        ranks = np.concatenate([middle, whole[fits]])
        order = np.lexsort((ranks, place))
        new = np.append(True, (np.diff(place[order]) != 0) | (np.diff(ranks[order]) != 0))[: len(order)]
        number = np.zeros(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        of_whole = np.full(len(first), -1, np.int64)
        of_whole[fits] = number[len(first) :]
        return owner, first, number[: len(first)], of_whole, ranks, number

    def judged(self, flags: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Surely repeated starts (a mask); ranks to count twice; open ranks and their starts."""
        run, status, loops = flags >> STATUS_BITS, flags & 3, (flags & LOOPS) > 0
        sure, shared = self._spread(self.starts[run], self.ends[run], status != OPEN), self._spread(self.starts[run], self.ends[run], loops & (status == SHARED))
        open_ = self._spread(self.starts[run], self.ends[run], loops & (status == OPEN))
        plain = ~loops & (status != SURE)
        state = np.zeros(len(self.starts), np.int64)
        state[run] = status
        owner, first, of_middle, of_whole, _, _ = self.numbered(run[plain])
        known = dict(zip(codes.tolist(), counts.tolist()))
        middle = np.array([known.get(c, 1) for c in of_middle.tolist()], np.int64)
        whole = np.array([known.get(c, 0) for c in of_whole.tolist()], np.int64)
        low, high = np.maximum(first, self.starts[owner]), np.minimum(first + BLOCK, self.ends[owner])
        sure |= self._spread(low, high, whole > 1)
        settled = (state[owner] == SHARED) | (whole > 1)
        shared |= self._spread(low, high, settled & (middle > whole))
        open_ |= self._spread(low, high, ~settled & (middle > 1))
        at = np.flatnonzero(shared | open_)
        ranks = self.stretches.hashes(at, at + LENGTH)
        _, where, inverse, n = np.unique(ranks, return_index=True, return_inverse=True, return_counts=True)
        twice = n[inverse] > 1
        once = np.zeros(len(at), bool)
        once[where[n > 1]] = True
        sure[at[twice]] = True
        counted = once | (shared[at] & ~twice)
        asked = open_[at] & ~sure[at]
        return sure, ranks[counted], ranks[asked], at[asked]

    def _spread(self, low: np.ndarray, high: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """Mask of the starts within the chosen ranges."""
        edge = np.zeros(self.places + 1, np.int32)
        np.add.at(edge, low[chosen], 1)
        np.add.at(edge, high[chosen], -1)
        return np.cumsum(edge[:-1]) > 0


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, run, gram, stretch, weight for every run of every text."""
    for batch in batches:
        node = batch.column("node")
        parts, counts, held = [], [], 0
        done = 0
        texts = batch.column("data")
        for k in range(len(texts)):
            r = Runs(texts[k].as_py())
            counts.append(len(r.starts))
            if len(r.starts):
                parts.append((np.arange(len(r.starts), dtype=np.int32), signed(r.gram), signed(r.stretch()), r.weight()))
            held += len(r.starts)
            if held and (held > 200_000 or k == len(texts) - 1):
                index = np.repeat(np.arange(done, k + 1), counts)
                columns = [pa.array(np.concatenate(c)) for c in zip(*parts)]
                yield pa.RecordBatch.from_arrays([node.take(pa.array(index)), *columns], ["node", "run", "gram", "stretch", "weight"])
                parts, counts, held, done = [], [], 0, k + 1


def _batch(node: pa.Array, ranks: np.ndarray, weight: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    nodes = node.take(pa.array(np.zeros(len(ranks), np.int64)))
    return pa.RecordBatch.from_arrays([pa.array(signed(ranks)), pa.array(weight.astype(np.int32)), nodes, pa.array(place.astype(np.int32))], ["rank", "weight", "node", "place"])


def _flags(batch: pa.RecordBatch, k: int) -> np.ndarray:
    return batch.column("flags")[k].values.to_numpy()


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rank, weight, node, place (number of the middle or whole) of the blocks to look at."""
    for batch in batches:
        for k in range(batch.num_rows):
            flags = _flags(batch, k)
            flags = flags[((flags & LOOPS) == 0) & ((flags & 3) != SURE)]
            if not len(flags):
                continue
            r = Runs(batch.column("data")[k].as_py())
            owner, _, _, of_whole, ranks, number = r.numbered(flags >> STATUS_BITS)
            state = np.zeros(len(r.starts), np.int64)
            state[flags >> STATUS_BITS] = flags & 3
            weight = np.where(state[np.concatenate([owner, owner[of_whole >= 0]])] == SHARED, 2, 1)
            order = np.lexsort((-weight, number))
            place, ranks, weight = number[order], ranks[order], weight[order]
            new = np.append(True, place[1:] != place[:-1])
            yield _batch(batch.column("node").slice(k, 1), ranks[new], weight[new], place[new])


def _known(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of a text's blocks."""
    found = batch.column("blocks")[k]
    if not found.is_valid:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return found.values.field("place").to_numpy().astype(np.int64), found.values.field("all").to_numpy()


def _start_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rank, weight, node, place (-1: only counts) of the starts still open and of those they are compared with.

    A text's surely repeated starts are one row more: their ranges as first start and end, in turn; its rank is null.
    """
    for batch in batches:
        for k in range(batch.num_rows):
            r = Runs(batch.column("data")[k].as_py())
            sure, counted, asked, at = r.judged(_flags(batch, k), *_known(batch, k))
            node = batch.column("node").slice(k, 1)
            if len(counted) + len(asked):
                weight = np.repeat([2, 1], [len(counted), len(asked)])
                ranks = _batch(node, np.concatenate([counted, asked]), weight, np.concatenate([np.full(len(counted), -1), at]))
                yield ranks.append_column("sure", pa.nulls(len(ranks), pa.list_(pa.int32())))
            if sure.any():
                edges = np.flatnonzero(np.diff(np.concatenate([[False], sure, [False]]).astype(np.int8)))
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), node, pa.nulls(1, pa.int32()), pa.array([edges], pa.list_(pa.int32()))],
                    ["rank", "weight", "node", "place", "sure"],
                )


def removed(data: bytes, sure: np.ndarray, places: np.ndarray) -> tuple[int, int, str]:
    """Removed bytes, removed spans and the digest of the rest; ``sure``: ranges of repeated starts, ``places``: single ones."""
    edge = np.zeros(len(data) + 1, np.int32)
    edge[sure[::2]] += 1
    np.add.at(edge, sure[1::2] + (LENGTH - 1), -1)
    np.add.at(edge, places, 1)
    np.add.at(edge, places + LENGTH, -1)
    gone = np.cumsum(edge[:-1]) > 0
    rest = np.frombuffer(data, np.uint8)[~gone]
    return int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum()), hashlib.sha256(rest.tobytes()).hexdigest()


def _numbers(batch: pa.RecordBatch, name: str, k: int) -> np.ndarray:
    """A list of whole numbers of a row; null counts as empty."""
    found = batch.column(name)[k]
    return found.values.to_numpy().astype(np.int64) if found.is_valid else np.zeros(0, np.int64)


def _removed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [removed(batch.column("data")[k].as_py(), _numbers(batch, "sure", k), _numbers(batch, "places", k)) for k in range(batch.num_rows)]
        if out:
            n, spans, digest = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array(n, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest)], ["node", "n_removed", "n_spans", "kept_sha256"]
            )


def flagged_runs(rows: DataFrame) -> DataFrame:
    """node, flags: run << STATUS_BITS | status for every run that may hold repeated strings."""
    runs = rows.select("node", F.col("text").cast("binary").alias("data")).mapInArrow(_run_rows, "node binary, run int, gram bigint, stretch bigint, weight int")
    again = runs.groupBy("gram").agg(F.sum("weight").alias("all"), F.max("weight").alias("most")).where(F.col("all") > 1).select("gram", "most")
    runs = settled(runs.drop("weight").join(again, "gram"))
    stretches = runs.groupBy("gram", "stretch").agg(F.count("*").alias("n"), F.min(F.struct("node", "run")).alias("first"))
    mixed = stretches.groupBy("gram").agg(F.max(F.col("n") == 1).alias("mixed"))
    judged = stretches.join(mixed, "gram").select("gram", "stretch", "n", "mixed", "first")
    first = F.col("first") == F.struct("node", "run")
    status = F.when(F.col("n") == 1, OPEN).when(F.col("mixed") & first, SHARED).otherwise(SURE)
    flag = F.shiftleft(F.col("run").cast("long"), STATUS_BITS) + status + F.when(F.col("most") > 1, LOOPS).otherwise(0)
    return runs.join(judged, ["gram", "stretch"]).select("node", flag.alias("flag")).groupBy("node").agg(F.collect_set("flag").alias("flags"))


RANKS = "rank bigint, weight int, node binary, place int"


def _ranked(ranks: DataFrame) -> DataFrame:
    """node, place, all: how often each place's rank occurs, where it does more than once."""
    again = ranks.groupBy("rank").agg(F.sum("weight").alias("all")).where(F.col("all") > 1)
    return ranks.where("place >= 0").select("rank", "node", "place").join(again, "rank").select("node", "place", "all")


def repeated_parts(rows: DataFrame) -> DataFrame:
    """node, n_removed, n_spans, kept_sha256 of every different text that may lose something. rows: doc_id, node, text."""
    ship_package(rows.sparkSession)
    flags = settled(flagged_runs(rows))
    first = rows.select("node", "doc_id").groupBy("node").agg(F.min("doc_id").alias("_doc"))
    wanted = first.join(flags, "node").withColumnRenamed("node", "_node")
    held = rows.join(wanted, (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("_doc")))
    # of equal rows one
    one = held.groupBy("node").agg(F.first(F.struct(F.col("text").cast("binary").alias("data"), "flags")).alias("x"))
    texts = settled(one.select("node", "x.*"))
    blocks = _ranked(settled(texts.mapInArrow(_block_rows, RANKS))).groupBy("node").agg(F.collect_set(F.struct("place", "all")).alias("blocks"))
    blocks = settled(blocks)
    judged = texts.join(blocks, "node", "left").select("node", "data", "flags", "blocks")
    starts = settled(judged.mapInArrow(_start_rows, f"{RANKS}, sure array<int>"))
    sure = starts.where("rank IS NULL").select("node", "sure")
    places = settled(_ranked(starts.where("rank IS NOT NULL")).groupBy("node").agg(F.collect_set("place").alias("places")))
    whole = texts.join(sure, "node", "left").join(places, "node", "left").select("node", "data", "sure", "places")
    return whole.mapInArrow(_removed_rows, "node binary, n_removed bigint, n_spans bigint, kept_sha256 string")


def op10_prefix_doubling(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = whole_text()
    parts = settled(repeated_parts(docs.select("doc_id", text_digest(text).alias("node"), text.alias("text"))))
    own = docs.select("doc_id", text_digest(text).alias("node"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("digest"))
    return own.join(parts, "node", "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"),
        F.coalesce("kept_sha256", "digest").alias("kept_sha256"),
    )
