"""Byte-level BPE encoding and decoding with padded matrices.

A text is split by the tokenizer's pattern. The pieces of a stretch of text that are not known yet are sorted by length
into buckets and laid into matrices of token ids, one row per piece, padded at the right. Each round looks up the rank of
every neighbouring pair in a hash table, merges the leftmost pair of least rank in every row and closes the gap; rows with
nothing left to merge leave. A piece longer than LONG bytes has a matrix of its own, in which a round merges all
occurrences of the least pair at once, where no pair that comes up on the way has a lower rank: one by one, they would
merge in the same order, so ids do not change, but a long run of one letter takes a logarithmic number of rounds.

The vocabulary is one file of rank lines, read by the driver and broadcast; files over MOST_BYTES are refused. Texts stay
where they are: nothing is shuffled. A task holds a bounded stretch of text, its ids, and at most KEPT known pieces.

Defined results: a null text is empty; an empty text has no ids and decodes to no bytes; ids outside the vocabulary cannot
be decoded and raise; null ids decode to null; repeated rows give repeated results; other columns pass through, and a
column of the result's name is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewitness.llm.common import table, whole_text
from lakewitness.session import ship_package

# Largest vocabulary file that is broadcast; bytes of one piece from which it has a matrix of its own; cells of a matrix;
# characters of text, or ids, that a task turns at once; pieces it remembers.
MOST_BYTES, LONG, CELLS, STRETCH, KEPT = 64 << 20, 64, 1 << 18, 1 << 21, 200_000
NONE = np.int64(1) << 40
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Rank of the merge of two neighbouring tokens, by open addressing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.bits = max(4, int(2 * len(rank) + 1).bit_length() + 1)
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.values = np.full(1 << self.bits, NONE)
        key, rest = self._key(left, right), np.arange(len(rank))
        at = self._home(key)
        while len(rest):
            free = self.keys[at[rest]] == np.uint64(2**64 - 1)
            self.keys[at[rest[free]]] = key[rest[free]]
            won = free & (self.keys[at[rest]] == key[rest])
            self.values[at[rest[won]]] = rank[rest[won]]
            rest = rest[~won]
            at[rest] = (at[rest] + 1) & (len(self.keys) - 1)

    def _key(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)

    def _home(self, key: np.ndarray) -> np.ndarray:
        return ((key * _SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; NONE where the two do not merge. Padding (negative ids) never merges."""
        out = np.full(left.shape, NONE)
        rest = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        key = self._key(left.ravel()[rest], right.ravel()[rest])
        at = self._home(key)
        flat = out.ravel()
        while len(rest):
            there = self.keys[at]
            hit = there == key
            flat[rest[hit]] = self.values[at[hit]]
            go = ~hit & (there != np.uint64(2**64 - 1))
            rest, key, at = rest[go], key[go], (at[go] + 1) & (len(self.keys) - 1)
        return out


class Vocabulary:
    """Ids and ranks of a rank file, whose lines are a token in base 64 and its rank."""

    def __init__(self, lines: bytes, pattern: str):
        rows = [line.split() for line in lines.splitlines() if line]
        tokens = {base64.b64decode(t): int(r) for t, r in rows}
        self.pattern = regex.compile(pattern)
        self.first = np.full(256, -1, np.int64)
        for b in range(256):
            self.first[b] = tokens.get(bytes([b]), -1)
        pairs = [(tokens[t[:i]], tokens[t[i:]], r) for t, r in tokens.items() for i in range(1, len(t)) if t[:i] in tokens and t[i:] in tokens]
        self.pairs = PairTable(*np.array(pairs, np.int64).reshape(-1, 3).T)
        by_id = sorted((r, t) for t, r in tokens.items())
        self.size = by_id[-1][0] + 1 if by_id else 0
        self.lengths = np.full(self.size, -1, np.int64)
        self.lengths[[r for r, _ in by_id]] = [len(t) for _, t in by_id]
        self.starts = np.cumsum(np.maximum(self.lengths, 0)) - np.maximum(self.lengths, 0)
        self.bytes = np.frombuffer(b"".join(t for _, t in by_id), np.uint8)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(pieces)
        size = np.array([len(p) for p in pieces], np.int64)
        order = np.argsort(size, kind="stable")
        order = order[size[order] > 0]
        split = np.searchsorted(size[order], LONG, side="right")
        for k in order[split:]:
            out[k] = self._long(self.first[np.frombuffer(pieces[k], np.uint8)])
        a = 0
        while a < split:
            # Widths within a bucket differ by at most a quarter, so padding is bounded.
            widest = size[order[a]] + size[order[a]] // 4
            b = min(split, int(np.searchsorted(size[order], widest, side="right")), a + max(1, int(CELLS // widest)))
            rows = order[a:b]
            for k, ids in zip(rows, self._matrix([pieces[k] for k in rows], size[rows])):
                out[k] = ids
            a = b
        return out

    def _matrix(self, pieces: list[bytes], size: np.ndarray) -> list[np.ndarray]:
        width = int(size.max())
        m = np.full((len(pieces), width), -1, np.int64)
        m[np.arange(width) < size[:, None]] = self.first[np.frombuffer(b"".join(pieces), np.uint8)]
        n = size.copy()
        live = np.arange(len(pieces))
        ranks = self.pairs.ranks(m[:, :-1], m[:, 1:])
        done: list[np.ndarray] = [np.zeros(0, np.int64)] * len(pieces)
        while len(live):
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(live), np.int64)
            least = ranks[np.arange(len(live)), at] if ranks.shape[1] else np.full(len(live), NONE)
            over = least == NONE
            if over.any():
                for k in np.flatnonzero(over):
                    done[live[k]] = m[k, : n[k]].copy()
                keep = ~over
                live, m, ranks, n, at, least = live[keep], m[keep], ranks[keep], n[keep], at[keep], least[keep]
                if not len(live):
                    break
            rows = np.arange(len(live))
            m[rows, at] = least
            # Close the gap: every cell after the merged pair moves one to the left.
            shifted = np.arange(m.shape[1] - 1) > at[:, None]
            m[:, :-1] = np.where(shifted, m[:, 1:], m[:, :-1])
            n -= 1
            m[rows, n] = -1
            if ranks.shape[1] > 1:
                ranks[:, :-1] = np.where(shifted[:, :-1], ranks[:, 1:], ranks[:, :-1])
            ranks[rows, np.minimum(n, ranks.shape[1] - 1)] = NONE
            ranks[:, -1] = NONE
            right = n > at + 1
            ranks[rows[right], at[right]] = self.pairs.ranks(m[rows[right], at[right]], m[rows[right], at[right] + 1])
            ranks[rows[~right], np.minimum(at[~right], ranks.shape[1] - 1)] = NONE
            left = at > 0
            ranks[rows[left], at[left] - 1] = self.pairs.ranks(m[rows[left], at[left] - 1], m[rows[left], at[left]])
            width = int(n.max())
            m, ranks = m[:, :width], ranks[:, : max(width - 1, 0)]
        return done

    def _long(self, ids: np.ndarray) -> np.ndarray:
        """One long piece: the least pair wherever it occurs, if merging it one by one would do the same."""
        ranks = self.pairs.ranks(ids[:-1], ids[1:])
        while len(ids) > 1:
            at = np.flatnonzero(ranks == ranks.min())
            least = ranks[at[0]]
            if least == NONE:
                break
            # From the left, without overlaps: in a run of neighbouring places every second one counts.
            run = np.cumsum(np.append(True, np.diff(at) != 1)) - 1
            first = np.flatnonzero(np.append(True, np.diff(run) != 0))
            at = at[(np.arange(len(at)) - first[run]) % 2 == 0]
            merged = self._merge(ids, ranks, at, least)
            # A pair of a merged token and its neighbour, also of one that merges later, must not come first.
            heads = np.unique(ids[at])
            if len(at) > 1 and min(merged[2], self.pairs.ranks(np.full(len(heads), least), heads).min()) < least:
                merged = self._merge(ids, ranks, at[:1], least)
            ids, ranks = merged[:2]
        return ids

    def _merge(self, ids: np.ndarray, ranks: np.ndarray, at: np.ndarray, token: int) -> tuple[np.ndarray, np.ndarray, int]:
        keep = np.ones(len(ids), bool)
        keep[at + 1] = False
        out = ids.copy()
        out[at] = token
        out = out[keep]
        ranks = np.append(ranks, NONE)[keep][:-1]
        place = at - np.arange(len(at))
        changed = np.unique(np.concatenate([place - 1, place]))
        changed = changed[(changed >= 0) & (changed < len(ranks))]
        ranks[changed] = self.pairs.ranks(out[changed], out[changed + 1])
        return out, ranks, int(ranks[changed].min()) if len(changed) else int(NONE)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All bytes of the ids in a row, and the number of bytes of each id."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size or (self.lengths[ids] < 0).any()):
            raise ValueError("an id is not in the vocabulary")
        n = self.lengths[ids]
        ends = np.cumsum(n)
        index = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[ids] - (ends - n), n)
        return self.bytes[index], n


class Encoder:
    """Ids of texts, with a memory of pieces met before."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.offsets = np.zeros(1, np.int64)

    def _learn(self, pieces: list[str]) -> None:
        new = self.v.encode_pieces([p.encode("utf-8") for p in pieces])
        for p in pieces:
            self.place[p] = len(self.place)
        self.ids = np.concatenate([self.ids, *new]).astype(np.int32)
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum([len(x) for x in new])])

    def stretch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of ids of each text."""
        if len(self.place) > KEPT:
            self._forget()
        found = [self.v.pattern.findall(t) for t in texts]
        pieces = [p for f in found for p in f]
        fresh = [p for p in dict.fromkeys(pieces) if p not in self.place]
        if fresh:
            self._learn(fresh)
        at = np.fromiter(map(self.place.__getitem__, pieces), np.int64, len(pieces))
        n = self.offsets[at + 1] - self.offsets[at]
        ends = np.cumsum(n)
        ids = self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.offsets[at] - (ends - n), n)]
        upto = np.append(0, ends)[np.cumsum([0, *map(len, found)])]
        return ids, np.diff(upto)


def _stretches(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about STRETCH together; a larger row is a range of its own."""
    start, held = 0, 0
    for k, s in enumerate(sizes):
        if held and held + s > STRETCH:
            yield start, k
            start, held = k, 0
        held += s
    if start < len(sizes):
        yield start, len(sizes)


def _vocabulary(df: DataFrame, path: str, pattern: str):
    """Builds the vocabulary in a task, once per Python worker's run; the file's bytes are broadcast."""
    with open(path, "rb") as f:
        lines = f.read(MOST_BYTES + 1)
    if len(lines) > MOST_BYTES:
        raise ValueError(f"the vocabulary has more than {MOST_BYTES} bytes")
    ship_package(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(lines)
    return lambda: Vocabulary(sent.value, pattern)


def _fields(df: DataFrame, *without: str) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema if f.name.lower() not in without)


def _others(batch: pa.RecordBatch, *without: str) -> pa.RecordBatch:
    return batch.drop_columns([n for n in batch.schema.names if n.lower() in without])


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Every row with ``ids``, the token ids of its whole ``text``, in place of that column."""
    vocabulary = _vocabulary(df, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary())
        for batch in batches:
            texts, others = batch.column(text), _others(batch, text.lower(), ids.lower())
            for a, b in _stretches([len(t) if (t := x.as_py()) else 0 for x in texts]):
                flat, n = encoder.stretch([x.as_py() or "" for x in texts.slice(a, b - a)])
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([*others.slice(a, b - a).columns, lists], [*others.schema.names, ids])

    return df.mapInArrow(run, f"{_fields(df, text.lower(), ids.lower())}`{ids}` array<int>")


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Every row with ``decoded``, the bytes of its ``ids``."""
    vocabulary = _vocabulary(df, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary()
        for batch in batches:
            others = _others(batch, decoded.lower())
            lists = batch.column(ids)
            for a, b in _stretches([8 * len(x) if x.is_valid else 0 for x in lists]):
                part = lists.slice(a, b - a)
                data, n = v.decode(part.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
                size = np.append(0, np.cumsum(n))[np.append(0, np.cumsum([len(x) if x.is_valid else 0 for x in part]))]
                data = data.tobytes()
                out = [data[s:e] if x.is_valid else None for x, s, e in zip(part, size, size[1:])]
                yield pa.RecordBatch.from_arrays([*others.slice(a, b - a).columns, pa.array(out, pa.binary())], [*others.schema.names, decoded])

    return df.mapInArrow(run, f"{_fields(df, decoded.lower())}`{decoded}` binary")


def op11_bpe_matrices(spark, sf_dir: str) -> DataFrame:
    """Ids of every document by the 50k rank file, and the text they decode to, as digests."""
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", whole_text().alias("text"))
    out = decode(encode(docs, *vocabulary), *vocabulary)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
