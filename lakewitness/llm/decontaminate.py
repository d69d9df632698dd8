"""Benchmark decontamination by templates.

Words are reduced to templates: numbers, units and names (capitalised words inside a sentence) become typed
placeholders, other words lose case and outer punctuation; tokens without a letter or digit vanish. Windows of WINDOW
words are hashed and joined with the windows of the benchmark: each by its values, so that verbatim passages match whatever
their case and punctuation, and by its templates, one with capitalised words that open a sentence as words and one with
them as names. A window in which placeholders outnumber the words says too little as a template and is hashed by value only, as
is one without placeholders. Tasks pass on the windows whose two bits are set in a table of the benchmark's windows; the table's
size is fixed, and with ever larger benchmarks it lets more windows through to the join, which decides.
Along one alignment of a document with an
item, the same value of the item must always stand for the same value of the document: then the match is a
verbatim or re-parameterised question; otherwise only its verbatim windows count. In items under COVER words, an opening of the
item may stand for another opening only if both are the same word ("What is the capital" is no "Paris is the capital"). A document is contaminated if consistent windows cover COVER words of an item
(all words of a shorter one).

Defined results: a null text has no words; scripts without spaces count by character; an item with fewer than SHORTEST words matches
where all its tokens, those without letter or digit too, follow each other with the same values, never by template, and one of
fewer than ALONE tokens only where they are a line or sentence of their own; items of SHORTEST to WINDOW words match as a whole; null items are empty; equal items and
repeated rows are judged one by one; an empty benchmark contaminates nothing; an empty table gives an empty result;
other columns pass through.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewitness.llm.common import packed, table, text_digest, whole_text
from lakewitness.llm.hashing import C, mix
from lakewitness.session import cut, ship_package

WINDOW, COVER, SHORTEST, ALONE = 8, 13, 5, 3
# Bits of the table in which tasks look up windows before the join: 8 MB, whatever the size of the benchmark.
TABLE_BITS = 26
# Words a task remembers; it forgets all and starts anew beyond.
CACHED_WORDS = 500_000
# Rows a task holds before it passes them on.
HELD_ROWS = 20_000
UNITS = frozenset(
    "% ° $ € £ km m cm mm mi mile miles ft feet inch inches yard yards kg g mg lb lbs oz ton tons l ml liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hour hours day days week weeks month months year years hz khz mhz ghz w kw v a c f k "
    "dollar dollars euro euros cent cents pound pounds percent degree degrees mph kph km/h m/s kb mb gb tb".split()
)
LITERAL, NUMBER, UNIT, NAME = range(4)
# Before the value of a slot: a capitalised word that opens a sentence, which may be a name or not.
OPENING = "^"
_OUTER = string.punctuation + "\u00ab\u00bb\u2018\u2019\u201c\u201d\u201e\u2026\u2013\u2014\u00bf\u00a1\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f\u300a\u300b\u300c\u300d\uff08\uff09"
# Characters of scripts written without spaces, and their punctuation.
_UNSPACED = re.compile("([\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3001-\u30ff\u3100-\u312f\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff01-\uff0f\uff1a-\uff1f\uff66-\uff9f\U00020000-\U0003ffff])")
_QUOTES = "\"')]\u00bb\u2019\u201d"


class _Words(dict):
    """word -> (hash of its plain form without the low four bits) | capitalised << 3 | ends a sentence << 2 | kind.

    A word counts as capitalised if it has small letters too; text in capitals throughout holds no names.
    """

    def __missing__(self, word: str) -> int:
        lower = word.lower()
        plain = lower if lower in UNITS else lower.strip(_OUTER)
        code = 4 if word.rstrip(_QUOTES)[-1:] in (".", "!", "?", ":", "\u3002", "\uff01", "\uff1f", "\uff1a") else 0
        if plain:
            kind = UNIT if plain in UNITS else LITERAL if plain.isalpha() or not any(c.isdigit() for c in plain) else NUMBER
            name = word.strip(_OUTER)[:1].isupper() and not word.isupper()
            value = int.from_bytes(blake2b(plain.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
            code |= (value & 0xFFFFFFFFFFFFFFF0 or 16) | (name << 3) | kind
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = code
        return code


_words = _Words()


def _tokens(text: str) -> list[str]:
    return (text if text.isascii() else _UNSPACED.sub(r" \1 ", text)).split()


def templated(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per word with a letter or digit: its place among all tokens, kind, value hash, whether it is a capitalised word that opens a sentence."""
    tokens = _tokens(text)
    codes = np.fromiter(map(_words.__getitem__, tokens), np.uint64, len(tokens))
    ends = (codes & np.uint64(4)) > 0
    begins = np.append(True, ends[:-1])[: len(tokens)]
    value = codes & np.uint64(0xFFFFFFFFFFFFFFF0)
    kind = (codes & np.uint64(3)).astype(np.int64)
    capital = (kind == LITERAL) & ((codes & np.uint64(8)) > 0)
    kind[capital & ~begins] = NAME
    place = np.flatnonzero(value)
    return place, kind[place], value[place], (capital & begins)[place]


def _hashed(words: np.ndarray, size: int, salt: int) -> np.ndarray:
    n = len(words) - size + 1
    out = np.full(n, np.uint64(salt))
    for j in range(size):
        out += words[j : j + n] * C[j]
    return mix(out)


def windows(kind: np.ndarray, value: np.ndarray, opening: np.ndarray, size: int) -> list[tuple[np.ndarray | None, np.ndarray, np.ndarray]]:
    """Windows of ``size`` words: the kinds they were made with (None: by value), their places, their hashes."""
    if len(kind) < size:
        return []
    out = [(None, np.arange(len(kind) - size + 1), _hashed(value, size, size + 100))]
    opened = np.cumsum(np.append(0, opening))
    for kinds, every in ((kind, True), (np.where(opening, NAME, kind), False)):
        slots = np.cumsum(np.append(0, kinds != LITERAL))
        held = slots[size:] - slots[:-size]
        fits = (held > 0) & (2 * held <= size)
        if not every:
            fits &= opened[size:] > opened[:-size]
        at = np.flatnonzero(fits)
        if len(at):
            out.append((kinds, at, _hashed(np.where(kinds == LITERAL, value, kinds.astype(np.uint64)), size, size)[at]))
    return out


def _slot(token: str, opening: bool) -> str:
    lower = token.lower()
    return OPENING * bool(opening) + (lower if lower in UNITS else lower.strip(_OUTER))


def _sequence_hashes(tokens: list[str], size: int) -> np.ndarray:
    """Hash of every ``size`` tokens in a row, by value; a token without letter or digit stands for itself."""
    def value(token: str) -> int:
        return _words[token] & 0xFFFFFFFFFFFFFFF0 or int.from_bytes(blake2b(token.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")

    n = len(tokens) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    values = np.fromiter(map(value, tokens), np.uint64, len(tokens))
    out = np.full(n, np.uint64(size + 1000))
    for j in range(size):
        out = mix(out * C[0] + values[j : j + n])
    return out


def _alone(text: str, tokens: list[str], size: int) -> np.ndarray:
    """Whether the ``size`` tokens at every place begin and end with a line or sentence."""
    edge = np.append(True, [bool(_words[t] & 4) for t in tokens])
    edge[np.cumsum([len(_tokens(line)) for line in text.splitlines()])] = True
    edge[-1] = True
    return edge[: len(edge) - size] & edge[size:]


class WindowTable:
    """Bits of the window hashes of a benchmark, two for each."""

    def __init__(self, parts: list[tuple[int, bytes]], width: int = TABLE_BITS):
        self.width, self.bits = width, np.zeros(1 << width >> 3, np.uint8)
        for number, part in parts:
            self.bits[number * len(part) : (number + 1) * len(part)] = np.frombuffer(part, np.uint8)

    def may_have(self, found: np.ndarray) -> np.ndarray:
        mask = np.uint64((1 << self.width) - 1)
        out = np.ones(len(found), bool)
        for place in (found & mask, (found >> np.uint64(self.width)) & mask):
            out &= (self.bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0
        return out


def window_table(windows_: DataFrame) -> WindowTable:
    """The table of the ``window`` column: bitmaps of fixed size made by Spark, 8 MB in all."""
    place = lambda shift: F.shiftrightunsigned("window", shift).bitwiseAND(F.lit((1 << TABLE_BITS) - 1)) + 1
    places = windows_.select(F.explode(F.array(place(0), place(TABLE_BITS))).alias("p"))
    parts = places.groupBy(F.bitmap_bucket_number("p").alias("number")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("part"))
    return WindowTable([(r.number - 1, bytes(r.part)) for r in parts.collect()])


def _sequence_rows(text: str, sizes: list[int], held: WindowTable | None) -> Iterator[tuple]:
    """Rows of short items' sequences; their sizes are below zero."""
    tokens = _tokens(text) if sizes else []
    for size in sizes:
        found = _sequence_hashes(tokens, -size)
        fits = np.ones(len(found), bool) if held is None else held.may_have(found)
        if -size < ALONE and fits.any():
            fits &= _alone(text, tokens, -size)
        for p in np.flatnonzero(fits).tolist():
            yield int(found[p].astype(np.int64)), size, p, True, []


def _rows(text: str, sizes: list[int], held: WindowTable | None) -> Iterator[tuple]:
    place, kind, value, opening = templated(text)
    tokens = None
    for size in sizes:
        for kinds, at, found in windows(kind, value, opening, size):
            if held is not None:
                own = held.may_have(found)
                at, found = at[own], found[own]
            by_value, kinds = kinds is None, np.where(opening, NAME, kind) if kinds is None else kinds
            for p, h in zip(at.tolist(), found.astype(np.int64).tolist()):
                tokens = tokens or _tokens(text)
                slots = [_slot(tokens[place[p + j]], opening[p + j]) for j in range(size) if kinds[p + j] != LITERAL]
                yield h, size, p, by_value, slots


_WINDOW_ARROW = pa.schema([("window", pa.int64()), ("size", pa.int32()), ("at", pa.int32()), ("by_value", pa.bool_()), ("slots", pa.list_(pa.string()))])


def window_rows(df: DataFrame, key: str, sizes: list[int] | None, held: WindowTable | None = None) -> DataFrame:
    """key, window, size, at, by_value, slots: windows of the ``text`` column, of the given sizes, or of the size an item needs.

    ``held`` leaves out windows that the benchmark surely does not have.
    """
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(key), batch.column("text")
            at, rows = [], []
            for k in range(batch.num_rows):
                text = texts[k].as_py()
                own = sizes
                if own is None:
                    n = len(templated(text)[0])
                    own = [min(n, WINDOW)] if n >= SHORTEST else [-len(_tokens(text))] if n else []
                for make, some in ((_rows, [s for s in own if s > 0]), (_sequence_rows, [s for s in own if s < 0])):
                    for row in make(text, some, held):
                        at.append(k)
                        rows.append(row)
                        if len(rows) >= HELD_ROWS:
                            yield _batch(keys, at, rows)
                            at, rows = [], []
            if rows:
                yield _batch(keys, at, rows)

    def _batch(keys: pa.Array, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), _WINDOW_ARROW)]
        return pa.RecordBatch.from_arrays([keys.take(pa.array(at)), *columns], [key, *_WINDOW_ARROW.names])

    given = df.select(key, "text")
    fields = ", window bigint, size int, at int, by_value boolean, slots array<string>"
    return given.mapInArrow(run, f"`{key}` {dict(given.dtypes)[key]}{fields}")


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_key, ids, covered, reworded: consistent alignments that cover enough of an item. docs: doc_key, text.

    Items of one text are one item with several ids.
    """
    texts = benchmark.select("item_id", text_digest(whole_text()).alias("item"), whole_text().alias("text"))
    items = cut(texts.groupBy("item").agg(F.min("text").alias("text"), F.sort_array(F.collect_set("item_id")).alias("ids")))
    wanted = cut(window_rows(items, "item", None))
    sizes = sorted(r[0] for r in wanted.select("size").distinct().collect())
    nothing = "doc_key struct<doc_id:bigint,d:binary>, ids array<bigint>, covered int, reworded boolean"
    if not sizes:
        return docs.sparkSession.createDataFrame([], nothing)
    found = window_rows(docs, "doc_key", sizes, window_table(wanted))
    length = wanted.groupBy("item").agg((F.max("at") + F.max(F.abs("size"))).alias("length"))
    right = wanted.join(length, "item").select("item", "window", "size", "length", "by_value", F.col("at").alias("item_at"), F.col("slots").alias("item_slots"))
    # windows equal by value have the item's values, even where the two texts open sentences at other places
    both = found.drop("by_value").join(right, ["window", "size"]).withColumn("slots", F.when(F.col("by_value"), F.col("item_slots")).otherwise(F.col("slots")))
    unlike = F.exists(F.arrays_zip(F.col("item_slots").alias("i"), F.col("slots").alias("d")), lambda v: v["i"].startswith(OPENING) & v["d"].startswith(OPENING) & (v["i"] != v["d"]))
    plain = lambda c: F.transform(c, lambda v: F.when(v.startswith(OPENING), F.substring(v, 2, F.length(v))).otherwise(v))
    pairs = both.where((F.size("slots") == F.size("item_slots")) & ~((F.col("length") < COVER) & unlike)).withColumns({"slots": plain(F.col("slots")), "item_slots": plain(F.col("item_slots"))})
    own_words = F.sequence(F.col("item_at"), F.col("item_at") + F.abs("size") - 1)
    one = pairs.groupBy("doc_key", "item", "length", (F.col("at") - F.col("item_at")).alias("shift")).agg(
        F.array_distinct(F.flatten(F.collect_set(own_words))).alias("words"),
        F.array_distinct(F.flatten(F.collect_set(F.when(F.col("slots") == F.col("item_slots"), own_words)))).alias("verbatim"),
        F.array_distinct(F.flatten(F.collect_set(F.arrays_zip(F.col("item_slots").alias("i"), F.col("slots").alias("d"))))).alias("values"),
    )
    consistent = F.size("values") == F.size(F.array_distinct(F.transform("values", lambda v: v["i"])))
    # where values contradict each other, only what is verbatim counts
    covered = F.when(consistent, F.size("words")).otherwise(F.size("verbatim"))
    reworded = consistent & F.exists("values", lambda v: v["i"] != v["d"])
    judged = one.select("doc_key", "item", "length", covered.alias("covered"), reworded.alias("reworded"))
    enough = judged.where(F.col("covered") >= F.least(F.lit(COVER), F.col("length")))
    return enough.join(items.select("item", "ids"), "item").select("doc_key", "ids", "covered", "reworded")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct(F.col("doc_id"), text_digest(whole_text()).alias("d")).alias("doc_key"), whole_text().alias("text"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_key, items, covered, reworded per contaminated document."""
    return matches(_keyed(docs), benchmark).groupBy("doc_key").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("items"), F.max("covered").cast("long").alias("covered"), F.max("reworded").alias("reworded")
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without benchmark passages, with their own columns."""
    bad = cut(contaminated(docs, benchmark).select(F.col("doc_key.doc_id").alias("_id"), F.col("doc_key.d").alias("_d")))
    rows = packed(docs).withColumn("_digest", text_digest(whole_text("_row.text")))
    return rows.join(bad, (F.col("_digest") == F.col("_d")) & F.col("_row.doc_id").eqNullSafe(F.col("_id")), "left_anti").select("_row.*")


def op7_template_windows(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    bad = cut(contaminated(docs, table(spark, sf_dir, "benchmark"))).alias("b")
    rows = docs.select("doc_id", text_digest(whole_text()).alias("d")).alias("r")
    same = (F.col("r.d") == F.col("b.doc_key.d")) & F.col("r.doc_id").eqNullSafe(F.col("b.doc_key.doc_id"))
    return rows.join(bad, same, "left").select(
        "r.doc_id",
        F.col("b.covered").isNotNull().alias("contaminated"),
        F.coalesce("b.items", F.array().cast("array<bigint>")).alias("items"),
        F.coalesce("b.covered", F.lit(0).cast("long")).alias("covered"),
        F.coalesce("b.reworded", F.lit(False)).alias("reworded"),
    )
