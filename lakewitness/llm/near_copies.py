"""Near-copies by DartMinHash signatures.

A document is a weighted set: its shingles of five lower-case words, each weighted by how often it occurs (a text of
one to four words is one shingle). For every unit of a shingle's weight and every strip of ranks, a hash-seeded
Poisson number of darts falls into that region; each dart has a coordinate and a rank, and a coordinate keeps its
earliest dart. Strips of growing rank are thrown until every coordinate has one, so a signature costs about
k log k darts, not k times the number of shingles. Two signatures agree in a coordinate with the probability of the
weighted Jaccard similarity.

Bands of ROWS coordinates give candidates: 1 - (1 - 0.8**6)**40 = 0.999995 of the pairs at similarity 0.8, more above.
An exact check of the weighted Jaccard similarity of the shingles (64-bit hashes) follows. Only classes are wanted, so a
bucket whose members are already connected is closed. A few rounds compare all members of the open buckets with one
pivot each, another one every round; that connects groups of copies of any size with work in proportion to the
buckets, and only saves work: what it leaves apart is decided below. The members of the buckets left open are often unlike texts around one common passage, so all pairs of a bucket
would be too many. They meet by an exact filter instead: with the shingles in any one order, two texts of similarity t
share a shingle among the first |A| - ceil(t |A|) + 1 of the larger one and the first |B| - ceil(2 t |B| / (1 + t)) + 1 of
the smaller one, early enough in both to leave room for the rest. The order puts shingles that few of these texts hold
first, those of a common passage last, where they count no more. Texts that meet so and share a bucket are compared; no
pair of a bucket at the similarity asked for is left out. Links give classes by connected components.

Defined results: a null text is empty; texts without words are a class for each equal text; equal texts are one
class; class_id is the smallest doc_id of the class, null if it has none; of equal rows one stays; an empty table
gives an empty result; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewitness.llm.common import packed, settled, table, text_digest, whole_text, with_numbers
from lakewitness.llm.hashing import C, mix, ngrams, signed, word_hashes
from lakewitness.session import cut, ship_package

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 40, 6
COORDINATES = BANDS * ROWS
# Strips double from the first width up to the last, which they then keep.
FIRST_STRIP, LAST_STRIP = 0.25, 256.0
PIVOT_ROUNDS = 3
# How many texts hold a shingle, in steps, and the bits of the table that tells of each step: 10 MB, whatever the size of the corpus.
STEPS = {2: 26, 16: 24, 256: 22}
_LOW, _HALF = np.uint64(0xFFFFFFFF), np.uint64(32)
_IS_WORD = np.ones(256, np.int8)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = 0


def elements(text: str) -> np.ndarray:
    """One 64-bit number for every unit of weight: the i-th occurrence of a shingle."""
    words = word_hashes(text.lower().encode("utf-8", "surrogatepass"), _IS_WORD)
    if len(words) == 0:
        return words
    size = min(WORDS, len(words))
    shingles = np.sort(ngrams(words, tuple(range(size)), size))
    first = np.flatnonzero(np.append(True, shingles[1:] != shingles[:-1]))
    nth = np.arange(len(shingles)) - np.repeat(first, np.diff(np.append(first, len(shingles))))
    return mix(shingles + nth.astype(np.uint64) * C[40])


def _poisson_table(mean: float) -> np.ndarray:
    terms, k = [np.exp(-mean)], 0
    while k < mean or terms[-1] > 1e-18:
        k += 1
        terms.append(terms[-1] * mean / k)
    return np.cumsum(terms)


_tables: dict[float, np.ndarray] = {}


def signature(units: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """The earliest dart of every coordinate."""
    none = np.uint64(2**64 - 1)
    out = np.full(coordinates, none, np.uint64)
    open_ = np.ones(coordinates, bool)
    strip, low = 0, 0.0
    while open_.any():
        width = min(max(low, FIRST_STRIP), LAST_STRIP)
        if width not in _tables:
            _tables[width] = _poisson_table(width)
        seed = mix(units + C[41:42] * np.uint64(strip))
        darts = np.searchsorted(_tables[width], (seed >> np.uint64(11)) * 2.0**-53, side="right")
        nth = np.arange(1, darts.sum() + 1, dtype=np.uint64)
        nth -= np.repeat((np.cumsum(darts) - darts).astype(np.uint64), darts)
        dart = mix(np.repeat(seed, darts) + nth * C[42])
        # low bits give the coordinate; the dart as a number, ordered by its high bits, is its rank within the strip
        place = ((dart & _LOW) * np.uint64(coordinates) >> _HALF).astype(np.int64)
        fits = open_[place]
        np.minimum.at(out, place[fits], dart[fits])
        open_ = out == none
        strip, low = strip + 1, low + width
    return out


def band_hashes(text: str) -> np.ndarray | None:
    units = elements(text)
    if len(units) == 0:
        return None
    grid = signature(units).reshape(BANDS, ROWS)
    return signed(mix((grid * C[:ROWS]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * C[44]))


def _units(text: str) -> np.ndarray:
    return signed(elements(text))


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", text_digest(whole_text()).alias("node"), whole_text().alias("text"))


def memberships(rows: DataFrame) -> DataFrame:
    """band, node: the members of every bucket that holds different texts.

    Signatures are made once per document, kept as one short array per different text, and read twice.
    """
    signed_ = with_numbers(rows.select("node", "text"), band_hashes, "bands")
    once = settled(signed_.groupBy("node").agg(F.first("bands").alias("bands")))
    bands = once.select("node", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    return bands.join(shared, "band")


def unit_arrays(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, units: the shingle units of the given texts, each read from one document that holds it."""
    first = rows.select("node", "doc_id").groupBy("node").agg(F.min("doc_id").alias("_doc"))
    wanted = first.join(nodes, "node").withColumnRenamed("node", "_node")
    held = rows.join(wanted, (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("_doc")))
    found = with_numbers(held.select("node", "text"), _units, "units")
    return found.groupBy("node").agg(F.first("units").alias("units"))


def similarities(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with their exact similarity."""
    one = units.select(F.col("node").alias("a"), F.col("units").alias("_a"))
    two = units.select(F.col("node").alias("b"), F.col("units").alias("_b"))
    shared = F.size(F.array_intersect("_a", "_b"))
    both = pairs.join(two, "b").join(one, "a")
    return both.select("a", "b", (shared / (F.size("_a") + F.size("_b") - shared)).alias("similarity"))


def still_open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """band, node, root: the members of the buckets that hold more than one class so far."""
    known = members.select("band", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ends = known.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("band")
    return cut(known.join(ends, "band").select("band", "node", "root"))


def rooted_nodes(rows: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """node, root: the class of every text that is linked to a different one."""
    members = settled(memberships(rows))
    units = settled(unit_arrays(rows, members.select("node").distinct()))
    roots = members.limit(0).select("node", F.col("node").alias("root"))

    def joined(pairs: DataFrame) -> DataFrame:
        """The classes after these pairs (a, b) of members of different classes were compared."""
        found = cut(similarities(pairs, units).where(F.col("similarity") >= similarity).select("a", "b"))
        return roots if found.isEmpty() else components(found.union(roots.select("node", "root")))

    for k in range(PIVOT_ROUNDS):
        open_ = still_open(members, roots)
        if open_.isEmpty():
            return roots
        # a bucket once closed stays so
        members = open_.select("band", "node")
        # one order for all buckets, so that a large group of copies has the same pivot almost everywhere
        draw = F.struct(F.xxhash64(F.lit(k), "node").alias("draw"), F.col("node").alias("a"), F.col("root").alias("own"))
        pivots = open_.groupBy("band").agg(F.min(draw).alias("p")).select("band", "p.a", "p.own")
        met = open_.join(pivots, "band").where(F.col("root") != F.col("own"))
        roots = joined(met.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct())
    open_ = still_open(members, roots)
    if open_.isEmpty():
        return roots
    buckets = open_.groupBy("node", "root").agg(F.collect_set("band").alias("bands"))
    return joined(meetings(settled(units.join(buckets, "node")), similarity))


def step_tables(held: DataFrame) -> list[np.ndarray]:
    """Bits for each of STEPS: the places of shingles that so many texts hold."""
    counts = held.select(F.explode("units").alias("u")).groupBy(F.shiftright("u", 32).cast("int").alias("k")).agg(F.count("*").alias("n"))
    place = lambda bits: F.shiftrightunsigned("k", 32 - bits).cast("long") + 1
    steps = F.array(*[F.struct(F.lit(i).alias("step"), (F.col("n") >= n).alias("there"), place(bits).alias("p")) for i, (n, bits) in enumerate(STEPS.items())])
    places = counts.where(F.col("n") >= min(STEPS)).select(F.explode(F.filter(steps, lambda x: x["there"])).alias("x")).select("x.step", "x.p")
    parts = places.groupBy("step", F.bitmap_bucket_number("p").alias("number")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("part"))
    out = [np.zeros(1 << bits >> 3, np.uint8) for bits in STEPS.values()]
    for r in parts.collect():
        out[r.step][(r.number - 1) * len(r.part) : r.number * len(r.part)] = np.frombuffer(bytes(r.part), np.uint8)
    return out


def first_units(units: np.ndarray, tables: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the shingles that must hold one in common with any smaller text this similar, those that another text may hold; their places."""
    steps = np.zeros(len(units), np.uint8)
    for t, bits in zip(tables, STEPS.values()):
        place = units.view(np.uint64) >> np.uint64(64 - bits)
        steps += (t[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1
    n = len(units) - int(np.ceil(similarity * len(units) - 1e-9)) + 1
    order = np.lexsort((units, steps))[:n]
    at = np.flatnonzero(steps[order] > 0)
    return units[order[at]], at


def meetings(held: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of texts (node, root, bands, units) in different classes that may be this similar."""
    tables = step_tables(held)
    ship_package(held.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            others, lists = batch.drop_columns(["units"]), batch.column("units")
            for k in range(batch.num_rows):
                units, at = first_units(lists[k].values.to_numpy(), tables, similarity)
                again = pa.array(np.zeros(len(at), np.int64))
                columns = [c.take(again) for c in others.slice(k, 1).columns]
                size = pa.array(np.full(len(at), len(lists[k]), np.int32))
                yield pa.RecordBatch.from_arrays([*columns, size, pa.array(units), pa.array(at, pa.int32())], [*others.schema.names, "size", "unit", "at"])

    firsts = held.select("node", "root", "units").mapInArrow(run, "node binary, root binary, size int, unit bigint, at int")
    each = settled(firsts)
    mixed = each.groupBy("unit").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("unit")
    shared = cut(each.join(mixed, "unit"))
    sizes = shared.groupBy("unit", "root").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("unit").agg(F.max(F.struct("n", "root")).alias("m")).select("unit", F.col("m.root").alias("most"))
    placed = cut(shared.join(largest, "unit").select("unit", "node", "root", "size", "at", (F.col("root") != F.col("most")).alias("outside")))
    needed = lambda total: F.ceil(similarity / (1 + similarity) * total - 1e-9)
    # the smaller text of a pair comes from ``small``; of two in the class most of them are in, neither is asked for
    small = placed.where(F.col("at") <= F.col("size") - needed(2 * F.col("size"))).select("unit", *[F.col(c).alias(f"small_{c}") for c in ("node", "root", "size", "at", "outside")])
    room = F.least(F.col("size") - F.col("at"), F.col("small_size") - F.col("small_at")) >= needed(F.col("size") + F.col("small_size"))
    meet = (F.col("small_size") <= F.col("size")) & (F.col("small_size") >= similarity * F.col("size") - 1e-9) & (F.col("root") != F.col("small_root")) & room
    one, two = placed.join(small.where("small_outside"), "unit").where(meet), placed.where("outside").join(small.where("NOT small_outside"), "unit").where(meet)
    pairs = one.unionByName(two).select(F.least("node", "small_node").alias("a"), F.greatest("node", "small_node").alias("b")).distinct()
    side = lambda name: held.select(F.col("node").alias(name), F.col("bands").alias(f"bands_{name}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    return both.where(F.arrays_overlap("bands_a", "bands_b")).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of each node's component, for nodes with an edge.

    Alternating stars: every node sends its larger neighbours, then its smaller ones, to the least node it knows, until
    nothing changes. Every step works on aggregated minima, never on a gathered neighbourhood.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        e = cut(large.join(small, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("x")).select("x.u", F.col("x.m").alias("v")).where("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now


def classes(docs: DataFrame) -> DataFrame:
    """node, class_id, keep_doc, keep_node: per different text, its class and the one row of it that stays."""
    rows = keyed(docs)
    roots = rooted_nodes(rows)
    texts = rows.groupBy("node").agg(F.min("doc_id").alias("doc"))
    rooted = cut(texts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    # nulls come last
    first = F.struct(F.col("doc").isNull().alias("none"), "doc", "node")
    kept = rooted.groupBy("root").agg(F.min(first).alias("k"))
    return rooted.join(kept, "root").select("node", F.col("k.doc").alias("class_id"), F.col("k.node").alias("keep_node"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of every class, with its own columns."""
    stay = cut(classes(docs).where(F.col("node") == F.col("keep_node")).select("node", F.col("class_id").alias("_doc")))
    rows = packed(docs).withColumn("_node", text_digest(whole_text("_row.text")))
    held = rows.join(stay, (F.col("_node") == F.col("node")) & F.col("_row.doc_id").eqNullSafe(F.col("_doc")))
    # equal rows: the keys are those of the join
    return held.groupBy("node", "_doc").agg(F.first("_row").alias("_row")).select("_row.*")


def op4_dart_minhash(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = cut(classes(docs))
    rows = docs.select("doc_id", text_digest(whole_text()).alias("node"))
    return rows.join(found, "node").select("doc_id", "class_id")
