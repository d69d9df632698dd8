"""Quality rules with thresholds that follow the corpus.

Per language and source, a mergeable quantile sketch of every feature is kept: values fall into buckets that
grow by a fixed factor, so two sketches merge by adding counts and a quantile has a bounded relative error.
Fences come from the quartiles of the smallest level (language and source, language, everything) that holds
enough documents, and are joined back to the documents.

Defined results: a null text has no words and fails the base rules; null languages and sources count as empty
names; repeated rows are judged one by one, and alike; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from lakewitness.llm.common import column_of, packed, table, whole_text
from lakewitness.session import cut, ship_package

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
SPACES = " \t\n\x0b\x0c\r"

# Relative growth of the sketch's buckets, the value below which all is bucket 0.
GROWTH, SMALLEST = 1.02, 1e-3
# Documents a level needs before its own quantiles are trusted.
MIN_GROUP = 200
# Fence = median -/+ REACH * spread, with spread = twice the smaller half of the middle 50 %, at least the floor.
REACH = 3.0
# feature: (numerator, denominator, floor of the spread, judged below the lower fence too)
FEATURES = {
    "word_length": ("word_chars", "n_words", 0.5, True),
    "symbols": ("n_symbols", "n_words", 0.05, False),
    "dup_lines": ("n_dup_lines", "n_lines", 0.1, False),
    "repeats": ("n_repeat_words", "n_words", 0.1, False),
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
_SCHEMA = T.StructType([T.StructField(n, T.LongType()) for n in MEASURES])


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur at least twice."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    marked = bytearray(len(words))
    for i, window in enumerate(windows):
        if counts[window] > 1:
            marked[i : i + 3] = b"\x01\x01\x01"
    return sum(marked)


def measure_text(text: str) -> tuple[int, ...]:
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return (
        len(words),
        len(text) - (len(data) - sum(map(len, words))),
        len(data) - len(data.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
    )


def measured(df: DataFrame, *keep: str) -> DataFrame:
    """The kept columns, lang_key, source_key and the struct ``m`` of measures, for every document.

    A packed row (``_row``) goes through Python as it is and holds its text once; else only the text goes there. Texts are
    measured one by one, so beside an Arrow batch a task holds one of them.
    """
    ship_package(df.sparkSession)
    key = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    whole = "_row" in keep
    lang, source = ("_row.lang", "_row.source") if whole else ("lang", "source")
    given = df.select(*keep, key(lang).alias("lang_key"), key(source).alias("source_key"), *([] if whole else [whole_text().alias("_text")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = column_of(batch.column("_row"), "text") if whole else batch.column("_text")
            values = [measure_text(t.as_py() or "") for t in texts]
            m = pa.StructArray.from_arrays([pa.array([v[i] for v in values], pa.int64()) for i in range(len(MEASURES))], MEASURES)
            others = batch if whole else batch.drop_columns(["_text"])
            yield pa.RecordBatch.from_arrays([*others.columns, m], [*others.schema.names, "m"])

    fields = [f for f in given.schema.fields if f.name != "_text"]
    return given.mapInArrow(run, T.StructType([*fields, T.StructField("m", _SCHEMA)]))


def base_failed() -> Column:
    return (F.col("m.n_words") < MIN_WORDS) | (100 * F.col("m.n_repeat_words") > 50 * F.col("m.n_words"))


def _feature(name: str) -> Column:
    over, under = FEATURES[name][:2]
    return F.coalesce(F.col(f"m.{over}") / F.greatest(F.col(f"m.{under}"), F.lit(1)), F.lit(0.0))


def _bucket(value: Column) -> Column:
    return F.when(value <= SMALLEST, 0).otherwise(F.ceil(F.ln(value / SMALLEST) / F.ln(F.lit(GROWTH)))).cast("int")


def _value(bucket: Column) -> Column:
    return F.when(bucket == 0, 0.0).otherwise(SMALLEST * F.pow(F.lit(GROWTH), bucket) * (2 / (1 + GROWTH)))


def sketches(m: DataFrame) -> DataFrame:
    """Bucket counts per language, source and feature, over the documents that pass the base rules."""
    names = F.array(*[F.struct(F.lit(n).alias("feature"), _bucket(_feature(n)).alias("bucket")) for n in FEATURES])
    cells = m.where(~base_failed()).select("lang_key", "source_key", F.inline(names))
    return cells.groupBy("lang_key", "source_key", "feature", "bucket").agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """One row per language and source: the fences of every feature, as columns lo_ and hi_."""
    keys = ["level", "lang_key", "source_key", "feature"]
    level = lambda k, *gone: sketch.select(
        F.lit(k).alias("level"), *[F.lit("").alias(c) if c in gone else c for c in ("lang_key", "source_key")], "feature", "bucket", "n"
    )
    merged = level(0).union(level(1, "source_key")).union(level(2, "lang_key", "source_key"))
    merged = merged.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))
    order = W.partitionBy(*keys).orderBy("bucket")
    counted = merged.withColumn("upto", F.sum("n").over(order)).withColumn("total", F.sum("n").over(W.partitionBy(*keys)))
    at = lambda q: _value(F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("bucket")))).alias(f"q{round(q * 100)}")
    quartiles = counted.groupBy(*keys).agg(F.max("total").alias("total"), at(0.25), at(0.5), at(0.75))
    quartiles = quartiles.where((F.col("total") >= min_group) | (F.col("level") == 2))
    groups = sketch.select("lang_key", "source_key", "feature").distinct()
    own = groups.select(
        "*",
        F.explode(F.array(*[F.struct(F.lit(k).alias("level"), lang.alias("l"), source.alias("s")) for k, lang, source in (
            (0, F.col("lang_key"), F.col("source_key")), (1, F.col("lang_key"), F.lit("")), (2, F.lit(""), F.lit("")))])).alias("at"),
    ).select("lang_key", "source_key", "feature", "at.*")
    found = own.join(
        quartiles.select("level", F.col("lang_key").alias("l"), F.col("source_key").alias("s"), "feature", "q25", "q50", "q75"), ["level", "l", "s", "feature"]
    )
    best = found.groupBy("lang_key", "source_key", "feature").agg(F.min(F.struct("level", "q25", "q50", "q75")).alias("q"))
    middle = F.col("q.q50")
    half = F.least(middle - F.col("q.q25"), F.col("q.q75") - middle)
    out = []
    for name, (_, _, floor, _) in FEATURES.items():
        spread = REACH * F.greatest(2 * half, F.lit(floor))
        out.append(F.max(F.when(F.col("feature") == name, middle - spread)).alias(f"lo_{name}"))
        out.append(F.max(F.when(F.col("feature") == name, middle + spread)).alias(f"hi_{name}"))
    return best.groupBy("lang_key", "source_key").agg(*out)


def judged(m: DataFrame, fence: DataFrame) -> DataFrame:
    """``m`` with base_failed and kept. A group without any fence (all its documents fail the base rules) rejects nothing more."""
    out = m.join(fence, ["lang_key", "source_key"], "left")
    beyond = F.lit(False)
    for name, (_, _, _, both) in FEATURES.items():
        beyond = beyond | F.coalesce(_feature(name) > F.col(f"hi_{name}"), F.lit(False))
        if both:
            beyond = beyond | F.coalesce(_feature(name) < F.col(f"lo_{name}"), F.lit(False))
    return out.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & ~beyond)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents the rules keep, with their own columns.

    Texts are measured twice, once for the sketches, which are written, and once beside the filter, rather than stored or shuffled
    in between.
    """
    fence = cut(fences(cut(sketches(measured(docs)))))
    return judged(measured(packed(docs), "_row"), fence).where("kept").select("_row.*")


def op6_quality_fences(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    m = cut(measured(docs, "doc_id"))
    out = judged(m, cut(fences(sketches(m))))
    return out.select("doc_id", *[F.col(f"m.{n}").alias(n) for n in MEASURES[:5]], "base_failed", "kept")


OP6_SQL = """
WITH words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents)
),
windows AS (
  SELECT *, count(*) OVER (PARTITION BY doc_id, word, w2, w3) > 1 AND w3 IS NOT NULL AS twice
  FROM (SELECT *, lead(word) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i))
),
marked AS (
  SELECT doc_id, word, twice OR coalesce(lag(twice) OVER o, false) OR coalesce(lag(twice, 2) OVER o, false) AS repeated
  FROM windows WINDOW o AS (PARTITION BY doc_id ORDER BY i)
),
per_word AS (
  SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars, sum(repeated::INT) AS n_repeat_words FROM marked GROUP BY doc_id
),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id
),
m AS (
  SELECT d.doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
    length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM documents d LEFT JOIN per_word USING (doc_id) LEFT JOIN lines USING (doc_id)
),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
f AS (
  UNPIVOT (SELECT doc_id, lang, source, base_failed, word_chars / greatest(n_words, 1) AS word_length, n_symbols / greatest(n_words, 1) AS symbols,
           n_dup_lines / greatest(n_lines, 1) AS dup_lines, n_repeat_words / greatest(n_words, 1) AS repeats FROM b)
  ON word_length, symbols, dup_lines, repeats INTO NAME feature VALUE x
),
cells AS (
  SELECT lang, source, feature, CASE WHEN x <= 1e-3 THEN 0 ELSE ceil(ln(x / 1e-3) / ln(1.02)) END AS bucket FROM f WHERE NOT base_failed
),
levels AS (
  SELECT 0 AS level, lang, source, feature, bucket FROM cells UNION ALL SELECT 1, lang, '', feature, bucket FROM cells
  UNION ALL SELECT 2, '', '', feature, bucket FROM cells
),
upto AS (
  SELECT level, lang, source, feature, bucket, sum(count(*)) OVER (PARTITION BY level, lang, source, feature ORDER BY bucket) AS upto,
    sum(count(*)) OVER (PARTITION BY level, lang, source, feature) AS total
  FROM levels GROUP BY level, lang, source, feature, bucket
),
val AS (SELECT *, CASE WHEN bucket = 0 THEN 0 ELSE 1e-3 * pow(1.02, bucket) * (2 / 2.02) END AS v FROM upto),
quart AS (
  SELECT level, lang, source, feature, min(v) FILTER (upto >= 0.25 * total) AS q25, min(v) FILTER (upto >= 0.5 * total) AS q50,
    min(v) FILTER (upto >= 0.75 * total) AS q75
  FROM val WHERE total >= 200 OR level = 2 GROUP BY level, lang, source, feature
),
fence AS (
  SELECT g.lang, g.source, g.feature, coalesce(a.q50, b.q50, c.q50) AS mid,
    3 * greatest(2 * least(coalesce(a.q50, b.q50, c.q50) - coalesce(a.q25, b.q25, c.q25), coalesce(a.q75, b.q75, c.q75) - coalesce(a.q50, b.q50, c.q50)),
      CASE g.feature WHEN 'word_length' THEN 0.5 WHEN 'symbols' THEN 0.05 ELSE 0.1 END) AS reach
  FROM (SELECT DISTINCT lang, source, feature FROM cells) g
  LEFT JOIN quart a ON a.level = 0 AND a.lang = g.lang AND a.source = g.source AND a.feature = g.feature
  LEFT JOIN quart b ON b.level = 1 AND b.lang = g.lang AND b.feature = g.feature
  LEFT JOIN quart c ON c.level = 2 AND c.feature = g.feature
),
beyond AS (
  SELECT f.doc_id, bool_or(x > mid + reach OR (feature = 'word_length' AND x < mid - reach)) AS far
  FROM f JOIN fence USING (lang, source, feature) GROUP BY f.doc_id
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(far, false) AS kept
FROM b LEFT JOIN beyond USING (doc_id)
"""
