"""Mixing sources to target weights by Poisson replication.

Every source gets a repetition rate: its target share of the output, over what it holds. A document is repeated as
often as a Poisson variable with that mean says, inverted from a hash of the document and the seed, and all copies
are then shuffled globally by a hash of document and copy.

Sizes are code points of the text plus one. Rates above MEAN_STEP are split into equal parts with a draw each, so
that the inversion always ends within TERMS terms. Defined results: null texts are empty; null sources count as one
source; equal rows (same doc_id and text) draw the same count; a source without a given weight gets none; an empty
table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewitness.llm.common import packed, table, unit_draw, whole_text
from lakewitness.session import cut

SEED = "mix-1"
# Without given weights, a source's target share goes with its size to this power.
TEMPERING = 0.5
MEAN_STEP, TERMS = 16.0, 64


def source_key(column: str = "source") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def repetition_rates(docs: DataFrame, weights: dict[str, float] | None = None, size: float = 1.0) -> DataFrame:
    """mix_source, rate, parts, cdf (of a Poisson variable with mean rate / parts), for an output ``size`` times the input."""
    sizes = cut(docs.select(source_key().alias("mix_source"), (F.length(whole_text()) + 1).alias("chars")).groupBy("mix_source").agg(F.sum("chars").alias("chars")))
    if weights is None:
        wanted = F.pow(F.col("chars").cast("double"), F.lit(TEMPERING))
    else:
        wanted = F.lit(0.0)
        for name, weight in weights.items():
            wanted = F.when(F.col("mix_source") == name, float(weight)).otherwise(wanted)
    total = sizes.agg(F.sum("chars").alias("chars"), F.sum(wanted).alias("wanted")).first()
    if not total["chars"] or not total["wanted"]:
        rate = F.lit(0.0)
    else:
        rate = F.round(wanted / total["wanted"] * (size * total["chars"]) / F.col("chars"), 9)
    rates = sizes.select("mix_source", rate.alias("rate")).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / MEAN_STEP)).cast("int"))
    mean = F.col("rate") / F.col("parts")
    first = F.exp(-mean)

    def step(state: Column, k: Column) -> Column:
        term = state["term"] * mean / k
        return F.struct(F.array_append(state["cdf"], F.element_at(state["cdf"], -1) + term).alias("cdf"), term.alias("term"))

    start = F.struct(F.array(first).alias("cdf"), first.alias("term"))
    cdf = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda s: F.transform(s["cdf"], lambda x: F.round(x, 12)))
    return rates.withColumn("cdf", cdf)


def copies(key: Column, seed: str = SEED) -> Column:
    """How often a document appears, from its key and the columns of repetition_rates."""
    one = lambda i: F.size(F.filter("cdf", lambda c: c <= unit_draw(key, F.lit(seed), i)))
    return F.aggregate(F.sequence(F.lit(1), F.col("parts")), F.lit(0), lambda total, i: total + one(i))


def mixed(df: DataFrame, key: Column, rates: DataFrame, seed: str = SEED) -> DataFrame:
    """The rows of ``df`` (which has mix_source), repeated and shuffled; adds rate, copies, copy and order_key."""
    counted = df.join(rates, "mix_source").withColumn("_key", key).withColumn("copies", copies(F.col("_key"), seed)).where("copies > 0")
    spread = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    order = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("_key"), F.lit(seed), F.lit("order"), F.col("copy").cast("string"))), 1, 15), 16, 10).cast("long")
    # equal rows have equal order keys; the place in the input parts them, so that no range holds them all
    spread = spread.withColumn("order_key", order).withColumn("_tie", F.monotonically_increasing_id())
    return spread.orderBy("order_key", "_tie").drop("_tie", "_key", "cdf", "parts")


def document_key(doc_id: Column, text: Column) -> Column:
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), F.md5(text))


def mix_documents(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """The documents in their new mixture and order, with their own columns."""
    rates = cut(repetition_rates(docs, weights))
    rows = packed(docs).withColumn("mix_source", source_key("_row.source"))
    return mixed(rows, document_key(F.col("_row.doc_id"), whole_text("_row.text")), rates).select("_row.*")


def op5_poisson_mixture(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rates = cut(repetition_rates(docs))
    key = document_key(F.col("doc_id"), whole_text())
    rows = docs.select("doc_id", "source", source_key().alias("mix_source"), key.alias("doc_key"))
    return mixed(rows, F.col("doc_key"), rates).select("doc_id", "source", F.col("copies").cast("long"), F.col("copy").cast("long"), "order_key")


OP5_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(source, '') AS s, length(coalesce(text, '')) + 1 AS chars, doc_id || ':' || md5(coalesce(text, '')) AS key FROM documents),
sizes AS (SELECT s, sum(chars) AS chars FROM d GROUP BY s),
rates AS (
  SELECT s, round(sqrt(chars::DOUBLE) / sum(sqrt(chars::DOUBLE)) OVER () * sum(chars) OVER () / chars, 9) AS rate FROM sizes
),
parts AS (SELECT *, greatest(1, ceil(rate / {MEAN_STEP}))::INT AS parts FROM rates),
terms AS (SELECT s, k, exp(-rate / parts + k * ln(rate / parts) - lgamma(k + 1)) AS term FROM parts, range(0, {TERMS + 1}) t(k)),
cdf AS (SELECT s, k, round(sum(term) OVER (PARTITION BY s ORDER BY k), 12) AS c FROM terms),
draws AS (
  SELECT key, d.s, (('0x' || substr(md5(key || ':{SEED}:' || i), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u
  FROM d JOIN parts USING (s), range(1, 1000) r(i) WHERE i <= parts
),
counts AS (SELECT key, count(*) FILTER (c <= u) AS copies FROM draws JOIN cdf USING (s) GROUP BY key)
SELECT doc_id, source, copies, unnest(range(1, copies + 1)) AS copy,
  ('0x' || substr(md5(key || ':{SEED}:order:' || unnest(range(1, copies + 1))), 1, 15))::BIGINT AS order_key
FROM d JOIN counts USING (key)
"""
