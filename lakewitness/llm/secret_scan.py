"""Secret scan with corpus-wide ownership.

Fixed patterns give the base spans. A further pattern finds long mixed tokens. All candidates are hashed, and their
distinct repositories and owners are counted over the corpus: a candidate held by many owners, or in many repositories of a
few, is a copied example; one held by few in few places looks like a live credential. Live mixed tokens outside the base
spans are added to the spans.

Here an owner is a source, and a repository is what a source holds in one language. Defined results: a null text is
empty; null owners count as one owner; repeated rows get equal results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lakewitness.llm.common import EMPTY_SHA256, table, text_digest, whole_text
from lakewitness.session import cut

# Base patterns, fixed by the contract; then the token pattern of this operator.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = {"assign": ASSIGN, "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+", "mixed": "[A-Za-z0-9+/_=-]{24,}"}
KINDS = list(PATTERNS)
# Held by more owners than this, or in more repositories, a candidate is an example.
LIVE_OWNERS, LIVE_REPOSITORIES = 2, 3


def _value(match: Column) -> Column:
    """The part of a match that is the credential."""
    return F.when(F.col("kind") == 0, F.regexp_extract(match, ASSIGN, 2)).otherwise(match)


def _wanted() -> Column:
    value = F.col("value")
    mixed = value.rlike("[a-z]") & value.rlike("[A-Z]") & value.rlike("[0-9]")
    least = F.element_at(F.array(F.lit(8), F.lit(16), F.lit(32), F.lit(24)), F.col("kind") + 1)
    return (F.length(value) >= least) & ((F.col("kind") != 3) | mixed)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the text, owner, repository, kind, start, end, secret: every wanted match of every pattern.

    Matches and the text between them come from the same leftmost scan, so running lengths give positions. Rows
    without a match leave before any shuffle; equal rows are scanned once.
    """
    text = whole_text()
    found = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        # one code point more than a plain word can't match the long kinds: the quantifier keeps short runs out of the lists
        scan = {"hex": "[0-9a-f]{32,}", "access": "AKIA[A-Z0-9]{12,}"}.get(kind, pattern)
        matches = F.regexp_extract_all(text, F.lit(scan), 0)
        gaps = F.transform(F.split(text, scan, -1), lambda g: F.length(g))
        found.append(F.when(F.size(matches) > 0, F.struct(F.lit(k).alias("kind"), matches.alias("matches"), F.when(F.size(matches) > 0, gaps).alias("gaps"))))
    owner = F.coalesce(F.col("source").cast("string"), F.lit(""))
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text_digest(text).alias("digest"), owner.alias("owner"), F.struct(owner.alias("o"), lang.alias("l")).alias("repository"), F.array_compact(F.array(*found)).alias("found"))
    rows = rows.where(F.size("found") > 0).dropDuplicates(["doc_id", "digest", "owner", "repository"])
    each = rows.select("doc_id", "digest", "owner", "repository", F.inline("found")).select(
        "doc_id", "digest", "owner", "repository", "kind", F.posexplode(F.arrays_zip("matches", "gaps")).alias("i", "m")
    )
    each = each.where(F.col("m.matches").isNotNull())
    upto = W.partitionBy("doc_id", "digest", "owner", "repository", "kind").orderBy("i")
    size = F.length("m.matches")
    placed = each.withColumn("end", F.sum(F.col("m.gaps") + size).over(upto)).withColumn("start", F.col("end") - size)
    return placed.withColumn("value", _value(F.col("m.matches"))).where(_wanted()).select(
        "doc_id", "digest", "owner", "repository", "kind", "start", "end", F.sha2("value", 256).alias("secret")
    )


def ownership(found: DataFrame) -> DataFrame:
    """secret, repositories, owners, live: counts over the whole corpus, from distinct pairs, pre-aggregated."""
    pairs = found.groupBy("secret", "owner", "repository").agg(F.lit(1).alias("one"))
    owners = pairs.groupBy("secret", "owner").agg(F.count("*").alias("repositories"))
    counts = owners.groupBy("secret").agg(F.sum("repositories").alias("repositories"), F.count("*").alias("owners"))
    return counts.withColumn("live", (F.col("owners") <= LIVE_OWNERS) & (F.col("repositories") <= LIVE_REPOSITORIES))


def spans_by_document(found: DataFrame) -> DataFrame:
    """doc_id, digest and an ordered array ``spans`` of (start, kind, end, live) per document that has any."""
    judged = found.join(ownership(found).select("secret", "live"), "secret")
    spans = judged.groupBy("doc_id", "digest").agg(F.sort_array(F.collect_set(F.struct("start", "kind", "end", "live"))).alias("all"))
    base = F.filter("all", lambda s: s["kind"] < 3)
    apart = lambda s: ~F.exists(F.col("base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    return spans.withColumn("base", base).select("doc_id", "digest", "base", F.filter("all", lambda s: (s["kind"] < 3) | (s["live"] & apart(s))).alias("spans"))


def _listed(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_secret_ownership(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    per_doc = spans_by_document(cut(candidates(docs)))
    rows = docs.select("doc_id", text_digest(whole_text()).alias("digest")).alias("d")
    per_doc = per_doc.alias("s")
    same = F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.digest") == F.col("s.digest"))
    out = rows.join(per_doc, same, "left").select("d.doc_id", F.coalesce("s.base", F.array()).alias("base"), F.coalesce("s.spans", F.array()).alias("spans"))
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return out.select(
        "doc_id",
        *[number(k).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.when(F.size("base") == 0, EMPTY_SHA256).otherwise(F.sha2(_listed(F.col("base")), 256)).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
    )


def _oracle() -> str:
    parts = " UNION ALL ".join(
        f"SELECT doc_id, owner, repo, {k} AS k, '{kind}' AS kind, unnest(regexp_extract_all(text, '{p}')) AS m, unnest(string_split_regex(text, '{p}')[:-2]) AS gap, "
        f"generate_subscripts(regexp_extract_all(text, '{p}'), 1) AS i FROM d WHERE regexp_matches(text, '{p}')"
        for k, (kind, p) in enumerate((kind, p.replace("'", "''")) for kind, p in PATTERNS.items())
    )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS owner, coalesce(source, '') || chr(0) || coalesce(lang, '') AS repo FROM documents),
m AS ({parts}),
p AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, k ORDER BY i) AS stop FROM m),
v AS (SELECT *, stop - length(m) AS start, CASE k WHEN 0 THEN regexp_extract(m, '{ASSIGN.replace("'", "''")}', 2) ELSE m END AS val FROM p),
c AS (SELECT * FROM v WHERE length(val) >= [8, 16, 32, 24][k + 1] AND (k < 3 OR (regexp_matches(val, '[a-z]') AND regexp_matches(val, '[A-Z]') AND regexp_matches(val, '[0-9]')))),
live AS (SELECT val, count(DISTINCT owner) <= {LIVE_OWNERS} AND count(DISTINCT repo) <= {LIVE_REPOSITORIES} AS live FROM c GROUP BY val),
s AS (SELECT c.*, live FROM c JOIN live USING (val)),
kept AS (SELECT * FROM s WHERE k < 3 OR (live AND NOT EXISTS (SELECT 1 FROM s b WHERE b.doc_id = s.doc_id AND b.k < 3 AND b.start < s.stop AND s.start < b.stop))),
a AS (
  SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) FILTER (k < 3) AS base,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) AS spans, count(*) FILTER (live) AS n_live
  FROM kept GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0)::BIGINT AS n_live
FROM documents LEFT JOIN a USING (doc_id)
"""


OP2_SQL = _oracle()
