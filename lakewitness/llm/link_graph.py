"""URL filter by rules and link-graph propagation.

Hosts allowed by rules are trusted seeds, hosts blocked by rules are blocked seeds, each with the share of its pages
the rules reach. Trust is a personalised PageRank along links; distrust is one along reversed links, so that a host
that links to blocked hosts is distrusted. A host without its own rule is blocked where its distrust passes a
threshold and its trust. Hosts without outgoing links keep their mass to themselves. Both walks go on until the mass still
under way, which bounds what any host lacks, is below TOLERANCE.

Defined results: a null url, or one without "://", has an empty host and path, takes part in no link, and is allowed; null pages
have no links; repeated rows are judged alike and count as links again; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewitness.llm.common import table
from lakewitness.session import cut

# (host, path, verdict); fixed by the contract.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
DAMPING, STEPS, CUT_EVERY = 0.85, 10, 5
# Of the scores that decide; STEPS is the length of the fixed walk the check SQL makes.
TOLERANCE = 1e-6
DISTRUST = 0.1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)\bhref\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""


def host_of(rest: Column) -> Column:
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)


def addressed(pages: DataFrame, *keep: str) -> DataFrame:
    """The kept columns, host and path."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return pages.select(*keep, host_of(rest).alias("host"), path.alias("path"))


def ruled(df: DataFrame, rules=RULES) -> DataFrame:
    """Adds ``rule`` and ``by_rule`` from host and path: the longest rule that fits, by text among equals."""
    fits = []
    for host, path, verdict in rules:
        fit = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        fits.append(F.when(fit, F.struct(F.lit(len(host + path)).alias("size"), F.lit(host + path).alias("rule"), F.lit(verdict).alias("by_rule"))))
    best = F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<size:int,rule:string,by_rule:string>")
    return df.withColumn("_best", best).select("*", "_best.rule", "_best.by_rule").drop("_best")


def host_links(pages: DataFrame) -> DataFrame:
    """src, dst, n: links between different hosts, counted."""
    found = addressed(pages, F.array_distinct(F.regexp_extract_all(F.coalesce(F.col("html").cast("string"), F.lit("")), F.lit(LINK), 1)).alias("to"))
    links = found.select(F.col("host").alias("src"), F.explode("to").alias("dst")).select("src", F.translate("dst", _UPPER, _LOWER).alias("dst"))
    return links.where((F.col("src") != "") & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.count("*").alias("n"))


def _walk(seeds: DataFrame, edges: DataFrame, value: str, steps: int) -> DataFrame:
    """Personalised PageRank from ``seeds`` (host, seed) along ``edges`` (src, dst, part)."""
    rank = seeds.select("host", F.col("seed").alias(value))
    for step in range(1, steps + 1):
        moved = rank.join(edges, rank["host"] == edges["src"]).select(F.col("dst").alias("host"), (DAMPING * F.col(value) * F.col("part")).alias(value))
        rank = moved.union(seeds.select("host", ((1 - DAMPING) * F.col("seed")).alias(value))).groupBy("host").agg(F.sum(value).alias(value))
        if step % CUT_EVERY == 0 and step < steps:
            rank = cut(rank)
    return rank


def _converged(seeds: DataFrame, edges: DataFrame, value: str) -> DataFrame:
    """The same, summed from its start over walks of all lengths: what is not summed yet is only missing."""
    own = (1 - DAMPING) * F.col("seed")
    rank, left = seeds.select("host", own.alias(value), own.alias("moving")), TOLERANCE
    while left >= TOLERANCE:
        for _ in range(CUT_EVERY):
            moved = rank.where("moving > 0").join(edges, rank["host"] == edges["src"]).select(F.col("dst").alias("host"), (DAMPING * F.col("moving") * F.col("part")).alias("moving"))
            rank = rank.select("host", value, F.lit(0.0).alias("moving")).union(moved.select("host", F.col("moving").alias(value), "moving")).groupBy("host").agg(F.sum(value).alias(value), F.sum("moving").alias("moving"))
        rank = cut(rank)
        left = (rank.agg(F.sum("moving")).first()[0] or 0.0) * DAMPING / (1 - DAMPING)
    return rank.select("host", value)


def host_verdicts(pages: DataFrame, rules=RULES, steps: int | None = STEPS) -> DataFrame:
    """host, trust, distrust, blocked, for every host of the pages and every host they link to. steps: None until converged."""
    reached = ruled(addressed(pages), rules).where(F.col("host") != "")
    share = lambda verdict: F.avg(F.when(F.col("by_rule") == verdict, 1.0).otherwise(0.0))
    hosts = cut(reached.groupBy("host").agg(share("allow").alias("allowed"), share("block").alias("refused")))
    links = cut(host_links(pages))
    both = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    # forward edges carry trust, reversed ones distrust; each host divides what it passes on by its links in that direction
    out = links.groupBy("src").agg(F.sum("n").alias("all"))
    back = links.groupBy("dst").agg(F.sum("n").alias("all"))
    forward = cut(links.join(out, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("part")))
    reverse = cut(links.join(back, "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("n") / F.col("all")).alias("part")))
    walk = lambda *a: _converged(*a) if steps is None else _walk(*a, steps)
    trust = walk(hosts.where("allowed > 0").select("host", F.col("allowed").alias("seed")), forward, "trust")
    distrust = walk(hosts.where("refused > 0").select("host", F.col("refused").alias("seed")), reverse, "distrust")
    everyone = hosts.select("host").union(both.select("src")).distinct()
    scored = everyone.join(trust, "host", "left").join(distrust, "host", "left").na.fill(0.0, ["trust", "distrust"])
    # the blocked seeds' own part of the score is (1 - damping) of their share; more than the threshold needs most pages or many links
    return scored.withColumn("blocked", (F.col("distrust") > DISTRUST) & (F.col("distrust") > F.col("trust")))


def op1_link_graph_filter(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    verdicts = cut(host_verdicts(pages, steps=None))
    urls = ruled(addressed(pages, "page_id"))
    by_method = F.when(F.coalesce(F.col("blocked"), F.lit(False)), "block").otherwise("allow")
    return urls.join(verdicts, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_method).alias("verdict"))


def _oracle() -> str:
    steps = []
    for name, seed, src, dst in (("t", "allowed", "src", "dst"), ("d", "refused", "dst", "src")):
        steps.append(f"{name}e AS (SELECT {src} AS a, {dst} AS b, n / sum(n) OVER (PARTITION BY {src}) AS part FROM links)")
        steps.append(f"{name}0 AS (SELECT host, {seed} AS v FROM hosts WHERE {seed} > 0)")
        for i in range(STEPS):
            steps.append(
                f"{name}{i + 1} AS (SELECT host, sum(v) AS v FROM (SELECT b AS host, {DAMPING} * v * part AS v FROM {name}{i} JOIN {name}e ON host = a "
                f"UNION ALL SELECT host, {1 - DAMPING:.2f} * v FROM {name}0) GROUP BY host)"
            )
    rule = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for h, p, _ in sorted(RULES, key=lambda r: -len(r[0] + r[1])))
    verdict = " ".join(f"WHEN '{h}{p}' THEN '{v}'" for h, p, v in RULES)
    return f"""
WITH r AS (SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM r),
a AS (SELECT page_id, html, translate(raw, '{_UPPER}', '{_LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
u AS (SELECT *, CASE {rule} END AS rule FROM a),
v AS (SELECT *, CASE rule {verdict} END AS by_rule FROM u),
hosts AS (SELECT host, avg((by_rule IS NOT DISTINCT FROM 'allow')::INT) AS allowed, avg((by_rule IS NOT DISTINCT FROM 'block')::INT) AS refused FROM v WHERE host <> '' GROUP BY host),
links AS (
  SELECT host AS src, dst, count(*) AS n
  FROM (SELECT host, unnest(list_distinct(regexp_extract_all(coalesce(html, ''), '{LINK.replace("'", "''")}', 1))) AS raw FROM v), LATERAL (SELECT translate(raw, '{_UPPER}', '{_LOWER}') AS dst)
  WHERE host <> '' AND host <> dst GROUP BY host, dst
),
{", ".join(steps)}
SELECT page_id, v.host, path, rule, coalesce(by_rule, CASE WHEN coalesce(d{STEPS}.v, 0) > {DISTRUST} AND coalesce(d{STEPS}.v, 0) > coalesce(t{STEPS}.v, 0) THEN 'block' ELSE 'allow' END) AS verdict
FROM v LEFT JOIN t{STEPS} ON t{STEPS}.host = v.host LEFT JOIN d{STEPS} ON d{STEPS}.host = v.host
"""


OP1_SQL = _oracle()
