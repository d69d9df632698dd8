"""Connected components of many graphs at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewitness.session import cut


def components(edges: DataFrame, graph: str, left: str, right: str) -> DataFrame:
    """(graph, node, root) for every node with an edge: ``root`` is the least node of its component.

    Alternating stars: every node hands its larger neighbours, then its smaller ones, to the least node it knows, until a round
    changes nothing; the number of rounds is logarithmic in the longest path. A step works on minima that are merged
    before the shuffle, never on a gathered neighbourhood, so a graph may have any number of nodes and a node any degree.
    """
    key = F.col(graph).alias("g")
    links = edges.select(key, F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u <> v").distinct()
    links, state = cut(links), None
    while True:
        both = links.unionByName(links.select("g", F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("g", "u").agg(F.min("v").alias("m")).select("g", "u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, ["g", "u"]).select("g", F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("g", "u").agg(F.min("v").alias("m"))
        ends = F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        links = cut(large.join(small, ["g", "u"]).select("g", ends.alias("x")).select("g", "x.*").where("u <> v").distinct())
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("g", "u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            roots = links.select(F.col("g").alias(graph), F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return links.select(F.col("g").alias(graph), F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        state = now
