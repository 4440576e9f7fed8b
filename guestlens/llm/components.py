"""Connected components of a link table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guestlens.session import stage


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that has links; the root is the smallest node.

    `links` (a, b). Large-star and small-star steps in turn: every node hands its larger,
    then its smaller neighbours to the smallest one it knows, until only stars are left,
    after about log(size) rounds. Smallest neighbours come from combining aggregates;
    they are stored, so that the joins of a node with very many links can be split.
    """

    def towards(pairs):
        ordered = pairs.where(F.col("a") != F.col("b"))
        return ordered.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def signature(df):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    links = stage(towards(links), "links")
    now = signature(links)
    while now[0]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stage(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low")), "low")
        star = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = stage(towards(star), "large-star")
        low = stage(large.groupBy("a").agg(F.min("b").alias("low")), "low")
        star = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        links = stage(towards(star.unionByName(low.select("a", F.col("low").alias("b")))), "small-star")
        before, now = now, signature(links)
        if before == now:
            break
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stage(nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct()), "components")
