"""Connected components of a link table by alternating star rounds."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.session import staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round over edges (a, b) with a > b.

    Large: every node links its larger neighbours to its least neighbour or itself.
    Small: every node links its smaller neighbours and itself to the least of them.
    The least neighbour is an aggregate, joined back; no neighbourhood is gathered.
    """
    if large:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    # written, so that the join below deals both sides anew and a hub can be split
    least = staged(near.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("w"), F.least("u", "m").alias("m")), "least")
    met = near.join(least, near.u == least.w)
    if large:
        out = met.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("v").alias("a"), F.col("m").alias("b")).union(
            least.select(F.col("w").alias("a"), F.col("m").alias("b")))
    return out.filter("a > b").distinct()


def _settled(edges: DataFrame) -> bool:
    """True if every node has one smaller neighbour at most, and that one has none: stars."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")) \
        .filter("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of links (a, b): the smallest node reachable.

    Rounds are written to the shared folder, which cuts lineage; they end when the links
    are stars around the smallest nodes. Self links, repeats and nulls don't matter.
    """
    edges = staged(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                   .filter("a > b").distinct(), "links")
    for _ in range(most_rounds):
        if _settled(edges):
            break
        edges = staged(_star(_star(edges, large=True), large=False), "links")
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
