"""Connected components of a graph given as pairs, with the smallest node of each as its name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlens.session import freeze


def components(links: DataFrame) -> DataFrame:
    """node, component for every node of `links` (columns a, b, of an integer type).

    Every node is hung on the smallest node around it, first from above, then from below, until nothing changes; the
    number of rounds grows with the logarithm of the longest path. The smallest neighbour is an aggregate that combines before
    the shuffle, and the join that follows may split a node with very many links. Each round is a checkpoint.

    Links with a null end are left out; loops and repeated links change nothing; an empty table gives an empty one."""
    edges = freeze(
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    state = None
    while True:
        found = _sign(edges)
        if found == state:
            break
        state = found
        if not found[0]:
            break
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        # Larger neighbours move to the smallest one around.
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionAll(least.where("m < a").select("a", F.col("m").alias("b")).where("a > b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        # Smaller neighbours, and the node itself, move to the smallest one below.
        small = (
            large.join(least, "a")
            .select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
            .where("a > b")
            .distinct()
        )
        edges = freeze(small)
    tops = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
        tops.select("node", F.col("node").alias("component"))
    )


def _sign(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x"), F.sum(F.expr("xxhash64(b, a) >> 24")).alias("s")
    ).first()
    return row["n"], row["x"], row["s"]
