"""Connected components by contraction, with a reliable checkpoint in each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import compacted


def components(links: DataFrame) -> DataFrame:
    """Return (node, root) for the nodes of links (a, b); root is a node of the same component.

    In each round every node takes as parent the least of its neighbours and
    itself by a hash, parents are followed once, and the links are rewritten to
    the parents.  As the order is random, a fixed part of the nodes goes in
    each round, of long chains as well; as it is the same in all rounds, what
    is left around a hub goes in the second.  A node
    with very many links costs rows in proportion: their least is taken before
    the shuffle, and the joins may split its partition.
    """
    # Empty input must give an empty table of the right types.
    pairs = compacted(links.select("a", "b").where("a <> b").distinct())
    found = None
    while not pairs.isEmpty():
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))

        def ranked(name: str):
            return F.struct(F.xxhash64(F.col(name)).alias("h"), F.col(name).alias("p"))

        parent = compacted(both.groupBy("a").agg(F.min(ranked("b")).alias("r")).select("a", F.least(ranked("a"), "r")["p"].alias("p")))
        up = parent.select(F.col("a").alias("p"), F.col("p").alias("q"))
        parent = compacted(parent.join(up, "p").select("a", F.col("q").alias("p")))
        step = parent.select(F.col("a").alias("root"), "p")
        if found is None:
            found = parent.select(F.col("a").alias("node"), F.col("p").alias("root"))
        else:
            found = compacted(found.join(step, "root", "left").select("node", F.coalesce("p", "root").alias("root")))
        a, b = (parent.select(F.col("a").alias(x), F.col("p").alias(f"to_{x}")) for x in "ab")
        moved = pairs.join(a, "a").join(b, "b").where("to_a <> to_b")
        pairs = compacted(moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct())
    return found if found is not None else pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
