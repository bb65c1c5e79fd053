"""Connected components of a link table by alternating large-star and small-star rounds.

Every round regroups the links around smaller neighbours. Minima combine on the map side,
links are joined to written minima so that adaptive execution can split a node with very
many links, and every round is written to the shared folder. Only one count and one
checksum per round reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links(a, b)`` that is not the smallest of its
    component; root is that smallest node. Self-links, repeats and nulls are ignored."""
    links = stored(_larger_first(links.select("a", "b")), "links")
    seen = None
    while True:
        state = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state[0] == 0 or tuple(state) == seen:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = tuple(state)

        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stored(both.groupBy("a").agg(F.min("b").alias("m"))
                     .select("a", F.least("a", "m").alias("m")), "low")
        large = stored(_larger_first(both.join(low, "a").where("b > a")
                                     .select(F.col("b").alias("a"), F.col("m").alias("b"))), "large")
        low = stored(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = (large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(low.select("a", F.col("m").alias("b"))))
        links = stored(_larger_first(small), "links")


def _larger_first(links: DataFrame) -> DataFrame:
    return links.where("a <> b").select(F.greatest("a", "b").alias("a"),
                                        F.least("a", "b").alias("b")).distinct()
