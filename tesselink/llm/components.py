"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

#: A node's links are dealt into so many parts, so that no task holds a hub; what a node gathers is a row for each part.
PARTS = 32


def _with_least(rows: DataFrame) -> DataFrame:
    """Rows (a, b) with ``m``, the smallest b of their a.

    The rows move once, by node and part; only a row for each of these moves on to its node and back.
    """
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(PARTS))).repartition("a", "part")
    least = dealt.groupBy("a", "part").agg(F.min("b").alias("m")).withColumn("m", F.min("m").over(Window.partitionBy("a")))
    return dealt.join(least, ["a", "part"]).select("a", "b", "m")


def _large(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours point at the smallest of its neighbourhood."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_least(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))


def _small(links: DataFrame) -> DataFrame:
    """A node (a, the larger end of its links) and its smaller neighbours point at the smallest of them."""
    found = _with_least(links)
    return found.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(found.select("a", F.col("m").alias("b")))


def _settled(links: DataFrame) -> bool:
    """Whether every node either points at one other or is only pointed at."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("out")).unionByName(links.select(F.col("b").alias("node"), F.lit(0).alias("out")))
    of = ends.groupBy("node").agg(F.sum("out").alias("out"), F.count("*").alias("n"))
    return of.where((F.col("out") > 1) | ((F.col("out") == 1) & (F.col("n") > 1))).isEmpty()


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a and b), root being the smallest node reachable.

    Nodes may be of any type with an order, structs too.  Each round is checkpointed; the rounds end when all that is
    left are stars.  Loops and repeated links are allowed, an empty table gives an empty result.
    """
    now = durable(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(rounds):
        if _settled(now):
            break
        now = durable(_small(_large(now)).distinct())
    else:
        raise RuntimeError(f"the components did not settle in {rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
