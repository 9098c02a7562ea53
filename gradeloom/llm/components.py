"""Connected components of a link table by alternating stars, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _state(pairs: DataFrame) -> tuple:
    row = pairs.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def components(links: DataFrame, left: str, right: str, max_rounds: int = 60) -> DataFrame:
    """(node, root): every node that has a link and the least node of its component.

    A round hangs every node's greater neighbours on its least one, then its smaller ones; links
    become stars in a logarithmic number of rounds. Only counts and a checksum come to the driver;
    each round is cut off with a checkpoint. Least neighbours are found with partial aggregates, and
    the joins that follow can be split where a node has very many links.
    """
    pairs = links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u <> v").distinct()
    state = None
    for _ in range(max_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least_neighbour(both).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = _least_neighbour(large)
        hung = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = checkpointed(hung.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        new = _state(pairs)
        if new == state:
            break
        state = new
    else:
        raise RuntimeError(f"components have not settled in {max_rounds} rounds")
    roots = pairs.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
