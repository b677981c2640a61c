"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundshift.session import ensure_checkpoint_dir

MAX_ROUNDS = 100


def components(edges: DataFrame) -> DataFrame:
    """`node, root` for every node of `a, b` edges; the root is the smallest node of its component.

    Alternates large-star and small-star steps: each hangs neighbours on the smallest one they see, first those above a
    node, then those below, until nothing changes. Minima are aggregated before the shuffle and joined back, so a node with
    very many neighbours is never gathered. Every round is checkpointed; rounds grow with the logarithm of the nodes.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    both = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    seen = None
    for _ in range(MAX_ROUNDS):
        state = both.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
        # Large star: both directions; larger neighbours move to the smallest neighbour.
        ways = both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = ways.filter("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        kept = large.filter("u <> v").distinct()
        # Small star: smaller neighbours, and the node itself, move to the smallest of them.
        low = kept.groupBy("u").agg(F.min("v").alias("m"))
        small = kept.join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        both = small.filter("u <> v").distinct().checkpoint()
    else:
        raise RuntimeError("components did not converge")
    return both.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        both.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
