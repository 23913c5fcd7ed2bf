"""Connected components of an edge table by alternating stars (Kiveris and others, 2014); no node's links are gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import forget, materialize

#: Edges of one node are met in up to so many places.
SALTS = 4


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step: larger neighbours (large) or smaller ones and the node (small) are tied to the least neighbour."""
    both = edges if not large else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    both = both.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    # Which salts the edges of a node have, as bits: a hub's least neighbour goes to each of them, others' to few.
    met = both.groupBy("u").agg(F.min("v").alias("m"), F.expr("bit_or(shiftleft(1, s))").alias("bits")).select("u", F.least("u", "m").alias("m"), "bits")
    least = met.select("u", "m")
    spread = met.select("u", "m", F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.expr("bits").bitwiseAND(F.call_function("shiftleft", F.lit(1), i)) != 0)).alias("s"))
    near = both.join(spread, ["u", "s"])
    out = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else near.select("v", "m").toDF("u", "v").unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label for every node of edges (a, b: bigint): label is the least node it is connected with.

    Loops and repeated edges do no harm; no edges give no rows. Each round is written to the shared folder.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    seen = mark(now)
    while seen[0]:
        after = materialize(_stars(_stars(now, True), False))
        forget(now)
        found = mark(after)
        now = after
        if found == seen:
            break
        seen = found
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
