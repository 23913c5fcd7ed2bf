"""A graph written for lookups: nodes with dense numbers, and their links as sorted blocks of numbers in ranges of nodes.

Numbers follow the order of ids: ids are sorted by range, numbered within their part, and moved by the counts of the parts
before, so that nothing is ordered in one task. A node's links lie in blocks that are sorted by relation and other end; a
hub has one block for each stretch of other ends, so no block grows with a node's degree. Blocks lie in parts by the
number of their node, and a lookup reads the part of its node alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.stored import written

#: Links from which on a node is a hub, which is also how many numbers of other ends share a block of it.
HUB = 4096
#: Nodes whose blocks share a part.
PART = 65_536


def numbered(ids: DataFrame) -> DataFrame:
    """id, number: the distinct ids (id) from 0 in their order."""
    order = ids.select("id").where("id is not null").distinct().repartitionByRange("id").sortWithinPartitions("id")
    # The number of the partition, and that of the row in it.
    placed = F.monotonically_increasing_id()
    held = written(order.select("id", F.shiftright(placed, 33).alias("p"), placed.bitwiseAND((1 << 33) - 1).alias("i")))
    counts = {r["p"]: r["n"] for r in held.groupBy("p").agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for p in sorted(counts):
        before.append((p, total))
        total += counts[p]
    # One row per partition.
    starts = F.broadcast(ids.sparkSession.createDataFrame(before, "p bigint, start bigint"))
    return held.join(starts, "p").select("id", (F.col("start") + F.col("i")).alias("number"))


def link_blocks(numbers: DataFrame, edges: DataFrame, hub: int = HUB) -> DataFrame:
    """number, side (out, into), block, links of the live edges (src, rel, dst, tombstone): links is a sorted array of (rel,
    other), other a number. Repeated edges count once; edges without a node at either end are left out."""
    live = edges.where(~F.col("tombstone")).select("src", "rel", "dst")
    ends = live.join(numbers.select(F.col("id").alias("src"), F.col("number").alias("a")), "src").join(numbers.select(F.col("id").alias("dst"), F.col("number").alias("b")), "dst")
    both = F.array(F.struct(F.lit("out").alias("side"), F.col("a").alias("number"), F.col("b").alias("other")), F.struct(F.lit("into").alias("side"), F.col("b").alias("number"), F.col("a").alias("other")))
    links = written(ends.select("rel", F.inline(both)).distinct())
    hubs = links.groupBy("side", "number").agg(F.count("*").alias("n")).where(F.col("n") > hub).select("side", "number", F.lit(True).alias("hub"))
    block = F.when(F.col("hub"), F.floor(F.col("other") / hub)).otherwise(0).cast("long")
    dealt = links.join(hubs, ["side", "number"], "left").withColumn("block", block)
    return dealt.groupBy("number", "side", "block").agg(F.array_sort(F.collect_list(F.struct("rel", "other"))).alias("links"))


def write_packed(nodes: DataFrame, edges: DataFrame, path: str, hub: int = HUB, part: int = PART) -> None:
    """Write nodes (id, ...) with their numbers and the blocks of their links under a path, both in ranges and in order."""
    numbers = written(numbered(nodes))
    named = nodes.join(numbers, "id")
    named.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(f"{path}/nodes")
    named.select("id", "number", F.floor(F.col("number") / part).cast("int").alias("part")).repartitionByRange("number").sortWithinPartitions("number").write.mode("overwrite").partitionBy("part").parquet(f"{path}/numbers")
    blocks = link_blocks(numbers, edges, hub).withColumn("part", F.floor(F.col("number") / part).cast("int"))
    blocks.repartitionByRange("part", "number", "side", "block").sortWithinPartitions("part", "number", "side", "block").write.mode("overwrite").partitionBy("part").parquet(f"{path}/links")


def neighbours(spark: SparkSession, path: str, id, side: str = "out", rel=None, part: int = PART) -> DataFrame:
    """rel, id of the nodes that a node is linked with; only the node's part of the blocks is read, and of the numbers
    what the blocks name."""
    found = spark.read.parquet(f"{path}/nodes").where(F.col("id") == F.lit(id)).select("number").first()
    if found is None:
        schema = spark.read.parquet(f"{path}/nodes").schema["id"].dataType.simpleString()
        return spark.createDataFrame([], f"rel string, id {schema}")
    number = found["number"]
    blocks = spark.read.parquet(f"{path}/links").where((F.col("part") == number // part) & (F.col("number") == number) & (F.col("side") == side))
    links = blocks.select(F.inline("links")).withColumn("part", F.floor(F.col("other") / part).cast("int"))
    links = links if rel is None else links.where(F.col("rel") == F.lit(rel))
    numbers = spark.read.parquet(f"{path}/numbers").select(F.col("number").alias("other"), "id", "part")
    return links.join(numbers, ["part", "other"]).select("rel", "id")
