"""The packed graph against its edges, with a hub."""

import random

from pyspark.sql import functions as F

from skein.operators import packed_graph


def test_packed_links_equal_the_edges_and_lookups_read_one_part(spark, tmp_path):
    rng = random.Random(9)
    ids = sorted(rng.sample(range(10_000), 300))
    edges = {(rng.choice(ids), rng.choice("xy"), rng.choice(ids)) for _ in range(500)} | {(ids[7], "x", i) for i in ids} | {(i, "y", ids[9]) for i in ids[::2]}
    rows = [(*e, False) for e in edges] + [(*e, False) for e in list(edges)[:20]] + [(ids[0], "gone", ids[1], True), (ids[0], "x", -5, False)]
    nodes = spark.createDataFrame([(i, f"n{i}") for i in ids], "id long, payload string").repartition(5)
    frame = spark.createDataFrame(rows, "src long, rel string, dst long, tombstone boolean")
    numbers = {r.id: r.number for r in packed_graph.numbered(nodes).collect()}
    assert numbers == {i: n for n, i in enumerate(ids)}
    path = str(tmp_path / "g")
    packed_graph.write_packed(nodes, frame, path, hub=16, part=32)
    blocks = spark.read.parquet(f"{path}/links")
    assert all(len(r.links) <= 16 * 2 and list(r.links) == sorted(r.links) for r in blocks.collect())
    assert blocks.where((F.col("number") == 7) & (F.col("side") == "out")).count() > 10
    for i in (ids[7], ids[9], ids[0], ids[-1]):
        assert sorted(map(tuple, packed_graph.neighbours(spark, path, i, part=32).collect())) == sorted((r, d) for s, r, d in edges if s == i)
        assert sorted(map(tuple, packed_graph.neighbours(spark, path, i, "into", "y", part=32).collect())) == sorted((r, s) for s, r, d in edges if d == i and r == "y")
    assert packed_graph.neighbours(spark, path, 123_456, part=32).count() == 0
    one = blocks.where((F.col("part") == 2) & (F.col("number") == 70))
    assert {f.split("part=")[1].split("/")[0] for f in one.select(F.input_file_name().alias("f")).distinct().toPandas()["f"]} <= {"2"}
    assert "PartitionFilters: [isnotnull(part" in one._jdf.queryExecution().executedPlan().toString()
    assert packed_graph.numbered(nodes.where("false")).count() == 0
