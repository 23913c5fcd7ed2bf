"""Near-duplicate vectors by epsilon grid order (Boehm and others, 2001).

Unit vectors of cosine c lie sqrt(2 - 2c) apart; with epsilon the distance at the threshold, the grid's cells are epsilon
wide on the leading principal dimensions. Vectors are sorted by their cells, the sequence is cut into blocks, and
intervals of the sequence are joined recursively: a pair of intervals whose boxes are further apart than epsilon is
skipped with all that it holds, another is split into pairs of its parts, down to blocks, which are compared in full.

Blocks are dealt to a fixed number of groups, and each pair of groups is met in a place of its own: a block travels once
to each of these places, not once with every block that it is compared with, so what is shuffled grows as the vectors do.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.blocks import arrow_rows, chunks, pad, usable, widest
from skein.llm.common import materialize
from skein.llm.components import components

BLOCK, LEADING, FAN = 1024, 6, 16
#: Numbers of a sample of vectors that come to the driver.
SAMPLE = 1 << 20
#: Groups of blocks; every block is copied to GROUPS + 1 places of all GROUPS * (GROUPS + 1) / 2.
GROUPS = 6


def units(vectors: list[np.ndarray], width: int) -> np.ndarray:
    return normalised(pad(vectors, width, np.float64))


def normalised(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def principal(df: DataFrame, width: int) -> np.ndarray:
    """The leading principal directions of a sample of the unit vectors: those of the first hashed nodes, SAMPLE numbers
    at most. Any orthonormal directions give right results, these give small boxes."""
    rows = max(64, min(8192, SAMPLE // max(1, width)))
    some = df.orderBy(F.xxhash64("node"), "node").limit(rows).select("v").collect()
    if not some:
        return np.zeros((width, 0))
    x = units([np.array(r["v"], dtype=np.float64) for r in some], width)
    _, directions = np.linalg.eigh(x.T @ x)
    return directions[:, ::-1][:, :LEADING].copy()


def linked(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Where unit vectors have a cosine of at least `least`: in doubles, but only for rows and columns that single
    precision, with its largest error allowed for, does not rule out."""
    slack = (a.shape[1] + 8) * 2.0**-22
    near = a.astype(np.float32) @ b.astype(np.float32).T >= np.float32(least - slack)
    rows, columns = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
    if len(rows):
        near[:] = False
        near[np.ix_(rows, columns)] = a[rows] @ b[columns].T >= least
    return near


def forest(mask: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least node that each row (a) and column (b) of mask is connected with inside it."""
    la, lb, none = a.copy(), b.copy(), np.iinfo(np.int64).max
    while True:
        lb2 = np.minimum(lb, np.where(mask, la[:, None], none).min(0, initial=none))
        la2 = np.minimum(la, np.where(mask, lb2[None, :], none).min(1, initial=none))
        if (la2 == la).all() and (lb2 == lb).all():
            return la, lb
        la, lb = la2, lb2


def _dealt(pairs: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks as a and as b of pairs (a, b) of places in the sequence, copied to the places where they meet.

    Places for pairs of groups take the lesser group as a, the other as b. What a block is to meet goes along as numbers.
    """
    group = lambda c: F.pmod(F.col(c), F.lit(GROUPS))
    turned = group("a") > group("b")
    ends = pairs.select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("b"))
    wanted = ends.groupBy(F.col("a").alias("seq")).agg(F.collect_list("b").alias("wanted"))
    held = lambda s: [F.col("seq").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("nodes", "counts", "rows")]]
    last = F.lit(GROUPS - 1).cast("long")
    place = lambda low, high: (low * GROUPS + high).cast("int").alias("place")
    left = blocks.join(wanted.hint("merge"), "seq").withColumn("other", F.explode(F.sequence(group("seq"), last))).select(place(group("seq"), F.col("other")), "wanted", *held("a"))
    right = blocks.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), group("seq")))).select(place(F.col("other"), group("seq")), *held("b"))
    return left, right


def _met(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    """The pairs (a, b) with what their blocks hold; either block of a pair may come as a."""
    left, right = _dealt(pairs, blocks)
    places = 4 * GROUPS * (GROUPS + 1) // 2
    return left.repartition(places, "place").join(right.repartition(places, "place").hint("merge"), "place").where(F.array_contains("wanted", F.col("b"))).drop("place", "wanted")


def near_vectors(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row; links are cosines >= threshold, in double precision.

    Equal vectors are compared as one with a count, so a hot vector costs one row. Null or zero vectors, and those with
    null or non-finite components, link with nothing: 0 links, a component of their own. Rows that repeat an id are one
    node, but every row counts as a link; null ids take no part in links. Shorter vectors end in zeros. A pair of blocks
    returns one row per linked vector, never pairs.
    """
    spark = vectors.sparkSession
    every = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    good = usable(F.col("v")) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    groups = materialize(every.where(good).groupBy("v").agg(F.min("vec_id").alias("node"), F.count("*").alias("n")))
    copies = every.where(good).join(groups, "v").select("vec_id", "node", "n")
    width = widest(groups, "v")
    directions = principal(groups, width) if width else np.zeros((0, 0))
    epsilon = math.sqrt(max(0.0, 2 - 2 * threshold))
    shown = directions.shape[1]
    # Blocks hold the vectors as they came: floats need half the room of unit vectors in doubles.
    kind = np.float32 if groups.schema["v"].dataType.elementType.typeName() == "float" else np.float64

    def placed(frames):
        for f in frames:
            x = units(list(f["v"]), width) @ directions
            cell = np.floor(x / max(epsilon, 1e-9)).astype(np.int64)
            yield pd.DataFrame({"node": f["node"], "n": f["n"], "v": f["v"], "p": list(x)} | {f"c{d}": cell[:, d] for d in range(shown)})

    cells = [f"c{d}" for d in range(shown)]
    schema = f"node long, n long, v {groups.schema['v'].dataType.simpleString()}, p array<double>" + "".join(f", {c} long" for c in cells)
    order = groups.mapInPandas(placed, schema).repartitionByRange(*cells, "node").sortWithinPartitions(*cells, "node").withColumn("part", F.spark_partition_id())

    def cut(frames):
        for at, f in enumerate(chunks(frames, BLOCK)):
            p = np.stack(f["p"].to_numpy())
            x = pad(list(f["v"]), width, kind)
            yield pd.DataFrame({"part": [int(f["part"].iloc[0])], "at": [at], "low": [p.min(0)], "high": [p.max(0)], "nodes": [f["node"].to_numpy(np.int64).tobytes()], "counts": [f["n"].to_numpy(np.int64).tobytes()], "rows": [x.tobytes()]})

    blocks = materialize(order.select("part", "node", "n", "v", "p").mapInPandas(cut, "part int, at int, low array<double>, high array<double>, nodes binary, counts binary, rows binary"))
    # A block's place in the sequence: after the blocks of earlier partitions, whose counts are as many as partitions.
    counts, first = blocks.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect(), []
    for r in counts:
        first.append((r["part"], first[-1][1] + first[-1][2] if first else 0, r["n"]))
    before = spark.createDataFrame(first, "part int, before long, n long").drop("n")
    blocks = blocks.join(F.broadcast(before), "part").withColumn("seq", F.col("before") + F.col("at")).drop("before")
    # Intervals of FAN, FAN ** 2, ... places are its parents.
    boxes = blocks.select("seq", "low", "high")
    levels = [boxes.withColumnRenamed("seq", "id")]
    last = first[-1][1] + first[-1][2] - 1 if first else 0
    while last:
        last //= FAN
        up = levels[-1].withColumn("id", (F.col("id") / FAN).cast("long"))
        bound = lambda f, c: F.array(*[f(F.col(c)[d]) for d in range(shown)]).alias(c)
        levels.append(up.groupBy("id").agg(bound(F.min, "low"), bound(F.max, "high")))

    far = F.zip_with(F.zip_with("low_a", "high_b", lambda x, y: x - y), F.zip_with("low_b", "high_a", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    close = F.aggregate(far, F.lit(0.0), lambda s, x: s + x * x) <= epsilon * epsilon + 1e-9
    box = lambda df, s: df.select(F.col("id").alias(s), F.col("low").alias(f"low_{s}"), F.col("high").alias(f"high_{s}"), (F.col("id") / FAN).cast("long").alias(f"up_{s}"))
    pairs = levels[-1].select(F.col("id").alias("a"), F.col("id").alias("b"))
    for level in reversed(levels[:-1]):
        up = pairs.withColumnsRenamed({"a": "up_a", "b": "up_b"})
        pairs = materialize(up.join(box(level, "a"), "up_a").join(box(level, "b"), "up_b").where((F.col("a") <= F.col("b")) & close).select("a", "b"))

    loaded = _met(pairs, blocks)

    def compare(frames):
        for frame in frames:
            for r in frame.itertuples():
                na, nb = np.frombuffer(r.nodes_a, np.int64), np.frombuffer(r.nodes_b, np.int64)
                ca, cb = np.frombuffer(r.counts_a, np.int64), np.frombuffer(r.counts_b, np.int64)
                a, b = (normalised(np.frombuffer(x, kind).reshape(-1, width)) for x in (r.rows_a, r.rows_b))
                mask = linked(a, b, threshold)
                if r.a == r.b:
                    np.fill_diagonal(mask, False)
                if not mask.any():
                    continue
                la, lb = forest(mask, na, nb)
                out = [(na, mask @ cb, la)] if r.a == r.b else [(na, mask @ cb, la), (nb, ca @ mask, lb)]
                node, links, label = (np.concatenate(x) for x in zip(*out, strict=True))
                hit = links > 0
                yield pd.DataFrame({"node": node[hit], "links": links[hit], "label": label[hit]})

    with arrow_rows(spark, 8):
        found = materialize(loaded.mapInPandas(compare, "node long, links long, label long"))
    labels = components(found.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(copies.select(F.col("vec_id").alias("a"), F.col("node").alias("b"))))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    own = copies.join(links, "node", "left").groupBy("vec_id").agg(F.max(F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")).select(F.col("vec_id").alias("k"), "n_links")
    near = own.join(labels.select(F.col("node").alias("k"), "label"), "k", "left")
    out = every.select("vec_id").join(near, F.col("vec_id") == F.col("k"), "left")
    component = F.coalesce("label", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


#: near_vectors() over embeddings in DuckDB.
ORACLE = """
with recursive v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
z as (select vec_id, e, sqrt(list_dot_product(e, e)) as n from v where list_dot_product(e, e) > 0),
l as (select a.vec_id as a, b.vec_id as b from z a join z b on a.vec_id <> b.vec_id and list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
r as (select vec_id as a, vec_id as b from embeddings union select r.a, l.b from r join l on r.b = l.a),
c as (select a as vec_id, min(b) as component_id from r group by a),
k as (select a as vec_id, count(*) as n from l group by a)
select c.vec_id, coalesce(k.n, 0) as n_links, c.component_id, c.vec_id = c.component_id as kept from c left join k using (vec_id)
"""
