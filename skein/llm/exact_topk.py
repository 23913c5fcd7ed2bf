"""Exact top-k inner products by norm-bucketed retrieval (after LEMP; Teflioudi and others, 2015).

Vectors of like length share a bucket. A query carries a lower bound of its k-th score, from the longest vectors. For a
bucket whose longest vector has length l, the query's local cosine threshold is t = bound / (|q| * l): above 1 the bucket
is skipped as a whole; a high t prunes by coordinates, keeping vectors whose unit coordinates lie in the feasible
interval of each of the query's largest coordinates; a low t prunes by length, keeping the vectors that are long enough.
What is left is verified by whole inner products of integers.

Queries meet the buckets in rounds: first a few buckets, then eight times as many, and so on. Each round raises the lower
bounds to the k-th score so far, so that in the next one only about eight times k vectors per query pass, whatever the
number of buckets, of tasks or the way Spark joins: what is shuffled grows with the number of queries. Blocks travel as
the narrowest integers that hold them, and are never broadcast: as files they are far smaller than as rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.blocks import arrow_rows, chunks, pad, usable, widest
from skein.llm.common import materialize

BUCKET, QUERIES, HEAD = 1024, 512, 2048
#: Each round has so many times the buckets of all before; the first one has as many at most.
GROWTH = 8
#: From this local cosine threshold on coordinates prune; below it only lengths do.
COORDINATES_FROM, FOCUS = 0.4, 4
#: Spark's floor() ends at the limits of long, so components beyond 2**62 are cut there.
TOP = 1 << 62
#: A block of queries meets the blocks of vectors in so many places at most, so copies of it grow no faster than queries.
PLACES = 64


def quantised(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.least(F.greatest(F.floor(F.lit(64.0) * x.cast("double")).cast("long"), F.lit(-TOP)), F.lit(TOP)))


def packed(x: np.ndarray) -> bytes:
    """Rows of integers as bytes, in the narrowest kind that holds all of them."""
    low, high = int(x.min(initial=0)), int(x.max(initial=0))
    return x.astype(next(k for k in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(k).min <= low and high <= np.iinfo(k).max)).tobytes()


def unpacked(rows: bytes, n: int, width: int) -> np.ndarray:
    return np.frombuffer(rows, f"i{len(rows) // (n * width)}" if n * width else np.int64).reshape(n, width).astype(np.int64)


def products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact integer inner products: by doubles where no partial sum reaches 2**53, else by Python's integers."""
    bound = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(p.astype(np.float64)).max(initial=0)) * max(1, q.shape[1])
    if bound < 2.0**53:
        return (q.astype(np.float64) @ p.astype(np.float64).T).astype(np.int64)
    exact = q.astype(object) @ p.astype(object).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def norms(x: np.ndarray) -> np.ndarray:
    """Lengths, rounded up a little so that bounds hold."""
    return np.sqrt((x.astype(np.float64) ** 2).sum(1)) * (1 + 1e-12)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= least)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]


def survivors(q: np.ndarray, q_norm: float, bound: float, unit: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Rows of a bucket that may reach bound with q; length falls along the rows."""
    if bound <= 0 or q_norm == 0:
        return np.arange(len(length)) if bound <= 0 else np.zeros(0, dtype=np.int64)
    rows = int(np.searchsorted(-length, -bound / q_norm, side="right"))
    t = bound / (q_norm * length[0])
    if rows == 0 or t > 1:
        return np.zeros(0, dtype=np.int64)
    if t < COORDINATES_FROM:
        return np.arange(rows)
    direction = q / q_norm
    mask = np.ones(rows, dtype=bool)
    for f in np.argsort(-np.abs(direction))[:FOCUS]:
        centre = direction[f] * t
        # A vector shorter than the bucket's longest needs an even larger cosine, so t is a safe threshold for all.
        reach = np.sqrt(max(0.0, (1 - direction[f] ** 2) * (1 - t * t))) + 1e-9
        low = centre - reach if direction[f] > -t else -1.0
        high = centre + reach if direction[f] < t else 1.0
        mask &= (unit[:rows, f] >= low) & (unit[:rows, f] <= high)
    return np.flatnonzero(mask)


def long_enough(q_norm: np.ndarray, bound: np.ndarray, length: np.ndarray) -> np.ndarray:
    """How many rows of a bucket, whose lengths fall, are long enough for each query; 0 where the bucket is skipped."""
    need = np.where(bound > 0, bound / np.maximum(q_norm, 1e-300), -np.inf)
    return np.searchsorted(-length, -need, side="right")


def worth_focus(q: np.ndarray, q_norm: np.ndarray, bound: np.ndarray, unit: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Queries for which a feasible interval leaves out about a quarter of a bucket or more; for others coordinates cost
    more than they save, and lengths alone prune."""
    t = bound / np.maximum(q_norm * length[0], 1e-300)
    out = (bound > 0) & (t >= COORDINATES_FROM) & (t <= 1)
    if not out.any():
        return out
    low, high = np.quantile(unit[:: max(1, len(unit) // 128)], [0.25, 0.75], axis=0)
    direction = q / np.maximum(q_norm, 1e-300)[:, None]
    f = np.argsort(-np.abs(direction), axis=1)[:, :FOCUS]
    d, t = np.take_along_axis(direction, f, 1), np.clip(t, 0, 1)[:, None]
    reach = np.sqrt(np.maximum(0.0, (1 - d * d) * (1 - t * t)))
    return out & (((d > -t) & (d * t - reach > low[f])) | ((d < t) & (d * t + reach < high[f]))).any(1)


def reaching(q: np.ndarray, q_ids: np.ndarray, bound: np.ndarray, p: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query id, vector id, score of the at most k best rows of each query that reach its bound, never its own id."""
    s = products(q, p)
    at, row = np.nonzero((s >= bound[:, None]) & (ids != q_ids[:, None]))
    keep = np.ones(len(at), dtype=bool)
    first = np.searchsorted(at, np.arange(len(q) + 1))
    for i in np.flatnonzero(np.diff(first) > k):
        mine = slice(first[i], first[i + 1])
        keep[mine] = False
        keep[first[i] + best(s[i, row[mine]], ids[row[mine]], k)] = True
    at, row = at[keep], row[keep]
    return q_ids[at], ids[row], s[at, row]


def top_products(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products with other ids, ties to smaller ids.

    Unusable vectors and null ids take no part; a query with fewer than k others gets all. Shorter vectors end in zeros.
    Rows that repeat an id are candidates each, but never of their own id. Blocks of queries meet blocks of vectors only
    where the lengths allow a hit; there are as many places for that as blocks of vectors ask for, PLACES at most, and a
    task compares one pair of blocks at a time.
    """
    spark = vectors.sparkSession
    base = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col)).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    base = base.withColumn("n2", F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    base = materialize(base)
    width = widest(base, "v")
    top = base.orderBy(F.col("n2").desc(), "id").limit(HEAD).select("id", "v").collect()
    head_ids = np.array([r["id"] for r in top], dtype=np.int64)
    head = spark.sparkContext.broadcast((head_ids, pad([r["v"] for r in top], width, np.int64)))

    def data_blocks(frames):
        for f in chunks(frames, BUCKET):
            x = pad(list(f["v"]), width, np.int64)
            yield pd.DataFrame({"longest": [float(norms(x).max(initial=0))], "ids": [f["id"].to_numpy(np.int64).tobytes()], "rows": [packed(x)]})

    def query_blocks(frames):
        ids_h, x_h = head.value
        base, at = TaskContext.get().partitionId() << 32, 0
        for f in chunks(frames, QUERIES):
            x, ids = pad(list(f["v"]), width, np.int64), f["id"].to_numpy(np.int64)
            s = products(x, x_h)
            bound = np.full(len(ids), -np.inf)
            for i in range(len(ids)):
                others = s[i][ids_h != ids[i]]
                if len(others) >= k:
                    bound[i] = np.partition(others, len(others) - k)[len(others) - k]
            at += 1
            yield pd.DataFrame({"block": [base + at], "need": [need_of(x, bound)], "q_ids": [ids.tobytes()], "q_rows": [packed(x)], "bounds": [bound.tobytes()]})

    ordered = lambda df: df.repartitionByRange(F.col("n2").desc(), F.col("id")).sortWithinPartitions(F.col("n2").desc(), F.col("id")).select("id", "v")
    data = materialize(ordered(base).mapInPandas(data_blocks, "longest double, ids binary, rows binary"))
    queries = materialize(ordered(base.where("asks")).mapInPandas(query_blocks, QUERY_BLOCK))
    rounds = 1
    while GROWTH**rounds < data.count():
        rounds += 1
    draw = F.pmod(F.xxhash64("ids", F.lit(1)), F.lit(GROWTH ** (rounds - 1)))
    hits = None
    for i in range(rounds):
        # The blocks whose draw GROWTH ** (rounds - 1 - i) divides and no greater power that an earlier round had.
        new = draw % (GROWTH ** (rounds - 1 - i)) == 0
        own = data.where(new if i == 0 else new & (draw % (GROWTH ** (rounds - i)) != 0))
        with arrow_rows(spark, 16):
            found = materialize(_met(queries, own).mapInPandas(_scanner(width, k), "block long, query_id long, vec_id long, score long"))
        if hits is not None:
            found = found.unionByName(hits)
        best_of = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        ranked = found.withColumn("rank", F.row_number().over(best_of).cast("int")).where(F.col("rank") <= k)
        if i == rounds - 1:
            return ranked.select("query_id", "rank", "vec_id", "score")
        hits = materialize(ranked)
        raised = hits.where(F.col("rank") == k).groupBy("block").agg(F.collect_list(F.struct("query_id", "score")).alias("raised"))
        hits = hits.drop("rank")
        with arrow_rows(spark, 16):
            queries = materialize(queries.join(raised.hint("merge"), "block", "left").mapInPandas(_raiser(width), QUERY_BLOCK))


QUERY_BLOCK = "block long, need double, q_ids binary, q_rows binary, bounds binary"


def need_of(x: np.ndarray, bound: np.ndarray) -> float:
    """The length that a vector needs to be of use to any of a block's queries."""
    need = np.where(bound > 0, bound / np.maximum(norms(x), 1e-300), 0.0)
    return float(need.min(initial=np.inf)) * (1 - 1e-9)


def _met(queries: DataFrame, data: DataFrame) -> DataFrame:
    """Pairs of blocks. Every block of queries goes to every place, a block of vectors to one: the stated queries against
    all rows. A place has some blocks of vectors."""
    places = min(PLACES, max(8, data.count() // 4))
    wide = queries.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(places - 1)))).repartition(places, "place")
    own = data.withColumn("place", F.pmod(F.xxhash64("ids"), F.lit(places)).cast("int")).repartition(places, "place")
    return wide.join(own.hint("merge"), "place").where("longest >= need").drop("place", "need", "longest")


def _scanner(width: int, k: int):
    """The at most k vectors of a block of vectors that reach each query's bound, for pairs of blocks."""

    def scan(frames):
        for frame in frames:
            for r in frame.itertuples():
                q_ids, ids = np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.ids, np.int64)
                q, bounds = unpacked(r.q_rows, len(q_ids), width), np.frombuffer(r.bounds, np.float64)
                p = unpacked(r.rows, len(ids), width)
                q_norm, length = norms(q), norms(p)
                unit, out = p / np.maximum(length, 1e-300)[:, None], []
                focused = worth_focus(q, q_norm, bounds, unit, length)
                for i in np.flatnonzero(focused):
                    rows = survivors(q[i].astype(np.float64), q_norm[i], bounds[i], unit, length)
                    if len(rows):
                        out.append(reaching(q[i : i + 1], q_ids[i : i + 1], bounds[i : i + 1], p[rows], ids[rows], k))
                # The others keep what is long enough, so they meet the longest rows at once.
                enough = long_enough(q_norm, bounds, length)
                at = np.flatnonzero(~focused & (enough > 0))
                if len(at):
                    rows = enough[at].max()
                    out.append(reaching(q[at], q_ids[at], bounds[at], p[:rows], ids[:rows], k))
                out = [x for x in out if len(x[0])]
                if out:
                    yield pd.DataFrame({"block": r.block} | {n: np.concatenate(x) for n, x in zip(("query_id", "vec_id", "score"), zip(*out, strict=True), strict=True)})

    return scan


def _raiser(width: int):
    """Blocks of queries with bounds raised to the k-th scores that are known."""

    def lift(frames):
        for frame in frames:
            for r in frame.itertuples():
                q_ids, bounds = np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.bounds, np.float64)
                known = {x["query_id"]: float(x["score"]) for x in (r.raised if r.raised is not None else [])}
                # Whole numbers beyond 2**53 may be rounded up; the bound stays below.
                bounds = np.array([max(b, np.nextafter(known[q], -np.inf)) if q in known else b for q, b in zip(q_ids.tolist(), bounds.tolist(), strict=True)])
                x = unpacked(r.q_rows, len(q_ids), width)
                yield pd.DataFrame({"block": [r.block], "need": [need_of(x, bounds)], "q_ids": [r.q_ids], "q_rows": [r.q_rows], "bounds": [bounds.tobytes()]})

    return lift


#: top_products() over embeddings in DuckDB, for vectors of one width.
ORACLE = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as q from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as query_id, b.vec_id, list_dot_product(a.q, b.q)::bigint as score from v a join v b on a.vec_id % 20 = 0 and a.vec_id <> b.vec_id),
r as (select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score from s)
select * from r where rank <= 20
"""
