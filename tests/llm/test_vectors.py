"""Corpus operators on vectors against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA)


def mixed(seed, n=260, dim=12):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(9)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        spread = rng.choice([0.05, 0.2, 1.0])
        rows.append((i, [float(np.float32(rng.choice([1, 1, 3]) * (x + rng.gauss(0, spread)))) for x in c]))
    rows += [(n + k, rows[0][1]) for k in range(60)]
    rows += [(900, None), (901, [float("nan")] * dim), (902, [float("inf")] + [0.0] * (dim - 1)), (903, [0.0] * dim), (904, [None] + [1.0] * (dim - 1)), (906, [1.0, 2.0]), (905, [])]
    return rows


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def wide(v, dim=12):
    return np.array(list(v) + [0.0] * (dim - len(v)))


def test_top_products_equal_brute_force(spark):
    from skein.llm.exact_topk import top_products

    rows = mixed(1)
    got = {}
    for r in top_products(vectors(spark, rows), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    q = {i: np.floor(64 * wide(v)).astype(np.int64) for i, v in rows if good(v)}
    for i in (i for i in q if i % 20 == 0):
        best = sorted(((-int(q[i] @ x), j) for j, x in q.items() if j != i))[:20]
        assert sorted(got[i]) == [(n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert set(got) == {i for i in q if i % 20 == 0}
    assert top_products(vectors(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    few = top_products(vectors(spark, [(0, [1.0]), (1, [2.0]), (2, None)]), F.col("vec_id") % 20 == 0).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in few] == [(0, 1, 1, 64 * 128)]


@pytest.mark.parametrize("broadcast", ["-1", "10m"])
def test_rows_of_hits_grow_with_the_queries_under_any_join(spark, monkeypatch, broadcast):
    from skein.llm import exact_topk

    for name, value in (("BUCKET", 32), ("QUERIES", 32), ("HEAD", 64)):
        monkeypatch.setattr(exact_topk, name, value)
    made, write = [], exact_topk.materialize

    def counted(df, *args):
        out = write(df, *args)
        if "score" in out.columns:
            made[-1] += out.count()
        return out

    monkeypatch.setattr(exact_topk, "materialize", counted)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        for n in (1000, 5000):
            x = np.random.default_rng(n).normal(0, 1, (n, 12))
            x /= np.linalg.norm(x, axis=1)[:, None]
            made.append(0)
            rows = exact_topk.top_products(vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)]), F.col("vec_id") % 20 == 0, 5).collect()
            assert len(rows) == n // 20 * 5
            q = np.floor(64.0 * x.astype(np.float32)).astype(np.int64)
            for i in (0, 20):
                best = sorted(((-int(q[i] @ q[j]), j) for j in range(n) if j != i))[:5]
                assert [(r.vec_id, r.score) for r in sorted((r for r in rows if r.query_id == i), key=lambda r: r.rank)] == [(j, -s) for s, j in best]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert made[1] < 6 * made[0], made


def test_coordinate_pruning_keeps_every_hit():
    from skein.llm.exact_topk import norms, survivors

    rng = np.random.default_rng(3)
    p = rng.normal(0, 40, (400, 8)).astype(np.int64)
    p = p[np.argsort(-norms(p))]
    length = norms(p)
    unit = p / length[:, None]
    for _ in range(60):
        q = p[rng.integers(0, 400)].astype(float) + rng.normal(0, 5, 8)
        s = p @ q
        bound = float(np.sort(s)[-rng.integers(1, 30)])
        keep = survivors(q, float(np.sqrt(q @ q)), bound, unit, length)
        assert set(np.flatnonzero(s >= bound)) <= set(keep)


def test_products_beyond_doubles_are_exact():
    from skein.llm.exact_topk import products

    a = np.array([[2**40 + 1, 3]])
    assert products(a, np.array([[2**20 + 1, 5]]))[0, 0] == (2**40 + 1) * (2**20 + 1) + 15


def test_near_vectors_equal_brute_force(spark, monkeypatch):
    from skein.llm import near_vectors

    rows = mixed(2)
    monkeypatch.setattr(near_vectors, "BLOCK", 40)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors.near_vectors(vectors(spark, rows)).collect()}
    unit = {i: wide(v) / np.linalg.norm(wide(v)) for i, v in rows if good(v) and any(v)}
    ids = sorted(unit)
    x = np.stack([unit[i] for i in ids])
    link = x @ x.T >= 0.9
    np.fill_diagonal(link, False)
    label = np.array(ids)
    while True:
        new = np.minimum(label, np.where(link, label[None, :], 10**9).min(1))
        if (new == label).all():
            break
        label = new
    want = {i: (int(n), int(c), i == c) for i, n, c in zip(ids, link.sum(1), label, strict=True)}
    want |= {i: (0, i, True) for i, _ in rows if i not in want}
    assert got == want
    assert near_vectors.near_vectors(vectors(spark, [])).count() == 0
    assert [tuple(r) for r in near_vectors.near_vectors(vectors(spark, [(7, None), (7, None)])).collect()] == [(7, 0, 7, True)] * 2


def test_repeated_vector_rows_count_as_links(spark):
    from skein.llm.near_vectors import near_vectors

    out = near_vectors(vectors(spark, [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.01]), (None, [1.0, 0.0])])).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id) for r in out) == [(0, 0, None), (1, 2, 1), (1, 2, 1), (2, 2, 1)]


def blocks_of(spark, columns, n=12):
    return spark.createDataFrame([(i, *[bytearray(b"x" * 40)] * (len(columns) - 1)) for i in range(n)], f"{columns[0]} long, " + ", ".join(f"{c} binary" for c in columns[1:]))


def test_blocks_of_vectors_are_never_broadcast(spark):
    """As compressed files they look small; as rows they filled the driver."""
    from skein.llm import exact_topk

    queries = blocks_of(spark, ["block", "q_ids", "q_rows", "bounds"]).withColumn("need", F.lit(0.0))
    data = blocks_of(spark, ["at", "ids", "rows"]).select(F.lit(1.0).alias("longest"), "ids", "rows")
    met = exact_topk._met(queries, data)
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
    assert met.count() == 144


@pytest.mark.parametrize("top", [3, 300, 70_000, 1 << 40])
def test_packed_rows_come_back_whole(top):
    from skein.llm.exact_topk import packed, unpacked

    x = np.array([[top, -top, 0], [1, 2, -1]], dtype=np.int64)
    assert (unpacked(packed(x), 2, 3) == x).all()
    assert len(packed(x)) <= 6 * (1 if top < 128 else 2 if top < 32_768 else 4 if top < 1 << 31 else 8)
    assert unpacked(packed(np.zeros((2, 0), dtype=np.int64)), 2, 0).shape == (2, 0)


def test_a_block_travels_to_a_fixed_number_of_places(spark):
    from skein.llm import near_vectors

    for n in (12, 40):
        blocks = blocks_of(spark, ["seq", "nodes", "counts", "rows"], n)
        pairs = spark.createDataFrame([(a, b) for a in range(n) for b in range(a, n) if (a + b) % 3], "a long, b long")
        met = near_vectors._met(pairs, blocks)
        assert {(min(r.a, r.b), max(r.a, r.b)) for r in met.select("a", "b").collect()} == {(r.a, r.b) for r in pairs.collect()}
        assert met.count() == pairs.count()
        left, right = near_vectors._dealt(pairs, blocks)
        assert left.count() + right.count() == (near_vectors.GROUPS + 1) * n
