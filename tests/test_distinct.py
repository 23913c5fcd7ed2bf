"""Greedy distinct items against a walk in order, and the halves of large categories against a plain two-means."""

import random

import numpy as np
import pytest

from skein.operators.taxonomy import greedy_distinct, halves, refine


def walk(rows, threshold):
    kept, out = {}, set()
    for g, o, k, v in sorted(rows, key=lambda r: (r[1], r[2])):
        if v is None or not any(v):
            out.add((g, k))
            continue
        v = np.array(v) / (np.linalg.norm(v) + 1e-9)
        if all(float(w @ v) < threshold for w in kept.setdefault(g, [])):
            kept[g].append(v)
            out.add((g, k))
    return out


@pytest.mark.parametrize(("threshold", "size"), [(0.5, 16), (0.9, 8)])
def test_greedy_distinct_equals_a_walk(spark, threshold, size):
    rng = random.Random(2)
    rows = []
    for i in range(260):
        g = rng.choice(["a", "a", "a", "b", "c"])
        v = [rng.gauss(0, 1) for _ in range(3)]
        rows.append((g, rng.randint(0, 99), i, rng.choice([v, v, v, rows[-1][3] if rows else v, None, [0.0] * 3])))
    rows.append(("d", 1, 1000, [1.0, 0.0, 0.0]))
    out = greedy_distinct(spark.createDataFrame(rows, "grp string, ord long, key long, vector array<double>"), "grp", threshold, size)
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == walk(rows, threshold)
    assert greedy_distinct(spark.createDataFrame([], "grp string, ord long, key long, vector array<double>"), "grp").count() == 0


def plain_halves(vectors, rounds=10):
    """Two-means over the cosine from the first item and the one least like it: sets of keys, that of the least first."""
    cos = lambda x, y: round(float(x @ y / (np.linalg.norm(x) * np.linalg.norm(y))), 9)
    keys = sorted(vectors)
    a = vectors[keys[0]]
    b = vectors[min(keys, key=lambda k: (cos(vectors[k], a), k))]
    for _ in range(rounds):
        side = {k: cos(vectors[k], b) > cos(vectors[k], a) for k in keys}
        parts = [[k for k in keys if side[k] is s] for s in (False, True)]
        a, b = (np.mean([vectors[k] for k in p], axis=0) for p in parts)
    return sorted(parts), a, b


def test_large_categories_are_cut_in_halves(spark):
    rng = np.random.default_rng(3)
    at = {"wide": [(1, 0.2, 0), (0.2, 1, 0)], "tight": [(0, 0, 1)], "small": [(1, 1, 1)]}
    vectors, classes = {}, []
    for c, centres in at.items():
        for i in range({"wide": 60, "tight": 40, "small": 8}[c]):
            k = len(vectors)
            vectors[k] = np.array(centres[i % len(centres)]) + rng.normal(0, 0.05, 3)
            classes.append((k, c, 1.0))
    items = spark.createDataFrame([(k, f"name{k}", v.tolist()) for k, v in vectors.items()] + [(999, "none", None)], "key long, name string, vector array<double>")
    frame = spark.createDataFrame([*classes, (999, "wide", 1.0)], "key long, category string, score double")
    taxonomy = spark.createDataFrame([(c, [float(x) for x in centres[0]]) for c, centres in at.items()], "category string, centre array<double>")
    out = {r.category: r for r in halves(items, frame, taxonomy).collect()}
    assert sorted(out) == ["wide-1", "wide-2"] and {r.of for r in out.values()} == {"wide"}
    (low, high), *_ = plain_halves({k: vectors[k] for k, c, _ in classes if c == "wide"})
    for name, part in (("wide-1", low), ("wide-2", high)):
        assert np.allclose(out[name].centre, np.mean([vectors[k] for k in part], axis=0))
    refined, _ = refine(items.where("vector is not null"), taxonomy, 3, split_above=20)
    assert {"wide-1", "wide-2"} <= {r.category for r in refined.collect()}
    assert halves(items.where("false"), frame, taxonomy).count() == 0


def test_a_worker_gets_few_pairs_of_blocks_at_a_time(spark, monkeypatch):
    from skein.operators import taxonomy

    key, seen, write = "spark.sql.execution.arrow.maxRecordsPerBatch", [], taxonomy.written
    before = spark.conf.get(key)
    monkeypatch.setattr(taxonomy, "written", lambda df: (seen.append(int(spark.conf.get(key))), write(df))[1])
    items = spark.createDataFrame([("g", i, i, [1.0, i / 10]) for i in range(20)], "grp string, ord int, key int, vector array<double>")
    assert taxonomy.greedy_distinct(items, "grp", 0.99, size=4).count() > 1
    assert seen and max(seen) <= 8
    assert spark.conf.get(key) == before


def test_refining_classifies_once_a_round(spark, monkeypatch):
    from skein.operators import taxonomy

    plans, metrics = [], taxonomy.metrics
    monkeypatch.setattr(taxonomy, "metrics", lambda classes, total: (plans.append(classes._jdf.queryExecution().optimizedPlan().toString()), metrics(classes, total))[1])
    items = spark.createDataFrame([(i, f"word{'ab'[i % 2] * 3} thing", [float(i % 2), 1.0]) for i in range(12)], "key long, name string, vector array<double>")
    start = spark.createDataFrame([("first", [1.0, 0.0])], "category string, centre array<double>")
    taxonomy.refine(items, start, 2, split_above=4)
    assert plans and all("Generate" not in p for p in plans)
