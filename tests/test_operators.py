import random

from pyspark.sql import functions as F

from skein.operators import code, graph, lexical, memory, patterns, search, taxonomy


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_rrf_prefers_documents_in_both_lists(spark):
    sem = lexical.ranked(spark.createDataFrame([(100, 0.9), (200, 0.8), (300, 0.7)], "key long, score double"), 10)
    lex = lexical.ranked(spark.createDataFrame([(200, 10.0), (400, 8.0), (100, 5.0)], "key long, score double"), 10)
    out = {r.key: (r.score, r.source) for r in lexical.rrf(sem, lex).collect()}
    assert max(out, key=lambda k: out[k][0]) == 200 and out[200] == (1 / 62 + 1 / 61, "both")
    assert out[300][1] == "semantic" and out[400][1] == "lexical"
    empty = sem.where("false")
    assert lexical.rrf(empty, empty).count() == 0 and lexical.rrf(sem, empty).count() == 3


def test_hybrid_fast_path(spark):
    sem = spark.createDataFrame([(1, 0.9)], "key long, score double")
    lex = spark.createDataFrame([(2, 13.0), (3, 1.0)], "key long, score double")
    assert {r.source for r in lexical.hybrid(sem, lex, 5).collect()} == {"lexical"}
    assert {r.key for r in lexical.hybrid(sem, lex, 5, fast_from=20.0).collect()} == {1, 2, 3}
    assert [r.key for r in lexical.hybrid(sem, lex.where("false"), 5).collect()] == [1]


def test_bm25_orders_by_rarity_and_frequency(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha alpha alpha"), (3, "gamma"), (4, None)], "key long, content string")
    out = {r.key: r.score for r in lexical.bm25(docs, ["alpha", "gamma"]).collect()}
    stored = {r.key: r.score for r in lexical.bm25_of_postings(lexical.postings(docs), ["alpha", "gamma"]).collect()}
    assert out.keys() == stored.keys() and all(abs(out[k] - s) < 1e-12 for k, s in stored.items())
    assert set(out) == {1, 2, 3} and out[2] > out[1]


def test_recency_reorders(spark):
    df = spark.createDataFrame([(1, 0.5, 3e7), (2, 0.5, 1800.0), (3, 0.5, 600000.0), (4, 0.5, None)], "key long, score double, age double")
    out = {r.key: r.score for r in lexical.with_recency(df, F.col("age")).collect()}
    assert out[2] > out[3] > out[1] and out[4] == 0.4
    flat = {r.key: r.score for r in lexical.with_recency(df, F.col("age"), normalise=True).collect()}
    assert flat == {1: 0.6, 2: 1.0, 3: 0.8, 4: 0.6}


def test_truncation_cuts_the_lowest_scores_first(spark):
    df = spark.createDataFrame([(k, float(k), "x" * 300) for k in range(4)], "key long, score double, content string")
    out = {r.key: len(r.content) for r in search.truncated(df, 900).collect()}
    assert out == {0: 65, 1: 65, 2: 300, 3: 300}


def test_grep_tiers_prefer_changed_files(spark):
    df = spark.createDataFrame([("a", "tracked", "needle"), ("b", "unstaged", "needle"), ("c", "tracked", "other")], "path string, status string, content string")
    assert rows(search.grep_tiers(df, "needle")) == [("a", 3), ("b", 1)]


def test_memory_filters(spark):
    df = spark.createDataFrame([(1, "t", ["a", "b"], [], ["x"], 1.0), (2, "t", ["a"], [], ["x", "y"], 2.0), (3, "u", [], [], [], 3.0)], "id long, task string, context array<string>, insights array<string>, tags array<string>, created_at double")
    assert [r.id for r in memory.query_memories(df).collect()] == [3, 2, 1]
    assert [r.id for r in memory.query_memories(df, contexts=["a", "b"]).collect()] == [1]
    assert [r.id for r in memory.query_memories(df, tags=["x"], limit=1, offset=1).collect()] == [1]


def test_eviction_leaves_room_for_one(spark):
    df = spark.createDataFrame([(i, i, 0.0, None) for i in range(5)], "id long, access_count long, created_at double, last_accessed double")
    assert sorted(r.id for r in memory.evicted(df, 4, F.lit(10.0)).collect()) == [2, 3, 4]
    assert memory.evicted(df, 10, F.lit(10.0)).count() == 5


def test_graph_versions_and_diff(spark):
    log = spark.createDataFrame([("a", 1.0, "n", "s", "1"), ("a", 3.0, "n", "s", "2"), ("b", 3.0, "n", "s", "1")], "id string, ts double, type string, scope string, payload string")
    nodes = graph.node_versions(log)
    assert rows(nodes.select("id", "payload", "rev", "created_ts")) == [("a", "2", 2, 1.0), ("b", "1", 1, 3.0)]
    edges = graph.edge_versions(spark.createDataFrame([("a", "r", "b", 1.0, False), ("a", "r", "b", 3.0, True), ("b", "r", "a", 3.0, False), ("c", "r", "a", 1.0, True), ("c", "r", "a", 2.0, False)], "src string, rel string, dst string, ts double, tombstone boolean"))
    assert rows(graph.diff_since(nodes, edges, 2.5)) == [("edge_added", "b|r|a"), ("edge_deleted", "a|r|b"), ("node_added", "b"), ("node_updated", "a")]
    assert rows(graph.neighbours(edges, "a", "in").select("other")) == [("b",), ("c",)]
    assert graph.neighbours(edges, "a", "in", "unknown").count() == 0


def test_reach_of_random_graphs(spark):
    rng = random.Random(1)
    pairs = {(rng.randint(0, 30), rng.randint(0, 30)) for _ in range(40)}
    depth, frontier = {0: 0}, [0]
    for d in range(1, 5):
        frontier = [y for x in frontier for a, b in pairs for y in ([b] if a == x else []) + ([a] if b == x else []) if y not in depth and not depth.update({y: d})]
    edges = spark.createDataFrame(list(pairs), "src long, dst long").withColumn("tombstone", F.lit(False))
    assert {r.node: r.depth for r in graph.reach(edges, spark.range(1).toDF("node"), 4).collect()} == depth


def test_relations_keep_builtin_ids(spark):
    names = spark.createDataFrame([("calls", 5.0), ("zeta", 1.0), ("alpha", 2.0), ("zeta", 3.0)], "name string, ts double")
    assert rows(graph.interned(names)) == [("alpha", 1001), ("calls", 3), ("zeta", 1000)]


def test_call_sites_skip_definitions_and_take_the_last_symbol(spark):
    symbols = spark.createDataFrame([("a.py", "helper", "function", 1), ("b.py", "helper", "function", 3), ("a.py", "len", "function", 2)], "path string, name string, kind string, line int")
    files = spark.createDataFrame([("a.py", "def helper():\n  len(x)"), ("b.py", "helper()\n\ndef helper():\n")], "path string, content string")
    assert rows(code.call_sites(symbols, files)) == [("a.py", "helper", "b.py", 1), ("b.py", "helper", "b.py", 1)]


def test_memory_extraction_reasons(spark):
    turns = spark.createDataFrame([(1, "s", 1, "short", False), (2, "s", 2, "x" * 80, False), (3, "s", 3, "We decided to use it. " * 5, False), (4, "s", 4, "we decided to use it " * 5, False), (5, "s", 5, "maybe " * 20, False)], "key long, session string, ord int, text string, explores boolean")
    weights = [("insight:decision", "(?i)decided to", 0.4), ("insight:maybe", "maybe", 0.1)]
    out = {r.key: r.skip_reason for r in patterns.extract_memories(turns, weights).collect()}
    assert out == {1: "text_too_short", 2: "no_patterns_matched", 3: None, 4: "duplicate", 5: "below_confidence_threshold"}


def test_greedy_dedupe_keeps_the_first(spark):
    items = spark.createDataFrame([("g", 1, 10, [1.0, 0.0]), ("g", 2, 11, [1.0, 0.01]), ("g", 3, 12, [0.0, 1.0])], "grp string, ord int, key long, vector array<double>")
    assert rows(taxonomy.greedy_distinct(items, "grp")) == [("g", 10), ("g", 12)]


def test_knn_by_blocks_equals_brute_force_without_a_cross_join(spark):
    import numpy as np

    from skein.operators import search

    x = np.random.default_rng(5).normal(0, 1, (90, 4))
    x[40:60] = x[3]
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(900, None), (901, [1.0])], "key long, vector array<float>")
    q = v.where("key % 7 = 0").selectExpr("key as query", "vector as q")
    out = search.knn(q, v, 5, block=16)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    f = x.astype(np.float32).astype(float)
    for i in range(0, 90, 7):
        s = np.round(f @ f[i] / (np.linalg.norm(f, axis=1) * np.linalg.norm(f[i]) + 1e-9), 12)
        want = sorted(range(90), key=lambda j: (-s[j], j))[:5]
        assert [r.key for r in sorted(out.where(f"query = {i}").collect(), key=lambda r: r["rank"])] == want
