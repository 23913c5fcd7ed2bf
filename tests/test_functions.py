from pyspark.sql import functions as F

from skein.functions import scores, text, vectors


def one(spark, value, schema, expression):
    return spark.createDataFrame([value], schema).select(expression.alias("x")).first().x


def test_code_tokens(spark):
    cases = {
        "getUserById": ["get", "user", "by", "id"], "get-user-by-id": ["get", "user", "by", "id"], "module.component.name": ["module", "component", "name"], "a_b_c_def": ["def"],
        "XMLHttpRequest": ["xml", "http", "request"], "HTTP2": [], "XHttp": ["http"], "": [], "path/to\\File": ["path", "to", "file"], "日本": ["日本"],
    }
    for word, tokens in cases.items():
        assert one(spark, (word,), "t string", text.code_tokens(F.col("t"))) == tokens


def test_recency_buckets(spark):
    for age, weight in ((-5.0, 1.0), (3600.0, 1.0), (3601.0, 0.9), (604800.0, 0.8), (2419201.0, 0.6), (None, 0.6)):
        assert one(spark, (age,), "a double", scores.recency_weight(F.col("a"))) == weight
    assert one(spark, (604801.0,), "a double", scores.recency_weight(F.col("a"), "aggressive")) == 0.2
    assert one(spark, (7776000.0,), "a double", scores.recency_weight(F.col("a"), "mild")) == 0.9


def test_cosine_of_zero_vectors(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    r = df.select(vectors.cosine_search(F.col("a"), F.col("b")).alias("s"), vectors.cosine_guarded(F.col("a"), F.col("b")).alias("g"), vectors.cosine_plain(F.col("a"), F.col("b")).alias("p")).first()
    assert (r.s, r.g, r.p) == (0.0, 0.0, None)


def test_keys_round_trip(spark):
    df = spark.createDataFrame([(0,), (255,), (-1,), (2**63 - 1,), (-(2**63),)], "k long")
    rows = df.select("k", text.hex_key(F.col("k")).alias("h")).withColumn("b", text.key_of_hex(F.col("h"))).collect()
    assert all(r.k == r.b and len(r.h) == 18 for r in rows) and rows[2].h == "0x" + "f" * 16


def test_remotes_routes_and_titles(spark):
    for url in ("git@host.example:Owner/Repo.git", "https://host.example/owner/repo/", "ssh://git@host.example:22/owner/repo.git"):
        assert one(spark, (url,), "u string", text.remote_slug(F.col("u"))) == "host.example/owner/repo"
    assert one(spark, ("src/app/api/users/[id]/route.ts",), "p string", text.route_of_file(F.col("p"))) == "/api/users/:id"
    assert one(spark, ("src/lib/x.ts",), "p string", text.route_of_file(F.col("p"))) is None
    long = "a" * 60 + ". rest\nsecond"
    assert one(spark, (long,), "t string", text.title(F.col("t"))) == "a" * 47 + "..."
    assert one(spark, ("  First one. Second\nthird",), "t string", text.title(F.col("t"))) == "First one"
    uuid = one(spark, ("x",), "s string", text.project_id(F.col("s")))
    assert len(uuid) == 36 and uuid[14] == "4" and uuid[19] in "89ab"


def test_regex_risk(spark):
    for pattern, unsafe in (("(a+)+", True), (r"(?:foo\s+)?bar", False), (r"\bword\b", False), ("(x*y)*", True)):
        assert (one(spark, (pattern,), "p string", text.regex_risk(F.col("p"))) >= text.UNSAFE_FROM) == unsafe


def test_flexible_pattern():
    import re

    p = text.flexible_pattern("JIT index manager")
    assert all(re.search(p, s) for s in ("JITIndexManager", "jit_index_manager", "jit-index-manager", "jit.index.manager"))
    assert text.flexible_pattern("word") is None


def test_embedder_is_deterministic_and_normed(spark):
    df = spark.createDataFrame([("hello world",), ("hello world",), (None,), ("",)], "t string")
    v = [r.x for r in df.select(vectors.hashing_embedder(16)("t").alias("x")).collect()]
    assert v[0] == v[1] and abs(sum(x * x for x in v[0]) - 1) < 1e-6 and set(v[2]) == set(v[3]) == {0.0}


def test_embedder_reads_the_whole_text(spark):
    head = "same " * 400
    df = spark.createDataFrame([(head + "alpha " * 300,), (head + "omega " * 300,)], "t string")
    a, b = [r.x for r in df.select(vectors.hashing_embedder(64)("t").alias("x")).collect()]
    assert a != b
