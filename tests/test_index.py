import pytest
from pyspark.sql import functions as F

from skein.operators import index


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_upserts_take_the_newest_and_incoming_rows_win_ties(spark):
    old = spark.createDataFrame([("a", 1, "old"), ("b", 5, "old"), ("c", 2, "old")], "k string, v int, x string")
    new = spark.createDataFrame([("a", 1, "new"), ("b", 4, "new"), ("d", 1, "new")], "k string, v int, x string")
    assert rows(index.upserted(old, new, "k", "v")) == [("a", 1, "new"), ("b", 5, "old"), ("c", 2, "old"), ("d", 1, "new")]
    assert rows(index.deleted(old, new, "k")) == [("c", 2, "old")]


def test_registering_files(spark):
    files = spark.createDataFrame([("a.py", "py", "def login():\n    # TODO: jwt\n    assert login\n"), ("b.txt", "txt", "")], "path string, ext string, content string")
    out = index.register(files)
    assert rows(out["contexts"]) == [("a.py", "context:auth", 3)]
    assert rows(out["insights"].select("key", "type_id", "line")) == [("a.py", "insight:todo", 2)]
    assert rows(out["symbols"].select("name")) == [("login",)] and out["files"].count() == 2


def test_secret_policies(spark):
    m = spark.createDataFrame([(1, "mail me@host.example now"), (2, "clean")], "id int, text string")
    assert rows(index.written(m, "redact").select("text")) == [("clean",), ("mail [REDACTED:email] now",)]
    assert rows(index.written(m, "warn").select("id", "has_secrets")) == [(1, True), (2, False)]
    with pytest.raises(Exception, match="holds a secret"):
        index.written(m, "reject").collect()


def test_ema_centroids_fold_in_order(spark):
    q = spark.createDataFrame([("t", 2, [0.0, 1.0]), ("t", 1, [1.0, 0.0]), ("u", 1, [2.0, 2.0])], "thread string, ord int, vector array<float>")
    out = {r.thread: [round(x, 6) for x in r.centre] for r in index.ema_centroids(q).collect()}
    assert out == {"t": [0.7, 0.3], "u": [2.0, 2.0]}


def test_bucketed_index_and_compaction(spark, tmp_path):
    table = spark.range(100).withColumn("x", F.col("id") % 7)
    index.compacted(table, str(tmp_path / "t"), 10)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 100
