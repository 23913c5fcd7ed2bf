import json

from pyspark.sql import functions as F

from skein.sources import manifests, scanner, transcripts
from skein.streaming import sessions


def test_scan_a_tree(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.py").write_text('"""Doc."""\nLIMIT = 3\n_hidden = 1\n\n\nclass View:\n    """Shows."""\n\n    def render(self):\n        pass\n\n\n@cache\nasync def load(x):\n    return x\n\n\ndef _own():\n    pass\n')
    (tmp_path / "src/b.ts").write_text("export const x = 1;\nexport async function run() {\n  if (x) {\n  }\n}\nexport interface Row {\n}\n")
    (tmp_path / "src/c.rs").write_text("pub struct Unit;\npub fn go() {\n}\nfn hidden() {}\n")
    (tmp_path / "src/d.py").write_text("def broken(:\n")
    (tmp_path / "node_modules/e.py").write_text("def no(): pass\n")
    files = scanner.read_tree(spark, str(tmp_path), ["py", "ts", "rs"], exclude=("zzz",))
    got = {(r.path.rpartition("/")[2], r.name, r.kind, r.line_start, r.line_end, r.doc) for r in scanner.scan_symbols(files).collect()}
    assert got == {
        ("a.py", "LIMIT", "const", 2, 2, None), ("a.py", "View", "class", 6, 10, "Shows."), ("a.py", "load", "async function", 14, 15, None),
        ("b.ts", "x", "const", 1, 1, None), ("b.ts", "run", "function", 2, 5, None), ("b.ts", "Row", "interface", 6, 7, None), ("c.rs", "Unit", "struct", 1, 1, None), ("c.rs", "go", "fn", 2, 3, None),
    }
    assert scanner.python_components((tmp_path / "src/a.py").read_text()) == ["View"]
    known = files.where("path like '%a.py'").unionByName(files.where("path like '%b.ts'").withColumn("size", F.col("size") + 1))
    assert {r.path.rpartition("/")[2] for r in scanner.stale(files, known).collect()} == {"b.ts", "c.rs", "d.py"}


def test_manifests(spark):
    assert manifests.parse("x/go.mod", "require github.com/a/b v1.0.0\n") == [("github.com/a/b", "v1.0.0", "manifest")]
    assert manifests.parse("x/package-lock.json", json.dumps({"packages": {"": {}, "node_modules/a": {"version": "1"}}})) == [("a", "1", "lock")]
    assert manifests.parse("x/package.json", "{") == [] and manifests.parse("x/other", "") == []


def test_transcripts_stream_and_defer(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    line = lambda ts, item: json.dumps({"type": "assistant", "sessionId": "s", "timestamp": ts, "message": {"content": [item]}})
    (folder / "a.jsonl").write_text("\n".join([line(1, {"type": "tool_use", "id": "t", "name": "Write", "input": json.dumps({"file_path": "a.py"})}), "broken", line(2, {"type": "text", "text": "done"})]))
    stream = transcripts.file_accesses(transcripts.events(transcripts.tail(spark, str(folder))))
    stream.writeStream.format("memory").queryName("t_accesses").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert [tuple(r) for r in spark.table("t_accesses").collect()] == [("s", 1, "a.py", "write")]


def test_debounce_on_a_stream(spark, tmp_path):
    src = tmp_path / "src"
    spark.createDataFrame([("a", 0.0, False), ("a", 1.5, True), ("a", 10.0, False), ("z", 500.0, False)], "path string, s double, reindex boolean").select("path", F.timestamp_seconds("s").alias("ts"), "reindex").write.parquet(str(src))
    stream = spark.readStream.schema("path string, ts timestamp, reindex boolean").parquet(str(src))
    out = sessions.debounced(stream, "2 seconds", "5 seconds").select("path", "n", "reindex")
    out.writeStream.outputMode("append").format("memory").queryName("t_debounced").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(tuple(r) for r in spark.table("t_debounced").collect()) == [("a", 1, False), ("a", 2, True)]


def test_correlation_on_streams(spark, tmp_path):
    for name, column, rows in (("calls", "ts", [("x", 1000.0), ("y", 1001.0)]), ("results", "rts", [("x", 1002.0), ("y", 1500.0)])):
        spark.createDataFrame(rows, "id string, s double").select("id", F.timestamp_seconds("s").alias(column)).write.parquet(str(tmp_path / name))
    read = lambda n, c: spark.readStream.schema(f"id string, {c} timestamp").parquet(str(tmp_path / n)).withWatermark(c, "10 seconds")
    out = sessions.correlated(read("calls", "ts"), read("results", "rts"), "60 seconds").select("id")
    out.writeStream.format("memory").queryName("t_correlated").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert [r.id for r in spark.table("t_correlated").collect()] == ["x"]


def test_routing_starts_threads_below_the_threshold(spark):
    q = spark.createDataFrame([("s", 1, [1.0, 0.0]), ("s", 2, [0.9, 0.1]), ("s", 3, [0.0, 1.0]), ("t", 1, [0.0, 0.0]), ("t", 2, [1.0, 0.0])], "session string, ord int, vector array<double>")
    assert sorted((r.session, r.ord, r.thread) for r in sessions.routed(q).collect()) == [("s", 1, 0), ("s", 2, 0), ("s", 3, 1), ("t", 1, 0), ("t", 2, 1)]
