"""Keyed state and stored tables on streams, against plain folds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.streaming import state
from skein.streaming.store import KeyedStore, upsert_stream


def run(spark, stream, folder, name):
    """What a stream gives in all, from its sink of files."""
    with state.rocks_state(spark):
        stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{folder}/cp-{name}").option("path", f"{folder}/out-{name}").trigger(availableNow=True).start().awaitTermination()
    return [tuple(r) for r in spark.read.schema(stream.schema).parquet(f"{folder}/out-{name}").collect()]


def fold_threads(rows, threshold, alpha, most, idle):
    """(session, ord, thread) by a plain fold; rows (session, ord, seconds, vector)."""
    sessions, out = {}, []
    for s, o, at, v in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        threads, count = sessions.setdefault(s, ([], [0]))
        threads[:] = [t for t in threads if at - t["last"] <= idle]
        v = np.array(v)
        near = [(state.cosine(t["c"], v), -t["id"], t) for t in threads]
        near = [x for x in near if x[0] > threshold]
        if near:
            t = max(near, key=lambda x: x[:2])[2]
            t["c"] = (1 - alpha) * t["c"] + alpha * v
        else:
            if len(threads) >= most:
                threads.remove(min(threads, key=lambda t: (t["last"], t["id"])))
            t = {"id": count[0], "c": v}
            count[0] += 1
            threads.append(t)
        t["last"] = at
        out.append((s, o, t["id"]))
    return sorted(out)


@pytest.mark.parametrize("files", [1, 4])
def test_routing_equals_a_fold_over_any_number_of_micro_batches(spark, tmp_path, files):
    rng = random.Random(3)
    rows = [(f"s{i % 3}", i, 1000.0 + i * rng.choice([5, 5, 40]), [rng.gauss(0, 1) for _ in range(3)]) for i in range(120)]
    rows.sort(key=lambda r: r[2])
    for k in range(files):
        part = rows[k * len(rows) // files : (k + 1) * len(rows) // files]
        spark.createDataFrame(part, "session string, ord long, at double, vector array<double>").select("session", "ord", F.timestamp_seconds("at").alias("ts"), "vector").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session string, ord long, ts timestamp, vector array<double>").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("ts", "1 hour")
    got = run(spark, state.routed_stream(stream, 0.4, 0.3, 3, 600.0), tmp_path, "threads")
    assert sorted(r[:3] for r in got) == fold_threads(rows, 0.4, 0.3, 3, 600.0)
    assert len({r[2] for r in got}) > 3


def test_searches_are_learned_before_they_expire_and_late_rows_are_dropped(spark, tmp_path):
    rows = [
        ("a", 1, 0.0, "search", None, 0.2), ("a", 2, 10.0, "read", "x", None), ("a", 3, 20.0, "read", "y", None), ("a", 4, 60.0, "turn", None, None),
        ("b", 1, 0.0, "search", None, 0.9), ("b", 2, 5.0, "read", "x", None), ("b", 3, 6.0, "turn", None, None),
        ("c", 1, 0.0, "search", None, None), ("c", 2, 5.0, "turn", None, None), ("c", 3, 30.0, "read", "z", None), ("c", 4, 31.0, "read", "z", None), ("c", 5, 40.0, "turn", None, None),
        ("d", 1, 0.0, "search", None, 0.1), ("d", 2, 30.0, "read", "z", None), ("d", 3, 61.0, "turn", None, None),
    ]
    write = lambda part: spark.createDataFrame(part, "session string, ord long, at double, kind string, path string, score double").select("session", "ord", F.timestamp_seconds(F.col("at") + 500).alias("ts"), "kind", "path", "score").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    write(rows)
    stream = spark.readStream.schema("session string, ord long, ts timestamp, kind string, path string, score double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("ts", "10 seconds")
    learned = state.learned_stream(stream, 0.65, 60.0)
    assert sorted(run(spark, learned, tmp_path, "learned")) == [("a", 1, "x"), ("a", 1, "y"), ("c", 1, "z")]
    # The watermark has passed; a late turn and a late read come to nothing, a new search is learned from.
    write([("e", 1, 1000.0, "search", None, 0.1), ("e", 2, 1001.0, "read", "n", None)])
    write([("e", 3, 2.0, "read", "late", None), ("e", 4, 1030.0, "turn", None, None), ("d", 4, 3.0, "turn", None, None)])
    assert sorted(run(spark, learned, tmp_path, "learned")) == [("a", 1, "x"), ("a", 1, "y"), ("c", 1, "z"), ("e", 1, "n")]


def test_a_batch_merged_twice_changes_nothing_and_a_failed_one_is_replayed(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "store"), "k long, v string, at long", "k", "at", buckets=4)
    frame = lambda rows: spark.createDataFrame(rows, "k long, v string, at long")
    assert store.read().count() == 0
    store.merge(frame([(1, "a", 1), (2, "b", 1), (1, "c", 2)]), 0)
    now = lambda: sorted(tuple(r) for r in store.read().collect())
    assert now() == [(1, "c", 2), (2, "b", 1)]
    store.merge(frame([(1, "never", 9)]), 0)
    assert now() == [(1, "c", 2), (2, "b", 1)] and store.commits() == [0]
    # A merge that died before its commit has left data; the replay writes over it.
    frame([(7, "half", 1)]).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(str(tmp_path / "store/data/1"))
    assert now() == [(1, "c", 2), (2, "b", 1)]
    store.merge(frame([(2, None, 5), (3, "d", 1), (1, "older", 1)]), 1, gone="v is null")
    assert now() == [(1, "c", 2), (3, "d", 1)]
    store.vacuum()
    assert now() == [(1, "c", 2), (3, "d", 1)] and [tuple(r) for r in store.read([3]).collect()] == [(3, "d", 1)]


def test_a_stream_is_merged_once_over_restarts(spark, tmp_path):
    schema = "k long, v string, at long"
    store = KeyedStore(spark, str(tmp_path / "store"), schema, "k", "at", buckets=3)
    want = {}
    for step in range(3):
        rows = [(i % 10, f"{step}-{i}", step * 100 + i) for i in range(step, 40, step + 1)]
        want |= {k: (k, v, at) for k, v, at in rows}
        spark.createDataFrame(rows, schema).coalesce(2).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        upsert_stream(stream, store, str(tmp_path / "cp")).awaitTermination()
        assert sorted(tuple(r) for r in store.read().collect()) == sorted(want.values())
