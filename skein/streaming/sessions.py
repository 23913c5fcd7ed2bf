"""Operators on event streams; each takes a streaming or a batch table with an event-time column."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.vectors import norm


def debounced(accesses: DataFrame, gap: str = "2 seconds", late: str | None = None) -> DataFrame:
    """path, start, end, n, reindex: accesses (path, ts, reindex) of a path without a pause of gap, as one."""
    source = accesses.withWatermark("ts", late) if late else accesses
    w = F.session_window("ts", gap)
    return source.groupBy("path", w.alias("w")).agg(F.count("*").alias("n"), F.max("reindex").alias("reindex")).select("path", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "reindex")


def correlated(calls: DataFrame, results: DataFrame, within: str | None = None) -> DataFrame:
    """Tool calls (id, ts, ...) with their results (id, rts, ...). within bounds the wait, as streams need it; both then
    carry watermarks."""
    if within is None:
        return calls.join(results, "id")
    near = F.expr(f"id = _id and rts >= ts and rts <= ts + interval {within}")
    return calls.join(results.withColumnRenamed("id", "_id"), near).drop("_id")


def learned(events: DataFrame, weak_below: float = 0.65, seconds: float = 60.0) -> DataFrame:
    """session, search_ord, path: files read within `seconds` after a weak search and before the end of its turn, in
    turns that a user's line closes.

    events (session, ord, ts, kind, name, path, score). The interval join is by (session, turn), so its groups are turns.
    """
    upto = Window.partitionBy("session").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = events.withColumn("turn", F.sum(F.when(F.col("kind") == "user", 1).otherwise(0)).over(upto))
    closed = turns.where("kind = 'user'").select("session", (F.col("turn") - 1).alias("turn"))
    weak = turns.where((F.col("name") == "search") & (F.coalesce("score", F.lit(0.0)) < weak_below)).select("session", "turn", F.col("ord").alias("search_ord"), F.col("ts").alias("since"))
    reads = turns.where("name = 'Read'").select("session", "turn", "ts", "path")
    near = weak.join(reads, ["session", "turn"]).where((F.col("ts") >= F.col("since")) & (F.col("ts") < F.col("since") + seconds))
    return near.join(closed, ["session", "turn"], "left_semi").select("session", "search_ord", "path").distinct()


def thread_files(accesses: DataFrame) -> DataFrame:
    """session, path, op, first_ts, last_ts, n: the strongest operation of a session on a file, and when."""
    rank = F.when(F.col("op") == "write", 3).when(F.col("op") == "edit", 2).otherwise(1)
    return accesses.groupBy("session", "path").agg(F.max_by("op", rank).alias("op"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))


def deduplicated(texts: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Texts (key, ts, ...) whose key did not come within the watermark; for streams."""
    return texts.withWatermark("ts", late).dropDuplicatesWithinWatermark(["key"])


def routed(queries: DataFrame, threshold: float = 0.4, alpha: float = 0.3) -> DataFrame:
    """session, ord, thread, similarity of queries (session, ord, vector): the thread whose centroid is most alike, if
    above the threshold, else a new one; a centroid moves by alpha towards each query.

    The fold depends on the order, so a session is walked in one worker; its state is its centroids.
    """

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ord")
        centres: list[np.ndarray] = []
        rows = []
        for o, v in zip(frame["ord"], frame["vector"], strict=True):
            v = np.asarray(v, dtype=float)
            scores = [float(c @ v / (np.linalg.norm(c) * np.linalg.norm(v))) if np.linalg.norm(c) and np.linalg.norm(v) else 0.0 for c in centres]
            best = int(np.argmax(scores)) if scores else -1
            if best >= 0 and scores[best] > threshold:
                centres[best] = (1 - alpha) * centres[best] + alpha * v
            else:
                centres.append(v)
                best = len(centres) - 1
            rows.append((frame["session"].iloc[0], o, best, round(scores[best], 6) if best < len(scores) else None))
        return pd.DataFrame(rows, columns=["session", "ord", "thread", "similarity"])

    kinds = dict(queries.dtypes)
    good = queries.where(norm(F.col("vector")).isNotNull())
    return good.groupBy("session").applyInPandas(walk, f"session {kinds['session']}, ord {kinds['ord']}, thread int, similarity double")
