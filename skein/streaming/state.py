"""Keyed state on streams: thread routing and learning from searches, with event-time timers that let state go.

Both run as transformWithStateInPandas, so state lies in the state store by key, survives restarts through the
checkpoint, and is bounded: a session holds some threads, or the searches of the last seconds. They take streams with a
watermark. Rows of one session that come in one micro-batch are walked in the order of their time; rows behind the
watermark are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks_state(spark: SparkSession):
    """State stores of queries started inside are kept in RocksDB, as keyed state needs; the setting is put back."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _in_order(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    rows = list(frames)
    return pd.concat(rows, ignore_index=True).sort_values(["us", "ord"], kind="stable") if rows else pd.DataFrame()


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    size = float(np.linalg.norm(a) * np.linalg.norm(b))
    return float(a @ b) / size if size else 0.0


class Threads(StatefulProcessor):
    """Threads of a session: centre, touches and time of the last touch of each, and the next thread's number."""

    def __init__(self, threshold: float, alpha: float, most: int, idle_us: int):
        self.threshold, self.alpha, self.most, self.idle_us = threshold, alpha, most, idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.threads = handle.getMapState("threads", "thread int", "centre array<double>, touches bigint, last bigint")
        self.next = handle.getValueState("next", "thread int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = _in_order(rows)
        now = {k[0]: [np.array(v[0], float), v[1], v[2]] for k, v in self.threads.iterator()}
        number, out, old = (self.next.get()[0] if self.next.exists() else 0), [], set(now)
        for o, us, vector in zip(frame["ord"], frame["us"], frame["vector"], strict=True):
            for t in [t for t, (_, _, last) in now.items() if us - last > self.idle_us]:
                del now[t]
            v = np.asarray(vector, float)
            best, score = None, self.threshold
            for t in sorted(now):
                if (c := cosine(now[t][0], v)) > score:
                    best, score = t, c
            fresh = best is None
            if fresh:
                if len(now) >= self.most:
                    del now[min(now, key=lambda t: (now[t][2], t))]
                best, number = number, number + 1
                now[best] = [v, 0, us]
            else:
                now[best][0] = (1 - self.alpha) * now[best][0] + self.alpha * v
            now[best][1:] = [now[best][1] + 1, int(us)]
            out.append((key[0], o, best, None if fresh else round(score, 6), now[best][1], fresh))
        for t in old - set(now):
            self.threads.removeKey((t,))
        for t, (centre, touches, last) in now.items():
            self.threads.updateValue((t,), (centre.tolist(), touches, last))
        self.next.update((number,))
        if now:
            self.handle.registerTimer(max(last for _, _, last in now.values()) // 1000 + self.idle_us // 1000 + 1)
        yield pd.DataFrame(out, columns=["session", "ord", "thread", "similarity", "touches", "started"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Threads idle for long go; the number of the next thread stays, so that numbers are never used twice."""
        at = expiredTimerInfo.getExpiryTimeInMs() * 1000
        for t in [k[0] for k, v in self.threads.iterator() if at - v[2] > self.idle_us]:
            self.threads.removeKey((t,))
        return iter(())

    def close(self) -> None:
        pass


def routed_stream(queries: DataFrame, threshold: float = 0.4, alpha: float = 0.3, most: int = 5, idle_seconds: float = 86_400.0) -> DataFrame:
    """session, ord, thread, similarity, touches, started of a stream of queries (session, ord, ts, vector) with a watermark on ts.

    A query joins the thread of its session whose centre is most alike, if above the threshold (ties: the older), and
    moves that centre by alpha; else it starts a thread. A session keeps its `most` threads of latest touch; threads
    without a touch for idle_seconds are gone.
    """
    kinds = dict(queries.dtypes)
    rows = queries.where("vector is not null").withColumn("us", F.unix_micros("ts"))
    processor = Threads(threshold, alpha, most, int(idle_seconds * 1_000_000))
    schema = f"session {kinds['session']}, ord {kinds['ord']}, thread int, similarity double, touches bigint, started boolean"
    return rows.groupBy("session").transformWithStateInPandas(processor, schema, "Append", "EventTime")


class Searches(StatefulProcessor):
    """Weak searches of a session that nothing has resolved yet: when they began and what has been read since."""

    def __init__(self, weak_below: float, wait_us: int, least: int):
        self.weak_below, self.wait_us, self.least = weak_below, wait_us, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "search bigint", "since bigint, reads array<string>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = _in_order(rows)
        now = {k[0]: (v[0], list(v[1])) for k, v in self.open.iterator()}
        old, out = set(now), []
        for o, us, kind, path, score in zip(frame["ord"], frame["us"], frame["kind"], frame["path"], frame["score"], strict=True):
            now = {s: x for s, x in now.items() if us - x[0] <= self.wait_us}
            if kind == "search" and (pd.isna(score) or score < self.weak_below):
                now[o] = (us, [])
            elif kind == "read" and path is not None:
                for _, reads in now.values():
                    if path not in reads:
                        reads.append(path)
            elif kind == "turn":
                done = [s for s, (_, reads) in now.items() if len(reads) >= self.least]
                out += [(key[0], s, path) for s in done for path in now[s][1]]
                now = {s: x for s, x in now.items() if s not in done}
        for s in old - set(now):
            self.open.removeKey((s,))
        for s, (since, reads) in now.items():
            self.open.updateValue((s,), (int(since), reads))
        if now:
            self.handle.registerTimer(max(since for since, _ in now.values()) // 1000 + self.wait_us // 1000 + 1)
        yield pd.DataFrame(out, columns=["session", "search_ord", "path"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs() * 1000
        for s in [k[0] for k, v in self.open.iterator() if at - v[0] > self.wait_us]:
            self.open.removeKey((s,))
        return iter(())

    def close(self) -> None:
        pass


def learned_stream(events: DataFrame, weak_below: float = 0.65, seconds: float = 60.0, least: int = 1) -> DataFrame:
    """session, search_ord, path: what was read after a weak search until the first end of a turn with `least` reads before
    it, if that end came within `seconds` of the search; later the search is forgotten.

    events: a stream (session, ord, ts, kind, path, score) with a watermark on ts; kind is search, read, turn (its end) or
    any other. A search without a score is weak.
    """
    kinds = dict(events.dtypes)
    rows = events.withColumn("us", F.unix_micros("ts"))
    processor = Searches(weak_below, int(seconds * 1_000_000), least)
    return rows.groupBy("session").transformWithStateInPandas(processor, f"session {kinds['session']}, search_ord bigint, path string", "Append", "EventTime")
