"""A stored keyword index: postings by term in buckets, committed in segments, with deletes, replacements and a merge.

A commit writes a segment: its postings, each with its document's length beside it, in files by a hash of the term and
sorted by term, so that a query reads only its terms' buckets and, by the statistics of the files, only their row groups;
the lengths of its documents; and the keys that it takes away from earlier segments, be they replaced or deleted. Last
comes a row with the totals of all that is live, which makes the commit complete: a commit that died before is written
over by its replay, and one that is there is left alone. Scores are those of lexical.bm25() over the live documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import code_tokens
from skein.operators.lexical import bm25_part

COMMIT = "number bigint, base bigint, documents bigint, tokens bigint"


class TermIndex:
    """The index under a path; keys are of one SQL type."""

    def __init__(self, spark: SparkSession, path: str, key_type: str = "bigint", buckets: int = 64):
        self.spark, self.path, self.key_type, self.buckets = spark, path.rstrip("/"), key_type, buckets

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _has(self, number: int) -> bool:
        fs, p = self._fs(f"{self.path}/commits/{number}/_SUCCESS")
        return fs.exists(p)

    def _numbers(self) -> list[int]:
        """Complete commits; a merge keeps their number small."""
        fs, p = self._fs(f"{self.path}/commits")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n) for n in names if n.isdigit() and self._has(int(n)))

    def state(self) -> dict | None:
        """The newest complete commit: its number, the segment from which on segments count, live documents and tokens."""
        done = self._numbers()
        return self.spark.read.schema(COMMIT).parquet(f"{self.path}/commits/{done[-1]}").first().asDict() if done else None

    def _segments(self, upto: dict | None) -> list[int]:
        return [n for n in self._numbers() if upto["base"] <= n <= upto["number"]] if upto else []

    def _of_segments(self, what: str, schema: str, segments: list[int]) -> DataFrame:
        """A part of some segments, with the segment's number; files that a segment does not have are none."""
        here = [n for n in segments if (lambda fs, p: fs.exists(p))(*self._fs(f"{self.path}/{what}/{n}"))]
        frames = [self.spark.read.schema(schema).parquet(f"{self.path}/{what}/{n}").withColumn("segment", F.lit(n)) for n in here]
        return reduce(DataFrame.unionByName, frames) if frames else self.spark.createDataFrame([], schema + ", segment int")

    def _live(self, rows: DataFrame, segments: list[int]) -> DataFrame:
        """Rows (key, segment) whose document no later segment takes away."""
        if len(segments) < 2:
            return rows
        gone = self._of_segments("gone", f"key {self.key_type}", segments[1:]).groupBy("key").agg(F.max("segment").alias("upto"))
        return rows.join(gone, "key", "left").where("upto is null or upto <= segment").drop("upto")

    def _write(self, number: int, base: int, terms: DataFrame, lengths: DataFrame | None, gone: DataFrame | None, documents: int, tokens: int) -> None:
        bucket = F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")
        placed = terms.withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions("bucket", "term", "key")
        placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/{number}")
        if lengths is not None:
            lengths.write.mode("overwrite").parquet(f"{self.path}/lengths/{number}")
        if gone is not None:
            gone.write.mode("overwrite").parquet(f"{self.path}/gone/{number}")
        self.spark.createDataFrame([(number, base, documents, tokens)], COMMIT).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/{number}")

    def commit(self, docs: DataFrame, number: int, deleted: DataFrame | None = None, content: str = "content") -> None:
        """Put documents (key, content) in, in place of those of their keys, and take those of deleted (key) out.

        Numbers rise; a number that is committed already changes nothing. Documents without tokens count for nothing.
        """
        if self._has(number):
            return
        before = self.state()
        if before and number < before["number"]:
            raise ValueError(f"commit {number} comes after {before['number']}")
        each = docs.select(F.col("key").cast(self.key_type).alias("key"), code_tokens(F.coalesce(F.col(content), F.lit(""))).alias("tokens"))
        each = each.select("key", F.size("tokens").cast("long").alias("dl"), F.explode("tokens").alias("term"))
        terms = each.groupBy("term", "key", "dl").agg(F.count("*").alias("tf"))
        touched = docs.select(F.col("key").cast(self.key_type).alias("key"))
        if deleted is not None:
            touched = touched.unionByName(deleted.select(F.col("key").cast(self.key_type).alias("key")))
        lengths = docs.select(F.col("key").cast(self.key_type).alias("key"), F.size(code_tokens(F.coalesce(F.col(content), F.lit("")))).cast("long").alias("dl")).where("dl > 0")
        # Written first and read again, so that texts are cut into tokens twice in all.
        lengths.write.mode("overwrite").parquet(f"{self.path}/lengths/{number}")
        lengths = self.spark.read.schema(f"key {self.key_type}, dl bigint").parquet(f"{self.path}/lengths/{number}")
        total = lambda df: df.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("t")).first()
        new, documents, tokens = total(lengths), 0, 0
        if before:
            live = self._live(self._of_segments("lengths", f"key {self.key_type}, dl bigint", self._segments(before)), self._segments(before))
            lost = total(live.join(touched.distinct(), "key", "left_semi"))
            documents, tokens = before["documents"] - lost["n"], before["tokens"] - lost["t"]
        self._write(number, before["base"] if before else number, terms, None, touched.distinct() if before else None, documents + new["n"], tokens + new["t"])

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """term, key, dl, tf of the live documents; of some terms, from their buckets alone."""
        segments = self._segments(self.state())
        rows = self._of_segments("postings", f"term string, key {self.key_type}, dl bigint, tf bigint, bucket int", segments)
        if terms is not None:
            rows = rows.where(F.col("bucket").isin(*[F.pmod(F.xxhash64(F.lit(t)), F.lit(self.buckets)).cast("int") for t in terms]) & F.col("term").isin(*terms))
        return self._live(rows, segments).select("term", "key", "dl", "tf")

    def search(self, query: list[str]) -> DataFrame:
        """key, score of the documents that hold a query term."""
        state, terms = self.state(), sorted(set(query))
        if state is None or not terms or not state["documents"]:
            return self.spark.createDataFrame([], f"key {self.key_type}, score double")
        hits = self.postings(terms)
        # One row per query term.
        df = hits.groupBy("term").agg(F.count("*").alias("df"))
        part = bm25_part(F.col("tf"), F.col("df"), F.col("dl"), F.lit(state["documents"]), F.lit(state["tokens"] / state["documents"]))
        return hits.join(F.broadcast(df), "term").groupBy("key").agg(F.sum(part).alias("score"))

    def stats(self) -> DataFrame:
        """documents, terms, postings of the live index: one row.

        Documents are counted in the table of lengths, and postings by term, so that no posting travels.
        """
        segments = self._segments(self.state())
        live = self._live(self._of_segments("lengths", f"key {self.key_type}, dl bigint", segments), segments)
        documents = live.agg(F.count_distinct("key").alias("documents"))
        by_term = self.postings().groupBy("term").agg(F.count("*").alias("n"))
        return documents.crossJoin(by_term.agg(F.count("*").alias("terms"), F.coalesce(F.sum("n"), F.lit(0)).alias("postings")))

    def merge(self, number: int) -> None:
        """Write the live postings as one segment, from which on later commits count; the old ones can be vacuumed."""
        state = self.state()
        if state is None or self._has(number):
            return
        if number < state["number"]:
            raise ValueError(f"merge {number} comes after {state['number']}")
        segments = self._segments(state)
        lengths = self._live(self._of_segments("lengths", f"key {self.key_type}, dl bigint", segments), segments).select("key", "dl")
        self._write(number, number, self.postings(), lengths, None, state["documents"], state["tokens"])

    def vacuum(self) -> None:
        """Delete segments from before the last merge; queries on them must have ended."""
        state = self.state()
        for n in self._numbers() if state else []:
            if n < state["base"]:
                for part in ("commits", "postings", "lengths", "gone"):
                    fs, p = self._fs(f"{self.path}/{part}/{n}")
                    if fs.exists(p):
                        fs.delete(p, True)
