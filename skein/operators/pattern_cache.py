"""What patterns find in files, kept in a stored table and brought up to date by the files that have changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.vectors import cosine_search
from skein.operators.patterns import PatternSet, match_counts
from skein.streaming.store import KeyedStore

SCHEMA = "path string, hash string, at bigint, found array<struct<type_id:string,n:bigint>>"


class PatternCache:
    """Matches of sets of patterns, file by file: path, hash of its content, when it was scanned, and what was found."""

    def __init__(self, spark, path: str, sets: list[PatternSet], buckets: int = 64):
        self.store, self.sets = KeyedStore(spark, path, SCHEMA, "path", "at", buckets), sets

    def stale(self, files: DataFrame, now: int, keep: int | None = None) -> DataFrame:
        """Files (path, content) that are not in the table as they are, or not since `keep` seconds before now."""
        known = self.store.read().select("path", "hash", "at")
        if keep is not None:
            known = known.where(F.col("at") > now - keep)
        return files.withColumn("hash", F.sha2(F.coalesce("content", F.lit("")), 256)).join(known.select("path", "hash"), ["path", "hash"], "left_anti")

    def refresh(self, files: DataFrame, now: int, batch_id: int, keep: int | None = None) -> None:
        """Scan stale files and merge what they show; files that are no more, and with `keep` what was scanned before that,
        leave the table. A batch that is done changes nothing."""
        found = F.filter(match_counts(F.coalesce("content", F.lit("")), self.sets), lambda m: m["n"] > 0)
        new = self.stale(files, now, keep).select("path", "hash", F.lit(now).cast("long").alias("at"), found.alias("found"), F.lit(False).alias("gone"))
        lost = self.store.read().join(files.select("path"), "path", "left_anti").withColumns({"at": F.lit(now).cast("long"), "gone": F.lit(True)})
        self.store.merge(new.unionByName(lost.select(new.columns)), batch_id, "gone")

    def matches(self) -> DataFrame:
        """type_id, path, n of all files."""
        return self.store.read().select("path", F.inline("found")).select("type_id", "path", "n")

    def first(self, most: int = 20) -> DataFrame:
        """type_id, files, paths: how many files a set shows in, and the first of them, as a cached result of a search."""
        sizes = self.matches().groupBy("type_id").agg(F.count("*").alias("files"))
        place = Window.partitionBy("type_id", F.pmod(F.xxhash64("path"), F.lit(64))).orderBy("path")
        few = self.matches().withColumn("r", F.row_number().over(place)).where(F.col("r") <= most)
        # At most 64 times `most` paths of a set.
        paths = few.groupBy("type_id").agg(F.slice(F.array_sort(F.collect_list("path")), 1, most).alias("paths"))
        return sizes.join(paths, "type_id")

    def search(self, query: Column, embed, k: int = 5) -> DataFrame:
        """type_id, score of the sets that show somewhere and whose patterns are most like the query, a vector; embed maps a
        column of text to one of vectors."""
        names = self.store.spark.createDataFrame([(s.type_id, " ".join(s.patterns)) for s in self.sets], "type_id string, text string")
        shown = self.matches().select("type_id").distinct()
        scored = names.join(shown, "type_id", "left_semi").select("type_id", cosine_search(embed(F.col("text")), query).alias("score"))
        return scored.orderBy(F.col("score").desc(), "type_id").limit(k)
