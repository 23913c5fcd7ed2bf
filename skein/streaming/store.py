"""A stored table with one row per key, into which streams merge; a micro-batch that comes twice changes nothing.

Rows lie in buckets by a hash of their key. A merge reads and writes anew only the buckets that its rows touch, as files
of its own version; then it writes its commit, a small table of which version each bucket has. A reader goes by the
newest commit, so it sees a merge as a whole or not at all, and what a failed merge left is written over by its replay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class KeyedStore:
    """Rows of `schema` (DDL) under `path`, one per value of `key`; of several the one of greatest `order` counts."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, order: str, buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.order, self.buckets = spark, path.rstrip("/"), schema, key, order, buckets

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def commits(self) -> list[int]:
        """Numbers of the merges that are complete."""
        if not self._exists(f"{self.path}/commits"):
            return []
        fs, p = self._fs(f"{self.path}/commits")
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n) for n in names if n.isdigit() and self._exists(f"{self.path}/commits/{n}/_SUCCESS"))

    def versions(self) -> dict[int, int]:
        """The version of each bucket by the newest commit; at most as many as there are buckets."""
        done = self.commits()
        if not done:
            return {}
        return {r["bucket"]: r["version"] for r in self.spark.read.schema("bucket int, version bigint").parquet(f"{self.path}/commits/{done[-1]}").collect()}

    def _read(self, versions: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/data/{v}/bucket={b}" for b, v in versions.items()]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, keys: list | None = None) -> DataFrame:
        """All rows, or those of some keys, for which only their buckets are read."""
        versions = self.versions()
        if keys is None:
            return self._read(versions)
        kind = dict(self.spark.createDataFrame([], self.schema).dtypes)[self.key]
        wanted = self.spark.createDataFrame([(k,) for k in keys], f"{self.key} {kind}")
        own = {r["b"] for r in wanted.select(self._bucket().alias("b")).collect()}
        return self._read({b: v for b, v in versions.items() if b in own}).where(F.col(self.key).isin(list(keys)))

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def merge(self, rows: DataFrame, batch_id: int, gone: str | None = None) -> None:
        """Put rows in, as batch `batch_id`; rows for which the condition `gone` holds take their key away.

        A batch that is committed is left alone. Of rows of one key, and of what is stored, the greatest order wins.
        """
        if self._exists(f"{self.path}/commits/{batch_id}/_SUCCESS"):
            return
        columns = self.spark.createDataFrame([], self.schema).columns
        new = rows.select(*columns, (F.expr(gone) if gone else F.lit(False)).alias("_gone"), self._bucket().alias("bucket"))
        versions = self.versions()
        # At most as many numbers as buckets.
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]
        old = self._read({b: versions[b] for b in touched if b in versions}).withColumns({"_gone": F.lit(False), "bucket": self._bucket()})
        both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
        last = both.groupBy("bucket", self.key).agg(F.max_by(F.struct(*columns, "_gone"), F.struct(self.order, "_new")).alias("r")).select("bucket", "r.*")
        last.where("not _gone").drop("_gone").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/{batch_id}")
        kept = [b for b in touched if self._exists(f"{self.path}/data/{batch_id}/bucket={b}")]
        now = {b: v for b, v in versions.items() if b not in touched} | {b: batch_id for b in kept}
        self.spark.createDataFrame(list(now.items()), "bucket int, version bigint").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/{batch_id}")

    def vacuum(self) -> None:
        """Delete the data of versions that the newest commit does not name; readers of older commits must have ended."""
        used = set(self.versions().values())
        fs, p = self._fs(f"{self.path}/data")
        for s in fs.listStatus(p) if fs.exists(p) else []:
            if s.getPath().getName() not in {str(v) for v in used}:
                fs.delete(s.getPath(), True)


def upsert_stream(stream: DataFrame, store: KeyedStore, checkpoint: str, gone: str | None = None):
    """Merge all that a stream holds now into a store; the running number of a micro-batch names its commit."""
    return stream.writeStream.foreachBatch(lambda rows, batch_id: store.merge(rows, batch_id, gone)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
