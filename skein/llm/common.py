"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
#: The separators between words.
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data directory; any path that Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=1)
def _own_dir() -> str:
    """A temporary folder of this process, for sessions on one machine."""
    return tempfile.mkdtemp(prefix="skein-checkpoint-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, on one machine, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return folder or _own_dir()


#: Folders that materialize() wrote and nothing has deleted, and those of the scratch() blocks that are open.
_WRITTEN: set[str] = set()
_OPEN: list[list[str]] = []


def materialize(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back; this cuts the lineage and survives lost executors.

    Parquet keeps long texts and repeated values compressed, which Spark's own checkpoint files do not. The end of a
    scratch() block deletes the table unless keep is set.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/skein-{uuid.uuid4().hex}"
    if _OPEN and not keep:
        _OPEN[-1].append(path)
    df.write.parquet(path)
    _WRITTEN.add(path.rsplit("/", 1)[1])
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    if folder.rsplit("/", 1)[1] in _WRITTEN:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        _WRITTEN.discard(folder.rsplit("/", 1)[1])


@contextmanager
def scratch(spark: SparkSession):
    """Delete at its end what operators wrote to the shared folder inside; write their results out before that."""
    _OPEN.append([])
    try:
        yield
    finally:
        for folder in _OPEN.pop():
            _delete(spark, folder)


def forget(*frames: DataFrame) -> None:
    """Delete tables that materialize() wrote and that nothing reads any more; other tables stay."""
    for df in frames:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _delete(df.sparkSession, folder)


def bound_batches(spark: SparkSession, rows: int = 1000, megabytes: int = 32) -> None:
    """Bound what one Arrow batch brings into a Python worker, by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))


def held_out(doc_id: Column) -> Column:
    """True where crc32(doc_id as text) mod 5 is 0; a null doc_id is held out as well."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def text_key(text: Column) -> Column:
    """16 bytes that name a text; null and empty texts share one."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))
