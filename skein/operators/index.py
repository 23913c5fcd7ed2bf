"""Index tables: registering files, upserts and deletes, lazy embedding, compaction, validation and discovery of rules."""

from __future__ import annotations

import json
import tomllib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import has_secret, redacted
from skein.operators.patterns import CONTEXTS, INSIGHTS, detect_contexts, line_matches
from skein.sources.scanner import scan_symbols


def upserted(existing: DataFrame, incoming: DataFrame, key: str, version: str) -> DataFrame:
    """The row of the greatest version of each key; of equals the incoming one."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    last = Window.partitionBy(key).orderBy(F.col(version).desc(), F.col("_new").desc())
    return both.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_new")


def deleted(existing: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return existing.join(keys.select(key).distinct(), key, "left_anti")


def register(files: DataFrame) -> dict[str, DataFrame]:
    """The tables of files (path, ext, content): files with a content hash, contexts, insights and symbols.

    Four plans over one scan's columns; nothing is embedded yet.
    """
    return {
        "files": files.select("path", "ext", F.length("content").alias("size"), F.sha2("content", 256).alias("content_hash")),
        "contexts": detect_contexts(files, CONTEXTS, 2, key="path", ext="ext"),
        "insights": line_matches(files.withColumnRenamed("path", "key"), INSIGHTS),
        "symbols": scan_symbols(files),
    }


def missing_embeddings(files: DataFrame, vectors: DataFrame, key: str = "key") -> DataFrame:
    """Files that no vector has yet: what a lazy embedder must still compute."""
    return files.join(vectors.select(key), key, "left_anti")


def warmed(files: DataFrame, vectors: DataFrame, embed, most: int, key: str = "key", content: str = "content") -> DataFrame:
    """key, vector of up to `most` files without a vector, those of least key; embed maps a text column to a vector one."""
    texts = missing_embeddings(files, vectors, key).orderBy(key).limit(most)
    return texts.select(key, embed(F.col(content)).alias("vector"))


def registry(files: DataFrame, symbols: DataFrame, embed) -> DataFrame:
    """type, key, vector of files (path, content) and of symbols (path, name, kind), embedded in one pass: a file by its
    content, a symbol by its kind, name and path."""
    f = files.select(F.lit("file").alias("type"), F.concat(F.lit("file:"), "path").alias("key"), F.col("content").alias("text"))
    s = symbols.select(F.lit("symbol").alias("type"), F.concat_ws("#", "path", "name").alias("key"), F.concat_ws(" ", "name", "kind", "path").alias("text"))
    return f.unionByName(s).select("type", "key", embed(F.col("text")).alias("vector"))


def write_index(table: DataFrame, name: str, key: str, buckets: int = 64) -> None:
    """A bucketed, sorted table, so that lookups prune and joins on the key need no shuffle."""
    table.write.bucketBy(buckets, key).sortBy(key).mode("overwrite").saveAsTable(name)


def stored(contents: DataFrame, content: str = "content") -> DataFrame:
    """contents with size (bytes) and checksum, as they are put into a content store."""
    return contents.withColumns({"size": F.octet_length(content).cast("long"), "checksum": F.sha2(F.col(content).cast("binary"), 256)})


def damaged(store: DataFrame, content: str = "content") -> DataFrame:
    """Rows of a content store whose content is not what its size and checksum say."""
    good = (F.octet_length(content) == F.col("size")) & (F.sha2(F.col(content).cast("binary"), 256) == F.col("checksum"))
    return store.where(~F.coalesce(good, F.lit(False)))


def full_index(spark, root: str, out: str, checkpoint: str, pattern: str = "*", files_per_batch: int = 1000) -> None:
    """Register the files under root in the Parquet table out; another run goes on where the last one ended.

    A streaming source of files with its checkpoint keeps what is done, so an interrupted run loses one batch at most and
    files that are new since are all that a later run reads.
    """
    source = spark.readStream.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch)
    files = source.schema("path string, modificationTime timestamp, length long, content binary").load(root)
    rows = files.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), F.sha2("content", 256).alias("content_hash"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
    rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start().awaitTermination()


def symbols_of_files(files: DataFrame, symbols: DataFrame, vectors: DataFrame) -> DataFrame:
    """path, vector, symbols (sorted array of name, kind, line) of the files that have a vector, for a taxonomy."""
    own = symbols.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("name", "kind", "line"))).alias("symbols"))
    return files.select("path", "key").join(vectors.select("key", "vector"), "key").join(own, "path", "left").select("path", "vector", F.coalesce("symbols", F.array().cast("array<struct<name:string,kind:string,line:int>>")).alias("symbols"))


def compacted(table: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Write a table anew in files of bounded size."""
    table.write.option("maxRecordsPerFile", rows_per_file).mode("overwrite").parquet(path)


def written(memories: DataFrame, policy: str) -> DataFrame:
    """Memories under a policy for secrets: allow, warn (has_secrets tells), redact or reject (the query fails)."""
    flagged = memories.withColumn("has_secrets", has_secret(F.col("text")))
    if policy == "redact":
        return flagged.withColumn("text", redacted(F.col("text")))
    if policy == "reject":
        return flagged.withColumn("text", F.when(F.col("has_secrets"), F.raise_error(F.lit("a memory holds a secret"))).otherwise(F.col("text")))
    return flagged


def valid_convention(name: Column, priority: Column, pattern: Column) -> Column:
    """The first thing wrong with a convention, or null: no name, unknown priority, brackets of the pattern unbalanced."""
    opened = lambda a, b: F.regexp_count(F.regexp_replace(pattern, r"\\.|\[[^\]]*\]", ""), F.lit(a)) != F.regexp_count(F.regexp_replace(pattern, r"\\.|\[[^\]]*\]", ""), F.lit(b))
    return F.when(F.coalesce(F.trim(name), F.lit("")) == "", "no_name").when(~priority.isin("required", "recommended", "optional"), "unknown_priority").when(opened(r"\(", r"\)"), "bad_pattern")


def _level(value) -> str:
    """Severity of a rule's setting: a name, a number, or either as the first of a list or as the level of an object."""
    value = value[0] if isinstance(value, list) and value else value
    value = value.get("level", "error") if isinstance(value, dict) else value
    return str({0: "off", 1: "warn", 2: "error"}.get(value, value))


def _rules(path: str, content: str) -> list[tuple[str, str]]:
    """(rule, severity) of a linter's configuration, by the name of its file; broken and unknown files give nothing."""
    file = path.rpartition("/")[2]
    try:
        if file in ("ruff.toml", ".ruff.toml", "pyproject.toml"):
            data = tomllib.loads(content)
            ruff = data.get("tool", {}).get("ruff", {}) if file == "pyproject.toml" else data
            lint = ruff.get("lint", {}) | {k: v for k, v in ruff.items() if k in ("select", "extend-select", "ignore")}
            chosen = [*lint.get("select", []), *lint.get("extend-select", [])]
            return [(f"ruff/{r}", "error") for r in chosen if r not in lint.get("ignore", [])] + [("ruff/line-length", str(ruff["line-length"]))] * ("line-length" in ruff)
        data = json.loads(content)
        if file.startswith("biome.json"):
            groups = data.get("linter", {}).get("rules", {})
            return [(f"{g}/{r}", _level(v)) for g, rules in groups.items() if isinstance(rules, dict) for r, v in rules.items()]
        if file.startswith((".prettierrc", "prettier.config")):
            return [(f"prettier/{k}", json.dumps(v)) for k, v in data.items() if not isinstance(v, (dict, list))]
        return [(k, _level(v)) for k, v in data.get("rules", {}).items()]
    except (ValueError, AttributeError, TypeError):
        return []


def linter_rules(configs: DataFrame) -> DataFrame:
    """path, rule, severity of linter configurations (path, content); rules that are off are left out."""

    def scan(frames):
        for f in frames:
            yield pd.DataFrame([(p, *r) for p, c in zip(f["path"], f["content"], strict=True) for r in _rules(p, c or "") if r[1] != "off"], columns=["path", "rule", "severity"])

    return configs.select("path", "content").mapInPandas(scan, "path string, rule string, severity string")


def rule_category(rule: Column) -> Column:
    """Category that a rule's name suggests, by the first word that fits."""
    ladder = [("secur|inject|eval", "convention:security"), ("test", "convention:testing"), ("import|require", "convention:architecture"), ("name|case", "convention:naming"), ("perf", "convention:performance")]
    out = F.lit("convention:style")
    for words, category in reversed(ladder):
        out = F.when(rule.rlike(words), category).otherwise(out)
    return out


def ema_centroids(queries: DataFrame, alpha: float = 0.3) -> DataFrame:
    """thread, centre: 0.7 of the centre and 0.3 of each vector, folded in order; queries (thread, ord, vector).

    The fold is a weighted sum: a vector with k behind it weighs alpha * (1 - alpha) ** k, the first one without alpha. So
    no thread is gathered; sums are combined before they meet.
    """
    back = Window.partitionBy("thread").orderBy(F.col("ord").desc())
    weight = F.when(F.lead("ord").over(back).isNull(), F.lit(1.0)).otherwise(F.lit(float(alpha))) * F.pow(F.lit(1.0 - alpha), F.row_number().over(back) - 1)
    parts = queries.select("thread", weight.alias("w"), "vector").select("thread", "w", F.posexplode("vector").alias("at", "x"))
    sums = parts.groupBy("thread", "at").agg(F.sum(F.col("w") * F.col("x").cast("double")).alias("x"))
    return sums.groupBy("thread").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("centre"))


def recent_distinct(texts: DataFrame, window: int = 100) -> DataFrame:
    """Texts (session, ord, key) whose key is not among the last `window` rows of the session before."""
    before = F.lag("ord").over(Window.partitionBy("session", "key").orderBy("ord"))
    return texts.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("ord") - F.col("_before") > window)).drop("_before")
