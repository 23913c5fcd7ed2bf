"""Lookups and search: key probes, vector top-k, grep tiers, result tables."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import flexible_pattern
from skein.functions.vectors import cosine_search


def union_first(sources: list[DataFrame], key: str = "key") -> DataFrame:
    """Rows of several tables, the first table that has a key wins."""
    ordered = reduce(DataFrame.unionByName, [df.withColumn("_source", F.lit(i)) for i, df in enumerate(sources)])
    first = Window.partitionBy(key).orderBy("_source")
    return ordered.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_source")


def vector_top_k(vectors: DataFrame, query: list[float], k: int, key: str = "key", vector: str = "vector") -> DataFrame:
    """key, score: the k rows of highest cosine with the query, which is a literal in the plan; ties to the smaller key."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select(F.col(key).alias("key"), cosine_search(F.col(vector), q).alias("score"))
    return scored.orderBy(F.col("score").desc(), "key").limit(k)


def _dealt(rows: DataFrame, key: str, vector: str, size: int) -> tuple[DataFrame, int]:
    """no, keys, flat: vectors of one width dealt by their key into blocks of about size, and how many blocks there are."""
    many = max(1, -(-rows.count() // size))
    dealt = rows.withColumn("no", F.pmod(F.xxhash64(key), F.lit(many)).cast("int"))
    gathered = dealt.groupBy("no", F.size(vector).alias("width")).agg(F.collect_list(F.struct(F.col(key).alias("key"), F.transform(vector, lambda x: x.cast("double")).alias("v"))).alias("rows"))
    return gathered, many


def knn(queries: DataFrame, vectors: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """query, key, score, rank: top k for each query (query, q) over all vectors (key, vector), ties to the smaller key.

    Blocks of queries are dealt to the blocks of vectors by number, and a pair of blocks gives the k best of each of its
    queries; so rows are shuffled by block, and what meets to be ranked is k rows for each query and block of vectors.
    Null vectors, and those of another width than the query's, take no part. Scores count to twelve decimals.
    """
    import numpy as np
    import pandas as pd

    kinds = {"query": dict(queries.dtypes)["query"], "key": dict(vectors.dtypes)["key"]}
    asked, _ = _dealt(queries.where("q is not null"), "query", "q", max(1, block // 8))
    held, many = _dealt(vectors.where("vector is not null"), "key", "vector", block)
    pairs = asked.drop("no").withColumnRenamed("rows", "asked").withColumn("no", F.explode(F.sequence(F.lit(0), F.lit(many - 1)))).join(held, ["no", "width"])

    def best(frames):
        for frame in frames:
            for asked_rows, rows in zip(frame["asked"], frame["rows"], strict=True):
                q, v = (np.array([list(r["v"]) for r in part], dtype=float).reshape(len(part), -1) for part in (asked_rows, rows))
                keys = np.array([r["key"] for r in rows])
                norms = np.sqrt((q**2).sum(1))[:, None] * np.sqrt((v**2).sum(1))[None, :]
                scores = np.round(q @ v.T / (norms + 1e-9), 12)
                picks = [np.lexsort((keys, -row))[:k] for row in scores]
                yield pd.DataFrame({"query": np.repeat([r["key"] for r in asked_rows], [len(p) for p in picks]), "key": np.concatenate([keys[p] for p in picks]), "score": np.concatenate([row[p] for row, p in zip(scores, picks, strict=True)])})

    scored = pairs.select("asked", "rows").mapInPandas(best, f"query {kinds['query']}, key {kinds['key']}, score double")
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), "key")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def probe(index: DataFrame, names: list[str]) -> DataFrame:
    """The first of several keys that the index (key, ...) holds, score 1: a pushed-down filter and a top one."""
    order = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("key"))
    return index.where(F.col("key").isin(names)).orderBy(order).limit(1).withColumn("score", F.lit(1.0)).withColumn("source", F.lit("aot_index"))


def memory_tier(score: Column, is_team: Column) -> Column:
    """Tier of a memory hit: nothing below 0.3, team updates, prior context from 0.5, else related."""
    return F.when(score < 0.3, F.lit(None)).when(is_team, "team_updates").when(score >= 0.5, "prior_context").otherwise("related")


def grep_rank(query: str, path: Column, content: Column) -> Column:
    """Heuristic score of a file that a search found: by its name, its path, a definition or a mention of the name."""
    words = query.lower().split()
    name = F.lower(F.substring_index(path, "/", -1))
    stem = F.regexp_replace(name, r"(.)\.[^.]*$", "$1")
    low, text = F.lower(path), F.lower(content)
    every = lambda c: reduce(lambda a, b: a & b, [F.contains(c, F.lit(w)) for w in words])
    forms = ["".join(words), "_".join(words)]
    defined = text.rlike(r"(class|def|fn|struct|interface|type)\s+(" + "|".join(map(re.escape, forms)) + r")\b")
    mentioned = F.contains(text, F.lit(forms[0])) | F.contains(text, F.lit(forms[1]))
    by_name = F.when(every(stem), 0.7).when(every(name), 0.6).when(every(low), 0.5).otherwise(0.2)
    return F.greatest(F.when(defined, 1.0).otherwise(0.2), F.when(mentioned, 0.8).otherwise(0.2), by_name)


def grep_tiers(files: DataFrame, query: str) -> DataFrame:
    """path, tier of files whose content matches: literally in changed, staged, tracked files (status), else flexibly.

    The best tier of a path wins, and later tiers show only where no earlier one has any row.
    """
    literal, flexible = F.contains(F.col("content"), F.lit(query)), flexible_pattern(query)
    tier = F.when(literal & (F.col("status") == "unstaged"), 1).when(literal & (F.col("status") == "staged"), 2).when(literal, 3)
    if flexible:
        tier = tier.when(F.col("content").rlike(flexible), 4)
    found = files.withColumn("tier", tier).where("tier is not null").groupBy("path").agg(F.min("tier").alias("tier"))
    # A window over nothing would gather all rows in one task; the least tier is one row.
    least = found.agg(F.min("tier").alias("least"))
    return found.join(F.broadcast(least), F.col("tier") <= F.greatest(F.col("least"), F.lit(3))).drop("least")


def grep(docs: DataFrame, patterns: list[str], key: str = "key", content: str = "content") -> DataFrame:
    """key, line, text of the lines that any pattern matches, one row a line."""
    any_of = "|".join(f"(?:{p})" for p in patterns)
    hit = docs.where(F.col(content).rlike(any_of)).select(F.col(key).alias("key"), F.posexplode(F.split(F.col(content), "\n")).alias("line", "text"))
    return hit.where(F.col("text").rlike(any_of)).select("key", (F.col("line") + 1).alias("line"), "text")


def sgrep(docs: DataFrame, patterns: list[str], query: list[float], embed, k: int, key: str = "key", content: str = "content") -> DataFrame:
    """key, line, text, score: of the non-empty lines that any pattern matches the k most similar to the query vector.

    embed is a function from a text column to a vector column; equal lines are embedded once.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    lines = grep(docs, patterns, key, content).where(F.trim("text") != "")
    scored = lines.select("text").distinct().withColumn("score", cosine_search(embed(F.col("text")), q))
    return lines.join(scored, "text").orderBy(F.col("score").desc(), "key", "line").limit(k).select("key", "line", "text", "score")


def truncated(results: DataFrame, most: int, keep: int = 50, from_length: int = 200) -> DataFrame:
    """results (key, score, content) whose contents are cut, lowest score first, until all fit in most characters.

    Only contents above from_length are cut. One row per result of a search, so one task.
    """
    mark = "... [truncated]"
    size, saving = F.length("content"), F.when(F.length("content") > from_length, F.length("content") - keep - len(mark)).otherwise(0)
    lowest = Window.orderBy("score", F.col("key").desc()).rowsBetween(Window.unboundedPreceding, -1)
    over = F.sum(size).over(Window.partitionBy()) - F.coalesce(F.sum(saving).over(lowest), F.lit(0))
    cut = (over > most) & (size > from_length)
    return results.withColumn("content", F.when(cut, F.concat(F.substring("content", 1, keep), F.lit(mark))).otherwise(F.col("content")))


def tsv(*columns: Column) -> Column:
    """A line of tab-separated values; scores should come as format_number(score, 2)."""
    return F.concat_ws("\t", *[F.translate(F.coalesce(c.cast("string"), F.lit("")), "\t\n", "  ") for c in columns])
