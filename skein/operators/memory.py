"""Memories and conventions: filters, retrieval, eviction, merging, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.scores import eviction_score
from skein.functions.vectors import cosine_search

# Priorities from the strongest.
PRIORITIES = ["required", "recommended", "optional"]


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def all_of(column: Column, wanted: list[str]) -> Column:
    """True where an array holds every wanted value."""
    return F.size(F.array_except(_strings(wanted), F.coalesce(column, _strings([])))) == 0


def any_of_or_empty(column: Column, wanted: list[str]) -> Column:
    """True where an array is empty or shares a value."""
    return (F.size(column) == 0) | F.arrays_overlap(column, _strings(wanted))


def query_memories(memories: DataFrame, task: str | None = None, contexts: list[str] = (), insights: list[str] = (), tags: list[str] = (), limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest first; every list filter asks for all of its values."""
    out = memories.where(all_of(F.col("context"), list(contexts)) & all_of(F.col("insights"), list(insights)) & all_of(F.col("tags"), list(tags)))
    out = out if task is None else out.where(F.col("task") == task)
    return out.orderBy(F.col("created_at").desc(), "id").offset(offset).limit(limit)


def priority_rank(priority: Column) -> Column:
    at = F.array_position(_strings(PRIORITIES), priority)
    return F.when(at == 0, len(PRIORITIES) + 1).otherwise(at)


def query_conventions(conventions: DataFrame, category: str | None = None, scope: list[str] = (), priority: str | None = None, limit: int = 50) -> DataFrame:
    """By priority, then name; scope asks for any of its values or for a convention without scope."""
    out = conventions
    for column, value in (("category", category), ("priority", priority)):
        out = out if value is None else out.where(F.col(column) == value)
    out = out.where(any_of_or_empty(F.col("scope"), list(scope))) if scope else out
    return out.orderBy(priority_rank(F.col("priority")), "name").limit(limit)


def for_contexts(conventions: DataFrame, contexts: DataFrame) -> DataFrame:
    """Conventions whose scope meets a context of the table (context), and those without scope, once each."""
    scoped = conventions.withColumn("context", F.explode("scope")).join(contexts.select("context").distinct(), "context", "left_semi").drop("context")
    return scoped.unionByName(conventions.where(F.size("scope") == 0)).dropDuplicates(["id"])


def search_memories(memories: DataFrame, query: list[float] | None, k: int, candidates: int = 10) -> DataFrame:
    """id, score: the k most similar of the newest k * candidates memories; without a query the newest, score 1."""
    newest = memories.orderBy(F.col("created_at").desc(), "id").limit(k * candidates)
    if query is None:
        return newest.orderBy(F.col("created_at").desc(), "id").limit(k).select("id", F.lit(1.0).alias("score"))
    q = F.array(*[F.lit(float(x)) for x in query])
    return newest.select("id", cosine_search(F.col("vector"), q).alias("score")).orderBy(F.col("score").desc(), "id").limit(k)


def search_conventions(conventions: DataFrame, query: list[float], k: int, candidates: int = 5, **filters) -> DataFrame:
    """id, score: the k most similar of the first k * candidates conventions of query_conventions()."""
    q = F.array(*[F.lit(float(x)) for x in query])
    first = query_conventions(conventions, limit=k * candidates, **filters)
    return first.select("id", cosine_search(F.col("vector"), q).alias("score")).orderBy(F.col("score").desc(), "id").limit(k)


def shared(memories: DataFrame, ids: DataFrame, owner: str) -> DataFrame:
    """memories with is_team and owner_id set where their id is in ids (id)."""
    named = ids.select(F.col("id").alias("_id")).distinct()
    out = memories.join(named, F.col("id") == F.col("_id"), "left")
    return out.withColumns({"is_team": F.col("_id").isNotNull(), "owner_id": F.when(F.col("_id").isNotNull(), F.lit(owner))}).drop("_id")


def accessed(memories: DataFrame, log: DataFrame) -> DataFrame:
    """memories with access_count and last_accessed brought up to date from a log (id, ts); one aggregate, one join."""
    seen = log.groupBy("id").agg(F.count("*").alias("_n"), F.max("ts").alias("_last"))
    out = memories.join(seen, "id", "left")
    return out.withColumns({"access_count": F.col("access_count") + F.coalesce("_n", F.lit(0)), "last_accessed": F.greatest("last_accessed", "_last")}).drop("_n", "_last")


def got(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """The memories of ids (id)."""
    return memories.join(ids.select("id").distinct(), "id", "left_semi")


def forgotten(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """memories without those of ids (id); unknown ids change nothing."""
    return memories.join(ids.select("id").distinct(), "id", "left_anti")


def coldest(memories: DataFrame, n: int, now: Column) -> DataFrame:
    """id, score of the n rows to evict: least eviction score; age counts from the last access, else from the creation."""
    age = now - F.coalesce("last_accessed", "created_at")
    return memories.select("id", eviction_score(F.col("access_count"), age).alias("score")).orderBy("score", "id").limit(n)


def evicted(memories: DataFrame, most: int, now: Column) -> DataFrame:
    """memories without the coldest, so that one more fits below most; their number is one count."""
    surplus = max(0, memories.count() - most + 1)
    return memories.join(coldest(memories, surplus, now).select("id"), "id", "left_anti") if surplus else memories


def merged(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """existing and those of incoming whose key is new, once each."""
    first = Window.partitionBy(key).orderBy(*[c for c in incoming.columns if c != key and "array" not in dict(incoming.dtypes)[c]])
    fresh = incoming.join(existing.select(key), key, "left_anti").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return existing.unionByName(fresh)


def exported(conventions: DataFrame) -> DataFrame:
    """One JSON document per convention, by priority and name."""
    fields = ["name", "description", "category", "priority", "scope", "pattern"]
    return conventions.orderBy(priority_rank(F.col("priority")), "name").select(F.to_json(F.struct(*fields)).alias("json"))


def imported(lines: DataFrame) -> DataFrame:
    """Conventions of JSON documents (json); what does not parse is left out."""
    schema = "name string, description string, category string, priority string, scope array<string>, pattern string"
    return lines.select(F.from_json("json", schema).alias("c")).select("c.*").where("name is not null")
