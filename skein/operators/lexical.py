"""Keyword search: postings, BM25, rank fusion, hybrid search, recency re-ranking."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.scores import recency_bucket, recency_weight, rrf_part
from skein.functions.text import code_tokens, raw_tokens
from skein.functions.text import TOKENS as PYTHON_TOKENS

#: Robertson and Zaragoza, 2009.
K1, B = 1.2, 0.75


def postings(docs: DataFrame, key: str = "key", fields: tuple[str, ...] = ("content",)) -> DataFrame:
    """key, field, term, tf: one row for each term of a document's field; counts combine before the shuffle."""
    parts = F.array(*[F.struct(F.lit(f).alias("field"), code_tokens(F.coalesce(F.col(f), F.lit(""))).alias("tokens")) for f in fields])
    each = docs.select(F.col(key).alias("key"), F.explode(parts).alias("p")).select("key", "p.field", F.explode("p.tokens").alias("term"))
    return each.groupBy("key", "field", "term").agg(F.count("*").alias("tf"))


def index_stats(terms: DataFrame) -> DataFrame:
    """documents, terms, postings of a table of postings(): one row."""
    return terms.agg(F.count_distinct("key").alias("documents"), F.count_distinct("term").alias("terms"), F.count("*").alias("postings"))


def without(terms: DataFrame, keys: DataFrame) -> DataFrame:
    """A table of postings without the documents of keys (key)."""
    return terms.join(keys.select("key").distinct(), "key", "left_anti")


def bm25_part(tf: Column, df: Column, dl: Column, n: Column, avgdl: Column) -> Column:
    """What one term of one field adds to a score."""
    idf = F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))
    return idf * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl)))


def bm25(docs: DataFrame, query: list[str], boosts: dict[str, float] | None = None, key: str = "key") -> DataFrame:
    """key, score of the documents that hold a query term; boosts by field (column), content alone where none are given.

    A text is cut into tokens once and counted where it is read: its length and how often it holds each query term are
    what is shuffled, so no posting is. The aggregate of all documents (one row) and the scores read the same shuffle.
    """
    boosts, terms = boosts or {"content": 1.0}, sorted(set(query))
    if not terms:
        return docs.select(F.col(key).alias("key"), F.lit(0.0).alias("score")).where(F.lit(False))
    cut = docs.select(F.col(key).alias("key"), *[raw_tokens(F.coalesce(F.col(f), F.lit(""))).alias(f"t{i}") for i, f in enumerate(boosts)])
    low = cut.select("key", *[F.size(f"t{i}").alias(f"dl{i}") for i in range(len(boosts))], *[F.filter(f"t{i}", lambda x: F.lower(x).isin(terms)).alias(f"h{i}") for i in range(len(boosts))])
    each = lambda i, term: F.size(F.filter(f"h{i}", lambda x: F.lower(x) == term)).alias(f"tf{i}_{terms.index(term)}")
    counted = low.select("key", *[f"dl{i}" for i in range(len(boosts))], *[each(i, t) for i in range(len(boosts)) for t in terms]).repartition("key")
    names = [f"tf{i}_{j}" for i in range(len(boosts)) for j in range(len(terms))]
    # Every column is read, so that the scores below find this shuffle done.
    stats = counted.agg(F.count("key"), *[F.count_if(F.col(f"dl{i}") > 0).alias(f"n{i}") for i in range(len(boosts))], *[F.try_divide(F.sum(f"dl{i}"), F.count_if(F.col(f"dl{i}") > 0)).alias(f"avg{i}") for i in range(len(boosts))], *[F.count_if(F.col(c) > 0).alias(f"d{c}") for c in names])
    score = F.lit(0.0)
    for i, weight in enumerate(boosts.values()):
        for j in range(len(terms)):
            tf = F.col(f"tf{i}_{j}")
            score = score + F.when(tf > 0, F.lit(float(weight)) * bm25_part(tf, F.col(f"dtf{i}_{j}"), F.col(f"dl{i}"), F.col(f"n{i}"), F.col(f"avg{i}"))).otherwise(0.0)
    some = F.greatest(*[F.col(c) for c in names], F.lit(0)) > 0
    # stats is a single row.
    return counted.crossJoin(F.broadcast(stats)).select("key", F.when(some, score).alias("score")).where("score is not null")


def bm25_of_postings(terms: DataFrame, query: list[str], boosts: dict[str, float] | None = None) -> DataFrame:
    """bm25() over a stored table of postings(): the query's terms are a pushed-down filter of it.

    Only postings of the query's terms take part in the scoring; document lengths are one aggregate of the table.
    """
    boosts = boosts or {"content": 1.0}
    weight = F.lit(0.0)
    for f, w in boosts.items():
        weight = F.when(F.col("field") == f, F.lit(float(w))).otherwise(weight)
    lengths = terms.groupBy("key", "field").agg(F.sum("tf").alias("dl"))
    means = lengths.groupBy("field").agg(F.avg("dl").alias("avgdl"), F.count("*").alias("n"))
    hits = terms.where(F.col("term").isin(query))
    df = hits.groupBy("field", "term").agg(F.count("*").alias("df"))
    # One row per field, and one per field and query term: bounded by the query.
    joined = hits.join(lengths, ["key", "field"]).join(F.broadcast(means), "field").join(F.broadcast(df), ["field", "term"])
    part = bm25_part(F.col("tf"), F.col("df"), F.col("dl"), F.col("n"), F.col("avgdl"))
    return joined.groupBy("key").agg(F.sum(weight * part).alias("score"))


def fielded(docs: DataFrame, text: str, key: str = "key", name: str = "name", combined: str = "combined", content: str = "content", doc_type: str | None = None) -> DataFrame:
    """key, score of a query over fields: the whole query as a phrase of the name counts 10 times, its tokens in the
    combined text 5 times, in the content once; doc_type restricts the rows that are shown, not the statistics."""
    tokens = [w.lower() for w in re.findall(PYTHON_TOKENS, text)]
    parts = bm25(docs, tokens, {combined: 5.0, content: 1.0}, key)
    phrase = docs.where(F.contains(F.lower(F.col(name)), F.lit(text.lower()))).select(F.col(key).alias("key"), F.lit(10.0).alias("score"))
    out = parts.unionByName(phrase).groupBy("key").agg(F.sum("score").alias("score"))
    return out if doc_type is None else out.join(docs.where(F.col("doc_type") == doc_type).select(F.col(key).alias("key")), "key", "left_semi")


def exact(docs: DataFrame, term: str, field: str = "name") -> DataFrame:
    """Rows whose field is the term, in any case."""
    return docs.where(F.lower(F.col(field)) == term.lower())


def ranked(scores: DataFrame, k: int) -> DataFrame:
    """The k best rows with rank from 1, ties to the smaller key. The cut comes first, so only k rows meet to be ranked."""
    top = scores.orderBy(F.col("score").desc(), "key").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "key")))


def rrf(semantic: DataFrame, lexical: DataFrame, weights: tuple[float, float] = (1.0, 1.0), k: int = 60) -> DataFrame:
    """key, score, source (both, semantic, lexical) of two ranked lists; a union and an aggregate, not an outer join."""
    parts = [df.select("key", rrf_part(F.col("rank"), w, k).alias("part"), F.lit(name).alias("source")) for df, w, name in ((semantic, weights[0], "semantic"), (lexical, weights[1], "lexical"))]
    fused = parts[0].unionByName(parts[1]).groupBy("key").agg(F.sum("part").alias("score"), F.count("*").alias("lists"), F.min("source").alias("source"))
    return fused.select("key", "score", F.when(F.col("lists") > 1, "both").otherwise(F.col("source")).alias("source"))


def hybrid(semantic: DataFrame, lexical: DataFrame, k: int = 10, fast_from: float = 12.0) -> DataFrame:
    """Fused top k of two scored lists (key, score), each cut at 2k; if the best keyword score reaches fast_from, the
    keyword list alone. The choice is a flag column in one plan, not a driver's branch."""
    lex, sem = ranked(lexical, 2 * k), ranked(semantic, 2 * k)
    strong = lex.agg(F.coalesce(F.max("score") >= fast_from, F.lit(False)).alias("strong"))
    only = lex.select("key", "score", F.lit("lexical").alias("source"), F.lit(True).alias("alone"))
    both = rrf(sem, lex).withColumn("alone", F.lit(False))
    # strong is a single row.
    chosen = only.unionByName(both).join(F.broadcast(strong), F.col("alone") == F.col("strong")).select("key", "score", "source")
    return chosen.orderBy(F.col("score").desc(), "key").limit(k)


def with_recency(results: DataFrame, age: Column, preset: str = "default", normalise: bool = False) -> DataFrame:
    """results with score times the weight of its age; rows of unknown age get 0.8 (or, normalised, the oldest bucket).

    Normalised: scores are first mapped to 0..1 inside each age bucket (1 where they are all equal).
    """
    if not normalise:
        return results.withColumn("score", F.col("score") * F.coalesce(F.when(age.isNotNull(), recency_weight(age, preset)), F.lit(0.8)))
    inside = Window.partitionBy("bucket")
    low, high = F.min("score").over(inside), F.max("score").over(inside)
    scaled = results.withColumn("bucket", recency_bucket(age, preset)).withColumn("weight", recency_weight(age, preset))
    return scaled.withColumn("score", F.when(high == low, F.lit(1.0)).otherwise((F.col("score") - low) / (high - low)) * F.col("weight")).drop("bucket", "weight")
