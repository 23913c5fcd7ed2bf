"""Score formulas: recency, eviction, threads, rank fusion, waste."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (age in seconds up to which a bucket reaches, weight); the last bucket is open.
RECENCY = {
    "default": [(3600, 1.0), (86400, 0.9), (604800, 0.8), (2419200, 0.7), (None, 0.6)],
    "aggressive": [(3600, 1.0), (86400, 0.7), (604800, 0.4), (None, 0.2)],
    "mild": [(604800, 1.0), (2419200, 0.95), (7776000, 0.9), (None, 0.85)],
}
UNKNOWN_AGE = 0.8


def recency_bucket(age: Column, preset: str = "default") -> Column:
    """0-based bucket of an age in seconds; ages below 0 count as 0, an unknown age as the oldest."""
    buckets = RECENCY[preset]
    out = F.lit(len(buckets) - 1)
    for i, (limit, _) in reversed(list(enumerate(buckets[:-1]))):
        out = F.when(F.greatest(age, F.lit(0.0)) <= limit, F.lit(i)).otherwise(out)
    return F.when(age.isNull(), F.lit(len(buckets) - 1)).otherwise(out)


def recency_weight(age: Column, preset: str = "default") -> Column:
    weights = F.array(*[F.lit(w) for _, w in RECENCY[preset]])
    return F.element_at(weights, recency_bucket(age, preset) + 1)


def eviction_score(access_count: Column, age_seconds: Column) -> Column:
    """Low scores go first: ten points an access and up to a hundred for youth, halved after a week."""
    return F.lit(10.0) * access_count + F.lit(100.0) / (F.lit(1.0) + age_seconds / 3600.0 / 168.0)


def thread_score(age_seconds: Column, touches: Column) -> Column:
    """0.6 recency over ten minutes and 0.4 frequency up to fifty touches."""
    return F.lit(0.6) * F.greatest(F.lit(0.0), F.lit(1.0) - age_seconds / 600.0) + F.lit(0.4) * F.least(F.lit(1.0), touches / 50.0)


def rrf_part(rank: Column, weight: float = 1.0, k: int = 60) -> Column:
    """A list's share of the fused score; rank counts from 1."""
    return F.lit(weight) / (F.lit(float(k)) + rank)


def waste_ratio(live: Column, total: Column) -> Column:
    return F.when(total > 0, F.lit(1.0) - live / total).otherwise(F.lit(0.0))


def needs_compaction(live: Column, total: Column, ratio: float = 0.25, least_bytes: int = 1 << 20) -> Column:
    """More than a quarter and more than a MiB wasted."""
    return (waste_ratio(live, total) > ratio) & (total - live > least_bytes)
