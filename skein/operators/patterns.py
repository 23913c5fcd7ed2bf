"""Pattern mining: a library of regular expressions as rows, and scans of texts against it."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import contexts_of_path, dedupe_key, is_narration


@dataclass(frozen=True)
class PatternSet:
    """A named set of patterns; extensions restrict it to files, an empty list to none."""

    type_id: str
    patterns: tuple[str, ...]
    extensions: tuple[str, ...] = field(default=())


JS, PY = ("ts", "tsx", "js", "jsx"), ("py", "pyi")
# Sets of our own; more are loaded by passing them to the functions below.
CONTEXTS = [
    PatternSet("context:auth", (r"(?i)\blogin\b", r"(?i)authenticat", r"(?i)\bjwt\b", r"(?i)password")),
    PatternSet("context:api", (r"@(?:app|router)\.(?:get|post|put|delete)\(", r"\b(?:app|router)\.(?:get|post|put|delete)\(", r"(?i)\bendpoint\b"), JS + PY),
    PatternSet("context:data", (r"(?i)\bselect\b.{1,80}\bfrom\b", r"\b(?:Column|relationship|ForeignKey)\(", r"(?i)\bmigrat")),
    PatternSet("context:testing", (r"\bdef test_", r"\b(?:describe|it|expect)\(", r"\bassert\b")),
    PatternSet("context:containers", (r"(?m)^FROM\s", r"(?m)^(?:RUN|CMD|COPY)\s", r"services:\s*\n\s*\w+:")),
]
INSIGHTS = [
    PatternSet("insight:todo", (r"(?i)\bTODO\b",)),
    PatternSet("insight:fixme", (r"(?i)\bFIXME\b", r"(?i)\bBUG\b")),
    PatternSet("insight:decision", (r"(?i)\b(?:decided|chose) to\b", r"(?i)\bdecision:")),
    PatternSet("insight:constraint", (r"(?i)\bmust not\b", r"(?i)\bconstraint:")),
]
ANCHORS = [
    PatternSet("anchor:routes", (r"@(?:app|router)\.(?:get|post|put|delete)\(", r"\b(?:app|router)\.(?:get|post|put|delete)\(", r"export async function (?:GET|POST|PUT|DELETE)\b")),
    PatternSet("anchor:models", (r"class \w+\((?:Base|Model|BaseModel)\)", r"\bpgTable\(", r"@dataclass\b")),
    PatternSet("anchor:entrypoints", (r"if __name__ == ['\"]__main__['\"]", r"\bfn main\(")),
]


class Library:
    """Named pattern sets that are loaded at run time; a later set of a name takes the place of the one before."""

    def __init__(self, sets: list[PatternSet] = ()):
        self._sets = {s.type_id: s for s in sets}

    def load(self, definition: dict) -> PatternSet:
        """Add {"id", "patterns", "extensions"}; an empty set or a pattern that does not compile is refused."""
        out = PatternSet(definition["id"], tuple(definition["patterns"]), tuple(definition.get("extensions", ())))
        if not out.patterns:
            raise ValueError("a pattern set needs patterns")
        for p in out.patterns:
            re.compile(p)
        self._sets[out.type_id] = out
        return out

    def get(self, name: str) -> PatternSet | None:
        return self._sets.get(name)

    def sets(self) -> list[PatternSet]:
        return list(self._sets.values())

    def list_all(self, spark) -> DataFrame:
        """type_id, patterns (how many), extensions: one row per set."""
        rows = [(s.type_id, len(s.patterns), ",".join(s.extensions)) for s in self._sets.values()]
        return spark.createDataFrame(rows, "type_id string, patterns int, extensions string")


def _matches(text: str, compiled: list, limit: int | None):
    """(pattern from 1, start, end) in UTF-8 bytes of all matches that are not empty."""
    out = []
    for number, pattern in enumerate(compiled, 1):
        at = byte = 0
        for m in pattern.finditer(text):
            if m.end() == m.start():
                continue
            byte += len(text[at : m.start()].encode("utf-8", "surrogatepass"))
            size = len(m[0].encode("utf-8", "surrogatepass"))
            out.append((number, byte, byte + size))
            byte, at = byte + size, m.end()
            if limit is not None and len(out) > limit:
                raise ValueError(f"more than {limit} matches in one text")
    return out


def scan(docs: DataFrame, patterns: PatternSet, key: str = "key", content: str = "content", limit: int | None = None) -> DataFrame:
    """key, pattern (from 1), start, end: all matches of a set's patterns in whole texts, as byte offsets.

    Texts without any match never leave the JVM. With a limit, a text of more matches fails the query.
    """
    any_of = "|".join(f"(?:{p})" for p in patterns.patterns)
    hit = docs.where(F.col(content).rlike(any_of)).select(F.col(key).alias("key"), F.col(content).alias("content"))

    def find(frames):
        compiled = [re.compile(p) for p in patterns.patterns]
        for f in frames:
            rows = [(k, *m) for k, t in zip(f["key"], f["content"], strict=True) for m in _matches(t, compiled, limit)]
            yield pd.DataFrame(rows, columns=["key", "pattern", "start", "end"])

    return hit.mapInPandas(find, f"key {hit.schema['key'].dataType.simpleString()}, pattern int, start long, end long")


def _fits(sets: PatternSet, ext: Column | None) -> Column:
    """A set without extensions, a file without one, or a file of one of them."""
    if not sets.extensions or ext is None:
        return F.lit(True)
    return ext.isNull() | (ext == "") | ext.isin(*sets.extensions)


def match_counts(text: Column, sets: list[PatternSet], ext: Column | None = None) -> Column:
    """array<struct<type_id, n>>: matches of every set in a whole text, counted leftmost and non-overlapping."""
    each = []
    for s in sets:
        n = F.lit(0)
        for p in s.patterns:
            n = n + F.regexp_count(text, F.lit(p))
        each.append(F.struct(F.lit(s.type_id).alias("type_id"), F.when(_fits(s, ext), n).otherwise(0).cast("long").alias("n")))
    return F.array(*each)


def detect_contexts(docs: DataFrame, sets: list[PatternSet] = CONTEXTS, least: int = 2, key: str = "key", content: str = "content", ext: str | None = None) -> DataFrame:
    """key, type_id, n of the sets with at least `least` matches; a narrow map, without a shuffle."""
    found = docs.select(F.col(key).alias("key"), F.explode(match_counts(F.col(content), sets, F.col(ext) if ext else None)).alias("m"))
    return found.select("key", "m.type_id", "m.n").where(F.col("n") >= least)


def line_matches(docs: DataFrame, sets: list[PatternSet], key: str = "key", content: str = "content", most: int = 100) -> DataFrame:
    """key, type_id, line, text, pattern: the first pattern of each set that a line matches, text trimmed and cut.

    Texts without any match are dropped before they are cut into lines.
    """
    any_of = "|".join(f"(?:{p})" for s in sets for p in s.patterns)
    lines = docs.where(F.col(content).rlike(any_of)).select(F.col(key).alias("key"), F.posexplode(F.split(F.col(content), "\n")).alias("line", "raw"))
    first = [F.struct(F.lit(s.type_id).alias("type_id"), F.coalesce(*[F.when(F.col("raw").rlike(p), F.lit(p)) for p in s.patterns]).alias("pattern")) for s in sets]
    hits = lines.where(F.col("raw").rlike(any_of)).select("key", (F.col("line") + 1).alias("line"), F.substring(F.trim("raw"), 1, most).alias("text"), F.explode(F.array(*first)).alias("m"))
    return hits.where("m.pattern is not null").select("key", "m.type_id", "line", "text", "m.pattern")


def check_rules(rules: list[tuple[str, str]], docs: DataFrame, key: str = "key", content: str = "content") -> DataFrame:
    """key, rule, n, first: what violates the patterns of a list of (rule, pattern); rules are literals of the plan."""
    each = F.array(*[F.struct(F.lit(r).alias("rule"), F.regexp_extract_all(F.col(content), F.lit(p), F.lit(0)).alias("found")) for r, p in rules])
    hits = docs.select(F.col(key).alias("key"), F.explode(each).alias("v")).where("size(v.found) > 0")
    return hits.select("key", "v.rule", F.size("v.found").cast("long").alias("n"), F.get("v.found", F.lit(0)).alias("first"))


# Least lengths of a text by preset.
PRESETS = {"conservative": 100, "moderate": 75, "aggressive": 50}


def extract_memories(turns: DataFrame, weights: list[tuple[str, str, float]], least_length: int = 75, threshold: float = 0.3, explore_threshold: float = 0.35, narration: bool = True) -> DataFrame:
    """turns (key, session, ord, text, explores: boolean) with insights, confidence, skip_reason and should_create.

    weights: (insight, pattern, confidence). The first reason that applies is given: too short, no pattern, confidence
    below the threshold, mere narration (unless narration is False), duplicate of an earlier accepted text of the session.
    """
    hits = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.struct(F.lit(i).alias("insight"), F.lit(w).alias("w"))) for i, p, w in weights]))
    scored = turns.withColumn("_hits", hits).withColumn("confidence", F.round(F.least(F.lit(1.0), F.aggregate("_hits", F.lit(0.0), lambda s, x: s + x["w"])), 6))
    scored = scored.withColumn("insights", F.array_join(F.array_sort(F.array_distinct(F.transform("_hits", lambda x: x["insight"]))), ","))
    bar = F.when(F.col("explores"), explore_threshold).otherwise(threshold)
    reason = F.when(F.length(F.trim("text")) < least_length, "text_too_short").when(F.size("_hits") == 0, "no_patterns_matched").when(F.col("confidence") < bar, "below_confidence_threshold").when(is_narration(F.col("text")) if narration else F.lit(False), "process_narration")
    gated = scored.withColumn("_reason", reason).withColumn("_same", dedupe_key(F.col("text")))
    again = F.row_number().over(Window.partitionBy("session", "_same", F.col("_reason").isNull()).orderBy("ord")) > 1
    out = gated.withColumn("skip_reason", F.coalesce("_reason", F.when(again, "duplicate")))
    return out.withColumn("should_create", F.col("skip_reason").isNull()).drop("_hits", "_reason", "_same")


def session_context(files: Column) -> Column:
    """Sorted contexts of an array of paths."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(files, contexts_of_path))))
