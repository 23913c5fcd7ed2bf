"""Knowledge graph on change logs: latest versions, neighbours, policies, differences, traversal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The built-in relations in the order of their ids from 1; custom ones start at 1000.
RELATIONS = ["defines", "references", "calls", "imports", "contains", "derived_from", "tagged_with", "enriches"]
CUSTOM_FROM = 1000


def node_versions(log: DataFrame) -> DataFrame:
    """Log rows (id, ts, type, scope, payload) as the latest node with rev, created_ts, updated_ts; one aggregate."""
    last = F.max_by(F.struct("type", "scope", "payload"), F.struct("ts", "payload"))
    out = log.groupBy("id").agg(F.count("*").alias("rev"), F.min("ts").alias("created_ts"), F.max("ts").alias("updated_ts"), last.alias("v"))
    return out.select("id", "v.type", "v.scope", "v.payload", "rev", "created_ts", "updated_ts")


def edge_versions(log: DataFrame) -> DataFrame:
    """Log rows (src, rel, dst, ts, tombstone) as the latest edge; a later row brings a deleted edge back."""
    return log.groupBy("src", "rel", "dst").agg(F.min("ts").alias("created_ts"), F.max("ts").alias("updated_ts"), F.max_by("tombstone", F.struct("ts", "tombstone")).alias("tombstone"))


def neighbours(edges: DataFrame, node, direction: str = "out", relation=None) -> DataFrame:
    """node, rel, other of a node's live edges; a relation that nobody has gives none."""
    here, there = ("src", "dst") if direction == "out" else ("dst", "src")
    live = edges.where(~F.col("tombstone") & (F.col(here) == node))
    live = live if relation is None else live.where(F.col("rel") == relation)
    return live.select(F.col(here).alias("node"), "rel", F.col(there).alias("other"))


def latest_policy(policies: DataFrame, rev: int | None = None) -> DataFrame:
    """The last revision of each (scope, namespace, key), or the last up to rev; equality of the namespace, no prefix."""
    some = policies if rev is None else policies.where(F.col("rev") <= rev)
    return some.groupBy("scope", "namespace", "key").agg(F.max("rev").alias("rev"), F.max_by("payload", "rev").alias("payload"))


def diff_since(nodes: DataFrame, edges: DataFrame, ts) -> DataFrame:
    """change, id of what changed since ts: nodes added or updated, edges added or deleted; a payload alone is no change
    of an edge."""
    created, updated = F.col("created_ts") >= ts, F.col("updated_ts") >= ts
    edge = F.concat_ws("|", "src", "rel", "dst")
    return nodes.where(updated).select(F.when(created, "node_added").otherwise("node_updated").alias("change"), F.col("id").cast("string").alias("id")).unionByName(
        edges.where((created & ~F.col("tombstone")) | (updated & F.col("tombstone"))).select(F.when(F.col("tombstone"), "edge_deleted").otherwise("edge_added").alias("change"), edge.alias("id"))
    )


def reach(edges: DataFrame, starts: DataFrame, depth: int, both: bool = True) -> DataFrame:
    """node, depth: least number of steps from any start node, up to depth.

    A loop of joins of the frontier with the edges, each round without what is known; depth bounds the plan.
    """
    steps = edges.where(~F.col("tombstone")).select(F.col("src").alias("node"), F.col("dst").alias("next"))
    steps = steps.unionByName(steps.select(F.col("next").alias("node"), F.col("node").alias("next"))) if both else steps
    seen = [starts.select("node", F.lit(0).alias("depth")).distinct()]
    for d in range(1, depth + 1):
        known = reduce(DataFrame.unionByName, seen)
        new = seen[-1].join(steps, "node").select(F.col("next").alias("node")).distinct().join(known, "node", "left_anti")
        seen.append(new.withColumn("depth", F.lit(d)))
    return reduce(DataFrame.unionByName, seen)


def iter_nodes(nodes: DataFrame, type: str | None = None, scope: str | None = None) -> DataFrame:
    """Nodes of a type and a scope, where they are given."""
    for column, value in (("type", type), ("scope", scope)):
        nodes = nodes if value is None else nodes.where(F.col(column) == value)
    return nodes


def snapshot(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, type, scope, payload, out, into: every node with its live edges, each a sorted array of (rel, other).

    Lists of a node are gathered by key; write the result sorted by id, so that a lookup of an id prunes to one file part.
    """
    live = edges.where(~F.col("tombstone"))
    ends = live.select(F.col("src").alias("id"), F.struct(F.col("rel"), F.col("dst").alias("other")).alias("out"), F.lit(None).alias("into")).unionByName(
        live.select(F.col("dst").alias("id"), F.lit(None).alias("out"), F.struct(F.col("rel"), F.col("src").alias("other")).alias("into"))
    )
    lists = ends.groupBy("id").agg(F.array_sort(F.collect_list("out")).alias("out"), F.array_sort(F.collect_list("into")).alias("into"))
    none = lists.schema["out"].dataType.simpleString()
    kept = nodes.select("id", "type", "scope", "payload").join(lists, "id", "left")
    return kept.withColumns({c: F.coalesce(c, F.array().cast(none)) for c in ("out", "into")})


def orphans(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Live edges that lack an end."""
    live = edges.where(~F.col("tombstone")).select("src", "rel", "dst")
    ids = nodes.select("id")
    return live.join(ids, live["src"] == ids["id"], "left_anti").unionByName(live.join(ids, live["src"] == ids["id"], "left_semi").join(ids, live["dst"] == ids["id"], "left_anti"))


def interned(names: DataFrame) -> DataFrame:
    """name, rel: ids of relations; built-in ones keep theirs, others count from 1000 in the order of their first ts."""
    own = F.array_position(F.array(*[F.lit(r) for r in RELATIONS]), F.col("name"))
    first = names.groupBy("name").agg(F.min("ts").alias("ts")).withColumn("own", own)
    custom = first.where("own = 0").withColumn("rel", (F.row_number().over(Window.orderBy("ts", "name")) + CUSTOM_FROM - 1).cast("long"))
    return first.where("own > 0").select("name", F.col("own").cast("long").alias("rel")).unionByName(custom.select("name", "rel"))


def graph_stats(nodes: DataFrame, edges: DataFrame, policies: DataFrame) -> DataFrame:
    """nodes, edges (with deleted ones), live_edges, policies: one row."""
    e = edges.agg(F.count("*").alias("edges"), F.count_if(~F.col("tombstone")).alias("live_edges"))
    return nodes.agg(F.count("*").alias("nodes")).crossJoin(e).crossJoin(policies.select("scope", "namespace", "key").distinct().agg(F.count("*").alias("policies")))


def dot(edges: DataFrame, name: str = "src", other: str = "dst") -> DataFrame:
    """One line of the DOT language per edge; write them as text between the lines of the graph's head and tail."""
    return edges.select(F.format_string('  "%s" -> "%s" [label="%s"];', F.col(name).cast("string"), F.col(other).cast("string"), F.col("label").cast("string")).alias("line"))
