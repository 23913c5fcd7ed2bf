"""Queries of memories, conventions, aggregates, windows, sets, graphs and the taxonomy."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.functions.scores import needs_compaction, waste_ratio
from skein.operators import graph, lexical, memory, patterns, taxonomy
from skein.operators.patterns import PatternSet
from skein.plans import corpus
from skein.plans.base import FILES_SQL, files, per_supplier, per_supplier_sql, query, table
from skein.plans.search_plans import NOW_S

# ---- memories: documents with labels; conventions: literals

TAGS = "case when quality = 1 then ['quality'] else [] end || case when toxic = 1 then ['toxic'] else [] end"
MEM_SQL = f"mem as (select d.doc_id as id, 'task:' || lang as task, {TAGS} as tags, ['context:' || source] as context, case when contains(text, 'license') then ['insight:license'] else []::varchar[] end as insights, (d.doc_id % 977)::double as created_at, d.doc_id % 5 as access_count, case when d.doc_id % 3 = 0 then null else (d.doc_id % 1500)::double end as last_accessed from documents d join labels using (doc_id))"


def memories(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    tag = lambda c, n: F.when(F.col(c) == 1, F.array(F.lit(n))).otherwise(F.array().cast("array<string>"))
    return rows.select(
        F.col("doc_id").alias("id"), F.concat(F.lit("task:"), "lang").alias("task"), F.concat(tag("quality", "quality"), tag("toxic", "toxic")).alias("tags"),
        F.array(F.concat(F.lit("context:"), "source")).alias("context"), F.when(F.contains("text", F.lit("license")), F.array(F.lit("insight:license"))).otherwise(F.array().cast("array<string>")).alias("insights"),
        (F.col("doc_id") % 977).cast("double").alias("created_at"), (F.col("doc_id") % 5).alias("access_count"), F.when(F.col("doc_id") % 3 != 0, (F.col("doc_id") % 1500).cast("double")).alias("last_accessed"),
    )


@query("flt1_memories", f"with {MEM_SQL} select id, task, created_at from mem where task = 'task:en' and list_contains(tags, 'quality') order by created_at desc, id limit 40 offset 5")
def flt1(spark, d):
    return memory.query_memories(memories(spark, d), task="task:en", tags=["quality"], limit=40, offset=5).select("id", "task", "created_at")


@query("flt1_all_of", f"with {MEM_SQL} select id from mem where list_contains(tags, 'quality') and list_contains(tags, 'toxic') and list_contains(context, 'context:src3') order by created_at desc, id limit 100")
def flt1_all(spark, d):
    return memory.query_memories(memories(spark, d), contexts=["context:src3"], tags=["quality", "toxic"], limit=100).select("id")


CONV_SQL = per_supplier_sql("conv", corpus.CONVENTION_COLUMNS, corpus.CONVENTIONS, corpus.CONVENTION_OF)
RANK_SQL = "case priority when 'required' then 1 when 'recommended' then 2 when 'optional' then 3 else 4 end"


@query("flt2_conventions", f"with {CONV_SQL} select id, name from conv where list_has_any(scope, ['context:backend', 'context:data']) or len(scope) = 0 order by {RANK_SQL}, name limit 3")
def flt2(spark, d):
    c = per_supplier(spark, d, corpus.CONVENTION_COLUMNS, corpus.CONVENTIONS, corpus.CONVENTION_OF)
    return memory.query_conventions(c, scope=["context:backend", "context:data"], limit=3).select("id", "name")


@query("set2_for_context", f"with {CONV_SQL} select distinct id, name from conv where list_has_any(scope, ['context:api', 'context:auth']) or len(scope) = 0")
def set2(spark, d):
    contexts = spark.createDataFrame([("context:api",), ("context:auth",)], "context string")
    return memory.for_contexts(per_supplier(spark, d, corpus.CONVENTION_COLUMNS, corpus.CONVENTIONS, corpus.CONVENTION_OF), contexts).select("id", "name")


@query("cnv4_check", f"""with {FILES_SQL}, r(rule, pattern) as (values ('no-mail', '[a-z0-9]+@[a-z0-9.]+'), ('license', '(?i)\\blicen[cs]ed?\\b')),
m as (select key, rule, regexp_extract_all(content, '[a-z0-9]+@[a-z0-9.]+') as found from files, r where rule = 'no-mail' union all select key, rule, regexp_extract_all(content, '(?i)\\blicen[cs]ed?\\b') from files, r where rule = 'license')
select key, rule, len(found) as n, found[1] as first from m where len(found) > 0""")
def cnv4(spark, d):
    rules = [(c[1], c[6]) for c in corpus.CONVENTIONS if c[1] in ("no-mail", "license")]
    return patterns.check_rules(rules, files(spark, d))


@query("top6_evict", f"with {MEM_SQL} select id, round(10.0 * access_count + 100.0 / (1.0 + ({NOW_S} - coalesce(last_accessed, created_at)) / 3600.0 / 168.0), 6) as score from mem order by 10.0 * access_count + 100.0 / (1.0 + ({NOW_S} - coalesce(last_accessed, created_at)) / 3600.0 / 168.0), id limit 30")
def top6(spark, d):
    return memory.coldest(memories(spark, d), 30, F.lit(NOW_S)).select("id", F.round("score", 6).alias("score"))


@query("mem2_newest_first", f"with {MEM_SQL}, n as (select id, created_at from mem order by created_at desc, id limit 100) select id, 1.0::double as score from n order by created_at desc, id limit 10")
def mem2(spark, d):
    return memory.search_memories(memories(spark, d), None, 10)


@query("set5_merge", f"with {CONV_SQL} select name, id from conv union all select * from (values ('new-rule', 'conv:x')) v(name, id)")
def set5(spark, d):
    c = per_supplier(spark, d, corpus.CONVENTION_COLUMNS, corpus.CONVENTIONS, corpus.CONVENTION_OF)
    extra = spark.createDataFrame([("conv:x", "new-rule"), ("conv:y", "no-print-0"), ("conv:z", "new-rule")], "id string, name string")
    return memory.merged(c.select("id", "name"), extra, "name")


@query("snk1_export_roundtrip", f"with {CONV_SQL} select name, description, category, priority, array_to_string(scope, ',') as scope, pattern from conv")
def snk1(spark, d):
    again = memory.imported(memory.exported(per_supplier(spark, d, corpus.CONVENTION_COLUMNS, corpus.CONVENTIONS, corpus.CONVENTION_OF)))
    return again.withColumn("scope", F.array_join("scope", ","))


# ---- aggregates

SETS = [PatternSet("context:contact", (r"[a-z0-9]+@[a-z0-9.]+", r"\+[0-9]+ \([0-9]+\)")), PatternSet("context:legal", (r"(?i)\blicen[cs]ed?\b",)), PatternSet("context:noise", (r"[*]{3}", r"[%]{3}"), ("en", "de"))]
COUNT_SQL = """cnt as (select key, 'context:contact' as type_id, len(regexp_extract_all(content, '[a-z0-9]+@[a-z0-9.]+')) + len(regexp_extract_all(content, '\\+[0-9]+ \\([0-9]+\\)')) as n from files
union all select key, 'context:legal', len(regexp_extract_all(content, '(?i)\\blicen[cs]ed?\\b')) from files
union all select key, 'context:noise', len(regexp_extract_all(content, '[*]{3}')) + len(regexp_extract_all(content, '[%]{3}')) from files where ext in ('en', 'de'))"""


@query("agg8_contexts_min2", f"with {FILES_SQL}, {COUNT_SQL} select key, type_id, n from cnt where n >= 2")
def agg8(spark, d):
    return patterns.detect_contexts(files(spark, d), SETS, 2, ext="ext")


@query("agg1_context_stats", f"with {FILES_SQL}, {COUNT_SQL} select type_id, count(*) as files from cnt where n >= 2 group by type_id")
def agg1(spark, d):
    return patterns.detect_contexts(files(spark, d), SETS, 2, ext="ext").groupBy("type_id").agg(F.count("*").alias("files"))


@query("lkp8_files_by_context", f"with {FILES_SQL}, {COUNT_SQL} select path from cnt join files using (key) where n >= 2 and type_id = 'context:legal'")
def lkp8(spark, d):
    f = files(spark, d)
    hits = patterns.detect_contexts(f, SETS, 2, ext="ext").where("type_id = 'context:legal'")
    return f.join(hits, "key", "left_semi").select("path")


LINES = [PatternSet("insight:license", (r"(?i)licensed under", r"(?i)released under")), PatternSet("insight:key", (r"token = ",))]
LINE_SQL = """ln as (select key, unnest(string_split(content, chr(10))) as raw, unnest(range(1, len(string_split(content, chr(10))) + 1)) as line from files),
ins as (select key, 'insight:license' as type_id, line, substr(trim(raw, ' '), 1, 100) as text, case when regexp_matches(raw, '(?i)licensed under') then '(?i)licensed under' else '(?i)released under' end as pattern from ln where regexp_matches(raw, '(?i)licensed under|(?i)released under')
union all select key, 'insight:key', line, substr(trim(raw, ' '), 1, 100), 'token = ' from ln where contains(raw, 'token = '))"""


@query("pat6_insights", f"with {FILES_SQL}, {LINE_SQL} select * from ins")
def pat6(spark, d):
    return patterns.line_matches(files(spark, d), LINES)


@query("agg2_insight_stats", f"with {FILES_SQL}, {LINE_SQL} select type_id, count(*) as n, count(distinct key) as files from ins group by type_id")
def agg2(spark, d):
    return patterns.line_matches(files(spark, d), LINES).groupBy("type_id").agg(F.count("*").alias("n"), F.count_distinct("key").alias("files"))


@query("agg3_counts", "select count(*) as files, count(*) filter (lang = 'en') as english, (select count(*) from embeddings) as vectors, (select count(*) from conversations) as turns from documents")
def agg3(spark, d):
    n = lambda t, name: table(spark, d, t).agg(F.count("*").alias(name))
    return table(spark, d, "documents").agg(F.count("*").alias("files"), F.count_if(F.col("lang") == "en").alias("english")).crossJoin(n("embeddings", "vectors")).crossJoin(n("conversations", "turns"))


@query("agg4_thread_stats", "with t as (select user_id, count(*) as n, max(ts) as last_ts from events group by user_id) select count(*) filter (last_ts >= timestamp '2024-01-30') as active, count(*) filter (last_ts < timestamp '2024-01-30') as inactive, max(n) as top_events, arg_max(user_id, n * 1000000 - user_id) as top_user from t")
def agg4(spark, d):
    t = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))
    day = F.lit("2024-01-30").cast("timestamp_ntz")
    return t.agg(F.count_if(F.col("last_ts") >= day).alias("active"), F.count_if(F.col("last_ts") < day).alias("inactive"), F.max("n").alias("top_events"), F.max_by("user_id", F.col("n") * 1000000 - F.col("user_id")).alias("top_user"))


@query("agg5_grouping_sets", "select p_brand, p_size, count(*) as n from part group by grouping sets ((p_brand), (p_size), ())")
def agg5(spark, d):
    table(spark, d, "part").createOrReplaceTempView("_agg5_part")
    return spark.sql("select p_brand, p_size, count(*) as n from _agg5_part group by grouping sets ((p_brand), (p_size), ())")


@query("agg6_waste", "with t as (select o_orderstatus as status, sum(length(o_orderpriority)) as live, sum(length(o_orderpriority) + o_orderkey % 7)::bigint as total from orders group by 1) select status, round(1.0 - live::double / total, 6) as waste, 1.0 - live::double / total > 0.25 and total - live > 100 as compact from t")
def agg6(spark, d):
    t = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.sum(F.length("o_orderpriority")).alias("live"), F.sum(F.length("o_orderpriority") + F.col("o_orderkey") % 7).alias("total"))
    return t.select("status", F.round(waste_ratio(F.col("live"), F.col("total")), 6).alias("waste"), needs_compaction(F.col("live"), F.col("total"), 0.25, 100).alias("compact"))


@query("agg14_content_hash", """with b as (select source, doc_id // 1000 as bucket, sha256(string_agg(doc_id || ':' || md5(text), chr(10) order by doc_id)) as h from documents group by 1, 2)
select source, substr(sha256(string_agg(h, chr(10) order by up)), 1, 16) as digest from (select source, bucket // 1000 as up, sha256(string_agg(h, chr(10) order by bucket)) as h from b group by 1, 2) group by source""")
def agg14(spark, d):
    """A tree of hashes: a thousand ids at a time, a thousand hashes of those, then the rest, so no group is gathered."""
    line = F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.md5("text"))
    joined = lambda order, x: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, x.alias("x")))), lambda r: r["x"]), "\n")
    part = table(spark, d, "documents").groupBy("source", F.floor(F.col("doc_id") / 1000).alias("bucket")).agg(F.sha2(joined("doc_id", line), 256).alias("h"))
    upper = part.groupBy("source", F.floor(F.col("bucket") / 1000).alias("up")).agg(F.sha2(joined("bucket", F.col("h")), 256).alias("h"))
    return upper.groupBy("source").agg(F.substring(F.sha2(joined("up", F.col("h")), 256), 1, 16).alias("digest"))


# ---- taxonomy

CENTRE = "cen as (select label::varchar as category, [" + ", ".join(f"avg(embedding[{i}]::double)" for i in range(1, 65)) + "] as centre from embeddings where label < 6 group by label)"
CLS = """pairs as (select vec_id as key, category, round(case when list_dot_product(a, a) * list_dot_product(centre, centre) = 0 then 0 else list_dot_product(a, centre) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(centre, centre))) end, 6) as score from (select vec_id, list_transform(embedding, lambda x: x::double) as a from embeddings), cen),
cls as (select key, category, score from (select *, row_number() over (partition by key order by score desc, category) as r from pairs) where r <= 3 and score >= 0.1)"""


def classes(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"), "label")
    return taxonomy.classify(e, taxonomy.centroids(e.where("label < 6"), "label", "vector", 64))


@query("cls1_classify", f"with {CENTRE}, {CLS} select * from cls")
def cls1(spark, d):
    return classes(spark, d)


@query("agg12_taxonomy_metrics", f"with {CENTRE}, {CLS}, s as (select avg(n) as mean, stddev_pop(n) as sd, count(*) as categories from (select count(*) as n from cls group by category)), i as (select count(*) as covered, avg(n) as avg_n, avg(top) as avg_top from (select count(*) as n, max(score) as top from cls group by key)) select round(covered / (select count(*) from embeddings)::double, 3) as coverage, round(avg_n, 3) as avg_categories, round(avg_top, 3) as avg_confidence, round(1 / (1 + sd / mean), 3) as balance, categories from i, s")
def agg12(spark, d):
    return taxonomy.metrics(classes(spark, d), table(spark, d, "embeddings").count())


@query("agg13_jaccard", f"with {CENTRE}, {CLS}, z as (select category, count(*) as n from cls group by category), o as (select x.category as a, y.category as b, count(*) as c from cls x join cls y on x.key = y.key and x.category < y.category group by 1, 2) select a, b, round(c::double / (p.n + q.n - c), 6) as jaccard from o join z p on p.category = a join z q on q.category = b where round(c::double / (p.n + q.n - c), 6) >= 0.05")
def agg13(spark, d):
    return taxonomy.merge_candidates(classes(spark, d), 0.05)


@query("win8_top_categories", "select user_id, event_type, n from (select *, row_number() over (partition by user_id order by n desc, event_type) as r from (select user_id, event_type, count(*) as n from events group by 1, 2)) where r <= 3")
def win8(spark, d):
    n = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    r = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("n").desc(), "event_type"))
    return n.withColumn("r", r).where("r <= 3").drop("r")


@query("top8_frequent_words", "with w as (select lower(t) as token from part, unnest(string_split(p_name, ' ')) u(t)) select token, count(*) as n from w where length(token) >= 3 group by token having count(*) >= 3 order by n desc, token limit 10")
def top8(spark, d):
    return taxonomy.frequent_patterns(table(spark, d, "part").select(F.col("p_name").alias("name")))


@query("jn11_greedy_dedupe")
def jn11(spark, d):
    e = table(spark, d, "embeddings").select(F.col("label").alias("grp"), F.col("vec_id").alias("ord"), F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    return taxonomy.greedy_distinct(e, "grp", 0.5)


# ---- graph: orders of customers; an order's lines link parts and suppliers

NODE_SQL = "nodes as (select o_custkey as id, count(*) as rev, min(o_orderdate) as created_ts, max(o_orderdate) as updated_ts from orders group by o_custkey)"
EDGE_SQL = "edges as (select l_partkey as src, l_shipmode_ as rel, l_suppkey as dst, min(l_shipdate) as created_ts, max(l_shipdate) as updated_ts, arg_max(l_returnflag = 'R', (epoch_us(l_shipdate)::hugeint * 2 + case when l_returnflag = 'R' then 1 else 0 end)) as tombstone from (select *, l_linestatus as l_shipmode_ from lineitem) group by 1, 2, 3)"


def nodes(spark, d):
    o = table(spark, d, "orders")
    log = o.select(F.col("o_custkey").alias("id"), F.col("o_orderdate").alias("ts"), F.lit("customer").alias("type"), F.lit("repo").alias("scope"), F.col("o_orderkey").cast("string").alias("payload"))
    return graph.node_versions(log)


def edges(spark, d):
    log = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_linestatus").alias("rel"), F.col("l_suppkey").alias("dst"), F.col("l_shipdate").alias("ts"), (F.col("l_returnflag") == "R").alias("tombstone"))
    return graph.edge_versions(log)


@query("grf1_win4_nodes", f"with {NODE_SQL} select * from nodes")
def grf1(spark, d):
    return nodes(spark, d).select("id", "rev", "created_ts", "updated_ts")


@query("grf2_tombstones", f"with {EDGE_SQL} select src, rel, dst, tombstone from edges")
def grf2(spark, d):
    return edges(spark, d).select("src", "rel", "dst", "tombstone")


@query("grf3_neighbours", f"with {EDGE_SQL} select src as node, rel, dst as other from edges where src = 7 and not tombstone union all select dst, rel, src from edges where dst = 7 and rel = 'O' and not tombstone")
def grf3(spark, d):
    e = edges(spark, d)
    return graph.neighbours(e, 7).unionByName(graph.neighbours(e, 7, "in", "O"))


POLICY_SQL = "pol as (select o_orderpriority as scope, o_orderstatus as namespace, o_custkey as key, row_number() over (partition by o_orderpriority, o_orderstatus, o_custkey order by o_orderdate, o_orderkey) as rev, o_orderkey as payload from orders)"


def policies(spark, d):
    w = Window.partitionBy("o_orderpriority", "o_orderstatus", "o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("scope"), F.col("o_orderstatus").alias("namespace"), F.col("o_custkey").alias("key"), F.row_number().over(w).alias("rev"), F.col("o_orderkey").alias("payload"))


@query("win3_policy_latest", f"with {POLICY_SQL} select scope, namespace, key, max(rev) as rev, arg_max(payload, rev) as payload from pol group by 1, 2, 3")
def win3(spark, d):
    return graph.latest_policy(policies(spark, d))


@query("grf4_policy_at_rev", f"with {POLICY_SQL} select scope, namespace, key, max(rev) as rev, arg_max(payload, rev) as payload from pol where rev <= 2 group by 1, 2, 3")
def grf4(spark, d):
    return graph.latest_policy(policies(spark, d), 2)


DIFF_AT = "2001-01-01"


@query("set4_diff_since", f"with {NODE_SQL}, {EDGE_SQL} select case when created_ts >= timestamp '1998-01-01' then 'node_added' else 'node_updated' end as change, id::varchar as id from nodes where updated_ts >= timestamp '1998-01-01' union all select case when tombstone then 'edge_deleted' else 'edge_added' end, src || '|' || rel || '|' || dst from edges where (created_ts >= timestamp '1998-01-01' and not tombstone) or (updated_ts >= timestamp '1998-01-01' and tombstone)".replace("1998-01-01", DIFF_AT))
def set4(spark, d):
    return graph.diff_since(nodes(spark, d), edges(spark, d), F.lit(DIFF_AT).cast("timestamp_ntz"))


@query("agg16_graph_stats", f"with {NODE_SQL}, {EDGE_SQL}, {POLICY_SQL} select (select count(*) from nodes) as nodes, count(*) as edges, count(*) filter (not tombstone) as live_edges, (select count(*) from (select distinct scope, namespace, key from pol)) as policies from edges")
def agg16(spark, d):
    return graph.graph_stats(nodes(spark, d), edges(spark, d), policies(spark, d))


@query("grf10_bfs", """with recursive e as (select n_nationkey + 100 as src, n_regionkey as dst from nation union all select c_custkey + 1000, c_nationkey + 100 from customer),
b as (select src, dst from e union all select dst, src from e), r as (select 1001::bigint as node, 0 as depth union select b.dst, r.depth + 1 from r join b on b.src = r.node where r.depth < 3)
select node, min(depth) as depth from r group by node""")
def grf10(spark, d):
    n = table(spark, d, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("src"), F.col("n_regionkey").cast("long").alias("dst"))
    c = table(spark, d, "customer").select((F.col("c_custkey") + 1000).alias("src"), (F.col("c_nationkey") + 100).cast("long").alias("dst"))
    return graph.reach(n.unionByName(c).withColumn("tombstone", F.lit(False)), spark.range(1001, 1002).toDF("node"), 3)


@query("grf7_relations", "with n as (select event_type as name, min(ts) as ts from events group by 1 union all select 'calls', timestamp '2024-01-01') select name, case when name = 'calls' then 3 else 999 + row_number() over (partition by name = 'calls' order by ts, name) end as rel from n")
def grf7(spark, d):
    names = table(spark, d, "events").select(F.col("event_type").alias("name"), "ts")
    own = spark.createDataFrame([("calls", "2024-01-01")], "name string, ts string").select("name", F.col("ts").cast("timestamp_ntz").alias("ts"))
    return graph.interned(names.unionByName(own))


@query("grf8_orphans", f"with {EDGE_SQL} select src, rel, dst from edges where not tombstone and (src not between 1 and 150 or dst not between 1 and 150)")
def grf8(spark, d):
    return graph.orphans(edges(spark, d), spark.range(1, 151).toDF("id"))


@query("grf6_bootstrap", "select 'file' as type, count(*) as nodes from documents union all select 'source', count(distinct source) from documents union all select 'contains', count(*) from documents")
def grf6(spark, d):
    t = table(spark, d, "documents")
    f = t.select(F.lit("file").alias("type"), F.col("doc_id").cast("string").alias("id"))
    s = t.select(F.lit("source").alias("type"), F.col("source").alias("id")).distinct()
    e = t.select(F.lit("contains").alias("type"), F.concat_ws("|", "source", "doc_id").alias("id"))
    return f.unionByName(s).unionByName(e).groupBy("type").agg(F.count("*").alias("nodes"))


@query("win1_rank_fusion_order", "select l_suppkey as key, s as score, rank from (select *, row_number() over (order by s desc, l_suppkey) as rank from (select l_suppkey, sum(l_quantity) as s from lineitem group by 1)) where rank <= 10")
def win1(spark, d):
    return lexical.ranked(table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("key")).agg(F.sum("l_quantity").alias("score")), 10)


@query("set6_set_algebra", "select 'both' as part, count(*) as n from (select p_size from part where p_brand = 'Brand#1' intersect select p_size from part where p_brand = 'Brand#2') union all select 'first', count(*) from (select p_size from part where p_brand = 'Brand#1' except select p_size from part where p_brand = 'Brand#2')")
def set6(spark, d):
    size = lambda b: table(spark, d, "part").where(F.col("p_brand") == b).select("p_size")
    count = lambda df, n: df.agg(F.lit(n).alias("part"), F.count("*").alias("n"))
    return count(size("Brand#1").intersect(size("Brand#2")), "both").unionByName(count(size("Brand#1").exceptAll(size("Brand#2")).distinct().join(size("Brand#2"), "p_size", "left_anti"), "first"))


@query("jn1_enrich", "select l_orderkey, l_linenumber, p_name, s_name from lineitem left join part on p_partkey = l_partkey left join supplier on s_suppkey = l_suppkey where l_quantity >= 49")
def jn1(spark, d):
    part, supplier = table(spark, d, "part").select("p_partkey", "p_name"), table(spark, d, "supplier").select("s_suppkey", "s_name")
    big = table(spark, d, "lineitem").where("l_quantity >= 49")
    return big.join(part, F.col("p_partkey") == F.col("l_partkey"), "left").join(supplier, F.col("s_suppkey") == F.col("l_suppkey"), "left").select("l_orderkey", "l_linenumber", "p_name", "s_name")


@query("jn3_full_outer", "select coalesce(a.k, b.k) as k, a.n as events, b.n as orders from (select user_id as k, count(*) as n from events group by 1) a full join (select o_custkey as k, count(*) as n from orders group by 1) b on a.k = b.k")
def jn3(spark, d):
    a = table(spark, d, "events").groupBy(F.col("user_id").alias("k")).agg(F.count("*").alias("events"))
    b = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("orders"))
    return a.join(b, "k", "full_outer")
