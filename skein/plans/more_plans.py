"""Queries of results, sessions, index upkeep and small functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.functions import text as t
from skein.operators import code, index, memory, search
from skein.operators.patterns import line_matches
from skein.plans import corpus
from skein.plans.base import FILES_SQL, files, per_supplier, per_supplier_sql, query, table
from skein.plans.code_plans import CALL_SQL, CODE_SQL, SYM_SQL, calls, code_files, labels_sql
from skein.plans.search_plans import AGES, TOKENS, ages, vectors
from skein.plans.table_plans import CENTRE, CLS, CONV_SQL, LINE_SQL, LINES, SETS, classes

SOURCES = "with f as (select doc_id as key, 'file' as kind, 1 as r from documents), s as (select vec_id as key, 'symbol' as kind, 2 as r from embeddings), a as (select * from f union all select * from s)"


@query("set1_union_sources", f"{SOURCES} select key, arg_min(kind, r) as kind from a group by key")
def set1(spark, d):
    f = table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.lit("file").alias("kind"))
    return search.union_first([f, vectors(spark, d).select("key", F.lit("symbol").alias("kind"))])


@query("lkp2_upsert_latest", "select k, arg_max(o_orderkey, o_orderkey) as last from (select o_custkey as k, o_orderkey, o_orderdate from orders) o where (k, o_orderdate) in (select o_custkey, max(o_orderdate) from orders group by 1) group by k")
def lkp2(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("last"), F.struct("o_orderdate", "o_orderkey").alias("v"))
    return index.upserted(o.where("last % 2 = 0"), o.where("last % 2 <> 0"), "k", "v").drop("v")


@query("idx4_delete", "select c_custkey from customer where c_custkey not in (select o_custkey from orders)")
def idx4(spark, d):
    return index.deleted(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("lkp6_symbols", f"with {SYM_SQL} select path, name, kind, line from sym where path = 'm3/src/auth.py'")
def lkp6(spark, d):
    return per_supplier(spark, d, corpus.SYMBOL_COLUMNS, corpus.SYMBOLS, corpus.SYMBOL_OF).where("path = 'm3/src/auth.py'")


@query("lkp9_insights_by_type", f"with {FILES_SQL}, {LINE_SQL} select key, line, text from ins where type_id = 'insight:license'")
def lkp9(spark, d):
    return line_matches(files(spark, d), LINES).where("type_id = 'insight:license'").select("key", "line", "text")


@query("flt4_query_search", "select conv_id, turn from conversations where role = 'user' and contains(lower(text), 'ver') order by conv_id desc, turn desc limit 30")
def flt4(spark, d):
    c = table(spark, d, "conversations").where((F.col("role") == "user") & F.contains(F.lower("text"), F.lit("ver")))
    return c.orderBy(F.col("conv_id").desc(), F.col("turn").desc()).limit(30).select("conv_id", "turn")


@query("flt7_pattern_files", "with n as (select doc_id, len(regexp_extract_all(text, '[*%&$#]{3}')) as n, length(text) as len from documents) select doc_id, n, n >= 20 or n * 1000.0 / greatest(len, 1) > 0.8 as pattern_file from n where n > 0")
def flt7(spark, d):
    n = table(spark, d, "documents").select("doc_id", F.regexp_count("text", F.lit("[*%&$#]{3}")).cast("long").alias("n"), F.length("text").alias("len"))
    return n.where("n > 0").select("doc_id", "n", ((F.col("n") >= 20) | (F.col("n") * 1000.0 / F.greatest("len", F.lit(1)) > 0.8)).alias("pattern_file"))


@query("prj1_result_projection", "with v as (select vec_id as key from embeddings) select key, coalesce(d.source || '/' || d.doc_id, p.url, 'unknown') as path, case when d.doc_id is not null then 'file' when p.page_id is not null then 'page' else 'symbol' end as kind from v left join documents d on d.doc_id = key left join pages p on p.page_id = key")
def prj1(spark, d):
    v = vectors(spark, d).select("key")
    f, p = files(spark, d).select("key", "path"), table(spark, d, "pages").select(F.col("page_id").alias("key"), "url")
    return v.join(f, "key", "left").join(p, "key", "left").select("key", F.coalesce("path", "url", F.lit("unknown")).alias("path"), F.when(F.col("path").isNotNull(), "file").when(F.col("url").isNotNull(), "page").otherwise("symbol").alias("kind"))


@query("top7_thread_prune", "select session, path, n from (select *, row_number() over (partition by session order by n desc, path) as r from (select user_id % 10 as session, event_type || user_id as path, count(*) as n from events group by 1, 2)) where r <= 5")
def top7(spark, d):
    n = table(spark, d, "events").groupBy((F.col("user_id") % 10).alias("session"), F.concat("event_type", F.col("user_id").cast("string")).alias("path")).agg(F.count("*").alias("n"))
    return n.withColumn("r", F.row_number().over(Window.partitionBy("session").orderBy(F.col("n").desc(), "path"))).where("r <= 5").drop("r")


@query("top9_sorted_items", f"with {SYM_SQL} select name, path from sym order by lower(name), path limit 6")
def top9(spark, d):
    return per_supplier(spark, d, corpus.SYMBOL_COLUMNS, corpus.SYMBOLS, corpus.SYMBOL_OF).orderBy(F.lower("name"), "path").limit(6).select("name", "path")


@query("jn2_symbol_mtime", f"with {AGES} select o_orderkey, coalesce(s.mtime, p.mtime) as mtime from orders left join ages s on s.key = o_orderkey % 400 left join ages p on p.key = o_custkey")
def jn2(spark, d):
    a = ages(spark, d)
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 400).alias("k1"), F.col("o_custkey").alias("k2"))
    own, parent = a.select(F.col("key").alias("k1"), F.col("mtime").alias("m1")), a.select(F.col("key").alias("k2"), F.col("mtime").alias("m2"))
    return o.join(own, "k1", "left").join(parent, "k2", "left").select("o_orderkey", F.coalesce("m1", "m2").alias("mtime"))


@query("jn4_conventions_of_results", f"with {CODE_SQL}, {CONV_SQL}, c as (select distinct unnest(case when ext = 'py' then ['context:backend', 'context:data'] else ['context:frontend'] end) as context from code where path like '%/src/db%' or path like '%.ts') select distinct id, priority from conv, c where list_contains(scope, context)")
def jn4(spark, d):
    f = code_files(spark, d).where("path like '%/src/db%' or path like '%.ts'")
    contexts = f.select(F.explode(F.when(F.col("ext") == "py", F.array(F.lit("context:backend"), F.lit("context:data"))).otherwise(F.array(F.lit("context:frontend")))).alias("context"))
    return memory.for_contexts(per_supplier(spark, d, corpus.CONVENTION_COLUMNS, corpus.CONVENTIONS, corpus.CONVENTION_OF), contexts).select("id", "priority")


PATTERN_COLUMNS = "key string, pattern string, matched array<string>"
PATTERNS = [("p1", "token", ["src/auth.py", "src/main.py"]), ("p2", "user", ["src/main.py", "src/db/models.py"]), ("p3", "none", [])]


@query("jn5_pattern_files", f"with {per_supplier_sql('p', PATTERN_COLUMNS, PATTERNS)} select path, string_agg(pattern, ',' order by pattern) as patterns from (select pattern, concat('m', k, '/', unnest(matched)) as path from p) group by path")
def jn5(spark, d):
    p = per_supplier(spark, d, PATTERN_COLUMNS, PATTERNS, {"k": "k"}).select("pattern", "k", F.explode("matched").alias("path")).withColumn("path", F.expr(corpus.PATH))
    return p.groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("pattern")), ",").alias("patterns"))


@query("jn6_thread_details", "select user_id as thread, count(*) as touches, count(*) filter (event_type = 'view') as files, count(*) filter (event_type = 'error') as queries, count(distinct event_type) as tools from events group by 1")
def jn6(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.col("user_id").alias("thread")).agg(F.count("*").alias("touches"), F.count_if(F.col("event_type") == "view").alias("files"), F.count_if(F.col("event_type") == "error").alias("queries"), F.count_distinct("event_type").alias("tools"))


@query("jn10_entity_symbols", f"with {SYM_SQL}, e(entity) as (values ('User'), ('Order'), ('Token')) select entity, name from e join sym on contains(lower(name), lower(entity))")
def jn10(spark, d):
    e = spark.createDataFrame([("User",), ("Order",), ("Token",)], "entity string")
    return per_supplier(spark, d, corpus.SYMBOL_COLUMNS, corpus.SYMBOLS, corpus.SYMBOL_OF).join(e, F.contains(F.lower("name"), F.lower("entity"))).select("entity", "name")


CONFIGS = [("a/.eslintrc.json", '{"rules": {"no-eval": "error", "camelcase": ["warn", {}], "semi": 0, "import/order": 2}}'), ("b/.oxlintrc.json", '{"rules": {"no-print": "error"}}'), ("c/.eslintrc.json", "broken")]

RULES = [("a/.eslintrc.json", "no-eval", "error", "convention:security"), ("a/.eslintrc.json", "camelcase", "warn", "convention:naming"), ("a/.eslintrc.json", "import/order", "error", "convention:architecture"), ("b/.oxlintrc.json", "no-print", "error", "convention:style")]
RULE_SQL = per_supplier_sql("v", "path string, rule string, severity string, category string", RULES, corpus.PATH_OF)


def configs(spark, d):
    return per_supplier(spark, d, "path string, content string", CONFIGS, corpus.PATH_OF)


@query("src14_linter_rules", f"with {RULE_SQL} select path, rule, severity, category from v")
def src14(spark, d):
    return index.linter_rules(configs(spark, d)).withColumn("category", index.rule_category(F.col("rule")))


@query("jn13_new_rules", f"with {RULE_SQL}, {CONV_SQL} select concat(rule, '-', k) as rule from v where concat(rule, '-', k) not in (select name from conv)")
def jn13(spark, d):
    rules = index.linter_rules(configs(spark, d)).select(F.concat("rule", F.lit("-"), F.regexp_extract("path", "^m([0-9]+)/", 1)).alias("rule"))
    known = per_supplier(spark, d, corpus.CONVENTION_COLUMNS, corpus.CONVENTIONS, corpus.CONVENTION_OF)
    return rules.join(known.select(F.col("name").alias("rule")), "rule", "left_anti")


@query("jn14_derived_from", "select l_orderkey as src, 'derived_from' as rel, l_partkey as dst from lineitem where l_linenumber = 1 group by all")
def jn14(spark, d):
    keys = table(spark, d, "lineitem").where("l_linenumber = 1").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("keys"))
    return keys.select(F.col("l_orderkey").alias("src"), F.lit("derived_from").alias("rel"), F.explode("keys").alias("dst"))


@query("agg7_index_stats", "select (select count(*) from documents) as files, (select count(*) from pages) as pages, (select count(*) from embeddings where embedding is not null) as embedded, (select sum(length(text)) from documents)::bigint as characters")
def agg7(spark, d):
    n = lambda name, what: table(spark, d, name).agg(what)
    return n("documents", F.count("*").alias("files")).crossJoin(n("pages", F.count("*").alias("pages"))).crossJoin(n("embeddings", F.count("embedding").alias("embedded"))).crossJoin(n("documents", F.sum(F.length("text")).cast("long").alias("characters")))


@query("agg17_session_metrics", "select conv_id, count(*) as lines, count(*) filter (role = 'user') as turns, round(count(*) filter (role = 'assistant')::double / count(*), 6) as share from conversations group by conv_id")
def agg17(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id")
    return c.agg(F.count("*").alias("lines"), F.count_if(F.col("role") == "user").alias("turns"), F.round(F.count_if(F.col("role") == "assistant") / F.count("*"), 6).alias("share"))


@query("win5_first_per_line", f"with {FILES_SQL}, {LINE_SQL} select key, type_id, min(line) as line from ins group by 1, 2")
def win5(spark, d):
    w = Window.partitionBy("key", "type_id").orderBy("line")
    return line_matches(files(spark, d), LINES).withColumn("n", F.row_number().over(w)).where("n = 1").select("key", "type_id", "line")


@query("win6_ema_centroid", """with r as (select label as thread, embedding, row_number() over (partition by label order by vec_id desc) - 1 as k, row_number() over (partition by label order by vec_id) as i from embeddings),
u as (select thread, case when i = 1 then 1.0::double else 0.3::double end * pow(0.7::double, k) as w, unnest(range(1, 65)) as d, embedding from r), s as (select thread, d, sum(w * embedding[d]::double) as x from u group by 1, 2)
select thread, list(round(x, 6) + 0.0 order by d) as centre from s group by thread""")
def win6(spark, d):
    e = table(spark, d, "embeddings").select(F.col("label").alias("thread"), F.col("vec_id").alias("ord"), F.col("embedding").alias("vector"))
    return index.ema_centroids(e).select("thread", F.transform("centre", lambda x: F.round(x, 6) + 0.0).alias("centre"))


@query("win7_last_symbol", "select c_name_ as name, max(c_custkey) as at from (select c_custkey, c_mktsegment || c_nationkey as c_name_ from customer) group by 1")
def win7(spark, d):
    c = table(spark, d, "customer").select(F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("name"), F.col("c_custkey").alias("at"))
    w = Window.partitionBy("name").orderBy(F.col("at").desc())
    return c.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


@query("win10_recent_distinct", "with e as (select user_id as session, row_number() over (partition by user_id order by ts, event_id) as ord, event_type as key from events), b as (select *, lag(ord) over (partition by session, key order by ord) as before_ from e) select session, ord, key from b where before_ is null or ord - before_ > 8")
def win10(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select(F.col("user_id").alias("session"), F.row_number().over(w).alias("ord"), F.col("event_type").alias("key"))
    return index.recent_distinct(e, 8)


@query("str4_index_text", f"with {per_supplier_sql('i', corpus.IDENTIFIER_COLUMNS, corpus.IDENTIFIERS, corpus.IDENTIFIER_OF)} select text, array_to_string({TOKENS.format(t='text')}, ' ') || ' ' || lower(text) as indexed from i")
def str4(spark, d):
    return per_supplier(spark, d, corpus.IDENTIFIER_COLUMNS, corpus.IDENTIFIERS, corpus.IDENTIFIER_OF).select("text", t.index_text(F.col("text")).alias("indexed"))


@query("str14_routes", f"with {CODE_SQL} select path, case when base_path = 'src/app/api/users/[id]/route.ts' then '/api/users/:id' end as route from code")
def str14(spark, d):
    return code_files(spark, d).select("path", t.route_of_file(F.col("path")).alias("route"))


@query("dat3_iso_times", "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') as iso, epoch_us(ts) // 1000000 as seconds from events")
def dat3(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("seconds"))


@query("dat4_expired", "select count(*) as expired from events where ts < timestamp '2024-01-31' - interval 7 day")
def dat4(spark, d):
    return table(spark, d, "events").where("ts < timestamp_ntz '2024-01-31 00:00:00' - interval 7 days").agg(F.count("*").alias("expired"))


@query("arr1_membership", f"with {CONV_SQL} select id, list_has_all(scope, ['context:backend', 'context:api']) as every, list_has_any(scope, ['context:backend', 'context:api']) as some from conv")
def arr1(spark, d):
    wanted = ["context:backend", "context:api"]
    return per_supplier(spark, d, corpus.CONVENTION_COLUMNS, corpus.CONVENTIONS, corpus.CONVENTION_OF).select("id", memory.all_of(F.col("scope"), wanted).alias("every"), memory.any_of_or_empty(F.col("scope"), wanted).alias("some"))


@query("arr2_first_n", "select source, array_to_string((list(doc_id::varchar order by doc_id))[:5], ', ') || case when count(*) > 5 then ' and ' || (count(*) - 5) || ' more' else '' end as shown from documents group by source")
def arr2(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id")
    ranked = docs.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")))
    agg = ranked.groupBy("source").agg(F.array_sort(F.collect_list(F.when(F.col("r") <= 5, F.col("doc_id")))).alias("ids"), F.count("*").alias("n"))
    more = F.when(F.col("n") > 5, F.concat(F.lit(" and "), (F.col("n") - 5).cast("string"), F.lit(" more"))).otherwise("")
    return agg.select("source", F.concat(F.array_join(F.transform("ids", lambda x: x.cast("string")), ", "), more).alias("shown"))


@query("map1_category_index", f"with {CENTRE}, {CLS} select category, string_agg(key || ':' || round(score * 1000)::bigint, ',' order by key) as scores from cls group by category")
def map1(spark, d):
    index_ = classes(spark, d).groupBy("category").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "score")))).alias("scores"))
    shown = F.transform(F.map_entries("scores"), lambda x: F.concat_ws(":", x["key"].cast("string"), F.round(x["value"] * 1000).cast("long").cast("string")))
    return index_.select("category", F.array_join(shown, ",").alias("scores"))


@query("jsn1_event_props", "select event_id, (props->>'k')::bigint as k from events where (props->>'k')::bigint > 90")
def jsn1(spark, d):
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return table(spark, d, "events").select("event_id", k.alias("k")).where("k > 90")


@query("txt2_symbol_postings", f"with {SYM_SQL}, x as (select path || '#' || name as key, unnest({TOKENS.format(t='name')}) as term from sym) select key, term, count(*) as tf from x group by 1, 2")
def txt2(spark, d):
    from skein.operators.lexical import postings

    s = per_supplier(spark, d, corpus.SYMBOL_COLUMNS, corpus.SYMBOLS, corpus.SYMBOL_OF).select(F.concat_ws("#", "path", "name").alias("key"), "name")
    return postings(s, fields=("name",)).select("key", "term", "tf")


@query("cg3_graph_import", f"with {CALL_SQL} select caller as src, 'calls' as rel, callee_file as dst, count(*) as n from calls group by 1, 3")
def cg3(spark, d):
    return calls(spark, d).groupBy(F.col("caller").alias("src"), F.lit("calls").alias("rel"), F.col("callee_file").alias("dst")).agg(F.count("*").alias("n"))


@query("ir3_business_rules", f"with l as (select source || '/' || doc_id as path, {labels_sql('text', code.RULES)} as rules from documents) select * from l where rules <> ''")
def ir3_rules(spark, d):
    return code.labels(files(spark, d), code.RULES, "rules")


@query("idx1_register_contexts", f"with {FILES_SQL} select path, length(content) as size, sha256(content) as content_hash from files")
def idx1(spark, d):
    return index.register(files(spark, d).select("path", "ext", "content"))["files"].drop("ext")


@query("idx1_register_symbols")
def idx1_symbols(spark, d):
    return index.register(code_files(spark, d))["symbols"]


@query("idx3_missing_embeddings", "select doc_id as key from documents where doc_id not in (select vec_id from embeddings)")
def idx3(spark, d):
    return index.missing_embeddings(files(spark, d).select("key"), vectors(spark, d))


@query("mem1_written_redacted", "select doc_id, regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+|\\b[0-9]{1,3}(?:\\.[0-9]{1,3}){3}\\b|\\b[0-9a-f]{32,}\\b') as has_secrets from documents")
def mem1(spark, d):
    return index.written(table(spark, d, "documents").select("doc_id", "text"), "redact").select("doc_id", "has_secrets")


CHECKS = [("a", "required", "x+"), ("", "required", "x"), ("b", "never", "x"), ("c", "optional", "(x"), ("d", "optional", r"\(x")]

PROBLEMS = [("a", None), ("", "no_name"), ("b", "unknown_priority"), ("c", "bad_pattern"), ("d", None)]


@query("cnv1_validation", f"with {per_supplier_sql('v', 'name string, problem string', PROBLEMS)} select k, name, problem from v")
def cnv1(spark, d):
    c = per_supplier(spark, d, "name string, priority string, pattern string", CHECKS, {"k": "k"})
    return c.select("k", "name", index.valid_convention(F.col("name"), F.col("priority"), F.col("pattern")).alias("problem"))


@query("stm2_turn_memories", "with t as (select conv_id, turn, role, text, sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn) as k from conversations) select conv_id as session, k as turn_id, min(turn) as first_ord, sum(length(text))::bigint as characters from t where role = 'assistant' group by 1, 2")
def stm2(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("ord"), "role", F.length("text").alias("n"))
    return code.turn_ids(c).where("role = 'assistant'").groupBy("session", "turn_id").agg(F.min("ord").alias("first_ord"), F.sum("n").cast("long").alias("characters"))


@query("stm7_pattern_cache", "select source || ':' || lang as key, list_sort(list(doc_id))[:20] as matched from documents where contains(text, 'token = ') group by 1")
def stm7(spark, d):
    hit = table(spark, d, "documents").where(F.contains("text", F.lit("token = "))).select(F.concat_ws(":", "source", "lang").alias("key"), "doc_id")
    first = hit.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("doc_id"))).where("r <= 20")
    return first.groupBy("key").agg(F.array_sort(F.collect_list("doc_id")).alias("matched"))


@query("agg8_runtime_sets", f"with {FILES_SQL} select key, len(regexp_extract_all(content, '(?i)\\blicen[cs]ed?\\b')) as n from files where len(regexp_extract_all(content, '(?i)\\blicen[cs]ed?\\b')) > 0")
def agg8_runtime(spark, d):
    from skein.operators.patterns import detect_contexts

    return detect_contexts(files(spark, d), [s for s in SETS if s.type_id == "context:legal"], 1).select("key", "n")
