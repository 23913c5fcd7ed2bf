"""Queries of scans with offsets, fielded search, vector search over memories and conventions, snapshots and stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import text as t
from skein.functions.text import NARRATION, NARRATION_BELOW, NARRATION_PREFIXES
from skein.operators import code, graph, index, lexical, memory, patterns, search, taxonomy
from skein.operators.patterns import Library, PatternSet
from skein.plans import corpus
from skein.plans.base import FILES_SQL, ORACLE_SQL, files, per_supplier, per_supplier_sql, query, quoted, table
from skein.plans.code_plans import code_files
from skein.plans.search_plans import COS, E0, TOKENS, first_vector, vectors
from skein.plans.table_plans import EDGE_SQL, MEM_SQL, edges, memories
from skein.sources import manifests

# ---- scans with offsets, in bytes

LEGAL = PatternSet("context:legal", (r"(?i)\blicen[cs]ed?\b", r"token = "))
LINKS = PatternSet("context:links", (r"<a href=", r"</p>"))


def spans_sql(source: str, sets: PatternSet) -> str:
    """All matches of a set's patterns in source (key, content): the pieces between the matches place them."""
    each = [
        f"""select key, {n} as pattern, s as start, s + strlen(m) as "end" from (select key, m, sum(strlen(g)) over w + coalesce(sum(strlen(m)) over (w rows between unbounded preceding and 1 preceding), 0) as s
  from (select key, unnest(regexp_extract_all(content, {quoted(p)})) as m, unnest(list_slice(regexp_split_to_array(content, {quoted(p)}), 1, len(regexp_extract_all(content, {quoted(p)})))) as g, unnest(range(len(regexp_extract_all(content, {quoted(p)})))) as i from {source})
  window w as (partition by key order by i))"""
        for n, p in enumerate(sets.patterns, 1)
    ]
    return " union all ".join(each)


@query("pat2_spans", f"with {FILES_SQL} {spans_sql('files', LEGAL)}")
def pat2(spark, d):
    return patterns.scan(files(spark, d), LEGAL)


@query("pat3_scan_key", f"with pages_ as (select page_id as key, html as content from pages where page_id = 7) {spans_sql('pages_', LINKS)}")
def pat3(spark, d):
    page = table(spark, d, "pages").where("page_id = 7").select(F.col("page_id").alias("key"), F.col("html").alias("content"))
    return patterns.scan(page, LINKS, limit=100_000)


@query("pat1_library", f"""with {FILES_SQL}, n as (select count(*) as files from files where len(regexp_extract_all(content, '(?i)\\blicen[cs]ed?\\b')) + len(regexp_extract_all(content, 'token = ')) >= 1)
select 'context:legal' as type_id, 2 as patterns, '' as extensions, files from n union all select 'team:keys', 1, 'py,ts', 0""")
def pat1(spark, d):
    """What is registered, with the number of files in which each set shows; the later of two sets of one name counts."""
    library = Library([LEGAL])
    library.load({"id": "team:keys", "patterns": ["x"], "extensions": ["go"]})
    library.load({"id": "team:keys", "patterns": [r"api_key\s*="], "extensions": ["py", "ts"]})
    shown = patterns.detect_contexts(files(spark, d), library.sets(), 1, ext="ext").groupBy("type_id").agg(F.count("*").alias("files"))
    return library.list_all(spark).join(shown, "type_id", "left").withColumn("files", F.coalesce("files", F.lit(0).cast("long")))


# ---- text gates of memory extraction


@query("str8_snippets", """with c as (select conv_id, turn, text, instr(text, ' th') - 1 as spot from conversations where contains(text, ' th')),
s as (select *, list_filter(string_split(regexp_replace(text, '([.!?])\\s+([A-Z])', '\\1' || chr(31) || '\\2', 'g'), chr(31)), lambda x: trim(x) <> '') as ss from c),
i as (select *, coalesce(nullif(list_position(list_transform(range(1, len(ss) + 1), lambda k: (list_sum(list_transform(list_slice(ss, 1, k), lambda x: length(x))) > spot)), true), 0), 1) as n from s),
n as (select *, array_to_string(list_filter(list_transform(ss[greatest(n - 1, 1):n + 1], lambda x: trim(x)), lambda x: x <> ''), ' ') as near_ from i)
select conv_id, turn, trim(case when length(near_) > 300 then regexp_replace(near_[1:300], '(?s)^(.*) .*$', '\\1') || '...' else near_ end) as snippet from n""")
def str8(spark, d):
    c = table(spark, d, "conversations").where(F.contains("text", F.lit(" th")))
    return c.select("conv_id", "turn", t.sentence_snippet(F.col("text"), F.instr("text", " th") - 1).alias("snippet"))


def _stripped(column: str) -> str:
    for p in NARRATION_PREFIXES:
        column = f"regexp_replace({column}, {quoted('(?i)' + p)}, '')"
    return f"trim({column})"


#: Openings of narration put before conversations, so that the rules have something to find.
OPENINGS = ["", "Found it! ", "ok, so let me ", "Here's the plan. ", "Running ", "Nice! Yeah, ", "I'll "]
OPEN_SQL = f"o as (select conv_id, turn, {quoted(OPENINGS)}[turn % {len(OPENINGS)} + 1] || text as text from conversations)"


@query("str9_narration", f"with {OPEN_SQL}, r as (select conv_id, turn, {_stripped('text')} as rest, {_stripped('trim(text)')} as bare from o) select conv_id, turn, md5(rest) as digest, length(bare) < {NARRATION_BELOW} or regexp_matches(bare, {quoted('(?i)' + '|'.join(f'(?:{p})' for p in NARRATION))}) as narration from r")
def str9(spark, d):
    opening = F.element_at(F.array(*[F.lit(o) for o in OPENINGS]), (F.col("turn") % len(OPENINGS) + 1).cast("int"))
    c = table(spark, d, "conversations").select("conv_id", "turn", F.concat(opening, "text").alias("text"))
    return c.select("conv_id", "turn", F.md5(t.without_narration(F.col("text"))).alias("digest"), t.is_narration(F.col("text")).alias("narration"))


@query("str19_safe_search", "select doc_id, contains(text, 'token = ') as found, null::boolean as refused from documents")
def str19(spark, d):
    return table(spark, d, "documents").select("doc_id", t.safe_rlike(F.col("text"), F.lit("token = ")).alias("found"), t.safe_rlike(F.col("text"), F.lit("(a+)+$")).alias("refused"))


# ---- fielded and exact keyword search


PHRASE = "small widget"
FIELDED_SQL = f"""f as (select p_partkey as key, lower(p_name) as name, 5.0::double as w, p_name || ' ' || p_brand as t, 'combined' as field from part union all select p_partkey, lower(p_name), 1.0::double, p_type, 'content' from part),
tok as (select key, field, w, unnest({TOKENS.format(t='t')}) as term from f), terms as (select key, field, w, term, count(*) as tf from tok group by all), len_ as (select key, field, sum(tf) as dl from terms group by all),
mean_ as (select field, avg(dl) as avgdl, count(*) as n from len_ group by field), df_ as (select field, term, count(*) as df from terms where term in ('{"', '".join(PHRASE.split())}') group by all),
part_ as (select key, sum(w * ln(1.0 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)))) as score from terms join df_ using (field, term) join len_ using (key, field) join mean_ using (field) group by key),
every as (select key, score from part_ union all select p_partkey, 10.0 from part where contains(lower(p_name), '{PHRASE}')), s as (select key, sum(score) as score from every group by key)"""


@query("txt3_fielded", f"with {FIELDED_SQL} select key, round(score, 6) as score from s")
def txt3(spark, d):
    docs = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.concat_ws(" ", "p_name", "p_brand").alias("combined"), F.col("p_type").alias("content"))
    return lexical.fielded(docs, PHRASE).select("key", F.round("score", 6).alias("score"))


@query("txt5_exact", "select p_partkey from part where lower(p_name) = 'large bolt'")
def txt5(spark, d):
    return lexical.exact(table(spark, d, "part"), "Large Bolt", "p_name").select("p_partkey")


@query("txt6_stats", f"with {FILES_SQL}, tok as (select key, unnest({TOKENS.format(t='content')}) as term from files where path not like 'src1%') select count(distinct key) as documents, count(distinct term) as terms, count(*) as postings from (select distinct key, term from tok)")
def txt6(spark, d):
    f = files(spark, d)
    return lexical.index_stats(lexical.without(lexical.postings(f), f.where("path like 'src1%'")))


@query("idx9_registry")
def idx9(spark, d):
    from skein.functions.vectors import hashing_embedder

    return index.registry(files(spark, d), table(spark, d, "part").select(F.lit("parts").alias("path"), F.col("p_name").alias("name"), F.col("p_type").alias("kind")), hashing_embedder(64))


@query("idx7_warm")
def idx7(spark, d):
    from skein.functions.vectors import hashing_embedder

    return index.warmed(files(spark, d), vectors(spark, d).where("key % 2 = 0"), hashing_embedder(64), 50)


@query("txt11_sgrep")
def sgrep(spark, d):
    from skein.functions.vectors import hashing_embedder

    embed = hashing_embedder(64)
    asked = spark.createDataFrame([("licensed under the license",)], "text string").select(embed("text").alias("v")).first()["v"]
    return search.sgrep(files(spark, d), ["(?i)licen[cs]ed", "token = "], asked, embed, 20)


# ---- memories and conventions with a query vector

WITH_VECTOR = "w as (select m.*, list_transform(e.embedding, lambda x: x::double) as a, " + E0 + " as b from mem m join embeddings e on e.vec_id = m.id)"


@query("mem2_vector", f"with {MEM_SQL}, {WITH_VECTOR}, n as (select id, {COS} as score from (select * from w order by created_at desc, id limit 100)) select id, round(score, 6) as score from n order by n.score desc, id limit 10")
def mem2_vector(spark, d):
    with_vector = memories(spark, d).join(vectors(spark, d).withColumnRenamed("key", "id"), "id")
    return memory.search_memories(with_vector, first_vector(spark, d), 10).select("id", F.round("score", 6).alias("score"))


PRIORITY = "['required', 'recommended', 'optional'][vec_id % 3 + 1]"


@query("cnv2_search", f"""with c as (select 'conv:' || vec_id as id, 'rule-' || vec_id as name, {PRIORITY} as priority, vec_id % 3 as p, list_transform(embedding, lambda x: x::double) as a, {E0} as b from embeddings where vec_id % 2 = 0),
f as (select id, {COS} as score from (select * from c order by p, name limit 50)) select id, round(score, 6) as score from f order by f.score desc, id limit 10""")
def cnv2(spark, d):
    e = table(spark, d, "embeddings")
    priority = F.element_at(F.array(F.lit("required"), F.lit("recommended"), F.lit("optional")), (F.col("vec_id") % 3 + 1).cast("int"))
    category = F.when(F.col("vec_id") % 2 == 0, "convention:even").otherwise("convention:odd")
    conventions = e.select(F.concat(F.lit("conv:"), F.col("vec_id").cast("string")).alias("id"), F.concat(F.lit("rule-"), F.col("vec_id").cast("string")).alias("name"), priority.alias("priority"), category.alias("category"), F.col("embedding").alias("vector"))
    return memory.search_conventions(conventions, first_vector(spark, d), 10, category="convention:even").select("id", F.round("score", 6).alias("score"))


@query("mem4_share", f"with {MEM_SQL} select id, id in (select vec_id from embeddings where vec_id % 10 = 0) as is_team, case when id in (select vec_id from embeddings where vec_id % 10 = 0) then 'team' end as owner_id from mem")
def mem4(spark, d):
    return memory.shared(memories(spark, d), vectors(spark, d).where("key % 10 = 0").select(F.col("key").alias("id")), "team").select("id", "is_team", "owner_id")


@query("mem3_access", f"with {MEM_SQL}, l as (select user_id as id, count(*) as n, max(epoch_us(ts)) / 1e6 as last_ from events group by 1) select id, access_count + coalesce(n, 0) as access_count, greatest(last_accessed, last_) as last_accessed from mem left join l using (id)")
def mem3(spark, d):
    log = table(spark, d, "events").select(F.col("user_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"))
    return memory.accessed(memories(spark, d), log).select("id", "access_count", "last_accessed")


# ---- graph: node filters and snapshots


@query("flt3_nodes", "select o_orderkey as id from orders where o_orderpriority = '1-URGENT' and o_orderstatus = 'F'")
def flt3(spark, d):
    nodes = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("type"), F.col("o_orderstatus").alias("scope"))
    return graph.iter_nodes(nodes, "1-URGENT", "F").select("id")


@query("grf9_snapshot", f"""with {EDGE_SQL}, live as (select src, rel, dst from edges where not tombstone), o as (select src as id, string_agg(rel || ':' || dst, ',' order by rel, dst) as x, count(*) as n from live group by src),
i as (select dst as id, string_agg(rel || ':' || src, ',' order by rel, src) as x, count(*) as n from live group by dst)
select p_partkey as id, coalesce(o.x, '') as out, coalesce(i.x, '') as into_, coalesce(o.n, 0) as degree from part left join o on o.id = p_partkey left join i on i.id = p_partkey""")
def grf9(spark, d):
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("type"), F.lit("repo").alias("scope"), F.col("p_name").alias("payload"))
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["rel"], x["other"].cast("string"))), ",")
    return graph.snapshot(nodes, edges(spark, d)).select("id", shown("out").alias("out"), shown("into").alias("into_"), F.size("out").cast("long").alias("degree"))


# ---- stores and lookups


@query("snk3_blobs", "select doc_id, strlen(text) as size, sha256(text) as checksum, doc_id % 9 = 4 as damaged from documents")
def snk3(spark, d):
    store = index.stored(table(spark, d, "documents").select("doc_id", "text"), "text")
    # Every ninth content is changed after it was stored.
    later = store.withColumn("text", F.when(F.col("doc_id") % 9 == 4, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    bad = index.damaged(later, "text").select("doc_id", F.lit(True).alias("damaged"))
    return store.drop("text").join(bad, "doc_id", "left").withColumn("damaged", F.coalesce("damaged", F.lit(False)))


@query("lkp4_content", f"with {FILES_SQL} select key, strlen(content) as length, md5(content) as digest from files where path = (select path from files where key = 3)")
def lkp4(spark, d):
    f = files(spark, d)
    found = f.join(f.where("key = 3").select("path"), "path", "left_semi")
    return found.select("key", F.octet_length("content").cast("long").alias("length"), F.md5("content").alias("digest"))


@query("cls3_export", "with s as (select l_orderkey as key, string_agg(l_returnflag || l_linestatus || l_linenumber, ',' order by l_returnflag, l_linestatus, l_linenumber) as symbols from lineitem group by 1) select 'o/' || o_orderkey as path, coalesce(symbols, '') as symbols, len(embedding) as dims from orders join embeddings on vec_id = o_orderkey left join s on s.key = o_orderkey")
def cls3(spark, d):
    path = lambda c: F.concat(F.lit("o/"), F.col(c).cast("string")).alias("path")
    f = table(spark, d, "orders").select(path("o_orderkey"), F.col("o_orderkey").alias("key"))
    s = table(spark, d, "lineitem").select(path("l_orderkey"), F.col("l_returnflag").alias("name"), F.col("l_linestatus").alias("kind"), F.col("l_linenumber").alias("line"))
    out = index.symbols_of_files(f, s, vectors(spark, d))
    return out.select("path", F.array_join(F.transform("symbols", lambda x: F.concat(x["name"], x["kind"], x["line"].cast("string"))), ",").alias("symbols"), F.size("vector").cast("long").alias("dims"))


@query("cls2_refine")
def cls2(spark, d):
    e = table(spark, d, "embeddings")
    names = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"))
    items = e.select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"), "label").join(names, "key")
    refined, _ = taxonomy.refine(items, taxonomy.centroids(items.where("label < 3"), "label", "vector", 64), 3, split_above=20)
    return refined.select("category", F.size("centre").alias("dims"))


# ---- the application in one table

APP_SQL = f"app as (select 'entity' as kind, entity as name, path, fields as detail from ({ORACLE_SQL['ir1_entities']}) union all select 'endpoint', method || ' ' || route, path, 'line ' || line from ({ORACLE_SQL['ir2_endpoints']}) where route is not null)"


@query("ir5_app", f"with {APP_SQL} select * from app")
def ir5(spark, d):
    return code.application(code_files(spark, d))


@query("snk7_markdown", f"with {APP_SQL} select '- **' || name || '** (' || kind || ', ' || path || '): ' || detail as line from app")
def snk7(spark, d):
    return code.markdown(code.application(code_files(spark, d)))


# ---- lock files

ROOT = "concat('m', k, '/', root)"
LOCK_COLUMNS = "path string, content string"
LOCK_FILES = [
    ("a/package-lock.json", '{"packages": {"": {}, "node_modules/zod": {"version": "3.1.0"}}}'),
    ("a/yarn.lock", 'zod@^3:\n  version "9.9.9"\n'),
    ("b/bun.lock", "broken"),
    ("b/pnpm-lock.yaml", "packages:\n\n  /left-pad@1.3.0:\n    resolution: {}\n  '@scope/x@2.0.0':\n    resolution: {}\n"),
    ("c/Pipfile.lock", '{"default": {"flask": {"version": "==3.0"}}, "develop": {"pytest": {"version": "==8.1"}}}'),
    ("d/go.sum", "example.com/mod v1.2.3 h1:abc\nexample.com/mod v1.2.3/go.mod h1:def\n"),
    ("e/Gemfile.lock", "GEM\n  specs:\n    rails (7.1.0)\n      rack (>= 2)\n"),
    ("f/composer.lock", '{"packages": [{"name": "a/b", "version": "1.0"}], "packages-dev": [{"name": "c/d", "version": "v2"}]}'),
    ("g/deno.lock", '{"npm": {"chalk@5.3.0": {}}, "jsr": {"@std/fs@0.2.0": {}}}'),
]
LOCK_ROWS = [("a", "zod", "3.1.0"), ("b", "left-pad", "1.3.0"), ("b", "@scope/x", "2.0.0"), ("c", "flask", "3.0"), ("c", "pytest", "8.1"), ("d", "example.com/mod", "v1.2.3"), ("e", "rails", "7.1.0"), ("f", "a/b", "1.0"), ("f", "c/d", "v2"), ("g", "chalk", "5.3.0"), ("g", "@std/fs", "0.2.0")]


@query("src16_locks", f"with {per_supplier_sql('l', LOCK_COLUMNS, LOCK_FILES, corpus.PATH_OF)}, {per_supplier_sql('r', 'root string, name string, version string', LOCK_ROWS, {'root': ROOT})} select r.root, r.name, r.version, sha256(content)[1:16] as lock_hash from r join l on l.path like r.root || '/%' and l.path not like '%yarn%' and content <> 'broken'")
def src16(spark, d):
    return manifests.resolved(per_supplier(spark, d, LOCK_COLUMNS, LOCK_FILES, corpus.PATH_OF)).select("root", "name", "version", "lock_hash")
