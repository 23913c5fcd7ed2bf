"""Queries of lookups, keyword and vector search, fusion, recency and result tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions.scores import RECENCY, eviction_score, recency_weight, thread_score
from skein.functions.text import code_tokens, dedupe_key, file_key, flexible_pattern, hex_key, key_of_hex, line_of, project_id, redacted, regex_risk, remote_slug, snippet, title
from skein.functions.vectors import cosine_guarded, cosine_search, hashing_embedder, key_hash, norm
from skein.operators import lexical, search
from skein.plans import corpus
from skein.plans.base import FILES_SQL, NOW, files, per_supplier, per_supplier_sql, query, table

COS = "(list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)) + 1e-9))"
E0 = "(select list_transform(embedding, lambda x: x::double) from embeddings where vec_id = 0)"
#: Tokens of a text in RE2, which has no look-ahead: a space is put where an acronym meets a word.
TOKENS = """list_filter(flatten(list_transform(regexp_split_to_array({t}, '[_\\-.\\s/\\\\:]+'), lambda p: case when p = '' then []
  when len(regexp_extract_all(p, '[A-Za-z0-9]')) = 0 then case when length(p) > 1 then [lower(p)] else [] end
  when len(list_filter(flatten(list_transform(string_split(regexp_replace(p, '([A-Z]{{2,}})([A-Z][a-z])', '\\1 \\2', 'g'), ' '), lambda q: regexp_extract_all(q, '[A-Z]{{2,}}$|[A-Z][a-z]+|[a-z]+|[0-9]+'))), lambda q: q <> '')) = 0
  then case when length(p) > 1 then [lower(p)] else [] end
  else list_transform(list_filter(flatten(list_transform(string_split(regexp_replace(p, '([A-Z]{{2,}})([A-Z][a-z])', '\\1 \\2', 'g'), ' '), lambda q: regexp_extract_all(q, '[A-Z]{{2,}}$|[A-Z][a-z]+|[a-z]+|[0-9]+'))), lambda q: length(q) > 1), lambda q: lower(q)) end)), lambda x: x <> '')"""
QUERY = ["the", "licensed", "est", "token"]
TERMS = f"tok as (select doc_id as key, unnest({TOKENS.format(t='text')}) as term from documents), terms as (select key, term, count(*) as tf from tok group by key, term)"
BM25 = f"""len_ as (select key, sum(tf) as dl from terms group by key), mean_ as (select avg(dl) as avgdl, count(*) as n from len_),
df_ as (select term, count(*) as df from terms where term in ('{"', '".join(QUERY)}') group by term),
lex as (select t.key, sum(ln(1.0 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)))) as score from terms t join df_ using (term) join len_ using (key), mean_ group by t.key)"""
SEM = f"sem as (select vec_id as key, {COS.replace('a,', 'e.embedding,').replace('(a', '(e.embedding')} as score from embeddings e)"
SEM = f"v as (select vec_id as key, list_transform(embedding, lambda x: x::double) as a, {E0} as b from embeddings), sem as (select key, {COS} as score from v)"


def first_vector(spark, d):
    """The query vector: that of vec_id 0, one row."""
    return list(table(spark, d, "embeddings").where("vec_id = 0").first()["embedding"])


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))


def ages(spark, d):
    """key, mtime: last event of a user, as epoch seconds."""
    return table(spark, d, "events").groupBy(F.col("user_id").alias("key")).agg(F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("us")).select("key", (F.col("us") / 1e6).alias("mtime"))


AGES = "ages as (select user_id as key, epoch_us(max(ts)) / 1e6 as mtime from events group by user_id)"
NOW_S = 1706659200.0


@query("top1_vector_search", f"with {SEM} select key, round(score, 6) as score from sem order by sem.score desc, key limit 20")
def top1(spark, d):
    return search.vector_top_k(vectors(spark, d), first_vector(spark, d), 20).select("key", F.round("score", 6).alias("score"))


@query("top2_knn", f"""with q as (select vec_id as query, list_transform(embedding, lambda x: x::double) as b from embeddings where vec_id % 50 = 0),
v as (select vec_id as key, list_transform(embedding, lambda x: x::double) as a from embeddings), s as (select query, key, {COS} as score from q, v),
r as (select *, row_number() over (partition by query order by score desc, key) as rank from s) select query, key, round(score, 6) as score, rank from r where rank <= 5""")
def top2(spark, d):
    q = table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    return search.knn(q, vectors(spark, d), 5).select("query", "key", F.round("score", 6).alias("score"), "rank")


@query("mth1_cosine_variants", f"""with v as (select vec_id, list_transform(embedding, lambda x: x::double) as a, {E0} as b from embeddings)
select vec_id, round({COS}, 6) as additive, round(case when list_dot_product(a, a) = 0 then 0 else list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))) end, 6) as guarded, round(sqrt(list_dot_product(a, a)), 6) as norm from v""")
def mth1(spark, d):
    q = F.array(*[F.lit(float(x)) for x in first_vector(spark, d)])
    v = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.round(cosine_search(v, q), 6).alias("additive"), F.round(cosine_guarded(v, q), 6).alias("guarded"), F.round(norm(v), 6).alias("norm"))


@query("str3_tokens", f"with {per_supplier_sql('i', corpus.IDENTIFIER_COLUMNS, corpus.IDENTIFIERS, corpus.IDENTIFIER_OF)} select text, array_to_string({TOKENS.format(t='text')}, ' ') as tokens from i")
def str3(spark, d):
    return per_supplier(spark, d, corpus.IDENTIFIER_COLUMNS, corpus.IDENTIFIERS, corpus.IDENTIFIER_OF).select("text", F.array_join(code_tokens(F.col("text")), " ").alias("tokens"))


@query("txt1_postings", f"with {TERMS} select key, term, tf from terms")
def txt1(spark, d):
    return lexical.postings(files(spark, d)).select("key", "term", "tf")


@query("txt4_bm25", f"with {TERMS}, {BM25} select key, round(score, 6) as score from lex order by lex.score desc, key limit 20")
def txt4(spark, d):
    return lexical.ranked(lexical.bm25(files(spark, d), QUERY), 20).select("key", F.round("score", 6).alias("score"))


RANKED = "rs as (select key, score, row_number() over (order by score desc, key) as rank from sem order by sem.score desc, key limit 20), rl as (select key, score, row_number() over (order by score desc, key) as rank from lex order by lex.score desc, key limit 20)"
FUSED = "fused as (select key, sum(1.0::double / (60 + rank)) as score, case when count(*) > 1 then 'both' else min(s) end as source from (select key, rank, 'semantic' as s from rs union all select key, rank, 'lexical' from rl) group by key)"


def both_lists(spark, d):
    return search.vector_top_k(vectors(spark, d), first_vector(spark, d), 20), lexical.bm25(files(spark, d), QUERY)


@query("txt7_rrf", f"with {TERMS}, {BM25}, {SEM}, {RANKED}, {FUSED} select key, round(score, 6) as score, source from fused")
def txt7(spark, d):
    sem, lex = both_lists(spark, d)
    return lexical.rrf(lexical.ranked(sem, 20), lexical.ranked(lex, 20)).select("key", F.round("score", 6).alias("score"), "source")


@query("txt8_hybrid", f"with {TERMS}, {BM25}, {SEM}, {RANKED}, {FUSED} select key, round(score, 6) as score, source from fused order by fused.score desc, key limit 10")
def txt8(spark, d):
    sem, lex = both_lists(spark, d)
    return lexical.hybrid(sem, lex, 10, fast_from=1e9).select("key", F.round("score", 6).alias("score"), "source")


@query("txt8_fast_path", f"with {TERMS}, {BM25} select key, round(score, 6) as score, 'lexical' as source from lex order by lex.score desc, key limit 10")
def txt8_fast(spark, d):
    sem, lex = both_lists(spark, d)
    return lexical.hybrid(sem, lex, 10, fast_from=0.5).select("key", F.round("score", 6).alias("score"), "source")


def sql_bucket(age: str, preset: str, weight: bool) -> str:
    steps = " ".join(f"when greatest({age}, 0) <= {limit} then {w if weight else i}" for i, (limit, w) in enumerate(RECENCY[preset]) if limit)
    last = RECENCY[preset][-1][1] if weight else len(RECENCY[preset]) - 1
    return f"(case when {age} is null then {last} {steps} else {last} end)"


for _preset in RECENCY:

    @query(f"dat1_recency_{_preset}", f"with {AGES} select key, {sql_bucket(f'({NOW_S} - mtime)', _preset, True)}::double as weight from ages")
    def dat1(spark, d, preset=_preset):
        return ages(spark, d).select("key", recency_weight(F.lit(NOW_S) - F.col("mtime"), preset).alias("weight"))


SCORED = "scored as (select v.key, v.score, a.mtime from (select key, score from sem order by sem.score desc, key limit 200) v left join ages a using (key))"


def scored(spark, d):
    top = search.vector_top_k(vectors(spark, d), first_vector(spark, d), 200)
    return top.join(ages(spark, d), "key", "left")


@query("txt9_recency_direct", f"with {SEM}, {AGES}, {SCORED} select key, round(score * case when mtime is null then 0.8 else {sql_bucket(f'({NOW_S} - mtime)', 'default', True)} end::double, 6) as score from scored")
def txt9(spark, d):
    out = lexical.with_recency(scored(spark, d), F.lit(NOW_S) - F.col("mtime"))
    return out.select("key", F.round("score", 6).alias("score"))


@query("txt9_recency_normalized", f"""with {SEM}, {AGES}, {SCORED}, b as (select *, {sql_bucket(f'({NOW_S} - mtime)', 'default', False)} as bucket, {sql_bucket(f'({NOW_S} - mtime)', 'default', True)}::double as weight from scored)
select key, round(case when max(score) over w = min(score) over w then 1.0 else (score - min(score) over w) / (max(score) over w - min(score) over w) end * weight, 6) as score from b window w as (partition by bucket)""")
def txt9n(spark, d):
    out = lexical.with_recency(scored(spark, d), F.lit(NOW_S) - F.col("mtime"), normalise=True)
    return out.select("key", F.round("score", 6).alias("score"))


@query("lkp3_exact_probe", f"with {FILES_SQL} select 'file:' || path as key, ext, 1.0::double as score, 'aot_index' as source from files where 'file:' || path in ('file:src3/3', 'src3/3') limit 1")
def lkp3(spark, d):
    index = files(spark, d).select(file_key(F.col("path")).alias("key"), "ext")
    return search.probe(index, ["file:src3/3", "src3/3"])


@query("lkp5_get_source", "with a as (select doc_id as key, 'file' as kind, text as content, 1 as r from documents union all select page_id, 'page', html, 2 from pages) select key, arg_min(kind, r) as kind, md5(arg_min(content, r)) as digest from a group by key")
def lkp5(spark, d):
    a = files(spark, d).select("key", F.lit("file").alias("kind"), "content")
    b = table(spark, d, "pages").select(F.col("page_id").alias("key"), F.lit("page").alias("kind"), F.col("html").alias("content"))
    return search.union_first([a, b]).select("key", "kind", F.md5("content").alias("digest"))


@query("lkp7_name_contains", "select p_partkey, p_name from part where contains(p_name, 're')")
def lkp7(spark, d):
    return table(spark, d, "part").where(F.contains("p_name", F.lit("re"))).select("p_partkey", "p_name")


@query("lkp10_needs_index", f"with {AGES} select c_custkey as key, (mtime is null or mtime > 1705000000.0) as stale from customer left join ages on key = c_custkey")
def lkp10(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"))
    return c.join(ages(spark, d), "key", "left").select("key", (F.col("mtime").isNull() | (F.col("mtime") > 1705000000.0)).alias("stale"))


@query("lkp11_keys", "select 'file' as type, count(*) as n, min('doc:' || doc_id) as first from documents union all select 'page', count(*), min('page:' || page_id) from pages union all select 'vector', count(*), min('vec:' || vec_id) from embeddings")
def lkp11(spark, d):
    parts = [("file", "documents", "doc_id", "doc:"), ("page", "pages", "page_id", "page:"), ("vector", "embeddings", "vec_id", "vec:")]
    keys = [table(spark, d, t).select(F.lit(n).alias("type"), F.concat(F.lit(p), F.col(c).cast("string")).alias("key")) for n, t, c, p in parts]
    return keys[0].unionByName(keys[1]).unionByName(keys[2]).groupBy("type").agg(F.count("*").alias("n"), F.min("key").alias("first"))


@query("flt5_threshold", f"with {SEM}, t as (select key, score from sem order by sem.score desc, key limit 50) select key, round(score, 6) as score from t where score >= 0.3")
def flt5(spark, d):
    return search.vector_top_k(vectors(spark, d), first_vector(spark, d), 50).where("score >= 0.3").select("key", F.round("score", 6).alias("score"))


@query("flt6_memory_tiers", f"with {SEM}, t as (select key, case when score < 0.3 then null when key % 7 = 0 then 'team_updates' when score >= 0.5 then 'prior_context' else 'related' end as tier from sem) select key, tier from t where tier is not null")
def flt6(spark, d):
    q = F.array(*[F.lit(float(x)) for x in first_vector(spark, d)])
    s = vectors(spark, d).select("key", cosine_search(F.col("vector"), q).alias("score"))
    return s.select("key", search.memory_tier(F.col("score"), F.col("key") % 7 == 0).alias("tier")).where("tier is not null")


@query("top4_recent", "select o_orderkey, o_orderdate from orders order by o_orderdate desc, o_orderkey limit 25")
def top4(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderdate").orderBy(F.col("o_orderdate").desc(), "o_orderkey").limit(25)


@query("txt11_grep", f"with {FILES_SQL}, l as (select key, unnest(string_split(content, chr(10))) as text, unnest(range(1, len(string_split(content, chr(10))) + 1)) as line from files) select key, line, text from l where regexp_matches(text, 'Licensed|token = ')")
def txt11(spark, d):
    return search.grep(files(spark, d), ["Licensed", "token = "])


CODE_SQL = per_supplier_sql("code", corpus.CODE_COLUMNS, corpus.CODE, corpus.CODE_OF)


@query("set3_grep_tiers", f"""with {CODE_SQL}, t as (select path, case when contains(content, 'make_token') and status = 'unstaged' then 1 when contains(content, 'make_token') and status = 'staged' then 2 when contains(content, 'make_token') then 3 end as tier from code)
select path, tier from t where tier is not null""")
def set3(spark, d):
    return search.grep_tiers(per_supplier(spark, d, corpus.CODE_COLUMNS, corpus.CODE, corpus.CODE_OF), "make_token")


@query("txt10_flexible", f"with {CODE_SQL} select path, 4 as tier from code where regexp_matches(content, '(?i)build[\\s_\\-.]*index')")
def txt10(spark, d):
    return search.grep_tiers(per_supplier(spark, d, corpus.CODE_COLUMNS, corpus.CODE, corpus.CODE_OF), "build index")


@query("top5_grep_rank", f"""with {CODE_SQL} select path, greatest(case when regexp_matches(lower(content), '(class|def|fn|struct|interface|type)\\s+(maketoken|make_token)\\b') then 1.0 else 0.2 end,
case when contains(lower(content), 'maketoken') or contains(lower(content), 'make_token') then 0.8 else 0.2 end,
case when contains(lower(path), 'make') and contains(lower(path), 'token') then 0.5 else 0.2 end)::double as score from code""")
def top5(spark, d):
    return per_supplier(spark, d, corpus.CODE_COLUMNS, corpus.CODE, corpus.CODE_OF).select("path", search.grep_rank("make token", F.col("path"), F.col("content")).alias("score"))


@query("prj2_truncate", """with r as (select doc_id as key, (doc_id % 17)::double as score, text as content from documents order by n_chars desc, doc_id limit 30),
s as (select *, case when length(content) > 200 then length(content) - 65 else 0 end as saving from r),
w as (select *, sum(length(content)) over () - coalesce(sum(saving) over (order by score, key desc rows between unbounded preceding and 1 preceding), 0) as over_ from s)
select key, md5(case when over_ > 8000 and length(content) > 200 then substr(content, 1, 50) || '... [truncated]' else content end) as digest from w""")
def prj2(spark, d):
    top = table(spark, d, "documents").orderBy(F.col("n_chars").desc(), "doc_id").limit(30)
    r = top.select(F.col("doc_id").alias("key"), (F.col("doc_id") % 17).cast("double").alias("score"), F.col("text").alias("content"))
    return search.truncated(r, 8000).select("key", F.md5("content").alias("digest"))


@query("snk6_tsv", f"""with {FILES_SQL}, {SEM} select concat_ws(chr(9), 'F', key::varchar, path, length(content)::varchar) as line from files union all select concat_ws(chr(9), 'T', conv_id::varchar, count(*)::varchar) from conversations group by conv_id
union all select concat_ws(chr(9), 'M', doc_id::varchar, coalesce(quality::varchar, '')) from labels union all select concat_ws(chr(9), 'S', p_partkey::varchar, p_name, p_brand) from part""")
def snk6(spark, d):
    t = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n")).select(search.tsv(F.lit("T"), F.col("conv_id"), F.col("n")).alias("line"))
    m = table(spark, d, "labels").select(search.tsv(F.lit("M"), F.col("doc_id"), F.col("quality")).alias("line"))
    s = table(spark, d, "part").select(search.tsv(F.lit("S"), F.col("p_partkey"), F.col("p_name"), F.col("p_brand")).alias("line"))
    f = files(spark, d).select(search.tsv(F.lit("F"), F.col("key"), F.col("path"), F.length("content")).alias("line"))
    return f.unionByName(t).unionByName(m).unionByName(s)


@query("str2_hex_keys", "select doc_id, '0x' || lpad(lower(to_hex(doc_id)), 16, '0') as hex, doc_id as back from documents")
def str2(spark, d):
    h = hex_key(F.col("doc_id"))
    return table(spark, d, "documents").select("doc_id", h.alias("hex"), key_of_hex(h).alias("back"))


@query("str7_dedupe_key", "select doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[.,!?;:]', '', 'g'), '\\s+', ' ', 'g'))) as digest from documents")
def str7(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(dedupe_key(F.col("text"))).alias("digest"))


@query("str10_title", """with l as (select conv_id, turn, split_part(split_part(trim(text), chr(10), 1), '. ', 1) as s from conversations)
select conv_id, turn, case when length(s) > 50 then substr(s, 1, 47) || '...' else s end as title from l""")
def str10(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", title(F.col("text")).alias("title"))


@query("str11_snippet", """with h as (select doc_id, text, instr(text, 'token = ') - 1 as p from documents where contains(text, 'token = ')),
b as (select *, greatest(p - 50, 0) as lo, least(p + 58, length(text)) as hi from h)
select doc_id, case when lo > 0 then '...' else '' end || trim(replace(substr(text, (lo + 1)::bigint, (hi - lo)::bigint), chr(10), ' ')) || case when hi < length(text) then '...' else '' end as snippet, length(text[:p]) - length(replace(text[:p], chr(10), '')) + 1 as line from b""")
def str11(spark, d):
    at = F.instr("text", "token = ") - 1
    hit = table(spark, d, "documents").where(F.contains("text", F.lit("token = ")))
    return hit.select("doc_id", snippet(F.col("text"), at, at + 8).alias("snippet"), line_of(F.col("text"), at).cast("long").alias("line"))


@query("str13_remote", f"with {per_supplier_sql('r', corpus.REMOTE_COLUMNS, corpus.REMOTES, corpus.REMOTE_OF)} select url, 'host.example/owner' || k || '/repo' as slug from r")
def str13(spark, d):
    return per_supplier(spark, d, corpus.REMOTE_COLUMNS, corpus.REMOTES, corpus.REMOTE_OF).select("url", remote_slug(F.col("url")).alias("slug"))


@query("str13_project", """with s as (select c_custkey, 'host.example/' || lower(replace(c_name, '#', '/')) as slug, sha256('host.example/' || lower(replace(c_name, '#', '/'))) as h from customer)
select c_custkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-' || substr('89ab', (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) as project from s""")
def str13_project(spark, d):
    url = F.concat(F.lit("https://me@Host.Example/"), F.replace("c_name", F.lit("#"), F.lit("/")), F.lit(".git"))
    return table(spark, d, "customer").select("c_custkey", project_id(remote_slug(url)).alias("project"))


REDACT_SQL = "regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+', '[REDACTED:email]', 'g'), '\\b[0-9]{1,3}(?:\\.[0-9]{1,3}){3}\\b', '[REDACTED:ipv4]', 'g'), '\\b[0-9a-f]{32,}\\b', '[REDACTED:hex_key]', 'g')"


@query("str17_redact", f"select doc_id, md5({REDACT_SQL}) as digest, (text <> {REDACT_SQL}) as found from documents")
def str17(spark, d):
    clean = table(spark, d, "documents").select("doc_id", "text", redacted(F.col("text")).alias("clean"))
    return clean.select("doc_id", F.md5("clean").alias("digest"), (F.col("text") != F.col("clean")).alias("found"))


@query("str18_regex_risk")
def str18(spark, d):
    return per_supplier(spark, d, corpus.REGEX_COLUMNS, corpus.REGEXES, corpus.REGEX_OF).select("pattern", regex_risk(F.col("pattern")).alias("risk"))


@query("str1_key_hash")
def str1(spark, d):
    return files(spark, d).select("path", hex_key(key_hash("file")(file_key(F.col("path")))).alias("key"))


@query("vec1_embed")
def vec1(spark, d):
    return files(spark, d).select("key", hashing_embedder(64)(F.col("content")).alias("vector"))


@query("str5_flexible", "select doc_id from documents where regexp_matches(text, '(?i)mit[\\s_\\-.]*license')")
def str5(spark, d):
    return table(spark, d, "documents").where(F.col("text").rlike(flexible_pattern("MIT License"))).select("doc_id")


PER_USER = f"u as (select user_id as id, count(*) as n, {NOW_S} - epoch_us(max(ts)) / 1e6 as age from events group by user_id)"


@query("mth2_eviction", f"with {PER_USER} select id, round(10.0 * n + 100.0 / (1.0 + age / 3600.0 / 168.0), 6) as score from u")
def mth2(spark, d):
    u = table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("n"), (F.lit(NOW_S) - F.max(F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6).alias("age"))
    return u.select("id", F.round(eviction_score(F.col("n"), F.col("age")), 6).alias("score"))


@query("mth3_thread_score", f"with {PER_USER} select id, round(0.6 * greatest(0.0, 1.0 - age / 6000000.0) + 0.4 * least(1.0, n / 50.0), 6) as score from u")
def mth3(spark, d):
    u = table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("n"), (F.lit(NOW_S) - F.max(F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6).alias("age"))
    return u.select("id", F.round(thread_score(F.col("age") / 10000.0, F.col("n")), 6).alias("score"))


assert NOW == "2024-01-31 00:00:00"
