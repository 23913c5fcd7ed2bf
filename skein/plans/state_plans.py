"""Queries with stored state (threads and search learning on streams, merges of streams into tables, the stored index), and
of the whole library of patterns in one pass."""

from __future__ import annotations

import itertools
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import text as t
from skein.operators import code, graph, lexical, memory, packed_graph, patterns, search
from skein.operators.library import scan_library
from skein.operators.pattern_cache import PatternCache
from skein.operators.patterns import PatternSet
from skein.operators.stored import new_folder
from skein.operators.term_index import TermIndex
from skein.plans import corpus
from skein.plans.base import FILES_SQL, files, per_supplier, per_supplier_sql, query, quoted, table
from skein.plans.code_plans import CALL_SQL, WEIGHTS, calls
from skein.plans.search_plans import BM25, FUSED, QUERY, RANKED, SEM, TERMS, first_vector, vectors
from skein.plans.table_plans import EDGE_SQL, MEM_SQL, edges, memories
from skein.streaming import sessions, state
from skein.streaming.store import KeyedStore, upsert_stream


def stream(spark, d: str, name: str) -> DataFrame:
    """A table of the data directory as a stream of files, what is there now."""
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}*.parquet")


def collected(spark, out: DataFrame) -> DataFrame:
    """All that a stream gives until its input ends, through a sink of files."""
    folder = new_folder(spark, "stream")
    with state.rocks_state(spark):
        out.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


@query("stm3_thread_routing")
def stm3(spark, d):
    """Vectors as a stream of queries of the sessions that their labels name, one second apart."""
    e = stream(spark, d, "embeddings").select(F.col("label").alias("session"), F.col("vec_id").alias("ord"), F.timestamp_seconds(F.col("vec_id") + 1).alias("ts"), F.col("embedding").alias("vector"))
    out = state.routed_stream(e.withWatermark("ts", "1 hour"), 0.4, 0.3, 5, 1e9)
    return collected(spark, out).select("session", "ord", "thread", "similarity")


PAIRS_SQL = """select c.user_id as session, c.event_id as call, r.event_id as result, (epoch_us(r.ts) - epoch_us(c.ts)) / 1e6 as took
from events c join events r on c.user_id = r.user_id and c.event_type = 'click' and r.event_type = 'purchase' and r.ts >= c.ts and r.ts <= c.ts + interval 6 hour"""


@query("stm5_stream_correlation", PAIRS_SQL)
def stm5(spark, d):
    """Clicks with the purchases of the same user within six hours, as a join of two streams."""
    e = lambda kind: stream(spark, d, "events").where(F.col("event_type") == kind).withColumn("at", F.col("ts").cast("timestamp"))
    calls = e("click").select(F.col("user_id").alias("id"), F.col("event_id").alias("call"), F.col("at").alias("ts")).withWatermark("ts", "1 hour")
    results = e("purchase").select(F.col("user_id").alias("id"), F.col("event_id").alias("result"), F.col("at").alias("rts")).withWatermark("rts", "1 hour")
    out = sessions.correlated(calls, results, "6 hours").select(F.col("id").alias("session"), "call", "result", ((F.unix_micros("rts") - F.unix_micros("ts")) / 1e6).alias("took"))
    return collected(spark, out)


LEARN_SQL = """with e as (select user_id as session, event_id as ord, epoch_us(ts) as us, value, json_extract_string(props, '$.k') as path, event_type as kind, row_number() over (partition by user_id order by ts, event_id) as at from events),
s as (select * from e where kind = 'click' and value < 25),
r as (select s.session, s.ord, s.us, s.at, min(x.at) as first_read from s join e x on x.session = s.session and x.kind = 'view' and x.at > s.at and x.us <= s.us + 86400000000 group by all),
t as (select r.session, r.ord, r.at, min(u.at) as ended from r join e u on u.session = r.session and u.kind = 'purchase' and u.at > r.first_read and u.us <= r.us + 86400000000 group by all)
select distinct t.session, t.ord as search_ord, x.path from t join e x on x.session = t.session and x.kind = 'view' and x.at > t.at and x.at < t.ended"""


@query("stm6_stream_learning", LEARN_SQL)
def stm6_stream(spark, d):
    """Clicks as searches (weak below 25), views as reads, purchases as ends of turns, within a day."""
    kind = F.when(F.col("event_type") == "click", "search").when(F.col("event_type") == "view", "read").when(F.col("event_type") == "purchase", "turn").otherwise("other")
    e = stream(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("ord"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), F.get_json_object("props", "$.k").alias("path"), F.col("value").alias("score"))
    return collected(spark, state.learned_stream(e.withWatermark("ts", "1 hour"), 25.0, 86_400.0))


@query("stm7_stream_upserts", "select user_id, event_id, event_type, value from events qualify row_number() over (partition by user_id order by event_id desc) = 1 and event_type <> 'error'")
def stm7_stream(spark, d):
    """The last event of every user, merged from a stream into a stored table; a user whose last event is an error goes."""
    folder = new_folder(spark, "store")
    store = KeyedStore(spark, f"{folder}/table", "user_id bigint, event_id bigint, event_type string, value double", "user_id", "event_id")
    upsert_stream(stream(spark, d, "events"), store, f"{folder}/checkpoint", gone="event_type = 'error'").awaitTermination()
    return store.read()


#: Folders of the indexes that this process has built, by application and data directory.
_INDEXES: dict[tuple[str, str], str] = {}


def stored_index(spark, d: str) -> TermIndex:
    """The keyword index over documents: built at its first use by an application, then read where it lies."""
    name = (spark.sparkContext.applicationId, d)
    if name not in _INDEXES or TermIndex(spark, _INDEXES[name]).state() is None:
        folder = f"{new_folder(spark, 'terms')}/{uuid.uuid4().hex}"
        TermIndex(spark, folder).commit(files(spark, d).select("key", "content"), 1)
        _INDEXES[name] = folder
    return TermIndex(spark, _INDEXES[name])


@query("txt4_stored_bm25", f"with {TERMS}, {BM25} select key, round(score, 6) as score from lex order by lex.score desc, key limit 20")
def txt4_stored(spark, d):
    return lexical.ranked(stored_index(spark, d).search(QUERY), 20).select("key", F.round("score", 6).alias("score"))


@query("txt6_stored_stats", f"with {TERMS} select count(distinct key) as documents, count(distinct term) as terms, count(*) as postings from terms")
def txt6_stored(spark, d):
    return stored_index(spark, d).stats()


def stored_lists(spark, d):
    return search.vector_top_k(vectors(spark, d), first_vector(spark, d), 20), stored_index(spark, d).search(QUERY)


@query("txt7_stored_rrf", f"with {TERMS}, {BM25}, {SEM}, {RANKED}, {FUSED} select key, round(score, 6) as score, source from fused")
def txt7_stored(spark, d):
    sem, lex = stored_lists(spark, d)
    return lexical.rrf(lexical.ranked(sem, 20), lexical.ranked(lex, 20)).select("key", F.round("score", 6).alias("score"), "source")


@query("txt8_stored_hybrid", f"with {TERMS}, {BM25}, {SEM}, {RANKED}, {FUSED} select key, round(score, 6) as score, source from fused order by fused.score desc, key limit 10")
def txt8_stored(spark, d):
    sem, lex = stored_lists(spark, d)
    return lexical.hybrid(sem, lex, 10, fast_from=1e9).select("key", F.round("score", 6).alias("score"), "source")


# ---- a library of three hundred patterns in one pass

SYLLABLES = ["th", "er", "on", "in", "re", "an", "st"]
LINES_OF_FILES = "ln as (select key, unnest(string_split(content, chr(10))) as text, unnest(range(1, len(string_split(content, chr(10))) + 1)) as line from files)"
#: Sixty sets of five patterns, each of words that begin with three syllables.
STEMS = ["".join(x) for x in itertools.product(SYLLABLES, repeat=3)][:300]
LIBRARY = [PatternSet(f"stems:{i}", tuple(rf"(?i)\b{w}\w*" for w in STEMS[5 * i : 5 * i + 5])) for i in range(60)]


@query("pat4_library_scan", f"""with p as (select 'stems:' || ((i - 1) // 5) as type_id, w from (select unnest({quoted(STEMS)}) as w, unnest(range(1, {len(STEMS) + 1})) as i))
select doc_id as key, type_id, sum(len(regexp_extract_all(text, '(?i)\\b' || w || '\\w*')))::bigint as n from documents, p where contains(lower(text), w) group by all having n >= 2""")
def pat4_library(spark, d):
    return scan_library(files(spark, d), LIBRARY, ext="ext").select("key", "type_id", "n")


@query("pat6_library_lines", f"""with {FILES_SQL}, {LINES_OF_FILES}, i(type_id, p) as (values ('insight:license', '(?i)\\blicen[cs]ed?\\b'), ('insight:token', 'token = '))
select key, i.type_id, line, substr(trim(text, ' '), 1, 100) as text from ln, i where case i.type_id when 'insight:license' then regexp_matches(text, '(?i)\\blicen[cs]ed?\\b') else contains(text, 'token = ') end
union all select doc_id, 'context:noise', null, null from documents where len(regexp_extract_all(text, '[*]{{3}}')) >= 2""")
def pat6_library(spark, d):
    """Contexts and insights of files from one pass."""
    counted = [PatternSet("context:noise", (r"[*]{3}",))]
    lines = [PatternSet("insight:license", (r"(?i)\blicen[cs]ed?\b",)), PatternSet("insight:token", (r"token = ",))]
    return scan_library(files(spark, d), counted, lines).select("key", "type_id", "line", "text")


# ---- the packed graph

PACKED_SQL = f"""{EDGE_SQL}, num as (select p_partkey as id, row_number() over (order by p_partkey) - 1 as number from part),
live as (select distinct a.number as a, rel, b.number as b from edges join num a on a.id = src join num b on b.id = dst where not tombstone),
links as (select 'out' as side, a as number, rel, b as other from live union all select 'into', b, rel, a from live),
deg as (select side, number, count(*) as n from links group by all)"""


@query("grf9_packed", f"with {PACKED_SQL} select num.id, side, case when n > 16 then other // 16 else 0 end as block, count(*) as n, min(other) as first, max(other) as last from links join deg using (side, number) join num using (number) group by all")
def grf9_packed(spark, d):
    """Blocks of links between parts; 16 links make a hub."""
    ids = table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    numbers = packed_graph.numbered(ids)
    blocks = packed_graph.link_blocks(numbers, edges(spark, d), 16).join(numbers, "number")
    others = F.transform("links", lambda x: x["other"])
    return blocks.select("id", "side", "block", F.size("links").cast("long").alias("n"), F.array_min(others).alias("first"), F.array_max(others).alias("last"))


# ---- the pattern cache


@query("txt12_pattern_cache", """with now as (select source || '/' || doc_id as path, case when doc_id % 10 = 0 then text || ' licensed' else text end as content from documents where doc_id % 10 <> 1),
n as (select path, len(regexp_extract_all(content, '(?i)\\blicen[cs]ed?\\b')) as l, len(regexp_extract_all(content, 'token = ')) as t from now)
select type_id, path, n from (select 'context:legal' as type_id, path, l as n from n union all select 'context:token', path, t from n) where n > 0""")
def txt12(spark, d):
    """Documents are scanned once; then every tenth changes and is scanned again, and every tenth goes."""
    cache = PatternCache(spark, new_folder(spark, "cache"), [PatternSet("context:legal", (r"(?i)\blicen[cs]ed?\b",)), PatternSet("context:token", (r"token = ",))])
    first = files(spark, d).select("path", "content", "key")
    cache.refresh(first.drop("key"), 1, 1)
    later = first.where("key % 10 <> 1").withColumn("content", F.when(F.col("key") % 10 == 0, F.concat("content", F.lit(" licensed"))).otherwise(F.col("content")))
    cache.refresh(later.drop("key"), 2, 2)
    return cache.matches()


# ---- smaller ones: safe patterns, presets, upkeep of memories, call graphs as text


@query("str19_safe_calls", "select doc_id, len(regexp_extract_all(text, '[0-9a-f]{32,}'))::bigint as n, regexp_matches(text, '^(?:[A-Z][a-z]+)') as starts, md5(regexp_replace(text, '[*]{3}', '', 'g')) as digest, null::varchar as refused from documents")
def str19_calls(spark, d):
    c, p = F.col("text"), F.lit
    return table(spark, d, "documents").select("doc_id", F.size(t.safe_findall(c, p("[0-9a-f]{32,}"))).cast("long").alias("n"), t.safe_match(c, p("[A-Z][a-z]+")).alias("starts"), F.md5(t.safe_sub(c, p("[*]{3}"), p("")).cast("binary")).alias("digest"), t.safe_sub(c, p("(a+)+$"), p("")).alias("refused"))


@query("pat11_presets", "select preset, count(*) filter (length(trim(text, ' ')) < least) as short, count(*) as turns from conversations, (values ('conservative', 100), ('moderate', 75), ('aggressive', 50)) p(preset, least) where role = 'assistant' group by preset")
def pat11(spark, d):
    """How many of the assistant's turns are too short for a memory, by preset."""
    c = table(spark, d, "conversations").where("role = 'assistant'").select(F.col("conv_id").alias("session"), F.col("conv_id").alias("key"), F.col("turn").alias("ord"), "text", F.lit(False).alias("explores"))
    each = [patterns.extract_memories(c, WEIGHTS, least_length=n).select(F.lit(preset).alias("preset"), "skip_reason") for preset, n in patterns.PRESETS.items()]
    counts = reduce(DataFrame.unionByName, each).groupBy("preset")
    return counts.agg(F.count_if(F.col("skip_reason") == "text_too_short").alias("short"), F.count("*").alias("turns"))


@query("mem3_upkeep", f"with {MEM_SQL} select task, count(*) filter (id % 7 <> 0) as kept, count(*) filter (id % 7 = 0) as got, max(id) filter (id % 7 <> 0) as last from mem group by task having kept + got > 0")
def mem3_upkeep(spark, d):
    """Memories by task: those left when the ids of every seventh customer are forgotten, and those that the ids get."""
    m, ids = memories(spark, d), table(spark, d, "documents").where("doc_id % 7 = 0").select(F.col("doc_id").alias("id"))
    left = memory.forgotten(m, ids).groupBy("task").agg(F.count("*").alias("kept"), F.max("id").alias("last"))
    found = memory.got(m, ids).groupBy("task").agg(F.count("*").alias("got"))
    return left.join(found, "task", "full").select("task", F.coalesce("kept", F.lit(0).cast("long")).alias("kept"), F.coalesce("got", F.lit(0).cast("long")).alias("got"), "last")


@query("snk5_dot", f"""with {CALL_SQL} select '  "' || caller || '" -> "' || callee_file || '" [label="' || count(*) || '"];' as line from calls group by caller, callee_file""")
def snk5_dot(spark, d):
    n = calls(spark, d).groupBy("caller", "callee_file").agg(F.count("*").alias("label"))
    return graph.dot(n, "caller", "callee_file")


# ---- entities in windows, five families, and their relations

SCHEMAS = [
    ("models.py", "class User(Base):\n    id = Column(Integer, primary_key=True)\n    name = Column(String(50))\n    team_id = Column(Integer, ForeignKey('teams.id'))\n    posts = relationship('Post')\n\n\nclass Note(BaseModel):\n    title: str\n    count: int = 0\n    tags: list[str]\n\n\ndef helper():\n    x = Column(Text)\n"),
    ("schema.prisma", "model Post {\n  id Int @id\n  title String\n  author User @relation(fields: [authorId])\n  tags Tag[]\n}\n\nmodel Tag {\n  name String?\n}\n"),
    ("schema.ts", "export const orders = pgTable('orders', {\n  id: serial('id'),\n  label: varchar('label'),\n})\n\nexport const item = z.object({\n  sku: z.string(),\n  n: z.number(),\n})\n\nexport class Cart {\n  @OneToMany(() => line)\n  lines\n  @ManyToOne(() => User)\n  owner\n}\n"),
    ("plain.py", "x = 1\nclass_name = 'User'\n"),
]
_UPPER = lambda x: f"upper({x}[1]) || {x}[2:]"
WINDOW_SQL = f"""{per_supplier_sql('code', 'path string, content string', SCHEMAS, corpus.PATH_OF)},
sl as (select path, unnest(string_split(content, chr(10))) as text, unnest(range(len(string_split(content, chr(10))))) as pos from code where regexp_matches(content, {quoted('(?m)' + code.ENTITY)})),
si as (select *, sum(case when regexp_matches(text, {quoted(code.DEFINITION)}) then 1 else 0 end) over (partition by path order by pos) as island from sl),
sw as (select path, min(pos) as pos, arg_min(text, pos) as head, array_to_string((list(text order by pos))[:50], chr(10)) as body from si where island > 0 group by path, island),
sn as (select path, pos, body, regexp_extract(head, {quoted(code.ENTITY)}, 1) || regexp_extract(head, {quoted(code.ENTITY)}, 2) || regexp_extract(head, {quoted(code.ENTITY)}, 3) as n from sw),
w as (select path, pos, body, {_UPPER('n')} as entity from sn where n <> '')"""
_TYPE = "case t " + " ".join(f"when {quoted(a)} then {quoted(b)}" for a, b in code.SCHEMA_TYPES.items()) + " else t end"
_FIELDS = " union all ".join(f"select entity, path, {quoted(family)} as family, unnest(regexp_extract_all(body, {quoted(p)}, 1)) as f, unnest(regexp_extract_all(body, {quoted(p)}, {g})) as t, unnest(range(len(regexp_extract_all(body, {quoted(p)})))) as i from w" for family, forms in code.SCHEMA_FIELDS.items() for p, g in forms)
_RELATED = " union all ".join(f"select entity, path, pos, {i} as form, {quoted(kind)} as type, unnest(regexp_extract_all(body, {quoted(p)}, 1)) as t from w" for i, (p, kind) in enumerate(code.RELATIONS))


def schema_windows(spark, d):
    return code.entity_windows(per_supplier(spark, d, "path string, content string", SCHEMAS, corpus.PATH_OF))


@query("ir1_entity_fields", f"with {WINDOW_SQL} select entity, path, family, string_agg(f || ':' || {_TYPE}, ',' order by i) as fields from ({_FIELDS}) group by entity, path, family")
def ir1_fields(spark, d):
    return code.entity_fields(schema_windows(spark, d))


@query("ir1_relations", f"with {WINDOW_SQL}, r as (select entity, path, pos, form, type, {_UPPER('t')} as target from ({_RELATED})) select entity, path, arg_min(type, form) as type, target from r group by entity, path, pos, target")
def ir1_relations(spark, d):
    return code.entity_relations(schema_windows(spark, d))
