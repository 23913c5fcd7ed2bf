"""Secret spans in whole texts, with multipart credentials linked; DataFrame expressions only.

Base kinds are found by their own patterns. Weak kinds (an account identifier, a mixed string that could be a key, an
endpoint) say little alone; a weak candidate becomes a span only when complementary parts lie in its scope, the `scope`
code points on either side of its start: a secret for an identifier, an identifier or an endpoint for a secret, both an
identifier and a secret for an endpoint. Strong spans count as parts: access as identifier, assign and hex as secret.
The link is an interval join on (text, scope-wide cell) as semi-joins, so no pair is ever emitted and copies of a text
are linked once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import materialize, text_key

# The base patterns and their least lengths.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

# Weak parts of a multipart credential.
IDENTIFIER = r"""(?i:access_?key(?:_?id)?|client_?id|account|user_?name|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{4,}"""
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}={0,2}"
ENDPOINT = r"""(?i:https?://[^\x00-\x20"'<>]{4,}|(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{4,})"""

#: Kinds in the order that breaks ties of the start.
KINDS = ["assign", "access", "hex", "identifier", "candidate", "endpoint"]
PATTERNS = dict(zip(KINDS, [ASSIGN, ACCESS, HEX, IDENTIFIER, CANDIDATE, ENDPOINT], strict=True))


#: Code points of a block of text that is redacted at a time.
BLOCK = 4096


def _pieces(text: Column, kind: str) -> Column:
    """array<struct<rank, i, gap, size, good>> of a kind's matches in text, in code points and in order.

    gap is what lies between a match and the one before, as split() by the same pattern gives it.
    """
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    good = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_LEAST if kind == "assign" else F.lit(True)
    pairs = F.arrays_zip(found.alias("m"), F.slice(F.split(text, PATTERNS[kind], -1), 1, F.size(found)).alias("g"))
    step = lambda x, i: F.struct(F.lit(KINDS.index(kind)).alias("rank"), i.alias("i"), F.length(x["g"]).cast("long").alias("gap"), F.length(x["m"]).cast("long").alias("size"), good(x["m"]).alias("good"))
    return F.when(text.rlike(PATTERNS[kind]), F.transform(pairs, step)).otherwise(F.array().cast("array<struct<rank:int,i:int,gap:bigint,size:bigint,good:boolean>>"))


def _text(spans: Column) -> Column:
    """All spans as kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, text_col: str = "text", scope: int = 300, drop_text: bool = False) -> DataFrame:
    """docs with base and secret_spans added: arrays of (start, rank of KINDS, end), sorted; base holds the strong kinds.

    A null or empty text has no spans. Repeated rows get the same spans each; other columns pass through, and columns of
    docs that are named as the two results are replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.drop("base", "secret_spans")
    columns = [c for c in docs.columns if not (drop_text and c == text_col)]
    placed = materialize(docs.select(*columns, text_key(F.col(text_col)).alias("_text_key"), F.concat(*[_pieces(text, k) for k in KINDS]).alias("_pieces")))
    some, none = placed.where("size(_pieces) > 0"), placed.where("size(_pieces) = 0")

    # Places are running sums of gaps and matches, text by text; each step is linear in a text's matches.
    each = some.select("_text_key", "_pieces").dropDuplicates(["_text_key"]).select("_text_key", F.inline("_pieces"))
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("_text_key", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    spans = each.withColumn("end", end).where("good").select("_text_key", (F.col("end") - F.col("size")).alias("start"), "rank", "end")
    # A weak span that meets a base span goes: one that starts no later and reaches into it, or one that starts inside.
    base, text_order = F.col("rank") < 3, Window.partitionBy("_text_key")
    reached = F.max(F.when(base, F.col("end"))).over(text_order.orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    coming = F.min(F.when(base, F.col("start"))).over(text_order.orderBy(F.col("start").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    met = (F.coalesce("reached", F.lit(0)) > F.col("start")) | F.coalesce(F.col("coming") < F.col("end"), F.lit(False))
    free = spans.withColumn("reached", reached).withColumn("coming", coming).where(base | ~met)
    spans = materialize(free.select("_text_key", F.struct("start", "rank", "end").alias("part")))
    parts = spans.select("_text_key", "part", F.col("part.start").alias("at"), F.col("part.rank").alias("rank"), F.floor(F.col("part.start") / scope).alias("cell"))
    identifiers, secrets, endpoints = (parts.where(F.col("rank").isin(*[KINDS.index(k) for k in names])) for names in (("access", "identifier"), ("assign", "hex", "candidate"), ("endpoint",)))

    def beside(weak: DataFrame, others: DataFrame) -> DataFrame:
        """Those of weak with one of others in their scope."""
        wide = others.select(F.col("_text_key").alias("k"), F.col("at").alias("near"), F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("c"))
        return weak.join(wide, (F.col("_text_key") == F.col("k")) & (F.col("cell") == F.col("c")) & (F.abs(F.col("at") - F.col("near")) <= scope), "left_semi")

    pick = lambda kind: parts.where(F.col("rank") == KINDS.index(kind))
    linked = beside(pick("identifier"), secrets).unionByName(beside(pick("candidate"), identifiers.unionByName(endpoints))).unionByName(beside(beside(pick("endpoint"), identifiers), secrets))
    every = parts.where("rank < 3").select("_text_key", "part").unionByName(linked.select("_text_key", "part"))
    by_text = every.groupBy(F.col("_text_key").alias("k")).agg(F.array_sort(F.collect_list("part")).alias("secret_spans"))
    empty = F.array().cast("array<struct<start:bigint,rank:int,end:bigint>>")
    found = some.join(by_text, F.col("_text_key") == F.col("k"), "left").withColumn("secret_spans", F.coalesce("secret_spans", empty))
    found = found.withColumn("base", F.filter("secret_spans", lambda x: x["rank"] < 3)).select(*columns, "base", "secret_spans")
    return found.unionByName(none.select(*columns, empty.alias("base"), empty.alias("secret_spans")))


def secret_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 300) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked of every row."""
    found = find_secrets(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", scope, drop_text=True)
    count = lambda k: F.size(F.filter("base", lambda s: s["rank"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS[:3]], F.sha2(_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), _text(F.col("secret_spans")).alias("spans"), (F.size("secret_spans") - F.size("base")).cast("long").alias("n_linked"))


def redact(found: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """found with every stretch of the text that its secret_spans cover put as mark; other columns and rows as they are.

    Spans that overlap share a mark. Texts without spans, null ones included, pass through. A text is cut into blocks of
    BLOCK code points, which meet their spans, so the work is linear in the text and in its spans.
    """
    own = F.struct(text_key(F.col(text_col)), F.xxhash64("secret_spans"))
    some = materialize(found.where("size(secret_spans) > 0").withColumn("_own", own))
    texts = some.select("_own", F.col(text_col).alias("_text"), "secret_spans").dropDuplicates(["_own"])
    blocks = texts.select("_own", F.posexplode(F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))).alias("no", "block"))
    # Where the spans before have ended; what of a span lies before that is gone already.
    before = Window.partitionBy("_own").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = texts.select("_own", F.inline("secret_spans")).withColumn("past", F.coalesce(F.max("end").over(before), F.lit(0)))
    gone = spans.withColumn("low", F.greatest("start", "past")).where("low < end")
    gone = gone.withColumn("no", F.explode(F.sequence((F.col("low") / BLOCK).cast("int"), ((F.col("end") - 1) / BLOCK).cast("int"))))
    first = F.col("no").cast("long") * BLOCK
    local = F.struct((F.greatest("low", first) - first).cast("int").alias("low"), (F.least("end", first + BLOCK) - first).cast("int").alias("high"), ((F.col("start") >= F.col("past")) & (F.col("low") >= first)).alias("mark"))
    cuts = gone.groupBy("_own", "no").agg(F.array_sort(F.collect_list(local)).alias("cuts"))

    def walk(state: Column, c: Column) -> Column:
        kept = F.substring(F.col("block"), state["at"] + 1, c["low"] - state["at"])
        return F.struct(c["high"].alias("at"), F.concat(state["out"], kept, F.when(c["mark"], F.lit(mark)).otherwise(F.lit(""))).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.when(F.col("cuts").isNull(), F.col("block")).otherwise(F.aggregate("cuts", start, walk, lambda s: F.concat(s["out"], F.substring(F.col("block"), s["at"] + 1, F.lit(BLOCK)))))
    done = blocks.join(cuts, ["_own", "no"], "left").select("_own", F.struct("no", clean.alias("block")).alias("b"))
    whole = done.groupBy("_own").agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["block"]), "").alias("_clean"))
    cleaned = some.join(whole, "_own").withColumn(text_col, F.col("_clean")).select(*found.columns)
    return cleaned.unionByName(found.where("size(secret_spans) = 0").select(*found.columns))


def _places(kind: str, pattern: str, keep: str = "true") -> str:
    rank = KINDS.index(kind)
    return f"""select k, {rank} as rank, '{kind}' as kind, s as start, s + length(m) as "end" from (
  select k, m, i, sum(length(g)) over (partition by k order by i) + coalesce(sum(length(m)) over (partition by k order by i rows between unbounded preceding and 1 preceding), 0) as s
  from (select k, unnest(regexp_extract_all(x, '{pattern}')) as m, unnest(list_slice(regexp_split_to_array(x, '{pattern}'), 1, len(regexp_extract_all(x, '{pattern}')))) as g,
    unnest(range(len(regexp_extract_all(x, '{pattern}')))) as i from u)) where {keep}"""


def oracle(scope: int = 300) -> str:
    """secret_digest() over documents in DuckDB. RE2 has no look-around: candidates are filtered after their match."""
    quote = lambda p: p.replace("'", "''")
    candidate = r"[A-Za-z0-9+/_-]{20,}={0,2}"
    edge = "regexp_matches(m, '[0-9]') and regexp_matches(m, '[A-Za-z]')"
    weak = " union all ".join([_places("identifier", quote(IDENTIFIER)), _places("candidate", candidate, edge), _places("endpoint", quote(ENDPOINT))])
    strong = " union all ".join([_places("assign", quote(ASSIGN), f"length(regexp_extract(m, '{quote(ASSIGN)}', 2)) >= {ASSIGN_LEAST}"), _places("access", ACCESS), _places("hex", HEX)])
    near = lambda kinds: f"exists (select 1 from parts o where o.k = p.k and o.kind in ({kinds}) and abs(o.start - p.start) <= {scope})"
    ids, keys = near("'access', 'identifier'"), near("'assign', 'hex', 'candidate'")
    return f"""
with u as (select distinct coalesce(text, '') as x, md5(coalesce(text, '')) as k from documents),
base as ({strong}),
parts as (select * from base union all select w.* from ({weak}) w where not exists (select 1 from base b where b.k = w.k and b.start < w."end" and w.start < b."end")),
spans as (select * from base union all select * from parts p where rank > 2 and case kind when 'identifier' then {keys} when 'candidate' then {ids} or {near("'endpoint'")} else {ids} and {keys} end),
f as (select k, count(*) filter (kind = 'assign') as a, count(*) filter (kind = 'access') as c, count(*) filter (kind = 'hex') as h, count(*) filter (rank > 2) as n,
  string_agg(kind || ':' || start || ':' || "end", ',' order by start, rank) filter (rank < 3) as b, string_agg(kind || ':' || start || ':' || "end", ',' order by start, rank) as s from spans group by k)
select doc_id, coalesce(a, 0) as n_assign, coalesce(c, 0) as n_access, coalesce(h, 0) as n_hex, sha256(coalesce(b, '')) as base_sha256, coalesce(s, '') as spans, coalesce(n, 0) as n_linked
from documents d left join f on f.k = md5(coalesce(d.text, ''))
"""
