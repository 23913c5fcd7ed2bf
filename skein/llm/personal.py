"""Personal data in whole texts: base kinds by pattern, others by bootstrapped contexts; DataFrame expressions only.

Base kinds (email, ip, card, phone) are found by their own patterns and are the seeds. A lexical pattern is the word before
or the word after an identifier. Patterns and instances (values of seeds and of candidates, tokens with digits) form a
graph with one edge for each pattern and value. In every round a pattern's confidence in a kind is the share of all
occurrences of its word, among identifiers or not, at which a known instance of the kind stands; enough distinct known
values must support it. A value's score is the chance that one of its confident patterns is right. Values that score high
join the known ones, so the next round's patterns can rest on them. Candidates so discovered become spans; base spans
stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import materialize, text_key

# The base patterns. Each is written so that no run of characters is tried from more than one start.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Candidates: groups of letters and digits held together by single joiners, with a digit somewhere.
CANDIDATE = r"(?<![A-Za-z0-9])(?<![A-Za-z0-9][@._/+-])(?=(?:[A-Za-z]++[@._/+-])*+[A-Za-z]*+[0-9])[A-Za-z0-9]++(?:[@._/+-][A-Za-z0-9]++)*+"
#: Code points and digits of a candidate, and code points in which the word beside an identifier is looked for.
SHORTEST, LONGEST, DIGITS, BESIDE = 6, 64, 3, 40

#: Kinds in the order that breaks ties of the start; discovered spans carry the kind whose patterns found them.
BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, *[f"like_{k}" for k in BASE]]
PATTERNS = dict(zip([*BASE, "candidate"], [EMAIL, IP, CARD, PHONE, CANDIDATE], strict=True))
RANK = {k: i for i, k in enumerate(PATTERNS)}

#: Rounds, distinct known values that a pattern needs, confidence that it needs, and score from which a value is known.
ROUNDS, SUPPORT, CONFIDENT, ACCEPT = 3, 3, 0.3, 0.6
LEFT, RIGHT = r"(\p{L}+)\P{L}{0,8}$", r"^\P{L}{0,8}(\p{L}+)"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _good(kind: str, m: Column) -> Column:
    """Whether a match of the pattern is one of the kind."""
    n = F.length(_digits(m))
    if kind == "ip":
        return m.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if kind == "card":
        return F.when(n.between(12, 19), F.call_function("luhn_check", _digits(m))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    if kind == "candidate":
        return F.length(m).between(SHORTEST, LONGEST) & (n >= DIGITS)
    return F.lit(True)


def _matches(text: Column, kind: str) -> Column:
    """array<struct<rank, i, gap, size, good, value, before, after>> of a kind's matches in text, in code points and in order.

    gap is what lies between a match and the one before it, as split() by the same pattern gives it; before and after are
    the words beside the match. Values and words are in lower case.
    """
    pattern = PATTERNS[kind]
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    each = F.arrays_zip(found.alias("m"), F.slice(gaps, 1, F.size(found)).alias("g"), F.slice(gaps, 2, F.size(found)).alias("h"))

    def step(x: Column, i: Column) -> Column:
        good = _good(kind, x["m"])
        only = lambda c: F.when(good, F.lower(c)).otherwise(F.lit(""))
        return F.struct(F.lit(RANK[kind]).alias("rank"), i.alias("i"), F.length(x["g"]).cast("long").alias("gap"), F.length(x["m"]).cast("long").alias("size"), good.alias("good"), only(x["m"]).alias("value"),
                        only(F.regexp_extract(F.right(x["g"], F.lit(BESIDE)), LEFT, 1)).alias("before"), only(F.regexp_extract(F.left(x["h"], F.lit(BESIDE)), RIGHT, 1)).alias("after"))

    empty = F.array().cast("array<struct<rank:int,i:int,gap:bigint,size:bigint,good:boolean,value:string,before:string,after:string>>")
    return F.when(text.rlike(pattern), F.transform(each, step)).otherwise(empty)


def _places(some: DataFrame) -> DataFrame:
    """_text_key, copies, start, rank, end, value, before, after of the good matches of distinct texts.

    Candidates that meet a base span go: they are known. Places are running sums of gaps and matches, text by text.
    """
    by_text = some.groupBy("_text_key").agg(F.first("_found").alias("_found"), F.count("*").alias("copies"))
    each = by_text.select("_text_key", "copies", F.inline("_found"))
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("_text_key", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    spans = each.withColumn("end", end).where("good").withColumn("start", F.col("end") - F.col("size"))
    base, in_text = F.col("rank") < len(BASE), Window.partitionBy("_text_key")
    reached = F.max(F.when(base, F.col("end"))).over(in_text.orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    coming = F.min(F.when(base, F.col("start"))).over(in_text.orderBy(F.col("start").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    met = (F.coalesce("reached", F.lit(0)) > F.col("start")) | F.coalesce(F.col("coming") < F.col("end"), F.lit(False))
    free = spans.withColumn("reached", reached).withColumn("coming", coming).where(base | ~met)
    return free.select("_text_key", "copies", "start", "rank", "end", "value", "before", "after")


def discover(edges: DataFrame, totals: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confident: float = CONFIDENT, accept: float = ACCEPT) -> DataFrame:
    """value, kind (rank of BASE) of candidates that confident patterns point at; the lowest kind of several.

    edges: side, word, rank, value, n of distinct patterns and values; totals: word, total. Every round shuffles edges by
    value and sums by pattern; patterns and values meet only where the pattern is confident, so a word that stands
    everywhere joins with nothing.
    """
    seeds = edges.where(F.col("rank") < len(BASE)).groupBy("side", "word", F.col("rank").alias("kind")).agg(F.count("*").alias("values"), F.sum("n").alias("n"))
    candidates = edges.where(F.col("rank") == len(BASE)).select("side", "word", "value", "n")
    found = None
    for _ in range(rounds):
        known = seeds
        if found is not None:
            known = known.unionByName(candidates.join(found, "value").groupBy("side", "word", "kind").agg(F.count("*").alias("values"), F.sum("n").alias("n")))
        share = F.least(F.sum("n") / F.first("total"), F.lit(0.999999))
        sure = known.join(totals, "word").groupBy("side", "word", "kind").agg(share.alias("confidence"), F.sum("values").alias("values")).where((F.col("values") >= support) & (F.col("confidence") >= confident))
        scored = candidates.join(sure, ["side", "word"]).groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score"))
        found = materialize(scored.where(F.col("score") >= accept - 1e-9).groupBy("value").agg(F.min("kind").alias("kind")))
    return found


def find_personal(docs: DataFrame, text_col: str = "text", drop_text: bool = False) -> DataFrame:
    """docs with personal_spans added: a sorted array of (start, rank of KINDS, end) in code points, end exclusive.

    A null or empty text has no spans. Repeated rows get the same spans each; copies of a text are worked on once and
    count each in the shares of patterns. Other columns pass through; a column of docs that is named as the result is
    replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.drop("personal_spans")
    columns = [c for c in docs.columns if not (drop_text and c == text_col)]
    placed = materialize(docs.select(*columns, text_key(F.col(text_col)).alias("_text_key"), F.concat(*[_matches(text, k) for k in PATTERNS]).alias("_found")))
    some, none = placed.where("size(_found) > 0"), placed.where("size(_found) = 0")
    spans = materialize(_places(some))

    sides = F.array(F.struct(F.lit("before").alias("side"), F.col("before").alias("word")), F.struct(F.lit("after").alias("side"), F.col("after").alias("word")))
    edges = spans.select("rank", "value", "copies", F.inline(sides)).where("word <> ''").groupBy("side", "word", "rank", "value").agg(F.sum("copies").alias("n"))
    # Only words beside enough seeds can become patterns, in the first round or, through what they find, later.
    edges = materialize(edges)
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    totals = words.groupBy("word").agg(F.count("*").alias("total"))
    totals = materialize(totals.join(edges.select("word").distinct(), "word", "left_semi"))
    found = discover(edges, totals)

    parts = spans.where(F.col("rank") < len(BASE)).select("_text_key", F.struct("start", "rank", "end").alias("part"))
    extra = spans.where(F.col("rank") == len(BASE)).join(found, "value").select("_text_key", F.struct("start", (F.col("kind") + len(BASE)).alias("rank"), "end").alias("part"))
    by_text = parts.unionByName(extra).groupBy(F.col("_text_key").alias("k")).agg(F.array_sort(F.collect_list("part")).alias("personal_spans"))
    empty = F.array().cast("array<struct<start:bigint,rank:int,end:bigint>>")
    whole = some.join(by_text, F.col("_text_key") == F.col("k"), "left").select(*columns, F.coalesce("personal_spans", empty).alias("personal_spans"))
    return whole.unionByName(none.select(*columns, empty.alias("personal_spans")))


def _text(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found of every row."""
    found = find_personal(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", drop_text=True)
    base = F.filter("personal_spans", lambda s: s["rank"] < len(BASE))
    count = lambda k: F.size(F.filter("personal_spans", lambda s: s["rank"] == RANK[k])).cast("long").alias(f"n_{k}")
    extra = F.size(F.filter("personal_spans", lambda s: s["rank"] >= len(BASE))).cast("long").alias("n_found")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(_text(base).cast("binary"), 256).alias("base_sha256"), _text(F.col("personal_spans")).alias("spans"), extra)


def oracle() -> str:
    """personal_digest() over documents in DuckDB, whose patterns know no look-around and need none."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]", "candidate": "[A-Za-z0-9]+(?:[@._/+-][A-Za-z0-9]+)*",
    }
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda p: case when p % 2 = 1 then substr({digits}, -p, 1)::int else (2 * substr({digits}, -p, 1)::int) // 10 + (2 * substr({digits}, -p, 1)::int) % 10 end)) % 10 = 0"
    good = {
        "email": "true", "ip": f"regexp_full_match(m, '{PART}(?:\\.{PART}){{3}}')", "card": f"length({digits}) between 12 and 19 and {luhn}",
        "phone": f"length({digits}) between 9 and 15", "candidate": f"length(m) between {SHORTEST} and {LONGEST} and length({digits}) >= {DIGITS}",
    }

    def places(kind: str) -> str:
        p, rank = plain[kind], RANK[kind]
        # A token without digits is no candidate and does not part the gaps of those that are.
        return f"""select k, copies, {rank} as rank, s as start, s + length(m) as "end", lower(m) as value, lower(regexp_extract(right(substr(x, p + 1, s - p), {BESIDE}), '{LEFT}', 1)) as before,
  lower(regexp_extract(substr(x, s + length(m) + 1, least({BESIDE}, coalesce(q, length(x)) - s - length(m))), '{RIGHT}', 1)) as after, m from (
  select k, copies, x, m, s, coalesce(lag(s + length(m)) over w, 0) as p, lead(s) over w as q from (
    select k, copies, x, m, i, (sum(length(g)) over (partition by k order by i) + coalesce(sum(length(m)) over (partition by k order by i rows between unbounded preceding and 1 preceding), 0))::bigint as s
    from (select k, copies, x, unnest(regexp_extract_all(x, '{p}')) as m, unnest(list_slice(regexp_split_to_array(x, '{p}'), 1, len(regexp_extract_all(x, '{p}')))) as g, unnest(range(len(regexp_extract_all(x, '{p}')))) as i from u))
  where {"regexp_matches(m, '[0-9]')" if kind == "candidate" else "true"} window w as (partition by k order by s)) where {good[kind]}"""

    def turn(i: int) -> str:
        more = "" if i == 1 else f" union all select side, word, f.kind, count(*), sum(n) from e join found{i - 1} f using (value) where rank = {len(BASE)} group by all"
        return f"""known{i} as (select side, word, rank as kind, count(*) as c, sum(n) as n from e where rank < {len(BASE)} group by all{more}),
sure{i} as (select side, word, kind, least(sum(n)::double / any_value(total), 0.999999) as confidence from known{i} join totals using (word) group by all having sum(c) >= {SUPPORT} and confidence >= {CONFIDENT}),
found{i} as (select value, min(kind) as kind from (select value, s.kind from e join sure{i} s using (side, word) where rank = {len(BASE)} group by value, s.kind having 1 - exp(sum(ln(1 - confidence))) >= {ACCEPT} - 1e-9) group by value)"""

    names = " ".join(f"when {i} then '{k}'" for i, k in enumerate(KINDS))
    one = f"case rank {names} end || ':' || start || ':' || \"end\""
    return f"""
with u as materialized (select coalesce(text, '') as x, md5(coalesce(text, '')) as k, count(*) as copies from documents group by all),
base as materialized ({" union all ".join(places(k) for k in BASE)}),
free as (select c.* from ({places("candidate")}) c where not exists (select 1 from base b where b.k = c.k and b.start < c."end" and c.start < b."end")),
spans as materialized (select * from base union all select * from free),
e as materialized (select side, word, rank, value, sum(copies) as n from (select rank, value, copies, 'before' as side, before as word from spans union all select rank, value, copies, 'after', after from spans) where word <> '' group by all),
totals as (select word, count(*) as total from (select unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) as word from documents) group by word),
{", ".join(turn(i) for i in range(1, ROUNDS + 1))},
final as (select k, rank, start, "end" from base union all select k, f.kind + {len(BASE)}, start, "end" from free join found{ROUNDS} f using (value)),
f as (select k, {", ".join(f"count(*) filter (rank = {i}) as n{i}" for i in range(len(BASE)))}, count(*) filter (rank >= {len(BASE)}) as more,
  string_agg({one}, ',' order by start, rank) filter (rank < {len(BASE)}) as b, string_agg({one}, ',' order by start, rank) as s from final group by k)
select doc_id, {", ".join(f"coalesce(n{i}, 0) as n_{k}" for i, k in enumerate(BASE))}, sha256(coalesce(b, '')) as base_sha256, coalesce(s, '') as spans, coalesce(more, 0) as n_found
from documents d left join f on f.k = md5(coalesce(d.text, ''))
"""
