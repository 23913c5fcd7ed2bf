"""Substring deduplication by sliding sentence spans.

A text is cut into units: sentences and clauses, which end after a word with one of . ! ? ; : , behind it or before a line
feed; a clause of more than LONG words is cut again after words that a rule on their last character and length picks, so
that a passage has the same units wherever it stands, and what is then still longer, as one word repeated may be, after
every LONG words from its start. From every unit on, the run of the next units that number SPAN and
hold LEAST words at least is hashed; hashes are joined over all documents, and the words that any run but the first of
its hash covers are removed. The first one is that of least id, then of least position. White space between words does
not count, and that behind a removed word goes with it.

A repeated passage loses all but the words before its first unit and those after its last whole run; a passage of less
than LEAST words is left alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import WORD, bound_batches
from skein.llm.near_text import UNNAMED, mix

SPAN, LEAST, LONG, EVERY = 3, 30, 18, 5
U = np.uint64
STOPS = np.array([ord(c) for c in ".!?;:,"], dtype=np.uint32)
SALTS = 16
#: Odd bases of the two hashes of a run, and their inverses modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)
#: Characters of the texts that are laid out at a time; a longer text is laid out by itself.
CHARACTERS = 1 << 22


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=U)
    out[0] = 1
    return np.cumprod(out, dtype=U)


class Layout:
    """Words, units and runs of texts: for each word its text, start and end, for each run its text and its words."""

    def __init__(self, texts: list[str]):
        cp = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        text_of = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
        gap = ((cp >= 9) & (cp <= 13)) | (cp == 32)
        inside = np.flatnonzero(~gap)
        # The character behind a text is a gap, so no word crosses texts.
        new = np.diff(inside, prepend=-2) > 1
        self.start = inside[new]
        n = len(self.start)
        self.end = np.append(inside[np.flatnonzero(new)[1:] - 1], inside[-1:]) + 1 if n else self.start
        self.text = text_of[self.start]
        self.first = np.searchsorted(self.text, np.arange(len(texts) + 1))
        self.offset = np.cumsum([0] + [len(t) + 1 for t in texts])
        empty = np.zeros(0, np.int64)
        self.run_text, self.run_start, self.run_end = empty, empty, empty
        self.h, self.c = np.zeros(0, U), np.zeros(0, np.int16)
        if not n:
            return
        last, size = cp[self.end - 1], self.end - self.start
        lines = np.cumsum(cp == 10)
        after = np.append(self.start[1:], len(cp) - 1)
        ends_text = np.append(self.text[1:] != self.text[:-1], True)
        cut = ends_text | np.isin(last, STOPS) | (lines[after - 1] > lines[self.end - 1])
        clause = np.cumsum(cut) - cut
        stop = cut | ((np.bincount(clause)[clause] > LONG) & ((last + size) % EVERY == 0))
        since = np.arange(n) - np.maximum.accumulate(np.where(np.append(True, stop[:-1]), np.arange(n), 0))
        stop |= since % LONG == LONG - 1
        ends = np.flatnonzero(stop) + 1
        starts = np.append(0, ends[:-1])
        reach = np.maximum(np.arange(len(starts)) + SPAN - 1, np.searchsorted(ends, starts + LEAST))
        whole = reach < len(ends)
        starts, reach = starts[whole], ends[reach[whole]]
        whole = self.text[starts] == self.text[reach - 1]
        self.run_start, self.run_end = starts[whole], reach[whole]
        self.run_text = self.text[self.run_start]
        at = np.arange(len(inside)) - np.repeat(np.flatnonzero(new), size)
        word = mix(np.add.reduceat((cp[inside].astype(U) + U(7)) * _powers(BASES[0], int(size.max()))[at], np.flatnonzero(new)) + size.astype(U))
        hashes = []
        for base, inverse, salt in zip(BASES, INVERSES, (0, 1), strict=True):
            sums = np.append(U(0), np.cumsum(mix(word + U(salt)) * _powers(base, n), dtype=U))
            back = _powers(inverse, n)
            hashes.append(mix((sums[self.run_end] - sums[self.run_start]) * back[self.run_start] + (self.run_end - self.run_start).astype(U)))
        # 80 bits name a run.
        self.h, self.c = hashes[0], (hashes[1] >> U(48)).astype(np.uint16).view(np.int16)

    def again(self) -> np.ndarray:
        """Runs whose hash an earlier run of the same text has."""
        order = np.lexsort((self.run_start, self.c, self.h, self.run_text))
        t, h, c = self.run_text[order], self.h[order], self.c[order]
        same = np.zeros(len(order), dtype=bool)
        same[1:] = (t[1:] == t[:-1]) & (h[1:] == h[:-1]) & (c[1:] == c[:-1])
        out = np.zeros(len(order), dtype=bool)
        out[order] = same
        return out


def batches(texts: list[str]):
    """Stretches [lo, hi) of texts of some CHARACTERS each."""
    lo = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > CHARACTERS:
            yield lo, i
            lo, total = i, 0
        total += len(t)
    if lo < len(texts):
        yield lo, len(texts)


RUNS = T.StructType([T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("h", T.ArrayType(T.LongType())), T.StructField("c", T.ArrayType(T.ShortType())), T.StructField("again", T.ArrayType(T.BooleanType()))])
LEFT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_removed", T.LongType())])


@F.pandas_udf(RUNS)
def _runs(texts: pd.Series) -> pd.DataFrame:
    texts, parts = list(texts), {"at": [], "h": [], "c": [], "again": []}
    for lo, hi in batches(texts):
        x = Layout(texts[lo:hi])
        edges = np.searchsorted(x.run_text, np.arange(1, hi - lo))
        at = x.run_start - x.first[x.run_text]
        for name, values in (("at", at.astype(np.int32)), ("h", x.h.view(np.int64)), ("c", x.c), ("again", x.again())):
            parts[name] += np.split(values, edges)
    return pd.DataFrame({k: pd.Series(v, dtype=object) for k, v in parts.items()})


def left_of(texts: list[str], hits: list[dict[int, int]]) -> list[tuple[str, int]]:
    """Each text without the runs in hits (position: hash), and how many of its words went."""
    x = Layout(texts)
    gone = np.zeros(len(x.start) + 1, dtype=np.int64)
    h = x.h.view(np.int64)
    for i, (t, s) in enumerate(zip(x.run_text.tolist(), (x.run_start - x.first[x.run_text]).tolist(), strict=True)):
        # A row of the same id but another text has no run of this hash here.
        if hits[t].get(s) == h[i]:
            gone[x.run_start[i]] += 1
            gone[x.run_end[i]] -= 1
    gone = np.cumsum(gone[:-1]) > 0
    out = []
    for k, text in enumerate(texts):
        lo, hi = int(x.first[k]), int(x.first[k + 1])
        lost = gone[lo:hi]
        # Stretches of removed words, with the white space behind them.
        edges = np.flatnonzero(np.diff(lost.astype(np.int8), prepend=0, append=0)) + lo
        begin, pieces = 0, []
        for a, b in edges.reshape(-1, 2).tolist():
            pieces.append(text[begin : x.start[a] - x.offset[k]])
            begin = x.start[b] - x.offset[k] if b < hi else len(text)
        out.append(("".join(pieces) + text[begin:], int(lost.sum())))
    return out


@F.pandas_udf(LEFT)
def _left(texts: pd.Series, hits: pd.Series) -> pd.DataFrame:
    rows: list[tuple] = [(None, 0)] * len(texts)
    some = [i for i, t in enumerate(texts) if t is not None]
    whole, found = [texts.iloc[i] for i in some], [{r["at"]: r["h"] for r in hits.iloc[i]} for i in some]
    for lo, hi in batches(whole):
        for i, row in zip(some[lo:hi], left_of(whole[lo:hi], found[lo:hi]), strict=True):
            rows[i] = row
    return pd.DataFrame(rows, columns=["text", "n_removed"])


def _document(id_col: str, text: Column) -> Column:
    """Identity and order of documents; those without an id come last, named by a hash of their text."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(UNNAMED) + F.xxhash64(text).bitwiseAND(F.lit(UNNAMED - 1)))


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text cleaned, and n_words, n_removed (words) added in place of columns of those names.

    Identical rows of one id are one occurrence and keep what that keeps; rows of one id with different texts are searched
    as one document, each for its own runs. Null texts stay null and have 0 words. A common run costs one row for each
    occurrence: counts are combined before the shuffle, and its occurrences meet them in SALTS places.
    """
    bound_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    runs = docs.select(_document(id_col, text).alias("document"), _runs(text).alias("r")).select("document", F.inline(F.arrays_zip("r.at", "r.h", "r.c", "r.again")))
    runs = runs.withColumn("salt", F.pmod(F.xxhash64("document"), F.lit(SALTS)).cast("int"))
    firsts = runs.groupBy("h", "c").agg(F.min("document").alias("first"), F.count("*").alias("n"), F.expr("bit_or(shiftleft(1, salt))").alias("bits")).where("n > 1")
    # A repeated hash goes to the places where its documents are: a rare one to few, a hot one to all.
    places = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.expr("bits").bitwiseAND(F.call_function("shiftleft", F.lit(1), i)) != 0)
    hits = runs.join(firsts.select("h", "c", "first", F.explode(places).alias("salt")), ["h", "c", "salt"]).where((F.col("document") > F.col("first")) | F.col("again"))
    # Rows are moved before they are gathered: plain numbers take less room than half-made sets.
    gone = hits.select(F.col("document").alias("_document"), "at", "h").repartition("_document").groupBy("_document").agg(F.collect_set(F.struct("at", "h")).alias("_hits"))
    joined = docs.drop("n_words", "n_removed").withColumn("_document", _document(id_col, text)).join(gone, "_document", "left")
    none = F.array().cast("array<struct<at:int,h:bigint>>")
    # Only texts with a hit go to a Python worker and come back.
    hit = F.col("_hits").isNotNull()
    out = joined.withColumn("_left", _left(F.when(hit, F.col(text_col)), F.coalesce("_hits", none)))
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    cleaned = out.withColumns({"n_words": words, "n_removed": F.coalesce("_left.n_removed", F.lit(0).cast("long"))})
    return cleaned.withColumn(text_col, F.when(hit, F.col("_left.text")).otherwise(F.col(text_col))).drop("_document", "_hits", "_left")


#: remove_repeated() over documents in DuckDB.
ORACLE = f"""
with recursive d as (select doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]*') as p from documents),
w as (select doc_id, unnest(p) as p, unnest(range(len(p))) as i, len(p) as n from d),
v as (select *, regexp_replace(p, '[\\x20\\x09-\\x0D]+$', '') as s from w),
x as (select *, (i = n - 1 or regexp_matches(s, '[.!?;:,]$') or contains(p, chr(10))) as cut from v),
y as (select *, coalesce(sum(cut::int) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as clause from x),
z as (select *, count(*) over (partition by doc_id, clause) as size from y),
o as (select *, cut or (size > {LONG} and (unicode(right(s, 1)) + length(s)) % {EVERY} = 0) as picked from z),
l as (select *, coalesce(sum(picked::int) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as stretch from o),
b as (select *, picked or row_number() over (partition by doc_id, stretch order by i) % {LONG} = 0 as stop from l),
e as (select doc_id, list(s order by i) as ws, list(i + 1 order by i) filter (stop) as ends from b group by doc_id),
u as (select doc_id, ws, ends, unnest(list_prepend(0, ends[:-2])) as s, unnest(range(len(ends))) as k from e),
r as (select doc_id, s, list_filter(ends[k + {SPAN}:], lambda q: q >= s + {LEAST})[1] as t, ws from u),
q as (select doc_id, s, t, row_number() over (partition by array_to_string(ws[s + 1:t], ' ') order by doc_id, s) as k from r where t is not null),
g as (select distinct doc_id, unnest(range(s, t)) as i from q where k > 1)
select d.doc_id, case when d.text is null then null else regexp_extract(d.text, '^[\\x20\\x09-\\x0D]*') || coalesce(string_agg(b.p, '' order by b.i) filter (g.i is null), '') end as text,
  count(b.i) as n_words, count(g.i) as n_removed
from d left join b on b.doc_id = d.doc_id left join g on g.doc_id = b.doc_id and g.i = b.i group by d.doc_id, d.text
"""
