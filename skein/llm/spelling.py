"""Spelling variants: words one edit apart, by an even-partition pigeonhole join (after PassJoin; Li and others, 2011).

A word of length l is cut into two even segments, which depend on l alone. One edit leaves one of the two whole, so two
words of which one has length l and the other l or l + 1 can be near only if they agree outside one segment: the word
of length l is indexed once for each segment that may hold the edit, by all that lies outside; words of length l and
l + 1 probe with their substrings at the same, or for what follows the edit at the shifted, place. Where a bucket of the
index would make too many candidates, the segment that may hold the edit is halved by the same rule, so buckets stay
small whatever prefixes or endings the words share. Candidates are verified and a pair that several buckets hold is
kept once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import bound_batches, materialize
from skein.llm.stretches import ascii_lower, stretches

RUN = re.compile("[A-Za-zÀ-ÿ]+")
OUTSIDE = re.compile("[^A-Za-zÀ-ÿ]")
#: Least code points and least occurrences of a word, and how many times as frequent its form has to be.
SHORTEST, LEAST, TIMES = 6, 5, 5
#: Candidates of a bucket above which the segment that may hold the edit is halved again.
CROWD = 1 << 12
#: Distinct words that a task counts before it hands them on.
HELD = 400_000


def word_counts(docs: DataFrame, slips_every: int = 0, shortest: int = SHORTEST, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n of the runs of letters of whole texts, A-Z in lower case, with at least so many code points and occurrences.

    With slips_every, a run whose crc32 of "<doc_id>:<run>" that number divides loses the code point at crc32 % length,
    which plants slips of the pen; a null doc_id is written as nothing. A null or empty text has no runs.
    """
    bound_batches(docs.sparkSession)

    def frame(seen):
        return pd.DataFrame({"word": list(seen.keys()), "n": list(seen.values())})

    def count(frames):
        seen: Counter = Counter()
        for f in frames:
            for name, text in zip(f["name"], f["text"], strict=True):
                for part in stretches(ascii_lower(text), OUTSIDE):
                    for run, n in Counter(RUN.findall(part)).items():
                        if len(run) < shortest:
                            continue
                        if slips_every and (h := zlib.crc32(f"{name}:{run}".encode())) % slips_every == 0:
                            at = h % len(run)
                            run = run[:at] + run[at + 1 :]
                        seen[run] += n
                    if len(seen) > HELD:
                        yield frame(seen)
                        seen.clear()
        if seen:
            yield frame(seen)

    texts = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"), F.col(text_col).alias("text")).where("text is not null")
    runs = texts.mapInPandas(count, "word string, n long").where(F.length("word") >= shortest)
    return runs.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _key(length: Column, low: Column, high: Column, shift: Column | int) -> Column:
    """What a word has outside the stretch from low to high + shift, with the place of that stretch, as 64 bits."""
    shift = F.lit(shift) if isinstance(shift, int) else shift
    return F.xxhash64(length, low, high, F.substring("word", F.lit(1), low), F.substring("word", high + shift + 1, F.length("word")))


def _halves(low: Column, high: Column) -> Column:
    middle = F.floor((low + high) / 2).cast("int")
    return F.explode(F.array(F.struct(low.alias("low"), middle.alias("high")), F.struct(middle.alias("low"), high.alias("high"))))


def _segments(words: DataFrame) -> DataFrame:
    """Entries of the index and probes: word, n, probe, length of the indexed word, the segment and the key."""
    own = F.length("word")
    every = F.filter(F.array(F.struct(F.lit(False).alias("probe"), own.alias("length")), F.struct(F.lit(True).alias("probe"), own.alias("length")), F.struct(F.lit(True).alias("probe"), (own - 1).alias("length"))), lambda e: e["length"] > 0)
    each = words.select("word", "n", F.explode(every).alias("e")).select("word", "n", "e.probe", "e.length")
    return _keyed(each.withColumn("s", _halves(F.lit(0), F.col("length"))))


def _keyed(each: DataFrame) -> DataFrame:
    shift = F.length("word") - F.col("length")
    each = each.select("word", "n", "probe", "length", F.col("s.low").alias("low"), F.col("s.high").alias("high"))
    return each.withColumn("key", _key(F.col("length"), F.col("low"), F.col("high"), shift))


def _verified(entries: DataFrame) -> DataFrame:
    """a, a_n, b, b_n of candidates that one edit parts; of words of one length the lesser is a."""
    index = entries.where("not probe").select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    probes = entries.where("probe").select("key", F.col("word").alias("b"), F.col("n").alias("b_n"))
    once = (F.length("a") < F.length("b")) | (F.col("a") < F.col("b"))
    return index.join(probes, "key").where(once & (F.levenshtein("a", "b", 1) == 1)).select("a", "a_n", "b", "b_n")


def near_pairs(words: DataFrame) -> DataFrame:
    """word, n, near, near_n: both directions of every pair of words that one inserted, deleted or replaced code point parts.

    words has distinct word, and n, and is read several times.
    """
    entries, found = _segments(words), []
    while True:
        sizes = entries.groupBy("key").agg(F.sum(F.when(F.col("probe"), 0).otherwise(1)).alias("of_index"), F.sum(F.when(F.col("probe"), 1).otherwise(0)).alias("of_probes"), F.min(F.col("high") - F.col("low")).alias("width"))
        crowded = materialize(sizes.where((F.col("of_index") * F.col("of_probes") > CROWD) & (F.col("width") > 1)).select("key"))
        if crowded.isEmpty():
            found.append(_verified(entries))
            break
        found.append(_verified(entries.join(crowded, "key", "left_anti")))
        narrower = entries.join(crowded, "key", "left_semi").withColumn("s", _halves(F.col("low"), F.col("high")))
        entries = materialize(_keyed(narrower))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    pairs = materialize(pairs.dropDuplicates(["a", "b"]))
    one = pairs.select(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("near"), F.col("b_n").alias("near_n"))
    return one.unionByName(pairs.select(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))


def spelling_groups(words: DataFrame, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n of distinct words with their n.

    A word's form is its near word of largest n (ties: the smallest), if that is at least times the word's own; root is
    the end of its forms. Since n grows on the way, there are no rings and few steps. A word has at most so many near
    words as letters and places allow, so no group here grows with the corpus.
    """
    words = materialize(words.select("word", "n"))
    best = F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near").alias("form"), F.col("near_n").alias("form_n")))
    links = near_pairs(words).groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("b"))
    good = F.col("b.form_n") >= times * F.col("n")
    links = materialize(links.select("word", "n_near", F.when(good, F.col("b.form")).alias("form"), F.when(good, F.col("b.form_n")).alias("form_n")))
    roots = links.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = materialize(roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if roots.where("moved").isEmpty():
            break
    out = words.join(links, "word", "left").join(roots.select("word", "root"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


#: spelling_groups() over the words of documents in DuckDB, with slips: crc32 by its table, near words by their deletions.
ORACLE = """
with recursive codes as (select list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
runs as (select doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) as run from documents) where length(run) >= 6),
each as (select doc_id, run, count(*) as n, hex(encode(coalesce(doc_id::varchar, '') || ':' || run)) as x from runs group by doc_id, run),
hashed as (select run, n, xor(4294967295, list_reduce(list_concat([4294967295::bigint], list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::bigint)),
  lambda c, b: xor(c >> 8, t[1 + xor(c & 255, b)]))) as h from each, codes),
slipped as (select case when h % 199 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, n from hashed),
words as (select word, sum(n)::bigint as n from slipped where length(word) >= 6 group by word having sum(n) >= 5),
less as (select word, n, i, substr(word, 1, i) || substr(word, i + 2) as rest from (select word, n, unnest(range(length(word)))::int as i from words)),
pairs as (select a.word, a.n, b.word as near, b.n as near_n from less a join less b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union select l.word, l.n, w.word, w.n from less l join words w on l.rest = w.word union select w.word, w.n, l.word, l.n from less l join words w on l.rest = w.word),
links as (select word, any_value(n) as n, count(*) as n_near, arg_min(near, row(-near_n, near)) as form, max(near_n) as form_n from pairs group by word),
forms as (select word, n_near, case when form_n >= 5 * n then form end as form, case when form_n >= 5 * n then form_n end as form_n from links),
steps as (select word, form as head, 1 as depth from forms where form is not null union all select s.word, f.form, depth + 1 from steps s join forms f on f.word = s.head where f.form is not null),
roots as (select word, arg_max(head, depth) as root from steps group by word)
select w.word, f.form, coalesce(r.root, w.word) as root, w.n, coalesce(f.n_near, 0) as n_near, f.form_n from words w left join forms f using (word) left join roots r using (word)
"""
