"""Collocations: phrases whose words meet more often than their parts let expect, language by language.

Every task adds its runs of one to three words to a count-min sketch of small saturating counters; the sketches are
merged, slice by slice. A sketch never counts too little, so the second pass hands on only runs that the merged sketch,
for the run and for each shorter run inside it, puts at the least frequency or above, and counts those exactly: nothing
frequent is lost and few of the rare are shuffled. Candidates are then scored by their weakest cut, and those that live
inside a longer one are dropped.
"""

from __future__ import annotations

import re
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import bound_batches, materialize
from skein.llm.near_text import mix
from skein.llm.stretches import ascii_lower, stretches

ENDS = ".,;:!?\n\x0b\x0c\r"
END = re.compile(r"[.,;:!?\x0A-\x0D]")
TOKEN = re.compile(r"[^\x20\x09.,;:!?\x0A-\x0D]+|[.,;:!?\x0A-\x0D]")
U = np.uint64
#: Bits of a word's number within a task; three words make a key of 63 bits.
BITS = 21
#: Rows of the sketch, and the largest count of one of its cells, two of which share a byte.
DEPTH, FULL = 2, 15
#: Cells of the sketch (32 MB), and of a slice of it; tasks whose slices are added up in one place first.
CELLS, SLICE, TOGETHER = 1 << 26, 1 << 20, 256
#: Runs that a task holds before it hands them on.
HELD = 2_000_000


class Words(dict):
    """Numbers of the words of a task, from 1 in the order of their appearance; 0 for ends of pieces."""

    def __init__(self):
        super().__init__(dict.fromkeys(ENDS, 0))
        self.names, self.hashes = [""], [0]

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self.names)
        self.names.append(word)
        self.hashes.append(int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little"))
        return number


def runs_of(numbers: np.ndarray) -> np.ndarray:
    """Keys of all runs of one, two and three words: their numbers, BITS bits each."""
    n, bits = numbers, BITS
    two = (n[:-1] << bits | n[1:])[(n[:-1] > 0) & (n[1:] > 0)]
    three = (n[:-2] << 2 * bits | n[1:-1] << bits | n[2:])[(n[:-2] > 0) & (n[1:-1] > 0) & (n[2:] > 0)]
    return np.concatenate([n[n > 0], two, three])


def counted_runs(frames):
    """(lang, words, keys, counts) of the runs of texts, in portions; a portion's keys are distinct."""
    words, held, n = Words(), {}, 0

    def portion():
        for lang, keys in held.items():
            yield (lang, words, *np.unique(np.concatenate(keys), return_counts=True))

    for f in frames:
        for lang, text in zip(f["lang"], f["text"], strict=True):
            for part in stretches(ascii_lower(text), END):
                found = TOKEN.findall(part)
                keys = runs_of(np.fromiter(map(words.__getitem__, found), np.int64, len(found)))
                held.setdefault(lang, []).append(keys)
                n += len(keys)
                if n > HELD or len(words) > 1 << (BITS - 1):
                    yield from portion()
                    words, held, n = Words(), {}, 0
    yield from portion()


def run_hashes(lang: str, hashes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """64-bit hashes of keys; a leading 0 stands for no word."""
    out = np.full(len(keys), int.from_bytes(blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little"), U)
    for shift in (2 * BITS, BITS, 0):
        part = keys >> shift & (1 << BITS) - 1
        out = np.where(part > 0, mix(out * U(0x9E3779B97F4A7C15) + hashes[part] + U(1)), out)
    return out


def cells_of(h: np.ndarray, cells: int, row: int) -> np.ndarray:
    """The cell of each hash in a row of the sketch."""
    width = cells // DEPTH
    return ((mix(h + U(row)) & U(width - 1)) + U(row * width)).astype(np.int64)


def add(sketch: np.ndarray, cell: np.ndarray, counts: np.ndarray) -> None:
    """Add counts to cells, which stop at FULL."""
    order = np.argsort(cell, kind="stable")
    cell = cell[order]
    first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, np.int64)
    if len(first):
        sums = np.add.reduceat(counts[order], first)
        at = cell[first]
        sketch[at] = np.minimum(sketch[at] + sums, FULL)


def packed(sketch: np.ndarray) -> np.ndarray:
    return sketch[::2] | sketch[1::2] << 4


def unpacked(data: np.ndarray) -> np.ndarray:
    out = np.empty(2 * len(data), np.uint8)
    out[::2], out[1::2] = data & 15, data >> 4
    return out


def at_least(sketch: np.ndarray, h: np.ndarray, least: int) -> np.ndarray:
    """Whether the packed sketch puts a hash at least so high."""
    good, cells = np.ones(len(h), dtype=bool), 2 * len(sketch)
    for row in range(DEPTH):
        cell = cells_of(h, cells, row)
        good &= (sketch[cell >> 1] >> (cell & 1) * 4 & 15) >= least
    return good


def squeeze(data: np.ndarray) -> bytes:
    return pa.compress(data.tobytes(), codec="zstd", asbytes=True)


def expand(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, size, codec="zstd", asbytes=True), np.uint8)


def merged_sketch(texts: DataFrame, cells: int) -> np.ndarray:
    """The packed sketch of all texts: cells / 2 bytes, whatever the number of texts.

    A task hands on its sketch in slices. They are added up in streams, first in several places per slice, then in one,
    so a task holds one slice at a time. Only the end, of fixed size, comes to the driver.
    """
    size = min(cells, SLICE)

    def build(frames):
        sketch = np.zeros(cells, np.uint8)
        for lang, words, keys, counts in counted_runs(frames):
            h = run_hashes(lang, np.array(words.hashes, U), keys)
            for row in range(DEPTH):
                add(sketch, cells_of(h, cells, row), counts)
        place = TaskContext.get().partitionId() // TOGETHER
        for no in range(cells // size):
            if (own := sketch[no * size : (no + 1) * size]).any():
                yield pd.DataFrame({"no": [no], "place": [place], "cells": [squeeze(packed(own))]})

    def total(frames):
        at, sums = None, None
        for f in frames:
            for no, place, data in zip(f["no"], f["place"], f["cells"], strict=True):
                if (no, place) != at:
                    if at is not None:
                        yield pd.DataFrame({"no": [at[0]], "place": [at[1]], "cells": [squeeze(packed(sums))]})
                    at, sums = (no, place), np.zeros(size, np.uint8)
                sums = np.minimum(sums + unpacked(expand(data, size // 2)), FULL)
        if at is not None:
            yield pd.DataFrame({"no": [at[0]], "place": [at[1]], "cells": [squeeze(packed(sums))]})

    schema = "no int, place int, cells binary"
    slices = texts.mapInPandas(build, schema)
    for _ in range(2):
        slices = slices.repartition("no", "place").sortWithinPartitions("no", "place").mapInPandas(total, schema).withColumn("place", F.lit(0))
    out = np.zeros(cells // 2, np.uint8)
    for r in slices.select("no", "cells").collect():
        out[r["no"] * size // 2 : (r["no"] + 1) * size // 2] = expand(bytes(r["cells"]), size // 2)
    return out


def frequent_runs(texts: DataFrame, least: int, sketch: np.ndarray) -> DataFrame:
    """lang, words, phrase, n: exact counts of all runs of one to three words from least on; of words = 0 the words of a lang."""
    shared = texts.sparkSession.sparkContext.broadcast(sketch)
    low = min(least, FULL)

    def survivors(frames):
        for lang, words, keys, counts in counted_runs(frames):
            names, hashes, sketch = np.array(words.names, dtype=object), np.array(words.hashes, U), shared.value
            one = keys < 1 << BITS
            yield pd.DataFrame({"lang": [lang], "words": [0], "phrase": [""], "n": [int(counts[one].sum())]})
            known = np.zeros(len(names), dtype=bool)
            known[keys[one]] = at_least(sketch, run_hashes(lang, hashes, keys[one]), low)
            mask, parts = (1 << BITS) - 1, [keys >> s & (1 << BITS) - 1 for s in (2 * BITS, BITS, 0)]
            good = known[parts[2]] & ((parts[1] == 0) | known[parts[1]]) & ((parts[0] == 0) | known[parts[0]])
            good &= one | (counts >= low) | at_least(sketch, run_hashes(lang, hashes, keys), low)
            keys, counts = keys[good], counts[good]
            two = keys[(keys >= 1 << BITS) & (keys < 1 << 2 * BITS)]
            three = keys >= 1 << 2 * BITS
            inside = lambda x: two[np.minimum(np.searchsorted(two, x), max(0, len(two) - 1))] == x if len(two) else np.zeros(len(x), dtype=bool)
            # A run of three words holds two runs of two; both were counted in the same portion.
            keep = ~three
            keep[three] = inside(keys[three] >> BITS) & inside(keys[three] & (mask << BITS | mask))
            keys, counts = keys[keep], counts[keep]
            a, b, c = (keys >> s & mask for s in (2 * BITS, BITS, 0))
            phrase = np.where(b > 0, names[b] + " ", "") + names[c]
            phrase = np.where(a > 0, names[a] + " ", "") + phrase
            yield pd.DataFrame({"lang": lang, "words": 1 + (b > 0).astype(np.int32) + (a > 0), "phrase": phrase, "n": counts})

    runs = texts.mapInPandas(survivors, "lang string, words int, phrase string, n long")
    return runs.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n")).where((F.col("words") == 0) | (F.col("n") >= least))


def collocations(docs: DataFrame, least: int = 10, first: int = 2000, inside_percent: int = 50, cells: int = CELLS, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best `first` phrases of two and three words of every language.

    a, l and r are the counts of the phrase and of the parts of its weakest cut, n all words of the language; score is
    floor(1000000 * a * a / (l * r)), exact. Order: score and a falling, then phrase. Phrases below `least` are none; one
    inside a longer phrase that has inside_percent of its occurrences goes. Null languages are "und"; null and empty
    texts have no words; repeated rows count each; other columns are not read. The sketch has `cells` cells whatever the
    input, so what a task hands on of it is bounded; the larger the corpus, the more of the rare it lets through to the
    exact counts, which are right for any sketch, and the more cells are worth their room.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    texts = docs.select(F.coalesce(lang_col, F.lit("und")).alias("lang"), F.col(text_col).alias("text")).where("text <> ''")
    counts = materialize(frequent_runs(texts, least, merged_sketch(texts, cells)))
    phrases, parts = counts.where("words > 1"), counts.where("words in (1, 2)").select("lang", "phrase", "n")

    head = lambda k: F.substring_index("phrase", " ", k)
    tail = lambda k: F.expr(f"substring(phrase, length(substring_index(phrase, ' ', {k})) + 2)")
    cut = lambda k: F.struct(F.lit(k).alias("k"), head(k).alias("left"), tail(k).alias("right"))
    cuts = phrases.withColumn("cut", F.explode(F.when(F.col("words") == 2, F.array(cut(1))).otherwise(F.array(cut(1), cut(2))))).select("lang", "words", "phrase", F.col("n").alias("a"), "cut.*")
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    big = lambda c: f"cast({c} as decimal(15, 0))"
    score = F.expr(f"cast(1000000 as decimal(7, 0)) * ({big('a')} * {big('a')}) div ({big('l')} * {big('r')})")
    scored = cuts.groupBy("lang", "words", "phrase", "a").agg(F.min(F.struct(score.alias("score"), F.col("k"), F.col("l"), F.col("r"))).alias("low"))

    longer = phrases.where("words = 3").select("lang", F.explode(F.array(head(2), tail(1))).alias("phrase"), F.col("n").alias("over")).groupBy("lang", "phrase").agg(F.max("over").alias("over"))
    scored = scored.select("lang", "phrase", "a", "low.*").join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("over") < inside_percent * F.col("a"), F.lit(True)))
    # The best of every share of a language first, so that no task orders a whole language.
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    shares = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(shares))).orderBy(*order)
    few = scored.withColumn("_at", F.row_number().over(share)).where(F.col("_at") <= first)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    totals = counts.where("words = 0").select("lang", F.col("n").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: collocations() over documents in DuckDB.
ORACLE = r"""
with pieces as (select row_number() over () as id, lang, w from (select coalesce(lang, 'und') as lang,
  regexp_extract_all(unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') as w from documents where text is not null) where len(w) > 0),
grams as (select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from pieces, (select unnest([1, 2, 3]) as k))),
f as (select lang, k, phrase, count(*) as n from grams group by all),
total as (select lang, sum(n)::bigint as n from f where k = 1 group by lang),
c as (select lang, k, phrase, n as a, string_split(phrase, ' ') as w from f where k > 1 and n >= 10),
cuts as (select c.*, i, array_to_string(w[1:i], ' ') as lp, array_to_string(w[i + 1:], ' ') as rp from c, (select unnest([1, 2]) as i) where i < k),
scored as (select cuts.*, x.n as l, y.n as r, ((1000000::hugeint * a * a) // (x.n::hugeint * y.n))::bigint as score from cuts join f x on x.lang = cuts.lang and x.phrase = lp join f y on y.lang = cuts.lang and y.phrase = rp),
low as (select * from scored qualify row_number() over (partition by lang, phrase order by score, i) = 1),
kept as (select * from low s where not exists (select 1 from c t where t.k = 3 and s.k = 2 and t.lang = s.lang and s.phrase in (array_to_string(t.w[1:2], ' '), array_to_string(t.w[2:3], ' ')) and 100 * t.a >= 50 * s.a)),
r as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select r.lang, r.rank, r.phrase, r.a, r.l, r.r, total.n, r.score from r join total on total.lang = r.lang where rank <= 2000
"""
