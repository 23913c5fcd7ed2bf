"""Harmonic packing of tokenised documents into fixed-length sequences.

A piece of length n belongs to class k = capacity // n, so that k pieces of the class always fit one sequence. Every
class fills its sequences with exactly k pieces, by a rank that workers number independently of each other; no bin is
ever searched. A document is first cut so that its pieces fill their class almost exactly:

* as many pieces of full capacity as it holds,
* of the rest n, in class k: kept whole where it leaves at most `waste` of its share capacity / k empty, else
  capacity // (k + 1) tokens go to class k + 1, which they fill, and what is left is cut in the same way.

Each class ends in at most one sequence that lacks pieces. Those, at most one a class, so no more than `capacity`
whatever the corpus, share sequences by first fit in order of falling size.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import bound_batches, materialize

PIECES = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())]))


def cuts(n: int, capacity: int, waste: float) -> list[int]:
    """Lengths of the pieces of a document of n tokens, in order."""
    out = [capacity] * (n // capacity)
    n %= capacity
    while n:
        k = capacity // n
        head = capacity // (k + 1)
        if k * n >= (1 - waste) * capacity or not head:
            out.append(n)
            break
        out.append(head)
        n -= head
    return out


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in own)}


@lru_cache(maxsize=2)
def library_encoder(path: str):
    """Ids of a text by tokenizers itself."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


class Encoder:
    """Token ids of whole texts as little-endian 32-bit integers, equal to those of the tokenizers file at path.

    Where the file is a plain byte-level BPE whose ids rank its merges, its vocabulary is handed to a faster encoder of
    the same algorithm (special strings inside texts become their ids, as in tokenizers); else, and where that encoder
    refuses a text, tokenizers encodes.
    """

    def __init__(self, path: str):
        import json

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, special = spec["model"], {t["content"]: t["id"] for t in spec["added_tokens"]}
        merged = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
        pre = spec["pre_tokenizer"] or {}
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec["normalizer"] and not spec["post_processor"]
        if plain and merged == sorted(merged) and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            from tiktoken import Encoding

            byte = byte_alphabet()
            ranks = {bytes(byte[c] for c in w): i for w, i in model["vocab"].items() if w not in special}
            # Fixed value: the split pattern of byte-level pre-tokenizers with use_regex.
            pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
            encoding = Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
            def encode(text: str):
                try:
                    return encoding.encode_to_numpy(text, allowed_special="all")
                except ValueError:
                    # Its pattern matcher gives up on very long runs of white space.
                    return library_encoder(path)(text)

            self.encode = encode
        else:
            self.encode = library_encoder(path)

    def ids(self, text: str | None) -> bytes:
        return np.asarray(self.encode(text), dtype="<u4").tobytes() if text else b""


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(text: Column, tokenizer_path: str, capacity: int, end_id: int, waste: float, keep_ids: bool) -> Column:
    """array<struct<start, length, ids>> of a text: its pieces; ids holds the piece's ids, or their crc32 as 4 bytes."""

    @F.pandas_udf(PIECES)
    def cut(texts: pd.Series) -> pd.Series:
        end = np.array([end_id], dtype="<u4").tobytes()
        out, tokens = [], encoder(tokenizer_path)
        for text in texts:
            ids = tokens.ids(text) + end
            start, row = 0, []
            for n in cuts(len(ids) // 4, capacity, waste):
                own = ids[4 * start : 4 * (start + n)]
                row.append({"start": start, "length": n, "ids": own if keep_ids else zlib.crc32(own).to_bytes(4, "big")})
                start += n
            out.append(row)
        return pd.Series(out, dtype=object)

    return cut(text)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, waste: float = 0.02, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32 (or ids), doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone. Repeated rows are packed as often as they occur; an empty table gives no
    rows; other columns are ignored. Only piece lengths are shuffled, by a class and a sub-bucket of it, so neither a hot
    class nor a hot document meets in one task; ranks inside a class come from per-bucket counts. A sequence's pieces meet
    to get their offsets: at most `capacity` rows, whatever the corpus.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    cut = docs.select(F.col(id_col).alias("doc_id"), pieces(F.col(text_col), tokenizer_path, capacity, end_id, waste, keep_ids).alias("p"))
    each = cut.select("doc_id", F.aggregate("p", F.lit(0).cast("long"), lambda s, x: s + x["length"]).alias("doc_tokens"), F.inline("p"))
    crc = F.col("ids") if keep_ids else F.conv(F.hex("ids"), 16, 10).cast("long")
    each = materialize(each.select("doc_id", "start", "length", crc.alias("ids" if keep_ids else "ids_crc32"), "doc_tokens", (F.lit(capacity) / F.col("length")).cast("long").alias("k"), F.pmod(F.xxhash64("doc_id", "start", "ids"), F.lit(4096)).alias("bucket")))
    columns = [c for c in each.columns if c not in ("k", "bucket")]

    # A piece's rank in its class: its rank in its bucket after the counts of the class's earlier buckets.
    sizes = each.groupBy("k", "bucket").agg(F.count("*").alias("n"))
    before = sizes.select("k", "bucket", (F.sum("n").over(Window.partitionBy("k").orderBy("bucket")) - F.col("n")).alias("before"))
    order = Window.partitionBy("k", "bucket").orderBy("length", "doc_id", "start", columns[3])
    ranked = each.join(before, ["k", "bucket"]).withColumn("rank", F.row_number().over(order) - 1 + F.col("before"))

    # Classes number at most `capacity`, whatever the corpus: the one table that the driver reads and sends back.
    first, total = {}, 0
    classes = sorted((r["k"], r["n"]) for r in sizes.groupBy("k").agg(F.sum("n").alias("n")).collect())
    for k, n in classes:
        first[k], total = total, total + n // k
    # Tokens of the pieces that a class has too few of for another whole sequence.
    sums = spark.createDataFrame([(k, n // k * k) for k, n in classes], "k long, cut long")
    ranked = ranked.join(F.broadcast(sums), "k")
    left = ranked.where("rank >= cut").groupBy("k").agg(F.sum("length").alias("tokens"))
    homes, room = {}, []
    for k, tokens in sorted(((r["k"], r["tokens"]) for r in left.collect()), key=lambda x: (-x[1], x[0])):
        at = next((i for i, free in enumerate(room) if free >= tokens), None)
        if at is None:
            at = len(room)
            room.append(capacity)
        homes[k] = (total + at, capacity - room[at])
        room[at] -= tokens
    place = spark.createDataFrame([(k, first[k], *homes.get(k, (None, 0))) for k, _ in classes], "k long, first long, home long, base long")
    ranked = ranked.join(F.broadcast(place), "k")
    rest = F.col("rank") >= F.col("cut")
    ranked = ranked.withColumn("sequence_id", F.when(rest, F.col("home")).otherwise(F.col("first") + (F.col("rank") / F.col("k")).cast("long")))
    # At most `capacity` rows each.
    inside = Window.partitionBy("sequence_id", "k").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = ranked.withColumn("offset", F.sum("length").over(inside) - F.col("length") + F.when(rest, F.col("base")).otherwise(F.lit(0)))
    return ranked.select(*columns, "sequence_id", "offset")
