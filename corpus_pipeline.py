"""A training corpus in five stages: toxicity, near duplicates, secrets, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of documents. run() writes each stage's result to the shared folder and reads it as the next one's documents.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import WORD, forget, materialize, scratch, table, text_key
from skein.llm.mixing import mix
from skein.llm.near_text import near_duplicates
from skein.llm.packing import pack
from skein.llm.queries import tokenizer_file
from skein.llm.secrets import find_secrets, redact
from skein.llm.toxicity import score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled ones among docs, does not reject.

    Null and empty texts are scored like any other.
    """
    return score_toxicity(docs, table(spark, sf_dir, "labels")).where("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of least id; texts without words all stay.

    Rows that repeat a kept id and its text stay once; a class without ids keeps one row. A different text under a
    repeated id is a document of its own.
    """
    has_words = F.coalesce(F.col("text"), F.lit("")).rlike(WORD)
    kept = near_duplicates(docs, with_key=True).where("kept").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()
    keyed = docs.where(has_words).withColumn("_key_of_text", text_key(F.col("text")))
    full = keyed.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key_of_text") == F.col("_key")), "left_semi").dropDuplicates(["doc_id", "_key_of_text"])
    return full.select(*COLUMNS).unionByName(docs.where(~has_words).select(*COLUMNS))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secret spans of their texts put as a mark, and n_chars of what is left."""
    chars = F.when(F.size("secret_spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return redact(find_secrets(docs)).withColumn("n_chars", chars).select(*COLUMNS)


@F.pandas_udf(T.StringType())
def first_words(texts: pd.Series, counts: pd.Series) -> pd.Series:
    """The texts up to the end of their first so many words."""
    import re

    from skein.llm.common import WORD

    word = re.compile(WORD)

    def cut(text: str, n: int) -> str:
        end = 0
        for k, m in enumerate(word.finditer(text)):
            if k == n:
                break
            end = m.end()
        return text[:end]

    return pd.Series([cut(t, n) for t, n in zip(texts, counts, strict=True)], dtype=object)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: whole, and at last up to the word where their source's target is met.

    A document that the mix does not reach does not appear; one without words stays as it is.
    """
    has_words = F.coalesce(F.col("text"), F.lit("")).rlike(WORD)
    # A row's name; rows of one name are equal but for lang and n_chars, and are taken together.
    name = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.hex(text_key(F.col("text"))), F.coalesce(F.concat(F.lit("="), "source"), F.lit("-"))))
    named = docs.where(has_words).withColumn("_row", F.unhex(name))
    taken = mix(named, keep=("_row",)).groupBy("_row").agg(F.sum("taken").alias("_taken"), F.first("size").alias("_size")).where("_taken > 0")
    # Texts meet their numbers once; the join has sorted them by name.
    met = named.join(taken, "_row").withColumn("_n", F.row_number().over(Window.partitionBy("_row").orderBy("_row"))).where("_n = 1")
    whole = F.floor(F.col("_taken") / F.col("_size")).cast("int")
    part = F.col("_taken") - whole * F.col("_size")
    times = F.concat(F.array_repeat(F.col("_size"), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))
    rows = met.withColumn("_words", F.explode(times))
    short = F.col("_words") < F.col("_size")
    full = rows.where(~short).select(*COLUMNS)
    cut = rows.where(short).withColumn("text", first_words("text", "_words")).withColumn("n_chars", F.length("text").cast("long"))
    return full.unionByName(cut.select(*COLUMNS)).unionByName(docs.where(~has_words).select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens, as pack() returns them."""
    return pack(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL has no trained classifier and no tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before = docs
        # What a stage wrote for itself, and its input, go when its result is written.
        with scratch(spark):
            docs = materialize(stage(spark, before, sf_dir), keep=True)
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
