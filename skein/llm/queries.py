"""The corpus operators as queries over the tables of a data directory, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import exact_topk, mixing, near_text, near_vectors, personal, phrases, repeated_spans, secrets, spelling
from skein.llm.common import table


def tokenizer_file(name: str) -> str:
    """A vocabulary file; its folder is the one parameter that a cluster may have to change."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.quality import score_quality

    return score_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")).drop("text")


def op8_toxicity_subwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")).drop("text")


def op2_bagminhash_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_text.near_duplicates(table(spark, sf_dir, "documents"))


def op3_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans.remove_repeated(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_golden_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.bpe_count import count_tokens

    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file("piece_bpe_32k.model")).drop("text")


def op6_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(table(spark, sf_dir, "documents"))


def op7_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_epsilon_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op11_pigeonhole_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(spelling.word_counts(table(spark, sf_dir, "documents"), slips_every=199))


def op12_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.personal_digest(table(spark, sf_dir, "documents"))


def op13_sketched_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_attention": op1_quality_attention,
    "op2_bagminhash_near": op2_bagminhash_near,
    "op3_sentence_spans": op3_sentence_spans,
    "op4_golden_mixing": op4_golden_mixing,
    "op5_token_counts": op5_token_counts,
    "op6_linked_secrets": op6_linked_secrets,
    "op7_norm_buckets": op7_norm_buckets,
    "op8_toxicity_subwords": op8_toxicity_subwords,
    "op9_epsilon_grid": op9_epsilon_grid,
    "op10_harmonic_packing": op10_harmonic_packing,
    "op11_pigeonhole_spelling": op11_pigeonhole_spelling,
    "op12_bootstrapped_pii": op12_bootstrapped_pii,
    "op13_sketched_phrases": op13_sketched_phrases,
}

#: DuckDB SQL for those that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op2_bagminhash_near": near_text.ORACLE,
    "op3_sentence_spans": repeated_spans.ORACLE,
    "op4_golden_mixing": mixing.ORACLE,
    "op6_linked_secrets": secrets.oracle(),
    "op7_norm_buckets": exact_topk.ORACLE,
    "op9_epsilon_grid": near_vectors.ORACLE,
    "op11_pigeonhole_spelling": spelling.ORACLE,
    "op12_bootstrapped_pii": personal.oracle(),
    "op13_sketched_phrases": phrases.ORACLE,
}
