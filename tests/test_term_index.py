"""The stored keyword index against scores over the texts themselves."""

import random

import pytest
from pyspark.sql import functions as F

from skein.operators import lexical
from skein.operators.term_index import TermIndex

WORDS = "alpha beta gamma delta getUserName HTTPServer snake_case epsilon".split()


def texts(rng, keys):
    return [(k, " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 30)))) for k in keys]


def scores(df):
    return {r.key: round(r.score, 9) for r in df.collect()}


def same(spark, index, live, query):
    docs = spark.createDataFrame(list(live.items()), "key long, content string")
    assert scores(index.search(query)) == scores(lexical.bm25(docs, query))
    want, got = lexical.index_stats(lexical.postings(docs)).first(), index.stats().first()
    assert tuple(got) == tuple(want)


def test_commits_deletes_and_merges_keep_the_scores_of_the_live_texts(spark, tmp_path):
    rng, query = random.Random(4), ["alpha", "user", "server", "nowhere"]
    index = TermIndex(spark, str(tmp_path / "i"), buckets=8)
    frame = lambda rows: spark.createDataFrame(rows, "key long, content string")
    assert index.search(query).count() == 0 and index.state() is None
    live = dict(texts(rng, range(60)))
    live[59] = ""
    index.commit(frame(list(live.items())), 1)
    same(spark, index, live, query)
    # Replacements, new texts and deletes; a commit that comes twice changes nothing.
    for _ in range(2):
        change = texts(random.Random(5), range(50, 80)) + [(3, None)]
        index.commit(frame(change), 2, deleted=spark.createDataFrame([(0,), (1,), (999,)], "key long"))
    live |= {k: t or "" for k, t in change}
    live = {k: t for k, t in live.items() if k not in (0, 1)}
    same(spark, index, live, query)
    # A deleted key may come back.
    index.commit(frame([(0, "alpha alpha server")]), 3)
    live[0] = "alpha alpha server"
    same(spark, index, live, query)
    index.merge(4)
    same(spark, index, live, query)
    index.vacuum()
    index.commit(frame([(5, "user")]), 6)
    live[5] = "user"
    same(spark, index, live, query)
    assert index.state()["base"] == 4
    with pytest.raises(ValueError, match="comes after"):
        index.commit(frame([(5, "user")]), 5)


def test_an_unfinished_commit_is_not_seen_and_is_written_over(spark, tmp_path):
    index = TermIndex(spark, str(tmp_path / "i"), buckets=4)
    frame = lambda rows: spark.createDataFrame(rows, "key long, content string")
    index.commit(frame([(1, "alpha"), (2, "beta")]), 1)
    spark.createDataFrame([("alpha", 9, 1, 1, 0)], "term string, key long, dl long, tf long, bucket int").write.partitionBy("bucket").parquet(str(tmp_path / "i/postings/2"))
    assert set(scores(index.search(["alpha"]))) == {1}
    index.commit(frame([(3, "alpha")]), 2)
    assert set(scores(index.search(["alpha"]))) == {1, 3}


def test_a_query_reads_only_the_buckets_of_its_terms(spark, tmp_path):
    index = TermIndex(spark, str(tmp_path / "i"), buckets=16)
    index.commit(spark.createDataFrame([(i, f"word{chr(97 + i % 26)} other{chr(97 + i % 7)}") for i in range(200)], "key long, content string"), 1)
    hits = index.postings(["worda"])
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "PushedFilters" in plan and "EqualTo(term,worda)" in plan or "In(term" in plan
    everything = index.postings()
    assert len(hits.inputFiles()) <= len(everything.inputFiles())
    read = {r.b for r in hits.select(F.input_file_name().alias("f")).select(F.regexp_extract("f", "bucket=([0-9]+)", 1).alias("b")).collect()}
    assert len(read) <= 1


def test_stats_move_no_posting(spark, tmp_path):
    index = TermIndex(spark, str(tmp_path / "i"), buckets=4)
    index.commit(spark.createDataFrame([(1, "alpha beta alpha"), (2, "beta"), (3, "")], "key long, content string"), 1)
    stats = index.stats()
    assert "Expand" not in stats._jdf.queryExecution().optimizedPlan().toString()
    assert tuple(stats.first()) == (2, 2, 3)
