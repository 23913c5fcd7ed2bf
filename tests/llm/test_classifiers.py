"""Classifiers on held-out documents, and the pipeline against its stages' rules."""

import os
import random
import zlib

import numpy as np
import pytest

DATA = os.environ.get("SKEIN_TESTDATA_LARGE", "/root/testdata/sf0.1")
SMALL = os.environ.get("SKEIN_TESTDATA", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def auc(scores, ys):
    order = np.argsort(np.argsort(scores))
    ones = np.array(ys) == 1
    return (order[ones].mean() - (ones.sum() - 1) / 2) / (~ones).sum()


def evaluate(spark, score, label):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    ids = labels.select("doc_id")
    rows = score(docs.join(ids, "doc_id", "left_semi").select("doc_id", "text"), labels).join(labels.select("doc_id", label), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    return [r.score for r in held], [r[label] for r in held], [r.predicted for r in held]


@needs_data
def test_quality_on_held_out_documents(spark):
    from skein.llm.quality import score_quality

    scores, ys, predicted = evaluate(spark, score_quality, "quality")
    assert auc(scores, ys) > 0.99 and np.mean(np.array(predicted) == ys) > 0.98
    assert all((s >= 0.3) == (p == 1) for s, p in zip(scores, predicted, strict=True))


@needs_data
def test_toxicity_on_held_out_documents(spark):
    from skein.llm.toxicity import score_toxicity

    scores, ys, predicted = evaluate(spark, score_toxicity, "toxic")
    predicted, ys = np.array(predicted), np.array(ys)
    # Some labelled documents have no telling word: 12 of 97 stay below the threshold.
    assert auc(scores, ys) > 0.94 and ys[predicted == 1].mean() > 0.95 and predicted[ys == 1].mean() > 0.85


def test_classifiers_take_any_text(spark):
    from skein.llm.quality import score_quality
    from skein.llm.toxicity import score_toxicity

    rng = random.Random(1)
    good = [" ".join(rng.choice(["plain", "words", "of", "prose", "here"]) for _ in range(80)) for _ in range(60)]
    bad = [" ".join("!!!" + rng.choice(["idiot", "moron"]) for _ in range(80)) for _ in range(60)]
    texts = [*good, *bad, None, "", " \n ", "x" * 200_000, "😀" * 50, "\x00", "word " * 20_000]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(0, good[0], "clash"), (None, "no id", "clash")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i < 60), int(i >= 60)) for i in range(120)] + [(5, 1, 0), (6, None, None)], "doc_id long, quality int, toxic int")
    for score, label in ((score_quality, 1), (score_toxicity, 0)):
        rows = score(docs, labels).collect()
        assert len(rows) == len(texts) + 2 and all(0 <= r.score <= 1 for r in rows)
        assert np.mean([r.predicted == label for r in rows if r.doc_id is not None and r.doc_id < 60]) > 0.95
        assert np.mean([r.predicted == 1 - label for r in rows if r.doc_id is not None and 60 <= r.doc_id < 120]) > 0.95
        assert score(docs.limit(0), labels).count() == 0
        assert {r.score for r in score(docs, labels.limit(0)).collect()} == {0.5}
        again = {(r.doc_id, r.score) for r in score(docs, labels).collect()}
        assert again == {(r.doc_id, r.score) for r in rows}


def test_unseen_misspellings_share_subwords():
    from skein.llm.toxicity import Sample, fit

    rng = random.Random(2)
    words = ["harbour", "morning", "window", "garden", "letter", "stone", "river", "table", "cloud", "paper"]
    clean = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(150)]
    toxic = [t + " you worthless thing " + " ".join(rng.choice(words) for _ in range(20)) for t in clean[:70]]
    sample = Sample()
    sample.add(clean + toxic, [0] * len(clean) + [1] * len(toxic))
    scorer = fit(sample).open()
    misspelt, clean = scorer.scores(["garden stone worthlesss river table cloud", "garden stone letter river table cloud"])
    assert misspelt > 0.5 > clean


def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline
    from skein.llm.common import materialize

    if not os.path.isdir(SMALL):
        pytest.skip("no test tables")
    extra = [(10_001, None, "en", "src1", 0), (10_002, "", "en", None, 0), (10_003, 'Kept text. token = "abcdef0123456789abcdef01" end', "en", "src2", 49), (10_003, 'Kept text. token = "abcdef0123456789abcdef01" end', "en", "src2", 49), (None, "no id here at all", "en", "src2", 17)]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    sizes = {}
    for name, stage in pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, SMALL))
        sizes[name] = (before.count(), docs.count())
        if name != "packing":
            assert docs.columns == pipeline.COLUMNS
        if name == "near_duplicates":
            ids = [r.doc_id for r in docs.select("doc_id").where("doc_id is not null").collect()]
            assert len(ids) == len(set(ids)) and {10_001, 10_002, 10_003} <= set(ids)
        if name == "secrets":
            assert sizes[name][0] == sizes[name][1] and docs.where("doc_id = 10003").first().text == 'Kept text. [SECRET]" end'
        if name == "mixing":
            wordless = lambda df: sorted((r.doc_id, str(r.text)) for r in df.where("text is null or text = ''").collect())
            assert wordless(docs) == wordless(before) and {10_001, 10_002} <= {i for i, _ in wordless(docs)}
            words = lambda df: sum(len((r.text or "").split()) for r in df.select("text").collect())
            assert abs(words(docs) - words(before)) <= 0.02 * words(before)
    assert sizes["toxicity"][1] < sizes["toxicity"][0] and sizes["near_duplicates"][1] < sizes["near_duplicates"][0]
    full = docs.groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in full) <= 2048
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "packing"]
    # run() leaves no tables of its stages but those that its result reads.
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    before = set(os.listdir(folder))
    whole = pipeline.run(spark, SMALL)
    assert whole.count() > 0 and len(set(os.listdir(folder)) - before) <= 3
    empty = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES[:-1]:
        empty = materialize(stage(spark, empty, SMALL))
    assert pipeline.STAGES[-1][1](spark, empty, SMALL).count() == 0
