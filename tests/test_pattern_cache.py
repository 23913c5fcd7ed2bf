"""The pattern cache: only files that changed are scanned again."""

from pyspark.sql import functions as F

from skein.functions.vectors import hashing_embedder
from skein.operators.pattern_cache import PatternCache
from skein.operators.patterns import PatternSet

SETS = [PatternSet("red", (r"red",)), PatternSet("blue", (r"blue", r"navy")), PatternSet("none", (r"never",))]


def test_only_changed_files_are_scanned_again(spark, tmp_path):
    cache = PatternCache(spark, str(tmp_path / "c"), SETS, buckets=4)
    frame = lambda d: spark.createDataFrame(list(d.items()), "path string, content string")
    now = lambda: sorted(tuple(r) for r in cache.matches().collect())
    files = {f"f{i}": "red red blue" if i % 2 else "navy" for i in range(10)} | {"empty": "", "null": None}
    cache.refresh(frame(files), 100, 1)
    assert now() == sorted([("red", p, 2) for p, t in files.items() if t and "red" in t] + [("blue", p, 1) for p in files if p[1:].isdigit()])
    assert cache.stale(frame(files), 200).count() == 0
    changed = files | {"f1": "nothing", "f2": "red", "new": "red"}
    del changed["f3"]
    assert sorted(r.path for r in cache.stale(frame(changed), 200).collect()) == ["f1", "f2", "new"]
    for _ in range(2):
        cache.refresh(frame(changed), 200, 2)
    assert not [r for r in now() if r[1] in ("f1", "f3")] and ("red", "f2", 1) in now() and ("red", "new", 1) in now()
    at = {r.path: r.at for r in cache.store.read().collect()}
    assert {p for p, t in at.items() if t == 200} == {"f1", "f2", "new"} and "f3" not in at
    # What was scanned before the time to live is scanned again.
    assert {r.path for r in cache.stale(frame(changed), 250, keep=100).collect()} == set(changed) - {"f1", "f2", "new"}
    first = {r.type_id: (r.files, r.paths) for r in cache.first(2).collect()}
    assert first["red"] == (5, ["f2", "f5"]) and set(first) == {"red", "blue"}
    embed = hashing_embedder(16)
    best = cache.search(F.array(*[F.lit(float(x)) for x in spark.range(1).select(embed(F.lit("blue navy")).alias("v")).first().v]), embed, 1)
    assert [r.type_id for r in best.collect()] == ["blue"]
