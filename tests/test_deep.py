"""Scans, libraries, gates, file lists and resumable indexing; and the engine without its corpus operators."""

import os
import random
import re
import shutil
import subprocess
import sys

import pytest

from skein.functions import text as t
from skein.operators import index, lexical, memory, patterns
from skein.operators.patterns import Library, PatternSet
from skein.sources import manifests
from skein.sources.scanner import tracked_files

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_scan_places_every_match_in_bytes(spark):
    rng = random.Random(4)
    texts = ["", "é token = 😀 licensed", "LICENSED" * 3] + ["".join(rng.choice(["é", "licensed ", "x", "\n", "token = ", "😀"]) for _ in range(40)) for _ in range(50)]
    sets = PatternSet("s", (r"(?i)licen[cs]ed", r"token = "))
    docs = spark.createDataFrame(list(enumerate(texts)), "key long, content string")
    got = sorted(tuple(r) for r in patterns.scan(docs, sets).collect())
    want = [(k, n, m.start(), m.end()) for k, x in enumerate(texts) for n, p in enumerate(sets.patterns, 1) for m in re.finditer(p.encode(), x.encode())]
    assert got == sorted(want)
    assert patterns.scan(docs.limit(0), sets).count() == 0
    with pytest.raises(Exception, match="more than 2 matches"):
        patterns.scan(docs, sets, limit=2).collect()


def test_library_refuses_what_does_not_compile(spark):
    library = Library()
    for definition in ({"id": "a", "patterns": []}, {"id": "a", "patterns": ["("]}):
        with pytest.raises((ValueError, re.error)):
            library.load(definition)
    library.load({"id": "a", "patterns": ["x"]})
    assert library.get("a").patterns == ("x",) and library.get("b") is None and library.list_all(spark).count() == 1


def test_narration_and_snippets(spark):
    from pyspark.sql import functions as F

    rows = [("Found it! The cache is keyed by the hash of the path, not by the path.", False), ("Let me look at the configuration of the cache first.", True), ("ok, so", True), ("Now I'll check the tests of the second module as well.", True), ("The lock is held while the file is written, which is the cause.", False)]
    df = spark.createDataFrame(rows, "s string, want boolean")
    assert all(r.got == r.want for r in df.select("want", t.is_narration(F.col("s")).alias("got")).collect())
    text = "One sentence here. Two is the match. Three follows it. Four is far."
    got = spark.createDataFrame([(text, text.index("match")), (text, 1000), ("", 0), ("w " * 400, 5)], "s string, at int").select(t.sentence_snippet(F.col("s"), F.col("at")).alias("x")).collect()
    assert got[0].x == "One sentence here. Two is the match. Three follows it." and got[1].x == "One sentence here. Two is the match."
    assert got[2].x == "" and got[3].x.endswith("...") and len(got[3].x) <= 303
    votes = spark.createDataFrame([(["Read", "Grep", "Bash"],), (["x"],), ([],)], "tools array<string>").select(t.task_of_tools(F.col("tools")).alias("x")).collect()
    assert [r.x for r in votes] == ["task:review", None, None]


def test_fielded_search_prefers_the_name(spark):
    docs = spark.createDataFrame([(1, "userCache", "user cache src", "holds users", "symbol"), (2, "other", "other cache user", "user cache userCache", "file"), (3, "x", "x", "nothing", "file")], "key long, name string, combined string, content string, doc_type string")
    out = {r.key: r.score for r in lexical.fielded(docs, "userCache").collect()}
    assert out[1] > out[2] and 3 not in out
    assert [r.key for r in lexical.fielded(docs, "userCache", doc_type="file").collect()] == [2]
    assert [r.key for r in lexical.exact(docs, "USERCACHE").collect()] == [1] and lexical.bm25(docs, []).count() == 0


def test_conventions_are_cut_before_they_are_compared(spark):
    rows = [(f"c{i}", f"n{i:02d}", "required" if i < 4 else "optional", "a", [1.0, float(i)]) for i in range(12)]
    c = spark.createDataFrame(rows, "id string, name string, priority string, category string, vector array<double>")
    assert [r.id for r in memory.search_conventions(c, [0.0, 1.0], 1, candidates=4).collect()] == ["c3"]
    assert [r.id for r in memory.search_conventions(c, [0.0, 1.0], 1, candidates=40).collect()] == ["c11"]


def test_tracked_files(tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True)
    assert tracked_files(str(tmp_path)) is None
    git("init", "-q")
    for name in ("a.py", "b.ts", "c.log", "node_modules/d.py", "src/e.py"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    (tmp_path / ".gitignore").write_text("*.log\n")
    git("add", "a.py")
    names = lambda paths: [os.path.relpath(p, tmp_path) for p in paths]
    assert names(tracked_files(str(tmp_path))) == [".gitignore", "a.py", "b.ts", "src/e.py"]
    assert names(tracked_files(str(tmp_path), (".py",))) == ["a.py", "src/e.py"]


def test_full_index_goes_on_where_it_ended(spark, tmp_path):
    root, out, checkpoint = (str(tmp_path / x) for x in ("root", "out", "checkpoint"))
    os.makedirs(root + "/sub")
    for i in range(5):
        with open(f"{root}/sub/{i}.py", "w") as f:
            f.write(f"x = {i}")
    index.full_index(spark, root, out, checkpoint, "*.py", files_per_batch=2)
    assert spark.read.parquet(out).count() == 5
    with open(root + "/new.py", "w") as f:
        f.write("é")
    index.full_index(spark, root, out, checkpoint, "*.py", files_per_batch=2)
    rows = spark.read.parquet(out).collect()
    assert len(rows) == 6 and {r.content for r in rows} == {f"x = {i}" for i in range(5)} | {"é"}


def test_stores_tell_damage(spark):
    store = index.stored(spark.createDataFrame([(1, "a"), (2, "é"), (3, "")], "key long, content string"))
    assert index.damaged(store).count() == 0
    from pyspark.sql import functions as F

    assert [r.key for r in index.damaged(store.withColumn("content", F.when(F.col("key") == 2, "e").otherwise(F.col("content")))).collect()] == [2]


def test_lock_files_of_many_kinds():
    assert manifests.parse("yarn.lock", 'zod@^3:\n  version "3.2.1"\n') == [("zod", "3.2.1", "lock")]
    assert manifests.parse("bun.lock", '{"packages": {"a": ["a@1.0.0", ""], "@s/b": ["@s/b@2.0", ""],}}') == [("a", "1.0.0", "lock"), ("@s/b", "2.0", "lock")]
    assert manifests.parse("x/go.sum", "m v1 h1:a\nm v1/go.mod h1:b\n") == [("m", "v1", "lock")]
    assert manifests.parse("Pipfile.lock", "broken") == []


def test_linter_families():
    rules = index._rules
    assert rules("biome.json", '{"linter": {"rules": {"recommended": true, "style": {"useConst": "warn", "noVar": {"level": "off"}}}}}') == [("style/useConst", "warn"), ("style/noVar", "off")]
    assert rules("ruff.toml", 'line-length = 100\n[lint]\nselect = ["E", "F"]\nignore = ["F"]\n') == [("ruff/E", "error"), ("ruff/line-length", "100")]
    assert rules(".prettierrc", '{"semi": false, "overrides": []}') == [("prettier/semi", "false")]
    assert rules("pyproject.toml", "broken") == [] and rules(".eslintrc.json", "[]") == []


def test_routes_and_entities_of_several_frameworks(spark):
    from skein.operators import code

    files = [
        ("a.py", "@app.route('/a', methods=['POST'])\ndef a(): pass\n@bp.route('/b')\ndef b(): pass\n@router.put(\n    '/c'\n)\napi.add_url_rule('/d', 'd', d, methods=('DELETE',))\n"),
        ("src/app/api/users/route.ts", "export const GET = handler\nexport async function POST(r) {}\n"),
        ("m.py", "class User(db.Model):\n    id = db.Column(db.Integer, primary_key=True)\n    name = Column(String(9))\n\nclass P(BaseModel):\n    x: int\n"),
        ("s.ts", 'export const users = pgTable("users", {\n  id: serial("id").primaryKey(),\n  isActive: boolean("a"),\n})\n'),
    ]
    df = spark.createDataFrame(files, "path string, content string")
    assert sorted((r.method, r.route) for r in code.endpoints(df).collect()) == [("DELETE", "/d"), ("GET", "/api/users"), ("GET", "/b"), ("POST", "/a"), ("POST", "/api/users"), ("PUT", "/c")]
    assert {r.entity: r.fields for r in code.entities(df).collect()} == {"User": "id:integer,name:string", "P": "x:int", "Users": "id:serial,isActive:boolean"}


def test_taxonomies_grow_merge_and_settle(spark):
    from skein.operators import taxonomy

    rows = [(i, "parseTree", [1.0, 0.0, 0.0]) for i in range(4)] + [(10 + i, "drawMap", [0.0, 0.0, 1.0]) for i in range(4)] + [(20, "oddOne", [0.0, 0.0, 0.9])]
    items = spark.createDataFrame(rows, "key long, name string, vector array<double>")
    start = spark.createDataFrame([("parser", [1.0, 0.0, 0.0]), ("parsing", [0.99, 0.01, 0.0])], "category string, centre array<double>")
    out, seen = taxonomy.refine(items, start)
    names = {r.category for r in out.collect()}
    assert "parser" in names and "parsing" not in names and names & {"draw", "map"} and not {"odd", "tree"} & names
    assert seen[0]["coverage"] < 0.5 and seen[-1]["coverage"] == 1.0 and len(seen) < 5


def test_the_rest_works_without_the_corpus_operators(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "*.parquet"))
    code = "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); assert 'txt4_bm25' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q), sorted(q); assert 'txt4_bm25' in s and callable(e.entry); print(len(q))"
    for folder in (copy,):
        done = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True)
        assert done.returncode == 0, done.stderr
    (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    assert subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True).returncode == 0
