"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")
from skein.plans.registry import ORACLE_SQL, QUERIES  # noqa: E402

DATA = os.environ.get("SKEIN_TESTDATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    return (None if math.isnan(v) else round(v, 6)) if isinstance(v, float) else v


def sort(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sort(df.select(*columns).collect())
    if name in ORACLE_SQL:
        result = duck.execute(ORACLE_SQL[name])
        names = [c[0] for c in result.description]
        assert sorted(names) == columns
        assert got == sort([[r[names.index(c)] for c in columns] for r in result.fetchall()])
    else:
        assert len(got) > 0


def test_memory_tiers_label_every_vector(spark):
    plan = QUERIES["flt6_memory_tiers"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit" not in plan


def test_memories_equal_their_sql_on_texts_that_open_like_narration(spark, duck, tmp_path):
    """Prose may open with "On it" by chance; line ends are line feeds, and the end of a text is its last character."""
    texts = ["On it went the day, and then?\n" + "more of it, and of that " * 4, "Let me see, or not, or so, is it? " * 3, "a, b, c, d " * 9 + "\n", "one, two\r, three, four " * 4, "x? y\u2028z " * 9, "plain " * 20, "plain, " * 20, "short?"]
    rows = [(c, t, "assistant", x) for c in (1, 2) for t, x in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["pat10_memory_extract"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(f"select {', '.join(got.columns)} from ({ORACLE_SQL['pat10_memory_extract']})").fetchall()
    assert sort(got.collect()) == sort(want)
    assert any(r.skip_reason is None for r in got.where("ord = 0").collect())
