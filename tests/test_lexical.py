import sqlite3

import pyarrow as pa
import pytest

from semloom.operators import lexical

TEXTS = [
    "Severe storm warning for the north coast", "storm storm storm and calm", "The north wind: a cold, cold wind!", "Café in the old town", "cafe closed; kernel panic",
    "kernel module load order", "", "calm before the storm in the north", "foo_bar d'accord k=v 42 x", "Họp nhóm ệ 会议室 today", "north north", "old kernel of the old coast",
]
QUERIES = [
    "storm", "the north", "storm OR kernel", "storm NOT calm", '"the north"', '"cold wind"', "stor*", "^storm", "NEAR(the coast, 3)", "(storm OR wind) AND north", "content:storm", "cafe",
    "old+kernel", '"storm storm"', "kernel NOT (old OR panic)", "会议室", "ệ", "hop", "what?", "a, b", "(x", "AND", "", "twice-daily", "bar", "storm calm OR kernel", "north AND NOT", "other:storm", "NOT storm", '"', "no*",
]


@pytest.fixture(scope="module")
def fts():
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(content)")
    db.executemany("INSERT INTO t (rowid, content) VALUES (?, ?)", enumerate(TEXTS, 1))
    return db


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS, 1)), "id bigint, text string")
    found = lexical.build_index(docs)
    return lexical.Index(found.postings.cache(), found.totals.cache())


@pytest.mark.parametrize("query", QUERIES)
def test_as_sqlite(fts, index, query):
    try:
        expected = fts.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ? ORDER BY bm25(t), rowid LIMIT 20", (query,)).fetchall()
    except sqlite3.Error:
        expected = []
    got = [(r["id"], r["score"]) for r in lexical.search(index, query).orderBy("rank").collect()]
    assert [i for i, _ in got] == [i for i, _ in expected]
    assert [s for _, s in got] == pytest.approx([s for _, s in expected], abs=1e-9)


def test_sanitized(index):
    assert lexical.search(index, "storm?!").count() == 0
    assert lexical.search(index, "storm?!", sanitize=True).count() == 3


def test_one_scan_whatever_the_query(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(TEXTS, 1)), "id bigint, text string")
    built = lexical.build_index(docs)
    built.postings.write.parquet(str(tmp_path / "p"))
    stored = lexical.Index(spark.read.parquet(str(tmp_path / "p")), built.totals)
    plan = lexical.scored(stored, lexical.parse('(storm OR "north wind") NOT NEAR(old coast, 3)'))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2  # for the rows and for their numbers: one exchange, used twice
    got = lexical.search(stored, "storm OR kernel").count()
    assert got == lexical.search(built, "storm OR kernel").count()


def test_search_for_any_of_many_terms(spark, index, monkeypatch):
    asked = spark.createDataFrame([(1, "the storm storm"), (2, "zzz"), (3, "kernel of the old")], "item int, text string")
    key = lambda df: sorted((r["item"], r["id"], round(r["score"], 9), r["rank"]) for r in df.collect())
    sent = key(lexical.search_any(index, asked, 5))
    monkeypatch.setattr(lexical, "ASKED", 1)
    assert sent and sent == key(lexical.search_any(index, asked, 5))
    single = {r["id"]: r["score"] for r in lexical.search(index, "kernel OR of OR the OR old").collect()}
    assert {i: s for item, i, s, _ in sent if item == 3} == pytest.approx({i: single[i] for item, i, _, _ in sent if item == 3}, abs=1e-8)


def test_a_large_batch_is_put_in_order_in_steps(spark):
    lists = [[f"t{j % 700}" for j in range(3000)]] * 400 + [None, []]
    batch = pa.record_batch([pa.array(range(len(lists)), pa.int64()), pa.array(lists, pa.list_(pa.string()))], names=["id", "terms"])
    got = list(lexical._postings(iter([batch])))
    assert max(sum(b["tf"].to_pylist()) for b in got) <= lexical.STEP  # all 1,200,000 at once would be some 100 MB
    rows = [r for b in got for r in b.to_pylist()]
    assert len(rows) == 400 * 700 and sorted({r["id"] for r in rows}) == list(range(400))
    assert all(r["length"] == 3000 and r["positions"] == list(range(int(r["term"][1:]), 3000, 700)) and r["tf"] == len(r["positions"]) for r in rows[::97])
    lexical.build_index(spark.createDataFrame([(1, "a")], "id bigint, text string"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 16 << 20
