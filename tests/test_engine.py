import json
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from semloom.operators import encoding, lexical, ranking
from semloom.plans import facts, legacy, lifecycle, snapshots
from semloom.plans.engine import Config, Engine
from semloom.plans.snapshots import Snapshots
from semloom.sources import corpus, sqlite
from semloom.streaming import updates


def session_db(path, rows):
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE IF NOT EXISTS messages (id INTEGER PRIMARY KEY AUTOINCREMENT, compacted INT DEFAULT 0, active INT DEFAULT 1, content TEXT, role TEXT, tool_calls TEXT, session_id TEXT)")
    db.executemany("INSERT INTO messages (session_id, role, content, active, compacted) VALUES ('s', ?, ?, ?, ?)", rows)
    db.commit()
    db.close()
    return str(path)


ROWS = [
    ("user", "the first thing that is kept", 1, 0), ("assistant", "an answer that is kept too", 1, 0), ("tool", "a tool row goes away", 1, 0), ("user", None, 1, 0), ("user", "", 1, 0),
    ("user", "[system: not this one here", 1, 0), ("user", "[CONTEXT COMPACTION of all that", 1, 0), ("user", "undone and so left out", 0, 0), ("user", "compacted but the original words", 0, 1),
]


def test_session_source(spark, tmp_path):
    path = session_db(tmp_path / "s.db", ROWS)
    messages = corpus.read_messages(spark, path)
    assert sorted(r["id"] for r in corpus.kept_messages(messages).collect()) == [1, 2, 9]
    assert corpus.highest_id(messages) == 9
    assert [r["doc_seq"] for r in corpus.session_texts(messages, after=1, until=8).collect()] == [2]
    assert corpus.read_corpus(spark, path, "sessions").count() == 3
    with pytest.raises(ValueError):
        corpus.read_corpus(spark, path, "other")


def test_old_session_store_without_flags(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "old.db")
    db.execute("CREATE TABLE messages (id INTEGER PRIMARY KEY, role TEXT, content TEXT)")
    db.execute("INSERT INTO messages (role, content) VALUES ('user', 'three words here')")
    db.commit()
    db.close()
    assert corpus.read_corpus(spark, str(tmp_path / "old.db"), "sessions").count() == 1


def test_file_sources(spark, tmp_path):
    (tmp_path / "b.txt").write_text("Second file has words. Too short.\r\nAnother line of words")
    (tmp_path / "a.md").write_text("Marked text goes last of all")
    (tmp_path / "a+1 é.txt").write_text("Text with an odd name")
    block = lambda **k: dict(k)
    mixed = [block(type="text", text="first block words"), block(type="tool_use", name="x"), block(type="text", text="then more")]
    said = [("user", "plain words of a user"), ("tool", "a tool said some words"), ("assistant", mixed), ("user", ""), ("user", [block(type="tool_use")]), ("user", 7)]
    lines = [json.dumps(dict(role=r, content=c)) for r, c in said]
    (tmp_path / "x.jsonl").write_text("\n".join([lines[0], "", "not json", "[1, 2]", *lines[1:]]) + "\n")
    plain = corpus.read_corpus(spark, str(tmp_path)).orderBy("doc_seq", "sentence").collect()
    assert [r["words"][0] for r in plain] == ["text", "second", "another", "marked"]
    chat = corpus.read_corpus(spark, str(tmp_path), "chat-jsonl").orderBy("doc_seq", "sentence").collect()
    assert [r["words"] for r in chat] == [["plain", "words", "of", "user"], ["first", "block", "words", "then", "more"]]
    assert corpus.read_corpus(spark, str(tmp_path / "none")).count() == 0
    assert len(updates.changed_files(spark, str(tmp_path), 0)) == 4 and updates.changed_files(spark, str(tmp_path), 4e9) == {}


def test_fusion(spark):
    lists = [[1, 2, 3], [2, 8, 9]]
    rows = spark.createDataFrame([(k, r, i) for k, x in enumerate(lists) for r, i in enumerate(x)], "list int, rank int, id bigint")
    got = [(r["id"], r["score"]) for r in ranking.fuse(rows).orderBy(*ranking.fused_order()).collect()]
    assert [i for i, _ in got] == [i for i, _ in ranking.fuse_lists(lists)] == [2, 1, 8, 3, 9]
    assert dict(got) == pytest.approx(dict(ranking.fuse_lists(lists)))


def test_idf_and_zero_vectors(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha alpha gamma"), (3, "")], "id bigint, text string")
    weights = {r["word"]: r["idf"] for r in encoding.idf(docs).collect()}
    assert weights == pytest.approx({"alpha": np.log(3 / 2), "beta": np.log(3), "gamma": np.log(3)})
    vectors = spark.createDataFrame([("alpha", [1.0, 0.0]), ("gamma", [0.0, 1.0])], "word string, memory array<float>")
    got = {r["id"]: np.array(r["vector"]) for r in encoding.encode_all(docs, vectors, 2).collect()}
    want = np.array([2 * np.log(3 / 2), np.log(3)])
    joined = {r["id"]: r["vector"] for r in encoding.encode_joined(docs, vectors, encoding.idf(docs), 2).collect()}
    assert joined == {i: v.tolist() for i, v in got.items() if v.any()}
    table = encoding.encode_all(docs, vectors, 2)
    asked = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 1.0])], "item bigint, vector array<float>")
    many = {(r["item"], r["rank"]): r["id"] for r in encoding.nearest_many(table, asked, 2).collect()}
    one = {(i, r["rank"]): r["id"] for i, q in ((7, [1.0, 0.0]), (8, [0.0, 1.0])) for r in encoding.nearest(table, np.array(q), 2).collect()}
    assert many == one and encoding.nearest_many(table, asked, 3, 0.5).count() == 3
    assert np.allclose(got[2], want / np.linalg.norm(want), atol=1e-6) and np.allclose(got[1], [1, 0]) and not got[3].any()


def test_snapshots(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "s"))
    assert store.read("t") is None and store.get_meta("k", 3) == 3
    store.commit({"t": spark.range(3)}, {"k": [1, None]})

    def refuse(_):
        raise ValueError("no")

    with pytest.raises(ValueError):
        store.commit({"t": spark.range(9)}, {"k": 0}, refuse)
    assert store.read("t").count() == 3 and store.get_meta("k") == [1, None]
    for n in (4, 5):
        store.commit({"t": spark.range(n)})
    store.vacuum(1)
    assert store.read("t").count() == 5 and store.manifest()["version"] == 3


META = {"dim": 64, "window": 2, "regex": lifecycle.WORD_PATTERN, "stemmer": None, "corpus_source": "state_db", "last_seen_id": 150, "tokenizer_fingerprint": lifecycle.fingerprint(dim=64, window=2)}


@pytest.mark.parametrize(
    "change,shape,highest,state,rebuild",
    [
        ({}, (None, None, None), 500, "cold", False),
        ({}, (3, 3, 64), 150, "current", False),
        ({"tokenizer_fingerprint": "x"}, (3, 3, 64), 150, "healed", False),
        ({"tokenizer_fingerprint": "x", "regex": "[a-z]+"}, (3, 3, 64), 150, "stale", True),
        ({}, (3, 2, 64), 150, "damaged", True),
        ({}, (3, 3, 32), 150, "damaged", True),
        ({"dim": 32}, (3, 3, 32), 150, "damaged", True),
        ({"corpus_source": "archive"}, (3, 3, 64), 150, "damaged", True),
        ({"corpus_source": "archive"}, (3, 3, 64), 100, "current", False),
        ({"last_seen_id": 10}, (3, 3, 64), 150, "damaged", True),
        ({"last_seen_id": 10}, (3, 3, 64), 90, "current", False),
        ({"last_seen_id": 0}, (3, 3, 64), 150, "current", False),
        ({"last_seen_id": 5000}, (3, 3, 64), 400, "damaged", True),
    ],
)
def test_verdicts(change, shape, highest, state, rebuild):
    v = lifecycle.judge(META | change, *shape, highest, 64, 2)
    assert (v.state, v.rebuild) == (state, rebuild) and v.serve == (state not in ("cold", "damaged")) and bool(v.notice) == (state == "damaged")


def test_small_things():
    assert lifecycle.builds_by_itself(lifecycle.Verdict("cold", False, False), 101) and not lifecycle.builds_by_itself(lifecycle.Verdict("cold", False, False), 100)
    assert lifecycle.progress_bar(5, 0) == "" and "100%" in lifecycle.progress_bar(7, 5) and lifecycle.progress_bar(1, 2, "x") == "x: [█████░░░░░] 50% (1/2)"
    assert lifecycle.fingerprint() != lifecycle.fingerprint(dim=512) and len(lifecycle.fingerprint()) == 16
    assert not lifecycle.cache_is_current({}, 2, 2, 64, 64) and lifecycle.cache_is_current({"encoder_version": lifecycle.ENCODER_VERSION}, 2, 2, 64, 64)


def test_engine_from_build_to_update(spark, tmp_path):
    said = ["the dismissal letter went to the bureau", "the layoff letter went to the bureau", "rain fell on the harbour all day", "sun and rain over the harbour"] * 8
    path = session_db(tmp_path / "s.db", [("user", f"{s}.", 1, 0) for s in said])
    config = Config(str(tmp_path / "store"), path, dim=64, window=2)
    config.save(str(tmp_path / "c.json"))
    assert Config.load(str(tmp_path / "c.json")) == config
    engine = Engine(spark, config)
    assert engine.prefetch("x") == ""
    assert engine.open(background=False).state == "cold" and engine.status() == {"build": "not_built", "facts": 0}
    assert engine.update() == 0  # without a model there is nothing to go on from
    a, b = engine.add("a dismissal letter of the bureau", 0.6), engine.add("picnic by the harbour in the rain")
    c = engine.add("numbers of an invoice")
    assert [r["fact_id"] for r in engine.search("dismissal").collect()] == [a]  # by words alone
    engine.build()
    assert engine.store.get_meta("last_seen_id") == 32 and engine.status()["build"] == "complete"
    found = engine.search("layoff").collect()  # no fact has the word
    assert found[0]["fact_id"] == a and found[0]["trust"] == 0.6
    assert "sem:+" in engine.prefetch("layoff") and "trust:0.6" in engine.prefetch("layoff")
    assert engine.prefetch_similar("layoff") and engine.prefetch("???") == "" and engine.recall("layoff", 1).count() == 1
    assert engine.feedback(a, "helpful") == pytest.approx(0.65) and engine.feedback(a, "bad") == pytest.approx(0.55)
    assert engine.feedback(999, "helpful") == pytest.approx(0.55) and engine.trust_of(999) == 0.5
    engine.remove(c)
    engine.remove(999)
    d = engine.add("one more")
    assert d == c + 1  # ids aren't used again
    engine.on_memory_write("replace", "words that no one knows zzz", old_text="one more")
    assert [r["id"] for r in corpus_ids(engine)] == [a, b, d + 1] and engine.store.read("fact_vectors").count() == 3
    engine.on_memory_write("remove", old_text="words that no one knows zzz")
    engine.on_memory_write("add", "a last fact about the harbour")
    assert engine.facts().count() == 3
    assert json.loads(engine.call("memory_search", {"query": "layoff", "top_k": 1}))["results"][0]["fact_id"] == a
    assert json.loads(engine.call("memory_status", {}))["facts"] == 3 and "error" in json.loads(engine.call("no", {}))
    assert json.loads(engine.call("memory_feedback", {"fact_id": a, "feedback": "helpful"}))["new_trust"] == pytest.approx(0.6)
    assert {t["name"] for t in engine.tools()} == {"memory_add", "memory_search", "memory_feedback", "memory_status"} and "words over" in engine.prompt()
    # later messages, by the mark and by a stream, as in one build
    more = [("user", "the redundancy letter went to the bureau and back again", 1, 0), ("user", "the redundancy letter came", 1, 0)]
    session_db(path, more)
    again = Engine(spark, config)
    assert again.open(background=False).state == "current"
    assert again.update() == 2 and again.update() == 0
    whole = Engine(spark, Config(str(tmp_path / "whole"), path, dim=64, window=2))
    whole.build()
    vectors = [{r["word"]: r["memory"] for r in e.store.read("vectors").collect()} for e in (again, whole)]
    assert vectors[0] == vectors[1]
    words = [sorted(map(tuple, e.store.read("vocabulary").collect()), key=str) for e in (again, whole)]
    assert words[0] == words[1]
    source = str(tmp_path / "stream")
    spark.createDataFrame([(35, "s", "user", "the severance letter went to the severance bureau", None, 1, 0)], corpus.MESSAGES).write.parquet(source)
    q = updates.absorb_batches(again, spark.readStream.schema(corpus.MESSAGES).parquet(source), str(tmp_path / "cp"))
    q.awaitTermination()
    assert again.store.get_meta("last_seen_id") == 35
    assert again.store.read("vocabulary").where("word = 'severance'").head()["count"] == 2


def test_reads_of_sqlite_are_bounded(spark, tmp_path):
    path = session_db(tmp_path / "s.db", [("user", f"message number {i} of some", 1, 0) for i in range(500)])
    few = sqlite.read_sqlite(spark, path, "messages", "id", after=490, columns=["id", "content", "other"])
    assert few.columns == ["content", "id"] or few.columns == ["id", "content"]
    assert sorted(r["id"] for r in few.collect()) == list(range(491, 501))
    reader = sqlite.SqliteReader({"path": path, "table": "messages", "key": "id", "after": "490", "until": "495"}, ["id"])
    assert sum(p.high - p.low for p in reader.partitions()) == 5 and sum(1 for p in reader.partitions() for _ in reader.read(p)) == 5
    assert corpus.read_corpus(spark, path, "sessions", after=495).count() == 5 and corpus.read_corpus(spark, path, "sessions", after=900).count() == 0
    assert corpus.highest_of(spark, path) == 500


def test_an_earlier_store_is_folded_in(spark, tmp_path):
    store = tmp_path / "store"
    store.mkdir()
    words, matrix = ["harbour", "tide"], np.eye(2, 16, dtype=np.float32)
    (store / legacy.VOCABULARY).write_text(json.dumps({"vocab": words, "counts": {"harbour": 4, "tide": 2}, "dim": 16, "window": 2, "consumed_sentences": 9}))
    (store / legacy.UPDATED).write_text(json.dumps({"last_seen_id": 77}))
    (store / legacy.FACTS).write_text(json.dumps([1, 2]))
    np.save(store / legacy.MATRIX, matrix)
    np.save(store / legacy.ENCODED, matrix)
    engine = Engine(spark, Config(str(store), dim=16, window=2))
    assert engine.open(background=False).state == "current" and engine.store.get_meta("last_seen_id") == 77
    assert engine.store.read("fact_vectors").count() == 2 and not (store / legacy.VOCABULARY).exists() and (store / legacy.MATRIX).exists()
    assert not legacy.fold_in(engine, str(store))


def test_progress_moves(spark, tmp_path):
    engine = Engine(spark, Config(str(tmp_path / "s"), dim=16))
    with engine._watched(100):
        spark.range(40).repartition(40).foreach(lambda _: __import__("time").sleep(0.1))
    assert engine.progress is not None and 0 < engine.progress[0] <= 100 and engine.progress[1] == 100


def test_the_stored_index_is_that_of_the_facts(spark, tmp_path):
    engine = Engine(spark, Config(str(tmp_path / "store"), dim=16))
    texts = ["Severe storm on the coast", "calm before the storm", "", "a cold wind", "Café by the coast", "storm storm"]
    engine.add_all(spark.createDataFrame([(t, 0.5) for t in texts[:3]], "content string, trust double"))
    look = lambda q: [(r["id"], round(r["score"], 9)) for r in lexical.search(engine.index(), q).orderBy("rank").collect()]
    anew = lambda q: [(r["id"], round(r["score"], 9)) for r in lexical.search(lexical.build_index(facts.documents(engine.facts())), q).orderBy("rank").collect()]
    assert look("storm") == anew("storm") != []
    first = engine.store.folders("postings")
    for t in texts[3:]:
        engine.add(t)
    assert engine.store.folders("postings")[:1] == first and len(engine.store.folders("postings")) == 4  # only added to
    engine.remove(2)
    engine.on_memory_write("replace", "the coast is calm", old_text="storm storm")
    for q in ("storm", '"the coast"', "cafe OR co*", "calm NOT wind"):
        assert look(q) == anew(q)
    kept = engine.store.folders("idf")
    engine.weights(), engine.weights()
    once = engine.store.folders("idf")
    assert once != kept and engine.store.folders("idf") == once
    engine.set_trust(1, 0.9)
    assert look("storm") == anew("storm")
    plan = engine.index().postings.where("term = 'storm'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,storm)" in plan


def test_a_table_is_put_together_after_many_additions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "MOST", 3)
    store = Snapshots(spark, str(tmp_path / "s"))
    for i in range(5):
        store.commit({}, more={"t": spark.range(i, i + 1)})
    assert sorted(r["id"] for r in store.read("t").collect()) == [0, 1, 2, 3, 4] and len(store.folders("t")) == 2
    store.commit({"t": None})
    assert store.read("t") is None


def corpus_ids(engine):
    from semloom.plans import facts

    return facts.documents(engine.facts()).collect()


def test_import(spark, tmp_path):
    rows = spark.createDataFrame([("x", 0.0), ("y", None), ("z", 0.9), (None, 0.3)], "content string, trust_score double")
    engine = Engine(spark, Config(str(tmp_path / "s")))
    assert engine.import_facts(rows) == 3 and engine.import_facts(rows) == 3
    assert sorted(r["trust"] for r in engine.facts().collect()) == [0.5] * 4 + [0.9] * 2


def test_damaged_model_is_not_served(spark, tmp_path):
    path = session_db(tmp_path / "s.db", [("user", f"topic {i} about words and letters", 1, 0) for i in range(120)])
    engine = Engine(spark, Config(str(tmp_path / "store"), path, dim=32, window=2))
    engine.build()
    engine.store.commit({"vectors": engine.store.read("vectors").limit(2)})
    again = Engine(spark, Config(str(tmp_path / "store"), path, dim=32, window=2))
    verdict = again.open(background=False)  # and builds anew
    assert verdict.state == "damaged" and again.status()["notice"] and "notice" not in again.status()
    assert again.verdict.serve and again.store.read("vectors").count() > 2


def test_taken_over_model_and_changed_files(spark, tmp_path):
    words = ["harbour", "tide", "anchor"]
    (tmp_path / "v.json").write_text(json.dumps({"vocab": words, "counts": {"harbour": 4, "tide": 2, "anchor": 2, "once": 1}, "dim": 16, "window": 2, "consumed_sentences": 9}))
    matrix = np.random.default_rng(0).normal(size=(3, 16)).astype(np.float32)
    np.save(tmp_path / "m.npy", matrix)
    folder = tmp_path / "texts"
    folder.mkdir()
    (folder / "a.txt").write_text("the tide left the harbour once. the tide came back")
    engine = Engine(spark, Config(str(tmp_path / "store"), str(folder), "plain", dim=16, window=2))
    assert legacy.take_over(engine, str(tmp_path / "v.json"), str(tmp_path / "m.npy"))
    assert not legacy.take_over(engine, str(tmp_path / "v.json"), str(tmp_path / "m.npy"))
    assert engine.open(background=False).state == "current"
    got = {r["word"]: np.array(r["memory"], np.float32) for r in engine.store.read("vectors").collect()}
    assert all((got[w] == matrix[i]).all() for i, w in enumerate(words))
    assert updates.absorb_files(engine, str(folder)) == 2 and updates.absorb_files(engine, str(folder)) == 0
    counts = {r["word"]: (r["count"], r["idx"]) for r in engine.store.read("vocabulary").collect()}
    assert counts["harbour"] == (5, 0) and counts["once"][0] == 2 and counts["once"][1] >= 3 and counts["left"] == (1, None)
    with pytest.raises(ValueError):
        np.save(tmp_path / "bad.npy", matrix[:2])
        legacy.read_model(engine, str(tmp_path / "v.json"), str(tmp_path / "bad.npy"))


def test_a_joined_vocabulary_sends_a_vector_once_a_block(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 37}" for j in range(200)) if i else "") for i in range(30)], "id bigint, text string").repartition(3)
    vectors = spark.createDataFrame([(f"w{k}", [float(k % 5 - 2), 1.0 / (k + 1), 0.5]) for k in range(30)], "word string, memory array<float>")
    sent = {r["id"]: r["vector"] for r in encoding.encode_all(docs, vectors, 3).collect()}
    monkeypatch.setattr(encoding, "BROADCAST_NUMBERS", 0)
    joined = encoding.encode_all(docs, vectors, 3)
    assert {r["id"]: r["vector"] for r in joined.collect()} == sent and len(sent) == 30 and not any(sent[0])
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "posexplode" not in plan  # a row with a vector for each of the texts' 6,000 words before
