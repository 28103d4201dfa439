"""The engine: a store of facts, a model trained on a corpus, fused search over both, and their upkeep."""

from __future__ import annotations

import json
import logging
import os
import threading
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import MISSING, asdict, dataclass, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semloom.operators import encoding, lexical, ranking, training
from semloom.plans import facts as fact_plans
from semloom.plans import legacy, lifecycle
from semloom.plans.snapshots import Snapshots
from semloom.sources import corpus

DEPTH = 20
THRESHOLD = 0.01
SHOWN = 5
POSTINGS = "term string, id bigint, tf bigint, positions array<int>, length int"
log = logging.getLogger("semloom")


@dataclass
class Config:
    """Where things are, and the model's shape."""

    store: str
    corpus: str = ""
    format: str = "sessions"
    dim: int = 2048
    window: int = 3
    min_count: int = 2

    @classmethod
    def load(cls, path: str) -> Config:
        with open(path, encoding="utf-8") as f:
            return cls(**json.load(f))

    def save(self, path: str) -> None:
        staged = f"{path}.new"
        Path(staged).write_text(json.dumps(asdict(self), indent=2))
        os.replace(staged, path)

    @staticmethod
    def schema() -> list[dict]:
        """The settings with their defaults and what they mean, for a settings dialogue."""
        said = {
            "store": "Folder of the store", "corpus": "Session store, or folder of texts or chat logs", "format": "Kind of corpus: plain, chat-jsonl or sessions",
            "dim": "Vector dimension; a change builds anew", "window": "Neighbours on each side; a change builds anew", "min_count": "Occurrences from which a word counts",
        }
        return [dict(key=f.name, default="" if f.default is MISSING else f.default, description=said[f.name]) for f in fields(Config)]


class Engine:
    def __init__(self, spark: SparkSession, config: Config):
        self.spark, self.config = spark, config
        self.store = Snapshots(spark, config.store)
        self.notice: str | None = None
        self.progress: tuple[int, int] | None = None
        self.building: threading.Thread | None = None
        self.verdict = lifecycle.Verdict("cold", False, False)
        self.opened = False

    # opening and upkeep

    def open(self, background: bool = True) -> lifecycle.Verdict:
        """The verdict on what is stored; heals or re-encodes what can be, and builds if needed (``background``: in a thread)."""
        if os.path.isdir(self.config.store):
            legacy.fold_in(self, self.config.store)
        meta = self.store.manifest()["meta"]
        highest = self._highest()
        words, vectors, width = self._shape()
        found = self.verdict = lifecycle.judge(meta, words, vectors, width, highest, self.config.dim, self.config.window)
        self.notice = self.verdict.notice
        if self.verdict.state == "healed":
            self.store.set_meta("tokenizer_fingerprint", self._fingerprint())
        if self.verdict.serve:
            self._refresh_cache(meta)
        self.opened = True
        if lifecycle.builds_by_itself(self.verdict, highest):
            if background:
                self.building = threading.Thread(target=self._build_safely, daemon=True)
                self.building.start()
            else:
                self._build_safely()
        return found

    def close(self) -> None:
        self.opened = False

    def _fingerprint(self) -> str:
        return lifecycle.fingerprint(dim=self.config.dim, window=self.config.window)

    def _highest(self) -> int:
        if self.config.format != "sessions" or not self.config.corpus or not os.path.exists(self.config.corpus):
            return 0
        return corpus.highest_of(self.spark, self.config.corpus)

    def _shape(self) -> tuple[int | None, int | None, int | None]:
        vocabulary, vectors = self.store.read("vocabulary"), self.store.read("vectors")
        if vocabulary is None or vectors is None:
            return None, None, None
        row = vectors.agg(F.count("*").alias("n"), F.max(F.size("memory")).alias("width")).collect()[0]
        return vocabulary.where("idx IS NOT NULL").count(), row["n"], row["width"]

    def _refresh_cache(self, meta: dict) -> None:
        n, cached = self.facts().count(), self.store.read("fact_vectors")
        row = cached.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).collect()[0] if cached is not None else {"n": None, "width": None}
        if n and not lifecycle.cache_is_current(meta, n, row["n"], row["width"], self.config.dim):
            if row["n"] is not None and meta.get("encoder_version") not in (None, lifecycle.ENCODER_VERSION):
                self.notice = lifecycle.REENCODED
            self.rebuild_cache()

    def model(self) -> training.Model | None:
        if not self.verdict.serve:
            return None
        vocabulary, vectors = self.store.read("vocabulary"), self.store.read("vectors")
        settings = training.Settings(self.config.dim, self.config.window, self.config.min_count)
        seen = int(self.store.get_meta("consumed_sentences", 0) or 0)
        return training.Model(vocabulary, vectors, settings, lambda: seen)

    def _build_safely(self) -> None:
        try:
            self.build()
        except Exception as e:
            self.progress = None
            log.warning("the build failed and will be tried again at the next start: %s", e)

    def build(self) -> training.Model:
        """A full build. It is written and checked beside the old state, then committed at once."""
        highest = self._highest()
        sentences = corpus.read_corpus(self.spark, self.config.corpus, self.config.format, until=highest if self.config.format == "sessions" else None)
        settings = training.Settings(self.config.dim, self.config.window, self.config.min_count)
        sentences = sentences.persist()  # tokenized once for all that reads it
        total = sentences.count()
        self.progress = (0, total) if total else None
        model = training.train(sentences, settings)
        with self._watched(total):
            self._commit_model(model, highest)
        sentences.unpersist()
        self.progress = None
        self.verdict = lifecycle.Verdict("current", True, False)
        if self.facts().limit(1).count():
            self.rebuild_cache()
        return self.model()

    @contextmanager
    def _watched(self, total: int) -> Iterator[None]:
        """Meanwhile ``progress`` follows the share of the tasks of the running jobs' stages that are done, as so many of the sentences."""
        over, tracker = threading.Event(), self.spark.sparkContext.statusTracker()

        def watch() -> None:
            done: dict[int, tuple[int, int]] = {}
            while not over.wait(0.5):
                for s in tracker.getActiveStageIds():
                    if (info := tracker.getStageInfo(s)) is not None:
                        done[s] = info.numCompletedTasks, info.numTasks
                for s in set(done) - set(tracker.getActiveStageIds()):
                    done[s] = done[s][1], done[s][1]
                if done and total:
                    share = sum(a for a, _ in done.values()) / max(1, sum(b for _, b in done.values()))
                    self.progress = max((self.progress or (0, total))[0], int(share * total)), total

        thread = threading.Thread(target=watch, daemon=True)
        thread.start()
        try:
            yield
        finally:
            over.set()
            thread.join()

    def _commit_model(self, model: training.Model, highest: int) -> None:
        def check(written: dict[str, DataFrame]) -> None:
            words = written["vocabulary"].where("idx IS NOT NULL").count()
            if not words:
                raise ValueError("no word has enough occurrences; nothing is stored")
            if written["vectors"].where(F.size("memory") == model.settings.dim).count() != words:
                raise ValueError("vectors and vocabulary don't agree; nothing is stored")

        meta = {
            "dim": model.settings.dim, "window": model.settings.window, "min_count": model.settings.min_count, "tokenizer_fingerprint": self._fingerprint(),
            "regex": lifecycle.WORD_PATTERN, "stemmer": None, "consumed_sentences": model.sentences, "corpus_source": lifecycle.SOURCE,
            "last_seen_id": highest, "encoder_version": lifecycle.ENCODER_VERSION,
        }
        self.store.commit({"vocabulary": model.vocabulary, "vectors": model.vectors}, meta, check)

    def update(self) -> int:
        """Take in the messages after the last seen one, up to the highest now; the number of sentences. Without a model nothing is done:
        a model from a tail of the corpus would pass for a whole one."""
        model = self.model() if self.opened else None
        if model is None:
            return 0
        last, highest = int(self.store.get_meta("last_seen_id", 0) or 0), self._highest()
        if highest <= last:
            return 0
        sentences = corpus.read_corpus(self.spark, self.config.corpus, "sessions", after=last, until=highest)
        return self.absorb(sentences, highest)

    def absorb(self, sentences: DataFrame, highest: int) -> int:
        """Train on with later sentences, and set the mark of the last message seen."""
        model = self.model()
        before = model.vocabulary.where("idx IS NOT NULL").count()
        sentences = sentences.persist()
        after = training.train(sentences, model.settings, model)
        taken = sentences.count()
        self._commit_model(after, highest)
        sentences.unpersist()
        new = self.store.read("vocabulary").where("idx IS NOT NULL").count() - before
        if new > lifecycle.LEAKED_WORDS:
            log.warning("%d new words at once; does the corpus hold what it shouldn't?", new)
        if self.facts().limit(1).count():
            self.rebuild_cache()
        return taken

    def rebuild_cache(self) -> None:
        """Encode all facts anew."""
        docs = fact_plans.documents(self.facts())
        vectors = encoding.encode_all(docs, self.store.read("vectors"), self.config.dim, self.weights())
        self.store.commit({"fact_vectors": vectors}, {"encoder_version": lifecycle.ENCODER_VERSION})

    def weights(self) -> DataFrame:
        """(word, df, idf) over the facts, counted when first asked for after they changed and kept in the store."""
        now = self.store.folders("facts")
        if self.store.get_meta("idf_of") != now or self.store.read("idf") is None:
            self.store.commit({"idf": encoding.idf(fact_plans.documents(self.facts()))}, {"idf_of": now})
        return self.store.read("idf")

    def index(self) -> lexical.Index:
        """The stored full-text index of the facts; built if the store has none."""
        if self.store.get_meta("index_of") is None:
            self._build_index()
        meta = self.store.manifest()["meta"]
        postings, gone = self.store.read("postings"), self.store.read("gone")
        if postings is None:
            postings = self.spark.createDataFrame([], POSTINGS)
        if gone is not None:
            postings = postings.join(gone.select(F.col("fact_id").alias("id")), "id", "left_anti")
        n, length = meta["index_of"]
        totals = self.spark.createDataFrame([(n, length / n if n else 0.0)], "documents bigint, average double")
        return lexical.Index(postings, totals)

    def _postings(self, docs: DataFrame) -> tuple[DataFrame, int, int]:
        """(postings as they are stored, documents, terms) of some facts."""
        built = lexical.build_index(docs)
        total = built.totals.head()
        return built.postings.repartitionByRange("term", "id").sortWithinPartitions("term", "id"), total["documents"], round(total["documents"] * (total["average"] or 0))

    def _build_index(self) -> None:
        rows, n, length = self._postings(fact_plans.documents(self.facts()))
        self.store.commit({"postings": rows if n else None, "gone": None}, {"index_of": [n, length]})

    # facts

    def facts(self) -> DataFrame:
        found = self.store.read("facts")
        return fact_plans.empty(self.spark) if found is None else found

    def add(self, content: str, trust: float = ranking.DEFAULT_TRUST) -> int:
        return self.add_all(self.spark.createDataFrame([(content, float(trust))], "content string, trust double"))[0]

    def add_all(self, rows: DataFrame) -> tuple[int, int]:
        """Append ``rows`` (content, trust): (first id, number). Older facts' vectors stay as they are until the cache is rebuilt."""
        first, added = self._append(rows, None)
        return first, added

    def _append(self, rows: DataFrame, gone: int | None) -> tuple[int, int]:
        highest = int(self.store.get_meta("highest_fact_id", 0) or 0)
        if gone is not None:
            self.remove(gone)
        # written as they come, with their place; then numbered by what stands in earlier partitions, of which there is one row each
        with self.store.staged(rows.select("content", "trust", F.monotonically_increasing_id().alias("place"))) as staged:
            part = F.shiftright("place", 33)
            first, found = {}, highest
            for r in staged.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("place").alias("start")).orderBy("part").collect():
                first[r["part"]], found = found + 1 - r["start"], found + r["n"]
            if not first:
                return highest + 1, 0
            shift = self.spark.createDataFrame(list(first.items()), "part bigint, shift bigint")
            numbered = staged.withColumn("part", part).join(F.broadcast(shift), "part").select((F.col("place") + F.col("shift")).alias("fact_id"), "content", "trust")
            new = fact_plans.documents(numbered)
            more = {"facts": fact_plans.added(fact_plans.empty(self.spark), numbered, highest)}
            meta: dict = {"highest_fact_id": found}
            if self.store.get_meta("index_of") is not None:
                rows, n, length = self._postings(new)
                if n and length:
                    more["postings"] = rows
                meta["index_of"] = [x + y for x, y in zip(self.store.get_meta("index_of"), (n, length))]
            self.store.commit({}, meta, more=more)
            if self.model() is not None:  # weighted by all facts, these too
                self.store.commit({}, more={"fact_vectors": encoding.encode_all(new, self.store.read("vectors"), self.config.dim, self.weights())})
        return highest + 1, found - highest

    def _ids(self, *ids: int) -> DataFrame:
        return self.spark.createDataFrame([(i,) for i in ids], "fact_id bigint")

    def remove(self, fact_id: int) -> None:
        fact = self.facts().where(F.col("fact_id") == fact_id)
        length = fact.where("content IS NOT NULL").select(F.size(lexical.terms(F.col("content"))).alias("n")).head()
        tables = {"facts": fact_plans.removed(self.facts(), self._ids(fact_id))}
        cached = self.store.read("fact_vectors")
        if cached is not None:
            tables["fact_vectors"] = cached.where(F.col("id") != fact_id)
        kept = self.store.get_meta("index_of")
        if kept is None or length is None:
            self.store.commit(tables)
        else:  # its postings stay, and are left out when they are read
            self.store.commit(tables, {"index_of": [kept[0] - 1, kept[1] - length["n"]]}, more={"gone": self._ids(fact_id)})

    def set_trust(self, fact_id: int, value: float) -> None:
        changes = self.spark.createDataFrame([(fact_id, float(value))], "fact_id bigint, new_trust double")
        self.store.commit({"facts": fact_plans.with_trust_set(self.facts(), changes)})

    def trust_of(self, fact_id: int) -> float:
        row = self.facts().where(F.col("fact_id") == fact_id).select("trust").head()
        return 0.5 if row is None or row["trust"] is None else row["trust"]

    def feedback(self, fact_id: int, feedback: str) -> float:
        """The new trust. An unknown fact's is counted from 0.5 and not stored."""
        now = self.trust_of(fact_id)
        new = min(1.0, now + ranking.HELPFUL) if feedback == "helpful" else max(0.0, now + ranking.UNHELPFUL)
        self.set_trust(fact_id, new)
        return new

    def on_memory_write(self, action: str, content: str = "", old_text: str = "") -> None:
        """Mirror a change made elsewhere: add, remove (the first fact of that text), or replace (remove if found, and add)."""
        if not self.opened:
            return
        if action == "add" and content:
            self.add(content)
        elif action in ("remove", "replace") and (action == "remove" or content):
            gone = fact_plans.first_of_text(self.facts(), old_text) if old_text else None
            if action == "replace":
                self._append(self.spark.createDataFrame([(content, 0.5)], "content string, trust double"), gone)
            elif gone is not None:
                self.remove(gone)

    def import_facts(self, source: DataFrame) -> int:
        """Copy another store's facts (content, trust_score); run twice it copies twice."""
        return self.add_all(corpus.imported_facts(source))[1]

    # search

    def ranked_lists(self, query: str) -> DataFrame:
        """(list, rank, id, similarity): list 0 by words, list 1 by vectors."""
        by_words = lexical.search(self.index(), query).select(F.lit(0).alias("list"), "rank", "id", F.lit(None).cast("double").alias("similarity"))
        return by_words.unionByName(self._similar(query, DEPTH).select(F.lit(1).alias("list"), "rank", "id", F.col("score").alias("similarity")))

    def _similar(self, query: str, k: int) -> DataFrame:
        cached = self.store.read("fact_vectors") if self.model() is not None else None
        if cached is None:
            return self.spark.createDataFrame([], "id bigint, score double, rank int")
        vector = encoding.encode_query(query, self.store.read("vectors"), self.weights(), self.config.dim)
        return encoding.nearest(cached, vector, k, THRESHOLD)

    def search(self, query: str, top_k: int = 5) -> DataFrame:
        """(fact_id, score, trust, text, place): the first ``top_k`` of the fused lists, in that order; trust only scales their scores."""
        fused = ranking.fuse(self.ranked_lists(query)).orderBy(*ranking.fused_order()).limit(top_k)
        placed = encoding.ranked(fused, ranking.fused_order()).withColumnRenamed("rank", "place")
        return self._described(placed).orderBy("place")

    def _described(self, fused: DataFrame) -> DataFrame:
        facts = self.facts()
        texts = facts.select(F.col("fact_id").alias("id"), F.col("content").alias("text"))
        joined = ranking.with_trust(fused, facts).join(texts, "id", "left")
        return joined.select(F.col("id").alias("fact_id"), (F.col("score") * F.col("trust")).alias("score"), "trust", F.coalesce("text", F.lit("")).alias("text"), *[c for c in ("place", "list", "first_rank") if c in joined.columns])

    def recall(self, query: str, top_k: int = 5) -> DataFrame:
        """(fact_id, score, text) by vectors alone."""
        texts = self.facts().select(F.col("fact_id").alias("id"), F.col("content").alias("text"))
        return self._similar(query, top_k).join(texts, "id", "left").orderBy("rank").select(F.col("id").alias("fact_id"), "score", F.coalesce("text", F.lit("")).alias("text"))

    def prefetch(self, query: str) -> str:
        """The memories to put before a model: all fused facts by trusted score, the first five as lines; "" if there are none."""
        if not self.opened:
            return ""
        lists = self.ranked_lists(query)
        found = lists.groupBy("id").agg(F.max((F.col("list") == 0).cast("int")).alias("words"), F.max("similarity").alias("similarity"))
        fused = ranking.fuse(lists).withColumnRenamed("rank", "first_rank")
        top = self._described(fused).orderBy(F.desc("score"), "list", "first_rank").limit(SHOWN)
        rows = top.join(found.withColumnRenamed("id", "fact_id"), "fact_id").orderBy(F.desc("score"), "list", "first_rank").collect()
        if not rows:
            return ""
        lines = []
        for r in rows:
            tags = (["fts"] if r["words"] else []) + ([f"sem:{r['similarity']:+.2f}"] if r["similarity"] is not None else [])
            lines.append(f"- [{r['score']:.4f} {'+'.join(tags) or '?'} trust:{r['trust']:.1f}] {r['text'][:200]}")
        return "\n".join(["Relevant memories (words and vectors fused):", *lines])

    def prefetch_similar(self, query: str) -> str:
        """Lines by vectors alone."""
        lines = [f"- [{r['score']:+.3f}] {r['text'][:200]}" for r in self.recall(query).collect()]
        return "\n".join(["Relevant memories (vectors only):", *lines]) if lines else ""

    # for a host

    def status(self) -> dict:
        """What is built and stored; a notice is given once."""
        out: dict = {}
        if self.progress is not None:
            done, total = self.progress
            out |= {"build": "in_progress", "progress": lifecycle.progress_bar(done, total), "done": done, "total": total}
        elif self.verdict.serve:
            out |= {"build": "complete", "model_size": self.store.read("vocabulary").where("idx IS NOT NULL").count(), "dim": self.config.dim}
        else:
            out["build"] = "not_built"
        out["facts"] = self.facts().count()
        if self.notice:
            out["notice"], self.notice = self.notice, None
        return out

    def prompt(self) -> str:
        """How a language model is told about the memory."""
        head = "# Semantic memory\n"
        if self.verdict.serve:
            s = self.status()
            state = f"Active, with vectors of {s['model_size']} words over {s['facts']} facts."
        elif self.building is not None:
            state = "Active by words; vectors are being built."
        else:
            state = "Active by words; there are no vectors yet."
        return f"{head}{state}\nUse memory_search to recall, memory_add to store, memory_feedback to rate what was recalled."

    @staticmethod
    def tools() -> list[dict]:
        text, number = {"type": "string"}, {"type": "integer"}
        make = lambda name, what, needed, **given: dict(name=name, description=what, parameters=dict(type="object", required=needed, properties=given))
        return [
            make("memory_add", "Store a fact, with how far it is trusted.", ["content"], content=text, trust={"type": "number", "default": 0.5}),
            make("memory_search", "Search facts by words and meaning.", ["query"], query=text, top_k=number | {"default": 5}),
            make("memory_feedback", "Say whether a fact helped.", ["fact_id", "feedback"], fact_id=number, feedback=text | {"enum": ["helpful", "unhelpful"]}),
            make("memory_status", "What is built, and how many facts there are.", []),
        ]

    def call(self, tool: str, arguments: dict) -> str:
        """A tool's result as JSON."""
        if tool == "memory_add":
            out = {"fact_id": self.add(arguments.get("content", ""), arguments.get("trust", 0.5)), "stored": True}
        elif tool == "memory_search":
            out = {"results": [{k: r[k] for k in ("fact_id", "score", "trust", "text")} for r in self.search(arguments.get("query", ""), arguments.get("top_k", 5)).collect()]}
        elif tool == "memory_feedback":
            out = {"fact_id": arguments.get("fact_id"), "new_trust": self.feedback(arguments.get("fact_id"), arguments.get("feedback"))}
        elif tool == "memory_status":
            out = self.status()
        else:
            out = {"error": f"unknown tool: {tool}"}
        return json.dumps(out)

    def sync_turn(self, user: str, assistant: str) -> None:
        """Nothing: the corpus is the session store, read by ``update``."""
