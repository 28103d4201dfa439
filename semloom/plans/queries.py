"""The engine's queries over the driver's tables, and their SQL.

conversations stand for the session store (ids by conversation and turn; none is inactive), documents for the facts, labels for trust,
benchmark for what is asked.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from semloom.functions import kept
from semloom.functions import text as T
from semloom.functions import vectors as V
from semloom.operators import encoding, lexical, ranking, training
from semloom.plans import facts as fact_plans
from semloom.sources import corpus

WATERMARK = 300
DIM = 64


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def messages(spark: SparkSession, d: str) -> DataFrame:
    """The conversations with ids in order. Ranks are within a conversation; what comes before is added up over conversations."""
    turns = _table(spark, d, "conversations")
    before = Window.orderBy("conv_id").rowsBetween(Window.unboundedPreceding, -1)
    starts = turns.groupBy("conv_id").count().select("conv_id", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    inside = turns.withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    return inside.join(starts, "conv_id").select(
        (F.col("start") + F.col("n")).alias("id"), F.col("conv_id").cast("string").alias("session_id"), "role", F.col("text").alias("content"),
        F.lit(1).alias("active"), F.lit(0).alias("compacted"),
    )


def sentences(spark: SparkSession, d: str, **bounds) -> DataFrame:
    return corpus.split_texts(corpus.session_texts(messages(spark, d), **bounds))


def docs(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def facts(spark: SparkSession, d: str) -> DataFrame:
    """documents with a trust of 0.5, 0.05 more for quality and 0.10 less for toxicity."""
    labels = _table(spark, d, "labels").select("doc_id", (0.5 + 0.05 * F.col("quality") - 0.10 * F.col("toxic")).alias("trust"))
    return _table(spark, d, "documents").join(labels, "doc_id", "left").select(F.col("doc_id").alias("fact_id"), F.col("text").alias("content"), F.coalesce("trust", F.lit(0.5)).alias("trust"))


def session_messages(spark, d):
    return corpus.kept_messages(messages(spark, d)).select("id", "role", "content")


def highest_message(spark, d):
    return messages(spark, d).agg(F.coalesce(F.max("id"), F.lit(0)).alias("highest"))


def messages_since(spark, d):
    return corpus.session_texts(messages(spark, d), after=WATERMARK).select(F.col("doc_seq").alias("id"), F.col("text").alias("content"))


def chat_blocks(spark, d):
    """The conversations as chat rows with a list of blocks, and their text again."""
    blocks = F.to_json(F.struct("role", F.array(F.struct(F.lit("text").alias("type"), F.col("text")), F.struct(F.lit("tool").alias("type"), F.lit(None).cast("string").alias("text"))).alias("content")))
    rows = _table(spark, d, "conversations").select("conv_id", "turn", F.try_parse_json(blocks).alias("v"))
    return rows.where(F.try_variant_get("v", "$.role", "string").isin(*corpus.ROLES)).select("conv_id", "turn", corpus.message_text("v").alias("text"))


def sentence_pieces(spark, d):
    return docs(spark, d).select("id", F.size(T.split_sentences(F.col("text"))).alias("pieces"))


def corpus_sentences(spark, d):
    return sentences(spark, d).select(F.col("doc_seq").alias("id"), "sentence", F.array_join("words", " ").alias("words"))


def token_counts(spark, d):
    return docs(spark, d).select(F.explode(T.tokenize(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def vocabulary(spark, d):
    tokens = training.occurrences(sentences(spark, d))
    limits = training.thresholds(tokens, 2)
    return limits.join(training.indexed(limits, tokens), "word", "left").select("word", F.col("total").alias("count"), "idx")


def cooccurrences(spark, d):
    tokens = training.occurrences(sentences(spark, d))
    return training.cooccurrences(training.eligible(tokens, training.thresholds(tokens, 2)), 3)


def identity_numbers(spark, d):
    """Of each word the digest of all 2048 numbers of its identity vector, written with blanks between them."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))  # named, so that few words aren't put in one task: there is much to do for each
    words = training.occurrences(sentences(spark, d)).select("word").distinct().repartition(n, "word")
    return words.select("word", V.identity_digest_of(F.col("word"), 2048).alias("numbers"))


def idf(spark, d):
    return encoding.idf(docs(spark, d)).select("word", "df", F.round("idf", 6).alias("idf"))


def _index(spark, d):
    return lexical.build_index(docs(spark, d))


def postings(spark, d):
    return _index(spark, d).postings.select("term", "id", "tf", F.array_join("positions", " ").alias("positions"), "length")


def _scored(query: str):
    def run(spark, d):
        return lexical.scored(_index(spark, d), lexical.parse(query)).select("id", F.round("score", 6).alias("score"))

    return run


TEXT_QUERIES = {
    "fts_and": "the with",
    "fts_or": "idiot OR clown",
    "fts_not": "that NOT with",
    "fts_phrase": '"of the"',
    "fts_prefix": "wor*",
    "fts_initial": "^the",
    "fts_near": "NEAR(from with, 3)",
}


def fts_top(spark, d):
    return lexical.search(_index(spark, d), "idiot OR clown OR trash").select("id", F.round("score", 5).alias("score"), "rank")


def nearest_vectors(spark, d):
    rows = _table(spark, d, "embeddings")
    query = rows.where("vec_id = 0").select(F.col("embedding").alias("q"))
    score = V.cosine(F.col("embedding"), F.col("q"))
    top = rows.crossJoin(F.broadcast(query)).select(F.col("vec_id").alias("id"), score.alias("score")).orderBy(F.desc("score"), "id").limit(20)
    return top.where(F.col("score") > 0.01).select("id", F.round("score", 4).alias("score"))


def nearest_vectors_of_all(spark, d):
    """For each row of embeddings its 20 nearest rows by cosine, above 0.01; the row itself is one of them."""
    rows = _table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, x: a + x * x))
    unit = rows.select("id", F.transform("x", lambda x: F.when(length > 0, x / length).otherwise(0.0)).alias("vector"))
    return encoding.nearest_many(unit, unit.withColumnRenamed("id", "item"), 20, 0.01).select("item", "id", F.round("score", 4).alias("score"), "rank")


def label_cosines(spark, d):
    """Cosine of the mean vectors of each two labels."""
    cells = _table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    means = cells.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda c: c["x"]).alias("mean"))
    a, b = means.toDF("a", "x"), means.toDF("b", "y")
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(V.cosine(F.col("x"), F.col("y")), 5).alias("cosine"))


def _two_lists(spark, d):
    """Two rankings of each source's documents, twenty each, as deep as a search looks: by length, and by words' number."""
    rows = _table(spark, d, "documents").select("doc_id", "source", "n_chars", F.size(F.split("text", " ", -1)).alias("blanks"))
    out = []
    for k, by in enumerate(("n_chars", "blanks")):
        place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc(by), "doc_id"))
        out.append(rows.select("source", F.lit(k).alias("list"), (place - 1).alias("rank"), F.col("doc_id").alias("id")).where("rank < 20"))
    return out[0].unionByName(out[1])


def rank_fusion(spark, d):
    fused = ranking.fuse(_two_lists(spark, d), by=["source"])
    place = F.row_number().over(Window.partitionBy("source").orderBy(*ranking.fused_order())) - 1
    return fused.select("source", "id", F.round("score", 8).alias("score"), place.alias("place"))


def trusted_search(spark, d):
    """The first five of each fused ranking, with scores scaled by trust, in fused order."""
    place = F.row_number().over(Window.partitionBy("source").orderBy(*ranking.fused_order())) - 1
    top = ranking.fuse(_two_lists(spark, d), by=["source"]).withColumn("place", place).where("place < 5")
    return ranking.with_trust(top, facts(spark, d)).select("source", "id", "place", F.round(F.col("score") * F.col("trust"), 8).alias("score"), F.round("trust", 4).alias("trust"))


def trusted_lines(spark, d):
    """All of each fused ranking by trusted score; the first five as lines."""
    fused = ranking.with_trust(ranking.fuse(_two_lists(spark, d), by=["source"]), facts(spark, d)).withColumn("score", F.round(F.col("score") * F.col("trust"), 9))
    place = F.row_number().over(Window.partitionBy("source").orderBy(*ranking.fused_order()))
    line = F.format_string("- [%.4f trust:%.1f] %s", "score", "trust", F.substring(F.col("content"), 1, 200))
    texts = facts(spark, d).select(F.col("fact_id").alias("id"), "content")
    return fused.withColumn("place", place).where("place <= 5").join(texts, "id").select("source", "place", line.alias("line"))


def feedback(spark, d):
    """Labels as feedback on their documents: first on quality (good: helpful), then on toxicity (toxic: unhelpful)."""
    given = _table(spark, d, "labels").select(F.col("doc_id").alias("fact_id"), F.explode(F.array(F.struct(F.lit(1).alias("at"), F.when(F.col("quality") == 1, "helpful").otherwise("unhelpful").alias("feedback")), F.struct(F.lit(2).alias("at"), F.when(F.col("toxic") == 1, "unhelpful").otherwise("helpful").alias("feedback")))).alias("s")).select("fact_id", "s.*")
    table = facts(spark, d).withColumn("created_at", F.lit(None).cast("timestamp")).withColumn("updated_at", F.lit(None).cast("timestamp"))
    return fact_plans.with_feedback(table, given).select("fact_id", F.round("trust", 4).alias("trust"))


def removed_facts(spark, d):
    """Facts without the toxic documents."""
    gone = _table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("fact_id"))
    return fact_plans.removed(facts(spark, d), gone).select("fact_id", F.length("content").alias("size"))


def repeated_facts(spark, d):
    """For each text that more than one fact has, the fact that a removal by text would take."""
    return facts(spark, d).groupBy("content").agg(F.min("fact_id").alias("fact_id"), F.count("*").alias("n")).where("n > 1").select("fact_id", "n")


def imported_trust(spark, d):
    source = _table(spark, d, "documents").join(_table(spark, d, "labels"), "doc_id", "left").select(F.col("doc_id"), F.col("text").alias("content"), (F.col("quality") * 0.8).alias("trust_score"))
    return corpus.imported_facts(source).groupBy("trust").agg(F.count("*").alias("n")).select(F.round("trust", 3).alias("trust"), "n")


def trained_vectors(spark, d):
    return training.train(sentences(spark, d), training.Settings(DIM)).vectors


def encoded_facts(spark, d):
    model = training.train(sentences(spark, d), training.Settings(DIM))
    return encoding.encode_all(docs(spark, d), model.vectors, DIM)


def fused_search(spark, d):
    """Each benchmark text asked of the documents by any of its words, with bm25, and of their vectors by meaning; fused, with trust."""
    model = training.train(sentences(spark, d), training.Settings(DIM))
    learned = kept.cut(model.vectors)  # for the texts and for the documents
    words = encoding.worded(docs(spark, d))
    weights = kept.cut(encoding.idf_of(words))
    asked = _table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    queries_ = encoding.encode(asked, learned, weights, DIM).select(F.col("id").alias("item"), "vector")
    by_meaning = encoding.nearest_many(encoding.encode_words(words, learned, weights, DIM, every=True), queries_, 20, 0.01)
    by_words = lexical.search_texts(docs(spark, d), asked.select(F.col("id").alias("item"), "text"), 20)
    lists = by_words.select("item", F.lit(0).alias("list"), "rank", "id").unionByName(by_meaning.select("item", F.lit(1).alias("list"), "rank", "id"))
    place = F.row_number().over(Window.partitionBy("item").orderBy(*ranking.fused_order())) - 1
    top = ranking.fuse(lists, by=["item"]).withColumn("place", place).where("place < 5")
    return ranking.with_trust(top, facts(spark, d)).select("item", "place", F.col("id").alias("fact_id"), (F.col("score") * F.col("trust")).alias("score"), "trust")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [
        session_messages, highest_message, messages_since, chat_blocks, sentence_pieces, corpus_sentences, token_counts, vocabulary, cooccurrences,
        identity_numbers, idf, postings, fts_top, nearest_vectors, nearest_vectors_of_all, label_cosines, rank_fusion, trusted_search, trusted_lines, feedback, removed_facts,
        repeated_facts, imported_trust, trained_vectors, encoded_facts, fused_search,
    ]
    return {f.__name__: f for f in named} | {name: _scored(q) for name, q in TEXT_QUERIES.items()}
