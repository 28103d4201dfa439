"""Corpus sources. Each gives texts with an explicit order: (source, doc_seq, text), source a string, doc_seq a number.

The order matters because training absorbs sentences one after another; (source, doc_seq, sentence, position) is a token's place.
"""

from __future__ import annotations

import os
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semloom.functions import text as T

ROLES = ("user", "assistant")
#: Beginnings of boilerplate rows, matched without regard to case.
BOILERPLATE = ("[SYSTEM:%", "[CONTEXT COMPACTION%")
MESSAGES = "id bigint, session_id string, role string, content string, tool_calls string, active int, compacted int"


class DocumentSource(Protocol):
    """Anything with facts: (id, text)."""

    def documents(self) -> DataFrame: ...


class Documents:
    """Facts from rows or a table, as they are."""

    def __init__(self, spark: SparkSession, rows):
        self.table = rows if isinstance(rows, DataFrame) else spark.createDataFrame([(r["id"], r["text"]) for r in rows], "id bigint, text string")

    def documents(self) -> DataFrame:
        return self.table


def documents_file(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file with a list of {id, text}."""
    return spark.read.schema("id bigint, text string").json(path, multiLine=True)


def _listed(spark: SparkSession, path: str, endings: tuple[str, ...]) -> list[str]:
    """Files of a folder by ending and then name, not below it; a file itself; nothing if there is no such path.

    Through Hadoop's file system, so any scheme it knows will do."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    if not fs.getFileStatus(at).isDirectory():
        return [path]
    names = sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isFile())
    return [os.path.join(path, n) for e in endings for n in names if n.endswith(e)]


def _whole(spark: SparkSession, files: list[str]) -> DataFrame:
    """(source, doc_seq, text): whole files in the order given, with universal line ends; bytes that aren't UTF-8 are replaced."""
    if not files:
        return spark.createDataFrame([], "source string, doc_seq bigint, text string")
    places = spark.createDataFrame([(os.path.basename(f), i) for i, f in enumerate(files)], "source string, doc_seq bigint")
    got = spark.read.format("binaryFile").load(files).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.decode("content", "UTF-8").alias("text"))
    named = got.withColumn("source", F.url_decode(F.replace("name", F.lit("+"), F.lit("%2B"))))
    return named.join(F.broadcast(places), "source").select("source", "doc_seq", F.regexp_replace("text", "\r\n?", "\n").alias("text"))


def plain_texts(spark: SparkSession, path: str) -> DataFrame:
    """A file, or the .txt files and then the .md files of a folder."""
    return _whole(spark, _listed(spark, path, (".txt", ".md")))


def chat_messages(spark: SparkSession, path: str) -> DataFrame:
    """Rows of JSON-lines chat logs: what users and assistants said. Lines that are no JSON object are left out.

    doc_seq orders by file and then line."""
    return chat_rows(_whole(spark, _listed(spark, path, (".jsonl",))))


def chat_rows(files: DataFrame) -> DataFrame:
    """``chat_messages`` of whole files (source, doc_seq, text)."""
    lines = files.select("source", F.col("doc_seq").alias("file"), F.posexplode(F.split("text", "\n", -1)).alias("line", "row"))
    parsed = lines.where(F.trim("row") != "").withColumn("v", F.try_parse_json("row"))
    role = F.try_variant_get("v", "$.role", "string")
    rows = parsed.where(role.isin(*ROLES)).withColumn("text", message_text("v"))
    return rows.where(F.col("text") != "").select("source", (F.col("file") * F.lit(1 << 32) + F.col("line")).alias("doc_seq"), "text")


def message_text(message: str):
    """The text of a chat message (a variant column): its content if that is a string; of a list of blocks their texts, with blanks between."""
    kind = F.schema_of_variant(F.try_variant_get(message, "$.content", "variant"))
    plain = F.try_variant_get(message, "$.content", "string")
    blocks = F.try_variant_get(message, "$.content", "array<variant>")
    is_text = lambda b: F.schema_of_variant(F.try_variant_get(b, "$.text", "variant")) == "STRING"
    texts = F.transform(F.filter(blocks, is_text), lambda b: F.try_variant_get(b, "$.text", "string"))
    return F.when(kind == "STRING", plain).when(blocks.isNotNull(), F.array_join(texts, " ")).otherwise("")


def kept_messages(messages: DataFrame) -> DataFrame:
    """The rows of a session table that are conversation: by users and assistants, not empty, current or compacted originals, no boilerplate."""
    content = F.col("content")
    said = F.col("role").isin(*ROLES) & content.isNotNull() & (content != "") & ((F.col("active") == 1) | (F.col("compacted") == 1))
    for start in BOILERPLATE:
        said &= ~content.ilike(start)
    return messages.where(said)


def session_texts(messages: DataFrame, after: int | None = None, until: int | None = None) -> DataFrame:
    """(source, doc_seq, text) of the kept messages with after < id <= until; the bounds reach a Parquet scan, and SQLite by
    ``read_messages``."""
    if after is not None:
        messages = messages.where(F.col("id") > after)
    if until is not None:
        messages = messages.where(F.col("id") <= until)
    return kept_messages(messages).select(F.lit("").alias("source"), F.col("id").alias("doc_seq"), F.col("content").alias("text"))


def highest_id(messages: DataFrame) -> int:
    """Of all messages, kept or not; 0 if there are none."""
    return messages.agg(F.coalesce(F.max("id"), F.lit(0))).collect()[0][0]


def highest_of(spark: SparkSession, path: str) -> int:
    """``highest_id`` of a session store; of SQLite by its index."""
    from semloom.sources.sqlite import highest, is_sqlite

    return highest(path, "messages", "id") if is_sqlite(path) else highest_id(read_messages(spark, path))


def split_texts(texts: DataFrame, normalize: bool = True) -> DataFrame:
    """(source, doc_seq, sentence, words) of the sentences of three words or more. Texts are cut first and each sentence tokenized alone."""
    pieces = texts.select("source", "doc_seq", F.posexplode(T.split_sentences(F.col("text"))).alias("sentence", "piece"))
    return pieces.withColumn("words", T.tokenize(F.col("piece"), normalize)).where(F.size("words") >= T.MIN_WORDS).drop("piece")


def read_corpus(spark: SparkSession, path: str, format: str = "plain", after: int | None = None, until: int | None = None) -> DataFrame:
    """Tokenized sentences of a corpus: "plain", "chat-jsonl" or "sessions" (a SQLite file, or a Parquet table of messages)."""
    if format == "plain":
        return split_texts(plain_texts(spark, path))
    if format == "chat-jsonl":
        return split_texts(chat_messages(spark, path))
    if format == "sessions":
        return split_texts(session_texts(read_messages(spark, path, after, until, ["id", "role", "content", "active", "compacted"]), after, until))
    raise ValueError(f"no such corpus format: {format!r}")


def read_messages(spark: SparkSession, path: str, after: int | None = None, until: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """The messages table of a session store; columns that an older store lacks have their defaults (active, not compacted).

    Of SQLite only the rows with after < id <= until and the ``columns`` are read (others are null); of Parquet Spark finds out by itself."""
    from semloom.sources.sqlite import is_sqlite, read_sqlite

    found = read_sqlite(spark, path, "messages", "id", after=after, until=until, columns=columns) if is_sqlite(path) else spark.read.parquet(path)
    defaults = {"session_id": "", "tool_calls": None, "active": 1, "compacted": 0}
    types = dict(c.rsplit(" ", 1) for c in MESSAGES.split(", "))
    return found.select(*[(F.col(c) if c in found.columns else F.lit(defaults[c])).cast(t).alias(c) for c, t in types.items()])


def imported_facts(facts: DataFrame) -> DataFrame:
    """(content, trust) of another store's facts (content, trust_score): rows without content are left out; no trust, or 0, becomes 0.5."""
    trust = F.col("trust_score").cast("double")
    return facts.where(F.col("content").isNotNull()).select("content", F.when(trust.isNull() | (trust == 0), 0.5).otherwise(trust).alias("trust"))
