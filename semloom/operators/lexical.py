"""Full-text search: an inverted index with positions, the query language of SQLite's FTS5, and its bm25."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semloom.functions.kept import bounded, cut

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
LIMIT = 20
#: Terms of queries that are sent to every task at most.
ASKED = 1_000_000
#: Numbers of a table of terms by texts asked that is sent to every task at most (32 MB).
SENT = 1 << 22
#: Terms of documents that are put in order at a time; a longer document is a step of its own.
STEP = 1 << 18


class _Folding(dict):
    """For ``str.translate``: what each character folds to, found out once."""

    def __missing__(self, code: int) -> str:
        parts = unicodedata.normalize("NFD", chr(code))
        bare = [x for x in parts if unicodedata.category(x) != "Mn"]
        self[code] = bare[0] if len(parts) == 2 and len(bare) == 1 else chr(code)
        return self[code]


_folding = _Folding()


def fold_accents(text: str) -> str:
    """Lower case without the mark of letters that have one; letters with two keep theirs, as unicode61 has it."""
    return text.lower().translate(_folding)


def _folded(texts: pa.Array) -> pa.Array:
    return pa.array([t if t is None or t.isascii() else t.translate(_folding) for t in texts.to_pylist()], pa.string())


def terms(text: Column, fold: bool = True) -> Column:
    """Terms of a text: runs of letters and digits (and marks that stayed), lower case. ``fold``: without accents, through Arrow."""
    low = F.lower(text)
    if fold:  # only texts beyond ASCII go to Python
        low = F.coalesce(F.arrow_udf(_folded, "string")(F.when(F.octet_length(low) > F.length(low), low)), low)
    return F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}\p{Co}][\p{L}\p{N}\p{Co}\p{M}]*"), F.lit(0))


def query_terms(text: str) -> list[str]:
    out, word = [], ""
    for c in fold_accents(text) + " ":
        kind = unicodedata.category(c)
        if kind[0] in "LN" or kind == "Co" or (word and kind[0] == "M"):
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


class Index(NamedTuple):
    """postings: (term, id, tf, positions, length of the document); totals: one row (documents, average): their number and mean length.

    Postings stored in order of their terms are read where a query's terms are, by the statistics of the files' row groups."""

    postings: DataFrame
    totals: DataFrame


def _steps(size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows that have STEP terms together at most, or one row."""
    total, row = np.cumsum(size), 0
    while row < len(size):
        end = max(row + 1, int(np.searchsorted(total, (total[row - 1] if row else 0) + STEP, "right")))
        yield row, end
        row = end


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        sizes = pc.fill_null(pc.list_value_length(whole.column("terms")), 0).to_numpy()
        for start, end in _steps(sizes):
            batch, size = whole.slice(start, end - start), sizes[start:end]
            coded = batch.column("terms").flatten().dictionary_encode()
            codes = coded.indices.to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(size)), size)
            position = (np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
            key = row * (len(coded.dictionary) + 1) + codes
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0]) if len(key) else np.zeros(0, np.int64)
            border = np.r_[first, len(key)].astype(np.int32)
            yield pa.record_batch(
                [
                    coded.dictionary.take(pa.array(codes[order][first])).cast(pa.string()), batch.column("id").cast(pa.int64()).take(pa.array(row[order][first])),
                    pa.array(np.diff(border).astype(np.int64)), pa.ListArray.from_arrays(pa.array(border), pa.array(position[order])), pa.array(size[row[order][first]].astype(np.int32)),
                ],
                names=["term", "id", "tf", "positions", "length"],
            )


def build_index(docs: DataFrame, fold: bool = True) -> Index:
    """Of ``docs`` (id, text), one row an id. A document's postings are all in its row, so nothing is shuffled, and a worker holds those of a
    bounded batch."""
    split = bounded(docs).select("id", terms(F.col("text"), fold).alias("terms"))
    postings = split.mapInArrow(_postings, "term string, id bigint, tf bigint, positions array<int>, length int")
    return Index(postings, split.agg(F.count("*").alias("documents"), F.avg(F.size("terms")).alias("average")))


# the query language


class Phrase(NamedTuple):
    """Terms in a row; the last may be a beginning; ``initial``: at the text's start."""

    terms: tuple[str, ...]
    prefix: bool = False
    initial: bool = False


class Near(NamedTuple):
    phrases: tuple[Phrase, ...]
    distance: int


class And(NamedTuple):
    left: object
    right: object


class Or(NamedTuple):
    left: object
    right: object


class Not(NamedTuple):
    left: object
    right: object


class QueryError(ValueError):
    pass


_TOKEN = re.compile(r'\s*(?:(?P<string>"(?:[^"]|"")*")|(?P<bare>[A-Za-z0-9_\x1a\x80-\U0010ffff]+)|(?P<mark>[()*+^:,{}-]))')


class _Parser:
    """Precedence, tightest first: phrase, implicit AND, NOT, AND, OR."""

    def __init__(self, query: str, columns: tuple[str, ...]):
        self.columns, self.at, self.tokens = columns, 0, []
        i, end = 0, len(query.rstrip())
        while i < end:
            m = _TOKEN.match(query, i, end)
            if not m:
                raise QueryError(f"syntax error near {query[i:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            i = m.end()

    def peek(self, ahead: int = 0):
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else (None, "")

    def take(self):
        self.at += 1
        return self.peek(-1)

    def is_word(self, word: str) -> bool:
        return self.peek() == ("bare", word)

    def parse(self):
        tree = self.either()
        if self.at < len(self.tokens):
            raise QueryError(f"unexpected {self.peek()[1]!r}")
        return tree

    def either(self):
        tree = self.both()
        while self.is_word("OR"):
            self.take()
            tree = Or(tree, self.both())
        return tree

    def both(self):
        tree = self.without()
        while self.is_word("AND"):
            self.take()
            tree = And(tree, self.without())
        return tree

    def without(self):
        tree = self.several()
        while self.is_word("NOT"):
            self.take()
            tree = Not(tree, self.several())
        return tree

    def several(self):
        tree = self.one()
        while self.peek()[0] in ("string", "bare") and self.peek()[1] not in ("AND", "OR", "NOT") or self.peek() in (("mark", "^"), ("mark", "{"), ("mark", "-")) or self.peek() == ("mark", "("):
            if self.peek() == ("mark", "("):
                raise QueryError("a parenthesis needs an operator before it")
            tree = And(tree, self.one())
        return tree

    def one(self):
        kind, text = self.peek()
        if (kind, text) == ("mark", "("):
            self.take()
            tree = self.either()
            if self.take() != ("mark", ")"):
                raise QueryError("a parenthesis isn't closed")
            return tree
        if (kind, text) in (("mark", "-"), ("mark", "{")) or (kind in ("bare", "string") and self.peek(1) == ("mark", ":")):
            return self.column()
        if (kind, text) == ("bare", "NEAR") and self.peek(1) == ("mark", "("):
            return self.near()
        return self.phrase()

    def column(self):
        negative = self.peek() == ("mark", "-")
        if negative:
            self.take()
        names = []
        if self.peek() == ("mark", "{"):
            self.take()
            while self.peek() != ("mark", "}"):
                kind, name = self.take()
                if kind not in ("bare", "string"):
                    raise QueryError("a column name is missing")
                names.append(name.strip('"'))
            self.take()
        else:
            kind, name = self.take()
            if kind not in ("bare", "string"):
                raise QueryError("a column name is missing")
            names.append(name.strip('"'))
        if self.take() != ("mark", ":"):
            raise QueryError("a colon is missing")
        for n in names:
            if n.lower() not in self.columns:
                raise QueryError(f"no such column: {n}")
        tree = self.one()
        return Not(tree, tree) if negative else tree

    def near(self):
        self.take()
        self.take()
        phrases, distance = [], 10
        while self.peek() not in (("mark", ")"), ("mark", ",")):
            phrases.append(self.phrase())
        if self.take() == ("mark", ","):
            kind, number = self.take()
            if kind != "bare" or not number.isdigit() or self.take() != ("mark", ")"):
                raise QueryError("NEAR needs a number after the comma")
            distance = int(number)
        if not phrases:
            raise QueryError("NEAR needs phrases")
        return Near(tuple(phrases), distance)

    def phrase(self) -> Phrase:
        initial = self.peek() == ("mark", "^")
        if initial:
            self.take()
        found: list[str] = []
        while True:
            kind, text = self.take()
            if kind not in ("string", "bare") or (kind == "bare" and text in ("AND", "OR", "NOT")):
                raise QueryError("a phrase is missing")
            found += query_terms(text[1:-1].replace('""', '"') if kind == "string" else text)
            if self.peek() != ("mark", "+"):
                break
            self.take()
        prefix = self.peek() == ("mark", "*")
        if prefix:
            self.take()
        return Phrase(tuple(found), prefix, initial)


def parse(query: str, columns: tuple[str, ...] = ("content",)):
    """The tree of a query; QueryError if it isn't one."""
    return _Parser(query, columns).parse()


def phrases(tree) -> list[Phrase]:
    if isinstance(tree, Phrase):
        return [tree]
    if isinstance(tree, Near):
        return list(tree.phrases)
    return phrases(tree.left) + phrases(tree.right)


def _term(p: Phrase, i: int) -> Column:
    term = F.col("term")
    return term.startswith(p.terms[i]) if p.prefix and i == len(p.terms) - 1 else term == p.terms[i]


def _wanted(index: Index, found: list[Phrase]) -> DataFrame:
    """The postings of some phrases' terms, in one scan."""
    every = [(p, i) for p in found for i in range(len(p.terms))]
    if not every:
        return index.postings.limit(0)
    whole = sorted({p.terms[i] for p, i in every if not (p.prefix and i == len(p.terms) - 1)})
    condition = F.col("term").isin(whole) if whole else F.lit(False)
    for p, _ in every:
        if p.prefix:
            condition = condition | F.col("term").startswith(p.terms[-1])
    return index.postings.where(condition)


def occurrences(index: Index, found: list[Phrase]) -> DataFrame:
    """(id, length, s0, s1, ...): of the documents with any term of some phrases the places where each phrase begins. Each document's
    postings meet in one row; places are intersected there, shifted."""
    rows = _wanted(index, found)
    # of a beginning's several terms all places count
    places = [F.flatten(F.collect_list(F.when(_term(p, i), F.col("positions")))).alias(f"p{k}_{i}") for k, p in enumerate(found) for i in range(len(p.terms))]
    each = rows.groupBy("id").agg(F.first("length").alias("length"), *places)
    none = F.array().cast("array<int>")

    def less(i: int):
        return lambda x: x - i

    def starts(k: int, p: Phrase) -> Column:
        out = None
        for i in range(len(p.terms)):
            shifted = F.transform(f"p{k}_{i}", less(i))
            out = shifted if out is None else F.array_intersect(out, shifted)
        out = none if out is None else out
        return F.filter(out, lambda x: x == 0) if p.initial else out

    return each.select("id", "length", *[starts(k, p).alias(f"s{k}") for k, p in enumerate(found)])


def _widened(starts: str, n: int):
    """Each span with each of the places of a phrase of ``n`` terms taken in."""

    def widen(span: Column) -> Column:
        def with_place(s: Column) -> Column:
            return F.struct(
                F.least(span["low"], s).alias("low"),
                F.when(s < span["low"], s + n).otherwise(span["low_end"]).alias("low_end"),
                F.greatest(span["high"], s).alias("high"),
            )

        return F.transform(starts, with_place)

    return widen


def holds(tree, numbers: Iterator[int]) -> Column:
    """Whether a query's tree holds for a row of ``occurrences`` of its phrases; ``numbers`` counts them."""
    if isinstance(tree, Phrase):
        return F.size(f"s{next(numbers)}") > 0
    if isinstance(tree, Near):
        own = [next(numbers) for _ in tree.phrases]
        # some choice of one place each lies within the distance: the gap between the first's end and the last's start
        spans = F.transform(f"s{own[0]}", lambda s: F.struct(s.alias("low"), (s + len(tree.phrases[0].terms)).alias("low_end"), s.alias("high")))
        for k, p in zip(own[1:], tree.phrases[1:]):
            spans = F.flatten(F.transform(spans, _widened(f"s{k}", len(p.terms))))
        return F.exists(spans, lambda s: s["high"] - s["low_end"] <= tree.distance)
    left = holds(tree.left, numbers)
    right = holds(tree.right, numbers)
    return left & right if isinstance(tree, And) else left | right if isinstance(tree, Or) else left & ~right


def scored(index: Index, tree) -> DataFrame:
    """(id, score) of the matching documents, smaller is better: each of the query's phrases adds its part, wherever it stands.

    One scan of the postings and one shuffle of those asked for; how many documents have a phrase comes from the same rows."""
    found = phrases(tree)
    each = occurrences(index, found)
    counts = each.agg(*[F.coalesce(F.sum((F.size(f"s{k}") > 0).cast("bigint")), F.lit(0)).alias(f"n{k}") for k in range(len(found))])
    rows = each.where(holds(tree, iter(range(len(found))))).crossJoin(F.broadcast(counts)).crossJoin(F.broadcast(index.totals))
    score = F.lit(0.0)
    for k in range(len(found)):
        tf = F.size(f"s{k}")
        score = score + F.when(tf > 0, -_weight(F.col(f"n{k}")) * _saturated(tf)).otherwise(0.0)
    return rows.select("id", score.alias("score"))


def _weight(n: Column) -> Column:
    weight = F.log((F.col("documents") - n + 0.5) / (n + 0.5))
    return F.when(weight <= 0, LEAST_IDF).otherwise(weight)


def _saturated(tf: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("average")))


def search_any(index: Index, asked: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(item, id, score, rank) of the best documents for each of ``asked`` (item, text): as ``search`` for any of the text's terms, of
    which each occurrence adds its part. Up to ASKED terms asked for are sent to every task; more are joined."""
    from pyspark.sql import Window

    words = cut(asked.select("item", F.explode(terms(F.col("text"))).alias("term")).groupBy("item", "term").agg(F.count("*").alias("times")))
    words = F.broadcast(words) if words.limit(ASKED + 1).count() <= ASKED else words
    known = index.postings.select("term", "id", "tf", "length").join(words.select("term").distinct(), "term", "left_semi")
    weights = known.groupBy("term").agg(F.count("*").alias("n")).crossJoin(F.broadcast(index.totals)).select("term", "average", _weight(F.col("n")).alias("weight"))
    hits = known.join(weights, "term").join(words, "term")
    found = hits.groupBy("item", "id").agg(F.sum(-F.col("weight") * _saturated(F.col("tf")) * F.col("times")).alias("score"))
    place = F.row_number().over(Window.partitionBy("item").orderBy("score", "id")) - 1
    return found.withColumn("rank", place).where(F.col("rank") < limit)


def _rows(batches: Iterator[pa.RecordBatch], known: pa.Array, rows: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Some rows of (id, terms) at a time, their lengths, and how often each has each of the terms ``known``."""
    for whole in batches:
        sizes = pc.fill_null(pc.list_value_length(whole.column("terms")), 0).to_numpy().astype(np.int64)
        for start, end in ((i, j) for a, b in _steps(sizes) for i in range(a, b, rows) for j in (min(i + rows, b),)):
            batch, size = whole.slice(start, end - start), sizes[start:end]
            code = pc.fill_null(pc.index_in(batch.column("terms").flatten(), value_set=known), -1).to_numpy()
            cell = (np.repeat(np.arange(len(size)), size) * len(known) + code)[code >= 0]
            yield batch, size, np.bincount(cell, minlength=len(size) * len(known)).reshape(len(size), len(known))


def _having(known: pa.Array):
    """(term, n, length): how many documents have each term; under a null term how many there are, and their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, documents, length = np.zeros(len(known), np.int64), 0, 0
        for _, size, tf in _rows(batches, known, 1024):
            n, documents, length = n + (tf > 0).sum(0), documents + len(size), length + int(size.sum())
        yield pa.record_batch([pa.array([*known.to_pylist(), None], pa.string()), pa.array([*n.tolist(), documents]), pa.array([0] * len(known) + [length])], names=["term", "n", "length"])

    return run


def _best_scored(sent, limit: int):
    """(item, id, score) of a task's best documents for each text asked. A product of matrices tells which may be among them; those are summed
    again term by term, so that equal documents have equal scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, items, factor, average = sent.value  # factor: (terms x items)
        of = [np.flatnonzero(f) for f in factor.T]
        ids, scores = [np.zeros(0, np.int64) for _ in items], [np.zeros(0) for _ in items]
        least = np.zeros(len(items))
        for batch, size, tf in _rows(batches, known, 1024):
            part = tf * (K1 + 1) / (tf + (K1 * (1 - B + B * size / average))[:, None])
            about = part @ factor
            may = (about > 0) & (about > least * (1 - 1e-9))
            number = batch.column("id").cast(pa.int64()).to_numpy()
            for i in np.flatnonzero(may.any(0)):
                rows = np.flatnonzero(may[:, i])
                value = (part[rows][:, of[i]] * factor[of[i], i]).sum(1)
                value, who = np.r_[scores[i], value], np.r_[ids[i], number[rows]]
                best = np.lexsort((who, -value))[:limit]
                scores[i], ids[i] = value[best], who[best]
                if len(best) == limit:
                    least[i] = scores[i][-1]
        count = [len(x) for x in ids]
        yield pa.record_batch([pa.array(np.repeat(items, count)), pa.array(np.concatenate([*ids, np.zeros(0, np.int64)])), pa.array(-np.concatenate([*scores, np.zeros(0)]))], names=["item", "id", "score"])

    return run


def search_texts(docs: DataFrame, asked: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``search_any`` of an index of ``docs`` (id, text) that isn't stored: two scans of the documents, the first for how many have each
    term. Of each text asked a task keeps the best, so no pairs of texts and documents are shuffled. If there are more terms and texts than
    SENT allows, an index is joined."""
    from pyspark.sql import Window

    words = cut(asked.select(F.col("item").cast("bigint").alias("item"), F.explode(terms(F.col("text"))).alias("term")).groupBy("item", "term").agg(F.count("*").alias("times")))
    n_items, n_terms = words.agg(F.count_distinct("item"), F.count_distinct("term")).head()
    if n_items * n_terms > SENT:
        return search_any(build_index(docs), asked, limit)
    rows = words.toArrow()
    known, items = rows["term"].combine_chunks().unique().sort(), np.unique(rows["item"].to_numpy())
    split = bounded(docs).select("id", terms(F.col("text")).alias("terms"))
    counts = split.mapInArrow(_having(known), "term string, n bigint, length bigint").groupBy("term").agg(F.sum("n").alias("n"), F.sum("length").alias("length")).collect()
    n = {r["term"]: r["n"] for r in counts}
    documents, length = next(((r["n"], r["length"]) for r in counts if r["term"] is None), (0, 0))
    weight = np.array([max(np.log((documents - k + 0.5) / (k + 0.5)), 0.0) or LEAST_IDF for k in (n.get(t, 0) for t in known.to_pylist())])
    factor = np.zeros((len(known), len(items)))
    at = pc.index_in(rows["term"], value_set=known).to_numpy()
    factor[at, np.searchsorted(items, rows["item"].to_numpy())] = rows["times"].to_numpy() * weight[at]
    sent = docs.sparkSession.sparkContext.broadcast((known, items, factor, length / documents if length else 1.0))
    found = split.mapInArrow(_best_scored(sent, limit), "item bigint, id bigint, score double")
    place = F.row_number().over(Window.partitionBy("item").orderBy("score", "id")) - 1
    return found.withColumn("rank", place).where(F.col("rank") < limit)


def search(index: Index, query: str, limit: int = LIMIT, sanitize: bool = False) -> DataFrame:
    """(id, score, rank) of the best documents; of equal scores the smaller id first. A query that isn't one finds nothing, unless
    ``sanitize`` has it tried again with blanks for all but ASCII letters and digits."""
    try:
        tree = parse(query)
    except QueryError:
        clean = re.sub(r"[^a-zA-Z0-9\s]", " ", query).strip()
        if sanitize and clean and clean != query:
            return search(index, clean, limit)
        return index.postings.sparkSession.createDataFrame([], "id bigint, score double, rank int")
    from semloom.operators.encoding import ranked

    top = scored(index, tree).orderBy("score", "id").limit(limit)
    return ranked(top, [F.asc("score"), F.asc("id")])
