"""Quality and toxicity of documents by histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytes_text as bt
from . import storage

#: Labelled rows fitted on at most (those of least hash), and bytes of their texts.
SAMPLE, SAMPLE_BYTES = 4000, 64 << 20
#: A word, or a beginning of so many bytes of a longer word, is in the toxic lexicon if it is in so many and in such a share of the
#: sample's toxic documents, and so many times as frequent among their words as among the others'.
LEXICON_MIN, LEXICON_SHARE, LEXICON_RATIO, PREFIXES = 3, 0.01, 8.0, (4, 5, 6, 7, 8)
TREES, DEPTH, BINS, RATE, L2, MIN_HESSIAN = 80, 4, 64, 0.15, 1.0, 1.0
SCHEMA = "quality double, toxicity double, keep boolean"

_CLASS = np.zeros(256, np.uint8)
_CLASS[33:127] = 10
_CLASS[[*range(97, 123)]] = 1
_CLASS[[*range(65, 91)]] = 2
_CLASS[[*range(48, 58)]] = 3
_CLASS[[9, 13, 32]] = 4
_CLASS[10] = 5
for _k, _s in ((6, b".,;:"), (7, b"!?"), (8, b"#$%&*"), (9, b"|")):
    _CLASS[list(_s)] = _k
_CLASS[128:] = 11
STATISTICS = (
    "log_bytes log_words word_length upper digit space newline stop_mark exclamation symbol bar other_mark non_ascii distinct_words "
    "top_word repeated_word capital_word symbols_per_word words_per_line distinct_lines longest_word toxic_words toxic_share"
).split()


class Model(NamedTuple):
    """Two boosted ensembles as arrays: [head, tree, node] splits of complete trees, [head, tree, leaf] values."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    bias: np.ndarray
    lexicon: np.ndarray


def _entries(low: np.ndarray, s: np.ndarray, e: np.ndarray, h: np.ndarray):
    """(word indices, hashes) of the words, then of their beginnings of each length."""
    yield np.arange(len(s)), h
    for n in PREFIXES:
        longer = np.flatnonzero(e - s > n)
        yield longer, bt.span_hashes(low, s[longer], s[longer] + n)


def statistics(column: pa.Array, lexicon: np.ndarray) -> np.ndarray:
    """Texts x STATISTICS, float64. Whole texts; empty ones give zeros."""
    out = np.zeros((len(column), len(STATISTICS)))
    for i, j, b, off in bt.steps(column):
        n, size = j - i, np.diff(off)
        count = np.bincount(np.repeat(np.arange(n) * 12, size) + _CLASS[b], minlength=12 * n).reshape(n, 12).astype(float)
        low = bt.lower(b)
        s, e, doc = bt.words(bt.ALNUM[b], off)
        h = bt.span_hashes(low, s, e)
        words = np.bincount(doc, minlength=n).astype(float)
        some, lines = np.maximum(words, 1), np.maximum(size, 1)
        key = np.sort((doc.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
        of, times = (key[first] >> np.uint64(44)).astype(int), np.diff(np.r_[first, len(key)])
        distinct, top, longest = np.bincount(of, minlength=n), np.zeros(n), np.zeros(n)
        if len(of):
            begins = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            top[of[begins]] = np.maximum.reduceat(times, begins)
            w0 = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            longest[doc[w0]] = np.maximum.reduceat(e - s, w0)
        again = np.flatnonzero((h[1:] == h[:-1]) & (doc[1:] == doc[:-1])) + 1
        caps = np.r_[0, np.cumsum((b >= 65) & (b <= 90))]
        capital = (caps[e] - caps[s] >= e - s) & (e - s > 1)
        ls, le, ld = bt.words(b != 10, off)
        line = np.unique((ld.astype(np.uint64) << np.uint64(44)) | (bt.span_hashes(b, ls, le) >> np.uint64(20)))
        n_lines = np.maximum(np.bincount(ld, minlength=n), 1)
        toxic = np.zeros(len(s), bool)
        if len(lexicon):
            for at, entry in _entries(low, s, e, h):
                toxic[at[lexicon[np.minimum(np.searchsorted(lexicon, entry), len(lexicon) - 1)] == entry]] = True
        hits = np.bincount(doc[toxic], minlength=n)
        r = count / lines[:, None]
        out[i:j] = np.column_stack(
            [np.log1p(size), np.log1p(words), np.bincount(doc, e - s, n) / some, r[:, 2], r[:, 3], r[:, 4], r[:, 5], r[:, 6], r[:, 7], r[:, 8], r[:, 9], r[:, 10], r[:, 11], distinct / some, top / some]
            + [np.bincount(doc[again], minlength=n) / some, np.bincount(doc, capital, n) / some, count[:, 8] / some, words / n_lines, np.bincount((line >> np.uint64(44)).astype(int), minlength=n) / n_lines, longest, hits, hits / some]
        )
    return out


def toxic_lexicon(column: pa.Array, toxic: np.ndarray) -> np.ndarray:
    """Sorted hashes of the words and beginnings of words that mark toxic texts of a sample."""
    found, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, _, b, off in bt.steps(column):
        low = bt.lower(b)
        s, e, doc = bt.words(bt.ALNUM[b], off)
        for at, entry in _entries(low, s, e, bt.span_hashes(low, s, e)):
            found.append(entry)
            docs.append(doc[at] + i)
    seen, back = np.unique(np.concatenate(found), return_inverse=True)
    doc = np.concatenate(docs)
    n, bad = len(seen), toxic[doc] > 0
    occurs = [np.bincount(back[m], minlength=n) for m in (bad, ~bad)]
    once = np.unique(back[bad] * len(toxic) + doc[bad]) // max(1, len(toxic))
    inside = np.bincount(once, minlength=n)
    rate = occurs[0] / max(1, bad.sum()) >= LEXICON_RATIO * (occurs[1] + 0.5) / max(1, (~bad).sum())
    return seen[(inside >= max(LEXICON_MIN, LEXICON_SHARE * (toxic > 0).sum())) & rate]


def boost(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Logistic gradient boosting over quantile histograms: (feature, threshold, value, bias)."""
    n, k = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(k)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f]) for f in range(k)], 1)  # bin i holds edges[i-1] < v <= edges[i]
    cells = binned + np.arange(k) * BINS
    inner = 2**DEPTH - 1
    feature, threshold, value = np.zeros((TREES, inner), np.int32), np.full((TREES, inner), np.inf), np.zeros((TREES, inner + 1))
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(p / (1 - p)))
    raw = np.full(n, bias)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, int)
        for level in range(DEPTH):
            wide, base = 2**level, 2**level - 1
            at = ((node - base)[:, None] * (k * BINS) + cells).ravel()
            gs, hs = (np.bincount(at, np.repeat(v, k), wide * k * BINS).reshape(wide, k, BINS).cumsum(2) for v in (g, h))
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + L2) + (gt - gs) ** 2 / (ht - hs + L2) - gt**2 / (ht + L2)
            gain[(hs < MIN_HESSIAN) | (ht - hs < MIN_HESSIAN)] = 0
            best = gain.reshape(wide, -1).argmax(1)
            for w in range(wide):
                f, c = divmod(int(best[w]), BINS)
                if gain[w, f, c] > 1e-9 and c < len(edges[f]):
                    feature[t, base + w], threshold[t, base + w] = f, edges[f][c]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        leaf = node - inner
        value[t] = RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + L2)
        raw += value[t][leaf]
    return feature, threshold, value, bias


def traverse(model: Model, head: int, x: np.ndarray) -> np.ndarray:
    """Probabilities for the rows of ``x``: all trees step down a level at a time, over arrays."""
    out = np.empty(len(x))
    feature, threshold, value = model.feature[head], model.threshold[head], model.value[head]
    trees = np.arange(feature.shape[0])
    for at in range(0, len(x), 2048):
        rows = x[at : at + 2048]
        node = np.zeros((len(rows), len(trees)), np.int32)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (np.take_along_axis(rows, feature[trees, node], 1) > threshold[trees, node])
        out[at : at + 2048] = model.bias[head] + value[trees, node - feature.shape[1]].sum(1)
    return 1 / (1 + np.exp(-out))


def fit_texts(column: pa.Array, quality: np.ndarray, toxic: np.ndarray) -> Model:
    """The lexicon, then both heads over the statistics with it."""
    lexicon = toxic_lexicon(column, toxic)
    x = statistics(column, lexicon)
    heads = [boost(x, y.astype(float)) for y in (quality, toxic)]
    return Model(*(np.stack([np.asarray(h[k]) for h in heads]) for k in range(4)), lexicon)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit on at most ``sample`` labelled documents of ``docs``, those whose doc_id has the least hash, and at most SAMPLE_BYTES of text;
    None if there are none.

    Rows of ``labels`` (doc_id, quality, toxic) with a null, or without a document, are left out; of repeated ones one counts."""
    there = docs.select("doc_id").where("doc_id IS NOT NULL")
    known = labels.select("doc_id", "quality", "toxic").dropna().join(there, "doc_id", "left_semi")
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    chosen = storage.cut(known.withColumn("place", F.xxhash64("doc_id")).orderBy("place", "doc_id").limit(sample))
    rows = storage.sampled(docs, chosen, ["doc_id"], SAMPLE_BYTES)
    if not rows.num_rows:
        return None
    return fit_texts(bt.to_string(rows["text"]), rows["quality"].to_numpy(), rows["toxic"].to_numpy())


def score(column: pa.Array, model: Model | None) -> pa.Array:
    valid = column.is_valid()
    texts = bt.to_string(column)
    x = statistics(texts, model.lexicon if model else np.zeros(0, np.uint64))
    some = x[:, STATISTICS.index("log_words")] > 0
    if model is None:
        null = pa.nulls(len(column), pa.float64())
        return pa.StructArray.from_arrays([null, null, pa.array(some)], ["quality", "toxicity", "keep"])
    good, bad = traverse(model, 0, x), traverse(model, 1, x)
    missing = ~valid.to_numpy(zero_copy_only=False)
    return pa.StructArray.from_arrays([pa.array(good, mask=missing), pa.array(bad, mask=missing), pa.array(some & (good >= 0.5) & (bad < 0.5))], ["quality", "toxicity", "keep"])


def scored(text: str, model: Model | None) -> Column:
    """A struct column (quality, toxicity, keep) of the text column."""

    def run(column: pa.Array) -> pa.Array:
        return score(column, model)

    return F.arrow_udf(run, SCHEMA)(F.col(text))


def classify_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, quality, toxicity, keep) for each row of ``docs`` (doc_id, text), without a shuffle of the texts.

    ``quality`` and ``toxicity`` are probabilities; keep: quality is at least 0.5, toxicity is less, and there is a word. Null
    text: null scores, not kept. Empty or blank text: scores of its (zero) statistics, not kept. Repeated rows and a null doc_id:
    a row each. An empty ``docs`` gives no rows; without usable labels scores are null and every text with a word is kept.
    Columns but these are not looked at.
    """
    model = fit(storage.bounded(docs), labels, sample)
    return docs.select(F.col("doc_id"), scored("text", model).alias("scores")).select("doc_id", "scores.quality", "scores.toxicity", "scores.keep")


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` (doc_id, text) that ``classify_documents`` keeps, with all their columns, whatever their names.

    Rows of null, empty or blank text go; a null doc_id doesn't matter; of repeated rows all stay or none. An empty table gives no rows."""
    return docs.where(scored("text", fit(storage.bounded(docs), labels, sample))["keep"])
