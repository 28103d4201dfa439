"""Word-level language identification by a linear-chain conditional random field.

A word's score for each language sums learned weights of its affixes, its character n-grams (over bytes, word borders included)
and its lexicon entry; a learned matrix scores the passage from one word's language to the next. Forward-backward gives each
word's probabilities within its whole text, so that words of a code-switched text are labelled in context.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bytes_text as bt
from . import storage

#: Documents per language that the model is fitted on at most (those of least hash), the bytes of all of them, and the code-switched word
#: runs made of them, for each language.
SAMPLE, SAMPLE_BYTES, RUNS = 300, 64 << 20, 1500
EPOCHS, RATE, L2 = 60, 0.5, 1e-4
LEXICON = 256
GRAM_BITS, AFFIX_BITS, AFFIX = 16, 15, 3
#: Words that one forward-backward block steps over; texts are cut into such blocks and joined again exactly.
CHUNK = 32
#: A document is kept if its main language has at least this share of the words' probability.
MIN_SHARE = 0.5
SCHEMA = "lang string, share double, confidence double, n_words int, n_switches int, spans array<struct<start:int,end:int,lang:string>>"


class Model(NamedTuple):
    labels: list[str]
    grams: np.ndarray  # [order 2 or 3, language, hash]
    affixes: np.ndarray  # [prefix or suffix, language, hash]
    lexicon: np.ndarray  # sorted word hashes
    entries: np.ndarray  # [language, word of the lexicon or other]
    transition: np.ndarray  # [from, to]


class Words(NamedTuple):
    """Feature indices of the words of some texts."""

    text: np.ndarray
    bounds: tuple[np.ndarray, np.ndarray]  # of each word's bigrams and trigrams
    grams: tuple[np.ndarray, np.ndarray]  # by byte
    affixes: tuple[np.ndarray, np.ndarray]
    entry: np.ndarray
    hashes: np.ndarray


def features(b: np.ndarray, off: np.ndarray, lexicon: np.ndarray) -> Words:
    """Of texts that each end in a blank."""
    low = np.where(bt.ALNUM[b], bt.lower(b), np.uint8(32))
    s, e, text = bt.words(low != 32, off)
    h = bt.span_hashes(low, s, e)
    x = np.r_[np.uint8(32), low, np.uint8(32), np.uint8(32)].astype(np.uint32)  # x[i + 1] is low[i]
    two = (x[:-2] << 8) | x[1:-1]
    three = ((((x[:-2] << 16) | (x[1:-1] << 8) | x[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - GRAM_BITS)).astype(np.int32)
    tri = lambda at: (((x[at + 1] << 16) | (x[at + 2] << 8) | x[at + 3]) * np.uint32(0x85EBCA77)) >> np.uint32(32 - AFFIX_BITS)
    long = e - s >= AFFIX
    affixes = tuple(np.where(long, tri(np.where(long, at, 0)), 0).astype(np.int32) for at in (s, e - AFFIX))
    entry = np.full(len(h), len(lexicon))
    if len(lexicon):
        at = np.minimum(np.searchsorted(lexicon, h), len(lexicon) - 1)
        entry = np.where(lexicon[at] == h, at, len(lexicon))
    # x begins a byte earlier: the windows that touch a word [s, e) begin at s (the border before it) and end before e + 1
    bounds = tuple(np.stack([s, e + 1 - k], 1).ravel() for k in (0, 1))
    return Words(text, bounds, (two.astype(np.int32), three), affixes, entry, h)


def emissions(model: Model, w: Words) -> np.ndarray:
    """(words x languages)."""
    n, k = len(w.text), len(model.labels)
    out = np.empty((n, k))
    if n:
        for c in range(k):
            total = model.entries[c][w.entry].astype(np.float64)
            for which in (0, 1):
                total += model.affixes[which, c][w.affixes[which]]
                total += np.add.reduceat(model.grams[which, c][w.grams[which]], w.bounds[which])[::2]
            out[:, c] = total
    return out


def forward_backward(scores: np.ndarray, text: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward messages of each word, each row scaled to sum 1 (their product is in proportion to the marginals).

    ``text`` (non-decreasing) tells the chains apart. Each chain is cut into blocks of CHUNK words. A block's effect on a message is
    a matrix, found for all blocks at once; messages pass over whole blocks, then inside all blocks at once."""
    n, k = scores.shape
    if not n:
        return scores, scores
    step = np.exp(transition - transition.max())
    local = np.exp(scores - scores.max(1, keepdims=True)) + 1e-30
    first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    length = np.diff(np.r_[first, n])
    blocks = -(-length // CHUNK)
    chain = np.repeat(np.arange(len(first)), blocks)
    number = np.arange(len(chain)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    start = first[chain] + number * CHUNK
    size = np.minimum(CHUNK, length[chain] - number * CHUNK)
    order = np.argsort(-size, kind="stable")
    start, size, chain, number = start[order], size[order], chain[order], number[order]
    active = [int(np.searchsorted(-size, -t, "left")) for t in range(CHUNK)]  # blocks of more than t words

    through = np.empty((len(start), k, k))
    through[:] = np.where((number == 0)[:, None, None], 1.0 / k, step) * local[start][:, None, :]
    for t in range(1, CHUNK):
        if not (m := active[t]):
            break
        part = (through[:m].reshape(-1, k) @ step).reshape(m, k, k) * local[start[:m] + t][:, None, :]
        through[:m] = part / part.sum((1, 2), keepdims=True)

    place = np.empty(len(chain), int)  # block number j of chain c is at place[base[c] + j]
    base = np.cumsum(blocks) - blocks
    place[base[chain] + number] = np.arange(len(chain))
    into, outof = np.full((len(start), k), 1.0 / k), np.full((len(start), k), 1.0 / k)
    longest = np.argsort(-blocks, kind="stable")
    many = -blocks[longest]
    for j in range(1, int(blocks.max())):
        c = longest[: np.searchsorted(many, -j, "left")]  # chains of more than j blocks
        before = place[base[c] + j - 1]
        a = np.einsum("ci,cij->cj", into[before], through[before])
        into[place[base[c] + j]] = a / a.sum(1, keepdims=True)
        here = place[base[c] + blocks[c] - j]
        a = np.einsum("cij,cj->ci", through[here], outof[here])
        outof[place[base[c] + blocks[c] - j - 1]] = a / a.sum(1, keepdims=True)

    forward, backward = np.empty((n, k)), np.empty((n, k))
    a = np.where((number == 0)[:, None], 1.0 / k, into @ step)
    for t in range(CHUNK):
        if not (m := active[t]):
            break
        a = (a[:m] if t == 0 else a[:m] @ step) * local[start[:m] + t]
        a /= a.sum(1, keepdims=True)
        forward[start[:m] + t] = a
    message = outof.copy()
    for t in range(CHUNK - 1, -1, -1):
        m = active[t]
        at = start[:m] + t
        backward[at] = message[:m]
        a = (local[at] * message[:m]) @ step.T
        message[:m] = a / a.sum(1, keepdims=True)
    return forward, backward


def marginals(scores: np.ndarray, text: np.ndarray, transition: np.ndarray) -> np.ndarray:
    forward, backward = forward_backward(scores, text, transition)
    p = forward * backward
    return p / p.sum(1, keepdims=True) if len(p) else p


def _mixed(column: pa.Array, labels: np.ndarray, rng: np.random.Generator) -> tuple[pa.Array, list[np.ndarray]]:
    """Sequences of runs of words of the labelled texts, every other one in two or more languages: (texts, label of each word)."""
    texts, spans = [t.encode() for t in column.to_pylist()], []
    for t in texts:
        b = np.frombuffer(t, np.uint8)
        s, e, _ = bt.words(bt.ALNUM[b], np.array([0, len(b)]))
        spans.append((s, e))
    usable = [i for i, (s, _) in enumerate(spans) if len(s)]
    by = {c: [i for i in usable if labels[i] == c] for c in np.unique(labels[usable])}
    out, tags, made = [], [], 0
    while made < RUNS * len(by):
        pieces, tag, one = [], [], rng.choice(list(by))
        mixed = rng.random() < 0.5
        for _ in range(int(rng.integers(1, 6))):
            c = rng.choice(list(by)) if mixed else one
            i = by[c][int(rng.integers(len(by[c])))]
            s, e = spans[i]
            n = int(min(len(s), rng.integers(2, 26)))
            at = int(rng.integers(len(s) - n + 1))
            pieces.append(texts[i][s[at] : e[at + n - 1]])
            tag += [c] * n
            made += 1
        out.append(b" ".join(pieces).decode("utf-8", "replace") + " ")
        tags.append(np.array(tag))
    return pa.array(out, pa.large_string()), tags


def gradient(model: Model, w: Words, y: np.ndarray) -> list[np.ndarray]:
    """Of the log-likelihood of the words' labels ``y``: by grams, affixes, lexicon and transitions, observed less expected counts."""
    k = len(model.labels)
    word_of = [np.repeat(np.arange(len(y)), np.diff(v.reshape(-1, 2), axis=1).ravel()) for v in w.bounds]
    gram_of = [g[np.concatenate([np.arange(a, z) for a, z in v.reshape(-1, 2)])] for g, v in zip(w.grams, w.bounds)]
    inner = np.flatnonzero(w.text[1:] == w.text[:-1])
    scores = emissions(model, w)
    forward, backward = forward_backward(scores, w.text, model.transition)
    p = forward * backward
    p /= p.sum(1, keepdims=True)
    d = np.eye(k)[y] - p
    after = np.exp(scores - scores.max(1, keepdims=True)) * backward
    pair = forward[inner][:, :, None] * np.exp(model.transition) * after[inner + 1][:, None, :]
    out = [np.zeros(t.shape) for t in (model.grams, model.affixes, model.entries)]
    for c in range(k):
        for o in (0, 1):
            out[0][o, c] = np.bincount(gram_of[o], d[word_of[o], c], 1 << GRAM_BITS)
            out[1][o, c] = np.bincount(w.affixes[o], d[:, c], 1 << AFFIX_BITS)
        out[2][c] = np.bincount(w.entry, d[:, c], model.entries.shape[1])
    observed = np.bincount(y[inner] * k + y[inner + 1], minlength=k * k).reshape(k, k)
    return [*out, observed - (pair / pair.sum((1, 2), keepdims=True)).sum(0)]


def fit_texts(column: pa.Array, langs: list[str], seed: int = 7) -> Model | None:
    """Maximum likelihood on code-switched sequences made of texts of known language, by AdaGrad over full gradients."""
    labels = sorted(set(langs))
    if not labels:
        return None
    y_text = np.searchsorted(labels, langs)
    k, rng = len(labels), np.random.default_rng(seed)
    texts, tags = _mixed(column, y_text, rng)
    if not tags:
        return None
    b, off = bt.buffers(texts)
    w = features(b, off, np.zeros(0, np.uint64))
    y = np.concatenate(tags)
    seen, back = np.unique(w.hashes, return_inverse=True)
    lexicon = np.unique(np.concatenate([seen[np.lexsort((seen, -np.bincount(back[y == c], minlength=len(seen))))][:LEXICON] for c in range(k)]))
    w = features(b, off, lexicon)
    model = Model(labels, np.zeros((2, k, 1 << GRAM_BITS), np.float32), np.zeros((2, k, 1 << AFFIX_BITS), np.float32), lexicon, np.zeros((k, len(lexicon) + 1), np.float32), np.zeros((k, k)))
    tables = [model.grams, model.affixes, model.entries, model.transition]
    squares = [np.full(t.shape, 1e-2) for t in tables]
    for _ in range(EPOCHS):
        for t, g, q in zip(tables, gradient(model, w, y), squares):
            g -= L2 * len(y) * t
            q += g**2
            t += (RATE * g / np.sqrt(q)).astype(t.dtype)
    return model


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit on at most ``sample`` documents of each value of ``lang``, those whose doc_id has the least hash, and at most SAMPLE_BYTES of
    text; None if none has one.

    The ids are found first, over doc_id and lang alone; then only those texts are fetched."""
    known = docs.select("doc_id", "lang").where("doc_id IS NOT NULL AND lang IS NOT NULL").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = storage.cut(known.withColumn("place", rank).where(F.col("place") <= sample))
    rows = storage.sampled(docs, chosen, ["doc_id", "lang"], SAMPLE_BYTES)
    return fit_texts(bt.to_string(rows["text"]), rows["lang"].to_pylist())


def label_batch(column: pa.Array, model: Model | None) -> pa.Array:
    names = ["lang", "share", "confidence", "n_words", "n_switches", "spans"]
    n = len(column)
    texts = pc.binary_join_element_wise(bt.to_string(column), pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string()))
    missing = ~column.is_valid().to_numpy(zero_copy_only=False)
    lang, share, sure, words, switches = np.full(n, -1), np.zeros(n), np.zeros(n), np.zeros(n, np.int32), np.zeros(n, np.int32)
    starts, ends, tags, spans = [], [], [], np.zeros(n, np.int64)
    k = len(model.labels) if model else 0
    for i, j, b, off in bt.steps(texts):
        m = j - i
        if not model:
            words[i:j] = np.bincount(bt.words(bt.ALNUM[b], off)[2], minlength=m)
            continue
        w = features(b, off, model.lexicon)
        if not len(w.text):
            continue
        p = marginals(emissions(model, w), w.text, model.transition)
        best = p.argmax(1)
        count = np.bincount(w.text, minlength=m)
        total = np.stack([np.bincount(w.text, p[:, c], m) for c in range(k)], 1)
        words[i:j] = count
        lang[i:j] = np.where(count > 0, total.argmax(1), -1)
        share[i:j] = total.max(1) / np.maximum(count, 1)
        sure[i:j] = np.bincount(w.text, p.max(1), m) / np.maximum(count, 1)
        new_text = np.r_[True, w.text[1:] != w.text[:-1]]
        turn = new_text | np.r_[True, best[1:] != best[:-1]]
        at = np.flatnonzero(turn)
        origin = np.repeat(np.flatnonzero(new_text), count[count > 0])
        starts.append(at - origin[at])
        ends.append(np.r_[at[1:], len(best)] - origin[at])
        tags.append(best[at])
        spans[i:j] = np.bincount(w.text[at], minlength=m)
        switches[i:j] = np.maximum(spans[i:j] - 1, 0)
    names_of = pa.array(model.labels if model else [], pa.string())
    cat = lambda v: np.concatenate(v).astype(np.int32) if v else np.zeros(0, np.int32)
    inner = pa.StructArray.from_arrays([pa.array(cat(starts)), pa.array(cat(ends)), names_of.take(pa.array(cat(tags)))], ["start", "end", "lang"])
    border = pa.array(np.r_[0, np.cumsum(spans)].astype(np.int32))
    unknown = missing | (lang < 0)
    columns = [
        names_of.take(pa.array(np.maximum(lang, 0), mask=unknown)) if model else pa.nulls(n, pa.string()),
        pa.array(share, mask=unknown), pa.array(sure, mask=unknown), pa.array(words, mask=missing), pa.array(switches, mask=missing),
        pa.ListArray.from_arrays(border, inner, mask=pa.array(missing)),
    ]
    return pa.StructArray.from_arrays(columns, names)


def labelled(text: str, model: Model | None) -> Column:
    """A struct column of the text column: main language, its share, mean confidence, numbers of words and switches, spans."""

    def run(column: pa.Array) -> pa.Array:
        return label_batch(column, model)

    return F.arrow_udf(run, SCHEMA)(F.col(text))


def identify_languages(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, lang, share, confidence, n_words, n_switches, spans, keep) for each row of ``docs`` (doc_id, text, lang).

    The input's ``lang`` is only used to fit. ``spans`` are the runs of words of one language, [start, end) in words, over the whole
    text; ``share`` is the main language's mean probability over the words. keep: the share is at least MIN_SHARE. Null text: null in
    all but doc_id, not kept. A text without words: null lang, share and confidence, no spans, not kept. Repeated rows and a null
    doc_id: a row each. An empty table gives no rows; if no row has a lang, lang is null and every text with a word is kept.
    Columns but these are not looked at.
    """
    model = fit(storage.bounded(docs), sample)
    found = docs.select("doc_id", labelled("text", model).alias("found"))
    return found.select("doc_id", "found.*", _keep("found", model).alias("keep"))


def _keep(found: str, model: Model | None) -> Column:
    good = F.col(f"{found}.share") >= MIN_SHARE if model else F.col(f"{found}.n_words") > 0
    return F.coalesce(good, F.lit(False))


def keep_identified(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang) that ``identify_languages`` keeps, with all their columns, whatever their names.

    Rows of null text and of text without words go; a null doc_id doesn't matter; of repeated rows all stay or none. An empty table gives no
    rows. If no row has a lang, all with a word stay."""
    model = fit(storage.bounded(docs), sample)

    def run(column: pa.Array) -> pa.Array:
        found = label_batch(column, model)
        share, words = found.field(1).to_numpy(zero_copy_only=False), found.field(3).to_numpy(zero_copy_only=False)
        return pa.array(np.nan_to_num(share) >= MIN_SHARE if model else np.nan_to_num(words) > 0)

    return docs.where(F.arrow_udf(run, "boolean")(F.col("text")))
