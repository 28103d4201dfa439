"""Token counts of a unigram tokenizer, by Viterbi over counts and scores only.

An Aho-Corasick automaton enumerates the vocabulary's matches; dynamic programming carries the best score and its number of tokens
to each position. No segmentation is kept.

Scores add up as SentencePiece's unigram encoder has them, which decides ties: sums are kept in single precision; a candidate is compared
unrounded, and replaces an earlier one only if it is better; where the best sum at a character lies beyond +-LIMIT it is subtracted from
all sums that the text has by then, rounded again. So what a unit (see ``unigram``) does to a text's sum depends on the sum before it.
"""

from __future__ import annotations

import struct
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytes_text as bt
from .storage import bounded
from .unigram import MODEL, load, units

#: Units, and results for a unit after some sum, that a worker keeps; when there are more it starts anew, which only costs time.
CACHE = 250_000
LIMIT = 100_000
#: Units solved at once, and how long they may be; longer ones are solved one by one.
AT_ONCE, LONGEST = 8192, 40
_BETWEEN = "\ue000"  # for private use
SCHEMA = "doc_id bigint, n_tokens bigint, score double"
_single = struct.Struct("f")


def _float32(x: float) -> float:
    return _single.unpack(_single.pack(x))[0]


class Encoder:
    """What one unit does to a text's sum: ``solve`` gives (tokens, score, sum after it) from the sum before it, which is within LIMIT.

    With whole-number scores, of which the lowest (``low``) is the only one that single precision rounds in sums with the others, a unit that
    begins with a piece of that score depends only on what the sum before it is rounded by. ``lost`` has that, -32 to 32, by the sum's
    last 7 bits; otherwise it is None. Then ``solve_many`` finds what most units do, whatever the sum before them, all at once."""

    def __init__(self, path: str):
        vocabulary = load(path)
        scores = {_float32(s) for _, s in vocabulary.pieces.values()}
        self.low = min(scores)
        self.unknown = _float32(self.low - 10)
        whole = all(s == int(s) for s in scores | {self.unknown})
        number = int if whole else float
        self.low, self.unknown = number(self.low), number(self.unknown)
        self.pieces = {p: number(_float32(s)) for p, (_, s) in vocabulary.pieces.items()}
        self.exact = whole
        if any(_BETWEEN in piece for piece in self.pieces):
            raise ValueError(f"{path}: a piece has the character {ascii(_BETWEEN)}")
        self.automaton = ahocorasick.Automaton()
        self.matched = [(len(piece), score) for piece, score in self.pieces.items()]
        for i, piece in enumerate(self.pieces):
            self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        ulp = [np.spacing(np.float32(abs(self.low) + x)) for x in (-2 * LIMIT, 2 * LIMIT)]
        rest = [s for s in scores if s != self.low]
        self.lost = None
        if whole and ulp[0] == ulp[1] == 64 and self.low % 128 == 0 and self.unknown == self.low and min(rest, default=0) > -LIMIT and max(scores) <= 0:
            self.lost = [self._round(b + self.low) - b - self.low for b in range(128)]
            self.size, self.score = (np.array([m[k] for m in self.matched], np.int32) for k in (0, 1))
            by = np.arange(-32, 33)
            #: By a score's last 7 bits, whether it is rounded to another number if 1 more was lost.
            self.turns = np.diff(np.rint((np.arange(128)[:, None] - by) / 64), axis=1) != 0

    def _round(self, x):
        if self.exact:
            return x if -16777216 <= x <= 16777216 else int(_float32(x))
        return _float32(x)

    def solve(self, unit: str, before) -> tuple:
        """(tokens, score, sum after it, least sum at any character)."""
        n, least, round_ = len(unit), before, self._round
        ends: list = [()] * n
        for end, i in self.automaton.iter(unit):  # of an end the longest first
            if ends[end]:
                ends[end].append(self.matched[i])
            else:
                ends[end] = [self.matched[i]]
        sums, count, score, taken, seen = [before], [0], [0], [], [0]  # taken: what was subtracted; seen: how much of it by a place
        for q in range(1, n + 1):
            best, length = None, 0
            for length, s in ends[q - 1]:
                p = q - length
                now = sums[p] + s
                if best is not None:
                    while r < seen[p]:
                        best = round_(best - taken[r])
                        r += 1
                if best is None or now > best:
                    best, k, total, r = round_(now), count[p] + 1, score[p] + s, seen[p]
            p = q - 1
            if best is not None:
                while r < seen[p]:
                    best = round_(best - taken[r])
                    r += 1
            if length != 1 and (best is None or sums[p] + self.unknown > best):
                best, k, total = round_(sums[p] + self.unknown), count[p] + len(unit[p].encode("utf-8", "surrogatepass")), score[p] + self.unknown
            if best < least:
                least = best
            if not -LIMIT <= best <= LIMIT:
                taken.append(best)
                best = 0
            sums.append(best)
            count.append(k)
            score.append(total)
            seen.append(len(taken))
        return count[n], score[n], sums[n], least


    def solve_many(self, found: list[str]) -> list:
        """Of each unit: (tokens, score, change of the sum, least sum), if it adds up exactly from 0; (bounds, results) if it begins with a
        mark of the lowest score: results by what is lost of the sum before it, as ``solve`` has them; None if neither can be said.

        A mark takes the sum away twice: after it and after the first piece that is longer. What is left of the sum before it is how the
        first piece's score was rounded, with what was lost, to a multiple of 64. From there on sums are exact."""
        out: list = [None] * len(found)
        size = np.array([len(x) for x in found])
        start = np.cumsum(size + 1) - size - 1
        flat = np.fromiter(chain.from_iterable(self.automaton.iter(_BETWEEN.join(found) + _BETWEEN)), np.int64).reshape(-1, 2)
        length, score = self.size[flat[:, 1]], self.score[flat[:, 1]]
        unit = np.searchsorted(start, flat[:, 0], "right") - 1
        begin = (flat[:, 0] - start[unit] - length + 1).astype(np.int32)
        n = len(found)
        singles = np.bincount(unit[length == 1], minlength=n)
        lowest = np.bincount(unit[(score == self.low) & ((begin > 0) | (length > 1))], minlength=n)
        head = np.zeros(n, bool)
        head[unit[(begin == 0) & (length == 1) & (score == self.low)]] = True
        second = np.zeros(n, bool)
        second[unit[(begin == 0) & (length == 2)]] = True
        known = (singles == size) & (lowest == 0) & (size <= LONGEST)
        for marked in (False, True):
            chosen = np.flatnonzero(known & (head == marked) & (second | ~head))
            if not len(chosen):
                continue
            number = np.full(n, -1)
            number[chosen] = np.arange(len(chosen))
            mine = np.flatnonzero(number[unit] >= 0)
            u, p, e, s = number[unit[mine]], begin[mine], begin[mine] + length[mine], score[mine]
            if marked:
                first = (p == 0) & (e > 1)
                order = np.argsort(u[first], kind="stable")
                fu, fe, fs = u[first][order], e[first][order], s[first][order]
                border = np.flatnonzero(np.r_[True, fu[1:] != fu[:-1]])
                turns = np.logical_or.reduceat(self.turns[fs & 127], border)
                cases = turns.sum(1) + 1
                base = np.cumsum(cases) - cases
                at, where = np.nonzero(turns)  # where + 1 more lost than 32 less is another case
                lost = np.full(int(cases.sum()), -32)
                lost[base[at] + 1 + np.arange(len(at)) - (np.cumsum(cases - 1) - (cases - 1))[at]] = where - 31
            else:
                cases, base, lost = np.ones(len(chosen), np.int64), np.arange(len(chosen)), np.zeros(len(chosen), np.int64)
            width = int(size[chosen].max()) + 1
            value, count, total = np.full((len(lost), width), -(1 << 30), np.int32), np.zeros((len(lost), width), np.int32), np.zeros((len(lost), width), np.int32)
            if marked:
                owner = np.repeat(np.arange(len(fu)), cases[fu])  # a row for each first piece and case
                row = base[fu[owner]] + np.arange(len(owner)) - np.repeat(np.cumsum(cases[fu]) - cases[fu], cases[fu])
                rounded = (64 * np.rint((fs[owner] - lost[row]) / 64)).astype(np.int32)
                shortest = np.zeros(len(lost), np.int32)
                two = fe[owner] == 2
                shortest[row[two]] = rounded[two]
                value[row, fe[owner]], count[row, fe[owner]], total[row, fe[owner]] = rounded - shortest[row], 1, fs[owner]
            else:
                value[:, 0] = 0
            least = np.zeros(len(lost), np.int32)
            inner = p >= 2 if marked else p >= 0
            u, p, e, s = u[inner], p[inner], e[inner], s[inner]
            key = e.astype(np.int64) * (LONGEST + 1) + p  # of an end the longest first
            order = np.argsort(key, kind="stable")
            u, p, e, s = u[order], p[order], e[order], s[order]
            group = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0]) if len(key) else np.zeros(0, np.int64)
            for i, j in zip(group, np.r_[group[1:], len(key)]):
                each = cases[u[i:j]]
                row = np.repeat(base[u[i:j]] - (np.cumsum(each) - each), each) + np.arange(int(each.sum())) if marked else u[i:j]
                more = np.repeat(s[i:j], each) if marked else s[i:j]
                now = value[row, p[i]] + more
                better = now > value[row, e[i]]
                row = row[better]
                value[row, e[i]], count[row, e[i]], total[row, e[i]] = now[better], count[row, p[i]] + 1, total[row, p[i]] + more[better]
            for q in range(2 if marked else 1, width):
                rows = np.repeat(size[chosen] >= q, cases)
                least[rows] = np.minimum(least[rows], value[rows, q])
            end = np.repeat(size[chosen], cases)
            row = np.arange(len(lost))
            tokens, scores, sums = (x[row, end].tolist() for x in (count, total, value))
            least_, lost_ = least.tolist(), lost.tolist()
            for c, b, k in zip(chosen.tolist(), base.tolist(), cases.tolist()):
                if min(least_[b : b + k]) < -LIMIT:  # part of the sum is taken away inside
                    continue
                if marked:
                    out[c] = tuple(lost_[b + 1 : b + k]), tuple(zip(tokens[b : b + k], scores[b : b + k], sums[b : b + k]))
                else:
                    out[c] = tokens[b], scores[b], sums[b], least_[b]
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """Made once in each process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Counter:
    """Counts texts, and keeps what it found for units."""

    def __init__(self, path: str):
        self.path, self.encoder = path, encoder(path)
        self.key, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # hashes of the known units in order, and their numbers
        self.text: list[str] = []
        self.known: list = []  # of ``solve_many``
        self.memo: dict = {}

    def _numbers(self, found) -> np.ndarray:
        """Numbers of the different units of some texts."""
        at = np.searchsorted(self.key, found.key)
        inside = np.minimum(at, max(len(self.key) - 1, 0))
        known = self.key[inside] == found.key if len(self.key) else np.zeros(len(at), bool)
        out = np.zeros(len(at), np.int64)
        out[known] = self.number[inside[known]]
        fresh = np.flatnonzero(~known)
        if len(fresh):
            end = np.cumsum(found.size)
            every = found.points.tobytes().decode("utf-32-le", "surrogatepass")
            out[fresh] = np.arange(len(self.text), len(self.text) + len(fresh))
            units_ = [every[b - n : b] for b, n in zip(end[fresh].tolist(), found.size[fresh].tolist())]
            self.text += units_
            for i in range(0, len(units_), AT_ONCE):
                self.known += self.encoder.solve_many(units_[i : i + AT_ONCE]) if self.encoder.lost is not None else [None] * len(units_[i : i + AT_ONCE])
            self.key, self.number = np.insert(self.key, at[fresh], found.key[fresh]), np.insert(self.number, at[fresh], out[fresh])
        return out

    def add(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, score) of each text."""
        if len(self.text) > CACHE or len(self.memo) > CACHE:
            self.__init__(self.path)
        found = units(texts, self.path)
        which = self._numbers(found)[found.which].tolist()
        border = np.searchsorted(found.text, np.arange(len(texts) + 1)).tolist()
        tokens, scores = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        e, known, memo, text, lost = self.encoder, self.known, self.memo, self.text, self.encoder.lost
        for t in range(len(texts)):
            n, total, sum_ = 0, 0, 0
            for u in which[border[t] : border[t + 1]]:
                x = known[u]
                if x is not None:
                    if len(x) == 2:
                        x = x[1][bisect_right(x[0], lost[sum_ & 127])]
                        n += x[0]
                        total += x[1]
                        sum_ = x[2]
                        continue
                    if sum_ + x[3] >= -LIMIT:
                        n += x[0]
                        total += x[1]
                        sum_ += x[2]
                        continue
                key = u, sum_
                x = memo.get(key)
                if x is None:
                    x = memo[key] = e.solve(text[u], sum_)
                n += x[0]
                total += x[1]
                sum_ = x[2]
            tokens[t], scores[t] = n, total
        return tokens, scores


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = bt.to_string(batch.column(1))
            tokens, scores = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for i, j, _, _ in bt.steps(texts, 1 << 20):
                tokens[i:j], scores[i:j] = counter.add(texts.slice(i, j - i).to_pylist())
            missing = ~batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(tokens, mask=missing), pa.array(scores, mask=missing)], names=["doc_id", "n_tokens", "score"])

    return run


def count_tokens(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, n_tokens, score) for each row of ``docs`` (doc_id, text), without a shuffle.

    ``n_tokens`` is the length of the encoding that SentencePiece has of the whole text with the vocabulary file read as a unigram model;
    ``score`` is the sum of its pieces' scores, in double precision. Null text: null count and score.
    Empty text: 0 and 0. Repeated rows and a null doc_id: a row each. An empty table gives no rows. Columns but doc_id and text are
    not looked at. ``path`` is the vocabulary's file, which every executor must have.
    """
    return bounded(docs).select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_counted(path), SCHEMA)
