"""Sampled segmentations without replacement over a unigram lattice, and decoding.

Gumbel top-k: the k segmentations of largest perturbed log-probability are k draws without replacement. They are found by A-star
search over sets of segmentations. A set's key is the largest perturbed log-probability in it, drawn for the set as a whole (a
Gumbel number at the set's log-mass, cut off at its parent's key), so that no set is opened before it holds the next best:

* the root is all segmentations of a text; its best is an ordinary sample, drawn backwards through the lattice;
* what it leaves is split, for each unit, into the segmentations that agree with it before that unit and differ in it;
* the set of the largest key gives the next sample: the same units before, another segmentation of the unit, fresh ones after.

The key after the last sample's gives the inclusion scores. Random numbers are hashes of the row's key, the sample and the place, so
a row's samples don't depend on partitions, batches or other rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytes_text as bt
from .unigram import MODEL, Units, code_points, load, rolling, units

SAMPLES = 2
#: Inverse temperature of the piece scores.
ALPHA = 0.001
#: Text bytes sampled at a time, and how many such steps share a lattice: the more, the more units repeat, and the more memory it takes.
STEP_BYTES, SHARED_STEPS = 1 << 20, 5
SCHEMA = "doc_id bigint, sample int, ids array<int>, log_prob double, inclusion double"
_TABLE_BITS = 20
_tables: dict[str, tuple] = {}


def _lookup(path: str) -> tuple:
    """(slot -> first place, most in a slot, slot -> whether some piece begins so, sorted hashes, ids in that order, longest piece, score by id): a piece is found by the top bits of its hash."""
    if path not in _tables:
        v = load(path)
        names = list(v.pieces)
        ends = np.cumsum([len(p) for p in names])
        sums, ri = rolling(code_points("".join(names)))
        starts = np.r_[0, ends[:-1]]
        h = (sums[ends] - sums[starts]) * ri[starts]
        order = np.argsort(h)
        if len(np.unique(h)) < len(h):
            raise ValueError("two pieces have one hash")
        ids = np.array([v.pieces[p][0] for p in names], np.int32)[order]
        slots = np.searchsorted(h[order], np.arange(1 << _TABLE_BITS, dtype=np.uint64) << np.uint64(64 - _TABLE_BITS)).astype(np.int32)
        shared = int(np.diff(np.r_[slots, len(h)]).max())
        begins = np.zeros(1 << _TABLE_BITS, bool)
        for n in range(1, max(map(len, names)) + 1):
            long = starts[ends - starts >= n]
            begins[(((sums[long + n] - sums[long]) * ri[long]) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
        scores = np.zeros(len(v.surface))
        for _, (i, score) in v.pieces.items():
            scores[i] = score
        _tables[path] = slots, shared, begins, h[order], ids, max(map(len, names)), scores
    return _tables[path]


class Lattice(NamedTuple):
    """Edges of the lattices of some units, grouped by the node they end at. Node numbers run on over units."""

    source: np.ndarray  # node each edge begins at
    log_p: np.ndarray  # of the edge, given the node it ends at
    row: np.ndarray  # node -> its first edge; one more at the end
    best: np.ndarray  # node -> its likeliest edge
    share: np.ndarray  # node -> that edge's probability
    ladder: np.ndarray  # running probability of the node's other edges, scaled to 1, plus the node's number
    pool: np.ndarray  # edge -> its first output id
    width: np.ndarray  # edge -> number of output ids
    out: np.ndarray  # output ids
    first: np.ndarray  # unit -> its first node
    last: np.ndarray  # unit -> its last node


def joined(parts: list[Lattice]) -> Lattice:
    """One lattice of the units of all; empties ``parts``, an array at a time, so that there are never two whole copies."""
    nodes = np.cumsum([0] + [len(x.best) for x in parts])
    edges = np.cumsum([0] + [len(x.source) for x in parts])
    outs = np.cumsum([0] + [len(x.out) for x in parts])
    by = {
        "source": nodes, "row": edges, "best": edges, "ladder": nodes, "pool": outs, "first": nodes, "last": nodes,
    }
    columns, held = {}, [x._asdict() for x in parts]
    parts.clear()
    for name in Lattice._fields:
        values = [x.pop(name) for x in held]
        if name == "row":
            values = [v[:-1] for v in values[:-1]] + values[-1:]
        if name in by:
            values = [v + v.dtype.type(o) for v, o in zip(values, by[name])]
        columns[name] = np.concatenate(values)
    return Lattice(**columns)


def lattice(points: np.ndarray, size: np.ndarray, path: str = MODEL, alpha: float = ALPHA) -> Lattice:
    """Of units laid end to end, of the given lengths."""
    vocabulary = load(path)
    slots, shared, begins, hashes, piece_ids, longest, scores = _lookup(path)
    end = np.cumsum(size).astype(np.int32)
    begin = end - size.astype(np.int32)
    sums, ri = rolling(points)
    left = np.repeat(end, size) - np.arange(len(points), dtype=np.int32)  # characters to the unit's end
    at, to, piece = [], [], []
    here = np.arange(len(points), dtype=np.int32)
    single = np.zeros(len(points), bool)
    for n in range(1, longest + 1):
        here = here[left[here] >= n]
        if not len(here):
            break
        h = (sums[here + n] - sums[here]) * ri[here]
        slot = (h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
        on = begins[slot]  # else no piece is this long or longer from there
        here, h, k = here[on], h[on], slots[slot[on]]
        hit = np.zeros(len(here), bool)
        which = np.zeros(len(here), np.int32)
        for step in range(shared):
            kk = np.minimum(k + step, len(hashes) - 1)
            same = hashes[kk] == h
            hit |= same
            which[same] = kk[same]
        got = np.flatnonzero(hit)
        at.append(here[got])
        to.append(here[got] + n)
        piece.append(piece_ids[which[got]])
        if n == 1:
            single[here[got]] = True
    stray = np.flatnonzero(~single).astype(np.int32)
    at.append(stray)
    to.append(stray + 1)
    piece.append(-1 - np.arange(len(stray), dtype=np.int32))
    at, to, piece = np.concatenate(at), np.concatenate(to), np.concatenate(piece)
    weight = alpha * np.where(piece >= 0, scores[np.maximum(piece, 0)], vocabulary.unknown)
    # nodes: unit u has size + 1 of them from begin[u] + u on
    unit = np.repeat(np.arange(len(size), dtype=np.int32), size)[at]
    source, target = at + unit, to + unit
    depth = to - begin[unit]
    order = np.argsort(target.astype(np.int64) * 64 + (target - source))  # by target; no two edges to it are of one length
    source, target, weight, piece, depth = source[order], target[order], weight[order], piece[order], depth[order]
    first, last = (v + np.arange(len(size)) for v in (begin, end))
    nodes = len(points) + len(size)
    deepest = int(depth.max()) if len(depth) else 0
    level = np.argsort(depth.astype(np.uint16) if deepest < 1 << 16 else depth, kind="stable")
    mass = np.zeros(nodes)
    borders = np.r_[0, np.cumsum(np.bincount(depth, minlength=deepest + 1)[1:])]
    for a, b in zip(borders[:-1], borders[1:]):
        if a == b:
            continue
        of, to = level[a:b], target[level[a:b]]
        value = mass[source[of]] + weight[of]
        heads = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
        most = np.maximum.reduceat(value, heads)
        total = np.add.reduceat(np.exp(value - np.repeat(most, np.diff(np.r_[heads, b - a]))), heads)
        mass[to[heads]] = most + np.log(total)
    log_p = mass[source] + weight - mass[target]
    row = np.r_[0, np.cumsum(np.bincount(target, minlength=nodes))]
    p = np.exp(log_p)
    degree = np.diff(row)
    some = np.flatnonzero(degree)
    share, best = np.ones(nodes), np.zeros(nodes, np.int64)
    if len(some):
        share[some] = np.maximum.reduceat(p, row[some])
        top = np.flatnonzero(p == np.repeat(share, degree))[::-1]
        best[target[top]] = top  # of equals the first
        p[best[some]] = 0
    run = np.r_[0.0, np.cumsum(p)]
    within = run[1:] - np.repeat(run[row[:-1]], degree)
    total = np.repeat(run[row[1:]] - run[row[:-1]], degree)
    ladder = target + np.minimum(within / np.maximum(total, 1e-300), 1.0)
    width, out = np.ones(len(piece), np.int32), piece.copy()
    odd = np.flatnonzero(piece < 0)
    if len(odd):
        raw = [chr(c).encode("utf-8", "surrogatepass") for c in points[stray[-1 - piece[odd]]]]
        width[odd] = [len(x) for x in raw]
        start = np.cumsum(width) - width
        out = np.repeat(piece, width)
        for k, x in zip(start[odd], raw):
            out[k : k + len(x)] = [vocabulary.byte[c] for c in x]
    return Lattice(source, log_p, row, best, share, ladder, np.cumsum(width, dtype=np.int32) - width, width, out, first, last)


def _uniform(key: np.ndarray, sample: int, place: np.ndarray, step: int) -> np.ndarray:
    """In (0, 1), by hash."""
    h = bt.mix(key + bt.mix((place.astype(np.uint64) << np.uint64(20)) + np.uint64((step & 0xFFFF) << 4 | (sample & 15)) + np.uint64((sample >> 4) << 60 & (1 << 64) - 1)))
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


_FULL = (1 << 64) - 1


def _mix(x: int) -> int:
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _FULL
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _FULL
    return x ^ (x >> 31)


def _uniform_one(key: int, sample: int, place: int, step: int) -> float:
    """``_uniform`` of single numbers."""
    h = _mix((key + _mix(((place << 20) + ((step & 0xFFFF) << 4 | (sample & 15)) + ((sample >> 4) << 60)) & _FULL)) & _FULL)
    return ((h >> 11) + 0.5) * 2.0**-53


def _draw(lat: Lattice, unit: np.ndarray, key: np.ndarray, sample: int, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A segmentation of each unit: (log-probability, edges, numbers of edges); edges are laid end to end, each unit's in order."""
    node, log_p = lat.last[unit].copy(), np.zeros(len(unit))
    stop = lat.first[unit]
    live = np.flatnonzero(node > stop)
    taken, owners, step = [], [], 0
    while len(live):
        here, u = node[live], _uniform(key[live], sample, place[live], step)
        edge, share = lat.best[here], lat.share[here]
        rest = np.flatnonzero(u > share)
        edge[rest] = np.searchsorted(lat.ladder, here[rest] + np.clip((u[rest] - share[rest]) / (1 - share[rest]), 1e-9, 1 - 1e-9), "left")
        log_p[live] += lat.log_p[edge]
        node[live] = lat.source[edge]
        taken.append(edge)
        owners.append(live)
        live = live[node[live] > stop[live]]
        step += 1
    if not taken:
        return log_p, np.zeros(0, np.int64), np.zeros(len(unit), np.int64)
    count = np.bincount(np.concatenate(owners), minlength=len(unit))
    end, edges = np.cumsum(count), np.empty(int(count.sum()), np.int64)
    for k, (e, o) in enumerate(zip(taken, owners)):
        edges[end[o] - 1 - k] = e
    return log_p, edges, count


def _probability(lat: Lattice, edges: list[int]) -> float:
    return exp(sum(lat.log_p[edges].tolist()))


def _other(lat: Lattice, unit: int, used: list[list[int]], key: int, sample: int, place: int) -> tuple[list[int], float] | None:
    """A segmentation of one unit that is none of ``used``, drawn from what they leave; with its log-probability."""
    node, stop = int(lat.last[unit]), int(lat.first[unit])
    same = [(u[::-1], _probability(lat, u)) for u in used]
    out, log_p, step = [], 0.0, 0
    while node > stop:
        a, b = int(lat.row[node]), int(lat.row[node + 1])
        logs = lat.log_p[a:b].tolist()
        p = [exp(x) for x in logs]
        left = p.copy()
        for u, m in same:
            left[u[step] - a] -= m
        for e in {u[step] - a for u, _ in same}:
            if left[e] < 1e-12 * p[e]:  # it holds only used segmentations; the rest is rounding
                left[e] = 0.0
        total = sum(left)
        if not total > 0:
            return None
        at, e = _uniform_one(key, sample, place, 0x8000 + step) * total, -1
        for i, x in enumerate(left):
            if x > 0:
                e, at = i, at - x
                if at <= 0:
                    break
        same = [(u, m / p[e]) for u, m in same if u[step] - a == e]
        out.append(a + e)
        log_p += logs[e]
        node = int(lat.source[a + e])
        step += 1
    return out[::-1], log_p


def _cut_gumbel(location: np.ndarray, top: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel numbers at ``location`` given that they are below ``top``."""
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        return np.where(np.isneginf(location), -np.inf, location - np.log(np.exp(np.minimum(location - top, 700)) - np.log(u)))


def sample_texts(texts: list[str], keys: np.ndarray, k: int = SAMPLES, path: str = MODEL, alpha: float = ALPHA):
    """For each sample number: (texts that have it, ids laid end to end, their counts, log-probabilities, inclusion scores)."""
    found = units(texts, path)
    return sample_units(found.text, found.which, lattice(found.points, found.size, path, alpha), len(texts), keys, k)


def sample_units(text: np.ndarray, unit: np.ndarray, lat: Lattice, n: int, keys: np.ndarray, k: int):
    """``sample_texts`` of ``n`` texts given as units of a lattice, in order."""
    number = np.bincount(text, minlength=n)
    border = np.r_[0, np.cumsum(number)]
    place = np.arange(len(unit)) - border[text]
    keys = bt.mix(keys.astype(np.uint64))
    by_text = keys[text]
    close = np.argsort(unit, kind="stable")  # neighbours in memory are drawn together

    def fresh(sample: int, which: np.ndarray):
        log_p, edges, count = _draw(lat, unit[which], by_text[which], sample, place[which])
        return log_p, edges, np.cumsum(count) - count, count

    best = -np.log(-np.log(_uniform(keys, 0, np.zeros(n, np.int64), 0xFFFF)))
    made: list[tuple] = []  # per sample: key of each text, log-probabilities, edge pool, first edge and number by unit
    open_: list[np.ndarray] = []  # per sample: key of the set that leaves it at each unit
    used: dict[tuple[int, int], list[list[int]]] = {}
    key_now, parent, split = best, np.full(n, -1), np.zeros(n, np.int64)
    alive = np.ones(n, bool)
    for s in range(k):
        log_p, pool, start, count = np.zeros(len(unit)), np.zeros(0, np.int64), np.zeros(len(unit), np.int64), np.zeros(len(unit), np.int64)
        after = alive[text] & ((place > split[text]) | (parent[text] < 0))
        which = close[after[close]]
        got, edges, first, many = fresh(s, which)
        log_p[which], start[which], count[which] = got, first, many
        pool = edges
        location = np.full(len(unit), -np.inf)
        if s:
            extra, offset = [], len(pool)
            for d in np.flatnonzero(alive):
                a, w, par = int(border[d]), int(border[d] + split[d]), int(parent[d])
                old = made[par]
                log_p[a:w] = old[1][a:w]
                for x in range(a, w):
                    m = int(old[4][x])
                    extra.append(old[2][old[3][x] : old[3][x] + m])
                    start[x], count[x] = offset, m
                    offset += m
                seg, lp = pending[d]
                extra.append(np.array(seg, np.int64))
                start[w], count[w], log_p[w] = offset, len(seg), lp
                offset += len(seg)
            pool = np.concatenate([pool, *extra]) if extra else pool
        run = np.cumsum(log_p)
        before = run - log_p - (np.r_[0.0, run][border[:-1]])[text]
        with np.errstate(divide="ignore", invalid="ignore"):
            rest = np.log(-np.expm1(np.minimum(log_p, 0)))
        rest[log_p > -1e-14] = -np.inf
        location = np.where(after, before + rest, -np.inf)
        if s:
            for d in np.flatnonzero(alive):  # what is still left at the unit where it left its parent
                w = int(border[d] + split[d])
                total = sum(_probability(lat, u) for u in used[d, int(parent[d]), w])
                location[w] = before[w] + (np.log1p(-total) if total < 1 - 1e-12 else -np.inf)
        open_.append(_cut_gumbel(location, key_now[text], _uniform(by_text, s, place, 0x7FFF)))
        made.append((np.where(alive, key_now, -np.inf), log_p, pool, start, count, alive.copy()))
        if s:
            for d in np.flatnonzero(alive):
                w = int(border[d] + split[d])
                used[d, s, w] = used[d, int(parent[d]), w]
        # the next set of each text
        tops = np.full((s + 1, n), -np.inf)
        some = np.flatnonzero(number > 0)
        for j in range(s + 1):
            if len(some):
                tops[j, some] = np.maximum.reduceat(open_[j], border[some])
        key_now = tops.max(0)
        alive = ~np.isneginf(key_now)
        if s + 1 == k:
            break
        pending = {}
        for d in np.flatnonzero(alive):
            a, b = int(border[d]), int(border[d + 1])
            while True:
                j = int(np.argmax([o[a:b].max() for o in open_]))
                w = a + int(open_[j][a:b].argmax())
                key_now[d] = open_[j][w]
                if np.isneginf(key_now[d]):
                    alive[d] = False
                    break
                open_[j][w] = -np.inf
                _, _, pool_j, start_j, count_j, _ = made[j]
                history = used.setdefault((d, j, w), [])
                mine = list(map(int, pool_j[start_j[w] : start_j[w] + count_j[w]]))
                if mine not in history:
                    history.append(mine)
                seg = _other(lat, int(unit[w]), history, int(keys[d]), s + 1, int(place[w]))
                if seg is not None:  # else all that the set had was rounding
                    history.append(seg[0])
                    pending[d], parent[d], split[d] = seg, j, w - a
                    break
    threshold = key_now  # the (k+1)-th
    for s, (_, log_p, pool, start, count, have) in enumerate(made):
        rows = np.flatnonzero(have)
        mine = have[text]
        at, many = start[mine], count[mine]
        edges = pool[np.repeat(at - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
        width = lat.width[edges]
        ids = lat.out[np.repeat(lat.pool[edges] - (np.cumsum(width) - width), width) + np.arange(int(width.sum()))]
        owner = np.repeat(text[mine], many)
        total = np.bincount(text, log_p, n)[rows]
        with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
            x = np.minimum(total - threshold[rows], 700)
            inclusion = np.where(x <= -10, x - np.exp(x) / 2, np.log(-np.expm1(-np.exp(x))))
        yield rows, ids.astype(np.int32), np.bincount(owner, width, n).astype(np.int64)[rows], total, np.minimum(inclusion, 0.0)


def row_keys(ids: pa.Array, seed: int) -> np.ndarray:
    raw = ids.cast(pa.int64()).fill_null(-(1 << 62)).to_numpy(zero_copy_only=False).view(np.uint64)
    return bt.mix(raw + bt.mix(np.array([seed], np.uint64)))


def _shared(found: list[Units], path: str, alpha: float) -> tuple[Lattice, list[np.ndarray]]:
    """One lattice of the different units of all, and where in it each one's are."""
    keys, first, where = np.unique(np.concatenate([f.key for f in found]), return_index=True, return_inverse=True)
    border = np.cumsum([0] + [len(f.key) for f in found])
    order = np.empty(len(keys), np.int64)
    order[np.argsort(first)] = np.arange(len(keys))  # number of a unit in the joint lattice: by first occurrence
    parts = []
    for f, a, b in zip(found, border[:-1], border[1:]):
        new = np.sort(first[(first >= a) & (first < b)]) - a
        start, size = (np.cumsum(f.size) - f.size)[new], f.size[new]
        inside = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        parts.append(lattice(f.points[inside], size, path, alpha))
    return joined(parts), [order[where[a:b]] for a, b in zip(border[:-1], border[1:])]


def _sampled(k: int, path: str, alpha: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(1).is_valid())
            if not batch.num_rows:
                continue
            ids, texts = batch.column(0).cast(pa.int64()), bt.to_string(batch.column(1))
            keys = row_keys(ids, seed)
            slices = [(i, j) for i, j, _, _ in bt.steps(texts, STEP_BYTES)]
            for a in range(0, len(slices), SHARED_STEPS):
                group = slices[a : a + SHARED_STEPS]
                found = [units(texts.slice(i, j - i).to_pylist(), path) for i, j in group]
                lat, which = _shared(found, path, alpha)
                for (i, j), f, w in zip(group, found, which):
                    for s, (rows, pieces, count, log_p, inclusion) in enumerate(sample_units(f.text, w[f.which], lat, j - i, keys[i:j], k)):
                        border = np.r_[0, np.cumsum(count)].astype(np.int32)
                        yield pa.record_batch(
                            [ids.slice(i, j - i).take(pa.array(rows)), pa.array(np.full(len(rows), s, np.int32)), pa.ListArray.from_arrays(pa.array(border), pa.array(pieces)), pa.array(log_p), pa.array(inclusion)],
                            names=["doc_id", "sample", "ids", "log_prob", "inclusion"],
                        )

    return run


def sample_segmentations(docs: DataFrame, k: int = SAMPLES, path: str = MODEL, alpha: float = ALPHA, seed: int = 11) -> DataFrame:
    """(doc_id, sample, ids, log_prob, inclusion): ``k`` distinct segmentations of each row of ``docs`` (doc_id, text).

    ``sample`` counts from 0 in the order drawn; ``log_prob`` is the segmentation's log-probability under piece scores times
    ``alpha``; ``inclusion`` the log-probability that it is among ``k`` draws, given the key after them. Decoding any gives the text.
    A text with fewer than ``k`` segmentations gives all it has (inclusion 0); those whose share of their unit is below about 1e-12 don't
    count. Null text: no row. Empty text: one row without ids.
    The seed of a row is its doc_id (and ``seed``), so repeated rows have the same samples; a null doc_id is a key of its own. An empty
    table gives no rows. Columns but doc_id and text are not looked at. No shuffle.
    """
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_sampled(k, path, alpha, seed), SCHEMA)
