import os
import random
from collections import Counter, defaultdict

import pytest
import sentencepiece

from semloom.llm import bins, packing, sharding
from semloom.llm.unigram import MODEL

from .conftest import LONG, odd_rows, plain


def item_by_item(items, capacity):
    """Best fit decreasing, one item after another."""
    left, place, rank = [], {}, Counter()
    for s in sorted(items, reverse=True):
        fit = [(r, i) for i, r in enumerate(left) if r >= s]
        if not fit:
            left.append(capacity)
        r, i = min(fit) if fit else (capacity, len(left) - 1)
        place[s, rank[s]] = i, capacity - r
        rank[s] += 1
        left[i] -= s
    return place, len(left)


@pytest.mark.parametrize("tree", [bins.SegmentTree, bins.BalancedTree])
def test_runs_equal_items(tree):
    rng = random.Random(1)
    for _ in range(200):
        capacity = rng.choice([1, 10, 37, 100, 2048])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(0, 200))]
        runs, n = bins.best_fit_decreasing(Counter(items), capacity, tree)
        got = {(x.size, x.rank + j): (x.bin + j // x.per, x.offset + j % x.per * x.size) for x in runs for j in range(x.count)}
        assert (got, n) == item_by_item(items, capacity)
    with pytest.raises(ValueError):
        bins.best_fit_decreasing({11: 1}, 10, tree)


needs_model = pytest.mark.skipif(not os.path.exists(MODEL), reason="no vocabulary file")


def pack_checked(df, rows, capacity):
    got = df.collect()
    want = Counter()
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for i, text in rows:
        n = len(sp.encode(text or ""))
        tokens = n + 1 if n else 0
        parts = max(1, -(-tokens // capacity))
        for p in range(parts):
            want[i, p, parts, min(capacity, tokens - p * capacity)] += 1
    assert Counter((r["doc_id"], r["part"], r["n_parts"], r["size"]) for r in got) == want
    use = defaultdict(list)
    for r in got:
        if r["size"]:
            use[r["bin_id"]].append((r["bin_offset"], r["size"]))
        else:
            assert r["bin_id"] is None and r["bin_offset"] is None
    for spans in use.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + s == b for (a, s), (b, _) in zip(spans, spans[1:])) and sum(spans[-1]) <= capacity
    place, n = item_by_item([r["size"] for r in got if r["size"]], capacity)
    assert sorted(use) == list(range(n))
    assert Counter((s, *v) for (s, _), v in place.items()) == Counter((r["size"], r["bin_id"], r["bin_offset"]) for r in got if r["size"])


@needs_model
def test_packing_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w" for _ in range(rng.choice([0, 1, 3, 9, 12, 30, 31, 64, 65, 150])))) for i in range(300)]
    pack_checked(packing.pack_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), 64), rows, 64)


@needs_model
def test_texts_without_blanks_and_long_ones(spark):
    rows = [(1, "漢字" * 16_000), (2, "q7Zx" * 150_000), (3, " " * 5000), (4, "\n" * 5000), (5, "one two")]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id bigint, text string"))
    pack_checked(got, rows, packing.CAPACITY)


@needs_model
def test_packing_odd_rows(odd, none):
    pack_checked(packing.pack_documents(odd), [r[:2] for r in odd_rows()], packing.CAPACITY)
    assert packing.pack_documents(none).count() == 0
    assert plain(packing.pack_documents(odd)) == plain(packing.pack_documents(odd.repartition(1)))


def shard_checked(got, rows, shard_bytes):
    groups = defaultdict(list)
    for i, t in rows:
        groups[("null", i) if t is None else t].append((i, len((t or "").encode())))
    units = {k: max(1, sum(b for _, b in v)) for k, v in groups.items()}
    more = {k: max(0, u.bit_length() - sharding.DIGITS) for k, u in units.items()}
    units = {k: -(-u // 2 ** more[k]) * 2 ** more[k] for k, u in units.items()}
    by = {r["doc_id"]: r for r in got}
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    fill, whole = Counter(), defaultdict(set)
    for k, v in groups.items():
        ids = [i for i, _ in v if i is not None]
        mine = {(by[i]["group_id"], by[i]["group_bytes"], by[i]["shard_id"]) for i in ids}
        if ids:
            assert len(mine) == 1 and next(iter(mine))[:2] == (min(ids), sum(b for _, b in v))
            fill[next(iter(mine))[2]] += units[k]
            whole[next(iter(mine))[2]].add(k)
    for s, n in fill.items():
        assert n <= shard_bytes or len(whole[s]) == 1
    return units, fill


@pytest.mark.parametrize("times,shard_bytes", [(1, 4096), (200, 4096 * 200)])
def test_sharding_equals_brute_force(spark, times, shard_bytes):
    rng = random.Random(3)
    rows = [(i, "ab" * times * rng.choice([1, 5, 30, 31, 32, 80, 200, 333, 340]) + str(i % 90)) for i in range(260)] + [(900 + i, "z" * 2000 * times) for i in range(3)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), shard_bytes).collect()
    units, fill = shard_checked(got, rows, shard_bytes)
    _, n = item_by_item([u for u in units.values() if u <= shard_bytes], shard_bytes)
    large = sum(u > shard_bytes for u in units.values())
    assert large == 1 and sorted(fill) == list(range(n + large))


def test_sharding_odd_rows(odd, none):
    got = sharding.shard_documents(odd, 8192).collect()
    assert len(got) == len(odd_rows())
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add((r["group_id"], r["shard_id"]))
    assert by[1] == by[7] and by[3] == by[9] and by[2] != by[3]
    assert max(r["group_bytes"] for r in got) == len(LONG)
    assert sharding.shard_documents(none).count() == 0
