import os
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from semloom.llm import sampling, token_count, unigram

from .conftest import LONG, odd_rows

SF = "/root/testdata/sf0.01"

pytestmark = pytest.mark.skipif(not os.path.exists(unigram.MODEL), reason="no vocabulary file")


def viterbi(text):
    """(tokens, score) of the whole text as one lattice, from its beginning on, character by character."""
    v, f = unigram.load(), np.float32
    x = unigram.MARK + text.replace(" ", unigram.MARK) if text else ""
    best = [(f(0), 0, 0)] + [None] * len(x)
    for i in range(len(x)):
        off = best[i][0]
        if abs(off) > token_count.LIMIT:
            for j in range(i, min(len(x), i + 17) + 1):
                if best[j]:
                    best[j] = f(best[j][0] - off), *best[j][1:]
        ends = [(n, f(v.pieces[x[i : i + n]][1]), 1) for n in range(1, 17) if i + n <= len(x) and x[i : i + n] in v.pieces]
        if not any(n == 1 for n, _, _ in ends):
            ends.append((1, f(f(min(s for _, s in v.pieces.values())) - f(10)), len(x[i].encode())))
        for n, s, k in ends:
            now = float(best[i][0]) + float(s)
            if best[i + n] is None or now > best[i + n][0]:
                best[i + n] = f(now), best[i][1] + k, best[i][2] + float(s)
    return best[-1][1], best[-1][2]


def some_texts():
    rng = random.Random(1)
    odd = ["", " ", "\n", "  a  b", "x\n\n y z", "日本語 test 🎉🎉 ok", "a\tb", "▁▁ foo", " private", "tation station " * 30]
    return odd + ["".join(rng.choice("ab thé🎉\n 日ñe.,") for _ in range(rng.randint(0, 40))) for _ in range(300)]


def test_counts_equal_one_viterbi():
    texts = some_texts()
    counter = token_count.Counter(unigram.MODEL)
    for part in (texts[:100], texts[100:], texts[:50]):  # with and without what is known
        tokens, scores = counter.add(part)
        assert list(zip(tokens, scores)) == [viterbi(t) for t in part]


def test_a_full_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(token_count, "CACHE", 50)
    texts = some_texts()
    counter = token_count.Counter(unigram.MODEL)
    for i in range(0, len(texts), 20):
        assert list(counter.add(texts[i : i + 20])[0]) == [viterbi(t)[0] for t in texts[i : i + 20]]


def as_unigram(path, change=lambda piece: None):
    """SentencePiece itself, told that the vocabulary is a unigram one."""
    sentencepiece = pytest.importorskip("sentencepiece")
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    model = pb.ModelProto()
    with open(unigram.MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    for piece in model.pieces:
        change(piece)
    with open(path, "wb") as f:
        f.write(model.SerializeToString())
    return sentencepiece.SentencePieceProcessor(model_file=str(path))


@pytest.mark.skipif(not os.path.exists(SF), reason="no test data")
def test_every_document_equals_the_library(tmp_path):
    sp = as_unigram(tmp_path / "unigram.model")
    texts = pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist() + some_texts() + [LONG, "日本" * 30_000, "q7Zx" * 30_000, " " * 3000]
    tokens, _ = token_count.Counter(unigram.MODEL).add(texts)
    assert list(tokens) == [len(x) for x in sp.encode(texts)]


def test_other_scores_equal_the_library(tmp_path):
    """Scores that no case distinction helps with: fractions, and a lowest one that isn't so low."""

    def fraction(piece):
        piece.score = max(piece.score / 2953.7, -9.5)

    sp = as_unigram(tmp_path / "fractions.model", fraction)
    assert token_count.encoder(str(tmp_path / "fractions.model")).lost is None
    texts = pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist()[:200] if os.path.exists(SF) else some_texts()
    tokens, _ = token_count.Counter(str(tmp_path / "fractions.model")).add(texts)
    assert list(tokens) == [len(x) for x in sp.encode(texts)]


def test_count_odd_rows(odd, none):
    got = {}
    for r in token_count.count_tokens(odd).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == len(odd_rows())
    assert tuple(got[2][0]) == (2, None, None) and tuple(got[3][0]) == (3, 0, 0.0) and got[1][0] == got[1][1]
    for i, t, _ in odd_rows():
        if t and len(t) < 1000 and i is not None and i != 10:
            assert tuple(got[i][0])[1:] == viterbi(t)
    assert tuple(got[5][0])[1:] == viterbi(LONG)
    assert token_count.count_tokens(none).count() == 0


def every_segmentation(text, alpha):
    v = unigram.load()
    x, out = unigram.MARK + text.replace(" ", unigram.MARK), {}

    def go(i, ids, score):
        if i == len(x):
            out[tuple(ids)] = score
            return
        ends = [(n, *v.pieces[x[i : i + n]]) for n in range(1, 17) if i + n <= len(x) and x[i : i + n] in v.pieces]
        for n, piece, s in ends:
            go(i + n, [*ids, piece], score + alpha * s)
        if not any(n == 1 for n, _, _ in ends):
            go(i + 1, [*ids, *(v.byte[b] for b in x[i].encode())], score + alpha * v.unknown)

    go(0, [], 0.0)
    top = max(out.values())
    total = top + np.log(sum(np.exp(s - top) for s in out.values()))
    return {k: s - total for k, s in out.items()}


def draws(text, n, k, alpha):
    keys = sampling.row_keys(pa.array(range(n)), 5)
    out = [[] for _ in range(n)]
    for rows, ids, count, log_p, inclusion in sampling.sample_texts([text] * n, keys, k, alpha=alpha):
        border = np.r_[0, np.cumsum(count)]
        for q, r in enumerate(rows):
            out[r].append((tuple(ids[border[q] : border[q + 1]].tolist()), log_p[q], inclusion[q]))
    return out


def test_draws_without_replacement_follow_the_lattice():
    text, alpha, n, k = "thin an", 3e-4, 6000, 3
    exact = every_segmentation(text, alpha)
    p = {s: np.exp(v) for s, v in exact.items()}
    got = draws(text, n, k, alpha)
    assert all(len({s for s, _, _ in d}) == k for d in got)
    assert all(abs(exact[s] - v) < 1e-6 for d in got for s, v, _ in d)
    for s in sorted(p, key=p.get)[-4:]:
        second = sum(p[a] * p[s] / (1 - p[a]) for a in p if a != s)
        third = sum(p[a] * p[b] / (1 - p[a]) * p[s] / (1 - p[a] - p[b]) for a in p for b in p if len({a, b, s}) == 3)
        for place, want in enumerate((p[s], second, third)):
            assert np.mean([d[place][0] == s for d in got]) == pytest.approx(want, abs=0.025)
    # weighted by the inclusion scores the samples stand for all segmentations
    assert np.mean([sum(np.exp(v - i) for _, v, i in d) for d in got]) == pytest.approx(1, abs=0.01)


def test_all_segmentations_when_there_are_few():
    for text in ("a🎉b", "é\nat"):
        exact = every_segmentation(text, 1e-3)
        possible = {s for s, v in exact.items() if v > -30}  # others' shares vanish in double precision
        for d in draws(text, 20, len(exact) + 3, 1e-3):
            assert {s for s, _, _ in d} == possible and all(i == 0 for _, _, i in d)


def test_sample_odd_rows(odd, none):
    rows = sampling.sample_segmentations(odd).collect()
    texts = {}
    for i, t, _ in odd_rows():
        texts.setdefault(i, set()).add(t)
    by = {}
    for r in rows:
        assert unigram.decode(r["ids"]) in texts[r["doc_id"]]
        assert r["log_prob"] <= 1e-9 and r["inclusion"] <= 0
        by.setdefault(r["doc_id"], []).append(r)
    assert 2 not in by and [r["ids"] for r in by[3]] == [[]] and len(by[5]) == 2
    assert sorted(map(str, by[1]))[0::2] == sorted(map(str, by[1]))[1::2]  # repeated rows, the same samples
    assert by[1][0]["ids"] != by[7][0]["ids"]  # another key
    again = sampling.sample_segmentations(odd.repartition(1)).collect()
    same = lambda v: sorted((str(r["doc_id"]), r["sample"], r["ids"], round(r["log_prob"], 4)) for r in v)
    assert same(again) == same(rows)
    assert sampling.sample_segmentations(none).count() == 0
