import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from semloom.llm import fingerprint as fp

from .conftest import LONG, odd_rows

parts = st.lists(st.text(alphabet="ab é", min_size=1, max_size=4), max_size=6)


@settings(max_examples=50, deadline=None)
@given(parts, parts)
def test_homomorphic(a, b):
    assert fp.combine(fp.fingerprint(a), fp.fingerprint(b)) == fp.fingerprint(b + a)
    assert fp.insert(fp.fingerprint(a), *b) == fp.fingerprint(sorted(a + b))
    assert fp.delete(fp.fingerprint(a + b), *b) == fp.fingerprint(a)
    assert (fp.fingerprint(a) == fp.fingerprint(b)) == (sorted(a) == sorted(b))


def test_many_paragraphs_equal_one_by_one():
    lines = [f"line {i % 700}" for i in range(5000)]
    value = fp.fingerprint([])
    for x in lines[:100]:
        value = fp.insert(value, x)
    assert value == fp.fingerprint(lines[:100]) and fp.delete(fp.fingerprint(lines), *lines[100:]) == value


def test_documents(spark, odd, none):
    got = {}
    for r in fp.fingerprint_documents(odd).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == len(odd_rows())
    assert got[2][0][1:] == (None, None, None) and got[3][0]["n_paragraphs"] == got[4][0]["n_paragraphs"] == 0
    assert not any(got[3][0]["fingerprint"]) and len(got[3][0]["fingerprint"]) == 2 * fp.LANES
    assert got[1][0]["digest"] == got[1][1]["digest"] == got[7][0]["digest"] != got[10][0]["digest"]
    assert got[5][0]["fingerprint"] == fp.fingerprint([LONG.strip()])
    assert fp.fingerprint_documents(none).count() == 0
    lines = ["one", "two", "two", " three "]
    mixed = lines[:]
    random.Random(1).shuffle(mixed)
    both = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n\n".join(mixed)), (3, "one\ntwo\nthree")], "doc_id bigint, text string")
    a, b, c = (r["fingerprint"] for r in fp.fingerprint_documents(both).orderBy("doc_id").collect())
    assert a == b != c and fp.insert(c, "two") == a
    assert a == by_hand(lines) and c == by_hand(["one", "two", "three"])


def by_hand(lines):
    """The sum itself, lane by lane in Python's numbers."""
    total = [0] * fp.LANES
    for x in lines:
        h = hashlib.shake_128(x.strip().encode()).digest(2 * fp.LANES)
        total = [(t + h[2 * i] + 256 * h[2 * i + 1]) % 65536 for i, t in enumerate(total)]
    return b"".join(t.to_bytes(2, "little") for t in total)


def test_fingerprints_equal_the_sum_by_hand(spark):
    texts = ["one\n two \n\n\ttwo", "x" * 5000 + "\né", "\n".join(f"line {i % 7}" for i in range(60)), ""]
    rows = fp.fingerprint_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    for r in rows:
        lines = [x for x in texts[r["doc_id"]].split("\n") if x.strip()]
        assert r["fingerprint"] == by_hand(lines) and r["n_paragraphs"] == len(lines)


def test_sums_of_groups(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", "b", None]), rng.randrange(3), rng.choice([None, *(fp.fingerprint([str(i)]) for i in range(4))])) for _ in range(200)] + [("none", 0, None)]
    prints = spark.createDataFrame(rows, "source string, day int, print binary").repartition(5)
    want = {}
    for s, d, v in rows:
        total = want.setdefault((s, d), fp.fingerprint([]))
        want[s, d] = fp.combine(total, v) if v else total
    got = fp.sum_fingerprints(prints, ["source", "day"], "print").collect()
    assert len(got) == len(want) and {(r["source"], r["day"]): bytes(r["fingerprint"]) for r in got} == want
    (whole,) = fp.sum_fingerprints(prints.withColumnRenamed("print", "fingerprint"), []).collect()
    everything = fp.fingerprint([])
    for v in want.values():
        everything = fp.combine(everything, v)
    assert bytes(whole["fingerprint"]) == everything
    assert fp.sum_fingerprints(prints.limit(0), ["day"], "print").count() == 0
