"""Vectors: the identity vector of a word, and arithmetic on array columns."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

CACHED = 1 << 24
_made: dict[int, dict[str, np.ndarray]] = {}
#: Each 16-bit number with a blank behind it, made once in each worker.
_written: list[np.ndarray] = []


def identity_numbers(word: str, dim: int):
    """``dim`` 16-bit numbers from counted SHA-256 blocks: the same on every machine."""
    blocks = b"".join(hashlib.sha256(b"%s:%d" % (word.encode(), i)).digest() for i in range(-(-dim // 16)))
    return np.frombuffer(blocks, "<u2", dim)


def identity(word: str, dim: int):
    """Unit vector of a word, float32; each process keeps what it made, up to CACHED numbers, and then starts anew."""
    made = _made.setdefault(dim, {})
    v = made.get(word)
    if v is None:
        v = identity_numbers(word, dim) / 32768.0 - 1.0
        v = (v / np.linalg.norm(v)).astype(np.float32)
        v.flags.writeable = False
        if len(made) * dim >= CACHED:
            made.clear()
        made[word] = v
    return v


def identity_numbers_of(word: Column, dim: int) -> Column:
    """``identity_numbers`` as an expression: array<int>."""
    blocks = F.transform(F.sequence(F.lit(0), F.lit(-(-dim // 16) - 1)), lambda i: F.sha2(F.concat(word, F.lit(":"), i.cast("string")).cast("binary"), 256))

    def numbers(block: Column) -> Column:  # each block is hashed once, as the lambda's argument
        hexed = lambda i: F.concat(F.substring(block, i * 4 + 3, F.lit(2)), F.substring(block, i * 4 + 1, F.lit(2)))  # noqa: E731  low byte first
        return F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.conv(hexed(i), 16, 10).cast("int"))

    return F.slice(F.flatten(F.transform(blocks, numbers)), 1, dim)


def identities(words: list[str], dim: int) -> np.ndarray:
    """(words x dim) of ``identity``, those that aren't known yet made together."""
    made = _made.setdefault(dim, {})
    if len(made) * dim >= CACHED:
        made.clear()
    found = [made.get(w) for w in words]
    missing = [k for k, v in enumerate(found) if v is None]
    if missing:
        blocks, sha = [], hashlib.sha256
        for k in missing:
            word = words[k].encode()
            blocks += [sha(b"%s:%d" % (word, i)).digest() for i in range(-(-dim // 16))]
        x = np.frombuffer(b"".join(blocks), "<u2").reshape(len(missing), -1)[:, :dim] / 32768.0 - 1.0
        x = (x / np.sqrt([row.dot(row) for row in x])[:, None]).astype(np.float32)
        x.flags.writeable = False
        for k, row in zip(missing, x):
            found[k] = made[words[k]] = row
    return np.array(found, np.float32).reshape(-1, dim)


def identity_digest_of(word: Column, dim: int) -> Column:
    """The md5 of ``identity_numbers`` written with blanks between them, in hexadecimal; through Arrow."""

    def digests(words: pa.Array) -> pa.Array:
        if not _written:
            _written.append(np.array([b"%d " % i for i in range(1 << 16)], "S6"))
        out = []
        for w in words.to_pylist():
            if w is None:
                out.append(None)
            else:  # shorter numbers end with null bytes, which are left out
                out.append(hashlib.md5(_written[0][identity_numbers(w, dim)].tobytes().replace(b"\0", b"")[:-1]).hexdigest())
        return pa.array(out, pa.string())

    return F.arrow_udf(digests, "string")(word)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either has length 0."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot(a, b) / lengths).otherwise(F.lit(0.0))


def scaled(a: Column) -> Column:
    """At length 1; null for length 0."""
    return F.when(norm(a) > 0, F.transform(a, lambda x: (x / norm(a)).cast("float")))


def cosine_of(a, b) -> float:
    lengths = np.linalg.norm(a) * np.linalg.norm(b)
    return float(a @ b / lengths) if lengths else 0.0
