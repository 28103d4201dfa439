"""A unigram vocabulary read from a SentencePiece model file: pieces and scores, and how text is cut into independent units.

Where no piece has two characters next to each other, no piece crosses from one to the other, so a text's lattice is a chain of
independent lattices. Such borders lie before space marks, at line breaks, before most punctuation. Units between them are short
and repeat; what is found for one holds for all.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from .bytes_text import mix

#: SentencePiece model; any file of the same kind may be given.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
_PAIR_BITS = 20
_R = np.uint64(0x9E3779B97F4A7C15)
_loaded: dict[str, "Vocabulary"] = {}
_powers: dict[str, np.ndarray] = {}


class Vocabulary(NamedTuple):
    pieces: dict[str, tuple[int, float]]  # ordinary pieces: (id, score)
    unknown: float  # score of a character without a piece, as SentencePiece has it: 10 below the lowest
    byte: list[int]  # ids of the byte pieces
    surface: list[str | int]  # by id: text, or the byte
    joined: np.ndarray  # hash of two characters -> whether some piece has them next to each other


def load(path: str = MODEL) -> Vocabulary:
    """Read once in each process."""
    if path not in _loaded:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        pieces = {sp.id_to_piece(i): (i, sp.get_score(i)) for i in range(n) if not special[i]}
        byte = [-1] * 256
        surface: list[str | int] = [p if p in pieces else "" for p in map(sp.id_to_piece, range(n))]
        for i in range(n):
            if sp.is_byte(i):
                value = int(sp.id_to_piece(i)[3:-1], 16)
                byte[value], surface[i] = i, value
        if min(byte) < 0:
            raise ValueError(f"{path}: it lacks byte pieces, so not every text has an encoding")
        x, y = (code_points("".join(p[k : len(p) - 1 + k] for p in pieces)) for k in (0, 1))
        joined = np.zeros(1 << _PAIR_BITS, bool)
        joined[_pair(x, y)] = True
        _loaded[path] = Vocabulary(pieces, min(s for _, s in pieces.values()) - 10, byte, surface, joined)
    return _loaded[path]


def _pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return ((x * np.uint32(0x9E3779B1)) ^ (y * np.uint32(0x85EBCA77))) >> np.uint32(32 - _PAIR_BITS)


class Units(NamedTuple):
    """The units of some texts, laid end to end, and the different ones among them."""

    text: np.ndarray  # of each unit
    which: np.ndarray  # of each unit: its number among the different ones
    points: np.ndarray  # code points of the different ones, end to end
    size: np.ndarray  # their lengths
    key: np.ndarray  # their hashes


def rolling(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, inverse powers): points[a:b] has the hash (sums[b] - sums[a]) * inverse[a]."""
    n = len(points)
    if len(_powers.get("r", ())) <= n:
        m = 1 << max(20, n.bit_length())
        powers = {}
        for name, base in (("r", _R), ("ri", np.uint64(pow(int(_R), -1, 1 << 64)))):
            powers[name] = np.full(m, base)
            powers[name][0] = 1
            np.multiply.accumulate(powers[name], out=powers[name])
        if m == 1 << 20:  # those of a long text aren't kept
            _powers.update(powers)
    else:
        powers = _powers
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(points.astype(np.uint64) + np.uint64(1)) * powers["r"][:n], out=sums[1:])
    return sums, powers["ri"][: n + 1]


def units(texts: list[str], path: str = MODEL) -> Units:
    """With marks for spaces and one in front, as SentencePiece has it; an empty text has no unit."""
    points = code_points("".join([MARK + t for t in texts if t]).replace(" ", MARK))
    length = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
    border = np.cumsum(length)
    if not len(points):
        z = np.zeros(0, np.int64)
        return Units(z, z, points, z, np.zeros(0, np.uint64))
    head = np.ones(len(points), bool)
    head[1:] = ~load(path).joined[_pair(points[:-1], points[1:])]
    head[(border - length)[length > 0]] = True
    start = np.flatnonzero(head)
    end = np.r_[start[1:], len(points)]
    sums, inverse = rolling(points)
    key, at, which = np.unique((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64), return_index=True, return_inverse=True)
    start, size = start[at], (end - start)[at]
    inside = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    return Units(np.searchsorted(border, np.flatnonzero(head), "right"), which, points[inside], size, key)


def decode(ids: list[int], path: str = MODEL) -> str:
    """The text of which ``ids`` are an encoding."""
    surface, out = load(path).surface, bytearray()
    for i in ids:
        s = surface[i]
        if isinstance(s, int):
            out.append(s)
        else:
            out += s.encode("utf-8", "surrogatepass")
    return out.decode("utf-8", "replace").replace(MARK, " ")[1:]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
