"""The tokenizer: column expressions for tables, and the same rules in Python for single strings."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The word rule that fingerprints stand for.
WORD_PATTERN = r"[^\W_][\w'\-=]*"
LINK = r"https?://\S+"
#: Words that a sentence must have to be trained on.
MIN_WORDS = 3
SHORTEST, LONGEST, HASH_LENGTH = 2, 25, 20
NUMBER = "<NUM>"
#: Scripts written without spaces (Han and Kana); Hangul isn't among them.
UNSPACED = "\\u3400-\\u4DBF\\u4E00-\\u9FFF\\uF900-\\uFAFF\\u3040-\\u309F\\u30A0-\\u30FF"
_SENTENCE = r"[.!?\n]+"


def _normalized(texts: pa.Array) -> pa.Array:
    composed = [t if t is None or t.isascii() else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()]
    return pa.array(composed, pa.string())


def nfkc(text: Column) -> Column:
    """Compatibility composition: Spark has no function for it, so texts pass through Arrow, a batch at a time."""
    return F.arrow_udf(_normalized, "string")(text)


def split_sentences(text: Column) -> Column:
    """Pieces between runs of sentence ends; blank ones are kept."""
    return F.split(text, _SENTENCE, -1)


def valid(word: Column) -> Column:
    """Neither too short nor too long, no base64 padding, no long ASCII string without a vowel."""
    size = F.length(word)
    coded = (size >= HASH_LENGTH) & word.rlike(r"^\p{ASCII}*$") & ~word.rlike("[aeiou]")
    return size.between(SHORTEST, LONGEST) & ~word.endswith("=") & ~coded


def tokenize(text: Column, normalize: bool = True) -> Column:
    """Words of a text in order, numbers as one token, then the two-character windows of unspaced scripts.

    Only ``normalize`` leaves the JVM; texts that are known to be composed need it not."""
    low = F.lower(nfkc(text) if normalize else text)
    clean = F.when(low.contains("http"), F.regexp_replace(low, f"(?U){LINK}", " ")).otherwise(low)
    return _once(clean, _split)


def _once(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` refers to it."""
    return F.transform(F.array(value), f)[0]


def _split(clean: Column) -> Column:
    word = F.lit(r"[\p{L}\p{N}][\p{L}\p{N}_'\-=]*")
    unspaced = (F.octet_length(clean) > F.length(clean)) & clean.rlike(f"[{UNSPACED}]")  # few texts have any
    number = lambda w: (w < ":") & w.rlike("^[0-9]+$")  # noqa: E731  the comparison spares most words the pattern
    words = lambda t: F.transform(F.filter(F.regexp_extract_all(t, word, F.lit(0)), valid), lambda w: F.when(number(w), F.lit(NUMBER)).otherwise(w))
    pairs = F.regexp_extract_all(clean, F.lit(f"(?=([{UNSPACED}]{{2}}))"), F.lit(1))
    return F.when(unspaced, F.concat(words(F.regexp_replace(clean, f"[{UNSPACED}]", " ")), pairs)).otherwise(words(clean))


_url, _word, _unspaced = re.compile(LINK), re.compile(WORD_PATTERN), re.compile(f"[{UNSPACED}]")
_windows = re.compile(f"(?=([{UNSPACED}]{{2}}))")


def tokens(text: str) -> list[str]:
    """``tokenize`` of one string, on the driver."""
    clean = _url.sub(" ", unicodedata.normalize("NFKC", text).lower())
    kept = []
    for w in _word.findall(_unspaced.sub(" ", clean)):
        n = len(w)
        if SHORTEST <= n <= LONGEST and w[-1] != "=" and not (w.isascii() and n >= HASH_LENGTH and not set("aeiou") & set(w)):
            kept.append(NUMBER if re.fullmatch("[0-9]+", w) else w)
    return kept + _windows.findall(clean)


def sentences(text: str) -> list[str]:
    return re.split(_SENTENCE, text)
