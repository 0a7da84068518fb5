"""Words of a text, whatever its case, spacing, markup and form of characters."""

from __future__ import annotations

import html
import re
import unicodedata

import numpy as np
import regex
import xxhash

_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,200}>")
_ENTITY = re.compile(r"&(?:[A-Za-z]{2,8}|#\d{1,6}|#x[0-9A-Fa-f]{1,6});")
_BROKEN = re.compile(r"(?<=[^\W\d_])[-‐‑­]\s*\n\s*(?=[^\W\d_])")
_GROUPED = re.compile(r"(?<=\d)[,.'’   ](?=\d{3}(?!\d))")
_WORD = re.compile(r"[^\W_]+")
_MARKS = regex.compile(r"[\p{Mn}\p{Cf}\p{Me}]+")
#: Letters of other alphabets that look like Latin ones.
_ALIKE = str.maketrans("аеорсухіјѕԁһкмтвнзαεορτνικυχ", "aeopcyxijsdhkmtbh3aeoptvikux")


def plain(text: str) -> str:
    """``text`` in lower case, with plain letters, without markup and invisible characters."""
    if "<" in text:
        text = _TAG.sub("", text)
    if "&" in text:
        text = _ENTITY.sub(lambda m: " " if m.group() in ("&nbsp;", "&#160;") else html.unescape(m.group()), text)
    text = _BROKEN.sub("", text)
    if text.isascii():
        text = text.lower()
    else:
        text = unicodedata.normalize("NFKD", text).casefold()
        text = _MARKS.sub("", text).translate(_ALIKE)
    return _GROUPED.sub("", text)


def words(text: str | None) -> list[str]:
    """The words of ``text``; none of a null or blank text."""
    return _WORD.findall(plain(text)) if text else []


def spread(documents):
    """``documents`` over at least as many partitions as there are cores; moved only where a small scan has fewer."""
    cores = documents.sparkSession.sparkContext.defaultParallelism
    return documents.repartition(cores) if documents.rdd.getNumPartitions() < cores else documents


class Hasher:
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self, bound: int = 400_000):
        self.seen: dict[str, int] = {}
        self.bound = bound

    def __call__(self, tokens: list[str]) -> np.ndarray:
        seen = self.seen
        if len(seen) > self.bound:
            seen.clear()
        out = np.empty(len(tokens), dtype=np.uint64)
        for i, w in enumerate(tokens):
            h = seen.get(w)
            if h is None:
                h = seen[w] = xxhash.xxh3_64_intdigest(w)
            out[i] = h
        return out


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of ``k`` words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, dtype=np.uint64)
        for i in range(k):
            out = out * np.uint64(0x100000001B3) + hashes[i : i + n]
        out ^= out >> np.uint64(29)
        return out * np.uint64(0xBF58476D1CE4E5B9)


def winnow(fingerprints: np.ndarray, window: int) -> np.ndarray:
    """Positions of the least fingerprint of every ``window`` adjacent ones, the last of equal ones."""
    n = len(fingerprints)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    if n <= window:
        return np.array([n - 1 - int(np.argmin(fingerprints[::-1]))])
    stacked = np.lib.stride_tricks.sliding_window_view(fingerprints, window)[:, ::-1]
    return np.unique(np.arange(n - window + 1) + window - 1 - stacked.argmin(axis=1))
