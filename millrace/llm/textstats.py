"""Counts over whole texts, and hashed n-gram features, for one text at a time in a worker."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np

#: White space that ends a word: space, and tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Longer texts count their windows in arrays, not in tuples.
MANY_WORDS = 20_000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """The words of a text in UTF-8: runs of anything but the six ASCII white-space characters."""
    data = (text or "").encode()
    return (data.translate(_LOWER) if lower else data).split()


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words lie in a window of `window` words that the text holds at least twice."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    if len(words) <= MANY_WORDS:
        runs = list(zip(*(words[i:] for i in range(window)), strict=False))
        if len(set(runs)) == n:
            return 0
        count = Counter(runs)
        twice = np.fromiter((count[r] > 1 for r in runs), bool, n)
    else:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        run = ids
        for i in range(1, window):
            run = run[:-1] * len(number) + ids[i:]
            run = np.unique(run, return_inverse=True)[1].astype(np.int64)
        twice = np.bincount(run)[run] > 1
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def base_counts(text: str | None, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""
    text = text or ""
    chars = len(text) - sum(text.count(c) for c in SPACES)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(words), chars, sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), repeated_words(words)


class WordHashes(dict):
    """The 32-bit hash of each word met so far; starts anew at `limit` words."""

    def __init__(self, limit: int = 200_000) -> None:
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = value = zlib.crc32(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint32, len(words))


def mixed(h: np.ndarray, bits: int, salt: int = 0) -> np.ndarray:
    """The `bits` top bits of 32-bit numbers after a multiplicative mix."""
    h = (h ^ np.uint32(salt * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0xC2B2AE35)
    return (h >> np.uint32(32 - bits)).astype(np.int64)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def char_grams(points: np.ndarray, order: int) -> np.ndarray:
    """A 32-bit hash for every run of `order` code points."""
    n = len(points) - order + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    h = points[:n] * np.uint32(0x9E3779B1)
    for i in range(1, order):
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0x01000193) + points[i : n + i]
    return h


def word_grams(hashes: np.ndarray, order: int) -> np.ndarray:
    """A 32-bit hash for every run of `order` words."""
    n = len(hashes) - order + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    h = hashes[:n]
    for i in range(1, order):
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + hashes[i : n + i]
    return h


def has_letter(text: str | None) -> bool:
    """Whether any character is a letter in Unicode's sense."""
    return bool(text) and any(map(str.isalpha, text))
