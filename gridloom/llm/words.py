"""Words and word hashes for the operators on shingles. Used on the executors."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")
#: Characters that are split into words at once; a longer text is cut at a word's end.
STEP = 1 << 20


def words_of(text: str) -> Iterator[list[str]]:
    """The lower-case words of a text, in lists of bounded size."""
    if len(text) <= STEP:
        yield WORD.findall(text.lower())
        return
    at, n = 0, len(text)
    while at < n:
        end = min(at + STEP, n)
        while end < n and (text[end].isalnum() or text[end - 1].isalnum()):
            end += 1
        yield WORD.findall(text[at:end].lower())
        at = end


class Hashes(dict):
    """word -> 64-bit hash; forgets all when it has grown to `most` words."""

    most = 400_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h

    def of(self, text: str) -> np.ndarray:
        parts = [np.fromiter(map(self.__getitem__, w), np.uint64, len(w)) for w in words_of(text)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(h: np.ndarray, size: int = 5) -> np.ndarray:
    """Hashes of each run of `size` words; a shorter text with words is one shingle."""
    n = len(h)
    if not n:
        return np.empty(0, np.uint64)
    size = min(size, n)
    out = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : n - size + 1 + k])
    return out
