"""Words, word hashes and shingle sets, over UTF-8 bytes.

`bytes.lower` folds A-Z alone and `bytes.split` cuts at the characters 9-13 and
32 alone, so a word here is `[^\\x20\\x09-\\x0D]+` of the text lower-cased A-Z.
"""

from __future__ import annotations

import re

import numpy as np

#: Distinct words whose hashes one task remembers; it only saves hashing them again.
REMEMBERED = 100_000

_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hash of a word; forgets all when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


#: A number for each byte, the same for both cases of A-Z, and the bytes between words.
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64))
_BYTES[65:91] = _BYTES[97:123]
_BETWEEN = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BREAK = re.compile(rb"[\x09-\x0d\x20]")
#: Bytes hashed at a time; a longer word is taken whole.
BLOCK = 1 << 18


class Words:
    """64-bit hashes of the words of a text, by a polynomial over their bytes for many words at once."""

    base = 0x9E3779B97F4A7C15

    def __init__(self) -> None:
        self._reach(BLOCK + (1 << 12))

    def _reach(self, n: int) -> None:
        factors = np.full(n, self.base, np.uint64)
        factors[0] = 1
        self.powers = np.multiply.accumulate(factors)
        factors[1:] = pow(self.base, -1, 1 << 64)
        self.back = np.multiply.accumulate(factors)

    def _block(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer(data, np.uint8)
        if len(raw) > len(self.powers):
            self._reach(len(raw))
        between = np.ones(len(raw) + 2, bool)
        between[1:-1] = _BETWEEN[raw]
        edges = np.flatnonzero(between[1:] != between[:-1])
        starts, ends = edges[::2], edges[1::2]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[raw] * self.powers[: len(raw)])])
        return mixed((total[ends] - total[starts]) * self.back[starts]), starts

    def placed(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each word, and the byte it starts at."""
        hashes, starts, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
        while at < len(text):
            cut = _BREAK.search(text, at + BLOCK)
            end = cut.start() if cut else len(text)
            found, where = self._block(text[at:end])
            hashes.append(found)
            starts.append(where + at)
            at = end
        return np.concatenate(hashes), np.concatenate(starts)

    def of(self, text: bytes) -> np.ndarray:
        return self.placed(text)[0]

    def of_all(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of texts, one after the other, and where each text's begin, with the end of all."""
        hashes, starts = self.placed(b" ".join(texts))
        ends = np.cumsum([len(t) + 1 for t in texts])
        return hashes, np.concatenate([[0], np.searchsorted(starts, ends)])


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; of the whole sequence where it is shorter; none of nothing."""
    k = min(k, len(hashes))
    if not k:
        return hashes
    n = len(hashes) - k + 1
    total = np.full(n, k, np.uint64)
    for i in range(k):
        total = mixed(total + hashes[i : i + n] + _STEP)
    return total


def shingle_sets(texts: list[bytes | None], k: int, known: Words) -> list[np.ndarray]:
    """Distinct shingles of k words of each text, sorted."""
    hashes, at = known.of_all([t or b"" for t in texts])
    return [np.unique(grams(hashes[i:j], k)) for i, j in zip(at, at[1:])]
