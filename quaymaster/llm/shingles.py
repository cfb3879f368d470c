"""Sets of hashed word shingles, made for many texts at once."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import keeps_cache, mix, take_turn

#: Words whose hashes a worker keeps at hand.
CACHED_WORDS = 300_000

# Odd multipliers, one for each place in a shingle, from a fixed generator.
_PLACES = np.random.default_rng(20240607).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


_hashes = _WordHashes()
keeps_cache("shingles", _hashes.clear)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all lower-cased words (split at ASCII white space), and the number of words per text."""
    take_turn("shingles")
    if len(_hashes) > CACHED_WORDS:
        _hashes.clear()
    split = [t.lower().split() for t in texts]
    count = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
    flat = np.fromiter((_hashes[w] for words in split for w in words), dtype=np.uint64, count=int(count.sum()))
    return flat, count


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes; a text with fewer words has its whole sequence as one."""
    flat, count = word_hashes(texts)
    start = np.cumsum(count) - count
    sums = np.zeros(max(0, len(flat) - width + 1), dtype=np.uint64)
    for i in range(width):
        sums += flat[i : i + len(sums)] * _PLACES[i]
    hashed = mix(sums + np.uint64(width))
    sets = []
    for s, n in zip(start.tolist(), count.tolist(), strict=True):
        if n >= width:
            sets.append(np.unique(hashed[s : s + n - width + 1]))
        elif n:
            sets.append(mix((flat[s : s + n] * _PLACES[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n)))
        else:
            sets.append(np.empty(0, dtype=np.uint64))
    return sets


def set_key(shingles: np.ndarray) -> int:
    """A 64-bit name of a set, as a signed number."""
    return int(mix(mix(shingles).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(shingles))).view(np.int64)[0])
