"""Sets of word shingles as sorted arrays of 62-bit hashes.

Words are lower-cased in A-Z and separated by ASCII white space. Texts are worked
as bytes, many at once: a word's hash is a difference of running sums of
byte values times powers of an odd number, a shingle's hash mixes its words'.
Equal shingles have equal hashes; unequal ones collide with a chance of 2**-62.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache

import numpy as np

#: Words of a shingle.
WORDS = 5

#: Characters that are worked at once.
CHUNK = 1 << 19

_ODD = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _byte_values() -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
    values[65:91] = values[97:123]  # A-Z as a-z
    return values


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _ODD and of its inverse, modulo 2**64."""

    def powers(base: int) -> np.ndarray:
        p = np.full(n, base, np.uint64)
        p[0] = 1
        return np.multiply.accumulate(p)

    return powers(_ODD), powers(pow(_ODD, -1, 2**64))


@cache
def _is_space() -> np.ndarray:
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    return space


def _size(n: int) -> int:
    """Few sizes, so that the powers are made once."""
    return max(2 * CHUNK, 1 << n.bit_length())


def located_words(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, where each begins, and the bytes
    of the texts, each with a line end after it."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    gap = _is_space()[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap]).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    up, down = _powers(_size(len(data) + 1))
    values = _byte_values()[data] * up[: len(data)]
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return mix((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64)), start, data


def word_hashes(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and the text that each is in."""
    words, start, _ = located_words(texts)
    opens = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return words, np.searchsorted(opens, start, side="right") - 1


def shingle_hashes(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts, and the text that each is in. A text
    of fewer words is one shingle of all of them; one without words has none."""
    words, owner = word_hashes(texts)
    n = np.bincount(owner, minlength=len(texts))
    powers = [np.uint64(pow(_ODD, i + 1, 2**64)) for i in range(WORDS)]
    m = max(0, len(words) - WORDS + 1)
    whole = np.flatnonzero(owner[:m] == owner[WORDS - 1 :]) if m else np.zeros(0, np.int64)
    mixed = sum((words[whole + i] * p for i, p in enumerate(powers)), np.zeros(len(whole), np.uint64))
    few = np.flatnonzero((n > 0) & (n < WORDS))
    first = np.cumsum(n) - n
    own = [sum((int(words[first[t] + i]) * int(powers[i]) for i in range(n[t])), int(n[t])) % 2**64 for t in few.tolist()]
    hashes = mix(np.concatenate([mixed + np.uint64(WORDS), np.array(own, np.uint64)])) >> np.uint64(2)
    return hashes, np.concatenate([owner[whole], few])


#: Marks shingles that come last in the global order; marked ones still fit a long.
LATE = np.uint64(1 << 62)


def shingle_sets(texts: Sequence[bytes], late: np.ndarray | None = None) -> list[np.ndarray]:
    """For each text its distinct shingles, ascending; those in ``late`` (sorted)
    carry LATE and so stand at the end."""
    hashes, owner = shingle_hashes(texts)
    if late is not None and len(late):
        at = np.minimum(np.searchsorted(late, hashes), len(late) - 1)
        hashes = np.where(late[at] == hashes, hashes | LATE, hashes)
    order = np.argsort(owner, kind="stable")
    hashes = hashes[order]
    end = np.cumsum(np.bincount(owner, minlength=len(texts)))
    out = []
    for a, b in zip(np.concatenate([[0], end[:-1]]), end, strict=True):
        own = np.sort(hashes[a:b])
        out.append(own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own)
    return out


def set_id(own: np.ndarray) -> int | None:
    """A hash of the whole set (marks left out); None for the empty set."""
    if not len(own):
        return None
    total = mix(own & ~LATE).sum(dtype=np.uint64)
    return int(mix(np.array([total + np.uint64(len(own))]))[0].astype(np.int64))


def signature(own: np.ndarray) -> np.ndarray:
    """A bitmap of the set: a power of two of bits, eight to sixteen for each member."""
    bits = max(64, 1 << (8 * len(own) - 1).bit_length())
    at = (own & ~LATE) % np.uint64(bits)
    flags = np.zeros(bits, np.uint8)
    flags[at.astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").view(np.uint64)


def folded(signature: np.ndarray, words: int) -> np.ndarray:
    """The bitmap of fewer bits that the same set has."""
    return np.bitwise_or.reduce(signature.reshape(-1, words), axis=0)


def overlap_bound(n: int, own: np.ndarray, sizes: np.ndarray, others: np.ndarray) -> np.ndarray:
    """At most so many members can be common: a bit that only one of two bitmaps
    has stands for a member that the other set lacks."""
    lacks = np.bitwise_count(own & ~others).sum(axis=1, dtype=np.int64)
    lacked = np.bitwise_count(others & ~own).sum(axis=1, dtype=np.int64)
    return np.minimum(n - lacks, sizes - lacked)
