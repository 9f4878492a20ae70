"""A fixed public vocabulary of pieces, and all ways to cut a unit of text into them.

Text is cut into units first: a run of letters for language identification, or a
word with the space before it for tokenising. A unit's lattice has its characters'
boundaries as nodes and the pieces found between them as edges. A character that
is no piece is an edge over its UTF-8 bytes, which the vocabulary always has.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np

#: Longest unit whose lattice is held whole; longer runs are cut (cut_long) or
#: scored in a window (window_log_probability). Products of probabilities may
#: leave a double's range before that, see shares() and log_sums().
UNIT = 40

#: Characters whose edges are looked up at once in a window.
BLOCK = 4096

#: Sums of products below this have lost digits, or all of them.
LOW = 1e-290

#: How the vocabulary writes a space.
SPACE = "▁"


@dataclass
class Vocabulary:
    """Pieces by id. ``byte`` has the ids of the 256 byte pieces."""

    pieces: list[str]
    byte: list[int]
    ids: dict[str, int] = field(default_factory=dict)
    longest: int = 1

    def __post_init__(self) -> None:
        own = set(self.byte)
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in own and p}
        for code in range(128):
            if chr(code) != " ":  # stands for a literal SPACE, see marked()
                self.ids.setdefault(chr(code), self.byte[code])
        self.longest = min(UNIT, max(map(len, self.ids), default=1))

    def __len__(self) -> int:
        return len(self.pieces)

    @cached_property
    def hashed(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the pieces that can be cut from text, ascending, and their ids."""
        by_length = same_length(names := list(self.ids))
        keys = np.zeros(len(names), np.uint64)
        for n, at in by_length.items():
            keys[at] = run_hashes(code_points([names[i] for i in at], n))[:, n]
        order = np.argsort(keys)
        return keys[order], np.fromiter(self.ids.values(), np.int64, len(names))[order]

    @cached_property
    def slots(self) -> np.ndarray:
        """Whether any piece has a hash of these high bits; most strings are no piece."""
        some = np.zeros(1 << _SLOT_BITS, bool)
        some[(self.hashed[0] >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)] = True
        return some

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes, -1 where there is none."""
        keys, ids = self.hashed
        out = np.full(len(hashes), -1, np.int64)
        some = np.flatnonzero(self.slots[(hashes >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)])
        at = np.minimum(np.searchsorted(keys, hashes[some]), len(keys) - 1)
        hit = keys[at] == hashes[some]
        out[some[hit]] = ids[at[hit]]
        return out


_SLOT_BITS = 20

#: Odd multipliers of the strings' hashes, modulo 2**64.
_ODD, _SPREAD = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


def code_points(units: Sequence[str], n: int) -> np.ndarray:
    """Units of n characters as a matrix."""
    return np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n)


def run_hashes(points: np.ndarray) -> np.ndarray:
    """Column i: sum over the first i characters of values times powers of _ODD."""
    powers = np.multiply.accumulate(np.array([1] + [_ODD] * (points.shape[1] - 1), np.uint64))
    value = points.astype(np.uint64) + np.uint64(1)
    value = (value ^ (value << np.uint64(21))) * np.uint64(_SPREAD)
    out = np.zeros((len(points), points.shape[1] + 1), np.uint64)
    np.cumsum((value ^ (value >> np.uint64(29))) * powers, axis=1, dtype=np.uint64, out=out[:, 1:])
    return out


_SWAP = str.maketrans({" ": SPACE, SPACE: " "})


def marked(text: str) -> str:
    """Text as the vocabulary writes it: a space is SPACE, and the character
    SPACE, should a text hold it, a space, which no piece has."""
    return text.translate(_SWAP) if SPACE in text else text.replace(" ", SPACE)


def byte_ids(vocabulary: Vocabulary, edge: int) -> list[int]:
    """The byte pieces of an edge that is no piece."""
    return [vocabulary.byte[b] for b in marked(chr(edge - len(vocabulary))).encode("utf-8", "surrogatepass")]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load(path: str | None = None) -> Vocabulary:
    """The pieces of a SentencePiece model with byte fallback. Control and unknown
    pieces keep their ids but can't be cut from text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or default_path())
    pieces, byte = [], [0] * 256
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte[int(piece[3:5], 16)] = i
        pieces.append("" if model.is_control(i) or model.is_unknown(i) else piece)
    return Vocabulary(pieces, byte)


def cut_long(units: list[str]) -> list[str]:
    """Units of UNIT characters at most."""
    if max(map(len, units), default=0) <= UNIT:
        return units
    out: list[str] = []
    for u in units:
        out.extend(u[i : i + UNIT] for i in range(0, len(u), UNIT)) if len(u) > UNIT else out.append(u)
    return out


def same_length(units: Sequence[str]) -> dict[int, list[int]]:
    """Positions of units by length, so that lattices of one shape are worked together."""
    groups: dict[int, list[int]] = {}
    for i, u in enumerate(units):
        groups.setdefault(len(u), []).append(i)
    return groups


def edges(vocabulary: Vocabulary, units: Sequence[str], n: int) -> dict[tuple[int, int], np.ndarray]:
    """Piece ids of units of n characters by (start, end); -1 where there is no
    piece. A single character without a piece has len(vocabulary) + its code.

    Substrings are looked up by hash, a difference of running sums; a string that
    is no piece is taken for one with a chance of 2**-49 (pieces by hashes)."""
    points, found = code_points(units, n), {}
    run, back = run_hashes(points), pow(_ODD, -1, 2**64)
    scale = np.array([pow(back, start, 2**64) for start in range(n)], np.uint64)
    for length in range(1, min(n, vocabulary.longest) + 1):
        starts = n - length + 1
        hashes = (run[:, length:] - run[:, :starts]) * scale[:starts]
        ids = vocabulary.find(hashes.ravel()).reshape(-1, starts)
        if length == 1:
            ids = np.where(ids < 0, len(vocabulary) + points.astype(np.int64), ids)
        for start in np.flatnonzero((ids >= 0).any(axis=0)).tolist():
            found[start, start + length] = ids[:, start]
    return found


def edge_weights(vocabulary: Vocabulary, p: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Probabilities of edges under the rows of p (pieces by languages, or pieces)."""
    size = len(vocabulary)
    known = (ids >= 0) & (ids < size)
    if known.all():
        return p[ids]
    w = p[np.where(known, ids, 0)]
    w[~known] = 0
    for i in np.flatnonzero(ids >= size):
        w[i] = p[byte_ids(vocabulary, int(ids[i]))].prod(axis=0)
    return w


def forward(vocabulary: Vocabulary, p: np.ndarray, cut: dict[tuple[int, int], np.ndarray], n: int) -> tuple[np.ndarray, dict]:
    """alpha[:, i]: probability, summed over all segmentations, of the first i
    characters; and the weights of the edges."""
    m = len(next(iter(cut.values())))
    alpha = np.zeros((m, n + 1, *p.shape[1:]))
    alpha[:, 0] = 1
    weights = {}
    for (start, end), ids in sorted(cut.items(), key=lambda x: x[0][1]):
        weights[start, end] = w = edge_weights(vocabulary, p, ids)
        alpha[:, end] += alpha[:, start] * w
    return alpha, weights


def shares(alpha: np.ndarray, weights: dict[tuple[int, int], np.ndarray]) -> dict[tuple[int, int], np.ndarray]:
    """Of each edge, its part of the sum at its end (forward() with p of one axis).
    Units whose sums leave a double's range are summed again, each boundary with
    an exponent of its own; powers of two change no digit of a share."""
    share = {(s, e): alpha[:, s] * w / np.maximum(alpha[:, e], LOW) for (s, e), w in weights.items()}
    low = np.flatnonzero(alpha.min(axis=1) < LOW)
    if len(low):
        into: dict[int, list[int]] = {}
        for start, end in weights:
            into.setdefault(end, []).append(start)
        exponent, part = np.zeros((len(low), alpha.shape[1]), np.int64), np.ones((len(low), alpha.shape[1]))
        for end in range(1, alpha.shape[1]):
            w = np.stack([weights[s, end][low] for s in into[end]], axis=1)
            top = np.where(w > 0, exponent[:, into[end]], -(2**30)).max(axis=1)
            by = np.where(w > 0, exponent[:, into[end]] - top[:, None], 0)
            flow = np.ldexp(part[:, into[end]] * w, by)
            for i, start in enumerate(into[end]):
                share[start, end][low] = flow[:, i] / flow.sum(axis=1)
            part[:, end], shift = np.frexp(flow.sum(axis=1))
            exponent[:, end] = top + shift
    return share


def log_sums(weights: dict[tuple[int, int], np.ndarray], rows: np.ndarray, n: int, back: bool = False) -> np.ndarray:
    """Logarithms of the sums over all segmentations up to each boundary, or from
    it on (``back``), of the units ``rows``: for those whose sums leave a double's
    range."""
    first = next(iter(weights.values()))
    out = np.full((len(rows), n + 1, *first.shape[1:]), -np.inf)
    out[:, n if back else 0] = 0
    with np.errstate(divide="ignore"):
        for (start, end), w in sorted(weights.items(), key=lambda x: -x[0][0] if back else x[0][1]):
            a, b = (end, start) if back else (start, end)
            out[:, b] = np.logaddexp(out[:, b], out[:, a] + np.log(w[rows]))
    return out


def low_units(ends: np.ndarray) -> np.ndarray:
    """Units of which some sum has left a double's range."""
    return np.flatnonzero((ends < LOW).reshape(len(ends), -1).any(axis=1))


def log_probability(vocabulary: Vocabulary, p: np.ndarray, units: Sequence[str]) -> np.ndarray:
    """Log probability of each unit under each language, all segmentations summed."""
    out = np.zeros((len(units), *p.shape[1:]))
    for n, at in same_length(units).items():
        if n > UNIT:
            for i in at:
                out[i] = window_log_probability(vocabulary, p, units[i])
            continue
        cut = edges(vocabulary, [units[i] for i in at], n)
        alpha, weights = forward(vocabulary, p, cut, n)
        low = low_units(alpha[:, n])
        found = np.log(np.maximum(alpha[:, n], LOW))
        if len(low):
            found[low] = log_sums(weights, low, n)[:, n]
        out[at] = found
    return out


def window_log_probability(vocabulary: Vocabulary, p: np.ndarray, unit: str) -> np.ndarray:
    """As log_probability, of one unit of any length and in memory that doesn't grow
    with it: sums wait for their boundary in a window as long as the longest piece,
    and at each boundary the greatest of them is taken out as a logarithm."""
    reach = vocabulary.longest
    ahead, out = np.zeros((reach + 1, *p.shape[1:])), np.zeros(p.shape[1:])
    ahead[0] = 1
    for at in range(0, len(unit), BLOCK):
        part = unit[at : at + BLOCK + reach - 1]
        leaving: list[list[tuple[int, int]]] = [[] for _ in part]
        for (start, end), ids in edges(vocabulary, [part], len(part)).items():
            leaving[start].append((end - start, int(ids[0])))
        for own in leaving[:BLOCK]:
            lengths, ids = np.array(own).T
            ahead[lengths] += ahead[0] * edge_weights(vocabulary, p, ids)
            ahead[:-1], ahead[-1] = ahead[1:].copy(), 0
            top = ahead.max(axis=0)
            top = np.where(top > 0, top, 1.0)
            ahead /= top
            out += np.log(top)
    with np.errstate(divide="ignore"):
        return out + np.log(ahead[0])


def expected_counts(vocabulary: Vocabulary, p: np.ndarray, units: Sequence[str], counts: np.ndarray) -> np.ndarray:
    """How often each piece is used in the units, on average over their
    segmentations (p has one column for each row of counts' second axis)."""
    total = np.zeros((len(vocabulary), p.shape[1]))
    for n, at in same_length(units).items():
        own = [units[i] for i in at]
        cut = edges(vocabulary, own, n)
        alpha, weights = forward(vocabulary, p, cut, n)
        beta = np.zeros_like(alpha)
        beta[:, n] = 1
        for (start, end), w in sorted(weights.items(), key=lambda x: -x[0][0]):
            beta[:, start] += w * beta[:, end]
        low = low_units(alpha[:, n])
        if len(low):
            log_alpha, log_beta = log_sums(weights, low, n), log_sums(weights, low, n, back=True)
        scale = counts[at] / np.maximum(alpha[:, n], LOW)
        for (start, end), ids in cut.items():
            use = alpha[:, start] * weights[start, end] * beta[:, end] * scale
            if len(low):
                with np.errstate(divide="ignore"):
                    share = log_alpha[:, start] + np.log(weights[start, end][low]) + log_beta[:, end] - log_alpha[:, n]
                use[low] = np.exp(share) * counts[at][low]
            known = (ids >= 0) & (ids < len(vocabulary))
            for column in range(p.shape[1]):
                total[:, column] += np.bincount(ids[known], use[known, column], len(vocabulary))
            for i in np.flatnonzero(ids >= len(vocabulary)):
                for b in byte_ids(vocabulary, int(ids[i])):
                    total[b] += use[i]
    return total
