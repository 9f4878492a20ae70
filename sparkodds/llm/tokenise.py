"""Sampled segmentations of text into the pieces of a public vocabulary, and back.

Forward filtering sums, for every boundary of a unit, the probability of what
stands before it; backward sampling then walks from the unit's end, choosing each
piece with the probability that the sums give it. That draws a segmentation
exactly by its share of all segmentations. The random numbers are a hash of the
row's key, the unit's place and the step, so a rerun, another partitioning or a
lost executor gives the same pieces.

All units of a few million characters are walked together. A unit's lattice is
built once and kept as a run of one sorted array, node number and cumulative
probability of its edges, so a step of all walks is one search.

Decoding joins the pieces' bytes and gives back every text exactly: spaces,
line ends, characters without a piece and the vocabulary's own space mark.

Defined results: null text has null pieces and decodes to null; empty text has
none; a null key is a key of its own; rows with equal key and text get equal
pieces. Only key and text are read, and the columns asked for are kept.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkodds.llm import pieces
from sparkodds.llm.common import give_back, numbered, read, spans

#: Of marked text.
UNITS = re.compile(rf"\n|{pieces.SPACE}?[^{pieces.SPACE}\n]+|{pieces.SPACE}+")

#: Units that a task remembers, and characters that it cuts at once.
REMEMBERED, CHARS = 160_000, 2_000_000


def weights(vocabulary: pieces.Vocabulary, power: float = 0.5) -> np.ndarray:
    """Piece probabilities by Zipf's law over the vocabulary's order, which is the
    order of usefulness; byte pieces come after all others. A power below 1 makes
    segmentations more alike in probability, so that sampling varies more."""
    p = np.zeros(len(vocabulary))
    own = set(vocabulary.byte)
    ranked = [i for i, x in enumerate(vocabulary.pieces) if x and i not in own]
    p[ranked] = 1 / (10 + np.arange(len(ranked)))
    p[vocabulary.byte] = 1 / (10 + len(ranked))
    p[p > 0] **= power
    return p / p.sum()


def units(text: str) -> list[str]:
    return pieces.cut_long(UNITS.findall(pieces.marked(text)))


class Lattices:
    """Lattices of known units, laid end to end.

    Node ``last[u] - n + i`` is boundary i of unit u (n characters). Of each
    node's edges ``limit`` has node * 2**32 + cumulative probability * 2**32 in
    whole numbers, so that a draw doesn't depend on where a lattice lies;
    ``piece`` is the piece and ``before`` the node where the edge starts, -1 at the
    unit's start."""

    def __init__(self, vocabulary: pieces.Vocabulary, p: np.ndarray) -> None:
        self.vocabulary, self.p = vocabulary, p
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.last = np.zeros(0, np.int64)
        self.limit, self.piece, self.before = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.nodes = 0

    def add(self, new: list[str]) -> None:
        last, limit, piece, before = [self.last], [self.limit], [self.piece], [self.before]
        for n, at in pieces.same_length(new).items():
            own = [new[i] for i in at]
            cut = pieces.edges(self.vocabulary, own, n)
            alpha, w = pieces.forward(self.vocabulary, self.p, cut, n)
            base = self.nodes + n * np.arange(len(own))
            columns = sorted(cut, key=lambda x: (x[1], x[0]))  # by node, that is by end
            of_edge = pieces.shares(alpha, w)
            share = np.stack([of_edge[c] for c in columns], axis=1)
            total = np.zeros_like(share)
            for end in range(1, n + 1):
                of = [i for i, (_, e) in enumerate(columns) if e == end]
                total[:, of] = np.cumsum(share[:, of], axis=1)
                # The last edge there is ends at one, whatever was rounded.
                nth = share[:, of].shape[1] - 1 - (share[:, of][:, ::-1] > 0).argmax(axis=1)
                total[np.arange(len(own)), np.array(of)[nth]] = 1.0
            ends, starts = np.array([e for _, e in columns]), np.array([s for s, _ in columns])
            there = share > 0
            limit.append(((base[:, None] + ends - 1 << 32) + (total * 2.0**32).astype(np.int64))[there])
            piece.append(np.stack([cut[c] for c in columns], axis=1).astype(np.int32)[there])
            before.append(np.where(starts > 0, base[:, None] + starts - 1, -1).astype(np.int32)[there])
            last.append(base + n - 1)
            self.known.update(zip(own, range(len(self.known), len(self.known) + len(own)), strict=True))
            self.nodes += n * len(own)
        self.last, self.limit = np.concatenate(last), np.concatenate(limit)
        self.piece, self.before = np.concatenate(piece), np.concatenate(before)

    @classmethod
    def of(cls, vocabulary: pieces.Vocabulary) -> Lattices:
        """The lattices of this Python worker, kept from one task to the next."""
        key = tuple(vocabulary.pieces)
        if key not in _KEPT:
            _KEPT.clear()
            _KEPT[key] = cls(vocabulary, weights(vocabulary))
        return _KEPT[key]

    def numbers(self, found: list[str]) -> np.ndarray:
        new = set(found).difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.clear()
            new = set(found)
        if new:
            self.add(sorted(new))
        return np.fromiter(map(self.known.__getitem__, found), np.int64, len(found))


_KEPT: dict[tuple, Lattices] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers mixed so that neighbours share nothing (a finaliser
    by shifts and multiplications)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(key: np.ndarray, place: np.ndarray, step: int) -> np.ndarray:
    """Numbers below 2**32 by row key, unit and step."""
    of_step = np.uint64((step + 1) * 0xD1342543DE82EF95 % 2**64)
    x = mixed(mixed(key + place * np.uint64(0x9E3779B97F4A7C15)) + of_step)
    return (x >> np.uint64(32)).astype(np.int64)


def row_key(key: object, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{seed}:{key}".encode(), digest_size=8).digest(), "little")


def sample(lattices: Lattices, texts: list[str], keys: list[int]) -> list[np.ndarray]:
    """Piece ids of each text."""
    split = [units(t) for t in texts]
    lengths = np.array([len(s) for s in split])
    found = [u for s in split for u in s]
    if not found:
        return [np.zeros(0, np.int64) for _ in texts]
    numbers = lattices.numbers(found)
    node = lattices.last[numbers]
    key = np.repeat(np.array(keys, np.uint64), lengths)
    first = np.cumsum(lengths) - lengths
    place = (np.arange(len(found)) - np.repeat(first, lengths)).astype(np.uint64)
    # Walks over one lattice stand together, so that searches stay in one place.
    walks, taken, n_taken = np.argsort(numbers, kind="stable"), [], np.zeros(len(found), np.int64)
    while len(walks):
        u = uniform(key[walks], place[walks], len(taken))
        edge = np.searchsorted(lattices.limit, (node[walks] << 32) + u, side="right")
        taken.append((walks, lattices.piece[edge]))
        n_taken[walks] += 1
        node[walks] = lattices.before[edge]
        walks = walks[node[walks] >= 0]
    end = np.cumsum(n_taken)
    ids = np.empty(end[-1], np.int64)
    for step, (walk, piece) in enumerate(taken):  # walks go from a unit's end to its start
        ids[end[walk] - 1 - step] = piece
    size = len(lattices.vocabulary)
    bounds = np.concatenate([[0], end])[np.concatenate([first, [len(found)]])]
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        own = ids[a:b]
        if (own >= size).any():
            parts = [pieces.byte_ids(lattices.vocabulary, i) if i >= size else [i] for i in own.tolist()]
            own = np.array([i for p in parts for i in p], np.int64)
        out.append(own)
    return out


def encode(
    docs: DataFrame, vocabulary: pieces.Vocabulary, keep: list[Column | str], key: str = "doc_id", seed: int = 7
) -> DataFrame:
    """``keep`` columns and ``pieces``: piece ids of a sampled segmentation."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows, schema, back = numbered(docs, keep, key=F.col(key).cast("string"), text=F.col("text"))

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        give_back()
        lattices = Lattices.of(shared.value)
        for part in parts:
            texts = [t if isinstance(t, str) else "" for t in part["text"]]
            keys = [row_key(k, seed) for k in part["key"]]
            for piece in spans([len(t) for t in texts], CHARS):
                ids = sample(lattices, texts[piece], keys[piece])
                give_back()
                out = part.drop(columns=["key", "text"]).iloc[piece].copy()
                missing = part["text"].iloc[piece].isna()
                out["pieces"] = pd.Series(
                    [None if m else i.astype(np.int32) for i, m in zip(ids, missing, strict=True)], out.index, object
                )
                yield out

    return back(rows.mapInPandas(cut, f"{schema}, pieces array<int>"))


def decode(rows: DataFrame, vocabulary: pieces.Vocabulary, keep: list[Column | str]) -> DataFrame:
    """``keep`` columns and ``decoded``, the text of the pieces."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)
    rows, schema, back = numbered(rows, keep, pieces=F.col("pieces"))

    def join(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = [pieces.marked(p).encode() for p in shared.value.pieces]
        for value, piece in enumerate(shared.value.byte):
            own[piece] = bytes([value])
        get = own.__getitem__
        for part in parts:
            for piece in spans([0 if i is None else len(i) for i in part["pieces"]], CHARS):
                out = part.drop(columns="pieces").iloc[piece].copy()
                ids = part["pieces"].iloc[piece]
                out["decoded"] = [None if i is None else b"".join(map(get, i.tolist())).decode("utf-8", "replace") for i in ids]
                yield out

    return back(rows.mapInPandas(join, f"{schema}, decoded string"))


def op5_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: pieces, their digest, and whether they decode to its text."""
    vocabulary = pieces.load()
    encoded = encode(read(spark, sf_dir, "documents"), vocabulary, ["doc_id", "text"])
    digest = F.xxhash64("pieces").alias("pieces_hash")
    n = F.coalesce(F.size("pieces"), F.lit(0)).cast("long").alias("n_pieces")
    decoded = decode(encoded.withColumn("n_pieces", n).withColumn("pieces_hash", digest), vocabulary, ["doc_id", "n_pieces", "pieces_hash", "text"])
    return decoded.select("doc_id", "n_pieces", "pieces_hash", F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"))
