"""Alignment of two tokenizers' tokens over the same bytes.

Each text, with a space before it, is cut by two public tokenizers: a byte-level
BPE and a piece BPE that adds the space itself. Their tokens are the same bytes
cut in two ways, so each cutting is an ascending list of byte offsets where tokens
end. The lists are intersected by galloping: the shorter one drives, and for each
of its offsets the place in the longer is found by steps of doubling length from
the place before and a binary search in the last step. Offsets that both lists
hold cut the tokens into groups; the differences of successive ranks are the
ranges of tokens that overlap. Many texts are intersected at once, as lanes of
LANE offsets that gallop side by side.

How many documents hold a linked pair of ids is a sum by pair. Every document's
distinct pairs are written once; the counts of the most frequent pairs, HEAD of
them at most, go to the executors, and the other pairs are joined with the table
of counts, so the result is exact at any number of pairs and no broadcast grows
beyond HEAD pairs.

Defined results: null and empty texts, and texts whose tokens don't give back
their bytes in either tokenizer (those with the piece vocabulary's space mark),
have no tokens, no groups and an empty digest. Rows that repeat are documents of
their own, also with equal or null ids. Strings of special tokens are plain text.
Only the text is read, and the columns asked for are kept whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cached_property
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkodds.llm.common import read, spans
from sparkodds.session import materialize

#: Offsets that a lane gallops over, characters of a batch, units that a worker
#: remembers, and the longest of them.
LANE, CHARS, REMEMBERED, LONGEST = 64, 1_500_000, 250_000, 64

#: Pairs whose counts are sent to the executors, 12 bytes each.
HEAD = 1 << 21

#: A run of so much white space is more than the fast tokenizer's pattern bears.
GAP = re.compile(r"\s{20000}")

#: No token of either vocabulary reaches over a single space that stands between
#: a character other than a space and one that is no white space; see ``units``.
PART, ODD = re.compile(r"(?<=[^ ]) (?=\S)"), re.compile(r" \s|^ | $")


def units(text: str) -> list[str]:
    """The text in parts that are cut alone as they are within it, each with the
    space before it."""
    return PART.split(text) if ODD.search(text) else text.split(" ")


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each number of the ascending ``short`` how many of ``long`` are less."""
    m = len(long)
    long = np.append(long, np.iinfo(np.int64).max)
    rank = np.empty(len(short), np.int64)
    lanes = np.arange(0, len(short), LANE)
    at = np.searchsorted(long, short[lanes])
    for step in range(min(LANE, len(short))):
        own = lanes[: len(lanes) - (lanes[-1] + step >= len(short))] + step
        x, low = short[own], at[: len(own)].copy()
        high, width = low.copy(), 1
        live = np.flatnonzero(long[high] < x)
        while len(live):
            low[live] = high[live] + 1
            high[live] = np.minimum(high[live] + width, m)
            width *= 2
            live = live[long[high[live]] < x[live]]
        live = np.flatnonzero(low < high)
        while len(live):
            middle = (low[live] + high[live]) >> 1
            less = long[middle] < x[live]
            low[live[less]] = middle[less] + 1
            high[live[~less]] = middle[~less]
            live = live[low[live] < high[live]]
        rank[own] = at = low
    return rank


class Tokenizers:
    """A pair of public tokenizers; loads in each worker. Without paths, the files
    of the installed collection are used."""

    def __init__(self, first: str | None = None, second: str | None = None):
        import public_tokenizers

        self.first = first or public_tokenizers.path("byte_bpe_50k.json")
        self.second = second or public_tokenizers.path("piece_bpe_32k.model")
        self.pattern = public_tokenizers.PATTERN

    def __getstate__(self) -> dict[str, str]:
        return {k: self.__dict__[k] for k in ("first", "second", "pattern")}

    @cached_property
    def bytes_a(self) -> list[bytes]:
        """Token bytes by id. Byte-level vocabularies write each byte as a character
        of its own: visible ones as they are, the others from U+0100 on."""
        seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(seen)]
        value = {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(others)}
        with open(self.first, encoding="utf-8") as f:
            file = json.load(f)
        vocabulary = file["model"]["vocab"]
        special = {t["content"] for t in file.get("added_tokens", [])}
        out = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            out[i] = b"" if token in special else bytes(value[c] for c in token)
        return out

    @cached_property
    def bytes_b(self) -> list[bytes]:
        p = self._pieces
        byte = re.compile(r"<0x([0-9A-F]{2})>")

        def own(i: int) -> bytes:
            if p.is_byte(i):
                return bytes([int(byte.fullmatch(p.id_to_piece(i))[1], 16)])
            return b"" if p.is_control(i) or p.is_unknown(i) else p.id_to_piece(i).replace("▁", " ").encode()

        return [own(i) for i in range(p.get_piece_size())]

    @cached_property
    def _pieces(self):
        from sentencepiece import SentencePieceProcessor

        return SentencePieceProcessor(model_file=self.second)

    @cached_property
    def _fast(self):
        import tiktoken

        ranks = {x: i for i, x in enumerate(self.bytes_a) if x}
        return tiktoken.Encoding("first", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def _whole(self):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(self.first)
        t.encode_special_tokens = True
        return t

    def encode_a(self, text: str) -> list[int]:
        if len(text) > 20_000 and GAP.search(text):
            return self._whole.encode(f" {text}", add_special_tokens=False).ids
        return self._fast.encode_ordinary(f" {text}")

    def encode_b(self, texts: list[str]) -> list[list[int]]:
        return self._pieces.encode(texts, num_threads=1)

    @cached_property
    def _joins_spaces(self) -> bool:
        """Whether a piece goes on after a word's end, so that units can't be cut alone."""
        return any(re.search(rb"[^ ] ", x) for x in self.bytes_b)

    def units(self, text: str) -> list[str]:
        return ([text] if self._joins_spaces else units(text)) if text else []

    @cached_property
    def _known(self) -> dict[str, tuple[list[int], list[int]] | None]:
        return {}

    def cut(self, units: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """The tokens of each unit; None where they don't give its bytes back."""
        known = self._known
        if len(known) > REMEMBERED:
            known.clear()
        new = [u for u in units if u not in known]
        found, a_bytes, b_bytes = {}, self.bytes_a, self.bytes_b
        for u, b in zip(new, self.encode_b(new), strict=True):
            a, whole = self.encode_a(u), b" " + u.encode()
            same = b"".join([a_bytes[i] for i in a]) == whole == b"".join([b_bytes[i] for i in b])
            found[u] = (a, b) if same else None
        known.update((u, x) for u, x in found.items() if len(u) <= LONGEST)
        return [found[u] if u in found else known[u] for u in units]

    @cached_property
    def widths(self) -> dict[str, np.ndarray]:
        return {k: np.array([len(x) for x in own], np.int64) for k, own in (("a", self.bytes_a), ("b", self.bytes_b))}

    @property
    def sizes(self) -> tuple[int, int]:
        return len(self.bytes_a), len(self.bytes_b)

    @cached_property
    def digits(self) -> tuple[np.ndarray, np.ndarray]:
        """The decimal digits of each id, filled up on the left, with a place for a
        sign behind them; and which of them are shown."""
        ids = np.arange(max(self.sizes))
        powers = 10 ** np.arange(len(str(ids[-1])) - 1, -1, -1)
        digits = np.append(ids[:, None] // powers % 10 + ord("0"), np.zeros((len(ids), 1)), axis=1).astype(np.uint8)
        shown = np.append(ids[:, None] >= powers, np.ones((len(ids), 1), bool), axis=1)
        shown[0, -2] = True
        return digits, shown


class Aligned(NamedTuple):
    """Tokens of several texts in order. ``n_a`` and ``n_b`` count them by text;
    ``last_a`` and ``last_b`` are the tokens that end groups, and the link ranges
    hold for each token of the list with fewer, ``driver``."""

    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    last_a: np.ndarray
    last_b: np.ndarray
    driver: str
    first: np.ndarray
    last: np.ndarray

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the tokens that overlap: of the first, of the second."""
        n = self.last - self.first + 1
        own = np.repeat(np.arange(len(n)), n)
        other = np.arange(len(own)) - np.repeat(np.cumsum(n) - n - self.first, n)
        return (own, other) if self.driver == "a" else (other, own)

    def text_of_a(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n_a)), self.n_a)

    def groups(self) -> np.ndarray:
        """Groups by text; each ends with a token of it."""
        return np.bincount(self.text_of_a()[self.last_a], minlength=len(self.n_a))


def aligned(tokenizers: Tokenizers, texts: list[str]) -> Aligned:
    """The texts' tokens with their groups and links."""
    parts = [tokenizers.units(t) for t in texts]
    number: dict[str, int] = {}
    for u in chain.from_iterable(parts):
        number.setdefault(u, len(number))
    cut = tokenizers.cut(list(number))
    whole = np.array([x is not None for x in cut], bool)
    n_parts = np.array([len(x) for x in parts], np.int64)
    unit = np.fromiter(map(number.__getitem__, chain.from_iterable(parts)), np.int64, int(n_parts.sum()))
    text = np.repeat(np.arange(len(texts)), n_parts)
    lost = np.zeros(len(texts), bool)
    lost[text[~whole[unit]]] = True
    unit, text = unit[~lost[text]], text[~lost[text]]
    ids, n = {}, {}
    for side, k in enumerate("ab"):
        own = [x[side] if x else [] for x in cut]
        size = np.fromiter(map(len, own), np.int64, len(own))
        flat = np.fromiter(chain.from_iterable(own), np.int32, int(size.sum()))
        taken = size[unit]
        at = np.repeat((np.cumsum(size) - size)[unit] - np.cumsum(taken) + taken, taken)
        ids[k] = flat[at + np.arange(len(at))]
        n[k] = np.bincount(text, taken, len(texts)).astype(np.int64)
    ends = {k: np.cumsum(tokenizers.widths[k][ids[k]]) for k in "ab"}
    driver, other = ("a", "b") if len(ids["a"]) <= len(ids["b"]) else ("b", "a")
    if not len(ids[driver]):
        none = np.zeros(0, np.int64)
        return Aligned(ids["a"], ids["b"], n["a"], n["b"], none, none, driver, none, none)
    rank = gallop(ends[driver], ends[other])
    common = ends[other][rank] == ends[driver]
    first = np.concatenate([[0], (rank + common)[:-1]])
    last = {driver: np.flatnonzero(common), other: rank[common]}
    return Aligned(ids["a"], ids["b"], n["a"], n["b"], last["a"], last["b"], driver, first, rank)


def written(tokenizers: Tokenizers, tokens: Aligned) -> list[bytes]:
    """Each text's groups as ``a1,a2|b1;a3|b2,b3``."""
    n_a, n_b = len(tokens.a), len(tokens.b)
    if not n_a:
        return [b""] * len(tokens.n_a)
    size_a = np.diff(tokens.last_a, prepend=-1)
    size_b = np.diff(tokens.last_b, prepend=-1)
    # A group's tokens of the first stand before those of the second.
    place_a = np.arange(n_a) + np.repeat(tokens.last_b + 1 - size_b, size_a)
    place_b = np.arange(n_b) + np.repeat(tokens.last_a + 1, size_b)
    ids = np.empty(n_a + n_b, np.int32)
    ids[place_a], ids[place_b] = tokens.a, tokens.b
    digits, shown = tokenizers.digits
    out, shown = digits[ids], shown[ids]
    out[:, -1] = ord(",")
    out[place_a[tokens.last_a], -1], out[place_b[tokens.last_b], -1] = ord("|"), ord(";")
    text = out[shown].tobytes()
    width = np.concatenate([[0], np.cumsum(shown.sum(axis=1))])
    stop = width[np.cumsum(tokens.n_a + tokens.n_b)]
    start = np.concatenate([[0], stop[:-1]])
    return [text[a : max(a, b - 1)] for a, b in zip(start.tolist(), stop.tolist(), strict=True)]


def lists(values: np.ndarray, n: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A column of lists from all values and the lists' lengths."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(values, kind))


def _mapped(docs: DataFrame, keep: list[Column | str], tokenizers: Tokenizers, make, more: str) -> DataFrame:
    """``keep`` columns and what ``make`` gives for the texts of a slice of rows."""
    fields = docs.select(*keep).schema.fields
    rows = docs.select(*keep, F.col("text").cast("string")).toDF(*(f"__{i}" for i in range(len(fields))), "text")
    schema = ", ".join([*(f"__{i} {f.dataType.simpleString()}" for i, f in enumerate(fields)), more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(len(fields)).to_pylist()]
            for part in spans([len(t) for t in texts], CHARS):
                old = batch.slice(part.start, part.stop - part.start)
                new = make(tokenizers, texts[part])
                yield pa.RecordBatch.from_arrays([*old.columns[:-1], *new.values()], [*old.schema.names[:-1], *new])

    made = rows.mapInArrow(run, schema)
    old = [F.col(f"__{i}").alias(f.name) for i, f in enumerate(fields)]
    return made.select(*old, *made.columns[len(fields) :])


def _alignment(tokenizers: Tokenizers, texts: list[str]) -> dict[str, pa.Array]:
    found = aligned(tokenizers, texts)
    groups = found.groups()
    link_a, link_b = found.links()
    n_links = np.bincount(found.text_of_a()[link_a], minlength=len(texts))
    before = {k: np.cumsum(n) - n for k, n in (("a", found.n_a), ("b", found.n_b))}
    out = {"a": lists(found.a, found.n_a, pa.int32()), "b": lists(found.b, found.n_b, pa.int32())}
    for k, last in (("a", found.last_a), ("b", found.last_b)):
        out[f"{k}_stops"] = lists(last + 1 - np.repeat(before[k], groups), groups, pa.int32())
    for k, link in (("a", link_a), ("b", link_b)):
        out[f"{k}_links"] = lists(link - np.repeat(before[k], n_links), n_links, pa.int32())
    return out


def align(docs: DataFrame, keep: list[Column | str], tokenizers: Tokenizers | None = None) -> DataFrame:
    """``keep`` columns; ``a`` and ``b``, the ids; ``a_stops`` and ``b_stops``, how
    many tokens of each end up to each group's end; ``a_links`` and ``b_links``, the
    places of the tokens that overlap, link by link."""
    more = ", ".join(f"{c} array<int>" for c in ("a", "b", "a_stops", "b_stops", "a_links", "b_links"))
    return _mapped(docs, keep, tokenizers or Tokenizers(), _alignment, more)


def _linked(tokenizers: Tokenizers, texts: list[str]) -> dict[str, pa.Array]:
    found = aligned(tokenizers, texts)
    link_a, link_b = found.links()
    size_a, size_b = tokenizers.sizes
    doc = found.text_of_a()[link_a]
    keys = np.sort((doc * size_a + found.a[link_a]) * np.int64(size_b) + found.b[link_b])
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else keys
    times = np.diff(np.append(new, len(keys)))
    keys = keys[new]
    per_doc = np.bincount(keys // (size_a * size_b), minlength=len(texts))
    digest = [hashlib.sha256(t).hexdigest() if t else "" for t in written(tokenizers, found)]
    return {
        "n_a": pa.array(found.n_a),
        "n_b": pa.array(found.n_b),
        "n_groups": pa.array(found.groups()),
        "n_links": pa.array(np.bincount(doc, minlength=len(texts))),
        "groups_sha256": pa.array(digest),
        "pairs": lists(keys % (size_a * size_b), per_doc, pa.int32() if size_a * size_b < 2**31 else pa.int64()),
        "times": lists(times, per_doc, pa.int32()),
    }


def linked(docs: DataFrame, keep: list[Column | str], tokenizers: Tokenizers | None = None) -> DataFrame:
    """``keep`` columns, counts, the groups' digest, and the distinct linked pairs,
    a's id * (size of b's vocabulary) + b's id, with how often each is linked."""
    tokenizers = tokenizers or Tokenizers()
    size_a, size_b = tokenizers.sizes
    pair = "int" if size_a * size_b < 2**31 else "bigint"
    more = f"n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<{pair}>, times array<int>"
    return _mapped(docs, keep, tokenizers, _linked, more)


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, n): how many documents hold each pair linked."""
    return links.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))


def frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The pairs with the greatest counts, as many powers of two of counts as fit
    into ``most`` pairs: pairs ascending, their counts, and the least count."""
    level = F.floor(F.log2("n")).cast("int").alias("level")
    by_level = sorted(counts.groupBy(level).agg(F.count("*").alias("pairs")).collect(), reverse=True)
    total, least = 0, 63
    for at, n in by_level:
        total += n
        if total > most:
            break
        least = at
    found = counts.where(F.col("n") >= F.lit(2).cast("long") ** F.lit(least)).toArrow()
    pair, n = found["pair"].to_numpy(), found["n"].to_numpy()
    order = np.argsort(pair)
    return pair[order], n[order], least


def count_sums(links: DataFrame, size_b: int, keep: list[str], head: int = HEAD) -> DataFrame:
    """``keep`` columns of written links, ``n_best`` and ``count_sum``."""
    links = materialize(links.withColumn("__row", F.monotonically_increasing_id()))
    counts = materialize(pair_counts(links))
    own_a = F.floor(F.col("pair") / size_b).cast("int")
    best = counts.groupBy(own_a.alias("__a")).agg(F.max("n").alias("best"))  # a row for each id of a at most
    top = best.toArrow()
    highest = np.zeros(max([0, *top["__a"].to_pylist()]) + 1, np.int64)
    highest[top["__a"].to_numpy()] = top["best"].to_numpy()
    pair, n, _ = frequent(counts, head)
    shared = links.sparkSession.sparkContext.broadcast((pair, n, highest))
    fields = links.select(*keep).schema.fields
    rows = links.select("__row", *keep, "times", "pairs").toDF("__row", *(f"__{i}" for i in range(len(fields))), "times", "pairs")
    kept = ", ".join(f"__{i} {f.dataType.simpleString()}" for i, f in enumerate(fields))
    pair_type = dict(links.dtypes)["pairs"]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, known_n, highest = shared.value
        known, known_n = (known, known_n) if len(known) else (np.array([-1]), np.array([0]))
        for batch in batches:
            pairs, times = batch.column(batch.num_columns - 1), batch.column(batch.num_columns - 2)
            n = np.diff(pairs.offsets.to_numpy())
            row = np.repeat(np.arange(len(n)), n)
            own, often = pairs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            hit = known[at] == own
            count = np.where(hit, known_n[at], 0)
            is_best = hit & (count == highest[own // size_b])

            def summed(values: np.ndarray, row: np.ndarray = row, n: np.ndarray = n) -> pa.Array:
                total = np.zeros(len(n), np.int64)
                np.add.at(total, row, values)
                return pa.array(total)

            left = np.bincount(row[~hit], minlength=len(n))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-2],
                    summed(often * is_best),
                    summed(often * count),
                    lists(own[~hit], left, pairs.type.value_type),
                    lists(often[~hit], left, pa.int32()),
                ],
                [*batch.schema.names[:-2], "n_best", "count_sum", "pairs", "times"],
            )

    found = rows.mapInArrow(look_up, f"__row bigint, {kept}, n_best bigint, count_sum bigint, pairs {pair_type}, times array<int>")
    found = materialize(found)
    rare = found.where(F.size("pairs") > 0).select("__row", F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    rare = rare.select("__row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    sums = (
        rare.join(counts, "pair")
        .join(best, own_a == F.col("__a"))
        .groupBy("__row")
        .agg(F.sum(F.when(F.col("n") == F.col("best"), F.col("times"))).alias("b"), F.sum(F.col("n") * F.col("times")).alias("s"))
    )
    total = lambda c, more: (F.col(c) + F.coalesce(F.col(more), F.lit(0))).cast("long").alias(c)
    old = [F.col(f"__{i}").alias(f.name) for i, f in enumerate(fields)]
    return found.drop("pairs", "times").join(sums, "__row", "left").select(*old, total("n_best", "b"), total("count_sum", "s"))


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: tokens, groups and links of the two tokenizers, and how the
    links stand in the corpus."""
    tokenizers = Tokenizers()
    links = linked(read(spark, sf_dir, "documents"), ["doc_id"], tokenizers)
    keep = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    return count_sums(links, tokenizers.sizes[1], keep)
