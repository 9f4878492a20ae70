"""Spelling variants: words one edit apart, found by walking a trie.

The trie of all words is a distributed table of edges, (node, symbol, label,
child): nodes are the places where words part, named by a hash of the prefix, and
an edge carries all the symbols up to the next such place; every word ends with a
sign of its own. A state is (word, position, node, edits). The word's own path has
no edits; at each of its nodes the other edges are taken with one edit, a replaced,
an additional or a skipped symbol, and from there on the frontier is joined with
the edges level by level, without further edits, until it is empty. States that
reach a word's end are neighbours.

Two words a single edit apart agree either in the first half of each or in the
last. So edits are made only from the middle on, in the trie of the words and in
that of the words reversed, where nodes have few edges; the two together find
every pair. Two words part at one node, so each trie finds a pair once. A node's
name is a hash; a name that two prefixes share joins their edges, which may add
pairs and loses none, and every pair found is compared exactly.

A word's form is the most frequent of its neighbours (ties: the first by code
points), if it is ``ratio`` times as frequent; following forms leads to its root.

Defined results: null texts have no words; a null id counts as an empty text; rows
that repeat count as often as they stand there, as does a run within a text. The
longest word sets nothing but the work for itself. Without two near words all
words are their own roots. Only the id and the text are read, so other columns may
have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkodds.llm.common import read
from sparkodds.session import materialize

#: Letters of a run, and the sign after a word's last symbol.
LETTERS, END = "A-Za-zÀ-ÿ", "\x00"

#: Of runs 1 / TYPOS has a letter taken out, so that there are variants to find.
TYPOS = 199

#: Words are of so many code points, stand so often, and a form is so many times as frequent.
LENGTH, LEAST, RATIO = 6, 5, 5

_ODD = 0x9E3779B97F4A7C15


def runs(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc, word, n): runs of at least ``length`` letters, A-Z as a-z, by document."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    found = F.regexp_extract_all(F.translate("text", upper, lower), F.lit(f"([{LETTERS}]{{{length},}})"), F.lit(1))
    return docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(found).alias("word"))


def with_typos(runs: DataFrame) -> DataFrame:
    """(word): runs of which some lose a letter, by a hash of document and run."""
    h = F.crc32(F.concat_ws(":", "doc", "word").cast("binary"))
    at = (F.col("h") % F.length("word")).cast("int")
    short = F.concat(F.expr("substring(word, 1, at)"), F.expr("substring(word, at + 2)"))
    return runs.select("word", h.alias("h")).withColumn("at", at).select(F.when(F.col("h") % TYPOS == 0, short).otherwise(F.col("word")).alias("word"))


def vocabulary(words: DataFrame, length: int = LENGTH, least: int = LEAST) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    counts = words.where(F.length("word") >= length).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= least)


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each word the prefixes from the middle on: their length, a hash of
    their symbols, and the symbol behind them."""
    for batch in batches:
        for low in range(0, batch.num_rows, 20_000):
            part = batch.slice(low, 20_000)
            words = part.column(0).to_pylist()
            lengths = np.array([len(w) for w in words])
            symbols = np.frombuffer((END.join(words) + END).encode("utf-32-le"), np.uint32)
            powers = np.full(lengths.max(initial=0) + 2, _ODD, np.uint64)
            powers[0] = 1
            powers = np.multiply.accumulate(powers)
            first = np.cumsum(lengths + 1) - lengths - 1
            place = np.arange(len(symbols)) - np.repeat(first, lengths + 1)
            value = (symbols.astype(np.uint64) + np.uint64(1)) * powers[place]
            run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
            # A partner may be a symbol shorter, and its middle before this one's.
            kept = np.flatnonzero(place >= np.repeat((lengths - 1) // 2, lengths + 1))
            word = np.repeat(np.arange(len(words)), lengths + 1)[kept]
            node = (run[kept] - run[first[word]]) ^ (place[kept].astype(np.uint64) << np.uint64(48))
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(word)), pa.array(place[kept], pa.int32()), pa.array(node.view(np.int64)), pa.array(symbols[kept].astype(np.int32))],
                ["word", "depth", "node", "symbol"],
            )


def trie(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The trie of (word): its edges (node, symbol, label, child), where ``child``
    is null at a word's end and ``label`` ends with END there; and each word's own
    path (word, depth, node), of the nodes from its middle on."""
    steps = materialize(words.select("word").mapInArrow(_prefixes, "word string, depth int, node bigint, symbol int"))
    parts = steps.select("node", "symbol").distinct().groupBy("node").agg(F.count("*").alias("edges")).where("edges > 1")
    path = materialize(steps.join(parts, "node").select("word", "depth", "node"))
    nodes = path.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("depth", "node"))).alias("nodes"))
    edge = nodes.select(F.concat("word", F.lit(END)).alias("word"), "nodes", F.posexplode("nodes").alias("nth", "at"))
    after = F.get("nodes", F.col("nth") + 1)
    stop = F.coalesce(after["depth"], F.length("word"))
    label = F.substring(F.col("word"), F.col("at.depth") + 1, stop - F.col("at.depth"))
    edges = edge.select(F.col("at.node").alias("node"), F.substring(label, 1, 1).alias("symbol"), label.alias("label"), after["node"].alias("child"))
    return edges.distinct(), path


def _rest(word: Column, position: Column) -> Column:
    return F.substring(word, position + 1, F.length(word) - position)


def walk(words: DataFrame) -> DataFrame:
    """(word, near): the words that a walk of the trie of (word) reaches from each."""
    edges, path = trie(words)
    edges = materialize(edges)
    own = path.where(F.col("depth") >= F.floor(F.length("word") / 2)).select(F.concat("word", F.lit(END)).alias("word"), "depth", "node")
    here = _rest(F.col("word"), F.col("depth"))  # what is still to come, this symbol first
    next_ = _rest(F.col("word"), F.col("depth") + 1)
    this, label = F.substring(here, 1, 1), F.col("label")
    tail = _rest(label, F.lit(1))
    # The word's symbol is replaced by the edge's, the edge's is additional, or the word's is skipped.
    kinds = [
        ((this != END) & (F.col("symbol") != END), tail, F.col("depth") + 1),
        (F.col("symbol") != END, tail, F.col("depth")),
        (this != END, label, F.col("depth") + 1),
    ]
    met = own.join(edges, "node").where(F.col("symbol") != this)
    taken = F.array(
        *(
            F.when(may & F.startswith(here if at is kinds[1][2] else next_, rest), F.struct((at + F.length(rest)).cast("int").alias("position"), F.length(rest).alias("of")))
            for may, rest, at in kinds
        )
    )
    spawned = met.select("word", "depth", "label", "child", F.explode(F.array_compact(taken)).alias("to"))
    seen = F.concat(F.substring(F.col("word"), F.lit(1), F.col("depth")), F.col("label"))
    frontier = materialize(spawned.select("word", F.col("to.position").alias("position"), F.col("child").alias("node"), seen.alias("seen")))
    found = []
    while True:
        found.append(frontier.where(F.col("node").isNull()).select("word", F.col("seen").alias("near")))
        live = frontier.where(F.col("node").isNotNull())
        if live.isEmpty():
            break
        ahead = _rest(F.col("word"), F.col("position"))
        state = live.withColumn("symbol", F.substring(ahead, 1, 1)).join(edges, ["node", "symbol"])
        frontier = materialize(
            state.where(F.startswith(ahead, label)).select(
                "word", (F.col("position") + F.length("label")).alias("position"), F.col("child").alias("node"), F.concat("seen", "label").alias("seen")
            )
        )
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.select(*(F.rtrim(c, F.lit(END)).alias(c) for c in ("word", "near")))


def one_edit(a: Column, b: Column) -> Column:
    """Whether two words are exactly one inserted, deleted or replaced symbol apart."""
    return F.levenshtein(a, b, 1) == 1


def neighbours(words: DataFrame) -> DataFrame:
    """(word, near): all ordered pairs of the distinct (word) that are one edit apart."""
    forward = walk(words)
    back = walk(words.select(F.reverse("word").alias("word"))).select(F.reverse("word").alias("word"), F.reverse("near").alias("near"))
    met = forward.union(back)
    both = met.union(met.select(F.col("near").alias("word"), F.col("word").alias("near")))
    return both.distinct().where(one_edit(F.col("word"), F.col("near")))


def forms(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of all (word, n)."""
    words = materialize(words)
    of = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    met = neighbours(words).join(of, "near")
    best = met.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    big = -F.col("best.less") >= ratio * F.col("n")
    named = materialize(
        words.join(best, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(big, F.col("best.near")).alias("form"),
            F.when(big, -F.col("best.less")).alias("form_n"),
        )
    )
    # Each step doubles the links that a root is away, and n grows with each link.
    root = named.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:
        root = materialize(root)
        up = root.select(F.col("word").alias("at"), F.col("root").alias("above"))
        further = root.join(up, F.col("root") == F.col("at"), "left")
        if further.where(F.col("above").isNotNull()).isEmpty():
            break
        root = further.select("word", F.coalesce("above", "root").alias("root"))
    return named.join(root, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per frequent word its near words, form and root."""
    words = vocabulary(with_typos(runs(read(spark, sf_dir, "documents"))))
    return forms(words).select("word", "form", "root", "n", "n_near", "form_n")
