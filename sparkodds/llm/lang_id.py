"""Language identification by unigrams over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. The
probability of a text is the product over its words of the sum, over all ways to
cut the word into pieces, of the pieces' product: a forward pass sums them, so no
segmentation has to be chosen. The piece probabilities are learned by expectation
maximisation with the same lattices.

Training takes a bounded sample: about ``train_docs`` labelled documents, those of
smallest hash (documented parameter). Its word counts are made by Spark, of runs of
letters in parts of at most 40; each task turns
its words into expected piece counts, at most one row for each piece and
language, and only those sums meet. Prediction covers every whole text and sums all
segmentations of a run of letters however long it is, with logarithms where sums
leave a double's range; a word's probabilities are remembered within a task.

Defined results: a text that is null or has no letter is ``und`` with score 0, as
is everything when no document has a language; ties go to the language that sorts
first. Only doc_id, text and (to learn) lang are read; other columns may have any
name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkodds.llm import pieces
from sparkodds.llm.common import crc_mod, hashed_sample, numbered, read, spans
from sparkodds.session import materialize

LETTERS = re.compile(r"[^\W\d_]+")

#: Words that a task remembers, and characters that it cuts at once.
REMEMBERED, CHARS = 300_000, 2_000_000


def words(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def spaced(units: list[str]) -> list[str]:
    return [pieces.SPACE + u for u in units]


class Model:
    """Languages with their shares and a matrix pieces x languages."""

    def __init__(self, languages: list[str], prior: np.ndarray, p: np.ndarray) -> None:
        self.languages, self.prior, self.p = languages, prior, p


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of the documents."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out: dict[tuple[str, str], int] = {}
            for lang, text in zip(part["lang"], part["text"], strict=True):
                for w in pieces.cut_long(words(text)):
                    out[lang, w] = out.get((lang, w), 0) + 1
            yield pd.DataFrame([(a, b, n) for (a, b), n in out.items()], columns=["lang", "word", "n"]).astype({"n": "int64"})

    return docs.select("lang", "text").mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, vocabulary: pieces.Vocabulary, train_docs: int = 4000, rounds: int = 3) -> Model:
    """Learn from documents with a language (columns doc_id, lang, text)."""
    spark = docs.sparkSession
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sample = hashed_sample(labelled, train_docs, "doc_id", "text").select("lang", "text")
    shares = sample.groupBy("lang").count().orderBy("lang").toPandas()
    languages = shares["lang"].tolist()
    if not languages:
        return Model([], np.zeros(0), np.zeros((len(vocabulary), 0)))
    place = {name: i for i, name in enumerate(languages)}
    counted = materialize(word_counts(sample))
    shared, size = spark.sparkContext.broadcast(vocabulary), len(vocabulary)
    usable = np.array([bool(x) for x in vocabulary.pieces], dtype=float)
    p = np.repeat((usable / usable.sum())[:, None], len(languages), axis=1)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(p)

        def expect(parts: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            total = np.zeros((size, len(languages)))
            for part in parts:
                # A word is worked once for all its languages.
                units, at = np.unique(part["word"].to_numpy(str), return_inverse=True)
                n = np.zeros((len(units), len(languages)))
                np.add.at(n, (at, part["lang"].map(place).to_numpy()), part["n"].to_numpy(float))
                total += pieces.expected_counts(shared.value, sent.value, spaced(units.tolist()), n)
            piece, lang = np.nonzero(total)
            yield pd.DataFrame({"piece": piece, "language": lang, "n": total[piece, lang]})

        sums = counted.mapInPandas(expect, "piece long, language long, n double").groupBy("piece", "language").agg(F.sum("n").alias("n")).toPandas()
        total = np.zeros((size, len(languages)))
        total[sums["piece"], sums["language"]] = sums["n"]
        # Seen too rarely to be told from chance: a small share for every usable piece.
        total += 0.01 * usable[:, None]
        p = total / total.sum(axis=0)
        sent.unpersist()
    return Model(languages, shares["count"].to_numpy(float) / shares["count"].sum(), p)


def predict(docs: DataFrame, vocabulary: pieces.Vocabulary, model: Model, keep: list[Column | str]) -> DataFrame:
    """``keep`` columns, lang_pred and score (the language's share of the
    probability) of every document's whole text."""
    context = docs.sparkSession.sparkContext
    shared, learned = context.broadcast(vocabulary), context.broadcast(model)
    rows, schema, back = numbered(docs, keep, text=F.col("text"))

    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, vocabulary = learned.value, shared.value
        n_lang = len(model.languages)
        known: dict[str, int] = {}
        held = np.zeros((0, n_lang))
        for part in parts:
            texts = [t if isinstance(t, str) else "" for t in part["text"]]
            best, share = [], []
            for piece in spans([len(t) for t in texts], CHARS) if n_lang else ():
                split, rare = [words(t) for t in texts[piece]], {}
                for i, s in enumerate(split):
                    if max(map(len, s), default=0) >= pieces.UNIT:  # too long to be met again
                        rare[i] = [w for w in s if len(w) >= pieces.UNIT]
                        split[i] = [w for w in s if len(w) < pieces.UNIT]
                new = {w for s in split for w in s if w not in known}
                if len(known) + len(new) > REMEMBERED:
                    known, held, new = {}, held[:0], {w for s in split for w in s}
                if new:
                    added = sorted(new)
                    known.update(zip(added, range(len(held), len(held) + len(added)), strict=True))
                    held = np.concatenate([held, pieces.log_probability(vocabulary, model.p, spaced(added))])
                for i, s in enumerate(split):
                    total = np.log(model.prior) + (held[[known[w] for w in s]].sum(axis=0) if s else 0)
                    if i in rare:
                        total = total + pieces.log_probability(vocabulary, model.p, spaced(rare[i])).sum(axis=0)
                    top, letters = int(total.argmax()), s or i in rare
                    best.append(model.languages[top] if letters else "und")
                    share.append(1 / np.exp(total - total[top]).sum() if letters else 0.0)
            out = part.drop(columns="text")
            out["lang_pred"], out["score"] = (best, share) if n_lang else ("und", 0.0)
            yield out

    return back(rows.mapInPandas(score, f"{schema}, lang_pred string, score double"))


def op1_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out")
    vocabulary = pieces.load()
    model = train(docs.where(~held_out), vocabulary)
    return predict(docs, vocabulary, model, [F.col("doc_id"), held_out])
