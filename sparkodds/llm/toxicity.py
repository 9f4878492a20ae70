"""Toxicity of documents, read through obfuscated spelling.

A writer's word goes through a noisy channel: letters become look-alike signs,
are spaced out, starred or repeated. ``Decoder`` undoes it: a suspicious span
becomes a lattice of what each character may stand for, and the Viterbi path
under a character language model (how the corpus spells) times the channel's
probabilities is the restored word. The restored text is then scored.

- The language model is trigram counts over all documents' letters. Its size has
  a bound, CODES cubed; the counts grow with the corpus.
- The lexicon holds words and word beginnings that toxic documents have far more
  often than others. It is learned from a bounded sample of labelled documents:
  about ``train_docs``, those of smallest hash (documented parameter).
- A logistic curve over three numbers of a document turns weights into a score.
  It is fitted on a third of the sample, which the lexicon hasn't seen.

Defined results: null and empty texts get the score of a document without
findings; without usable labels every score is the share of toxic labels (0
without any); several labels of a doc_id count as toxic if one is; a token of more
than SPAN characters is decoded part by part, cut at what is no sign, other spans
as a whole at any length. Only doc_id and text, and doc_id and toxic of the labels, are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkodds.llm.common import crc_mod, give_back, hashed_sample, numbered, read, spans

# What a sign may stand for.
LOOK_ALIKES = {
    "0": "o",
    "1": "il",
    "3": "e",
    "4": "a",
    "5": "s",
    "6": "bg",
    "7": "t",
    "8": "b",
    "9": "g",
    "@": "a",
    "$": "s",
    "!": "i",
    "|": "il",
    "+": "t",
    "(": "c",
    "€": "e",
    "£": "l",
    "¢": "c",
    "¥": "y",
}
#: Signs that hide a letter, and signs put between letters.
HIDING, BETWEEN = "*#%&?", " .-_*"
#: Signs that often stand before and after a word and mean nothing there; marks
#: around a token that are no sign.
BEFORE, AFTER, MARKS = HIDING + "(|+", HIDING + "!$+|", ".,;:)\"'"

#: Letters of the language model: a to z, ß to ÿ, any other letter; 0 is the word's edge.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
CODES = 64
OTHER = CODES - 1

WORDS = re.compile(r"[^\W\d_]+")
_SIGNS = re.escape("".join(LOOK_ALIKES) + HIDING)
SUSPECT = re.compile(rf"[{_SIGNS}]")
TOKEN = re.compile(r"\S+")
EDGES = re.compile(rf"([{re.escape(BEFORE)}]*)(.*?)([{re.escape(AFTER)}]*)", re.DOTALL)
PART = re.compile(rf"(?:[^\W_]|[{_SIGNS}])+")
REPEATED = re.compile(r"([^\W\d_])\1\1")
_ONE = rf"[^\W_]|[{re.escape(''.join(LOOK_ALIKES))}]"
SPACED = re.compile(rf"(?<!\w)(?:{_ONE})(?:[{re.escape(BETWEEN)}](?:{_ONE})){{3,}}(?!\w)")

#: Characters that are counted at once.
CHARS = 500_000

#: Longest span that is remembered, and longest token that is decoded as one span.
SPAN = 60

#: Natural logarithms of the channel's probabilities.
AS_IS, AS_SIGN, HIDDEN, DROPPED, LITERAL_SIGN, EDGE_SIGN = -0.05, -0.7, -4.0, -1.0, -6.0, -2.0


def code_table() -> np.ndarray:
    """Code of each character below 0x250; others are OTHER if letters, else 0."""
    table = np.zeros(0x250, np.int64)
    for c in range(0x250):
        if chr(c).isalpha():
            table[c] = OTHER
    for i, c in enumerate(LETTERS, 1):
        table[ord(c)] = i
    return table


def codes(text: str, table: np.ndarray) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    high = points >= len(table)
    out = table[np.where(high, 0, points)]
    out[high] = OTHER
    return out


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(gram, n) over all texts: gram is the three letters' codes; what stands
    before a word's edge doesn't matter."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, total = code_table(), np.zeros(CODES**3, np.int64)
        for part in parts:
            texts = part["text"].tolist()
            for piece in spans([len(t) for t in texts], CHARS):
                # Texts stand apart by edges, as words do.
                c = np.concatenate([[0, 0], codes("\n\n".join(texts[piece]).lower(), table), [0]])
                first = np.where(c[1:-1] == 0, 0, c[:-2])
                total += np.bincount((first * CODES + c[1:-1]) * CODES + c[2:], minlength=CODES**3)
        gram = np.flatnonzero(total)
        yield pd.DataFrame({"gram": gram, "n": total[gram]})

    texts = docs.where(F.length("text") > 0).select("text")
    return texts.mapInPandas(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def language_model(counts: pd.DataFrame) -> np.ndarray:
    """log P(c | a, b), trigrams smoothed by bigrams and those by letters."""
    n = np.zeros(CODES**3)
    n[counts["gram"]] = counts["n"]
    n = n.reshape(CODES, CODES, CODES)
    n[:, 0, 0] = 0  # one edge after another says nothing
    one = n.sum(axis=(0, 1)) + 1
    one = one / one.sum()
    two = n.sum(axis=0)
    two = (two + 20 * one) / (two.sum(axis=1, keepdims=True) + 20)
    return np.log((n + 20 * two[None]) / (n.sum(axis=2, keepdims=True) + 20)).astype(np.float32)


class Decoder:
    """Restores texts under a language model."""

    def __init__(self, logp: np.ndarray, remembered: int = 30_000) -> None:
        self.logp, self.remembered = logp, remembered
        self.code = {c: i for i, c in enumerate(LETTERS, 1)}
        self.seen: dict[str, str] = {}
        self.ends: dict[str, tuple[np.ndarray, np.ndarray]] = {"": (logp[:, :, 0].astype(float), np.zeros((CODES, CODES), int))}

    def choices(self, span: str) -> list[list[tuple[str, float]]]:
        """What each character may stand for, "" for nothing, with log probabilities."""
        before, word, _ = EDGES.fullmatch(span).groups()
        out = []
        for i, c in enumerate(span):
            edge = not len(before) <= i < len(before) + len(word)
            found: list[tuple[str, float]] = []
            if c.isalpha():
                found.append((c, AS_IS))
                if i and span[i - 1] == c:
                    found.append(("", DROPPED))
            else:
                found += [(x, AS_SIGN) for x in LOOK_ALIKES.get(c, "")]
                if i and span[i - 1] == c:
                    found.append(("", DROPPED))
                if c in HIDING:
                    found += [(x, HIDDEN) for x in LETTERS]
                found.append(("", EDGE_SIGN if edge else AS_IS if c in BETWEEN else LITERAL_SIGN))
            out.append(found)
        return out

    def end(self, signs: str, found: list[list[tuple[str, float]]]) -> tuple[np.ndarray, np.ndarray]:
        """For every state before the last ``signs``: the likeliest way to the word's
        edge, its score and its first letter's code, 0 for none. ``found`` has the signs' choices."""
        if signs not in self.ends:
            if len(self.ends) > 1000:
                self.ends = {"": self.ends[""]}
            after = self.end(signs[1:], found[1:])[0]
            score = after + max(p for x, p in found[0] if not x)
            letter = np.zeros((CODES, CODES), int)
            for x, p in sorted(x for x in found[0] if x[0]):
                c = self.code[x]
                total = p + self.logp[:, :, c] + after[:, c][None]
                better = total > score
                score, letter = np.where(better, total, score), np.where(better, c, letter)
            self.ends[signs] = score, letter
        return self.ends[signs]

    def viterbi(self, span: str) -> str:
        """The likeliest letters behind a span."""
        signs = EDGES.fullmatch(span)[3]
        choices = self.choices(span)
        best: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        done = []  # what all paths begin with
        for nth, found in enumerate(choices[: len(span) - len(signs)], 1):
            after: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (score, text) in best.items():
                for letter, p in found:
                    if letter:
                        c = self.code.get(letter, OTHER)
                        state, total = (b, c), score + p + float(self.logp[a, b, c])
                    else:
                        state, total = (a, b), score + p
                    # Ties go to the text that sorts first, so reruns agree.
                    if state not in after or (-total, text + letter) < (-after[state][0], after[state][1]):
                        after[state] = (total, text + letter)
            best = after
            if nth % 32 == 0:
                texts = [text for _, text in best.values()]
                done.append(commonprefix([min(texts), max(texts)]))
                best = {state: (score, text[len(done[-1]) :]) for state, (score, text) in best.items()}
        # The same signs end many words, so what they give is kept.
        tail = choices[len(span) - len(signs) :]
        total = self.end(signs, tail)[0]
        _, text, (a, b) = min((-(score + float(total[state])), text, state) for state, (score, text) in best.items())
        done.append(text)
        for i in range(len(signs)):
            c = int(self.end(signs[i:], tail[i:])[1][a, b])
            if c:
                done.append(LETTERS[c - 1])
                a, b = b, c
        return "".join(done)

    def restored(self, span: str) -> str:
        if len(span) > SPAN:
            return self.viterbi(span)
        if span not in self.seen:
            if len(self.seen) >= self.remembered:
                self.seen.clear()
            self.seen[span] = self.viterbi(span)
        return self.seen[span]

    def token(self, match: re.Match) -> str:
        """A run without white space: decoded if signs stand at its letters. A long one
        is cut at what is no sign."""
        core = match[0].strip(MARKS)
        if not SUSPECT.search(core) or not WORDS.search(core):
            return match[0]
        if len(core) > SPAN:
            return PART.sub(lambda m: self.part(m[0]), match[0])
        return match[0].replace(core, self.part(core), 1)

    def part(self, core: str) -> str:
        """Decoded with the signs at its edges if one is a letter, else between them."""
        before, word, signs = EDGES.fullmatch(core).groups()
        if not WORDS.search(word):
            return core
        found = self.restored(word) if SUSPECT.search(word) or before or signs else word
        if (before or signs) and (whole := self.restored(core)) != found:
            return whole
        return f"{before}{found if SUSPECT.search(word) else word}{signs}"

    def text(self, text: str) -> str:
        """Lower-cased text with suspicious spans restored."""
        text = text.lower()
        if SPACED.search(text):
            text = SPACED.sub(lambda m: self.restored(m[0]), text)
        if SUSPECT.search(text):
            text = TOKEN.sub(self.token, text)
        if REPEATED.search(text):
            text = WORDS.sub(lambda m: self.restored(m[0]) if REPEATED.search(m[0]) else m[0], text)
        return text


def features(word: str) -> list[str]:
    """A word and its beginnings."""
    return [word, *("^" + word[:n] for n in (4, 5, 6) if len(word) >= n)]


class Model:
    """Lexicon of features, and the curve from findings to a score."""

    def __init__(self, weight: dict[str, float], curve: np.ndarray, share: float) -> None:
        self.weight, self.curve, self.share = weight, curve, share

    def findings(self, words: set[str], known: dict[str, float]) -> tuple[float, float, float]:
        """Greatest weight, sum of the three greatest, number of words with a weight."""
        found = []
        for w in words:
            if w not in known:
                known[w] = max((self.weight.get(f, 0.0) for f in features(w)), default=0.0)
            if known[w] > 0:
                found.append(known[w])
        found.sort(reverse=True)
        return (found[0] if found else 0.0), sum(found[:3]), float(np.log1p(len(found)))

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.curve):
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(x @ self.curve[1:] + self.curve[0], -30, 30)))


def fit_curve(x: np.ndarray, y: np.ndarray, rounds: int = 30, shrink: float = 0.1) -> np.ndarray:
    """Logistic regression by Newton's method with a small ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        ridge = shrink * np.r_[0, np.ones(len(b) - 1)]
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-6)
        b = b + np.linalg.solve(hessian, x.T @ (y - p) - ridge * b)
    return b


def restored_words(texts: pd.Series, decoder: Decoder) -> Iterator[set[str]]:
    for text in texts:
        yield set(WORDS.findall(decoder.text(text))) if isinstance(text, str) else set()


def train(docs: DataFrame, labels: DataFrame, logp: np.ndarray, train_docs: int = 20_000, entries: int = 20_000) -> Model:
    """Learn from labelled documents (docs: doc_id, text; labels: doc_id, toxic)."""
    spark = docs.sparkSession
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    marks = marks.groupBy(F.col("doc_id").alias("of")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    # About train_docs rows of three numbers, so it may be broadcast at any size.
    sample = hashed_sample(marks, train_docs, "of").withColumn("fold", F.pmod(F.xxhash64(F.lit(5), "of"), F.lit(3)))
    rows = docs.join(F.broadcast(sample), F.col("doc_id") == F.col("of")).select("text", "toxic", "fold")
    context, sent = spark.sparkContext, spark.sparkContext.broadcast(logp)

    def count(only: object) -> DataFrame:
        def parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            decoder, total = Decoder(sent.value), Counter()
            wanted = only.value if only is not None else None
            for part in frames:
                for words in restored_words(part["text"], decoder):
                    found = {f for w in words for f in features(w)}
                    total.update(found if wanted is None else found & wanted)
            yield pd.DataFrame(list(total.items()), columns=["feature", "n"]).astype({"feature": object, "n": "int64"})

        chosen = rows.where((F.col("fold") != 0) & (F.col("toxic") == (1 if only is None else 0)))
        return chosen.select("text").mapInPandas(parts, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))

    folds = rows.groupBy("fold", "toxic").count().toPandas()
    n_toxic = int(folds[(folds["fold"] != 0) & (folds["toxic"] == 1)]["count"].sum())
    n_clean = int(folds[(folds["fold"] != 0) & (folds["toxic"] == 0)]["count"].sum())
    every = int(folds["count"].sum())
    share = float(folds[folds["toxic"] == 1]["count"].sum() / every) if every else 0.0
    if not n_toxic or not n_clean:
        return Model({}, np.zeros(0), share)
    toxic = count(None).where(F.col("n") >= 4).orderBy(F.desc("n"), "feature").limit(10 * entries).toPandas()
    clean = count(context.broadcast(frozenset(toxic["feature"]))).toPandas().set_index("feature")["n"]
    t, c = toxic["n"].to_numpy(float), toxic["feature"].map(clean).fillna(0).to_numpy(float)
    weight = np.log((t + 0.5) / (n_toxic + 1)) - np.log((c + 0.5) / (n_clean + 1))
    # Likelihood ratio against one rate for all documents: rare features whose
    # documents are toxic by chance stay out.
    rate = n_toxic / (n_toxic + n_clean)
    own = (t + 1e-9) / (t + c + 1e-9)
    evidence = 2 * (t * np.log(own / rate) + c * np.log(np.maximum(1 - own, 1e-12) / (1 - rate)))
    kept = np.flatnonzero((weight > 1) & (evidence > 25))
    kept = kept[np.argsort(-evidence[kept], kind="stable")][:entries]
    model = Model(dict(zip(toxic["feature"].iloc[kept], weight[kept].tolist(), strict=True)), np.zeros(0), share)
    shared = context.broadcast(model)

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder, known = Decoder(sent.value), {}
        for part in frames:
            x = [shared.value.findings(words, known) for words in restored_words(part["text"], decoder)]
            yield pd.DataFrame(x, columns=["a", "b", "c"]).assign(toxic=part["toxic"].to_numpy())

    held = rows.where(F.col("fold") == 0).select("text", "toxic")
    held = held.mapInPandas(measure, "a double, b double, c double, toxic int").toPandas()
    if held["toxic"].nunique() == 2:
        held = held.sort_values(["a", "b", "c", "toxic"])  # sums in one order, so reruns agree
        model.curve = fit_curve(held[["a", "b", "c"]].to_numpy(), held["toxic"].to_numpy(float))
    return model


def score(docs: DataFrame, model: Model, logp: np.ndarray, keep: list[Column | str], remembered: int = 100_000) -> DataFrame:
    """``keep`` columns, and the score of every document's whole restored text."""
    context = docs.sparkSession.sparkContext
    shared, sent = context.broadcast(model), context.broadcast(logp)
    rows, schema, back = numbered(docs, keep, text=F.col("text"))

    def parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder, known, model = Decoder(sent.value), {}, shared.value
        for part in frames:
            x = []
            for words in restored_words(part["text"], decoder):
                if len(known) > remembered:
                    known.clear()
                x.append(model.findings(words, known))
            out = part.drop(columns="text")
            out["score"] = model.score(np.array(x).reshape(-1, 3))
            yield out
            give_back()

    return back(rows.mapInPandas(parts, f"{schema}, score double"))


def learned(docs: DataFrame, labels: DataFrame) -> tuple[Model, np.ndarray]:
    """Model and language model; labels whose id's crc32 mod 4 is 2 aren't learned from."""
    logp = language_model(trigram_counts(docs).toPandas())
    return train(docs, labels.where(crc_mod(F.col("doc_id"), 4) != 2), logp), logp


#: Score from which a document counts as toxic.
TOXIC = 0.3


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model, logp = learned(docs, read(spark, sf_dir, "labels"))
    held_out = (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out")
    found = score(docs, model, logp, [F.col("doc_id"), held_out])
    return found.withColumn("predicted", (F.col("score") >= TOXIC).cast("int"))
