import itertools
import math
import re
from collections import Counter
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest
from awkward import docs
from pyspark.sql import functions as F

from sparkodds.llm import lang_id, pieces, tokenise
from sparkodds.llm.common import crc_mod, give_back

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load()


def small():
    names = ["a", "b", "ab", "ba", "aba", "b" * 3]
    return pieces.Vocabulary(names + [""] * 256, list(range(len(names), len(names) + 256)))


def segmentations(unit, names):
    """Every way to cut a unit into pieces."""
    if not unit:
        yield ()
    for n in range(1, len(unit) + 1):
        if unit[:n] in names:
            for rest in segmentations(unit[n:], names):
                yield (unit[:n], *rest)


def test_forward_sums_all_segmentations():
    v, rng = small(), np.random.default_rng(0)
    p = rng.random((len(v), 2)) / 10
    units = ["a", "ab", "aba", "bbbab", "ababab", "bababbb"]
    got = pieces.log_probability(v, p, units)
    for u, g in zip(units, got, strict=True):
        for lang in range(2):
            want = sum(math.prod(p[v.ids[x], lang] for x in s) for s in segmentations(u, v.pieces[:6]))
            assert g[lang] == pytest.approx(math.log(want))


def test_expected_counts():
    v, rng = small(), np.random.default_rng(1)
    p = rng.random((len(v), 1)) / 10
    units, counts = ["ababab", "bbbab"], np.array([[3.0], [2.0]])
    want = np.zeros(len(v))
    for u, n in zip(units, counts[:, 0], strict=True):
        all_of = list(segmentations(u, v.pieces[:6]))
        shares = np.array([math.prod(p[v.ids[x], 0] for x in s) for s in all_of])
        for s, share in zip(all_of, shares / shares.sum(), strict=True):
            for x in s:
                want[v.ids[x]] += n * share
    assert np.allclose(pieces.expected_counts(v, p, units, counts)[:, 0], want)


def exact_sums(v, p, unit, lang):
    """Sums over all segmentations of the unit's beginnings, as fractions."""
    out = [Fraction(1)]
    for end in range(1, len(unit) + 1):
        total = Fraction(0)
        for start in range(end):
            if unit[start:end] in v.ids:
                total += out[start] * Fraction(p[v.ids[unit[start:end]], lang])
            elif end - start == 1:
                total += out[start] * math.prod(Fraction(p[v.byte[b], lang]) for b in unit[start].encode())
        out.append(total)
    return out


def log_of_sums(v, p, unit, lang):
    """The logarithm of the sum over all segmentations, boundary by boundary."""
    out = [0.0]
    for end in range(1, len(unit) + 1):
        total = -math.inf
        for start in range(max(0, end - v.longest), end):
            if unit[start:end] in v.ids:
                total = np.logaddexp(total, out[start] + math.log(p[v.ids[unit[start:end]], lang]))
            elif end - start == 1:
                total = np.logaddexp(total, out[start] + sum(math.log(p[v.byte[b], lang]) for b in unit[start].encode()))
        out.append(total)
    return out[-1]


@pytest.mark.parametrize("n", [5, 39, 40, 41, 200, 5000])
def test_sums_of_any_size(n):
    v, rng = small(), np.random.default_rng(n)
    p = rng.random((len(v), 2)) * [1e-9, 1e-2]
    units = ["".join(rng.choice(list("abb\u4e2d\u0e9a"), n).tolist()) for _ in range(3 if n < 1000 else 1)]
    got = pieces.log_probability(v, p, units)
    for u, g in zip(units, got, strict=True):
        for lang in range(2):
            assert g[lang] == pytest.approx(log_of_sums(v, p, u, lang), rel=1e-10)


def test_expected_counts_below_a_doubles_range():
    v, rng = small(), np.random.default_rng(3)
    p, unit = rng.random((len(v), 1)) * 1e-12, "ab" + "\u4e2d" * 20 + "abab"
    got = pieces.expected_counts(v, p, [unit, "ab"], np.array([[2.0], [0.0]]))[:, 0]
    assert got[[v.byte[b] for b in "\u4e2d".encode()]] == pytest.approx(40.0)
    there, back = exact_sums(v, p, unit, 0), exact_sums(v, p, unit[:2], 0)
    as_one = Fraction(p[v.ids["ab"], 0]) / back[2]  # the share of "ab" in one piece at the start
    tail = exact_sums(v, p, unit[-4:], 0)[4]
    at_end = sum(
        Fraction(math.prod(Fraction(p[v.ids[x], 0]) for x in s)) * s.count("ab") for s in segmentations("abab", v.pieces[:6])
    ) / tail
    assert there[-1] < Fraction(1, 10**300) and got[v.ids["ab"]] == pytest.approx(2 * float(as_one + at_end))


def test_languages_of_scripts_without_spaces(spark, vocabulary):
    """Runs of characters that are no pieces are told apart at any length."""
    rare = [chr(c) for c in range(0x4E00, 0x9FA5) if chr(c) not in vocabulary.ids]
    alphabets = {"aa": rare[:400], "bb": rare[5000:5400], "lo": [chr(c) for c in range(0xE81, 0xE8A) if chr(c).isalpha()]}
    rng = np.random.default_rng(5)

    def text(lang, n):
        return "".join(rng.choice(alphabets[lang], n).tolist())

    learned = [(f"{lang}{i}", text(lang, 30), lang) for lang in alphabets for i in range(60)]
    model = lang_id.train(spark.createDataFrame(learned, "doc_id string, text string, lang string"), vocabulary)
    asked = [(f"{lang}{n}", text(lang, n), lang) for lang in alphabets for n in (10, 39, 40, 41, 150, 9000)]
    found = lang_id.predict(spark.createDataFrame(asked, "doc_id string, text string, lang string"), vocabulary, model, ["lang", "doc_id"])
    assert [r.doc_id for r in found.collect() if r.lang != r.lang_pred] == []


def test_samples_follow_the_segmentations_shares():
    v = small()
    p = np.zeros(len(v))
    p[:6] = [0.3, 0.2, 0.2, 0.1, 0.15, 0.05]
    lattices = tokenise.Lattices(v, p)
    n = 20_000
    drawn = Counter(tuple(ids.tolist()) for ids in tokenise.sample(lattices, ["ababa"] * n, list(range(n))))
    all_of = list(segmentations("ababa", v.pieces[:6]))
    shares = [math.prod(p[v.ids[x]] for x in s) for s in all_of]
    for s, share in zip(all_of, shares, strict=True):
        want = share / sum(shares)
        assert drawn[tuple(v.ids[x] for x in s)] / n == pytest.approx(want, abs=4 * math.sqrt(want / n) + 1e-3)
    assert sum(drawn.values()) == n


def test_round_trip(spark, vocabulary):
    encoded = tokenise.encode(docs(spark), vocabulary, ["doc_id", "text", "score", "`odd name`"])
    rows = tokenise.decode(encoded, vocabulary, ["text"]).collect()
    assert len(rows) == docs(spark).count()
    assert all(r.text == r.decoded for r in rows)
    got = {r.doc_id: r.pieces for r in encoded.collect() if r.doc_id is not None}
    assert got[3] is None and got[4] == []
    assert tokenise.encode(docs(spark, []), vocabulary, ["doc_id"]).count() == 0


@pytest.mark.parametrize("first", [0x1F300, 0x0E81, 0x1200, 0x0F40, 0x4E00, 0x3400])
def test_round_trip_of_characters_without_pieces(vocabulary, first):
    """40 characters in a run, whose probability as bytes leaves a double's range."""
    run = "".join(chr(c) for c in range(first, first + 400) if chr(c).isprintable())[:40]
    texts = [run, run * 3, "a word and " + run + " words", chr(first) * 40, "internationalisation" + run[:20]]
    lattices = tokenise.Lattices(vocabulary, tokenise.weights(vocabulary))
    own = [p.encode() for p in map(pieces.marked, vocabulary.pieces)]
    for value, piece in enumerate(vocabulary.byte):
        own[piece] = bytes([value])
    for seed in range(20):
        found = tokenise.sample(lattices, texts, [tokenise.row_key(k, seed) for k in range(len(texts))])
        assert [b"".join(own[i] for i in ids).decode() for ids in found] == texts


def test_shares_out_of_range():
    """The same lattice, its probabilities too small for the sums of products."""
    v, units = small(), ["ab" * 20, "ba" * 20]
    p = np.where(np.arange(len(v)) < 6, np.random.default_rng(2).random(len(v)), 0.1)
    tiny = p * 2.0 ** (-40 * np.array([len(x) or 1 for x in v.pieces]))
    cut = pieces.edges(v, units, 40)
    want, got = (pieces.shares(*pieces.forward(v, q, cut, 40)) for q in (p, tiny))
    assert want.keys() == got.keys()
    assert all(np.allclose(want[e], got[e], rtol=1e-12) for e in want)


def test_samples_depend_on_the_key_alone(spark, vocabulary):
    text = "reproducible sampled segmentations of considerable length " * 20
    df = spark.range(40).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"))
    one = {r.doc_id: tuple(r.pieces) for r in tokenise.encode(df.repartition(5), vocabulary, ["doc_id"]).collect()}
    two = {r.doc_id: tuple(r.pieces) for r in tokenise.encode(df.coalesce(1), vocabulary, ["doc_id"]).collect()}
    assert one == two
    assert len(set(one.values())) > 30


def test_query_is_lossless(spark):
    found = tokenise.op5_sampled_pieces(spark, SF)
    assert found.where("not lossless").count() == 0
    assert found.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_held_out_languages(spark):
    found = lang_id.op1_lang_id(spark, SF)
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    held = found.join(truth, "doc_id").where("held_out")
    right = held.where("lang = lang_pred").count()
    assert right >= 0.97 * held.count()
    assert found.where("score < 0 or score > 1 or score is null").count() == 0


def test_language_of_awkward_texts(spark, vocabulary):
    df = docs(spark)
    model = lang_id.train(df.where(crc_mod(F.col("doc_id"), 3) != 1), vocabulary)
    rows = {r.doc_id: r for r in lang_id.predict(df, vocabulary, model, ["doc_id"]).collect()}
    for i in (3, 4, 5):
        assert (rows[i].lang_pred, rows[i].score) == ("und", 0.0)
    assert rows[6].lang_pred in model.languages
    assert lang_id.predict(docs(spark, []), vocabulary, model, ["doc_id"]).count() == 0


def test_without_any_language(spark, vocabulary):
    df = docs(spark).withColumn("lang", F.lit(None).cast("string"))
    model = lang_id.train(df, vocabulary)
    assert {(r.lang_pred, r.score) for r in lang_id.predict(df, vocabulary, model, ["doc_id"]).collect()} == {("und", 0.0)}


def test_prediction_sums_words(spark, vocabulary):
    """The score against the definition: prior times all words' probabilities."""
    df = docs(spark)
    model = lang_id.train(df, vocabulary)
    got = {r.doc_id: r for r in lang_id.predict(df, vocabulary, model, ["doc_id", "text"]).collect()}[9]
    total = np.log(model.prior) + pieces.log_probability(vocabulary, model.p, lang_id.spaced(lang_id.words(got.text))).sum(axis=0)
    share = np.exp(total - total.max())
    assert got.lang_pred == model.languages[int(total.argmax())]
    assert got.score == pytest.approx((share / share.sum()).max())


def test_long_runs_are_cut():
    assert list(map(len, pieces.cut_long(["x" * 95, "y"]))) == [40, 40, 15, 1]
    assert "".join(itertools.chain.from_iterable(tokenise.units("a  b\n c" + "z" * 90))) == pieces.marked("a  b\n c" + "z" * 90)


def test_freed_memory_is_given_back():
    def held():
        return int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) >> 10

    blocks = [np.ones(8_000) for _ in range(4_000)]
    pins = blocks[::100]  # what stays in use between them keeps the C library from shrinking
    del blocks
    before = held()
    give_back()
    assert held() < before - 100 and len(pins) == 40
