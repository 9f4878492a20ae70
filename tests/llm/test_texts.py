"""Licences, toxicity, line dedup, n-gram join."""

import itertools
import random
import re

import numpy as np
import pandas as pd
import pytest
from awkward import docs
from pyspark.sql import functions as F

from sparkodds.llm import components, jaccard_join, licences, line_dedup, toxicity
from sparkodds.llm import shingles as sh

SF = "/root/testdata/sf0.01"


# -- licences ----------------------------------------------------------------

MIT = """# Copyright (c) 2020 Some Body
#
Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""

GPL = """This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version."""


@pytest.mark.parametrize(
    ("text", "want", "unmatched"),
    [
        (MIT, "MIT", 0),
        (MIT + "\n\n" + GPL, "GPL-3.0-or-later,MIT", 0),
        ("// SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0-or-later", 0),
        ("A title\nLicensed under CC BY-SA 4.0.\nmore", "CC-BY-SA-4.0", 0),
        ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0-only", 0),
        ("Released under the MIT License. Released under the MIT licence.", "MIT", 0),
        ("Our own licence forbids everything.", "", 1),
        ("Nothing of the kind.", "", 0),
        ("", "", 0),
        (None, "", 0),
    ],
)
def test_licences(spark, text, want, unmatched):
    row = licences.scan(docs(spark, [(1, text, *[None] * 7)]), ["doc_id"]).first()
    assert (row.licences, row.unmatched) == (want, unmatched)


@pytest.mark.parametrize(
    ("text", "want", "ids"),
    [
        ("Released under GPL v2.", "GPL-2.0-only", "<GPL2Ref>"),
        ("Distributed under the GPL, version 3 or later.", "GPL-3.0-or-later", "<GPL3PlusRef>"),
        ("Published under MIT. A sentence of something else.", "MIT", "<MITRef>"),
        ("Released under Apache-2.0.", "Apache-2.0", "<ApacheRef>"),
        ("This work is available under CC BY 4.0.", "CC-BY-4.0", "<CCBYRef>"),
        ("All rights reserved.", "", "<AllRights>"),
        ("This program is free\nsoftware.", "", "<FreeSoftware>"),
    ],
)
def test_known_sentences_without_the_word_licence(spark, text, want, ids):
    row = licences.scan(docs(spark, [(1, text, *[None] * 7)]), ["doc_id"]).first()
    assert (row.licences, row.sentence_ids, row.unmatched) == (want, ids, ids.count("<Free"))


def test_every_known_sentence_is_found(spark):
    known = [(s, f"<{name}>") for name, all_of in licences.SENTENCES.items() for s in all_of]
    rows = licences.scan(docs(spark, [(i, s, *[None] * 7) for i, (s, _) in enumerate(known)]), ["doc_id"]).collect()
    # As written in the table; some are reached only through other spellings.
    missed = [known[r.doc_id] for r in rows if r.sentence_ids != known[r.doc_id][1]]
    assert not [s for s, _ in missed if not re.search(licences.SPEAKS, s)]


def test_licences_awkward(spark):
    assert licences.scan(docs(spark), ["doc_id", "`odd name`"]).count() == docs(spark).count()
    assert licences.scan(docs(spark, []), ["doc_id"]).count() == 0
    plan = licences.scan(docs(spark), ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


# -- toxicity ----------------------------------------------------------------


@pytest.fixture(scope="module")
def decoder():
    words = "stupid idiot loser the and other words of this place " * 50
    table, n = toxicity.code_table(), np.zeros(toxicity.CODES**3)
    c = np.concatenate([[0, 0], toxicity.codes(words, table), [0]])
    first = np.where(c[1:-1] == 0, 0, c[:-2])
    n += np.bincount((first * 64 + c[1:-1]) * 64 + c[2:], minlength=64**3)
    gram = np.flatnonzero(n)
    return toxicity.Decoder(toxicity.language_model(pd.DataFrame({"gram": gram, "n": n[gram]})))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("You $tup1d l0s3r", "you stupid loser"),
        ("an s t u p i d one", "an stupid one"),
        ("an i.d.i.o.t!", "an idiot!"),
        ("idiooooot", "idiot"),
        ("st*pid words!!", "stupid words!!"),
        ("the words of this place", "the words of this place"),
        ("", ""),
    ],
)
def test_restored(decoder, text, want):
    assert decoder.text(text) == want


def test_viterbi_is_the_best_path(decoder):
    """Against every path of the lattice."""
    for span in ["1d10t", "$tu", "l0s*r", "oo0"]:
        best = []
        for path in itertools.product(*decoder.choices(span)):
            text, a, b = "".join(x for x, _ in path), 0, 0
            score = sum(p for _, p in path)
            for x in text:
                c = decoder.code.get(x, toxicity.OTHER)
                score += float(decoder.logp[a, b, c])
                a, b = b, c
            best.append((score + float(decoder.logp[a, b, 0]), text))
        top = max(s for s, _ in best)
        assert decoder.viterbi(span) in {t for s, t in best if abs(s - top) < 1e-6}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("|diot", "idiot"),
        ("an idio+ one", "an idiot one"),
        ("+he word$ of", "the words of"),
        ("thi* place\").", "this place\")."),
        ("(the) **words** loser!! of***", "(the) **words** loser!! of***"),
    ],
)
def test_signs_at_edges(decoder, text, want):
    assert decoder.text(text) == want


def test_viterbi_is_the_best_path_with_signs_at_edges(decoder):
    for span in ["|diot", "idio+", "wor$$", "lose*", "(he", "(*f", "of!!", "+he|", "o*?"]:
        best = []
        for path in itertools.product(*decoder.choices(span)):
            text, a, b = "".join(x for x, _ in path), 0, 0
            score = sum(p for _, p in path)
            for x in text:
                score += float(decoder.logp[a, b, c := decoder.code[x]])
                a, b = b, c
            best.append((score + float(decoder.logp[a, b, 0]), text))
        top = max(s for s, _ in best)
        assert decoder.viterbi(span) in {t for s, t in best if abs(s - top) < 1e-6}


def test_spans_of_any_length(decoder):
    assert decoder.text("an idi" + "o" * 3000 + "t") == "an idiot"
    assert decoder.text("an " + " ".join("stupididiot" * 200)) == "an " + "stupididiot" * 200
    joined = "the,words,of,this,place," * 4 + "$tup1d/1d10t;and," + "the,other,words," * 4
    assert decoder.text(joined) == joined.replace("$tup1d/1d10t", "stupid/idiot")


def test_held_out_toxicity(spark):
    """The labels that the model hasn't learned from, on a table large enough to learn."""
    sf = "/root/testdata/sf0.1"
    found = toxicity.op6_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    toxic, hit = found["toxic"] == 1, found["predicted"] == 1
    assert (toxic & hit).sum() >= 0.85 * toxic.sum()
    assert (~toxic & hit).sum() <= 0.02 * (~toxic).sum()


def test_toxicity_awkward(spark):
    df = docs(spark)
    marks = spark.createDataFrame([(1, 1, "x"), (1, 0, "y"), (2, None, "z"), (None, 1, "z"), (99, 1, "z")], "doc_id long, toxic int, text string")
    for labels in (marks, marks.where("false")):
        model, logp = toxicity.learned(df, labels)
        rows = toxicity.score(df, model, logp, ["doc_id", "score"]).collect()
        assert len(rows) == df.count()
        assert all(0 <= r[-1] <= 1 for r in rows)
    model, logp = toxicity.learned(docs(spark, []), marks)
    assert toxicity.score(docs(spark, []), model, logp, ["doc_id"]).count() == 0


# -- line dedup --------------------------------------------------------------


def words_of(line):
    return frozenset(x for x in re.split("[\x20\x09-\x0d]+", line) if x)


def brute_lines(rows, percent=line_dedup.PERCENT):
    """{(doc_id, text): kept text} by comparing all lines."""
    every = sorted({(i, n, line) for i, t in rows if t is not None for n, line in enumerate(t.split("\n"))})
    sets = [(i, n, words_of(line)) for i, n, line in every]
    gone = set()
    for i, n, s in sets:
        for j, m, r in sets:
            if s and r and (j, m) < (i, n) and 100 * len(s & r) >= percent * len(s | r):
                gone.add((i, n, s))
                break
    out = {}
    for i, t in rows:
        kept = [] if t is None else [x for n, x in enumerate(t.split("\n")) if (i, n, words_of(x)) not in gone]
        out[i] = None if t is None else "\n".join(kept)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup_against_brute_force(spark, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    base = [[rng.choice(words) for _ in range(rng.choice([1, 2, 8, 9, 10, 12, 25, 40]))] for _ in range(60)]

    def line():
        own = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            own[rng.randrange(len(own))] = rng.choice(words)
        if rng.random() < 0.3:
            rng.shuffle(own)
        return " ".join(own)

    rows = [(i, "\n".join(rng.choice([line(), line(), ""]) for _ in range(rng.randint(0, 8)))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["row"].doc_id: r["row"].text for r in line_dedup.dedup(df).collect()}
    assert got == brute_lines(rows)


def test_line_dedup_awkward(spark):
    df = docs(spark)
    found = line_dedup.dedup(df)
    rows = [r["row"] for r in found.collect()]
    assert found.select("row.*").columns == df.columns and len(rows) == df.count()
    text = [(r.doc_id, r.text) for r in rows]
    assert (3, None) in text and (4, "") in text and (None, None) in text
    assert text.count((2, "")) == 2 and (-5, docs(spark).where("doc_id = -5").first().text) in text
    assert (9, "Größe und Straße\nund noch mehr\n") in text
    assert (1, df.where("doc_id = 1").first().text) in text  # eight of nine words: 7 / 9 is below the threshold
    assert line_dedup.dedup(docs(spark, [])).count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_line_dedup_of_near_copies_keeps_no_square(spark, monkeypatch):
    """200 near copies: no table on the way has rows for all their pairs."""
    base, most = " ".join(f"w{i}" for i in range(30)), []

    def written(df, f=line_dedup.materialize):
        out = f(df)
        most.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "materialize", written)
    df = spark.createDataFrame([(i, f"{base} own{i}") for i in range(200)], "doc_id long, text string")
    kept = [r["row"].doc_id for r in line_dedup.dedup(df).where("n_removed = 0").collect()]
    assert kept == [0] and max(most) <= 12 * 200


# -- n-gram join -------------------------------------------------------------


def brute_components(rows, percent=jaccard_join.PERCENT):
    sets = []
    for _, t in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = [x for x in re.split("[\x20\x09-\x0d]+", lower) if x]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    members = {}
    for i in range(len(rows)):
        members.setdefault(find(i), []).append(rows[i][0])
    out = []
    for i, (name, _) in enumerate(rows):
        own = [x for x in members[find(i)] if x is not None]
        out.append((name, len(sets[i]), min(own) if own else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(4))
def test_components_against_brute_force(spark, monkeypatch, seed):
    """With limits so low that frequent shingles, windows and cut tiles all occur."""
    monkeypatch.setattr(jaccard_join, "LEAST", 4)
    monkeypatch.setattr(jaccard_join, "WINDOW", 500)
    monkeypatch.setattr(jaccard_join, "REPORTED", 2)
    monkeypatch.setattr(jaccard_join, "TILE", 3)
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(2000)]
    shared = [rng.choice(words) for _ in range(12)]
    rows = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([3, 5, 6, 20, 60, 150]))]
        if rng.random() < 0.5:
            base += shared
        for _ in range(rng.choice([1, 1, 2, 6])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((rng.randrange(10_000), " ".join(own) if rng.random() < 0.9 else "  ".join(own).upper()))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((tuple(r) for r in jaccard_join.near_duplicates(df).collect()), key=str)
    assert got == brute_components(rows)


def test_join_awkward(spark):
    df = docs(spark)
    got = sorted((tuple(r) for r in jaccard_join.near_duplicates(df).collect()), key=str)
    assert got == brute_components([(r.doc_id, r.text) for r in df.collect()])
    assert jaccard_join.near_duplicates(docs(spark, [])).count() == 0


def test_bitmaps_bound_the_overlap():
    rng = np.random.default_rng(0)
    for _ in range(200):
        pool = rng.integers(0, 2**62, 300).astype(np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 200))) for _ in range(2))
        x, y = sh.signature(a), sh.signature(b)
        words = min(len(x), len(y))
        bound = sh.overlap_bound(len(a), sh.folded(x, words), np.array([len(b)]), sh.folded(y, words)[None, :])[0]
        assert bound >= len(np.intersect1d(a, b))


def test_words_of_bytes():
    one, _ = sh.word_hashes([b"The  cat\tSAT \xc3\x9cber", b"", b"the cat sat \xc3\x9cber"])
    assert len(one) == 8 and (one[:4] == one[4:]).all()
    assert len(set(sh.word_hashes([b"a b ab ba aa bb"])[0].tolist())) == 6


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + rng.randint(1, 50)) for _ in range(80)] + [(500, 500)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0}
    assert {v for k, v in got.items() if 100 <= k <= 150} == {100}
    empty = spark.createDataFrame([], "a long, b long")
    assert components.components(empty).where(F.col("node") >= 0).count() == 0
