import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from awkward import docs

from sparkodds.llm import spelling

SF = "/root/testdata/sf0.01"


def near_by_hand(words):
    """For each word its neighbours, by trying every edit."""
    words, symbols = set(words), sorted(set("".join(words)))
    out = defaultdict(set)
    for w in words:
        for i in range(len(w) + 1):
            tries = [w[:i] + c + w[i:] for c in symbols]
            if i < len(w):
                tries += [w[:i] + w[i + 1 :], *(w[:i] + c + w[i + 1 :] for c in symbols)]
            out[w].update(x for x in tries if x != w and x in words)
    return out


def words_by_hand(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def by_hand(rows):
    n = words_by_hand(rows)
    near, form = near_by_hand(n), {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= 5 * n[w]:
            form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


@pytest.fixture(scope="module")
def words():
    rng = random.Random(3)
    own = {"".join(rng.choice("abcéÿ") for _ in range(rng.randint(6, 8))) for _ in range(600)}
    return sorted(own | {"a" * k for k in range(6, 40)} | {"ab" * k for k in range(3, 12)} | {"aba" * 300, "aba" * 299 + "ab", "b" + "aba" * 300})


def test_every_pair_is_found(spark, words):
    got = defaultdict(set)
    for r in spelling.neighbours(spark.createDataFrame([(w,) for w in words], "word string")).collect():
        assert r.near not in got[r.word]
        got[r.word].add(r.near)
    want = near_by_hand([w for w in words if len(w) < 100])
    long = {w for w in words if len(w) >= 100}
    assert {w: x for w, x in got.items() if w not in long} == {w: x for w, x in want.items() if x}
    first = "aba" * 300
    assert got[first] == long - {first} and all(got[x] >= {first} for x in long - {first})


def test_forms_lead_to_roots(spark):
    chain = [("caring", 3), ("carings", 15), ("scarings", 75), ("scarengs", 374), ("zebras", 9), ("zebraz", 45), ("zebrax", 45)]
    got = {r.word: r for r in spelling.forms(spark.createDataFrame(chain, "word string, n long")).collect()}
    assert [got[w].root for w in ("caring", "carings", "scarings", "scarengs")] == ["scarings"] * 3 + ["scarengs"]
    assert (got["zebras"].form, got["zebras"].form_n, got["zebras"].n_near) == ("zebrax", 45, 2)
    assert (got["zebrax"].form, got["zebrax"].n_near) == (None, 2)


def test_query_against_every_edit(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.op12_variants(spark, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == by_hand(rows)


def test_awkward_rows(spark):
    rows = [(r.doc_id, r.text) for r in docs(spark).collect()] + [(None, "Straße straße STRASSE Strasse Straßen " * 9)] * 2
    table = docs(spark).select("doc_id", "text").union(spark.createDataFrame(rows[-2:], "doc_id long, text string"))
    words = spelling.vocabulary(spelling.with_typos(spelling.runs(table)))
    got = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.forms(words).collect()}
    assert got == by_hand(rows)
    none = spelling.vocabulary(spelling.with_typos(spelling.runs(docs(spark, []))))
    assert spelling.forms(none).count() == 0
