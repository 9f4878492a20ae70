import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from awkward import docs
from pyspark.sql import functions as F

from sparkodds.llm import align

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tokenizers():
    return align.Tokenizers()


def whole_texts(tokenizers, text):
    """Both tokenizers' tokens of the whole text, with each token's byte range."""
    out = []
    for ids, table in ((tokenizers._whole.encode(" " + text, add_special_tokens=False).ids, tokenizers.bytes_a), (tokenizers.encode_b([text])[0], tokenizers.bytes_b)):
        at, own = 0, []
        for i in ids:
            own.append((i, at, at + len(table[i])))
            at += len(table[i])
        if b"".join(table[i] for i in ids) != b" " + text.encode():
            return [], []
        out.append(own)
    return out


def by_hand(tokenizers, texts):
    """The contract's columns, byte by byte and pair by pair."""
    rows, held = [], Counter()
    for text in texts:
        a, b = whole_texts(tokenizers, text) if text else ([], [])
        stops = sorted({e for *_, e in a} & {e for *_, e in b})
        groups = [";".join([])]
        groups, start = [], 0
        for stop in stops:
            own = [",".join(str(i) for i, s, e in side if start <= s and e <= stop) for side in (a, b)]
            groups.append("|".join(own))
            start = stop
        links = [(i, j) for i, s, e in a for j, t, f in b if max(s, t) < min(e, f)]
        held.update(set(links))
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        rows.append((len(a), len(b), len(groups), links, digest))
    best = defaultdict(int)
    for (i, _), n in held.items():
        best[i] = max(best[i], n)
    return [(n_a, n_b, n, len(links), sum(held[x] == best[x[0]] for x in links), sum(held[x] for x in links), d) for n_a, n_b, n, links, d in rows]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_gallop():
    rng = np.random.default_rng(0)
    for n, m in ((1, 1), (5, 1000), (300, 310), (64, 64), (129, 5000)):
        short, long = (np.sort(rng.choice(6000, k, replace=False)) for k in (n, m))
        assert (align.gallop(short, long) == np.searchsorted(long, short)).all()


def test_units_are_cut_as_within_the_text(tokenizers):
    rng = random.Random(1)
    texts = ["".join(rng.choice(" \n\t ab.1'sé漢　\x85\x1c<|\x00") for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    for text in texts:
        cut = tokenizers.cut(tokenizers.units(text))
        assert [i for x in cut for i in x[0]] == tokenizers._whole.encode(" " + text, add_special_tokens=False).ids
        assert [i for x in cut for i in x[1]] == tokenizers.encode_b([text])[0]


def test_long_gaps_are_cut(tokenizers):
    text = " " * 60_000 + "a" + "\n" * 30_000
    assert b"".join(tokenizers.bytes_a[i] for i in tokenizers.encode_a(text)) == b" " + text.encode()


@pytest.mark.parametrize("head", [align.HEAD, 40, 0])
def test_query_against_pairs_by_hand(spark, tokenizers, head):
    own = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 600").orderBy("doc_id").limit(60).collect()]
    texts = [*own, *own[:5], None, "", " ", "a  b ", "▁x", "<|endoftext|> </s> <unk>", "x\x00y", "\U0001f600漢字 ﬁ", "the " * 50]
    table = spark.createDataFrame([(i % 50, t) for i, t in enumerate(texts)], "doc_id long, text string")
    links = align.linked(table, ["doc_id", "text"], tokenizers)
    got = align.count_sums(links, tokenizers.sizes[1], ["doc_id", "text", *COLUMNS[:4], COLUMNS[-1]], head)
    want = by_hand(tokenizers, texts)
    assert Counter((r.doc_id, r.text, *(r[c] for c in COLUMNS)) for r in got.collect()) == Counter(
        (i % 50, t, *w) for i, (t, w) in enumerate(zip(texts, want, strict=True))
    )


def test_lists_of_tokens_groups_and_links(spark, tokenizers):
    rows = align.align(docs(spark), ["doc_id", "text", "score", "`set`", "`odd name`"], tokenizers).collect()
    assert len(rows) == docs(spark).count()
    for r in rows:
        if not r.text or "▁" in r.text:
            assert (r.a, r.b, r.a_stops, r.a_links) == ([], [], [], [])
            continue
        if len(r.text) > 2000:
            assert r.a_stops[-1] == len(r.a) and r.b_stops[-1] == len(r.b)
            continue
        a, b = whole_texts(tokenizers, r.text)
        assert [i for i, *_ in a] == r.a and [i for i, *_ in b] == r.b
        links = [(x, y) for x, (_, s, e) in enumerate(a) for y, (_, t, f) in enumerate(b) if max(s, t) < min(e, f)]
        assert sorted(zip(r.a_links, r.b_links, strict=True)) == links
        assert [a[x - 1][2] for x in r.a_stops] == [b[x - 1][2] for x in r.b_stops]


def test_empty_table(spark, tokenizers):
    links = align.linked(docs(spark, []), ["doc_id"], tokenizers)
    assert align.count_sums(links, tokenizers.sizes[1], ["doc_id"]).count() == 0
    assert align.align(docs(spark, []).select(F.col("doc_id"), "text"), ["doc_id"], tokenizers).count() == 0


def test_awkward_rows(spark, tokenizers):
    links = align.linked(docs(spark), ["doc_id", "score", "`odd name`"], tokenizers)
    rows = align.count_sums(links, tokenizers.sizes[1], ["doc_id", "score", "`odd name`", *COLUMNS[:4], COLUMNS[-1]]).collect()
    assert len(rows) == docs(spark).count()
    assert all((r.n_links, r.count_sum, r.groups_sha256) == (0, 0, "") for r in rows if r.doc_id in (3, 4))
