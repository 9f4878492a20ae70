import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkodds.llm import forest, topk

SCHEMA = "vec_id long, embedding array<float>, label int, score string, shard int"


def table(spark, vectors, first=0):
    rows = [(first + i, None if v is None else [None if x is None else float(x) for x in v], 0, "s", 1) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA)


def brute(ids, x, queries, k, score, smallest):
    out = []
    for q in queries:
        s = [(score(x[i], x[q]), ids[i]) for i in range(len(ids)) if ids[i] != ids[q]]
        s.sort(key=lambda t: (t[0] if smallest else -t[0], t[1]))
        out += [(ids[q], rank + 1, v, sc) for rank, (sc, v) in enumerate(s[:k])]
    return sorted(out)


@pytest.mark.parametrize(("n", "dim", "k"), [(400, 16, 20), (300, 7, 5), (12, 4, 20), (1, 4, 3)])
def test_top_k_against_brute_force(spark, monkeypatch, n, dim, k):
    monkeypatch.setattr(topk.grid, "SHARD", 64)
    monkeypatch.setattr(topk.grid, "BLOCK", 16)
    x = np.random.default_rng(n).normal(size=(n, dim)).astype(np.float32)
    x[n // 2 :] = np.round(x[n // 2 :] * 2) / 2  # ties
    got = topk.top_k(table(spark, x), F.col("vec_id") % 5 == 0, k)
    q = np.floor(64 * x.astype(np.float64))
    want = brute(list(range(n)), q, [i for i in range(n) if i % 5 == 0], k, lambda a, b: int(a @ b), False)
    assert sorted((r.query_id, r.rank, r.vec_id, int(r.score)) for r in got.collect()) == want


BAD = [None, [1.0, None, 2.0], [float("nan"), 0, 1], [float("inf"), 0, 1], [], [1.0, 2.0]]


@pytest.mark.parametrize("op", ["topk", "forest"])
def test_awkward_vectors(spark, op):
    good = [[1, 2, 3], [1, 2, 3], [3, 2, 1], [0, 0, 0], [-1, -2, -3]]
    df = table(spark, good + BAD).union(table(spark, [[1, 2, 3]]))
    found = topk.top_k(df, F.col("vec_id") >= 0, 20) if op == "topk" else forest.nearest(df, F.col("vec_id") >= 0, 20)
    rows = found.collect()
    assert {r.vec_id for r in rows} == ({0, 1, 2, 3, 4} if op == "topk" else {0, 1, 2, 4})
    assert all(r.query_id != r.vec_id for r in rows)
    assert len(rows) == (20 if op == "topk" else 12)
    empty = table(spark, [])
    none = topk.top_k(empty, F.lit(True)) if op == "topk" else forest.nearest(empty, F.lit(True))
    assert none.count() == 0
    assert set(none.columns) == {"query_id", "rank", "vec_id", "score"}


def test_forest_reaches_every_copy_and_the_root(spark):
    """Few vectors: every query ends at the root, so the result is exact."""
    x = np.random.default_rng(3).normal(size=(150, 8)).astype(np.float32)
    x[40:90] = x[40]
    got = forest.nearest(table(spark, x), F.col("vec_id") % 10 == 0, 10)
    d = x.astype(np.float64)
    want = brute(list(range(150)), d, list(range(0, 150, 10)), 10, lambda a, b: float(np.sqrt(((a - b) ** 2).sum())), True)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()) == want


def test_forest_recall(spark, monkeypatch):
    """Ranges, slices and blocks at work, ascending before the root."""
    monkeypatch.setattr(forest.grid, "SHARD", 512)
    monkeypatch.setattr(forest.grid, "BLOCK", 8)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 32))
    x = (centres[rng.integers(0, 40, 4000)] + 0.5 * rng.normal(size=(4000, 32))).astype(np.float32)
    rows = forest.nearest(table(spark, x), F.col("vec_id") % 100 == 0, 10, trees=24, gather=0.3, least=300).collect()
    d = x.astype(np.float64)
    hit = 0
    for q in range(0, 4000, 100):
        s = np.sqrt(((d - d[q]) ** 2).sum(axis=1))
        s[q] = np.inf
        mine = [r for r in rows if r.query_id == q]
        assert [r.rank for r in sorted(mine, key=lambda r: (r.score, r.vec_id))] == list(range(1, 11))
        assert all(math.isclose(r.score, s[r.vec_id], rel_tol=1e-15) for r in mine)
        hit += len({r.vec_id for r in mine} & set(np.argsort(s, kind="stable")[:10].tolist()))
    assert hit >= 0.9 * 400


def test_query_recall(spark):
    sf = "/root/testdata/sf0.1"
    e = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x, ids = np.stack(e["embedding"]).astype(np.float64), e["vec_id"].to_numpy()
    found = forest.op8_forest(spark, sf).toPandas()
    hit = 0
    for q, rows in found.groupby("query_id"):
        s = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        s[ids == q] = np.inf
        hit += len(set(ids[np.argsort(s, kind="stable")[:10]].tolist()) & set(rows["vec_id"]))
    assert hit >= 0.9 * len(found)
