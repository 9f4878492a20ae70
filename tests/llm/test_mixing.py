import random

import pytest
from awkward import docs
from pyspark.sql import functions as F

from sparkodds.llm import mixing


def brute_targets(sizes, weights=(1, 2, 3), cap=3):
    """Water filling, round after round, as the definition says."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = total - sum(capped.values())
        open_weight = sum(weight[s] for s in names if s not in capped)
        share = {s: rest * weight[s] / open_weight for s in names if s not in capped}
        over = [s for s, t in share.items() if t > cap * sizes[s]]
        if not over:
            return share | capped
        capped |= {s: cap * sizes[s] for s in over}


@pytest.mark.parametrize("seed", range(4))
def test_targets_and_taken(spark, seed):
    rng = random.Random(seed)
    names = [None, "a", "b", "c", "dd", "Z", "é", "zz"][: 3 + seed]
    rows = [(i, rng.choice(names + names[:1] * 6), " ".join("w" * 1 for _ in range(rng.randint(1, 30)))) for i in range(3000)]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).toPandas()
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = brute_targets(sizes)
    for s in sizes:
        own = found[found["source"].isna()] if s is None else found[found["source"] == s]
        assert own["target"].iloc[0] == pytest.approx(want[s])
        assert own["source_size"].unique().tolist() == [sizes[s]]
        assert abs(own["taken"].sum() - want[s]) <= own["size"].max() / 2 + 1e-6
        assert (own["taken"] <= 3 * own["size"]).all()
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))


def test_reruns_agree_whatever_the_partitions(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("string").alias("source"), F.lit("a b c").alias("text"))
    one = mixing.mix(df.repartition(7)).toPandas().sort_values("doc_id", ignore_index=True)
    two = mixing.mix(df.coalesce(1)).toPandas().sort_values("doc_id", ignore_index=True)
    assert one.equals(two)


def test_awkward(spark):
    df = docs(spark)
    found = mixing.mix(df)
    assert found.count() == df.count()
    assert found.where("text is null" if "text" in found.columns else "size is null").count() == 0
    rows = mixing.mixed(df)
    assert rows.columns == df.columns
    taken = {r.doc_id: r.copies for r in found.collect()}
    assert rows.where("doc_id = 6").count() == taken[6]
    assert mixing.mix(docs(spark, [])).count() == 0
    assert mixing.mixed(docs(spark, [])).count() == 0


def test_no_words_at_all(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b")], "doc_id long, text string, source string")
    assert {(r.target, r.taken) for r in mixing.mix(df).collect()} == {(0.0, 0)}
