"""The pipeline's stages against plain readings of what they must do."""

import pytest
from awkward import docs
from test_texts import brute_components, brute_lines

import corpus_pipeline
from sparkodds.llm import mixing, pieces, tokenise, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """What each stage got and gave."""
    df, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.materialize(stage(spark, df, SF))
        out.append((name, df, after))
        df = after
    return {name: (before, after) for name, before, after in out}


def test_columns(steps):
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    *most, last = steps.values()
    assert all(after.columns == names for _, after in most)
    assert last[1].columns == [*names, "pieces"]


def test_toxic_documents_go(spark, steps):
    before, after = steps["toxicity"]
    model, logp = toxicity.learned(before, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = toxicity.score(before, model, logp, ["doc_id"]).toPandas()
    assert sorted(r.doc_id for r in after.collect()) == sorted(scores[scores["score"] < toxicity.TOXIC]["doc_id"].tolist())


def test_lines(steps):
    before, after = steps["line_dedup"]
    assert {r.doc_id: r.text for r in after.collect()} == brute_lines([(r.doc_id, r.text) for r in before.collect()])
    assert all(r.n_chars == len(r.text) for r in after.collect())


def test_one_of_each_group(steps):
    before, after = steps["jaccard_join"]
    want = [i for i, _, c in brute_components([(r.doc_id, r.text) for r in before.collect()]) if i == c]
    assert sorted(r.doc_id for r in after.collect()) == sorted(want)


def test_near_duplicates_go_by_row(spark):
    """Ids that repeat or are missing: a clean text stays, of copies one row does."""
    passage = " ".join(f"word{i}" for i in range(60))
    near, clean = passage + " more", " ".join(f"other{i}" for i in range(50))
    rows = [
        (3, passage), (1, near), (1, clean),  # id 1 has a copy and a clean text
        (None, "alone here with seven words in all"), (None, "alone here with seven words in all"),
        (7, "twice the same id and the same text"), (7, "twice the same id and the same text"),
        (None, passage), (8, None), (8, None), (None, ""), (9, clean + " x"),
    ]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, df, SF)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(
        [(1, near), (1, clean), (None, rows[3][1]), (7, rows[5][1]), (8, None), (8, None), (None, "")], key=str
    )


def test_copies(steps):
    before, after = steps["mixing"]
    want = sorted(r.doc_id for r in mixing.mix(before).collect() for _ in range(r.copies))
    assert sorted(r.doc_id for r in after.collect()) == want


def test_pieces(steps):
    before, after = steps["pieces"]
    assert after.count() == before.count()
    rows = tokenise.decode(after, pieces.load(), ["text"]).collect()
    assert all(r.text == r.decoded for r in rows)


def test_stages_bear_anything(spark):
    for rows in (None, []):
        df = docs(spark, rows)
        for _, stage in corpus_pipeline.STAGES:
            before, df = df, corpus_pipeline.materialize(stage(spark, df, SF))
            assert df.columns[: len(before.columns)] == before.columns
