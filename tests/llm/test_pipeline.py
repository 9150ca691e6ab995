"""The pipeline's stages against brute force, each on its own input."""

import re

import pytest
from pyspark.sql import functions as F
from test_llm_edges import alike, brute_classes, brute_hits

import corpus_pipeline as pipeline
from convoframe.llm.pieces import SPACE, Pieces
from convoframe.llm.queries import PIECES, vocabulary
from convoframe.llm.toxicity import fit_toxicity, toxicity_scores
from convoframe.session import materialise

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """Input and output of each stage."""
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        made = materialise(stage(spark, docs, FOLDER), name)
        out[name] = (docs, made)
        docs = made
    return out


def rows(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_stages_and_columns(spark, steps):
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontaminate", "sentencepiece"]
    columns = spark.read.parquet(f"{FOLDER}/documents.parquet").columns
    assert all(steps[n][1].columns == columns for n, _ in pipeline.STAGES[:-1])


def test_toxicity(spark, steps):
    before, after = steps["toxicity"]
    model = fit_toxicity(before, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    kept = toxicity_scores(before, model).where("score < 0.3")
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, _ in rows(after)]


def test_exact_dedup(steps):
    before, after = map(rows, steps["exact_dedup"])
    first: dict = {}
    for doc_id, text in before:
        first.setdefault(re.sub(r"[ \t-\r]+", " ", text), doc_id)
    assert [i for i, _ in after] == sorted(first.values())


def test_near_dedup(steps):
    before, after = map(rows, steps["near_dedup"])
    classes = brute_classes(before, alike(80, 5))
    assert [i for i, _ in after] == sorted(before[x][0] for x, k in classes.items() if before[x][0] == k)


def test_decontaminate(spark, steps):
    before, after = map(rows, steps["decontaminate"])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    clean = [i for i, t in before if brute_hits(t, items)[1] == 0]
    assert [i for i, _ in after] == clean and len(clean) < len(before)


def test_sentencepiece(steps):
    before, after = steps["sentencepiece"]
    pieces = Pieces.load(vocabulary(PIECES))
    found = {r.doc_id: r for r in after.collect()}
    assert len(found) == before.count()
    for doc_id, text in rows(before):
        assert found[doc_id].text == text and found[doc_id].round_trip
        if len(text) < 3_000:
            assert found[doc_id].ids == pieces.best_path(SPACE + text.replace(" ", SPACE))


def test_run_gives_the_rows_of_the_last_stage(spark, steps):
    done = pipeline.run(spark, FOLDER)
    last = steps["sentencepiece"][1]
    assert sorted(map(repr, done.collect())) == sorted(map(repr, last.collect()))


def test_odd_rows_go_through(spark):
    """Null and repeated ids, null and empty texts, and a column named like an inner one."""
    docs = spark.createDataFrame(
        [(None, "a b c"), (None, "a b c"), (1, None), (1, ""), (2, "x y z"), (2, "x y z"), (2, "other words here")],
        "doc_id long, text string",
    ).withColumn("row", F.lit("r"))
    for name, stage in pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, FOLDER), name)
    # Of the null and the empty text, which count as equal, either stays.
    left = sorted((repr(r.doc_id), r.text or "") for r in docs.collect())
    assert left == [("1", ""), ("2", "other words here"), ("2", "x y z"), ("None", "a b c")]
    encoded = pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert encoded.count() == 4
    none = docs.limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, FOLDER).count() == 0
