"""Held-out accuracy of the two classifiers, and their parts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import quality, toxicity
from quarry.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize(("name", "label"), [("op2_toxicity", "toxic"), ("op8_quality_rules", "quality")])
def test_held_out_accuracy(spark, name, label):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = QUERIES[name](spark, SF).where("held_out").join(labels, "doc_id").toPandas()
    assert len(got) > 500
    assert (got["predicted"] == got[label]).mean() > 0.97
    ones, zeros = got.score[got[label] == 1].to_numpy(), got.score[got[label] == 0].to_numpy()
    assert (ones[:, None] > zeros[None, :]).mean() > 0.97


def test_machine_learns_a_pair_that_single_terms_miss():
    """Only the two terms together are toxic, each alone as often as not in clean texts."""
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for _ in range(3_000):
        a, b = rng.random() < 0.4, rng.random() < 0.4
        noise = rng.integers(1_000, 5_000, 12)
        rows.append(np.array(sorted({*noise.tolist(), *([1] if a else []), *([2] if b else [])})))
        labels.append(int(a and b))
    model = toxicity.train(rows, labels)
    score = {(a, b): model.score(np.array([model.slots[x] for x, on in ((1, a), (2, b)) if on], dtype=int))
             for a in (0, 1) for b in (0, 1)}
    assert score[1, 1] > 0.7
    assert max(score[0, 0], score[0, 1], score[1, 0]) < 0.5


def test_score_is_the_plain_double_sum(spark):
    """Scores of the query against w0 + sum w_i + sum over all pairs, term by term."""
    from quarry.llm.queries import toxicity_model

    folder = "/root/testdata/sf0.01"
    model = toxicity_model(spark, folder)
    rows = QUERIES["op2_toxicity"](spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"), "doc_id")
    for r in rows.limit(200).collect():
        words = set(toxicity._WORDS((r["text"] or "").lower()))
        on = sorted({model.slots[b] for w in words for b in toxicity.term_buckets(w) if b in model.slots})
        z = model.base + sum(model.linear[i] for i in on)
        z += sum(float(np.dot(model.factors[i], model.factors[j])) for n, i in enumerate(on) for j in on[:n])
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -35, 35))), abs=1e-9)


def test_every_row_is_learnt_from():
    """Rows with common words in common are no copies: each counts."""
    rows = [np.array([1, 2, 3, 100 + k]) for k in range(40)]
    seen = []
    real, toxicity._choose = toxicity._choose, lambda r, y: seen.append(len(r)) or real(r, y)
    try:
        toxicity.train(rows, [k % 2 for k in range(40)])
    finally:
        toxicity._choose = real
    assert seen == [40]


def test_buckets_column_is_whole_text(spark):
    text = "filler " * 50_000 + "needleword"
    got = spark.createDataFrame([(text,)], "text string").select(toxicity.buckets_column(F.col("text")).alias("b")).first()["b"]
    assert set(toxicity.term_buckets("needleword")) <= set(got)


def test_rules_as_columns_equal_rules_in_numpy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(300)
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.fit(docs.join(labels, "doc_id").withColumnRenamed("quality", "label"))
    assert model.rules
    got = quality.score_documents(docs, model).select("text", "score").toPandas()
    x = np.array([quality.statistics(t) for t in got.text])
    assert np.allclose(model.score(x), got.score, atol=1e-12)


def test_statistics_of_nothing():
    assert set(quality.statistics("")) == set(quality.statistics(" \n ")) == {0.0}
