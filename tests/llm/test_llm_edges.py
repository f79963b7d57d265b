"""Every query on empty tables and on odd rows, and every operator beside clashing columns."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import bpe, chat, html, lzprint, mixing, neighbours, ominhash, quality, toxicity
from quarry.llm.queries import QUERIES, VOCABULARY


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty_dir, name):
    assert QUERIES[name](spark, empty_dir).count() == (1 if name.startswith("op7") else 0)


def test_pipeline_on_empty_and_odd_tables(spark, empty_dir, odd_dir):
    assert corpus_pipeline.run(spark, empty_dir).count() == 0
    out = corpus_pipeline.run(spark, odd_dir).collect()
    assert all(r["exact"] for r in out)


def test_documents_queries_on_odd_rows(spark, odd_dir):
    for name in ("op1_byte_bpe", "op2_toxicity", "op3_order_minhash", "op4_lz_fingerprint", "op8_quality_rules", "op9_mixing"):
        rows = QUERIES[name](spark, odd_dir).collect()
        assert len(rows) == 10, name
        for r in rows:
            if "score" in r.asDict():
                assert 0 <= r["score"] <= 1
                assert r["held_out"] is not None


def test_null_text_is_empty(spark, odd_dir):
    row = QUERIES["op1_byte_bpe"](spark, odd_dir).where("doc_id = 2").first()
    nothing = hashlib.sha256(b"").hexdigest()
    assert (row["n_tokens"], row["ids_sha256"], row["decoded_sha256"]) == (0, nothing, nothing)


def test_vectors_that_take_no_part(spark, odd_dir):
    rows = QUERIES["op5_neighbours"](spark, odd_dir).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in rows] == [
        (0, 1, 5), (0, 2, 50), (0, 3, 6), (0, 4, 9), (50, 1, 0), (50, 2, 5), (50, 3, 6), (50, 4, 9)]


def test_pages_without_text(spark, odd_dir):
    got = {(r["page_id"], r["text"]) for r in QUERIES["op10_html"](spark, odd_dir).collect()}
    assert {(1, ""), (2, ""), (None, "Only & this")} <= got


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "some text here", "kept", 1, "b")],
                                 "doc_id long, text string, score string, ids int, `a.b` string")
    model = toxicity.train([], [])
    assert toxicity.score_documents(docs, model).first()["a.b"] == "b"
    assert quality.score_documents(docs, quality.train(quality.np.zeros((0, 16)), [])).first()["score"] == 0.5
    assert bpe.encode_documents(docs, VOCABULARY, r"\S+|\s+").first()["n_tokens"] > 0
    odd = docs.withColumn("source", F.lit("s")).withColumn("size", F.lit("x")).withColumn("row", F.lit("y")) \
        .withColumn("class", F.lit("z")).withColumn("digest", F.lit("z")).withColumn("span", F.lit("z"))
    assert mixing.mixed_documents(odd).columns == odd.columns
    assert ominhash.keep_one(odd).columns == odd.columns
    assert lzprint.chained(odd).first()["doc_id"] == 1
    pages = spark.createDataFrame([("<p>x", 5, "t")], "html string, n_chars int, text string")
    assert html.extract_pages(pages).first()["n_chars"] == 0
    turns = spark.createDataFrame([(1, 0, "user", "t", "f")], "conv_id int, turn int, role string, text string, formatted string")
    assert chat.format_conversations(turns).first()["formatted"] == "<|im_start|>user\nt<|im_end|>\n"
    vectors = spark.createDataFrame([(0, [1.0], "x", 1), (1, [2.0], "y", 2)], "vec_id int, embedding array<double>, id string, v int")
    assert neighbours.search(vectors, F.col("id") == 0).first()["vec_id"] == 1
