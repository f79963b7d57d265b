"""The whole pipeline against plain Python on 200 documents, and on columns that clash."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F
from test_llm_near import brute_classes

import corpus_pipeline
from quarry.llm import bpe, mixing, quality, toxicity
from quarry.llm.queries import QUALITY_FROM, TOXIC_FROM, VOCABULARY
from quarry.llm.tables import remainder_of_id

SF = "/root/testdata/sf0.01"


def brute_mix(docs):
    """Copies of each document: packets of all sources in the order of their finish times, up to as many words as there are."""
    sized = [(r["doc_id"], r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in docs]
    totals = defaultdict(int)
    for _, s, n in sized:
        totals[s] += n
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(sorted(totals, key=lambda s: (s is None, s)))}
    offers = []
    for s in totals:
        before = 0
        own = sorted((int(hashlib.md5(f"{i}:5".encode()).hexdigest()[:15], 16), i, n) for i, of, n in sized if of == s)
        for repeat in range(3):
            for _, i, n in own:
                for at in range(0, n, mixing.PACKET):
                    words = min(mixing.PACKET, n - at)
                    before += words
                    offers.append((before / weight[s], s is not None, s or "", before, words, i, repeat))
    left, took, size = sum(totals.values()), defaultdict(int), {i: n for i, _, n in sized}
    for *_, words, i, repeat in sorted(offers):
        took[i, repeat] += min(words, left)
        left -= min(words, left)
    return {i: sum(t > 0 and 2 * t >= size[i] for (of, _), t in took.items() if of == i) for i in size}


def test_pipeline_against_plain_python(spark, tables):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(200).collect()
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    folder = tables(documents=[tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in docs],
                    labels=[tuple(r[c] for c in ("doc_id", "quality", "toxic")) for r in labels])
    given = spark.read.parquet(f"{folder}/labels.parquet")

    def model(rows, kind, label, part):
        frame = spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string")
        return kind.fit(toxicity.labelled_documents(frame, given, label, part, kind.FIT_ROWS))

    fm = model(docs, toxicity, "toxic", remainder_of_id("doc_id", 3) != 1)

    def toxic(text):
        words = set(toxicity._WORDS((text or "").lower()))
        return fm.score(np.array(sorted({fm.slots[b] for w in words for b in toxicity.term_buckets(w) if b in fm.slots}), dtype=int))

    kept = [r for r in docs if toxic(r["text"]) < TOXIC_FROM]
    assert 0 < len(kept) < 200
    rules = model(kept, quality, "quality", remainder_of_id("doc_id", 5) != 0)
    kept = [r for r in kept if rules.score(np.array([quality.statistics(r["text"] or "")]))[0] >= QUALITY_FROM]
    group = brute_classes([(r["doc_id"], r["text"]) for r in kept])
    kept = [r for r in kept if group[r["doc_id"]] == r["doc_id"]]
    copies = brute_mix(kept)
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(VOCABULARY), special_tokens={})
    want = sorted((r["doc_id"], coder.encode_ordinary(r["text"] or "")) for r in kept for _ in range(copies[r["doc_id"]]))
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r["doc_id"], r["ids"]) for r in got) == want
    assert all(r["exact"] and r["n_tokens"] == len(r["ids"]) for r in got)


def test_stages_on_clashing_columns(spark, tables):
    rows = [(k, f"some text of the document number {k} that stands here", "en", "s", 9) for k in range(8)]
    folder = tables(documents=rows, labels=[(k, k % 2, 0) for k in range(8)])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name in ("label", "toxic", "quality", "score", "class", "node", "row", "size", "ids", "exact", "bucket", "first", "by", "id", "k"):
        docs = docs.withColumn(name, F.lit("x"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        out.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert last.count() == 8 and "text" not in last.columns
    assert mixing.mixed_documents(docs).count() > 0
