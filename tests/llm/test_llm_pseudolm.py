"""The network against its own formula, and real documents against shuffled ones."""

import random
import zlib

import numpy as np

from quarry.llm import pseudolm
from quarry.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_sum_of_conditional_log_probabilities():
    net = pseudolm.start()
    tokens = np.array([3, 5, 3, 60, 7], dtype=np.int32)
    total = 0.0
    for i in range(5):
        near = [tokens[i + k] if 0 <= i + k < 5 else pseudolm.CLASSES for k in (-2, -1, 1, 2)]
        h = np.tanh(sum(net["embed"][c] * net["place"][k] for k, c in enumerate(near)) + net["bias"])
        z = net["out"] @ h + net["prior"]
        total += z[tokens[i]] - np.log(np.exp(z).sum())
    assert abs(total - pseudolm.log_likelihood(net, tokens)) < 1e-4
    assert pseudolm.log_likelihood(net, tokens[:0]) == 0.0


def test_training_raises_the_likelihood_and_sees_order(spark):
    docs = spark.createDataFrame([(i, "a b c d e f " * 3000) for i in range(6)], "doc_id long, text string")
    words = [w for w, _ in pseudolm.frequent_words(docs)]
    net = pseudolm.fit(docs, words)
    mixed = "a b c d e f ".split() * 200
    random.Random(1).shuffle(mixed)
    test = spark.createDataFrame([(0, "a b c d e f " * 50), (1, " ".join(mixed[:300])), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pseudolm.score_documents(test, words, net).collect()}
    assert got[0]["mean_log_likelihood"] > got[1]["mean_log_likelihood"] + 0.3
    assert (got[2]["n_tokens"], got[2]["log_likelihood"], got[2]["mean_log_likelihood"]) == (0, 0.0, None)


def test_query_scores_every_document(spark):
    rows = QUERIES["op6_pseudo_likelihood"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r["log_likelihood"] < 0 for r in rows if r["n_tokens"])


def test_words_of_a_hash_class_are_told_apart(spark):
    def group(w):
        return zlib.crc32(w.encode()) % pseudolm.OTHERS

    common = " ".join(f"common{i}" for i in range(pseudolm.FREQUENT))
    known = "known"
    invented = next(w for w in map("invented{}".format, range(9_999)) if group(w) == group(known))
    rows = [(i, f"{common} {known}") for i in range(40)] + [(40, f"{common} {invented} \u00c9t\u00e9")] + [(41, common)] * 10
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    words = pseudolm.vocabulary(docs)
    frequent = [w for w, _ in pseudolm.frequent_words(docs, words=words)]
    assert known not in frequent and words.count() == pseudolm.FREQUENT + 3
    net = pseudolm.fit(docs, frequent)
    test = spark.createDataFrame([(0, f"{common} {known}"), (1, f"{common} {invented}"), (2, f"{common} {known} {known}"),
                                  (3, common), (4, None), (None, "nowhere")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pseudolm.score_documents(test, frequent, net, vocabulary=words).collect()}
    plain = {r["doc_id"]: r for r in pseudolm.score_documents(test, frequent, net).collect()}
    total = 41 + (group("\u00e9t\u00e9") == group(known))
    share = np.log(40 / (total + 1))
    within = {k: got[k]["log_likelihood"] - plain[k]["log_likelihood"] for k in got}
    assert abs(got[0]["log_likelihood"] - got[1]["log_likelihood"] - np.log(40)) < 1e-4
    assert abs(within[0] - share) < 1e-6 and abs(within[2] - 2 * share) < 1e-6
    assert within[3] == within[4] == 0 and within[None] <= 0 and len(got) == 6


def test_at_least_the_earlier_sizes():
    assert pseudolm.FREQUENT >= 192 and pseudolm.OTHERS >= 64 and pseudolm.WIDTH >= 16


def test_a_step_on_a_stream_is_the_step_by_its_formula():
    rng, w = np.random.default_rng(2), pseudolm.WINDOW
    texts = [rng.integers(0, pseudolm.CLASSES, n).astype(np.int32) for n in (7, 1, 30)]
    net, plain = pseudolm.start(), {k: v.astype(np.float64) for k, v in pseudolm.start().items()}
    seen = {k: np.full(v.shape, 1e-6, np.float32) for k, v in net.items()}
    pseudolm.learn(net, seen, pseudolm.stream(texts))
    slopes, total = {k: np.zeros(v.shape) for k, v in plain.items()}, sum(map(len, texts))
    for tokens in texts:
        for i, token in enumerate(tokens):
            near = [tokens[i + k] if 0 <= i + k < len(tokens) else pseudolm.CLASSES for k in (-2, -1, 1, 2)]
            h = np.tanh(sum(plain["embed"][c] * plain["place"][k] for k, c in enumerate(near)) + plain["bias"])
            err = np.exp(plain["out"] @ h + plain["prior"])
            err /= err.sum()
            err[token] -= 1
            err /= total
            back = (err @ plain["out"]) * (1 - h**2)
            for k, c in enumerate(near):
                slopes["embed"][c] += back * plain["place"][k]
                slopes["place"][k] += back * plain["embed"][c]
            for name, slope in (("bias", back), ("out", np.outer(err, h)), ("prior", err)):
                slopes[name] += slope
    for name, slope in slopes.items():
        step = pseudolm.STEP * slope / np.sqrt(1e-6 + slope**2)
        assert np.abs(net[name] - (plain[name] - step)).max() < 1e-5, name
    assert list(pseudolm.stream(texts[1:2])) == [pseudolm.CLASSES] * w + list(texts[1]) + [pseudolm.CLASSES] * w


def test_logits_beyond_the_range_of_exponentials():
    net = pseudolm.start()
    net["prior"][:2] = 2_000, -2_000
    got = pseudolm.log_likelihood(net, np.array([0, 1], dtype=np.int32))
    assert abs(got + 4_000) < 10
    seen = {k: np.full(v.shape, 1e-6, np.float32) for k, v in net.items()}
    pseudolm.learn(net, seen, pseudolm.stream([np.array([0, 1], dtype=np.int32)]))
    assert all(np.isfinite(v).all() for v in net.values())


def test_a_block_names_every_word_once():
    known = pseudolm._Numbered({"the": 0})
    texts = ["the cat cat", "", "the", "dog the cat"]
    numbers = [np.array([known[w] for w in t.split()], np.int32) for t in texts]
    words, first, offsets = (x.to_pylist() for x in pseudolm.said_words(known, [5, 6, 8, 9], numbers))
    assert first == [5, 5]
    assert dict(zip(words, offsets, strict=True)) == {"cat": [0, 0, 4], "dog": [4]}
    assert len(pseudolm.said_words(known, [5], numbers[2:3])[0]) == 0


def test_blocks_of_any_size_give_the_same_scores(spark, monkeypatch):
    rows = [(i, " ".join(f"w{j % (7 + i)} all" for j in range(40 * i))) for i in range(12)] + [(None, None), (3, "w1"), (3, "w1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    words = pseudolm.vocabulary(docs)
    frequent = [w for w, _ in pseudolm.frequent_words(docs, words=words)][:3]
    net = pseudolm.fit(docs, frequent)

    def scores():
        got = pseudolm.score_documents(docs, frequent, net, vocabulary=words).collect()
        return sorted((r["doc_id"] or -1, r["n_tokens"], round(r["log_likelihood"], 6)) for r in got)

    whole = scores()
    monkeypatch.setattr(pseudolm, "BLOCK", 50)
    assert scores() == whole and len(whole) == len(rows)
    monkeypatch.setattr(pseudolm, "REMEMBERED", 1)
    assert scores() == whole
