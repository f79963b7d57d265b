"""Near duplicates, fingerprints and neighbours against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import lzprint, neighbours, ominhash
from quarry.llm.queries import QUERIES


def brute_classes(rows):
    """Classes of all pairs at the similarity, by comparing everything."""
    found = {i: ominhash.items(ominhash.words_of(t or "")) for i, t in rows}
    same = defaultdict(list)
    for i, t in rows:
        same[" ".join(ominhash.words_of(t or ""))].append(i)
    parent = {i: i for i, _ in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def link(a, b):
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)

    reps = [v[0] for v in same.values()]
    for v in same.values():
        for x in v[1:]:
            link(v[0], x)
    for k, a in enumerate(reps):
        for b in reps[:k]:
            small, large = sorted((len(found[a]), len(found[b])))
            if small and small >= ominhash.SIMILARITY * large and ominhash.alignment(found[a], found[b]) >= ominhash.SIMILARITY:
                link(a, b)
    return {i: top(i) for i, _ in rows}


def classes(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"]: r["class_id"] for r in ominhash.near_duplicates(docs).collect()}


def edited(words, rate, rng):
    return [f"new{rng.random()}" if rng.random() < rate else w for w in words]


def test_large_group_of_near_copies_and_a_shared_passage(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(9_000)}" for _ in range(150)]
    passage = [f"p{k}" for k in range(60)]
    rows = [(k, " ".join(edited(base, 0.02, rng))) for k in range(150)]
    rows += [(200 + k, " ".join(passage + [f"o{k}_{j}" for j in range(12)])) for k in range(40)]
    rows += [(300 + k, " ".join(f"x{rng.randrange(90_000)}" for _ in range(40))) for k in range(30)]
    rows += [(400, rows[0][1].upper()), (401, None), (402, ""), (403, "three words only"), (404, "three  words\nonly")]
    got = classes(spark, rows)
    assert got == brute_classes(rows)
    assert got[400] == got[0]
    assert got[402] == 401
    assert got[404] == 403


def test_given_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = {r["doc_id"]: r["class_id"] for r in QUERIES["op3_order_minhash"](spark, "/root/testdata/sf0.01").collect()}
    assert got == brute_classes(rows)


def test_alignment_follows_order():
    x = ominhash.items([f"w{k}" for k in range(100)])
    assert ominhash.alignment(x, x) == 1.0
    turned = ominhash.items([f"w{k}" for k in [*range(50, 100), *range(50)]])
    assert ominhash.alignment(x, turned) < 0.6
    assert ominhash.alignment(x, x[:90]) == 0.9375


def test_band_recall_at_the_threshold():
    rng = random.Random(2)
    missed = 0
    for _ in range(300):
        words = [f"w{rng.randrange(10**9)}" for _ in range(204)]
        other = list(words)
        for at in range(10, 200, 48):  # four edits of five items each and one more: 0.8 and a little
            other[at] = "changed"
        x, y = ominhash.items(words), ominhash.items(other)
        assert ominhash.alignment(x, y) >= 0.8
        missed += not (ominhash.band_keys(x) == ominhash.band_keys(y)).any()
    assert missed == 0


def test_keep_one_keeps_columns_and_null_ids(spark):
    docs = spark.createDataFrame([(3, "a b c", 1), (1, "a b c", 2), (None, "q r s", 3), (7, "z", 4), (7, "z", 4)],
                                 "doc_id long, text string, other int")
    assert sorted((r["other"] for r in ominhash.keep_one(docs).collect())) == [2, 3, 4]


def test_hot_class_beside_singletons_that_share_its_passage(spark):
    """One class of a third of the rows, 200 documents that are each alone, chains and classes close to the limit."""
    rng = random.Random(8)
    passage = [f"p{k}" for k in range(120)]
    rows = [(k, " ".join(edited(passage + [f"b{j}" for j in range(60)], 0.01, rng))) for k in range(130)]
    shared = [f"s{j}" for j in range(400)]  # their other items stand in several documents, so that they can match
    for k in range(200):
        at = rng.randrange(300)
        rows.append((1_000 + k, " ".join(passage + shared[at:at + 60])))
    chain = [f"c{j}" for j in range(200)]
    for k in range(40):  # each close to the next, the ends far apart
        rows.append((2_000 + k, " ".join(chain[:5 * k] + [f"z{j}" for j in range(5 * k, 200)])))
    rng.shuffle(rows)
    assert classes(spark, rows) == brute_classes(rows)


def test_distance_is_a_metric_within_its_bounds():
    rng = random.Random(4)
    words = [f"w{k}" for k in range(60)]
    texts = [ominhash.items(edited(rng.sample(words, 60) if k % 4 == 0 else words[k:] + words[:k], 0.1, rng)) for k in range(40)]
    for _ in range(2_000):
        x, y, z = rng.sample(texts, 3)
        (a, b), (c, d), (e, _) = ominhash.bounds(x, y), ominhash.bounds(y, z), ominhash.bounds(x, z)
        assert a <= b and c <= d
        assert 1 - e >= (1 - b) - (1 - c) - 1e-9  # most(x, z) >= least(x, y) - most(y, z)


def test_rows_that_share_only_the_id_are_documents_of_their_own(spark):
    docs = spark.createDataFrame([(1, "one text of seven words in all", 1), (1, "a wholly different other text stands here", 2),
                                  (2, "One text of seven  words in all", 3), (1, "one text of seven words in all", 1), (None, "lost", 4)],
                                 "doc_id long, text string, other int")
    kept = sorted(r["other"] for r in ominhash.keep_one(docs).collect())
    assert kept == [1, 2, 4]
    assert sorted((r["doc_id"] or 0, r["class_id"] or 0) for r in ominhash.near_duplicates(docs).collect()) == [
        (0, 0), (1, 1), (1, 1), (1, 1), (2, 1)]


def test_fingerprints_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = {r["doc_id"]: r for r in QUERIES["op4_lz_fingerprint"](spark, sf).collect()}
    assert len(got) == len(rows)
    for (i, a), (_, b) in zip(rows, rows[1:] + rows[:1]):
        n = len(a)
        changed = a[:n - n // 2] + b[:n // 2]
        own, nxt, ed = (lzprint.fingerprint(t) for t in (a, b, changed))
        r = got[i]
        assert (r["n_chars"], r["fingerprint"], r["edited_fingerprint"]) == (n, own, ed)
        assert r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["near_edited"] == lzprint.likeness(lzprint.read(own), lzprint.read(ed))
        assert r["near_next"] == lzprint.likeness(lzprint.read(own), lzprint.read(nxt))


def test_parse_is_the_plain_one():
    rng = random.Random(3)
    for n in (0, 1, 2, 7, 100, 2_000):
        data = bytes(rng.choice(b"ab c") for _ in range(n))
        known, plain, start = set(), [], 0
        for end in range(1, n + 1):
            if data[start:end] not in known:
                known.add(data[start:end])
                plain.append(data[start:end])
                start = end
        found = []
        assert lzprint.parse(data, 0, set(), found) == start
        assert found == plain


def test_fingerprint_columns(spark):
    docs = spark.createDataFrame([("abc abc abd", "abc abc abd"), (None, ""), ("xyz", "")], "a string, b string")
    prints = docs.select(lzprint.fingerprint_column("a").alias("a"), lzprint.fingerprint_column("b").alias("b"))
    assert [r[0] for r in prints.select(lzprint.likeness_column("a", "b")).collect()] == [1.0, 1.0, 0.0]


def test_recall_against_brute_force(spark):
    sf = "/root/testdata/sf0.1"
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in vectors], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.array([r["vec_id"] for r in vectors])
    found = defaultdict(list)
    for r in QUERIES["op5_neighbours"](spark, sf).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = total = 0
    for at in np.flatnonzero(ids % 50 == 0):
        scores = x @ x[at]
        scores[at] = -9
        best = ids[np.lexsort((ids, -scores))[:5]]
        mine = found[ids[at]]
        assert len(mine) == 5
        assert all(abs(s - scores[np.flatnonzero(ids == i)[0]]) < 1e-12 for i, s in mine)
        hits, total = hits + len(set(best) & {i for i, _ in mine}), total + 5
    assert hits / total >= 0.9


def test_many_equal_vectors(spark):
    rows = [(i, [1.0, 0.5, 0.25]) for i in range(300)] + [(1_000 + i, [float(i), 1.0, 2.0]) for i in range(20)]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("id") % 50 == 0)
    by = defaultdict(list)
    for r in got.orderBy("query_id", "rank").collect():
        by[r["query_id"]].append(r["vec_id"])
    assert by[0] == [1, 2, 3, 4, 5]
    assert by[250] == [0, 1, 2, 3, 4]
    assert set(by) == {0, 50, 100, 150, 200, 250, 1_000}


def test_parities_never_say_too_much():
    rng = random.Random(6)
    words = [f"w{k}" for k in range(400)]
    for _ in range(200):
        x, y = (ominhash.items(edited(words[:rng.randrange(1, 400)], rng.choice((0, 0.02, 0.2)), rng)) for _ in range(2))
        differ = int(np.bitwise_count((ominhash.parities(x) ^ ominhash.parities(y)).view(np.uint64)).sum())
        assert differ <= len(set(x.tolist()) ^ set(y.tolist()))
    assert not ominhash.parities(ominhash.items([])).any()


def test_copies_too_far_from_each_other_are_not_compared(spark, monkeypatch):
    """Copies of one text, pairwise under the limit: without their parities nearly all pairs were compared."""
    rng = random.Random(7)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(60):
        words = list(base)
        for at in rng.sample(range(0, 200, 8), 4):
            words[at] = f"new{k}_{at}"
        rows.append((k, " ".join(words)))
    asked, tested = [], ominhash._tested
    monkeypatch.setattr(ominhash, "_tested", lambda pairs, texts: asked.append(pairs.count()) or tested(pairs, texts))
    assert classes(spark, rows) == brute_classes(rows)
    assert sum(asked) <= 4 * len(rows)
