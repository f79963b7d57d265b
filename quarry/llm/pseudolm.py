"""Masked pseudo-likelihood: each token is predicted from the tokens on both sides.

The softmax has two levels.  The first is over word classes: the ``FREQUENT`` most
frequent words of the whole corpus, each its own class, and ``OTHERS`` hash classes for
all other words.  A small network (embeddings of the ``WINDOW`` tokens before and behind,
weighted by place, a tanh layer, a softmax) is trained in numpy: every task passes once
over all tokens of its rows from the same start, and Spark averages the parameters,
weighted by tokens.  The second level is over the words of a class: every word of the
corpus has its share of its class (the maximum likelihood without neighbours), looked up
by a shuffle join, so the vocabulary is as large as the corpus makes it.  The neighbours
thus tell classes apart, not the words within a hash class.  A document's score is the sum
of the logarithms of its tokens' conditional probabilities.

Null and empty texts have no tokens and the sum 0 (null mean).  Texts are read
whole.  Repeated rows score alike; without any text the network is its start.
Other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .tables import quoted, text_or_empty, texts_of, written

FREQUENT, OTHERS, WINDOW, WIDTH = 192, 64, 2, 16
CLASSES = FREQUENT + OTHERS
BATCH, STEP = 512, 0.1
REMEMBERED, BLOCK = 300_000, 2_000_000
_SHAPES = {"embed": (CLASSES + 1, WIDTH), "place": (2 * WINDOW, WIDTH), "bias": (WIDTH,), "out": (CLASSES, WIDTH),
           "prior": (CLASSES,)}
_OFFSETS = [k for k in range(-WINDOW, WINDOW + 1) if k]
SAFE = 40.0
_ONES = np.ones(CLASSES, np.float32)
_CELLS = np.arange(WIDTH)


def vocabulary(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every word of the corpus and its count (``word, n``), as a table."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())],
                                              ["word", "n"])

        seen: Counter[str] = Counter()
        for batch in batches:
            for t in texts_of(batch.column(0)):
                seen.update(t.lower().split())
                if len(seen) > REMEMBERED:
                    yield counted()
                    seen.clear()
        if seen:
            yield counted()

    words = docs.select(text_or_empty(text).alias("text")).mapInArrow(count, "word string, n long")
    return written(words.groupBy("word").agg(F.sum("n").alias("n")))


def frequent_words(docs: DataFrame, text: str = "text", words: DataFrame | None = None) -> list[tuple[str, int]]:
    """The most frequent words of the corpus and their counts (ties: by word)."""
    words = vocabulary(docs, text) if words is None else words
    return [(r["word"], r["n"]) for r in words.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()]


class _Known(dict):
    """Class of a word; one that is missing gets its hash class."""

    def __missing__(self, word: str) -> int:
        self[word] = found = FREQUENT + zlib.crc32(word.encode()) % OTHERS
        return found


def classifier(frequent: list[str]) -> Callable[[list[str]], np.ndarray]:
    """Words -> class of every word."""
    fixed = {w: k for k, w in enumerate(frequent)}
    known = _Known(fixed)

    def classes(words: list[str]) -> np.ndarray:
        if len(known) > REMEMBERED:
            known.clear()
            known.update(fixed)
        return np.fromiter(map(known.__getitem__, words), dtype=np.int32, count=len(words))

    return classes


def stream(texts: list[np.ndarray]) -> np.ndarray:
    """Texts one after the other; before, between and behind them ``WINDOW`` times the class ``CLASSES``."""
    gap = np.full(WINDOW, CLASSES, np.int32)
    return np.concatenate([gap, *(x for tokens in texts for x in (tokens, gap))])


def start(seed: int = 9) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    net = {name: rng.normal(0, 0.1, shape).astype(np.float32) for name, shape in _SHAPES.items()}
    net["place"] += 1
    net["prior"][:] = 0
    return net


def with_prior(net: dict[str, np.ndarray]) -> np.ndarray:
    """``out`` and ``prior`` as one matrix, whose last column meets the constant 1 of :func:`hidden_layer`."""
    return np.column_stack([net["out"], net["prior"]])


def hidden_layer(net: dict[str, np.ndarray], vectors: np.ndarray) -> np.ndarray:
    """(places, ``WIDTH`` + 1): the tanh layer, and 1 in the last column, of all but ``WINDOW`` places at both ends."""
    n = len(vectors) - 2 * WINDOW
    total = vectors[:n] * net["place"][0]
    for k, at in enumerate(_OFFSETS[1:], 1):
        total += vectors[WINDOW + at:WINDOW + at + n] * net["place"][k]
    total += net["bias"]
    hidden = np.ones((n, WIDTH + 1), np.float32)
    np.tanh(total, out=hidden[:, :WIDTH])
    return hidden


def largest_logit(outer: np.ndarray) -> float:
    """No logit is farther from 0, as every unit of the hidden layer is within 1."""
    return float(np.abs(outer).sum(axis=1).max())


def logits(hidden: np.ndarray, outer: np.ndarray, largest: float) -> np.ndarray:
    """Logits of the classes, less their greatest where their exponentials could leave the range of floats."""
    z = hidden @ outer.T
    if not largest <= SAFE:
        z -= z.max(axis=1, keepdims=True)
    return z


def learn(net: dict[str, np.ndarray], seen: dict[str, np.ndarray], classes: np.ndarray) -> None:
    """One AdaGrad step on the tokens of a piece of a :func:`stream`, whose ``WINDOW`` places at both ends are neighbours only."""
    vectors, token = net["embed"].take(classes, axis=0), classes[WINDOW:-WINDOW]
    n, outer = len(token), with_prior(net)
    said = np.flatnonzero(token != CLASSES)
    hidden, token = hidden_layer(net, vectors)[said], token[said]
    err = logits(hidden, outer, largest_logit(outer))
    np.exp(err, out=err)
    total = err @ _ONES
    err[np.arange(len(token)), token] -= total
    share = (1 / (total * len(token)))[:, None]  # err times share is the slope of the logits
    back = np.zeros((n, WIDTH), np.float32)
    back[said] = (err @ net["out"]) * share * (1 - hidden[:, :WIDTH]**2)
    place, near = np.empty_like(net["place"]), np.zeros_like(vectors)
    for k, at in enumerate(_OFFSETS):
        there = slice(WINDOW + at, WINDOW + at + n)
        place[k] = np.einsum("ij,ij->j", back, vectors[there])
        near[there] += back * net["place"][k]
    embed = np.bincount((classes[:, None] * WIDTH + _CELLS).ravel(), near.ravel(), net["embed"].size)
    above = err.T @ (hidden * share)
    slopes = {"embed": embed.astype(np.float32).reshape(net["embed"].shape), "place": place, "bias": back.sum(axis=0),
              "out": above[:, :WIDTH], "prior": above[:, WIDTH]}
    for name, slope in slopes.items():
        seen[name] += slope**2
        net[name] -= STEP * slope / np.sqrt(seen[name])


def fit(docs: DataFrame, frequent: list[str], text: str = "text") -> dict[str, np.ndarray]:
    """Train on all rows, task by task, and average."""
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, net = classifier(frequent), start()
        seen = {name: np.full(shape, 1e-6, np.float32) for name, shape in _SHAPES.items()}
        waiting, held, total = [], 0, 0

        def step() -> None:
            held = stream(waiting)
            said = np.flatnonzero(held != CLASSES)
            for at in range(0, len(said), BATCH):
                these = said[at:at + BATCH]
                learn(net, seen, held[these[0] - WINDOW:these[-1] + WINDOW + 1])
            waiting.clear()

        for batch in batches:
            for t in texts_of(batch.column(0)):
                tokens = classes(t.lower().split())
                if len(tokens):
                    waiting.append(tokens)
                    held, total = held + len(tokens), total + len(tokens)
                if held >= 8 * BATCH:
                    step()
                    held = 0
        if waiting:
            step()
        if total:
            values = np.concatenate([net[name].ravel() for name in _SHAPES]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([float(total)]), pa.array([values], pa.list_(pa.float64()))],
                                             ["weight", "values"])

    parts = docs.select(text_or_empty(text).alias("text")).mapInArrow(train, "weight double, values array<double>")
    means = (parts.select("weight", F.posexplode("values").alias("at", "value")).groupBy("at")
             .agg((F.sum(F.col("weight") * F.col("value")) / F.sum("weight")).alias("value")).collect())
    net = start()
    if means:  # as many rows as the network has parameters
        flat = np.zeros(sum(int(np.prod(s)) for s in _SHAPES.values()), np.float32)
        for r in means:
            flat[r["at"]] = r["value"]
        at = 0
        for name, shape in _SHAPES.items():
            size = int(np.prod(shape))
            net[name] = flat[at:at + size].reshape(shape)
            at += size
    return net


def scorer(net: dict[str, np.ndarray]) -> Callable[[np.ndarray], float]:
    """Classes of a text -> sum of the logarithms of their conditional probabilities."""
    outer = with_prior(net)
    largest = largest_logit(outer)

    def score(tokens: np.ndarray) -> float:
        total, vectors = 0.0, net["embed"].take(stream([tokens]), axis=0)
        for at in range(0, len(tokens), BATCH):
            z = logits(hidden_layer(net, vectors[at:at + BATCH + 2 * WINDOW]), outer, largest)
            own = z[np.arange(len(z)), tokens[at:at + BATCH]]
            np.exp(z, out=z)
            total += float((own - np.log(z @ _ONES)).sum(dtype=np.float64))
        return total

    return score


def log_likelihood(net: dict[str, np.ndarray], tokens: np.ndarray) -> float:
    return scorer(net)(tokens)


class _Numbered(dict):
    """Number of a word: of a frequent one its class, else its place in the dictionary times ``CLASSES``, plus its class."""

    def __missing__(self, word: str) -> int:
        self[word] = found = len(self) * CLASSES + FREQUENT + zlib.crc32(word.encode()) % OTHERS
        return found


def said_words(known: dict[str, int], rows: list[int], numbers: list[np.ndarray]) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Every word outside the frequent ones once, the first row, and the word's rows less that one (as often as they say it)."""
    said, at = np.concatenate(numbers).astype(np.int64), np.repeat(np.arange(len(rows)), list(map(len, numbers)))
    other = said % CLASSES >= FREQUENT
    cells = said[other] // CLASSES * len(rows) + at[other]
    cells.sort()
    place = cells // len(rows)
    starts = np.flatnonzero(np.diff(place, prepend=-1))
    words = list(known)
    offsets = (np.array(rows, np.int64) - rows[0]).astype(np.int32)[cells - place * len(rows)]
    return (pa.array([words[k] for k in place[starts]], pa.string()), pa.array(np.full(len(starts), rows[0], np.int64)),
            pa.ListArray.from_arrays(pa.array(np.append(starts, len(cells)), pa.int32()), pa.array(offsets)))


def within_classes(said: DataFrame, frequent: list[str], vocabulary: DataFrame) -> DataFrame:
    """``row, within``: logarithms of the shares of the rows' words in their classes, summed.

    ``said`` has a ``word``, and its rows as ``offsets`` from ``first``, a row as often as it
    says the word.  A class of ``N`` tokens gives a word of count ``n`` the share
    ``n / (N + 1)``, and ``1 / (N + 1)`` to all words that the vocabulary does not have.
    """
    group = (F.crc32(F.col("word").cast("binary")) % OTHERS).cast("int")
    others = vocabulary.where(~F.col("word").isin(frequent))
    sizes = {r["k"]: r["n"] for r in others.groupBy(group.alias("k")).agg(F.sum("n").alias("n")).collect()}
    all_of = F.element_at(F.array(*[F.lit(float(np.log(sizes.get(k, 0) + 1))) for k in range(OTHERS)]), group + 1)
    share = F.coalesce(F.log(F.col("n").cast("double")), F.lit(0.0)) - all_of
    each = said.join(others, "word", "left").select("first", share.alias("share"), F.explode("offsets").alias("offset"))
    return each.groupBy((F.col("first") + F.col("offset")).alias("row")).agg(F.sum("share").alias("within"))


def score_documents(docs: DataFrame, frequent: list[str], net: dict[str, np.ndarray], key: str = "doc_id",
                    text: str = "text", vocabulary: DataFrame | None = None) -> DataFrame:
    """``doc_id, n_tokens, log_likelihood, mean_log_likelihood``; without a vocabulary, of the classes alone."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def record(size: int, **columns: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(size, f.type) for f in made], schema=made)

        def words() -> Iterator[pa.RecordBatch]:
            if vocabulary_given and rows:
                word, first, offsets = said_words(known, rows, numbers)
                yield record(len(word), word=word, first=first, offsets=offsets)
            known.clear()
            known.update(fixed)
            rows.clear()
            numbers.clear()

        likelihood, fixed = scorer(net), {w: k for k, w in enumerate(frequent)}
        known, rows, numbers, held, made = _Numbered(fixed), [], [], 0, None
        for batch in batches:
            made = made or pa.schema([("row", pa.int64()), ("doc_id", batch.schema.field(1).type), ("n", pa.int64()),
                                      ("total", pa.float64()), ("word", pa.string()), ("first", pa.int64()),
                                      ("offsets", pa.list_(pa.int32()))])
            n, total = [], []
            for row, t in zip(batch.column(0).to_pylist(), texts_of(batch.column(2)), strict=True):
                said = t.lower().split()
                number = np.fromiter(map(known.__getitem__, said), dtype=np.int32, count=len(said))
                n.append(len(said))
                total.append(likelihood(number % CLASSES))
                rows.append(row)
                numbers.append(number)
                held += len(said)
                if held > BLOCK or len(known) > REMEMBERED:
                    yield from words()
                    held = 0
            yield record(len(n), row=batch.column(0), doc_id=batch.column(1), n=pa.array(n, pa.int64()),
                         total=pa.array(total, pa.float64()))
        yield from words()

    vocabulary_given = vocabulary is not None
    texts = docs.select(F.monotonically_increasing_id().alias("row"), quoted(key).alias("doc_id"),
                        text_or_empty(text).alias("text"))
    made = StructType([StructField("row", LongType()), StructField("doc_id", texts.schema["doc_id"].dataType),
                       *StructType.fromDDL("n long, total double, word string, first long, offsets array<int>")])
    scored = texts.mapInArrow(score, made)
    total = F.col("total")
    if vocabulary is None:
        rows = scored
    else:
        kept = written(scored)
        said = kept.where(F.col("word").isNotNull()).select("word", "first", "offsets")
        rows = (kept.where(F.col("n").isNotNull()).select("row", "doc_id", "n", "total")
                .join(within_classes(said, frequent, vocabulary), "row", "left"))
        total = total + F.coalesce("within", F.lit(0.0))
    return rows.select("doc_id", F.col("n").alias("n_tokens"), total.alias("log_likelihood"),
                       F.try_divide(total, F.col("n")).alias("mean_log_likelihood"))
