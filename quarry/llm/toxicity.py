"""Toxicity: a factorization machine over hashed terms.

A text's terms are its distinct lower-case words and the first four and five
characters of longer words, each hashed to one of 2**28 buckets.  The score
is the logistic of ``w0 + sum w_i + sum_{i<j} <v_i, v_j>`` over the buckets
of the text: the pairwise part lets a combination (an insult next to a
group mention) weigh more than its members' sum.  Terms count once however
long the text is, so the whole of a long text is read and does not dilute.

Fitting takes a bounded sample of the labelled rows (``FIT_ROWS`` of them,
by the order of a hash of their id), chooses the
``FIT_TERMS`` buckets that tell the labels apart best and trains in numpy on the driver.
Scoring runs over all rows in Arrow batches; the model that travels is
bounded by ``FIT_TERMS``.

Null and empty texts have no terms and get the base score.  Rows with null labels
or ids are not learnt from; without any labelled row every score is the base score 0.
Ties, repeated rows and extra columns are carried along as they are.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import quoted, text_or_empty, texts_of

BUCKETS = 1 << 28
#: Most labelled rows that a model is fitted on.
FIT_ROWS = 9_000
#: Buckets with weights, rows that must hold one, and the least chi-square that tells the labels apart.
FIT_TERMS, LEAST_ROWS, LEAST_CHI2 = 2_048, 4, 8.0
FACTORS, EPOCHS, BATCH, STEP, DECAY = 8, 25, 256, 0.05, 2e-4
#: Words whose buckets one worker remembers.
REMEMBERED = 120_000

_WORDS = re.compile(r"\w+").findall


def term_buckets(word: str) -> tuple[int, ...]:
    """Buckets of a word and of its beginnings (marked, so that they differ from short words)."""
    terms = [word, *(f"{word[:n]}~" for n in (4, 5) if len(word) >= n)]
    return tuple(zlib.crc32(t.encode()) % BUCKETS for t in terms)


def buckets_column(text: Column) -> Column:
    """Distinct buckets of a text, ascending (``array<int>``)."""

    @F.arrow_udf("array<int>")
    def buckets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([sorted({b for w in set(_WORDS(t.lower())) for b in term_buckets(w)})
                            for t in texts_of(texts)], pa.list_(pa.int32()))

    return buckets(text)


@dataclass
class Model:
    """``slots``: bucket -> row of ``linear`` and ``factors``."""

    slots: dict[int, int]
    base: float
    linear: np.ndarray
    factors: np.ndarray

    def score(self, rows: np.ndarray) -> float:
        """Probability of label 1 for a text with these slots."""
        if not len(self.slots) and self.base == -np.inf:
            return 0.0
        v = self.factors[rows]
        pairs = 0.5 * float((v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum())
        z = self.base + float(self.linear[rows].sum()) + pairs
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def _choose(rows: list[np.ndarray], y: np.ndarray) -> list[int]:
    """Buckets that tell the labels apart best, by chi-square (ties: smaller bucket)."""
    every, counts = np.unique(np.concatenate(rows), return_counts=True)
    inside, hits = np.unique(np.concatenate([r for r, label in zip(rows, y, strict=True) if label] or [every[:0]]),
                             return_counts=True)
    pos = np.zeros(len(every))
    pos[np.searchsorted(every, inside)] = hits
    n, p = len(rows), y.sum()
    expected = counts * p / n
    chi2 = (pos - expected) ** 2 * n * n / np.maximum(expected * (n - p) * (n - counts + 1e-9), 1e-9)
    fit = np.flatnonzero((counts >= LEAST_ROWS) & (chi2 >= LEAST_CHI2))
    best = fit[np.lexsort((every[fit], -chi2[fit]))][:FIT_TERMS]
    return sorted(every[best].tolist())


def train(rows: list[np.ndarray], labels: list[int], seed: int = 7) -> Model:
    """Logistic factorization machine by AdaGrad on the chosen buckets."""
    y = np.array(labels, dtype=np.float64)
    if not len(rows) or not y.any():
        return Model({}, -np.inf, np.zeros(0), np.zeros((0, FACTORS)))
    chosen = _choose(rows, y)
    slots = {b: k for k, b in enumerate(chosen)}
    x = np.zeros((len(rows), len(chosen)), dtype=np.float32)
    for i, r in enumerate(rows):
        x[i, [slots[b] for b in r.tolist() if b in slots]] = 1
    rng = np.random.default_rng(seed)
    base = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    w, v = np.zeros(len(chosen)), rng.normal(0, 0.05, (len(chosen), FACTORS))
    g0, gw, gv = 1e-6, np.full(w.shape, 1e-6), np.full(v.shape, 1e-6)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            part = order[at:at + BATCH]
            xb = x[part].astype(np.float64)
            sums = xb @ v
            z = base + xb @ w + 0.5 * (sums**2 - xb @ v**2).sum(axis=1)
            err = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y[part]) / len(part)
            d0 = err.sum()
            dw = xb.T @ err + DECAY * w
            dv = xb.T @ (err[:, None] * sums) - (xb.T @ err)[:, None] * v + DECAY * v
            g0, gw, gv = g0 + d0**2, gw + dw**2, gv + dv**2
            base -= STEP * d0 / np.sqrt(g0)
            w -= STEP * dw / np.sqrt(gw)
            v -= STEP * dv / np.sqrt(gv)
    return Model(slots, float(base), w, v)


def fit(labelled: DataFrame, text: str = "text", label: str = "label", key: str = "doc_id") -> Model:
    """Fit on at most :data:`FIT_ROWS` labelled rows (those first by a hash of their key)."""
    rows = (labelled.where(quoted(label).isNotNull() & quoted(key).isNotNull())
            .select(quoted(key).alias("k"), quoted(label).cast("int").alias("y"),
                    buckets_column(text_or_empty(text)).alias("b"))
            .orderBy(F.xxhash64("k"), "k").limit(FIT_ROWS).toArrow())
    lists = rows.column("b").combine_chunks()
    flat, ends = np.asarray(lists.flatten()), np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))])
    return train([flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], rows.column("y").to_pylist())


def score_column(text: str | Column, model: Model) -> Column:
    """Probability (double, 0 to 1) that the text has label 1."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, tuple[int, ...]] = {}
        slots = model.slots
        for texts in batches:
            out = []
            for t in texts_of(texts):
                found: set[int] = set()
                words = set(_WORDS(t.lower()))
                for w in words.difference(known):
                    known[w] = tuple(slots[b] for b in term_buckets(w) if b in slots)
                for hit in map(known.__getitem__, words):
                    if hit:
                        found.update(hit)
                out.append(model.score(np.array(sorted(found), dtype=np.int64)))
                if len(known) > REMEMBERED:
                    known.clear()
            yield pa.array(out, pa.float64())

    return score(text_or_empty(text))


def score_documents(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score column (an existing one of that name is replaced)."""
    return docs.withColumn(out, score_column(text, model))


def labelled_documents(docs: DataFrame, labels: DataFrame, label: str, learn: Column,
                       limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts and labels of at most ``limit`` rows that may be learnt from.

    The rows are chosen among the labels alone (first by a hash of the key),
    so the broadcast side has at most ``limit`` rows.
    """
    chosen = (labels.where(learn & quoted(key).isNotNull() & quoted(label).isNotNull())
              .groupBy(quoted(key).alias("__key")).agg(F.max(quoted(label)).cast("int").alias("label"))
              .orderBy(F.xxhash64("__key"), "__key").limit(limit))
    texts = docs.select(quoted(key).alias("doc_id"), quoted(text).alias("text"))
    return texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("__key")).select("doc_id", "text", "label")
