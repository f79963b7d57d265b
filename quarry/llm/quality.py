"""Quality: a sparse ensemble of rules over text statistics, compiled into Spark columns.

:func:`statistics_column` describes a whole text by ratios that do not grow
with its length.  Small trees, grown in numpy on bootstrap samples of a
bounded set of labelled rows, give conjunctive rules (every path from the
root); a logistic regression with an absolute-value penalty keeps few of
them; and the kept rules with their weights become one Spark expression.

Null and empty texts have all statistics 0.  Rows with null labels or keys
are not learnt from; without labelled rows, or with one label only, the
score is that label's share (0.5 without rows).  Ties, repeated rows and
extra columns are carried along as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import text_or_empty, texts_of

#: Most labelled rows that a model is fitted on.
FIT_ROWS = 9_000
TREES, DEPTH, BINS, LEAST_LEAF = 40, 3, 24, 20
PENALTY, ROUNDS = 0.002, 600
STATISTICS = ("upper_words", "mark_words", "bar_words", "repeated_next", "distinct_words", "word_length",
              "long_words", "short_words", "digits", "punctuation", "other_marks", "letters", "sentence_ends",
              "line_length", "distinct_lines", "top_word")
_MARKS = frozenset("#$%&*+<=>@^_`{|}~")


def statistics(text: str) -> tuple[float, ...]:
    """The values of :data:`STATISTICS` for one text."""
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return (0.0,) * len(STATISTICS)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    upper = marked = long = short = 0
    for w, k in counts.items():  # each distinct word once
        if w.isupper():
            upper += k
        if w[-1] in _MARKS:
            marked += k
        size = len(w)
        if size > 15:
            long += k
        elif size < 3:
            short += k
    lines = text.split("\n")
    digits = sum(map(text.count, "0123456789"))
    marks = sum(map(text.count, _MARKS))
    ends = text.count(".") + text.count("!") + text.count("?")
    soft = text.count(",") + text.count(";") + text.count(":")
    inside = sum(map(len, words))
    again = sum(map(str.__eq__, words, words[1:]))
    return (upper / n, marked / n, counts.get("|", 0) / n, again / n, len(counts) / n, inside / n, long / n, short / n,
            digits / chars, (ends + soft) / chars, marks / chars, (inside - digits - marks - ends - soft) / chars,
            ends / n, n / len(lines), len(set(lines)) / len(lines), max(counts.values()) / n)


def statistics_column(text: str | Column) -> Column:
    """One struct of doubles named as in :data:`STATISTICS`."""

    @F.arrow_udf("struct<" + ", ".join(f"{s}: double" for s in STATISTICS) + ">")
    def describe(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = np.array([statistics(t) for t in texts_of(texts)], dtype=np.float64).reshape(-1, len(STATISTICS))
            yield pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(len(STATISTICS))], list(STATISTICS))

    return describe(text_or_empty(text))


#: A condition is (statistic's place, above, threshold): value > threshold, or value <= threshold.
Rule = tuple[tuple[int, bool, float], ...]


@dataclass
class RuleModel:
    base: float
    rules: list[tuple[Rule, float]]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 (the same rules in numpy, for tests)."""
        z = np.full(len(x), self.base)
        for rule, weight in self.rules:
            z += weight * holds(rule, x)
        return 1 / (1 + np.exp(-z))

    def column(self, stats: str) -> Column:
        """The rules as one expression over the struct column ``stats``."""
        z = F.lit(float(self.base))
        for rule, weight in self.rules:
            met = F.lit(True)
            for k, above, cut in rule:
                value = F.col(f"{stats}.{STATISTICS[k]}")
                met = met & ((value > cut) if above else (value <= cut))
            z = z + F.when(met, float(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-z))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for k, above, cut in rule:
        out &= (x[:, k] > cut) if above else (x[:, k] <= cut)
    return out


def _grow(x: np.ndarray, y: np.ndarray, cuts: list[np.ndarray], rng, path: Rule, found: set[Rule]) -> None:
    """Split by the largest fall of the squared error; every path becomes a rule."""
    if path:
        found.add(tuple(sorted(path)))
    if len(path) >= DEPTH or len(y) < 2 * LEAST_LEAF or y.min() == y.max():
        return
    best, choice = 1e-9, None
    for k in rng.choice(x.shape[1], size=max(1, x.shape[1] // 2), replace=False):
        left = x[:, k][:, None] <= cuts[k][None, :]
        n_left, s_left = left.sum(axis=0), (left * y[:, None]).sum(axis=0)
        n_right, s_right = len(y) - n_left, y.sum() - s_left
        fit = (n_left >= LEAST_LEAF) & (n_right >= LEAST_LEAF)
        gain = np.where(fit, s_left**2 / np.maximum(n_left, 1) + s_right**2 / np.maximum(n_right, 1), 0) - y.sum()**2 / len(y)
        at = int(np.argmax(gain)) if len(gain) else 0
        if len(gain) and gain[at] > best:
            best, choice = gain[at], (int(k), float(cuts[k][at]))
    if choice is None:
        return
    k, cut = choice
    for above in (False, True):
        side = (x[:, k] > cut) == above
        _grow(x[side], y[side], cuts, rng, (*path, (k, above, cut)), found)


def train(x: np.ndarray, y: np.ndarray, seed: int = 11) -> RuleModel:
    """Rules from trees, then weights by proximal gradient steps with an L1 penalty."""
    y = np.asarray(y, dtype=np.float64)
    if len(y) == 0 or y.min() == y.max():
        share = 0.5 if not len(y) else min(max(float(y.mean()), 0.01), 0.99)
        return RuleModel(float(np.log(share / (1 - share))), [])
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0.01, 0.99, BINS))) for k in range(x.shape[1])]
    found: set[Rule] = set()
    for _ in range(TREES):
        rows = rng.integers(0, len(y), size=min(len(y), 4_000))
        _grow(x[rows], y[rows], cuts, rng, (), found)
    rules = sorted(found)
    r = np.stack([holds(rule, x) for rule in rules], axis=1).astype(np.float64) if rules else np.zeros((len(y), 0))
    spread = np.maximum(r.std(axis=0), 0.05)
    r = r / spread
    w, b = np.zeros(len(rules)), float(np.log(y.mean() / (1 - y.mean())))
    mean = r.mean(axis=0)
    centred = r - mean
    size = 4.0 / max(np.linalg.norm(centred.T @ centred / len(y), 2) if len(rules) else 1.0, 1.0)
    ahead, t = w.copy(), 1.0
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-(b + centred @ ahead)))
        step = ahead - size * (centred.T @ (p - y) / len(y))
        new = np.sign(step) * np.maximum(np.abs(step) - size * PENALTY, 0)
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t_next * (new - w)
        w, t = new, t_next
        b -= 2.0 * float((p - y).mean())
    b -= float(mean @ w)
    return RuleModel(float(b), [(rule, float(k / s)) for rule, k, s in zip(rules, w, spread, strict=True) if k != 0])


def fit(labelled: DataFrame, text: str = "text", label: str = "label") -> RuleModel:
    """Fit on at most :data:`FIT_ROWS` labelled rows (those first by a hash of their id)."""
    got = (labelled.where(F.col(label).isNotNull())
           .select("doc_id", F.col(label).cast("int").alias("__y"), statistics_column(text).alias("__s"))
           .orderBy(F.xxhash64("doc_id"), "doc_id", "__y", "__s").limit(FIT_ROWS)
           .select("doc_id", "__y", "__s.*").toPandas().sort_values("doc_id", kind="stable"))
    return train(got[list(STATISTICS)].to_numpy(np.float64), got["__y"].to_numpy())


def score_documents(docs: DataFrame, model: RuleModel, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score column (an existing one of that name is replaced)."""
    return (docs.withColumn("__statistics", statistics_column(text))
            .withColumn(out, model.column("__statistics")).drop("__statistics"))
