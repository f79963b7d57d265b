"""Document fingerprints from Lempel-Ziv phrases.

A text is read from left to right and cut into phrases, each the shortest
piece not yet in its dictionary.  The distinct phrases are hashed and the
``SIGNATURE`` smallest hashes, ascending, are the fingerprint (base64 of
32-bit numbers).  Two fingerprints are compared by the share of the smallest
hashes of their union that both hold, which estimates the Jaccard likeness
of the phrase sets and follows how well one text compresses the other.

Null text is the empty text; the empty fingerprint is the empty string, and
two empty ones are wholly alike.  Equal texts have equal fingerprints.  Texts of any length
are read whole, as UTF-8 bytes.

:func:`chained` compares every document with its successor by id (ties: by
text; null ids first) and with an edited text made of both.  Ids are taken
for a key: the rows of one id are held by one task.  An empty table gives no
rows; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import quoted, text_or_empty

#: Hashes of a fingerprint.
SIGNATURE = 128


def parse(data: bytes, start: int, phrases: set[bytes], found: list[bytes]) -> int:
    """Cut ``data`` from ``start`` on into new phrases; returns where the unfinished last one begins.

    All beginnings of a phrase are phrases too, so the shortest unknown piece
    can be looked for from both sides; it is mostly as long as the one before it.
    """
    add, note, stop, guess = phrases.add, found.append, len(data), 2
    while start < stop:
        end = start + guess
        piece = data[start:end]
        if piece in phrases:
            end += 1
            piece = data[start:end]
            while piece in phrases:
                end += 1
                if end > stop:
                    return start
                piece = data[start:end]
        else:
            end -= 1
            shorter = data[start:end]
            while end > start and shorter not in phrases:
                end -= 1
                piece = shorter
                shorter = data[start:end]
            end += 1
        add(piece)
        note(piece)
        guess = len(piece)
        start += guess
    return start


def phrase_hashes(found: list[bytes]) -> np.ndarray:
    """One well-mixed 32-bit hash for each phrase."""
    x = np.fromiter(map(zlib.crc32, found), dtype=np.uint64, count=len(found))
    x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(32)).astype("<u4")


def smallest(hashes: np.ndarray) -> np.ndarray:
    """The smallest distinct hashes, ascending."""
    if len(hashes) > 4 * SIGNATURE:
        few = np.unique(np.partition(hashes, 2 * SIGNATURE)[:2 * SIGNATURE])
        if len(few) >= SIGNATURE:
            return few[:SIGNATURE]
    return np.unique(hashes)[:SIGNATURE]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the smallest hashes of the union that both have (0 to 1)."""
    if not len(a) and not len(b):
        return 1.0
    both = np.concatenate([a, b])
    both.sort()
    again = both[1:] == both[:-1]  # a hash that both have stands twice
    nth = np.arange(1, len(both)) - np.cumsum(again)  # distinct hashes up to each place, less the first
    return float((again & (nth < SIGNATURE)).sum() / min(SIGNATURE, len(both) - int(again.sum())))


def written(hashes: np.ndarray) -> str:
    return base64.b64encode(hashes.astype("<u4").tobytes()).decode()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), dtype="<u4")


def fingerprint(text: str) -> str:
    found: list[bytes] = []
    parse(text.encode(), 0, set(), found)
    return written(smallest(phrase_hashes(found)))


def fingerprint_column(text: str | Column) -> Column:
    """The fingerprint of a column of texts (string)."""

    @F.arrow_udf("string")
    def prints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([fingerprint(t) for t in texts.to_pylist()], pa.string())

    return prints(text_or_empty(text))


def likeness_column(a: str, b: str) -> Column:
    """Likeness of two fingerprint columns (double)."""

    @F.arrow_udf("double")
    def compare(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x, y in batches:
            yield pa.array([likeness(read(s), read(t)) for s, t in zip(x.to_pylist(), y.to_pylist(), strict=True)],
                           pa.float64())

    return compare(F.coalesce(quoted(a), F.lit("")), F.coalesce(quoted(b), F.lit("")))


class _Read:
    """A document read in two halves, so that its edited text can go on from the first."""

    def __init__(self, key: int | None, text: str):
        self.key, self.text, self.n = key, text, len(text)
        self.begin = text[:self.n - self.n // 2].encode()
        self.phrases: set[bytes] = set()
        found: list[bytes] = []
        self.open = parse(self.begin, 0, self.phrases, found)
        self.half = phrase_hashes(found)
        self.hashes = self._with(text[self.n - self.n // 2:].encode(), self.phrases.copy())

    def _with(self, rest: bytes, phrases: set[bytes]) -> np.ndarray:
        """Hashes of the text that goes on with ``rest`` behind the first half."""
        found: list[bytes] = []
        parse(self.begin[self.open:] + rest, 0, phrases, found)
        return smallest(np.concatenate([self.half, phrase_hashes(found)]))

    def edited(self, following: str) -> tuple[str, np.ndarray]:
        """The edited text and its hashes; uses up the first half's dictionary."""
        more = following[:self.n // 2]
        return self.text[:self.n - self.n // 2] + more, self._with(more.encode(), self.phrases)


OUTPUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                    ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
                    ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by span in order, and behind each span the row that follows it."""
    rows = chain.from_iterable(zip(*(b.column(c).to_pylist() for c in ("key", "ahead", "text")), strict=True)
                               for b in batches)
    last, out = None, []
    for key, ahead, text in rows:
        if ahead and last is None:
            continue
        now = _Read(key, text) if not ahead or last.text != text else last
        if last is not None:
            print_, next_print = last.hashes, now.hashes
            changed, hashes = last.edited(text)
            out.append((last.key, last.n, hashlib.sha256(changed.encode()).hexdigest(), written(print_),
                        written(hashes), likeness(print_, hashes), likeness(print_, next_print)))
        last = None if ahead else now
        if len(out) >= 1_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), OUTPUT.types)], schema=OUTPUT)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), OUTPUT.types)], schema=OUTPUT)


def chained(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's fingerprint, that of its edited text, and its likeness to both its neighbours.

    The edited text replaces the last ``floor(n / 2)`` code points by the
    first as many (or all) of the next document's; the last document is followed by the first.

    Texts are shuffled once, to spans of the id order; the first rows of a
    span go to the span before it too, so that each task sees every successor.
    """
    spark = docs.sparkSession
    order = F.coalesce(F.col("key"), F.lit(-(1 << 63)))
    rows = docs.select(quoted(key).cast("long").alias("key"), text_or_empty(text).alias("text")).withColumn("order", order)
    ids = docs.select(quoted(key).cast("long").alias("key")).withColumn("order", order)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = F.percentile_approx("order", [k / (2 * parts) for k in range(1, 2 * parts)], F.lit(20 * parts))
    bounds = sorted({float(b) for b in ids.agg(share.alias("b")).first()["b"] or [0]})
    spans = Bucketizer(splits=[-float("inf"), *bounds, float("inf")], inputCol="at", outputCol="span")

    def spanned(df: DataFrame) -> DataFrame:
        return spans.transform(df.withColumn("at", F.col("order").cast("double"))).drop("at").withColumn(
            "span", F.col("span").cast("int"))

    # as many rows as there are spans
    firsts = [(r["span"], r["first"]) for r in
              spanned(ids).groupBy("span").agg(F.min("order").alias("first")).orderBy("span").collect()]
    to = [(first, firsts[k - 1][0]) for k, (_, first) in enumerate(firsts)]
    copies = spark.createDataFrame(to, "first long, before int")
    places = F.array(F.struct(F.col("span").alias("span"), F.lit(0).alias("ahead")),
                     F.struct(F.col("before").alias("span"), F.lit(1).alias("ahead")))
    dealt = (spanned(rows).join(F.broadcast(copies), F.col("order") == F.col("first"), "left")
             .withColumn("place", F.explode(F.filter(places, lambda p: p["span"].isNotNull())))
             .select("key", "order", "text", "place.span", "place.ahead"))
    return (dealt.repartition(parts, "span").sortWithinPartitions("span", "ahead", "order", "text")
            .select("key", "ahead", "text")
            .mapInArrow(_chain, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                "edited_fingerprint string, near_edited double, near_next double"))
