"""Near-duplicate documents by order MinHash, candidates verified by banded alignment.

A document's items are its runs of ``K`` lower-case words (all its words, if
fewer), each labelled with how often it occurred before.  One order-MinHash value takes
the ``L`` smallest items under a hash order and keeps them in text order,
so that it agrees for two documents with a chance that follows their edit
similarity.  ``ROWS`` values make a band key; documents that share a key are candidates.

Two documents are linked when their items, aligned in order within a band
around the diagonal, match for ``SIMILARITY`` or more: matches over the
union.  That is the Jaccard similarity of the items unless text was moved
about, and then less.  The band is as wide as such a similarity can need.

Equal word sequences are one node from the start.  Within a bucket no pairs are
listed: members are compared with a leader, and after that only with further
leaders (4, 64, 1024, ... by rank) of buckets that still hold documents of
different classes, until every bucket is of one class or every member was a
leader (:func:`_settled`).  A pair is passed over if too many items of either occur in no other
document still looked at, if the parities of their items differ in too many cells (:func:`parities`), or if their distances to
a third document keep them apart; none of these passes over a link.  The classes are thus those of all pairs that share a
band key; a pair at similarity 0.8 shares none with a chance under 1 in 10,000.

Tables made once are checkpoints; those of the rounds are written tables, whose
sizes the planner knows.

Null text is empty; empty texts are copies of each other.  Texts are read whole.
Rows that share id and text are one document; rows that share only the id are
documents of their own.  Rows with a null id whose text has no id elsewhere get a null class.
The class id is the least document id of the class.  Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .tables import broadcast_if_small, quoted, text_or_empty, texts_of, written

#: Words of an item, least similarity of a link.
K, SIMILARITY = 5, 0.8
#: Items of one value, values of a band key, band keys.
L, ROWS, BANDS = 2, 3, 36
#: Leaders of a bucket after the first, and times as many in each further round.
FIRST_LEADERS, MORE_LEADERS = 4, 16
#: Documents whose distances one document remembers.
PIVOTS = 8
#: Cells of a document's parities, in words of 64.
CELL_WORDS = 32
#: Words whose hash one worker remembers.
REMEMBERED = 120_000
#: Elements of the hash matrix that are made at once.
_CELLS = 1 << 20

_MIX, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.random.default_rng(20).integers(0, 1 << 32, (2, ROWS * BANDS), dtype=np.uint32)


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORD_HASHES = _WordHashes()


def forget_words() -> None:
    """Give this worker's word hashes back."""
    _WORD_HASHES.clear()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def items(words: list[str]) -> np.ndarray:
    """Hashes of the occurrence-labelled runs of words, in text order (all different)."""
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(_WORD_HASHES.__getitem__, words), dtype=np.uint64, count=n)
    width = min(K, n)
    runs = np.zeros(n - width + 1, dtype=np.uint64)
    for j in range(width):
        runs = _mixed(runs * _STEP + h[j:n - width + 1 + j])
    order = np.argsort(runs, kind="stable")
    sorted_runs = runs[order]
    fresh = np.concatenate([[True], sorted_runs[1:] != sorted_runs[:-1]])
    if not fresh.all():
        at = np.arange(len(runs))
        before = at - np.maximum.accumulate(np.where(fresh, at, 0))
        label = np.empty(len(runs), dtype=np.uint64)
        label[order] = before.astype(np.uint64)
        runs = _mixed(runs + label * _STEP)
    return runs


def band_keys(found: np.ndarray) -> np.ndarray:
    """The band keys (int64) of a document's items; none for a document without words."""
    n = len(found)
    if not n:
        return np.zeros(0, dtype=np.int64)
    short = (found >> np.uint64(32)).astype(np.uint32)
    values = np.empty(ROWS * BANDS, dtype=np.uint64)
    step = max(1, _CELLS // n)
    for at in range(0, len(values), step):
        flips, odds = _SEEDS[0, at:at + step], _SEEDS[1, at:at + step] | np.uint32(1)
        ranks = (short[None, :] ^ flips[:, None]) * odds[:, None]
        rows = np.arange(len(ranks))
        places = np.empty((L, len(ranks)), dtype=np.int64)
        for k in range(L):  # the L smallest, or fewer
            places[k] = ranks.argmin(axis=1) if k < n else places[k - 1]
            ranks[rows, places[k]] = np.uint32(0xFFFFFFFF)
        places.sort(axis=0)  # back in text order
        value = np.zeros(len(ranks), dtype=np.uint64)
        for k in range(L):
            value = _mixed(value * _STEP + found[places[k]])
        values[at:at + step] = value
    keys = np.zeros(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        keys = _mixed(keys * _STEP + values[r::ROWS])
    return keys.view(np.int64)


def parities(found: np.ndarray) -> np.ndarray:
    """Whether each cell holds an odd number of the items, as bits (int64).

    Two documents differ in at least as many items as cells: common items fall into the same cell of both.
    """
    cells = np.bincount((found % np.uint64(64 * CELL_WORDS)).astype(np.int64), minlength=64 * CELL_WORDS)
    return np.packbits((cells & 1).astype(np.uint8)).view(np.int64)


def alignment(x: np.ndarray, y: np.ndarray, least: float = SIMILARITY) -> float:
    """Matches of the best in-order alignment within the band, over the union; too small, maybe, under ``least``."""
    return bounds(x, y, least)[0]


def bounds(x: np.ndarray, y: np.ndarray, least: float = SIMILARITY) -> tuple[float, float]:
    """Matches of the best in-order alignment within the band over the union, and of all equal items over theirs.

    The items of a document are all different, so the best alignment is the
    longest increasing run of places.  The second number is never below the similarity, the
    first never above; it is 0 where the second is below ``least``, and exact where it reaches ``least``.
    """
    if not len(x) or not len(y):
        return (float(len(x) == len(y)),) * 2
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = len(x) + len(y)
    overlap = len(i) / (both - len(i))
    if len(i) < least * (both - len(i)):
        return 0.0, overlap
    j = j[np.argsort(i, kind="stable")]
    i = np.sort(i)
    j = j[np.abs(i - j) <= both * (1 - least) / (1 + least) + 1]
    if (j[1:] > j[:-1]).all():
        matched = len(j)
    else:
        tails: list[int] = []
        for place in j.tolist():
            at = bisect_left(tails, place)
            if at == len(tails):
                tails.append(place)
            else:
                tails[at] = place
        matched = len(tails)
    return matched / (both - matched), overlap


def words_of(text: str) -> list[str]:
    return text.lower().split()


def sketch_column(text: str | Column) -> Column:
    """``digest`` (of the word sequence), ``n`` (items), ``bands`` (keys)."""

    @F.arrow_udf("struct<digest: binary, n: int, bands: array<long>>")
    def sketch(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            digests, sizes, bands = [], [], []
            for t in texts_of(texts):
                words = words_of(t)
                found = items(words)
                digests.append(hashlib.md5(" ".join(words).encode()).digest())
                sizes.append(len(found))
                bands.append(band_keys(found))
            yield pa.StructArray.from_arrays([pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()),
                                              pa.array(bands, pa.list_(pa.int64()))], ["digest", "n", "bands"])
        forget_words()

    return sketch(text_or_empty(text))


def items_column(text: str | Column) -> Column:
    """The items of a text (``array<long>``)."""

    @F.arrow_udf("array<long>")
    def listed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([items(words_of(t)).view(np.int64) for t in texts_of(texts)], pa.list_(pa.int64()))

    return listed(text_or_empty(text))


def parities_column(text: str | Column) -> Column:
    """:func:`parities` of the items of a text (``array<long>``)."""

    @F.arrow_udf("array<long>")
    def listed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([parities(items(words_of(t))) for t in texts_of(texts)], pa.list_(pa.int64()))

    return listed(text_or_empty(text))


def similarity_column(a: Column, b: Column) -> Column:
    """:func:`bounds` of the similarity of two texts: ``aligned``, ``overlap``."""

    @F.arrow_udf("struct<aligned: double, overlap: double>")
    def similarity(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            found = [bounds(items(words_of(x)), items(words_of(y))) for x, y in zip(texts_of(left), texts_of(right), strict=True)]
            yield pa.StructArray.from_arrays([pa.array([f[k] for f in found], pa.float64()) for k in range(2)],
                                             ["aligned", "overlap"])
        forget_words()

    return similarity(a, b)


def classes_of(links: DataFrame) -> DataFrame:
    """Connected components of links ``a, b``: ``node, class`` (its least node), for linked nodes.

    Each round takes the least class of the neighbours and then the class of
    that class, until nothing changes.
    """
    edges = written(links.select(F.col("a").alias("node"), F.col("b").alias("to"))
                    .unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("to"))).distinct())
    now = written(edges.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("class")))
    while True:
        near = (edges.join(now.select(F.col("node").alias("to"), F.col("class").alias("of")), "to")
                .groupBy("node").agg(F.min("of").alias("of")))
        least = now.join(near, "node").select("node", "class", F.least("class", "of").alias("low"))
        jump = now.select(F.col("node").alias("low"), F.col("class").alias("top"))
        moved = written(least.join(jump, "low").select("node", F.col("class").alias("old"),
                                                       F.least("low", "top").alias("class")))
        now = moved.select("node", "class")
        if moved.where(F.col("old") != F.col("class")).isEmpty():
            return now


def _tested(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs`` (nodes ``a, b``) with ``linked`` and bounds of their distance: ``least``, ``most``."""
    n = pairs.count()
    if not n:
        return pairs.select("a", "b", F.lit(False).alias("linked"), F.lit(1.0).alias("least"), F.lit(1.0).alias("most"))
    asked = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "node")
    texts = texts.join(broadcast_if_small(asked, 2 * n), "node", "left_semi")
    joined = (pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("left")), "a")
              .join(texts.select(F.col("node").alias("b"), F.col("text").alias("right")), "b"))
    return written(joined.select("a", "b", similarity_column(F.col("left"), F.col("right")).alias("s")).select(
        "a", "b", (F.col("s.aligned") >= SIMILARITY).alias("linked"), (1 - F.col("s.overlap")).alias("least"),
        (1 - F.col("s.aligned")).alias("most")))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, class_id`` for every row of ``docs``."""
    return classified(docs, key, text).select(F.col("id").alias("doc_id"), F.col("first.id").alias("class_id"))


def row_hash(key: Column, text: str) -> Column:
    """Tells rows that share an id by their texts."""
    return F.xxhash64(key, text_or_empty(text))


def classified(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, by`` (:func:`row_hash`) of every row of ``docs`` and ``first``, the least ``id, by`` of its class."""
    number = quoted(key).cast("long")
    rows = docs.select(number.alias("id"), row_hash(number, text).alias("by"), text_or_empty(text).alias("text"))
    sketched = cut_lineage(rows.select("id", "by", sketch_column("text").alias("s")).select("id", "by", "s.*"))
    named = F.when(F.col("id").isNotNull(), F.struct("id", "by"))
    copies = sketched.groupBy("digest").agg(F.min(named).alias("own"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    # documents are ordered by a hash; leaders come first in it, and classes are named by their first
    node = F.struct(F.col("own.by").alias("by"), F.col("own.id").alias("rep"))
    nodes = (copies.where(F.col("own").isNotNull() & (F.col("n") > 0))
             .select(node.alias("node"), "n", F.transform("bands", lambda v, i: F.xxhash64(i, v)).alias("buckets")))
    keyed = nodes.select("node", "n", F.explode("buckets").alias("bucket"))
    shared = (keyed.groupBy("bucket").agg(F.count("*").alias("size"), F.min(F.struct("node", "n")).alias("lead"))
              .where("size > 1").drop("size"))
    members = cut_lineage(keyed.join(shared, "bucket"))
    close = F.least("n", "m") >= SIMILARITY * F.greatest("n", "m")
    # first, each member against the leader that comes first among its buckets' leaders
    pairs = written(members.where(F.col("node") != F.col("lead.node")).groupBy("node", "n").agg(F.min("lead").alias("lead"))
                    .select(F.col("lead.node").alias("a"), F.col("node").alias("b"), "n", F.col("lead.n").alias("m"))
                    .where(close).select("a", "b"))
    used = written(members.select("node").distinct())
    texts = (rows.where("id IS NOT NULL").select(F.struct("by", F.col("id").alias("rep")).alias("node"), "text")
             .join(broadcast_if_small(used, used.count()), "node", "left_semi"))
    if not sketched.where("id IS NOT NULL").groupBy("id", "by").count().where("count > 1").isEmpty():
        texts = texts.groupBy("node").agg(F.min("text").alias("text"))
    texts = cut_lineage(texts)
    tested = _tested(pairs, texts)
    classes = classes_of(tested.where("linked"))
    members = _matchable(_mixed_buckets(members.select("bucket", "node", "n"), classes, 0), texts, nodes)
    classes = _settled(members, texts, classes, tested)
    # the class is called by its least id
    least = classes.groupBy("class").agg(F.min(F.struct(F.col("node.rep").alias("id"), "node.by")).alias("first"))
    of_node = classes.join(least, "class").select(F.struct(F.col("node.rep").alias("id"), "node.by").alias("own"), "first")
    of_copies = copies.select("digest", "own").join(of_node, "own", "left").select(
        F.col("digest").alias("of"), F.coalesce("first", "own").alias("first"))
    return sketched.select("id", "by", "digest").join(of_copies, F.col("digest") == F.col("of")).drop("digest", "of")


def _settled(members: DataFrame, texts: DataFrame, classes: DataFrame, tested: DataFrame) -> DataFrame:
    """``classes`` after all links between ``members`` of a bucket, leaders by leaders.

    A pair is looked at in the first bucket it shares, while its classes still differ, and only if
    nothing known keeps it apart: aligned distance (1 - matches / union) is a metric, so two documents whose distances to
    a third differ by more than the limit cannot link.  Each document remembers the leaders of the first
    round that it was tested against, :data:`PIVOTS` at most.
    """
    low, high = 0, FIRST_LEADERS
    members = members.join(_pivots(tested), "node", "left").withColumn("pivots", F.coalesce("pivots", F.array()))
    while True:
        placed = written(_mixed_buckets(members, classes, low))
        if placed.isEmpty():
            return classes
        members = placed.drop("class")
        ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy("bucket").orderBy("node")))
        leaders = ranked.where((F.col("rank") > low) & (F.col("rank") <= high)).select(
            "bucket", F.col("node").alias("a"), F.col("n").alias("m"), F.col("can").alias("may"), F.col("class").alias("of"),
            F.col("odd").alias("even"),
            F.col("earlier").alias("before"), F.col("pivots").alias("known"), F.col("rank").alias("lead"))
        met = ranked.join(leaders, "bucket").where(
            (F.col("rank") > F.col("lead")) & (F.col("class") != F.col("of")) & _possible()
            & ~F.arrays_overlap("earlier", "before") & ~_kept_apart())
        pairs = written(met.select("a", F.col("node").alias("b")).distinct().join(tested, ["a", "b"], "left_anti"))
        now = _tested(pairs, texts)
        if not now.where("linked").isEmpty():
            classes = _joined(classes, now.where("linked"))
        tested = tested.unionByName(now)
        low, high = high, MORE_LEADERS * high


def _pivots(tested: DataFrame) -> DataFrame:
    """``node, pivots``: the first leaders that a document was tested against, with bounds of the distances."""
    each = F.slice(F.sort_array(F.collect_list(F.struct(F.col("a").alias("p"), "least", "most"))), 1, PIVOTS)
    return written(tested.groupBy(F.col("b").alias("node")).agg(each.alias("pivots")))


def _kept_apart() -> Column:
    """Whether a third document shows that the pair cannot link, or the leader is one that the document was tested against."""
    limit = 1 - SIMILARITY + 1e-9

    def shows(x: Column) -> Column:
        return F.exists("known", lambda y: (x["p"] == y["p"]) & ((x["least"] - y["most"] > limit) | (y["least"] - x["most"] > limit)))

    return F.exists("pivots", lambda x: (x["p"] == F.col("a")) | shows(x))


def _possible() -> Column:
    """Whether two documents have enough items that can match."""
    both = F.col("n") + F.col("m")
    differ = reduce(add, [F.bit_count(F.col("odd")[k].bitwiseXOR(F.col("even")[k])) for k in range(CELL_WORDS)])

    def enough(most: Column) -> Column:
        return most >= SIMILARITY * (both - most)

    return enough(F.least("can", "may")) & enough(F.shiftright(both - differ, 1))


def _mixed_buckets(members: DataFrame, classes: DataFrame, low: int) -> DataFrame:
    """Members, with their ``class``, of buckets of several classes that have more than ``low`` members."""
    placed = members.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    mixed = (placed.groupBy("bucket").agg(F.min("class").alias("x"), F.max("class").alias("y"), F.count("*").alias("size"))
             .where((F.col("x") != F.col("y")) & (F.col("size") > low)).select("bucket"))
    return placed.join(mixed, "bucket", "left_semi")


def _matchable(members: DataFrame, texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """``bucket, node, n, can, odd, earlier``: members with the most items that can match any other
    member, their parities, and the buckets of the document before this one (a pair is looked at in the first it shares).

    Items that no other document here has match nothing.  A document in which less
    than the similarity can match has no link to look for and is left out.
    """
    members = written(members.drop("class"))
    left = written(members.select("node", "n").distinct())
    own = texts.join(broadcast_if_small(left.select("node"), left.count()), "node", "left_semi")
    single = (own.select("node", F.explode(items_column("text")).alias("item")).groupBy("item")
              .agg(F.count("*").alias("times"), F.min("node").alias("node")).where("times = 1")
              .groupBy("node").agg(F.count("*").cast("int").alias("alone")))
    able = (left.join(single, "node", "left").select("node", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("can"))
            .where(F.col("can") >= SIMILARITY * F.col("n")))
    able = written(able.join(nodes.select("node", "buckets"), "node"))
    odd = (texts.join(broadcast_if_small(able.select("node"), able.count()), "node", "left_semi")
           .select("node", parities_column("text").alias("odd")))
    able = able.join(odd, "node")
    earlier = F.slice("buckets", F.lit(1), (F.array_position("buckets", F.col("bucket")) - 1).cast("int"))
    return written(members.join(able, "node").select("bucket", "node", "n", "can", "odd", earlier.alias("earlier")))


def _joined(classes: DataFrame, links: DataFrame) -> DataFrame:
    """Classes after further links: components of the classes that these connect."""
    def of(side: str) -> DataFrame:
        return classes.select(F.col("node").alias(side), F.col("class").alias(f"of_{side}"))

    between = (links.join(of("a"), "a", "left").join(of("b"), "b", "left")
               .select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")).where("a != b").distinct())
    merged = classes_of(between).select(F.col("node").alias("class"), F.col("class").alias("into"))
    # nodes that had no class until now are classes of their own in ``merged``
    alone = merged.join(classes.select("class").distinct(), "class", "left_anti").select(
        F.col("class").alias("node"), F.col("into").alias("class"))
    moved = classes.join(merged, "class", "left").select("node", F.coalesce("into", "class").alias("class"))
    return written(moved.unionByName(alone))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id (and text) is the first of its class, one row each, all columns.

    Rows with a null id are kept unless their text is that of a row with an id.
    """
    found = classified(docs, key, text)
    dropped = written(found.where((F.col("id") != F.col("first.id")) | (F.col("by") != F.col("first.by")) |
                                  (F.col("id").isNull() & F.col("first").isNotNull()))
                      .select(F.col("id").alias("__id"), F.col("by").alias("__by")).distinct())
    here = row_hash(quoted(key).cast("long"), text)
    kept = docs.join(broadcast_if_small(dropped, dropped.count()),
                     quoted(key).cast("long").eqNullSafe(F.col("__id")) & (here == F.col("__by")), "left_anti")
    if found.where("id IS NOT NULL").groupBy("id", "by").count().where("count > 1").isEmpty():
        return kept
    # rows that share id and text: the one whose other columns hash lowest
    row, order = F.struct(*[quoted(c) for c in docs.columns]), F.xxhash64(*[quoted(c) for c in docs.columns])
    one = (kept.where(quoted(key).isNotNull()).groupBy(quoted(key).cast("long").alias("__id"), here.alias("__by"))
           .agg(F.min_by(row, order).alias("__row")).select("__row.*"))
    return one.unionByName(kept.where(quoted(key).isNull()))
