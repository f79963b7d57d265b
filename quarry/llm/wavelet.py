"""Fill-in-middle transformation with cuts found in a wavelet matrix.

The code points of a text fall into four classes (:data:`OTHER`,
:data:`NEWLINE`, :data:`BLANK`, :data:`STOP`), and a wavelet matrix of two bit planes
holds the classes in text order.  A unit of a text ends after each
character of the unit's boundary classes (:data:`UNITS`), and what is left at the end is a
unit too.  The number of boundaries before a place is a sum of rank queries, one for each
class; the place of the k-th boundary is a select query where one class
ends units and a bisection on the summed ranks where several do.  Both cuts are found so, without
a list of the units.

Hashes of the id and the seed choose the cuts and the form: ``psm``
(``<P>`` prefix ``<S>`` suffix ``<M>`` middle), ``spm`` (``<S>`` suffix ``<P>`` prefix ``<M>`` middle) or
``plain`` (the text as it is).  :func:`restored` rebuilds the text from output and form alone.

Null text is empty; an empty text, and one that holds a mark, is plain.
Texts are taken whole, whatever their length.  A null id is hashed as the empty
text; rows with equal ids get equal hashes and are otherwise rows of their own.  An
empty table stays empty.  Other columns are carried along; one named like an output column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import quoted, text_or_empty, texts_of

OTHER, NEWLINE, BLANK, STOP = range(4)
#: Classes whose characters end a unit.
UNITS = {"lines": (NEWLINE,), "words": (NEWLINE, BLANK), "sentences": (NEWLINE, STOP)}
#: Marks of the three parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Characters that end a sentence (fixed values).
_STOPS = ".!?…。！？"


def _class_table() -> np.ndarray:
    """The class of every code point."""
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    table[[c for c in range(0x3001) if chr(c).isspace()]] = BLANK
    table[[ord(c) for c in _STOPS]] = STOP
    table[ord("\n")] = NEWLINE
    return table


_CLASSES = _class_table()


def classes(text: str) -> np.ndarray:
    """The class of every code point of a text."""
    return _CLASSES[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]


class BitVector:
    """Bits in 64-bit words with the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self._words = np.concatenate([packed, np.zeros(8 - len(packed) % 8, dtype=np.uint8)]).view("<u8")
        self._before = np.concatenate([[0], np.cumsum(np.bitwise_count(self._words), dtype=np.int64)])
        self._zeros_before = 64 * np.arange(len(self._before)) - self._before
        self.zeros = len(bits) - int(self._before[-1])

    def rank(self, bit: int, i: int) -> int:
        """How many of the first ``i`` bits equal ``bit``."""
        word, rest = divmod(i, 64)
        ones = int(self._before[word]) + (int(self._words[word]) & ((1 << rest) - 1)).bit_count()
        return ones if bit else i - ones

    def select(self, bit: int, k: int) -> int:
        """Place of the ``k``-th (from 1) bit that equals ``bit``; it must be there."""
        before = self._before if bit else self._zeros_before
        word = int(np.searchsorted(before, k)) - 1
        left = int(self._words[word]) if bit else ~int(self._words[word]) & (2**64 - 1)
        for _ in range(k - int(before[word]) - 1):
            left &= left - 1
        return 64 * word + (left & -left).bit_length() - 1


class WaveletMatrix:
    """Rank and select of symbols below ``2 ** bits``."""

    def __init__(self, symbols: np.ndarray, bits: int = 2):
        self.size, self._planes = len(symbols), []
        for shift in reversed(range(bits)):
            ones = (symbols >> shift & 1).astype(bool)
            self._planes.append((shift, BitVector(ones)))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def _narrowed(self, symbol: int, i: int) -> tuple[int, int]:
        """The range, at the end of all planes, of ``symbol``'s occurrences before place ``i``."""
        low, high = 0, i
        for shift, plane in self._planes:
            bit = symbol >> shift & 1
            low, high = (bit * plane.zeros + plane.rank(bit, x) for x in (low, high))
        return low, high

    def rank(self, symbol: int, i: int) -> int:
        """Occurrences of ``symbol`` before place ``i``."""
        low, high = self._narrowed(symbol, i)
        return high - low

    def select(self, symbol: int, k: int) -> int:
        """Place of the ``k``-th (from 1) occurrence of ``symbol``; it must be there."""
        place = self._narrowed(symbol, 0)[0] + k - 1
        for shift, plane in reversed(self._planes):
            bit = symbol >> shift & 1
            place = plane.select(bit, place - bit * plane.zeros + 1)
        return place


class Units:
    """The units of a text, counted and cut through its wavelet matrix."""

    def __init__(self, text: str, unit: str = "lines"):
        found = classes(text)
        self._matrix, self._ends = WaveletMatrix(found), UNITS[unit]
        self._boundaries = self.boundaries_before(len(found))
        open_end = len(found) > 0 and int(found[-1]) not in self._ends
        self.count = self._boundaries + open_end

    def boundaries_before(self, i: int) -> int:
        return sum(self._matrix.rank(c, i) for c in self._ends)

    def end_of(self, k: int) -> int:
        """Code points of the first ``k`` units."""
        if k == 0:
            return 0
        if k > self._boundaries:
            return self._matrix.size
        if len(self._ends) == 1:
            return self._matrix.select(self._ends[0], k) + 1
        low, high = 1, self._matrix.size  # the least length that holds k boundaries
        while low < high:
            half = (low + high) // 2
            low, high = (low, half) if self.boundaries_before(half) >= k else (half + 1, high)
        return low


def cut_column(text: Column, first: Column, second: Column, unit: str) -> Column:
    """``n`` (units), ``prefix`` and ``middle`` (code points), cut after ``first`` and ``second`` modulo ``n + 1`` units."""

    @F.arrow_udf("struct<n: long, prefix: long, middle: long>")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, ones, others in batches:
            rows = []
            for t, x, y in zip(texts_of(texts), ones.to_pylist(), others.to_pylist(), strict=True):
                units = Units(t, unit)
                a, b = sorted((x % (units.count + 1), y % (units.count + 1)))
                start = units.end_of(a)
                rows.append((units.count, start, units.end_of(b) - start))
            columns = zip(*rows) if rows else ((), (), ())
            yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["n", "prefix", "middle"])

    return cut(text, first, second)


def id_hash(key: str, seed: int, part: int) -> Column:
    """The ``part``-th (from 0) 8-digit group, as a number, of the hex sha256 of ``seed:id``."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(quoted(key).cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 8 * part + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "lines", seed: int = 7,
                   rate: int = 100, spm: int = 50) -> DataFrame:
    """``docs`` with ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` (null if plain) and ``output``.

    ``rate`` of 100 documents are cut and ``spm`` of 100 of these have their suffix first.
    """
    whole = text_or_empty(text)
    cuts = docs.withColumn("__cut", cut_column(whole, id_hash(key, seed, 0), id_hash(key, seed, 1), unit))
    plain = (whole == "") | (id_hash(key, seed, 2) % 100 >= rate)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        plain = plain | F.contains(whole, F.lit(mark))
    form = F.when(plain, "plain").when(id_hash(key, seed, 3) % 100 < spm, "spm").otherwise("psm")
    formed = cuts.withColumn("form", form)
    start, length = F.col("__cut.prefix"), F.col("__cut.middle")
    head = F.concat(F.lit(PREFIX), F.substr(whole, F.lit(1), start))
    middle = F.concat(F.lit(MIDDLE), F.substr(whole, start + 1, length))
    tail = F.concat(F.lit(SUFFIX), F.substr(whole, start + length + 1))
    output = (F.when(F.col("form") == "psm", F.concat(head, tail, middle))
              .when(F.col("form") == "spm", F.concat(tail, head, middle)).otherwise(whole))
    kept = F.col("form") != "plain"
    return (formed.withColumn("output", output).withColumn("n", F.col("__cut.n"))
            .withColumn("prefix_chars", F.when(kept, start)).withColumn("middle_chars", F.when(kept, length)).drop("__cut"))


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` of this form was made from.

    The text held no mark, so the first of each is the one that was put in.
    """
    def between(first: str, then: str | None) -> Column:
        start = F.instr(output, first) + len(first)
        return F.substr(output, start) if then is None else F.substr(output, start, F.instr(output, then) - start)

    middle = between(MIDDLE, None)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
