"""Byte-level BPE through a sentencepiece model that is written straight from the vocabulary.

A rank file maps byte strings to ranks.  Every byte gets a character of its
own (:func:`byte_char`), every byte string becomes a piece of such
characters with score ``-rank``, and the normaliser is the identity; the BPE
merges of that model are then the merges of the rank file, lowest rank
first, leftmost on ties.  Texts are cut into pre-tokens by the pattern, each
pre-token is encoded on its own, and decoding looks each id's bytes up.

Null text is the empty text and has no ids.  Texts of any length are
encoded whole.  Repeated rows are encoded alike; ids that the vocabulary
does not hold, and null ids, decode to nothing; a null list decodes to
empty bytes.  Other columns are carried along untouched (an output column
that exists already is replaced).
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .tables import quoted, text_or_empty

#: Pre-tokens longer than this are encoded each time, not remembered.
REMEMBERED_CHARS = 48
#: Pre-tokens that one worker remembers before it starts afresh (about 30 MB).
REMEMBERED = 150_000
#: Texts that are cut at once.
SLICE = 32


def byte_char(value: int) -> str:
    """The character that stands for a byte inside the model."""
    return chr(0x100 + value)


def read_ranks(path: str) -> dict[bytes, int]:
    """``base64(bytes) rank`` lines."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | float | bytes) -> bytes:
    """One protocol-buffer field: length-delimited, 32-bit float or varint."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """The rank file as a sentencepiece BPE model; piece ``i`` is the ``i``-th lowest rank.

    Field numbers are those of the public sentencepiece model format.
    """
    in_order = sorted(ranks, key=ranks.__getitem__)
    chars = [byte_char(b) for b in range(256)]
    pieces = [_field(1, _field(1, "".join(chars[b] for b in piece).encode()) + _field(2, float(-ranks[piece])))
              for piece in in_order]
    unknown = _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(2, _field(3, 2) + _field(4, len(in_order) + 1) + _field(40, len(in_order)))
    normaliser = _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return b"".join(pieces) + unknown + trainer + normaliser


class PieceIds:
    """Texts -> ids, remembering the ids (little-endian int32 bytes) of short pre-tokens.

    All unknown pre-tokens of a batch go through the model in one call.
    """

    def __init__(self, model: bytes, ranks: dict[bytes, int], pattern: str, odd: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.ranks = ranks
        self._ids = sorted(ranks.values())
        self._plain = self._ids == list(range(len(ranks)))
        self._to_chars = {b: byte_char(b) for b in range(256)}
        self._known: dict[str, bytes] = {}
        self.cut = pre_tokeniser(pattern, odd)

    def _learn(self, new: list[str]) -> None:
        raw = [t.encode() for t in new]
        encoded = self._model.encode([r.decode("latin-1").translate(self._to_chars) for r in raw], num_threads=1)
        for token, r, ids in zip(new, raw, encoded, strict=True):
            whole = self.ranks.get(r)  # a pre-token that is itself a piece is that piece
            if whole is not None:
                ids = [whole]
            elif not self._plain:
                ids = [self._ids[i] for i in ids]
            self._known[token] = array("i", ids).tobytes()

    def packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as int32 bytes."""
        cuts = [self.cut(t) for t in texts]
        if len(self._known) > REMEMBERED:
            self._known.clear()
        new = set().union(*cuts).difference(self._known)
        if new:
            self._learn(list(new))
        look = self._known.__getitem__
        out = [b"".join(map(look, c)) for c in cuts]
        for long in [t for t in new if len(t) > REMEMBERED_CHARS]:
            del self._known[long]
        return out


def pre_tokeniser(pattern: str, odd_characters: str) -> Callable[[str], list[str]]:
    """All matches of the pattern, each a pre-token.

    The standard engine is over twice as fast but has no ``\\p`` classes.  It
    is used where its own classes agree with them on every character of the
    text; ``odd_characters`` (:func:`odd_characters`) are those on which they don't.
    """
    import regex

    exact = regex.compile(pattern).findall
    fast_pattern = pattern
    for theirs, ours in _CLASSES.items():
        fast_pattern = fast_pattern.replace(theirs, ours)
    if "\\p" in fast_pattern or "\\P" in fast_pattern:
        return exact
    fast, odd = re.compile(fast_pattern).findall, re.compile(f"[{re.escape(odd_characters)}\U00010000-\U0010ffff]").search
    return lambda text: fast(text) if odd(text) is None else exact(text)


#: Character classes of the two engines that mean the same but for a few characters.
_CLASSES = {r"[^\s\p{L}\p{N}]": r"(?:[^\s\w]|_)", r"\p{L}": r"[^\W\d_]", r"\p{N}": r"\d"}


def odd_characters() -> str:
    """Characters that one engine puts into a class and the other doesn't (found once, on the driver).

    Those of the basic plane; all later ones count as odd.
    """
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    odd: set[str] = set()
    for theirs, ours in [*_CLASSES.items(), (r"\s", r"\s")]:
        odd |= set(regex.findall(theirs, every)) ^ set(re.findall(ours, every))
    return "".join(sorted(odd))


_WORKER: dict = {}


def worker_pieces(key: str, sent: Broadcast) -> PieceIds:
    """The encoder of this worker process, kept from task to task (one at a time)."""
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = PieceIds(*sent.value)
    return _WORKER[key]


def encode_column(text: str | Column, ranks: dict[bytes, int], pattern: str) -> Column:
    """``array<int>`` of ids.  The model (2 MB, bounded by the vocabulary) travels with the task."""
    model = serialise_model(ranks)
    key = hashlib.sha256(model + pattern.encode()).hexdigest()
    sent = SparkSession.getActiveSession().sparkContext.broadcast((model, ranks, pattern, odd_characters()))

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = worker_pieces(key, sent)
        for texts in batches:
            ids, ends = bytearray(), array("i", [0])
            for at in range(0, len(texts), SLICE):
                for one in pieces.packed(texts[at:at + SLICE].to_pylist()):
                    ids += one
                    ends.append(len(ids) // 4)
            yield pa.ListArray.from_arrays(pa.array(np.frombuffer(ends, np.int32)), pa.array(np.frombuffer(ids, "<i4")))

    return encode(text_or_empty(text))


def decode_column(ids: str | Column, ranks: dict[bytes, int]) -> Column:
    """The bytes that a list of ids stands for (``binary``)."""
    sent = SparkSession.getActiveSession().sparkContext.broadcast({rank: piece for piece, rank in ranks.items()})

    @F.arrow_udf("binary")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        inverse = sent.value
        size = max(inverse, default=-1) + 2
        pieces = np.empty(size, dtype=object)  # the last entry stands for ids outside the vocabulary
        pieces[:] = b""
        for rank, piece in inverse.items():
            pieces[rank] = piece
        table = pieces.tolist()
        for lists in batches:
            flat = lists.flatten()
            flat = np.asarray(flat.fill_null(-1) if flat.null_count else flat)
            ends = np.cumsum(np.asarray(lists.value_lengths().fill_null(0)), dtype=np.int64).tolist()
            out, at = [], 0
            for end in ends:
                own = flat[at:end]
                if len(own) and (own.min() < 0 or own.max() >= size - 1):
                    own = np.where((own >= 0) & (own < size - 1), own, size - 1)
                out.append(b"".join(map(table.__getitem__, own.tolist())))
                at = end
            yield pa.array(out, pa.binary())

    return decode(F.col(ids) if isinstance(ids, str) else ids)


def tokenise_documents(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``ids``, ``n_tokens`` (long) and ``exact``: whether the ids decode to the text.

    Encoding and decoding share a worker and its vocabulary, and documents are
    handed on a few at a time, so that a worker never holds a whole batch of ids.
    """
    ranks = read_ranks(path)
    sent = docs.sparkSession.sparkContext.broadcast((serialise_model(ranks), ranks, pattern, odd_characters()))
    kept = [f for f in docs.schema.fields if f.name not in (text, "ids", "n_tokens", "exact")]
    schema = StructType([*kept, *StructType.fromDDL("ids array<int>, n_tokens long, exact boolean").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = PieceIds(*sent.value)
        bytes_of = {rank: piece for piece, rank in pieces.ranks.items()}
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                part = batch.slice(at, SLICE)
                texts = part.column(len(kept)).to_pylist()
                packed = [np.frombuffer(x, "<i4") for x in pieces.packed(texts)]
                exact = [b"".join(map(bytes_of.__getitem__, x.tolist())) == t.encode() for x, t in zip(packed, texts, strict=True)]
                sizes = [len(x) for x in packed]
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)),
                                               pa.array(np.concatenate(packed)))
                yield pa.RecordBatch.from_arrays([*part.columns[:len(kept)], ids, pa.array(sizes, pa.int64()), pa.array(exact)],
                                                 schema.names)
            pa.default_memory_pool().release_unused()

    return docs.select(*[quoted(f.name) for f in kept], text_or_empty(text).alias("__text")).mapInArrow(run, schema)


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array<int>) and ``n_tokens`` (long)."""
    out = docs.withColumn("ids", encode_column(text, read_ranks(path), pattern))
    return out.withColumn("n_tokens", F.size("ids").cast("long"))


def decode_documents(docs: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``docs`` with ``decoded`` (binary): the inverse mapping of its ids."""
    return docs.withColumn("decoded", decode_column(ids, read_ranks(path)))
