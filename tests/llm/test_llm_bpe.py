import base64
import hashlib

import public_tokenizers
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import bpe
from quarry.llm.queries import QUERIES, VOCABULARY

RANKS = bpe.read_ranks(VOCABULARY)
ODD = bpe.odd_characters()
PIECES = bpe.PieceIds(bpe.serialise_model(RANKS), RANKS, public_tokenizers.PATTERN, ODD)
TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def ids(text):
    return bpe.np.frombuffer(PIECES.packed([text])[0], dtype="<i4").tolist()


@settings(max_examples=400, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60) | st.text("ab '\n\t1st<|>", max_size=60))
def test_equals_tiktoken(text):
    assert ids(text) == TIKTOKEN.encode_ordinary(text)


def test_long_runs():
    for text in ("a" * 5_000, " " * 3_000, "é1 " * 2_000, "\U0001f600" * 700):
        assert ids(text) == TIKTOKEN.encode_ordinary(text)


def test_model_is_a_plain_sentencepiece_model():
    model = sentencepiece.SentencePieceProcessor(model_proto=bpe.serialise_model(RANKS))
    assert model.get_piece_size() == len(RANKS) + 1
    assert model.unk_id() == len(RANKS)
    assert model.get_score(300) == -300.0


def test_vocabulary_with_gaps(tmp_path):
    ranks = {bytes([b]): 2 * b for b in range(256)} | {b"ab": 1_000, b"abc": 2_001, b"bc": 3_000}
    path = tmp_path / "v.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(k) + b" %d\n" % v for k, v in ranks.items()))
    pieces = bpe.PieceIds(bpe.serialise_model(ranks), bpe.read_ranks(str(path)), r"\S+|\s+", ODD)
    assert bpe.np.frombuffer(pieces.packed(["abc xbc"])[0], dtype="<i4").tolist() == [2_001, 64, 240, 3_000]


def test_query_round_trip(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in QUERIES["op1_byte_bpe"](spark, sf).collect()}
    for row in spark.read.parquet(f"{sf}/documents.parquet").collect():
        want = TIKTOKEN.encode_ordinary(row["text"])
        assert got[row["doc_id"]]["n_tokens"] == len(want)
        assert got[row["doc_id"]]["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert got[row["doc_id"]]["decoded_sha256"] == hashlib.sha256(row["text"].encode()).hexdigest()


def test_decode_skips_unknown_ids(spark):
    rows = spark.createDataFrame([([1, None, 70_000, -5, 262],), (None,), ([],)], "ids array<int>")
    assert [bytes(r["decoded"]) for r in bpe.decode_documents(rows, VOCABULARY).collect()] == [b'" the', b"", b""]
