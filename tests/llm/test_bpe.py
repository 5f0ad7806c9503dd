import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from textfix.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as file:
        ranks = bpe.read_ranks(file.read())
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [
    None, "", " ", "  \n\n  a  b", "it's WE'LL 'tis don't", "naïve façade 漢字 😀\x1c\x85 x",
    "a" * 5000, "ab" * 3000 + " " * 300, "<|endoftext|> 123456 ...---", "tie tie tie", "tie tie tie",
]


def test_round_trip_equals_library(spark, docs, library):
    got = {r["doc_id"]: r for r in bpe.round_trip(docs(enumerate(TEXTS), "ids string"), PATH, P.PATTERN).collect()}
    for i, text in enumerate(TEXTS):
        ids = np.array(library.encode_ordinary(text or ""), "<u4")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_encode_and_decode_keep_columns_and_replace_a_clashing_one(spark, docs, library):
    df = bpe.encode(docs(enumerate(TEXTS), "ids string"), PATH, P.PATTERN)
    back = bpe.decode(df, PATH)
    for row in back.collect():
        assert row["ids"] == library.encode_ordinary(row["text"] or "")
        assert bytes(row["decoded"]) == (row["text"] or "").encode()
        assert row["lang"] == "en"
    assert bpe.round_trip(docs([]), PATH, P.PATTERN).collect() == []


def test_smaller_rank_formed_by_a_merge_goes_first():
    # "abc" has a smaller rank than "ab", from which it is formed.
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"ab": 300, b"bab": 280}
    coder = bpe.BytePairCoder(ranks, r"\S+")
    assert coder.encode_pieces([b"ababcab"]) == [np.array([300, 256, 300], "<u4").tobytes()]


def test_slices_end_where_a_pre_token_ends():
    text = "aa  bb\n cc" * 50
    assert "".join(bpe.safe_slices(text, 7)) == text
    assert all(s[0] in " \n" for s in list(bpe.safe_slices(text, 7))[1:])
