import hashlib
import random
import struct

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lectorium.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tables():
    return bpe.Tables(PATH)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def texts():
    rng = random.Random(5)
    alphabet = "aeiou tnsrh\n\t  .,'!?0123éßñ漢字🙂\x0b\x1c\x85\xa0 ​　<|endoftext|>"
    out = ["", " ", "\n\n a  b ", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "don't I'LL we've", "a" * 500, "é" * 300,
           "x   ", "   <|endoftext|>   y", "1" * 100, "\x1c\x1d \x1e", "naïve café — “quoted”", "the " * 50, "<|endoftext", "áb‍🙂‍🙂"]
    out += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(300)]
    out += ["".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x250, 0xD7FF), rng.randrange(0x1F300, 0x1F700)])) for _ in range(60)) for _ in range(100)]
    return out


def test_counts_and_ids_equal_the_library(tables, library):
    count, encode, decode = bpe.token_counter(tables, tables.whole_tokens()), bpe.encoder(tables), bpe.decoder(tables)
    for t in texts():
        ids = library.encode(t, add_special_tokens=False).ids
        assert count(t) == len(ids), t
        packed = encode(t)
        assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == ids, t
        assert decode(packed) == library.decode(ids, skip_special_tokens=False) == t


def test_whole_tokens_are_single_in_the_library(tables, library):
    whole = sorted(tables.whole_tokens())
    assert len(whole) > 40_000
    for t in whole[::50]:
        assert len(library.encode(t, add_special_tokens=False).ids) == 1


def test_cuts_never_cross_a_token(tables):
    for piece in (b"zqxj", "é漢字".encode(), b" hello", bytes(range(128, 160))):
        parts = list(tables.fragments(piece))
        assert b"".join(parts) == piece
        assert [x for p in parts for x in tables.merge(p)] == tables.merge(piece)


def test_long_pieces_merge_alike(tables):
    rng = random.Random(1)
    for _ in range(30):
        piece = bytes(rng.choice(b"etaoin shrdlu") for _ in range(40))
        assert tables._merge_long([piece[i : i + 1] for i in range(40)]) == tables.merge(piece)


def test_queries_on_rows(spark, documents, library):
    items = [(1, None), (1, None), (2, ""), (None, "hello <|endoftext|>"), (3, "word " * 2000)]
    docs = documents(items).selectExpr("*", "1 as n_tokens", "2 as ids")
    rows = bpe.count_tokens(docs, PATH).collect()
    assert sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == [(0, 0, False)] * 3 + [(19, 3, False), (10000, 2001, True)]
    pairs = sorted((r.n_tokens, r.decoded_text) for r in bpe.encode_decode(docs, PATH).collect())
    assert pairs == [(0, "")] * 3 + [(3, "hello <|endoftext|>"), (2001, "word " * 2000)]
    digests = {r.doc_id: r for r in bpe.encode_decode(docs, PATH, digest=True).collect()}
    ids = library.encode("word " * 2000, add_special_tokens=False).ids
    assert digests[3].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
    assert bpe.count_tokens(documents([]), PATH).count() == 0
