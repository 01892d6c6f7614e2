import hashlib
import random
import struct

import public_tokenizers
import pytest
import sentencepiece

from lectorium.llm import sentence_pieces as sp

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "   ", "a", " a ", "a  b", "\n\n\ta", "<s>", "</s> x <unk>", "<0x41>", "▁", "▁▁a ▁", "a" * 3000, "漢字" * 400, "🙂 é\x00\x85　", "don't  stop", "​́", "x\r\ny"]


@pytest.fixture(scope="module")
def pieces():
    return sp.Pieces(PATH)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def texts():
    rng = random.Random(3)
    alphabet = "aeiou tnsrh\n\t  .,'!?0123éßñ漢字🙂\x00\x0b\x85\xa0▁<s></s><0x41>"
    out = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(400)]
    return ODD + out + ["".join(chr(rng.choice([rng.randrange(0, 0x250), rng.randrange(0x250, 0xD7FF), rng.randrange(0x1F300, 0x1F700)])) for _ in range(30)) for _ in range(200)]


def test_ids_and_texts_equal_the_library(pieces, library):
    encode, decode = sp.Encoder(pieces), sp.decoder(pieces)
    for t in texts():
        ids = library.encode(t, add_bos=True, add_eos=True)
        assert encode(t) == packed(ids), t
        assert decode(packed(ids)) == library.decode(ids), t


def test_whole_texts_as_one_agenda_give_the_same(pieces):
    """Cutting at words is sound for this vocabulary: an agenda over the whole text ends in the same pieces."""
    assert pieces.words_apart
    encode = sp.Encoder(pieces)
    for t in texts():
        if t:
            whole = pieces.packed(sp.SPACE + t.replace(" ", sp.SPACE))
            assert encode(t) == packed([pieces.begin]) + whole + packed([pieces.end])


def test_both_forms_of_the_agenda_agree(pieces):
    for t in texts():
        word = sp.SPACE + t[: sp.WORD - 1]
        assert pieces.symbols(word) == pieces._symbols_of_long(word)


def test_any_ids_decode_as_in_the_library(pieces, library):
    """Broken bytes, bytes before words, controls and unknown ids in any order."""
    rng, decode = random.Random(4), sp.decoder(pieces)
    for _ in range(1500):
        ids = [rng.choice([rng.randrange(32_000), rng.randrange(262)]) for _ in range(rng.randrange(12))]
        assert decode(packed(ids)) == library.decode(ids), ids


def test_a_wrong_word_is_seen_in_every_text_that_has_it(pieces, library):
    """Also when it is remembered from an earlier batch; a word with spaces before it is a word of its own."""
    encode = sp.Encoder(pieces, library)
    right = pieces.packed
    encode.pieces = type("Broken", (), {"packed": staticmethod(lambda w: right(w) + right("x") if w == "▁bad" else right(w))})()
    for texts in (["bad", "good  bad", "good bad"], ["a bad day", "good", ""]):
        for t in texts:
            encode(t)
        assert encode.same_as_library(texts) == [t.replace("  bad", "").split().count("bad") == 0 for t in texts]


def test_another_kind_of_model_is_refused(tmp_path):
    with open(PATH, "rb") as f:
        model = f.read()
    changed = model.replace(b"identity", b"nmt_nfkc")  # only a name: still no table of characters
    (tmp_path / "same.model").write_bytes(changed)
    sp.Pieces(str(tmp_path / "same.model"))
    name = b"identity\x12\x00"  # the table of characters follows, empty
    assert name in model
    (tmp_path / "other.model").write_bytes(model.replace(name, b"identity\x12\x01x", 1).replace(b"\x1a\x12\x0a\x08identity", b"\x1a\x13\x0a\x08identity", 1))
    with pytest.raises(ValueError, match="without normalising"):
        sp.Pieces(str(tmp_path / "other.model"))


def test_query_equals_the_library(spark, sf, library):
    from lectorium.llm.queries import QUERIES

    rows = QUERIES["op12_sentence_pieces"](spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id] or "", add_bos=True, add_eos=True)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256, r.same_as_library) == (len(ids), sha(packed(ids)), sha(library.decode(ids).encode()), True)


def test_odd_rows(spark, library):
    """Null texts, null and repeated ids, repeated rows, clashing columns."""
    rows = [(1, None, "a"), (None, "x y", "b"), (1, "x y", "c"), (1, "x y", "c"), (2, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted((str(r.doc_id), list(r.ids), r.decoded_text, r.n_tokens) for r in sp.encode_decode(docs, PATH).collect())
    want = sorted((str(i), w := library.encode(t or "", add_bos=True, add_eos=True), t or "", len(w)) for i, t, _ in rows)
    assert got == want
    assert sp.encode_decode(docs.limit(0), PATH, digest=True, checked=True).collect() == []
