import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from millrace.llm import pieces, queries

DATA = open(pieces.MODEL, "rb").read()
LIBRARY = sentencepiece.SentencePieceProcessor(model_proto=DATA)


@pytest.fixture(scope="module")
def model():
    return pieces.Model(DATA)


def ids_of(model, texts):
    return pieces.encode_array(model, pa.array([t.encode() for t in texts], pa.binary())).to_pylist()


def made_up(n, seed=7):
    """Texts of common letters, blanks and marks (pieces overlap), of digits, and of characters of all kinds."""
    r = random.Random(seed)
    kinds = [
        "aehinorst  ",
        "abcdeé ñ\n\t漢字かな😀▁<s>0123..--==   ü",
        [chr(c) for lo, hi in ((32, 127), (0x400, 0x450), (0x4E00, 0x5E00), (0x1F300, 0x1F600), (0x300, 0x340)) for c in range(lo, hi)],
    ]
    return ["".join(r.choices(r.choice(kinds), k=r.randint(0, 90))) for _ in range(n)]


ODD = ["", " ", "  ", " " * 700, "\n", "\x00a\x00", "a" * 900, "ab" * 500, "=" * 300, "<s></s><unk><0x41>", "▁", "▁ ▁", "é", "é", "aaa aaaa aaaaa", "１２３"]


def test_encoding_is_the_librarys(model):
    texts = ODD + made_up(4000)
    assert ids_of(model, texts) == LIBRARY.encode(texts)


def test_words_that_were_met_are_encoded_alike(model):
    texts = made_up(200, 3)
    first = ids_of(model, texts)
    assert ids_of(model, texts) == first == ids_of(pieces.Model(DATA), texts)


def test_parts_of_texts_and_small_memories(model, monkeypatch):
    """Long texts are encoded in parts that end between words, and what is remembered may be forgotten at any time."""
    texts = [" ".join(made_up(30, k)) for k in range(40)] + [" " * 300, "a" * 300, ("x" * 90 + "  ") * 9]
    want = LIBRARY.encode(texts)
    for group, most in ((1, 0), (37, 100), (200, 10**6)):
        monkeypatch.setattr(pieces, "GROUP", group)
        monkeypatch.setattr(pieces, "REMEMBERED", most)
        own = pieces.Model(DATA)
        assert ids_of(own, texts) == want == ids_of(own, texts)


def test_equal_hashes_of_different_words(monkeypatch):
    """Words are what their characters are, also where every hash is the same."""
    own = pieces.Model(DATA)
    own.values[:] = 0
    texts = made_up(60, 11) + ["ab ba ab", "the hte the"]
    assert ids_of(own, texts) == LIBRARY.encode(texts) == ids_of(own, texts)
    own = pieces.Model(DATA)
    own.encode(["abc"])
    hashes, first, which = own.distinct(np.array([97, 98, 99], dtype=np.int32), np.array([0]), np.array([3]))
    own.hashes[:] = 0
    own.values[:] = 0
    assert own.encode(["xyz"])[0].tolist() == LIBRARY.encode("xyz")


def test_rounds_and_heap_agree(model, monkeypatch):
    texts = made_up(300, 5) + ["".join(random.Random(1).choices("the and in on er", k=900))]
    want = LIBRARY.encode(texts)
    for longest in (0, 3, 10**9):
        monkeypatch.setattr(pieces, "LONG", longest)
        assert ids_of(pieces.Model(DATA), texts) == want


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def own_model(words):
    """The bytes of a BPE model with these pieces, the best first."""
    field = lambda number, data: _varint(number << 3 | 2) + _varint(len(data)) + data
    number = lambda k, v: _varint(k << 3) + _varint(v)
    piece = lambda text, score, kind: field(1, field(1, text.encode()) + _varint(2 << 3 | 5) + np.float32(score).tobytes() + number(3, kind))
    out = piece("<unk>", 0, 2) + piece("<s>", 0, 3) + piece("</s>", 0, 3)
    out += b"".join(piece(f"<0x{i:02X}>", 0, 6) for i in range(256))
    out += b"".join(piece(t, s, 1) for t, s in words)
    return out + field(2, number(3, 2) + number(35, 1)) + field(3, field(1, b"identity") + number(3, 1) + number(4, 0) + number(5, 1))


def test_models_whose_longer_pieces_come_first():
    """Pieces with better scores than what they are made of, and equal scores, in every order of a few letters."""
    r = random.Random(2)
    every = ["".join(x) for n in (2, 3, 4) for x in __import__("itertools").product("ab", repeat=n)]
    for seed in range(12):
        chosen = r.sample(every, 12)
        words = [(t, -float(r.randint(1, 8 if seed % 2 else 40))) for t in chosen] + [("a", -50.0), ("b", -51.0), ("▁", -52.0)]
        data = own_model(words)
        library, own = sentencepiece.SentencePieceProcessor(model_proto=data), pieces.Model(data)
        texts = ["".join(r.choices("ab", k=r.randint(1, 25))) for _ in range(300)] + ["a b ab", "c", "aéb"]
        assert ids_of(own, texts) == library.encode(texts)


def test_decoding_is_the_librarys(model):
    r = random.Random(3)
    lists = LIBRARY.encode(ODD + made_up(500)) + [[r.randint(0, 31_999) if r.random() < 0.4 else r.randint(0, 300) for _ in range(r.randint(0, 12))] for _ in range(4000)]
    own = pieces.decode_array(model, pa.array([*lists, None], pa.list_(pa.int32()))).to_pylist()
    assert own == [*map(LIBRARY.decode, lists), None]
    for bad in (32_000, -1):
        with pytest.raises(IndexError, match="an id is not among"):
            pieces.decode_array(model, pa.array([[5, bad]], pa.list_(pa.int32())))


def test_other_models_are_errors():
    from millrace.llm.pieces import Model

    good = own_model([("a", -1.0)])
    Model(good)
    with pytest.raises(ValueError, match="only BPE"):
        Model(good.replace(bytes([3 << 3, 2, 0xFF]), b"") + bytes([2 << 3 | 2, 2, 3 << 3, 1]))
    with pytest.raises(ValueError, match="only BPE"):
        Model(own_model([("a", -1.0), ("a▁b", -2.0)]))


def test_query_against_the_library(spark, docs):
    want = {}
    for doc in docs.collect():
        ids = LIBRARY.encode(doc.text or "")
        hexed = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), LIBRARY.decode(ids))]
        want[doc.doc_id] = (len(ids), *hexed)
    rows = queries.op11_sentencepiece(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == want and len(rows) == len(want)


def test_edges(spark, edge_docs, no_docs):
    encode, decode = pieces.encoder(spark), pieces.decoder(spark)
    for docs in (edge_docs, no_docs):
        rows = docs.withColumn("ids", encode(F.col("text"))).withColumn("again", decode(F.col("ids"))).collect()
        assert len(rows) == docs.count()
        for r in rows:
            assert r.ids == LIBRARY.encode(r.text or "") and r.again == LIBRARY.decode(r.ids) == (r.text or "")
    assert spark.sql("select cast(null as array<int>) as i").select(decode(F.col("i"))).first()[0] is None
    broken = spark.sql("select cast(x'61ff62' as string) as t").select(encode(F.col("t")).alias("ids")).first()
    assert broken.ids == LIBRARY.encode("a�b")
