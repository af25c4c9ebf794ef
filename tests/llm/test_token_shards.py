import hashlib

import numpy as np
import pytest

from millrace.llm import token_shards
from millrace.llm.token_shards import Encoder, permute

FILES = ["byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097, 70_000])
def test_permutation(n):
    slots = permute(np.arange(n), n, key=7)
    assert sorted(slots.tolist()) == list(range(n))
    if n > 60:
        assert permute(np.arange(n), n, key=8).tolist() != slots.tolist()
        assert (permute(np.array([5]), n, key=7) == slots[5]).all()
        assert abs(np.corrcoef(np.arange(n), slots)[0, 1]) < 0.4


def scalar_slot(x, n, key):
    """One number by plain integers."""
    half, wide = max(1, ((n - 1).bit_length() + 1) // 2), (1 << 64) - 1
    mask = (1 << half) - 1
    digest = hashlib.sha256(b"feistel %d" % key).digest() + hashlib.sha256(b"rounds %d" % key).digest()
    keys = [int.from_bytes(digest[8 * i : 8 * i + 8], "little") for i in range(token_shards.ROUNDS)]
    while True:
        left, right = x >> half, x & mask
        for k in keys:
            f = (right + k) * 0xBF58476D1CE4E5B9 & wide
            f = (f ^ f >> 29) * 0x94D049BB133111EB & wide
            left, right = right, left ^ ((f ^ f >> 32) & mask)
        x = left << half | right
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 3, 100, 4097])
def test_permutation_against_plain_integers(n):
    for key in (0, 7):
        assert permute(np.arange(n), n, key).tolist() == [scalar_slot(x, n, key) for x in range(n)]


def round_trip(spark, df, tokenizer, seq_len, per_shard):
    manifest, path = token_shards.materialize_order(df, tokenizer, seq_len, per_shard=per_shard)
    with open(tokenizer, "rb") as file:
        encoder = Encoder(tokenizer, file.read())
    rows = manifest.collect()
    stored = {(r.shard, r.place): list(r.ids) for r in token_shards.read_shards(spark, path, seq_len, encoder.dtype.itemsize).collect()}
    assert len(stored) == len(rows) and sorted(r.slot for r in rows) == list(range(len(rows)))
    pieces, stride = {}, seq_len * encoder.dtype.itemsize + 2
    for r in rows:
        assert r.shard == r.slot // per_shard and r.byte_offset == r.slot % per_shard * stride
        ids = stored[r.shard, r.slot % per_shard]
        assert all(x == encoder.end for x in ids[r.n_tokens :])
        for s in r.spans:
            pieces.setdefault(s.doc_id, []).append((s.first, ids[s.at : s.at + s.n]))
    return pieces, encoder


@pytest.mark.parametrize("name", FILES)
def test_exact_round_trip(spark, docs, name):
    some = docs.where("doc_id < 60")
    pieces, encoder = round_trip(spark, some, f"/opt/tokenizers/{name}", 128, 50)
    for r in some.collect():
        ids = [x for _, part in sorted(pieces[r.doc_id]) for x in part]
        assert ids == [*encoder.encode(r.text), encoder.end]


def test_equal_runs_give_equal_shards(spark, docs):
    a, b = (token_shards.materialize_order(docs, seq_len=256, per_shard=100)[0] for _ in range(2))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_edges(spark, edge_docs, no_docs):
    pieces, encoder = round_trip(spark, edge_docs, token_shards.TOKENIZER, 64, 1000)
    assert [len(p) for _, p in pieces[3]] == [1] and len(pieces[2]) >= 2
    ids = [x for _, part in sorted(pieces[8]) for x in part]
    assert ids.count(encoder.end) == 1
    manifest, _ = token_shards.materialize_order(no_docs)
    assert manifest.count() == 0
