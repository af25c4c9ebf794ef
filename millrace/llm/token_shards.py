"""Training-order token shards: a keyed Feistel permutation gives every sequence its global slot.

Texts become token ids, each document ended by the end id, packed one after the other into sequences of
seq_len ids (the last of a partition is filled up with the end id). Packing follows the rows of docs as
their files are split, so equal files and settings give equal shards, also after a lost task. Sequence
number i of N goes to slot P(i), where P is a Feistel network over the next even number of bits,
walked along its cycle until it falls below N: a permutation known from (N, key) alone.

A shard is a file of fixed-stride records in the order of slots: seq_len ids, little-endian, then two
line feeds. The record of slot s is at (s % per_shard) * stride of shard s // per_shard, so reading can
start anywhere. Spark's text writer puts them where spark.checkpoint.dir or the caller says, with its
commit protocol. Records are compressed until they are written, in the table of packed
sequences as pages of many, in the shuffle one by one.

Null and empty texts give the end id alone; texts that spell out control tokens are ordinary text;
repeated rows are packed each; an empty table writes no record. Only doc_id and text are read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import materialize, shared_dir

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's makers cut text before merging bytes.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MAX_TOKENIZER_BYTES = 64 << 20
END = "\n\n"
ROUNDS = 6
#: Sequences that the driver reads to make a compression dictionary of.
SAMPLE = 600


class Encoder:
    """Text to ids with the bytes of a public tokenizer's file: .tiktoken, .json (tokenizers) or .model."""

    def __init__(self, name: str, data: bytes):
        if name.endswith(".tiktoken"):
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
            encoder = tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
            self.encode, self.size, self.end = encoder.encode_ordinary, len(ranks) + 1, len(ranks)
        elif name.endswith(".json"):
            from tokenizers import Tokenizer

            t = Tokenizer.from_buffer(data)
            t.encode_special_tokens = True
            self.encode = lambda text: t.encode(text, add_special_tokens=False).ids
            self.size = t.get_vocab_size()
            self.end = t.token_to_id("<|endoftext|>")
        else:
            import sentencepiece

            p = sentencepiece.SentencePieceProcessor(model_proto=data)
            self.encode, self.size, self.end = p.encode, p.vocab_size(), p.eos_id()
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, seq_len: int = 2048) -> DataFrame:
    """part, k, n_tokens, spans (doc_id, at, first, n), sha256, ids (binary): the k-th sequence of each
    partition, written to the shared folder. A span says that n tokens of the document, from its token
    number first, stand at place at."""
    with open(tokenizer, "rb") as file:  # a few megabytes, on the driver's machine
        data = file.read()
    if len(data) > MAX_TOKENIZER_BYTES:
        raise ValueError(f"{tokenizer} has more than {MAX_TOKENIZER_BYTES} bytes")
    shared = docs.sparkSession.sparkContext.broadcast(data)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"part int, k int, n_tokens int, spans array<struct<doc_id: {kind}, at: int, first: long, n: int>>, sha256 string, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer, shared.value)
        buffer, filled, spans, rows, k, part, id_type = np.empty(seq_len, encoder.dtype), 0, [], [], 0, None, None
        fill = encoder.end

        def close() -> dict:
            raw = buffer.tobytes()
            return {"part": part, "k": k, "n_tokens": filled, "spans": spans, "sha256": hashlib.sha256(raw).hexdigest(), "ids": raw}

        def batch() -> pa.RecordBatch:
            span = pa.struct([("doc_id", id_type), ("at", pa.int32()), ("first", pa.int64()), ("n", pa.int32())])
            fields = [("part", pa.int32()), ("k", pa.int32()), ("n_tokens", pa.int32()), ("spans", pa.list_(span)), ("sha256", pa.string()), ("ids", pa.binary())]
            return pa.RecordBatch.from_pylist(rows, pa.schema(fields))

        for b in batches:
            id_type = b.schema.field(0).type
            for doc_id, text, at in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                part = at.as_py()
                ids = np.array([*encoder.encode(text.as_py() or ""), fill], dtype=encoder.dtype)
                first = 0
                while first < len(ids):
                    n = min(len(ids) - first, seq_len - filled)
                    buffer[filled : filled + n] = ids[first : first + n]
                    spans.append({"doc_id": doc_id, "at": filled, "first": first, "n": n})
                    filled, first = filled + n, first + n
                    if filled == seq_len:
                        rows.append(close())
                        filled, spans, k = 0, [], k + 1
                        if len(rows) == 256:
                            yield batch()
                            rows = []
        if filled:
            buffer[filled:] = fill
            rows.append(close())
        if rows:
            yield batch()

    rows = docs.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(run, schema)
    return materialize(rows, level=9)


def permute(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """The slot of each number x < n: a keyed permutation of 0 .. n - 1."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    digest = hashlib.sha256(b"feistel %d" % key).digest() + hashlib.sha256(b"rounds %d" % key).digest()
    keys = np.frombuffer(digest, dtype="<u8")[:ROUNDS]

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> np.uint64(half), v & mask
        for round_key in keys:
            f = (right + round_key) * np.uint64(0xBF58476D1CE4E5B9)  # the mixing steps of splitmix64
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((f ^ (f >> np.uint64(32))) & mask)
        return (left << np.uint64(half)) | right

    out = once(x.astype(np.uint64))
    while (outside := out >= n).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def place(packed: DataFrame, key: int = 0, per_shard: int = 16384) -> tuple[DataFrame, int]:
    """packed with number, slot and shard; and how many sequences there are. The driver reads one count
    for each partition that packed sequences."""
    counts = sorted(tuple(r) for r in packed.groupBy("part").count().collect())
    starts, n = [], 0
    for part, c in counts:
        starts.append((part, n))
        n += c
    total = n

    @F.arrow_udf("long")
    def slot(number: pa.Array) -> pa.Array:
        return pa.array(permute(number.to_numpy(zero_copy_only=False), total, key))

    table = packed.sparkSession.createDataFrame(starts, "part int, start long")
    placed = packed.join(F.broadcast(table), "part").withColumn("number", F.col("start") + F.col("k"))
    placed = placed.withColumn("slot", slot("number"))
    return placed.withColumn("shard", F.floor(F.col("slot") / per_shard).cast("int")).drop("start"), n


def dictionary(samples: list[bytes]) -> bytes:
    """What the samples have in common, for compressing each alone; empty if they are too few to tell."""
    try:
        return zstandard.train_dictionary(112 << 10, [bytes(x) for x in samples]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def write_shards(placed: DataFrame, n: int, path: str, per_shard: int = 16384) -> None:
    """One file for each shard of n sequences, in order: part-00000 is shard 0. Sequences cross the network
    compressed, with a dictionary made of SAMPLE of them; any dictionary gives the same files."""
    table = dictionary([r.ids for r in placed.select("ids").limit(SAMPLE).collect()])

    @F.arrow_udf("binary")
    def small(ids: pa.Array) -> pa.Array:
        zip_ = zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(table))
        return pa.array([zip_.compress(x.as_py()) for x in ids], pa.binary())

    @F.arrow_udf("binary")
    def plain(ids: pa.Array) -> pa.Array:
        unzip = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(table))
        return pa.array([unzip.decompress(x.as_py()) for x in ids], pa.binary())

    shards = max(1, -(-n // per_shard))
    dealt = placed.select("slot", "shard", small("ids").alias("ids")).repartitionById(shards, F.col("shard")).sortWithinPartitions("slot")
    dealt.select(plain("ids").cast("string")).write.option("lineSep", END).text(path)


def materialize_order(
    docs: DataFrame, tokenizer: str = TOKENIZER, seq_len: int = 2048, key: int = 0, per_shard: int = 16384, path: str | None = None
) -> tuple[DataFrame, str]:
    """Writes the shards; gives their manifest, a row per sequence, and their folder."""
    path = path or f"{shared_dir(docs.sparkSession)}/millrace-shards-{uuid.uuid4().hex}"
    placed, n = place(pack(docs, tokenizer, seq_len), key, per_shard)
    write_shards(placed, n, path, per_shard)
    with open(tokenizer, "rb") as file:
        width = Encoder(tokenizer, file.read()).dtype.itemsize
    stride = seq_len * width + len(END)
    manifest = placed.select(
        "slot",
        "shard",
        ((F.col("slot") % per_shard) * stride).alias("byte_offset"),
        "n_tokens",
        F.transform("spans", lambda s: s.doc_id).alias("doc_ids"),
        "spans",
        "sha256",
    )
    return manifest, path


def read_shards(spark: SparkSession, path: str, seq_len: int = 2048, width: int = 2, first_shard: int = 0) -> DataFrame:
    """shard, place and ids (array<int>) of the records, from first_shard on."""
    stride = seq_len * width + len(END)
    files = spark.read.format("binaryFile").load(path + "/part-*")
    shard = F.regexp_extract("path", r"part-(\d+)-[^/]*$", 1).cast("int").alias("shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("shard", pa.int32()), ("place", pa.int32()), ("ids", pa.list_(pa.int32()))])
        for b in batches:
            for number, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = content.as_py()
                record = np.dtype([("ids", f"<u{width}", (seq_len,)), ("end", "S2")])
                table = np.frombuffer(raw[: len(raw) // stride * stride], dtype=record)["ids"].astype(np.int32)
                for at in range(0, len(table), 1024):
                    some = [{"shard": number, "place": at + i, "ids": x} for i, x in enumerate(table[at : at + 1024])]
                    yield pa.RecordBatch.from_pylist(some, kind)

    return files.select(shard, "content").where(F.col("shard") >= first_shard).mapInArrow(run, "shard int, place int, ids array<int>")
