"""Packing along a space-filling curve.

Each document's token ids are hashed into a count vector, projected to three dimensions
by fixed random signs, and put on a Hilbert curve. Documents are range-sorted by curve
key, with a hash of the id behind it so that any number of equal documents still spread
over partitions, and packed one behind another. A partition's stream is cut every
`capacity` ids, so only its last sequence is short; that one is cut into powers of two,
which need no padding.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import settle, table
from marquee.llm.token_counts import PATTERN, UNEVEN, byte_alphabet

HASHED = 1024  # buckets of the hashed count vector
DIMENSIONS, BITS = 3, 16
CACHE_ENTRIES = 200_000
TOKENS_A_PARTITION = 4_000_000


class Encoder:
    """Ids of the vocabulary file, with the text's special strings as the library has them by default."""

    def __init__(self, path: str):
        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        number = byte_alphabet()
        ranks = {bytes(map(number.__getitem__, t)): i for t, i in spec["model"]["vocab"].items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for t in special:
            ranks.pop(t.encode(), None)
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.kind = "<u2" if max([*ranks.values(), *special.values()]) < 65536 else "<u4"
        self.chunks = _Chunks(self)

    def packed(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def encode(self, text: str) -> bytes:
        if self.special is not None and self.special.search(text):
            return self.packed(self.encoding.encode(text, allowed_special="all"))
        if UNEVEN.search(text):
            return self.packed(self.encoding.encode_ordinary(text))
        first, *rest = text.split(" ")
        return self.packed(self.encoding.encode_ordinary(first)) + b"".join(map(self.chunks.__getitem__, rest))


class _Chunks(dict):
    """Ids of a chunk between spaces, with the space before it: the same wherever it stands."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, chunk: str) -> bytes:
        ids = self.encoder.packed(self.encoder.encoding.encode_ordinary(" " + chunk))
        if len(chunk) <= 64:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[chunk] = ids
        return ids


@lru_cache(1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(1)
def signs() -> np.ndarray:
    return np.random.default_rng(7).choice([-1.0, 1.0], (HASHED, DIMENSIONS))


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions on the Hilbert curve of integer points (n, d), by the transposed-axes method."""
    x = points.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << bits - 1
    while q > 1:
        low = q - 1
        for i in range(d):
            swap = (x[0] ^ x[i]) & low
            flip = (x[i] & q) != 0
            x[0] ^= np.where(flip, low, swap)
            x[i] ^= np.where(flip, 0, swap)
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << bits - 1
    while q > 1:
        t ^= np.where(x[d - 1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | x[i] >> b & 1
    return key


def curve_keys(ids: list[np.ndarray]) -> np.ndarray:
    """A curve key for each id sequence: alike sequences tend to lie near one another."""
    if not ids:
        return np.zeros(0, np.int64)
    v = np.stack([np.bincount(((x.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(22)).astype(np.int64), minlength=HASHED) for x in ids])
    v = np.sqrt(v)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    spread = 1 / (1 + np.exp(-1.7 * (v @ signs())))
    return hilbert(np.minimum((spread * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


def encode_for_packing(docs: DataFrame, vocabulary: str, *, id_col="doc_id", text_col="text", end_id: int = 0) -> DataFrame:
    """(id_col, key, tie, n, ids): ids with end_id behind them as bytes, and the curve key."""
    schema = docs.select(id_col).schema.add("key", "long").add("n", "long").add("ids", "binary")

    def run(batches):
        enc = encoder(vocabulary)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                raw = [enc.encode(t or "") + enc.packed([end_id]) for t in b.column(1).to_pylist()]
                ids = [np.frombuffer(x, enc.kind) for x in raw]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(curve_keys(ids), pa.int64()), pa.array(map(len, ids), pa.int64()), pa.array(raw, pa.binary())],
                    names=[id_col, "key", "n", "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, schema).withColumn("tie", F.xxhash64(F.col(id_col).cast("string")))


def pack_documents(docs: DataFrame, vocabulary: str, *, id_col="doc_id", text_col="text", capacity: int = 1024, end_id: int = 0) -> DataFrame:
    """Pieces of documents in sequences: (id_col, start, length, ids, doc_tokens, sequence_id, offset).

    ids are the piece's ids as little-endian unsigned 32-bit numbers. capacity is a power
    of two. Every id of every row, end_id included, is in exactly one piece. Null and
    empty texts are the end id alone. Repeated rows are packed once each. Sequences are
    full, or a power of two long. Other columns are left out, so their names can't clash.
    An empty table gives no pieces. sequence_id is partition << 40 | number.
    """
    coded = settle(encode_for_packing(docs, vocabulary, id_col=id_col, text_col=text_col, end_id=end_id), "packing")
    tokens = coded.agg(F.sum("n")).first()[0] or 0
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // TOKENS_A_PARTITION))
    ordered = coded.repartitionByRange(parts, "key", "tie").sortWithinPartitions("key", "tie", id_col)
    schema = docs.select(id_col).schema.add("start", "long").add("length", "long").add("ids", "binary").add("doc_tokens", "long").add("sequence_id", "long").add("offset", "long")

    def run(batches):
        kind = encoder(vocabulary).kind
        base, done, fill, held, out = TaskContext.get().partitionId() << 40, 0, 0, [], []
        id_pa = None

        def batch(rows):
            a, b, c, d, e, f = zip(*rows)
            return pa.RecordBatch.from_arrays(
                [pa.array(a, id_pa), pa.array(b, pa.int64()), pa.array([len(x) // 4 for x in c], pa.int64()), pa.array(c, pa.binary()),
                 pa.array(d, pa.int64()), pa.array(e, pa.int64()), pa.array(f, pa.int64())], names=schema.names)

        for b in batches:
            id_pa = b.schema.field(0).type
            for doc, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.frombuffer(raw, kind).astype("<u4").tobytes()
                n, at = len(ids) // 4, 0
                while at < n:
                    take = min(capacity - fill, n - at)
                    held.append((doc, at, ids[4 * at:4 * (at + take)], n, base | done, fill))
                    at, fill = at + take, fill + take
                    if fill == capacity:
                        out += held
                        held, fill, done = [], 0, done + 1
                        if len(out) >= 2000:
                            yield batch(out)
                            out = []
        # the last sequence, cut into powers of two
        size = 1 << max(0, fill.bit_length() - 1)
        used = 0
        for doc, at, ids, n, _, _ in held:
            while ids:
                take = min(size - used, len(ids) // 4)
                out.append((doc, at, ids[:4 * take], n, base | done, used))
                ids, at, used, fill = ids[4 * take:], at + take, used + take, fill - take
                if used == size:
                    done, used, size = done + 1, 0, 1 << max(0, fill.bit_length() - 1)
        if out:
            yield batch(out)

    return ordered.select(id_col, "ids").mapInArrow(run, schema)


def op10_packing(spark, sf_dir):
    import public_tokenizers

    pieces = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
