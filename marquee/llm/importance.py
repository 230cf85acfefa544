"""Importance resampling towards a target distribution of hashed n-grams.

A feature is a run of words; its bucket is its CRC-32 modulo `buckets`. Each document is
normalised to words with one space behind each and scanned once, and the CRC register is
stored at every word's start and end. Registers are linear over GF(2): with P the register
of a prefix and M the operator that a byte of zeros applies to it,

    crc(b) = P(ab) ^ M^|b| (P(a) ^ ones) ^ ones

so the CRC of any run, of any number of words, comes from the two prefixes at its ends,
and no run is hashed itself. M^n is looked up for n < 64 and made of squares of M beyond.

Bucket ids of all features are settled once (a scan of whole texts is paid once) and read
twice: for the corpus's bucket counts, of which each task sends one row a bucket, and for
each document's sum of gains. The draw is a Gumbel top-k: rows are range-sorted by score,
numbered inside their partition and shifted by the rows of the partitions before.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from marquee.llm.common import local_rows, settle, table

ONES = np.uint32(0xFFFFFFFF)
POLYNOMIAL = 0xEDB88320  # of CRC-32, reflected
COLUMNS = 512  # bytes of a row of the scan
SCAN_BYTES = 1 << 22  # bytes scanned at once
SLICE_BYTES = 1 << 22  # of texts whose words are held at once; one longer text is held alone
NEAR = 64  # shifts below this are one lookup


@lru_cache(1)
def byte_steps() -> np.ndarray:
    """The register after each byte from a register of 0."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, c >> 1 ^ np.uint32(POLYNOMIAL), c >> 1).astype(np.uint32)
    return c


def apply(op: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear operator, given as its values for each byte of the register (4, 256)."""
    return op[0][x & 255] ^ op[1][x >> 8 & 255] ^ op[2][x >> 16 & 255] ^ op[3][x >> 24]


@lru_cache(1)
def near_shifts() -> np.ndarray:
    """M^n for n < NEAR: (NEAR, 4, 256)."""
    bytes_of = np.arange(256, dtype=np.uint32)
    ops = [np.stack([bytes_of << np.uint32(8 * j) for j in range(4)])]
    for _ in range(NEAR - 1):
        ops.append(byte_steps()[ops[-1] & 255] ^ ops[-1] >> 8)
    return np.stack(ops)


@lru_cache(64)
def square_shift(k: int) -> np.ndarray:
    """M^(2^k)."""
    if 1 << k < NEAR:
        return near_shifts()[1 << k]
    half = square_shift(k - 1)
    return np.stack([apply(half, half[j]) for j in range(4)])


def shifted(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """M^n x: registers x after n bytes of zeros each."""
    flat, low = near_shifts().reshape(-1), (n % NEAR).astype(np.int64) * 1024
    x = flat[low + (x & 255)] ^ flat[low + (256 + (x >> 8 & 255))] ^ flat[low + (512 + (x >> 16 & 255))] ^ flat[low + (768 + (x >> 24))]
    k = NEAR.bit_length() - 1
    while len(n) and int(n.max()) >> k:
        at = np.flatnonzero(n >> k & 1)
        x[at] = apply(square_shift(k), x[at])
        k += 1
    return x


def running_crcs(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The CRC register (from 0) after the first at[i] bytes of data; at ascends.

    The bytes stand in rows of COLUMNS, all of which are scanned together, a column at a
    time; the registers at the rows' ends are then carried into the rows behind by
    doubling, with M to the power of the distance.
    """
    out = np.zeros(len(at), np.uint32)
    steps, carry = byte_steps(), np.uint32(0)
    for begin in range(0, len(data), SCAN_BYTES):
        part = data[begin:begin + SCAN_BYTES]
        rows = -(-len(part) // COLUMNS)
        block = np.zeros(rows * COLUMNS, np.uint8)
        block[:len(part)] = part
        block = np.ascontiguousarray(block.reshape(rows, COLUMNS).T)
        local = np.empty((COLUMNS, rows), np.uint32)
        state = np.zeros(rows, np.uint32)
        state[0] = carry
        for c in range(COLUMNS):
            state = steps[(state ^ block[c]) & 255] ^ state >> 8
            local[c] = state
        end, d, k = state.copy(), 1, COLUMNS.bit_length() - 1
        while d < rows:
            end[d:] ^= apply(square_shift(k), end[:-d])
            d, k = d * 2, k + 1
        before = np.concatenate([np.zeros(1, np.uint32), end[:-1]])  # the carry is in row 0's own registers
        lo, hi = np.searchsorted(at, [begin + 1, begin + len(part) + 1])
        r, c = np.divmod(at[lo:hi] - begin - 1, COLUMNS)
        out[lo:hi] = local[c, r] ^ shifted(before[r], c + 1)
        if hi < len(at):
            carry = running_end(local, before, len(part))
    return out


def running_end(local: np.ndarray, before: np.ndarray, n: int) -> np.uint32:
    r, c = divmod(n - 1, COLUMNS)
    return (local[c, r] ^ shifted(before[r:r + 1], np.array([c + 1])))[0]


@lru_cache(1)
def letters() -> np.ndarray:
    """Each byte as it stands in a word, 0 for what separates words."""
    b = np.arange(256)
    word = (b >= 0x80) | (b >= 0x30) & (b <= 0x39) | (b >= 0x61) & (b <= 0x7A)
    upper = (b >= 0x41) & (b <= 0x5A)
    return np.where(word, b, np.where(upper, b + 32, 0)).astype(np.uint8)


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts raw[offsets[i]:offsets[i + 1]]: the normalised bytes, each word's start and end in them, words a text."""
    low = letters()[raw]
    at = np.flatnonzero(low)
    first = np.ones(len(at), bool)
    first[1:] = np.diff(at) > 1
    begins = np.zeros(len(raw) + 1, bool)
    begins[offsets[:-1]] = True
    first |= begins[at]
    place = np.arange(len(at)) + np.cumsum(first) - 1
    starts = place[first]
    data = np.full(len(at) + len(starts), 32, np.uint8)
    data[place] = low[at]
    ends = np.append(starts[1:], len(data)) - 1
    words = np.diff(np.searchsorted(at[first], offsets))
    return data, starts, ends[:len(starts)], words


def run_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray, shortest: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """CRC-32 of all runs of shortest to longest words inside a text, by text, and how many a text has."""
    at = np.empty(2 * len(starts), np.int64)
    at[0::2], at[1::2] = starts, ends
    register = running_crcs(data, at)
    text = np.repeat(np.arange(len(words)), words)
    found, of = [], []
    for g in range(shortest, longest + 1):
        w = np.flatnonzero(text[:len(text) - g + 1] == text[g - 1:]) if g <= len(text) else np.zeros(0, np.int64)
        a, b = starts[w], ends[w + g - 1]
        found.append(register[2 * (w + g - 1) + 1] ^ shifted(register[2 * w] ^ ONES, b - a) ^ ONES)
        of.append(text[w])
    found, of = np.concatenate(found), np.concatenate(of)
    if longest > shortest:
        found = found[np.argsort(of, kind="stable")]
    return found, np.bincount(of, minlength=len(words))


def slices(column: pa.Array):
    """(first row, raw bytes, offsets) of runs of rows of about SLICE_BYTES; nulls are empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1)
        stop = min(stop, len(column))
        yield row, raw[offsets[row]:offsets[stop]], offsets[row:stop + 1] - offsets[row]
        row = stop


def hashed_runs(docs: DataFrame, *, id_col="doc_id", text_col="text", ngrams=(1, 1), buckets=10_000) -> DataFrame:
    """(id_col, n_words, n_features, buckets): the bucket of every run of ngrams[0] to ngrams[1] words of every row.

    Words are lower-cased (A-Z) runs of digits, Latin letters and bytes above 127. Null,
    empty and wordless texts have none. Texts count whole, repeats count, other columns
    are left out. One narrow pass.
    """
    schema = docs.select(id_col).schema.add("n_words", "long").add("n_features", "long").add("buckets", ArrayType(IntegerType()))

    def run(batches):
        for b in batches:
            for row, raw, offsets in slices(b.column(1)):
                data, starts, ends, words = word_spans(raw, offsets)
                crcs, each = run_crcs(data, starts, ends, words, *ngrams)
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(each)]).astype(np.int32), (crcs % np.uint32(buckets)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(row, len(words)), pa.array(words, pa.int64()), pa.array(each, pa.int64()), lists], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def bucket_counts(hashed: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n) over all rows of hashed_runs; a task sends one row a bucket that it has seen."""

    def run(batches):
        n = np.zeros(buckets, np.int64)
        for b in batches:
            n += np.bincount(b.column(0).flatten().to_numpy(zero_copy_only=False), minlength=buckets)
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(n[seen])], names=["bucket", "n"])

    return hashed.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of every bucket: floor(1000 ln) of its smoothed share in target over that in corpus."""
    spark = corpus.sparkSession
    counts = (
        spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
        .join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"]))
    sums = counts.agg(F.sum("s"), F.sum("t")).first()
    all_s, all_t = (F.lit(float((x or 0) + buckets)) for x in sums)
    ratio = (F.col("t") + 1.0) * all_s / ((F.col("s") + 1.0) * all_t)
    return counts.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))


def weighted(hashed: DataFrame, gains: np.ndarray, id_col: str) -> DataFrame:
    """(id_col, n_words, n_features, weight): the sum of the gains of each row's features. gains has one number a bucket."""
    schema = hashed.select(id_col, "n_words", "n_features").schema.add("weight", "long")

    def run(batches):
        for b in batches:
            lists = b.column(3)
            sums = np.concatenate([[0], np.cumsum(gains[lists.flatten().to_numpy(zero_copy_only=False)])])
            at = np.concatenate([[0], np.cumsum(b.column(2).to_numpy())])
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.diff(sums[at]), pa.int64())], names=schema.names)

    return hashed.select(id_col, "n_words", "n_features", "buckets").mapInArrow(run, schema)


def numbered(rows: DataFrame, *order) -> DataFrame:
    """rows with `number`: 1, 2, ... in the given order, over all partitions, without a one-task sort.

    One range exchange; what reaches the driver is one number a partition.
    """
    spark = rows.sparkSession
    ranged = settle(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranged")
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    before, shifts = 0, []
    for p, n in sorted(ranged.groupBy(part.alias("part")).count().collect()):
        shifts.append((p, before))
        before += n
    shift = local_rows(spark, shifts, _part=pa.int64(), _shift=pa.int64())
    return ranged.withColumn("_part", part).join(shift, "_part").withColumn("number", F.col("_shift") + within + 1).drop("_at", "_part", "_shift")


def resample(docs: DataFrame, target: DataFrame, *, id_col="doc_id", text_col="text", target_col="text", ngrams=(1, 1), buckets: int = 10_000,
             percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """(id_col, n_words, n_features, weight, score, rank) of every row of docs.

    weight is the sum of the bucket gains of the row's features, score adds Gumbel noise
    from a SHA-256 of seed and id, so that the highest scores are a draw without
    replacement in proportion to exp(weight / 1000). Of the N rows of least_words words
    or more, floor(percent * N / 100) are drawn; rank numbers them, ties go to the smaller
    id (null last), then to fewer features, and rows equal in all of that are numbered in
    any order. All others have a null rank. Null, empty and wordless texts weigh 0. Null
    ids take their noise from the text "". Repeated rows are rows of their own; other
    columns are left out, so names can't clash. No rows give no rows; an empty target
    gives gains against a uniform one.
    """
    hashed = settle(hashed_runs(docs, id_col=id_col, text_col=text_col, ngrams=ngrams, buckets=buckets), "hashed")
    of_target = hashed_runs(target.select(F.lit(0).alias("id"), target_col), id_col="id", text_col=target_col, ngrams=ngrams, buckets=buckets)
    gains = np.zeros(buckets, np.int64)
    for bucket, gain in bucket_gains(settle(bucket_counts(hashed, buckets), "buckets"), bucket_counts(of_target, buckets), buckets).collect():  # one number a bucket
        gains[bucket] = gain
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = settle(weighted(hashed, gains, id_col).withColumn("score", F.col("weight") + noise), "scored")
    able = F.col("n_words") >= least_words
    drawn = scored.where(able).count() * percent // 100
    ordered = numbered(scored, (~able).asc(), F.desc("score"), F.asc_nulls_last(id_col), F.asc("n_features"))
    return ordered.select(id_col, "n_words", "n_features", "weight", "score", F.when(F.col("number") <= drawn, F.col("number")).alias("rank"))


def op11_importance_resampling(spark, sf_dir):
    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


OP11_SQL = r"""
WITH RECURSIVE steps AS (
  SELECT list_transform(range(0, 256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
           lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), texts AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark
), words AS (
  SELECT kind, id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM texts
), counts AS (
  SELECT kind, id, w, count(*) AS n FROM words GROUP BY ALL
), vocabulary AS (
  SELECT w, hex(encode(w)) AS x FROM (SELECT DISTINCT w FROM counts)
), hashed AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(x) // 2), lambda i: ('0x' || substr(x, (2 * i + 1)::INT, 2))::BIGINT)),
                            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM vocabulary, steps
), features AS (
  SELECT kind, id, bucket, sum(n)::BIGINT AS n FROM counts JOIN hashed USING (w) GROUP BY ALL
), totals AS (
  SELECT coalesce(sum(n) FILTER (kind = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (kind = 'b'), 0)::DOUBLE AS t FROM features
), gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(sum(n) FILTER (kind = 'b'), 0)::DOUBLE + 1) * (any_value(s) + 10000)
                               / ((coalesce(sum(n) FILTER (kind = 'd'), 0)::DOUBLE + 1) * (any_value(t) + 10000))))::BIGINT AS gain
  FROM features, totals GROUP BY bucket
), weights AS (
  SELECT id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM features JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY id
), scored AS (
  SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || doc_id::VARCHAR)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM documents LEFT JOIN weights ON id = doc_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS able FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * able // 100 THEN place END::BIGINT AS rank FROM ranked
"""
