"""Suffix-array dedup by column-wise multi-document construction.

Removes every byte covered by a string of SPAN bytes that also starts anywhere else.

Anchors. Every window of SPAN bytes has one anchor: the position of the smallest hash
among its GRAM-byte substrings. Equal windows have equal anchors at equal distance, so a
repeated window's anchor hash is repeated, and only the surroundings of repeated anchors
can hold repeats. A region is the text around an anchor that all windows with this anchor
lie in; regions of equal anchors are aligned at it.

Columns. A task takes the regions of its anchors as a collection of documents and builds
their suffix order column by column from the right: each round inserts one symbol per
document, which turns the order of the suffixes one symbol shorter into the order with it
by one stable pass over that column's transform (the symbols in the last order), and the
common prefixes of neighbours follow from the last round's by range minima. As regions
are aligned, a suffix is only compared with those of its own column, so the round's
transform, order and prefixes are all that need be held: they are streamed from round to
round instead of kept in files. Where neighbours have SPAN common bytes, both repeat.

Skew. Equal texts are one text, named by 128 bits of its SHA-256: with a copy, all of a
text of SPAN bytes or more goes. A collection takes all regions of its anchors. Where that
would be more than LARGEST different ones (a line in a third of a large corpus), the
anchor is halved, again and again: the windows that start in either half of the range of
distances to the anchor become a part of their own, named by the bytes that all of them
share, and equal parts become one. So windows inside a common passage collapse, and those
that reach out of it part by what is around; a range of one distance is a single window,
of which only one is left. No window is lost: equal windows have equal distances.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from marquee.llm.common import settle, settle_alone, table

SPAN = 200
GRAM = 64
LARGEST = 2048  # different regions of one anchor in a suffix order; with more, it is halved
COLLECTION = 16_384  # regions of one suffix order
REGIONS_A_PARTITION = 60_000

_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of every substring of gram (a power of two) bytes, by doubling."""
    h = (data.astype(np.uint64) + np.uint64(1)) * _MULT
    h ^= h >> np.uint64(29)
    n = 1
    while n < gram:
        right = h[n:]
        h = h[:-n] * _MIX + (right ^ right >> np.uint64(31))
        h ^= h >> np.uint64(27)
        h *= _MULT
        n *= 2
    return h


def anchors(data: bytes, span: int = SPAN, gram: int = GRAM):
    """(positions, hashes, firsts, lasts) of the anchors, and of the windows' starts that each is the anchor of.

    A window's anchor is the leftmost of its least hashes (of 44 bits; the rest settles nothing).
    """
    out = []
    step = (1 << 20) - span
    for base in range(0, max(1, len(data) - span + 1), step):
        part = data[base:base + step + span - 1]
        if len(part) < span:
            continue
        h = gram_hashes(np.frombuffer(part, np.uint8), gram)
        n, width = len(h), span - gram + 1
        key = h >> np.uint64(20) << np.uint64(20) | np.arange(n, dtype=np.uint64)
        rows = -(-n // width)
        padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
        padded[:n] = key
        grid = padded.reshape(rows, width)
        before = np.minimum.accumulate(grid, axis=1).ravel()
        after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        low = np.minimum(after[: n - width + 1], before[width - 1:n])
        first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        last = np.concatenate([first[1:], [len(low)]]) - 1
        at = (low[first] & np.uint64((1 << 20) - 1)).astype(np.int64)
        out.append((at + base, h[at], first + base, last + base))
    if not out:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out))


def columns_of(regions: list[bytes], leads: np.ndarray, span: int, gram: int) -> np.ndarray:
    """Regions as rows, aligned at their anchors; 0xFF, which no UTF-8 text holds, where a region has no byte."""
    width = 2 * span - gram
    out = np.full((len(regions), width), 0xFF, np.uint8)
    for k, (r, lead) in enumerate(zip(regions, leads.tolist())):
        at = span - gram - lead
        out[k, at:at + len(r)] = np.frombuffer(r, np.uint8)
    return out


def repeated_starts(matrix: np.ndarray, span: int, gram: int) -> np.ndarray:
    """For each document (row) and window start (column), whether another row has the same span bytes there.

    Column-wise construction: symbols are inserted from the last column on; `order` is
    the suffix order of all rows, `common` the common prefix of each with the one before.
    """
    n, width = matrix.shape
    starts = span - gram + 1
    hits = np.zeros((starts, n), bool)
    if n < 2:
        return hits.T
    columns = np.ascontiguousarray(matrix.T)
    order = np.arange(n)
    common = np.zeros(n, np.uint8)
    levels = max(1, int(n).bit_length())
    minima = np.zeros((levels, n), np.uint8)
    log = np.zeros(n + 1, np.int64)
    for k in range(2, n + 1):
        log[k] = log[k >> 1] + 1
    cap = np.uint8(span)
    for col in range(width - 1, -1, -1):
        transform = columns[col][order]
        move = np.argsort(transform, kind="stable")
        symbols = transform[move]
        gap = np.diff(move)
        same = (symbols[1:] == symbols[:-1]) & (symbols[1:] != 0xFF)
        minima[0] = common
        top = int(log[gap[same].max()]) if same.any() else 0
        for k in range(1, top + 1):
            half = 1 << k - 1
            minima[k, : n - half] = np.minimum(minima[k - 1, : n - half], minima[k - 1, half:])
        at = np.flatnonzero(same)
        a, b = move[at] + 1, move[at + 1]
        k = log[b - a + 1]
        least = np.minimum(minima[k, a], minima[k, b - (1 << k) + 1])
        common = np.zeros(n, np.uint8)
        common[at + 1] = np.minimum(least, cap - np.uint8(1)) + np.uint8(1)
        order = order[move]
        if col < starts:
            full = common >= cap
            hits[col, order[full]] = True
            hits[col, order[:-1][full[1:]]] = True
    return hits.T


def runs(hits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of the runs of true columns."""
    edge = np.zeros((hits.shape[0], hits.shape[1] + 2), np.int8)
    edge[:, 1:-1] = hits
    d = np.diff(edge, axis=1)
    row, first = np.nonzero(d == 1)
    _, past = np.nonzero(d == -1)
    return row, first, past - 1


def text_name(text: str) -> Column:
    """What names a text in Spark: 128 bits of its SHA-256; null is empty text."""
    return F.unhex(F.substring(F.sha2(F.coalesce(F.col(text), F.lit("")), 256), 1, 32))


def read_texts(docs: DataFrame, id_col: str, text_col: str, span: int, gram: int) -> DataFrame:
    """(id_col, name, n_bytes, sha256, hashes, positions): each text's name, and its anchors."""
    schema = docs.select(id_col).schema.add("name", "binary").add("n_bytes", "long").add("sha256", "string")
    schema = schema.add("hashes", ArrayType(LongType())).add("positions", ArrayType(LongType()))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                raw = [(t or "").encode() for t in b.column(1).to_pylist()]
                digests = [hashlib.sha256(x) for x in raw]
                found = [anchors(x, span, gram)[:2] for x in raw]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([d.digest()[:16] for d in digests], pa.binary()), pa.array(map(len, raw), pa.int64()),
                     pa.array([d.hexdigest() for d in digests], pa.string()),
                     pa.array([h.view(np.int64) for _, h in found], pa.list_(pa.int64())), pa.array([p for p, _ in found], pa.list_(pa.int64()))],
                    names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def cut_regions(candidates: DataFrame, span: int, gram: int, large: bool) -> DataFrame:
    """(key, name, start, lead, region) of the repeated anchors, large or not, that candidates (name, text, places) list."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                out = []
                for name, text, positions in zip(*(b.column(k).to_pylist() for k in range(3))):
                    data, wanted = text.encode(), set(positions)
                    for p, h, first, last in zip(*(x.tolist() for x in anchors(data, span, gram))):
                        if p in wanted:
                            out.append((np.uint64(h).astype(np.int64), name, first, p - first, data[first:last + span]))
                if out:
                    cols = list(zip(*out))
                    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.array(cols[0], np.int64)), *(pa.array(c, k) for c, k in zip(cols[1:], kinds))],
                        names=["key", "name", "start", "lead", "region"])

    positions = F.transform(F.filter("places", lambda x: x["large"] == large), lambda x: x["pos"])
    wanted = candidates.select("name", "text", positions.alias("positions")).where(F.size("positions") > 0)
    return wanted.mapInArrow(run, "key long, name binary, start long, lead long, region binary")


def column_wise(regions: DataFrame, n: int, span: int, gram: int) -> DataFrame:
    """(name, first, last) of repeated window starts of n regions (key, name, start, lead, region); only those of one key are compared."""
    parts = max(int(regions.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // REGIONS_A_PARTITION))

    def run(batches):
        held = []

        def found(rows):
            _, docs, starts, leads, texts = zip(*rows)
            starts, leads = np.array(starts), np.array(leads)
            row, first, last = runs(repeated_starts(columns_of(texts, leads, span, gram), span, gram))
            shift = starts[row] - (span - gram - leads[row])
            return pa.RecordBatch.from_arrays(
                [pa.array([docs[k] for k in row.tolist()], pa.binary()), pa.array(first + shift, pa.int64()), pa.array(last + shift, pa.int64())], names=["name", "first", "last"])

        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                held += zip(*(c.to_pylist() for c in whole.slice(at, 4096).columns))
                if len(held) > COLLECTION:
                    cut = len(held) - 1
                    while cut > 0 and held[cut - 1][0] == held[-1][0]:
                        cut -= 1
                    if cut:
                        yield found(held[:cut])
                        held = held[cut:]
        if held:
            yield found(held)

    dealt = regions.select("key", "name", "start", "lead", "region").repartition(parts, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "name binary, first long, last long")


def halves(parts: DataFrame, span: int) -> DataFrame:
    """Each part as the parts of its windows at the lower and the upper distances to the anchor, those without windows left out."""
    middle = F.floor((F.col("low") + F.col("high")) / 2)
    split = parts.withColumn("half", F.explode(F.array(
        F.struct(F.col("low").alias("low"), middle.alias("high")), F.struct((middle + 1).alias("low"), F.col("high").alias("high")))))
    # starts in the region of the half's windows: their distance to the anchor, at lead, is in the half's range
    split = split.withColumn("first", F.greatest(F.lit(0), F.col("lead") - F.col("half.high"))).withColumn(
        "last", F.least(F.length("region") - span, F.col("lead") - F.col("half.low"))).where("first <= last")
    cut = lambda c, at, n: F.substring(c, (at + 1).cast("int"), n.cast("int"))
    split = split.select(
        "parent", (F.col("shift") + F.col("first")).alias("shift"), "key", F.col("half.low").alias("low"), F.col("half.high").alias("high"), "n",
        (F.col("lead") - F.col("first")).alias("lead"), cut("region", F.col("first"), F.col("last") - F.col("first") + span).alias("region"))
    core = cut("region", F.col("lead") - F.col("low"), F.lit(span) - (F.col("high") - F.col("low")))
    return split.withColumn("key", F.xxhash64("key", "low", core)).withColumn("part", F.unhex(F.md5("region")))


def halved(regions: DataFrame, span: int, gram: int) -> DataFrame:
    """(name, found): column_wise's runs, as an array for each region, of anchors whose regions are too many for a collection.

    Each round takes the collections that have become small enough and halves the rest;
    there are at most as many rounds as halvings of the windows an anchor can have.
    """
    named = regions.withColumn("part", F.unhex(F.md5("region")))
    live = named.groupBy("key", "part").agg(F.count("*").alias("n"), F.first("lead").alias("lead"), F.first("region").alias("region")).select(
        F.col("part").alias("parent"), F.lit(0).cast("long").alias("shift"), "key", F.lit(0).cast("long").alias("low"), F.lit(span - gram).cast("long").alias("high"),
        "n", "lead", "region", "part")
    found = None
    while True:
        live = settle(live, "live")
        parts = live.groupBy("key", "part").agg(
            F.sum("n").alias("n"), *[F.first(c).alias(c) for c in ("low", "high", "lead", "region")])
        sizes = parts.groupBy("key").agg((F.count("*") > LARGEST).alias("large"))
        parts = settle(parts.join(sizes, "key"), "parts")
        fit = parts.where("not large").select("key", F.col("part").alias("name"), F.lit(0).cast("long").alias("start"), "lead", "region")
        small = column_wise(fit, fit.count(), span, gram)
        # a part that occurs twice is repeated as a whole; it stays, once, as evidence against others
        whole = parts.where("n > 1").select(F.col("part").alias("name"), F.lit(0).cast("long").alias("first"), (F.length("region") - span).cast("long").alias("last"))
        now = live.where("parent is not null").join(small.unionAll(whole), F.col("part") == F.col("name")).select(
            "parent", (F.col("shift") + F.col("first")).alias("first"), (F.col("shift") + F.col("last")).alias("last"))
        now = settle(now, "found")
        found = now if found is None else found.unionAll(now)
        rest = parts.where("large")
        if rest.isEmpty():
            break
        alone = live.join(rest.where("n = 1").select("key", "part"), ["key", "part"], "left_semi")
        evidence = rest.where("n > 1").select(*[F.lit(None).cast("binary").alias(c) if c == "parent" else F.lit(0).cast("long").alias(c) if c == "shift" else F.col(c) for c in live.columns])
        live = halves(alone.unionByName(evidence), span)
    found = found.groupBy("parent").agg(F.collect_list(F.struct("first", "last")).alias("found"))
    # a content may stand in a text many times, and in many texts: one row a text and content
    members = named.groupBy("name", F.col("part").alias("parent")).agg(F.collect_list("start").alias("starts"))
    moved = F.flatten(F.transform("starts", lambda at: F.transform("found", lambda x: F.struct((at + x["first"]).alias("first"), (at + x["last"]).alias("last")))))
    return members.join(found, "parent").select("name", moved.alias("found"))


def trim(candidates: DataFrame, span: int, as_text: bool) -> DataFrame:
    """(name, kept, n_removed, spans) from (name, text, found): the text without its covered bytes.

    kept holds bytes, or, as text, the characters that are left whole at the cuts.
    """
    kind = "string" if as_text else "binary"
    pair = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                kept, removed, spans = [], [], []
                for text, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                    data, done, parts, mine = text.encode(), 0, [], []
                    for x in sorted((f["first"], f["last"] + span) for f in found):
                        if mine and x[0] <= mine[-1]["stop"]:
                            mine[-1]["stop"] = max(mine[-1]["stop"], x[1])
                        else:
                            mine.append({"start": x[0], "stop": x[1]})
                    for m in mine:
                        parts.append(data[done:m["start"]])
                        done = m["stop"]
                    parts.append(data[done:])
                    # a part is valid but for characters that the cuts have broken, at its ends
                    kept.append("".join(x.decode(errors="ignore") for x in parts) if as_text else b"".join(parts))
                    removed.append(len(data) - sum(map(len, parts)))
                    spans.append(mine)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(kept, pa.string() if as_text else pa.binary()), pa.array(removed, pa.int64()), pa.array(spans, pair)], names=["name", "kept", "n_removed", "spans"])

    return candidates.select("name", "text", "found").mapInArrow(run, f"name binary, kept {kind}, n_removed long, spans array<struct<start long, stop long>>")


def find_repeats(docs: DataFrame, *, id_col="doc_id", text_col="text", span: int = SPAN, gram: int = GRAM, as_text: bool = False) -> tuple[DataFrame, DataFrame]:
    """(texts, cuts): a row (id_col, name, n_bytes, sha256) for each row of docs, and for each text that loses bytes (name, copied, kept, n_removed, spans).

    All but copied is null where the text has a copy: then all of it goes.
    """
    texts = settle(read_texts(docs, id_col, text_col, span, gram), "texts")
    classes = settle(texts.where(F.col("n_bytes") >= span).groupBy("name").agg(
        F.min(id_col).alias("rep"), (F.count("*") > 1).alias("copied"), F.first("hashes").alias("hashes"), F.first("positions").alias("positions")), "classes")
    each = classes.select("name", "rep", F.explode(F.arrays_zip("hashes", "positions")).alias("a")).select(
        "name", "rep", F.col("a.hashes").alias("hash"), F.col("a.positions").alias("pos"))
    repeated = settle(each.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash", "n", (F.col("n") > LARGEST).alias("large")), "anchors")
    places = each.join(repeated.drop("n"), "hash").groupBy("name", "rep").agg(F.collect_list(F.struct("pos", "large")).alias("places"))
    # one row of each text that has places: that of its name and smallest id, of which there is more than one only in repeated rows
    key = lambda name, rep: F.concat(F.hex(name), F.lit("/"), F.coalesce(F.col(rep).cast("string"), F.lit("")))
    rows = docs.select(key(text_name(text_col), id_col).alias("key"), F.col(text_col).alias("text"))
    candidates = settle(rows.join(places.select(key("name", "rep").alias("key"), "name", "places"), "key").dropDuplicates(["key"]).drop("key"), "candidates")
    few, many = repeated.agg(F.sum(F.when(~F.col("large"), F.col("n"))), F.count(F.when(F.col("large"), 1))).first()
    found = column_wise(cut_regions(candidates, span, gram, False), few or 0, span, gram).select("name", F.array(F.struct("first", "last")).alias("found"))
    if many:
        found = found.unionAll(halved(settle(cut_regions(candidates, span, gram, True), "regions"), span, gram))
    found = found.groupBy("name").agg(F.flatten(F.collect_list("found")).alias("found"))
    trimmed = trim(candidates.join(found, "name"), span, as_text)
    cuts = classes.select("name", "copied").join(trimmed, "name", "left").where("copied or n_removed > 0").select(
        "name", "copied", *[F.when(~F.col("copied"), F.col(c)).alias(c) for c in ("kept", "n_removed", "spans")])
    return texts.select(id_col, "name", "n_bytes", "sha256"), cuts


def remove_repeats(docs: DataFrame, *, id_col="doc_id", text_col="text", span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(id_col, n_bytes, sha256, n_removed, spans, kept) of every row.

    kept holds the remaining bytes only where some but not all are removed, else null;
    spans are the maximal removed runs; sha256 is the whole text's. Null is empty text.
    Texts shorter than span lose nothing, longer ones with a copy lose all. Repeated rows
    are copies. Texts are what is compared: null or repeated ids are rows like others.
    Other columns are left out. An empty table gives an empty one.
    """
    texts, cuts = find_repeats(docs, id_col=id_col, text_col=text_col, span=span, gram=gram)
    out = texts.join(cuts, "name", "left")
    copied = F.coalesce("copied", F.lit(False))
    all_of = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop")))
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    return out.select(
        id_col, "n_bytes", "sha256", F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copied, all_of).otherwise(F.coalesce("spans", none)).alias("spans"), F.when(copied, F.lit(b"")).otherwise(F.col("kept")).alias("kept"))


def without_repeats(docs: DataFrame, *, id_col="doc_id", text_col="text", length_col: str | None = "n_chars") -> DataFrame:
    """docs, all columns, with the remaining text; length_col, if there, is its new length.

    Characters that a cut breaks go; no others. A text of which all is repeated is empty,
    and its row stays, as do null and repeated ids and repeated rows. Null texts stay
    null. No column name clashes. An empty table gives an empty one.
    """
    cuts = settle_alone(docs.sparkSession, "cuts", lambda: find_repeats(docs, id_col=id_col, text_col=text_col, as_text=True)[1])
    packed = docs.select(F.struct(*docs.columns).alias("row"), text_name(text_col).alias("name"))
    out = packed.join(cuts.select("name", F.coalesce("kept", F.lit("")).alias("kept"), F.lit(True).alias("cut")), "name", "left")
    columns = []
    for c in docs.columns:
        old = F.col("row")[c]
        new = {text_col: F.col("kept"), length_col: F.char_length("kept").cast(docs.schema[c].dataType) if c == length_col else None}.get(c)
        columns.append((old if new is None else F.when(F.col("cut"), new).otherwise(old)).alias(c))
    return out.select(*columns)


def op9_repeats(spark, sf_dir):
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_bytes", F.col("n_removed").cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.when(F.col("kept").isNull(), F.col("sha256")).otherwise(F.sha2("kept", 256)).alias("kept_sha256"))
