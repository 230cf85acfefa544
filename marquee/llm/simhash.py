"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits a seed are cut into blocks. In each block the anchors are the
words of a perfect covering code: a Hamming code over the block's leading 2^r - 1 bits,
and every value of the bits left over, so its covering radius is 1. Every value is within
that radius of one anchor, its home. A fingerprint is replicated to every anchor within
covering radius plus threshold: to the homes of all values one bit away. Two fingerprints
that differ in one bit of a block meet where a home meets replicas (reach 1); two that
differ in two bits meet where replicas meet replicas, at the home of the value between
them (reach 2). Whole fingerprints are compared per anchor.

op7 links at 3 of 64 bits: of two halves, one differs in at most one bit (pigeonhole), so
no pair is lost. Texts whose five-word shingles have a resemblance of 0.8 differ in about
15 % of bits, at random: near_duplicates takes as many blocks of reach 2 as let such a
pair meet with a stated probability (covering_plan), and then compares whole shingle sets.

Equal fingerprints are one row from the start, so groups of copies of any size cost one
fingerprint, and groups of near copies are joined by stars before pairs are sought
(link_components). Per-anchor comparison is an equi-join, which adaptive execution splits.
"""

from __future__ import annotations

import math
import re
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from marquee.llm.common import components, forest, marked, named_by_id, settle, table

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SEED = 42
SAMPLED, CROWD = 16, 5  # an anchor is crowded if CROWD groups meet there in one of SAMPLED nodes


def shingle_hashes(text: str | None, words: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle of lower-cased (A-Z) words, repeats included; fewer words: of them all; none: empty."""
    found = WORD.findall((text or "").encode().translate(LOWER))
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    k = min(words, len(found))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(found) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[k - 1:].tolist())], np.uint64)


def fold(hashes: np.ndarray) -> np.ndarray:
    """The fingerprint of each row of hashes: bit i is 1 if set in over half of them."""
    seeds, n = hashes.shape
    ones = np.zeros((seeds, 64), np.int64)
    for at in range(0, n, 1 << 14):
        part = np.ascontiguousarray(hashes[:, at:at + (1 << 14)].astype("<u8", copy=False))
        bits = np.unpackbits(part.view(np.uint8).reshape(seeds, -1, 8), axis=2, bitorder="little")
        ones += bits.sum(axis=1, dtype=np.uint16)
    return np.packbits(2 * ones > n, axis=1, bitorder="little").view("<u8")[:, 0]


def remixed(hashes: np.ndarray, seeds: int) -> np.ndarray:
    """A row of hashes a seed: the given ones, then remixed from them."""
    out = np.empty((seeds, len(hashes)), np.uint64)
    out[0] = hashes
    for s in range(1, seeds):
        g = (hashes ^ hashes >> np.uint64(31)) * np.uint64(2 * 0x9E3779B97F4A7C15 * s + 1 & (1 << 64) - 1)
        out[s] = g ^ g >> np.uint64(29)
    return out


def set_name(hashes: np.ndarray) -> list[int]:
    """Two longs that name a set of sorted hashes."""
    return np.frombuffer(xxhash.xxh128_digest(hashes.tobytes()), np.int64).tolist()


def fingerprints(docs: DataFrame, *, id_col="doc_id", text_col="text", words: int = 3, seeds: int = 1, distinct: bool = False) -> DataFrame:
    """(id_col, f0, f1, ...): a 64-bit fingerprint a seed, as longs. One narrow pass over whole texts.

    distinct: each shingle counts once, as in the similarity of sets; k1, k2 name the set,
    n is its size, text a hash of the text. Null and empty texts, and texts without words, have fingerprint zero.
    """
    schema = docs.select(id_col).schema
    for name in [*(f"f{s}" for s in range(seeds)), *(("k1", "k2", "n") if distinct else ())]:
        schema = schema.add(name, "long")
    if distinct:
        schema = schema.add("text", "long")

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                out, names = [], []
                for t in b.column(1).to_pylist():
                    h = shingle_hashes(t, words)
                    if distinct:
                        h = np.unique(h)
                        names.append([*set_name(h), len(h)])
                    out.append(fold(remixed(h, seeds)))
                cols = np.array(out, np.uint64).reshape(len(out), seeds).view(np.int64)
                if distinct:
                    cols = np.hstack([cols, np.array(names, np.int64).reshape(-1, 3)])
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in cols.T), *b.columns[2:]], names=schema.names)

    return docs.select(F.col(id_col), F.col(text_col), *([F.xxhash64(text_col)] if distinct else [])).mapInArrow(run, schema)


def code_bits(width: int) -> int:
    """Bits of a block that the Hamming code covers: the most of form 2^r - 1."""
    r = 1
    while (1 << r + 1) - 1 <= width:
        r += 1
    return (1 << r) - 1


def syndrome(block: np.ndarray, n: int) -> np.ndarray:
    """Position, from 1, of the bit that leads to the home anchor; 0 at an anchor. The parity checks of a Hamming code."""
    out = np.zeros_like(block)
    for bit in range(n):
        out ^= np.where(block >> np.uint64(bit) & np.uint64(1), np.uint64(bit + 1), np.uint64(0))
    return out


def home(block: np.ndarray, width: int) -> np.ndarray:
    """The anchor within radius 1: the codeword of the covered bits, and the other bits as they are."""
    s = syndrome(block, code_bits(width))
    return np.where(s > 0, block ^ np.uint64(1) << np.maximum(s, np.uint64(1)) - np.uint64(1), block)


def replicas(block: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor): the homes of all values at most one bit away, each once."""
    flips = np.array([0, *(1 << k for k in range(width))], np.uint64)
    anchors = home(block[:, None] ^ flips[None, :], width)
    anchors.sort(axis=1)
    new = np.ones_like(anchors, bool)
    new[:, 1:] = anchors[:, 1:] != anchors[:, :-1]
    return np.nonzero(new)[0], anchors[new]


def blocks(words: int, threshold: int) -> list[tuple[int, int]]:
    """(first bit, width) of the blocks: as few as leave at most one differing bit in some block."""
    n = -(-(threshold + 1) // 2)
    each = -(-n // words)
    cuts = [64 * k // each for k in range(each + 1)]
    return [(64 * w + a, b - a) for w in range(words) for a, b in zip(cuts, cuts[1:])]


def flip_rate(resemblance: float) -> float:
    """The share of bits in which two sets of like size and this resemblance are expected to differ."""
    return math.acos(2 * resemblance / (1 + resemblance)) / math.pi


def covering_plan(n: int, resemblance: float, recall: float) -> tuple[list[tuple[int, int]], int]:
    """Blocks for n fingerprints, and the seeds they need.

    The width goes with log2 n, so the chance meetings of a fingerprint stay as many at
    any size. There are as many blocks as let two texts of the resemblance differ in at
    most two bits of some block with probability `recall`.
    """
    width = max(16, math.ceil(math.log2(max(2, n))) + 4)
    p = flip_rate(resemblance)
    meet = sum(math.comb(width, k) * p ** k * (1 - p) ** (width - k) for k in range(3))
    count = max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))
    return [(width * k, width) for k in range(count)], -(-width * count // 64)


def block_values(f: list[np.ndarray], first: int, width: int) -> np.ndarray:
    """Bits first .. first + width of fingerprints of several words."""
    w, shift = divmod(first, 64)
    out = f[w] >> np.uint64(shift)
    if shift + width > 64:
        out = out | f[w + 1] << np.uint64(64 - shift)
    return out & np.uint64((1 << width) - 1)


def anchored(prints: DataFrame, plan: list[tuple[int, int]], carried: list[str], *, homes: bool) -> DataFrame:
    """(anchor, carried...) of each fingerprint at its home anchors, or at all anchors in reach."""
    words = 1 + max((first + width - 1) // 64 for first, width in plan)
    names = [f"f{w}" for w in range(words)]
    kept = prints.select(*carried)
    schema = kept.schema.add("anchors", ArrayType(LongType()))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                f = [b.column(len(carried) + w).to_numpy().view(np.uint64) for w in range(words)]
                rows, anchors = [], []
                for k, (first, width) in enumerate(plan):
                    part = block_values(f, first, width)
                    r, a = (np.arange(len(part)), home(part, width)) if homes else replicas(part, width)
                    rows.append(r)
                    anchors.append(a | np.uint64(k << width))
                rows = np.concatenate(rows)
                order = np.argsort(rows, kind="stable")
                ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=b.num_rows))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(anchors)[order].view(np.int64)))
                yield pa.RecordBatch.from_arrays([*b.columns[:len(carried)], lists], names=schema.names)

    return prints.select(*carried, *names).mapInArrow(run, schema).select(F.explode("anchors").alias("anchor"), *carried)


def hamming(left: str, right: str, names: list[str]) -> Column:
    """Bits in which two rows of columns f... differ."""
    return reduce(add, [F.bit_count(F.col(f"{left}.{n}").bitwiseXOR(F.col(f"{right}.{n}"))) for n in names])


def near_pairs(prints: DataFrame, *, threshold: int = 3, plan: list[tuple[int, int]], reach: int = 1, compared: int = 1) -> DataFrame:
    """(src, dst): nodes of (node, f0, ...) that meet at an anchor and differ in at most threshold bits of the first `compared` words.

    Rows are found if they differ in at most `reach` (1 or 2) bits of some block of the
    plan. Rows of one node don't meet; src is the smaller.
    """
    names = [f"f{w}" for w in range(compared)]
    spread = anchored(prints, plan, ["node", *names], homes=False)
    other = anchored(prints, plan, ["node", *names], homes=True) if reach == 1 else spread
    return (
        other.alias("a").hint("merge").join(spread.alias("b"), F.col("a.anchor") == F.col("b.anchor"))
        .where((F.col("a.node") < F.col("b.node")) & (hamming("a", "b", names) <= threshold))
        .select(F.col("a.node").alias("src"), F.col("b.node").alias("dst"))
    )


def star_links(rows: DataFrame, names: list[str], threshold: int) -> DataFrame:
    """(src, dst) from rows (anchor, node, f0, ...): rows of an anchor that are near its smallest node, linked to that node. A row gives one link at most."""
    spokes = rows.select("anchor", F.struct("node", *names).alias("spoke"))
    hubs = spokes.groupBy("anchor").agg(F.min("spoke").alias("hub"), F.max("spoke.node").alias("last")).where("hub.node != last").drop("last")
    near = spokes.join(hubs, "anchor").where((F.col("spoke.node") != F.col("hub.node")) & (hamming("spoke", "hub", names) <= threshold))
    return near.select(F.col("spoke.node").alias("src"), F.col("hub.node").alias("dst"))


def crowded_anchors(grouped: DataFrame, plan: list[tuple[int, int]]) -> DataFrame:
    """(anchor) where, by one in SAMPLED nodes of (node, group, f0, ...), nodes of many groups meet; by more of them if there are few nodes.

    It only says where stars are worth their shuffle: anchors of some 75 groups or more.
    At the dozen that meet by chance CROWD sampled ones are rare. Groups at other anchors
    lose nothing: they meet in near_pairs, in pairs whose number an anchor is bounded.
    """
    names = [c for c in grouped.columns if re.fullmatch(r"f\d+", c)]
    one_in = max(1, min(SAMPLED, grouped.count() // 200))
    some = grouped.where(F.pmod(F.xxhash64("node"), F.lit(one_in)) == 0).select("group", *names)
    met = anchored(some, plan, ["group"], homes=False).groupBy("anchor").agg(F.count_distinct("group").alias("groups"))
    return met.where(F.col("groups") >= CROWD).select("anchor")


def link_components(classes: DataFrame, *, threshold: int = 3, plan: list[tuple[int, int]] | None = None, reach: int = 1, compared: int = 1) -> DataFrame:
    """(node, component) of every node of classes (node, f0, ...; distinct) under the links of near_pairs.

    First each node is held against the smallest node of its home anchors, which joins
    most of a large group of near copies by a link a node and block. Where replicas meet
    replicas (reach 2) near copies often share no home, so the groups so far are then held
    against the smallest group of every crowded anchor in reach, twice. Then only links
    between different groups are sought at all anchors in reach: those within one would
    change nothing, and there may be as many as the square of its size.
    """
    plan = plan or blocks(compared, threshold)
    names = [c for c in classes.columns if re.fullmatch(r"f\d+", c)]
    near = names[:compared]
    first = components(star_links(anchored(classes, plan, ["node", *near], homes=True), near, threshold))
    grouped = settle(classes.join(first, "node", "left").select("node", F.coalesce("component", "node").alias("group"), *names), "groups")
    crowds = settle(crowded_anchors(grouped, plan), "crowds") if reach == 2 else None
    for _ in range(0 if crowds is None or crowds.isEmpty() else 2):
        spread = anchored(grouped.select(F.col("group").alias("node"), *names), plan, ["node", *near], homes=False)
        spread = marked(spread, F.col("anchor"), crowds).where("maybe").select("row.*").repartition("anchor")
        joined = components(star_links(spread, near, threshold)).withColumnRenamed("node", "group")
        grouped = settle(grouped.join(joined, "group", "left").select("node", F.coalesce("component", "group").alias("group"), *names), "groups")
    pairs = near_pairs(grouped.select(F.col("group").alias("node"), *names), threshold=threshold, plan=plan, reach=reach, compared=compared)
    second = components(pairs).withColumnRenamed("node", "group")
    return grouped.select("node", "group").join(second, "group", "left").select("node", F.coalesce("component", "group").alias("component"))


def simhash_groups(docs: DataFrame, *, id_col="doc_id", text_col="text", words: int = 3, threshold: int = 3) -> DataFrame:
    """(id_col, fingerprint, component_id) of every row.

    Rows link if their fingerprints differ in at most threshold bits; component_id is the
    smallest id reachable by links. Null and empty texts have fingerprint zero and link
    like any other. Ids are integers; rows with a null id form no links through it and get
    the component of their fingerprint. Repeated rows come out once each, and rows of one
    id with different texts are rows of their own, linked by their texts alone. Other
    columns are left out. An empty table gives an empty one.
    """
    prints = settle(fingerprints(docs, id_col=id_col, text_col=text_col, words=words), "fingerprints")
    # one node a fingerprint
    classes = prints.where(F.col(id_col).isNotNull()).groupBy("f0").agg(F.min(F.col(id_col).cast("long")).alias("id"))
    classes = settle(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    groups = link_components(classes.select("node", "f0"), threshold=threshold)
    named = named_by_id(classes, groups).select("f0", "component_id")
    return prints.join(named, "f0", "left").select(id_col, F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_sets(docs: DataFrame, wanted: DataFrame, *, id_col="doc_id", text_col="text", words: int = 5) -> DataFrame:
    """(group, tiles, tile, x) of wanted (node, group, tiles, tile, k1, k2, id, hash): x is the tile's nodes with their sets of distinct hashes.

    A node's set is of the text of docs with this id and hash that has the set named k1, k2; repeated rows give it once.
    Texts that a bitmap of the wanted ids rules out aren't shuffled.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash"))
    rows = marked(texts, F.col("id"), wanted.select("id")).where("maybe").select("row.*").join(wanted, ["id", "hash"])
    kept = ["node", "group", "tiles", "tile"]

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                found, sets = [], []
                for k, (t, *name) in enumerate(zip(*(b.column(c).to_pylist() for c in (4, 5, 6)))):
                    h = np.unique(shingle_hashes(t, words))
                    if set_name(h) == name:
                        found.append(k)
                        sets.append(h.view(np.int64))
                picked = pa.array(found, pa.int64())
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(picked) for k in range(4)), pa.array(sets, pa.list_(pa.int64()))], names=[*kept, "shingles"])

    sets = rows.select(*kept, "text", "k1", "k2").mapInArrow(run, "node long, group long, tiles long, tile long, shingles array<long>")
    return sets.groupBy("group", "tiles", "tile").agg(F.collect_set(F.struct("node", "shingles")).alias("x"))


def common_counts(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of x shares with each of y: products of 0/1 rows over the elements that occur twice."""
    sets = [*x, *y]
    _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    twice = times[place] > 1
    row, place = row[twice], (np.cumsum(times > 1) - 1)[place[twice]]
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    out = np.zeros((len(x), len(y)), np.float32)
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, 8192):
        a, b = np.searchsorted(place, [low, low + 8192])
        part = np.zeros((len(sets), min(8192, int(place[b - 1]) - low + 1)), np.float32)
        part[row[a:b], place[a:b] - low] = 1
        out += part[:len(x)] @ part[len(x):].T
    return out


def similar_sets(pairs: DataFrame, similarity: float) -> DataFrame:
    """(src, dst) from rows (x, y) of two tiles of (node, shingles): a spanning forest of the pairs of the similarity or more."""

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                tiles = [batch.column(k)[r].values for k in (0, 1)]
                node = np.concatenate([t.field(0).to_numpy() for t in tiles])
                x, y = ([s.values.to_numpy() for s in t.field(1)] for t in tiles)
                both = common_counts(x, y)
                size = lambda sets: np.array([len(s) for s in sets])
                near = both >= similarity * (size(x)[:, None] + size(y)[None, :] - both)
                a, c = np.nonzero(near)
                root = forest(len(node), [(a, c + len(x))])
                at = np.flatnonzero(node != node[root])
                yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(node[root[at]])], names=["src", "dst"])

    return pairs.select("x", "y").mapInArrow(run, "src long, dst long")


def compare_sets(tiles: DataFrame, similarity: float) -> DataFrame:
    """(src, dst): links that join whatever pairs of similarity or more join, within each group of (group, tiles, tile, x).

    A pair of tiles gives a spanning forest, not pairs. A group of one tile meets itself.
    In a larger one nodes are held against the group's hub, the node it is named by, first:
    those similar to it are linked to it and don't meet each other.
    """
    alone = tiles.where("tiles = 1").select("x", F.col("x").alias("y"))
    members = tiles.where("tiles > 1").select("group", "tiles", "tile", F.explode("x").alias("m"))
    hubs = members.where("m.node = group").select("group", F.col("m.shingles").alias("hub"))
    shared = F.size(F.array_intersect("m.shingles", "hub"))
    near = shared >= similarity * (F.size("m.shingles") + F.size("hub") - shared)
    held = members.join(hubs, "group").withColumn("near", near)
    dealt = settle(held.groupBy("group", "tiles", (F.col("tile") + F.when(F.col("near"), F.col("tiles")).otherwise(0)).alias("tile")).agg(F.collect_list("m").alias("x")), "tiles")
    left = dealt.where("tile < tiles").withColumn("other", F.explode(F.sequence("tile", F.col("tiles") * 2 - 1)))
    right = dealt.select("group", F.col("tile").alias("other"), F.col("x").alias("y"))
    met = left.join(right, ["group", "other"]).repartition("group", "tile", "other")
    stars = dealt.where("tile >= tiles").select(F.col("group").alias("src"), F.explode("x.node").alias("dst"))
    return similar_sets(alone, similarity).unionAll(similar_sets(met, similarity)).unionAll(stars)


def near_duplicates(docs: DataFrame, *, id_col="doc_id", text_col="text", words: int = 5, similarity: float = 0.8, recall: float = 0.99,
                    tile_sets: int = 256, tile_shingles: int = 65_536) -> DataFrame:
    """(id_col, component_id, text_hash): documents grouped by links of shingle-set resemblance `similarity` or more.

    Candidates are fingerprints that meet at an anchor; a pair of texts of exactly the
    similarity meets with a probability of about `recall`, closer pairs more surely
    (0.9997 at 0.85). Documents link only if their whole sets of shingles have the
    resemblance. Nulls, empty texts, repeated rows and ids as in simhash_groups. text_hash
    tells the rows of an id apart. An empty table gives an empty one.
    """
    n = docs.count()
    plan, seeds = covering_plan(n, similarity, recall)
    compared = 2
    rate = flip_rate(similarity)
    # of the bits compared, no more than a pair of the similarity reaches once in 10,000 times
    most = math.ceil(64 * compared * rate + 3.8 * math.sqrt(64 * compared * rate * (1 - rate)))
    names = [f"f{s}" for s in range(max(seeds, compared))]
    prints = settle(fingerprints(docs, id_col=id_col, text_col=text_col, words=words, seeds=len(names), distinct=True), "fingerprints")
    # one node a set; its text is looked up by the smallest id
    first = F.min(F.struct(F.col(id_col).cast("long").alias("id"), "text")).alias("first")
    classes = prints.where(F.col(id_col).isNotNull()).groupBy("k1", "k2", "n", *names).agg(first).select("k1", "k2", "n", *names, "first.*")
    classes = settle(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    groups = settle(link_components(classes.select("node", *names), threshold=most, plan=plan, reach=2, compared=compared), "candidates")
    # tiles of bounded numbers of sets and of shingles
    sizes = groups.join(classes.select("node", "n"), "node").groupBy("component").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles")).where("sets > 1")
    sizes = sizes.select("component", F.ceil(F.greatest(F.col("sets") / tile_sets, F.col("shingles") / tile_shingles, F.lit(1.0))).cast("long").alias("tiles"))
    wanted = groups.join(sizes, "component").join(classes, "node").select(
        "node", F.col("component").alias("group"), "tiles", F.pmod(F.xxhash64("node"), F.col("tiles")).alias("tile"), "k1", "k2", "id", F.col("text").alias("hash"))
    tiles = settle(shingle_sets(docs, settle(wanted, "wanted"), id_col=id_col, text_col=text_col, words=words), "sets")
    links = components(compare_sets(tiles, similarity))
    named = named_by_id(classes.select("k1", "k2", "node", "id"), links).select("k1", "k2", "component_id")
    return prints.select(id_col, "k1", "k2", "text").join(named, ["k1", "k2"], "left").select(id_col, "component_id", F.col("text").alias("text_hash"))


def one_of_each(docs: DataFrame, groups: DataFrame, *, id_col="doc_id", text_col="text") -> DataFrame:
    """The rows of docs, all columns, that are the smallest of their group; rows without an id stay.

    groups is near_duplicates of docs. Rows are told by id and text, so of an id with
    several texts each goes or stays for itself; of a smallest id and text that repeat all
    rows stay. Rows that groups doesn't name stay. An empty table gives an empty one.
    Only rows that a bitmap of the others' ids leaves open are shuffled to look them up.
    """
    extra = groups.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).cast("long").alias("extra"), "text_hash").distinct()
    rows = marked(docs, F.col(id_col), extra.select("extra"))
    same = (F.col("row")[id_col].cast("long") == F.col("extra")) & F.xxhash64(F.col("row")[text_col]).eqNullSafe(F.col("text_hash"))
    open_rows = rows.where("maybe").join(extra, same, "left_anti")
    return rows.where("not maybe").select("row.*").unionAll(open_rows.select("row.*"))


def op7_simhash(spark, sf_dir):
    return simhash_groups(table(spark, sf_dir, "documents"))
