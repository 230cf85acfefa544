"""What several corpus operators share: tables, settled intermediates, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_rows(spark: SparkSession, rows: list[tuple], **kinds: pa.DataType) -> DataFrame:
    """A table of few rows, of columns of these Arrow types; unlike one made from Python objects, it is no work for Python workers."""
    columns = zip(*rows) if rows else [()] * len(kinds)
    return spark.createDataFrame(pa.table([pa.array(c, k) for c, k in zip(columns, kinds.values())], names=list(kinds)))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for intermediates, spark.checkpoint.dir.

    Where it is unset and Spark runs on one machine, a folder of that machine; on more
    than one, where executors couldn't read each other's files, it must be set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-settled-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Where settled tables go at present, if not in the shared folder itself.
_inner: ContextVar[str | None] = ContextVar("inner", default=None)


#: While it is set, Spark deletes the shuffle files of a write once it has ended.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _settled(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{_inner.get() or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back.

    Cuts the lineage at files that outlive any executor, so that what follows neither
    recomputes the Python work above it nor depends on shuffle files of lost executors.
    The write's own shuffle files are of no more use then and are deleted.
    """
    return _settled(df, name)[0]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def settle_alone(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What make returns, settled; all that it settled on the way is deleted then."""
    folder = f"{_inner.get() or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    outer = _inner.set(folder)
    try:
        made = make()
    finally:
        _inner.reset(outer)
    try:
        return settle(made, name)
    finally:
        _delete(spark, folder)


def marked(rows: DataFrame, key: Column, ids: DataFrame, bits: int = 24) -> DataFrame:
    """(row, maybe) of every row: row is a struct of its columns; maybe is true if key is among ids, and for few others.

    ids has one column; both sides are taken as longs. A bitmap of the ids' hashes goes to
    all executors. It has 2**(bits - 6) longs at most (4 MB by default) whatever ids holds;
    when many more ids fill it up, it marks ever more rows, up to all, so whoever asks must
    look up the marked rows exactly. A null key is marked or not, by chance.
    """
    place = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(1 << bits))
    word = lambda c: F.shiftright(place(c), 6)
    at = lambda c: place(c).bitwiseAND(F.lit(63)).cast("int")
    one = F.col(ids.columns[0])
    words = ids.groupBy(word(one).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), at(one))).alias("set"))
    placed = rows.select(F.struct("*").alias("row"), word(key).alias("at_word"), at(key).alias("at"))
    found = placed.join(F.broadcast(words), F.col("at_word") == F.col("word"), "left")
    return found.select("row", F.coalesce(F.call_function("getbit", "set", "at") == 1, F.lit(False)).alias("maybe"))


def forest(n: int, pairs) -> np.ndarray:
    """For each of n nodes a smaller or equal one of its component, by union of (rows, columns) batches."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            ra, rb = root[a], root[b]
            if (ra == rb).all():
                break
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while not (root[root] == root).all():
                root = root[root]
    return root


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Connected components of an undirected edge list of longs: (node, component).

    component is the smallest node id that is reachable. Alternates large-star and
    small-star steps over a settled edge table until no edge changes; every step is a
    grouped minimum (combined map-side) and a join back, so a hub costs its degree only.
    Nodes without edges don't appear. Null ends are dropped; self loops and repeats
    are harmless.
    """
    spark = edges.sparkSession
    now, path = _settled(
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .where("u is not null and v is not null and u != v").distinct(),
        "edges",
    )
    before = None
    while True:
        # large star: every larger neighbour of u goes to the smallest of u and its neighbours
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = (
            both.where("v > u").join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        )
        # small star: u's smaller neighbours, and u, go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        )
        last = path
        now, path = _settled(small, "edges")
        _delete(spark, last)
        mark = now.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if mark == before:
            break
        before = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def named_by_id(classes: DataFrame, groups: DataFrame) -> DataFrame:
    """classes (node, id, ...) with component_id: the smallest id of a class in the same component.

    groups: (node, component), of some nodes or all; the others are components of their
    own. Nodes name values, not ids, so that an id that stands for several values neither
    joins them nor multiplies rows.
    """
    found = classes.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = found.groupBy("component").agg(F.min("id").alias("component_id"))
    return found.join(least, "component").drop("component")
