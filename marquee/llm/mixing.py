"""Mixing sources to target weights by a time-varying curriculum.

Each source has a weight schedule over training time t in [0, 1], linear from `start` to
`end`. Its integral is the source's base weight, which sets its target number of words;
its running integral, scaled to the target, is the source's cumulative demand. Documents
of a source stand in a fixed hash order; the demand is met by going through that order,
and through it again once it is used up. A pass over a document starts at the time at
which the demand reaches the words before it: the inverse of the cumulative demand, a
quadratic's root. Passes are range-sorted by that time.

Prefix sums run over (source, hash bucket) groups, then over the buckets of a source, so
a source of any size spreads over many tasks. Targets are found from one row a source.
All of it is DataFrame operations.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.common import local_rows, settle, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
#: How a source's weight changes over the run, as shares of its base weight at t=0 and t=1 (mean 1).
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
BUCKET_HEX = 2  # hex digits of a bucket: 256 buckets a source, 16 times as many for each digit more
DOCS_A_BUCKET = 20_000
ADDED = ("source_size", "target", "taken", "passes", "position")


def ordinals(sources: DataFrame, name: str) -> DataFrame:
    """sources with `ordinal`: the rank of each row by code point, null last, without a one-task sort.

    Rows are range-partitioned and settled, ranked inside their partition, and shifted by
    the number of rows in the partitions before, which are at most as many as partitions.
    """
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = settle(
        sources.withColumn("_null", F.col(name).isNull()).repartitionByRange(parts, "_null", name)
        .withColumn("_part", F.spark_partition_id()), "sources")
    before, offsets = 0, []
    for part, n in sorted(ranged.groupBy("_part").count().collect()):
        offsets.append((part, before))
        before += n
    shift = local_rows(sources.sparkSession, offsets, _part=pa.int32(), _shift=pa.int64())
    rank = F.row_number().over(Window.partitionBy("_part").orderBy("_null", name)) - 1
    return ranged.withColumn("_rank", rank).join(shift, "_part").withColumn("ordinal", F.col("_shift") + F.col("_rank")).drop("_part", "_null", "_rank", "_shift")


def fill_targets(sources: DataFrame, *, size: str, weight: str, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sources with `target`: share of all sizes by weight, none above `most` times its size, the excess reshared.

    Each round is one aggregate: sources whose share is above their limit are set to it,
    and the rest share what is left, until none is above. Only two sums reach the driver.
    """
    limit = F.col(size) * F.lit(most)
    total = (sources.agg(F.sum(size)).first()[0] or 0) * share
    level, full = None, F.lit(False)
    while True:
        left = sources.agg(F.sum(F.when(full, limit)), F.sum(F.when(~full, F.col(weight))), F.count(F.when(full, 1))).first()
        capped, weights = left[0] or 0.0, left[1]
        if not weights or level == (capped, weights, left[2]):
            break
        level = (capped, weights, left[2])
        # w * (total - capped) / weights > limit, kept as products so that both sides are exact
        full = full | (F.col(weight) * F.lit(float(total - capped)) > limit * F.lit(float(weights)))
    if level is None:
        return sources.withColumn("target", F.lit(0.0))
    share_left = F.col(weight) * F.lit(float(total - level[0])) / F.lit(float(level[1]))
    return sources.withColumn("target", F.when(full, limit).otherwise(share_left).cast("double"))


def mix_sources(docs: DataFrame, *, id_col="doc_id", source_col="source", size_col="size", weights=WEIGHTS,
                schedules=SCHEDULES, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """docs with source_size, target, taken, position and passes.

    taken: the words of the document in the mix, repeats counted, at most `most` (2) times
    its size; a source's taken words are its target, rounded down. passes: the training
    time and words of each of its passes with words, in order; position: the first's time,
    null if there is none.
    A null source is a source of its own, the last. Null ids are ordered as the text "".
    Sizes null or 0 take nothing. Repeated rows are documents of their own. All columns
    of docs are kept, whatever their names, but for those named as an added one, which
    takes their place. An empty table gives an empty one. The order within a source is
    that of an MD5 of the id, the size and the other columns, so reruns agree; rows equal
    in all of them, and only those, always stand together.
    """
    if most != 2.0:
        raise ValueError("documents go through at most two passes")
    others = [c for c in docs.columns if c not in (id_col, source_col, size_col)]
    content = [F.xxhash64(*others).cast("string")] if others else []
    # rows travel as one column, so that their names can't clash with those used here
    sized = docs.select(
        F.struct(*docs.columns).alias("_mix_row"), F.col(source_col).alias("_mix_source"), F.col(id_col).alias("_mix_id"),
        F.coalesce(F.col(size_col).cast("long"), F.lit(0)).alias("_mix_size"),
        F.md5(F.concat_ws("/", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(size_col).cast("long"), F.lit(0)).cast("string"), *content)).alias("_mix_hash"))
    sums = sized.groupBy("_mix_source").agg(F.sum("_mix_size").alias("source_size"), F.count("*").alias("_mix_docs"))
    sources = ordinals(sums, "_mix_source")
    k = F.col("ordinal") % len(weights)
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (k + 1).cast("int"))
    sources = sources.withColumn("_mix_weight", pick(weights))
    sources = settle(
        fill_targets(sources, size="source_size", weight="_mix_weight", share=share, most=most)
        .withColumn("_mix_start", pick([s for s, _ in schedules])).withColumn("_mix_end", pick([e for _, e in schedules]))
        .drop("_mix_weight", "ordinal"), "targets")
    largest = sources.agg(F.max("_mix_docs")).first()[0] or 0
    digits = BUCKET_HEX
    while 16 ** digits * DOCS_A_BUCKET < largest:
        digits += 1
    keyed = sized.withColumn("_mix_bucket", F.substring("_mix_hash", 1, digits))
    buckets = keyed.groupBy("_mix_source", "_mix_bucket").agg(F.sum("_mix_size").alias("_mix_sum"))
    over = Window.partitionBy("_mix_source").orderBy("_mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("_mix_before", F.coalesce(F.sum("_mix_sum").over(over), F.lit(0)))
    starts = buckets.alias("b").join(sources.alias("s"), F.col("b._mix_source").eqNullSafe(F.col("s._mix_source"))).select(
        "b._mix_source", "b._mix_bucket", "_mix_before", "source_size", "target", "_mix_start", "_mix_end")
    within = Window.partitionBy("_mix_source", "_mix_bucket").orderBy("_mix_hash", "_mix_id", "_mix_size").rowsBetween(Window.unboundedPreceding, -1)
    out = keyed.withColumn("_mix_within", F.coalesce(F.sum("_mix_size").over(within), F.lit(0))).alias("d").join(
        starts.alias("b"), F.col("d._mix_source").eqNullSafe(F.col("b._mix_source")) & (F.col("d._mix_bucket") == F.col("b._mix_bucket"))
    ).select("d.*", "_mix_before", "source_size", "target", "_mix_start", "_mix_end")
    first = F.col("_mix_before") + F.col("_mix_within")
    wanted = F.floor("target")
    overlap = lambda at: F.greatest(F.least(wanted - at, F.col("_mix_size")), F.lit(0))
    a, b = F.col("_mix_start"), F.col("_mix_end")
    # demand(t) = target * (a t + (b - a) t^2 / 2) / ((a + b) / 2), solved for t
    def when(at):
        need = at / F.col("target") * (a + b) / 2
        return F.when(a == b, need / a).otherwise((F.sqrt(F.greatest(a * a + 2 * (b - a) * need, F.lit(0.0))) - a) / (b - a))

    passes = F.array(*[
        F.when(overlap(at) > 0, F.struct(when(at).alias("position"), overlap(at).cast("long").alias("words")))
        for at in (first, first + F.col("source_size"))])
    out = (
        out.withColumn("taken", (overlap(first) + overlap(first + F.col("source_size"))).cast("long"))
        .withColumn("passes", F.filter(passes, lambda x: x.isNotNull()))
        .withColumn("position", F.get("passes", F.lit(0))["position"])
    )
    return out.select(*[F.col("_mix_row")[c].alias(c) for c in docs.columns if c not in ADDED], *ADDED)


def training_order(mixed: DataFrame, *, id_col="doc_id") -> DataFrame:
    """One row a pass, range-sorted by training position, with `pass` (0, 1), its `position` and its `words`.

    mixed is a result of mix_sources. Columns of these names are replaced; rows without
    passes are left out; ties are broken by the id, then the pass. No rows give none.
    """
    columns = [c for c in mixed.columns if c not in ("passes", "position", "pass", "words")]
    rows = mixed.select(*columns, F.posexplode("passes").alias("pass", "_mix_at"))
    return rows.select(*columns, "pass", F.col("_mix_at.position").alias("position"), F.col("_mix_at.words").alias("words")).orderBy("position", id_col, "pass")


def mixed_documents(docs: DataFrame, *, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """The mix as documents in training order: a row a pass, the columns of docs.

    A pass that takes a part of a document keeps its first words, joined by single spaces.
    Documents of which the mix takes no word, so null and empty texts, are left out. Null
    ids and sources, repeated rows and ties as in mix_sources and training_order; no
    column name clashes. An empty table gives an empty one.
    """
    size = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")
    packed = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), F.struct(*docs.columns).alias("row"))
    order = training_order(mix_sources(packed, id_col="id", size_col="size"), id_col="id")
    text = F.col("row")[text_col]
    part = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), F.lit(1), F.col("words").cast("int")), " ")
    kept = F.when(F.col("words") < F.col("size"), part).otherwise(text)
    return order.select(*[(kept if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])


def op3_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    return mix_sources(docs).orderBy("position", "doc_id").select("doc_id", "size", "source_size", "target", "taken", "position")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w,
         [1.5, 1.0, 0.5][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS a,
         [0.5, 1.0, 1.5][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS b
  FROM d GROUP BY source
), r AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS total,
         coalesce(sum(2 * source_size) OVER (ORDER BY source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS capped,
         sum(w) OVER (ORDER BY source_size / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS weights
  FROM s
), l AS (
  SELECT capped, weights FROM r WHERE w * (total - capped) <= 2 * source_size * weights ORDER BY source_size / w, source LIMIT 1
), t AS (
  SELECT r.source, source_size, a, b, CASE WHEN w * (total - l.capped) > 2 * source_size * l.weights THEN 2.0 * source_size
         ELSE w * (total - l.capped) / l.weights END::DOUBLE AS target
  FROM r, l
), c AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, a, b, floor(t.target) AS wanted,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(d.doc_id::VARCHAR, '') || '/' || d.size::VARCHAR), d.doc_id, d.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), p AS (
  SELECT *, greatest(least(wanted - ahead, size), 0) AS one, greatest(least(wanted - ahead - source_size, size), 0) AS two FROM c
), n AS (
  SELECT *, CASE WHEN one > 0 THEN ahead WHEN two > 0 THEN ahead + source_size END / target * (a + b) / 2 AS need FROM p
)
SELECT doc_id, size, source_size, target, (one + two)::BIGINT AS taken,
       CASE WHEN need IS NULL THEN NULL WHEN a = b THEN need / a ELSE (sqrt(greatest(a * a + 2 * (b - a) * need, 0.0)) - a) / (b - a) END AS position
FROM n
"""
