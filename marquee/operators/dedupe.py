"""Entity resolution of listings: content ids, time islands, and the merge of each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions.dates import minutes_of, time_bucket
from marquee.functions.text import hash_norm

GAP_MINUTES = 90

#: What an event has of its best listing, and what it unites of all.
KEEP, UNION = ("title", "venue", "city", "date", "time"), ("lineup", "types", "origins")


def content_id(name: Column, date: Column, venue: Column) -> Column:
    """Sixteen hex digits that name an act, a day and a place, however they are spaced or cased."""
    key = F.concat_ws("|", hash_norm(F.coalesce(name, F.lit(""))), F.coalesce(date.cast("string"), F.lit("")), hash_norm(F.coalesce(venue, F.lit(""))))
    return F.substring(F.sha1(key), 1, 16)


def listing_rank(priority: Column, special: Column) -> Column:
    """Source priority, half a step worse for a special-sale listing."""
    return priority.cast("double") + F.when(special, 0.5).otherwise(0.0)


def island_cells(keyed: DataFrame, gap: int = GAP_MINUTES) -> DataFrame:
    """(base_id, minute, label, first, bucket, island, leads) of each minute of the day at which a group has listings.

    keyed has base_id, minute, time and ord; rows without a minute are left out. A minute's
    rows are summed up map-side, so the windows see as many rows of a group as there are
    minutes, however large it is. first is the least ord; the cell with the least of its
    group leads.
    """
    cells = keyed.where("minute is not null").groupBy("base_id", "minute").agg(F.min("time").alias("label"), F.min(_ord(keyed)).alias("first"))
    return _islands(cells, gap)


def _ord(keyed: DataFrame) -> Column:
    """ord as a struct, so that nulls compare in it."""
    kind = keyed.schema["ord"].dataType
    return F.struct(*[f"ord.{f}" for f in kind.names]) if hasattr(kind, "names") else F.struct("ord")


def _islands(cells: DataFrame, gap: int) -> DataFrame:
    """cells (base_id, minute, label, first) with bucket, island and leads; one without a minute leads nowhere and is no part of any island."""
    timed = F.col("minute").isNotNull()
    own = time_bucket(F.concat_ws(":", F.floor(F.col("minute") / 60).cast("string"), F.lpad((F.col("minute") % 60).cast("string"), 2, "0")))
    group, inner = Window.partitionBy("base_id"), Window.partitionBy("base_id", "bucket")
    cells = cells.withColumn("_own", F.when(timed, own))
    cells = cells.withColumn("bucket", F.when(F.min("_own").over(group) != F.max("_own").over(group), F.col("_own")))
    along = inner.orderBy("minute")
    cells = cells.withColumn("_new", (F.coalesce(F.col("minute") - F.lag("minute").over(along), F.lit(0)) > gap).cast("int")).withColumn("_island", F.sum("_new").over(along))
    label = F.min("label").over(Window.partitionBy("base_id", "bucket", "_island"))
    cells = cells.withColumn("island", F.when(timed & (F.max("_island").over(inner) > 0), label))
    leads = timed & (F.struct("first", "minute") == F.min(F.when(timed, F.struct("first", "minute"))).over(group))
    return cells.withColumn("leads", F.coalesce(leads, F.lit(False))).drop("_own", "_new", "_island")


def resolve_ids(listings: DataFrame, *, gap: int = GAP_MINUTES) -> DataFrame:
    """listings (name, date, venue, time, ord) with `base_id`, `bucket`, `island` and `id`.

    Rows without a time go where the first timed row in `ord` order went; a bucket or
    island is part of the id only if its group has more than one. Groups are judged by
    their minutes (island_cells), and what differs from the plain id is joined back by
    group and minute, so a group of any size spreads over tasks. Ties in `ord` go to the
    earlier time. Columns of these names are replaced.
    """
    minute = F.coalesce(minutes_of(F.col("time")), F.lit(-1))
    keyed = listings.withColumn("base_id", content_id(F.col("name"), F.col("date"), F.col("venue"))).drop("bucket", "island", "id")
    cells = island_cells(keyed.select("base_id", minutes_of(F.col("time")).alias("minute"), "time", "ord"), gap).where("bucket is not null or island is not null")
    at = F.explode(F.when(F.col("leads"), F.array(F.col("minute"), F.lit(-1))).otherwise(F.array("minute")))
    told = cells.select(F.col("base_id").alias("_base"), at.alias("_minute"), "bucket", "island")
    out = keyed.join(told, (F.col("base_id") == F.col("_base")) & (minute == F.col("_minute")), "left").drop("_base", "_minute")
    return out.withColumn("id", F.concat_ws("-", "base_id", "bucket", "island"))


def _rank() -> Column:
    return F.struct(listing_rank(F.col("priority"), F.col("special")).alias("rank"), F.col("price_min").isNull().alias("free"), F.col("ord").alias("ord"))


def _ref(sources: bool) -> list[Column]:
    return [F.struct(F.col("source").alias("name"), "raw_id").alias("ref")] if sources else []


def merge_groups(resolved: DataFrame, *, keep=KEEP, union=UNION, sources: bool = True) -> DataFrame:
    """One row an id: the best-ranked listing as the base, its sources and lists united in rank order, prices spanned.

    resolved has id, priority, special, price_min, price_max, source, raw_id, ord, and the
    keep and union columns. Grouped with map-side combination; `sources` is an array of
    (name, raw_id), or left out. All listings of a group are collected with what is asked
    for, so callers should leave out what they don't need.
    """
    df = resolved.withColumn("_rank", _rank())
    lists = F.collect_list(F.struct("_rank", *_ref(sources), *[c for c in union if c in resolved.columns]))
    kept = [c for c in keep if c in resolved.columns]
    base = [F.min_by(F.struct(*kept), F.col("_rank")).alias("_base")] if kept else []
    out = df.groupBy("id").agg(*base, F.array_sort(lists).alias("_rows"), F.min("price_min").alias("price_min"), F.max("price_max").alias("price_max"))

    return _told(out, resolved, kept, union, sources)


def _told(out: DataFrame, listings: DataFrame, kept, union, sources: bool) -> DataFrame:
    """The events of out (id, _rows in rank order, _base, price_min, price_max), listings having the columns of the lists."""
    def united(c):
        none = F.array().cast(listings.schema[c].dataType)
        return F.array_distinct(F.flatten(F.transform("_rows", lambda r: F.coalesce(r[c], none)))).alias(c)

    refs = [F.transform("_rows", lambda r: r["ref"]).alias("sources")] if sources else []
    return out.select("id", *(["_base.*"] if kept else []), *refs, *[united(c) for c in union if c in listings.columns], "price_min", "price_max")


def dedupe_events(listings: DataFrame, *, gap: int = GAP_MINUTES, keep=KEEP, union=UNION, sources: bool = True, behind: dict[str, Column] | None = None) -> DataFrame:
    """Listings of all sources as one event table, as merge_groups of resolve_ids gives. Rows that are runs already (`sessions`) should be left out before.

    Listings are shuffled once, by base id, which is all that their minutes, islands and
    events need; windows see a row a minute, with its listings in an array. `behind`
    holds columns that follow from others: they are worked out behind the shuffle.
    """
    rows = listings.withColumn("base_id", F.unhex(content_id(F.col("name"), F.col("date"), F.col("venue")))).drop("bucket", "island", "id").repartition("base_id")
    rows = rows.withColumns(behind or {}).withColumn("minute", minutes_of(F.col("time")))
    kept = [c for c in keep if c in rows.columns]
    entry = F.struct(_rank().alias("_rank"), *_ref(sources), *[c for c in union if c in rows.columns], *([F.struct(*kept).alias("_base")] if kept else []))
    cells = rows.groupBy("base_id", "minute").agg(F.min(F.when(F.col("minute").isNotNull(), F.col("time"))).alias("label"), F.min(_ord(rows)).alias("first"), F.collect_list(entry).alias("_rows"), F.min("price_min").alias("price_min"), F.max("price_max").alias("price_max"))
    cells = _islands(cells, gap)
    # listings without a time go where the first timed one went
    of_first = lambda c: F.when(F.col("minute").isNull(), F.max(F.when(F.col("leads"), F.col(c))).over(Window.partitionBy("base_id"))).otherwise(F.col(c)).alias(c)
    cells = cells.select("base_id", of_first("bucket"), of_first("island"), "_rows", "price_min", "price_max")
    out = cells.groupBy("base_id", "bucket", "island").agg(F.array_sort(F.flatten(F.collect_list("_rows"))).alias("_rows"), F.min("price_min").alias("price_min"), F.max("price_max").alias("price_max"))
    out = out.withColumn("id", F.concat_ws("-", F.lower(F.hex("base_id")), "bucket", "island")).withColumn("_base", F.col("_rows")[0]["_base"] if kept else F.lit(None))
    return _told(out, rows, kept, union, sources)
