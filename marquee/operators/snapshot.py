"""Snapshots: differences, lineage of ids, fallback, reuse, first and last wins, source health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WATCHED = ("date", "time", "venue", "status", "price_min", "price_max", "on_sale_at")
RUN_WATCHED = ("date_end", "venue", "status", "price_min", "price_max", "on_sale_at")
CACHEABLE = ("non_music_noise", "outside_taiwan", "classical")


def id_lineage(new: DataFrame, old: DataFrame) -> DataFrame:
    """new (id, sources) with the id that an old row of a shared source reference had, where its own id is unknown.

    The first source of the new row that an old row knows decides; of several old rows
    with one reference the largest id (ties are thus settled the same each time).
    `old_id` is null where the id stays.
    """
    refs = new.join(old.select("id"), "id", "left_anti").select("id", F.posexplode("sources").alias("pos", "s")).select("id", "pos", "s.name", "s.raw_id")
    known = old.select(F.col("id").alias("old_id"), F.explode("sources").alias("s")).groupBy("s.name", "s.raw_id").agg(F.max("old_id").alias("old_id"))
    found = refs.join(known, ["name", "raw_id"]).groupBy("id").agg(F.min_by("old_id", "pos").alias("old_id"))
    out = new.join(found, "id", "left")
    return out.withColumn("id", F.coalesce("old_id", "id"))


def changed_fields(a: str, b: str, fields) -> Column:
    """Names of the fields in which two aliased rows differ, nulls being values."""
    return F.filter(F.array(*[F.when(~F.col(f"{a}.{f}").eqNullSafe(F.col(f"{b}.{f}")), F.lit(f)) for f in fields]), lambda x: x.isNotNull())


def snapshot_diff(old: DataFrame, new: DataFrame, *, fields=WATCHED, run_col: str | None = None, run_fields=RUN_WATCHED, key="id", now: Column | None = None, include_removed=False) -> DataFrame:
    """(key, change, fields[, first_seen_at, updated_at]): added, updated with the watched fields that differ, unchanged.

    New rows with a value in run_col (such as `sessions`) are runs: of those run_fields are
    watched, as a run's next date moves on by itself.
    """
    kind = "full" if include_removed else "right"
    both = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), kind)
    watched = changed_fields("o", "n", fields)
    if run_col:
        watched = F.when(F.col(f"n.{run_col}").isNotNull(), changed_fields("o", "n", run_fields)).otherwise(watched)
    fs = F.when(F.col(f"o.{key}").isNotNull() & F.col(f"n.{key}").isNotNull(), watched)
    change = (F.when(F.col(f"o.{key}").isNull(), "added").when(F.col(f"n.{key}").isNull(), "removed").when(F.size(fs) > 0, "updated").otherwise("unchanged"))
    cols = [F.coalesce(f"n.{key}", f"o.{key}").alias(key), change.alias("change"), fs.alias("fields")]
    if now is not None:
        cols += [F.coalesce("o.first_seen_at", now).alias("first_seen_at"), F.when(change == "unchanged", F.col("o.updated_at")).otherwise(now).alias("updated_at")]
    return both.select(*cols)


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by a total order. Grouped minimum, so it combines map-side and takes any skew."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*").select(*df.columns)


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*").select(*df.columns)


def source_health(prior: DataFrame, counts: DataFrame) -> DataFrame:
    """(source, status, last_count): error, anomaly (nothing after something; the old count stays, so it stays flagged) or ok.

    prior: source, last_count. counts: source, n (null: the run failed).
    """
    both = prior.join(counts, "source", "full")
    status = F.when(F.col("n").isNull(), "error").when((F.col("n") == 0) & (F.coalesce("last_count", F.lit(0)) > 0), "anomaly").otherwise("ok")
    return both.select("source", status.alias("status"), F.when(status == "ok", F.col("n")).otherwise(F.coalesce("last_count", F.lit(0))).alias("last_count"))


def source_fallback(fresh: DataFrame, previous: DataFrame, health: DataFrame) -> DataFrame:
    """fresh (source, raw_id, ...), and for each source that isn't ok its own part of the previous merged events.

    previous: id and sources, as dedupe_events gives them. Each event that lists the source
    anywhere comes back as a row of that source with its own reference; columns of fresh
    that previous lacks are null, and what only a merge makes is left out.
    """
    bad = health.where(F.col("status") != "ok").select("source")
    own = own_contribution(previous).join(bad, "source", "left_semi")
    back = previous.drop("source", "raw_id", "sources").join(own, "id")
    return fresh.unionByName(back.select(*[c for c in fresh.columns if c in back.columns]), allowMissingColumns=True)


def own_contribution(events: DataFrame) -> DataFrame:
    """(id, source, raw_id): each event's first reference of each of its sources."""
    refs = events.select("id", F.posexplode("sources").alias("pos", "s"))
    return refs.groupBy("id", F.col("s.name").alias("source")).agg(F.min_by("s.raw_id", "pos").alias("raw_id"))


def known_ids(events: DataFrame) -> DataFrame:
    """(source, raw_id, status) of events with a recognised name."""
    return events.where(F.size("headliners") > 0).select(F.explode("sources").alias("s"), "status").select(F.col("s.name").alias("source"), "s.raw_id", "status")


def reuse_known(listings: DataFrame, previous: DataFrame, signals: DataFrame, now: Column, today: Column) -> DataFrame:
    """Prior rows of listings marked reuse_previous, their status refreshed by the signals of their key."""
    from marquee.functions.status import refreshed

    marked = listings.where("reuse_previous").select("source", "raw_id").distinct()
    kept = previous.join(marked, ["source", "raw_id"], "left_semi").join(signals.withColumnRenamed("on_sale_at", "signal_at"), ["source", "raw_id"], "left")
    new = refreshed(F.col("status"), F.col("on_sale_at"), F.col("date"), F.col("signal"), F.col("signal_at"), now, today)
    kept = kept.withColumn("_n", new).withColumn("on_sale_at", F.when(F.col("_n").isNull(), F.col("on_sale_at").cast("string")).otherwise(F.col("_n.on_sale_at")))
    return kept.withColumn("status", F.coalesce("_n.status", "status")).select(*previous.columns)


def exclusion_cache(cache: DataFrame, excluded: DataFrame, now: Column, *, ttl_days: int = 7) -> DataFrame:
    """The cache (source, raw_id, reason, checked_at) with fresh cacheable exclusions, latest first, without the expired."""
    fresh = excluded.where(F.col("reason").isin(*CACHEABLE)).select("source", "raw_id", "reason", now.alias("checked_at"))
    both = cache.select("source", "raw_id", "reason", "checked_at").unionByName(fresh).where(F.col("checked_at") > now - F.make_interval(days=F.lit(ttl_days)))
    return last_wins(both, ["source", "raw_id"], ["checked_at", "reason"])


def skip_list(cache: DataFrame, reasons_today: DataFrame, now: Column, *, ttl_days: int = 7) -> DataFrame:
    """Cached keys still young and still excluded by today's rules."""
    young = cache.where(F.col("checked_at") > now - F.make_interval(days=F.lit(ttl_days)))
    return young.join(reasons_today.where(F.col("reason").isin(*CACHEABLE)).select("source", "raw_id"), ["source", "raw_id"], "left_semi").select("source", "raw_id")


def renormalize(events: DataFrame, reason: Column, headliners: Column, city: Column, unknown: str = "未知") -> tuple[DataFrame, DataFrame]:
    """(kept, excluded) after a change of rules: newly excluded rows go out, only rows without names or city get new ones."""
    marked = events.withColumn("reason", reason)
    excluded = marked.where(F.col("reason").isNotNull())
    kept = marked.where(F.col("reason").isNull()).drop("reason")
    kept = kept.withColumn("headliners", F.when(F.size("headliners") == 0, headliners).otherwise(F.col("headliners")))
    return kept.withColumn("city", F.when(F.col("city") == unknown, F.coalesce(city, F.col("city"))).otherwise(F.col("city"))), excluded


def after_renormalize(cache: DataFrame, review: DataFrame, excluded: DataFrame, resolved: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(cache, review) after renormalize: every source listing of excluded events is cached and leaves the review queue.

    excluded: sources (name, raw_id), reason; resolved: sources of events that got names,
    whose listings leave the queue if they wait there as artist_unrecognized.
    """
    listings = lambda df, *more: df.select(F.explode("sources").alias("s"), *more).select(F.col("s.name").alias("source"), "s.raw_id", *more)
    out = listings(excluded, "reason")
    left = review.join(out.select("source", "raw_id"), ["source", "raw_id"], "left_anti")
    done = listings(resolved).withColumn("reason", F.lit("artist_unrecognized"))
    return exclusion_cache(cache, out, now), left.join(done, ["source", "raw_id", "reason"], "left_anti")


def rejected_recovery(accepted: DataFrame, rejected: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """accepted, and the rejected rows that another strategy lists."""
    return accepted.unionByName(rejected.join(other.select(*keys).distinct(), keys, "left_semi"))


def stored_vs_fresh(stored: DataFrame, fresh: DataFrame, keys: list[str], fields) -> DataFrame:
    """(keys, field, stored, fresh) of each field that differs."""
    both = stored.alias("a").join(fresh.alias("b"), keys)
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"a.{f}").cast("string").alias("stored"), F.col(f"b.{f}").cast("string").alias("fresh")) for f in fields])
    return both.select(*keys, F.explode(F.filter(rows, lambda r: ~r["stored"].eqNullSafe(r["fresh"]))).alias("d")).select(*keys, "d.*")


def write_actions(old: DataFrame, new: DataFrame, key: str, payload: Column) -> DataFrame:
    """(key, action): write what is new or differs, delete what is gone, keep the rest, by content hash."""
    hashed = lambda df: df.select(key, F.sha2(payload, 256).alias("h"))
    both = hashed(old).withColumnRenamed("h", "a").join(hashed(new).withColumnRenamed("h", "b"), key, "full")
    return both.select(key, F.when(F.col("b").isNull(), "delete").when(F.col("a").eqNullSafe(F.col("b")), "keep").otherwise("write").alias("action"))


def latest_first(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each key in order: for child links and other short lists."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")
