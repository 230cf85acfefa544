"""Runs: many sessions of one production as one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rollup_status(status: Column, on_sale_at: Column, upcoming: Column) -> tuple[Column, Column]:
    """Aggregates (status, on_sale_at): on_sale before announced before sold_out among upcoming sessions, else ended."""
    seen = lambda s: F.coalesce(F.bool_or(upcoming & (status == s)), F.lit(False))
    start = F.min(F.when(upcoming & (status == "announced"), on_sale_at))
    best = F.when(seen("on_sale"), "on_sale").when(seen("announced"), "announced").when(seen("sold_out"), "sold_out").otherwise("ended")
    return best, F.when(~seen("on_sale") & seen("announced"), start)


def group_runs(sessions: DataFrame, today: Column, *, base=("title", "venue", "city")) -> DataFrame:
    """One row a run_key: its sorted sessions, the next upcoming session as base, the last one's date, status, price span.

    sessions has run_key, date, time, status, on_sale_at, price_min, price_max, venue,
    city, ord and the base columns. If nothing is upcoming, all sessions count for the
    base. Rows without run_key aren't runs; leave them out before.
    """
    have = [c for c in base if c in sessions.columns]
    upcoming = F.col("date") >= today
    at = F.struct("date", F.coalesce("time", F.lit("")).alias("t"), F.col("ord"))
    status, on_sale_at = rollup_status(F.col("status"), F.col("on_sale_at"), upcoming)
    row = F.struct(*have, "date", "time")
    picked = lambda rows, key: F.min_by(F.when(rows, row), F.when(rows, key))
    out = sessions.groupBy("run_key").agg(
        F.coalesce(picked(upcoming, at), F.min_by(row, at)).alias("_b"),
        F.coalesce(F.max(F.when(upcoming, F.col("date"))), F.max("date")).alias("date_end"),
        status.alias("status"), on_sale_at.alias("on_sale_at"),
        F.least(F.min("price_min"), F.min("price_max")).alias("price_min"), F.greatest(F.max("price_min"), F.max("price_max")).alias("price_max"),
        F.sort_array(F.collect_list(F.struct("date", F.coalesce("time", F.lit("")).alias("time"), "venue", "city", "status"))).alias("sessions"))
    return out.select(run_id(F.col("run_key")).alias("id"), "run_key", "_b.*", "date_end", "status", "on_sale_at", "price_min", "price_max", "sessions")


def run_id(key: Column) -> Column:
    """A run's id hashes its raw key where other ids have their date."""
    return F.substring(F.sha1(F.concat(F.lit("run|"), key, F.lit("|"))), 1, 16)


def next_session(sessions: Column, today: Column) -> Column:
    """The next upcoming session, else the last."""
    later = F.filter(sessions, lambda s: s["date"] >= today)
    return F.coalesce(F.get(later, F.lit(0)), F.try_element_at(sessions, F.lit(-1)))


def event_dates(sessions: Column, today: Column) -> Column:
    """The distinct upcoming dates, or all if none is upcoming."""
    later = F.filter(sessions, lambda s: s["date"] >= today)
    return F.array_distinct(F.transform(F.when(F.size(later) > 0, later).otherwise(sessions), lambda s: s["date"]))


def event_cities(sessions: Column, today: Column) -> Column:
    later = F.filter(sessions, lambda s: s["date"] >= today)
    return F.array_distinct(F.transform(F.when(F.size(later) > 0, later).otherwise(sessions), lambda s: s["city"]))


def run_summary(sessions: Column, today: Column) -> Column:
    """Text of what is to come: none for at most one session; stops if in several cities; else first to last and how many."""
    later = F.filter(sessions, lambda s: s["date"] >= today)
    stop = lambda s: F.concat_ws(" ", F.date_format(s["date"], "MM/dd"), s["city"], F.when(s["status"] == "sold_out", "（完售）"))
    span = F.concat(F.date_format(F.get(later, F.lit(0))["date"], "MM/dd"), F.lit("–"), F.date_format(F.try_element_at(later, F.lit(-1))["date"], "MM/dd"), F.lit(" "), F.size(later).cast("string"))
    many = F.size(F.array_distinct(F.transform(sessions, lambda s: s["city"]))) > 1
    return F.when(F.size(later) > 1, F.when(many, F.array_join(F.transform(later, stop), "、")).otherwise(span))


def games_to_sessions(games: DataFrame) -> DataFrame:
    """Games grouped by (start, venue); the most optimistic signal wins, the earlier sale start on ties."""
    from marquee.functions.status import signal_rank

    key = F.struct(signal_rank(F.col("signal")).alias("r"), F.col("sale_start"))
    return games.groupBy("start", "venue").agg(F.min_by("signal", F.when(F.col("signal").isNotNull(), key)).alias("signal"), F.min("sale_start").alias("sale_start"))


def combine_signals(signals: DataFrame, keys: list[str]) -> DataFrame:
    """The most optimistic signal of each key, the first on equal rank; keys without a signal are left out."""
    from marquee.functions.status import signal_rank

    known = signals.where(F.col("signal").isNotNull())
    return known.groupBy(*keys).agg(F.min_by(F.struct("signal", "on_sale_at"), F.struct(signal_rank(F.col("signal")).alias("r"), "ord")).alias("s")).select(*keys, "s.*")


def tier_rows_to_sessions(rows: DataFrame, restricted: str) -> DataFrame:
    """Tier rows (date, time, venue, name, price, closed) as sessions with a tier list.

    Rows whose name is restricted go unless a session has no other; of equal prices an
    open one wins; a session whose tiers are all closed says so.
    """
    keys = ["date", "time", "venue"]
    limited = F.coalesce(F.col("name").rlike(restricted), F.lit(False))
    prices = rows.groupBy(*keys, limited.alias("limited"), "price").agg(F.bool_and("closed").alias("closed"))
    tier = F.struct("price", "closed")
    both = prices.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.when(~F.col("limited"), tier))).alias("plain"), F.sort_array(F.collect_list(F.when(F.col("limited"), tier))).alias("limited"))
    tiers = F.when(F.size("plain") > 0, F.col("plain")).otherwise(F.col("limited"))
    return both.select(*keys, tiers.alias("tiers"), F.forall(tiers, lambda t: t["closed"]).alias("all_closed"))


def multi_stops(listings: DataFrame) -> DataFrame:
    """Listings with several `stops` as a row each, raw_id numbered and run_key shared; others stay one row."""
    n = F.size("stops")
    rest = [c for c in listings.columns if c not in ("raw_id", "run_key", "stops")]
    rows = listings.select(*rest, "raw_id", n.alias("_n"), F.posexplode_outer("stops").alias("_i", "stop"))
    return rows.select(*rest, F.when(F.col("_n") > 1, F.concat_ws("#", "raw_id", F.col("_i").cast("string"))).otherwise(F.col("raw_id")).alias("raw_id"),
                       F.when(F.col("_n") > 1, F.col("raw_id")).alias("run_key"), "stop")
