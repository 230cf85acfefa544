"""Questions to the event table: filters, visibility, search, facets, calendars."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.operators.order import positions

PRESETS = (500, 1000, 2000, 3000)


def upcoming(df: DataFrame, today: Column) -> DataFrame:
    return df.where(F.coalesce("date_end", "date") >= today)


def past(df: DataFrame, today: Column) -> DataFrame:
    return df.where(F.col("date") < today)


def view_predicates(filters: dict[str, list | object]) -> dict[str, Column]:
    """A predicate for each filter that isn't empty. Values of one filter are alternatives.

    city, month, venue: array columns `cities`, `months`, `venues` overlap the values;
    type, origin: array columns `types`, `origins`; priceMax: price_min at most the
    largest value, and rows without a price pass.
    """
    arrays = {"city": "cities", "month": "months", "venue": "venues", "type": "types", "origin": "origins"}
    out = {}
    for name, values in filters.items():
        values = values if isinstance(values, (list, tuple)) else [values]
        values = [v for v in values if v is not None and v != ""]
        if not values:
            continue
        if name == "priceMax":
            out[name] = F.coalesce(F.col("price_min") <= max(values), F.lit(True))
        else:
            out[name] = F.coalesce(F.arrays_overlap(F.col(arrays[name]), F.array(*map(F.lit, values))), F.lit(False))
    return out


def view_filters(df: DataFrame, filters: dict) -> DataFrame:
    """Rows that pass every filter."""
    return df.where(reduce(lambda a, b: a & b, view_predicates(filters).values(), F.lit(True)))


def visibility(today: Column, *, favourite: Column, hidden_event: Column, hidden_artist: Column, hidden_type: Column, passes: Column) -> Column:
    """ended, favourite (if it passes the view), hidden:event, hidden:artist, hidden:type, filtered, or show: the first that holds."""
    return (
        F.when(F.coalesce("date_end", "date") < today, "ended").when(favourite & passes, "favourite").when(favourite & ~passes, "filtered")
        .when(hidden_event, "hidden:event").when(hidden_artist, "hidden:artist").when(hidden_type, "hidden:type").when(~passes, "filtered").otherwise("show"))


def search(df: DataFrame, text: str) -> DataFrame:
    """Rows whose title or any name of the line-up contains the text, whatever the case, by date."""
    word = F.lit(text.lower())
    hit = F.lower("title").contains(word) | F.coalesce(F.exists("lineup", lambda n: F.lower(n).contains(word)), F.lit(False))
    return df.where(hit).orderBy("date", "id")


def facet_counts(df: DataFrame, filters: dict, facets: dict[str, str]) -> DataFrame:
    """(facet, value, n): options of each facet among rows that pass all filters but the facet's own.

    facets: name to array column. One pass over the rows: the failed filters of a row are
    counted, and a facet takes it if none failed, or only its own. Counts combine
    map-side.
    """
    checks = view_predicates(filters)
    failed = reduce(lambda a, b: a + b, [(~c).cast("int") for c in checks.values()], F.lit(0))

    def option(name, column):
        own = (~checks[name]).cast("int") if name in checks else F.lit(0)
        return F.when(failed - own == 0, F.transform(F.array_distinct(F.col(column)), lambda v: F.struct(F.lit(name).alias("facet"), v.cast("string").alias("value"))))

    none = F.array().cast("array<struct<facet:string,value:string>>")
    rows = F.concat(*[F.coalesce(option(n, c), none) for n, c in facets.items()])
    return df.select(F.explode(rows).alias("o")).groupBy("o.facet", "o.value").agg(F.count("*").alias("n"))


def facet_sort(counts: DataFrame) -> DataFrame:
    """Options by count, then by name in Unicode collation."""
    return counts.orderBy("facet", F.desc("n"), F.collate("value", "UNICODE"))


def venue_options(df: DataFrame, key: Column, name: Column) -> DataFrame:
    """(key, venue, n): each venue under its most frequent, then shortest, then first spelling."""
    each = df.select(key.alias("key"), name.alias("venue")).groupBy("key", "venue").agg(F.count("*").alias("c"))
    return each.groupBy("key").agg(F.min_by("venue", F.struct(-F.col("c"), F.char_length("venue"), "venue")).alias("venue"), F.sum("c").alias("n"))


def price_presets(df: DataFrame, presets=PRESETS) -> DataFrame:
    """(preset): the steps at or above the lowest price."""
    low = df.agg(F.min("price_min").alias("low"))
    return low.select(F.explode(F.array(*map(F.lit, presets))).alias("preset"), "low").where("low <= preset").select("preset")


def partition_counts(df: DataFrame, decision: Column) -> DataFrame:
    d = F.coalesce(decision, F.lit("show"))
    return df.agg(F.count_if(d.isin("show", "favourite")).alias("visible"), F.count_if(d == "ended").alias("ended"), F.count_if(d.startswith("hidden")).alias("hidden"))


def due_reminders(df: DataFrame, *, before=(15, 0)) -> DataFrame:
    """Announced rows with a sale start: a 15-minute block and its alarms."""
    rows = df.where((F.col("status") == "announced") & F.col("on_sale_at").isNotNull())
    alarm = F.explode(F.array(*map(F.lit, before)))
    rows = rows.select("*", alarm.alias("minutes_before"))
    return rows.withColumn("block_end", F.col("on_sale_at") + F.expr("interval 15 minutes")).withColumn("alarm_at", F.col("on_sale_at") - F.make_interval(mins=F.col("minutes_before")))


def group_by_date(df: DataFrame) -> DataFrame:
    """df with each event's `position` on its day: by time with unknown times last, then id."""
    return positions(df, ["date"], [F.coalesce("time", F.lit("99:99")), "id"])


def collect_calendar(df: DataFrame, favourites: DataFrame) -> DataFrame:
    """(date, position, id) of favourited events, each once on each of its `dates`, by id."""
    rows = df.join(favourites.select("id"), "id", "left_semi").select("id", F.explode("dates").alias("date")).distinct()
    return positions(rows, ["date"], ["id"]).select("date", "position", "id")


def new_arrivals(df: DataFrame, now: Column, *, days: int = 7) -> DataFrame:
    """(group, n): rows first seen today and in the past days before, to the microsecond."""
    at = lambda c: F.unix_micros(c.cast("timestamp"))
    age = F.floor((at(now) - at(F.col("first_seen_at"))) / 86_400_000_000)
    rows = df.withColumn("_age", age).where((F.col("_age") >= 0) & (F.col("_age") <= days))
    return rows.groupBy(F.when(F.col("_age") < 1, "today").otherwise("week").alias("group")).agg(F.count("*").alias("n"))


def source_warning(status: DataFrame) -> DataFrame:
    """(names): the sources whose last run was not ok, in order, without the manual one."""
    bad = status.where((F.col("status") != "ok") & (F.col("source") != "manual"))
    return bad.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "source"))), lambda x: x["source"]), "、").alias("names"))
