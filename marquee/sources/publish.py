"""Tables for publishing: structured documents, schedule, sitemap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions.dates import date_label
from marquee.functions.price import price_label
from marquee.functions.status import status_label
from marquee.operators.order import positions

#: The sale states that make an offer; an ended event has none.
AVAILABILITY = {"on_sale": "InStock", "announced": "PreOrder", "sold_out": "SoldOut"}
UNKNOWN = "未知"


def _known(c: Column) -> Column:
    return F.when((c != "") & (c != UNKNOWN), c)


def description(site_sources: Column) -> Column:
    """One sentence on a row: title, day, place, price, status, and the distinct names of its sources."""
    where = F.concat_ws(" ", _known(F.col("city")), F.nullif("venue", F.lit("")))
    return F.concat(
        F.col("title"), F.lit("｜"), date_label(F.col("date"), F.col("time")), F.when(where != "", F.concat(F.lit(" 於"), where)).otherwise(""), F.lit("，"), price_label(F.col("price_min"), " 起"),
        F.lit("，"), F.coalesce(status_label(F.col("status")), F.lit("")), F.lit("。資料來源："), F.array_join(F.array_distinct(F.transform(site_sources, lambda s: s["name"])), "、"), F.lit("。"))


def jsonld(site: str) -> Column:
    """A schema.org event of a row as JSON; what is null or unknown is left out.

    The row has id, title, date, date_end, time, venue, city, status, on_sale_at, price_min,
    ticket_url, headliners, image, sources (name) and sessions (date, time, venue, city,
    status). There is an offer if a price is known and the status is one of a sale; sessions
    are sub-events with offers of their own status, if there are two or more. A place
    without a name is called by its city, and an unknown city is no locality.
    """
    text = lambda x: F.lit(x)
    schema = lambda x: F.lit("https://schema.org/" + x)
    moment = lambda d, t: F.concat(d.cast("string"), F.coalesce(F.concat(F.lit("T"), F.nullif(t, F.lit("")), F.lit(":00+08:00")), F.lit("")))
    stock = F.create_map(*[F.lit(x) for kv in AVAILABILITY.items() for x in kv])
    told, price, image = description(F.col("sources")), F.col("price_min"), F.col("image")
    address = lambda c: F.struct(text("PostalAddress").alias("@type"), text("TW").alias("addressCountry"), _known(c).alias("addressLocality"))
    place = lambda v, c: F.struct(text("Place").alias("@type"), F.coalesce(F.nullif(v, F.lit("")), c).alias("name"), address(c).alias("address"))
    offer = lambda status: F.when(price.isNotNull() & stock[status].isNotNull(), F.struct(
        text("Offer").alias("@type"), F.col("ticket_url").alias("url"), price.alias("price"), text("TWD").alias("priceCurrency"), F.concat(schema(""), stock[status]).alias("availability"),
        F.when(status == "announced", F.col("on_sale_at").cast("string")).alias("validFrom")))
    performers = F.when(F.size("headliners") > 0, F.transform("headliners", lambda n: F.struct(text("PerformingGroup").alias("@type"), n.alias("name"))))
    mode = [schema("EventScheduled").alias("eventStatus"), schema("OfflineEventAttendanceMode").alias("eventAttendanceMode")]
    subs = F.transform("sessions", lambda s: F.struct(
        text("Event").alias("@type"), F.col("title").alias("name"), told.alias("description"), moment(s["date"], s["time"]).alias("startDate"), *mode, place(s["venue"], s["city"]).alias("location"),
        performers.alias("performer"), image.alias("image"), offer(s["status"]).alias("offers")))
    return F.to_json(F.struct(
        F.lit("https://schema.org").alias("@context"), text("Event").alias("@type"), F.col("title").alias("name"), told.alias("description"),
        F.concat(F.lit(site + "/e/"), F.col("id").cast("string"), F.lit(".html")).alias("url"), moment(F.col("date"), F.col("time")).alias("startDate"),
        F.when(F.col("date_end") != F.col("date"), F.col("date_end").cast("string")).alias("endDate"), *mode, place(F.col("venue"), F.col("city")).alias("location"),
        performers.alias("performer"), image.alias("image"), F.when(F.size("sessions") > 1, subs).alias("subEvent"), offer(F.col("status")).alias("offers")))


def schedule(df: DataFrame) -> DataFrame:
    """df with its `month` and each event's `position` in it: by date, then id."""
    return positions(df.withColumn("month", F.date_format("date", "yyyy-MM")), ["month"], ["date", "id"])


def sitemap(df: DataFrame, base: str) -> DataFrame:
    """(loc, lastmod) of every event and of the site, whose lastmod is the latest."""
    pages = df.select(F.concat(F.lit(base + "e/"), F.col("id").cast("string"), F.lit(".html")).alias("loc"), F.col("updated_at").alias("lastmod"))
    return pages.unionAll(df.agg(F.lit(base).alias("loc"), F.max("updated_at").alias("lastmod"))).orderBy("loc")


def report_rows(reports: DataFrame, *, most: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined) user reports: a message of 1 to `most` characters and an event id; accepted ones get a clipped notice line."""
    from marquee.functions.text import clip_text

    n = F.char_length(F.trim(F.coalesce("message", F.lit(""))))
    good = F.coalesce((n >= 1) & (F.char_length("message") <= most) & F.col("event_id").isNotNull(), F.lit(False))
    return reports.where(good).withColumn("notice", F.concat_ws(" ", F.col("event_id").cast("string"), clip_text(F.col("message"), 80))), reports.where(~good)
