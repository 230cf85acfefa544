"""Dates and times as Column expressions. Civil time is a zone's; the as-of moment is a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marquee.functions.text import let

ZONE = "Asia/Taipei"
OFFSET = "+08:00"


def as_of_today(now: Column, zone: str = ZONE) -> Column:
    """The civil date of a UTC moment."""
    return F.to_date(F.from_utc_timestamp(now, zone))


def minutes_of(time: Column) -> Column:
    """Minutes of HH:MM; null for null or other text."""
    return F.regexp_extract(time, r"^(\d{1,2}):(\d{2})", 1).try_cast("int") * 60 + (
        F.regexp_extract(time, r"^(\d{1,2}):(\d{2})", 2).try_cast("int"))


def time_bucket(time: Column, evening: int = 17) -> Column:
    """day before the evening hour, evening from it on; null without a time."""
    return F.when(minutes_of(time) < evening * 60, "day").when(minutes_of(time).isNotNull(), "evening")


def _part(c: Column, pattern: str, k: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, k), F.lit(""))


def _time(c: Column, pattern: str = r"(\d{1,2})[:：](\d{2})") -> Column:
    return F.concat_ws(":", F.lpad(_part(c, pattern, 1), 2, "0"), _part(c, pattern, 2))


SLASH = r"(\d{4})/(\d{1,2})/(\d{1,2})"
DASH = r"(\d{4})-(\d{1,2})-(\d{1,2})"
WORDS = r"(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日|(\d{4})\.(\d{1,2})\.(\d{1,2})"
GRAMMARS = ("slash", "slash_time", "words", "dash")


def parse_date(c: Column, grammar: Column) -> Column:
    """Struct (date, time) of a date text by its grammar: slash, slash_time, words or dash; nulls if it doesn't parse.

    slash_time takes the last time of the text, the others the first after the date.
    """
    found = lambda pattern: F.regexp_extract(c, pattern, 0)
    words = F.translate(found(WORDS), "年月.日 \t\n\x0b\x0c\r", "---")
    date = F.when(grammar.isin("slash", "slash_time"), F.translate(found(SLASH), "/", "-")).when(grammar == "words", words).when(grammar == "dash", found(DASH)).try_cast("date")
    last = F.nullif(F.concat_ws(":", F.lpad(_part(c, r".*(?<!\d)(\d{1,2})[:：](\d{2})", 1), 2, "0"), _part(c, r".*(?<!\d)(\d{1,2})[:：](\d{2})", 2)), F.lit(""))
    time = F.when(grammar == "slash_time", last).otherwise(let(found(r"\d{1,2}[:：]\d{2}"), lambda x: F.when(x != "", F.lpad(F.translate(x, "：", ":"), 5, "0"))))
    return let(date, lambda d: F.struct(d.alias("date"), F.when(d.isNotNull(), time).alias("time")))


def slash_timestamp(c: Column, zone: str = ZONE) -> Column:
    """The UTC moment of a civil YYYY/MM/DD H:MM in a text; null if there is none."""
    found = F.regexp_extract(c, r"(\d{4}/\d{2}/\d{2})\s+(\d{1,2}):(\d{2})", 1)
    hour = F.lpad(F.regexp_extract(c, r"(\d{4}/\d{2}/\d{2})\s+(\d{1,2}):(\d{2})", 2), 2, "0")
    minute = F.regexp_extract(c, r"(\d{4}/\d{2}/\d{2})\s+(\d{1,2}):(\d{2})", 3)
    return F.to_utc_timestamp(F.try_to_timestamp(F.concat(found, F.lit(" "), hour, F.lit(":"), minute), F.lit("yyyy/MM/dd HH:mm")), zone)


def local_text(ts: Column, layout: str = "yyyy/MM/dd HH:mm", zone: str = ZONE) -> Column:
    """A UTC moment as civil text."""
    return F.date_format(F.from_utc_timestamp(ts, zone), layout)


#: The second layout of civil text, which is also the key by which moments are compared.
MINUTE = "yyyy-MM-dd HH:mm"


def minute_key(moment: Column | None = None, text: Column | None = None, zone: str = ZONE) -> Column:
    """The civil minute of a UTC moment, or of a text that is civil time already, so that the two can be joined; null for null."""
    if moment is not None:
        return local_text(moment, MINUTE, zone)
    return F.substring(F.replace(text, F.lit("T"), F.lit(" ")), 1, 16)


def days_until(date: Column, today: Column) -> Column:
    return F.datediff(date, today)


def days_since(ts: Column, now: Column) -> Column:
    """Whole days passed."""
    return F.floor((F.unix_timestamp(now) - F.unix_timestamp(ts)) / 86400).cast("long")


def month_list(today: Column, more: int = 6) -> Column:
    """This month and the next ones, as first days."""
    return F.sequence(F.trunc(today, "month").cast("date"), F.add_months(F.trunc(today, "month"), more).cast("date"), F.expr("interval 1 month"))


def month_grid(month: Column) -> Column:
    """The weeks of a month: an array of weeks of seven days, Sunday first, null outside the month."""
    first = F.trunc(month, "month").cast("date")
    lead = F.dayofweek(first) - 1
    n = F.day(F.last_day(first))
    cells = F.transform(F.sequence(F.lit(0), F.ceil((lead + n) / 7).cast("int") * 7 - 1),
                        lambda k: F.when((k >= lead) & (k < lead + n), F.date_add(first, (k - lead).cast("int"))))
    return F.transform(F.sequence(F.lit(0), (F.size(cells) / 7).cast("int") - 1), lambda w: F.slice(cells, w * 7 + 1, F.lit(7)))


def pending_days(start: Column, end: Column, today: Column, most: int = 7) -> Column:
    """The first `most` days of a span, without those before today."""
    days = F.slice(F.sequence(start, F.greatest(start, end), F.expr("interval 1 day")), 1, most)
    return F.filter(days, lambda d: d >= today)


WEEKDAYS = ("日", "一", "二", "三", "四", "五", "六")


def date_label(date: Column, time: Column) -> Column:
    """YYYY/MM/DD（weekday）HH:MM."""
    day = F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.dayofweek(date))
    return F.concat(F.date_format(date, "yyyy/MM/dd"), F.lit("（"), day, F.lit("）"), F.coalesce(time, F.lit("")))


def group_label(date: Column, today: Column) -> Column:
    """MM/dd, with the year before it only if it isn't this one."""
    return F.when(F.year(date) == F.year(today), F.date_format(date, "MM/dd")).otherwise(F.date_format(date, "yyyy/MM/dd"))


def append_time(text: Column, other: Column) -> Column:
    """text as it is if it has a time; else with the time found in other (24 hours, or am/pm with or without minutes) behind it."""
    half = r"(?i)(\d{1,2})(?::(\d{2}))?\s*(am|pm)"
    hour = F.nullif(F.regexp_extract(other, half, 1), F.lit("")).cast("int") % 12 + F.when(F.lower(F.regexp_extract(other, half, 3)) == "pm", 12).otherwise(0)
    found = F.when(other.rlike(half), F.concat_ws(":", F.lpad(hour.cast("string"), 2, "0"), F.coalesce(F.nullif(F.regexp_extract(other, half, 2), F.lit("")), F.lit("00")))).otherwise(F.nullif(_time(other), F.lit("")))
    return F.when(text.rlike(r"\d{1,2}[:：]\d{2}") | found.isNull(), text).otherwise(F.concat_ws(" ", text, found))
