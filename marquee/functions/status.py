"""Sale status from tiers, signals, offers and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words of a closed sale, and the order of signals and of a run's statuses.
TERMINAL = "(?:銷售|選購|販售|售票|登記)(?:一空|截止|結束)|售完|完售|售罄|停售|截止"
SIGNAL_RANK = {"IN_STOCK": 0, "COMING_SOON": 1, "SOLD_OUT": 2, "REGISTRATION_CLOSED": 2}
STATUSES = ("on_sale", "announced", "sold_out", "ended")


def signal_rank(c: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in SIGNAL_RANK.items() for x in kv])[c]


def closed_status(date: Column, today: Column) -> Column:
    return F.when(date >= today, "sold_out").otherwise("ended")


def _state(status, on_sale_at=None) -> Column:
    at = F.lit(None).cast("string") if on_sale_at is None else on_sale_at.cast("string")
    return F.struct((F.lit(status) if isinstance(status, str) else status).alias("status"), at.alias("on_sale_at"))


def status_from_tiers(tiers: Column, signal: Column, date: Column, today: Column, stated: Column) -> Column:
    """Struct (status, on_sale_at) from a source's signal, then its tiers, then the date.

    tiers: array of (closed, waiting, on_sale_at); null counts as empty. A waiting tier is
    neither open nor closed; the earliest start of the waiting ones is the sale's.
    """
    tiers = F.coalesce(tiers, F.slice(tiers, 1, 0))
    n = F.coalesce(F.size(tiers), F.lit(0))
    yes = lambda x: F.coalesce(x, F.lit(False))
    waiting = F.filter(tiers, lambda t: yes(t["waiting"]))
    start = F.array_min(F.transform(waiting, lambda t: t["on_sale_at"]))
    return (
        F.when(signal.isin("SOLD_OUT", "REGISTRATION_CLOSED"), _state(closed_status(date, today)))
        .when(signal == "IN_STOCK", _state("on_sale"))
        .when((signal == "COMING_SOON") & (n <= 0), _state("announced", stated))
        .when(F.exists(tiers, lambda t: ~yes(t["closed"]) & ~yes(t["waiting"])), _state("on_sale"))
        .when(F.size(waiting) > 0, _state("announced", start))
        .when(n <= 0, _state("announced"))
        .otherwise(_state(closed_status(date, today))))


def text_status(text: Column, sale: Column, date: Column, today: Column) -> Column:
    """Struct (status, on_sale_at) of a source without tiers and signals: terminal words, else the stated sale start if it is on a later day."""
    return (
        F.when(F.coalesce(text, F.lit("")).rlike(TERMINAL), _state(closed_status(date, today)))
        .when(F.substring(sale.cast("string"), 1, 10) > today.cast("string"), _state("announced", sale)).otherwise(_state("on_sale")))


def offers_signal(offers: Column, now: Column) -> Column:
    """Signal of an array of offers (availability, validFrom, validThrough); null without offers."""
    stock = F.filter(offers, lambda o: F.coalesce(o["availability"], F.lit("")).rlike("(?i)InStock|LimitedAvailability|PreSale|PreOrder"))
    still = F.filter(stock, lambda o: ~F.coalesce(o["validThrough"] < now, F.lit(False)))
    return (
        F.when(F.coalesce(F.size(offers), F.lit(0)) <= 0, F.lit(None).cast("string"))
        .when(F.size(stock) == 0, "SOLD_OUT").when(F.size(still) == 0, "REGISTRATION_CLOSED")
        .when(F.forall(still, lambda o: F.coalesce(o["validFrom"] > now, F.lit(False))), "COMING_SOON").otherwise("IN_STOCK"))


def vocabulary_signal(source: Column, state: Column, vocabularies: dict[str, dict[str, str]]) -> Column:
    """A source's own state word as a signal; null for words outside its vocabulary."""
    out = F.lit(None).cast("string")
    for name, words in vocabularies.items():
        out = F.when(source == name, F.create_map(*[F.lit(x) for kv in words.items() for x in kv])[state]).otherwise(out)
    return out


def needs_check(status: Column, on_sale_at: Column, today: Column) -> Column:
    """Whether a known row's status can still change: not over, and not announced for a later day."""
    over = status.isin("sold_out", "ended")
    later = (status == "announced") & F.coalesce(F.substring(on_sale_at.cast("string"), 1, 10) > today.cast("string"), F.lit(False))
    return F.coalesce(~over & ~later, F.lit(True))


def needs_reading(known: Column, status: Column, signal: Column) -> Column:
    """Whether a known row has changed enough to be read again: its sale has ended, or it has opened since it was announced."""
    ended = signal.isin("SOLD_OUT", "REGISTRATION_CLOSED")
    opened = (signal == "IN_STOCK") & (status == "announced")
    return ~F.coalesce(known, F.lit(False)) | F.coalesce(ended, F.lit(False)) | F.coalesce(opened, F.lit(False))


def refreshed(status: Column, on_sale_at: Column, date: Column, signal: Column, signal_at: Column, now: Column, today: Column) -> Column:
    """Struct (status, on_sale_at) after a fresh signal; null if nothing changes."""
    new = (
        F.when(date < today, _state("ended")).when(signal.isin("SOLD_OUT", "REGISTRATION_CLOSED"), _state("sold_out"))
        .when(signal == "IN_STOCK", _state("on_sale")).when(signal == "COMING_SOON", _state("announced", F.coalesce(signal_at, on_sale_at)))
        .when((status == "announced") & (on_sale_at <= now), _state("on_sale")))
    same = new["status"].eqNullSafe(status) & new["on_sale_at"].eqNullSafe(on_sale_at.cast("string"))
    return F.when(new.isNotNull() & ~same, new)


def status_label(status: Column) -> Column:
    """What a status is called; sold out and closed for another reason can't be told apart, so it says that the sale has ended."""
    words = {"on_sale": "售票中", "announced": "尚未開賣", "sold_out": "結束販售", "ended": "已結束"}
    return F.create_map(*[F.lit(x) for kv in words.items() for x in kv])[status]
