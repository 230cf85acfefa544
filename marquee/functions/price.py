"""Prices and sale dates out of tiers and free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marquee.functions.text import any_of, fullwidth_ascii, let, math_digits, utrim

# The patterns by which labels, amounts and sale dates are written.
PRICE_HEAD = r"票\s*價|門\s*票|票務"
PRICE_LABEL = r"(?U)(?:票\s*價|門\s*票|票務)[^\n｜:：|]{0,20}[：｜|:][ \t]*([^\n]{1,200})"
CURRENCY = r"(?U)(?:NT\$|NT|TWD|\$)\s*([\d,]+)|([\d,]+)\s*元"
BARE = r"([\d,]{2,})"
KEYWORD = r"(?i)(?:預售|現場|單人|雙人|套票|adv|door)[^\d]{0,8}(\d[\d,]*)"
DOLLAR = r"\$\s*([\d,]+)"
DISCOUNT_WORDS = ("身障", "愛心", "陪同")
DISCOUNT = r"(?U)(?:身障|愛心|陪同)[^\d]{0,20}[\d,]+(?:\s*[/、,，]\s*[\d,]+)*\s*元?"
SALE_LABEL = r"(?U)(?:開賣|起售|開放售票|售票)[^｜:：|\n]{0,10}(?:\s*\n\s*時間)?[｜:：|]\s*([^\n]{1,60})"
SALE_WORD = "開賣|起售|開放售票|售票"
SALE_END = "截止|結束|停止"
LEAST, MOST = 50, 100_000


def html_to_lines(c: Column) -> Column:
    """Text with a line break where a block starts or ends, without tags, with the two commonest entities decoded."""
    out = c
    for pattern, new in ((r"(?i)<(?:br|p|div|li)\b[^>]*>", "\n"), (r"(?i)</(?:p|div|li)>", "\n"), (r"<[^>]+>", ""), (r"(?i)&nbsp;", " "), (r"(?i)&amp;", "&")):
        out = F.regexp_replace(out, pattern, new)
    return F.when(c.contains("<") | c.contains("&"), out).otherwise(c)


def plain_text(c: Column) -> Column:
    return math_digits(fullwidth_ascii(html_to_lines(c)))


def price_from_tiers(tiers: Column) -> Column:
    """Struct (min, max) over the open tiers with a price, or over all tiers if none is open."""
    opened = F.filter(tiers, lambda t: ~F.coalesce(t["closed"], F.lit(False)))
    used = F.filter(F.transform(F.when(F.size(opened) > 0, opened).otherwise(tiers), lambda t: t["price"]), lambda p: p.isNotNull())
    return F.struct(F.array_min(used).alias("min"), F.array_max(used).alias("max"))


def amounts(texts: Column) -> Column:
    """The numbers among texts that can be prices."""
    numbers = F.transform(texts, lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double"))
    return F.filter(numbers, lambda n: n.between(LEAST, MOST))


def without_discounts(text: Column) -> Column:
    return F.when(any_of(text, DISCOUNT_WORDS), F.regexp_replace(text, DISCOUNT, "")).otherwise(text)


def label_block(plain: Column) -> Column:
    """What stands behind a price label: on its line, else the header line's tail and the next five lines; null if nothing."""
    return F.coalesce(F.nullif(utrim(F.regexp_extract(plain, PRICE_LABEL, 1)), F.lit("")), let(F.split(plain, "\n"), _header_block))


def _header_block(lines: Column) -> Column:
    places = F.sequence(F.lit(0), F.size(lines) - 1)

    def block(i):
        tail = F.nullif(utrim(F.regexp_extract(F.get(lines, i), r"[：｜|:][ \t]*([^\n]+)", 1)), F.lit(""))
        rest = F.filter(F.transform(F.slice(lines, i + 2, F.lit(5)), utrim), lambda x: x != "")
        return F.nullif(F.concat_ws("\n", tail, F.concat_ws("\n", rest)), F.lit(""))

    heads = F.filter(places, lambda i: F.get(lines, i).rlike("(?U)" + PRICE_HEAD))
    return F.get(F.filter(F.transform(heads, block), lambda b: b.isNotNull()), F.lit(0))


def price_from_text(c: Column, plain: Column | None = None) -> Column:
    """Struct (min, max) of the prices that a description states; nulls rather than guesses. plain: its plain_text, if that is at hand.

    Tried in order: marked amounts behind a price label; bare numbers behind one; numbers
    next to a price word; anything with a dollar sign. Reduced prices for entitled
    visitors never count.
    """
    none = F.array().cast("array<double>")
    marked_pattern = F.lit("(" + CURRENCY.replace("(?U)", "").replace("([", "(?:[") + ")")
    every = lambda t, pattern: amounts(F.regexp_extract_all(t, pattern, F.lit(1)))

    def behind_label(label):
        marked = amounts(F.transform(F.regexp_extract_all(label, marked_pattern, F.lit(1)), lambda x: F.regexp_replace(x, r"[^\d,]", "")))
        return let(marked, lambda m: F.when(F.size(m) > 0, m).otherwise(every(label, F.lit(BARE))))

    def anywhere(rest):
        return let(every(rest, F.lit(KEYWORD)), lambda k: F.when(F.size(k) > 0, k).otherwise(every(rest, F.lit(DOLLAR))))

    def read(plain):
        label = F.coalesce(let(label_block(plain), lambda b: let(without_discounts(b), behind_label)), none)
        return let(label, lambda x: F.when(F.size(x) > 0, x).otherwise(let(without_discounts(plain), anywhere)))

    return let(let(plain_text(c) if plain is None else plain, read), lambda x: F.struct(F.array_min(x).alias("min"), F.array_max(x).alias("max")))


def sale_moment(text: Column) -> Column:
    """ISO moment of a full date, with 00:00 where no time is given; null without a year."""
    slash = r"(?U)(\d{4})\s*[/.]\s*(\d{1,2})\s*[/.]\s*(\d{1,2})"
    words = r"(?U)(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日"
    pick = lambda k: F.coalesce(F.nullif(F.regexp_extract(text, slash, k), F.lit("")), F.nullif(F.regexp_extract(text, words, k), F.lit("")))
    clock = r"(\d{1,2})[:：](\d{2})"
    time = F.when(text.rlike(clock), F.concat_ws(":", F.lpad(F.regexp_extract(text, clock, 1), 2, "0"), F.regexp_extract(text, clock, 2))).otherwise("00:00")
    return F.concat(pick(1), F.lit("-"), F.lpad(pick(2), 2, "0"), F.lit("-"), F.lpad(pick(3), 2, "0"), F.lit("T"), time, F.lit(":00+08:00"))


def on_sale_at(c: Column, plain: Column | None = None) -> Column:
    """The first sale start that a description dates in full; labels and values that speak of an end are passed over. plain: its plain_text, if that is at hand.

    Labels may overlap, so each place where a label word starts is read on its own.
    """
    plain = plain_text(c) if plain is None else plain
    return F.when(any_of(plain, SALE_WORD.split("|")), let(plain, _first_sale))


def _first_sale(plain: Column) -> Column:
    label_value = SALE_LABEL[4:]
    # every place where a label word starts, with the two characters before it and what follows
    starts = F.regexp_extract_all(F.concat(F.lit("  "), plain), F.lit(f"(?s)(?=(..(?:{SALE_WORD}).{{0,158}}))"), F.lit(1))

    def read(x):
        return let(F.substring(x, 3, 160), lambda here: let(F.regexp_extract(here, "(?U)^" + label_value, 1), lambda value: dated(x, here, value)))

    def dated(x, here, value):
        label = F.concat(F.substring(x, 1, 2), F.regexp_extract(here, "(?U)^(" + label_value.replace("([^\\n]{1,60})", ")(?=[^\\n])"), 1))
        return F.when((value != "") & ~label.rlike(SALE_END) & ~value.rlike(SALE_END), sale_moment(value))

    return F.get(F.filter(F.transform(starts, read), lambda x: x.isNotNull()), F.lit(0))


def source_names(sources: Column) -> Column:
    """The distinct names of an event's sources, in order."""
    return F.array_join(F.array_distinct(F.transform(sources, lambda s: s["name"])), " · ")


def price_label(low: Column, suffix: str = " up") -> Column:
    """The lowest price and upwards, or that it isn't known."""
    whole = low == F.floor(low)
    return F.when(low.isNull(), "票價未公布").otherwise(F.concat(F.lit("NT$"), F.when(whole, F.format_number(low, 0)).otherwise(F.regexp_replace(F.format_number(low, 3), "0+$", "")), F.lit(suffix)))
