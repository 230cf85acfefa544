"""Classification by ordered rules held as data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marquee.functions.text import any_of, quoted_pattern

# Words and patterns of the rules.
FEATURING = r"(?i)\bfeat\.?\b|\bft\.?\b|\bwith\b"
JUNK_TITLE = r"(?i)^https?://?\s*$|^(open|my)?test$"
TYPE_WORDS = (
    ("音樂祭", "音樂祭"), ("音樂節", "音樂祭"), ("Music Festival", "音樂祭"), ("爛泥發芽", "音樂祭"), ("RUSH BALL", "音樂祭"), ("FNC BAND KINGDOM", "音樂祭"),
    ("ASIA METAL FESTIVAL", "音樂祭"), ("火球祭", "音樂祭"), ("秋夜爵醒祭", "音樂祭"), ("FRIENDS MEETING", "音樂祭"), ("漫才", "喜劇"), ("脫口秀", "喜劇"),
    ("相聲", "喜劇"), ("單口喜劇", "喜劇"), ("stand-up", "喜劇"), ("comedy", "喜劇"), ("des bishop", "喜劇"), ("音樂劇", "音樂劇"), ("拼盤", "拼盤"),
    ("電音派對", "拼盤"), ("重型宇宙派對", "拼盤"), ("Punk Strike", "拼盤"), ("PHANTASMAGORIA", "拼盤"), ("西部地區懸賞公告", "拼盤"), ("河馬玖狂", "拼盤"), ("交個朋友吧", "拼盤"),
)
LOTTERY_TITLE = "登記抽選|抽選登記"
GENERAL_SALE = "一般(?:票券)?(?:開售|發售|開賣|販售|售票)"
REGION = {"台北": "雙北", "新北": "雙北"}


def first_word(text: Column, pairs, fold=True) -> Column:
    """The value of the first (word, value) pair whose word the text holds; null if none."""
    where = F.lower(text) if fold else text
    return F.coalesce(*[F.when(where.contains(w.lower() if fold else w), F.lit(v)) for w, v in pairs], F.lit(None).cast("string"))


def type_tag(title: Column, headliners: Column, words=TYPE_WORDS) -> Column:
    """The type of an event: by its title's words, else a shared bill of two or more names, else a single act's show."""
    shared = (F.coalesce(F.size(headliners), F.lit(0)) >= 2) & ~title.rlike(FEATURING)
    return F.coalesce(first_word(title, words), F.when(shared, "拼盤").otherwise("專場"))


def exclusion_reason(title: Column, url: Column, account: Column, venue: Column, *, noise=(), classical=(), greet=(), demo: str | None = None, accounts=(), urls=(), outside: str | None = None, escape: str | None = None) -> Column:
    """The first reason, in fixed order, to leave a listing out; null to keep it.

    Words are literal, or, as marquee.operators.rules has them, a column each that says whether a listing
    holds one; demo (a platform's own pages) is a pattern of URLs, outside one of venues.
    """
    title = F.coalesce(title, F.lit(""))
    held = lambda given, test: given if isinstance(given, Column) else test(given)
    one_of = lambda text: lambda words: text.isin(*words) if words else F.lit(False)
    plain = held(classical, lambda words: any_of(title, words)) & (~title.contains(escape) if escape else F.lit(True))
    checks = (
        ("junk_title", F.trim(title).rlike(JUNK_TITLE)),
        ("non_music_noise", held(noise, lambda words: F.lower(title).rlike(quoted_pattern([w.lower() for w in words])) if words else F.lit(False))),
        ("classical", plain),
        ("meet_and_greet", held(greet, lambda words: any_of(F.lower(title), [w.lower() for w in words]))),
        ("platform_demo_content", F.coalesce(url.rlike(demo), F.lit(False)) if demo else F.lit(False)),
        ("excluded_account", held(accounts, one_of(account))),
        ("manual_exclude", held(urls, one_of(url))),
        ("outside_taiwan", F.coalesce(venue.rlike(outside), F.lit(False)) if outside else F.lit(False)),
    )
    return F.coalesce(*[F.when(c, F.lit(name)) for name, c in checks], F.lit(None).cast("string"))


def section_of(types: Column) -> Column:
    """comedy before theatre before music."""
    return F.when(F.array_contains(types, "喜劇"), "comedy").when(F.array_contains(types, "音樂劇") | F.array_contains(types, "戲劇"), "theatre").otherwise("music")


def city_bucket(city: Column, regions=REGION) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in regions.items() for x in kv])[city], city)


def category_of(codes: Column, classes: dict[str, str], excluded=()) -> Column:
    """The class of the first code, in the classes' order, that a listing has; null if it has an excluded one or none."""
    hit = F.coalesce(*[F.when(F.array_contains(codes, k), F.lit(v)) for k, v in classes.items()], F.lit(None).cast("string"))
    bad = F.arrays_overlap(codes, F.array(*map(F.lit, excluded))) if excluded else F.lit(False)
    return F.when(~bad, hit)


def is_lottery(title: Column, text: Column, hedge, window: int = 150, lookback: int = 20, beside="VIP|加購", words=LOTTERY_TITLE, sale=GENERAL_SALE) -> Column:
    """Whether general tickets are drawn by lot: the title says so, or the text does near a general sale.

    A lottery word counts unless `beside` words stand within lookback characters before
    it; a hedge within `window` characters behind the general sale undoes it. All four are
    patterns, as text or as columns.
    """
    text = F.coalesce(text, F.lit(""))
    pattern = lambda p: p if isinstance(p, Column) else F.lit(p)
    found = lambda t, p: F.regexp_instr(t, pattern(p)) > 0
    # what stands before each lottery word, from a text with room before its start
    ahead = F.concat(F.lit(f"(?s)(?=(.{{{lookback}}})(?:"), pattern(words), F.lit("))"))
    real = F.exists(F.regexp_extract_all(F.concat(F.lit(" " * lookback), text), ahead, F.lit(1)), lambda x: ~found(x, beside))
    at = F.regexp_instr(text, pattern(sale))
    hedged = (at > 0) & found(F.substring(text, at, F.lit(window)), hedge)
    return found(F.coalesce(title, F.lit("")), words) | (found(text, words) & (at > 0) & real & ~hedged)
