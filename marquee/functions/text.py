"""Text folds and keys as Column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The counties and cities, in the order in which an address is searched.
CITIES = ("台北", "新北", "桃園", "新竹", "苗栗", "台中", "彰化", "南投", "雲林", "嘉義", "台南", "高雄", "屏東", "宜蘭", "花蓮", "台東", "澎湖", "金門", "連江")


def let(value: Column, body) -> Column:
    """body(value) with the value computed once a row, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_variant_char(c: Column) -> Column:
    """One spelling for a character written two ways in place names."""
    return F.translate(c, "臺", "台")


def fullwidth_ascii(c: Column) -> Column:
    """Full-width forms of ASCII characters as ASCII."""
    wide = "".join(chr(0xFF01 + k) for k in range(94))
    return F.translate(c, wide, "".join(chr(0x21 + k) for k in range(94)))


def math_digits(c: Column) -> Column:
    """Digits of the mathematical alphabets as ASCII digits."""
    return F.translate(c, "".join(chr(0x1D7CE + k) for k in range(50)), "0123456789" * 5)


def is_ascii(c: Column) -> Column:
    """Whether a text is ASCII alone; null for null."""
    return F.octet_length(c) == F.char_length(c)


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode compatibility composition; null stays null."""
    return s if s.isna().all() else s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def composed(c: Column) -> Column:
    """nfkc of a column, which sends nothing of ASCII texts to Python: they stay as they are."""
    return F.coalesce(nfkc(F.when(~is_ascii(c), c)), c)


#: Every character of Unicode's White_Space, which the pattern (?U)\s means.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def utrim(c: Column) -> Column:
    """Trim of every Unicode white space."""
    return F.trim(c, F.lit(WHITE))


def hash_norm(c: Column) -> Column:
    """Lower case without any white space."""
    return F.lower(F.translate(c, WHITE, ""))


def squash(c: Column) -> Column:
    """Without white space, punctuation and symbols, lower case: for comparing names."""
    return F.lower(F.regexp_replace(c, r"(?U)[\s\p{P}\p{S}]", ""))


def city_from_address(c: Column, cities=CITIES) -> Column:
    """The first of the cities, in list order, that the address contains; null if none."""
    folded = fold_variant_char(c)
    found = F.coalesce(*[F.when(folded.contains(x), F.lit(x)) for x in cities])
    return found if any(x.isascii() for x in cities) else F.when(~is_ascii(c), found)


def clip_text(c: Column, n: int) -> Column:
    """At most n characters, with an ellipsis for what is cut."""
    return F.when(F.char_length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit("…"))).otherwise(c)


def host_label(url: Column, suffix: str) -> Column:
    """The label right before a host suffix, lower case; null if the host is another."""
    host = F.lower(F.regexp_extract(url, r"^https?://([^/?#:]+)", 1))
    quoted = suffix.replace(".", r"\.")
    return F.nullif(F.regexp_extract(host, rf"([^.]+){quoted}$", 1), F.lit(""))


def safe_url(c: Column) -> Column:
    """The URL if it is http or https, else null."""
    return F.when(c.rlike(r"(?i)^https?://"), c)


#: Cities that stand before a venue's name without being part of it.
PREFIX_CITIES = ("台北", "新北", "桃園", "新竹", "台中", "台南", "高雄", "基隆")


def _key(c: Column, aliases: dict[str, str] | None) -> Column:
    base = utrim(F.lower(fold_variant_char(F.regexp_replace(c, "[·・‧•]", ""))))
    latin = r"\s+([a-z0-9 .'&-]+)$"
    city = F.regexp_extract(base, rf"(?U)^({'|'.join(PREFIX_CITIES)}){latin}", 2)
    head = F.regexp_extract(base, rf"(?U)^(.*[\u4e00-\u9fff]){latin}", 1)
    key = F.regexp_replace(F.when(city != "", city).when(head != "", head).otherwise(base), r"(?U)\s", "")
    if aliases:
        key = F.coalesce(F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])[key], key)
    return key


def venue_key(c: Column, aliases: dict[str, str] | None = None) -> Column:
    """A key that spellings of one venue share.

    Compatibility forms, variant characters, case, spaces and middle dots fold; a Latin
    name behind a space and a Chinese one goes, unless the Chinese one is a bare city,
    which goes itself; then aliases map keys to keys. Null is the empty key.
    """
    return _key(nfkc(F.coalesce(c, F.lit(""))), aliases)


def _venue_parts(c: Column) -> Column:
    """What a field that lists venues holds, split at list marks and ampersands."""
    return F.filter(F.transform(F.split(c, r"(?U)\s*[、＆]\s*|\s+&\s+"), utrim), lambda x: x != "")


def _composed_parts(parts: Column) -> Column:
    """The same parts after compatibility composition, which joins and splits no part."""
    return F.split(nfkc(F.array_join(parts, "\x01")), "\x01")


def venue_names(c: Column, aliases: dict[str, str] | None = None) -> Column:
    """The venues that a field lists, as written, one for each key; a field of one venue as it is."""
    parts = _venue_parts(c)
    keyed = F.zip_with(_composed_parts(parts), parts, lambda x, name: F.struct(_listed_key(x, aliases).alias("key"), name.alias("name")))
    # where two spellings share a key, the last one's name stands at the first one's place
    last = let(keyed, lambda all_: F.transform(F.array_distinct(all_["key"]), lambda k: F.element_at(F.filter(all_, lambda y: y["key"] == k), -1)["name"]))
    return F.when(F.size(parts) < 2, F.array(c)).otherwise(last)


def _listed_key(c: Column, aliases: dict[str, str] | None) -> Column:
    """The key of one of several venues: of the name in brackets if there is one, which is the one that other spellings use."""
    return _key(F.coalesce(F.nullif(F.regexp_extract(c, r"\[([^\]]+)\]", 1), F.lit("")), c), aliases)


def venue_keys(c: Column, aliases: dict[str, str] | None = None) -> Column:
    """The distinct keys of the venues that a field lists, in order."""
    parts = _venue_parts(c)
    return F.when(F.size(parts) < 2, F.array(venue_key(c, aliases))).otherwise(F.array_distinct(F.transform(_composed_parts(parts), lambda x: _listed_key(x, aliases))))


def any_of(c: Column, words) -> Column:
    """Whether the text holds any of the literal words."""
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words], F.lit(False))


def quoted_pattern(words) -> str:
    """A pattern that matches any of the literal words."""
    return "|".join(r"\Q" + w + r"\E" for w in words)
