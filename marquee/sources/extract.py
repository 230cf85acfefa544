"""Extraction from captured pages, as Column expressions and DataFrame jobs over raw_page (source, url, html)."""

from __future__ import annotations

import json
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from marquee.functions.price import html_to_lines
from marquee.functions.text import let, nfkc, utrim

EVENT_SCHEMA = "struct<`@type`:string,name:string,startDate:string,location:struct<name:string>,offers:array<struct<availability:string,validFrom:string,validThrough:string,price:string>>>"


def jsonld_events(html: Column, schema: str = EVENT_SCHEMA) -> Column:
    """The first event of a page's JSON-LD blocks that has a start; blocks may be objects or arrays, bad JSON is passed over."""
    blocks = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    many = lambda b: F.coalesce(F.from_json(F.when(F.trim(b).startswith("["), b).otherwise(F.concat(F.lit("["), b, F.lit("]"))), f"array<{schema}>"), F.array().cast(f"array<{schema}>"))
    events = F.flatten(F.transform(blocks, many))
    return F.get(F.filter(events, lambda e: F.coalesce(e["@type"] == "Event", F.lit(False)) & F.coalesce(e["startDate"].rlike(r"^\d{4}-\d{2}-\d{2}"), F.lit(False))), F.lit(0))


def embedded_objects(marker: str, pushed: str | None = None):
    """A function from text columns to arrays of the JSON objects, as text, that hold a marker themselves, not in an object inside.

    One pass with a stack of open objects: a marker outside strings flags the innermost
    one, which is cut out at its closing brace. Objects come in the order in which they
    close; what isn't closed gives nothing. With pushed, the name of a call, the text is
    first put together from the string chunks of `pushed([1,"..."])` calls, unescaped;
    chunks that can't be are passed over. Null gives null.
    """

    @F.pandas_udf(ArrayType(StringType()))
    def scan(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else _objects(_chunks(t, pushed) if pushed else t, marker))

    return scan


#: A string with its escapes, to its end or the text's; or a brace.
_MARKS = re.compile(r'"[^"\\]*+(?:\\.[^"\\]*+)*+"?|[{}]', re.DOTALL)


def _chunks(text: str, call: str) -> str:
    out = []
    for m in re.finditer(re.escape(call) + r'\(\[1,("[^"\\]*+(?:\\.[^"\\]*+)*+")\]\)', text, re.DOTALL):
        try:
            out.append(json.loads(m[1]))
        except ValueError:
            continue
    return "".join(out)


def _objects(text: str, marker: str) -> list[str]:
    out, stack, at = [], [], 0
    for m in _MARKS.finditer(text):
        # a marker that begins between the last string or brace and this one, or with it
        if stack and text.find(marker, at, m.start() + len(marker)) >= 0:
            stack[-1][1] = True
        at = m.end()
        if m[0] == "{":
            stack.append([m.start(), False])
        elif m[0] == "}" and stack:
            begin, flagged = stack.pop()
            if flagged:
                out.append(text[begin:at])
    return out


def decode_entities(c: Column) -> Column:
    """The five basic entities, the ampersand's last so that nothing is decoded twice."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def lines(html: Column) -> Column:
    """The non-empty lines of a page's text."""
    return F.filter(F.transform(F.split(html_to_lines(html), "\n"), utrim), lambda x: x != "")


def labeled_field(html: Column, labels: str, *, following: int = 6, most: int = 200) -> Column:
    """The value behind a label; if its line has none, the next lines up to another label, joined by " / ". Cut to `most` characters."""
    def read(ls):
        places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(ls) - 1, F.lit(0))), lambda i: F.get(ls, i).rlike(f"^(?:{labels})[^｜：:|]{{0,10}}[｜：:|]"))
        return let(F.get(places, F.lit(0)), lambda at: F.when(at.isNotNull(), F.coalesce(own_line(ls, at), let(F.slice(ls, at + 2, F.lit(following)), next_lines))))

    def own_line(ls, at):
        return F.nullif(utrim(F.regexp_extract(F.get(ls, at), r"[｜：:|](.*)$", 1)), F.lit(""))

    def next_lines(after):
        stop = F.array_position(F.transform(after, lambda x: x.rlike(r"^[^｜：:|]{1,10}[｜：:|]")), F.lit(True))
        return F.nullif(F.array_join(F.when(stop > 0, F.slice(after, F.lit(1), (stop - 1).cast("int"))).otherwise(after), " / "), F.lit(""))

    return F.substring(let(lines(html), read), 1, most)


def table_rows(html: Column) -> Column:
    """The cells, as text, of each table row."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cell = lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda x: utrim(F.regexp_replace(x, "<[^>]+>", "")))
    return F.filter(F.transform(rows, cell), lambda r: F.size(r) > 0)


def typed_rows(html: Column, columns: dict[str, tuple[int, str]]) -> Column:
    """Table rows as structs of named columns (cell number from 0, type).

    Numbers may have thousands separators and a currency before them. A cell that is
    missing or isn't of its type is null; rows without any readable cell go.
    """

    def field(row, name, at, kind):
        text = F.get(row, F.lit(at))
        if kind in ("int", "long", "double"):
            text = F.replace(F.regexp_extract(text, r"(-?\d[\d,]*(?:\.\d+)?)", 1), F.lit(","), F.lit(""))
        return F.nullif(text, F.lit("")).try_cast(kind).alias(name)

    rows = F.transform(table_rows(html), lambda r: F.struct(*[field(r, name, at, kind) for name, (at, kind) in columns.items()]))
    return F.filter(rows, lambda r: reduce(lambda x, y: x | y, [r[name].isNotNull() for name in columns]))


def struck_prices(html: Column) -> Column:
    """Tiers (price, closed) of a price list; a price that is struck out is a closed tier."""
    marked = F.regexp_replace(html, r"(?is)<(s|del)\b[^>]*>(.*?)</\1>", "~$2~")
    parts = F.split(F.regexp_replace(marked, "<[^>]+>", ""), r"[、/／]|\n")
    price = lambda p: F.replace(F.regexp_extract(p, r"([\d,]{2,})", 1), F.lit(","), F.lit("")).try_cast("double")
    return F.filter(F.transform(parts, lambda p: F.struct(price(p).alias("price"), p.contains("~").alias("closed"))), lambda t: t["price"].isNotNull())


def og_image(html: Column, generic: str = "default|logo|placeholder", host: str = "") -> Column:
    """The page's og:image unless it is a generic one; else the first image of the host."""
    og = F.nullif(F.regexp_extract(html, r'(?i)<meta[^>]+property="og:image"[^>]+content="([^"]+)"', 1), F.lit(""))
    img = F.nullif(F.regexp_extract(html, rf'(?i)<img[^>]+src="(https?://[^"]*{host}[^"]*)"', 1), F.lit(""))
    return F.coalesce(F.when(~F.lower(og).rlike(generic), og), img)


def child_links(html: Column, own: Column, pattern: str, most: int = 8) -> Column:
    """The first distinct ids of links to other pages."""
    found = F.array_distinct(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)))
    return F.slice(F.filter(found, lambda x: ~x.eqNullSafe(own)), 1, most)


def routed(html: Column, routes: list[tuple[str, Column]]) -> Column:
    """The extraction of the first route whose mark the page holds and that finds something."""
    return F.coalesce(*[F.when(html.contains(mark), got) for mark, got in routes])


def tiers_from_map(prices: Column, available: Column | None = None) -> Column:
    """Tiers (name, price, closed) from a map of names to prices, without pair tickets."""
    kept = F.filter(F.map_entries(prices), lambda e: ~F.lower(e["key"]).startswith("pair"))
    closed = (lambda e: ~F.coalesce(available[e["key"]], F.lit(True))) if available is not None else (lambda e: F.lit(False))
    return F.transform(F.sort_array(kept), lambda e: F.struct(e["key"].alias("name"), e["value"].cast("double").alias("price"), closed(e).alias("closed")))


def tiers_from_range(low: Column, high: Column) -> Column:
    """Tiers that stand for a price range, or for free entry."""
    tier = lambda n, p: F.struct(F.lit(n).alias("name"), p.cast("double").alias("price"), F.lit(False).alias("closed"))
    return F.when(low.isNull(), F.array().cast("array<struct<name:string,price:double,closed:boolean>>")).when(high == 0, F.array(tier("free", F.lit(0)))).when(low == high, F.array(tier("from", low))).otherwise(F.array(tier("from", low), tier("to", high)))


def price_paragraph(html: Column) -> Column:
    """The first line with a price, without vouchers that it includes and prices for pairs."""
    first = F.get(F.filter(lines(html), lambda x: x.contains("NT$")), F.lit(0))
    return utrim(F.regexp_replace(F.regexp_replace(first, r"[（(]?含[^）)\n]{0,20}?\d[\d,]*\s*元[^）)\n]{0,10}[）)]?", ""), r"(?i)pair[^\d\n]{0,12}[\d,]+", ""))


def title_clean(c: Column) -> Column:
    """A title in its compatibility form (NFKC), without a trailing date code and a dangling bar."""
    return utrim(F.regexp_replace(F.regexp_replace(utrim(nfkc(c)), r"\s*[(（]?\d{4}[)）]?$", ""), r"\s*[|｜/]\s*$", ""))


def cell_date(cell: Column) -> Column:
    """The date text of a cell: a time element's attribute, else its text."""
    return F.coalesce(F.nullif(F.regexp_extract(cell, r'(?i)<time[^>]+datetime="([^"]+)"', 1), F.lit("")), F.nullif(utrim(F.regexp_replace(cell, "<[^>]+>", " ")), F.lit("")))


def cell_venue(cell: Column) -> Column:
    """Struct (venue, address, note) of a cell: the link's text, the address out of a map link, and the text around."""
    link = r'(?is)<a[^>]+href="([^"]+)"[^>]*>(.*?)</a>'
    query = F.nullif(F.regexp_extract(F.regexp_extract(cell, link, 1), r"[?&]q=([^&]+)", 1), F.lit(""))
    name = F.nullif(utrim(F.regexp_replace(F.regexp_extract(cell, link, 2), "<[^>]+>", "")), F.lit(""))
    rest = F.nullif(utrim(F.regexp_replace(F.regexp_replace(cell, link, " "), "<[^>]+>", " ")), F.lit(""))
    return F.struct(F.coalesce(name, rest).alias("venue"), F.try_url_decode(query).alias("address"), F.when(name.isNotNull(), rest).alias("note"))


def session_blocks(html: Column, block: str, moment: str, venue: str, address: str) -> Column:
    """Sessions (moment, venue, address) of repeated blocks; what a block lacks is null, blocks without a well-formed moment go."""
    blocks = F.regexp_extract_all(html, F.lit(block), F.lit(1))
    part = lambda b, pattern: F.nullif(utrim(F.regexp_extract(b, pattern, 1)), F.lit(""))
    rows = F.transform(blocks, lambda b: F.struct(part(b, moment).alias("moment"), part(b, venue).alias("venue"), part(b, address).alias("address")))
    return F.filter(rows, lambda r: r["moment"].rlike(r"^\d{4}[-/]\d{2}[-/]\d{2}"))


def preferred(structured: Column, template: Column) -> Column:
    """What structured data say, else what the template says."""
    return F.coalesce(F.nullif(structured, F.lit("")), F.nullif(template, F.lit("")))


def detail_signal(known: Column, excluded: Column, offers: Column, children: Column, table: Column) -> Column:
    """The sale signal of a detail page: the known one; none for pages that rules leave out; then of offers, child pages, the price table."""
    return F.when(known.isNotNull(), known).when(~F.coalesce(excluded, F.lit(False)), F.coalesce(offers, children, table))


def shape_listing(df: DataFrame, source: str, fields: dict[str, Column | list[Column]]) -> DataFrame:
    """A source's extracted fields as listings: raw_id, url, title, venue joined with its address, and what else is given.

    A raw_id of several parts, as for a page with many sessions, is joined by dashes without the parts that are null.
    """
    cols = {"source": F.lit(source)} | fields
    if isinstance(cols.get("raw_id"), list):
        cols["raw_id"] = F.concat_ws("-", *[c.cast("string") for c in cols["raw_id"]])
    if "venue" in cols and "address" in cols:
        cols["venue"] = F.concat_ws(" / ", F.nullif(cols["venue"], F.lit("")), F.nullif(cols.pop("address"), F.lit("")))
    return df.select(*[c.alias(k) for k, c in cols.items()])
