"""Embedded objects, venue keys, labels, structured documents and roll-ups in the cases where readings differ."""

import json
import random

import pytest
from pyspark.sql import functions as F

from marquee.functions import price, status, text
from marquee.operators import relations
from marquee.sources import extract, publish


def one(spark, column, kind, value):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("page, found", [
    ('{"a": {"b": 1}, "id": 5}', ['{"a": {"b": 1}, "id": 5}']),
    ('x = {"s": "{", "id": 5};', ['{"s": "{", "id": 5}']),
    ('{"id": 1, "in": {"id": 2}, "n": {"k": 3}}', ['{"id": 2}', '{"id": 1, "in": {"id": 2}, "n": {"k": 3}}']),
    ('{"s": "\\"id\\"", "k": 1} {"s": "a\\\\", "id": 1}', ['{"s": "a\\\\", "id": 1}']),
    ('} {"id": 1', []), ('{"id": "never closed } ', []), ("", []), (None, None), ('"id"', []),
])
def test_embedded_objects(spark, page, found):
    assert one(spark, extract.embedded_objects('"id"'), "string", page) == found


def plain_scan(text, marker):
    """Character by character."""
    out, stack, quoted, skip = [], [], False, False
    for i, c in enumerate(text):
        if not quoted and stack and text.startswith(marker, i):
            stack[-1][1] = True
        if quoted:
            if skip:
                skip = False
            elif c == "\\":
                skip = True
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c == "{":
            stack.append([i, False])
        elif c == "}" and stack:
            begin, hit = stack.pop()
            if hit:
                out.append(text[begin:i + 1])
    return out


def test_embedded_objects_as_by_characters():
    rng = random.Random(4)
    for _ in range(4000):
        text = "".join(rng.choice(['"id"', "id", "{", "}", '"', "\\", "x", "\n", '"a"', "{{", "}}"]) for _ in range(rng.randrange(25)))
        for marker in ('"id"', "id", '{"a"', "x"):
            assert extract._objects(text, marker) == plain_scan(text, marker), (text, marker)


def test_pushed_chunks(spark):
    blob = '{"list": [{"a": {"b": "}"}, "shows": []}]}'
    push = lambda t: f"self.push([1,{json.dumps(t)}])"
    page = "<p>" + push(blob[:15]) + ' self.push([1,"\\x"]) self.push([2,"{}"]) ' + push(blob[15:]) + '{"shows": 1}'
    assert one(spark, extract.embedded_objects('"shows"', "self.push"), "string", page) == ['{"a": {"b": "}"}, "shows": []}']


def test_long_page_is_scanned_once():
    text = '{"n": {"k": "' + "\\\"}{" * 200_000 + '"}, ' + '"s": {"a": [1]}, ' * 100_000 + '"id": 1}'
    assert extract._objects(text, '"id"') == [text]


@pytest.mark.parametrize("venue, key", [
    ("台北 The Wall Live House", "thewalllivehouse"), ("台北 Arena", "arena"), ("臺北小巨蛋 Taipei Arena", "台北小巨蛋"), ("小巨蛋Arena", "小巨蛋arena"), ("Comedy Plus 卡米地＋", "comedyplus卡米地+"),
    ("ＡＢＣ　Hall", "abchall"), ("苗栗 Arena", "苗栗"), ("台北・小巨蛋", "台北小巨蛋"), ("台北", "台北"), ("", ""), (None, ""), ("West ar", "star"),
])
def test_venue_key(spark, venue, key):
    assert one(spark, lambda c: text.venue_key(c, {"westar": "star"}), "string", venue) == key


def test_listed_venues_fold_compatibility_forms(spark):
    rows = spark.createDataFrame([("Ｈａｌｌ Ａ、hall a & 乙廳 [Hall Ｂ]",)], "v string")
    assert tuple(rows.select(text.venue_keys(F.col("v")), text.venue_names(F.col("v"))).first()) == (["halla", "hallb"], ["hall a", "乙廳 [Hall Ｂ]"])


def test_labels(spark):
    assert one(spark, status.status_label, "string", "sold_out") == "結束販售"
    assert [one(spark, price.price_label, "double", x) for x in (None, 0.0, 1200.0, 1200.5)] == ["票價未公布", "NT$0 up", "NT$1,200 up", "NT$1,200.5 up"]


@pytest.mark.parametrize("children, signal", [
    ([(1, "REGISTRATION_CLOSED"), (1, "REGISTRATION_CLOSED")], "REGISTRATION_CLOSED"), ([(1, "REGISTRATION_CLOSED"), (1, "SOLD_OUT")], "SOLD_OUT"), ([(1, "SOLD_OUT"), (1, None)], None),
    ([(1, None), (1, "IN_STOCK")], "IN_STOCK"), ([(1, None), (1, "COMING_SOON")], "COMING_SOON"), ([(1, "SOLD_OUT"), (2, None)], "SOLD_OUT"), ([(2, "SOLD_OUT"), (None, None)], None), ([(1, None)], None),
])
def test_child_rollup(spark, children, signal):
    parents = spark.createDataFrame([(7, 1)], "id int, date int")
    kids = spark.createDataFrame([(7, d, s) for d, s in children], "id int, date int, signal string")
    assert [tuple(r) for r in relations.child_rollup(parents, kids).collect()] == [(7, signal)]


SESSION = "struct<date:string,time:string,venue:string,city:string,status:string>"


def document(spark, **given):
    row = dict(id="x", title="T", date="2026-05-01", date_end="2026-05-01", time=None, venue="V", city="台北", status="on_sale", on_sale_at="2026-04-01T12:00:00+08:00", price_min=500, ticket_url="u",
               headliners=[], image=None, sources=[("s",)], sessions=[]) | given
    kinds = ("id string, title string, date string, date_end string, time string, venue string, city string, status string, on_sale_at string, price_min int, ticket_url string, headliners array<string>, "
             f"image string, sources array<struct<name:string>>, sessions array<{SESSION}>")
    rows = spark.createDataFrame([tuple(row.values())], kinds).withColumns({c: F.to_date(c) for c in ("date", "date_end")})
    return json.loads(rows.select(publish.jsonld("https://a.test").alias("d")).first().d)


def test_structured_documents(spark):
    plain = document(spark)
    assert plain["offers"] == {"@type": "Offer", "url": "u", "price": 500, "priceCurrency": "TWD", "availability": "https://schema.org/InStock"}
    assert plain["location"]["address"] == {"@type": "PostalAddress", "addressCountry": "TW", "addressLocality": "台北"} and plain["startDate"] == "2026-05-01"
    assert not {"endDate", "performer", "subEvent", "image"} & plain.keys() and plain["url"] == "https://a.test/e/x.html"
    assert plain["description"] == "T｜2026/05/01（五） 於台北 V，NT$500 起，售票中。資料來源：s。"
    assert "offers" not in document(spark, status="ended") and "offers" not in document(spark, price_min=None) and "offers" not in document(spark, status=None)
    assert document(spark, status="announced")["offers"]["validFrom"] == "2026-04-01T12:00:00+08:00"
    unknown = document(spark, city="未知", venue="")
    assert unknown["location"] == {"@type": "Place", "name": "未知", "address": {"@type": "PostalAddress", "addressCountry": "TW"}} and "於" not in unknown["description"]
    full = document(spark, date_end="2026-05-03", headliners=["A", "B"], image="i", sessions=[("2026-05-01", "19:30", "V", "台北", "sold_out"), ("2026-05-03", None, "W", "未知", "ended")])
    assert full["endDate"] == "2026-05-03" and [p["name"] for p in full["performer"]] == ["A", "B"]
    first, second = full["subEvent"]
    assert first["startDate"] == "2026-05-01T19:30:00+08:00" and first["offers"]["availability"] == "https://schema.org/SoldOut" and "offers" not in second and second["performer"] == full["performer"]
