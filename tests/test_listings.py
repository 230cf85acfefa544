"""Behaviours with names of their own, on tiny inputs."""

import datetime as dt
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from marquee.functions import classify, dates, price, status, text
from marquee.operators import browse, dedupe, match, normalize, order, prefs, quality, relations, runs, snapshot
from marquee.sources import extract, publish, tables
from marquee.streaming import streams
from tests.measured import shuffled_bytes

DAY = dt.date(2026, 5, 1)


def one(spark, column, **values):
    """The value of an expression over one row."""
    kinds = ", ".join(f"{k} {v[0]}" for k, v in values.items())
    frame = spark.createDataFrame([tuple(v[1] for v in values.values())], kinds) if values else spark.range(1)
    return frame.select(column.alias("x")).first().x


def listing(**kw):
    row = dict(source="a", priority=1, raw_id="r", name="Act", title="Act live", venue="Hall", city="台北", date=DAY, time="19:00", special=False, price_min=None, price_max=None, lineup=["Act"], ord=0)
    return row | kw


SCHEMA = "source string, priority int, raw_id string, name string, title string, venue string, city string, date date, time string, special boolean, price_min double, price_max double, lineup array<string>, ord int"


def merged(spark, *rows):
    frame = spark.createDataFrame([tuple((r | {"ord": k})[c] for c in listing()) for k, r in enumerate(rows)], SCHEMA)
    return sorted(dedupe.dedupe_events(frame).collect(), key=lambda r: r.id)


@pytest.mark.parametrize("rows, n", [
    ([listing(), listing(source="b", name="A ct", venue=" HALL ")], 1),
    ([listing(), listing(name="Other")], 2),
    ([listing(time="14:00"), listing(time="19:00")], 2),
    ([listing(time="13:00"), listing(time="16:30")], 2),
    ([listing(time="19:00"), listing(time="19:30")], 1),
    ([listing(time="13:00"), listing(time="14:20"), listing(time="15:40")], 1),
    ([listing(time=None), listing(time="19:00"), listing(time="14:00")], 2),
    ([listing(date=dt.date(2026, 5, 2)), listing()], 2),
])
def test_dedupe_counts(spark, rows, n):
    assert len(merged(spark, *rows)) == n


def test_dedupe_ids_and_base(spark):
    day, evening = merged(spark, listing(time="14:00"), listing(time="19:00"))
    assert day.id.endswith("-day") and evening.id.endswith("-evening") and day.id[:16] == evening.id[:16]
    plain, = merged(spark, listing(raw_id="s", special=True, price_min=900.0, price_max=900.0), listing(raw_id="p", price_min=500.0, price_max=700.0, lineup=["Act", "Guest"]))
    assert [s.raw_id for s in plain.sources] == ["p", "s"] and (plain.price_min, plain.price_max) == (500, 900) and plain.lineup == ["Act", "Guest"]
    tie, = merged(spark, listing(raw_id="free"), listing(raw_id="paid", price_min=1.0))
    assert tie.sources[0].raw_id == "paid"
    better, = merged(spark, listing(raw_id="two", priority=2), listing(raw_id="one", special=True))
    assert better.sources[0].raw_id == "one"


def test_timeless_rows_follow_the_first_timed_row(spark):
    rows = merged(spark, listing(raw_id="x", time="19:00"), listing(raw_id="none", time=None), listing(raw_id="y", time="14:00"))
    assert {s.raw_id for s in next(r for r in rows if r.id.endswith("evening")).sources} == {"x", "none"}


def test_dedupe_is_blind_to_partitioning(spark):
    frame = spark.createDataFrame([tuple((listing(name=f"n{k % 9}", time=f"{10 + k % 12}:00") | {"ord": k})[c] for c in listing()) for k in range(200)], SCHEMA)
    a, b = (sorted(dedupe.dedupe_events(f).collect()) for f in (frame.coalesce(1), frame.repartition(7)))
    assert a == b


def test_a_group_of_any_size_is_judged_by_its_minutes(spark):
    rng = random.Random(8)
    rows = [listing(raw_id=str(k), name="Act" if k % 3 else f"n{k % 40}", time=rng.choice([None, "x", *(f"{rng.randrange(9, 23)}:{rng.randrange(0, 60, 20):02d}" for _ in range(3))])) | {"ord": rng.randrange(10**6)} for k in range(6000)]
    frame = spark.createDataFrame([tuple(r[c] for c in listing()) for r in rows], SCHEMA)
    keyed = dedupe.resolve_ids(frame).withColumn("minute", dedupe.minutes_of(F.col("time")))
    assert dedupe.island_cells(keyed).groupBy("base_id").count().agg(F.max("count")).first()[0] <= 14 * 3
    got = {r.raw_id: (r.bucket, r.island) for r in keyed.collect()}
    groups = {}
    for r in rows:
        groups.setdefault(r["name"], []).append(r)
    minute = lambda r: int(r["time"].split(":")[0]) * 60 + int(r["time"][-2:]) if r["time"] and ":" in r["time"] else None
    for own in groups.values():
        own.sort(key=lambda r: (r["ord"], minute(r) or 0))
        first = next((r for r in own if minute(r) is not None), None)
        half = lambda r: None if minute(r) is None else "day" if minute(r) < 17 * 60 else "evening"
        split = len({half(r) for r in own} - {None}) > 1
        for bucket in {half(r) for r in own} - {None}:
            times = sorted({minute(r) for r in own if minute(r) is not None and (not split or half(r) == bucket)})
            starts = [t for t, before in zip(times, [-999, *times]) if t - before > dedupe.GAP_MINUTES]
            label = lambda r: max(t for t in starts if t <= minute(r))
            shown = lambda t: min((r["time"] for r in own if minute(r) is not None and (not split or half(r) == bucket) and label(r) == t))
            names = {t: shown(t) for t in starts}
            for r in own:
                at = first if minute(r) is None else r
                if not split or half(at) == bucket:
                    assert got[r["raw_id"]] == (bucket if split else None, names[label(at)] if len(starts) > 1 else None)


def test_positions_in_groups_of_any_size(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", None, "b"]), rng.randrange(50), k, -1) for k in range(3000)]
    frame = spark.createDataFrame(rows, "g string, o int, id int, position int").repartition(5)
    got = order.positions(frame, ["g"], [F.desc("o"), "id"])
    want = {}
    for g, o, k, _ in sorted(rows, key=lambda r: (-r[1], r[2])):
        want.setdefault(g, []).append(k)
    assert {(r.g, r.position): r.id for r in got.collect()} == {(g, n): k for g, ids in want.items() for n, k in enumerate(ids, 1)}
    assert order.positions(frame.limit(0), ["g"], ["id"]).collect() == []


def test_runs(spark):
    row = lambda d, s, at=None, p=None, v="H": ("k", dt.date(2026, 5, d), "19:00", s, at, p, p, v, "台北", d, f"t{d}")
    kinds = "run_key string, date date, time string, status string, on_sale_at string, price_min double, price_max double, venue string, city string, ord int, title string"
    today = F.lit(dt.date(2026, 5, 10))
    got = runs.group_runs(spark.createDataFrame([row(1, "on_sale", p=100.0), row(12, "sold_out"), row(14, "announced", "2026-05-11", 900.0, "V"), row(13, "announced", "2026-05-12")], kinds), today).first()
    assert (got.status, got.on_sale_at, got.date.day, got.date_end.day, got.title, got.price_min, got.price_max, len(got.sessions)) == ("announced", "2026-05-11", 12, 14, "t12", 100, 900, 4)
    assert got.sessions[3].venue == "V"
    over = runs.group_runs(spark.createDataFrame([row(1, "on_sale"), row(3, "on_sale")], kinds), today).first()
    assert (over.status, over.date.day, over.date_end.day, over.id) == ("ended", 1, 3, got.id)


def test_prices_from_tiers(spark):
    t = lambda *rows: one(spark, price.price_from_tiers(F.col("t")), t=("array<struct<price:double,closed:boolean>>", list(rows)))
    assert t((500.0, True), (800.0, False)) == (800, 800)
    assert t((500.0, True), (800.0, True)) == (500, 800)
    assert t((None, False)) == (None, None) and t() == (None, None)


@pytest.mark.parametrize("raw, low, high", [
    ("★票價：NT$2,450起，最高NT$6,010\n另收手續費75元", 2450, 6010), ("票價｜9,300 / 4,100 / 2,700", 2700, 9300), ("ＡＤＶ．ＮＴ＄４２０／ＤＯＯＲ．ＮＴ＄５６０", 420, 560),
    ("票　　價｜1,350元", 1350, 1350), ("票價：NT$1,450<br>身障席 725 元", 1450, 1450), ("票價：身障席 725 元", None, None), ("【票價】<br>坐席｜NTD 2,900<br>身障坐席｜NTD 1,450", 2900, 2900),
    ("票價｜預售單人$𝟰𝟮𝟬", 420, 420), ("free of numbers", None, None), ("just NT$ 910 at hand", 910, 910), (None, None, None), ("票價：15元", None, None),
])
def test_prices_from_text(spark, raw, low, high):
    assert one(spark, price.price_from_text(F.col("x")), x=("string", raw)) == (low, high)


@pytest.mark.parametrize("raw, at", [
    ("售票時間：2031/03/08（六）10:30 開放", "2031-03-08T10:30:00+08:00"), ("開賣時間：2031 年 04 月 05 日 9:15", "2031-04-05T09:15:00+08:00"), ("起售時間｜2031年12月1日 20:00", "2031-12-01T20:00:00+08:00"),
    ("開放售票：3月9日早上", None), ("停止售票：2031/03/08 10:30", None), ("說明\n\n開賣\n 時間：2031/05/06 08:00", "2031-05-06T08:00:00+08:00"), ("開賣：2031/3/4", "2031-03-04T00:00:00+08:00"), (None, None), ("", None),
    ("售票：截止售票：2031/01/01 開賣：2031/2/2 11:00", "2031-02-02T11:00:00+08:00"),
])
def test_sale_start(spark, raw, at):
    assert one(spark, price.on_sale_at(F.col("x")), x=("string", raw)) == at


def test_status(spark):
    def of(tiers, signal=None, date=DAY):
        return one(spark, status.status_from_tiers(F.col("t"), F.col("s"), F.col("d"), F.lit(DAY), F.lit("soon")), t=("array<struct<closed:boolean,waiting:boolean,on_sale_at:string>>", tiers), s=("string", signal), d=("date", date))

    assert of([(True, False, None)]).status == "sold_out" and of([(True, False, None)], date=dt.date(2026, 4, 1)).status == "ended"
    assert of([(False, False, None)], "SOLD_OUT").status == "sold_out" and of([], "IN_STOCK").status == "on_sale"
    assert tuple(of([(False, True, "b"), (False, True, "a")])) == ("announced", "a")
    assert tuple(of([], "COMING_SOON")) == ("announced", "soon") and tuple(of(None)) == ("announced", None)


def test_refresh(spark):
    def of(state, at, date, signal, signal_at=None):
        args = dict(s=("string", state), a=("string", at), d=("date", date), g=("string", signal), h=("string", signal_at))
        return one(spark, status.refreshed(F.col("s"), F.col("a"), F.col("d"), F.col("g"), F.col("h"), F.lit("2026-05-01T12"), F.lit(DAY)), **args)

    assert of("on_sale", None, dt.date(2026, 4, 1), "IN_STOCK").status == "ended"
    assert of("announced", "2026-05-01T10", DAY, None).status == "on_sale"
    assert of("announced", "2026-05-02T10", DAY, None) is None and of("on_sale", None, DAY, "IN_STOCK") is None
    assert tuple(of("on_sale", None, DAY, "COMING_SOON", "2026-06-01")) == ("announced", "2026-06-01")


def test_offers(spark):
    def of(*offers):
        return one(spark, status.offers_signal(F.col("o"), F.lit("2026-05-01")), o=("array<struct<availability:string,validFrom:string,validThrough:string>>", list(offers)))

    assert of() is None and of(("SoldOut", None, None)) == "SOLD_OUT" and of(("InStock", None, "2026-04-01")) == "REGISTRATION_CLOSED"
    assert of(("InStock", "2026-06-01", None)) == "COMING_SOON" and of(("InStock", "2026-06-01", None), ("PreSale", None, None)) == "IN_STOCK"


def test_text(spark):
    s = lambda f, x: one(spark, f(F.col("x")), x=("string", x))
    assert s(text.fullwidth_ascii, "ＮＴ＄５００") == "NT$500" and s(text.math_digits, "𝟱𝟬𝟬") == "500" and s(text.hash_norm, " A　b\tC ") == "abc"
    assert s(text.city_from_address, "116台灣臺北市…") == "台北" and s(text.city_from_address, "nowhere") is None
    assert s(text.nfkc, "𝐍𝐄𝐋𝐋") == unicodedata.normalize("NFKC", "𝐍𝐄𝐋𝐋") == "NELL" and s(text.nfkc, None) is None
    assert s(lambda c: text.clip_text(c, 3), "abcd") == "ab…" and s(text.venue_names, "甲、乙 & 丙、甲") == ["甲", "乙", "丙"]
    assert s(text.venue_key, "臺中・展演館 Taichung Hall") == s(text.venue_key, "台中展演館") and s(text.venue_key, "台北 Arena") == "arena"


def test_dates(spark):
    p = lambda x, g: tuple(one(spark, dates.parse_date(F.col("x"), F.lit(g)), x=("string", x)))
    assert p("2026/5/1(五) 19:30", "slash") == (DAY, "19:30") and p("2026/05/01 18:00 入場 19:30", "slash_time") == (DAY, "19:30")
    assert p("2026 年 5 月 1 日", "words") == (DAY, None) and p("2026.5.1 7:05", "words") == (DAY, "07:05") and p("2026-05-01", "dash") == (DAY, None)
    assert p("2026-02-31", "dash") == (None, None) and p(None, "dash") == (None, None) and p("x", "slash") == (None, None)
    weeks = one(spark, dates.month_grid(F.lit(DAY)))
    assert all(len(w) == 7 for w in weeks) and [d for w in weeks for d in w if d] == [dt.date(2026, 5, k) for k in range(1, 32)] and weeks[0].index(DAY) == 5
    assert one(spark, dates.append_time(F.lit("2026/05/01"), F.lit("7:05 pm"))) == "2026/05/01 19:05"


NAMES = [("IVE", "IVE", 0), ("MONO", "MONO", 1), ("MONO NO AWARE", "MONO NO AWARE", 2), ("NO", "NO", 3), ("王", "王", 4), ("王小明", "王小明", 5)]


@pytest.mark.parametrize("title, heads", [
    ("LIVE tour", []), ("ive LIVE", ["IVE"]), ("MONO NO AWARE 2026", ["MONO NO AWARE", "NO"]), ("王小明演唱會", ["王小明"]), ("unknown", []), ("", []), (None, []),
])
def test_dictionary(spark, title, heads):
    frame = spark.createDataFrame([(1, title)], "id long, title string")
    got = match.headliners(match.match_dictionary(frame, spark.createDataFrame(NAMES, "canonical string, name string, entry_ord int"))).collect()
    assert (got[0].headliners if got else []) == heads


def test_dictionary_equals_all_pairs(spark):
    import random
    import re

    rng = random.Random(2)
    names = [("c%d" % k, "".join(rng.choice("ab 王李") for _ in range(rng.randrange(1, 5))).strip() or "a", k) for k in range(40)]
    titles = [(k, "".join(rng.choice("ab 王李-") for _ in range(rng.randrange(0, 20)))) for k in range(60)]

    def find(t, n):
        if re.fullmatch("[a-z0-9]+", n):
            m = re.search(rf"(?<![a-z0-9]){n}(?![a-z0-9])", t)
            return m.start() + 1 if m else 0
        return t.find(n) + 1

    expect = set()
    for k, t in titles:
        at = {}
        for c, n, o in names:
            if pos := find(t, n):
                at.setdefault(pos, []).append((-len(n), o, c, n))
        expect |= {(k, min(v)[2], min(v)[3], pos) for pos, v in at.items()}
    got = match.match_dictionary(spark.createDataFrame(titles, "id long, title string"), spark.createDataFrame(names, "canonical string, name string, entry_ord int"))
    assert {tuple(r) for r in got.collect()} == expect
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in got._jdf.queryExecution().executedPlan().toString()


def test_city_order(spark):
    rows = spark.createDataFrame([(1, "", None, "高雄場"), (2, "Legacy", None, "台中場"), (3, "Legacy", "臺南市", ""), (4, "x", None, "台中場")], "id int, venue string, address string, title string")
    rules = spark.createDataFrame([("legacy", "台北", 1), ("leg", "花蓮", 2)], "match string, city string, rule_ord int")
    assert {r.id: r.city for r in match.resolve_city(rows, rules).collect()} == {1: "高雄", 2: "台北", 3: "台南", 4: "未知"}


def test_snapshot(spark):
    kinds = "id string, sources array<struct<name:string,raw_id:string>>, status string"
    old = spark.createDataFrame([("a", [("s", "1")], "x"), ("b", [("s", "2")], "x")], kinds)
    new = spark.createDataFrame([("c", [("s", "9"), ("s", "1")], "x"), ("b", [("s", "1")], "y"), ("d", [("s", "7")], "x")], kinds)
    linked = snapshot.id_lineage(new, old)
    assert {r.id: r.old_id for r in linked.collect()} == {"a": "a", "b": None, "d": None}
    got = {r.id: (r.change, r.fields) for r in snapshot.snapshot_diff(old, linked, fields=("status",), include_removed=True).collect()}
    assert got == {"a": ("unchanged", []), "b": ("updated", ["status"]), "d": ("added", None)}
    assert quality.duplicate_ids(linked.unionAll(linked.limit(1))).count() == 1


def test_health_stays_flagged(spark):
    prior = spark.createDataFrame([("a", 5), ("b", 0), ("c", 5)], "source string, last_count long")
    got = snapshot.source_health(prior, spark.createDataFrame([("a", 0), ("b", 0), ("c", None), ("d", 2)], "source string, n long"))
    assert {tuple(r) for r in got.collect()} == {("a", "anomaly", 5), ("b", "ok", 0), ("c", "error", 5), ("d", "ok", 2)}
    again = snapshot.source_health(got.select("source", "last_count"), spark.createDataFrame([("a", 0)], "source string, n long"))
    assert again.where("source = 'a'").first().status == "anomaly"


def test_exclusion_cache(spark):
    now = F.lit(dt.datetime(2026, 5, 10))
    cache = spark.createDataFrame([("s", "1", "classical", dt.datetime(2026, 5, 9)), ("s", "2", "classical", dt.datetime(2026, 5, 1)), ("s", "3", "classical", dt.datetime(2026, 5, 9))], "source string, raw_id string, reason string, checked_at timestamp")
    today = spark.createDataFrame([("s", "1", "classical"), ("s", "2", "classical"), ("s", "4", "junk_title")], "source string, raw_id string, reason string")
    assert [tuple(r) for r in snapshot.skip_list(cache, today, now).collect()] == [("s", "1")]
    assert {r.raw_id for r in snapshot.exclusion_cache(cache, today, now).collect()} == {"1", "2", "3"}


def test_preferences(spark):
    events = spark.createDataFrame([("e1", ["A"], ["t"]), ("e2", ["A", "B"], []), ("e3", None, None)], "id string, headliners array<string>, types array<string>")
    rules = spark.createDataFrame([(1, "artist", "A"), (1, "favourite", "e2"), (1, "type", "t"), (2, "event", "e3"), (2, "event", "e3")], "user_id int, kind string, value string")
    assert {tuple(r) for r in prefs.rule_hits(events, rules).collect()} == {(1, "e1", "artist"), (1, "e2", "favourite"), (2, "e3", "event")}
    log = spark.createDataFrame([(1, "a", "x", "toggle", 1), (1, "a", "y", "add", 1), (1, "a", "y", "toggle", 2), (1, "a", "z", "remove", 3), (1, "a", "z", "toggle", 5), (1, "a", "z", "toggle", 1)], "user_id int, kind string, value string, action string, seq int")
    assert {r.value for r in prefs.fold_log(log).collect()} == {"x", "z"}


def test_view(spark):
    rows = spark.createDataFrame([(1, ["台北"], ["2026-05"], 500.0), (2, ["台中"], ["2026-05"], None), (3, ["台北", "台中"], ["2026-06"], 3000.0)], "id int, cities array<string>, months array<string>, price_min double").withColumn("venues", F.array()).withColumn("types", F.array())
    ids = lambda f: {r.id for r in browse.view_filters(rows, f).collect()}
    assert ids({"city": ["台中"]}) == {2, 3} and ids({"city": [], "month": None}) == {1, 2, 3} and ids({"priceMax": 1000}) == {1, 2} and ids({"city": "台北", "month": ["2026-06"]}) == {3}
    counts = {(r.facet, r.value): r.n for r in browse.facet_counts(rows, {"city": ["台中"], "priceMax": 1000}, {"city": "cities", "month": "months"}).collect()}
    assert counts == {("city", "台北"): 1, ("city", "台中"): 1, ("month", "2026-05"): 1}


def test_relations(spark):
    parents = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    children = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (2, 99)], "id int, child_id int")
    assert [r.id for r in relations.divided(parents, children, spark.createDataFrame([(10,), (11,)], "id int")).collect()] == [1]


def test_extraction(spark):
    s = lambda f, x: one(spark, f(F.col("x")), x=("string", x))
    page = '<script type="application/ld+json">{oops</script><script type="application/ld+json">[{"@type":"Event","name":"no start"},{"@type":"Event","name":"n","startDate":"2026-05-01T19:00"}]</script>'
    assert s(extract.jsonld_events, page).name == "n" and s(extract.jsonld_events, "none") is None and s(extract.jsonld_events, None) is None
    assert [tuple(t) for t in s(extract.struck_prices, "<s>1,200</s> / 800")] == [(1200, True), (800, False)]
    assert s(lambda c: extract.labeled_field(c, "地點"), "<p>地點：</p><p>甲</p><p>乙</p><p>時間：x</p>") == "甲 / 乙"
    assert s(extract.decode_entities, "&amp;lt;&lt;") == "&lt;<" and s(extract.title_clean, "Show (0102) ") == "Show"
    assert s(extract.table_rows, "<table><tr><td>a</td><td> <b>b</b></td></tr></table>") == [["a", "b"]]
    kinds = {"day": (0, "date"), "price": (1, "int")}
    assert [tuple(r) for r in s(lambda c: extract.typed_rows(c, kinds), "<tr><th>day</th></tr><tr><td>2026-05-01</td><td>NT$ 1,200</td></tr><tr><td>x</td><td>free</td></tr><tr><td>x</td><td>7</td></tr>")] == [(dt.date(2026, 5, 1), 1200), (None, 7)]
    assert s(lambda c: extract.typed_rows(c, kinds), None) is None and s(lambda c: extract.typed_rows(c, kinds), "") == []
    blocks = s(lambda c: extract.session_blocks(c, "<div>(.*?)</div>", r"^(\S+)", "<b>(.*?)</b>", "<i>(.*?)</i>"), "<div>2026-05-01 <i>Road</i></div><div>soon <b>v</b></div>")
    assert [tuple(b) for b in blocks] == [("2026-05-01", None, "Road")]
    assert s(extract.title_clean, "Ｓｈｏｗ ｜") == "Show" and s(extract.title_clean, None) is None


def test_venues(spark):
    v = lambda venue, title: one(spark, normalize.clean_venue(F.col("v"), F.col("t"), (("South Rd", "known hall"),)), v=("string", venue), t=("string", title))
    assert v("Club X 📍 https://maps.test/?q=1", "a") == "Club X" and v("Club X 📍", None) == "Club X" and v(None, None) == ""
    assert v("My Show! / 1 South Rd", "my show") == "known hall / 1 South Rd" and v("My Show / 2 North Rd / 2F", "my show") == "2 North Rd / 2F"
    assert v("My Show", "my show") == "My Show" and v("Show", "my show") == "Show"


def test_tables(spark, tmp_path):
    kinds = "id string, n int"
    assert tables.read_snapshot(spark, str(tmp_path / "none.json"), kinds).count() == 0
    (tmp_path / "bad.json").write_text('{"id": "a", "n": 1}\n{oops\n')
    with pytest.raises(Exception):
        tables.read_snapshot(spark, str(tmp_path / "bad.json"), kinds).collect()
    rules = spark.createDataFrame([("noise", "x", 1), ("classical", " ", 1)], "kind string, pattern string, ord int")
    assert tables.read_rules(rules, ("noise",)).count() == 2
    with pytest.raises(ValueError):
        tables.read_rules(rules, ("noise", "classical"))
    out = str(tmp_path / "events")
    for day, n in (("2026-05-01", 3), ("2026-05-02", 2), ("2026-05-02", 1)):
        tables.write_snapshot(spark.range(n).withColumn("v", F.lit("x")), out, day)
    assert tables.latest_snapshot(spark, out).count() == 1 and spark.read.parquet(out).count() == 4
    tables.write_outputs({"events": spark.range(2), "review": spark.range(1), "digest": spark.range(0)}, str(tmp_path / "run"), "2026-05-03")
    assert [tables.latest_snapshot(spark, str(tmp_path / "run" / n)).count() for n in ("events", "review")] == [2, 1]
    parts = extract.shape_listing(spark.createDataFrame([("u", 1), ("u", None)], "url string, n int"), "good", {"raw_id": [F.col("url"), F.col("n")]})
    assert sorted(r.raw_id for r in parts.collect()) == ["u", "u-1"]
    tables.EXTRACTORS.clear()
    tables.register_extractor("good", 1, lambda df: extract.shape_listing(df, "good", {"raw_id": F.col("url"), "venue": F.lit("v"), "address": F.lit("a")}))
    tables.register_extractor("bad", 2, lambda df: df.select("missing"))
    got, errors = tables.extract_all(spark.createDataFrame([("good", "u", "h")], "source string, url string, html string"))
    assert [r.venue for r in got.collect()] == ["v / a"] and set(errors) == {"bad"}


def test_reports(spark):
    good, bad = publish.report_rows(spark.createDataFrame([("e", "hello"), ("e", " "), (None, "x"), ("e", "y" * 2000), ("e", None)], "event_id string, message string"))
    assert good.count() == 1 and bad.count() == 4


def test_outcomes(spark):
    kinds = "id string, source string, title string, venue string, address string, date_text string, price_text string, status_text string, url string, signal string, tiers array<struct<price:double,closed:boolean,waiting:boolean,on_sale_at:string>>"
    rows = [("1", "s", "IVE live", "Legacy", None, "2026/06/01 19:00", "票價：NT$800", "", "u", None, None), ("2", "s", "IVE", "x", None, "soon", None, None, "u", None, None),
            ("3", "s", "test", "x", None, "2026/06/01", None, None, "u", None, None), ("4", "s", None, None, None, None, None, None, None, None, None)]
    names, rules = spark.createDataFrame(NAMES, "canonical string, name string, entry_ord int"), spark.createDataFrame([("legacy", "台北", 1)], "match string, city string, rule_ord int")
    out = normalize.listing_outcomes(spark.createDataFrame(rows, kinds), names, rules, grammars={"s": "slash"}, today=F.lit(DAY))
    got = {r.id: r for r in out.collect()}
    assert {k: (r.outcome, r.reason) for k, r in got.items()} == {"1": ("event", None), "2": ("needs_review", "date_unparseable"), "3": ("excluded", "junk_title"), "4": ("needs_review", "normalize_error")}
    assert (got["1"].headliners, got["1"].city, got["1"].price_min, got["1"].status) == (["IVE"], "台北", 800, "on_sale")
    assert got["2"].detail == "soon" and {r.id: r.reason for r in normalize.review_queue(out).collect()} == {"2": "date_unparseable", "4": "normalize_error"}


def test_outcomes_whole(spark):
    kinds = "id string, source string, title string, venue string, address string, date_text string, price_text string, status_text string, url string, signal string, tiers array<struct<price:double,closed:boolean,waiting:boolean,on_sale_at:string>>, raw_id string, category string, run_key string, on_sale_text string"
    row = lambda id_, title, category=None, sale=None, text="": (id_, "s", title, "x", None, "2020/01/01", None, text, "u", None, None, "r" + id_, category, "run", sale)
    rows = [row("1", "IVE and unknown 音樂祭"), row("2", "nobody known"), row("3", "拼盤 a musical", "音樂劇"), row("4", "IVE", sale="soon"), row("5", "IVE", "音樂劇", "2027-01-01T12:00:00+08:00"), row("6", "登記抽選", text="已售完")]
    names = spark.createDataFrame([(c, n, k, "KR") for c, n, k in NAMES], "canonical string, name string, entry_ord int, origin string")
    rules = spark.createDataFrame([("legacy", "台北", 1)], "match string, city string, rule_ord int")
    overrides = spark.createDataFrame([("category", "5", "")], "field string, key string, value string")
    out = normalize.listing_outcomes(spark.createDataFrame(rows, kinds), names, rules, grammars={"s": "slash"}, today=F.to_date(F.lit("2026-05-01")), overrides=overrides)
    got = {r.id: r for r in out.collect()}
    assert got["1"].is_festival and got["1"].origins == ["KR"] and got["1"].lineup == got["1"].headliners == ["IVE"] and [tuple(x) for x in got["1"].sources] == [("s", "u", "r1")]
    assert got["1"].status == "on_sale" and got["6"].status == "ended" and got["6"].is_lottery  # a past date alone ends nothing
    assert (got["3"].types, got["3"].category, got["3"].run_key) == (["音樂劇"], "音樂劇", "run") and (got["5"].types, got["5"].category, got["5"].run_key) == (["專場"], None, None)
    assert (got["4"].outcome, got["4"].reason, got["4"].detail) == ("needs_review", "normalize_error", "on_sale_text: soon") and got["5"].status == "announced"
    assert {(r.id, r.reason) for r in normalize.review_queue(out).collect()} == {("2", "artist_unrecognized"), ("4", "normalize_error"), ("6", "artist_unrecognized")}
    events, review, excluded = normalize.split_outcomes(out)
    assert events.count() == 5 and review.count() == 3 and excluded.count() == 0 and "reason" not in events.columns


def test_names_near_letters_that_grow_in_lower_case(spark):
    titles = spark.createDataFrame([("1", "İİ abc"), ("2", "İstanbul Trio live"), ("3", "x 甲İ乙 y"), ("4", "甲i̇乙")], "id string, title string")
    names = spark.createDataFrame([("A", "ABC", 0), ("B", "İstanbul Trio", 1), ("C", "甲İ乙", 2)], "canonical string, name string, entry_ord int")
    assert {(r.id, r.canonical) for r in match.match_dictionary(titles, names).collect()} == {("1", "A"), ("2", "B"), ("3", "C")}


def test_lottery(spark):
    of = lambda t, b: one(spark, classify.is_lottery(F.lit(t), F.lit(b), "視餘票"))
    assert of("登記抽選", "") and of("x", "登記抽選 一般開賣") and not of("x", "VIP登記抽選 一般開賣") and not of("x", "登記抽選 一般開賣視餘票") and not of("x", "一般開賣")


def test_status_stream_emits_changes_only(spark, tmp_path):
    at = lambda h: dt.datetime(2026, 5, 1, h)
    rows = [("s", "1", "COMING_SOON", at(12), at(9)), ("s", "1", None, None, at(13)), ("s", "1", "IN_STOCK", None, at(14)), ("s", "1", "SOLD_OUT", None, at(15))]
    kinds = "source string, raw_id string, signal string, on_sale_at timestamp, ts timestamp"
    spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = streams.status_changes(spark.readStream.schema(kinds).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("changes").trigger(availableNow=True).start()
    q.awaitTermination()
    q.stop()
    assert [r.status for r in spark.table("changes").orderBy("changed_at").collect()] == ["announced", "on_sale", "sold_out"]


def test_report_stream(spark, tmp_path):
    spark.createDataFrame([("e", "hi"), ("e", "")], "event_id string, message string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id string, message string").parquet(str(tmp_path / "in"))
    q = streams.write_reports(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/accepted")).count() == 1 and spark.read.parquet(str(tmp_path / "out/quarantined")).count() == 1


def test_source_fallback_takes_each_event_that_lists_the_source(spark):
    fresh = spark.createDataFrame([("a", "9", "new", 1)], "source string, raw_id string, title string, priority int")
    previous = spark.createDataFrame(
        [("e1", "x", [("a", "1"), ("b", "2"), ("b", "5")]), ("e2", "y", [("a", "3")]), ("e3", "z", [("c", "4"), ("b", "6")])],
        "id string, title string, sources array<struct<name string, raw_id string>>")
    health = spark.createDataFrame([("a", "ok"), ("b", "anomaly"), ("c", "error")], "source string, status string")
    got = {tuple(r) for r in snapshot.source_fallback(fresh, previous, health).collect()}
    assert got == {("a", "9", "new", 1), ("b", "2", "x", None), ("b", "6", "z", None), ("c", "4", "z", None)}


def test_styled_names_and_case_of_other_scripts(spark):
    """Titles are folded by NFKC; names that aren't wholly ASCII keep their case."""
    titles = spark.createDataFrame([(1, "\U0001d40d\U0001d404\U0001d40b\U0001d40b live"), (2, "五月天mayday"), (3, "五月天MAYDAY"), (4, "ＰＵＮＫ strike")], "id int, title string")
    names = spark.createDataFrame([("NELL", "NELL", 1), ("Mayday", "五月天MAYDAY", 2), ("Punk", "Punk Strike", 3)], "canonical string, name string, entry_ord int")
    assert {(r.id, r.canonical) for r in match.match_dictionary(titles, names).collect()} == {(1, "NELL"), (3, "Mayday"), (4, "Punk")}


def test_rules_on_titles_of_blank_venues_and_empty_rules(spark):
    rows = spark.createDataFrame([(1, None, " ", "Legacy night"), (2, None, "Zepp", "Legacy night"), (3, None, "", "台南 Legacy")], "id int, address string, venue string, title string")
    rules = spark.createDataFrame([("", "空", 0), ("legacy", "台北", 1)], "match string, city string, rule_ord int")
    assert {r.id: r.city for r in match.resolve_city(rows, rules).collect()} == {1: "台北", 2: "未知", 3: "台南"}


def test_bracketed_venues(spark):
    rows = spark.createDataFrame([("大館 [Big Hall]、小館",), ("大館 [Big Hall] & Big Hall",), ("one",)], "v string")
    got = [(r.k, r.n) for r in rows.select(text.venue_keys(F.col("v")).alias("k"), text.venue_names(F.col("v")).alias("n")).collect()]
    assert got == [(["bighall", "小館"], ["大館 [Big Hall]", "小館"]), (["bighall"], ["Big Hall"]), (["one"], ["one"])]


def test_runs_watch_their_last_day(spark):
    kinds = "id int, date string, date_end string, time string, venue string, status string, price_min double, price_max double, on_sale_at string, sessions array<string>"
    row = lambda i, date, end, sessions: (i, date, end, None, "v", "on_sale", 1.0, 1.0, None, sessions)
    old = spark.createDataFrame([row(1, "a", "z", ["s"]), row(2, "a", None, None), row(3, "a", "y", ["s"])], kinds)
    new = spark.createDataFrame([row(1, "b", "z", ["s"]), row(2, "b", None, None), row(3, "a", "z", ["s"])], kinds)
    got = {r.id: (r.change, r.fields) for r in snapshot.snapshot_diff(old, new, run_col="sessions").collect()}
    assert got == {1: ("unchanged", []), 2: ("updated", ["date"]), 3: ("updated", ["date_end"])}


def test_which_rows_are_read_again(spark):
    rows = spark.createDataFrame([(None, None, None), (True, "on_sale", "SOLD_OUT"), (True, "announced", "IN_STOCK"), (True, "on_sale", "IN_STOCK"), (True, "announced", None)], "known boolean, status string, signal string")
    got = [r[0] for r in rows.select(status.needs_reading(F.col("known"), F.col("status"), F.col("signal"))).collect()]
    assert got == [True, True, True, False, False]


def test_passages_in_whole_texts(spark):
    items = spark.createDataFrame([(1, "b c d e"), (2, "one two three four five six seven eight nine ten eleven"), (3, "x y z not there"), (4, None), (5, "")], "item_id int, text string")
    texts = spark.createDataFrame([("far ahead, a" + "b c d e" + "f behind",), ("zone two three",), ("long before one two three four five six seven eight nine ten elevens",), (None,)], "text string")
    assert {r.item_id: r.found for r in quality.passages_found(items, texts).collect()} == {1: True, 2: True, 3: False, 4: False, 5: False}
    assert [r.found for r in quality.passages_found(items.limit(0), texts).collect()] == [] and {r.found for r in quality.passages_found(items, texts.limit(0)).collect()} == {False}


def test_passages_as_all_pairs(spark):
    rng = random.Random(7)
    words = lambda n: " ".join("".join(rng.choice("abé") for _ in range(rng.randrange(1, 5))) + rng.choice(["", "", "", " ", "\n"]) for _ in range(n))
    texts = [words(rng.randrange(60)) for _ in range(40)] + ["say a hello", None, ""]
    passages = [words(n) for n in (1, 2, 3, 4, 6, 12) for _ in range(12)]
    passages += [t[at:at + n] for t in texts[:40] for n in (1, 3, 9, 40) if (at := rng.randrange(max(1, len(t)))) < len(t)] + ["hello", "ell", "a h", " ", None, "hello"]
    items = spark.createDataFrame([(k % 90, p, "clash") for k, p in enumerate(passages)], "item_id int, text string, _d string")
    got = quality.passages_found(items, spark.createDataFrame([(t,) for t in texts], "text string"), words=3).collect()
    want = [(k % 90, bool(p and p.strip()) and any(p in t for t in texts if t)) for k, p in enumerate(passages)]
    assert sorted(map(tuple, got)) == sorted(want) and sum(f for _, f in want) > 50


@pytest.mark.parametrize("acts", [1, 3, 6])
def test_counts_and_pages_as_by_pairs(spark, acts, monkeypatch):
    monkeypatch.setattr(prefs, "CHUNK", 7)
    rng = random.Random(acts)
    events = [(k, dt.date(2026, 5, 1 + k % 20), None if k % 4 == 0 else f"{10 + k % 9}:00", rng.sample([f"a{n}" for n in range(12)], rng.randrange(acts + 1)), rng.sample(["x", "y", "z"], rng.randrange(3)), k % 7 != 0) for k in range(120)]
    rules = [(u, kind, rng.choice({"artist": [f"a{n}" for n in range(12)], "type": ["x", "y", "z"]}.get(kind, [str(n) for n in range(130)]))) for u in range(9) for kind in ("artist", "artist", "type", "event", "event", "favourite") if rng.random() < 0.8]
    rules += [(50, "type", t) for t in "xyz"] + [(50, "artist", f"a{n}") for n in range(11)] + [(60, "event", "none such")]
    e = spark.createDataFrame(events, "id int, date date, time string, headliners array<string>, types array<string>, good boolean")
    r = spark.createDataFrame(rules + rules[:3], "user_id int, kind string, value string")
    decide = lambda own, ev: "favourite" if ("favourite", str(ev[0])) in own else "hidden" if ("event", str(ev[0])) in own or any(("artist", a) in own for a in ev[3]) or any(("type", t) in own for t in ev[4]) else "show"
    want_counts, want_pages = set(), set()
    for u in {u for u, _, _ in rules}:
        own = {(k, v) for x, k, v in rules if x == u}
        told = [(ev, decide(own, ev)) for ev in events]
        hidden, liked = (sum(d == what for _, d in told) for what in ("hidden", "favourite"))
        if hidden or liked:
            want_counts.add((u, hidden, liked, len(events) - hidden))
        page = sorted(((ev[1], ev[2] or "99:99", ev[0], d) for ev, d in told if d != "hidden" and ev[5] and ev[1] >= dt.date(2026, 5, 3)))[:6]
        want_pages |= {(u, n, i, d) for n, (_, _, i, d) in enumerate(page, 1)}
    assert {tuple(x) for x in prefs.user_counts(e, r).collect()} == want_counts
    got = prefs.visible_pages(e, r, today=F.to_date(F.lit("2026-05-03")), passes=F.col("good"), size=6).collect()
    assert {tuple(x) for x in got} == want_pages and len(got) == len(want_pages)


def test_counts_of_events_with_acts_of_their_own(spark):
    """What users meet grows with their rules, not with the events."""
    events = spark.range(4000).select("id", F.array(F.concat(F.lit("act"), "id")).alias("headliners"), F.array(F.concat(F.lit("t"), (F.col("id") % 5).cast("string"))).alias("types"))
    keyed = events.select(F.col("id").cast("string").alias("id"), F.array_sort(prefs._keys(prefs.SHARED)).alias("keys"))
    subsets = prefs._subset_counts(keyed)
    assert subsets.where("anchor.kind = 'type'").count() == 5
    rules = spark.range(300).select(F.col("id").alias("user_id"), F.lit("type").alias("kind"), F.lit("t1").alias("value"))
    assert {tuple(r)[1:] for r in prefs.user_counts(events, rules).collect()} == {(800, 0, 3200)}


def test_exclusions_that_repeat_come_later_and_end(spark, tmp_path):
    day = lambda n, hour=0: dt.datetime(2026, 5, n, hour)
    rows = [(k, "s", "r", day(k)) for k in range(1, 29)] + [(100, "s", "other", day(3)), (101, None, "r", day(3))]
    checks = [("s", "r", day(2)), ("s", "r", day(4)), ("s", "r", day(4)), ("s", "r", day(20)), ("s", "late", day(27))]
    want = {k for k, s, r, ts in rows if not any((s, r) == (x, y) and at <= ts < at + dt.timedelta(days=7) for x, y, at in checks)}
    assert {2, 10, 20, 26} & want == set() and {1, 11, 19, 27, 100, 101} <= want
    listings = spark.createDataFrame(rows, "id int, source string, raw_id string, ts timestamp")
    excluded = spark.createDataFrame(checks, "source string, raw_id string, checked_at timestamp")
    assert {r.id for r in streams.not_excluded(listings, excluded).collect()} == want
    for k, part in enumerate((("1", "10"), ("10", "19"), ("19", "32"))):
        for frame, at in ((listings, "ts"), (excluded, "checked_at")):
            frame.where(F.dayofmonth(at).between(int(part[0]), int(part[1]) - 1)).coalesce(1).write.parquet(f"{tmp_path}/{at}/{k}")
    read = lambda frame, at: spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/{at}")
    out = streams.not_excluded(read(listings, "ts"), read(excluded, "checked_at"))
    q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    assert len(q.recentProgress) >= 3
    got = [r.id for r in spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect()]
    assert sorted(got) == sorted(k for k in want if k < 27 or k > 99)  # the watermark holds the last rows back


def test_arrivals_are_told_apart_by_parts_of_a_second(spark):
    rows = spark.createDataFrame([("2024-01-15 12:00:00.5",), ("2024-01-15 12:00:00",), ("2024-01-14 12:00:00.5",), ("2024-01-14 12:00:00",), ("2024-01-07 12:00:00.000001",), ("2024-01-07 12:00:00",), (None,)], "t string")
    for kind in ("timestamp", "timestamp_ntz"):
        got = browse.new_arrivals(rows.select(F.col("t").cast(kind).alias("first_seen_at")), F.to_timestamp(F.lit("2024-01-15 12:00:00")))
        assert {r.group: r.n for r in got.collect()} == {"today": 2, "week": 2}


def _preferences(spark, acts, events, users):
    """Events of so many acts and rules of so many users, with lists that repeat, hold nulls or are null."""
    rng = random.Random(5)
    names = lambda k: rng.choice([None, [], [f"a{rng.randrange(acts)}"], [f"a{rng.randrange(acts)}", None, f"a{rng.randrange(acts)}"]]) if k % 3 else [f"a{rng.randrange(acts)}"]
    e = [(k, DAY + dt.timedelta(days=rng.randrange(9)), rng.choice([None, "20:00"]), names(k), rng.choice([None, ["t0"], ["t1"], ["t0", "t1"]])) for k in range(events)]
    value = lambda kind: f"a{rng.randrange(acts)}" if kind == "artist" else f"t{rng.randrange(3)}" if kind == "type" else str(rng.randrange(events + 5))
    r = [(u, kind, value(kind)) for u in range(users) for kind in rng.choices(list(prefs.KINDS), [3, 6, 12, u % 3 == 0], k=rng.randrange(3 * acts))]
    return e, r, spark.createDataFrame(e, "id long, date date, time string, headliners array<string>, types array<string>"), spark.createDataFrame(r, "user_id long, kind string, value string")


def _decided_kind(event, mine):
    keys = [("favourite", str(event[0])), ("event", str(event[0])), *[("artist", a) for a in event[3] or []], *[("type", t) for t in event[4] or []]]
    return min((k for k in keys if k in mine), key=lambda k: prefs.KINDS[k[0]], default=(None,))[0]


@pytest.mark.parametrize("chunk", [2, 200])
def test_rules_meet_profiles_as_all_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(prefs, "CHUNK", chunk)
    monkeypatch.setattr(prefs, "PIECE", 50)
    e, r, events, rules = _preferences(spark, 7, 120, 25)
    mine = {u: {x[1:] for x in r if x[0] == u} for u, *_ in r}
    kinds = {(u, x[0]): _decided_kind(x, mine[u]) for u in mine for x in e}
    got = [tuple(x) for x in prefs.rule_hits(events, rules).collect()]
    assert sorted(got) == sorted((*pair, kind) for pair, kind in kinds.items() if kind)
    order = sorted((x for x in e if x[1] >= DAY + dt.timedelta(days=2)), key=lambda x: (x[1], x[2] or "99:99", x[0]))
    expect = []
    for u in mine:
        seen = [(x[0], kinds[u, x[0]] or "show") for x in order if kinds[u, x[0]] in (None, "favourite")][:6]
        expect += [(u, k + 1, *x) for k, x in enumerate(seen)]
    pages = prefs.visible_pages(events, rules, today=F.lit(DAY + dt.timedelta(days=2)), size=6)
    assert sorted(map(tuple, pages.collect())) == sorted(expect)


def test_pairs_spread_over_tasks_by_their_number(spark, monkeypatch):
    """Small tables whose pairs are many aren't left to one task."""
    monkeypatch.setattr(prefs, "PIECE", 1000)
    events = spark.range(400).select("id", F.array(F.lit("a")).alias("headliners"), F.array(F.lit("t")).alias("types"))
    rules = spark.range(100).select(F.col("id").alias("user_id"), F.lit("type").alias("kind"), F.lit("t").alias("value"))
    pieces = prefs.rule_hits(events, rules).groupBy(F.spark_partition_id()).count().collect()
    assert len(pieces) >= 20 and sum(x["count"] for x in pieces) == 40_000 and max(x["count"] for x in pieces) < 8000


def test_white_space_is_what_the_pattern_means(spark):
    every = "".join(chr(c) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000)
    row = spark.createDataFrame([(every,), (" a\u3000B\n",), (None,)], "t string").select(text.hash_norm(F.col("t")).alias("a"), F.lower(F.regexp_replace("t", r"(?U)\s", "")).alias("b"))
    assert all(r.a == r.b for r in row.collect()) and row.collect()[1].a == "ab"


def test_groups_collect_only_what_is_asked_for(spark):
    rows = spark.createDataFrame([("i", 1, False, 5.0, 5.0, "s", "r1", 1, "t", ["x"]), ("i", 2, False, None, None, "u", "r2", 2, "v", ["y", "x"])], "id string, priority int, special boolean, price_min double, price_max double, source string, raw_id string, ord int, title string, lineup array<string>")
    assert [tuple(r) for r in dedupe.merge_groups(rows, keep=(), sources=False).select("id", "lineup").collect()] == [("i", ["x", "y"])]
    slim = dedupe.merge_groups(rows, keep=("title",), union=())
    assert slim.columns == ["id", "title", "sources", "price_min", "price_max"] and [x.raw_id for x in slim.first().sources] == ["r1", "r2"]
    assert "lineup" not in slim._jdf.queryExecution().optimizedPlan().toString().split("LogicalRDD")[0]


def test_users_arent_shuffled_once_a_task(spark, monkeypatch):
    """Users and events of one profile meet by blocks: what is shuffled grows with the root of their pairs."""
    monkeypatch.setattr(prefs, "PIECE", 1000)
    events = spark.range(300).select("id", F.array(F.lit("a")).alias("headliners"), F.array(F.lit("t")).alias("types"))
    events = events.unionAll(events.select(F.lit(None).cast("long"), "headliners", "types").limit(1))
    named = spark.createDataFrame([(7, "favourite", "3"), (8, "event", "4"), (None, "type", "t")], "user_id long, kind string, value string")
    rules = spark.range(1500).select(F.col("id").alias("user_id"), F.lit("type").alias("kind"), F.lit("t").alias("value")).unionAll(named)
    hits = prefs.rule_hits(events, rules)
    assert shuffled_bytes(spark, lambda: hits.write.format("noop").mode("overwrite").save()) < 2_000_000
    counts = {r.kind: r["count"] for r in hits.groupBy("kind").count().collect()}
    assert counts == {"type": 301 * 1501 - 2, "favourite": 1, "event": 1} and hits.distinct().count() == 301 * 1501
    assert hits.where("user_id is null").count() == 301 and hits.where("id is null").count() == 1501


def test_events_are_merged_in_one_shuffle(spark):
    """Listings are shuffled once for islands and merging, without what follows from other columns, and give what resolving and then merging gives."""
    rng = random.Random(5)
    times = [None, "soon", "9:10", "10:30", "11:55", "14:00", "17:00", "19:30", "23:59"]
    rows = [(rng.choice(["A", "a ", "B", None]), rng.choice([DAY, DAY + dt.timedelta(1), None]), rng.choice(["x", " X", None]), rng.choice(times[: rng.choice([2, 4, 9])]), rng.choice([1, 2, 3]), rng.choice([True, False, None]), rng.choice([None, 5.0, 7.0]), k) for k in range(400)]
    frame = spark.createDataFrame(rows, "name string, date date, venue string, time string, priority int, special boolean, price_min double, k int")
    behind = {"price_max": F.col("price_min") + 1, "source": F.concat(F.lit("s"), F.col("priority").cast("string")), "raw_id": F.col("k").cast("string"), "ord": F.struct(F.when(F.col("k") % 7 != 0, F.col("k") % 5).alias("a"), F.col("k").alias("b")), "lineup": F.array("name", "venue")}
    whole = frame.withColumns(behind)
    for asked in ({}, {"keep": ("time", "venue"), "union": ()}, {"keep": (), "sources": False}):
        merged = dedupe.dedupe_events(frame, behind=behind, **asked)
        assert merged._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        expected = dedupe.merge_groups(dedupe.resolve_ids(whole), **asked)
        assert merged.columns == expected.columns and sorted(map(str, merged.collect())) == sorted(map(str, expected.collect()))
    assert sorted(map(str, dedupe.dedupe_events(whole).collect())) == sorted(map(str, dedupe.dedupe_events(frame, behind=behind).collect()))
    before = shuffled_bytes(spark, lambda: dedupe.merge_groups(dedupe.resolve_ids(whole)).write.format("noop").mode("overwrite").save())
    assert shuffled_bytes(spark, lambda: dedupe.dedupe_events(frame, behind=behind).write.format("noop").mode("overwrite").save()) < before / 2
