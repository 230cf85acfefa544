"""The projection with few names and rules works in each row's place and gives what the joins give."""

from pyspark.sql import functions as F

from marquee.functions import dates, price
from marquee.operators import match, normalize


def _outcomes(spark):
    kinds = "id string, source string, title string, venue string, address string, date_text string, price_text string, status_text string, url string, signal string, tiers array<struct<price:double,closed:boolean,waiting:boolean,on_sale_at:string>>"
    texts = [("ab and abc live", " Legacy 　", "2026/6/1 9:30"), ("ＡＢＣ x the abc", "臺中 hall", "2026/02/30"), ("none", None, "soon"), (None, " ", None), ("zz 乙 ab", "x 📍 https://a.b/c", "2026/12/31 19：05"), ("legacy abcd", "", "2026/6/1")]
    rows = [(str(k), "s", t, v, None, d, "票價：NT$800<br>開賣：2026/5/1", "", "u", None, None) for k, (t, v, d) in enumerate(texts)] + [(None, "s", "ab", "legacy", None, "2026/6/1", None, None, None, None, None)]
    names = spark.createDataFrame([("A", "ab", 1, "KR"), ("A", "abc", 2, ""), ("B", "abc", 3, "JP"), ("C", "live", 4, None), ("乙", "乙", 5, "TW"), ("Z", "zz 乙", 6, "US"), ("E", "", 7, "X")], "canonical string, name string, entry_ord int, origin string")
    rules = spark.createDataFrame([("legacy", "台北", 2), ("leg", "高雄", 1), ("", "x", 0), ("hall", None, 0)], "match string, city string, rule_ord int")
    overrides = spark.createDataFrame([("venue", "0", "leg b"), ("venue", "0", "leg a"), ("date", "0", "2027-01-01"), ("category", "1", "x"), ("date", "2", "2027-01-02")], "field string, key string, value string")
    return normalize.listing_outcomes(spark.createDataFrame(rows, kinds), names, rules, grammars={"s": "slash"}, today=F.to_date(F.lit("2026-05-01")), overrides=overrides)


def test_few_names_and_rules_need_no_join(spark, monkeypatch):
    here = _outcomes(spark)
    plan = here._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter, (id#") == 1  # the overrides
    got = {r.id: r for r in here.collect()}
    assert (got["0"].venue, got["0"].city, str(got["0"].date), got["0"].time) == ("leg b", "高雄", "2027-01-01", None)
    assert (got["4"].venue, got["4"].time, got["4"].headliners, got["4"].origins) == ("x", "19:05", ["Z", "乙", "A"], ["US", "TW", "KR"])
    assert got["1"].date is None and got[None].headliners == []
    monkeypatch.setattr(match, "FEW", 0)
    joined = _outcomes(spark)
    assert sorted(map(str, here.collect())) == sorted(map(str, joined.collect()))


def test_review_queue_works_out_the_projection_once(spark):
    plan = normalize.review_queue(_outcomes(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_sort") == 1


def test_date_and_time_forms(spark):
    rows = [("2026年 6 月7日 8:05", "words"), ("x 2026.12.1 18：30", "words"), ("2026-2-29 1:00", "dash"), ("2024-2-29 1:00", "dash"), ("", "dash"), (None, "dash"), ("2026/1/2", "slash")]
    got = spark.createDataFrame(rows, "x string, g string").select(dates.parse_date(F.col("x"), F.col("g")).alias("d")).select(F.col("d.date").cast("string"), "d.time").collect()
    assert [tuple(r) for r in got] == [("2026-06-07", "08:05"), ("2026-12-01", "18:30"), (None, None), ("2024-02-29", "01:00"), (None, None), (None, None), ("2026-01-02", None)]
    text = F.lit("<p>票價：NT$1,200 身障 600 元</p>&nbsp;開賣：2026/5/1 12:00")
    assert tuple(spark.range(1).select(price.price_from_text(text).alias("p"), price.on_sale_at(text)).first()) == ((1200.0, 1200.0), "2026-05-01T12:00:00+08:00")
