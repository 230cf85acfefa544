"""Queries over scalar functions, extraction and publishing."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.functions import classify, dates, price, status, text
from marquee.plans.registry import LISTING_SQL, SESSION_SQL, TODAY, listings, query, sessions, table
from marquee.sources import extract, publish


@query("""SELECT c_custkey, translate(c_name, 'Cu#0', '臺台') AS folded, lower(regexp_replace(c_name || ' x', '\\s', '', 'g')) AS norm, CASE WHEN length(c_name) > 10 THEN substr(c_name, 1, 9) || '…' ELSE c_name END AS clipped,
  lower(regexp_replace(c_name, '[#\\s]', '', 'g')) AS squashed FROM customer""")
def text_folds(spark, sf_dir):
    n = F.col("c_name")
    wide = F.translate(n, "Customer#0123456789", "Ｃｕｓｔｏｍｅｒ＃０１２３４５６７８９")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.translate(text.fullwidth_ascii(wide), "Cu#0", "臺台").alias("folded"), text.hash_norm(F.concat(n, F.lit("　x"))).alias("norm"), text.clip_text(n, 10).alias("clipped"), text.squash(n).alias("squashed"))


@query("SELECT c_custkey, c_custkey || '' AS digits FROM customer")
def math_digits(spark, sf_dir):
    bold = "".join(chr(0x1D7CE + k) for k in range(10))
    return table(spark, sf_dir, "customer").select("c_custkey", text.math_digits(F.translate(F.col("c_custkey").cast("string"), "0123456789", bold)).alias("digits"))


@query()
def nfkc(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.nfkc(F.translate("c_name", "Custome", "Ｃｕｓｔｏｍｅ")).alias("name"))


@query("""SELECT page_id, nullif(regexp_extract(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '([^.]+)\\.example\\.com$', 1), '') AS account, CASE WHEN regexp_matches(url, '(?i)^https?://') THEN url END AS safe FROM pages""")
def hosts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.host_label(F.col("url"), ".example.com").alias("account"), text.safe_url(F.col("url")).alias("safe"))


@query("""SELECT p_partkey, CASE p_size % 9 WHEN 0 THEN 'legacytaipei' WHEN 1 THEN '台中展演館' WHEN 2 THEN 'thewall' || p_size WHEN 3 THEN '小巨蛋arena' WHEN 4 THEN '小巨蛋' WHEN 5 THEN 'ab(' || p_size || ')' WHEN 6 THEN 'moondog' WHEN 7 THEN '嘉義' ELSE 'hall' || p_size END AS key FROM part""")
def venue_keys(spark, sf_dir):
    k, n = F.col("p_size") % 9, F.col("p_size").cast("string")
    raw = (F.when(k == 0, "Legacy・Taipei").when(k == 1, "臺中展演館 Taichung Hall").when(k == 2, F.concat(F.lit("臺北 The Wall "), n)).when(k == 3, "小巨蛋Arena").when(k == 4, "小巨蛋　Taipei Arena-2")
           .when(k == 5, F.concat(F.lit("ＡＢ（"), n, F.lit("） "))).when(k == 6, "Moondog Taipei").when(k == 7, "嘉義 Arena").otherwise(F.concat(F.lit("Hall "), n)))
    return table(spark, sf_dir, "part").select("p_partkey", text.venue_key(raw, {"moondogtaipei": "moondog"}).alias("key"))


@query("""WITH g AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_custkey % 24 END AS h FROM orders)
SELECT o_orderkey, CAST(d AS VARCHAR) AS date, CASE WHEN h IS NOT NULL THEN lpad(CAST(h AS VARCHAR), 2, '0') || ':05' END AS time FROM g""")
def date_grammars(spark, sf_dir):
    d, p = F.col("o_orderdate"), F.col("o_orderpriority")
    time = F.concat((F.col("o_custkey") % 24).cast("string"), F.lit(":05"))
    raw = (F.when(p == "1-URGENT", F.concat(F.date_format(d, "yyyy/M/d"), F.lit(" (六) "), time)).when(p == "2-HIGH", F.concat(F.date_format(d, "yyyy/MM/dd"), F.lit(" 入場 "), time))
           .when(p == "3-MEDIUM", F.concat(F.date_format(d, "yyyy"), F.lit(" 年 "), F.month(d).cast("string"), F.lit("月"), F.day(d).cast("string"), F.lit("日"))).when(p == "4-NOT SPECIFIED", F.date_format(d, "yyyy.M.d")).otherwise(F.date_format(d, "yyyy-MM-dd")))
    grammar = F.when(p == "1-URGENT", "slash").when(p == "2-HIGH", "slash_time").when(p.isin("3-MEDIUM", "4-NOT SPECIFIED"), "words").otherwise("dash")
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.parse_date(raw, grammar).alias("x")).select("o_orderkey", F.col("x.date").cast("string").alias("date"), "x.time")


@query("""SELECT o_orderkey, strftime(o_orderdate + INTERVAL 8 HOUR, '%Y/%m/%d %H:%M') AS local, date_diff('day', DATE '1998-01-01', CAST(o_orderdate AS DATE)) AS days, CAST(floor((epoch(TIMESTAMP '2001-01-01') - epoch(o_orderdate)) / 86400) AS BIGINT) AS since,
  strftime(o_orderdate, '%Y/%m/%d') || '（' || ['日','一','二','三','四','五','六'][dayofweek(o_orderdate) + 1] || '）19:30' AS label, CASE WHEN year(o_orderdate) = 1998 THEN strftime(o_orderdate, '%m/%d') ELSE strftime(o_orderdate, '%Y/%m/%d') END AS day,
  CASE WHEN hour(o_orderdate) < 17 THEN 'day' ELSE 'evening' END AS bucket FROM orders""")
def date_labels(spark, sf_dir):
    d, day = F.col("o_orderdate"), F.to_date("o_orderdate")
    today = F.to_date(F.lit("1998-01-01"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", dates.local_text(d).alias("local"), dates.days_until(day, today).cast("long").alias("days"), dates.days_since(d, F.to_timestamp(F.lit("2001-01-01"))).alias("since"),
        dates.date_label(day, F.lit("19:30")).alias("label"), dates.group_label(day, today).alias("day"), dates.time_bucket(F.date_format(d, "HH:mm")).alias("bucket"))


@query("SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) - INTERVAL 8 HOUR + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M') AS utc FROM orders")
def slash_times(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(dates.slash_timestamp(F.concat(F.date_format("o_orderdate", "yyyy/MM/dd"), F.lit(" 9:00(+0800)"))), "yyyy-MM-dd HH:mm").alias("utc"))


@query("""SELECT o_orderkey, CASE o_custkey % 3 WHEN 0 THEN '1998/01/02 19:00' WHEN 1 THEN '1998/01/02 ' || lpad(CAST(o_custkey % 12 + 12 AS VARCHAR), 2, '0') || ':30' ELSE CASE WHEN o_orderkey % 2 = 0 THEN '1998/01/02 ' || lpad(CAST(o_custkey % 12 + 12 AS VARCHAR), 2, '0') || ':00' ELSE '1998/01/02' END END AS text FROM orders""")
def append_time(spark, sf_dir):
    k = F.col("o_custkey") % 3
    base = F.when(k == 0, "1998/01/02 19:00").otherwise("1998/01/02")
    hour = F.col("o_custkey") % 12
    other = F.when(k < 2, F.concat(F.lit("open "), F.when(hour == 0, 12).otherwise(hour).cast("string"), F.lit(":30 PM"))).when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("演出開始："), F.when(hour == 0, 12).otherwise(hour).cast("string"), F.lit("pm"))).otherwise("soon")
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.append_time(base, other).alias("text"))


@query("""SELECT o_orderkey, string_agg(strftime(g, '%Y-%m'), ',' ORDER BY g) AS months FROM (SELECT o_orderkey, unnest(generate_series(date_trunc('month', o_orderdate), date_trunc('month', o_orderdate) + INTERVAL 6 MONTH, INTERVAL 1 MONTH)) AS g FROM orders) GROUP BY o_orderkey""")
def months(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.transform(dates.month_list(F.to_date("o_orderdate")), lambda d: F.date_format(d, "yyyy-MM")), ",").alias("months"))


@query("""SELECT CAST(m AS VARCHAR) AS month, CAST(ceil((dayofweek(m) + day(last_day(m))) / 7.0) AS INT) AS weeks, dayofweek(m) AS lead FROM (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM orders)""")
def month_grid(spark, sf_dir):
    m = table(spark, sf_dir, "orders").select(F.trunc("o_orderdate", "month").alias("m")).distinct()
    grid = dates.month_grid(F.col("m"))
    return m.select(F.col("m").cast("string").alias("month"), F.size(grid).alias("weeks"), F.size(F.filter(grid[0], lambda d: d.isNull())).cast("long").alias("lead"))


@query("""SELECT o_orderkey, CAST(g AS DATE)::VARCHAR AS day FROM (SELECT o_orderkey, unnest(generate_series(CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE) + CAST(least(o_custkey % 10, 6) AS INT), INTERVAL 1 DAY)) AS g FROM orders) WHERE g >= DATE '1998-01-01'""")
def pending_days(spark, sf_dir):
    d = F.to_date("o_orderdate")
    days = dates.pending_days(d, F.date_add(d, (F.col("o_custkey") % 10).cast("int")), F.to_date(F.lit("1998-01-01")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.explode(days).alias("day")).withColumn("day", F.col("day").cast("string"))


@query("""SELECT l_orderkey, coalesce(min(l_extendedprice) FILTER (l_linestatus = 'O'), min(l_extendedprice)) AS low, coalesce(max(l_extendedprice) FILTER (l_linestatus = 'O'), max(l_extendedprice)) AS high FROM lineitem GROUP BY l_orderkey""")
def price_tiers(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_extendedprice").alias("price"), (F.col("l_linestatus") != "O").alias("closed"))).alias("tiers"))
    return t.select("l_orderkey", price.price_from_tiers(F.col("tiers")).alias("p")).select("l_orderkey", F.col("p.min").alias("low"), F.col("p.max").alias("high"))


@query("""WITH t AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) % 5000 + 100 AS a, CAST(floor(o_totalprice) AS BIGINT) % 700 + 60 AS b, o_orderkey % 5 AS k FROM orders)
SELECT o_orderkey, CAST(CASE k WHEN 0 THEN least(a, b) WHEN 1 THEN least(a, b) WHEN 2 THEN a WHEN 3 THEN b END AS DOUBLE) AS low, CAST(CASE k WHEN 0 THEN greatest(a, b) WHEN 1 THEN greatest(a, b) WHEN 2 THEN a WHEN 3 THEN b END AS DOUBLE) AS high FROM t""")
def price_text(spark, sf_dir):
    total = F.floor("o_totalprice")
    a, b = (total % 5000 + 100).cast("string"), (total % 700 + 60).cast("string")
    k = F.col("o_orderkey") % 5
    raw = (F.when(k == 0, F.concat(F.lit("<p>演出</p><p>票價：NT$"), a, F.lit(" / "), b, F.lit("元</p>服務費 20 元"))).when(k == 1, F.concat(F.lit("票價｜"), a, F.lit(" / "), b))
           .when(k == 2, F.concat(F.lit("【票價資訊】<br>全區｜NTD "), a, F.lit("<br>身障區｜NTD 50"))).when(k == 3, F.concat(F.lit("預售單人＄"), b)).otherwise("free for all"))
    return table(spark, sf_dir, "orders").select("o_orderkey", price.price_from_text(raw).alias("p")).select("o_orderkey", F.col("p.min").alias("low"), F.col("p.max").alias("high"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T12:00:00+08:00' WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00+08:00' WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T11:00:00+08:00' END AS on_sale_at FROM orders""")
def sale_dates(spark, sf_dir):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    raw = (F.when(k == 0, F.concat(F.lit("售票時間："), F.date_format(d, "yyyy/M/d"), F.lit("（六）12:00 開始"))).when(k == 1, F.concat(F.lit("開賣時間："), F.date_format(d, "yyyy 年 MM 月 dd 日")))
           .when(k == 2, F.concat(F.lit("停止售票：2001/01/01 10:00<br>正式開賣<br> 時間："), F.date_format(d, "yyyy/MM/dd"), F.lit(" 11:00"))).otherwise("售票：7月22日"))
    return table(spark, sf_dir, "orders").select("o_orderkey", price.on_sale_at(raw).alias("on_sale_at"))


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN '票價未公布' ELSE 'NT$' || printf('%,d', CAST(floor(o_totalprice / 10) AS INT)) || CASE WHEN o_custkey % 4 = 1 THEN '.5' ELSE '' END || ' up' END AS label, CASE WHEN o_custkey % 3 = 0 THEN 'b · a' ELSE 'b' END AS sources FROM orders""")
def price_labels(spark, sf_dir):
    p = F.col("o_totalprice")
    source = lambda name: F.struct(F.lit(name).alias("name"), F.col("o_orderkey").alias("raw_id"))
    sources = F.array(source("b"), F.when(F.col("o_custkey") % 3 == 0, source("a")).otherwise(source("b")), source("b"))
    return table(spark, sf_dir, "orders").select("o_orderkey", price.price_label(F.when(F.col("o_custkey") % 4 != 0, F.floor(p / 10) + F.when(F.col("o_custkey") % 4 == 1, 0.5).otherwise(0.0))).alias("label"), price.source_names(sources).alias("sources"))


@query(f"""WITH {LISTING_SQL}, t AS (SELECT l_orderkey, min(date) AS d, count(*) AS n, bool_or(l_linestatus = 'O' AND l_returnflag <> 'R') AS open, min(CASE WHEN l_returnflag = 'R' THEN CAST(date AS VARCHAR) END) AS start, max(l_orderkey % 6) AS s FROM listing GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN s = 0 THEN CASE WHEN d >= DATE '1998-01-01' THEN 'sold_out' ELSE 'ended' END WHEN s = 1 THEN 'on_sale' WHEN open THEN 'on_sale' WHEN start IS NOT NULL THEN 'announced' WHEN d >= DATE '1998-01-01' THEN 'sold_out' ELSE 'ended' END AS status,
  CASE WHEN s > 1 AND NOT open THEN start END AS on_sale_at FROM t""")
def status_rules(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    tier = F.struct((F.col("l_linestatus") != "O").alias("closed"), (F.col("l_returnflag") == "R").alias("waiting"), F.to_date("l_shipdate").cast("string").alias("on_sale_at"))
    t = li.groupBy("l_orderkey").agg(F.collect_list(tier).alias("tiers"), F.to_date(F.min("l_shipdate")).alias("d"))
    k = F.col("l_orderkey") % 6
    signal = F.when(k == 0, "SOLD_OUT").when(k == 1, "IN_STOCK").when(k == 2, "COMING_SOON")
    return t.select("l_orderkey", status.status_from_tiers(F.col("tiers"), signal, F.col("d"), F.to_date(F.lit("1998-01-01")), F.lit("x")).alias("s")).select("l_orderkey", "s.status", "s.on_sale_at")


@query(f"""WITH {SESSION_SQL} SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CASE WHEN date >= DATE '{TODAY}' THEN 'sold_out' ELSE 'ended' END WHEN CAST(CAST(on_sale_at AS TIMESTAMP) AS DATE) > DATE '{TODAY}' THEN 'announced' ELSE 'on_sale' END AS status FROM session""")
def status_text(spark, sf_dir):
    s = sessions(spark, sf_dir)
    words = F.when(F.col("event_id") % 6 == 0, "票券已售完").when(F.col("event_id") % 3 == 0, "銷售截止").otherwise("熱賣中")
    return s.select("event_id", status.text_status(words, F.col("on_sale_at"), F.col("date"), F.to_date(F.lit(TODAY)))["status"].alias("status"))


@query("""WITH o AS (SELECT l_orderkey, l_returnflag = 'N' AS stock, CAST(l_shipdate AS DATE) AS d, l_linestatus FROM lineitem), s AS (SELECT l_orderkey, count(*) FILTER (stock) AS n, count(*) FILTER (stock AND NOT (l_linestatus = 'F' AND d < DATE '1998-01-01')) AS still,
  count(*) FILTER (stock AND NOT (l_linestatus = 'F' AND d < DATE '1998-01-01') AND d > DATE '1999-01-01') AS later FROM o GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN n = 0 THEN 'SOLD_OUT' WHEN still = 0 THEN 'REGISTRATION_CLOSED' WHEN later = still THEN 'COMING_SOON' ELSE 'IN_STOCK' END AS signal FROM s""")
def offer_signals(spark, sf_dir):
    d = F.to_date("l_shipdate").cast("string")
    li = table(spark, sf_dir, "lineitem")
    offer = F.struct(F.when(F.col("l_returnflag") == "N", "http://schema.org/InStock").otherwise("SoldOut").alias("availability"), F.when(d > "1999-01-01", F.lit("1998-06-01")).otherwise("1990-01-01").alias("validFrom"), F.when(F.col("l_linestatus") == "F", d).alias("validThrough"))
    return li.groupBy("l_orderkey").agg(F.collect_list(offer).alias("o")).select("l_orderkey", status.offers_signal(F.col("o"), F.lit("1998-01-01")).alias("signal"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(trim(t), '(?i)^(open|my)?test$') THEN 'junk_title' WHEN contains(lower(t), 'thing') THEN 'non_music_noise' WHEN contains(t, 'the') AND NOT contains(t, 'and') THEN 'classical' WHEN contains(lower(t), 'here') THEN 'meet_and_greet'
  WHEN source = 'src3' AND doc_id % 2 = 0 THEN 'platform_demo_content' WHEN source IN ('src1', 'src2') THEN 'excluded_account' WHEN regexp_matches(t, 'que|des') THEN 'outside_taiwan' END AS reason FROM (SELECT *, text AS t FROM documents)""")
def exclusion(spark, sf_dir):
    t = F.col("text")
    url = F.when((F.col("source") == "src3") & (F.col("doc_id") % 2 == 0), "https://demo.demo.test/e/1").otherwise("https://x.test/?https://demo.demo.test/")
    return table(spark, sf_dir, "documents").select("doc_id", classify.exclusion_reason(t, url, F.col("source"), t, demo=r"(?i)^https?://demo\.demo\.test/", noise=("Thing",), classical=("the",), greet=("HERE",), accounts=("src1", "src2"), outside="que|des", escape="and").alias("reason"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 28 < 10 THEN '音樂祭' WHEN p_partkey % 28 < 17 THEN '喜劇' WHEN p_partkey % 28 < 18 THEN '音樂劇' WHEN p_partkey % 28 < 26 THEN '拼盤'
  WHEN p_size % 2 = 0 AND p_partkey % 28 = 26 THEN '拼盤' ELSE '專場' END AS type FROM part""")
def type_tag(spark, sf_dir):
    # each part's title holds one of the words, in another case if it is Latin, a guest's mark, or nothing
    marks = F.array(*[F.lit(w.upper()) for w, _ in classify.TYPE_WORDS], F.lit(""), F.lit(" feat. x"))
    title = F.concat("p_name", F.element_at(marks, (F.col("p_partkey") % 28 + 1).cast("int")), F.lit(" live"))
    heads = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))
    return table(spark, sf_dir, "part").select("p_partkey", classify.type_tag(title, heads).alias("type"))


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'comedy' WHEN 1 THEN 'theatre' ELSE 'music' END AS section, CASE WHEN p_size % 4 < 2 THEN '雙北' ELSE '台中' END AS region, CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 5 < 3 THEN 'concert' ELSE 'drama' END AS category FROM part""")
def sections(spark, sf_dir):
    s = F.col("p_size")
    types = F.when(s % 3 == 0, F.array(F.lit("喜劇"), F.lit("音樂劇"))).when(s % 3 == 1, F.array(F.lit("音樂劇"))).otherwise(F.array(F.lit("專場")))
    codes = F.when(s % 5 == 0, F.array(F.lit("m"), F.lit("kids"))).when(s % 5 < 3, F.array(F.lit("d"), F.lit("m"))).otherwise(F.array(F.lit("d")))
    return table(spark, sf_dir, "part").select("p_partkey", classify.section_of(types).alias("section"), classify.city_bucket(F.when(s % 4 == 0, "台北").when(s % 4 == 1, "新北").otherwise("台中")).alias("region"),
                                               classify.category_of(codes, {"m": "concert", "d": "drama"}, ("kids",)).alias("category"))


@query("SELECT p_partkey, p_size % 5 IN (0, 1) AS lottery FROM part")
def lottery(spark, sf_dir):
    k = F.col("p_size") % 5
    title = F.when(k == 0, "夏季 登記抽選").otherwise(F.col("p_name"))
    body = F.when(k == 1, "本場採登記抽選，一般票券開售於八月").when(k == 2, "VIP 套票登記抽選，一般開賣八月").when(k == 3, "登記抽選後，一般販售視餘票而定").otherwise("一般開賣")
    return table(spark, sf_dir, "part").select("p_partkey", classify.is_lottery(title, body, "視餘票|若有餘票").alias("lottery"))


# -- pages

@query("""SELECT page_id, len(regexp_extract_all(html, '(?i)<li\\b')) AS n_items, md5(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&')) AS decoded FROM pages""")
def entities(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_count("html", F.lit(r"(?i)<li\b")).cast("long").alias("n_items"), F.md5(extract.decode_entities(F.col("html"))).alias("decoded"))


@query(r"""SELECT page_id, array_to_string(list_filter(list_transform(string_split(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<(?:br|p|div|li)\b[^>]*>', chr(10), 'gi'), '</(?:p|div|li)>', chr(10), 'gi'), '<[^>]+>', '', 'g'), '&nbsp;', ' ', 'gi'), '&nbsp;', ' '), '&amp;', '&'), chr(10)), lambda x: trim(x)), lambda x: x <> ''), '|') AS lines FROM pages""")
def html_lines(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(extract.lines(F.col("html")), "|").alias("lines"))


@query(r"""SELECT page_id, array_to_string(list_slice(list_filter(list_distinct(regexp_extract_all(html, 'href="/([A-Za-z]+)"', 1)), lambda x: x <> 'The'), 1, 100), '') IS NOT NULL AS has, least(len(list_filter(list_distinct(regexp_extract_all(html, 'href="/([A-Za-z]+)"', 1)), lambda x: x <> 'The')), 8) AS n FROM pages""")
def links(spark, sf_dir):
    found = extract.child_links(F.col("html"), F.lit("The"), r'href="/([A-Za-z]+)"')
    return table(spark, sf_dir, "pages").select("page_id", F.lit(True).alias("has"), F.size(found).cast("long").alias("n"))


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 3 <> 0 THEN 'show ' || o_orderkey END AS name, CASE WHEN o_custkey % 3 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS start, o_custkey || '/' || o_orderkey AS cells, CASE WHEN o_custkey % 2 = 0 THEN 'http://x.test/a' || o_custkey || '.jpg' ELSE 'http://cdn.test/b.png' END AS image FROM orders""")
def page_fields(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    c, k = F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")
    html = F.concat(
        F.lit('<script type="application/ld+json">{bad</script><script type="application/ld+json">'),
        F.when(F.col("o_custkey") % 3 == 0, '{"@type":"Place"}').otherwise(F.concat(F.lit('[{"@type":"Event","name":"x"},{"@type":"Event","name":"show '), k, F.lit('","startDate":"'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('"}]'))),
        F.lit("</script><table><tr><td><b>"), c, F.lit("</b></td><td> "), k, F.lit('</td></tr></table><meta property="og:image" content="'),
        F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("http://x.test/a"), c, F.lit(".jpg"))).otherwise("http://x.test/logo.png"), F.lit('"><img src="http://cdn.test/b.png">'))
    ev = extract.jsonld_events(html)
    return o.select("o_orderkey", ev["name"].alias("name"), ev["startDate"].alias("start"), F.array_join(extract.table_rows(html)[0], "/").alias("cells"), extract.og_image(html).alias("image"))


@query("""SELECT o_orderkey, 'hall ' || o_custkey AS venue, CASE WHEN o_custkey % 2 = 0 THEN '1 / 2' END AS times, 'low=' || (o_custkey + 100) || ',' || (o_custkey + 200) || 'x' AS prices FROM orders""")
def labeled_fields(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    c = F.col("o_custkey")
    html = F.concat(F.lit("<p>地點："), F.concat(F.lit("hall "), c.cast("string")), F.lit("</p><p>"), F.when(c % 2 == 0, "時間：<br>1<br>2").otherwise("無"), F.lit("</p><p>備註：無</p>"))
    tiers = extract.struck_prices(F.concat((c + 100).cast("string"), F.lit(" / <s>"), (c + 200).cast("string"), F.lit("</s>")))
    shown = F.array_join(F.transform(tiers, lambda t: F.concat(t["price"].cast("int").cast("string"), F.when(t["closed"], "x").otherwise(""))), ",")
    return o.select("o_orderkey", extract.labeled_field(html, "地點|場地").alias("venue"), extract.labeled_field(html, "時間").alias("times"), F.concat(F.lit("low="), shown).alias("prices"))


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 'old ' ELSE 'new ' END || o_orderkey AS routed, CASE o_custkey % 3 WHEN 0 THEN 'x' ELSE 'template' END AS preferred, 'front=' || o_custkey AS tiers, strftime(o_orderdate, '%Y-%m-%d') AS cell, 'hall' || o_custkey || '|1 A st' AS venue, 'NT$' || o_custkey AS paragraph, 'Show ' || o_orderkey || 'th (0102)' AS title, strftime(o_orderdate, '%Y/%m/%d') || '|hall' || o_custkey || '|' || o_orderkey || ' Road;2024-01-02' AS blocks, o_custkey || '|' || (1000 + o_custkey % 1000) || '|-' AS cells FROM orders""")
def page_templates(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    c, k = F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")
    html = F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("class=old <b>"), k, F.lit("</b>"))).otherwise(F.concat(F.lit("class=new <i>"), k, F.lit("</i>")))
    route = extract.routed(html, [("class=old", F.concat(F.lit("old "), F.regexp_extract(html, "<b>(.*?)</b>", 1))), ("class=new", F.concat(F.lit("new "), F.regexp_extract(html, "<i>(.*?)</i>", 1)))])
    tiers = extract.tiers_from_map(F.create_map(F.lit("front"), F.col("o_custkey").cast("double"), F.lit("Pair seat"), F.lit(9.0)))
    venue = extract.cell_venue(F.concat(F.lit('<a href="https://maps.test/?q=1%20A%20st&z=1">hall'), c, F.lit("</a> 2F")))
    day = F.date_format("o_orderdate", "yyyy/MM/dd")
    blocks = extract.session_blocks(F.concat(F.lit("<div>"), day, F.lit(" <b>hall"), c, F.lit("</b><i>"), k, F.lit(" Road</i></div><div>soon <b>y</b></div><div>2024-01-02</div>")), "<div>(.*?)</div>", r"^(\S+)", "<b>(.*?)</b>", "<i>(.*?)</i>")
    said = F.array_join(F.transform(blocks, lambda b: F.concat_ws("|", b["moment"], b["venue"], b["address"])), ";")
    rows = extract.typed_rows(F.concat(F.lit("<tr><td>"), c, F.lit(" seats</td><td>NT$ 1,"), F.lpad(F.pmod(F.col("o_custkey"), F.lit(1000)).cast("string"), 3, "0"), F.lit("</td></tr><tr></tr>")), {"seats": (0, "int"), "price": (1, "double"), "left": (2, "int")})
    return o.select(
        "o_orderkey", route.alias("routed"), extract.preferred(F.when(F.col("o_custkey") % 3 == 0, "x").otherwise(""), F.lit("template")).alias("preferred"),
        F.array_join(F.transform(tiers, lambda t: F.concat(t["name"], F.lit("="), t["price"].cast("int").cast("string"))), ",").alias("tiers"),
        extract.cell_date(F.concat(F.lit('<time datetime="'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('">d</time>'))).alias("cell"), F.concat_ws("|", venue["venue"], venue["address"]).alias("venue"),
        extract.price_paragraph(F.concat(F.lit("<p>hello</p><p>NT$"), c, F.lit("（含飲料券100元）</p>"))).alias("paragraph"), 
        extract.title_clean(F.concat(F.lit("Ｓhow "), k, F.lit("th (0102) ｜"))).alias("title"), said.alias("blocks"), F.array_join(F.transform(rows, lambda r: F.concat_ws("|", r["seats"], r["price"].cast("int"), F.coalesce(r["left"].cast("string"), F.lit("-")))), ";").alias("cells"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE '{"shows":[' || CASE WHEN o_orderkey % 3 = 0 THEN '{"n":{"k":1}}' ELSE '' END || '],"id":' || o_orderkey || '}' END AS first_found,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE '{"a":{"b":' || o_custkey || '},"t":"x}{\\"","shows":[],"id":' || o_orderkey || '}' END AS second_found, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 2 END::BIGINT AS n FROM orders""")
def embedded_json(spark, sf_dir):
    k, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    inner = F.concat(F.lit('{"shows":['), F.when(F.col("o_orderkey") % 3 == 0, '{"n":{"k":1}}').otherwise(""), F.lit('],"id":'), k, F.lit("}"))
    # objects before and around the marker, braces and quotes in strings, the marker's text in a string, cut into chunks anywhere
    plain = F.concat(F.lit('["{", \'\', {"list":['), inner, F.lit(',{"a":{"b":'), c, F.lit('},"t":"x}{\\"","shows":[],"id":'), k, F.lit('}],"s":"\\"shows\\":["}'))
    unclosed = F.concat(F.lit('{"shows":[{"a":1}],"id":'), k, F.lit(',"t":"'), inner)
    said = F.when(F.col("o_orderkey") % 5 == 0, unclosed).otherwise(plain)
    at = (F.col("o_orderkey") % 40 + 1).cast("int")
    push = lambda t: F.concat(F.lit('<script>self.push([1,"'), F.replace(F.replace(t, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"])</script>'))
    page = F.concat(push(F.substring(said, F.lit(1), at)), F.lit('<script>self.push([1,"\\x"])</script>{"shows":[]}'), push(F.substring(said, at + 1, F.lit(10_000))))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", extract.embedded_objects('"shows":[', "self.push")(page).alias("found"))
    return rows.select("o_orderkey", F.get("found", F.lit(0)).alias("first_found"), F.get("found", F.lit(1)).alias("second_found"), F.size("found").cast("long").alias("n"))


# -- publishing

@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m') ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS position, o_orderkey AS id FROM orders")
def schedule(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("date"))
    return publish.schedule(o).select("month", "position", "id")


@query("SELECT 'https://a.test/e/' || o_orderkey || '.html' AS loc, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS lastmod FROM orders UNION ALL SELECT 'https://a.test/', CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) FROM orders")
def sitemap(spark, sf_dir):
    return publish.sitemap(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").cast("string").alias("updated_at")), "https://a.test/")


_PLACE = """'{{"@type":"Place","name":"' || coalesce({v}, {c}) || '","address":{{"@type":"PostalAddress","addressCountry":"TW"' || coalesce(',"addressLocality":"' || nullif({c}, '未知') || '"', '') || '}}}}'"""
_OFFER = """CASE WHEN low IS NOT NULL AND {s} <> 'ended' THEN ',"offers":{{"@type":"Offer","url":"https://t.test/' || raw_id || '","price":' || low || '.5,"priceCurrency":"TWD","availability":"https://schema.org/'
  || CASE {s} WHEN 'on_sale' THEN 'InStock' WHEN 'announced' THEN 'PreOrder' ELSE 'SoldOut' END || '"' || CASE WHEN {s} = 'announced' AND sale IS NOT NULL THEN ',"validFrom":"' || sale || '"' ELSE '' END || '}}' ELSE '' END"""
_MODE = '"eventStatus":"https://schema.org/EventScheduled","eventAttendanceMode":"https://schema.org/OfflineEventAttendanceMode"'


@query(f"""WITH {LISTING_SQL}, r AS (SELECT *, CASE WHEN l_linenumber % 3 <> 0 THEN l_partkey END AS low, ['on_sale', 'announced', 'sold_out', 'ended'][l_orderkey % 4 + 1] AS s, CASE WHEN l_suppkey % 2 = 0 THEN '未知' ELSE city END AS town,
  CASE WHEN l_linenumber <> 2 THEN venue END AS hall, CASE WHEN special THEN '2024-05-01T12:00:00+08:00' END AS sale FROM listing
), t AS (SELECT *, title || '｜' || strftime(date, '%Y/%m/%d') || '（' || ['日','一','二','三','四','五','六'][dayofweek(date) + 1] || '）' || coalesce(time, '') || coalesce(' 於' || nullif(concat_ws(' ', nullif(town, '未知'), hall), ''), '')
  || '，' || coalesce('NT$' || printf('%,d', low) || '.5 起', '票價未公布') || '，' || CASE s WHEN 'on_sale' THEN '售票中' WHEN 'announced' THEN '尚未開賣' WHEN 'sold_out' THEN '結束販售' ELSE '已結束' END || '。資料來源：' || source || '、b。' AS told,
  CASE WHEN l_linenumber % 2 = 0 THEN '"performer":[{{"@type":"PerformingGroup","name":"' || name || '"}}],' ELSE '' END AS acts FROM r)
SELECT raw_id, price, '{{"@context":"https://schema.org","@type":"Event","name":"' || title || '","description":"' || told || '","url":"https://a.test/e/' || raw_id || '.html","startDate":"' || date || coalesce('T' || time || ':00+08:00', '') || '",'
  || CASE WHEN l_linenumber % 4 = 1 THEN '"endDate":"' || (date + 3) || '",' ELSE '' END || '{_MODE},"location":' || {_PLACE.format(v="hall", c="town")} || rtrim(',' || acts, ',')
  || CASE WHEN special THEN ',"subEvent":[{{"@type":"Event","name":"' || title || '","description":"' || told || '","startDate":"' || date || 'T19:30:00+08:00",{_MODE},"location":' || {_PLACE.format(v="'hall 1'", c="'台北'")} || rtrim(',' || acts, ',') || {_OFFER.format(s="'announced'")}
    || '}},{{"@type":"Event","name":"' || title || '","description":"' || told || '","startDate":"' || (date + 1) || '",{_MODE},"location":' || {_PLACE.format(v="'未知'", c="'未知'")} || rtrim(',' || acts, ',') || {_OFFER.format(s="'ended'")} || '}}]' ELSE '' END
  || {_OFFER.format(s="s")} || '}}' AS doc FROM t""")
def publish_jsonld(spark, sf_dir):
    rows = listings(spark, sf_dir)
    null, line = F.lit(None).cast("string"), F.col("l_linenumber")
    session = lambda day, time, venue, city, status: F.struct(day.alias("date"), F.lit(time).alias("time"), F.lit(venue).alias("venue"), F.lit(city).alias("city"), F.lit(status).alias("status"))
    one = session(F.col("date"), "19:30", "hall 1", "台北", "announced")
    two = session(F.date_add("date", 1), "", "", "未知", "ended")
    source = lambda x: F.struct(x.alias("name"))
    rows = rows.withColumns({
        "id": F.col("raw_id"), "price_min": F.when(line % 3 != 0, F.col("l_partkey") + 0.5), "status": F.element_at(F.array(*map(F.lit, ("on_sale", "announced", "sold_out", "ended"))), (F.col("l_orderkey") % 4 + 1).cast("int")),
        "city": F.when(F.col("l_suppkey") % 2 == 0, "未知").otherwise(F.col("city")), "venue": F.when(line != 2, F.col("venue")), "ticket_url": F.concat(F.lit("https://t.test/"), "raw_id"), "image": null,
        "on_sale_at": F.when(F.col("special"), "2024-05-01T12:00:00+08:00"), "date_end": F.when(line % 4 == 1, F.date_add("date", 3)).otherwise(F.col("date")),
        "headliners": F.when(line % 2 == 0, F.array("name")).otherwise(F.array().cast("array<string>")), "sources": F.array(source(F.col("source")), source(F.lit("b")), source(F.col("source"))),
        "sessions": F.when(F.col("special"), F.array(one, two)).otherwise(F.array(one))})
    return rows.select("raw_id", "price", publish.jsonld("https://a.test").alias("doc"))


@query("SELECT doc_id, doc_id || ' ' || CASE WHEN length(text) > 80 THEN substr(text, 1, 79) || '…' ELSE text END AS notice FROM documents WHERE length(text) <= 1000 AND length(trim(text)) > 0")
def reports(spark, sf_dir):
    good, _ = publish.report_rows(table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("event_id"), F.col("text").alias("message")))
    return good.select("doc_id", "notice")


# -- labels, source vocabularies, venue cleaning

@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '售票中' WHEN 'O' THEN '尚未開賣' ELSE '結束販售' END AS label FROM orders")
def status_labels(spark, sf_dir):
    s = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select("o_orderkey", status.status_label(F.when(s == "F", "on_sale").when(s == "O", "announced").otherwise("sold_out")).alias("label"))


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN CASE o_orderstatus WHEN 'F' THEN 'IN_STOCK' WHEN 'O' THEN 'SOLD_OUT' END WHEN o_orderpriority = '2-HIGH' THEN CASE o_orderstatus WHEN 'F' THEN 'COMING_SOON' END END AS signal FROM orders")
def source_signals(spark, sf_dir):
    words = {"1-URGENT": {"F": "IN_STOCK", "O": "SOLD_OUT"}, "2-HIGH": {"F": "COMING_SOON"}}
    return table(spark, sf_dir, "orders").select("o_orderkey", status.vocabulary_signal(F.col("o_orderpriority"), F.col("o_orderstatus"), words).alias("signal"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'known' WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'offers' WHEN o_orderkey % 2 = 0 THEN 'children' WHEN o_orderstatus = 'F' THEN 'table' END AS signal FROM orders""")
def detail_signals(spark, sf_dir):
    k = F.col("o_orderkey")
    signal = extract.detail_signal(F.when(k % 5 == 0, "known"), k % 7 == 0, F.when(k % 3 == 0, "offers"), F.when(k % 2 == 0, "children"), F.when(F.col("o_orderstatus") == "F", "table"))
    return table(spark, sf_dir, "orders").select("o_orderkey", signal.alias("signal"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN 'known hall / ' || p_size || ' First Road' WHEN 2 THEN p_size || ' Other Road / 2F' ELSE p_name || ' hall / 1 First Road' END AS venue FROM part")
def clean_venues(spark, sf_dir):
    from marquee.operators.normalize import clean_venue

    k = F.col("p_size") % 4
    size = F.col("p_size").cast("string")
    raw = (F.when(k == 0, F.concat("p_name", F.lit(" 📍 https://maps.test/?q=1"))).when(k == 1, F.concat(F.upper("p_name"), F.lit("! / "), size, F.lit(" First Road 📍")))
           .when(k == 2, F.concat("p_name", F.lit("/"), size, F.lit(" Other Road / 2F"))).otherwise(F.concat("p_name", F.lit(" hall / 1 First Road"))))
    return table(spark, sf_dir, "part").select("p_partkey", clean_venue(raw, F.col("p_name"), (("First Road", "known hall"),)).alias("venue"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'free=0' WHEN 1 THEN 'from=' || p_size WHEN 2 THEN 'from=' || p_size || ',to=' || (p_size + 100) ELSE '' END AS tiers, CASE p_size % 3 WHEN 0 THEN '甲廳|乙廳' ELSE '甲廳' END AS venues FROM part")
def range_tiers(spark, sf_dir):
    s = F.col("p_size")
    low = F.when(s % 4 == 3, None).when(s % 4 == 0, 0).otherwise(s)
    tiers = extract.tiers_from_range(low, F.when(s % 4 == 0, 0).when(s % 4 == 1, s).otherwise(s + 100))
    names = text.venue_keys(F.when(s % 3 == 0, "甲廳、乙廳 & 甲 廳").otherwise("甲 廳"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(tiers, lambda t: F.concat(t["name"], F.lit("="), t["price"].cast("int").cast("string"))), ",").alias("tiers"), F.array_join(names, "|").alias("venues"))
