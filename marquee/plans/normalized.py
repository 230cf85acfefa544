"""Queries over the whole projection of listings, incremental recomputing, and replayed streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.operators import browse, match, normalize, prefs, relations, snapshot
from marquee.plans.registry import LISTING_SQL, SESSION_SQL, SOURCES, listings, query, sessions, table
from marquee.shared import shared_dir
from marquee.sources.tables import union_sources
from marquee.streaming import streams

def _raw(spark, sf_dir):
    v = listings(spark, sf_dir)
    k = F.col("l_partkey")
    first = F.col("source").isin("AF", "AO")
    text = F.when(k % 11 == 0, "soon").when(first, F.date_format("date", "yyyy/MM/dd")).otherwise(F.date_format("date", "yyyy-MM-dd"))
    title = F.concat(F.lit("live "), F.when(k % 7 != 0, F.concat("name", F.lit(" "))).otherwise(""), "title", F.when(k % 41 == 0, " 音樂祭").when(k % 43 == 0, " 登記抽選").otherwise(""))
    return v.select(
        F.concat_ws("~", "raw_id", F.col("price").cast("string")).alias("id"), "raw_id", "source", F.when(k % 31 != 0, title).alias("title"), F.col("title").alias("venue"), F.lit(None).cast("string").alias("address"),
        F.concat_ws(" ", text, "time").alias("date_text"), F.concat(F.lit("票價：NT$"), (k % 900 + 100).cast("string")).alias("price_text"), F.when(F.col("l_orderkey") % 4 == 0, "已售完").otherwise("").alias("status_text"),
        F.when(k % 17 == 0, "http://demo.test/x").when(k % 19 == 0, "http://OUT.test").otherwise("http://a.test").alias("url"), F.lit(None).cast("string").alias("signal"), F.lit(None).cast("array<struct<price:double,closed:boolean,waiting:boolean,on_sale_at:string>>").alias("tiers"),
        F.when(k % 13 == 0, "音樂劇").alias("category"), F.when(k % 13 == 0, F.concat(F.lit("run "), "name")).alias("run_key"), F.when(k % 37 == 0, "soon").when(F.col("l_orderkey") % 5 == 0, "2030-01-01T12:00:00+08:00").alias("on_sale_text"))


def _overrides(spark, sf_dir):
    k = F.col("l_partkey")
    of = lambda field, each, value: F.when(k % each == 0, F.struct(F.lit(field).alias("field"), F.lit(value).alias("value")))
    given = F.array(of("venue", 23, "moved hall"), of("date", 29, "1999-01-01"), of("category", 39, ""), of("category", 47, "戲劇"))
    v = listings(spark, sf_dir).where(" or ".join(f"l_partkey % {each} = 0" for each in (23, 29, 39, 47)))
    rows = v.select(F.concat_ws("~", "raw_id", F.col("price").cast("string")).alias("key"), F.explode(F.filter(given, lambda x: x.isNotNull())).alias("o"))
    return rows.select("o.field", "key", "o.value")


OUTCOME_SQL = f"""{LISTING_SQL}, l AS (SELECT *, CASE WHEN l_partkey % 29 = 0 THEN DATE '1999-01-01' WHEN l_partkey % 11 <> 0 THEN date END AS d, CASE WHEN l_partkey % 47 = 0 THEN '戲劇' WHEN l_partkey % 13 = 0 AND l_partkey % 39 <> 0 THEN '音樂劇' END AS cat,
  CASE WHEN l_partkey % 31 = 0 THEN 'normalize_error' WHEN contains(lower(title), 'ring') THEN 'non_music_noise' WHEN l_partkey % 17 = 0 THEN 'platform_demo_content' WHEN l_partkey % 19 = 0 THEN 'excluded_account' END AS early,
  CASE WHEN l_partkey % 7 <> 0 AND l_partkey % 31 <> 0 THEN name END AS act FROM listing
), o AS (SELECT *, raw_id || '~' || CAST(price AS VARCHAR) AS id, coalesce(early, CASE WHEN l_partkey % 37 = 0 THEN 'normalize_error' WHEN d IS NULL THEN 'date_unparseable' END) AS reason,
  CASE WHEN early IS NULL AND l_partkey % 37 = 0 THEN 'on_sale_text: soon' WHEN early IS NULL AND d IS NULL THEN 'soon' || coalesce(' ' || time, '') WHEN l_partkey % 31 = 0 THEN 'title is missing' END AS detail FROM l
), outcomes AS (SELECT *, CASE WHEN reason IS NULL THEN 'event' WHEN reason IN ('normalize_error', 'date_unparseable') THEN 'needs_review' ELSE 'excluded' END AS outcome,
  CASE WHEN l_orderkey % 4 = 0 THEN CASE WHEN d IS NULL OR d < DATE '1998-01-01' THEN 'ended' ELSE 'sold_out' END WHEN l_partkey % 37 <> 0 AND l_orderkey % 5 = 0 THEN 'announced' ELSE 'on_sale' END AS status FROM o)"""


@query(f"""WITH {OUTCOME_SQL} SELECT id, outcome, reason, detail, CASE WHEN l_partkey % 23 = 0 THEN 'moved hall' ELSE title END AS venue, CASE WHEN contains(title, 'red') AND l_partkey % 23 <> 0 THEN '台中' ELSE '未知' END AS city,
  CAST(d AS VARCHAR) AS date, CASE WHEN l_partkey % 11 <> 0 AND l_partkey % 29 <> 0 THEN time END AS time, CAST(l_partkey % 900 + 100 AS DOUBLE) AS price_min, status,
  CASE WHEN status = 'announced' THEN '2030-01-01T12:00:00+08:00' END AS on_sale_at, act AS headliner, act AS lineup, l_partkey % 41 = 0 AND l_partkey % 31 <> 0 AS is_festival,
  coalesce(cat, CASE WHEN l_partkey % 41 = 0 AND l_partkey % 31 <> 0 THEN '音樂祭' ELSE '專場' END) AS type, CASE WHEN ends_with(act, '1') OR ends_with(act, '2') THEN 'west' END AS origin,
  l_partkey % 43 = 0 AND l_partkey % 41 <> 0 AND l_partkey % 31 <> 0 AS is_lottery, cat AS category, CASE WHEN l_partkey % 13 = 0 AND (l_partkey % 39 <> 0 OR cat IS NOT NULL) THEN 'run ' || name END AS run_key, source || '/' || raw_id AS sources
FROM outcomes""", dates=("date",))
def normalize_outcomes(spark, sf_dir):
    out = _outcomes(spark, sf_dir)
    longest = F.try_element_at(F.array_sort(F.col("headliners")), F.lit(-1))
    return out.select("id", "outcome", "reason", "detail", "venue", "city", "date", "time", "price_min", "status", "on_sale_at", longest.alias("headliner"), F.try_element_at(F.array_sort("lineup"), F.lit(-1)).alias("lineup"), "is_festival",
                      F.col("types")[0].alias("type"), F.get("origins", F.lit(0)).alias("origin"), "is_lottery", "category", "run_key", F.concat_ws("/", F.col("sources")[0]["name"], F.col("sources")[0]["raw_id"]).alias("sources"))


def _outcomes(spark, sf_dir):
    brand = F.col("p_brand")
    names = table(spark, sf_dir, "part").select(brand.alias("canonical"), brand.alias("name"), F.when(F.substring(brand, -1, 1).isin("1", "2"), "west").alias("origin")).distinct().withColumn("entry_ord", F.lit(0))
    rules = spark.createDataFrame([("red", "台中", 1)], "match string, city string, rule_ord int")
    grammars = {s: "slash" if s in ("AF", "AO") else "dash" for s in ("AF", "AO", "NF", "NO", "RF", "RO")}
    return normalize.listing_outcomes(_raw(spark, sf_dir), names, rules, grammars=grammars, today=F.to_date(F.lit("1998-01-01")), account_suffix=".test", rules={"noise": ("Ring",), "demo": "^http://demo[.]", "accounts": ("out",)}, overrides=_overrides(spark, sf_dir))


@query(f"""WITH {OUTCOME_SQL} SELECT id, reason, detail FROM outcomes WHERE outcome = 'needs_review' UNION ALL SELECT id, 'artist_unrecognized', NULL FROM outcomes WHERE outcome = 'event' AND act IS NULL AND cat IS NULL""")
def review_queue(spark, sf_dir):
    return normalize.review_queue(_outcomes(spark, sf_dir)).select("id", "reason", "detail")


@query(f"WITH {LISTING_SQL} SELECT source, count(*) FILTER (date >= DATE '1998-01-01') AS upcoming, count(*) FILTER (date < DATE '1998-01-01') AS past FROM listing GROUP BY source")
def upcoming_past(spark, sf_dir):
    v = listings(spark, sf_dir).withColumn("date_end", F.when(F.col("special"), F.col("date")))
    day = F.to_date(F.lit("1998-01-01"))
    count = lambda df, n: df.groupBy("source").agg(F.count("*").alias(n))
    return count(browse.upcoming(v, day), "upcoming").join(count(browse.past(v, day), "past"), "source")


@query("SELECT p_partkey FROM part WHERE p_size % 5 <> 0 AND p_size % 7 <> 0 AND p_type <> 'PROMO'")
def row_filters(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return normalize.listed_only(p.withColumn("merch", F.col("p_size") % 5 == 0).withColumn("hidden", F.when(F.col("p_size") % 7 == 0, True)).withColumn("state", F.when(F.col("p_type") == "PROMO", "withdrawn"))).select("p_partkey")


@query("SELECT p_partkey AS id FROM part WHERE p_type NOT IN ('PROMO', 'SMALL') OR (p_type = 'PROMO' AND regexp_matches(p_name, '^red|ring$')) OR (p_type = 'SMALL' AND contains(p_name, 'blue'))")
def venue_predicates(spark, sf_dir):
    rules = spark.createDataFrame([("PROMO", "^red"), ("PROMO", "ring$"), ("SMALL", "blue")], "keyword string, pattern string")
    return normalize.venue_predicates(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("keyword"), F.col("p_name").alias("venue")), rules).select("id")


@query("SELECT o_orderkey AS raw_id FROM orders o WHERE o_orderkey % 3 = 0 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 30)")
def review_pending(spark, sf_dir):
    q = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("raw_id"))
    return normalize.review_pending(q, table(spark, sf_dir, "lineitem").where("l_quantity > 30").select(F.col("l_orderkey").alias("raw_id")))


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'new' ELSE 'old' END AS head, CASE WHEN p_size % 2 = 0 THEN '台中' ELSE '台北' END AS city FROM part WHERE NOT contains(p_name, 'ring')""")
def renormalize(spark, sf_dir):
    s = F.col("p_size")
    none = F.array().cast("array<string>")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name", F.when(s % 3 == 0, none).otherwise(F.array(F.lit("old"))).alias("headliners"), F.when(s % 2 == 0, "未知").otherwise("台北").alias("city"))
    kept, _ = snapshot.renormalize(p, F.when(F.col("p_name").contains("ring"), "noise"), F.array(F.lit("new")), F.lit("台中"))
    return kept.select("id", F.col("headliners")[0].alias("head"), "city")


@query("""WITH gone AS (SELECT DISTINCT l_suppkey AS k, CASE WHEN l_returnflag = 'R' THEN 's' ELSE 't' END AS source FROM lineitem JOIN part ON l_partkey = p_partkey WHERE contains(p_name, 'ring') AND l_quantity >= 49)
SELECT 'cache' AS kind, source, CAST(k AS VARCHAR) AS raw_id, 'non_music_noise' AS reason FROM gone
UNION ALL SELECT 'review', 's', CAST(s_suppkey AS VARCHAR), CASE WHEN s_suppkey % 2 = 0 THEN 'artist_unrecognized' ELSE 'date_unparseable' END FROM supplier
WHERE NOT EXISTS (SELECT 1 FROM gone WHERE k = s_suppkey AND source = 's') AND NOT (s_suppkey % 2 = 0 AND s_nationkey % 3 = 0)""")
def renormalized_queues(spark, sf_dir):
    ref = lambda name, c: F.struct(name.alias("name"), c.cast("string").alias("raw_id"))
    noisy = table(spark, sf_dir, "part").where(F.col("p_name").contains("ring")).select(F.col("p_partkey").alias("l_partkey"))
    out = table(spark, sf_dir, "lineitem").where("l_quantity >= 49").join(noisy, "l_partkey").select(
        F.array(ref(F.when(F.col("l_returnflag") == "R", "s").otherwise("t"), F.col("l_suppkey"))).alias("sources"), F.lit("non_music_noise").alias("reason"))
    suppliers = table(spark, sf_dir, "supplier")
    review = suppliers.select(F.lit("s").alias("source"), F.col("s_suppkey").cast("string").alias("raw_id"), F.when(F.col("s_suppkey") % 2 == 0, "artist_unrecognized").otherwise("date_unparseable").alias("reason"))
    resolved = suppliers.where("s_nationkey % 3 = 0").select(F.array(ref(F.lit("s"), F.col("s_suppkey"))).alias("sources"))
    now = F.to_timestamp(F.lit("1998-01-01"))
    empty = review.limit(0).withColumn("checked_at", now)
    cache, left = snapshot.after_renormalize(empty, review, out, resolved, now)
    return cache.select(F.lit("cache").alias("kind"), "source", "raw_id", "reason").unionAll(left.select(F.lit("review"), "source", "raw_id", "reason"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey % 2 = 0 OR (o_custkey % 2 = 1 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY'))")
def rejected_recovery(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    other = table(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return snapshot.rejected_recovery(o.where("o_custkey % 2 = 0"), o.where("o_custkey % 2 = 1"), other, ["o_custkey"]).select("o_orderkey")


@query("SELECT canonical, name FROM (SELECT n_name AS canonical, n_name AS name FROM nation UNION ALL SELECT DISTINCT 'patched', p_brand FROM part UNION ALL SELECT 'patched', n_name FROM nation WHERE false)")
def dictionary_patch(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("canonical"), F.col("n_name").alias("name"))
    patch = n.select(F.lit("patched").alias("canonical"), "name").unionAll(table(spark, sf_dir, "part").select(F.lit("patched"), "p_brand").distinct())
    return match.patch_dictionary(n, patch)


@query(f"WITH {LISTING_SQL} SELECT source, count(*) AS n, count(price) FILTER (source = 'AF') AS priced FROM listing GROUP BY source")
def source_union(spark, sf_dir):
    v = listings(spark, sf_dir)
    parts = [v.where(F.col("source") == s).select(*(["source", "raw_id", "price"] if s == "AF" else ["raw_id", "source"])) for s in SOURCES]
    return union_sources(parts).groupBy("source").agg(F.count("*").alias("n"), F.count("price").alias("priced"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'old' || o_orderkey ELSE CASE WHEN o_custkey % 2 = 0 THEN 'img' || o_custkey WHEN o_custkey % 3 = 0 THEN 'other' || o_custkey END END AS image FROM orders""")
def backfill(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    ref = lambda name, c: F.struct(F.lit(name).alias("name"), c.cast("string").alias("raw_id"))
    events = o.select(F.col("o_orderkey").alias("id"), F.array(ref("s", -F.col("o_custkey") - 1), ref("s", F.col("o_custkey")), ref("t", F.col("o_custkey"))).alias("sources"))
    images = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("old"), F.col("o_orderkey").cast("string"))).alias("image")).unionAll(spark.range(1).select(F.lit(-5).cast("long"), F.lit("gone")))
    # two sources know listings by the same ids
    has = lambda name, each, word: o.where(f"o_custkey % {each} = 0").select(F.lit(name).alias("name"), F.col("o_custkey").cast("string").alias("raw_id"), F.concat(F.lit(word), F.col("o_custkey").cast("string")).alias("image")).distinct()
    found = has("s", 2, "img").unionAll(has("t", 3, "other"))
    return relations.backfill(events, images, found)


@query(f"""WITH {SESSION_SQL}, k AS (SELECT substr(sha1(lower(title) || '|' || date || '|' || lower(regexp_replace(venue, '\\s', '', 'g'))), 1, 16) AS id, * FROM session)
SELECT id, arg_max(time, ord) AS time, max(ord) AS ord, '未知' AS city, 'manual ' || id AS source FROM k GROUP BY id HAVING NOT bool_or(ends_with(venue, '3')) OR max(ord) > min(ord)""")
def manual_build(spark, sf_dir):
    rows = sessions(spark, sf_dir).select("title", "date", "venue", "time", "ord")
    # events at some venues are removed right after they were first given
    removed = prefs.manual_events(rows.withColumn("ord", -F.col("ord"))).where(F.col("venue").endswith("3")).select("id", (-F.col("ord")).alias("ord"))
    made = prefs.manual_events(rows, removed)
    return made.select("id", "time", "ord", "city", F.concat_ws(" ", F.col("sources")[0]["name"], F.col("sources")[0]["raw_id"]).alias("source"))


@query("SELECT l_orderkey, bool_and(l_returnflag = 'R') AS terminal FROM lineitem GROUP BY l_orderkey")
def rows_terminal(spark, sf_dir):
    from marquee.functions.status import TERMINAL

    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag") == "R", "2026/09/19 12:00 截止").otherwise("熱賣").alias("text"))
    return relations.all_rows_terminal(li, ["l_orderkey"], "text", TERMINAL)


# -- streams, replayed from the events files and compared with their batch result

def _replay(spark, sf_dir, make) -> DataFrame:
    """The rows that a streaming query gives for the whole events table, read as a stream until it is used up."""
    events = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return _drained(spark, make(stream.withColumn("ts", F.col("ts").cast("timestamp"))))


def _drained(spark, out: DataFrame) -> DataFrame:
    """A stream's output, written as files in the shared folder until the input is used up, and read back."""
    path = f"{shared_dir(spark)}/replay-{uuid.uuid4().hex}"
    q = (out.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint")
         .outputMode("append").trigger(availableNow=True).start())
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return spark.read.schema(out.schema).parquet(f"{path}/rows")


@query("SELECT DISTINCT event_type AS source, CAST(user_id AS VARCHAR) AS raw_id FROM events")
def stream_first_seen(spark, sf_dir):
    return _replay(spark, sf_dir, lambda s: streams.first_seen(s.select(F.col("event_type").alias("source"), F.col("user_id").cast("string").alias("raw_id"), "ts"), late="60 days")).select("source", "raw_id")


@query("""WITH e AS (SELECT user_id, event_id, ts, CASE WHEN event_type IN ('click', 'view') THEN 'on_sale' WHEN event_type = 'error' THEN 'sold_out' ELSE 'announced' END AS status FROM events),
l AS (SELECT *, lag(status) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM e) SELECT CAST(user_id AS VARCHAR) AS raw_id, status, count(*) AS n FROM l WHERE before IS DISTINCT FROM status GROUP BY ALL""")
def stream_status_machine(spark, sf_dir):
    t = F.col("event_type")
    signal = F.when(t.isin("click", "view"), "IN_STOCK").when(t == "error", "SOLD_OUT").otherwise("COMING_SOON")
    rows = lambda s: s.select(F.lit("e").alias("source"), F.col("user_id").cast("string").alias("raw_id"), signal.alias("signal"), F.lit(None).cast("timestamp").alias("on_sale_at"), "ts")
    return _replay(spark, sf_dir, lambda s: streams.status_changes(rows(s))).groupBy("raw_id", "status").agg(F.count("*").alias("n"))


@query("""WITH x AS (SELECT user_id, ts AS checked_at FROM events WHERE event_type = 'error'), m AS (SELECT date_trunc('day', max(ts)) - INTERVAL 1 DAY AS until FROM events)
SELECT event_id FROM events e, m WHERE event_type <> 'error' AND ts < until AND NOT EXISTS (SELECT 1 FROM x WHERE x.user_id = e.user_id AND e.ts >= checked_at AND e.ts < checked_at + INTERVAL 2 DAY)""")
def stream_exclusion_ttl(spark, sf_dir):
    # users are excluded again and again, at the events of one type, each time for two days
    keyed = lambda s: s.select(F.lit("e").alias("source"), F.col("user_id").alias("raw_id"), "event_id", "event_type", "ts")
    made = lambda s: streams.not_excluded(keyed(s).where("event_type != 'error'"), keyed(s).where("event_type = 'error'").select("source", "raw_id", F.col("ts").alias("checked_at")), ttl_days=2)
    # the watermark holds the last rows back
    until = table(spark, sf_dir, "events").agg(F.date_trunc("day", F.max("ts")) - F.expr("interval 1 day"))
    return _replay(spark, sf_dir, made).where(F.col("ts") < until.scalar()).select("event_id")


@query("""WITH c AS (SELECT event_type AS source, CAST(ts AS DATE) AS day, count(*) FILTER (NOT (event_type = 'click' AND day(ts) BETWEEN 10 AND 12)) AS n FROM events GROUP BY ALL),
m AS (SELECT max(day) AS last FROM c), h AS (SELECT source, day, n, coalesce(last_value(nullif(n, 0) IGNORE NULLS) OVER (PARTITION BY source ORDER BY day), 0) AS last_count FROM c)
SELECT source, CAST(day AS VARCHAR) AS day, n, CASE WHEN n = 0 AND last_count > 0 THEN 'anomaly' ELSE 'ok' END AS status, last_count FROM h, m WHERE day < last - 1""")
def stream_source_health(spark, sf_dir):
    rows = lambda s: s.select(F.col("event_type").alias("source"), "ts", (~((F.col("event_type") == "click") & F.day("ts").between(10, 12))).alias("present"))
    # the daily counts are a stream of their own, which the state machine follows
    counts = _replay(spark, sf_dir, lambda s: streams.daily_counts(rows(s), late="1 hour"))
    stream = spark.readStream.schema(counts.schema).parquet(counts.inputFiles()[0].rsplit("/", 1)[0])
    out = _drained(spark, streams.source_health(stream)).withColumn("day", F.to_date("day"))
    day = table(spark, sf_dir, "events").agg(F.to_date(F.max("ts")).alias("last"))
    return out.join(F.broadcast(day), F.col("day") < F.date_sub("last", 1)).select("source", F.col("day").cast("string").alias("day"), "n", "status", "last_count")
