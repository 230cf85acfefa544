"""Queries over listings and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.operators import dedupe, runs
from marquee.plans.registry import LISTING_SQL, SESSION_SQL, TODAY, keyed, listings, query, sessions

_KEY = r"lower(regexp_replace({}, '\s', '', 'g'))"
_ORD = "l_orderkey, l_linenumber, l_partkey, l_suppkey, price"
RESOLVED_SQL = f"""{LISTING_SQL}, b AS (
  SELECT *, substr(sha1({_KEY.format('name')} || '|' || date || '|' || {_KEY.format('venue')}), 1, 16) AS base_id,
         CAST(split_part(time, ':', 1) AS INT) * 60 + CAST(split_part(time, ':', 2) AS INT) AS m FROM listing
), o AS (SELECT *, CASE WHEN m < 1020 THEN 'day' WHEN m IS NOT NULL THEN 'evening' END AS own FROM b
), g AS (
  SELECT *, CASE WHEN min(own) OVER (PARTITION BY base_id) <> max(own) OVER (PARTITION BY base_id)
    THEN coalesce(own, first_value(own IGNORE NULLS) OVER (PARTITION BY base_id ORDER BY {_ORD} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) END AS bucket FROM o
), n AS (SELECT *, CASE WHEN m - lag(m) OVER (PARTITION BY base_id, bucket ORDER BY m NULLS LAST) > 90 THEN 1 ELSE 0 END AS fresh FROM g
), i AS (SELECT *, CASE WHEN m IS NOT NULL THEN sum(fresh) OVER (PARTITION BY base_id, bucket ORDER BY m NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS isl FROM n
), j AS (
  SELECT *, max(isl) OVER (PARTITION BY base_id, bucket) > 0 AS many,
         coalesce(isl, first_value(isl IGNORE NULLS) OVER (PARTITION BY base_id, bucket ORDER BY {_ORD} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS mine FROM i
), l AS (SELECT *, CASE WHEN many THEN min(time) OVER (PARTITION BY base_id, bucket, mine) END AS island FROM j
), resolved AS (SELECT *, concat_ws('-', base_id, bucket, island) AS id,
         row_number() OVER (PARTITION BY concat_ws('-', base_id, bucket, island) ORDER BY priority + CASE WHEN special THEN 0.5 ELSE 0 END, price < 5000, {_ORD}) AS rk FROM l)"""


def _derived():
    """Columns of a listing that follow from others."""
    paid = F.when(F.col("price") >= 5000, F.col("price"))
    return {"price_min": paid, "price_max": paid, "lineup": F.array("title"), "types": F.array("source")}


def _resolved(spark, sf_dir):
    return dedupe.resolve_ids(listings(spark, sf_dir).withColumns(_derived()))


def _events(spark, sf_dir, **asked):
    return dedupe.dedupe_events(listings(spark, sf_dir), behind=keyed() | _derived(), **asked)


@query(f"""WITH {RESOLVED_SQL}
SELECT id, max(CASE WHEN rk = 1 THEN raw_id END) AS base_raw_id, max(CASE WHEN rk = 1 THEN city END) AS city, max(CASE WHEN rk = 1 THEN time END) AS time,
       string_agg(source || '/' || raw_id, ',' ORDER BY rk) AS sources, count(*) AS n_sources,
       min(CASE WHEN price >= 5000 THEN price END) AS price_min, max(CASE WHEN price >= 5000 THEN price END) AS price_max
FROM resolved GROUP BY id""")
def dedupe_full(spark, sf_dir):
    out = _events(spark, sf_dir, keep=("city", "time"), union=())
    return out.select("id", F.col("sources")[0]["raw_id"].alias("base_raw_id"), "city", "time", F.array_join(F.transform("sources", lambda s: F.concat_ws("/", s["name"], s["raw_id"])), ",").alias("sources"),
                      F.size("sources").cast("long").alias("n_sources"), "price_min", "price_max")


@query(f"""WITH {RESOLVED_SQL} SELECT raw_id, price, base_id, bucket, island, id FROM resolved""")
def time_islands(spark, sf_dir):
    return _resolved(spark, sf_dir).select("raw_id", "price", "base_id", "bucket", "island", "id")


@query(f"""WITH {RESOLVED_SQL}, f AS (SELECT id, title, min(rk) AS k FROM resolved GROUP BY id, title), s AS (SELECT id, source, min(rk) AS k FROM resolved GROUP BY id, source)
SELECT a.id, lineup, types FROM (SELECT id, string_agg(title, '|' ORDER BY k) AS lineup FROM f GROUP BY id) a
JOIN (SELECT id, string_agg(source, '|' ORDER BY k) AS types FROM s GROUP BY id) b ON a.id = b.id""")
def merge_arrays(spark, sf_dir):
    return _events(spark, sf_dir, keep=(), union=("lineup", "types"), sources=False).select("id", F.array_join("lineup", "|").alias("lineup"), F.array_join("types", "|").alias("types"))


@query(f"""WITH {RESOLVED_SQL} SELECT id, source AS base_source, raw_id AS base_raw_id FROM resolved WHERE rk = 1""")
def base_pick(spark, sf_dir):
    rows = _resolved(spark, sf_dir)
    key = F.struct(dedupe.listing_rank(F.col("priority"), F.col("special")).alias("r"), F.col("price_min").isNull().alias("free"), F.col("ord").alias("ord"))
    return rows.groupBy("id").agg(F.min_by(F.struct("source", "raw_id"), key).alias("b")).select("id", F.col("b.source").alias("base_source"), F.col("b.raw_id").alias("base_raw_id"))


RUNS_SQL = f"""{SESSION_SQL}, s AS (SELECT *, date >= DATE '{TODAY}' AS up, max(CASE WHEN date >= DATE '{TODAY}' THEN 1 ELSE 0 END) OVER (PARTITION BY run_key) AS has_up FROM session
), r AS (SELECT *, row_number() OVER (PARTITION BY run_key ORDER BY CASE WHEN has_up = 1 AND NOT up THEN 1 ELSE 0 END, date, time, ord) AS rk FROM s)"""


@query(f"""WITH {RUNS_SQL}
SELECT substr(sha1('run|' || run_key || '|'), 1, 16) AS id, run_key, max(CASE WHEN rk = 1 THEN venue END) AS venue, max(CASE WHEN rk = 1 THEN date END) AS date, max(CASE WHEN rk = 1 THEN time END) AS time,
       CASE WHEN max(has_up) = 1 THEN max(CASE WHEN up THEN date END) ELSE max(date) END AS date_end, count(*) AS n_sessions,
       CASE WHEN bool_or(up AND status = 'on_sale') THEN 'on_sale' WHEN bool_or(up AND status = 'announced') THEN 'announced' WHEN bool_or(up AND status = 'sold_out') THEN 'sold_out' ELSE 'ended' END AS status,
       CASE WHEN NOT bool_or(up AND status = 'on_sale') AND bool_or(up AND status = 'announced') THEN min(CASE WHEN up AND status = 'announced' THEN on_sale_at END) END AS on_sale_at,
       min(price_min) AS price_min, max(price_max) AS price_max FROM r GROUP BY run_key""", dates=("date", "date_end"))
def run_rollup(spark, sf_dir):
    return runs.group_runs(sessions(spark, sf_dir), F.to_date(F.lit(TODAY)), base=("venue",)).select(
        "id", "run_key", "venue", "date", "time", "date_end", F.size("sessions").cast("long").alias("n_sessions"), "status", "on_sale_at", "price_min", "price_max")


def _runs(spark, sf_dir):
    return runs.group_runs(sessions(spark, sf_dir), F.to_date(F.lit(TODAY)), base=("venue",))


@query(f"""WITH {SESSION_SQL}, s AS (SELECT *, row_number() OVER (PARTITION BY run_key ORDER BY date < DATE '{TODAY}', CASE WHEN date >= DATE '{TODAY}' THEN date - DATE '{TODAY}' ELSE DATE '{TODAY}' - date END,
  CASE WHEN date >= DATE '{TODAY}' THEN time END, CASE WHEN date < DATE '{TODAY}' THEN time END DESC) AS k FROM session)
SELECT run_key, date, time FROM s WHERE k = 1""", dates=("date",))
def next_session(spark, sf_dir):
    return _runs(spark, sf_dir).select("run_key", runs.next_session(F.col("sessions"), F.to_date(F.lit(TODAY))).alias("s")).select("run_key", "s.date", "s.time")


@query(f"""WITH {SESSION_SQL}, u AS (SELECT *, max(date >= DATE '{TODAY}') OVER (PARTITION BY run_key) AS any_up FROM session), k AS (SELECT * FROM u WHERE NOT any_up OR date >= DATE '{TODAY}')
SELECT run_key, string_agg(DISTINCT strftime(date, '%Y-%m-%d'), ',' ORDER BY strftime(date, '%Y-%m-%d')) AS dates, count(DISTINCT city) AS n_cities FROM k GROUP BY run_key""")
def run_dates(spark, sf_dir):
    today = F.to_date(F.lit(TODAY))
    return _runs(spark, sf_dir).select(
        "run_key", F.array_join(F.transform(runs.event_dates(F.col("sessions"), today), lambda d: F.date_format(d, "yyyy-MM-dd")), ",").alias("dates"),
        F.size(runs.event_cities(F.col("sessions"), today)).cast("long").alias("n_cities"))


@query(f"""WITH {SESSION_SQL}, c AS (SELECT run_key, count(DISTINCT city) AS n FROM session GROUP BY run_key),
u AS (SELECT run_key, count(*) AS k, strftime(min(date), '%m/%d') || '–' || strftime(max(date), '%m/%d') || ' ' || count(*) AS span,
  string_agg(strftime(date, '%m/%d') || ' ' || city || CASE WHEN status = 'sold_out' THEN ' （完售）' ELSE '' END, '、' ORDER BY date, time, venue, city, status) AS stops FROM session WHERE date >= DATE '{TODAY}' GROUP BY run_key)
SELECT c.run_key, CASE WHEN k > 1 THEN CASE WHEN n > 1 THEN stops ELSE span END END AS summary FROM c LEFT JOIN u ON c.run_key = u.run_key""")
def run_summary(spark, sf_dir):
    return _runs(spark, sf_dir).select("run_key", runs.run_summary(F.col("sessions"), F.to_date(F.lit(TODAY))).alias("summary"))


_SIGNAL = "CASE event_id % 4 WHEN 0 THEN 'IN_STOCK' WHEN 1 THEN 'COMING_SOON' WHEN 2 THEN 'SOLD_OUT' ELSE 'REGISTRATION_CLOSED' END"


def _signals(spark, sf_dir):
    k = F.col("event_id") % 4
    signal = F.when(k == 0, "IN_STOCK").when(k == 1, "COMING_SOON").when(k == 2, "SOLD_OUT").otherwise("REGISTRATION_CLOSED")
    return sessions(spark, sf_dir).withColumn("signal", F.when(F.col("value") > 3, signal))


@query(f"""WITH {SESSION_SQL}, s AS (SELECT run_key, date, {_SIGNAL} AS signal, on_sale_at, row_number() OVER (PARTITION BY run_key, date ORDER BY least(event_id % 4, 2), event_id) AS k FROM session WHERE value > 3)
SELECT run_key, date, signal, on_sale_at FROM s WHERE k = 1""", dates=("date",))
def signals(spark, sf_dir):
    return runs.combine_signals(_signals(spark, sf_dir), ["run_key", "date"])


@query(f"""WITH {SESSION_SQL}, s AS (SELECT date, venue, CASE WHEN value > 3 THEN {_SIGNAL} END AS signal, on_sale_at AS sale_start FROM session), r AS (
  SELECT date AS start, venue, signal, sale_start, row_number() OVER (PARTITION BY date, venue ORDER BY signal IS NULL, CASE signal WHEN 'IN_STOCK' THEN 0 WHEN 'COMING_SOON' THEN 1 ELSE 2 END, sale_start NULLS FIRST, signal) AS k,
  min(sale_start) OVER (PARTITION BY date, venue) AS first_start FROM s)
SELECT start, venue, CASE signal WHEN 'SOLD_OUT' THEN 'over' WHEN 'REGISTRATION_CLOSED' THEN 'over' ELSE signal END AS signal, first_start AS sale_start FROM r WHERE k = 1""", dates=("start",))
def game_sessions(spark, sf_dir):
    out = runs.games_to_sessions(_signals(spark, sf_dir).select(F.col("date").alias("start"), "venue", "signal", F.col("on_sale_at").alias("sale_start")))
    return out.withColumn("signal", F.when(F.col("signal").isin("SOLD_OUT", "REGISTRATION_CLOSED"), "over").otherwise(F.col("signal")))


@query(f"""WITH {LISTING_SQL}, t AS (SELECT date, time, venue, special AS limited, round(price / 10000) * 10000 AS price, bool_and(l_linenumber % 3 = 0) AS closed FROM listing WHERE time IS NOT NULL GROUP BY ALL),
p AS (SELECT *, bool_or(NOT limited) OVER (PARTITION BY date, time, venue) AS has_plain FROM t)
SELECT date, time, venue, string_agg(CAST(CAST(price AS INT) AS VARCHAR) || CASE WHEN closed THEN 'x' ELSE '' END, ',' ORDER BY price) AS tiers, bool_and(closed) AS all_closed FROM p WHERE NOT has_plain OR NOT limited GROUP BY date, time, venue""", dates=("date",))
def tier_sessions(spark, sf_dir):
    rows = listings(spark, sf_dir).where("time is not null").select("date", "time", "venue", F.when(F.col("special"), "身障席").otherwise("全票").alias("name"), (F.round(F.col("price") / 10000) * 10000).alias("price"), (F.col("l_linenumber") % 3 == 0).alias("closed"))
    text = F.transform("tiers", lambda t: F.concat(t["price"].cast("int").cast("string"), F.when(t["closed"], "x").otherwise("")))
    return runs.tier_rows_to_sessions(rows, "身障").select("date", "time", "venue", F.array_join(text, ",").alias("tiers"), "all_closed")


@query("""WITH s AS (SELECT l_orderkey, l_suppkey || '/' || l_linenumber AS stop FROM lineitem), n AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY stop) - 1 AS i FROM s)
SELECT CASE WHEN n > 1 THEN l_orderkey || '#' || i ELSE CAST(l_orderkey AS VARCHAR) END AS raw_id, CASE WHEN n > 1 THEN CAST(l_orderkey AS VARCHAR) END AS run_key, stop FROM n""")
def multi_stop(spark, sf_dir):
    from marquee.plans.registry import table

    stops = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("raw_id")).agg(F.sort_array(F.collect_list(F.concat_ws("/", F.col("l_suppkey").cast("string"), F.col("l_linenumber").cast("string")))).alias("stops"))
    return runs.multi_stops(stops.withColumn("run_key", F.lit(None).cast("string")))
