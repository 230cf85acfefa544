"""Queries over snapshots, dictionaries, relations, preferences and browsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.functions import status as st
from marquee.operators import browse, match, prefs, quality, relations, snapshot
from marquee.plans.registry import LISTING_SQL, SESSION_SQL, TODAY, listings, query, sessions, table

OLD_SQL = "old AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS price_min, o_orderpriority AS source, CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_orderkey % 10 <> 0)"
NEW_SQL = ("new AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 14 = 0 THEN NULL ELSE o_totalprice END AS price_min, "
           "o_orderpriority AS source, CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_orderkey % 10 <> 1)")


def _old_new(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price_min"), F.col("o_orderpriority").alias("source"), F.to_date("o_orderdate").alias("date"))
    new = o.where("id % 10 != 1").withColumn("status", F.when(F.col("id") % 7 == 0, "X").otherwise(F.col("status"))).withColumn("price_min", F.when(F.col("id") % 14 != 0, F.col("price_min")))
    return o.where("id % 10 != 0"), new


@query(f"""WITH {OLD_SQL}, {NEW_SQL}
SELECT coalesce(n.id, o.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' WHEN (n.id % 4 <> 0 AND o.status IS DISTINCT FROM n.status) OR o.price_min IS DISTINCT FROM n.price_min THEN 'updated' ELSE 'unchanged' END AS change,
  CASE WHEN o.id IS NOT NULL AND n.id IS NOT NULL THEN concat_ws(',', CASE WHEN n.id % 4 <> 0 AND o.status IS DISTINCT FROM n.status THEN 'status' END, CASE WHEN o.price_min IS DISTINCT FROM n.price_min THEN 'price_min' END) END AS fields
FROM old o FULL JOIN new n ON o.id = n.id""")
def snapshot_diff(spark, sf_dir):
    old, new = _old_new(spark, sf_dir)
    # of every fourth row, a run, the status isn't watched
    runs = new.withColumn("sessions", F.when(F.col("id") % 4 == 0, F.array("date")))
    return snapshot.snapshot_diff(old, runs, fields=("status", "price_min"), run_col="sessions", run_fields=("price_min",), include_removed=True).withColumn("fields", F.array_join("fields", ","))


@query(f"""WITH {OLD_SQL}, {NEW_SQL}
SELECT n.id, coalesce(CAST(o.date AS VARCHAR), '2024-01-01') AS first_seen_at, CASE WHEN o.id IS NOT NULL AND o.status IS NOT DISTINCT FROM n.status AND o.price_min IS NOT DISTINCT FROM n.price_min THEN CAST(o.date + 1 AS VARCHAR) ELSE '2024-01-01' END AS updated_at
FROM new n LEFT JOIN old o ON o.id = n.id""")
def first_seen_carry(spark, sf_dir):
    old, new = _old_new(spark, sf_dir)
    old = old.withColumn("first_seen_at", F.col("date").cast("string")).withColumn("updated_at", F.date_add("date", 1).cast("string"))
    return snapshot.snapshot_diff(old, new, fields=("status", "price_min"), now=F.lit("2024-01-01")).select("id", "first_seen_at", "updated_at")


@query("""SELECT CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 10 <> 1 THEN 'o' || o_orderkey WHEN o_orderkey % 3 = 0 THEN 'n' || o_orderkey ELSE 'o' || o_orderkey END AS id,
  CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 10 <> 1 THEN 'o' || o_orderkey END AS old_id, CASE WHEN o_orderkey % 3 = 0 THEN 'n' ELSE 'o' END || o_orderkey AS own_id FROM orders""")
def id_lineage(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    ref = lambda c: F.struct(F.lit("s").alias("name"), c.cast("string").alias("raw_id"))
    named = lambda c: F.concat(c, F.col("o_orderkey").cast("string")).alias("id")
    new = o.select(named(F.when(F.col("o_orderkey") % 3 == 0, "n").otherwise("o")), F.array(ref(-F.col("o_orderkey")), ref(F.col("o_orderkey"))).alias("sources"))
    old = o.where("o_orderkey % 10 != 1").select(named(F.lit("o")), F.array(ref(F.col("o_orderkey"))).alias("sources"))
    return snapshot.id_lineage(new.withColumn("own_id", F.col("id")), old).select("id", "old_id", "own_id")


@query(f"""WITH {OLD_SQL}, {NEW_SQL}, p AS (SELECT source, count(*) AS last_count FROM old GROUP BY source), c AS (SELECT source, CASE WHEN source = '1-URGENT' THEN 0 WHEN source = '2-HIGH' THEN NULL ELSE count(*) END AS n FROM new GROUP BY source)
SELECT p.source, CASE WHEN n IS NULL THEN 'error' WHEN n = 0 AND last_count > 0 THEN 'anomaly' ELSE 'ok' END AS status, CASE WHEN n > 0 THEN n ELSE last_count END AS last_count FROM p JOIN c ON p.source = c.source""")
def source_health(spark, sf_dir):
    return _health(spark, sf_dir)


def _health(spark, sf_dir):
    old, new = _old_new(spark, sf_dir)
    counts = new.groupBy("source").agg(F.when(F.col("source") == "1-URGENT", 0).when(F.col("source") != "2-HIGH", F.count("*")).alias("n"))
    return snapshot.source_health(old.groupBy("source").agg(F.count("*").alias("last_count")), counts)


@query(f"""WITH {OLD_SQL}, {NEW_SQL} SELECT source, status, count(*) AS n, round(sum(price_min), 2) AS total FROM (
  SELECT source, status, price_min FROM new WHERE source NOT IN ('1-URGENT', '2-HIGH') UNION ALL SELECT source, status, price_min FROM old WHERE source IN ('1-URGENT', '2-HIGH')) GROUP BY ALL""")
def source_fallback(spark, sf_dir):
    old, new = _old_new(spark, sf_dir)
    events = old.withColumn("sources", F.array(F.struct(F.col("source").alias("name"), F.col("id").cast("string").alias("raw_id")))).drop("source")
    out = snapshot.source_fallback(new.where(~F.col("source").isin("1-URGENT", "2-HIGH")), events, _health(spark, sf_dir))
    return out.groupBy("source", "status").agg(F.count("*").alias("n"), F.round(F.sum("price_min"), 2).alias("total"))


@query(f"""WITH {LISTING_SQL} SELECT source, name, raw_id, price FROM (SELECT *, row_number() OVER (PARTITION BY source, name ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, price) AS k FROM listing) WHERE k = 1""")
def first_wins(spark, sf_dir):
    return snapshot.first_wins(listings(spark, sf_dir).select("source", "name", "ord", "raw_id", "price"), ["source", "name"], ["ord"]).select("source", "name", "raw_id", "price")


@query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS k FROM conversations) WHERE k = 1")
def last_wins(spark, sf_dir):
    return snapshot.last_wins(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), ["conv_id"], ["turn", "role", "text"])


@query(f"""WITH {OLD_SQL}, {NEW_SQL}, d AS (SELECT n.id, unnest([{{'field': 'status', 'stored': o.status, 'fresh': n.status}}, {{'field': 'price_min', 'stored': CAST(o.price_min IS NULL AS VARCHAR), 'fresh': CAST(n.price_min IS NULL AS VARCHAR)}}]) AS d FROM old o JOIN new n ON o.id = n.id)
SELECT id, d.field AS field, d.stored AS stored, d.fresh AS fresh FROM d WHERE d.stored IS DISTINCT FROM d.fresh""")
def stored_vs_fresh(spark, sf_dir):
    old, new = (x.withColumn("price_min", F.col("price_min").isNull()) for x in _old_new(spark, sf_dir))
    return snapshot.stored_vs_fresh(old, new, ["id"], ("status", "price_min"))


@query(f"""WITH {OLD_SQL}, {NEW_SQL} SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NULL THEN 'delete' WHEN o.status = n.status AND o.id IS NOT NULL THEN 'keep' ELSE 'write' END AS action FROM old o FULL JOIN new n ON o.id = n.id""")
def write_if_changed(spark, sf_dir):
    return snapshot.write_actions(*_old_new(spark, sf_dir), "id", F.concat_ws("|", F.col("id").cast("string"), "status"))


@query("SELECT * FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem) WHERE k <= 8)")
def top_children(spark, sf_dir):
    return snapshot.latest_first(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], 8)


@query("""WITH e AS (SELECT o_orderkey AS id, o_orderpriority AS source, CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE 1 END AS named, o_orderstatus AS status FROM orders)
SELECT source, CAST(id AS VARCHAR) AS raw_id, status FROM e WHERE named = 1""")
def known_ids(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    none = F.array().cast("array<string>")
    ev = o.select(F.array(F.struct(F.col("o_orderpriority").alias("name"), F.col("o_orderkey").cast("string").alias("raw_id"))).alias("sources"),
                  F.when(F.col("o_custkey") % 3 == 0, none).otherwise(F.array(F.lit("x"))).alias("headliners"), F.col("o_orderstatus").alias("status"))
    return snapshot.known_ids(ev)


@query(f"""WITH {SESSION_SQL}, s AS (SELECT event_id, status, on_sale_at, date, CASE event_id % 6 WHEN 0 THEN 'IN_STOCK' WHEN 1 THEN 'COMING_SOON' WHEN 2 THEN 'SOLD_OUT' END AS signal FROM session), r AS (
  SELECT *, CASE WHEN date < DATE '{TODAY}' THEN 'ended' WHEN signal = 'SOLD_OUT' THEN 'sold_out' WHEN signal = 'IN_STOCK' THEN 'on_sale' WHEN signal = 'COMING_SOON' THEN 'announced' WHEN status = 'announced' AND on_sale_at <= '{TODAY}T12:00' THEN 'on_sale' END AS new,
  CASE WHEN date >= DATE '{TODAY}' AND signal = 'COMING_SOON' THEN on_sale_at END AS new_at FROM s)
SELECT event_id, coalesce(new, status) AS status, CASE WHEN new IS NULL THEN on_sale_at ELSE new_at END AS on_sale_at FROM r""")
def reuse_known(spark, sf_dir):
    s = sessions(spark, sf_dir).withColumn("source", F.col("event_type")).withColumn("raw_id", F.col("event_id").cast("string"))
    k = F.col("event_id") % 6
    sig = s.select("source", "raw_id", F.when(k == 0, "IN_STOCK").when(k == 1, "COMING_SOON").when(k == 2, "SOLD_OUT").alias("signal"), F.lit(None).cast("string").alias("on_sale_at")).where("signal is not null")
    out = snapshot.reuse_known(s.select("source", "raw_id", F.lit(True).alias("reuse_previous")), s.select("source", "raw_id", "event_id", "status", "on_sale_at", "date"), sig, F.lit(f"{TODAY}T12:00"), F.to_date(F.lit(TODAY)))
    return out.select("event_id", "status", "on_sale_at")


@query(f"""WITH {SESSION_SQL} SELECT event_id, coalesce(status NOT IN ('sold_out', 'ended') AND NOT (status = 'announced' AND coalesce(substr(on_sale_at, 1, 10) > '{TODAY}', false)), true) AS due FROM session""")
def status_gate(spark, sf_dir):
    return sessions(spark, sf_dir).select("event_id", st.needs_check(F.col("status"), F.col("on_sale_at"), F.lit(TODAY)).alias("due"))


@query("""WITH c AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'non_music_noise' WHEN 1 THEN 'classical' ELSE 'junk_title' END AS reason, DATE '2024-01-01' + CAST(doc_id % 20 AS INT) AS checked FROM documents)
SELECT source, CAST(doc_id AS VARCHAR) AS raw_id FROM c JOIN documents d USING (doc_id) WHERE reason <> 'junk_title' AND checked > DATE '2024-01-08' AND doc_id % 2 = 0""")
def exclusion_cache(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", F.col("doc_id").cast("string").alias("raw_id"), F.when(F.col("doc_id") % 3 == 0, "non_music_noise").when(F.col("doc_id") % 3 == 1, "classical").otherwise("junk_title").alias("reason"),
                                                 F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("doc_id") % 20).cast("int")).cast("timestamp").alias("checked_at"), "doc_id")
    now = F.to_timestamp(F.lit("2024-01-15"))
    cache = d.where("reason != 'junk_title'").select("source", "raw_id", "reason", "checked_at")
    return snapshot.skip_list(cache, d.where("doc_id % 2 = 0").select("source", "raw_id", "reason"), now)


# -- matching

NAMES = "SELECT n_name AS canonical, n_name AS name, n_nationkey AS entry_ord FROM nation UNION ALL SELECT n_name, 'land ' || n_nationkey, n_nationkey + 1000 FROM nation"
TITLES = "SELECT c_custkey AS id, 'live ' || a.n_name || ' & ' || lower(b.n_name) || ' in LAND ' || (c_custkey % 30) || 'x' || (CASE WHEN c_custkey % 3 = 0 THEN b.n_name ELSE '' END) AS title FROM customer JOIN nation a ON a.n_nationkey = c_nationkey JOIN nation b ON b.n_nationkey = (c_nationkey + c_custkey) % 25"


def _titles(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    c = table(spark, sf_dir, "customer").withColumn("k", ((F.col("c_nationkey") + F.col("c_custkey")) % 25).cast("int"))
    j = c.join(n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("a")), "c_nationkey").join(n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("b")), "k")
    title = F.concat(F.lit("live "), "a", F.lit(" & "), F.lower("b"), F.lit(" in LAND "), (F.col("c_custkey") % 30).cast("string"), F.lit("x"), F.when(F.col("c_custkey") % 3 == 0, F.col("b")).otherwise(""))
    names = n.select(F.col("n_name").alias("canonical"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("entry_ord")).unionAll(
        n.select("n_name", F.concat(F.lit("land "), F.col("n_nationkey").cast("string")), F.col("n_nationkey") + 1000))
    return j.select(F.col("c_custkey").alias("id"), title.alias("title")), names


MATCH_SQL = f"""names AS ({NAMES}), titles AS ({TITLES}), h AS (
  SELECT id, canonical, name, entry_ord, length(name) AS len, CASE WHEN regexp_full_match(lower(name), '[a-z0-9]+')
    THEN CASE WHEN regexp_matches(lower(title), '(^|[^a-z0-9])' || lower(name) || '($|[^a-z0-9])')
      THEN length(regexp_extract(lower(title), '^(.*?)(^|[^a-z0-9])' || lower(name) || '($|[^a-z0-9])', 1)) + length(regexp_extract(lower(title), '^(.*?)(^|[^a-z0-9])' || lower(name) || '($|[^a-z0-9])', 2)) + 1 ELSE 0 END
    ELSE strpos(lower(title), lower(name)) END AS pos FROM titles, names
), e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, canonical ORDER BY pos, len DESC, entry_ord, name) AS k FROM h WHERE pos > 0) WHERE k = 1
), m AS (SELECT id, canonical, name, CAST(pos AS INT) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY id, pos ORDER BY len DESC, entry_ord, canonical) AS k2 FROM e) WHERE k2 = 1)"""


@query(f"WITH {MATCH_SQL} SELECT id, canonical, name, pos FROM m")
def dict_match(spark, sf_dir):
    titles, names = _titles(spark, sf_dir)
    return match.match_dictionary(titles, names)


@query(f"WITH {MATCH_SQL}, o AS (SELECT m.id, CAST(n_regionkey AS VARCHAR) AS origin, min(pos) AS p FROM m JOIN nation ON n_name = canonical GROUP BY ALL) SELECT id, string_agg(origin, ',' ORDER BY p) AS origins FROM o GROUP BY id")
def dict_attribute(spark, sf_dir):
    titles, names = _titles(spark, sf_dir)
    heads = match.headliners(match.match_dictionary(titles, names))
    origin = table(spark, sf_dir, "nation").select(F.col("n_name").alias("canonical"), F.col("n_regionkey").cast("string").alias("origin"))
    return match.dictionary_attribute(heads, origin).select("id", F.array_join("values", ",").alias("origins"))


@query("""WITH rules AS (SELECT * FROM (VALUES ('ring', '台北', 1), ('red', '台中', 2), ('widget', '高雄', 3), ('i', '花蓮', 4)) t(m, city, ord))
SELECT p_partkey AS id, arg_min(city, ord) AS city FROM part JOIN rules ON contains(lower(p_name), m) GROUP BY p_partkey""")
def rule_lookup(spark, sf_dir):
    rules = spark.createDataFrame([("ring", "台北", 1), ("red", "台中", 2), ("widget", "高雄", 3), ("i", "花蓮", 4)], "match string, city string, rule_ord int")
    return match.first_rule(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("venue")), rules)


@query("""WITH r AS (SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN '116臺北市某路' WHEN p_size % 4 = 1 THEN '台灣高雄市' END AS address, CASE WHEN p_size % 5 = 0 THEN '' ELSE p_name END AS venue, CASE WHEN p_size % 2 = 0 THEN '台南 ' ELSE '' END || p_name AS title FROM part)
SELECT id, CASE WHEN address LIKE '%臺北%' THEN '台北' WHEN address LIKE '%高雄%' THEN '高雄' WHEN venue = '' AND title LIKE '台南%' THEN '台南'
  WHEN contains(CASE WHEN venue = '' THEN title ELSE venue END, 'ring') THEN '台北' WHEN contains(CASE WHEN venue = '' THEN title ELSE venue END, 'red') THEN '台中' ELSE '未知' END AS city FROM r""")
def city_resolve(spark, sf_dir):
    size = F.col("p_size")
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.when(size % 4 == 0, "116臺北市某路").when(size % 4 == 1, "台灣高雄市").alias("address"),
        F.when(size % 5 == 0, "").otherwise(F.col("p_name")).alias("venue"), F.concat(F.when(size % 2 == 0, "台南 ").otherwise(""), "p_name").alias("title"))
    rules = spark.createDataFrame([("ring", "台北", 1), ("red", "台中", 2)], "match string, city string, rule_ord int")
    return match.resolve_city(rows, rules).select("id", "city")


# -- relations

@query("SELECT o_orderkey AS id FROM orders o WHERE o_orderkey % 3 = 0 AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey IN (o.o_orderkey + 1, o.o_orderkey + 2) AND l.l_quantity > 45)")
def manual_suppress(spark, sf_dir):
    manual = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), F.array(F.col("o_orderkey") + 1, F.col("o_orderkey") + 2).alias("possible_real_ids"))
    return relations.suppress_known(manual, table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("id"))).select("id")


@query(f"""WITH {SESSION_SQL} SELECT s.event_id FROM session s WHERE s.status <> 'ended' AND NOT (s.status = 'announced' AND EXISTS (SELECT 1 FROM session c WHERE c.status = 'ended' AND c.date = s.date AND c.venue = s.venue))""")
def peer_semi(spark, sf_dir):
    return relations.without_peers(sessions(spark, sf_dir), F.col("status") == "ended", F.col("status") == "announced", ["date", "venue"]).select("event_id")


@query("SELECT l_orderkey AS id FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size > 10 GROUP BY l_orderkey HAVING count(*) = count(p_partkey)")
def division(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return relations.divided(li.select(F.col("l_orderkey").alias("id")).distinct(), li.select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("child_id")), table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("id")))


_CHILD = "CASE WHEN l_quantity > 46 THEN 'IN_STOCK' WHEN l_quantity > 42 THEN 'COMING_SOON' WHEN l_quantity > 40 THEN NULL WHEN l_orderkey % 3 = 0 THEN 'REGISTRATION_CLOSED' WHEN l_quantity > 20 THEN 'SOLD_OUT' ELSE 'REGISTRATION_CLOSED' END"


@query(f"""WITH c AS (SELECT l_orderkey AS id, year(l_shipdate) = year(o_orderdate) AS same, {_CHILD} AS s FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
k AS (SELECT *, bool_or(same) OVER (PARTITION BY id) AS any_same FROM c)
SELECT id, CASE WHEN count(*) FILTER (s = 'IN_STOCK') > 0 THEN 'IN_STOCK' WHEN count(*) FILTER (s = 'COMING_SOON') > 0 THEN 'COMING_SOON' WHEN count(*) <> count(s) THEN NULL WHEN min(s) = 'REGISTRATION_CLOSED' AND max(s) = 'REGISTRATION_CLOSED' THEN 'REGISTRATION_CLOSED' ELSE 'SOLD_OUT' END AS signal
FROM k WHERE same OR NOT any_same GROUP BY id""")
def child_rollup(spark, sf_dir):
    q, closed = F.col("l_quantity"), F.lit("REGISTRATION_CLOSED")
    signal = F.when(q > 46, "IN_STOCK").when(q > 42, "COMING_SOON").when(q > 40, None).when(F.col("l_orderkey") % 3 == 0, closed).when(q > 20, "SOLD_OUT").otherwise(closed)
    kids = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.year("l_shipdate").alias("date"), signal.alias("signal"))
    return relations.child_rollup(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("date")), kids)


@query(f"""WITH {SESSION_SQL}, a AS (SELECT time, venue, arg_max(status, event_id) AS availability FROM session WHERE event_id % 3 = 0 GROUP BY time, venue) SELECT s.event_id, a.availability FROM session s LEFT JOIN a ON a.time = s.time AND a.venue = s.venue""")
def availability(spark, sf_dir):
    s = sessions(spark, sf_dir)
    return relations.lookup(s.select("event_id", "time", "venue"), s.where("event_id % 3 = 0").select("time", "venue", "event_id", F.col("status").alias("availability")), ["time", "venue"], "availability", ["event_id"], last=True).select("event_id", "availability")


@query("SELECT o_orderkey AS id, CASE WHEN o_custkey % 2 = 0 THEN 'img' || o_custkey END AS image FROM orders")
def images_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("img"), F.col("o_custkey").cast("string")).alias("image"))
    return relations.with_images(o.select("id"), o.where(F.col("image").rlike("[02468]$")))


@query("""WITH v AS (SELECT * FROM (VALUES ('Brand#1', 'A'), ('Brand#2', 'B')) t(k, v)) SELECT p_partkey, p_brand, coalesce(v, p_type) AS p_type, CASE WHEN v IS NULL THEN p_name END AS run_key FROM part LEFT JOIN v ON k = p_brand""")
def overrides(spark, sf_dir):
    o = spark.createDataFrame([("p_type", "Brand#1", "A"), ("p_type", "Brand#2", "B"), ("p_name", "Brand#3", "no")], "field string, key string, value string")
    parts = table(spark, sf_dir, "part").withColumn("run_key", F.col("p_name"))
    return relations.overridden(parts, o, "p_type", "p_brand", drops=("run_key",)).select("p_partkey", "p_brand", "p_type", "run_key")


# -- preferences and browsing

RULE_SQL = """rules AS (SELECT DISTINCT user_id, CASE event_type WHEN 'click' THEN 'favourite' WHEN 'view' THEN 'event' WHEN 'error' THEN 'artist' ELSE 'type' END AS kind,
  CASE event_type WHEN 'error' THEN 'Brand#' || (CAST(json_extract(props, '$.k') AS INT) % 25) WHEN 'click' THEN json_extract_string(props, '$.k') WHEN 'view' THEN json_extract_string(props, '$.k')
  ELSE ['ECONOMY','STANDARD','PROMO','SMALL','MEDIUM','LARGE'][CAST(json_extract(props, '$.k') AS INT) % 6 + 1] END AS value FROM events)"""


def _rules(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    t = F.col("event_type")
    types = F.array(*map(F.lit, ("ECONOMY", "STANDARD", "PROMO", "SMALL", "MEDIUM", "LARGE")))
    value = F.when(t == "error", F.concat(F.lit("Brand#"), (k.cast("int") % 25).cast("string"))).when(t.isin("click", "view"), k).otherwise(F.element_at(types, k.cast("int") % 6 + 1))
    return table(spark, sf_dir, "events").select("user_id", F.when(t == "click", "favourite").when(t == "view", "event").when(t == "error", "artist").otherwise("type").alias("kind"), value.alias("value"))


def _parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array("p_brand").alias("headliners"), F.array("p_type").alias("types"))


HITS_SQL = f"""{RULE_SQL}, keys AS (SELECT p_partkey AS id, unnest([{{'kind': 'favourite', 'value': CAST(p_partkey AS VARCHAR)}}, {{'kind': 'event', 'value': CAST(p_partkey AS VARCHAR)}}, {{'kind': 'artist', 'value': p_brand}}, {{'kind': 'type', 'value': p_type}}]) AS k FROM part),
hits AS (SELECT user_id, id, arg_min(kind, CASE kind WHEN 'favourite' THEN 1 WHEN 'event' THEN 2 WHEN 'artist' THEN 3 ELSE 4 END) AS kind FROM keys JOIN rules ON rules.kind = k.kind AND rules.value = k.value GROUP BY user_id, id)"""


@query(f"WITH {HITS_SQL} SELECT user_id, id, kind FROM hits")
def user_visibility(spark, sf_dir):
    return prefs.rule_hits(_parts(spark, sf_dir), _rules(spark, sf_dir))


@query(f"""WITH {HITS_SQL}, e AS (SELECT p_partkey AS id, DATE '2024-01-01' + CAST(p_size AS INT) AS date FROM part WHERE p_size >= 10 AND p_size % 5 <> 0), u AS (SELECT DISTINCT user_id FROM rules),
r AS (SELECT u.user_id, e.id, coalesce(h.kind, 'show') AS decision, row_number() OVER (PARTITION BY u.user_id ORDER BY date, e.id) AS position FROM u CROSS JOIN e LEFT JOIN hits h ON h.user_id = u.user_id AND h.id = e.id WHERE coalesce(h.kind, 'favourite') = 'favourite')
SELECT user_id, position, id, decision FROM r WHERE position <= 10""")
def visible_pages(spark, sf_dir):
    days = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.date_add(F.lit("2024-01-01"), F.col("p_size").cast("int")).alias("date"), F.lit(None).cast("string").alias("time"), (F.col("p_size") % 5 != 0).alias("passes"))
    return prefs.visible_pages(_parts(spark, sf_dir).join(days, "id"), _rules(spark, sf_dir), today=F.to_date(F.lit("2024-01-11")), passes=F.col("passes"), size=10)


@query(f"WITH {HITS_SQL} SELECT user_id, count(*) FILTER (kind <> 'favourite') AS hidden, count(*) FILTER (kind = 'favourite') AS favourites, (SELECT count(*) FROM part) - count(*) FILTER (kind <> 'favourite') AS shown FROM hits GROUP BY user_id")
def user_counts(spark, sf_dir):
    return prefs.user_counts(_parts(spark, sf_dir), _rules(spark, sf_dir))


@query(f"""WITH {RULE_SQL}, keys AS (SELECT p_partkey AS id, unnest([{{'kind': 'event', 'value': CAST(p_partkey AS VARCHAR)}}, {{'kind': 'artist', 'value': p_brand}}, {{'kind': 'type', 'value': p_type}}]) AS k FROM part WHERE p_size >= 10)
SELECT r.user_id, r.kind, r.value, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY r.user_id) AS BIGINT) AS total FROM keys JOIN rules r ON r.kind = k.kind AND r.value = k.value
WHERE NOT EXISTS (SELECT 1 FROM rules f WHERE f.user_id = r.user_id AND f.kind = 'favourite' AND f.value = CAST(id AS VARCHAR)) GROUP BY r.user_id, r.kind, r.value""")
def hidden_counts(spark, sf_dir):
    days = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.date_add(F.lit("2024-01-01"), F.col("p_size").cast("int")).alias("date"))
    return prefs.hidden_rule_counts(_parts(spark, sf_dir).join(days, "id"), _rules(spark, sf_dir), today=F.to_date(F.lit("2024-01-11")))


@query("""WITH l AS (SELECT user_id, 'artist' AS kind, json_extract_string(props, '$.k') AS value, CASE event_type WHEN 'click' THEN 'add' WHEN 'error' THEN 'remove' ELSE 'toggle' END AS action, event_id AS seq FROM events),
b AS (SELECT user_id, kind, value, max(seq) AS at_seq, arg_max(action, seq) AS last FROM l WHERE action <> 'toggle' GROUP BY ALL)
SELECT l.user_id, l.kind, l.value FROM l LEFT JOIN b ON b.user_id = l.user_id AND b.value = l.value GROUP BY ALL
HAVING (coalesce(max(last), '') = 'add')::INT % 2 <> count(*) FILTER (action = 'toggle' AND seq > coalesce(at_seq, -1)) % 2""")
def pref_log(spark, sf_dir):
    t = F.col("event_type")
    log = table(spark, sf_dir, "events").select("user_id", F.lit("artist").alias("kind"), F.get_json_object("props", "$.k").alias("value"), F.when(t == "click", "add").when(t == "error", "remove").otherwise("toggle").alias("action"), F.col("event_id").alias("seq"))
    return prefs.fold_log(log)


@query("""WITH l AS (SELECT user_id, sum(event_id) AS a FROM events GROUP BY 1), r AS (SELECT user_id, sum(event_id) + user_id % 2 AS a FROM events WHERE user_id % 3 <> 0 GROUP BY 1)
SELECT user_id, CAST(coalesce(r.a, l.a) AS VARCHAR) AS favs, coalesce(r.a, l.a) IS DISTINCT FROM l.a AS changed FROM l LEFT JOIN r USING (user_id)""")
def reconcile(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum("event_id").alias("a"))
    remote = e.where("user_id % 3 != 0").select("user_id", (F.col("a") + F.col("user_id") % 2).cast("string").alias("favs"))
    return prefs.reconcile(e.select("user_id", F.col("a").cast("string").alias("favs")), remote, ["favs"])


_VIEW = {"city": ["NATION_1", "NATION_2", "NATION_3"], "venue": ["ASIA", "EUROPE"], "priceMax": [30000]}


def _view(spark, sf_dir):
    return listings(spark, sf_dir).select("raw_id", F.col("price").alias("price_min"), F.array("city").alias("cities"), F.array("venue").alias("venues"), F.array(F.date_format("date", "yyyy-MM")).alias("months"), F.array("name").alias("types"), "venue", "city", "price")


_C, _V, _P = "city IN ('NATION_1','NATION_2','NATION_3')", "venue IN ('ASIA','EUROPE')", "price <= 30000"


@query(f"WITH {LISTING_SQL} SELECT raw_id, price FROM listing WHERE {_C} AND {_V} AND {_P}")
def view_filters(spark, sf_dir):
    return browse.view_filters(_view(spark, sf_dir), _VIEW).select("raw_id", "price")


@query(f"""WITH {LISTING_SQL}
SELECT 'city' AS facet, city AS value, count(*) AS n FROM listing WHERE {_V} AND {_P} GROUP BY city UNION ALL SELECT 'venue', venue, count(*) FROM listing WHERE {_C} AND {_P} GROUP BY venue
UNION ALL SELECT 'month', strftime(date, '%Y-%m'), count(*) FROM listing WHERE {_C} AND {_V} AND {_P} GROUP BY 2 UNION ALL SELECT 'type', name, count(*) FROM listing WHERE {_C} AND {_V} AND {_P} GROUP BY name""")
def facets(spark, sf_dir):
    return browse.facet_sort(browse.facet_counts(_view(spark, sf_dir), _VIEW, {"city": "cities", "venue": "venues", "month": "months", "type": "types"}))


@query(f"WITH {LISTING_SQL} SELECT preset FROM (VALUES (500), (1000), (2000), (3000)) t(preset) WHERE preset >= (SELECT min(price) FROM listing)")
def presets(spark, sf_dir):
    return browse.price_presets(_view(spark, sf_dir))


@query("""WITH c AS (SELECT p_size % 10 AS key, p_name AS venue, count(*) AS c FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY c DESC, length(venue), venue) AS k, sum(c) OVER (PARTITION BY key) AS n FROM c)
SELECT key, venue, CAST(n AS BIGINT) AS n FROM r WHERE k = 1""")
def venue_options(spark, sf_dir):
    return browse.venue_options(table(spark, sf_dir, "part"), F.col("p_size") % 10, F.col("p_name"))


@query(f"""WITH {LISTING_SQL}, d AS (SELECT *, CASE WHEN date < DATE '2000-01-01' THEN 'ended' WHEN l_partkey % 50 = 0 THEN CASE WHEN {_P} THEN 'favourite' ELSE 'filtered' END WHEN l_orderkey % 11 = 0 THEN 'hidden:event' WHEN name = 'Brand#3' THEN 'hidden:artist'
  WHEN source = 'RF' THEN 'hidden:type' WHEN NOT ({_P}) THEN 'filtered' ELSE 'show' END AS v FROM listing) SELECT v AS decision, count(*) AS n FROM d GROUP BY v""")
def visibility(spark, sf_dir):
    return _decided(spark, sf_dir).groupBy("decision").agg(F.count("*").alias("n"))


def _decided(spark, sf_dir):
    v = listings(spark, sf_dir).withColumn("date_end", F.lit(None).cast("date"))
    return v.select(browse.visibility(
        F.to_date(F.lit("2000-01-01")), favourite=F.col("l_partkey") % 50 == 0, hidden_event=F.col("l_orderkey") % 11 == 0, hidden_artist=F.col("name") == "Brand#3", hidden_type=F.col("source") == "RF", passes=F.col("price") <= 30000).alias("decision"))


@query(f"""WITH {LISTING_SQL}, d AS (SELECT CASE WHEN date < DATE '2000-01-01' THEN 'e' WHEN l_partkey % 50 = 0 THEN CASE WHEN {_P} THEN 's' ELSE 'f' END WHEN l_orderkey % 11 = 0 OR name = 'Brand#3' OR source = 'RF' THEN 'h' WHEN NOT ({_P}) THEN 'f' ELSE 's' END AS v FROM listing)
SELECT count(*) FILTER (v = 's') AS visible, count(*) FILTER (v = 'e') AS ended, count(*) FILTER (v = 'h') AS hidden FROM d""")
def partition_counts(spark, sf_dir):
    return browse.partition_counts(_decided(spark, sf_dir), F.col("decision"))


@query("SELECT doc_id AS id, lang FROM documents WHERE contains(lower(text), 'that') OR contains(lower(source), 'that')")
def search(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", F.col("text").alias("title"), F.array("source").alias("lineup"), F.col("doc_id").alias("date"))
    return browse.search(d, "That").select("id", "lang")


@query(f"WITH {SESSION_SQL} SELECT date, row_number() OVER (PARTITION BY date ORDER BY CASE WHEN event_id % 9 = 0 THEN '99:99' ELSE time END, event_id) AS position, event_id AS id FROM session", dates=("date",))
def timeline(spark, sf_dir):
    s = sessions(spark, sf_dir).withColumn("time", F.when(F.col("event_id") % 9 != 0, F.col("time"))).withColumn("id", F.col("event_id"))
    return browse.group_by_date(s.select("date", "time", "id")).select("date", "position", "id")


@query(f"WITH {SESSION_SQL} SELECT date, row_number() OVER (PARTITION BY date ORDER BY run_key) AS position, run_key AS id FROM (SELECT DISTINCT date, run_key FROM session WHERE user_id % 4 = 0)", dates=("date",))
def calendar(spark, sf_dir):
    runs = sessions(spark, sf_dir).groupBy(F.col("run_key").alias("id"), "user_id").agg(F.collect_set("date").alias("dates"))
    return browse.collect_calendar(runs, runs.where("user_id % 4 = 0"))


@query("SELECT CASE WHEN age < 1 THEN 'today' ELSE 'week' END AS \"group\", count(*) AS n FROM (SELECT floor(epoch(TIMESTAMP '2024-01-15 12:00:00' - ts) / 86400) AS age FROM events) WHERE age BETWEEN 0 AND 7 GROUP BY 1")
def arrivals(spark, sf_dir):
    return browse.new_arrivals(table(spark, sf_dir, "events").withColumn("first_seen_at", F.date_trunc("microsecond", "ts")), F.to_timestamp(F.lit("2024-01-15 12:00:00")))


@query(f"""WITH {SESSION_SQL} SELECT event_id, b AS minutes_before, strftime(CAST(on_sale_at AS TIMESTAMP) + INTERVAL 15 MINUTE, '%Y-%m-%d %H:%M') AS block_end, strftime(CAST(on_sale_at AS TIMESTAMP) - to_minutes(b), '%Y-%m-%d %H:%M') AS alarm_at
FROM session, (VALUES (15), (0)) t(b) WHERE status = 'announced' AND on_sale_at IS NOT NULL""")
def due_reminders(spark, sf_dir):
    out = browse.due_reminders(sessions(spark, sf_dir).withColumn("on_sale_at", F.to_timestamp("on_sale_at")))
    return out.select("event_id", "minutes_before", F.date_format("block_end", "yyyy-MM-dd HH:mm").alias("block_end"), F.date_format("alarm_at", "yyyy-MM-dd HH:mm").alias("alarm_at"))


# -- reports

def _events(spark, sf_dir):
    return listings(spark, sf_dir).select(
        F.col("raw_id").alias("id"), F.when(F.col("priority") == 1, "未知").otherwise(F.col("city")).alias("city"), F.when(F.col("l_partkey") % 13 == 0, " ").otherwise(F.col("venue")).alias("venue"), "date", "time",
        F.when(F.col("price") > 5000, F.col("price")).alias("price_min"), F.when(F.col("special"), "on_sale").otherwise("ended").alias("status"),
        F.when(F.col("l_suppkey") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("name")).alias("headliners"), F.when(F.col("l_linenumber") == 1, "x").alias("category"), "source", "price", "name")


@query(f"""WITH {LISTING_SQL} SELECT rule, n FROM (SELECT count(*) FILTER (priority = 1) AS unknown_city, count(*) FILTER (l_partkey % 13 = 0) AS empty_venue, count(*) FILTER (special AND NOT price > 5000) AS missing_price,
  count(*) FILTER (l_suppkey % 3 = 0 AND l_linenumber <> 1) AS no_headliner FROM listing) UNPIVOT (n FOR rule IN (unknown_city, empty_venue, missing_price, no_headliner))""")
def quality_summary(spark, sf_dir):
    return quality.quality_report(_events(spark, sf_dir))


@query(f"""WITH {LISTING_SQL} SELECT raw_id AS id, 'unknown_city' AS rule FROM listing WHERE priority = 1 UNION ALL SELECT raw_id, 'empty_venue' FROM listing WHERE l_partkey % 13 = 0
UNION ALL SELECT raw_id, 'missing_price' FROM listing WHERE special AND NOT price > 5000 UNION ALL SELECT raw_id, 'no_headliner' FROM listing WHERE l_suppkey % 3 = 0 AND l_linenumber <> 1""")
def quality_detail(spark, sf_dir):
    return quality.quality_rows(_events(spark, sf_dir))


@query(f"""WITH {LISTING_SQL} SELECT date, time, lower(trim(CASE WHEN l_partkey % 13 = 0 THEN ' ' ELSE venue END)) AS venue_key, string_agg(raw_id, ',' ORDER BY raw_id) AS ids FROM listing GROUP BY 1, 2, 3 HAVING count(*) > 1""", dates=("date",))
def dup_candidates(spark, sf_dir):
    return quality.dup_candidates(_events(spark, sf_dir)).withColumn("ids", F.array_join("ids", ","))


@query("SELECT count(*) AS n, count(*) FILTER (f) AS found, round(count(*) FILTER (f) / count(*), 4) AS share FROM (SELECT EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, b.text)) AS f FROM benchmark b)")
def coverage(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    found = quality.passages_found(items, table(spark, sf_dir, "documents"))
    return quality.coverage(items, found.where("found"), "item_id")


@query(f"WITH {LISTING_SQL}, c AS (SELECT source, name, count(*) AS n FROM listing GROUP BY ALL) SELECT source, string_agg(name || '=' || n, ',' ORDER BY name) AS stats FROM c GROUP BY source")
def run_stats(spark, sf_dir):
    out = quality.run_stats(_events(spark, sf_dir).withColumn("outcome", F.col("name")))
    return out.select("source", F.array_join(F.transform(F.map_entries("stats"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("stats"))


@query("SELECT '1-URGENT、2-HIGH' AS names")
def source_warning(spark, sf_dir):
    return browse.source_warning(_health(spark, sf_dir).withColumn("ord", F.substring("source", 1, 1)))
