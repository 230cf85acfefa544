"""Registration of queries with their SQL twins, and the views that several of them read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None, *, dates: tuple[str, ...] = ()):
    """Register a function (spark, sf_dir) under its name, with the SQL that gives the same rows.

    Columns in `dates` are compared as text.
    """

    def add(f):
        def run(spark, sf_dir):
            return f(spark, sf_dir).withColumns({c: F.col(c).cast("string") for c in dates})

        QUERIES[f.__name__] = run if dates else f
        if sql:
            texts = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in dates)
            SQL[f.__name__] = f"SELECT * REPLACE ({texts}) FROM ({sql})" if dates else sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SOURCES = ("AF", "AO", "NF", "NO", "RF", "RO")

#: Listings of six sources out of the order lines: an act (brand) at a place (region) on a day.
LISTING_SQL = """listing AS (
  SELECT l_returnflag || l_linestatus AS source, list_position(['AF','AO','NF','NO','RF','RO'], l_returnflag || l_linestatus) AS priority,
         l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS raw_id, p_brand AS name, p_name AS title, r_name AS venue, n_name AS city,
         CAST(l_shipdate AS DATE) AS date, CASE WHEN l_tax <> 0 THEN (10 + CAST(l_quantity AS INT) % 12) || ':' || CASE WHEN l_partkey % 2 = 1 THEN '30' ELSE '00' END END AS time,
         l_extendedprice AS price, l_discount >= 0.09 AS special, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def keyed() -> dict[str, Column]:
    """What follows from a line's own keys, source and price: the id that its source has for it, its source's place, and its place in order."""
    keys = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return {"priority": F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source")).cast("int"), "raw_id": F.concat_ws("-", *[F.col(c).cast("string") for c in keys]), "ord": F.struct(*keys, "price")}


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    hour = (F.lit(10) + F.col("l_quantity").cast("int") % 12).cast("string")
    # what a line alone tells is worked out before lines are shuffled for their parts
    lines = t("lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("source"), F.to_date("l_shipdate").alias("date"), F.when(F.col("l_tax") != 0, F.concat(hour, F.lit(":"), F.when(F.col("l_partkey") % 2 == 1, "30").otherwise("00"))).alias("time"),
        F.col("l_extendedprice").alias("price"), (F.col("l_discount") >= 0.09).alias("special"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    rows = lines.join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.withColumns(keyed()).select(
        "source", "priority", "raw_id", F.col("p_brand").alias("name"), F.col("p_name").alias("title"), F.col("r_name").alias("venue"), F.col("n_name").alias("city"),
        "date", "time", "price", "special", "ord",
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


#: Sessions of runs out of the events: a run is a user's events of one type.
SESSION_SQL = """session AS (
  SELECT user_id || ':' || event_type AS run_key, event_id AS ord, CAST(ts AS DATE) AS date, strftime(ts, '%H:%M') AS time, event_type AS title,
         'hall ' || (event_id % 7) AS venue, CASE WHEN event_id % 5 = 0 THEN '台北' WHEN event_id % 5 = 1 THEN '台中' ELSE '高雄' END AS city,
         CASE WHEN value < 5 THEN 'sold_out' WHEN value < 12 THEN 'announced' WHEN value < 30 THEN 'on_sale' ELSE 'ended' END AS status,
         CASE WHEN value < 12 THEN strftime(ts - INTERVAL 3 DAY, '%Y-%m-%dT%H:%M') END AS on_sale_at, value AS price_min, value * 2 AS price_max, user_id, event_type, value, event_id
  FROM events)"""
TODAY = "2024-01-15"


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").select(
        F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("run_key"), F.col("event_id").alias("ord"), F.to_date("ts").alias("date"),
        F.date_format("ts", "HH:mm").alias("time"), F.col("event_type").alias("title"), F.concat(F.lit("hall "), (F.col("event_id") % 7).cast("string")).alias("venue"),
        F.when(F.col("event_id") % 5 == 0, "台北").when(F.col("event_id") % 5 == 1, "台中").otherwise("高雄").alias("city"),
        F.when(v < 5, "sold_out").when(v < 12, "announced").when(v < 30, "on_sale").otherwise("ended").alias("status"),
        F.when(v < 12, F.date_format(F.col("ts") - F.expr("interval 3 days"), "yyyy-MM-dd'T'HH:mm")).alias("on_sale_at"),
        v.alias("price_min"), (v * 2).alias("price_max"), "user_id", "event_type", "value", "event_id")
