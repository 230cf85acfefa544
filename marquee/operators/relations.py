"""Joins with a meaning of their own: suppression, peers, division, roll-ups, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def suppress_known(manual: DataFrame, events: DataFrame, *, id_col="id", candidates="possible_real_ids") -> DataFrame:
    """manual rows none of whose candidate ids exists."""
    known = manual.select(id_col, F.explode(candidates).alias("_c")).join(events.select(F.col(id_col).alias("_c")), "_c", "left_semi").select(id_col).distinct()
    return manual.join(known, id_col, "left_anti")


def without_peers(rows: DataFrame, confirmed: Column, unknown: Column, keys: list[str]) -> DataFrame:
    """rows without the confirmed ones, and without unknown ones that share the keys with a confirmed one."""
    marked = rows.withColumn("_c", F.coalesce(confirmed, F.lit(False))).withColumn("_u", F.coalesce(unknown, F.lit(False)))
    gone = marked.where("_c").select(*keys).distinct().withColumn("_hit", F.lit(True))
    return marked.where("not _c").join(gone, keys, "left").where("not (_u and coalesce(_hit, false))").select(*rows.columns)


def divided(parents: DataFrame, children: DataFrame, found: DataFrame, *, id_col="id", child="child_id") -> DataFrame:
    """Ids of parents that have children, all of which are found."""
    each = children.join(found.select(F.col(id_col).alias(child)).distinct().withColumn("_f", F.lit(True)), child, "left")
    full = each.groupBy(id_col).agg(F.bool_and(F.coalesce("_f", F.lit(False))).alias("_all")).where("_all").select(id_col)
    return parents.join(full, id_col, "left_semi").select(id_col)


def child_rollup(parents: DataFrame, children: DataFrame, *, id_col="id") -> DataFrame:
    """(id_col, signal): children of the parent's day before others; in stock before coming soon before ended.

    children: id_col, date, signal. Ended is REGISTRATION_CLOSED if all are, else SOLD_OUT;
    one child whose signal is unknown leaves it null. Same-day and all signals are
    counted side by side in one grouped pass.
    """
    j = children.join(parents.select(id_col, F.col("date").alias("_d")), id_col)
    same = F.coalesce(F.col("date") == F.col("_d"), F.lit(False))
    said = F.coalesce("signal", F.lit(""))
    seen = lambda s, c: F.bool_or(c & (said == s))
    every = lambda s, c: F.bool_and(~c | said.isin(s))
    pick = lambda c: (
        F.when(seen("IN_STOCK", c), "IN_STOCK").when(seen("COMING_SOON", c), "COMING_SOON").when(every(["REGISTRATION_CLOSED"], c), "REGISTRATION_CLOSED").when(every(["SOLD_OUT", "REGISTRATION_CLOSED"], c), "SOLD_OUT"))
    return j.groupBy(id_col).agg(F.when(F.bool_or(same), pick(same)).otherwise(pick(F.lit(True))).alias("signal"))


def lookup(left: DataFrame, right: DataFrame, keys: list[str], value: str, order: list[str], *, last: bool = False) -> DataFrame:
    """left with `value` of the first (or last) right row of its keys, null where there is none."""
    pick = F.max_by if last else F.min_by
    one = right.groupBy(*keys).agg(pick(value, F.struct(*order)).alias(value))
    return left.join(one, keys, "left")


def all_rows_terminal(rows: DataFrame, keys: list[str], text: str, pattern: str) -> DataFrame:
    """(keys, terminal): whether every row's text says that the sale is over."""
    return rows.groupBy(*keys).agg(F.bool_and(F.coalesce(F.col(text), F.lit("")).rlike(pattern)).alias("terminal"))


def with_images(events: DataFrame, images: DataFrame) -> DataFrame:
    return events.join(images.select("id", "image"), "id", "left")


def backfill(events: DataFrame, images: DataFrame, found: DataFrame) -> DataFrame:
    """(id, image): known images of events that exist, and for the rest the first found by source order; null is tried again.

    found: name, raw_id, image, of the source references that were looked up.
    """
    have = images.where("image is not null").join(events.select("id"), "id", "left_semi")
    todo = events.join(have.select("id"), "id", "left_anti").select("id", F.posexplode("sources").alias("pos", "s")).select("id", "pos", "s.name", "s.raw_id")
    new = todo.join(found, ["name", "raw_id"], "left").groupBy("id").agg(F.min_by("image", F.when(F.col("image").isNotNull(), F.col("pos"))).alias("image"))
    return have.select("id", "image").unionByName(new)


def overriding(rows: DataFrame, overrides: DataFrame, fields: tuple[str, ...], key: str) -> DataFrame:
    """rows with `_new_<field>` for each field, the value that overrides (field, key, value) give it; null where there is none. One join for all fields; of several values for one key the largest counts."""
    one = overrides.where(F.col("field").isin(*fields)).groupBy(F.col("key").alias(key)).agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f"_new_{f}") for f in fields])
    return rows.join(one, key, "left")


def overridden(rows: DataFrame, overrides: DataFrame, field: str, key: str, drops: tuple[str, ...] = ()) -> DataFrame:
    """rows with the field's value from an override table (field, key, value), where there is one; the columns in drops are null there. Of several for one key the largest counts."""
    one = overrides.where(F.col("field") == field).groupBy(F.col("key").alias(key)).agg(F.max("value").alias("_v"))
    return rows.join(one, key, "left").withColumn(field, F.coalesce(F.col("_v").cast(rows.schema[field].dataType), F.col(field))).withColumns(
        {c: F.when(F.col("_v").isNull(), F.col(c)) for c in drops}).drop("_v")
