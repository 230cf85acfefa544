"""Reports on the event table and on what feeds it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions.text import let
from marquee.shared import checkpointed

UNKNOWN = "未知"


def quality_flags() -> dict[str, Column]:
    return {
        "unknown_city": F.col("city") == UNKNOWN, "empty_venue": F.trim(F.coalesce("venue", F.lit(""))) == "",
        "missing_price": F.col("price_min").isNull() & F.col("status").isin("on_sale", "announced"),
        "no_headliner": (F.coalesce(F.size("headliners"), F.lit(0)) <= 0) & F.col("category").isNull(),
    }


def quality_report(df: DataFrame) -> DataFrame:
    """(rule, n) of every rule, in one pass."""
    flags = quality_flags()
    one = df.agg(*[F.count_if(c).alias(k) for k, c in flags.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("n")) for k in flags])).alias("r")).select("r.*")


def quality_rows(df: DataFrame) -> DataFrame:
    """(id, rule) of every row that a rule finds."""
    hits = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in quality_flags().items()]), lambda x: x.isNotNull())
    return df.select("id", F.explode(hits).alias("rule"))


def dup_candidates(df: DataFrame) -> DataFrame:
    """(date, time, venue_key, ids): different events at one time and place."""
    return (df.groupBy("date", "time", F.lower(F.trim("venue")).alias("venue_key")).agg(F.sort_array(F.collect_list("id")).alias("ids"))
            .where(F.size("ids") > 1))


def coverage(wanted: DataFrame, captured: DataFrame, key: str) -> DataFrame:
    """(n, found, share): how much of a wanted list is captured."""
    hit = captured.select(key).distinct().withColumn("_hit", F.lit(1))
    return wanted.join(hit, key, "left").agg(F.count("*").alias("n"), F.count("_hit").alias("found"), F.round(F.count("_hit") / F.count("*"), 4).alias("share"))


def passages_found(passages: DataFrame, texts: DataFrame, *, id_col="item_id", text_col="text", words: int = 8) -> DataFrame:
    """(id_col, found): whether a passage stands, as it is, anywhere in a text.

    A passage's first and last words may be parts of longer ones in a text, those between
    are whole. So a passage of three words or more has runs of `words` of these, or of all,
    where they are fewer; how many texts hold each is counted, and the rarest is its
    anchor. A shorter passage's longest word is looked for in the texts' vocabulary. Texts
    travel by a digest; whole ones are fetched for candidates alone, and looked through.
    Blank and null passages aren't found, repeated ones are rows of their own.
    """
    split = lambda c: F.regexp_extract_all(c, F.lit(r"(\S+)"), F.lit(1))
    p = passages.select(F.md5(text_col).alias("_id"), F.col(text_col).alias("_p")).distinct().withColumn("_w", split(F.col("_p"))).where(F.size("_w") > 0)
    t = texts.select(F.md5(text_col).alias("_d"), F.col(text_col).alias("_t")).where("_t is not null")
    inner = p.where(F.size("_w") > 2).select("_id", "_p", F.slice("_w", F.lit(2), F.size("_w") - 2).alias("_w")).withColumn("_n", F.least(F.size("_w"), F.lit(words)))
    runs = lambda w, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.xxhash64(F.slice(w, i, n))))
    wanted = checkpointed(inner.select("_id", "_n", F.explode(runs("_w", F.col("_n"))).alias("_h")))
    lengths = sorted(r[0] for r in wanted.select("_n").distinct().collect())  # `words` numbers at most
    sized = lambda n: let(runs("_w", F.lit(n)), lambda hs: F.transform(hs, lambda h: F.struct(F.lit(n).alias("_n"), h.alias("_h"))))
    here = F.flatten(F.array(*[F.when(F.size("_w") >= n, sized(n)).otherwise(F.array()) for n in lengths])) if lengths else F.array()
    candidates = []
    if lengths:
        held = t.withColumn("_w", split(F.col("_t"))).select("_d", F.explode(here).alias("_r")).select("_d", "_r.*").join(wanted.select("_n", "_h").distinct(), ["_n", "_h"], "left_semi")
        held = checkpointed(held.distinct())
        counted = wanted.join(held.groupBy("_n", "_h").agg(F.count("*").alias("_df")), ["_n", "_h"], "left")
        rarest = counted.groupBy("_id", "_n").agg(F.min_by("_h", F.struct(F.coalesce("_df", F.lit(0)), "_h")).alias("_h"))
        candidates.append(rarest.join(held, ["_n", "_h"]).select("_id", "_d"))
    short = p.where(F.size("_w") <= 2).select("_id", F.when(F.char_length(F.get("_w", F.lit(0))) >= F.coalesce(F.char_length(F.get("_w", F.lit(1))), F.lit(0)), F.get("_w", F.lit(0))).otherwise(F.get("_w", F.lit(1))).alias("_piece"))
    if not short.isEmpty():
        short = short.withColumn("_g", F.substring("_piece", 1, 3))
        said = t.select("_d", F.explode(F.array_distinct(split(F.col("_t")))).alias("_word"))
        grams = F.flatten(F.transform(F.sequence(F.lit(1), F.char_length("_word")), lambda i: F.transform(F.array(*map(F.lit, (1, 2, 3))), lambda n: F.substring(F.col("_word"), i, n))))
        known = said.select("_word").distinct().select("_word", F.explode(F.array_distinct(grams)).alias("_g"))
        candidates.append(short.join(known, "_g").where(F.col("_word").contains(F.col("_piece"))).select("_id", "_word").distinct().join(said, "_word").select("_id", "_d"))
    none = p.select(F.col("_p").alias("_said")).limit(0)
    hit = reduce(lambda a, b: a.unionAll(b), [
        c.distinct().join(p.select("_id", "_p"), "_id").join(t.dropDuplicates(["_d"]), "_d").where(F.col("_t").contains(F.col("_p"))).select(F.col("_p").alias("_said")) for c in candidates], none)
    hit = hit.distinct().withColumn("_hit", F.lit(True))
    out = passages.join(hit, passages[text_col] == F.col("_said"), "left")
    return out.select(id_col, F.coalesce("_hit", F.lit(False)).alias("found"))


def run_stats(df: DataFrame) -> DataFrame:
    """(source, stats): a map of outcome to count."""
    each = df.groupBy("source", "outcome").agg(F.count("*").alias("n"))
    return each.groupBy("source").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("outcome", "n")))).alias("stats"))


def duplicate_ids(df: DataFrame) -> DataFrame:
    """Ids that more than one row has: lineage can send two new rows to one old id."""
    return df.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
