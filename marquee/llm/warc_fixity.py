"""Merkle fixity audit of WARC files.

A file's records, in order, are the leaves of a tree; a leaf hashes the record's offset,
length and digest, and a node hashes its children's hashes in order and the offset range
they span. Two replicas are compared by their roots, and only below nodes that differ is
the next level read, down to the records at fault. Trees are built level by level with
grouped hashes over at most `fanout` children, so no file is ever in one task as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.common import settle, table

FANOUT = 16
RECORDS_A_FILE = 256  # production parameter: pages of neighbouring ids share a file


def warc_record(url, html, page_id):
    """The bytes of a response record, as text."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def manifest(pages: DataFrame, *, records_a_file: int = RECORDS_A_FILE) -> DataFrame:
    """(page_id, warc_file, seq, offset, length, digest): where each page's record lies in its file.

    Files hold pages of neighbouring ids in id order; pages without an id are dealt over
    files of negative number by a hash of their content. Null url or html are empty.
    Repeated rows are records of their own. Other columns are left out.
    """
    record = warc_record(F.col("url"), F.col("html"), F.col("page_id"))
    spread = -F.pmod(F.xxhash64("url", "html"), F.lit(1 << 20)) - 1
    rows = pages.select(
        "page_id", F.coalesce(F.floor(F.col("page_id") / records_a_file).cast("long"), spread).alias("warc_file"),
        F.octet_length(record).cast("long").alias("length"), F.sha2(record, 256).alias("digest"))
    order = Window.partitionBy("warc_file").orderBy("page_id", "digest")
    return rows.select(
        "page_id", "warc_file", (F.row_number().over(order) - 1).cast("long").alias("seq"),
        F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"), "length", "digest")


def leaves(records: DataFrame) -> DataFrame:
    """Level 0 of the trees: (warc_file, level, idx, hash, first, last)."""
    return records.select(
        "warc_file", F.lit(0).alias("level"), F.col("seq").alias("idx"),
        F.sha2(F.concat_ws(":", F.col("offset").cast("string"), F.col("length").cast("string"), F.coalesce("digest", F.lit(""))), 256).alias("hash"),
        F.col("offset").alias("first"), (F.col("offset") + F.col("length")).alias("last"))


def merkle_levels(records: DataFrame, *, fanout: int = FANOUT) -> list[DataFrame]:
    """The levels of every file's tree, leaves first; the last holds one root a file."""
    level = settle(leaves(records), "leaves")
    widest = (level.agg(F.max("idx")).first()[0] or 0) + 1
    out = [level]
    while widest > 1:
        child = F.sort_array(F.collect_list(F.struct("idx", "hash")))
        level = settle(
            out[-1].groupBy("warc_file", F.floor(F.col("idx") / fanout).alias("idx"))
            .agg(child.alias("c"), F.min("first").alias("first"), F.max("last").alias("last"))
            .select("warc_file", F.lit(len(out)).alias("level"), "idx",
                    F.sha2(F.concat_ws(":", F.col("first").cast("string"), F.col("last").cast("string"), F.array_join("c.hash", "")), 256).alias("hash"), "first", "last"),
            f"level{len(out)}")
        out.append(level)
        widest = -(-widest // fanout)
    return out


def locate(ours: list[DataFrame], theirs: list[DataFrame], *, fanout: int = FANOUT) -> DataFrame:
    """(warc_file, seq, first, last) of records whose leaves differ, by descent from differing roots.

    Files of one replica alone differ at every record. Replicas of different height are
    compared from the lower of the two roots' levels.
    """
    top = min(len(ours), len(theirs)) - 1
    differ = None
    for level in range(top, -1, -1):
        a, b = ours[level], theirs[level].select("warc_file", "idx", F.col("hash").alias("other"), F.col("first").alias("first2"), F.col("last").alias("last2"))
        if differ is not None:  # only children of nodes that differ
            under = differ.select("warc_file", F.explode(F.sequence(F.col("idx") * fanout, F.col("idx") * fanout + (fanout - 1))).alias("idx"))
            a, b = a.join(under, ["warc_file", "idx"], "left_semi"), b.join(under, ["warc_file", "idx"], "left_semi")
        differ = settle(
            a.join(b, ["warc_file", "idx"], "full").where(~F.col("hash").eqNullSafe(F.col("other")))
            .select("warc_file", "idx", F.coalesce("first", "first2").alias("first"), F.coalesce("last", "last2").alias("last")), "differ")
    return differ.withColumnRenamed("idx", "seq")


def audit(records: DataFrame, replica: DataFrame, *, fanout: int = FANOUT) -> DataFrame:
    """records with `status`: ok, changed or missing in the replica; replica's digest is null where a record is lost.

    Both have (warc_file, seq, offset, length, digest). An empty table gives an empty one.
    """
    bad = locate(merkle_levels(records, fanout=fanout), merkle_levels(replica, fanout=fanout), fanout=fanout)
    found = bad.join(replica.select("warc_file", "seq", F.col("digest").alias("_digest")), ["warc_file", "seq"], "left").select(
        "warc_file", "seq", F.when(F.col("_digest").isNull(), "missing").otherwise("changed").alias("status"))
    return records.join(found, ["warc_file", "seq"], "left").withColumn("status", F.coalesce("status", F.lit("ok")))


def damaged(pages: DataFrame, records: DataFrame) -> DataFrame:
    """A replica of records in which pages with two hash values have one character changed, and with a third are lost."""
    mark = F.substring(F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit(""))), 1, 2)
    html = F.coalesce("html", F.lit(""))
    rotten = pages.where(mark.isin("00", "01")).select(
        "page_id", F.sha2(warc_record(F.col("url"), F.concat(F.lit("~"), F.substring(html, 2, 1 << 30)), F.col("page_id")), 256).alias("bad")).dropDuplicates(["page_id"])
    return records.join(rotten, "page_id", "left").select(
        *[c for c in records.columns if c != "digest"],
        F.when(mark == "02", F.lit(None).cast("string")).otherwise(F.coalesce("bad", "digest")).alias("digest"))


def op6_warc_fixity(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    records = settle(manifest(pages), "manifest")
    return audit(records, damaged(pages, records)).select("page_id", "warc_file", "seq", "offset", "length", "digest", "status")


OP6_SQL = """
WITH r AS (
  SELECT page_id, page_id // 256 AS warc_file, substr(md5(page_id::VARCHAR), 1, 2) AS mark,
         'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
         || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'Content-Length: '
         || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM pages
), m AS (SELECT page_id, warc_file, mark, strlen(record) AS length, sha256(record) AS digest FROM r)
SELECT page_id, warc_file, row_number() OVER w - 1 AS seq,
       coalesce(sum(length) OVER (PARTITION BY warc_file ORDER BY page_id, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset",
       length, digest, CASE WHEN mark IN ('00', '01') THEN 'changed' WHEN mark = '02' THEN 'missing' ELSE 'ok' END AS status
FROM m WINDOW w AS (PARTITION BY warc_file ORDER BY page_id, digest)
"""
