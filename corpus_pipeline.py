"""Corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from functools import reduce

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm import mixing, packing, repeats, simhash, toxicity
from marquee.llm.common import settle, settle_alone, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain finds toxic go.

    Each row is judged by its text alone: repeated rows and ids go or stay together with
    their text, null ids stay or go like others. Null and empty texts are judged by the
    models' constants, as any text without letters. Sources and languages may be null. No
    documents give none.
    """
    return toxicity.keep_clean(docs, toxicity.production_chain(spark, sf_dir), "toxic")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8 or more.

    The smallest id of a group stays, with all rows that repeat it and its text; rows of one
    id with different texts go or stay each for itself, and rows without an id stay. Null,
    empty and wordless texts have the same empty set, so they are one group. No documents
    give none.
    """
    return simhash.one_of_each(docs, settle_alone(spark, "groups", lambda: simhash.near_duplicates(docs)))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes in strings of 200 that also start elsewhere are cut out of the texts.

    All rows stay, those whose text is cut whole with an empty one; null texts stay null.
    Repeated rows of 200 bytes or more lose them in each. Ids may be null or repeat. No
    documents give none.
    """
    return repeats.without_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each pass of a document in the mix, in training order.

    Documents without words, so null and empty texts, have no pass. A null source is one of
    its own. Ties and repeated rows stand by a hash of the whole row; ids may be null or
    repeat. No documents give none.
    """
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 ids.

    Null and empty texts are their end id. Repeated rows are packed once each; null ids
    like others. No documents give no pieces. The encoded texts are deleted once the
    pieces are written.
    """
    def pieces():
        packed = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
        return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

    return settle_alone(spark, "pieces", pieces)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("suffix_array", cut_repeats),
    ("mixing", mix),
    ("packing", pack),
]

#: Trained models, byte-pair ids and hash order aren't SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce(lambda docs, stage: settle(stage[1](spark, docs, sf_dir), stage[0]), STAGES, table(spark, sf_dir, "documents"))
