"""Reading and writing of snapshots, rules and sources."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

RULE_KINDS = ("noise", "classical", "greet", "url", "account")


def read_snapshot(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON snapshot; a missing path is an empty one, a row that can't be parsed stops the job."""
    try:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_rules(rules: DataFrame, kinds=RULE_KINDS) -> DataFrame:
    """rules (kind, pattern, ord), checked: every kind has rows, none is blank."""
    have = {r[0]: r[1] for r in rules.groupBy("kind").agg(F.count_if(F.trim("pattern") != "")).collect()}
    if missing := [k for k in kinds if not have.get(k)]:
        raise ValueError(f"no rules of kind {', '.join(missing)}")
    return rules


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """All sources' listings; columns that a source lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


EXTRACTORS: dict[str, tuple[int, Callable[[DataFrame], DataFrame]]] = {}


def register_extractor(name: str, priority: int, extract: Callable[[DataFrame], DataFrame]) -> None:
    """Add a source: a lazy function from its raw pages to listings."""
    EXTRACTORS[name] = (priority, extract)


def extract_all(raw_pages: DataFrame, extractors: dict | None = None) -> tuple[DataFrame, dict[str, str]]:
    """Listings of all registered (or the given) sources, each with its priority, and the errors of those whose plan can't be built."""
    frames, errors = [], {}
    for name, (priority, extract) in (EXTRACTORS if extractors is None else extractors).items():
        try:
            frames.append(extract(raw_pages.where(F.col("source") == name)).withColumn("priority", F.lit(priority)))
        except Exception as e:  # a broken source must not stop the others
            errors[name] = str(e).splitlines()[0]
    if not frames:
        raise ValueError(f"no source can be read: {errors}")
    return union_sources(frames), errors


def write_snapshot(df: DataFrame, path: str, run_date: str) -> None:
    """Overwrite one run's partition only."""
    (df.withColumn("run_date", F.lit(run_date)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date").parquet(path))


def write_outputs(outputs: dict[str, DataFrame], path: str, run_date: str) -> None:
    """One run's outputs (events, digest, review, sources, ...), each a snapshot table of its own below path.

    events is written last: readers that look for a run there find its other outputs complete.
    """
    for name in sorted(outputs, key=lambda n: n == "events"):
        write_snapshot(outputs[name], f"{path}/{name}", run_date)


def latest_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The newest run; the filter prunes the other partitions."""
    df = spark.read.parquet(path)
    newest = df.agg(F.max("run_date")).first()[0]
    return df.where(F.col("run_date") == F.lit(newest))
