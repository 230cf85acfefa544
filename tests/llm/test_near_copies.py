"""A group of near copies costs links in proportion to its size."""

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from marquee.llm import mixing, simhash, toxicity
from marquee.llm.common import local_rows


def test_near_copies_meet_as_groups(spark, monkeypatch):
    # two bits of 16 set: 36 homes, and each meets all that share a bit with it
    values = [1 << a | 1 << b for a, b in combinations(range(16), 2)]
    nodes = spark.createDataFrame(list(enumerate(values)), "node long, f0 long")
    made, pairs = [], simhash.near_pairs
    monkeypatch.setattr(simhash, "near_pairs", lambda *a, **k: made.append(pairs(*a, **k)) or made[-1])
    found = simhash.link_components(nodes, threshold=4, plan=[(0, 16)], reach=2)
    assert found.select(F.countDistinct("component"), F.count("*")).first() == (1, 120)
    n = made[0].count()
    assert n <= 120, n


def test_few_rows_reach_stars_where_no_anchor_is_crowded(spark, monkeypatch):
    rng = np.random.default_rng(5)
    values = rng.integers(-1 << 63, 1 << 63, (3000, 2), np.int64)
    values[1] = values[0] ^ np.array([5, 3])  # one near copy
    nodes = spark.createDataFrame([(k, *map(int, v)) for k, v in enumerate(values)], "node long, f0 long, f1 long")
    rows, stars = [], simhash.star_links
    monkeypatch.setattr(simhash, "star_links", lambda r, *a: rows.append(r.count()) or stars(r, *a))
    plan = [(0, 16), (16, 16), (32, 16)]
    found = simhash.link_components(nodes, threshold=20, plan=plan, reach=2, compared=2)
    assert found.where("component != node").collect() == [(1, 0)]
    # one home a node and block; all anchors in reach are some nine times as many
    assert sum(rows) < 2 * 3000 * len(plan), rows


def test_fingerprints_and_features_take_bounded_slices(spark):
    batches = [pa.RecordBatch.from_pydict({"text": ["a"] * 1201})]
    assert [b.num_rows for b in toxicity.sliced(batches)] == [500, 500, 201]
    docs = spark.createDataFrame([(k, f"w{k} of many words here {k}") for k in range(2100)], "doc_id long, text string").coalesce(1)
    got = simhash.fingerprints(docs, distinct=True, seeds=2)
    assert got.select(F.countDistinct("doc_id"), F.count("*")).first() == (2100, 2100)


def test_few_local_rows_need_no_python_workers(spark):
    made = local_rows(spark, [(0, 5), (1, 7)], _part=pa.int32(), _shift=pa.int64())
    assert made.dtypes == [("_part", "int"), ("_shift", "bigint")] and made.collect() == [(0, 5), (1, 7)]
    assert local_rows(spark, [], _part=pa.int32()).collect() == []
    sizes = spark.createDataFrame([("a", 3), ("b", 4), (None, 5)], "source string, size long")
    plan = mixing.ordinals(sizes, "source")._jdf.queryExecution().toString()
    assert "Scan ExistingRDD" not in plan and "LocalTableScan" in plan, plan
