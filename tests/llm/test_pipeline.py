"""The pipeline's stages on a small corpus, each against what it is to do."""

from collections import Counter

import corpus_pipeline
from marquee.llm import common, queries

from tests.llm.test_operators import brute_repeats, check_packing


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = common.table(spark, sf, "documents")
    frames = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = frames[name] = common.settle(stage(spark, docs, sf), name)
        if name != "packing":
            assert docs.columns == frames["documents"].columns
    start, clean, one, cut, mixed = (frames[n].collect() for n in ("documents", "toxicity", "simhash", "suffix_array", "mixing"))
    assert {r.doc_id for r in clean} <= {r.doc_id for r in start} and 0.7 * len(start) < len(clean)
    assert len({r.text for r in one}) == len(one) and {r.doc_id for r in one} <= {r.doc_id for r in clean}
    whole = {r.doc_id: r.text.encode() for r in one}
    removed = brute_repeats(whole)
    assert {r.doc_id for r in cut} == set(whole)
    for r in cut:
        assert abs(len(r.text.encode()) - (removed[r.doc_id][0] - removed[r.doc_id][1])) <= 6 * removed[r.doc_id][2]
    size = lambda rows: sum(len(r.text.split()) for r in rows)
    assert abs(size(mixed) - 1.5 * size(cut)) <= 30 and max(Counter(r.doc_id for r in mixed).values()) <= 2
    packed = frames["packing"].collect()
    total = Counter()
    for r in packed:
        total[r.sequence_id] += r.length
    assert all(n <= 1024 and n & n - 1 == 0 for n in total.values())
    assert {r.doc_id for r in packed} == {r.doc_id for r in mixed}


def test_registered():
    names = {n.split("_")[0] for n in queries.QUERIES}
    assert names == {f"op{k}" for k in range(1, 14)} and set(queries.SQL) <= set(queries.QUERIES)
    assert len(corpus_pipeline.STAGES) == 5 and check_packing


def test_stages_on_odd_rows(spark):
    """Null and repeated ids, null, empty and wordless texts, no source: each stage keeps the columns and what it must."""
    long = " ".join(f"w{k}" for k in range(400))
    rows = [(None, long, "en", None, 1), (7, long, None, "s", None), (7, "other " + long[::-1], "en", "s", 2), (8, None, "en", "s", 3), (9, "", "en", None, 4), (9, "   ", "en", "s", 5), (10, "short and clean", "en", "t", 6), (10, "short and clean", "en", "t", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0
        if name != "packing":
            assert out.dtypes == docs.dtypes
            kept[name] = [(r.doc_id, r.text) for r in out.collect()]
    assert sorted(map(str, kept["toxicity"])) == sorted(str((r[0], r[1])) for r in rows)
    texts = [(i, t) for i, t, *_ in rows]
    # 7 has the id of its group; the null id stays; of the empty sets 8 is the smallest; both rows of 10 are the smallest
    assert sorted(map(str, kept["simhash"])) == sorted(str(x) for k, x in enumerate(texts) if k not in (4, 5))
    assert len(kept["suffix_array"]) == len(rows) and kept["suffix_array"].count((8, None)) == 1
    assert all(t and t.strip() for _, t in kept["mixing"]) and {i for i, _ in kept["mixing"]} <= {None, 7, 10}
    pieces = corpus_pipeline.pack(spark, docs, "").collect()
    ends = sum(r.start + r.length == r.doc_tokens for r in pieces)
    assert ends == len(rows)
