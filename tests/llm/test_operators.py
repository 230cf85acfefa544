"""Each corpus operator against brute force, and on nulls, empty and very long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from marquee.llm import audio, common, embedding_dups, langid, mixing, packing, repeats, simhash, token_counts, toxicity, warc_fixity

BPE = public_tokenizers.path("byte_bpe_50k.json")
SMALL = "/root/testdata/sf0.001"
ODD = [None, "", " ", "a", "The the  of\n\nx <|endoftext|> y ", "é日本語" * 40, "word " * 40_000, "x" * 5000, "same text here", "same text here"]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, with columns whose names the operators use themselves."""
    rows = [(i, t, "en" if i % 2 else None, None if i == 3 else f"s{i % 3}", -1, "clash") for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens long, score string")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark):
    return common.table(spark, SMALL, "documents")


def components_of(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)] + [(None, 5), (7, 7)]
    got = dict(common.components(spark.createDataFrame(edges, "src long, dst long")).collect())
    real = {e for e in edges if None not in e and e[0] != e[1]}
    nodes = {x for e in real for x in e}
    assert got == components_of(sorted(nodes), lambda a, b: (a, b) in real or (b, a) in real)


# -- language

def test_langid_held_out(spark, docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = langid.fit(docs.where(~out), path)
    got = langid.predict(docs.where(out), model, path).join(docs, "doc_id").select("lang_pred", "lang", "score").collect()
    assert len(got) > 20 and sum(r.lang_pred == r.lang for r in got) / len(got) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_langid_forward_sums_all_segmentations():
    p = langid.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    probs = np.random.default_rng(0).random((p.size, 2))
    probs /= probs.sum(axis=0)

    def total(w):
        if not w:
            return np.ones(2)
        return sum((probs[p.number[w[:k]]] * total(w[k:]) for k in range(1, len(w) + 1) if w[:k] in p.number), np.zeros(2))

    words = [langid.START + w for w in ("the", "thing", "a", "enter")]
    assert np.allclose(langid.log_words(p, words, probs), np.log([total(w) for w in words]))


def log_segmentations(p, word, probs):
    """Log of the sum over all segmentations, in exact fractions; characters without a piece are spelled in bytes."""
    at = [Fraction(1)]
    for j in range(1, len(word) + 1):
        total = sum((at[i] * Fraction(probs[p.number[word[i:j]]]) for i in range(j) if word[i:j] in p.number), Fraction(0))
        if word[j - 1] not in p.number:
            spelled = Fraction(1)
            for x in word[j - 1].encode():
                spelled *= Fraction(probs[p.byte[x]])
            total += at[j - 1] * spelled
        at.append(total)
    return math.log(at[-1].numerator) - math.log(at[-1].denominator)


@pytest.mark.parametrize("scale", [1.0, 1e-12])
def test_langid_words_of_any_length_and_smallness(scale):
    """Long runs, spelled characters and probabilities whose products vanish, against exact fractions."""
    p = langid.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    probs = np.random.default_rng(3).random((p.size, 2)) / p.size * scale
    words = [langid.START + w for w in ("the", "x" * 200, "therapeutic" * 9, "\U00010330\U00010331" * 16, "ab\u1234cd" * 3, "q" * 47, "q" * 48)]
    got = langid.log_words(p, words, probs)
    for w, x in zip(words, got):
        assert x == pytest.approx([log_segmentations(p, w, probs[:, k]) for k in (0, 1)], rel=1e-9)


def test_langid_expected_counts_by_perturbation(monkeypatch):
    """A piece's expected uses are the derivative of the log probability by its log probability; plain and logarithmic sums agree."""
    p = langid.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    probs = np.random.default_rng(4).random(p.size) / p.size
    words, counts = [langid.START + w for w in ("there", "theatre", "\u1234ab", "anthem" * 3)], np.array([1.0, 2.0, 3.0, 0.5])
    got = langid.expected(p, words, counts, probs)
    for piece in ("the", langid.START + "the", "e", "re", "an"):
        moved = np.repeat(probs[:, None], 2, axis=1)
        moved[p.number[piece]] *= [1 + 1e-6, 1 - 1e-6]
        logs = langid.log_words(p, words, moved)
        assert got[p.number[piece]] == pytest.approx(float(counts @ (logs[:, 0] - logs[:, 1])) / 2e-6, rel=1e-4, abs=1e-6)
    assert got[p.byte["\u1234".encode()[0]]] >= 3.0
    monkeypatch.setattr(langid, "PLAIN", 0)
    assert np.allclose(langid.expected(p, words, counts, probs), got)


def test_langid_letters(spark, docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = langid.fit(docs, path, train_docs=50, rounds=1)
    texts = ["\u00bd \u00b2 \u2460", "\u2163 12 _ !", "\u00aa", "x", "語" * 300, "1a"]
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, path).collect()}
    assert [got[k].lang_pred == "und" for k in range(6)] == [True, True, False, False, False, False] and got[0].score == got[1].score == 0


def test_langid_odd(odd, empty, docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = langid.fit(docs, path, train_docs=50, rounds=1)
    got = {r.doc_id: r for r in langid.predict(odd, model, path).collect()}
    assert len(got) == len(ODD) and all(got[i].lang_pred == "und" and got[i].score == 0 for i in (0, 1, 2))
    assert got[8].lang_pred == got[9].lang_pred
    assert langid.predict(empty, model, path).count() == 0
    none = langid.fit(empty, path)
    assert {r.lang_pred for r in langid.predict(odd, none, path).collect()} == {"und"}


# -- tokens and packing

def library_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE).encode(text, add_special_tokens=False).ids


def test_token_counts(odd, empty):
    got = {r.doc_id: r for r in token_counts.count_tokens(odd, BPE).collect()}
    for i, t in enumerate(ODD):
        n = len(library_ids(t or ""))
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 512)
    assert token_counts.count_tokens(empty, BPE).count() == 0


@pytest.mark.parametrize("text", ["a  b", "a \n b\n\n c  ", "it's 'REAL don't 12 3٣ ½", "\t\tx\r\ny", "<|endoftext|>", "ab" * 300 + " ", "naïve — “q”… 😀😀", "x y z"])
def test_token_counts_of_spaces_and_marks(text):
    merges = token_counts.MergeTable(BPE)
    assert merges.count(text) == len(library_ids(text))
    assert np.frombuffer(packing.Encoder(BPE).encode(text), "<u2").tolist() == library_ids(text)


def check_packing(texts, pieces, capacity=1024):
    ids = {i: np.array([*library_ids(t or ""), 0], "<u4") for i, t in texts.items()}
    seen = Counter()
    sequences = {}
    for r in pieces:
        part = ids[r.doc_id][r.start:r.start + r.length]
        assert len(part) == r.length > 0 and r.doc_tokens == len(ids[r.doc_id]) and bytes(r.ids) == part.tobytes()
        seen.update((r.doc_id, k) for k in range(r.start, r.start + r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert seen == Counter((i, k) for i, x in ids.items() for k in range(len(x)))
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= capacity and at & at - 1 == 0


def test_packing(odd, empty):
    check_packing(dict(enumerate(ODD)), packing.pack_documents(odd, BPE).collect())
    assert packing.pack_documents(empty, BPE).count() == 0


def test_hilbert_is_a_walk_through_every_cell():
    side, bits = 8, 3
    points = np.stack(np.meshgrid(*[np.arange(side)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = packing.hilbert(points, bits)
    assert sorted(key) == list(range(side ** 3))
    walk = points[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


# -- mixing

def test_mixing(spark, odd, empty):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "b", "c", None, "hot", "hot", "hot"]), rng.choice([0, 1, 5, 40, 400])) for i in range(900)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string, size long")).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n
    total, order = 1.5 * sum(sizes.values()), sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, full = {}, set()
    while True:
        rest = [s for s in order if s not in full]
        left = total - sum(2 * sizes[s] for s in full)
        target = {s: 2 * sizes[s] if s in full else left * weights[s] / sum(weights[x] for x in rest) for s in order}
        over = {s for s in rest if target[s] > 2 * sizes[s]}
        if not over:
            break
        full |= over
    taken = Counter()
    for r in got:
        assert abs(r.target - target[r.source]) < 1e-6 and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size
        assert sum(p.words for p in r.passes) == r.taken and all(0 <= p.position <= 1 for p in r.passes)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)


def test_mixing_odd(odd, empty):
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns
    words = sum(len((r.text or "").split()) for r in mixed.collect())
    assert abs(words - 1.5 * sum(len((t or "").split()) for t in ODD)) < 5
    assert mixing.mixed_documents(empty).count() == 0


def test_mixing_whatever_the_columns_are_called(odd):
    """Columns named as added or inner ones, null and repeated ids, repeated rows."""
    clash = odd.withColumn("doc_id", F.when(F.col("doc_id") > 5, None).otherwise(F.col("doc_id") % 2))
    for name in ("target", "source_size", "taken", "passes", "position", "words", "pass", "row", "id", "size", "_mix_row"):
        clash = clash.withColumn(name, F.lit(f"own {name}"))
    got = mixing.mixed_documents(clash)
    assert got.columns == clash.columns
    rows = got.collect()
    assert rows and all(r[name] == f"own {name}" for r in rows for name in ("target", "source_size", "taken", "passes", "position", "words", "pass", "row", "id", "size", "_mix_row"))
    words = lambda t: len((t or "").split())
    sizes = sum(words(r.text) for r in clash.collect())
    assert abs(sum(words(r.text) for r in rows) - 1.5 * sizes) <= 12
    assert Counter(mixing.mixed_documents(clash).collect()) == Counter(rows)
    mixed = mixing.mix_sources(clash.withColumn("size", F.lit(3)))
    assert mixed.count() == len(ODD) and mixed.schema["target"].dataType.simpleString() == "double" and {"words", "row", "_mix_row"} <= set(mixed.columns)


# -- audio

def test_audio_round_trip(odd, empty):
    media = audio.store_audio(odd)
    got = {r.doc_id: r for r in audio.index_audio(media).collect()}
    for i, t in enumerate(ODD):
        p = audio.pad((t or "").encode())
        assert got[i].payload_sha256 == hashlib.sha256(p).hexdigest() and got[i].payload_bytes == len(p) and got[i].tail_crc32 == zlib.crc32(p[-64:])
        assert got[i].n_bad_crc == 0 and got[i].n_skipped == 0 and got[i].table_ok and got[i].duration_us == got[i].n_frames * 24_000
    assert got[8].media_sha256 == got[9].media_sha256
    assert audio.index_audio(audio.store_audio(empty)).count() == 0


def test_audio_damage():
    payload = random.Random(1).randbytes(64 * 100)
    media = audio.encode(payload)
    assert audio.crc16(b"123456789") == 0xAEE7
    whole = audio.parse(media)
    assert whole["payload"] == payload and len(whole["offsets"]) == whole["table"]["frames"] and whole["table"]["bytes"] == len(media) - whole["offsets"][0] + audio.FRAME[320]
    at = whole["offsets"][3]
    junk = audio.parse(media[:at] + b"\xff\xfbjunk" + media[at:])
    assert junk["payload"] == payload and junk["skipped"] == 6
    bad = bytearray(media)
    bad[at + 4] ^= 1
    assert audio.parse(bytes(bad))["bad"] == 1
    assert audio.parse(None)["frames"] == 0 and audio.parse(b"not audio")["frames"] == 0


@pytest.mark.parametrize("head, kbits, hertz, samples, size", [
    ("fffb9064", 128, 44100, 1152, 417), ("fffb9264", 128, 44100, 1152, 418), ("fff3a0c4", 96, 22050, 576, 313), ("ffe398c4", 80, 8000, 576, 720),
    ("fffdc000", 256, 44100, 1152, 835), ("fff58000", 64, 22050, 1152, 417), ("ffff4400", 128, 48000, 384, 128), ("fff77600", 112, 24000, 384, 228)])
def test_audio_headers(head, kbits, hertz, samples, size):
    """Headers of each version and layer, with the values that their standards give."""
    found = audio.frame_of(bytes.fromhex(head))
    assert (found.kbits, found.hertz, found.samples, found.bytes) == (kbits, hertz, samples, size)
    stream = b"".join(bytes.fromhex(head) + bytes(size - 4) for _ in range(5))
    got = audio.parse(b"junk" + stream)
    assert got["offsets"] == [4 + size * k for k in range(5)] and got["skipped"] == 4 and got["micros"] == 5 * samples * 1_000_000 // hertz


@pytest.mark.parametrize("head", ["fffb00c4", "fffbf0c4", "fffb9cc4", "ffeb90c4", "fff990c4", "fefb90c4", "ff"])
def test_what_is_no_audio_header(head):
    assert audio.frame_of(bytes.fromhex(head)) is None


def test_audio_vbri_table():
    head = bytes.fromhex("fffb9064")
    table = b"VBRI" + bytes.fromhex("0001 0000 0064") + (417 * 4).to_bytes(4, "big") + (3).to_bytes(4, "big") + bytes.fromhex("0003 0001 0002 0001") + b"".join((417).to_bytes(2, "big") for _ in range(3))
    stream = head + bytes(32) + table + bytes(417 - 36 - len(table)) + (head + bytes(413)) * 3
    got = audio.parse(stream)
    assert got["table"] == {"bytes": 1668, "frames": 3, "seek": [0, 417, 834]} and got["table_ok"] and got["offsets"] == [417, 834, 1251]


def test_audio_index_with_clashing_names(spark):
    frame = spark.createDataFrame([(1, None, "own"), (1, bytearray(b"no audio"), "own"), (None, bytearray(audio.encode(audio.pad(b"hi"))), "own")], "doc_id long, media binary, feature string")
    got = audio.index_audio(frame).collect()
    assert sorted(r.n_frames for r in got) == [0, 0, 1] and all(r.feature != "own" for r in got) and len(got[2].seek_offsets) == got[2].n_frames


# -- embeddings

def test_embeddings(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(np.vstack([base, base[:20] + 0.07 * rng.normal(size=(20, 16)), base[:5] * 3, np.repeat(base[:1], 40, axis=0)]))]
    rows += [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [None] * 16), (905, [1.0, 2.0]), (906, [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("k1", F.lit("clash"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dups.near_vectors(frame, tile=32).collect()}
    good = {i: np.array(v) for i, v in rows if i < 900 or i > 904}

    def linked(a, b):
        if a not in good or b not in good or len(good[a]) != len(good[b]):
            return False
        return good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= 0.95

    ids = [i for i, _ in rows]
    comp = components_of(ids, linked)
    assert got == {i: (sum(linked(i, j) for j in ids if j != i), comp[i], comp[i] == i) for i in ids}
    assert embedding_dups.near_vectors(frame.limit(0)).count() == 0


def brute_links(vectors, threshold=0.95):
    unit = {i: np.array(v) / np.abs(v).max() for i, v in vectors.items()}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    linked = lambda a, b: unit[a] @ unit[b] >= threshold
    comp = components_of(sorted(vectors), linked)
    return {i: (sum(linked(i, j) for j in vectors if j != i), comp[i], comp[i] == i) for i in vectors}


def test_embeddings_of_many_dimensions_and_any_size(spark):
    """Codes of 1,536 dimensions; components whose squares overflow or vanish; cosines about the threshold."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 1536))
    side = rng.normal(size=(12, 1536))
    side -= (side * base).sum(axis=1, keepdims=True) / (base * base).sum(axis=1, keepdims=True) * base
    side *= np.linalg.norm(base, axis=1, keepdims=True) / np.linalg.norm(side, axis=1, keepdims=True)
    near = [c * base + np.sqrt(1 - c * c) * side for c in (0.9501, 0.9499, 0.99)]
    flat = np.sign(base[:4])  # every code is the largest there is
    rows = np.vstack([base, *near, flat, -flat, base[:3] * 1e200, near[2][:3] * 1e-200, near[0][:2] * 1e-300])
    vectors = {i: v.tolist() for i, v in enumerate(rows)}
    frame = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    for tile in (16, embedding_dups.TILE):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dups.near_vectors(frame, tile=tile).collect()}
        assert got == brute_links(vectors)
    q = np.full((2, 1536), 127, np.int8)
    assert (embedding_dups.products(q, q) == 1536 * 127 * 127).all()


def test_rows_without_ids(spark):
    """No operator fails on them; each row comes out once."""
    vectors = spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (None, None)], "vec_id long, embedding array<float>")
    got = embedding_dups.near_vectors(vectors).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in got) == [(0, 0, 0, True), (0, 0, 0, True), (1, 1, 1, True), (2, 1, 1, False)]
    frame = spark.createDataFrame([(None, "x" * 300), (None, None), (1, "y" * 300), (2, "y" * 300), (3, "z words here")], "doc_id long, text string").withColumn("source", F.lit(None).cast("string"))
    assert {(r.doc_id, r.n_removed) for r in repeats.remove_repeats(frame).collect()} >= {(1, 300), (2, 300), (3, 0)}
    for out in (repeats.remove_repeats(frame), simhash.simhash_groups(frame), simhash.near_duplicates(frame), token_counts.count_tokens(frame, BPE), audio.store_audio(frame), mixing.mix_sources(frame.withColumn("size", F.lit(3)))):
        assert out.count() == 5
    check = packing.pack_documents(frame, BPE).collect()
    assert sum(r.length for r in check) == sum(len(library_ids(r.text or "")) + 1 for r in frame.collect())


def test_quantisation_bound():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, s, e = embedding_dups.quantise(x)
    error = np.abs(x @ x.T - (q.astype(float) * s[:, None]) @ (q.astype(float) * s[:, None]).T)
    assert (error <= e[None, :] + e[:, None] * (1 + e[None, :])).all()


# -- fixity

def test_warc(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "x" * (i % 50)) for i in range(700)] + [(None, None, None), (3, "http://h/3", "again")], "page_id long, url string, html string").withColumn("seq", F.lit("clash"))
    records = common.settle(warc_fixity.manifest(pages), "manifest")
    rotten = {5, 77, 300, 699}
    replica = records.withColumn("digest", F.when(F.col("page_id").isin(*rotten), F.lit("bad")).when(F.col("page_id") == 128, F.lit(None)).otherwise(F.col("digest")))
    got = warc_fixity.audit(records, replica).collect()
    assert len(got) == 702
    assert {(r.page_id, r.status) for r in got if r.status != "ok"} == {(i, "changed") for i in rotten} | {(128, "missing")}
    by_file = {}
    for r in got:
        by_file.setdefault(r.warc_file, []).append((r.seq, r.offset, r.length))
    for rs in by_file.values():
        at = 0
        for k, (seq, offset, n) in enumerate(sorted(rs)):
            assert (seq, offset) == (k, at)
            at += n
    assert warc_fixity.audit(records.limit(0), records.limit(0)).count() == 0


def test_warc_reads_only_below_what_differs(spark):
    pages = spark.range(600).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.lit("h").alias("html"))
    records = common.settle(warc_fixity.manifest(pages), "manifest")
    levels = warc_fixity.merkle_levels(records)
    assert [x.where("warc_file = 0").count() for x in levels] == [256, 16, 1]
    assert warc_fixity.locate(levels, warc_fixity.merkle_levels(records)).count() == 0


# -- SimHash

def brute_fingerprint(text, words=3):
    found = [w.translate(simhash.LOWER) for w in simhash.WORD.findall((text or "").encode())]
    if not found:
        return 0
    grams = [b" ".join(found[k:k + words]) for k in range(max(1, len(found) - words + 1))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(docs, odd, empty):
    for frame in (docs, odd):
        texts = {r.doc_id: r.text for r in frame.collect()}
        f = {i: brute_fingerprint(t) for i, t in texts.items()}
        comp = components_of(sorted(f), lambda a, b: (f[a] ^ f[b]).bit_count() <= 3)
        assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_groups(frame).collect()} == {i: (f"{f[i]:016x}", comp[i]) for i in f}
    assert simhash.simhash_groups(empty).count() == 0


def test_anchors_find_every_pair(spark):
    rng = random.Random(4)
    values = [rng.getrandbits(64) for _ in range(150)]
    for v in values[:100]:
        for b in rng.sample(range(64), rng.randrange(1, 6)):
            v ^= 1 << b
        values.append(v)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = {tuple(r) for r in simhash.near_pairs(spark.createDataFrame(list(enumerate(signed)), "node long, f0 long"), plan=simhash.blocks(1, 3)).collect()}
    assert got == {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if (values[i] ^ values[j]).bit_count() <= 3}


def test_groups_of_near_copies_join_by_few_links(spark):
    rng = random.Random(9)
    values = set()
    for base in [rng.getrandbits(64) for _ in range(6)]:
        near = [base]
        for _ in range(60):
            v = rng.choice(near)
            for b in rng.sample(range(64), rng.randrange(1, 4)):
                v ^= 1 << b
            near.append(v)
        values |= set(near)
    values = sorted(values)
    frame = spark.createDataFrame([(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(values)], "node long, f0 long")
    expect = components_of(range(len(values)), lambda a, b: (values[a] ^ values[b]).bit_count() <= 3)
    assert {r.node: r.component for r in simhash.link_components(frame).collect()} == expect


def test_covering_radius_is_one():
    for width in (21, 22, 32):
        x = np.random.default_rng(1).integers(0, 1 << width, 2000).astype(np.uint64)
        home = simhash.home(x, width)
        assert (np.bitwise_count(x ^ home) <= 1).all() and (simhash.home(home, width) == home).all()


def test_near_duplicates(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for i in range(60):
        text = [word() for _ in range(200)]
        rows.append((2 * i, " ".join(text)))
        text[rng.randrange(200)] = word()
        rows.append((2 * i + 1, " ".join(text)))
    rows += [(500, None), (501, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1))
    kept = {r.doc_id for r in simhash.one_of_each(frame, simhash.near_duplicates(frame)).collect()}
    assert all(2 * i in kept for i in range(60)) and sum(2 * i + 1 not in kept for i in range(60)) >= 57
    assert 500 in kept and 501 not in kept


@pytest.mark.parametrize("bits", [6, 10, 24])
def test_marked_rows_hold_all_that_are_sought(spark, bits):
    rows = spark.createDataFrame([(None if i % 50 == 0 else i, "x", i, i) for i in range(-500, 500)], "doc_id int, at string, word long, maybe long")
    ids = spark.createDataFrame([(i,) for i in range(-500, 500, 7)] + [(None,)], "extra long")
    out = common.marked(rows, F.col("doc_id"), ids, bits).select("row.doc_id", F.col("row.word").alias("w"), "maybe").collect()
    assert sorted(r.w for r in out) == list(range(-500, 500))
    sought = {r.extra for r in ids.collect()} - {None}
    assert all(r.maybe for r in out if r.doc_id in sought)
    others = [r.maybe for r in out if r.doc_id is not None and r.doc_id not in sought]
    assert sum(others) > 0.7 * len(others) if bits == 6 else sum(others) < 0.2 * len(others)
    assert common.marked(rows.limit(0), F.col("doc_id"), ids, bits).count() == 0
    assert not any(r.maybe for r in common.marked(rows, F.col("doc_id"), ids.limit(0), bits).collect())


def test_one_of_each_keeps_rows_and_columns(spark):
    docs = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (2, "a", 2), (3, "b", 3), (3, "b", 4), (None, "a", 5), (9, None, 6)], "doc_id int, row string, maybe long")
    groups = spark.createDataFrame([(1, 1, "a"), (2, 1, "a"), (2, 1, "a"), (3, 3, "b"), (None, 1, "a"), (7, 3, "b"), (9, 3, "other text")], "doc_id int, component_id long, row string")
    groups = groups.select("doc_id", "component_id", F.xxhash64("row").alias("text_hash"))
    kept = simhash.one_of_each(docs, groups, text_col="row")
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    assert sorted(r.maybe for r in kept.collect()) == [1, 3, 4, 5, 6]
    assert simhash.one_of_each(docs.limit(0), groups, text_col="row").count() == 0
    assert simhash.one_of_each(docs, groups.limit(0), text_col="row").count() == 7


def by_row(rows, linked):
    """(id, number of linked rows, smallest id of its component) of each row, in order."""
    comp = components_of(range(len(rows)), lambda a, b: linked(rows[a][1], rows[b][1]))
    least = {}
    for k, (i, _) in enumerate(rows):
        least[comp[k]] = min(i, least.get(comp[k], i))
    return [(i, sum(linked(v, w) for n, (_, w) in enumerate(rows) if n != k), least[comp[k]]) for k, (i, v) in enumerate(rows)]


def test_texts_that_share_an_id(spark):
    rng = random.Random(12)
    words = lambda: [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = []
    for k in range(30):
        text = words()
        rows += [(k % 6, " ".join(text)), (100 + k, " ".join([*text[:-1], "other"])), (k % 6, " ".join(text))]
    rows += [(3, None), (4, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    prints = {t: brute_fingerprint(t) for _, t in rows}
    want = by_row(rows, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    got = simhash.simhash_groups(frame).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((i, f"{prints[t]:016x}", c) for (i, t), (_, _, c) in zip(rows, want))
    sets = {t: set(simhash.shingle_hashes(t, 5).tolist()) for _, t in rows}
    want = by_row(rows, lambda a, b: sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    groups = simhash.near_duplicates(frame)
    assert sorted((r.doc_id, r.component_id) for r in groups.collect()) == sorted((i, c) for i, _, c in want)
    kept = Counter((r.doc_id, r.text) for r in simhash.one_of_each(frame, groups).collect())
    assert kept == Counter(row for row, (i, _, c) in zip(rows, want) if i == c)


def test_vectors_that_share_an_id(spark):
    rng = np.random.default_rng(7)
    rows = []
    for k in range(24):
        v = rng.normal(size=12)
        rows += [(k % 5, v.tolist()), (100 + k, (v + 0.01 * rng.normal(size=12)).tolist()), (k % 5, v.tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    cosine = lambda a, b: np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) >= 0.95
    got = embedding_dups.near_vectors(frame, tile=16).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted(by_row(rows, cosine))
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_near_duplicates_reach_the_limit_and_stop_there(spark):
    """Pairs of exactly this resemblance: 200 * share shingles in common of 200 in all."""
    rows, share_of = [], {}
    for share in (70, 75, 79, 80, 85, 90):
        for k in range(60):
            common_words = [f"c{share}x{k}x{w}" for w in range(2 * share + 4)]
            share_of[len(rows)] = share
            for side in "ab":
                rows.append((len(rows), " ".join(common_words + [f"{side}{share}x{k}x{w}" for w in range(100 - share)])))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = Counter(share_of[i] for i in share_of if got[i + 1] == i)
    assert found[70] == found[75] == found[79] == 0
    assert found[80] >= 57 and found[85] >= 59 and found[90] == 60
    assert len(set(got.values())) == len(rows) - sum(found.values())


def test_covering_plan_meets_its_recall():
    """Share of pairs that meet within two bits of a block, drawn at the flip rate of a resemblance."""
    rng = np.random.default_rng(7)
    for n in (50_000, 12_000_000):
        plan, seeds = simhash.covering_plan(n, 0.8, 0.99)
        for resemblance, least in ((0.8, 0.985), (0.85, 0.998), (0.9, 0.9995)):
            bits = rng.random((4000, 64 * seeds)) < simhash.flip_rate(resemblance)
            met = np.any([bits[:, a:a + w].sum(axis=1) <= 2 for a, w in plan], axis=0)
            assert met.mean() >= least
    assert simhash.flip_rate(0.8) == pytest.approx(0.1515, abs=1e-4)


def test_two_bits_apart_meet_at_an_anchor(spark):
    rng = random.Random(5)
    values = [rng.getrandbits(44) for _ in range(80)]
    for v in values[:80]:
        for b in rng.sample(range(44), rng.randrange(1, 6)):
            v ^= 1 << b
        values.append(v)
    plan = [(0, 22), (22, 22)]
    got = {tuple(r) for r in simhash.near_pairs(spark.createDataFrame(list(enumerate(values)), "node long, f0 long"), plan=plan, reach=2, threshold=5).collect()}
    differ = lambda i, j, at: ((values[i] ^ values[j]) >> at & (1 << 22) - 1).bit_count()
    for i in range(len(values)):
        for j in range(i + 1, len(values)):
            if differ(i, j, 0) + differ(i, j, 22) > 5:
                assert (i, j) not in got
            elif min(differ(i, j, 0), differ(i, j, 22)) <= 2:
                assert (i, j) in got


def test_compared_sets_are_joined_as_by_all_pairs(spark):
    rng = random.Random(12)
    sets = []
    for _ in range(4):
        base = set(rng.sample(range(10_000), 60))
        for _ in range(40):
            base = set(rng.sample(sorted(base), len(base) - rng.randrange(6))) | set(rng.sample(range(10_000), rng.randrange(6)))
            sets.append(base)
    rows = [(40 * (i // 40), tiles, i % tiles, i, sorted(x)) for i, x in enumerate(sets) for tiles in [1 if i < 40 else 5]]
    frame = spark.createDataFrame(rows, "group long, tiles long, tile long, node long, shingles array<long>")
    frame = frame.groupBy("group", "tiles", "tile").agg(F.collect_list(F.struct("node", "shingles")).alias("x"))
    edges = {tuple(r) for r in simhash.compare_sets(frame, 0.8).collect()}
    like = lambda i, j: i // 40 == j // 40 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    assert components_of(range(160), lambda i, j: (i, j) in edges or (j, i) in edges) == components_of(range(160), like)
    x = [np.array(sorted(s)) for s in sets]
    assert (simhash.common_counts(x[:50], x[50:]) == [[len(a & b) for b in sets[50:]] for a in sets[:50]]).all()


def test_near_duplicates_as_all_pairs(docs, odd, empty):
    for frame in (docs, odd):
        sets = {r.doc_id: set(simhash.shingle_hashes(r.text, 5).tolist()) for r in frame.collect()}
        comp = components_of(sorted(sets), lambda a, b: sets[a] == sets[b] or len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8)
        assert {r.doc_id: r.component_id for r in simhash.near_duplicates(frame).collect()} == comp
    assert simhash.near_duplicates(empty).count() == 0


# -- toxicity

def test_toxicity_held_out(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    labels = common.table(spark, "/root/testdata/sf0.01", "labels").select("doc_id", (1 - F.col("quality")).alias("junk"), "toxic")
    out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    chain = toxicity.fit_chain(docs, labels.where(~out), ["junk", "toxic"])
    got = toxicity.score_chain(docs, chain).join(labels.where(out), "doc_id").collect()
    assert sum((r.p_toxic >= 0.5) == r.toxic for r in got) / len(got) > 0.93


def test_toxicity_odd(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1, 0), (6, 0, 1), (8, 0, 0), (9, None, 1), (8, 0, 0), (None, 1, 1)], "doc_id long, junk int, toxic int")
    chain = toxicity.fit_chain(odd, labels, ["junk", "toxic"])
    assert toxicity.score_chain(odd, chain).count() == len(ODD) and toxicity.score_chain(empty, chain).count() == 0
    none = toxicity.fit_chain(odd, labels.limit(0), ["junk", "toxic"])
    assert toxicity.keep_clean(odd, none, "toxic").count() == len(ODD)
    assert toxicity.keep_clean(odd, none, "toxic").columns == odd.columns


def test_chain_feeds_earlier_probabilities():
    rng = np.random.default_rng(0)
    first = rng.random(400) < 0.5
    rows, cols = np.flatnonzero(first), np.zeros(first.sum(), np.int64)
    w, v, _ = toxicity.fit_linear(np.zeros(0, np.int64), np.zeros(0, np.int64), (4 * first - 2.0)[:, None], first.astype(float), 0)
    assert v[0] > 0.5
    w, _, _ = toxicity.fit_linear(rows, cols, np.zeros((400, 0)), first.astype(float), 1)
    assert w[0] > 2


def test_chain_as_by_hand(spark):
    """Choice of features, folds, out-of-fold probabilities and scores against plain loops over all documents."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(30)]
    texts, junk, toxic = [], [], []
    for k in range(160):
        bad, worse = rng.random() < 0.4, rng.random() < 0.4
        texts.append(" ".join([*rng.sample(words, 6), *(["spammy!"] if bad and rng.random() < 0.8 else []), *(["vile77"] if worse and (bad or rng.random() < 0.6) else []), f"n{k}"]))
        junk.append(int(bad))
        toxic.append(int(worse))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame(list(zip(range(160), junk, toxic)), "doc_id long, junk int, toxic int")
    chain = toxicity.fit_chain(frame, labels, ["junk", "toxic"])
    names = [set().union(*map(toxicity.features, t.split())) for t in texts]
    chosen = set()
    for y in (junk, toxic):
        p = sum(y) / len(y)
        for f in set().union(*names):
            n = sum(f in x for x in names)
            z = (sum(y[k] for k in range(160) if f in names[k]) - n * p) / (n * p * (1 - p)) ** 0.5
            if n >= 3 and z >= toxicity.EVIDENCE:
                chosen.add(f)
    assert chosen and chain.chosen.tolist() == sorted(chosen)
    place = {f: k for k, f in enumerate(sorted(chosen))}
    fold = [zlib.crc32(t.encode()) % toxicity.FOLDS for t in texts]

    def fitted(inside, earlier, y):
        rows = [(r, place[f]) for r, k in enumerate(inside) for f in sorted(names[k]) if f in place]
        at = np.array(rows, np.int64).reshape(-1, 2)
        extra = np.array([[4 * e[k] - 2 for e in earlier] for k in inside]).reshape(len(inside), len(earlier))
        return toxicity.fit_linear(at[:, 0], at[:, 1], extra, np.array([y[k] for k in inside], float), len(place))

    def probability(k, earlier, model):
        z = model[2] + sum(model[0][place[f]] for f in names[k] if f in place) + sum(v * (4 * e - 2) for v, e in zip(model[1], earlier))
        return 1 / (1 + np.exp(-z))

    earlier, models = [], []
    for y in (junk, toxic):
        models.append(fitted(range(160), earlier, y))
        mine = [0.0] * 160
        for out in range(toxicity.FOLDS):
            m = fitted([k for k in range(160) if fold[k] != out], earlier, y)
            for k in range(160):
                if fold[k] == out:
                    mine[k] = probability(k, [e[k] for e in earlier], m)
        earlier.append(mine)
    assert abs(models[1][1][0]) > 0.05
    for r in toxicity.score_chain(frame, chain).collect():
        first = probability(r.doc_id, [], models[0])
        assert r.p_junk == pytest.approx(first, abs=1e-6) and r.p_toxic == pytest.approx(probability(r.doc_id, [first], models[1]), abs=1e-6)
    kept = {r.doc_id for r in toxicity.keep_clean(frame, chain, "toxic").collect()}
    assert kept == {r.doc_id for r in toxicity.score_chain(frame, chain).where("p_toxic < 0.5").collect()}


# -- repeats

def brute_repeats(texts, span=200):
    count = Counter(b[k:k + span] for b in texts.values() for k in range(len(b) - span + 1))
    out = {}
    for i, b in texts.items():
        cover = np.zeros(len(b) + 1, int)
        for k in range(len(b) - span + 1):
            if count[b[k:k + span]] > 1:
                cover[k:k + span] = 1
        cover = cover[:len(b)]
        out[i] = (len(b), int(cover.sum()), int((np.diff(np.concatenate([[0], cover])) == 1).sum()), hashlib.sha256(bytes(x for x, c in zip(b, cover) if not c)).hexdigest())
    return out


def row(r):
    return r.n_bytes, r.n_removed, len(r.spans), r.sha256 if r.kept is None else hashlib.sha256(bytes(r.kept)).hexdigest()


def digest(frame):
    return {r.doc_id: row(r) for r in repeats.remove_repeats(frame).collect()}


@pytest.fixture(scope="module")
def repeated(spark):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared, exact = text(350), text(199)
    rows = [(i, text(rng.randrange(50, 900)) + shared[rng.randrange(60):rng.randrange(240, 350)] + text(rng.randrange(0, 300))) for i in range(40)]
    rows += [(100, exact + "x"), (101, exact + "y"), (102, "ab" * 400), (103, None), (104, ""), (105, rows[3][1]), (106, "short"), (107, "short"), (108, text(900)), (109, "z" * 250)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("hash", F.lit("clash"))


@pytest.mark.parametrize("largest", [1, 6, 2048])
def test_repeats(repeated, largest, monkeypatch):
    """Collections of any size, halved down to single windows or not at all."""
    monkeypatch.setattr(repeats, "LARGEST", largest)
    assert digest(repeated) == brute_repeats({r.doc_id: (r.text or "").encode() for r in repeated.collect()})


def test_repeats_in_small_collections(repeated, monkeypatch):
    monkeypatch.setattr(repeats, "COLLECTION", 5)
    assert digest(repeated) == brute_repeats({r.doc_id: (r.text or "").encode() for r in repeated.collect()})


def test_repeats_without_and_with_repeated_ids(spark):
    """Texts are compared whatever their ids: null, or one id for several texts."""
    rng = random.Random(21)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    one, two = text(260), text(300)
    rows = [(None, "a" + one), (1, one + "b"), (7, text(80) + two), (7, text(400)), (8, two + text(50)), (None, text(300)), (9, text(10)), (9, "q" + two[:210]), (None, None)]
    rows += [(5, text(250))] * 2 + [(None, "w" * 30 + text(200))] * 2
    brute = brute_repeats({k: (t or "").encode() for k, (_, t) in enumerate(rows)})
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter((r.doc_id, *row(r)) for r in repeats.remove_repeats(frame).collect()) == Counter((i, *brute[k]) for k, (i, _) in enumerate(rows))
    cut = Counter((r.doc_id, r.text, r.kept) for r in repeats.without_repeats(frame.withColumn("kept", F.lit("clash")).withColumn("row", F.lit(1))).collect())
    assert sum(cut.values()) == len(rows) and {k for _, _, k in cut} == {"clash"}
    assert cut[(None, None, "clash")] == 1 and cut[(5, "", "clash")] == 2 and cut[(None, "a", "clash")] == 1 and cut[(1, "b", "clash")] == 1


def test_only_broken_characters_go_with_a_cut(spark):
    line = "".join(chr(0x4E00 + k * 37 % 5000) for k in range(80))
    rows = [(1, "A\ufffdB" + line + "é"), (2, "x" + line), (3, "tail\ufffd")]
    got = {r.doc_id: r.text for r in repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "A\ufffdBé", 2: "x", 3: "tail\ufffd"}


def test_repeats_odd(odd, empty):
    assert digest(odd) == brute_repeats({i: (t or "").encode() for i, t in enumerate(ODD)})
    assert repeats.remove_repeats(empty).count() == 0 and repeats.without_repeats(empty).count() == 0
    cut = repeats.without_repeats(odd)
    assert cut.columns == odd.columns and cut.count() == len(ODD)


def test_columns_give_the_suffix_order():
    rng = random.Random(1)
    rows = ["".join(rng.choice("ab") for _ in range(336)) for _ in range(30)]
    rows += [rows[0][:100] + rows[1][100:], rows[2][:20] + rows[3][20:260] + rows[4][260:]]
    got = repeats.repeated_starts(np.array([list(r.encode()) for r in rows], np.uint8), 200, 64)
    for k, r in enumerate(rows):
        for col in range(137):
            assert got[k, col] == any(r[col:col + 200] == s[col:col + 200] for j, s in enumerate(rows) if j != k)
