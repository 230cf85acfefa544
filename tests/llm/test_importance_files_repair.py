"""Importance resampling, token files and conversation repair against brute force, and on odd input."""

import hashlib
import math
import os
import random
import re
import zlib
from functools import lru_cache

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marquee.llm import conversations, importance, packing, token_counts, token_files
from marquee.llm.common import table

BPE = public_tokenizers.path("byte_bpe_50k.json")
SMALL = "/root/testdata/sf0.001"
ODD = [None, "", " ", "a", "The the  of\n\nx <|endoftext|> y ", "é日本語" * 40, "word " * 40_000, "x" * 5000, "same text here", "same text here", "Ünï-code A1_b2 -- it's"]
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, null and repeated ids, and columns whose names the operators use themselves."""
    rows = [(None if i == 2 else i // 2 * 2 if i > 7 else i, t, -1, "clash", 0, 0) for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words long, buckets string, id int, number int")


# importance resampling


def runs(text, shortest, longest):
    w = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return [zlib.crc32(" ".join(w[i:i + g]).encode()) for g in range(shortest, longest + 1) for i in range(len(w) - g + 1)], len(w)


@pytest.mark.parametrize("ngrams", [(1, 1), (1, 3), (2, 2)])
@pytest.mark.parametrize("scan", [1024, 1 << 22])
def test_run_crcs_from_two_prefixes(monkeypatch, ngrams, scan):
    monkeypatch.setattr(importance, "SCAN_BYTES", scan)
    monkeypatch.setattr(importance, "SLICE_BYTES", 20_000)
    rng = random.Random(1)
    texts = [*ODD, " ".join(f"w{rng.randrange(50)}" for _ in range(5000)), "-" * 3000, "end", "start"]
    got = []
    for _, raw, offsets in importance.slices(pa.array(texts)[0:len(texts)]):
        crcs, each = importance.run_crcs(*importance.word_spans(raw, offsets), *ngrams)
        got += [x.tolist() for x in np.split(crcs, np.cumsum(each)[:-1])]
    assert got == [runs(t, *ngrams)[0] for t in texts]


def test_slices_of_a_sliced_column():
    column = pa.array(["aa", None, "b c", "", "dd"])[1:4]
    found = [(row, bytes(raw), offsets.tolist()) for row, raw, offsets in importance.slices(column)]
    assert found == [(0, b"b c", [0, 0, 3, 3])]


def resampled(docs, target, ngrams, buckets, percent, least):
    """(id, n_features, weight, score, rank) by plain loops."""
    of = [(d, *runs(t, *ngrams)) for d, t in docs]
    s, t = np.zeros(buckets), np.zeros(buckets)
    for _, f, _ in of:
        for c in f:
            s[c % buckets] += 1
    for x in target:
        for c in runs(x, *ngrams)[0]:
            t[c % buckets] += 1
    gain = [math.floor(1000 * math.log((t[k] + 1) * (s.sum() + buckets) / ((s[k] + 1) * (t.sum() + buckets)))) for k in range(buckets)]
    rows = []
    for d, f, n in of:
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        w = sum(gain[c % buckets] for c in f)
        rows.append((d, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], math.inf if r[0] is None else r[0], r[1]))
    rank = {id(r): k for k, r in enumerate(able[:len(able) * percent // 100], 1)}
    return [(*r[:4], rank.get(id(r))) for r in rows]


def order(rows):
    return sorted(rows, key=lambda r: [(x is None, x) for x in r])


@pytest.mark.parametrize("ngrams, buckets, percent, least", [((1, 1), 10_000, 10, 20), ((1, 2), 97, 60, 1)])
def test_resample_as_by_loops(spark, odd, ngrams, buckets, percent, least):
    docs = table(spark, SMALL, "documents").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    target = table(spark, SMALL, "benchmark")
    got = importance.resample(docs, target, ngrams=ngrams, buckets=buckets, percent=percent, least_words=least).drop("n_words").collect()
    want = resampled([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()], ngrams, buckets, percent, least)
    assert order(map(tuple, got)) == order(want)


def test_resample_odd(odd):
    got = importance.resample(odd, odd).collect()
    assert len(got) == len(ODD)
    assert importance.resample(odd, odd.limit(0)).count() == len(ODD)
    assert importance.resample(odd.limit(0), odd).collect() == []


def test_resample_against_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SMALL}/{name}.parquet')")
    want = con.sql(importance.OP11_SQL).fetchall()
    assert order(map(tuple, importance.op11_importance_resampling(spark, SMALL).collect())) == order(want)


# token files


def library_ids(text):
    library = Tokenizer.from_file(BPE)
    return [*library.encode(text or "", add_special_tokens=False).ids, 0]


@pytest.fixture(scope="module")
def written(spark, odd, tmp_path_factory):
    docs = table(spark, SMALL, "documents").select("doc_id", "text").unionByName(odd.select("doc_id", "text")).repartition(3)
    folder = "file://" + str(tmp_path_factory.mktemp("tokens"))
    return docs, token_files.write_token_files(docs, BPE, folder, length=256)


def test_token_files_hold_all_ids_in_order(spark, written):
    docs, manifest = written
    got = token_files.read_token_files(manifest, "long").orderBy("start").collect()
    keys = [(r.doc_id is not None, r.doc_id) for r in got]
    assert keys == sorted(keys) and len(got) == docs.count()
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    want = [(r.doc_id, len(ids := library_ids(r.text)), crc(ids)) for r in docs.collect()]
    assert order((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == order(want)


def test_sequences_are_views_of_the_file(written):
    docs, manifest = written
    for r in manifest.collect():
        file = token_files.SequenceFile(r.path)
        size, before = os.path.getsize(r.path.removeprefix("file://")), pa.total_allocated_bytes()
        seen = []
        for k in range(len(file)):
            ids, mask = file[k]
            assert len(ids) == len(mask) == 256 and ids.dtype == np.uint16 and not ids.flags.owndata
            assert mask.all() or k == len(file) - 1
            seen.append(ids[mask])
        assert pa.total_allocated_bytes() - before < size / 10
        assert sum(map(len, seen)) == r.n_tokens
        with pytest.raises(IndexError):
            file[len(file)]


def test_damaged_token_files_are_found(spark, written, tmp_path):
    _, manifest = written
    row = manifest.orderBy(F.desc("n_tokens")).first()
    raw = open(row.path.removeprefix("file://"), "rb").read()
    (tmp_path / "cut.arrow").write_bytes(raw[:len(raw) // 2])
    damaged = spark.createDataFrame([(0, f"file://{tmp_path}/cut.arrow", row.n_documents, row.n_tokens)], token_files.MANIFEST)
    with pytest.raises(Exception, match="(?i)arrow|footer"):
        token_files.read_token_files(damaged, "long").collect()
    wrong = spark.createDataFrame([(0, row.path, row.n_documents, row.n_tokens + 1)], token_files.MANIFEST)
    with pytest.raises(Exception, match="not"):
        token_files.read_token_files(wrong, "long").collect()


def test_token_files_of_nothing_and_of_texts_as_ids(spark, odd, tmp_path):
    none = token_files.write_token_files(odd.limit(0), BPE, f"file://{tmp_path}/none")
    assert none.collect() == [] and token_files.read_token_files(none, "long").collect() == []
    named = odd.select(F.concat(F.lit("d"), F.col("doc_id")).alias("name"), "text")
    some = token_files.write_token_files(named, BPE, f"file://{tmp_path}/some", id_col="name", end_id=7)
    assert token_files.read_token_files(some, "string").where("doc_id is not null").count() == len(ODD) - 1


def test_encoder_forgets_but_is_right(monkeypatch):
    monkeypatch.setattr(token_files, "CACHE_ENTRIES", 3)
    monkeypatch.setattr(token_files, "CACHE_CHARS", 100)
    encoder = token_files.LibraryEncoder(BPE)
    texts = ["a b c", "d e f g", " a", "a ", "", "x  y", f"b {'long' * 40} c", "q <|endoftext|> r", "line\nbreak \n z"]
    for _ in range(2):
        assert [np.frombuffer(x, encoder.kind).tolist() for x in encoder.encode(texts)] == [library_ids(t)[:-1] for t in texts]


# conversation repair


def damaged(conv, rows):
    """Rows (turn, role, text) of a conversation after damage, in order, by plain loops."""
    out = []
    for turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        role = "user" if case == 4 else role
        out += [(turn, role, text)] * {0: 0, 3: 2}.get(case, 1)
    return sorted(out, key=lambda r: ((r[0] is not None, r[0] or 0), r[1].encode(), r[2].encode()))


def plain_repair(rows):
    """(cost, audit, repaired rows) by recursion over all edits from the right."""
    @lru_cache(None)
    def best(i, state, inserted):
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        due = {"": "user", "s": "user", "u": "assistant", "a": "user"}[state]

        def add(cost, letter, row, rest):
            if rest:
                found.append((cost + rest[0], letter + rest[1], (*row, *rest[2])))

        if inserted < 3:
            add(5, "I", ((due, ""),), best(i, due[0], inserted + 1))
        if i < len(rows):
            role, text, gone, cut = rows[i]
            add(2, "D", (), best(i + 1, state, 0))
            if not gone:
                add(1 + 5 * cut, "R", ((due, text),), best(i + 1, due[0], 0))
                if role[:1] == due[0] or role[:1] == "s" and state == "":
                    add(5 * cut, "K", ((role, text),), best(i + 1, role[0], 0))
        return min(found, default=None)

    return best(0, "", 0)


def repaired_by_loops(conv, rows):
    rows = damaged(conv, rows)
    turns = [t for t, _, _ in rows if t is not None]
    marked, seen, n = [], set(), dict(blank=0, duplicate=0, truncated=0)
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\f\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            n[fault] += 1
        marked.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, kept = plain_repair(tuple(marked))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, digest), kept


def odd_conversations(spark):
    rng = random.Random(5)
    texts = [None, "", " \n", "Yes.", "No", "Why?  ", "Wait!\n", "a.b", "ünï。", "x" * 3000 + "."]
    rows = [(c, None if rng.random() < 0.1 else rng.randrange(9), rng.choice(["user", "assistant", "system", "tool", "", None, "ursula"]), rng.choice(texts), "clash", 3)
            for c in [*range(60), None] for _ in range(rng.randrange(1, 8))]
    rows += [(100, 7, "user", "Same.", "clash", 3)] * 3
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, audit string, kind int")


def by_conversation(rows):
    found = {}
    for r in rows:
        found.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    return found


@pytest.mark.parametrize("which", ["given", "odd"])
def test_repairs_as_by_loops(spark, which):
    rows = table(spark, SMALL, "conversations") if which == "given" else odd_conversations(spark)
    hurt = conversations.damage(rows)
    repairs = conversations.find_repairs(hurt, copies_col="copies")
    want, kept = {}, {}
    for conv, own in by_conversation(rows.collect()).items():
        want[conv], kept[conv] = repaired_by_loops(conv, own)
    got = conversations.repaired_digests(hurt, repairs, copies_col="copies").collect()
    assert {r.conv_id: tuple(r) for r in got} == want and len(got) == len(want)
    turns = {}
    for r in conversations.repaired_turns(hurt, repairs, copies_col="copies").orderBy("position").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
    assert turns == {c: [*k] for c, k in kept.items() if k}


def test_agenda_as_all_edits():
    rng = random.Random(2)
    for _ in range(3000):
        rows = tuple((rng.choice(["s", "u", "a", "t", ""]), "", rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randrange(9)))
        assert conversations.cheapest_repair([(r, gone, cut and not gone) for r, _, gone, cut in rows]) == plain_repair(tuple((r, t, g, c and not g) for r, t, g, c in rows))[:2]


def test_agenda_of_a_long_conversation():
    rows = [("ua"[k % 2], False, False) for k in range(30_000)]
    assert conversations.cheapest_repair(rows) == (0, "K" * 30_000)
    assert conversations.cheapest_repair([("u", True, False)] * 5000) == (10_000, "D" * 5000)


def test_audits_compare_as_their_strings():
    rng, made = random.Random(9), [conversations.Audit()]
    for _ in range(400):
        made.append(conversations.Audit(rng.choice("DIKR"), rng.choice(made[-3:] + made[:2])))
    one = {str(a): a for a in made}
    for x, a in one.items():
        for y, b in one.items():
            if x != y and not x.startswith(y) and not y.startswith(x):
                shared = len(os.path.commonprefix([x, y]))
                if a.cut(shared) is b.cut(shared):
                    assert (a < b) == (x < y)
            elif x != y:
                short, long = (a, b) if len(x) < len(y) else (b, a)
                if long.cut(short.length) is short:
                    assert short < long and not long < short


def test_no_conversations(spark):
    none = conversations.damage(odd_conversations(spark).limit(0))
    repairs = conversations.find_repairs(none, copies_col="copies")
    assert conversations.repaired_digests(none, repairs, copies_col="copies").collect() == []
    assert conversations.repaired_turns(none, repairs, copies_col="copies").collect() == []


def test_chunks_of_letters_are_kept_once():
    encoder = token_files.LibraryEncoder(BPE)
    texts = ["one two three, two", "four three two."]
    assert [np.frombuffer(x, encoder.kind).tolist() for x in encoder.encode(texts)] == [library_ids(t)[:-1] for t in texts]
    assert "two" in encoder.chunks.young and set(encoder.pieces.young) == {" three", ",", " two", "."}
    encoder = token_files.LibraryEncoder(BPE)
    encoder.encode(["one two"])
    assert not encoder.pieces.young


AMID_SPACE = ["a \xa0 \xa0", " \xa0 \xa0 \xa0b", "a\xa0 \xa0 \xa0 c", "a\n \nb", "a\n \n", "a \n b", "a \n", "a\0b c", " \0"]


def test_spaces_amid_white_space_are_encoded_as_the_library_does():
    want = [library_ids(t)[:-1] for t in AMID_SPACE]
    files, packer, counts = token_files.LibraryEncoder(BPE), packing.Encoder(BPE), token_counts.MergeTable(BPE)
    assert [np.frombuffer(x, files.kind).tolist() for x in files.encode(AMID_SPACE)] == want
    assert [np.frombuffer(packer.encode(t), packer.kind).tolist() for t in AMID_SPACE] == want
    assert [counts.count(t) for t in AMID_SPACE] == list(map(len, want))


def test_random_texts_are_encoded_as_the_library_does():
    rng = random.Random(5)
    parts = [" ", " ", "\n", "\xa0", "\t", "a", "Bé", "12", "'s", "'ll", "'", "!?", "日", "\0", "<|endoftext|>"]
    some = lambda k: "".join(rng.choices(parts, [9, 9, 4, 4, 2, 9, 4, 4, 2, 2, 2, 4, 1, k, k], k=rng.randrange(12)))
    texts = ["q a\n", " b", "c\n d", "e \nf", *(some(k) for k in (0, 1) for _ in range(3000))]
    want = [e.ids for e in Tokenizer.from_file(BPE).encode_batch(texts, add_special_tokens=False)]
    files, packer, counts = token_files.LibraryEncoder(BPE), packing.Encoder(BPE), token_counts.MergeTable(BPE)
    assert [np.frombuffer(x, files.kind).tolist() for x in files.encode(texts)] == want
    assert [np.frombuffer(x, files.kind).tolist() for t in texts for x in files.encode([t])] == want
    assert [np.frombuffer(packer.encode(t), packer.kind).tolist() for t in texts] == want
    assert [counts.count(t) for t in texts] == list(map(len, want))


def test_pretokens_are_asked_for_many_at_a_time(monkeypatch):
    encoder, asked = token_files.LibraryEncoder(BPE), []
    library = encoder.of_pieces

    class Counted:
        def __getattr__(self, name):
            return lambda texts, **more: asked.extend([texts] if isinstance(texts, str) else texts) or getattr(library, name)(texts, **more)

    monkeypatch.setattr(encoder, "of_pieces", Counted())
    texts = [" ".join(f"{a}{b}x é{b}{a}?! {a}\n{b}" for b in "abcdefghijklmnopqrst") for a in "ABCDEFGHIJKLMNOPQRST"]
    assert [np.frombuffer(x, encoder.kind).tolist() for x in encoder.encode(texts)] == [library_ids(t)[:-1] for t in texts]
    assert 0 < len(asked) < 10


def test_texts_are_grouped_by_their_bytes(monkeypatch):
    monkeypatch.setattr(token_files, "GROUP_BYTES", 10)
    texts = ["abc", None, "d" * 35, "", "éé", "f" * 9, None]
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(8)), "text": pa.array(["sliced off", *texts])}).slice(1)
    parts = [b.column(1).to_pylist() for b in token_files.groups(batch)]
    assert [t for p in parts for t in p] == texts and list(map(len, parts)) == [2, 2, 1, 2]
    assert [b.num_rows for b in token_files.groups(batch.slice(7))] == [0]
