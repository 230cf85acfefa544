"""Token ids in Arrow files of equal-length sequences.

Documents are range-sorted by id, encoded by the tokenizers library and written one behind
another. A file is an Arrow stream in the file format: batches of BATCH sequences, each
`length` ids as a fixed-size list, a fixed-size list of flags that tell ids from padding,
and the documents that end in the sequence with the place of their last id. Buffers aren't
compressed, so sequence k of a mapped file is a view of its bytes: batch k // BATCH, row
k % BATCH. Only a file's last sequence is padded; a document's ids run on over sequences,
never over files.

A task writes to a name of its own and its row of the manifest names it. The manifest is a
settled table, so files of failed or doubled attempts are never listed.
"""

from __future__ import annotations

import gc
import os
import uuid
import zlib
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from marquee.llm.common import local_rows, settle, shared_dir, table
from marquee.llm.token_counts import PATTERN, UNEVEN

BATCH = 256  # sequences of a record batch
CACHE_ENTRIES = 150_000  # of a generation
GROUP_BYTES = 8_000_000  # of texts whose chunks are looked up together
PIECES, DIVIDER = 500, "\0"  # asked for in one text, and what stands between them
CACHE_CHARS = 8_000_000  # that came into a generation
MANIFEST = "part int, path string, n_documents long, n_tokens long"


def cut(raw: bytes, ends: np.ndarray) -> list[bytes]:
    ends = ends.tolist()
    return [raw[a:b] for a, b in zip([0, *ends], ends)]


class Recent:
    """What was met lately, in two generations: the elder goes once the younger is full."""

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.chars = 0

    def missing(self, keys: Iterable[str]) -> list[str]:
        """Those of the distinct keys that aren't held; the others are young from now on."""
        if len(self.young) > CACHE_ENTRIES or self.chars > CACHE_CHARS:
            self.young, self.old, self.chars = {}, self.young, 0
        young, old = self.young, self.old
        out = [k for k in keys if k not in young]
        if old:
            young.update([(k, old[k]) for k in out if k in old])
            out = [k for k in out if k not in old]
        self.chars += sum(map(len, out))
        return out


class LibraryEncoder:
    """Ids as the tokenizers library gives them; each pre-token is asked for once.

    A chunk between spaces, with the space before it, is split and merged alike wherever
    it stands, and so are its pre-tokens. Texts in which a space stands amid white space or
    at the end (UNEVEN), or that hold a special string or DIVIDER, go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        from tokenizers import Tokenizer, pre_tokenizers

        self.library, self.of_pieces = Tokenizer.from_file(path), Tokenizer.from_file(path)
        if not isinstance(self.library.pre_tokenizer, pre_tokenizers.ByteLevel):
            raise ValueError(f"{path} is no byte-level vocabulary")
        self.of_pieces.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.CharDelimiterSplit(DIVIDER), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.kind = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.apart = [DIVIDER, *(t.content for t in self.library.get_added_tokens_decoder().values())]
        # DIVIDER is a match of its own, and stands for the end of the text to what is before it
        self.pattern = regex.compile(PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[^\s\p{{L}}\p{{N}}{DIVIDER}]").replace(r"(?!\S)", rf"(?![^\s{DIVIDER}])") + f"|{DIVIDER}")
        self.chunks, self.pieces = Recent(), Recent()

    def asked(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def asked_pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of each pre-token. PIECES of them are asked for as one text, as an answer of its own costs more than a pre-token's merges."""
        out = []
        for at in range(0, len(pieces), PIECES):
            some = pieces[at:at + PIECES]
            e = self.of_pieces.encode(DIVIDER.join(some), add_special_tokens=False)
            raw = np.array(e.ids, self.kind).tobytes()
            out += cut(raw, np.cumsum(np.bincount(np.array(e.word_ids, np.int64), minlength=len(some))) * self.kind.itemsize)
        return out

    def split(self, chunks: list[str]) -> tuple[list[str], list[int]]:
        """Pre-tokens of all chunks, each with the space before it, and how many there are up to each chunk's end."""
        pieces = self.pattern.findall("".join([f" {c}{DIVIDER}" for c in chunks]))
        ends = [k for k, p in enumerate(pieces) if p == DIVIDER]
        return [p for p in pieces if p != DIVIDER], [k - i for i, k in enumerate(ends)]

    def learn(self, chunks: list[str]) -> list[bytes]:
        """The ids of each of these distinct chunks. A chunk of letters is one pre-token with its space, so pieces hold what only others have."""
        new = self.chunks.missing(chunks)
        young = self.chunks.young
        words, others = [c for c in new if c.isalpha()], [c for c in new if not c.isalpha()]
        young.update(zip(words, self.asked_pieces([" " + c for c in words])))
        if others:
            parts, ends = self.split(others)
            missing = self.pieces.missing(set(parts))
            pieces = self.pieces.young
            # a chunk's ids are those with its space
            pieces.update([(p, young[p[1:]]) for p in missing if p[0] == " " and p[1:] in young])
            unknown = [p for p in missing if p not in pieces]
            pieces.update(zip(unknown, self.asked_pieces(unknown)))
            ids = list(map(pieces.__getitem__, parts))
            young.update(zip(others, cut(b"".join(ids), np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))[np.array(ends) - 1])))
        return list(map(young.__getitem__, chunks))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of texts, which are held together: write_token_files gives some GROUP_BYTES."""
        whole = [t for t in texts if UNEVEN.search(t) or any(s in t for s in self.apart)]
        by_text = dict(zip(whole, self.asked(whole))) if whole else {}
        ids = iter(self.joined([t for t in texts if t not in by_text]))
        return [by_text[t] if t in by_text else next(ids) for t in texts]

    def joined(self, texts: list[str]) -> list[bytes]:
        """The ids of texts from those of their chunks: each distinct chunk is looked up once, and its ids are copied to its places."""
        if not texts:
            return []
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        ends = lists.offsets.to_numpy()
        coded = lists.values.dictionary_encode()
        place = coded.indices.to_numpy().copy()
        gc.disable()  # the lists of pieces are many and hold no cycles
        try:
            known = self.learn(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        finally:
            gc.enable()
        # a text's first chunk has no space before it
        first = coded.dictionary.take(pa.array(place[ends[:-1]])).dictionary_encode()
        heads = first.dictionary.to_pylist()
        place[ends[:-1]] = len(known) + first.indices.to_numpy()
        known += [ids if h else b"" for h, ids in zip(heads, self.asked(heads))]
        raw = np.frombuffer(b"".join(known), self.kind)
        size = np.fromiter(map(len, known), np.int64, len(known)) // self.kind.itemsize
        start = np.cumsum(size) - size
        out = []
        for a, b in zip(ends.tolist(), ends[1:].tolist()):
            mine = place[a:b]
            n = size[mine]
            past = np.cumsum(n)
            out.append(raw[np.repeat(start[mine] - past + n, n) + np.arange(past[-1])].tobytes())
        return out


def groups(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
    """Slices of a batch of ids and texts: some GROUP_BYTES of text each, or one longer text with others."""
    held = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    starts = [0, *(np.flatnonzero(np.diff(held // GROUP_BYTES)) + 1).tolist(), batch.num_rows]
    return [batch.slice(a, b - a) for a, b in zip(starts, starts[1:])]


@lru_cache(1)
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def file_schema(id_type: pa.DataType, kind: np.dtype, length: int) -> pa.Schema:
    return pa.schema([
        ("ids", pa.list_(pa.from_numpy_dtype(kind), length)),
        ("mask", pa.list_(pa.bool_(), length)),
        ("documents", pa.list_(pa.struct([("id", id_type), ("end", pa.int32())]))),
    ])


class SequenceWriter:
    """One file: documents go in by `add`, batches go out as they fill; holds one batch."""

    def __init__(self, sink, id_type: pa.DataType, kind: np.dtype, length: int):
        self.schema, self.kind, self.length = file_schema(id_type, kind, length), kind, length
        self.out = pa.ipc.new_file(sink, self.schema)
        self.block = np.zeros(BATCH * length, kind)
        self.fill, self.ends = 0, []
        self.n_documents = self.n_tokens = 0

    def add(self, document, ids: np.ndarray) -> None:
        """ids holds one number at least."""
        at = 0
        while at < len(ids):
            take = min(len(self.block) - self.fill, len(ids) - at)
            self.block[self.fill:self.fill + take] = ids[at:at + take]
            at, self.fill = at + take, self.fill + take
            if at == len(ids):
                self.ends.append((document, self.fill - 1))
            if self.fill == len(self.block):
                self.flush()
        self.n_documents, self.n_tokens = self.n_documents + 1, self.n_tokens + len(ids)

    def flush(self) -> None:
        if not self.fill:
            return
        rows = -(-self.fill // self.length)
        self.block[self.fill:] = 0
        mask = np.arange(rows * self.length) < self.fill
        place = np.array([e for _, e in self.ends], np.int64)
        offsets = np.searchsorted(place, np.arange(rows + 1) * self.length)
        ends = pa.StructArray.from_arrays(
            [pa.array([d for d, _ in self.ends], self.schema.field("documents").type.value_type.field("id").type), pa.array((place % self.length).astype(np.int32))], names=["id", "end"])
        self.out.write_batch(pa.RecordBatch.from_arrays([
            pa.FixedSizeListArray.from_arrays(pa.array(self.block[:rows * self.length]), self.length),
            pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length),
            pa.ListArray.from_arrays(offsets.astype(np.int32), ends),
        ], schema=self.schema))
        self.block = np.zeros_like(self.block)
        self.fill, self.ends = 0, []

    def close(self) -> None:
        self.flush()
        self.out.close()


class SequenceFile:
    """Random access to a file's sequences; views of the mapped bytes where the file is local."""

    def __init__(self, uri: str):
        system, path = pyarrow.fs.FileSystem.from_uri(uri)
        self.source = pa.memory_map(path) if isinstance(system, pyarrow.fs.LocalFileSystem) else system.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("ids").type.list_size

    def __len__(self) -> int:
        n = self.file.num_record_batches
        return (n - 1) * BATCH + self.file.get_batch(n - 1).num_rows if n else 0

    def __getitem__(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, mask) of sequence k; ids is a view."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        batch, row = self.file.get_batch(k // BATCH), k % BATCH
        return batch.column(0)[row].values.to_numpy(), batch.column(1)[row].values.to_numpy(zero_copy_only=False)

    def documents(self):
        """(id, first, n, crc32 of the ids as little-endian unsigned 32-bit numbers) of each document, in the file's order."""
        base, first, crc = 0, 0, 0
        for b in range(self.file.num_record_batches):
            batch = self.file.get_batch(b)
            ids, mask = batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy(zero_copy_only=False)
            used = int(mask.sum())
            if not mask[:used].all():
                raise ValueError("padding before ids")
            raw = memoryview(ids[:used].astype("<u4").tobytes())
            lists = batch.column(2)
            ended = lists.flatten()
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            at = 0
            for document, end in zip(ended.field(0).to_pylist(), (row * self.length + ended.field(1).to_numpy() + 1).tolist()):
                yield document, first, base + end - first, zlib.crc32(raw[4 * at:4 * end], crc)
                at, first, crc = end, base + end, 0
            crc = zlib.crc32(raw[4 * at:], crc)
            base += used
        if first != base:
            raise ValueError("the last document has no end")


def write_token_files(docs: DataFrame, vocabulary: str, folder: str, *, id_col="doc_id", text_col="text", length: int = 1024, end_id: int = 0) -> DataFrame:
    """Write the ids of all rows, end_id behind each, to files in folder; the manifest (part, path, n_documents, n_tokens).

    folder is a URI that pyarrow.fs knows and all executors reach. Rows stand in
    ascending order of id over the parts, null first; rows of one id in the order of a
    hash of their text. Null and empty texts are end_id alone. Texts count whole, special
    strings inside them as by the library's default. Repeated rows are written once each;
    other columns are left out, so names can't clash. An empty table gives an empty
    manifest and no files. A task holds a batch of sequences and a batch of texts.
    """
    order = [F.col(id_col), F.xxhash64(text_col)]
    ranged = docs.select(id_col, text_col).repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches):
        encoder = library_encoder(vocabulary)
        system, path = pyarrow.fs.FileSystem.from_uri(folder)
        part, writer = TaskContext.get().partitionId(), None
        name = f"{part:06d}-{uuid.uuid4().hex}.arrow"
        end = np.array([end_id], encoder.kind)
        for whole in batches:
            if writer is None and whole.num_rows:
                system.create_dir(path, recursive=True)
                sink = system.open_output_stream(f"{path}/{name}")
                writer = SequenceWriter(sink, whole.schema.field(0).type, encoder.kind, length)
            for b in groups(whole):
                for document, raw in zip(b.column(0).to_pylist(), encoder.encode([t or "" for t in b.column(1).to_pylist()])):
                    writer.add(document, np.concatenate([np.frombuffer(raw, encoder.kind), end]))
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [f"{folder}/{name}"], "n_documents": [writer.n_documents], "n_tokens": [writer.n_tokens]})

    return settle(ranged.mapInArrow(run, MANIFEST), "manifest")


def read_token_files(manifest: DataFrame, id_type) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files; start counts the ids of all before it.

    One task a file. What reaches the driver is a number a file. A file that breaks off
    or holds another number of ids than its manifest says raises an error. An empty
    manifest gives no rows.
    """
    spark, before, bases = manifest.sparkSession, 0, []
    for part, n in sorted(manifest.select("part", "n_tokens").collect()):
        bases.append((part, before))
        before += n
    files = manifest.join(local_rows(spark, bases, part=pa.int32(), base=pa.int64()), "part").select("part", "path", "base", "n_tokens")
    schema = spark.createDataFrame([], manifest.schema).select(F.lit(None).cast(id_type).alias("doc_id")).schema.add("start", "long").add("n_tokens", "long").add("ids_crc32", "long")

    kinds = (to_arrow_type(schema[0].dataType), pa.int64(), pa.int64(), pa.int64())
    make = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=schema.names)

    def run(batches):
        for b in batches:
            for path, base, n_tokens in zip(*(b.column(k).to_pylist() for k in (1, 2, 3))):
                rows, total = [], 0
                file = SequenceFile(path)
                for document, first, n, crc in file.documents():
                    rows.append((document, base + first, n, crc))
                    total += n
                    if len(rows) == 10_000:
                        yield make(rows)
                        rows = []
                if total != n_tokens:
                    raise ValueError(f"{path} holds {total} ids, not {n_tokens}")
                if rows:
                    yield make(rows)

    return files.repartitionByRange(max(1, len(bases)), "part").mapInArrow(run, schema)


def op12_token_files(spark, sf_dir):
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    manifest = write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}")
    return read_token_files(manifest, docs.schema["doc_id"].dataType)
