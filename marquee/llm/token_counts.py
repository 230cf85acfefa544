"""Token counts by byte-pair merging with a heap and a linked list.

For each pre-token the symbols form a doubly linked list; a heap holds adjacent pairs
by (rank, position). The lowest pair is popped and merged until none is left, and the
count is the number of initial symbols less the number of merges: identifiers are
never emitted. Counts are kept per chunk between spaces in a bounded cache, because a
chunk with its leading space is split and merged alike wherever it stands.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import table

#: Fixed value: the published byte-level pre-token pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Spaces that meet, end the text or stand between other white space: a run of it is split by what is behind it, so chunks between spaces don't stand alone.
UNEVEN = re.compile(r" (?: |\Z|(?<=\s )\s)")
CACHE_ENTRIES = 800_000
_MARKS = frozenset(",.;:!?")
CACHE_CHARS = 64  # longer chunks aren't worth keeping


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies, by its published rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class MergeTable:
    """Ranks of symbol pairs. Symbols are numbered: bytes first, then merges by rank."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        number = byte_alphabet()
        self.rank: dict[int, int] = {}
        for k, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[number[left] << 20 | number[right]] = k
            number.setdefault(left + right, 256 + k)
        self.made = [number[a + b] for a, b in (
            p if isinstance(p, list) else p.split(" ") for p in spec["model"]["merges"])]
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.pattern = regex.compile(PATTERN)
        self.chunks = _Chunks(self)

    def merged_length(self, symbols: list[int]) -> int:
        n = len(symbols)
        if n < 2:
            return n
        rank, made = self.rank, self.made
        heap = [r << 32 | i for i in range(n - 1)
                if (r := rank.get(symbols[i] << 20 | symbols[i + 1])) is not None]
        if not heap:
            return n
        heapify(heap)
        after = list(range(1, n + 1))
        ahead = list(range(-1, n - 1))
        merges = 0
        while heap:
            top = heappop(heap)
            i = top & 0xFFFFFFFF
            j = after[i]
            # an entry is stale if its left symbol is gone or the pair there has changed
            if j >= n or symbols[i] < 0 or rank.get(symbols[i] << 20 | symbols[j]) != top >> 32:
                continue
            symbols[i], symbols[j] = made[top >> 32], -1
            merges += 1
            k = after[i] = after[j]
            if k < n:
                ahead[k] = i
                if (r := rank.get(symbols[i] << 20 | symbols[k])) is not None:
                    heappush(heap, r << 32 | i)
            h = ahead[i]
            if h >= 0 and (r := rank.get(symbols[h] << 20 | symbols[i])) is not None:
                heappush(heap, r << 32 | h)
        return n - merges

    def plain(self, text: str) -> int:
        return sum(self.merged_length(list(t.encode())) for t in self.pattern.findall(text))

    def part(self, text: str) -> int:
        """Tokens of text without special strings."""
        if not text:
            return 0
        if UNEVEN.search(text):
            return self.plain(text)
        first, *rest = text.split(" ")
        return (self.plain(first) if first else 0) + sum(map(self.chunks.__getitem__, rest))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or not self.special.search(text):
            return self.part(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.part, parts))


class _Chunks(dict):
    def __init__(self, merges: MergeTable):
        self.merges = merges

    def __missing__(self, chunk: str) -> int:
        # letters alone are one pre-token with their space; a letter run with one mark behind is that and the mark
        if chunk.isalpha():
            n = self.merges.merged_length([32, *chunk.encode()])
        elif chunk[-1:] in _MARKS and chunk[:-1].isalpha():
            n = self[chunk[:-1]] + 1
        else:
            n = self.merges.plain(" " + chunk)
        if len(chunk) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[chunk] = n
        return n


@lru_cache(1)
def merge_table(path: str) -> MergeTable:
    return MergeTable(path)


def count_tokens(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 512) -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit) of every row, by the vocabulary file's merges.

    One narrow pass, no shuffle. Null and empty texts have 0 bytes and 0 tokens; whole
    texts count, however long; repeated rows come out once each; other columns of docs
    are left out, so their names can't clash; an empty table gives an empty one.
    Special strings inside a text are one token each, as the library's default has it.
    """
    schema = docs.select(F.col(id_col)).schema.add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")

    def run(batches):
        merges = merge_table(vocabulary)
        for b in batches:
            texts = b.column(1).to_pylist()
            n = [merges.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()),
                 pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def op2_token_counts(spark, sf_dir):
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
