"""Language identification by segmentation-marginalised unigrams.

A fixed public piece vocabulary gives the units; each language has a probability for
every piece. A word's probability in a language is the sum over all of its segmentations
into pieces of the product of piece probabilities, found by a forward pass; a text's is
the product over its words. Piece probabilities come from expectation maximisation: each
round is a Spark job over distinct (language, word, count) rows that sums expected piece
counts from forward and backward passes. Characters outside the vocabulary are spelled
in the vocabulary's byte pieces, so every string has a probability.

A word is a run of letters (Unicode L) of the lower-cased text, of any length, with the
vocabulary's word-start mark before it. Sums of products of words up to PLAIN characters
are taken as they are; longer ones, and those that come near to vanishing, in logarithms.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import settle, table

START = "▁"
PLAIN = 48  # characters of a word whose sums are plain products
TINY = 1e-200  # plain sums below this are taken anew in logarithms
#: Documents a language for fitting, in expectation: a hash of the id picks them. The only bound.
TRAIN_DOCS = 1000
ROUNDS = 2
SMOOTH = 0.05
CACHE_ENTRIES = 400_000
BATCH_BYTES = 6_000_000  # of text that is split at once
RUN = regex.compile(r"\p{L}+")


class Pieces:
    """The vocabulary: a number for each piece, byte pieces for what it lacks."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.number: dict[str, int] = {}
        self.byte = [0] * 256
        for i in range(sp.get_piece_size()):
            if sp.is_byte(i):
                self.byte[int(sp.id_to_piece(i)[3:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                self.number[sp.id_to_piece(i)] = i
        self.size = sp.get_piece_size()
        self.longest = max(map(len, self.number), default=1)
        self.spans = lru_cache(PLAIN + 1)(self._spans)

    def _spans(self, n: int) -> tuple[list[tuple[int, int]], list[list[tuple[int, int]]]]:
        """All (start, end) of pieces in n characters, and for each end its (start, column)."""
        pairs = [(i, j) for j in range(1, n + 1) for i in range(max(0, j - self.longest), j)]
        ends: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        for c, (i, j) in enumerate(pairs):
            ends[j].append((i, c))
        return pairs, ends

    def words(self, text: str) -> list[str]:
        return [START + run for run in RUN.findall(text)]

    def columns(self, words: list[str], n: int, extra: dict[str, int]) -> np.ndarray:
        """Piece numbers of all spans of words of n characters; size: none; above: a spelled character."""
        pairs, _ = self.spans(n)
        get, none = self.number.get, self.size
        out = np.array([[get(w[i:j], none) for i, j in pairs] for w in words], np.int64).reshape(len(words), len(pairs))
        for c, (i, j) in enumerate(pairs):
            if j == i + 1:
                for k in np.flatnonzero(out[:, c] == none):
                    out[k, c] = self.size + 1 + extra.setdefault(words[k][i], len(extra))
        return out

    def table(self, probs: np.ndarray, extra: dict[str, int]) -> np.ndarray:
        """probs (size, languages) with a zero row, and a row for each spelled character."""
        spelled = [np.prod(probs[[self.byte[x] for x in c.encode("utf-8", "surrogatepass")]], axis=0) for c in extra]
        return np.vstack([probs, np.zeros((1, probs.shape[1])), *spelled])

    def forward(self, columns: np.ndarray, full: np.ndarray, n: int) -> np.ndarray:
        """Forward sums (n + 1, words, languages)."""
        _, ends = self.spans(n)
        a = np.zeros((n + 1, len(columns), full.shape[1]))
        a[0] = 1
        for j in range(1, n + 1):
            for i, c in ends[j]:
                a[j] += a[i] * full[columns[:, c]]
        return a


    def log_pieces(self, word: str, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each end in a word and each length back from it: the piece (size: none; above: a spelled character), its log probabilities, from those known of pieces."""
        n, back = len(word), min(self.longest, len(word))
        number = np.full((n + 1, back), self.size, np.int64)
        logs = np.full((n + 1, back, known.shape[1]), -np.inf)
        get = self.number.get
        for j in range(1, n + 1):
            for k in range(min(back, j)):
                if (found := get(word[j - 1 - k:j])) is not None:
                    number[j, k], logs[j, k] = found, known[found]
            if number[j, 0] == self.size:
                number[j, 0] = self.size + 1
                logs[j, 0] = known[[self.byte[x] for x in word[j - 1].encode("utf-8", "surrogatepass")]].sum(axis=0)
        return number, logs


def log_forward(logs: np.ndarray) -> np.ndarray:
    """Log forward sums (n + 1, languages) from log_pieces' logs; a window of the longest piece is all that a step needs."""
    n, back, languages = len(logs) - 1, logs.shape[1], logs.shape[2]
    a = np.full((n + 1, languages), -np.inf)
    a[0] = 0
    for j in range(1, n + 1):
        k = min(back, j)
        a[j] = np.logaddexp.reduce(a[j - k:j][::-1] + logs[j, :k], axis=0)
    return a


def log_backward(logs: np.ndarray) -> np.ndarray:
    """Log backward sums, likewise."""
    n, back, languages = len(logs) - 1, logs.shape[1], logs.shape[2]
    b = np.full((n + 1, languages), -np.inf)
    b[n] = 0
    for i in range(n - 1, -1, -1):
        ends = np.arange(i + 1, min(i + back, n) + 1)
        b[i] = np.logaddexp.reduce(b[ends] + logs[ends, ends - i - 1], axis=0)
    return b


@lru_cache(1)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def by_length(words: list[str], most: int) -> tuple[list[tuple[int, list[int]]], list[int]]:
    """Places of words of the same length, at most `most` at once, and those of words too long for plain sums."""
    by: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        by.setdefault(len(w), []).append(k)
    return [(n, ks[at:at + most]) for n, ks in by.items() if n <= PLAIN for at in range(0, len(ks), most)], [k for n, ks in by.items() if n > PLAIN for k in ks]


def log_words(p: Pieces, words: list[str], probs: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language."""
    out = np.zeros((len(words), probs.shape[1]))
    groups, left = by_length(words, 4096)
    for n, some in groups:
        extra: dict[str, int] = {}
        columns = p.columns([words[k] for k in some], n, extra)
        got = p.forward(columns, p.table(probs, extra), n)[n]
        small = (got < TINY).any(axis=1)
        left += [k for k, x in zip(some, small.tolist()) if x]
        out[some] = np.log(np.maximum(got, TINY))
    known = np.log(probs) if left else None
    for k in left:
        out[k] = log_forward(p.log_pieces(words[k], known)[1])[-1]
    return out


def expected(p: Pieces, words: list[str], counts: np.ndarray, probs: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in counted words, under one language's probabilities."""
    total = np.zeros(p.size)
    groups, left = by_length(words, 2048)
    for n, some in groups:
        pairs, ends = p.spans(n)
        extra: dict[str, int] = {}
        columns = p.columns([words[k] for k in some], n, extra)
        full = p.table(probs[:, None], extra)
        a = p.forward(columns, full, n)[:, :, 0]
        b = np.zeros_like(a)
        b[n] = 1
        use = full[columns, 0]
        for j in range(n, 0, -1):
            for i, c in ends[j]:
                b[i] += use[:, c] * b[j]
        small = a[n] < TINY
        left += [k for k, x in zip(some, small.tolist()) if x]
        weight = np.where(small, 0, counts[some] / np.maximum(a[n], TINY))
        for c, (i, j) in enumerate(pairs):
            got = a[i] * use[:, c] * b[j] * weight
            one = columns[:, c]
            known = one < p.size
            total += np.bincount(one[known], got[known], p.size)
            for k in np.flatnonzero(one > p.size):
                for x in words[some[k]][i].encode("utf-8", "surrogatepass"):
                    total[p.byte[x]] += got[k]
    known = np.log(probs[:, None]) if left else None
    for k in left:
        number, logs = p.log_pieces(words[k], known)
        a, b = log_forward(logs)[:, 0], log_backward(logs)[:, 0]
        for j, back in zip(*np.nonzero(number != p.size)):
            got = counts[k] * np.exp(a[j - 1 - back] + logs[j, back, 0] + b[j] - a[-1])
            if number[j, back] < p.size:
                total[number[j, back]] += got
            else:
                for x in words[k][j - 1].encode("utf-8", "surrogatepass"):
                    total[p.byte[x]] += got
    return total


class Model:
    """Languages, their log priors, and piece probabilities (pieces, languages)."""

    def __init__(self, languages: list[str], priors: np.ndarray, probs: np.ndarray):
        self.languages, self.priors, self.probs = languages, priors, probs


def fit(docs: DataFrame, vocabulary: str, *, id_col="doc_id", text_col="text", lang_col="lang", train_docs: int = TRAIN_DOCS, rounds: int = ROUNDS) -> Model:
    """Fit on a bounded sample of the labelled rows of docs, about train_docs a language.

    Rows without an id, a text or a language are left out; repeated rows count as often
    as they are. An empty table gives a model that knows no language.

    The model is at most languages x vocabulary numbers, whatever the size of docs.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    found = {r[0]: r[1] for r in labelled.groupBy(lang_col).count().collect()}
    languages = sorted(found)
    p = pieces(vocabulary)
    probs = np.ones((p.size, len(languages)))
    if not languages:
        return Model([], np.zeros(0), probs)
    priors = np.log(np.array([found[x] for x in languages], float) / sum(found.values()))
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, train_docs / found[k]))])
    drawn = labelled.where(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 30)) < F.lit(1 << 30) * share[F.col(lang_col)])
    chunk = F.explode(F.split(F.lower(text_col), r"\s+"))
    words = settle(drawn.select(F.col(lang_col).alias("lang"), chunk.alias("chunk")).groupBy("lang", "chunk").count(), "words")
    for j in range(len(languages)):
        for piece, i in p.number.items():
            probs[i, j] = 4.0 ** -len(piece)  # before any data, long pieces are as likely as their letters
    probs /= probs.sum(axis=0)
    for _ in range(rounds):
        shared = docs.sparkSession.sparkContext.broadcast((languages, probs))

        def run(batches, shared=shared):
            names, now = shared.value
            q = pieces(vocabulary)
            sums = {}
            held: dict[str, tuple[list[str], list[int]]] = {}

            def add(lang):
                ws, ns = held.pop(lang)
                sums[lang] = sums.get(lang, 0) + expected(q, ws, np.array(ns, float), now[:, names.index(lang)])

            for b in batches:
                for lang, chunk, n in zip(*(c.to_pylist() for c in b.columns)):
                    into = held.setdefault(lang, ([], []))
                    for w in q.words(chunk):
                        into[0].append(w)
                        into[1].append(n)
                    if len(into[0]) > 200_000:
                        add(lang)
            for lang in list(held):
                add(lang)
            for lang, got in sums.items():
                at = np.flatnonzero(got)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(got[at], pa.float64())], names=["lang", "piece", "n"])

        got = words.mapInArrow(run, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros_like(probs)
        column = {x: j for j, x in enumerate(languages)}
        counts[got.column("piece").to_numpy(), [column[x] for x in got.column("lang").to_pylist()]] = got.column("n").to_numpy()
        shared.unpersist()
        probs = (counts + SMOOTH) / (counts.sum(axis=0) + SMOOTH * p.size)
    return Model(languages, priors, probs)


class _Chunks(dict):
    """The row of each chunk's log probabilities in a growing table."""

    def __init__(self, p: Pieces, model: Model):
        self.p, self.model = p, model
        self.rows = np.zeros((1 << 12, len(model.languages)))

    def learn(self, chunks: set[str]) -> None:
        new = [c for c in chunks if c not in self]
        if len(self) + len(new) > CACHE_ENTRIES and len(self):
            self.clear()
            new = list(chunks)
        ends, words = [], []
        for c in new:
            words += self.p.words(c)
            ends.append(len(words))
        got = np.vstack([np.zeros((1, len(self.model.languages))), np.cumsum(log_words(self.p, words, self.model.probs), axis=0)]) if words else np.zeros((1, len(self.model.languages)))
        at = len(self)
        while len(self.rows) < at + len(new):
            self.rows = np.vstack([self.rows, np.zeros_like(self.rows)])
        e = np.array(ends, int)
        if len(new):
            self.rows[at:at + len(new)] = got[e] - got[np.concatenate([[0], e[:-1]])]
        self.update((c, at + k) for k, c in enumerate(new))


def predict(docs: DataFrame, model: Model, vocabulary: str, *, id_col="doc_id", text_col="text") -> DataFrame:
    """(id_col, lang_pred, score): the likeliest language of every whole text, and its posterior.

    One narrow pass. `und` with score 0 where the text is null, empty or has no letter, or
    the model knows no language. Ties go to the first language by name. Repeated rows come
    out once each; other columns are left out; an empty table gives an empty one.
    """
    schema = docs.select(id_col).schema.add("lang_pred", "string").add("score", "double")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        chunks = _Chunks(pieces(vocabulary), m)
        for whole in batches:
            long = np.add.accumulate(np.asarray(pc.fill_null(pc.binary_length(whole.column(1)), 0), np.int64)) // BATCH_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(long)) + 1).tolist(), whole.num_rows]
            for at, end in zip(cuts, cuts[1:]):
                b = whole.slice(at, end - at)
                texts = [(t or "").lower().split() for t in b.column(1).to_pylist()]
                out = []
                if m.languages:
                    chunks.learn(set().union(*texts))
                for t in texts:
                    if not m.languages or not any(map(RUN.search, t)):
                        out.append(("und", 0.0))
                        continue
                    total = chunks.rows[np.fromiter(map(chunks.__getitem__, t), np.int64, len(t))].sum(axis=0) + m.priors
                    k = int(total.argmax())
                    out.append((m.languages[k], 1.0 / float(np.exp(np.maximum(total - total[k], -700)).sum())))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.float64())],
                    names=[id_col, "lang_pred", "score"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def op1_language_id(spark, sf_dir):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents")
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = fit(docs.where(~out), path)
    return predict(docs, model, path).select("doc_id", out.alias("held_out"), "lang_pred", "score")
