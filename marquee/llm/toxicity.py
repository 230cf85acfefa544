"""Toxicity by a classifier chain.

Categories are predicted one after another by linear models over hashed word features;
a later model also gets the earlier categories' probabilities. It is trained with those
that models fitted without the document's fold gave (out-of-fold), so that it sees what
it will see at prediction. Copies of a text are always in one fold.

Fitting uses a bounded sample of labelled rows, each text once. Features that go with a category beyond
chance are chosen by counts summed in Spark; only the chosen ones of the sample's
documents reach the driver. Prediction is one narrow pass over whole texts.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import settle, table

SPACE = 1 << 20  # hashed features
TRAIN_DOCS = 12_000  # labelled documents for fitting, in expectation: a hash of the id picks them
FEATURES = 20_000  # chosen features of a category
EVIDENCE = 4.0  # least z-score of a chosen feature
FOLDS = 3
RUN = re.compile(r"[^\W\d_]+")
CACHE_ENTRIES = 200_000
ROWS = 500  # texts whose features are held at a time


def sliced(batches):
    """The batches in pieces of ROWS rows."""
    return (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS))


def features(chunk: str) -> set[int]:
    """Hashed features of a chunk between white space: whole words, their first 4 and 5 letters besides (as stems), and all that isn't a letter, joined."""
    found = RUN.findall(chunk.lower())
    names = [*found, *(f"{w[:k]}~" for w in found for k in (4, 5) if len(w) > k)]
    if rest := RUN.sub("", chunk):
        names.append(f" {rest}")
    return {zlib.crc32(n.encode("utf-8", "surrogatepass")) % SPACE for n in names}


class _Chunks(dict):
    """Features of chunks, as places among the chosen ones if given."""

    def __init__(self, place: dict[int, int] | None = None):
        self.place = place

    def __missing__(self, chunk: str):
        got = features(chunk)
        out = tuple(got) if self.place is None else tuple(self.place[x] for x in got if x in self.place)
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        if len(chunk) <= 64:
            self[chunk] = out
        return out

    def of(self, text: str | None) -> set[int]:
        return set().union(*map(self.__getitem__, set((text or "").split())))


def sparse_dot(rows: np.ndarray, cols: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, w[cols], n)


def fit_linear(rows, cols, extra, y, width: int, *, ridge: float = 0.02, steps: int = 250, rate: float = 0.15) -> tuple[np.ndarray, np.ndarray, float]:
    """Ridge logistic regression by adaptive-moment steps over all rows: weights of features, of extra columns, and the bias."""
    n = len(y)
    if n == 0 or y.min() == y.max():
        return np.zeros(width), np.zeros(extra.shape[1]), -20.0 if n == 0 or y[0] == 0 else 20.0
    theta = np.zeros(width + extra.shape[1] + 1)
    theta[-1] = np.log(y.mean() / (1 - y.mean()))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, steps + 1):
        z = sparse_dot(rows, cols, theta[:width], n) + extra @ theta[width:-1] + theta[-1]
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        grad = np.concatenate([np.bincount(cols, g[rows], width), extra.T @ g, [g.sum()]])
        grad[:-1] += ridge * theta[:-1]
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad * grad
        step = rate * (1 - k / (steps + 1))
        theta -= step * (first / (1 - 0.9 ** k)) / (np.sqrt(second / (1 - 0.99 ** k)) + 1e-8)
    return theta[:width], theta[width:-1], float(theta[-1])


def probabilities(rows, cols, extra, n: int, model) -> np.ndarray:
    w, v, bias = model  # of features, of earlier categories, of neither
    z = sparse_dot(rows, cols, w, n) + extra @ v + bias
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Chain:
    """Categories in order, the chosen features, and a linear model a category."""

    def __init__(self, categories: list[str], chosen: np.ndarray, models: list):
        self.categories, self.chosen, self.models = categories, chosen, models

    def predict(self, rows, cols, n: int) -> np.ndarray:
        out = np.zeros((n, 0))
        for m in self.models:
            out = np.column_stack([out, probabilities(rows, cols, 4 * out - 2, n, m)])
        return out


def fit_chain(docs: DataFrame, labels: DataFrame, categories: list[str], *, id_col="doc_id", text_col="text", train_docs: int = TRAIN_DOCS) -> Chain:
    """Fit on a bounded sample of labelled documents; labels has id_col and a 0/1 column a category.

    Rows of labels with a null are left out; of repeated ids the largest label counts.
    A category without both values gets a constant model.
    """
    labels = labels.dropna(subset=[id_col, *categories]).groupBy(id_col).agg(*[F.max(F.col(c).cast("int")).alias(f"y{k}") for k, c in enumerate(categories)])
    total = labels.count()
    share = min(1.0, train_docs / max(1, total))
    drawn = labels.where(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    ys = [f"y{k}" for k in range(len(categories))]
    sample = settle(docs.select(F.col(id_col), F.col(text_col).alias("text")).where("text is not null").join(drawn, id_col)
        .groupBy("text").agg(*[F.max(y).alias(y) for y in ys]), "sample")

    def count(batches):
        sums = np.zeros((SPACE, 1 + len(ys)), np.int32)
        chunks = _Chunks()
        for b in sliced(batches):
            for text, *y in zip(*(c.to_pylist() for c in b.columns)):
                sums[list(chunks.of(text))] += np.array([1, *y], np.int32)
        at = np.flatnonzero(sums[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(sums[at, k]) for k in range(1 + len(ys)))], names=["f", "n", *ys])

    sizes = sample.agg(F.count("*"), *[F.sum(y) for y in ys]).first()
    n = sizes[0]
    sums = sample.mapInArrow(count, ", ".join(["f int", "n int", *(f"{y} int" for y in ys)])).groupBy("f").agg(F.sum("n").alias("n"), *[F.sum(y).alias(y) for y in ys]).where("n >= 3")
    chosen: set[int] = set()
    sums = settle(sums, "features")
    for k, y in enumerate(ys):
        p = (sizes[1 + k] or 0) / max(1, n)
        z = (F.col(y) - F.col("n") * p) / F.sqrt(F.col("n") * p * (1 - p) + 1e-9)
        chosen |= {r[0] for r in sums.select("f", z.alias("z")).where(F.col("z") >= EVIDENCE).orderBy(F.desc("z"), "f").limit(FEATURES).collect()}
    picked = np.array(sorted(chosen), np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(picked)

    def pick(batches):
        chunks = _Chunks({int(f): k for k, f in enumerate(shared.value)})
        for b in sliced(batches):
            texts = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([sorted(chunks.of(t)) for t in texts], pa.list_(pa.int32())), pa.array([zlib.crc32(t.encode()) % FOLDS for t in texts], pa.int32()), *b.columns[1:]],
                names=["fs", "fold", *ys])

    got = sample.mapInArrow(pick, ", ".join(["fs array<int>", "fold int", *(f"{y} int" for y in ys)])).toArrow().combine_chunks()
    lists = got.column("fs").combine_chunks()
    lengths = np.asarray(lists.value_lengths())
    cols = np.asarray(lists.flatten()).astype(np.int64)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    fold = np.asarray(got.column("fold"))
    earlier = np.zeros((len(lengths), 0))  # out-of-fold probabilities of the categories so far
    models = []
    for y in ys:
        target = np.asarray(got.column(y)).astype(float)
        extra = 4 * earlier - 2
        models.append(fit_linear(rows, cols, extra, target, len(picked)))
        mine = np.zeros(len(lengths))
        for k in range(FOLDS):
            inside = fold != k
            number = np.cumsum(inside) - 1
            some = inside[rows]
            m = fit_linear(number[rows[some]], cols[some], extra[inside], target[inside], len(picked))
            mine[~inside] = probabilities(rows, cols, extra, len(lengths), m)[~inside]
        earlier = np.column_stack([earlier, mine])
    return Chain(categories, picked, models)


def score_chain(docs: DataFrame, chain: Chain, *, id_col="doc_id", text_col="text") -> DataFrame:
    """(id_col, p_<category>...) of every whole text, in one narrow pass.

    Null and empty texts, and ones without a chosen feature, get each model's bias alone.
    Repeated rows come out once each; other columns are left out; an empty table gives an
    empty one.
    """
    schema = docs.select(id_col).schema
    for c in chain.categories:
        schema = schema.add(f"p_{c}", "double")
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches):
        m = shared.value
        chunks = _Chunks({int(f): k for k, f in enumerate(m.chosen)})
        for b in sliced(batches):
            fs = [chunks.of(t) for t in b.column(1).to_pylist()]
            lengths = np.fromiter(map(len, fs), np.int64, len(fs))
            cols = np.fromiter((x for f in fs for x in sorted(f)), np.int64, int(lengths.sum()))
            p = m.predict(np.repeat(np.arange(len(fs)), lengths), cols, len(fs))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(p[:, k]) for k in range(len(m.categories)))], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def keep_clean(docs: DataFrame, chain: Chain, category: str, *, text_col="text", most: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose probability of the category is below most. One narrow pass.

    Each row is judged by its own text: null and empty texts by each model's bias alone;
    repeated rows, null ids and columns of any name come through as they are. An empty
    table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    at, k = docs.columns.index(text_col), chain.categories.index(category)

    def run(batches):
        m = shared.value
        chunks = _Chunks({int(f): k for k, f in enumerate(m.chosen)})
        for b in sliced(batches):
            fs = [sorted(chunks.of(t)) for t in b.column(at).to_pylist()]
            rows = np.repeat(np.arange(len(fs)), np.fromiter(map(len, fs), np.int64, len(fs)))
            p = m.predict(rows, np.fromiter((x for f in fs for x in f), np.int64, len(rows)), len(fs))
            yield b.filter(pa.array(p[:, k] < most))

    return docs.mapInArrow(run, docs.schema)


def production_chain(spark, sf_dir: str) -> Chain:
    """Junk before toxic, fitted on the labelled documents of the tables in sf_dir.

    Labels with a null, and of no document, are left out; with none left, nothing is
    junk or toxic.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("junk"), "toxic")
    return fit_chain(table(spark, sf_dir, "documents"), labels, ["junk", "toxic"])


def op8_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score_chain(docs, production_chain(spark, sf_dir)).withColumn("toxic", F.col("p_toxic") >= 0.5)
