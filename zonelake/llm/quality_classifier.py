"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network in numpy.

Word vectors: a word has two buckets, one by hash and one by its shape (its last two characters and its first as
classes of letters), and each bucket an index vector of a few random signs. A bucket's vector sums the index vectors
of its words' neighbours within WINDOW words over all documents. The table has a fixed size whatever the vocabulary, and
whole numbers, so sums don't depend on the order of rows; tasks sum their documents, then Spark adds tables row by row. A
document is the mean of its words' unit vectors of both kinds, the mean of their shapes' index vectors (what the words
are, not only where they occur), the share of words that repeat the one before, and the logarithm of their number.

The network (one hidden layer) learns on a sample of at most SAMPLE labelled rows, the smallest by hash of their id,
with a tenth of it left out to fit the temperature that calibrates probabilities by log loss. Language, source, id and
labels of the row are never inputs of its score.

Defined results: null or empty text is a document without words and gets a score as well; a null label isn't learned
from; with labels of one kind only, or none, scores are the share of label 1 (0.5 without any); repeated rows are scored
one by one; repeated labels of an id count again; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonelake.llm.common import crc_mod, text_of, words_of

BUCKETS, DIMENSIONS, NONZERO, WINDOW = 1 << 13, 32, 4, 2
SAMPLE, HIDDEN, EPOCHS, THRESHOLD = 20_000, 32, 60, 0.7
SLICE = 500
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
FEATURES = 3 * DIMENSIONS + 2


def index_vectors() -> np.ndarray:
    """The index vectors of all buckets, from a fixed seed."""
    draw = np.random.default_rng(2)
    out = np.zeros((BUCKETS, DIMENSIONS), np.float32)
    for _ in range(NONZERO):
        out[np.arange(BUCKETS), draw.integers(0, DIMENSIONS, BUCKETS)] += draw.choice(np.float32([-1, 1]), BUCKETS)
    return out


def prepared(docs: DataFrame, text_col: str, *columns: Column) -> DataFrame:
    """The columns, then the buckets of all words by hash (the lower half) and by shape (the upper half)."""
    half = F.lit(BUCKETS // 2)
    by_hash = lambda w: F.pmod(F.xxhash64(w), half).cast("int")
    upper = lambda w: F.when(F.left(w, F.lit(1)) == F.lower(F.left(w, F.lit(1))), 0).otherwise(1)
    by_shape = lambda w: (half + F.pmod(F.xxhash64(F.right(w, F.lit(2)), upper(w)), half)).cast("int")
    rows = docs.select(*columns, words_of(text_of(text_col)).alias("__words"))
    kept = [F.col(c) for c in rows.columns[:-1]]
    return rows.select(*kept, F.transform("__words", by_hash).alias("__hash"), F.transform("__words", by_shape).alias("__shape"))


def arrays(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets by hash and by shape of all words of a batch, and the number of words of each document."""
    last = part.num_columns
    flat = [part.column(i).flatten().to_numpy(zero_copy_only=False) for i in (last - 2, last - 1)]
    return flat[0].astype(np.intp), flat[1].astype(np.intp), part.column(last - 1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def neighbours(values: np.ndarray, same: list[np.ndarray]) -> np.ndarray:
    """For each word the sum of the values of its neighbours; same says which words are in one document with the k-th after them."""
    out = np.zeros_like(values)
    for k, near in enumerate(same, 1):
        out[k:] += values[:-k] * near
        out[:-k] += values[k:] * near
    return out


def word_vectors(docs: DataFrame, text_col: str) -> np.ndarray:
    """The table of all buckets with unit rows, from all documents."""
    names = [f"d{i}" for i in range(DIMENSIONS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One dimension after the other: its values of all buckets, and of a slice's words, fit the caches.
        index, table = np.ascontiguousarray(index_vectors().T), np.zeros((DIMENSIONS, BUCKETS))
        for part in slices(batches):
            words, shapes, lengths = arrays(part)
            doc = np.repeat(np.arange(len(lengths)), lengths)
            same = [(doc[k:] == doc[:-k]).astype(np.float32) for k in range(1, WINDOW + 1)]
            for d in range(DIMENSIONS):
                near = neighbours(index[d].take(words) + index[d].take(shapes), same).astype(np.float64)
                table[d] += np.bincount(words, near, BUCKETS) + np.bincount(shapes, near, BUCKETS)
        used = np.flatnonzero(table.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(used), *[pa.array(table[d, used].astype(np.int64)) for d in range(DIMENSIONS)]], ["bucket", *names])

    parts = prepared(docs, text_col).mapInArrow(run, "bucket long, " + ", ".join(f"{n} long" for n in names))
    summed = parts.groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names]).toPandas()
    out = np.zeros((BUCKETS, DIMENSIONS))
    out[summed["bucket"]] = summed[names].to_numpy(np.float64)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def pooled(part: pa.RecordBatch, vectors: np.ndarray, index: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each document of a batch."""
    words, shapes, lengths = arrays(part)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    out = np.zeros((len(lengths), FEATURES), np.float32)
    some = lengths > 0
    if len(words):
        starts = (np.cumsum(lengths) - lengths)[some]
        # One feature after the other, as in word_vectors().
        tables = [(np.ascontiguousarray(table.T), at) for table, at in ((vectors, words), (vectors, shapes), (index, shapes))]
        for k, (values, at) in enumerate((row, at) for table, at in tables for row in table):
            out[some, k] = np.add.reduceat(values.take(at), starts) / lengths[some]
        again = doc[1:][(words[1:] == words[:-1]) & (doc[1:] == doc[:-1])]
        out[some, -2] = np.bincount(again, minlength=len(lengths))[some] / lengths[some]
    out[:, -1] = np.log1p(lengths)
    return out


class Network:
    """One hidden layer, learned by Adam on log loss, then a temperature on rows left out."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.constant = None
        if len(set(y.tolist())) < 2:
            self.constant = float(y.mean()) if len(y) else 0.5
            return
        draw = np.random.default_rng(7)
        order = draw.permutation(len(y))
        left_out = order[: max(1, len(y) // 10)]
        learn = order[len(left_out) :] if len(y) >= 50 else order
        self.mean, self.spread = x[learn].mean(0), x[learn].std(0) + 1e-3
        z, t = (x - self.mean) / self.spread, y.astype(np.float64)
        self.w = [draw.normal(0, (2 / FEATURES) ** 0.5, (FEATURES, HIDDEN)), np.zeros(HIDDEN), draw.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        moments = [(np.zeros_like(w), np.zeros_like(w)) for w in self.w]
        step = 0
        for _ in range(EPOCHS):
            draw.shuffle(learn)
            for at in range(0, len(learn), 128):
                rows = learn[at : at + 128]
                hidden = np.maximum(z[rows] @ self.w[0] + self.w[1], 0)
                error = (1 / (1 + np.exp(-(hidden @ self.w[2] + self.w[3]))) - t[rows]) / len(rows)
                back = np.outer(error, self.w[2]) * (hidden > 0)
                step += 1
                for w, g, (m, v) in zip(self.w, (z[rows].T @ back + 1e-4 * self.w[0], back.sum(0), hidden.T @ error, error.sum(keepdims=True)), moments, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= 0.002 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        logits, truth = self.logits(x[left_out]), t[left_out]
        loss = lambda k: np.mean(np.logaddexp(0, logits / k) - truth * logits / k)
        self.temperature = min(np.geomspace(0.25, 8, 61), key=loss)

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.spread
        return np.maximum(z @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, held_out, vectors, id_col: str, text_col: str, label_col: str) -> Network:
    """Learns from at most SAMPLE labelled rows that aren't held out."""
    key = F.col(f"`{id_col}`").cast("long")
    usable = labels.select(key.alias("__id"), F.col(f"`{label_col}`").cast("int").alias("__y"), held_out.alias("__out")).where("not __out and __y in (0, 1)")
    sample = usable.orderBy(F.xxhash64("__id"), "__id", "__y").limit(SAMPLE).select("__id", "__y")
    chosen = docs.join(F.broadcast(sample), docs[id_col].cast("long") == sample["__id"])
    rows = prepared(chosen, text_col, F.col("__id"), F.col("__y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_vectors()
        for part in slices(batches):
            found = pooled(part, vectors.value, index)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(list(found), pa.list_(pa.float32()))], ["id", "y", "x"])

    learned = rows.mapInArrow(run, "id long, y int, x array<float>").toPandas().sort_values(["id", "y"], kind="stable")
    x = np.array(learned["x"].tolist(), np.float64).reshape(-1, FEATURES)
    return Network(x, learned["y"].to_numpy())


def score(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per document; held_out, an expression on the id, says which labels aren't learned from."""
    sc = docs.sparkSession.sparkContext
    vectors = sc.broadcast(word_vectors(docs, text_col))
    network = sc.broadcast(fit(docs, labels, held_out, vectors, id_col, text_col, label_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_vectors()
        for part in slices(batches):
            p = network.value.probabilities(pooled(part, vectors.value, index).astype(np.float64))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], [x.split()[0] for x in SCHEMA.split(", ")])

    return prepared(docs, text_col, F.col(f"`{id_col}`").cast("long").alias("doc_id"), held_out.alias("held_out")).mapInArrow(run, SCHEMA)


def default_held_out(id_col: str = "doc_id", n: int = 4, remainder: int = 2) -> Column:
    return crc_mod(id_col, n) == remainder
