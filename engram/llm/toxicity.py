"""Toxicity by a classifier chain of linear models.

The categories are label columns in a fixed order.  The first logistic model
sees hashed words; each later one sees the words and the probabilities of the
categories before it.  While training, those probabilities are out-of-fold: a
model that did not see the row gives them, so that the later link learns from
probabilities as honest as those it gets when it scores.

The models are fitted on a bounded sample of labelled rows (``SAMPLE`` rows,
those of the smallest seeded hash); every document is scored, whole.

Words are runs of letters and digits, A-Z lower-cased; their beginnings are
features as well, which carries over to words that training did not see.  Defined results: a null
or empty text has no words and gets the probability of the intercepts; labels
that are null are no training rows; without labels of both values a category's
probability is the labels' mean, or 0 without labels; repeated rows score alike, and
as training rows they count each, up to ``SAMPLE`` rows in all;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.textops import IS_ALNUM, mix, slices, words

BITS = 17
#: Bytes of the beginnings of words that are features besides whole words.
HEAD = 4
SAMPLE = 8_000
FOLDS = 4
SEED = 7
STEPS, RATE, RIDGE = 60, 0.15, 1e-4
#: Pseudo-rows of the label ratio of a word, and the fewest rows a word needs.
SHRINK, LEAST_ROWS = 10.0, 3
THRESHOLD = 0.35
#: The labels' columns in the order of the chain, and the value that counts as 1.
CHAIN = (("quality", 0), ("toxic", 1))


def features(batch: pa.RecordBatch, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every distinct hashed word, and beginning of a word, of each row of ``batch``."""
    found = []
    for head in (None, HEAD):
        w = words(batch.column("text"), table=IS_ALNUM, head=head)
        row = np.repeat(np.arange(batch.num_rows), np.diff(w.first))
        hashes = w.hash if head is None else mix(w.hash)
        found.append((row.astype(np.uint64) << np.uint64(bits)) | (hashes >> np.uint64(64 - bits)))
    both = np.unique(np.concatenate(found))
    return (both >> np.uint64(bits)).astype(np.int64), (both & np.uint64((1 << bits) - 1)).astype(np.int64)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Linear:
    """Logistic regression over sparse 0/1 features and a few dense ones."""

    def __init__(self, weights: np.ndarray, dense: np.ndarray, bias: float):
        self.weights, self.dense, self.bias = weights, dense, bias

    def predict(self, row: np.ndarray, col: np.ndarray, extra: np.ndarray, n: int) -> np.ndarray:
        return _sigmoid(np.bincount(row, weights=self.weights[col], minlength=n)[:n] + extra @ self.dense + self.bias)

    @classmethod
    def fit(cls, row: np.ndarray, col: np.ndarray, extra: np.ndarray, y: np.ndarray, bits: int = BITS) -> Linear:
        """Full-batch Adam on the logistic loss with a small ridge.  A word's value
        is the shrunken log ratio of its rates in rows labelled 1 and 0, so that
        words of a few rows cannot learn the rows by heart."""
        size, n = 1 << bits, len(y)
        mean = float(y.mean()) if n else 0.0
        if not 0 < mean < 1:
            return cls(np.zeros(size), np.zeros(extra.shape[1]), 30.0 if mean else -30.0)
        rows_with = np.bincount(col, minlength=size)
        keep = rows_with[col] >= LEAST_ROWS
        row, (used, col) = row[keep], np.unique(col[keep], return_inverse=True)
        k = len(used)
        ones = np.bincount(col, weights=y[row], minlength=k)
        zeros = rows_with[used] - ones
        ratio = np.log((ones / mean + SHRINK) / (zeros / (1 - mean) + SHRINK))
        value = ratio[col]
        w = np.zeros(k + extra.shape[1] + 1)
        w[-1] = np.log(mean / (1 - mean))
        m, v = np.zeros_like(w), np.zeros_like(w)
        for step in range(1, STEPS + 1):
            z = np.bincount(row, weights=w[:k][col] * value, minlength=n) + extra @ w[k:-1] + w[-1]
            off = (_sigmoid(z) - y) / n
            g = np.concatenate([np.bincount(col, weights=off[row] * value, minlength=k), extra.T @ off, [off.sum()]])
            g[:-1] += RIDGE * w[:-1]
            m = 0.9 * m + 0.1 * g
            v = 0.99 * v + 0.01 * g * g
            w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-10)
        weights = np.zeros(size)
        weights[used] = w[:k] * ratio
        return cls(weights, w[k:-1], float(w[-1]))


def fit_chain(row: np.ndarray, col: np.ndarray, labels: np.ndarray, fold: np.ndarray, folds: int = FOLDS) -> list[Linear]:
    """A model for each column of ``labels`` (rows x categories), in order."""
    n, chain = len(labels), []
    extra = np.zeros((n, 0))
    for c in range(labels.shape[1]):
        y = labels[:, c].astype(float)
        chain.append(Linear.fit(row, col, extra, y))
        if c + 1 == labels.shape[1]:
            break
        out_of_fold = np.zeros(n)
        for f in range(folds):
            inside, outside = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            at = np.full(n, -1)
            at[inside] = np.arange(len(inside))
            keep = at[row] >= 0
            model = Linear.fit(at[row[keep]], col[keep], extra[inside], y[inside])
            at[:] = -1
            at[outside] = np.arange(len(outside))
            keep = at[row] >= 0
            out_of_fold[outside] = model.predict(at[row[keep]], col[keep], extra[outside], len(outside))
        extra = np.column_stack([extra, out_of_fold])
    return chain


def training_sample(docs: DataFrame, labels: DataFrame, chain: tuple[tuple[str, int], ...] = CHAIN, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """Rows (spread, text, y, fold) of at most ``sample`` labelled documents; an id that repeats gives each of its rows."""
    full = labels.filter(" and ".join(["doc_id is not null", *[f"`{c}` is not null" for c, _ in chain]]))
    y = F.array(*[(F.col(c) == v).cast("int") for c, v in chain]).alias("y")
    spread = F.xxhash64(F.lit(seed), "doc_id")
    chosen = full.select("doc_id", y, spread.alias("spread")).orderBy("spread", "doc_id").limit(sample)
    # At most ``sample`` ids: their size is proven, so they are broadcast.
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("spread", "text", "y", F.pmod(F.shiftright("spread", 8), F.lit(FOLDS)).cast("int").alias("fold"))


def train(docs: DataFrame, labels: DataFrame, chain: tuple[tuple[str, int], ...] = CHAIN, sample: int = SAMPLE, seed: int = SEED) -> list[Linear]:
    """The fitted chain.  Only hashed words of at most ``sample`` rows reach the driver, however often ids repeat."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, col = features(batch)
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(col.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([lists, *[batch.column(c) for c in order], batch.column("y"), batch.column("fold")], names=["words", *order, "y", "fold"])

    order = ["spread", "tie"]
    drawn = training_sample(docs, labels, chain, sample, seed).withColumn("tie", F.xxhash64("text"))
    found = drawn.mapInArrow(hashed, "words array<int>, spread long, tie long, y array<int>, fold int")
    rows = found.orderBy(*order, "y").limit(sample).select("words", "y", "fold").toArrow()
    lists = rows.column("words").combine_chunks()
    col = lists.flatten().to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()) if len(lists) else np.zeros(0, np.int64)
    y = np.array(rows.column("y").to_pylist(), dtype=float).reshape(len(lists), len(chain))
    return fit_chain(row, col, y, rows.column("fold").to_numpy())


def score(docs: DataFrame, chain: list[Linear], names: tuple[str, ...], key: str = "doc_id") -> DataFrame:
    """(key, a probability for each name) for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                row, col = features(part)
                extra = np.zeros((part.num_rows, 0))
                for model in chain:
                    extra = np.column_stack([extra, model.predict(row, col, extra, part.num_rows)])
                yield pa.RecordBatch.from_arrays([part.column("key"), *[pa.array(extra[:, i]) for i in range(len(chain))]], names=["key", *names])

    rows = docs.select(F.col(key).alias("key"), F.col("text"))
    schema = f"key {docs.schema[key].dataType.simpleString()}, " + ", ".join(f"`{n}` double" for n in names)
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def toxic_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The result that query op9 returns: the documents found toxic, with the
    probabilities of both links of the chain."""
    chain = train(docs, labels)
    scored = score(docs, chain, ("low_quality_probability", "toxic_probability"))
    return scored.filter(F.col("toxic_probability") >= threshold).withColumn("toxic", F.lit(True))
