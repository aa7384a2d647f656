"""Operator 3: toxicity by FTRL-proximal logistic regression.

Features of a text are its words, the beginnings of longer words, pairs of neighbouring words and pairs with one
word between them (lower case, punctuation apart), hashed to ``BINS`` coordinates; each counts once per text.  Each coordinate has its own
learning rate, and the L1 term leaves most weights at zero: what goes to the tasks is a short list of
coordinates and weights.

The model is fitted on a bounded sample: at most about ``SAMPLE_ROWS`` labelled texts and 64 MB of them, chosen by hash,
taken in hash order by one task, ``EPOCHS`` times.

Cases: scoring covers every text as a whole, whatever its length; null and empty texts have the score of the bias
alone.  Equal rows (id, text and label) are learnt once and scored each; a document with two labels is learnt with both;
null labels are passed over, null texts are learnt as empty,
and a row without an id has no label.  Without labels every score is 1/2.  A score of exactly 1/2
counts as toxic.  An empty table gives an empty one.  Other columns, of whatever names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.llm.common import RunHashes, blocks, held_out, label_table, labelled_sample, map_texts, mix, table, text_column, word_places

SAMPLE_ROWS = 12_000
EPOCHS = 4
BINS = 1 << 20
#: Learning rate, its damping, and the strengths of the L1 and L2 terms.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 8.0, 1.0
#: Toxic texts are the rarer; their steps count so much more.
WEIGHT = 4.0
#: Lengths in bytes of the beginnings of words that are features too.
BEGINNINGS = (5, 7)


def text_features(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For blocks of texts: number of texts, coordinates of their features, text of each feature."""
    for _, data, offsets in blocks(pc.utf8_lower(texts)):
        starts, ends, first = word_places(data, offsets)
        hashes = RunHashes(data)
        words, owner = hashes.of(starts, ends), np.repeat(np.arange(len(first) - 1), np.diff(first))
        at, of = [words], [owner]
        for n in BEGINNINGS:
            longer = np.flatnonzero(ends - starts > n)
            at.append(mix(hashes.of(starts[longer], starts[longer] + n) + np.uint64(n)))
            of.append(owner[longer])
        for gap, salt in ((1, 0x51ED270B), (2, 0x2545F491)):
            same = owner[:-gap] == owner[gap:]
            at.append(mix(words[:-gap] * np.uint64(3) + words[gap:] + np.uint64(salt))[same])
            of.append(owner[:-gap][same])
        yield len(offsets) - 1, (np.concatenate(at) >> np.uint64(44)).astype(np.int64), np.concatenate(of)


class Ftrl:
    """Per-coordinate FTRL-proximal; the last coordinate is the bias, without L1."""

    def __init__(self):
        self.z, self.n = np.zeros(BINS + 1), np.zeros(BINS + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == BINS, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def learn(self, at: np.ndarray, y: int) -> None:
        at = np.append(at, BINS)
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30)))
        g = (p - y) * (WEIGHT if y else 1.0)
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g

    def sparse(self) -> tuple[np.ndarray, np.ndarray]:
        w = self.weights(np.arange(BINS + 1))
        at = np.flatnonzero(w)
        return at, w[at]


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and weights from docs (key, text) and labels (key, label)."""
    sample = labelled_sample(docs, label_table(docs, labels), SAMPLE_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            labels, k = batch.column(1).to_pylist(), 0
            for n, at, of in text_features(text_column(batch.column(0))):
                ends = np.searchsorted(np.sort(of, kind="stable"), np.arange(n + 1))
                at = at[np.argsort(of, kind="stable")]
                for a, b in zip(ends[:-1], ends[1:], strict=True):
                    rows.append((np.unique(at[a:b]).astype(np.int32), labels[k]))
                    k += 1
        model = Ftrl()
        for _ in range(EPOCHS):
            for at, y in rows:
                model.learn(at, y)
        at, w = model.sparse()
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w)], names=["at", "w"])

    ordered = sample.repartition(1).sortWithinPartitions(F.xxhash64("hash"), "hash", "label")
    found = map_texts(ordered.select("text", "label"), run, "at bigint, w double").collect()
    return np.array([r["at"] for r in found], np.int64), np.array([r["w"] for r in found])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], columns: tuple[str, ...], text: str = "text") -> DataFrame:
    """``columns`` of each row and its score from 0 to 1."""
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns), "score double"])
    at, w = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(BINS + 1, np.float32)
        dense[at] = w
        bias = float(dense[BINS])
        for batch in batches:
            total = []
            for n, feats, of in text_features(text_column(batch.column(len(columns)))):
                hit = np.flatnonzero(dense[feats])
                pairs = np.unique(of[hit] * np.int64(BINS) + feats[hit])  # each counts once per text
                total.append(np.bincount(pairs // BINS, dense[pairs % BINS], n) + bias)
            total = np.concatenate(total) if total else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(1 / (1 + np.exp(-np.clip(total, -30, 30))))], names=[*columns, "score"])

    return map_texts(docs.select(*columns, text), run, schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learnt from the labels of those that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    seen = docs.where(~held_out("doc_id", 5, 0)).select(F.col("doc_id").alias("key"), "text")
    found = score(docs, fit(seen, labels.select(F.col("doc_id").alias("key"), F.col("toxic").alias("label"))), ("doc_id",))
    return found.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
