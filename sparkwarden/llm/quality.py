"""Operator 7: quality by compression.

Two zstandard dictionaries are built, one of texts labelled good and one of texts labelled bad: whole texts in hash order,
equally many bytes of each label.  A text is compressed with each, in pieces of ``PIECE`` bytes, as within a long piece a
compressor learns more from the text itself than from a dictionary; the difference of the two sizes over all pieces, normalised
by the text's own size, says which it resembles.  A logistic curve over that difference alone, fitted on labelled
texts that are in neither dictionary, turns it into the probability of label 1.  ``SMOOTHING`` bytes of the labelled texts'
mean difference are added to each text, so that very short ones get a score near the share of label 1.

Both fits use bounded samples, chosen by hash: at most about ``DICTIONARY_ROWS`` texts and ``DICTIONARY_SAMPLE`` bytes per
label, of which whole texts go into a dictionary as long as they fit into ``DICTIONARY_BYTES``, and ``CURVE_ROWS`` texts
(64 MB at most) for the curve.

Cases: scoring compresses all of every text, whatever its length.  Null and empty texts have the mean difference and the
score that the curve has there.  If a label has no texts to learn from, the score is the share of label 1 (1/2 without
labels).  Equal texts of a label are learnt once, however often they are repeated, and every label with a text is learnt; of a text above
64 KB (1 MB for the curve) stretches spread over it are learnt.  Null labels are passed over, null texts are not learnt from.  A score of exactly 0.7 counts as good.  An empty table gives an empty one.  Other columns, of whatever
names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.llm.common import held_out, label_table, labelled_sample, map_texts, table, text_column

DICTIONARY_ROWS = 3000
DICTIONARY_BYTES = 1 << 20
DICTIONARY_SAMPLE = 4 << 20
CURVE_ROWS = 6000
LEVEL = 9
SMOOTHING = 64
PIECE = 1024


@dataclass
class Model:
    """The dictionaries (empty where there was nothing to learn from), the mean difference per byte, and the curve's slope and offset."""

    good: bytes
    bad: bytes
    mean: float
    slope: float
    offset: float


def _whole_texts(texts: list[bytes], most: int) -> bytes:
    """Whole texts, in order, as long as they fit; if none does, what fits of the first."""
    out, size = [], 0
    for t in texts:
        if size + len(t) <= most:
            out.append(t)
            size += len(t)
    if not out and texts:
        out.append(texts[0][:most])
    return b"".join(out)


def dictionaries(good: list[bytes], bad: list[bytes]) -> tuple[bytes, bytes]:
    """The texts of both dictionaries, of nearly equal size; empty ones if a label has none."""
    most = min(sum(map(len, good)), sum(map(len, bad)), DICTIONARY_BYTES)
    return _whole_texts(good, most), _whole_texts(bad, most)


def gains(texts: list[str], good: bytes, bad: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Per text: size with the bad dictionary less size with the good one, and its own size."""
    gain, size = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    tools = []
    for d in (good, bad) if good and bad else ():
        packed = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        packed.precompute_compress(level=LEVEL)
        tools.append(zstandard.ZstdCompressor(dict_data=packed, write_content_size=False, write_checksum=False, write_dict_id=False))
    for k, t in enumerate(texts):
        raw = t.encode("utf-8", "replace")
        size[k] = len(raw)
        for at in range(0, len(raw) if tools else 0, PIECE):
            piece = raw[at : at + PIECE]
            gain[k] += len(tools[1].compress(piece)) - len(tools[0].compress(piece))
    return gain, size


def _with_gains(rows: DataFrame, columns: tuple[str, ...], good: bytes, bad: bytes) -> DataFrame:
    """``columns``, _gain and _size of each row; rows ends in a column of texts."""
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns), "_gain bigint, _size bigint"])
    n = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = gains(text_column(batch.column(n)).to_pylist(), good, bad)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *map(pa.array, found)], names=[*columns, "_gain", "_size"])

    return map_texts(rows, run, schema)


def curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve of least loss, by Newton's method, with a small ridge."""
    scale = x.std() + 1e-9
    a, w = np.column_stack([x / scale, np.ones(len(x))]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a.T * (p * (1 - p))) @ a + 1e-2 * np.eye(2), a.T @ (p - y) + 1e-2 * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from docs (key, text) and labels (key, label).  Half of the labelled rows, by hash, are for the dictionaries, half for the curve."""
    known = label_table(docs, labels)
    half = F.pmod(F.xxhash64("hash", F.lit("half")), F.lit(2)) == 0
    # a label with one text alone, however often repeated, has it in one half: that text then serves both
    n = {(r["label"], r["half"]) for r in known.groupBy("label", half.alias("half")).agg(F.count("*").alias("n")).collect()}
    packs = []
    for y in (1, 0):
        own = known.where(F.col("label") == y)
        rows = labelled_sample(docs, own.where(half) if (y, True) in n else own, DICTIONARY_ROWS, DICTIONARY_SAMPLE)
        packs.append([r["text"].encode("utf-8", "replace") for r in rows.where("text != ''").select("text", F.xxhash64("hash").alias("h")).orderBy("h", "text").collect()])
    good, bad = dictionaries(*packs)
    other = ~half
    for y in (1, 0):
        if (y, False) not in n:
            other = other | (F.col("label") == y)
    rows = _with_gains(labelled_sample(docs, known.where(other), CURVE_ROWS).select("label", "text"), ("label",), good, bad).collect()
    rows.sort(key=lambda r: (r["_gain"], r["_size"], r["label"]))  # so that sums don't depend on partitions
    gain, size, y = (np.array([r[c] for r in rows], float) for c in ("_gain", "_size", "label"))
    mean = float(np.mean(gain / np.maximum(size, 1))) if len(rows) else 0.0
    return Model(good, bad, mean, *(curve((gain + SMOOTHING * mean) / (size + SMOOTHING), y) if len(rows) else (0.0, 0.0)))


def score(docs: DataFrame, model: Model, columns: tuple[str, ...], text: str = "text") -> DataFrame:
    """``columns`` of each row, its difference and its score from 0 to 1."""
    rows = _with_gains(docs.select(*columns, F.col(text).alias("_text")), columns, model.good, model.bad)
    rows = rows.withColumn("difference", (F.col("_gain") + SMOOTHING * model.mean) / (F.col("_size") + SMOOTHING)).drop("_gain", "_size")
    total = F.lit(model.slope) * F.col("difference") + model.offset
    return rows.withColumn("score", 1 / (1 + F.exp(-F.greatest(F.least(total, F.lit(30.0)), F.lit(-30.0)))))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learnt from the labels of those that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    seen = docs.where(~held_out("doc_id", 4, 2)).select(F.col("doc_id").alias("key"), "text")
    model = fit(seen, labels.select(F.col("doc_id").alias("key"), F.col("quality").alias("label")))
    found = score(docs, model, ("doc_id",))
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"), "difference")
