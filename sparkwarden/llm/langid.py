"""Operator 5: language identification by nearest centroid.

A text's vector counts its hashed byte bigrams and trigrams (lower case; digits, punctuation and blanks are one
blank), damped by a square root, times inverse document frequency, scaled to length one.  Each language has
several centroids, found by spherical k-means within its sample.  A text gets the language of the centroid with
the highest cosine, and is rejected if it lies farther from it than the language's radius for texts of its length.
Few grams lie far from any centroid, so each class of lengths has its own radius.  It comes from the distances of the
sampled texts and of their beginnings, cut to each length: of these cosines a low quantile times ``SLACK`` is the
least that is accepted.  So no radius reaches 1, and one odd text does not open its language.

The model is fitted on a bounded sample: at most ``SAMPLE_ROWS`` labelled texts per language, chosen by a hash of the text, equal
ones once, so that a language with any text is learnt however often its texts are repeated; of texts of more than ``LONGEST`` bytes
stretches spread over them are learnt.  Vectors of the sample are a
table; each language is clustered by a task of its own, and its centroids (32 KB each) come to the driver.

Cases: null texts and texts without a letter are ``und`` with score 0 and rejected.  Without labelled rows every text is
``und``.  Texts of any length are counted whole.  Repeated rows get equal results.  Of equally near centroids the first
language's, by code point, decides.  Null ids are learnt from like others, as they are never held out; null languages are
not learnt from.  An empty table gives an empty result.  Other columns are passed by; those asked for must not be named
as those of the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.llm.common import blocks, chosen_texts, cut, fetched, held_out, light_texts, quoted, map_texts, table, text_column

#: Labelled texts per language that the model is fitted on, about.
SAMPLE_ROWS = 400
#: Bytes of a labelled text at most.
LONGEST = 1 << 18
CENTROIDS = 4
BINS = 1 << 13
#: Least numbers of grams of the length classes but the first, and bytes of the beginnings that stand for those that are short.
LENGTHS = (24, 64, 128, 256, 512)
PIECES = (10, 24, 50, 100, 200)
#: The quantile of a class's distances, and the share of that text's cosine that is still accepted.
QUANTILE, SLACK = 0.99, 0.7
UNKNOWN = "und"

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[:128] = 32
_PLAIN[97:123] = np.arange(97, 123)


def count_grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row per text: how often each bin's bigrams and trigrams stand in it."""
    n, m = len(offsets) - 1, len(data)
    owner = np.repeat(np.arange(n, dtype=np.int64) * BINS, np.diff(offsets))
    b = _PLAIN[data].astype(np.uint32)
    if m < 3:
        return np.zeros((n, BINS), np.float32)
    two = b[:-1] << 8 | b[1:]
    ok = (owner[:-1] == owner[1:]) & (two != 0x2020)
    at = [(owner[:-1] + ((two * np.uint32(0x9E3779B1)) >> np.uint32(19)))[ok]]
    three = two[:-1] << 8 | b[2:]
    ok3 = ok[:-1] & ok[1:]
    at.append((owner[:-2] + ((three * np.uint32(0x85EBCA6B)) >> np.uint32(19)))[ok3])
    return np.bincount(np.concatenate(at), minlength=n * BINS).reshape(n, BINS).astype(np.float32)


def beginnings(texts: pa.Array, size: int) -> tuple[pa.Array, np.ndarray]:
    """The first bytes of the longer texts, lower case, and where these texts stand."""
    raw = pc.utf8_lower(texts).cast(pa.binary())
    at = np.flatnonzero(pc.greater(pc.binary_length(raw), size).to_numpy(zero_copy_only=False))
    return pc.binary_slice(raw.take(pa.array(at)), 0, size), at


def gram_rows(texts: pa.Array) -> Iterator[np.ndarray]:
    """Count matrices of a few hundred texts at a time, in order; binary texts are lower case already."""
    for _, data, offsets in blocks(texts if pa.types.is_binary(texts.type) else pc.utf8_lower(texts)):
        for at in range(0, len(offsets) - 1, 128):
            some = offsets[at : at + 129]
            yield count_grams(data[some[0] : some[-1]], some - some[0])


@dataclass
class Model:
    """Centroids as rows; ``of`` has the language of each, ``radius`` its largest distance by length class."""

    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    of: np.ndarray
    radius: np.ndarray

    def nearest(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The centroid with the highest cosine of each row of counts, and that cosine."""
        cos = unit(np.sqrt(counts) * self.idf) @ self.centroids.T
        best = cos.argmax(axis=1)
        return best, cos[np.arange(len(best)), best]

    def judge(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest centroid, its cosine, and whether it is too far for texts of this length."""
        best, cos = self.nearest(counts)
        return best, cos, 1 - cos > self.radius[best, length_class(counts)]


def length_class(counts: np.ndarray) -> np.ndarray:
    """The length class of each row of counts."""
    return np.searchsorted(LENGTHS, counts.sum(axis=1), side="right")


def radii(distances: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The radius of each length class; a shorter class's is at least a longer one's, and an empty class has its neighbour's."""
    found = [1 - SLACK * (1 - np.quantile(distances[classes == c], QUANTILE)) if (classes == c).any() else np.nan for c in range(len(LENGTHS) + 1)]
    longer = np.fmax.accumulate(found[::-1])[::-1]
    return np.where(np.isnan(longer), np.nanmin(longer), longer)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; rows of zeros stay."""
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def clusters(rows: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means: each centre starts at the row that is farthest from the centres before it; rows of zeros have no say."""
    rows = rows[rows.any(axis=1)] if rows.any() else rows[:1]
    centres = rows[:1]
    while len(centres) < min(k, len(rows)):
        centres = np.vstack([centres, rows[(rows @ centres.T).max(axis=1).argmin()]])
    for _ in range(rounds):
        own = (rows @ centres.T).argmax(axis=1)
        centres = unit(np.vstack([rows[own == j].sum(axis=0) if (own == j).any() else centres[j] for j in range(len(centres))]))
    return centres


def dense(rows: list) -> np.ndarray:
    """The count matrix of collected rows."""
    counts = np.zeros((len(rows), BINS), np.float32)
    for row, r in zip(counts, rows, strict=True):
        row[np.frombuffer(r["bins"], np.uint16)] = np.frombuffer(r["sizes"], np.uint32)
    return counts


def sample_vectors(labelled: DataFrame) -> DataFrame:
    """(lang, h, piece, bins, sizes) of a sample of labelled (text, lang); piece 0 is a whole text, others are its beginnings."""
    most = 64 * LONGEST
    chosen = chosen_texts(light_texts(labelled, ("lang",)), SAMPLE_ROWS, most, ("lang",))
    some = fetched(labelled, chosen, most, ("lang",))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                texts = text_column(batch.column(0))
                for piece, (part, own) in enumerate([(texts, np.arange(len(texts))), *(beginnings(texts, size) for size in PIECES)]):
                    bins, sizes = [], []
                    for m in gram_rows(part):
                        for c in m:
                            at = np.flatnonzero(c)
                            bins.append(at.astype(np.uint16).tobytes())
                            sizes.append(c[at].astype(np.uint32).tobytes())
                    own = pa.array(own)
                    rows = [batch.column(1).take(own), batch.column(2).take(own), pa.array(np.full(len(own), piece, np.int32)), pa.array(bins, pa.binary()), pa.array(sizes, pa.binary())]
                    yield pa.RecordBatch.from_arrays(rows, names=["lang", "h", "piece", "bins", "sizes"])

    return map_texts(some, vectors, "lang string, h bigint, piece int, bins binary, sizes binary")


def document_frequencies(vectors: DataFrame) -> tuple[int, np.ndarray]:
    """Number of whole texts, and for each bin the number of those that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BINS + 1, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                counts[np.frombuffer(raw, np.uint16)] += 1
                counts[BINS] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS + 1)), pa.array(counts)], names=["bin", "n"])

    counts = np.zeros(BINS + 1, np.int64)
    for r in vectors.where("piece = 0").select("bins").mapInArrow(run, "bin bigint, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        counts[r["bin"]] = r["n"]
    return int(counts[BINS]), counts[:BINS]


def _centroids(idf: np.ndarray):
    """A function of one language's vectors to its centroids and their radii."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["h", "piece"])
        whole, short = rows[rows["piece"] == 0].to_dict("records"), rows[rows["piece"] > 0].to_dict("records")
        counts = dense(whole)
        own = unit(np.sqrt(counts) * idf)
        made = clusters(own, CENTROIDS)
        distances, lengths = [1 - (own @ made.T).max(axis=1)], [length_class(counts)]
        for at in range(0, len(short), 256):
            counts = dense(short[at : at + 256])
            distances.append(1 - (unit(np.sqrt(counts) * idf) @ made.T).max(axis=1))
            lengths.append(length_class(counts))
        radius = radii(np.concatenate(distances), np.concatenate(lengths))
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "number": range(len(made)), "centroid": [m.astype(np.float32).tobytes() for m in made], "radius": [radius] * len(made)})

    return run


def fit(labelled: DataFrame) -> Model | None:
    """A model from labelled (text, lang)."""
    vectors = cut(sample_vectors(labelled))
    n, seen = document_frequencies(vectors)
    idf = (np.log((1 + n) / (1 + seen)) + 0.2).astype(np.float32)
    # a group is one language's sample, which is bounded
    found = vectors.groupBy("lang").applyInPandas(_centroids(idf), "lang string, number int, centroid binary, radius array<double>").collect()
    if not found:
        return None
    found.sort(key=lambda r: (r["lang"], r["number"]))
    langs = sorted({r["lang"] for r in found})
    centroids = np.vstack([np.frombuffer(r["centroid"], np.float32) for r in found])
    return Model(langs, idf, centroids, np.array([langs.index(r["lang"]) for r in found]), np.array([r["radius"] for r in found]))


def identify(docs: DataFrame, model: Model | None, columns: tuple[str, ...], text: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """``columns`` of each row, lang_pred (a learned language; ``und`` where there is no letter), score (its cosine) and rejected.

    ``names`` are those of the last three; none of ``columns`` may have one of them.
    """
    if clash := {c.lower() for c in columns} & {c.lower() for c in names}:
        raise ValueError(f"columns have names of the result: {', '.join(sorted(clash))}")
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    schema = ", ".join([*(f"{quoted(c)} {docs.schema[c].dataType.simpleString()}" for c in columns), *(f"{quoted(c)} {t}" for c, t in zip(names, ("string", "double", "boolean"), strict=True))])
    n = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.column(n + 1).to_numpy(zero_copy_only=False)
            size = batch.num_rows
            lang, score, far = np.full(size, UNKNOWN, object), np.zeros(size), np.ones(size, bool)
            if model is not None and size:
                best, cos, far = map(np.concatenate, zip(*[model.judge(m) for m in gram_rows(text_column(batch.column(n)))], strict=True))
                score = np.where(kept, np.clip(cos, 0, 1).astype(float), 0)
                lang = np.where(kept, np.array(model.langs, object)[model.of[best]], UNKNOWN)
                far |= ~kept
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(lang, pa.string()), pa.array(score), pa.array(far)], names=[*columns, *names])

    return map_texts(docs.select(*map(quoted, columns), text, letters.alias("__letters")), run, schema)


def learn(docs: DataFrame, text: str = "text") -> Model | None:
    """The model from the rows of docs that are not held out (crc32 of the id mod 3 is not 1) and have a language."""
    own = docs.where(~held_out("doc_id", 3, 1) & F.col("lang").isNotNull() & F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    return fit(own.select(F.col(text).alias("text"), F.col("lang").cast("string").alias("lang")))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, learn(docs), ("doc_id",))
    return found.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score", "rejected")
