"""Helpers shared by the text operators: loading, writing intermediate tables, vectorised words and hashes.

Python work runs inside ``mapInArrow`` tasks.  The helpers below look at the UTF-8 buffer of a whole
Arrow column at once, a few megabytes at a time, so that no loop runs per character or per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkwarden.sources.shared import forget, shared_path  # noqa: F401

#: Bytes of text that a task looks at together; longer single texts are looked at alone.
BLOCK_BYTES = 1 << 18
#: Rows with texts that go to a Python worker together.
BATCH_ROWS = 1000
#: Bytes of text in a sample that a classifier is fitted on, about.
SAMPLE_BYTES = 64 << 20
#: Stretches of a long text that a classifier learns from, and classes whose sums are broadcast at most.
STRETCHES, FEW = 16, 10_000
#: A key is heavy if more than one row in so many has it.
HEAVY = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; any path that Spark can read will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends here and every executor sees the files."""
    path = shared_path(df.sparkSession, "table")
    df.write.option("compression", "lz4").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spare(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as no column of df needs."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def quoted(name: str) -> str:
    """A column's name as Spark reads it, whatever is in it."""
    return f"`{name.replace('`', '``')}`"


def map_texts(df: DataFrame, run, schema: str) -> DataFrame:
    """``mapInArrow`` over rows that hold whole texts.

    Batches have ``BATCH_ROWS`` rows at most instead of Spark's ten thousand, as a batch lies in memory several
    times (JVM, Arrow, Python).  The setting is the session's.  ``run`` finds columns by place, so that clashing names do not matter.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(run, schema)


def held_out(doc_id: str, folds: int, fold: int):
    """Whether crc32 of the id as text falls into ``fold`` of ``folds``; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == fold, F.lit(False))


def excerpt(text: str, most: int):
    """The text, or where it has more than ``most`` bytes ``STRETCHES`` stretches spread evenly over it, of about ``most`` bytes together."""
    step = F.floor(F.length(text) / STRETCHES).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.lit(STRETCHES - 1)), lambda i: F.substring(F.col(text), i * step + 1, F.lit(most // STRETCHES)))
    return F.when(F.octet_length(text) > most, F.array_join(pieces, " ")).otherwise(F.col(text))


def chosen_texts(light: DataFrame, rows: int, most: int = SAMPLE_BYTES, by: tuple[str, ...] = (), even: bool = True) -> DataFrame:
    """(by..., hash) of at most ``rows`` different texts and ``most`` bytes of text of each class, from light (by..., hash, size).

    Equal texts are one, so that no repetition crowds out others; those with the least hashes are taken, so that reruns and
    other partitionings choose the same, and at least one of each class is.  A text counts with a 64th of ``most`` at most:
    of longer ones ``fetched`` takes an excerpt.  Unless ``even``, rows and bytes are those of all classes together, and each class has its
    share of them by its different texts, or a 16th.
    """
    own = cut(light.groupBy(*by, "hash").agg(F.max(F.least("size", F.lit(most // 64))).alias("size")).withColumn("order", F.xxhash64("hash")))
    wanted = [F.count("*").alias("n"), F.greatest(F.sum("size"), F.lit(1)).alias("b"), F.min("order").alias("first")]
    if by:
        sums = own.groupBy(*by).agg(*wanted)
        part = F.lit(1.0) if even else F.greatest(F.col("n") / max(1, own.count()), F.lit(1 / 16))
        few = sums.limit(FEW + 1).count() <= FEW
        sums = sums.withColumn("part", part)
        joined = own.join(F.broadcast(sums) if few else sums, list(by))
    else:
        known = own.agg(*wanted).first()
        joined = own.withColumns({c: F.lit(known[c] or 1).cast("long") for c in ("n", "b", "first")} | {"part": F.lit(1.0)})
    share = F.least(F.lit(1.0), rows * F.col("part") / F.col("n"), most * F.col("part") / F.col("b"))
    # about four times as many as wanted are ordered
    some = joined.where((F.pmod("order", F.lit(1 << 30)) < share * float(1 << 32)) | (F.col("order") == F.col("first")))
    window = Window.partitionBy(*by).orderBy(F.pmod("order", F.lit(1 << 30)), "order", "hash")
    ranked = some.withColumns({"rank": F.row_number().over(window), "bytes": F.sum("size").over(window.rowsBetween(Window.unboundedPreceding, 0))})
    kept = (F.col("rank") == 1) | ((F.col("rank") <= rows * F.col("part")) & (F.col("bytes") <= most * F.col("part")))
    out = cut(ranked.where(kept).select(*by, "hash"))
    forget(own)
    return out


def fetched(docs: DataFrame, chosen: DataFrame, most: int = SAMPLE_BYTES, by: tuple[str, ...] = ()) -> DataFrame:
    """(text, by..., hash): each text of docs (text, and those of ``by`` that it has) that was chosen, once; in one pass over docs."""
    on = [c for c in by if c in docs.columns]
    found = docs.select("text", *on, F.xxhash64("text").alias("hash")).join(F.broadcast(chosen), [*on, "hash"])
    return found.groupBy(*by, "hash").agg(F.first("text").alias("text")).select(excerpt("text", most // 64).alias("text"), *by, "hash")


def light_texts(docs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., hash, size) of docs (text, by...)."""
    return docs.select(*by, F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"), F.xxhash64("text").alias("hash"))


def bounded_sample(docs: DataFrame, rows: int, most: int = SAMPLE_BYTES) -> DataFrame:
    """(text, hash) of at most ``rows`` different texts of docs (text), as ``chosen_texts`` takes them."""
    return fetched(docs, chosen_texts(light_texts(docs), rows, most), most)


def label_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (key, text) and labels (key, label) to (key, label, size, hash) of each labelled text, without the texts.

    Null labels are passed over; a null key has no label.
    """
    light = docs.select("key", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"), F.xxhash64("text").alias("hash"))
    return cut(light.join(labels.where("label IS NOT NULL").select("key", F.col("label").cast("int").alias("label")), "key"))


def labelled_sample(docs: DataFrame, known: DataFrame, rows: int, most: int = SAMPLE_BYTES) -> DataFrame:
    """(text, label, hash): at most about ``rows`` texts and ``most`` bytes of those in ``known``, a part of ``label_table``.

    Only the chosen rows' texts are fetched; a text with both labels is there twice.
    """
    return fetched(docs, chosen_texts(known.select("label", "hash", "size"), rows, most, ("label",), even=False), most, ("label",))


def join_heavy(rows: DataFrame, side: DataFrame, keys: list[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """Join on ``keys``, where a row of ``side`` (unique by keys) says in ``weight`` how many of the ``total`` rows it meets.

    Keys that meet more than one row in ``HEAVY`` are at most ``HEAVY``, so that they are broadcast whatever the size;
    what is left is joined by shuffle without any hot key.  ``how`` is inner or left; rows with a null key go along
    with the broadcast part.
    """
    least = max(1, total // HEAVY)
    heavy = side.where(F.col(weight) > least)
    lone = F.lit(False)
    for k in keys:
        lone = lone | F.col(k).isNull()
    hot = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_semi").join(F.broadcast(heavy), keys)
    rest = rows.where(~lone).join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(side.where(F.col(weight) <= least), keys, how)
    out = hot.select(*rest.columns).unionByName(rest)
    if how == "left":
        out = out.unionByName(rows.where(lone), allowMissingColumns=True)
    return out


def text_column(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one array of texts, null as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.string()) if not pa.types.is_string(column.type) else column, "")


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, and the offsets of each text within them."""
    _, offsets, data = texts.buffers()
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def blocks(texts: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of texts of about ``most`` bytes: index of the first text, bytes, offsets."""
    data, offs = buffers(texts)
    at = 0
    while at < len(texts):
        end = int(np.searchsorted(offs, offs[at] + most, side="right")) - 1
        end = min(max(end, at + 1), len(texts))
        yield at, data[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
_STEP = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, BLOCK_BYTES + 1024)
        up, down = np.full(size, _STEP, np.uint64), np.full(size, pow(_STEP, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _POWERS[0], _POWERS[1]


def word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word of the texts in ``data`` starts and ends, and for each text the index of its first word.

    A word is a run of ASCII letters, digits, ``_`` and characters beyond ASCII.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = _WORD[data]
    first = np.zeros(n + 1, bool)
    first[offsets[:-1][offsets[:-1] < n]] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before &= ~first[:n]
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after &= ~first[1:]
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


class RunHashes:
    """Hashes of runs of bytes: differences of prefix sums of byte times power, so all runs cost a few array passes."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash for each run."""
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of the texts in ``data``, and for each text the index of its first word."""
    starts, ends, first = word_places(data, offsets)
    return RunHashes(data).of(starts, ends), first


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words of one text; a text of 1 to k-1 words has its whole run as one shingle."""
    if len(words) == 0:
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total = total * np.uint64(_STEP) + words[j : j + n]
    return mix(total + np.uint64(k))
