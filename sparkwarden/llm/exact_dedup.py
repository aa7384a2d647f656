"""Operator 8: exact duplicates by counting quotient filters.

1. Each text is normalised (characters of ``[\\x20\\x09-\\x0D]`` deleted) and fingerprinted with 64 bits.
2. Each partition builds counting quotient filters of its fingerprints, one for each block (the first bits of the
   fingerprint).  The next bits are the quotient, the slot where a fingerprint would like to be; the rest is the
   remainder, which a slot stores.  Remainders of a quotient form a sorted run, pushed to the right where slots are taken.
   Three bits tell what is where: ``occupied`` (a quotient has a run), ``runend`` (a slot ends its run), ``digit`` (a slot is
   no remainder, but a digit, in the base of a remainder's range, of how often the one before it counts beyond once).
3. Filters of all partitions are merged block by block without loss: their sorted remainders are laid together and counts
   of equal ones added.  A fingerprint that counts more than one goes on, all others are unique.
4. The rows behind such fingerprints are verified by their bytes: the whole normalised texts are grouped, with
   partial aggregation, so that a group's copies collapse on the side of the reader.

Cases: null texts count as empty, and empty texts are equal to each other and to texts of white space.  Texts of any
length are read whole.  Among equal texts the one with the most code points stays, then the smallest id (of any type that
can be ordered); a null id comes last.  Repeated rows (same id, same text) are one group whose rows all count; as they
can't be told apart, all of them carry ``kept`` if their id and length win.  An empty table gives an empty result.
Other columns, of whatever names, are passed by.  A group with a large share of all rows is one row before any
shuffle, and is joined back by a broadcast of the few such groups.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.llm.common import cut, join_heavy, map_texts, table, text_column

#: Fixed value: the characters that don't matter.
BLANKS = bytes([0x20, *range(0x09, 0x0E)])
#: Bits of a fingerprint that choose the block; of the others a filter takes as many for the quotient as it needs.
BLOCK_BITS = 12
#: Fingerprints that a task holds before it writes its filters and begins new ones.
HELD = 4_000_000
#: Share of a filter's quotients that have a fingerprint, on average.
LOAD = 0.75
#: Rows of a table of fingerprints or digests (some 100 bytes each) up to which it is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 500_000


def fingerprints(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """Per row: id, code points of the text, fingerprint and sha256 of its normalised bytes, and a hash of the raw text."""
    schema = f"doc_id {docs.schema[id_column].dataType.simpleString()}, n_points bigint, fp bigint, sha string, row bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, fps, shas = [], [], []
            texts = text_column(batch.column(1))
            for at in range(0, len(texts), 1000):
                for t in texts.slice(at, 1000).to_pylist():
                    raw = t.encode("utf-8", "replace").translate(None, BLANKS)
                    points.append(len(t))
                    fps.append(xxhash.xxh3_64_intdigest(raw))
                    shas.append(hashlib.sha256(raw).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(points, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(shas, pa.string()), batch.column(2)], names=["doc_id", "n_points", "fp", "sha", "row"])

    return map_texts(docs.select(F.col(id_column).alias("doc_id"), text, F.xxhash64(text).alias("row")), run, schema)


@dataclass
class Filter:
    """A counting quotient filter of one block."""

    quotient_bits: int
    occupied: np.ndarray
    runend: np.ndarray
    digit: np.ndarray
    slots: np.ndarray

    @property
    def remainder_bits(self) -> int:
        return 64 - BLOCK_BITS - self.quotient_bits

    @classmethod
    def of(cls, fps: np.ndarray, counts: np.ndarray) -> Filter:
        """From sorted fingerprints of one block and their counts."""
        q = max(1, math.ceil(math.log2(max(len(fps), 2) / LOAD)))
        r = 64 - BLOCK_BITS - q
        mask = np.uint64((1 << r) - 1)
        quotient = (fps >> np.uint64(r)).astype(np.int64) & ((1 << q) - 1)
        # what each slot will hold, in order: a remainder, then the digits of its count less one
        more = counts.astype(np.uint64) - np.uint64(1)
        of, step = [np.arange(len(fps))], [np.zeros(len(fps), np.int64)]
        value, level = [fps & mask], 1
        while (some := np.flatnonzero(more)).size:
            of.append(some)
            step.append(np.full(len(some), level))
            value.append(more[some] & mask)
            more, level = more >> np.uint64(r), level + 1
        of, step, value = np.concatenate(of), np.concatenate(step), np.concatenate(value)
        order = np.lexsort((step, of))
        of, step, value = of[order], step[order], value[order]
        home = quotient[of]
        # a slot is its quotient's own, or the next one that is free
        at = np.arange(len(of)) + np.maximum.accumulate(home - np.arange(len(of)))
        size = max(1 << q, int(at[-1]) + 1)
        occupied, runend, digit, slots = np.zeros(1 << q, bool), np.zeros(size, bool), np.zeros(size, bool), np.zeros(size, np.uint64)
        occupied[quotient] = True
        runend[at[np.flatnonzero(np.r_[home[1:] != home[:-1], True])]] = True
        digit[at] = step > 0
        slots[at] = value
        return cls(q, occupied, runend, digit, slots)

    def items(self, block: int) -> tuple[np.ndarray, np.ndarray]:
        """The sorted fingerprints and their counts."""
        quotient, end = np.flatnonzero(self.occupied), np.flatnonzero(self.runend)
        start = np.maximum(quotient, np.r_[0, end[:-1] + 1])
        sizes = end - start + 1
        at = np.repeat(start - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        digit, value = self.digit[at], self.slots[at]
        first = np.flatnonzero(~digit)
        r = np.uint64(self.remainder_bits)
        high = np.uint64(block) << np.uint64(64 - BLOCK_BITS)
        fps = high | np.repeat(quotient, sizes)[first].astype(np.uint64) << r | value[first]
        counts = np.ones(len(first), np.int64)
        if digit.any():
            own = np.cumsum(~digit) - 1
            level = np.arange(len(at)) - first[own] - 1
            np.add.at(counts, own[digit], (value[digit] << (r * level[digit].astype(np.uint64))).astype(np.int64))
        return fps, counts

    def packed(self) -> tuple[int, int, bytes, bytes, bytes, bytes]:
        """Quotient bits, number of slots, the three rows of bits, and the slots in as many whole bytes as a remainder needs."""
        wide = -(-self.remainder_bits // 8)
        slots = np.ascontiguousarray(self.slots.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide]).tobytes()
        return self.quotient_bits, len(self.slots), *(np.packbits(x).tobytes() for x in (self.occupied, self.runend, self.digit)), slots

    @classmethod
    def unpacked(cls, quotient_bits: int, n: int, occupied: bytes, runend: bytes, digit: bytes, slots: bytes) -> Filter:
        bits = lambda raw, k: np.unpackbits(np.frombuffer(raw, np.uint8), count=k).astype(bool)
        wide = -(-(64 - BLOCK_BITS - quotient_bits) // 8)
        full = np.zeros((n, 8), np.uint8)
        full[:, :wide] = np.frombuffer(slots, np.uint8).reshape(n, wide)
        return cls(quotient_bits, bits(occupied, 1 << quotient_bits), bits(runend, n), bits(digit, n), full.view("<u8").ravel().astype(np.uint64))


_FILTER = "block int, quotient_bits int, n int, occupied binary, runend binary, digit binary, slots binary"
_FILTER_NAMES = [c.split()[0] for c in _FILTER.split(", ")]


def _filter_rows(fps: np.ndarray) -> pa.RecordBatch:
    """The filters of some fingerprints, one row for each block."""
    found, counts = np.unique(fps, return_counts=True)
    block = (found >> np.uint64(64 - BLOCK_BITS)).astype(np.int32)
    starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    rows = [(int(block[a]), *Filter.of(found[a:b], counts[a:b]).packed()) for a, b in zip(starts, np.r_[starts[1:], len(block)], strict=True)]
    kinds = [pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=_FILTER_NAMES)


def partition_filters(prints: DataFrame) -> DataFrame:
    """Counting quotient filters of each partition, a row for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, held = [], 0
        for batch in batches:
            store.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            held += len(store[-1])
            if held >= HELD:
                yield _filter_rows(np.concatenate(store))
                store, held = [], 0
        if held:
            yield _filter_rows(np.concatenate(store))

    return prints.select("fp").mapInArrow(run, _FILTER)


def merge_filters(filters: DataFrame, at_least: int = 2) -> DataFrame:
    """Merge the filters of all partitions: (fp, n) of each fingerprint that counts ``at_least``.

    Blocks are dealt by their number, which is part of a hash: they are even, and a group of copies is one remainder.
    """

    def merged(block: int, parts: list[Filter]) -> pa.RecordBatch:
        fps, counts = map(np.concatenate, zip(*(f.items(block) for f in parts), strict=True))
        order = np.argsort(fps, kind="stable")  # a merge of sorted runs
        fps, counts = fps[order], counts[order]
        starts = np.flatnonzero(np.r_[True, fps[1:] != fps[:-1]])
        total = np.add.reduceat(counts, starts)
        many = total >= at_least
        return pa.RecordBatch.from_arrays([pa.array(fps[starts][many].view(np.int64)), pa.array(total[many])], names=["fp", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts = None, []  # rows come sorted by block
        for batch in batches:
            for b, *packed in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if b != block and parts:
                    yield merged(block, parts)
                    parts = []
                block = b
                parts.append(Filter.unpacked(*packed))
        if parts:
            yield merged(block, parts)

    return filters.repartition("block").sortWithinPartitions("block").mapInArrow(run, "fp bigint, n bigint")


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, keep_id, group_size, kept, text_sha256, row (a hash of the raw text).  See the module's text for the method."""
    prints = cut(fingerprints(docs, id_column, text))
    many = cut(merge_filters(partition_filters(prints)))
    # classes of the rows whose fingerprint counts more than one, aggregated before any shuffle of single rows
    first = F.min(F.struct((-F.col("n_points")).alias("p"), F.col("doc_id").isNull().alias("null"), F.col("doc_id").alias("d"))).alias("first")
    best = [first, F.count("*").alias("n")]
    if many.count() <= BROADCAST_ROWS:
        classes = prints.join(F.broadcast(many), "fp", "left_semi").groupBy("fp", "sha").agg(*best)
    else:
        classes = prints.groupBy("fp", "sha").agg(*best).join(many, "fp", "left_semi")
    classes = cut(classes.select("fp", "sha", "n", F.col("first.d").alias("keep_id"), (-F.col("first.p")).alias("keep_points")))
    total, number = prints.count(), classes.count()
    named = classes.select("fp", "sha", F.lit(True).alias("named"), "n")
    routed = prints.join(F.broadcast(named), ["fp", "sha"]) if number <= BROADCAST_ROWS else join_heavy(prints, named, ["fp", "sha"], "n", total)
    routed = cut(routed.select("row").distinct())
    verified = verify(docs, classes.select("fp", "sha", "n"), routed, text)
    classes = cut(classes.join(verified, ["fp", "sha"]).withColumnRenamed("n", "size"))
    joined = prints.join(F.broadcast(classes), ["fp", "sha"], "left") if number <= BROADCAST_ROWS else join_heavy(prints, classes, ["fp", "sha"], "size", total, "left")
    single = F.col("size").isNull()
    return joined.select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1).cast("bigint")).alias("group_size"),
        (single | ((F.col("n_points") == F.col("keep_points")) & F.col("doc_id").eqNullSafe(F.col("keep_id")))).alias("kept"),
        F.col("sha").alias("text_sha256"),
        "row",
    )


def verify(docs: DataFrame, classes: DataFrame, routed: DataFrame, text: str) -> DataFrame:
    """The classes of ``classes`` (fp, sha, n) whose rows all hold the same bytes.

    ``routed`` has the hashes of the raw texts behind the classes; no other text is normalised again.  The normalised
    texts are grouped as a whole.  Partial aggregation leaves one row per text and task before the shuffle.
    A class that held different bytes raises.
    """
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("raw"), F.xxhash64(text).alias("row"))
    texts = texts.join(F.broadcast(routed) if routed.count() <= BROADCAST_ROWS else routed, "row", "left_semi")
    texts = texts.select(F.translate("raw", BLANKS.decode(), "").alias("norm")).withColumn("sha", F.sha2(F.encode("norm", "utf-8"), 256))
    groups = texts.groupBy("sha", "norm").agg(F.count("*").alias("m"))
    found = groups.join(classes, "sha", "inner").groupBy("fp", "sha", "n").agg(F.count("*").alias("texts"), F.sum("m").alias("rows"))
    wrong = F.raise_error(F.concat(F.lit("different texts share a sha256: "), F.col("sha"))).cast("boolean")
    return found.where(F.when((F.col("texts") == 1) & (F.col("rows") == F.col("n")), True).otherwise(wrong)).select("fp", "sha")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the group of equal texts that it belongs to."""
    return exact_groups(table(spark, sf_dir, "documents")).drop("row")


#: The same result in DuckDB's SQL.
ORACLE = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n_points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT norm, count(*) AS group_size, arg_max(doc_id, (n_points, -doc_id)) AS keep_id FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256 FROM d JOIN g USING (norm)
"""
