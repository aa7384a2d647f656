"""Operator 6: n-gram Jaccard join by MinHash banding.

1. Each text becomes its set of hashed shingles of five words (lower case, punctuation apart).  Texts with equal
   sets are one class; only a class's first document goes on.
2. MinHash signatures are cut into bands.  Rows per band and bands are chosen for the target recall at the
   threshold.  Classes are shuffled on band hashes.  Buckets with the same members as another bucket go: they
   hold the same pairs.
3. Sets of a bucket lie in levels of size, a factor ``STEP`` each; only sets of the same or of neighbouring levels can reach
   the threshold.  Levels are cut into blocks that are bounded in classes and in shingles, and each pair of blocks is one
   piece of work, so a bucket of any size is spread over many tasks.  Within it pairs are verified on their full shingle
   sets, by one product of incidence matrices; a pair that several buckets hold counts in the first of them only.  What
   leaves the task is not the pairs but each class's number of links, and a spanning forest of them.
4. Connected components of the forests give the classes of near copies.

Cases: texts of one to four words have their whole run of words as one shingle.  Texts without words (null and empty
ones too) have an empty set: they are linked to nothing and stay classes of their own.  Texts of any length are read and
compared whole.  Exact copies and repeated rows are linked to each other: ``n_links`` counts all other rows whose Jaccard
similarity is the threshold or more.  Ids may be of any type that can be ordered.  A null doc_id is kept; it is a class's
name only if no other id is there.  An empty table gives an empty result.  Extra columns, of whatever names, are passed
by.  A class with a large share of all rows is one row before any shuffle, and is joined back by a broadcast of the few
such classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.llm.common import blocks, cut, forget, join_heavy, map_texts, mix, shingle_hashes, table, text_column, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
#: Chance that a pair exactly at the threshold shares a band.
RECALL = 0.9999
#: Hash functions at most.
HASHES = 96
#: Classes and shingles of a block, on average; a pair of blocks is one piece of work.
BLOCK = 1024
BLOCK_SHINGLES = 1 << 19
#: Sets in levels two apart differ in size by more than this factor, which must be above 1 / THRESHOLD.
STEP = 1.26
#: Rows (some 400 bytes each once hashed) up to which the table of classes to verify is broadcast to the scan of texts; beyond, texts are joined by shuffle.
BROADCAST_ROWS = 100_000


def choose_bands(threshold: float, recall: float, hashes: int) -> tuple[int, int]:
    """Bands and rows: the most rows per band (fewest false candidates) whose bands for the recall need at most ``hashes``."""
    best = (math.ceil(math.log(1 - recall) / math.log(1 - threshold)), 1)
    for rows in range(2, hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
        if bands * rows > hashes:
            break
        best = (bands, rows)
    return best


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    return (seeds[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[n:] >> np.uint64(32)).astype(np.uint32)


def band_hashes(shingles: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash per band of the MinHash signature of a set."""
    a, b = _coefficients(bands * rows)
    least = np.full(bands * rows, 0xFFFFFFFF, np.uint32)
    base = (mix(shingles) >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(base), 4096):
        part = a[:, None] * base[None, at : at + 4096]
        part += b[:, None]
        part ^= part >> np.uint32(15)
        part *= np.uint32(0x2C1B3C6D)
        np.minimum(least, part.min(axis=1), out=least)
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for column in least.reshape(bands, rows).T:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return out.view(np.int64)


def _sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted shingle set of each text."""
    for _, data, offsets in blocks(pc.utf8_lower(texts)):
        words, first = word_hashes(data, offsets)
        for a, b in zip(first[:-1], first[1:], strict=True):
            yield np.unique(shingle_hashes(words[a:b], SHINGLE))


def _key(s: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return (mix(s).sum(dtype=np.uint64) + np.uint64(len(s))).tobytes() + np.bitwise_xor.reduce(s, initial=np.uint64(0)).tobytes()


def signatures(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(doc_id, text) to doc_id, text_hash, key (null without words), size of the set, bands."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash bigint, key binary, size bigint, bands array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, found, counts = [], [], [], [0]
            for s in _sets(text_column(batch.column(1))):
                keys.append(_key(s) if len(s) else None)
                sizes.append(len(s))
                if len(s):
                    found.append(band_hashes(s, bands, rows))
                counts.append(bands * bool(len(s)))
            flat = np.concatenate(found) if found else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(counts), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), lists], names=["doc_id", "text_hash", "key", "size", "bands"])

    return map_texts(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), run, schema)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(key, copies, level, buckets, text) to key, copies, level, buckets and the set as 8-byte hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sets = pa.array([s.tobytes() for s in _sets(text_column(part.column(4)))], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:4], sets], names=["key", "copies", "level", "buckets", "shingles"])

    columns = docs.select("key", "copies", "level", "buckets", "text")
    return map_texts(columns, run, f"key binary, copies bigint, level int, buckets {docs.schema['buckets'].dataType.simpleString()}, shingles binary")


def _intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of incidence matrices over slices of the shared shingles."""
    flat = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in [*left, *right]])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.r_[True, flat[1:] != flat[:-1]]
    number = np.cumsum(new) - 1
    shared = np.bincount(number) > 1  # a shingle of one class alone is in no intersection
    keep = shared[number]
    number, owner = (np.cumsum(shared) - 1)[number[keep]], owner[keep]
    out, wide = np.zeros((len(left), len(right)), np.float32), 1024
    for lo in range(0, int(shared.sum()), wide):
        a, b = np.searchsorted(number, [lo, lo + wide])
        m = np.zeros((len(left) + len(right), wide), np.float32)
        m[owner[a:b], number[a:b] - lo] = 1
        out += m[: len(left)] @ m[len(left) :].T
    return out


def _met_before(left: list[np.ndarray], right: list[np.ndarray], bucket: int) -> np.ndarray:
    """Which pairs share a bucket before this one."""
    ids = np.unique(np.concatenate([*left, *right]))
    ids = ids[ids < bucket]
    if not len(ids):
        return np.zeros((len(left), len(right)), bool)

    def incidence(rows: list[np.ndarray]) -> np.ndarray:
        m = np.zeros((len(rows), len(ids)), np.float32)
        flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        some = flat < bucket
        m[owner[some], np.searchsorted(ids, flat[some])] = 1
        return m

    return incidence(left) @ incidence(right).T > 0


def _links(rows: list[tuple], other: list[tuple], bucket: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a block are linked to which of another, in this bucket before any other that they share."""
    a, b = [r[3] for r in rows], [r[3] for r in other]
    both = _intersections(a, b)
    total = np.array([len(s) for s in a])[:, None] + np.array([len(s) for s in b])[None, :] - both
    near = both >= THRESHOLD * total - 1e-6
    if same:
        near &= np.tri(len(a), k=-1, dtype=bool)
    if near.any():
        near &= ~_met_before([r[2] for r in rows], [r[2] for r in other], bucket)
    return np.nonzero(near)


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of each node's component."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def verify_buckets(members: DataFrame) -> DataFrame:
    """(bucket, p, q, blk, key, copies, bucket_ids, shingles), sorted by bucket, p, q, to (key, links, root)."""

    def work(at: tuple, rows: list[tuple]) -> pa.RecordBatch:
        bucket, p, q = at
        left, right = [r for r in rows if r[4] == p], [r for r in rows if r[4] == q]
        if p == q:
            nodes, (i, j) = left, _links(left, left, bucket, True)
        else:
            nodes = left + right
            i, j = _links(left, right, bucket, False) if left and right else (np.zeros(0, int), np.zeros(0, int))
            j = j + len(left)
        copies = np.array([r[1] for r in nodes])
        links = np.zeros(len(nodes), np.int64)
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        root = _forest(len(nodes), i, j)
        some = np.flatnonzero(links)
        keys = [nodes[k][0] for k in some]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(links[some]), pa.array([nodes[root[k]][0] for k in some], pa.binary())], names=["key", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for batch in batches:
            lists = [batch.column(k) for k in range(8)]
            places = list(zip(*(c.to_pylist() for c in lists[:3]), strict=True))
            for k, place in enumerate(places):
                if place != at:
                    if len(rows) > 1:
                        yield work(at, rows)
                    at, rows = place, []
                key = lists[4][k].as_py()
                if rows and rows[-1][0] == key:  # the first document of a class may be a repeated row
                    continue
                rows.append((key, lists[5][k].as_py(), lists[6][k].values.to_numpy(), np.frombuffer(lists[7][k].as_buffer(), np.uint64).copy(), lists[3][k].as_py()))
        if len(rows) > 1:
            yield work(at, rows)

    return members.select("bucket", "p", "q", "blk", "key", "copies", "bucket_ids", "shingles").mapInArrow(run, "key binary, links bigint, root binary")


def components(edges: DataFrame) -> DataFrame:
    """(key, root) edges to (key, label): the least key of each connected component.

    Labels spread along edges and then jump along labels, so long chains take few rounds.  Each round is written to
    the shared folder; a node with very many edges is aggregated before the shuffle.
    """
    both = cut(edges.where("key != root").selectExpr("key AS u", "root AS v").union(edges.where("key != root").selectExpr("root AS u", "key AS v")).distinct())
    labels = cut(both.groupBy("u").agg(F.min("v").alias("l")).select("u", F.least("u", "l").alias("l")))
    while True:
        near = both.join(labels.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("l").alias("m"))
        low = labels.join(near, "u").select("u", "l", F.least("l", "m").alias("m"))
        jump = low.join(labels.selectExpr("u AS m", "l AS k"), "m", "left").select("u", "l", F.least("m", "k").alias("m"))
        new = cut(jump)
        if new.where("m != l").isEmpty():
            forget(new, both)
            return labels.selectExpr("u AS key", "l AS label")
        forget(labels)
        labels = new.selectExpr("u", "m AS l")


def bucket_levels(banded: DataFrame) -> DataFrame:
    """(key, level, size, bucket) to bucket and its levels (level, parts), where two classes or more may be linked.

    A bucket with the same members as another goes.  A level is cut into parts by its classes and their shingles.
    """
    parts = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("parts")
    by_level = banded.groupBy("bucket", "level").agg(F.count("*").alias("n"), F.sum(F.xxhash64("key").cast("decimal(20,0)")).alias("s"), parts)
    buckets = by_level.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.array_sort(F.collect_list(F.struct("level", "parts"))).alias("levels")).where("n > 1")
    return buckets.groupBy("n", "s").agg(F.min(F.struct("bucket", "levels")).alias("b")).select("b.*")


def near_classes(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, text_hash, class_id (the least doc_id of its class), n_links, class_size, kept, and label (the class; null without words)."""
    bands, rows = choose_bands(THRESHOLD, RECALL, HASHES)
    prints = cut(signatures(docs, bands, rows))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "text_hash")).alias("first")
    classes = prints.where("key IS NOT NULL").groupBy("key").agg(first, F.count("*").alias("copies"), F.min("size").alias("size"), F.min("bands").alias("bands"))
    level = F.floor(F.log(F.col("size")) / F.log(F.lit(STEP))).cast("int").alias("level")
    classes = cut(classes.select("key", F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash"), "copies", "size", level, "bands"))
    banded = classes.select("key", "level", "size", F.explode("bands").alias("bucket"))
    held = banded.join(bucket_levels(banded), "bucket")
    # the blocks of a bucket that a class meets: those of its own level and of the two beside it
    met = F.expr("filter(levels, l -> abs(l.level - level) <= 1)")
    held = held.select("key", F.struct("bucket", met.alias("levels")).alias("b")).groupBy("key").agg(F.collect_list("b").alias("buckets"))
    held = cut(held.join(classes.select("key", "doc_id", "text_hash", "copies", "level"), "key"))
    # the texts of these classes alone
    side = F.broadcast(held) if held.count() <= BROADCAST_ROWS else held
    texts = docs.select(F.col("doc_id").alias("id"), "text", F.xxhash64("text").alias("h")).join(side.alias("s"), F.expr("h = text_hash AND id <=> doc_id"))
    members = shingle_sets(texts).withColumn("bucket_ids", F.col("buckets.bucket")).select("key", "copies", "level", "shingles", "bucket_ids", F.inline("buckets"))
    part = F.expr("pmod(xxhash64(key), element_at(filter(levels, l -> l.level = level), 1).parts)")
    number = "cast(l.level as bigint) * 1048576"
    members = members.withColumn("blk", F.expr("cast(level as bigint) * 1048576") + part)
    members = members.withColumn("other", F.explode(F.expr(f"flatten(transform(levels, l -> transform(sequence(0, l.parts - 1), j -> {number} + j)))")))
    members = members.withColumn("p", F.least("blk", "other")).withColumn("q", F.greatest("blk", "other"))
    found = cut(verify_buckets(members.repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q", "key")))
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    labels = components(found.select("key", "root"))
    own = classes.select("key", "doc_id", "copies").join(links, "key", "left").join(labels, "key", "left")
    own = cut(own.select("key", "copies", "doc_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("label", "key").alias("label")))
    names = own.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.sum("copies").alias("class_size"))
    named = cut(own.join(names, "label").select("key", "copies", "label", "class_id", "n_links", "class_size"))
    rows_of = prints.select("doc_id", "text_hash", "key")
    joined = join_heavy(rows_of, named, ["key"], "copies", prints.count(), "left")  # rows without words have no key and meet none
    lone = F.col("key").isNull()
    return joined.select(
        "doc_id",
        "text_hash",
        F.when(lone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
        F.coalesce("class_size", F.lit(1).cast("bigint")).alias("class_size"),
        (lone | F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept"),
        "label",
    )


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near copies and the number of its links."""
    return near_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "class_size", "kept")
