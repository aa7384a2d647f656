"""Operator 10: mixing sources to target weights.

Each source is a stream of its documents' words, cut into blocks of ``block_words`` words (the last may be
shorter).  The mix is a list of slots, dealt to output shards; a slot takes one block.  How many slots of a shard
go to each source is a multinomial draw, conditioned on the totals that the targets ask for, so the mix has the
weights as a whole and each shard has them up to chance.  Shards lie in strata of ``STRATUM`` slots, among which each
source's slots are dealt evenly, so that the numbers a draw works with stay bounded whatever the size of the mix.
The j-th slot of a source takes the block at place j mod n of a pseudorandom permutation of the source's n blocks (a
Feistel network, walked until it lands inside): each block is taken floor or ceil of slots/n times, and nothing is stored
but a key.  Documents are joined with taken blocks by block index.

Targets: sources in order of their names by code point, null last, weigh 1, 2, 3 and so on in turn; a target stops
at 3 times its source's size and the excess goes to the others by weight.  If every target stops, the mix is
smaller than the corpus.

Cases: sizes are counts of words ``[^\\x20\\x09-\\x0D]+``; null and empty texts have size 0 and nothing is taken of them.  A
text of any length is a run of blocks, joined block by block.  Rows with the same id are counted as they come: their order
within the stream is that of id, text hash, size.  An empty table gives an empty result.  Other columns, of
whatever names, are not looked at.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkwarden.llm.common import cut, mix, quoted, spare, table

#: Words of a block.
BLOCK_WORDS = 64
#: Slots of an output shard, and of a stratum of shards: the sampler of draws takes less than 10^9.
SHARD_SLOTS = 4096
STRATUM = 1 << 28
#: Rows of a source that one window task orders.
CHUNK_ROWS = 500
#: Chunks whose sums one window task orders.
RUN_CHUNKS = 1000
WEIGHTS = (1, 2, 3)
MOST = 3
#: Rows up to which the table of copies is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 20_000


def water_fill(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Shares of the total size by weight, none above ``most`` times its own size; excess is shared again by weight."""
    target, left, open_ = [0.0] * len(sizes), float(sum(sizes)), [i for i, s in enumerate(sizes) if s]
    while open_ and left > 1e-9:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] >= most * sizes[i]]
        if not full:
            for i in open_:
                target[i] = unit * weights[i]
            break
        for i in full:
            target[i] = float(most * sizes[i])
            left -= target[i]
        open_ = [i for i in open_ if i not in set(full)]
    return target


def slot_counts(sizes: list[int], targets: list[float], block_words: int) -> tuple[list[int], list[int]]:
    """Blocks and slots of each source; the slots' words come nearest to the target and no block is taken above MOST times."""
    n_blocks = [-(-s // block_words) for s in sizes]
    return n_blocks, [min(MOST * n, round(t / s * n)) if s else 0 for s, t, n in zip(sizes, targets, n_blocks, strict=True)]


def strata_of(slots: list[int]) -> int:
    """How many strata the slots are dealt to."""
    return max(1, -(-sum(slots) // STRATUM))


def shards_of(slots: list[int], shard_slots: int) -> int:
    """Output shards of a stratum."""
    strata = strata_of(slots)
    return max(1, -(-sum(-(-s // strata) for s in slots) // shard_slots))


@functools.lru_cache(maxsize=4096)
def _split(have: tuple[int, ...], lo: int, hi: int, stratum: int, shards: int, total: int, seed: int) -> tuple[int, ...]:
    """Slots of the left half of a run of shards that has ``have`` slots of each source."""
    mid = (lo + hi) // 2
    rng = np.random.default_rng([seed, stratum, lo, hi])
    return tuple(rng.multivariate_hypergeometric(have, mid * total // shards - lo * total // shards, method="marginals").tolist())


def shard_draw(slots: list[int], shard: int, shard_slots: int, seed: int) -> tuple[list[int], list[int]]:
    """For one output shard: the number of its slots for each source, and where each source's slots begin.

    A stratum has its even share of each source's slots.  Within it draws are multinomial under the condition that the
    totals over its shards are that share.  The shards are halved again and again; each half is drawn from its parent's
    counts with a seed of its own, so a shard follows one path from the root and no task needs another's draws.
    """
    strata, shards = strata_of(slots), shards_of(slots, shard_slots)
    stratum, shard = divmod(shard, shards)
    begin = [s * stratum // strata for s in slots]
    have = tuple(s * (stratum + 1) // strata - b for s, b in zip(slots, begin, strict=True))
    lo, hi, total = 0, shards, sum(have)
    while hi - lo > 1:
        mid, left = (lo + hi) // 2, _split(have, lo, hi, stratum, shards, total, seed)
        if shard < mid:
            hi, have = mid, left
        else:
            lo, begin = mid, [b + x for b, x in zip(begin, left, strict=True)]
            have = tuple(h - x for h, x in zip(have, left, strict=True))
    return list(have), begin


def permuted(turn: np.ndarray, n: int, key: int) -> np.ndarray:
    """Where each of ``turn`` (below n) lies in a pseudorandom order of 0..n-1: a Feistel network over an even number
    of bits, applied again to what lands at n or beyond."""
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = [mix(np.array([key * 64 + r + 1], np.uint64))[0] for r in range(4)]
    out, walk = turn.astype(np.uint64), np.ones(len(turn), bool)
    while walk.any():
        a, b = out[walk] >> half, out[walk] & mask
        for k in keys:
            a, b = b, a ^ (mix(b ^ k) & mask)
        out[walk] = (a << half) | b
        walk = out >= np.uint64(n)
    return out.astype(np.int64)


def sized(docs: DataFrame, text: str = "text", source: str = "source", id_column: str = "doc_id") -> DataFrame:
    """Per row: doc_id, source, size in words and ``row``, a hash of id, source and text."""
    size = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")
    return docs.select(F.col(id_column).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), F.xxhash64(id_column, source, text).alias("row"))


def mix_sources(docs: DataFrame, seed: int = 7, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, **columns: str) -> DataFrame:
    """Per row of docs: doc_id, row, source, size, source_size, target and taken.  See the module's text."""
    spark = docs.sparkSession
    sizes = cut(sized(docs, **columns))
    # one row per source comes to the driver
    sources = sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect()
    sources.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    totals = [r["size"] for r in sources]
    targets = water_fill(totals, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(sources))])
    n_blocks, slots = slot_counts(totals, targets, block_words)
    known = spark.createDataFrame(
        [(r["source"], i, r["size"], targets[i], -(-r["rows"] // CHUNK_ROWS)) for i, r in enumerate(sources)], f"source {sizes.schema['source'].dataType.simpleString()}, src int, source_size bigint, target double, chunks bigint"
    )
    rows = sizes.alias("d").join(F.broadcast(known).alias("k"), F.expr("d.source <=> k.source")).select("d.*", "src", "source_size", "target", F.expr("pmod(row, chunks)").alias("chunk"))
    # where each row's words begin in its source's stream: sums over runs of chunks, then over chunks, then within each chunk
    before = lambda x, *keys, by: F.coalesce(F.sum(x).over(Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chunks = rows.groupBy("src", "chunk").agg(F.sum("size").alias("words")).withColumn("run", F.expr(f"chunk div {RUN_CHUNKS}"))
    runs = chunks.groupBy("src", "run").agg(F.sum("words").alias("run_words")).select("src", "run", before("run_words", "src", by=["run"]).alias("run_at"))
    chunks = chunks.join(runs, ["src", "run"]).select("src", "chunk", (F.col("run_at") + before("words", "src", "run", by=["chunk"])).alias("chunk_at"))
    placed = rows.withColumn("within", before("size", "src", "chunk", by=["doc_id", "row", "size"])).join(chunks, ["src", "chunk"]).withColumn("at", F.col("within") + F.col("chunk_at"))
    kept = ["doc_id", "row", "source", "size", "source_size", "target"]
    pieces = placed.where("size > 0").select(*kept, "src", "at", F.explode(F.expr(f"sequence(at div {block_words}, (at + size - 1) div {block_words})")).alias("block"))
    overlap = F.expr(f"least(at + size, (block + 1) * {block_words}) - greatest(at, block * {block_words})")
    # both sides grow with the corpus, and their rows are so short that a planner takes them for small: never broadcast
    taken = pieces.withColumn("words", overlap).join(taken_blocks(spark, n_blocks, slots, shard_slots, seed).hint("merge"), ["src", "block"], "left")
    taken = taken.groupBy(*kept, "src", "at").agg(F.coalesce(F.sum(F.col("words") * F.col("times")), F.lit(0)).cast("bigint").alias("taken"))
    return taken.select(*kept, "taken").unionByName(placed.where("size = 0").select(*kept, F.lit(0).cast("bigint").alias("taken")))


def taken_blocks(spark: SparkSession, n_blocks: list[int], slots: list[int], shard_slots: int, seed: int) -> DataFrame:
    """(src, block, times): how often the mix takes each block; the work is dealt by output shard."""
    shards = strata_of(slots) * shards_of(slots, shard_slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                have, begin = shard_draw(slots, shard, shard_slots, seed)
                src, block = [], []
                for i in np.flatnonzero(have):
                    turn = (begin[i] + np.arange(have[i])) % n_blocks[i]
                    block.append(permuted(turn, n_blocks[i], int(i) + 1))
                    src.append(np.full(len(turn), i, np.int32))
                if block:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(block))], names=["src", "block"])

    drawn = spark.range(shards).mapInArrow(run, "src int, block bigint")
    return drawn.groupBy("src", "block").agg(F.count("*").alias("times"))


def mixed_documents(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The documents as the mix takes them: a row for each time.

    A document of which the mix takes 1.4 times its words is returned once or twice, by a hash of its row, so
    that each source has its taken words in expectation.  Documents without words, or of which nothing was taken, go.
    """
    mixed = mix_sources(docs, seed).where("size > 0").groupBy("row").agg((F.sum("taken") / F.sum("size")).alias("times"))
    luck = F.pmod(F.xxhash64(F.col("row"), F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    mixed = cut(mixed.select("row", F.floor(F.col("times") + luck).cast("int").alias("copies")).where("copies > 0"))
    side = F.broadcast(mixed) if mixed.count() <= BROADCAST_ROWS else mixed
    row, copies, copy = spare(docs, "row", "copies", "copy")
    rows = docs.withColumn(row, F.xxhash64("doc_id", "source", "text")).join(side.select(F.col("row").alias(row), F.col("copies").alias(copies)), row)
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*map(quoted, docs.columns))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix of all sources takes."""
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
