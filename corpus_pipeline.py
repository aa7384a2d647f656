"""A pipeline over documents: language ID, exact dedup, near dedup, mixing of sources, and BPE encoding.

Each stage is (spark, docs, sf_dir) -> DataFrame; what it returns is written as Parquet and read again as the next
one's docs.  All but the last return the columns of documents.

Cases, for all stages: null texts and texts without a letter go in the first stage; given to a later one, null counts as
empty, empty texts are one group of copies, are near copies of nothing, and go in the mix, as they have no words.  Texts
of any length are worked on whole.  Of equal or near texts one row stays: by length and id, or by id; of repeated rows (same
id, same text) one.  Null ids stay like others and come last in ties.  Null sources are one source.  Empty tables
give empty tables.  Columns beyond those of documents keep their values in all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.llm import bpe, exact_dedup, langid, mixing, near_dedup
from sparkwarden.llm.common import cut, quoted, spare, table

#: Rows (id and hash) up to which the rows to keep are broadcast; any larger table is joined by shuffle.
BROADCAST_ROWS = 20_000


def _only(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """The rows of docs that keep (id, hash of the text) names; of repeated rows one."""
    own, i, h = spare(docs, "hash_of_text", "kept_id", "kept_hash")
    keep = cut(keep.distinct().select(F.col("id").alias(i), F.col("hash").alias(h)))
    small = keep.count() <= BROADCAST_ROWS
    hashed, columns = docs.withColumn(own, F.xxhash64("text")), [quoted(c) for c in docs.columns]
    again = cut(hashed.groupBy("doc_id", own).agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias(i), F.col(own).alias(h)))
    same = F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(own) == F.col(h))
    kept = hashed.join(F.broadcast(keep) if small else keep, same, "left_semi")
    if not again.count():
        return kept.select(*columns)
    several = kept.join(again, same, "left_semi").dropDuplicates(["doc_id", own])
    return kept.join(again, same, "left_anti").unionByName(several).select(*columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without a letter and those far from every language go."""
    model = langid.learn(docs)
    columns, names = tuple(docs.columns), spare(docs, "lang_pred", "score", "rejected")
    return langid.identify(docs, model, columns, names=tuple(names)).where(~F.col(names[2])).select(*map(quoted, columns))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts; of repeated rows one."""
    groups = exact_dedup.exact_groups(docs).where("kept").groupBy("text_sha256")
    best = groups.agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row")).alias("best"))
    return _only(docs, best.select(F.col("best.doc_id").alias("id"), F.col("best.row").alias("hash")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    found = near_dedup.near_classes(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "text_hash")).alias("first")
    chosen = found.where("label IS NOT NULL").groupBy("label").agg(first).select(F.col("first.doc_id").alias("id"), F.col("first.text_hash").alias("hash"))
    wordless = found.where("label IS NULL").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    return _only(docs, chosen.union(wordless))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with digests of the ids and of what they decode to."""
    return bpe.encode_documents(docs, columns=("doc_id", "source"))


STAGES = [("language ID", language_id), ("exact dedup", exact_copies), ("n-gram Jaccard join", near_copies), ("mixing sources to target weights", mixing_sources), ("BPE encoding and decoding", bpe_encoding)]

#: Language ID, near dedup by MinHash, the mix and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
