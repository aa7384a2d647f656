"""The pipeline's stages on a small table, each against brute force on its own input."""

import collections
import hashlib

import corpus_pipeline
from pyspark.sql import functions as F
from sparkwarden.llm import mixing
from sparkwarden.llm.common import cut
from tests.llm.test_operators import plain_classes, tokenizer, words

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def table(spark):
    base = words(60, 5)
    near = base.split()
    near[30] = "other"
    rows = [(i, words(40 + i % 30, i)) for i in range(60)] + [(100, base), (101, base + " "), (102, " ".join(near)), (103, None), (104, "12 34"), (100, base)]
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows], SCHEMA)


def test_stages(spark):
    docs, seen = table(spark), {}
    for name, stage in corpus_pipeline.STAGES:
        out = cut(stage(spark, docs, ""))
        seen[name] = ([(r.doc_id, getattr(r, "text", None)) for r in docs.collect()], out.collect(), out.columns, out)
        docs = out
    columns = table(spark).columns
    assert all(seen[n][2] == columns for n, _ in corpus_pipeline.STAGES[:-1])
    given, left, *_ = seen["language ID"]
    assert {i for i, _ in given} - {r.doc_id for r in left} == {103, 104}
    given, left, *_ = seen["exact dedup"]
    assert sorted(r.text.replace(" ", "") for r in left) == sorted({t.replace(" ", "") for _, t in given})
    assert 101 in {r.doc_id for r in left} and 100 not in {r.doc_id for r in left}  # the longest stays
    given, left, *_ = seen["n-gram Jaccard join"]
    root, _ = plain_classes(given)
    at = {i: k for k, (i, _) in enumerate(given)}
    kept = collections.Counter(root[at[r.doc_id]] for r in left)
    assert set(kept) == set(root) and set(kept.values()) == {1}
    given, left, *_ = seen["mixing sources to target weights"]
    copies = collections.Counter((r.doc_id, r.text) for r in left)
    assert set(copies) <= set(given)
    mixed = {(r.doc_id): (r.size, r.taken) for r in mixing.mix_sources(seen["n-gram Jaccard join"][3]).collect()}
    for i, t in given:  # a document comes as often as its words are taken, up to the chance of a fraction
        size, taken = mixed[i]
        assert size == len(t.split()) and copies[i, t] in (taken // size, -(-taken // size))
    assert abs(sum(mixed[r.doc_id][0] for r in left) / sum(t for _, t in mixed.values()) - 1) < 0.25
    given, left, *_ = seen["BPE encoding and decoding"]
    other = tokenizer()
    encoded = collections.Counter((i, tuple(other.encode(t, add_special_tokens=False).ids)) for i, t in given)
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in left) == encoded
    assert all(r.n_tokens == len(r.ids) and r.decoded_sha256 == hashlib.sha256(other.decode(r.ids, skip_special_tokens=False).encode()).hexdigest() for r in left)


def test_empty_table(spark):
    docs = table(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, ""))
    assert docs.count() == 0


def test_odd_rows_and_extra_columns(spark):
    docs = table(spark).union(table(spark).where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("bigint")).withColumn("text", F.lit(words(50, 777))))
    docs = docs.unionByName(docs.where("doc_id = 4").withColumn("source", F.lit(None).cast("string")).withColumn("doc_id", F.lit(2000).cast("bigint")).withColumn("text", F.lit(words(30_000, 9))))
    docs = docs.withColumn("row", F.lit("extra")).withColumn("key", F.lit(1))
    for name, stage in corpus_pipeline.STAGES:
        out = cut(stage(spark, docs, ""))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            if name != "mixing sources to target weights":
                assert out.where("doc_id IS NULL").count() == 1 and out.where("doc_id = 2000").count() == 1, name
        docs = out
    # null texts given to later stages
    null = table(spark).where("doc_id >= 100")
    assert corpus_pipeline.exact_copies(spark, null, "").where("doc_id = 103").count() == 1
    assert corpus_pipeline.near_copies(spark, null, "").where("doc_id = 103").count() == 1
    assert corpus_pipeline.mixing_sources(spark, null, "").where("doc_id = 103").count() == 0
    assert corpus_pipeline.bpe_encoding(spark, null, "").where("doc_id = 103").first().n_tokens == 0
