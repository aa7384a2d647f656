"""Phrase collocations, cross-tokenizer alignment, quality rules and samples against brute force; the pipeline with clashing columns."""

import collections
import hashlib
import random
import re

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from sparkwarden.llm import alignment, bpe, collocation, common, langid, quality, quality_rules, toxicity
from sparkwarden.llm.queries import oracle_sql
from tests.conftest import same
from tests.llm.test_operators import SCHEMA, docs, none, odd_texts, tokenizer, words  # noqa: F401

BLANK = r"[^\x20\x09-\x0D]+"


# quality rules


def plain_measures(text):
    text = text or ""
    found = re.findall(BLANK, text)
    windows = collections.Counter(zip(found, found[1:], found[2:], strict=False))
    places = {k + j for k in range(len(found) - 2) if windows[tuple(found[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(BLANK, x)]
    return {
        "n_words": len(found),
        "word_chars": sum(map(len, found)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(places),
        "n_lines": len(lines),
        "n_exclamations": sum(c in "!?" for c in text),
        "n_stop_words": sum(w.lower() in quality_rules.STOP_WORDS for w in found),
        "n_letters": sum(not (c.isascii() and not c.isalpha()) for w in found for c in w),
        "n_ellipsis_lines": sum(x.rstrip(" \t\n\x0b\x0c\r").endswith(("...", "…")) for x in lines),
        "n_bullet_lines": sum(x.lstrip(" \t\n\x0b\x0c\r")[:1] in ("-", "*", "•") for x in lines),
    }


RULE_TEXTS = [None, "", " \n\t", "a", "a b c", "a b c a b c", "x x x x x", "- the one...\n* two…\n  • three\n\n \nthe end", "a b\na b\n a b\na b", "é 😀 ### $$ <b>|&|</b>\x0bü\x0c!", "The the THE of. of", "a b   c"]


def test_quality_rules_against_loops(spark):
    rng = random.Random(2)
    texts = RULE_TEXTS + [" ".join(rng.choice(["a", "b", "the", "c\n", "#", "!", "-x", "…\n"]) for _ in range(rng.randrange(120))) for _ in range(60)] + [words(30_000, 3)]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "a b c", "y")], "doc_id bigint, text string, n_words string")
    out = quality_rules.apply_rules(rows).collect()
    assert len(out) == len(texts) + 1
    for r in out:
        want = plain_measures("a b c" if r.doc_id is None else texts[r.doc_id])
        assert {k: r[k] for k in want} == want, (r.doc_id, want)
        base = want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"]
        broken = [q.name for q in quality_rules.RULES if want[q.whole] and (q.least is not None and 100 * want[q.part] < q.least * want[q.whole] or q.most is not None and 100 * want[q.part] > q.most * want[q.whole])]
        assert r.base_failed == base and r.failed_rules == broken and r.kept == (not base and not broken)
    assert quality_rules.apply_rules(rows.limit(0)).count() == 0
    assert "Python" not in quality_rules.apply_rules(rows)._jdf.queryExecution().executedPlan().toString()


def test_quality_rules_sql(spark, docs):  # noqa: F811
    import duckdb

    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(RULE_TEXTS)], "doc_id bigint, text string"))
    out = quality_rules.apply_rules(rows).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))
    con, documents = duckdb.connect(), rows.toArrow()  # noqa: F841
    same(out, con.sql(oracle_sql()["op13_quality_rules"]))


# phrase collocations


def plain_collocations(rows, least, share, top):
    counts, totals = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            counts.update((lang, tuple(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    found = {p: a for p, a in counts.items() if a >= least and len(p[1]) > 1}
    inner = collections.Counter()
    for (lang, p), a in found.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                inner[lang, p[i : i + k]] = max(inner[lang, p[i : i + k]], a)
    out = collections.defaultdict(list)
    for (lang, p), a in found.items():
        if 100 * inner[lang, p] >= share * a and inner[lang, p]:
            continue
        score, _, left, right = min((1000 * a * totals[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, rank, p.decode(), -a, left, right, totals[lang], -s) for lang, ps in out.items() for rank, (s, a, p, left, right) in enumerate(sorted(ps)[:top], 1))


def phrase_rows():
    rng = random.Random(5)
    some = ["New", "york", "new", "City", "of", "the", "é", "cat", "sat."]
    rows = [(" ".join(rng.choice(some) + rng.choice(["", "", "", ",", "\n", "\t"]) for _ in range(rng.randrange(60))), rng.choice(["en", "fr", None, "und"])) for _ in range(150)]
    return rows + [("on the cat sat the mat", "en")] * 40 + [(None, "en"), ("", None), ("a a a a a a a a a a", "fr"), (" ".join(["long", "text"] * 3000), "de")]


def test_collocations_against_loops(spark):
    rows = phrase_rows()
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "text string, lang string, phrase string, f string").repartition(5)
    out = sorted(tuple(r) for r in collocation.collocations(df, least=7, top=40).collect())
    assert out == plain_collocations(rows, 7, 100, 40) and len({r[0] for r in out}) == 4
    # looser shares, and tables that are empty or have no frequent phrase
    assert sorted(tuple(r) for r in collocation.collocations(df, least=9, share=80).collect()) == plain_collocations(rows, 9, 80, 2000)
    assert collocation.collocations(df, least=10**6).count() == 0
    assert collocation.collocations(df.limit(0), least=2).count() == 0


def test_collocations_sql(spark):
    import duckdb

    df = spark.createDataFrame([*phrase_rows()], "text string, lang string")
    con, documents = duckdb.connect(), df.toArrow()  # noqa: F841
    same(collocation.collocations(df, least=5), con.sql(collocation.oracle(5)))


def test_tries_burst_and_spill_without_losing_counts(spark):
    rng, want = random.Random(1), collections.Counter()
    trie = collocation.HatTrie(burst=4, depth=2)
    got = collections.Counter()
    for _ in range(40):
        phrases = [np.array([rng.randrange(5) for _ in range(rng.choice([3, 4, 5]))], np.int32).tobytes() for _ in range(50)]
        counts = [rng.randrange(1, 4) for _ in phrases]
        trie.add(phrases, counts)
        for p, n in zip(phrases, counts, strict=True):
            want[p] += n
        if trie.entries > 150:
            for subtree in trie.spill(60):
                assert len({p[:4] for p, _ in subtree}) == 1
                got.update(dict(subtree))
            assert trie.entries <= 60
    assert any(isinstance(box, collocation._Node) for box in trie.root.values())
    for subtree in trie.spill():
        got.update(dict(subtree))
    assert got == want and trie.entries == 0
    # a task that spills all the time gives the same sums
    df = spark.createDataFrame([(t, lang) for t, lang in phrase_rows()], "text string, lang string").repartition(2)
    sums = lambda **o: {(r.lang, r.phrase): r.f for r in collocation.merged(collocation.count_runs(df, (1, 2, 3), {}, **o), 1).collect()}
    assert sums(entries=20) == sums()


def test_scores_beyond_64_bits(spark):
    # 1000 * a * n is some 10^20 here: the same expression as in the query
    a, n, left, right = 3 * 10**7, 4 * 10**9, 5 * 10**7, 9 * 10**7
    df = spark.createDataFrame([(a, n, left, right)], "a bigint, n bigint, l bigint, r bigint")
    above = (F.col("a").cast("decimal(15,0)") * F.lit(1000)).cast("decimal(18,0)") * F.col("n").cast("decimal(19,0)")
    got = df.withColumns({"above": above, "below": F.col("l").cast("decimal(18,0)") * F.col("r").cast("decimal(19,0)")}).select(F.expr("above div below")).first()[0]
    assert got == 1000 * a * n // (left * right)


# alignment of two tokenizers


def plain_alignment(texts):
    own_a, own_b = tokenizer(), sentencepiece.SentencePieceProcessor(model_file=bpe.vocabulary_path("piece_bpe_32k.model"))
    own_a.encode_special_tokens = True
    letters = bpe._byte_alphabet()
    docs_, counts = [], collections.Counter()
    for t in texts:
        a, b, groups, links = [], [], [], []
        if t:
            ids_a, ids_b = own_a.encode(f" {t}", add_special_tokens=False).ids, own_b.encode(t)
            raw_a = [bytes(letters[c] for c in own_a.id_to_token(i)) for i in ids_a]
            raw_b = [bytes([int(p[3:5], 16)]) if own_b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [own_b.id_to_piece(i)]]
            if b"".join(raw_a) == b"".join(raw_b) == f" {t}".encode():
                a, b = ids_a, ids_b
                ends_a, ends_b = np.cumsum([0, *map(len, raw_a)]).tolist(), np.cumsum([0, *map(len, raw_b)]).tolist()
                cuts = sorted(set(ends_a) & set(ends_b))
                for lo, hi in zip(cuts, cuts[1:], strict=False):
                    groups.append(",".join(str(x) for x, e in zip(a, ends_a[1:], strict=True) if lo < e <= hi) + "|" + ",".join(str(x) for x, e in zip(b, ends_b[1:], strict=True) if lo < e <= hi))
                links = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if ends_a[i] < ends_b[j + 1] and ends_b[j] < ends_a[i + 1]]
        docs_.append((a, b, groups, links))
        counts.update(links)
    best = collections.Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [(len(a), len(b), len(g), len(x), sum(counts[p] == best[p[1]] for p in x), sum(counts[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "", ";".join(g)) for a, b, g, x in docs_]


ALIGN_TEXTS = [
    *[None, "", " ", "  ", "a", " a  b", "a\n\nb\n", "x\xa0 y", "\xa0  y", "<|endoftext|> <s>a</s><unk>", "▁x▁", "a▁ b", "\x1c a,\x1cb", "日本語のテキスト。　x"],
    *["\U0001f600 ok", "a\tb\t\tc\r\nd", "\n", "\t\tx", "'s don't I'll  'S", "x" * 300 + " " + "ab" * 200, "\x00 a\x00b", "  \n \n  a   ", "A" * 90, "same text", "same text", "Unbelievable tokenization, indeed!"],
]


def test_alignment_against_loops(spark):
    rng = random.Random(3)
    some = ["a", "the", " ", "  ", "\n", "é", "é", "▁", ",", "!!", "'s", "12", "½", "漢", "\x85", "\t", "\x1e", "<s>", "Z", "​", "token"]
    texts = ALIGN_TEXTS + ["".join(rng.choice(some) for _ in range(rng.randint(1, 30))) for _ in range(80)] + [t for _, t in odd_texts() if len(t or "") < 3000]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id bigint, text string, pair string, n string").repartition(3)
    want = plain_alignment(texts)
    for known in (alignment.KNOWN, 60):  # with few pairs broadcast most counts come by the join
        out = alignment.align_documents(df, known_pairs=known, with_groups=True).orderBy("doc_id").collect()
        assert [tuple(r)[1:] for r in out] == want
    assert alignment.align_documents(df.limit(0)).count() == 0
    repeated = spark.createDataFrame([(None, "one two"), (1, "one two"), (1, "one two")], "doc_id bigint, text string")
    assert sorted(tuple(r)[1:7] for r in alignment.align_documents(repeated).collect()) == sorted(w[:6] for w in plain_alignment(["one two"] * 3))


def test_alignment_reads_and_encodes_each_text_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        read.add(1)
        return text

    texts = [words(20, i) for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("text", counted.asNondeterministic()("text"))
    got = alignment.align_documents(df).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == [w[:7] for w in plain_alignment(texts)]
    assert read.value == len(texts)


def test_links_are_packed_by_the_size_of_ids(monkeypatch):
    rows = [[(50_256, 31_999), (0, 0)], [], [(1, 65_535)] * 3, []]
    want = [a << 32 | b for row in rows for a, b in row]
    monkeypatch.setattr(alignment, "LINK_BYTES", 8)
    for shift, width in ((16, 4), (32, 8)):
        names = [str(i) for i in range(65_536)]
        packed = [b"".join(alignment.align([a], [1], [b], [1], names, names, shift).links for a, b in row) for row in rows]
        assert [len(x) for x in packed] == [width * len(row) for row in rows]
        runs = list(alignment.packed_links(pa.array([b"", *packed], pa.binary()).slice(1), pa.array(list(map(len, rows)))))
        assert len(runs) > 1 and [r for at, end, *_ in runs for r in range(at, end)] == [0, 1, 2, 3]
        assert [x for _, _, links, _ in runs for x in alignment.as_pairs(links).tolist()] == want
        assert [n for *_, offs in runs for n in np.diff(offs).tolist()] == list(map(len, rows))


def test_gallop():
    rng = random.Random(7)
    for _ in range(300):
        a, b = (sorted(rng.sample(range(400), rng.randrange(60))) for _ in "ab")
        short, long = sorted((a, b), key=len)
        assert alignment.gallop(short, long) == [(short.index(x), long.index(x)) for x in sorted(set(a) & set(b))]


# samples


def test_samples_hold_every_class(spark):
    many = [(f"good {i} {words(6, i)}", 1) for i in range(300)] + [("the only bad one", 0)] * 2000 + [("x" * 5000 + " y", 2)] + [(None, 1)]
    df = spark.createDataFrame(many, "text string, label int").repartition(4)
    got = common.fetched(df, common.chosen_texts(common.light_texts(df, ("label",)), 50, 40_000, ("label",)), 40_000, ("label",)).collect()
    by = collections.Counter(r.label for r in got)
    assert by[0] == by[2] == 1 and by[1] == 50
    assert len(next(r.text for r in got if r.label == 2)) <= 40_000 // 64 + 16
    assert len(common.bounded_sample(df.select("text"), 1000).collect()) == 303
    assert common.bounded_sample(df.select("text").limit(0), 5).count() == 0


def repeated(spark, df, times):
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times)))).withColumn("doc_id", F.col("doc_id") * 100_000 + F.col("copy")).drop("copy")


def language_rows():
    english, french = "the quick house of stones and the river was that".split(), "le chat dans la maison des pierres que les rivières été".split()
    rng = random.Random(4)
    make = lambda w: " ".join(rng.choice(w) for _ in range(40))
    return [(i, make(english), "en") for i in range(60)], [(1000 + i, make(french), "fr") for i in range(6)]


def test_language_of_repeats_alone_is_learnt(spark):
    english, french = language_rows()
    schema = "doc_id bigint, text string, lang string"
    en, fr = spark.createDataFrame(english, schema), spark.createDataFrame(french, schema)
    model = langid.learn(en.unionByName(repeated(spark, fr, 2000)))
    assert model.langs == ["en", "fr"]
    found = langid.identify(fr, model, ("doc_id",)).collect()
    assert {r.lang_pred for r in found} == {"fr"}
    # and one of long texts alone
    long = fr.withColumn("text", F.repeat(F.concat("text", F.lit(" ")), 1500))
    assert langid.learn(en.unionByName(long)).langs == ["en", "fr"]
    with pytest.raises(ValueError):
        langid.identify(fr.withColumn("score", F.lit(1)), model, ("doc_id", "score"))


def test_labels_of_repeats_alone_are_learnt(spark):
    good = [(i, "fine prose about " + words(60, i), 1) for i in range(120)]
    bad = [(1000 + i, ("BUY NOW!! " * 30) + str(i), 0) for i in range(3)]
    df = spark.createDataFrame(good, "doc_id bigint, text string, label int").unionByName(repeated(spark, spark.createDataFrame(bad, "doc_id bigint, text string, label int"), 3000))
    docs_, labels = df.select(F.col("doc_id").alias("key"), "text"), df.select(F.col("doc_id").alias("key"), "label")
    model = quality.fit(docs_, labels)
    assert model.good and model.bad and model.slope > 0
    test = spark.createDataFrame([(1, "fine prose about " + words(60, 7000)), (2, "BUY NOW!! " * 25)], "doc_id bigint, text string")
    scores = {r.doc_id: r.score for r in quality.score(test, model, ("doc_id",)).collect()}
    assert scores[1] > scores[2]
    weights = toxicity.fit(docs_, labels)
    scores = {r.doc_id: r.score for r in toxicity.score(test, weights, ("doc_id",)).collect()}
    assert scores[1] > scores[2]
    # one text above 64 KB is all that a label has
    long = spark.createDataFrame([(99_999, "spam " * 30_000, 0)], "doc_id bigint, text string, label int").unionByName(df.where("label = 1"))
    model = quality.fit(long.select(F.col("doc_id").alias("key"), "text"), long.select(F.col("doc_id").alias("key"), "label"))
    assert model.bad and model.slope > 0


# the pipeline


def test_language_stage_against_the_model(spark):
    english, french = language_rows()
    rows = [*english, *french, (2000, None, "en"), (2001, "12 34", "en"), (2002, "zzxq qqzx xzqj " * 20, None)]
    df = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    model = langid.learn(df)
    want = set()
    for i, t, _ in rows:
        if t and re.search(r"[^\W\d_]", t):
            data = np.frombuffer(t.lower().encode(), np.uint8)
            _, _, far = model.judge(langid.count_grams(data, np.array([0, len(data)])))
            want |= set() if far[0] else {i}
    assert {r.doc_id for r in corpus_pipeline.language_id(spark, df, "").collect()} == want and 2002 not in want and len(want) >= 60


def test_extra_columns_keep_their_values(spark):
    names = ["row", "copies", "copy", "_letters", "__letters", "_hash", "id", "hash", "kept", "label", "score", "rejected", "lang_pred", "hash_of_text", "kept_id", "kept_hash", "a.b", "ti`ck"]
    base = words(60, 5)
    rows = [(i, words(40 + i % 30, i), "en", f"s{i % 3}", 5) for i in range(40)] + [(100, base, "en", "s0", 1), (101, base + " ", "en", "s0", 1), (100, base, "en", "s0", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    df = df.select("*", *(F.concat(F.lit(f"{k} "), F.col("doc_id")).alias(n) for k, n in enumerate(names)))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = common.cut(stage(spark, df, ""))
        assert out.columns == df.columns
        got = out.collect()
        assert got and all(r[n] == f"{k} {r.doc_id}" for r in got for k, n in enumerate(names))
        df = out
    assert corpus_pipeline.STAGES[-1][1](spark, df, "").count() == len(got)
