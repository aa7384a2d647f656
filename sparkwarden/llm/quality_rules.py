"""Operator 13: quality rules, a table of thresholds compiled into one projection.

``MEASURES`` are counts of a text; a ``Rule`` bounds the ratio of two of them.  ``apply_rules`` turns a table of rules into
columns: every measure, the names of the rules that a text fails, and whether it is kept.  All of it is built-in column
functions within one stage: no user function, no shuffle, no state between rows.  Ratios are compared as products of whole
numbers, so that no rounding decides.

A word is a run of ``[^\\x20\\x09-\\x0D]``.  Words in repeated windows are found by sorting a text's windows of three words
with their places: neighbours that are equal repeat, and each start of a repeated window covers three words, or fewer where
the next start is nearer.  So the work is that of one sort, however long the text and however often a window repeats.

Cases: a null text counts as empty; a text without words has no ratio to fail but fails the base rule of 50 words.  Equal
rows get equal results.  Texts of any length are measured whole.  A ratio just at its bound passes.  An empty table gives an
empty result.  Other columns, of whatever names, are passed by; the columns asked for must not be named as those of the result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.llm.common import table

#: What separates words, and what counts as a symbol.
BLANKS, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
#: Frequent words of four languages, in lower case.
STOP_WORDS = (
    *("the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "on", "was", "be", "as", "with", "by", "this", "are", "at", "from"),
    *("der", "die", "das", "und", "den", "von", "zu", "ist", "nicht", "ein", "eine", "mit", "auf", "dem", "des", "sich", "im"),
    *("le", "la", "les", "de", "et", "un", "une", "que", "qui", "en", "pas", "pour", "dans", "il", "du", "au", "est"),
    *("el", "los", "las", "del", "y", "no", "por", "con", "su", "para", "se", "lo", "una", "es"),
)


@dataclass(frozen=True)
class Rule:
    """A text passes if ``least`` <= 100 * part / whole <= ``most``; without a whole (0) it passes."""

    name: str
    part: str
    whole: str
    least: int | None = None
    most: int | None = None


#: The rules that a text of the base's length has to pass; bounds in hundredths.
RULES = (
    Rule("word_length", "word_chars", "n_words", 200, 1500),
    Rule("symbols", "n_symbols", "n_words", None, 25),
    Rule("exclamations", "n_exclamations", "n_words", None, 40),
    Rule("stop_words", "n_stop_words", "n_words", 2, None),
    Rule("letters", "n_letters", "word_chars", 60, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 50),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 50),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 90),
)


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with value computed once a row, however often ``of`` names it."""
    return F.transform(F.array(value), of)[0]


def n_of(text: Column, characters: str) -> Column:
    """How many of the text's characters are among these."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def words_of(text: Column) -> Column:
    """The words of a text, in order."""
    return F.array_remove(F.split(F.translate(text, BLANKS[1:], " " * (len(BLANKS) - 1)), " "), "")


def window_hashes(words: Column, size: int = 3) -> Column:
    """A hash for each word and the ``size`` - 1 words behind it, as far as there are some."""
    return F.transform(words, lambda w, i: F.xxhash64(w, *(F.get(words, i + j) for j in range(1, size))))


def repeated_words(words: Column, hashes: Column, size: int = 3) -> Column:
    """How many words stand in windows of ``size`` words that occur twice or more.

    ``hashes`` (``window_hashes``) are looked at first: most texts have no two equal ones, hence no repeated window,
    and need no sort.  Words themselves are compared where some are equal.
    """

    def ordered(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(w) - size)
        return F.sort_array(F.transform(places, lambda i: F.struct(*(w[i + j].alias(f"w{j}") for j in range(size)), i.alias("at"))))

    def starts(s: Column) -> Column:
        pairs = F.zip_with(s, F.slice(s, F.lit(2), F.size(s)), lambda x, y: F.when(_equal(x, y, size), F.array(x["at"], y["at"])))
        return F.array_distinct(F.flatten(F.array_compact(pairs)))

    def covered(p: Column) -> Column:
        reach = F.zip_with(p, F.slice(p, F.lit(2), F.size(p)), lambda x, y: F.least(F.lit(size), F.coalesce(y - x, F.lit(size))))
        return F.aggregate(reach, F.lit(0), lambda total, r: total + r)

    places = let(ordered(words), starts)
    some = (F.size(words) > size) & (F.size(F.array_distinct(hashes)) < F.size(hashes))
    return F.coalesce(F.when(some, let(F.sort_array(places), covered)), F.lit(0)).cast("long")


def _equal(x: Column, y: Column, size: int) -> Column:
    out = x["w0"] == y["w0"]
    for j in range(1, size):
        out = out & (x[f"w{j}"] == y[f"w{j}"])
    return out


def prepared(docs: DataFrame, columns: Sequence[str], text: str) -> DataFrame:
    """``columns``, and a struct ``__of`` of what the measures share: words, lines with a word, the words without blanks, window hashes.

    The struct is made in two projections, so that nothing shared is computed twice a row.
    """
    own = [F.col(f"`{c}`") for c in columns]
    body, of = F.coalesce(F.col(f"`{text}`"), F.lit("")), F.col("__of")
    split = docs.select(*own, F.struct(words_of(body).alias("words"), F.filter(F.split(body, "\n"), lambda x: F.trim(x, F.lit(BLANKS)) != "").alias("lines")).alias("__of"))
    return split.withColumn("__of", F.struct(of.words.alias("words"), of.lines.alias("lines"), F.array_join(of.words, "").alias("solid"), window_hashes(of.words).alias("windows")))


def measures(of: Column) -> dict[str, Column]:
    """Every measure of a text by name, from the struct of ``prepared``."""
    words, lines, solid = of["words"], of["lines"], of["solid"]
    return {
        "n_words": F.size(words),
        "word_chars": F.length(solid),
        "n_symbols": n_of(solid, SYMBOLS),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": repeated_words(words, of["windows"]),
        "n_lines": F.size(lines),
        "n_exclamations": n_of(solid, "!?"),
        "n_stop_words": F.size(F.filter(F.split(F.lower(F.array_join(words, " ")), " "), lambda w: w.isin(*STOP_WORDS))),
        "n_letters": F.length(F.translate(solid, MARKS, "")),
        "n_ellipsis_lines": F.size(F.filter(lines, lambda x: F.rtrim(x, F.lit(BLANKS)).endswith("...") | F.rtrim(x, F.lit(BLANKS)).endswith("…"))),
        "n_bullet_lines": F.size(F.filter(lines, lambda x: F.substring(F.ltrim(x, F.lit(BLANKS)), 1, 1).isin("-", "*", "•"))),
    }


#: ASCII characters that are neither letters nor blanks.
MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalpha())


def fails(rule: Rule) -> Column:
    """Whether the measures of a row break the rule."""
    part, whole = F.lit(100) * F.col(rule.part), F.col(rule.whole)
    low = part < F.lit(rule.least) * whole if rule.least is not None else F.lit(False)
    high = part > F.lit(rule.most) * whole if rule.most is not None else F.lit(False)
    return (whole > 0) & (low | high)


def apply_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, columns: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """``columns`` of each document, every measure, base_failed, the names of the rules it fails and whether it is kept.

    Result columns: columns..., the names of ``measures`` (long), base_failed, failed_rules (array of string), kept.
    """
    counted = prepared(docs, columns, text).select(*(F.col(f"`{c}`") for c in columns), *(m.cast("long").alias(name) for name, m in measures(F.col("__of")).items()))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    failed = F.array_compact(F.array(*(F.when(fails(r), F.lit(r.name)) for r in rules))) if rules else F.array().cast("array<string>")
    return counted.withColumns({"base_failed": base, "failed_rules": failed}).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, judged by ``RULES``."""
    out = apply_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))


def oracle(rules: Sequence[Rule] = RULES) -> str:
    """DuckDB SQL of ``op13_quality_rules``."""
    held = []
    for r in rules:
        low = f"100 * {r.part} < {r.least} * {r.whole}" if r.least is not None else "false"
        high = f"100 * {r.part} > {r.most} * {r.whole}" if r.most is not None else "false"
        held.append(f"CASE WHEN {r.whole} > 0 AND ({low} OR {high}) THEN '{r.name}' END")
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    marks = MARKS.replace("'", "''")
    return rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT row, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g') AS solid,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
p AS (SELECT row, words, unnest(range(1, len(words) - 1)) AS i FROM w),
g AS (SELECT row, i, count(*) OVER (PARTITION BY row, words[i], words[i + 1], words[i + 2]) AS n FROM p),
r AS (SELECT row, count(DISTINCT place) AS n FROM (SELECT row, i + unnest([0, 1, 2]) AS place FROM g WHERE n > 1) GROUP BY row),
m AS (SELECT doc_id, len(words) AS n_words, length(solid) AS word_chars, length(regexp_replace(solid, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(lines) AS n_lines,
  length(regexp_replace(solid, '[^!?]', '', 'g')) AS n_exclamations, len(list_filter(words, lambda x: lower(x) IN ({stop}))) AS n_stop_words,
  length(translate(solid, '{marks}', '')) AS n_letters,
  len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis_lines,
  len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullet_lines
  FROM w LEFT JOIN r USING (row)),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, concat_ws(',', {", ".join(held)}) AS failed_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM j
"""
