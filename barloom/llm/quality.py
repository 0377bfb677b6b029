"""Line-first cleaning: rules per line, removal of the lines that fail, rejection of documents that lose too much.

Everything is one projection of DataFrame functions: no shuffle, no Python. ``bound`` evaluates a value once and hands
it to what uses it several times, so nothing is split or hashed again for each array element.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\f\r"
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"

#: A line ends in one of these, or it is no sentence; a line of more words than that passes with a sentence end inside.
CLOSERS = ".!?…:;,\"”»’')]"
OPEN_WORDS = 10
SENTENCE_END = r"[.!?…][\x20\x09-\x0D]"
#: A line of this many words at least may be judged by its capitals.
SHOUT_WORDS = 3
#: Symbols for each ten words that a line may have.
SYMBOLS_PER_TEN_WORDS = 1
#: Words that only separate menu entries, and the share (one in so many words) from which a line is navigation.
SEPARATOR = r"(?:^|[\x20\x09-\x0D])[|>»•·/](?:[\x20\x09-\x0D]|$)"
SEPARATOR_ONE_IN = 8
#: Phrases of notices and menus; they fail lines of up to this many words.
BOILERPLATE = (
    r"(?i)cookie|javascript|all rights reserved|privacy policy|terms of (?:use|service)|licensed under|"
    r"general public license|copyright|©|click here|read more|sign (?:up|in)|log ?in|subscribe|newsletter|"
    r"share (?:this|on)|skip to|back to top|lorem ipsum|powered by"
)
BOILERPLATE_WORDS = 30
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
MAX_LOST_PERCENT = 30


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_of(text: Column) -> Column:
    """The words of a text; none for null or blank."""
    return bound(
        F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE)),
        lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, GAP)),
    )


def chars_in_words(text: Column) -> Column:
    return F.length(F.regexp_replace(text, GAP, ""))


def symbols_in(text: Column) -> Column:
    return F.length(F.regexp_replace(text, SYMBOLS, ""))


def _covered(hashes: Column) -> Column:
    """Words in windows that occur twice or more, from the hash of the window at each position."""

    def positions(pairs: Column) -> Column:
        repeated = F.transform(
            pairs,
            lambda e, j: F.when(
                (e["h"] == F.get(pairs, j - 1)["h"]) | (e["h"] == F.get(pairs, j + 1)["h"]), e["i"]
            ),
        )
        return F.sort_array(F.filter(repeated, lambda i: i.isNotNull()))

    def total(at: Column) -> Column:
        own = F.transform(at, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - i, F.lit(3))))
        return F.aggregate(own, F.lit(0), lambda a, b: a + b)

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(
        F.size(F.array_distinct(hashes)) < F.size(hashes), bound(pairs, lambda p: bound(positions(p), total))
    ).otherwise(F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows found twice or more in the text (windows compare by 64-bit hash)."""
    windows = F.transform(
        F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)),
    )
    return bound(windows, _covered)


def line_fails(line: Column) -> Column:
    """Whether a line with a word breaks a rule: symbols, no closing punctuation, capitals only, separators, boilerplate."""

    def judged(n: Column) -> Column:
        return (
            (symbols_in(line) * 10 > n * SYMBOLS_PER_TEN_WORDS)
            | (
                (F.instr(F.lit(CLOSERS), F.right(F.btrim(line, F.lit(SPACE)), F.lit(1))) == 0)
                & ((n <= OPEN_WORDS) | ~line.rlike(SENTENCE_END))
            )
            | ((n >= SHOUT_WORDS) & ~line.rlike(r"\p{Ll}") & line.rlike(r"\p{Lu}"))
            | (F.regexp_count(line, F.lit(SEPARATOR)) * SEPARATOR_ONE_IN > n)
            | ((n <= BOILERPLATE_WORDS) & line.rlike(BOILERPLATE))
        )

    return bound(F.regexp_count(line, F.lit(WORD)), judged)


def clean_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, the counts, ``clean_text`` (the lines that passed), and the verdict.

    * A null text counts as empty: no words, ``clean_text`` empty, ``base_failed``.
    * Blank lines break no rule and stay; a text without line breaks is one line.
    * ``kept`` is false if ``base_failed`` or if the failed lines hold over ``MAX_LOST_PERCENT`` of the word characters.
    * Null ids, repeated rows and empty tables pass through as they are. Other columns are not read.
    * Texts of any length are read whole, within the row.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    has_word = lambda line: F.btrim(line, F.lit(SPACE)) != ""

    def over_lines(lines: Column) -> Column:
        worded = F.filter(lines, has_word)
        passed = F.filter(lines, lambda x: ~has_word(x) | ~line_fails(x))
        return F.struct(
            bound(worded, lambda w: F.size(w) - F.size(F.array_distinct(w))).alias("dup"),
            (F.size(lines) - F.size(passed)).alias("bad"),
            F.array_join(passed, "\n").alias("clean"),
        )

    def over_words(words: Column) -> Column:
        return F.struct(F.size(words).alias("n"), repeated_words(words).alias("repeat"))

    measured = docs.select(
        F.col(id_col),
        bound(words_of(text), over_words).alias("w"),
        bound(F.split(text, "\n"), over_lines).alias("l"),
        chars_in_words(text).alias("chars"),
        symbols_in(text).alias("symbols"),
    )
    base_failed = (F.col("w.n") < MIN_WORDS) | (F.col("w.repeat") * 100 > F.col("w.n") * MAX_REPEATED_PERCENT)
    lost = F.col("chars") - chars_in_words(F.col("l.clean"))
    return measured.select(
        F.col(id_col),
        F.col("w.n").cast("bigint").alias("n_words"),
        F.col("chars").cast("bigint").alias("word_chars"),
        F.col("symbols").cast("bigint").alias("n_symbols"),
        F.col("l.dup").cast("bigint").alias("n_dup_lines"),
        F.col("w.repeat").cast("bigint").alias("n_repeat_words"),
        F.col("l.bad").cast("bigint").alias("n_bad_lines"),
        lost.cast("bigint").alias("lost_chars"),
        F.col("l.clean").alias("clean_text"),
        base_failed.alias("base_failed"),
    ).withColumn("kept", ~F.col("base_failed") & (F.col("lost_chars") * 100 <= F.col("word_chars") * MAX_LOST_PERCENT))


def sql() -> str:
    """The same in SQL."""
    gap, word, symbols = GAP, WORD, "[#*$%&|<>]"
    quoted = CLOSERS.replace("'", "''")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
counted AS (SELECT rid, line, len(regexp_extract_all(line, '{word}')) AS n FROM lines),
judged AS (
  SELECT rid, line, n, n > 0 AND (
    len(regexp_extract_all(line, '{symbols}')) * 10 > n * {SYMBOLS_PER_TEN_WORDS}
    OR (NOT contains('{quoted}', right(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1))
      AND (n <= {OPEN_WORDS} OR NOT regexp_matches(line, '{SENTENCE_END}')))
    OR (n >= {SHOUT_WORDS} AND NOT regexp_matches(line, '\\p{{Ll}}') AND regexp_matches(line, '\\p{{Lu}}'))
    OR len(regexp_extract_all(line, '{SEPARATOR}')) * {SEPARATOR_ONE_IN} > n
    OR (n <= {BOILERPLATE_WORDS} AND regexp_matches(line, '{BOILERPLATE}'))) AS bad
  FROM counted),
by_line AS (
  SELECT rid, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS dup, count(*) FILTER (bad) AS bad,
    coalesce(sum(length(regexp_replace(line, '{gap}', '', 'g'))) FILTER (bad), 0) AS lost
  FROM judged GROUP BY rid),
w AS (SELECT rid, regexp_extract_all(text, '{word}') AS words FROM d),
spread AS (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) > 2),
windows AS (SELECT rid, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM spread),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS k FROM windows) WHERE k > 1),
covered AS (SELECT rid, count(DISTINCT i + j) AS k FROM twice, (SELECT unnest([0, 1, 2]) AS j) GROUP BY rid),
measured AS (
  SELECT d.doc_id, len(words) AS n_words, length(regexp_replace(text, '{gap}', '', 'g')) AS word_chars,
    len(regexp_extract_all(text, '{symbols}')) AS n_symbols, dup AS n_dup_lines, coalesce(k, 0) AS n_repeat_words,
    bad AS n_bad_lines, CAST(lost AS BIGINT) AS lost_chars
  FROM d JOIN w USING (rid) JOIN by_line USING (rid) LEFT JOIN covered USING (rid))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words)
    AND lost_chars * 100 <= word_chars * {MAX_LOST_PERCENT} AS kept
FROM measured"""
