"""Quality rules as a short-circuit cascade, in DataFrame expressions alone."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, sampled, set_aside, written

#: Rows on which the rules' cost and selectivity are estimated. They set the order of evaluation and never the verdict.
SAMPLE_ROWS = 1_000
#: Times that each is measured; the least counts, less that of a rule that rejects nothing.
TIMES = 3
WINDOW = 8


def _text() -> Column:
    """The text that the features read: null once a rule has rejected the row, so that every later feature is null at no cost."""
    return F.col("_t")


def _verdict() -> Column:
    """Nothing rejected the row. The row id keeps filters above: pushed below, one would repeat every feature inside one expression."""
    return _text().isNotNull() & (F.monotonically_increasing_id() >= 0)


def words() -> Column:
    return F.array_remove(F.split(_text(), SPACE + "+", -1), "")


def _left_of(dropped: str) -> Column:
    return F.length(F.regexp_replace(_text(), dropped + "+", "")).cast("long")


def with_words(df: DataFrame) -> DataFrame:
    return df if "_n_words" in df.columns else df.withColumn("_n_words", F.size("_hashes" if "_hashes" in df.columns else words()).cast("long"))


def with_word_chars(df: DataFrame) -> DataFrame:
    return df if "_word_chars" in df.columns else df.withColumn("_word_chars", (_left_of(SPACE)))


def with_symbols(df: DataFrame) -> DataFrame:
    return df if "_n_symbols" in df.columns else df.withColumn("_n_symbols", (_left_of("[^#*$%&|<>]")))


def with_lines(df: DataFrame) -> DataFrame:
    """_n_lines: lines with a word; _n_dup_lines: those equal to an earlier line."""
    if "_n_dup_lines" in df.columns:
        return df
    lines = F.filter(F.split(_text(), "\n", -1), lambda x: x.rlike(WORD))
    df = df.withColumn("_lines", (lines))
    df = df.withColumn("_n_lines", F.size("_lines").cast("long")).withColumn("_n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    return df.drop("_lines")


def with_capitals(df: DataFrame) -> DataFrame:
    if "_n_upper" in df.columns:
        return df
    return df.withColumn("_n_upper", (_left_of(r"\P{Lu}"))).withColumn("_n_lower", (_left_of(r"\P{Ll}")))


def with_repeats(df: DataFrame) -> DataFrame:
    """_n_repeat_words: words inside windows of 8 words that the text holds twice or more.

    A window is the hash of its words' hashes. Only texts in which a window recurs sort their windows by hash to find
    where; the covered words are then the sum of min(8, distance to the next start). All of it is n log n in a text's words.
    """
    if "_n_repeat_words" in df.columns:
        return df
    df = df if "_hashes" in df.columns else df.withColumn("_hashes", (F.transform(words(), lambda w: F.xxhash64(w))))
    h = F.col("_hashes")
    starts = F.sequence(F.lit(0), F.size(h) - WINDOW)
    df = df.withColumn("_windows", F.when(F.size(h) >= WINDOW, F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))))
    w = F.col("_windows")
    df = df.withColumn("_again", F.size(F.array_distinct(w)) < F.size(w))
    df = df.withColumn("_sorted", F.when(F.col("_again"), F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    s = F.col("_sorted")
    same = lambda x, j: F.coalesce(x["h"] == F.get(s, j)["h"], F.lit(False))
    df = df.withColumn("_at", F.when(F.col("_again"), F.sort_array(F.transform(F.filter(s, lambda x, j: F.when(j > 0, same(x, j - 1)).otherwise(False) | same(x, j + 1)), lambda x: x["i"]))))
    at = F.col("_at")
    gaps = F.zip_with(at, F.slice(at, 2, F.greatest(F.size(at), F.lit(1))), lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    df = df.withColumn("_n_repeat_words", F.when(F.col("_again"), F.aggregate(gaps, F.lit(0), lambda a, x: a + x)).otherwise(0).cast("long"))
    return df.drop("_hashes", "_windows", "_again", "_sorted", "_at")


@dataclass(frozen=True)
class Rule:
    """`rejects` over the columns that `needs` adds. Null counts as no rejection."""

    name: str
    needs: Callable[..., DataFrame]
    rejects: Column


def rules() -> list[Rule]:
    c = F.col
    return [
        Rule("few_words", with_words, c("_n_words") < 20),
        Rule("repeats", with_repeats, 100 * c("_n_repeat_words") > 30 * c("_n_words")),
        Rule("symbols", with_symbols, 10 * c("_n_symbols") > c("_n_words")),
        Rule("dup_lines", with_lines, (c("_n_dup_lines") >= 3) & (10 * c("_n_dup_lines") > 3 * c("_n_lines"))),
        Rule("word_length", with_word_chars, (c("_word_chars") < 2 * c("_n_words")) | (c("_word_chars") > 15 * c("_n_words"))),
        Rule("capitals", with_capitals, c("_n_upper") > c("_n_lower")),
    ]


def ordered(df: DataFrame, found: Sequence[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by falling rejections per second, both measured on rows chosen by the hash of doc_id."""
    # One task holds the sample, as do all its measurements: bounded rows, whatever the partitions of df.
    sample = written(sampled(df.select("doc_id", F.coalesce("text", F.lit("")).alias("_t")), sample_rows, "doc_id", "_t").select("_t"), "quality-sample").coalesce(1).persist()
    try:
        if not sample.count():
            return list(found)

        def measured(rule: Rule) -> tuple[int, float]:
            hits, least = 0, float("inf")
            for _ in range(TIMES):
                began = time.perf_counter()
                hits = rule.needs(with_words(sample)).agg(F.count_if(rule.rejects)).first()[0]
                least = min(least, time.perf_counter() - began)
            return hits, least

        none = measured(Rule("none", with_words, F.col("_n_words") < 0))[1]
        scored = [((hits + 0.5) / max(seconds - none, 1e-4), rule) for rule in found for hits, seconds in [measured(rule)]]
    finally:
        sample.unpersist()
    return [rule for _, rule in sorted(scored, key=lambda x: -x[0])]


def cascade(df: DataFrame, found: Sequence[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """`df` with _kept: no rule rejects. A rule is evaluated only for rows that every rule before it left alive."""
    found = rules() if found is None else found
    keep = list(df.columns)
    order = ordered(df, found, sample_rows)
    df = with_words(df.withColumn("_t", F.coalesce("text", F.lit(""))))
    for rule in order:
        before = set(df.columns)
        df = rule.needs(df)
        df = df.withColumn("_t", F.when(~F.coalesce(rule.rejects, F.lit(False)), _text())).drop(*(set(df.columns) - before))
    return df.select(*keep, _verdict().alias("_kept"))


def measures(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Every document's counts and verdict.

    A null or empty text has no words and is rejected. Repeated rows each get their own row, and extra columns are not read.
    """
    order = ordered(docs, rules(), sample_rows)
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_t"))
    df = df.withColumn("_hashes", F.transform(words(), lambda w: F.xxhash64(w)))
    for need in (with_words, with_word_chars, with_symbols, with_lines, with_repeats):
        df = need(df)
    failed = (F.col("_n_words") < 20) | (100 * F.col("_n_repeat_words") > 30 * F.col("_n_words"))
    df = df.withColumn("_failed", failed).withColumn("_t", F.when(~F.col("_failed"), _text()))
    for rule in order:
        df = rule.needs(df)
        df = df.withColumn("_t", F.when(~F.coalesce(rule.rejects, F.lit(False)), _text()))
    return df.select(
        "doc_id", F.col("_n_words").alias("n_words"), F.col("_word_chars").alias("word_chars"), F.col("_n_symbols").alias("n_symbols"),
        F.col("_n_dup_lines").alias("n_dup_lines"), F.col("_n_repeat_words").alias("n_repeat_words"), F.col("_failed").alias("base_failed"), _verdict().alias("kept"),
    )


def keep_good(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that no rule rejects, with their own columns under whatever names."""
    return cascade(set_aside(docs, "doc_id", "text"), None, sample_rows).filter("_kept").drop("_kept").toDF(*docs.columns)


#: DuckDB over `documents`. Words and lines are split as above; window positions come from a list of windows.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
ps AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM w),
win AS (SELECT doc_id, i, concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o,
               lead(x, 5) OVER o, lead(x, 6) OVER o, lead(x, 7) OVER o) AS win, lead(x, 7) OVER o AS eighth
        FROM ps WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
rep AS (SELECT doc_id, i FROM win WHERE eighth IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, win) >= 2),
cov AS (SELECT doc_id, sum(least(8, coalesce(lead_i - i, 8)))::BIGINT AS n
        FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS lead_i FROM rep) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
             len(ls) AS n_lines, (length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g'))) AS n_upper,
             (length(t) - length(regexp_replace(t, '\p{Ll}', '', 'g'))) AS n_lower
      FROM w LEFT JOIN cov USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR (n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines)
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR n_upper > n_lower) AS kept
FROM f
"""
