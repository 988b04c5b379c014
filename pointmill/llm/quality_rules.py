"""Quality rules: a table of thresholds compiled into one projection of built-in expressions, without user functions.

A rule bounds one measure, or a share of two measures in hundredths, so verdicts rest on whole numbers. Measures are
taken in one pass over the words of the whole text, bound once by a one-element ``transform``.

Defined cases: null text has no word, and fails the base rule like any text under 50 words; empty lines count nowhere;
a null doc_id stays null; repeated rows each get their row; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"

# Common function words of English, French, German and Spanish.
STOP_WORDS = (
    "a and are as at be by for from in is it of on or that the this to was with "
    "au avec dans de des du en est et la le les par pour que qui sur un une "
    "das der den die ein eine ist mit nicht und von zu "
    "al con del el las los no para por se su una y"
).split()


@dataclass(frozen=True)
class Rule:
    """``low`` <= measure <= ``high``; with ``share_of``, 100 * measure against hundredths of that measure."""

    name: str
    measure: str
    low: int | None = None
    high: int | None = None
    share_of: str | None = None


#: The threshold table.
RULES = (
    Rule("word_count", "n_words", 50, 200_000),
    Rule("mean_word_length", "word_chars", 200, 1500, "n_words"),
    Rule("symbol_share", "n_symbols", None, 10, "n_words"),
    Rule("stop_word_share", "n_stop_words", 2, None, "n_words"),
    Rule("letter_word_share", "n_letter_words", 70, None, "n_words"),
    Rule("repeated_line_share", "n_dup_lines", None, 50, "n_lines"),
    Rule("bullet_line_share", "n_bullet_lines", None, 90, "n_lines"),
    Rule("ellipsis_line_share", "n_ellipsis_lines", None, 40, "n_lines"),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the text."""

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twins(s: Column) -> Column:
            n = F.size(s)
            same = F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | ((k < n - 1) & (F.get(s, k + 1)["h"] == x["h"])))
            places = F.sort_array(F.transform(same, lambda x: x["i"]))
            start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
            return F.aggregate(places, start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"])

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(placed, twins))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(windows, covered))


def measures(text: Column) -> Column:
    """A struct of all measures of a text."""
    whole = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(whole, SPACE), lambda w: w != "")
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(w: Column) -> Column:
        return let(
            lines,
            lambda x: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.regexp_replace(whole, SPACE, "")).cast("long").alias("word_chars"),
                F.regexp_count(whole, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
                (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                repeated_words(w).cast("long").alias("n_repeat_words"),
                F.size(x).cast("long").alias("n_lines"),
                F.size(F.filter(w, lambda t: F.lower(t).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
                F.size(F.filter(w, lambda t: t.rlike(r"\p{L}"))).cast("long").alias("n_letter_words"),
                F.size(F.filter(x, lambda t: t.rlike(r"^[\x20\x09-\x0D]*[-*•]"))).cast("long").alias("n_bullet_lines"),
                F.size(F.filter(x, lambda t: t.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).cast("long").alias("n_ellipsis_lines"),
            ),
        )

    return let(words, of_words)


def compile_rules(rules: tuple[Rule, ...], column: Callable[[str], Column] = F.col) -> dict[str, Column]:
    """For each rule, whether the measures break it."""
    out = {}
    for r in rules:
        value = column(r.measure) * (100 if r.share_of else 1)
        unit = column(r.share_of) if r.share_of else F.lit(1)
        broken = F.lit(False)
        if r.low is not None:
            broken = broken | (value < unit * r.low)
        if r.high is not None:
            broken = broken | (value > unit * r.high)
        out[r.name] = broken
    return out


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measures, base_failed, kept, and the names of the broken rules."""
    measured = docs.select(F.col(id_col).alias("doc_id"), measures(F.col(text_col)).alias("m")).select("doc_id", "m.*")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    broken = compile_rules(rules)
    names = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in broken.items()]), lambda x: x.isNotNull())
    return measured.select("*", base.alias("base_failed"), names.alias("broken")).withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))


def rules_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same threshold table as a DuckDB condition that holds if no rule is broken."""
    parts = []
    for r in rules:
        value, unit = (f"100 * {r.measure}", r.share_of) if r.share_of else (r.measure, "1")
        if r.low is not None:
            parts.append(f"{value} >= {r.low} * {unit}")
        if r.high is not None:
            parts.append(f"{value} <= {r.high} * {unit}")
    return " AND ".join(parts)


SQL = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3),
grams AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS c FROM g),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM grams, (SELECT unnest([0, 1, 2]) AS k) WHERE c >= 2 GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
         len(lines) AS n_lines,
         len(list_filter(words, lambda x: lower(x) IN ({", ".join(f"'{x}'" for x in STOP_WORDS)}))) AS n_stop_words,
         len(list_filter(words, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_letter_words,
         len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullet_lines,
         len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis_lines
  FROM w LEFT JOIN covered ON covered.doc_id = w.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND {rules_sql()} AS kept
FROM m
"""
