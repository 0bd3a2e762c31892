"""Quality rules: a threshold table compiled into one Spark projection.

Metrics are Column expressions over the text (lengths, symbols, stop words,
lines, repeated word windows); a rule bounds one metric, and all rules become
one boolean projection.  No user function runs.

Defined results: a null or empty text has no words and fails; ratios of a text
without words (or lines) are 0; repeated rows are judged alike; an empty table
gives no rows; the input's other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwise.llm.common import BLANKS, words

SYMBOLS = "#*$%&|<>"
#: Frequent function words of the four corpus languages.
STOP_WORDS = (
    "the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on", "are", "as", "with", "be", "by", "at", "from", "this",
    "le", "la", "les", "de", "des", "du", "et", "en", "un", "une", "que", "qui", "dans", "pour", "est", "pas", "sur", "au",
    "der", "die", "das", "und", "ein", "eine", "zu", "den", "von", "mit", "ist", "im", "nicht", "auf", "dem", "als",
    "el", "los", "las", "y", "se", "por", "con", "una", "su", "para", "no", "lo", "al", "del",
)


@dataclass(frozen=True)
class Rule:
    """``low <= metric <= high``; a missing bound does not bind."""
    metric: str
    low: float | None = None
    high: float | None = None

    def holds(self) -> Column:
        bounds = [F.col(self.metric) >= F.lit(self.low)] if self.low is not None else []
        bounds += [F.col(self.metric) <= F.lit(self.high)] if self.high is not None else []
        return reduce(lambda a, b: a & b, bounds)


#: The base: too short, or more than half of the words in repeated three-word windows.
BASE = (Rule("n_words", low=50), Rule("repeat_percent", high=50))
#: The threshold table of the verdict.
RULES = (
    Rule("mean_word_chars", low=2, high=15),
    Rule("symbols_per_word", high=0.25),
    Rule("stop_word_ratio", low=0.02),
    Rule("dup_line_ratio", high=0.5),
    Rule("exclaimed_ratio", high=0.3),
)


def metrics(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` plus the metric columns; only ``text_col`` is read."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, BLANKS, "") != "")
    df = (df.withColumn("_words", words(F.col(text_col).cast("string")))
          .withColumn("_lines", lines)
          .withColumn("n_words", F.size("_words").cast("long"))
          .withColumn("word_chars", F.char_length(F.translate(text, BLANKS, "")).cast("long"))
          .withColumn("n_symbols", (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long"))
          .withColumn("n_lines", F.size("_lines").cast("long"))
          .withColumn("n_dup_lines", F.col("n_lines") - F.size(F.array_distinct("_lines")))
          .withColumn("n_stop_words", F.size(F.filter("_words", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long"))
          .withColumn("n_exclaimed", F.size(F.filter("_words", lambda w: w.endswith("!!"))).cast("long"))
          .withColumn("n_repeat_words", repeated_words(F.col("_words"), 3)))

    def ratio(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a).cast("double") / F.col(b)).otherwise(F.lit(0.0))

    return (df.withColumn("mean_word_chars", ratio("word_chars", "n_words"))
            .withColumn("symbols_per_word", ratio("n_symbols", "n_words"))
            .withColumn("stop_word_ratio", ratio("n_stop_words", "n_words"))
            .withColumn("dup_line_ratio", ratio("n_dup_lines", "n_lines"))
            .withColumn("exclaimed_ratio", ratio("n_exclaimed", "n_words"))
            .withColumn("repeat_percent", F.when(F.col("n_words") > 0, 100.0 * F.col("n_repeat_words") / F.col("n_words")).otherwise(F.lit(0.0)))
            .drop("_words", "_lines"))


def repeated_words(found: Column, n: int) -> Column:
    """Number of words that lie in an ``n``-word window found twice or more.

    Windows are compared by their 64-bit hash.  Sorting (hash, position) puts
    equal windows side by side in O(w log w); a window's words not yet counted
    are those beyond the end of the previous repeated window."""
    last = F.size(found) - n
    hashes = F.when(last > 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
                                          lambda i: F.xxhash64(*[F.get(found, i + k) for k in range(n)])))
    # most texts repeat nothing: a hash set decides that without a sort
    plain = hashes.isNull() | (F.size(F.array_distinct(hashes)) == F.size(hashes))
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(plain, F.lit(0)).otherwise(_covered(pairs, n)).cast("long")


def _covered(pairs: Column, n: int) -> Column:
    """Words under the repeated windows of sorted (hash, position) ``pairs``."""
    def with_pairs(p: Column) -> Column:
        def twin(x: Column, k: Column) -> Column:
            return (F.get(p, k - 1)["h"] == x["h"]) | (F.get(p, k + 1)["h"] == x["h"])
        hits = F.filter(p, lambda x, k: F.coalesce(twin(x, k), (F.get(p, k + 1)["h"] == x["h"]), F.lit(False)))
        return F.array_sort(F.transform(hits, lambda x: x["i"]))
    # transform over a one-element array binds a value to a name once
    positions = F.transform(F.array(pairs), with_pairs)
    return F.get(F.transform(positions, lambda q: F.aggregate(
        q, F.struct(F.lit(0).alias("n"), F.lit(-n).alias("at")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(n), i - acc["at"])).alias("n"), i.alias("at")),
        lambda acc: acc["n"])), 0)


def quality_rules(df: DataFrame, text_col: str = "text", base: tuple[Rule, ...] = BASE, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``df`` plus metrics, ``base_failed``, ``failed`` (names of broken rules) and ``kept``."""
    out = metrics(df, text_col)
    ok = reduce(lambda a, b: a & b, [r.holds() for r in base])
    broken = F.filter(F.array(*[F.when(~r.holds(), F.lit(r.metric)) for r in (*base, *rules)]), lambda x: x.isNotNull())
    out = out.withColumn("base_failed", ~ok).withColumn("failed", broken)
    return out.withColumn("kept", F.size("failed") == 0)


#: DuckDB statement for the query's contract columns.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS w
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words
      FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(list_filter(ws, lambda x: list_contains([{stops}], lower(x))))::DOUBLE AS stops,
         len(list_filter(ws, lambda x: x LIKE '%!!'))::DOUBLE AS shouts
  FROM d LEFT JOIN c USING (doc_id)),
b AS (SELECT *, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
             n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars::DOUBLE / n_words BETWEEN 2 AND 15 AND n_symbols::DOUBLE / n_words <= 0.25
       AND stops / n_words >= 0.02 AND 2 * n_dup_lines <= len(ls) AND shouts / n_words <= 0.3 AS kept
FROM b
""".replace("{stops}", ", ".join(f"'{w}'" for w in STOP_WORDS))
