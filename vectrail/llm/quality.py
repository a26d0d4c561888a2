"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a predicate over a text with an estimate of its cost: how many
steps it takes for one text, a step being a character that a string function
passes over (``PATTERN`` steps for a pattern, ``ELEMENT`` for an element of an
array). One job over a bounded sample sums costs and rejections of all rules;
the cascade then tests rules in falling order of rejections per cost, and stops
at the first that rejects. Costs are counted, not timed, so the order is the
same in every run over the same rows. It never changes a verdict, as a document
is kept exactly when no rule rejects it. Words, lines and letters are found
once for each text, for base counts and rules alike.

Defined results: a null text has no words, so the base rule rejects it; very
long texts are counted whole; an empty table gives an empty result; repeated
rows get one result each; extra columns pass through, whatever their names, but
columns with the names of results are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_GAP, let, table, words_of

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30


#: Steps of a pattern for each character, and of a function of arrays for each element.
PATTERN, ELEMENT = 8, 12
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed_rule", "kept")


@dataclass(frozen=True)
class Rule:
    """``rejects``: true for a text to drop; ``cost``: steps that telling so takes.

    Both may use the columns text, n_chars, words, n_words, word_chars, n_symbols, n_lines, n_dup_lines and letters.
    """

    name: str
    rejects: Column
    cost: Column


def default_rules() -> list[Rule]:
    text, chars, n, letters = F.col("text"), F.col("n_chars"), F.col("n_words"), F.col("letters")
    one = F.lit(1)
    capitals = F.length(F.regexp_replace(text, r"\P{Lu}+", ""))
    stutter = F.size(F.filter("words", lambda x, i: F.coalesce(x == F.get("words", i - 1), F.lit(False))))
    return [
        Rule("stutter", stutter > 0.3 * n, ELEMENT * n),
        Rule("symbols", F.col("n_symbols") > 0.25 * n, one),
        Rule("exclamations", chars - F.length(F.translate(text, "!", "")) > 0.5 * n, 2 * chars),
        Rule("capitals", capitals > 0.7 * F.greatest(letters, one), PATTERN * chars),
        Rule("letters", letters < 0.5 * F.col("word_chars"), one),
        Rule("word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 25 * n), one),
        Rule("repeated_lines", F.col("n_dup_lines") * 100 > 40 * F.col("n_lines"), one),
    ]


def repeated_words(words: Column) -> Column:
    """Words covered by windows of WINDOW words that occur twice or more.

    Windows are compared as 64-bit hashes of the hashes of their words. Hash and
    place are sorted only in texts that have a repeat; covered words then follow from the gaps between
    the sorted places. All of it is O(n log n) in one row.
    """

    def hashes(w: Column) -> Column:
        # get() takes one element in constant time; slice() would copy the array for each window
        places = F.sequence(F.lit(0), F.size(w) - WINDOW)
        each = F.transform(w, lambda x: F.xxhash64(x))
        return let(each, lambda h: F.transform(places, lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW)))))

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))

        def twice(s: Column) -> Column:
            def same(k: Column, j: Column) -> Column:
                return F.coalesce(F.get(s, k)["h"] == F.get(s, j)["h"], F.lit(False))

            index = F.sequence(F.lit(0), F.size(s) - 1)
            hit = F.filter(index, lambda k: same(k, k + 1) | ((k > 0) & same(k, F.greatest(k - 1, F.lit(0)))))
            return F.sort_array(F.transform(hit, lambda k: F.get(s, k)["p"]))

        def total(p: Column) -> Column:
            steps = F.sequence(F.lit(0), F.size(p) - 1)
            return F.aggregate(steps, F.lit(0), lambda acc, k: acc + F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - F.get(p, k), F.lit(WINDOW))))

        return let(let(pairs, twice), total)

    none = F.lit(0)
    of_hashes = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(covered(h))
    return let(words, lambda w: F.when(F.size(w) <= WINDOW, none).otherwise(let(hashes(w), of_hashes))).cast("long")


def with_counts(docs: DataFrame) -> DataFrame:
    """The rows of docs as ``row``, and what base counts and rules need."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    line_counts = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    read = docs.select(F.struct("*").alias("row"), text.alias("text"), F.length(text).alias("n_chars"), words_of(F.col("text")).alias("words"), line_counts.alias("lines"))
    return read.select(
        "row",
        "text",
        "n_chars",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.col("n_chars") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.col("lines.n").alias("n_lines"),
        F.col("lines.dup").alias("n_dup_lines"),
        F.length(F.regexp_replace("text", r"\P{L}+", "")).cast("long").alias("letters"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def order_rules(docs: DataFrame, rules: list[Rule], sample_rows: int = 2000, seed: int = 7) -> list[tuple[Rule, float, float]]:
    """(rule, cost of a row, share rejected) in falling order of rejections per cost; ties by name.

    The sample has about ``sample_rows`` rows: its fraction follows from the row
    count, so nothing is shuffled, and one row comes back.
    """
    fraction = min(1.0, sample_rows / max(docs.count(), 1))
    sums = [F.count(F.lit(1))]
    for rule in rules:
        sums += [F.sum(F.coalesce(rule.rejects, F.lit(False)).cast("int")), F.sum(rule.cost)]
    n, *found = with_counts(docs.select("text").sample(fraction, seed)).agg(*sums).first()
    n = max(n, 1)
    measured = [(rule, float(found[2 * k + 1] or 0) / n, (found[2 * k] or 0) / n) for k, rule in enumerate(rules)]
    return sorted(measured, key=lambda m: (-m[2] / max(m[1], 1e-12), m[0].name))


def quality_cascade(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = 2000) -> DataFrame:
    """Base counts, ``failed_rule`` (first rule that rejects; null if none) and ``kept``."""
    ordered = order_rules(docs, rules or default_rules(), sample_rows)
    counted = with_counts(docs).withColumn("n_repeat_words", repeated_words(F.col("words"))).withColumn("base_failed", base_failed())
    cascade = F.when(F.col("base_failed"), F.lit("base"))
    for rule, _, _ in ordered:
        cascade = cascade.when(F.coalesce(rule.rejects, F.lit(False)), F.lit(rule.name))
    done = counted.withColumn("failed_rule", cascade).withColumn("kept", F.col("failed_rule").isNull())
    return done.select(*(F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in RESULTS), *RESULTS)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_cascade(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_W = r"[^\x20\x09-\x0D]+"
OP1_SQL = rf"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '{_W}') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_W}')) AS ls
  FROM documents),
win AS (
  SELECT r, p, list_aggregate(ws[p:p+7], 'string_agg', ' ') AS g
  FROM (SELECT r, ws, unnest(generate_series(1, len(ws) - 7)) AS p FROM w WHERE len(ws) >= 8)),
hit AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
cov AS (
  SELECT r, sum(least(8, coalesce(nxt - p, 8))) AS n
  FROM (SELECT r, p, lead(p) OVER (PARTITION BY r ORDER BY p) AS nxt FROM hit) GROUP BY r),
c AS (
  SELECT w.r, doc_id, t, ls, ws, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN cov USING (r)),
b AS (
  SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
         length(regexp_replace(t, '\P{{L}}+', '', 'g')) AS letters,
         length(regexp_replace(t, '\P{{Lu}}+', '', 'g')) AS capitals,
         len(ls) AS n_lines
  FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed
            OR len(list_filter(ws, lambda x, i: i > 1 AND x = ws[i - 1])) > 0.3 * n_words
            OR n_symbols > 0.25 * n_words
            OR length(t) - length(replace(t, '!', '')) > 0.5 * n_words
            OR capitals > 0.7 * greatest(letters, 1)
            OR letters < 0.5 * word_chars
            OR word_chars < 2 * n_words OR word_chars > 25 * n_words
            OR n_dup_lines * 100 > 40 * n_lines) AS kept
FROM b
"""
