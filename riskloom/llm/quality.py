"""Quality rules as a short-circuit cascade (DataFrame functions only).

Words are runs of characters other than space and \\t..\\r.  ``metrics`` derives the counts that every row is to show, and the
base rule from them.  The cascade's rules are conditions over text, words, lines and these counts; what a rule asks beyond
them (a pass over the characters or words, a sort of the words) is evaluated only for rows that no rule before it rejects.
``plan`` runs each rule on a sample of about ``SAMPLE`` rows, written once, measures its cost (seconds for ``REPEAT`` evaluations
a row, less those of reading the sample; the least of ``RUNS`` runs, rounded to powers of two so that noise does not turn the
order) and its selectivity (share of rows it rejects), and orders the rules by rejection per cost.  ``cascade`` is one CASE
expression, which stops at the first condition that holds.  The order decides only how much work is done, never the verdict;
``n_asked`` says how many rules a row was asked.

Repeated words are found in linear time within the row: a map from each 3-word window to its last place (and,
reversed, its first) leaves, by difference, the places of windows that occur more than once.  Nothing is shuffled.

Edge cases: a null or blank text has no words: all counts are 0 and the base rule rejects it.  Rows are judged
one by one, so repeated rows and null ids are rows like others; of rules equal in rejection per cost the cheaper, then the
first by name is asked first; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

SEPARATORS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
SAMPLE, REPEAT, RUNS = 1000, 8, 3
#: Base rule: too few words, or too many of them in repeated windows.
BASE = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"
#: The cascade's own rules, lenient enough to leave prose, tables and lists alone.  They see text, w (words), lines (those with
#: a word) and the counts.
RULES = {
    "symbols": "2 * n_symbols > 3 * n_words",
    "shouting": "regexp_count(text, '!') > n_words",
    "duplicate_lines": "size(lines) >= 4 AND 2 * n_dup_lines > size(lines)",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "no_letters": "5 * size(filter(w, x -> x rlike '[A-Za-z\\\\x{80}-\\\\x{10FFFF}]')) < n_words",
    # a word that makes up more than half of all stands in the middle of the sorted words
    "one_word": "10 * (n_words - size(array_remove(w, get(array_sort(w), cast(n_words div 2 as int))))) > 6 * n_words",
}
SHOWN = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def metrics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of each row of docs (doc_id, text), and text, w, lines, what rules may ask about."""
    # a window that occurs again is put into the maps below more than once; the later place is to stay
    docs.sparkSession.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    one = docs.select("doc_id", "text", F.array_remove(F.split("text", SEPARATORS, -1), "").alias("w"), F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    grams = F.expr("CASE WHEN size(w) >= 3 THEN transform(sequence(0, size(w) - 3), i -> concat_ws(' ', w[i], w[i + 1], w[i + 2])) ELSE array() END")
    two = one.select(
        "*",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        grams.alias("g"),
    )
    three = two.select("*", F.expr("CASE WHEN size(g) > size(array_distinct(g)) THEN sequence(0, size(g) - 1) END").alias("at"))
    again = F.expr(
        "array_union(array_except(at, map_values(map_from_arrays(g, at))), array_except(at, map_values(map_from_arrays(reverse(g), reverse(at)))))"
    )
    four = three.select("*", F.when(F.col("at").isNotNull(), again).alias("again"))
    covered = F.expr("coalesce(size(array_union(array_union(again, transform(again, i -> i + 1)), transform(again, i -> i + 2))), 0)")
    return four.select("*", F.when(F.col("again").isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words")).drop("g", "at", "again")


def plan(docs: DataFrame, rules: dict[str, str], rows: int = SAMPLE) -> list[tuple[str, float, float]]:
    """(name, seconds, share rejected) of each rule on a sample, best first."""
    n = docs.count()
    some = docs.select("doc_id", "text").sample(min(1.0, rows / max(n, 1)), seed=7).repartition(8)
    sample = cut(metrics(some), "sample").withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(REPEAT))))

    def run(column: Column) -> tuple[float, float]:
        began = time.perf_counter()
        got = sample.agg(column.alias("x")).collect()[0][0]
        return time.perf_counter() - began, got or 0.0

    # what reading the columns takes that a rule reads
    floor = min(run(F.sum(F.length("text") + F.size("w") + F.size("lines")))[0] for _ in range(RUNS))
    found = []
    for name, rule in rules.items():
        times = [run(F.avg(F.expr(rule).cast("double"))) for _ in range(RUNS)]
        seconds = 2.0 ** round(math.log2(max(min(t for t, _ in times) - floor, 1 / 64)))
        found.append((name, seconds, times[0][1]))
    return sorted(found, key=lambda x: (-x[2] / x[1], x[1], x[0]))


def cascade(rules: dict[str, str], order: list[str], first: str | None = None) -> Column:
    """The place (from 1, 0 for first) of the first rule that rejects, else null; a condition is evaluated only if none before it holds."""
    out = F.when(F.expr(first), 0) if first else F.when(F.lit(False), 0)
    for i, name in enumerate(order, 1):
        out = out.when(F.expr(rules[name]), i)
    return out


def quality(docs: DataFrame, rules: dict[str, str] | None = None, base: str = BASE) -> DataFrame:
    """The counts of each row of docs, base_failed, kept (the cascade's verdict), rejected_by (the rule's name) and n_asked (rules evaluated)."""
    rules = RULES if rules is None else rules
    order = [name for name, _, _ in plan(docs, rules)]
    names = F.array(*[F.lit(x) for x in ("base", *order)])
    out = metrics(docs).select(*SHOWN, F.expr(base).alias("base_failed"), cascade(rules, order, base).alias("at"))
    asked = F.coalesce("at", F.lit(len(order))).cast("long")
    return out.select(*SHOWN, "base_failed", F.col("at").isNull().alias("kept"), F.when(F.col("at").isNotNull(), names[F.col("at")]).alias("rejected_by"), asked.alias("n_asked"))
