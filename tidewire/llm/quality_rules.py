"""Quality rules as a short-circuit cascade, ordered by rejection per cost as seen on a sample."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidewire.llm.arrays import BLANK_CHARS, BLANKS, positions, without_chars, words
from tidewire.session import cut_lineage

#: Words of the windows whose repetition counts.
WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Texts, about, on which costs and selectivities are estimated; they decide the order of rules, never a verdict.
SAMPLE_ROWS = 400
#: What a regular expression does for a character, in characters of a plain scan.
REGEX = 12


def repeated_words(hashes: Column, n: Column) -> Column:
    """Words that lie in windows found twice or more, from the words' hashes and their number."""
    window = F.transform(
        positions(n - WINDOW + 1), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)])
    )

    def covered(win: Column) -> Column:
        ordered = F.sort_array(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda x, other: F.coalesce(x["h"] == other["h"], F.lit(False))
            hits = F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)))
            return F.sort_array(F.transform(hits, lambda x: x["i"]))

        def union(p: Column) -> Column:
            steps = F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW))))
            return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x)

        # Single-element arrays bind what is used more than once.
        held = F.transform(F.array(ordered), twice)
        return F.get(F.transform(held, union), F.lit(0))

    def count(win: Column) -> Column:
        none = F.size(F.array_distinct(win)) == F.size(win)
        return F.when(none, F.lit(0).cast("bigint")).otherwise(covered(win))

    return F.when(n <= WINDOW, F.lit(0).cast("bigint")).otherwise(F.get(F.transform(F.array(window), count), F.lit(0)))


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) of whole texts (null: none)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(f"[^{BLANKS}]"))
    first = docs.withColumns(
        {
            "_hashes": F.transform(words(whole), lambda w: F.xxhash64(w)),
            "_lines": lines,
            "word_chars": F.length(without_chars(whole, BLANK_CHARS)).cast("long"),
            "n_symbols": (F.length(whole) - F.length(without_chars(whole, SYMBOLS))).cast("long"),
        }
    )
    counted = first.withColumns(
        {
            "n_words": F.size("_hashes").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": repeated_words(F.col("_hashes"), F.size("_hashes")),
            "_here": F.rand(),
        }
    )
    # Filters on the counts, or on verdicts built on them, must stay above this step: pushed down,
    # they would repeat the whole computation once for every mention. A random column holds them.
    held = {c: F.when(F.col("_here") >= 0, F.col(c)) for c in ("n_words", "n_dup_lines", "n_repeat_words")}
    return counted.withColumns(held).drop("_hashes", "_lines", "_here")


@dataclass(frozen=True)
class Rule:
    """A document fails the rule where ``fails`` is true; ``work`` is what asking costs, in characters scanned."""

    name: str
    fails: Column
    work: Column


def base_rules() -> list[Rule]:
    return [
        Rule("few_words", F.col("n_words") < 20, F.lit(1)),
        Rule("repeated_windows", 100 * F.col("n_repeat_words") > 30 * F.col("n_words"), F.lit(1)),
    ]


def text_rules(text: str = "text") -> list[Rule]:
    """Bounds that prose of any language with blanks between words keeps by a wide margin."""
    whole = F.coalesce(F.col(text), F.lit(""))
    letters = F.length(F.regexp_replace(whole, "\\P{L}+", ""))
    capitals = F.length(F.regexp_replace(whole, "\\P{Lu}+", ""))
    marks = F.length(whole) - F.length(F.replace(whole, F.lit("!")))
    size, many = F.length(whole) + 1, F.col("n_dup_lines") >= 4
    return [
        Rule("symbols", 10 * F.col("n_symbols") > 3 * F.col("n_words"), F.lit(1)),
        Rule("word_length", (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words")), F.lit(1)),
        Rule("exclamations", 10 * marks > 3 * F.col("n_words"), size),
        Rule("duplicate_lines", many & (10 * F.col("n_dup_lines") > 3 * F.size(F.split(whole, "\n", -1))), F.when(many, REGEX * size).otherwise(1)),
        Rule("capitals", 10 * capitals > 5 * letters, 2 * REGEX * size),
        Rule("no_letters", 10 * letters < 4 * F.col("word_chars"), REGEX * size),
    ]


def ordered_by_gain(sample: DataFrame, rules: list[Rule]) -> list[tuple[Rule, float, float]]:
    """(rule, share rejected, mean work) by rejection per work on the sample, best first; equal gains by name.

    Work is counted, not timed, so one table gives one order.
    """
    found = sample.agg(
        *[F.avg(F.when(rule.fails, 1.0).otherwise(0.0)).alias(f"s{i}") for i, rule in enumerate(rules)],
        *[F.avg(rule.work).alias(f"w{i}") for i, rule in enumerate(rules)],
    ).first()
    costed = [(rule, found[f"s{i}"] or 0.0, found[f"w{i}"] or 1.0) for i, rule in enumerate(rules)]
    return sorted(costed, key=lambda x: (-x[1] / x[2], x[0].name))


def cascade(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add ``failed_rule``: the first of the rules, in the given order, that a row fails; null if it passes all.

    A CASE stops at the first failing rule, so the later rules are not evaluated for that row.
    Whether a row passes does not depend on the order.
    """
    failed = F.lit(None).cast("string")
    for rule in reversed(rules):
        failed = F.when(rule.fails, F.lit(rule.name)).otherwise(failed)
    return docs.withColumn("failed_rule", failed)


def sampled(docs: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """About ``rows`` different texts (column text) of the table, picked by their hash; all of a small table.

    The texts stay in their tasks, and the pick does not depend on how the table is stored.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    hashed = docs.select(whole.alias("text"), F.xxhash64(whole).alias("_hash"))
    n = docs.count()
    if n > rows:
        hashed = hashed.where(F.col("_hash") < -(1 << 63) + (rows << 64) // n)
    return hashed.dropDuplicates(["_hash"]).drop("_hash")


def rule_order(docs: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The text rules in the order that a sample of about ``rows`` texts suggests."""
    return [rule for rule, _, _ in ordered_by_gain(cut_lineage(base_counts(sampled(docs, text, rows))), text_rules())]


def quality_verdicts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the base counts, base_failed, failed_rule and kept to each row of ``docs``.

    Null and empty texts have no word and fail. The base rules, whose counts are there in any case, come
    first in the cascade, so no text rule is asked of a row that fails them. Repeated rows get equal verdicts. A
    pass for the sample and one for the verdicts, without a shuffle of texts but the sample's; columns of
    ``docs`` that have the name of an added one are replaced.
    """
    counted = base_counts(docs, text)
    base = base_rules()
    failed = base[0].fails | base[1].fails
    named = {rule.name: rule for rule in text_rules(text)}
    order = [named[rule.name] for rule in rule_order(docs, text)]
    judged = cascade(counted, base + order).withColumn("base_failed", failed)
    return judged.withColumn("kept", F.col("failed_rule").isNull())


def keep_passing(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass all rules, with their columns."""
    return quality_verdicts(docs.select(F.struct("*").alias("_doc"), "text")).where("kept").select("_doc.*")
