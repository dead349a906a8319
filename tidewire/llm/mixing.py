"""Mixing sources to target weights: hash-random keys, ranges sorted in each source, prefix sums, exact cuts."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidewire.llm.arrays import words
from tidewire.operators.order import placed
from tidewire.session import cut_lineage

#: Weights of the sources in code point order, repeating; words of the mix as a share of all words; most epochs.
WEIGHTS, SHARE, EPOCHS = (3, 1, 2), 1.5, 2
#: Rows that one range of keys of a source may hold on average; more rows make more ranges.
RANGE_ROWS = 10_000


def random_key(seed: str = "") -> Column:
    """Hex digits that depend on the id and the text of a row only, so that reruns agree."""
    doc_id = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.md5(F.concat(F.lit(seed), doc_id, F.lit(":"), F.coalesce("text", F.lit(""))))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """Add target (double) to the sources (source, source_size).

    ``share`` of all words is dealt by weight; no source gets more than ``epochs`` times its size, and what
    is over goes to the others by weight. All sources that are not full have the same level (words per
    weight), so each round sums up the full ones and raises the level, until no more sources get full.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    table = cut_lineage(
        placed(sizes, F.asc_nulls_last("source")).select(
            "source", "source_size", (F.col("source_size") * epochs).alias("most"), weight.alias("weight")
        )
    )
    spread = share * (table.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        full = F.col("most") <= F.col("weight") * F.lit(level)
        used, open_weight = table.agg(F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("weight")))).first()
        higher = (spread - (used or 0)) / open_weight if open_weight else math.inf
        if not open_weight or higher <= level:
            break
        level = higher
    own = F.col("weight") * F.lit(level)
    target = F.when(F.col("most") <= own, F.col("most").cast("double")).otherwise(own)
    return table.select("source", "source_size", target.alias("target"))


def plan_mix(docs: DataFrame, seed: str = "", range_rows: int = RANGE_ROWS, **dealing) -> DataFrame:
    """doc_id, source, key, size, copies, before, source_size, target: one row per distinct (doc_id, source, text).

    ``before`` counts the words of the source whose keys come earlier. Keys are hashes, so equal ranges of
    them hold about equal numbers of rows of a source, however large it is; rows are sorted inside their
    range, and the sums of the ranges are summed up per source.
    """
    rows = docs.select("doc_id", "source", random_key(seed).alias("key"), F.size(words(F.coalesce("text", F.lit("")))).cast("long").alias("size"))
    same = cut_lineage(rows.groupBy("doc_id", "source", "key", "size").agg(F.count("*").alias("copies")))
    sizes = same.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    budget = cut_lineage(targets(cut_lineage(sizes), **dealing))
    ranges = max(1, math.ceil(same.count() / range_rows))
    # The first 32 bits of the key, scaled to the number of ranges.
    bucket = F.shiftright(F.conv(F.left("key", F.lit(8)), 16, 10).cast("long") * F.lit(ranges), 32)
    cut = same.withColumn("bucket", bucket).withColumn("words", F.col("size") * F.col("copies"))
    by_source = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        cut.groupBy("source", "bucket").agg(F.sum("words").alias("total"))
        .select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), F.coalesce(F.sum("total").over(by_source), F.lit(0)).alias("_before"))
    )
    inside = W.partitionBy("source", "bucket").orderBy("key", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    summed = cut.withColumn("_in", F.coalesce(F.sum("words").over(inside), F.lit(0)))
    joined = summed.join(offsets, (F.col("bucket") == F.col("_b")) & F.col("source").eqNullSafe(F.col("_s")))
    dealt = budget.withColumnRenamed("source", "_of")
    return joined.join(dealt, F.col("source").eqNullSafe(F.col("_of"))).select(
        "doc_id", "source", "key", "size", "copies", (F.col("_before") + F.col("_in")).alias("before"), "source_size", "target"
    )


def _taken(copy: Column) -> Column:
    """Words taken of the given copy (from 0) of a row of the plan: whole epochs, and those up to the source's cut."""
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size") - F.col("before") - copy * F.col("size")
    return epochs * F.col("size") + F.greatest(F.lit(0), F.least(rest, F.col("size")))


def mix(docs: DataFrame, **how) -> DataFrame:
    """doc_id, source, size, source_size, target and taken for each row of ``docs`` (doc_id, text, source).

    The words taken of a source are its target, rounded down: whole epochs of all its rows, then rows in
    the order of their random keys until the budget is used up, the last of them in part. Null texts have no
    words; null is a source of its own and comes last. Rows of the same id, source and text are counted
    together and take their turns one after the other. Sources without words have target 0.
    """
    plan = plan_mix(docs, **how)
    each = plan.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return each.select("doc_id", "source", "size", "source_size", "target", _taken(F.col("_copy")).alias("taken"))


def mixed_texts(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: a row of ``docs`` for each epoch that takes of it, with epoch (from 0) and n_words.

    The text of a row that the budget cuts is its first words, joined by blanks. Columns of ``docs`` named
    epoch or n_words are replaced. Rows of which nothing is taken are left out.
    """
    plan = plan_mix(docs, **how)
    keyed = docs.select(F.struct("*").alias("_doc"), "doc_id", "source", random_key(how.get("seed", "")).alias("key"))
    copies = W.partitionBy("doc_id", "source", "key").orderBy(F.lit(0))
    numbered = keyed.withColumn("_copy", (F.row_number().over(copies) - 1).cast("long"))
    own = plan.withColumnsRenamed({"doc_id": "_id", "source": "_s", "key": "_k"})
    same = (F.col("key") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_s"))
    taken = numbered.join(own, same).withColumn("_taken", _taken(F.col("_copy"))).where("_taken > 0")
    epoch = taken.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_taken") - 1) / F.col("size")))))
    part = epoch.withColumn("n_words", F.least(F.col("size"), F.col("_taken") - F.col("epoch") * F.col("size")))
    whole = F.col("_doc.text")
    text = F.when(F.col("n_words") == F.col("size"), whole).otherwise(F.array_join(F.slice(words(whole), 1, F.col("n_words").cast("int")), " "))
    left = [F.col(f"_doc.{c}") if c != "text" else text.alias("text") for c in docs.columns if c not in ("epoch", "n_words")]
    return part.select(*left, "epoch", "n_words")


#: The same in SQL: targets from the first source, in order of words per weight, that is not full.
MIX_SQL = r"""WITH d AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS key,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
  s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
  r AS (SELECT *, 2 * source_size AS most, row_number() OVER (ORDER BY 2 * source_size / w) AS i FROM s),
  l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
  v AS (SELECT coalesce((SELECT level FROM l WHERE most > w * level ORDER BY i LIMIT 1), 0) AS level),
  t AS (SELECT source, source_size, least(most::DOUBLE, w * v.level) AS target FROM r, v),
  b AS (SELECT d.*, t.source_size, t.target, CAST(floor(target) AS BIGINT) AS budget,
      coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
  e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM b)
  SELECT doc_id, size, source_size, target,
    CAST(epochs * size + greatest(0, least(budget - epochs * source_size - before, size)) AS BIGINT) AS taken FROM e"""
