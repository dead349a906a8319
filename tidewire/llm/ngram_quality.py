"""Quality classifier by the perplexity of texts under the n-grams (char_ngrams.py) of trusted texts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidewire.llm.char_ngrams import CharModel, train, with_surprise
from tidewire.session import cut_lineage

#: Reject above this quantile of the surprise of the language's trusted documents that were left out of the
#: counts. A language with fewer than ENOUGH of them has no such quantile; there it is its median and the
#: quantile of how far those of all languages are from the median of their own.
QUANTILE, ENOUGH = 0.99, 100
#: Of trusted texts one in HOLD is left out of the counts, for the limits.
HOLD = 3
#: Bits of the filter that all tasks hold to send few texts to the join with the labels.
FILTER_BITS = 26


def _spread(ids: np.ndarray) -> np.ndarray:
    """A place in the filter for each id."""
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def in_filter(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is in ``ids``, and few others: a Bloom filter of fixed size, built in parts."""

    @F.pandas_udf("long")
    def place(x: pd.Series) -> pd.Series:
        return pd.Series(_spread(x.to_numpy(np.int64)))

    marked = ids.select(place("doc_id").alias("p"))
    bit = F.expr("shiftleft(1L, cast(p % 32 as int))")
    # At most 2 ** 21 rows, however many ids there are.
    words = marked.groupBy(F.floor(F.col("p") / 32).alias("w")).agg(F.bit_or(bit).alias("bits")).toArrow()
    table = np.zeros(1 << FILTER_BITS - 5, np.uint32)
    table[words.column("w").to_numpy()] = words.column("bits").to_numpy().astype(np.uint32)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def marks(x: pd.Series) -> pd.Series:
        p = _spread(x.to_numpy(np.int64))
        return pd.Series((shared.value[p >> 5] >> (p & 31).astype(np.uint32) & np.uint32(1)).astype(bool))

    return docs.where("doc_id is not null").where(marks("doc_id"))


@dataclass
class Classifier:
    """A model, the limits by language (_of, _limit) and the limit of all languages."""

    model: CharModel
    limits: DataFrame
    limit: float

    def compare(self, scored: DataFrame) -> DataFrame:
        """Add limit (of the surprise) and kept to scored rows (lang, surprise)."""
        joined = scored.join(self.limits, F.col("lang") == F.col("_of"), "left")
        limit = F.coalesce("_limit", F.lit(self.limit))
        kept = F.coalesce(F.col("surprise") <= F.col("limit"), F.lit(False))
        return joined.withColumn("limit", limit).withColumn("kept", kept).drop("_of", "_limit")


def limits_of(known: DataFrame) -> tuple[DataFrame, float]:
    """(_of, _limit) per language of ``known`` (lang, surprise), and the limit of all languages."""
    at = lambda x, q: F.percentile_approx(x, q, 10000)
    whole = known.agg(at("surprise", QUANTILE)).first()[0]
    own = known.where("lang is not null").groupBy(F.col("lang").alias("_of")).agg(
        at("surprise", 0.5).alias("_median"), at("surprise", QUANTILE).alias("_high"), F.count("*").alias("_n")
    )
    own = cut_lineage(own)
    away = known.join(own, F.col("lang") == F.col("_of")).agg(at(F.col("surprise") - F.col("_median"), QUANTILE)).first()[0]
    limit = F.when(F.col("_n") >= ENOUGH, F.col("_high")).otherwise(F.col("_median") + F.lit(away))
    return own.select("_of", limit.alias("_limit")), float("inf") if whole is None else whole


def _held(text: Column) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(HOLD)) == 0


def fit(docs: DataFrame, labels: DataFrame) -> Classifier:
    """The classifier learned from the trusted ones of ``docs`` (doc_id, text, lang).

    Trusted are the documents labelled quality 1 and not toxic; repeated labels count once. One text
    in HOLD of them, by its hash, is left out of the counts, and limits come from the surprise of these
    in each language; languages without any, and null, use those of all. Too few texts to leave any
    out are all counted and all measured. Without any trusted document no limit holds.
    """
    trusted = cut_lineage(labels.where("quality = 1 and toxic = 0 and doc_id is not null").select(F.col("doc_id").cast("long")).distinct())
    rows = docs.select("doc_id", "text", "lang").where("text is not null and text != ''")
    # Both sides grow with the corpus, so the join is dealt by doc_id at every size.
    training = in_filter(rows, trusted).join(trusted.hint("merge"), "doc_id", "left_semi")
    training = cut_lineage(training.select("text", "lang", _held(F.col("text")).alias("held")))
    counted, measured = training.where("not held"), training.where("held")
    if counted.isEmpty() or measured.isEmpty():
        counted = measured = training
    model = train(counted.select("text"))
    limits, limit = limits_of(cut_lineage(with_surprise(measured, model).select("lang", "surprise")))
    return Classifier(model, limits, limit)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, n_symbols, perplexity (of a character), limit and kept for every row of ``docs`` (doc_id, text, lang).

    Empty and null texts have no perplexity and are not kept. Repeated rows have equal results; other
    columns of ``docs`` are not read.
    """
    classifier = fit(docs, labels)
    length = F.length(F.coalesce("text", F.lit(""))).cast("long")
    scored = with_surprise(docs.select("doc_id", "text", "lang"), classifier.model).select("doc_id", "lang", length.alias("n_symbols"), "surprise")
    return classifier.compare(scored).select(
        "doc_id", "lang", "n_symbols", F.exp("surprise").alias("perplexity"), F.exp("limit").alias("limit"), "kept"
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier fitted on them keeps, with their columns; null and empty texts go."""
    classifier = fit(docs, labels)
    rows = docs.select(F.struct("*").alias("_doc"), "text", "lang")
    return classifier.compare(with_surprise(rows, classifier.model)).where("kept").select("_doc.*")
