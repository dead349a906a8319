"""The registered queries of the numbered operators: whole tables, production parameters, digests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewire.llm.arrays import positions, words
from tidewire.llm.chat import link_quotations
from tidewire.llm.divergence import AUDIT_SQL, audit
from tidewire.llm.fingerprints import fingerprints_with_edits
from tidewire.llm.html_extract import extract
from tidewire.llm.mixing import MIX_SQL, mix
from tidewire.llm.ngram_quality import classify
from tidewire.llm.packing import pack
from tidewire.llm.pii import KINDS, find_personal_data, written
from tidewire.llm.quality_rules import quality_verdicts
from tidewire.llm.runs import find_runs
from tidewire.llm.simhash import near_duplicate_classes
from tidewire.llm.token_files import read_token_files, write_token_files
from tidewire.llm.word_bpe import encode_and_decode
from tidewire.session import shared_folder, use_settings


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file, the same on all machines."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_settings(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), size=2048, end_id=1)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_decode(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = near_duplicate_classes(table(spark, sf_dir, "documents"))
    return classes.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{kind}") for i, kind in enumerate(KINDS)],
        F.sha2(F.encode(written(F.col("base")), "UTF-8"), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints_with_edits(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_verdicts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *counts, "base_failed", "kept", "failed_rule")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"), end_id=2)
    return read_token_files(spark.read.parquet(path))


def op9_chat_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotations(table(spark, sf_dir, "conversations"))


def op10_ngram_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; in one document of ten, by the checksum of its id, the words from some place on repeat."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def repeated(ws: Column) -> Column:
        n = F.size(ws)
        a = F.pmod(g, n).cast("int")
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))).cast("int")
        at = F.transform(positions(n), lambda i: F.when(i >= a, a + F.pmod(i - a, p)).otherwise(i))
        return F.array_join(F.transform(at, lambda i: F.get(ws, i)), " ")

    whole = F.coalesce("text", F.lit(""))
    # A single-element array binds the words, which are used more than once.
    planted = F.get(F.transform(F.array(words(whole)), repeated), F.lit(0))
    has_word = whole.rlike("[^\\x20\\x09-\\x0D]")
    return docs.select("doc_id", F.when((F.pmod(h, F.lit(10)) == 0) & has_word, planted).otherwise(whole).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    # Greatest length first, then the smallest start and period.
    ranked = F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))
    best = F.array_min(ranked)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    sha = lambda x: F.sha2(F.encode(x, "UTF-8"), 256)
    return found.withColumn("_best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_best.s").alias("start"),
        (-F.col("_best.l")).alias("length"),
        F.col("_best.p").alias("period"),
        F.floor(-F.col("_best.l") * 1000 / F.col("_best.p")).alias("exponent_milli"),
        sha(F.array_join(lines, "")).alias("runs_sha256"),
        sha(F.col("collapsed")).alias("collapsed_sha256"),
    )


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_main_text": op1_main_text,
    "op2_packing": op2_packing,
    "op3_bpe": op3_bpe,
    "op4_simhash": op4_simhash,
    "op5_personal_data": op5_personal_data,
    "op6_fingerprints": op6_fingerprints,
    "op7_token_files": op7_token_files,
    "op8_quality_rules": op8_quality_rules,
    "op9_chat_quotes": op9_chat_quotes,
    "op10_ngram_quality": op10_ngram_quality,
    "op11_mixing": op11_mixing,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_source_divergence": op13_source_divergence,
}
ORACLES: dict[str, str] = {"op11_mixing": MIX_SQL, "op13_source_divergence": AUDIT_SQL}
