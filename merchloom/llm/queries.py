"""The registered queries of the training-data operators: each applies its operator, with
production parameters, to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, brown, decontaminate, html_extract, lattice, mixing, periodic, pii, quality_mil, quality_rules, run_index, secrets, simhash
from .common import read


def op1_brown_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score_held_out(read(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply_rules(read(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_attention_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mil.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_index.remove_repeats(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_tree_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read(spark, sf_dir, "pages"))


def op6_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.copies(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op7_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.clusters(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"))


def op10_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(read(spark, sf_dir, "documents"))


def op11_group_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(read(spark, sf_dir, "documents"))


def op12_lattice_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.link(read(spark, sf_dir, "embeddings"))


def _made_periodic(docs: DataFrame) -> DataFrame:
    """The texts that the contract of op13 asks for: where h = crc32(doc_id) is a multiple of 10, words repeat from one on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)")
    placed = docs.select("doc_id", "text", g.alias("g"), F.when((h % 10 == 0), words).alias("words")).withColumn("n", F.size("words"))
    start = F.col("g") % F.col("n")
    period = 1 + F.floor((F.col("n") - start) / (3 + F.col("g") % 8))
    repeated = F.transform(
        F.sequence(F.lit(0), F.col("n") - 1),
        lambda i: F.element_at("words", (F.when(i < start, i).otherwise(start + (i - start) % period) + 1).cast("int")),
    )
    return placed.select("doc_id", F.when(F.col("n") > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.report(_made_periodic(read(spark, sf_dir, "documents")))


_ALL = (
    op1_brown_classes, op2_quality_rules, op3_attention_mil, op4_run_index, op5_tree_extraction, op6_systematic_mix,
    op7_simhash_pivots, op8_decontamination, op9_secret_scan, op10_pii_sanitisation, op11_group_dictionary, op12_lattice_hashing, op13_periodic_runs,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
