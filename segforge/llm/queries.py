"""Queries of the training-data operators over the project's tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segforge.io import ensure_checkpoint_dir, materialise, table
from segforge.llm import copies, lookalikes, mixing, mojibake, pairs, residue, sentences, tokens


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.found(table(spark, d, "trans_units"), table(spark, d, "files"), table(spark, d, "convert_params"))


def p1_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The sentences of the documents, as units of their own."""
    docs = table(spark, d, "documents").where("text is not null and trim(text) <> ''")
    lang = F.lower(F.regexp_extract("lang", "^[A-Za-z]+", 0)).alias("lang")
    texts = docs.select(F.col("doc_id").alias("id"), lang, F.coalesce(F.when(F.col("original").isNotNull(), F.xxhash64("original")), F.xxhash64("doc_id")).alias("doc"), "text")
    cut = sentences.sentences(texts, texts)
    return cut.groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("n_sentences"), F.sum(F.col("end_char") - F.col("start_char")).alias("n_chars_in_sentences"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.found(table(spark, d, "trans_units"), table(spark, d, "files"))


def p2_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.restored(table(spark, d, "trans_units"), table(spark, d, "files"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.found(table(spark, d, "trans_units"), table(spark, d, "files"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.found(table(spark, d, "trans_units"))


def p5_forms(spark: SparkSession, d: str) -> DataFrame:
    """How many strings of each field share one canonical form."""
    forms = lookalikes.canonical(table(spark, d, "trans_units"), ["source", "target"]).where("form is not null")
    return forms.groupBy("field", "form").agg(F.count("*").alias("n_strings"), F.sum("n").alias("n_rows")).where("n_strings > 1")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.found(table(spark, d, "raw_units"))


def p6_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return copies.collapse(table(spark, d, "raw_units"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    sizes = materialise(mixing.sized(table(spark, d, "documents")))
    return mixing.shares(table(spark, d, "documents"), table(spark, d, "mix_weights"), sizes=sizes)


def p8_mixed(spark: SparkSession, d: str) -> DataFrame:
    sizes = materialise(mixing.sized(table(spark, d, "documents")))
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_weights"), sizes=sizes)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.found(table(spark, d, "documents"))


def p9_kept(spark: SparkSession, d: str) -> DataFrame:
    return residue.kept(table(spark, d, "documents")).groupBy("source").agg(F.count("*").alias("n_documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [p1_found, p1_sentences, p2_found, p2_restored, p4_found, p5_found, p5_forms, p6_found, p6_collapsed, p7_ids, p8_shares, p8_mixed, p9_found, p9_kept]

    def prepared(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_checkpoint_dir(spark)
            return f(spark, sf_dir)

        return run

    return {f.__name__: prepared(f) for f in named}
