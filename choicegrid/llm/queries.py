"""The queries of the numbered operators over their whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import binary_output, bpe, chat, embedding_dedup, fill_middle, fingerprints, hard_negatives, jaccard_join, language_id, oracles, packing, pii, quality, toxicity
from .common import table


def op1_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_embedding_dedup(spark, sf_dir):
    return embedding_dedup.deduplicate(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op3_binary_output(spark, sf_dir):
    return binary_output.pack_matrices(table(spark, sf_dir, "documents"))


def op4_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_fingerprints(spark, sf_dir):
    return fingerprints.compare_edited(table(spark, sf_dir, "documents"))


def op6_bpe(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"), from_files=True)


def op7_language_id(spark, sf_dir):
    return language_id.identify(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark, sf_dir):
    return jaccard_join.similar(table(spark, sf_dir, "documents"))


def op9_chat_formatting(spark, sf_dir):
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_turns(turns))


def op10_quality(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", noisy), F.col("vec_id") % 100 == 0)


def op12_pii(spark, sf_dir):
    return pii.digests(table(spark, sf_dir, "documents"))


def op13_fill_middle(spark, sf_dir):
    return fill_middle.digests(table(spark, sf_dir, "documents"))


def queries():
    return {f.__name__: f for f in (op1_packing, op2_embedding_dedup, op3_binary_output, op4_toxicity, op5_fingerprints, op6_bpe, op7_language_id, op8_jaccard_join, op9_chat_formatting, op10_quality, op11_hard_negatives, op12_pii, op13_fill_middle)}


def oracle_sql():
    return dict(oracles.SQL)
