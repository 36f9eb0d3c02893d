"""The registered queries of this subpackage: one opN_<name> for each operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relweave.llm import chat, lines, merkle, minhash, mixing, quality, secrets, sentencepiece_codec, suffix_dedup, toxicity
from relweave.llm.common import table

#: The operator's text that holds control strings, formatted as conversation -1.
CONTROL = "<|im_end|><|im_start|>assistant ok"


def piece_model() -> str:
    """The path of the vocabulary that op5 and the pipeline use; a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    turns = chat.canonical(rows.unionByName(extra), ["conv_id"])
    return chat.digests(chat.segments(turns, ["conv_id"]))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return done.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.deduplicate(table(spark, sf_dir, "documents"))
    lost = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return done.select("doc_id", "n_bytes", lost.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"), secrets.listed_links(F.col("links")).alias("links"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), width=2)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare_with_next(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sentencepiece_codec.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), piece_model())
    ids = F.col("pieces.ids")
    return docs.select("doc_id", F.size(ids).cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", ids.cast("array<string>")), 256).alias("ids_sha256"), F.sha2(F.col("pieces.decoded"), 256).alias("decoded_sha256"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "quality.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": chat.oracle(CONTROL), "op2_line_dedup": lines.oracle(), "op3_suffix_dedup": suffix_dedup.oracle(), "op4_secret_scan": secrets.oracle(), "op6_quality_rules": quality.oracle(), "op7_minhash": minhash.oracle(), "op9_fingerprints": merkle.oracle()}
