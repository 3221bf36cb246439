"""The queries opN_<name> of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, exact_topk, hard_negatives, html_text, katz, media, merkle, mixing, near_dup, token_counts, toxicity, warc
from .common import held_out, table, tokenizer_path


def op1_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all texts by a model of those not held out, and by the base model."""
    return katz.train_and_score(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all texts, learned from the labelled rows that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.score(docs, toxicity.train(docs, labels), keep=["doc_id"])
    out = F.when(F.col("toxicity") >= toxicity.CUT, 1).otherwise(0)
    return scored.select("doc_id", held_out(F.col("doc_id"), toxicity.HELD_PARTS).alias("held_out"), F.col("toxicity").alias("score"), out.alias("predicted"))


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicates among all documents."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and a probe, folded, formatted and read back from the formatted text."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", chat.PROBE), (-1, 1, "assistant", chat.PROBE)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.parse(chat.render(chat.fold(chat.rows_as_events(rows.unionByName(probe))))))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts, stored as frames of a media container and read back through its sample tables."""
    return media.store_texts(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all texts by the 32,000-piece vocabulary."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path(token_counts.MODEL))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents and benchmark items that overlap."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of all pages."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed by source weights 5, 2, 1 to 150% of all words."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written to an archive and read back."""
    return warc.archive_and_read(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best rows of every hundredth embedding, by whole-number inner product."""
    return exact_topk.top_k_of(table(spark, sf_dir, "embeddings"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash tree of all documents, a proof of each, and each proof folded from a leaf that may be tampered with."""
    docs = table(spark, sf_dir, "documents")
    return merkle.verified(docs, merkle.tampered(docs))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth embedding and each of its positives."""
    return hard_negatives.mine_embeddings(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_katz, op2_toxicity, op3_near_dup, op4_chat, op5_media, op6_token_counts, op7_decontaminate, op8_html_text, op9_mixing, op10_warc, op11_exact_topk, op12_merkle, op13_hard_negatives)}


def oracle_sql() -> dict[str, str]:
    return {"op4_chat": chat.SQL, "op7_decontaminate": decontaminate.SQL, "op9_mixing": mixing.SQL, "op10_warc": warc.SQL, "op11_exact_topk": exact_topk.SQL, "op12_merkle": merkle.SQL, "op13_hard_negatives": hard_negatives.SQL}
