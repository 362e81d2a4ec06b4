"""The registered queries: each operator, with its parameters, on its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.llm import (
    bpe,
    decontaminate,
    embeddings,
    lexical,
    licence_texts,
    licences,
    lines,
    mixing,
    passages,
    secrets,
    shards,
    simhash,
    toxicity,
    whitening,
)
from staylens.llm.oracles import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES", "table"]

TOXIC_FROM = 0.7
# Words in a row that make a passage which documents share, besides the bytes that are removed.
PASSAGE_WORDS = 51
# The fold that is never learned from.
FOLDS, HELD_OUT = 3, 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_vocabulary() -> bpe.Vocabulary:
    """The public byte-level vocabulary of 50,257 tokens, read from where it is installed."""
    import public_tokenizers

    return bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_50k.json"))


def fold(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.TextCnn:
    """Trained on all labelled rows outside the held-out fold."""
    # The documents' condition follows from the labels'; it keeps the others out of the join's shuffle.
    known = fold() != HELD_OUT
    return toxicity.train_on(table(spark, sf_dir, "documents").where(known), table(spark, sf_dir, "labels").where(known))


def sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def fingerprinted(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


def without_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = passages.drop_passages(table(spark, sf_dir, "documents"), keep=["doc_id"], n_words=PASSAGE_WORDS)
    return cut.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"),
        (F.col("n_removed") > 0).alias("repeats"), "shares_words",
    )


def near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def decontaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_passages(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"]
    )
    n_hit = decontaminate.hit_words()
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("hit_items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def deduplicated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )


def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), byte_vocabulary(), keep=["doc_id"])


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of at least four letters of ``benchmark``."""
    runs = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))
    return table(spark, sf_dir, "benchmark").select(F.explode(runs).alias("word")).distinct()


def secret_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.scan_secrets(documents, dictionary(spark, sf_dir), F.coalesce(fold() != HELD_OUT, F.lit(True)))


def toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = toxicity_model(spark, sf_dir)
    scored = toxicity.score_texts(table(spark, sf_dir, "documents"), model, keep=["doc_id", "lang"])
    return scored.select(
        "doc_id",
        # A row without an id is in no fold that is held out.
        F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"),
        toxicity.language_threshold(model).alias("lang_threshold"),
        toxicity.decided(model).alias("predicted_by_lang"),
    )


def licensed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(
        table(spark, sf_dir, "documents"), licence_texts.NAMES, licence_texts.NOTICES, keep=["doc_id"]
    )


def ranked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", "size", "source_size", "target", "taken")


def whitened(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings"), keep=["vec_id"])
    # Beyond a long the exact sum has no place in the column: null.
    deviation = F.col("deviation").try_cast("long")
    return whitening.by_component(found, ["vec_id"]).withColumn("deviation", deviation)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_kd_shards": sharded,
    "op2_simhash": fingerprinted,
    "op3_passage_dedup": without_passages,
    "op4_embedding_dedup": near_vectors,
    "op5_decontaminate": decontaminated,
    "op6_line_dedup": deduplicated_lines,
    "op7_bpe": encoded,
    "op8_secrets": secret_findings,
    "op9_toxicity": toxic,
    "op10_licences": licensed,
    "op11_lexical": ranked_documents,
    "op12_mixing": mixed,
    "op13_whitening": whitened,
}
