"""The pipeline that turns ``documents`` into training data; each stage calls one operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.llm import bpe, decontaminate, lines, queries, simhash, toxicity
from staylens.sources.durable import durable, release

# The columns of documents, as all stages but the last return them.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the limit stay, unchanged; any row is scored by itself.

    Null and empty texts have the score of a text without words. Repeated rows and rows without an id
    are judged like others, the length of a text bounds nothing, and an empty table stays empty.
    """
    model = queries.toxicity_model(spark, sf_dir)
    scored = toxicity.score_texts(docs.select(COLUMNS), model)
    return scored.where(F.col("score") < queries.TOXIC_FROM).select(COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated lines; ``n_chars`` follows the text, a null text stays null.

    All rows stay. Rows of one id are one document, as are all rows without an id, which comes before
    every other, so a line that others have too goes there. An empty table stays empty.
    """
    kept = lines.drop_repeated_lines(docs.select(COLUMNS))
    text = F.when(F.col("text").isNotNull(), F.col("kept_text"))
    changed = F.col("n_dropped") > 0
    return kept.select(
        "doc_id",
        text.alias("text"),
        "lang",
        "source",
        F.when(changed, F.length(text).cast("long")).otherwise(F.col("n_chars")).alias("n_chars"),
    )


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, unchanged: that with the smallest id.

    Null, empty and blank texts have the fingerprint zero and are near duplicates of each other. A
    group without any id keeps one row, as does one whose smallest id repeats. An empty table stays empty.
    """
    found = simhash.near_duplicates(docs.select(COLUMNS))
    return simhash.one_of_each(found).select(COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window stay, unchanged.

    Null and empty texts have no words and stay; so do repeated rows and rows without an id that are
    clean. With a benchmark without words all rows stay; an empty table stays empty.
    """
    found = decontaminate.find_passages(docs.select(COLUMNS), queries.table(spark, sf_dir, "benchmark"))
    return found.where(F.size("hit_spans") == 0).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of ids and decoded text of each remaining document.

    A row for each row, ids null or repeated included; a null text is encoded as an empty one, which has
    no tokens. An empty table gives no rows.
    """
    return bpe.round_trip_digests(docs, queries.byte_vocabulary(), keep=["doc_id"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding and decoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's result is written before the next reads it."""
    docs = queries.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        kept = durable(stage(spark, docs, sf_dir))
        release(docs)
        docs = kept
    return docs


# The classifier and the encoder cannot be said in SQL; the tests hold each stage against brute force.
ORACLE_SQL = None
