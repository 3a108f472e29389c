"""The corpus pipeline: language ID, line dedup, MinHash near-dedup, benchmark decontamination, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of docs. Every stage works on all that its predecessor
kept; documents with a null or repeated doc_id and null texts pass through as the operators define it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontamination, language_id, line_dedup, minhash_dedup, sentencepiece_codec
from quarry.llm.common import broadcast_if_small, materialize, table

#: Posterior probability under which a predicted language is no decision and the document is rejected.
LEAST_SCORE = 0.5
#: Similarity of near duplicates in percent, and the bands for it: of pairs at 80 percent one in 7 million meets in no band.
NEAR_PERCENT, NEAR_BANDS = 80, 40
#: Keys of 32 characters up to which a list of documents is broadcast; a longer one is shuffled.
BROADCAST_KEYS = 200_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an identified language; those without a letter, or of no language that is likelier than not, go."""
    found = language_id.identify(docs, language_id.train(docs))
    return found.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier one; documents of which nothing is left go."""
    found = line_dedup.dedup_lines(docs)
    found = found.where((F.col("n_exact") + F.col("n_near") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one whose doc_id is the smallest."""
    found = minhash_dedup.minhash_components(docs.select("doc_id", "text"), percent=NEAR_PERCENT, bands=NEAR_BANDS)
    kept = materialize(found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_key")).distinct(), "kept")
    key = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (key == F.col("kept_key")), "left_semi").dropDuplicates(["doc_id", "text"])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    spans = decontamination.contamination_spans(docs.select("text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    leaked = materialize(spans.select(F.col("text_key").alias("leaked_key")).distinct(), "leaked")
    return docs.join(broadcast_if_small(leaked, leaked.count(), BROADCAST_KEYS), F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("")) == F.col("leaked_key"), "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, roundtrip and ids: the token ids of each document."""
    return sentencepiece_codec.encode(docs.select("doc_id", "text"), sentencepiece_codec.load_model())


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("MinHash near-dedup", dedup_documents),
    ("benchmark decontamination", decontaminate),
    ("SentencePiece encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0].lower())
    return docs


#: Classifier and tokenizer have no SQL: tests hold the documents and texts that each stage keeps against brute force.
ORACLE_SQL = None
