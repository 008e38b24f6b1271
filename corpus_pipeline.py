"""The corpus pipeline: five stages over documents, each one operator of the llm subpackage.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as
the next one's docs. All but the last return the columns of documents. The classifier of the first stage learns from labels.

All stages take nulls in any column, texts that are empty or of any length, repeated rows and empty tables; columns other than doc_id, text
and n_chars pass through as they are. What each does with them stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import neardup, packing, quality, storage, substring, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under 0.5. A null text is scored as an empty one, by the intercept alone; repeated rows and equal texts get equal
    scores; a score of 0.5 itself is toxic. An empty table stays empty."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model, "toxicity_score")
    return scored.where(F.col("toxicity_score") < 0.5).select(*docs.columns)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules. Null, empty and short texts have under 50 words and go; a measure at its bound passes; repeated
    rows stay or go together."""
    return quality.keep(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that of the least doc_id; where several texts have it, that of the least MD5; of repeated rows
    one. A class without doc_ids keeps one row. All texts without words that reach the stage are one class."""
    return neardup.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that stand earlier in the corpus, by doc_id, then MD5, null first; n_chars follows the text. A null text stays
    null, a text of repeats only becomes empty; repeated rows are cut alike."""
    return substring.cut_repeats(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 2048 tokens. A null or empty text is the end id alone; repeated rows are packed
    as often as they occur; ties in length are broken by doc_id, start and checksum."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", keep_good),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("packing", pack),
]

#: SQL can express neither a trained classifier nor signatures, so there is none for run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        before, docs = docs, storage.table(stage(spark, docs, sf_dir))
        storage.drop(before)
    return docs
