"""The corpus pipeline: five stages over ``documents``, each calling one operator of ``ticketlens.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read back as the next
stage's docs. All stages but the last return the columns of ``documents``; the last returns the packed pieces.
Null, empty and very long texts, repeated rows and extra columns are handled as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.llm import decontaminate, language_id, packing, simhash, suffix_dedup
from ticketlens.llm.common import crc_mod, delete, only_keeping, stored_at, table
from ticketlens.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told stay: a null text, one without a letter and one without any n-gram of a learned language go."""
    model = language_id.fit(docs, crc_mod("doc_id", 4) == 2)
    found = language_id.identify(docs, model)
    return found.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("lang_votes") > 0)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each class of near-duplicates stays."""
    return simhash.one_of_each(docs, shingle=4, budget=4)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose what repeats 50 bytes or more of a document with a smaller id.

    A character goes only with all its bytes, so texts stay valid UTF-8; n_chars follows the text. A document that loses all
    of its text goes.
    """
    found = suffix_dedup.remove_repeats(docs, width=50, whole_characters=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept").cast("string")).otherwise(F.col("text"))
    return (found.where((F.col("n_removed") == 0) | (F.octet_length("kept") > 0))
            .withColumn("text", text)
            .withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
            .select(*docs.columns))


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an occurrence of any benchmark window stay."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents left, packed into sequences of at most 2048 tokens; a row per piece, with its token ids."""
    return packing.pack(docs, tokenizer_path(), capacity=2048, end_id=0, with_ids=True)


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeats),
    ("benchmark decontamination", benchmark_free),
    ("best-fit packing", sequences),
]

#: SQL cannot express the stages; tests hold each of them against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written to the shared folder.

    Once a stage is written, the tables stored on its way and the result of the stage before are deleted.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with only_keeping(spark) as kept:
            docs, path = stored_at(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            kept.append(path)
        if before:
            delete(spark, before)
        before = path
    return docs
