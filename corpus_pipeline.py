"""A training-data pipeline over ``documents`` of the ``llm`` operators; every stage rereads the last one's table.

Stages: language identification (texts that are not in one of ``LANGUAGES`` go, and those of which
the model is less sure than ``MIN_SCORE``), exact deduplication, SimHash
near-deduplication (the smallest doc_id of each component stays), benchmark decontamination
(documents with a hit word go), and BPE encoding. All but the last return the columns they got.

Rows are told apart by their place (file and row), not by ``doc_id``: of rows that share an id each is judged by its
own text, and of equal or near-equal rows one stays, whatever their ids.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraforge.llm import bpe, decontaminate, exact_dedup, language_id, simhash
from spectraforge.llm.common import materialise
from spectraforge.llm.queries import vocabulary


#: Languages of the corpus, and the least probability of the predicted one.
LANGUAGES = ("de", "en", "es", "fr")
MIN_SCORE = 0.5


def _filed(docs: DataFrame) -> DataFrame:
    """``docs`` as rows of files, so that each has a place."""
    try:
        docs.select(_place())
        return docs
    except AnalysisException:
        return materialise(docs)


def _place() -> Column:
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def _only(docs: DataFrame, places: DataFrame) -> DataFrame:
    """The rows of ``docs`` at these places, whole and with their own columns only."""
    stays = places.select(F.col("place.file").alias("__stays_file"), F.col("place.row").alias("__stays_row"))
    placed = docs.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    return placed.join(stays, (F.col("__file") == F.col("__stays_file")) & (F.col("__row") == F.col("__stays_row")), "left_semi").select(*docs.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.identified_only(docs, language_id.train(docs, vocabulary("piece_bpe_32k.model")), LANGUAGES, MIN_SCORE)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = _filed(docs)
    return _only(docs, exact_dedup.exact_dedup(docs).select(F.col("keep_place").alias("place")).distinct())


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = _filed(docs)
    return _only(docs, simhash.one_a_component(docs, _place()))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_only(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(docs, vocabulary("word_bpe_49k.json"), keep=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("simhash_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe_encoding", encode),
]

#: SimHash and the tokenizer have no SQL form; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
