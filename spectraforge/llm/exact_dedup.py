"""Exact deduplication by a stateful stream over a digest log.

Every text is reduced to the SHA-256 of its normalised form (all of ``[\\x20\\x09-\\x0D]``
deleted). The log (digest, length, identifier, file and row of the text) is read by Structured
Streaming into keyed state that lives on disk (RocksDB) and never expires; the state keeps per
digest the number of rows, and the identifier and place of the row that stays. On hits (digests
seen more than once) the full normalised bytes are compared, of these rows alone, so two texts
are joined only if they are equal.

Defined results
    null text: as the empty text. Null ``doc_id``: a row like any other; it stays only if no
    equally long copy has an identifier. Repeated rows: all count in ``group_size``; every row
    with the identifier that stays is kept. Empty table: empty result. Extra columns: not read.
    Rows that do not come from Parquet files have no place (null).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CLASS, materialise, shared_dir, text_or_empty

#: State on disk; a store is closed after each batch, so idle stores hold no local files.
_STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
#: Up to so many digests (32 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_DIGESTS = 500_000
_LOG = "doc_id long, digest binary, n_points int, place struct<file:string,row:long>"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE_CLASS + "+", "")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _state_session(spark: SparkSession) -> SparkSession:
    """A session with the caller's SQL settings and those of the state, which no other query sees."""
    own = spark.newSession()
    for name, value in {**{k: v for k, v in spark.conf.getAll.items() if k.startswith("spark.sql.")}, **_STATE_SETTINGS}.items():
        if own.conf.isModifiable(name):
            own.conf.set(name, value)
    return own


def _place(docs: DataFrame) -> Column:
    """File and row number of each row, where the rows are read from Parquet."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    if "_metadata" not in docs.columns:
        try:
            docs.select(place)
            return place
        except AnalysisException:
            pass
    return F.lit(None).cast("struct<file:string,row:long>")


def digest_log(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per document: doc_id, digest, code points, place."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        digest(normalised(text_or_empty())).alias("digest"),
        F.length(text_or_empty()).alias("n_points"),
        _place(docs).alias("place"),
    )


def preference(n_points: Column, doc_id: Column) -> list[Column]:
    """Sorts the row that stays first: longest original, then smallest identifier, nulls last."""
    return [(-n_points).alias("shorter"), doc_id.isNull().alias("unnamed"), doc_id.alias("id")]


def stream_state(spark: SparkSession, path: str, checkpoint: str) -> DataFrame:
    """Feed the log below ``path`` to the state at ``checkpoint`` and write the state out.

    Called again with the same checkpoint after more files came, only these are read and the
    state is updated.
    """
    own = _state_session(spark)
    keyed = (
        own.readStream.schema(_LOG)
        .parquet(path)
        .groupBy("digest")
        .agg(
            F.count(F.lit(1)).alias("group_size"),
            F.min(F.struct(*preference(F.col("n_points"), F.col("doc_id")), "place")).alias("stays"),
        )
    )
    query = keyed.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    state = own.read.format("statestore").load(checkpoint).select(
        F.col("key.digest").alias("digest"),
        F.col("value.count").alias("group_size"),
        F.col("value.min.id").alias("keep_id"),
        F.col("value.min.place").alias("keep_place"),
    )
    out = shared_dir(spark)
    state.write.parquet(out)
    return spark.read.schema(state.schema).parquet(out)


def texts_of(docs: DataFrame, digests: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Rows of ``docs`` with one of ``digests``: doc_id, digest, n_points, place and the normalised text."""
    few = digests.count() <= BROADCAST_DIGESTS
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), normalised(text_or_empty()).alias("body"), F.length(text_or_empty()).alias("n_points"), _place(docs).alias("place")
    ).withColumn("digest", digest(F.col("body")))
    return texts.join(F.broadcast(digests) if few else digests, "digest", "left_semi")


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and the place of the row that stays.

    ``digest`` finds candidates; a weaker one gives the same groups, only text_sha256 is its own.
    """
    spark = docs.sparkSession
    log_path = shared_dir(spark)
    digest_log(docs, digest).write.parquet(log_path)
    log = spark.read.schema(_LOG).parquet(log_path)
    state = stream_state(spark, log_path, shared_dir(spark))

    # Hits: the state says how many rows share a digest, the bytes say how many share a text. Equal
    # texts meet inside each task before the shuffle, so a large group of copies sends a row a task.
    hits = materialise(state.where("group_size > 1").select("digest", F.col("group_size").alias("claimed")))
    shared = texts_of(docs, hits.select("digest"), digest).groupBy("digest", "body").agg(F.count(F.lit(1)).alias("confirmed"))
    refuted = materialise(shared.select("digest", "confirmed").join(hits, "digest").where("confirmed <> claimed").select("digest").distinct())
    rows = log.join(state, "digest")
    if refuted.isEmpty():
        return _result(rows)
    # Different texts with one digest: these rows alone are joined by their bytes.
    sure = _result(rows.join(refuted, "digest", "left_anti"))
    disputed = texts_of(docs, refuted, digest)
    classes = disputed.groupBy("digest", "body").agg(
        F.count(F.lit(1)).alias("group_size"), F.min(F.struct(*preference(F.col("n_points"), F.col("doc_id")), "place")).alias("stays")
    )
    exact = classes.select("digest", "body", "group_size", F.col("stays.id").alias("keep_id"), F.col("stays.place").alias("keep_place"))
    return sure.unionByName(_result(disputed.join(exact, ["digest", "body"])))


def _result(rows: DataFrame) -> DataFrame:
    return rows.select(
        "doc_id",
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "keep_place",
    )
