"""Exact dedup by stateful streaming.

Slim rows (digest, stable identifier, content locator) run as a stream through keyed state on disk
(RocksDB) that never expires: a digest's state is how many rows had it, and identifier and locator
(file and row) of the row that stays. Rows of one micro-batch are combined before the shuffle, so a
text that a third of all rows hold is one row a task. Hits, found by their locators, are then
checked by full bytes; texts met once are neither compared nor shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, ascii_lower, discard, located, locator, quoted, settings, shared_path, stored, stored_at, without

#: Bytes of slim rows that a micro-batch takes.
BATCH_BYTES = 256 << 20
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # stores are many and may be small
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # A store is closed with its task: else an executor keeps those of all its partitions open, and its maintenance goes on in folders that are deleted.
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    # Where Hadoop has no native library, each rename by the other manager starts processes of the executor's JVM.
    "spark.sql.streaming.checkpointFileManagerClass": "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager",
}


def normalised(text: Column) -> Column:
    """A-Z in lower case, null as empty; texts without other than ASCII take the faster function."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(ascii_lower(text))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def stream_state(spark: SparkSession, log_path: str, schema, checkpoint: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Run what the folder log_path holds and the state in `checkpoint` doesn't have yet through the state; gives the state.

    Called again with the same folders, it takes only files that came meanwhile: the state of a
    stopped or lost run is carried on.
    """
    with settings(spark, STATE_CONF):
        rows = spark.readStream.schema(schema).option("maxBytesPerTrigger", batch_bytes).parquet(log_path)
        state = rows.groupBy("digest").agg(F.count("*").alias("group_size"), F.max(F.struct("id", "at")).alias("keep"))
        query = state.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.format("statestore").load(checkpoint).select("key.digest", "value.*").toDF("digest", "group_size", "keep")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] | None = None, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; of equal ones the row with the largest id
    stays (a null id is the smallest; of repeated rows with one id, one stays). A null text is
    empty, one of any length is a digest but for the check of its bytes. An empty table gives no
    rows; other columns are ignored.
    """
    found = judged(located(docs), id_col, text_col, digest, batch_bytes)
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", "text_sha256")


def judged(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column] | None = None, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(id, at, keep_id, group_size, kept, text_sha256) of the rows of a located frame; `at` is a row's locator."""
    spark, hashed = docs.sparkSession, digest or sha256
    texts = docs.select(F.col(quoted(id_col)).alias("id"), normalised(F.col(quoted(text_col))).alias("text"), locator().alias("at"))
    slim = texts.select("id", hashed(F.col("text")).alias("digest"), "at", *([] if digest is None else [sha256(F.col("text")).alias("text_sha256")]))
    log_path, checkpoint = shared_path(spark, "digest-log"), shared_path(spark, "digest-state")
    log = stored_at(slim, log_path)
    state = stream_state(spark, log_path, slim.schema, checkpoint, batch_bytes)
    sha = F.col("digest" if digest is None else "text_sha256").alias("text_sha256")
    found = log.join(state, "digest").select("id", "at", "digest", sha, "group_size", F.col("keep.id").alias("keep_id"), (F.col("at") == F.col("keep.at")).alias("kept"))
    found = stored(found, "digest-groups")
    discard(spark, log_path, checkpoint)
    clashing = stored(clashes(hits(texts, found).select(hashed(F.col("text")).alias("digest"), "text")).select("digest"), "digest-clashes")
    if not clashing.isEmpty():
        found = found.join(clashing, "digest", "left_anti").unionByName(resolved(texts.withColumn("digest", hashed(F.col("text"))).join(clashing, "digest", "left_semi")))
    return found.select("id", "at", "keep_id", "group_size", "kept", "text_sha256")


def key(at: Column) -> Column:
    return F.xxhash64(at["file"], at["row"])


def hits(texts: DataFrame, found: DataFrame) -> DataFrame:
    """The texts whose digest the state had met before, picked by their locators.

    Keys are broadcast if there are few enough; else all texts count as hits, which only costs time.
    """
    keys = found.where("group_size > 1").select(key(F.col("at")).alias("key"))
    if keys.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return texts
    return texts.join(F.broadcast(keys), key(F.col("at")) == F.col("key"), "left_semi")


def clashes(texts: DataFrame) -> DataFrame:
    """Digests that different full texts share. Equal texts are one row a task before the shuffle."""
    return texts.groupBy("digest", "text").agg(F.lit(1).alias("one")).groupBy("digest").agg(F.count("*").alias("n_texts")).where("n_texts > 1")


def resolved(texts: DataFrame) -> DataFrame:
    """Groups of rows under clashing digests by their full texts."""
    groups = texts.groupBy("digest", "text").agg(F.count("*").alias("group_size"), F.max(F.struct("id", "at")).alias("keep"))
    joined = texts.join(groups, ["digest", "text"])
    return joined.select("id", "at", "digest", sha256(F.col("text")).alias("text_sha256"), "group_size", F.col("keep.id").alias("keep_id"), (F.col("at") == F.col("keep.at")).alias("kept"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, all columns kept; of repeated rows with one id and text, one.

    A null text is empty, and an empty table gives no rows. What goes is found again by its locator:
    texts aren't shuffled where the locators are few enough to be broadcast.
    """
    source = located(docs)
    gone = stored(judged(source, id_col, text_col).where("not kept").select("at"), "digest-dropped")
    return without(source, gone).toDF(*docs.columns)
