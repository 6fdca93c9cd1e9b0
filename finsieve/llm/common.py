"""Shared storage, text batches and grouped streams used by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Lower-casing A-Z only, for translate().
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a folder of our own, in local mode alone."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="finsieve-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/finsieve/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read again: cuts the lineage, and lost executors lose none of it."""
    return stored_at(df, shared_path(df.sparkSession, name))


#: Texts of a batch.
TEXTS = 1024


def stored_at(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored_from_python(df: DataFrame, name: str) -> DataFrame:
    """stored() of a pass through Python over whole texts: rows go to workers in batches of few, so that little text is held at a time on either side."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    known = int(df.sparkSession.conf.get(key))
    with settings(df.sparkSession, {key: str(min(known, TEXTS) if known > 0 else TEXTS)}):
        return stored(df, name)


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete folders that were stored and aren't needed further."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def quoted(name: str) -> str:
    """A column's name for col(), whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def apart(df: DataFrame, name: str) -> str:
    """A column's name like `name` that df doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows whose keys are broadcast at most; with some hundred bytes a row of short() that is some 30 MB.
BROADCAST_ROWS = 1 << 18


def located(docs: DataFrame) -> DataFrame:
    """docs as a scan of files, whose rows have locators: as it is, or else a copy in the shared folder.

    Columns keep their places; one of the name that Spark has for locators gets another.
    """
    scan = docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"
    clash = [c for c in docs.columns if c.lower() == "_metadata"]
    if scan and not clash:
        return docs
    return stored(docs.select(*[F.col(quoted(c)).alias(apart(docs, c) if c in clash else c) for c in docs.columns]), "located")


def locator() -> Column:
    """File and number in it of a row of a located frame."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def short(at: Column) -> Column:
    """A locator of 24 bytes however long the path is: the file as 128 bits of hashes, and the row's number.

    The driver holds a broadcast row's key twice, which with paths was some 370 bytes a row.
    """
    return F.struct(F.xxhash64(at["file"]).alias("a"), F.xxhash64(F.lit(1), at["file"]).alias("b"), at["row"].alias("row"))


def without(source: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of a located frame whose locators aren't in gone (at), which is broadcast if it has few rows."""
    few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    gone, at = gone.select(short(F.col("at")).alias("at")), apart(source, "at")
    gone = F.broadcast(gone) if few else gone
    kept = source.withColumn(at, short(locator())).alias("s").join(gone.alias("g"), F.col(f"s.{at}") == F.col("g.at"), "left_anti")
    return kept.drop(at)


_held: dict[object, object] = {}


def held(key: object, make: Callable[[], object]) -> object:
    """What an operator remembers in a Python worker, made when first needed.

    Workers outlive stages, so the memory of one operator goes back to the system when another's is asked for.
    """
    if key not in _held:
        if _held:
            _held.clear()
            release()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Give free memory back to the system: Arrow's, and the C library's where it can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def over_texts(
    df: DataFrame,
    carry: list[str],
    text_col: str,
    schema: str,
    rows: Callable[[list[str | None]], list[tuple] | Iterator[tuple]],
) -> DataFrame:
    """carry columns followed by what `rows` makes of each text, in order; one pass, no shuffle.

    `schema` is the DDL of the made columns. Columns other than carry and text_col are dropped, so
    extra columns with clashing names never meet the made ones.
    """
    kept = df.select(*[F.col(quoted(c)) for c in carry]).schema
    source = df.select(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(carry)], F.col(quoted(text_col)).cast("string").alias("text"))
    made = StructType.fromDDL(schema)
    out_schema = StructType([*kept.fields, *made.fields])
    names, n = out_schema.names, len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out_schema)
        for batch in batches:
            for part in slices(batch):
                found = list(rows(part.column(n).to_pylist()))
                columns = list(zip(*found, strict=True)) if found else [()] * len(made)
                arrays = [part.column(i).cast(arrow.field(i).type) for i in range(n)]
                arrays += [pa.array(c, arrow.field(n + i).type) for i, c in enumerate(columns)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return source.mapInArrow(run, out_schema)


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of few rows, so that the Python objects made of one piece stay small."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def groups(batches: Iterator[pa.RecordBatch], key: str = "shard") -> Iterator[tuple[object, pa.Table]]:
    """Runs of rows with an equal key, of partitions that are sorted by it; a run may span batches."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        keys = batch.column(key).to_pylist()
        start = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[start]:
                if held and keys[start] != current:
                    yield current, pa.Table.from_batches(held)
                    held = []
                current = keys[start]
                held.append(batch.slice(start, i - start))
                start = i
    if held:
        yield current, pa.Table.from_batches(held)
