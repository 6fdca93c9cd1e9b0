"""Readers, writers and names of files."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fields import KEYS

#: Suffixes that uploads may have.
SUFFIXES = ("jpeg", "jpg", "pdf", "png")


# Names

def basename(path: Column) -> Column:
    """What follows the last slash of either kind; without it a path could leave its folder."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def suffix(path: Column) -> Column:
    """In lower case without the point; empty for names that only begin with a point."""
    return F.lower(F.regexp_extract(basename(path), r"[^.].*\.([^.]*)$|^[^.]\.([^.]*)$", 1))


def stem(path: Column) -> Column:
    name = basename(path)
    return F.when(suffix(path) != "", F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def safe_upload(name: Column, random: Column) -> Column:
    """struct(accepted, suffix, saved_as): stem, the first 8 characters of `random`, suffix. Null for names that aren't accepted."""
    kind = suffix(name)
    fine = kind.isin(*SUFFIXES)
    return F.struct(fine.alias("accepted"), kind.alias("suffix"), F.when(fine, F.concat(stem(name), F.lit("_"), F.substring(random, 1, 8), F.lit("."), kind)).alias("saved_as"))


def random_id() -> Column:
    return F.replace(F.uuid(), F.lit("-"), F.lit(""))


# Readers

def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole UTF-8 files, line ends as single line feeds."""
    text = F.regexp_replace("value", "\r\n?", "\n").alias("text")
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), text)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length, content) of files of accepted kinds; the listing prunes others before they are read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(suffix(F.col("path")).isin(*SUFFIXES))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    from ..streaming.runlog import RUN

    return spark.read.schema(RUN).json(path)


def failed_runs(runs: DataFrame) -> DataFrame:
    return runs.where("status = 'error'")


def latest(files: DataFrame) -> DataFrame:
    """The most recently written of (path, modified), equal times by path."""
    return files.orderBy(F.desc("modified"), F.desc("path")).limit(1)


def latest_file(spark: SparkSession, path: str) -> DataFrame:
    return latest(spark.read.format("binaryFile").load(path).select("path", F.col("modificationTime").alias("modified")))


def stored(df: DataFrame, path: str) -> DataFrame:
    """df written once and read again, so that nothing behind it is worked out twice or called again."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Writers

def result_json(df: DataFrame) -> DataFrame:
    """(doc_id, json): fields in the catalog's order, nulls included, with the warnings."""
    data = F.struct(*[F.col(k) for k in KEYS])
    return df.select("doc_id", F.to_json(F.struct(data.alias("data"), "warnings"), {"ignoreNullFields": "false"}).alias("json"))


def write_results(df: DataFrame, path: str, kind: str = "routed") -> None:
    """A folder <path>_<kind>.json of one object a line, a file per task; kind is routed, extracted or vlm."""
    keep = ["doc_id", *[c for c in df.columns if c in KEYS], *[c for c in df.columns if c == "warnings"]]
    df.select(*keep).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}_{kind}.json")


def plain_values(row: dict) -> dict:
    """Numbers of a result as JSON has them: whole ones as integers, others as floats."""
    return {k: v if v is None or isinstance(v, int) else int(v) if v == int(v) else float(v) for k, v in row.items()}


def result_text(values: dict, warnings: list[str] | None = None) -> str:
    """A result as a document's file holds it: fields in the catalog's order and, if given, the warnings."""
    data = plain_values({k: values.get(k) for k in KEYS})
    return json.dumps(data if warnings is None else {"data": data, "warnings": warnings}, ensure_ascii=False, indent=2) + "\n"


def save_result(folder: str, name: str, values: dict, warnings: list[str] | None = None, kind: str = "routed") -> str:
    """One file <folder>/<name>_<kind>.json, written whole or not at all. The folder may be of any file system that Arrow knows; gives its path."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    system.create_dir(root)
    path = f"{root}/{name}_{kind}.json"
    part = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(result_text(values, warnings).encode())
    system.move(part, path)
    return path


def save_results(df: DataFrame, folder: str, name_col: str = "name", kind: str = "routed") -> int:
    """A file a document, as save_result, written by the tasks into a folder that all executors share; gives their number."""
    known = [c for c in KEYS if c in df.columns]
    warned = "warnings" in df.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for row in pdf.to_dict("records"):
                save_result(folder, row[name_col], {k: None if pd.isna(row[k]) else row[k] for k in known}, list(row["warnings"]) if warned else None, kind)
            yield pd.DataFrame({"n": [len(pdf)]})

    slim = df.select(F.col(name_col), *[F.col(k).cast("decimal(38,6)").alias(k) for k in known], *(["warnings"] if warned else []))
    return slim.mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_text(texts: DataFrame, path: str) -> None:
    """Texts that end in a line feed, one after another; the writer adds the last one again."""
    texts.select(F.regexp_replace(texts.columns[0], r"\n\z", "")).write.mode("overwrite").text(path)


def write_raw(dumps: DataFrame, path: str) -> None:
    write_text(dumps.select("dump"), f"{path}_raw.txt")


def append_runs(runs: DataFrame, path: str) -> bool:
    """Append runs to the log, a file per task, so concurrent writers need no lock. A log that can't be written loses the entry, not the run."""
    from py4j.protocol import Py4JError
    from pyspark.errors import PySparkException

    try:
        runs.write.mode("append").json(path)
    except (PySparkException, Py4JError, OSError) as failure:
        print(f"[WARNING] the run log can't be written: {failure}")
        return False
    return True
