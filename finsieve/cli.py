"""Commands over files: extract, ocr, vlm, route, route-files, check, metrics. `python -m finsieve.cli COMMAND INPUT OUTPUT`."""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .fields import KEYS
from .operators.extract import all_fields
from .operators.layout import page_text, raw_dump
from .operators.router import RouteConfig, route, vlm_branch
from .operators.validate import validate
from .sources import io
from .sources.documents import route_documents
from .streaming import runlog


def extract(spark: SparkSession, source: str, target: str) -> None:
    """Fields of whole text files; without rules or merging."""
    made = all_fields(io.read_texts(spark, source)).select(io.stem(F.col("path")).alias("doc_id"), *KEYS)
    io.write_results(made, target, "extracted")


def ocr(spark: SparkSession, source: str, target: str) -> None:
    """Recorded texts of regions (Parquet: doc_id, page_no, region_no, text) as one dump per document."""
    io.write_raw(raw_dump(page_text(spark.read.parquet(source))), target)


def vlm(spark: SparkSession, source: str, target: str) -> None:
    """Recorded replies (Parquet: doc_id, page_no, region_no, call_status, body) merged."""
    made = vlm_branch(spark.read.parquet(source))
    io.write_results(made.select("doc_id", *KEYS), target, "vlm")


def routed(spark: SparkSession, source: str, target: str, ocr_first: bool = False) -> None:
    """A folder with page_text and responses, both Parquet, through the router; documents are logged as runs."""
    run = runlog.Run(source)
    try:
        with run.stage("route"):
            made = route(spark.read.parquet(f"{source}/page_text"), spark.read.parquet(f"{source}/responses"), RouteConfig(ocr_first))
            io.write_results(made, target)
        run.status = "ok"
    except BaseException:
        run.status = "error"
        raise
    finally:
        io.append_runs(spark.createDataFrame([run.row()], runlog.RUN), f"{target}_runs")


def routed_files(spark: SparkSession, source: str, target: str, ocr_first: bool = False, backends: str | None = None) -> None:
    """Document files of a folder through live backends and the router: a file <stem>_routed.json each in the folder target.

    `backends` names a function, package.module:function, that checks its settings and gives the
    Backends; it is called before any job.
    """
    module, _, function = (backends or "").partition(":")
    if not function:
        raise SystemExit("--backends package.module:function is wanted")
    live, run = getattr(importlib.import_module(module), function)(), runlog.Run(source)
    try:
        with run.stage("route"):
            made = route_documents(io.read_documents(spark, source), live, f"{target}_work", RouteConfig(ocr_first))
            io.save_results(made.withColumn("name", io.stem(F.col("path"))).withColumn("warnings", F.col("api_warnings")), target)
        run.status = "ok"
    except BaseException:
        run.status = "error"
        raise
    finally:
        io.append_runs(spark.createDataFrame([run.row()], runlog.RUN), f"{target}_runs")


def metrics(spark: SparkSession, source: str, target: str) -> None:
    """The exposition of a run log."""
    io.write_text(runlog.exposition(runlog.totals(io.read_runs(spark, source))), target)


def check(spark: SparkSession, source: str, target: str) -> None:
    """Records of numbers (Parquet: doc_id and the fields) with their warnings."""
    io.write_results(validate(spark.read.parquet(source)), target, "routed")


COMMANDS = {"extract": extract, "ocr": ocr, "vlm": vlm, "route": routed, "route-files": routed_files, "metrics": metrics, "check": check}


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("command", choices=COMMANDS)
    parser.add_argument("source")
    parser.add_argument("target")
    parser.add_argument("--ocr-first", action="store_true", help="extract from text first, ask the model for what the gate rejects")
    parser.add_argument("--backends", help="package.module:function that gives the live backends, for route-files")
    found = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("finsieve").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    more = {"ocr_first": found.ocr_first} if found.command in ("route", "route-files") else {}
    more |= {"backends": found.backends} if found.command == "route-files" else {}
    COMMANDS[found.command](spark, found.source, found.target, **more)


if __name__ == "__main__":
    main()
