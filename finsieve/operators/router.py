"""Routing: text extraction first if wanted, the gate, the model for what it rejects, and the final check."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fields import KEYS
from ..functions.numbers import WIDE, coerce
from ..functions.responses import parse
from .extract import all_fields
from .merge import at_stop, first_value, ocr_prefixes, vlm_prefixes
from .validate import acceptable, required_present, rule_ids, rules, warnings

RAW = "struct<kind:string,txt:string>"


@dataclass(frozen=True)
class RouteConfig:
    """ocr_first is off unless asked for, as the environment variable USE_OCR_FIRST is; kind is the values' type."""

    ocr_first: bool = False
    kind: str = WIDE

    @classmethod
    def from_env(cls, env: dict[str, str]) -> RouteConfig:
        return cls(env.get("USE_OCR_FIRST", "false").strip().lower() in {"1", "true", "yes"})


def ocr_branch(page_text: DataFrame) -> DataFrame:
    """Each document's fields by text extraction, page after page up to the first that the gate accepts."""
    return at_stop(ocr_prefixes(all_fields(page_text).select("doc_id", "page_no", *KEYS)))


def parsed_regions(responses: DataFrame, *kept: str) -> DataFrame:
    """responses (doc_id, page_no, region_no, call_status, body) with parse_ok and raw values by key; `kept` columns go along.

    A reply without content is a failed call; an empty one is unreadable.
    """
    status = F.when((F.col("call_status") == "ok") & F.col("body").isNotNull(), "ok").when(F.col("region_no").isNotNull(), "failed")
    made = responses.select("doc_id", "page_no", "region_no", status.alias("call_status"), parse(F.when(F.col("call_status") == "ok", F.col("body"))).alias("reply"), *kept)
    return made.select("doc_id", "page_no", "region_no", "call_status", F.coalesce("reply.parse_ok", F.lit(False)).alias("parse_ok"), *kept, *[F.try_element_at("reply.fields", F.lit(k)).alias(k) for k in KEYS])


#: Counts of calls: each region is one, however often it was tried.
COUNTS = ("vlm_calls", "vlm_failures", "parse_failures")


def vlm_pages(regions: DataFrame, *kept: str) -> DataFrame:
    """First raw value of each field on each page, by region, and counts of the page's calls. All regions of a page count before reading may stop."""
    calls = (F.count("call_status"), F.count_if(F.col("call_status") == "failed"), F.count_if((F.col("call_status") == "ok") & ~F.col("parse_ok")))
    return regions.groupBy("doc_id", "page_no").agg(*[first_value(F.col(k), "region_no").alias(k) for k in KEYS], *[c.alias(n) for c, n in zip(calls, COUNTS)], *[F.first(c).alias(c) for c in kept])


def vlm_branch(responses: DataFrame, *kept: str) -> DataFrame:
    """Raw values (kind, txt) by first page up to the stop, with counts of calls up to there.

    Replies are parsed where they lie (Python's part of a plan loses its partitioning) and then dealt
    by document once: pages, prefixes and the choice of the stop page keep to that. `kept` columns
    are a document's own.
    """
    regions = parsed_regions(responses, *kept).repartition("doc_id")
    return at_stop(vlm_prefixes(vlm_pages(regions, *kept), counts=COUNTS, kept=kept), (*COUNTS, *kept))


def route(page_text: DataFrame, responses: DataFrame, config: RouteConfig = RouteConfig()) -> DataFrame:
    """One row per document: fields, rule_ids, warnings, api_warnings, final_acceptable, vlm_needed, pages_processed, counts of calls.

    Text extraction runs on all documents only if it is asked for; the model's replies are joined
    only to documents that the gate then rejects, and overwrite what the text gave (a rejected record
    always has a warning). Nothing is gated again after the model. A document's text results go along
    with its replies, so both are worked out once and nothing is cached. Values are of the type
    `config.kind`, by default one that keeps JSON's floats and long numbers.
    """
    documents = page_text.select("doc_id")
    if config.ocr_first:
        text = ocr_branch(page_text)
        found = F.struct(*[F.when(F.col(k).isNotNull(), F.struct(F.lit("int").alias("kind"), F.col(k).cast("string").alias("txt"))).alias(k) for k in KEYS], F.col("stop_page").alias("stop"))
        ocr = text.select("doc_id", (~F.col("stopped")).alias("vlm_needed"), found.alias("ocr"))
    else:
        found = F.struct(*[F.lit(None).cast(RAW).alias(k) for k in KEYS], F.lit(None).cast("int").alias("stop"))
        ocr = documents.distinct().select("doc_id", F.lit(True).alias("vlm_needed"), found.alias("ocr"))
    replies = responses.select(F.col("doc_id").alias("__doc"), "page_no", "region_no", "call_status", "body")
    joined = ocr.join(replies, (F.col("doc_id") == F.col("__doc")) & F.col("vlm_needed"), "left").drop("__doc")
    both = vlm_branch(joined, "vlm_needed", "ocr")
    merged = both.select("doc_id", "vlm_needed", *[F.coalesce(k, f"ocr.{k}").alias(f"raw_{k}") for k in KEYS], F.greatest("ocr.stop", "stop_page").alias("pages_processed"), *COUNTS)
    raw = {k: F.col(f"raw_{k}") for k in KEYS}
    typed = merged.withColumns({k: coerce(raw[k], config.kind) for k in KEYS})
    values = {k: F.col(k) for k in KEYS}
    first, again = rules(values, raw, config.kind), rules(values, kind=config.kind)
    checked = typed.withColumns({"rule_ids": rule_ids(first), "warnings": warnings(first), "api_warnings": warnings(again)})
    there = required_present({k: F.col(f"raw_{k}") for k in KEYS})
    return checked.withColumn("final_acceptable", acceptable(there, F.size("warnings"))).select("doc_id", *KEYS, "rule_ids", "warnings", "api_warnings", "final_acceptable", "vlm_needed", "pages_processed", *COUNTS)


def needing_model(page_text: DataFrame) -> DataFrame:
    """doc_id of documents whose text extraction the gate doesn't accept on any page."""
    return page_text.select("doc_id").distinct().join(ocr_branch(page_text).where("stopped").select("doc_id"), "doc_id", "left_anti")
