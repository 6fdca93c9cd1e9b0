"""Whole documents from files: pages, regions, texts, calls of the model, and the router over them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.layout import exploded_regions, page_text
from ..operators.router import RouteConfig, needing_model, route, vlm_branch
from . import backends, io


@dataclass(frozen=True)
class Backends:
    """What makes each backend in a worker."""

    renderer: Callable[[], backends.PageRenderer]
    layout: Callable[[], backends.LayoutBackend]
    reader: Callable[[], backends.OcrBackend] | None = None
    model: Callable[[], backends.VlmBackend] | None = None


def numbered(files: DataFrame) -> DataFrame:
    """(doc_id, path) of files (path): ids are 64-bit hashes of paths, so that a task that is tried again gives the same."""
    return files.select(F.xxhash64("path").alias("doc_id"), "path").distinct()


def page_images(files: DataFrame, live: Backends, work_dir: str) -> DataFrame:
    """(doc_id, page_no, image, region_no, region): each page is rendered and its tables are found once.

    Rendering is the dearest step, so pages and boxes are written to work_dir, which driver and
    executors share; text recognition and the model both read them from there, and images aren't
    shuffled on the way. A page without a table is one region.
    """
    rendered = backends.render_pages(backends.pages_of(numbered(files), live.renderer), live.renderer)
    boxes = backends.detect_boxes(rendered.withColumn("doc_id", F.xxhash64("path")), live.layout, with_images=True)
    return exploded_regions(io.stored(boxes, f"{work_dir}/pages"), "image")


def read_documents(regions: DataFrame, live: Backends) -> DataFrame:
    """(doc_id, page_no, text) by recognition of all regions."""
    return page_text(backends.read_regions(regions, live.reader))


def ask_model(regions: DataFrame, live: Backends, work_dir: str, patience: int = 3) -> DataFrame:
    """The model's replies, called page after page until each document has enough, and kept in work_dir."""
    images = backends.crop_regions(regions, live.renderer)
    return io.stored(backends.call_until_done(images, live.model, backends.build_prompt(), patience), f"{work_dir}/responses")


def ocr_documents(files: DataFrame, live: Backends, work_dir: str) -> DataFrame:
    """(doc_id, path, page_no, text) of whole documents."""
    return read_documents(page_images(files, live, work_dir), live).join(numbered(files), "doc_id")


def vlm_documents(files: DataFrame, live: Backends, work_dir: str) -> DataFrame:
    """Each document's raw fields by the model alone, with path and counts of calls."""
    return vlm_branch(ask_model(page_images(files, live, work_dir), live, work_dir)).join(numbered(files), "doc_id")


def route_documents(files: DataFrame, live: Backends, work_dir: str, config: RouteConfig = RouteConfig()) -> DataFrame:
    """The router's rows, with path, of files (path).

    Texts are recognised only if the configuration asks for them first, and the model is called only
    for documents that the gate then rejects, on pages that are rendered already. work_dir must be
    new; what is written there may be deleted when the result has been used.
    """
    regions = page_images(files, live, work_dir)
    if config.ocr_first:
        texts = io.stored(read_documents(regions, live), f"{work_dir}/texts")
        asked = regions.join(needing_model(texts), "doc_id", "left_semi")
    else:
        texts = regions.select("doc_id", "page_no", F.lit("").alias("text")).distinct()
        asked = regions
    return route(texts, ask_model(asked, live, work_dir), config).join(numbered(files), "doc_id")
