"""First values over pages, and the page at which reading stops.

What is known before the first page that stops doesn't depend on stopping, so all prefixes are
evaluated by windows and rows up to that page are kept. Pages are numbered densely from 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fields import KEYS, REQUIRED
from .validate import rules, warnings

#: Pages without a new field after which a document with all required fields is done.
PATIENCE = 3


def first_value(value: Column, *order: str) -> Column:
    """Aggregate: the first value that isn't null, in the order of the columns."""
    return F.min_by(value, F.when(value.isNotNull(), F.struct(*order)))


def first_non_null(df: DataFrame, by: list[str], order: list[str], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """One row per `by` with each key's first value. Combined before the shuffle; no order of rows matters."""
    return df.groupBy(*by).agg(*[first_value(F.col(k), *order).alias(k) for k in keys])


def prefix_state(pages: DataFrame, keys: tuple[str, ...] = KEYS, counts: tuple[str, ...] = (), kept: tuple[str, ...] = ()) -> DataFrame:
    """pages with each key's first value up to the page, n_found and n_new (fields first found there).

    `counts` are columns that are added up over the same window, `kept` columns go along as they are.
    """
    upto = Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, 0)
    state = pages.select("doc_id", "page_no", *kept, *[F.first(k, ignorenulls=True).over(upto).alias(k) for k in keys], *[F.sum(c).over(upto).alias(c) for c in counts])
    counted = state.withColumn("n_found", sum((F.col(k).isNotNull().cast("int") for k in keys), F.lit(0)))
    before = F.lag("n_found", 1, 0).over(Window.partitionBy("doc_id").orderBy("page_no"))
    return counted.withColumn("n_new", F.col("n_found") - before)


def vlm_prefixes(pages: DataFrame, patience: int = PATIENCE, counts: tuple[str, ...] = (), kept: tuple[str, ...] = ()) -> DataFrame:
    """Prefix states with idle (pages since a new field) and stop (all fields, or the required ones and patience at its end)."""
    upto = Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, 0)
    state = prefix_state(pages, counts=counts, kept=kept)
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no"))
    state = state.withColumn("__nth", nth)
    last_new = F.coalesce(F.max(F.when(F.col("n_new") > 0, F.col("__nth"))).over(upto), F.lit(0))
    state = state.withColumn("idle", F.col("__nth") - last_new).drop("__nth")
    required = F.lit(True)
    for k in REQUIRED:
        required = required & F.col(k).isNotNull()
    return state.withColumn("stop", (F.col("n_found") == len(KEYS)) | (required & (F.col("idle") >= patience)))


def ocr_prefixes(pages: DataFrame) -> DataFrame:
    """Prefix states with stop: the gate accepts what is known so far."""
    state = prefix_state(pages)
    found = rules({k: F.col(k) for k in KEYS})
    ready = F.lit(True)
    for k in REQUIRED:
        ready = ready & F.col(k).isNotNull()
    return state.withColumn("stop", ready & (F.size(warnings(found)) == 0))


def stop_pages(prefixes: DataFrame) -> DataFrame:
    """(doc_id, stop_page, stopped): the first page that stops, else the last."""
    first = F.min(F.when(F.col("stop"), F.col("page_no")))
    return prefixes.groupBy("doc_id").agg(F.coalesce(first, F.max("page_no")).alias("stop_page"), first.isNotNull().alias("stopped"))


def at_stop(prefixes: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Each document's state at its stop page, with stop_page and stopped, and `more` columns of that page's state.

    The page is found over the window that made the prefixes, so nothing is shuffled again. A
    document of one row without a page keeps that row.
    """
    whole = Window.partitionBy("doc_id")
    first = F.min(F.when(F.col("stop"), F.col("page_no"))).over(whole)
    marked = prefixes.withColumn("stopped", first.isNotNull()).withColumn("stop_page", F.coalesce(first, F.max("page_no").over(whole)))
    return marked.where("page_no <=> stop_page").select("doc_id", *KEYS, *more, "stop_page", "stopped")
