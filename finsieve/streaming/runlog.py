"""Run metrics, cumulative counters, their exposition, and what a time-series store would ask of them."""

from __future__ import annotations

import contextlib
import threading
import time
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.numbers import rounded

RUN = "timestamp timestamp, document string, status string, total_seconds double, stages map<string,double>, counters map<string,bigint>, info map<string,string>"
#: Series that exist before any run, and the prefix of all of them in the exposition.
SEEDED = ("documents_total", "documents_ok_total", "documents_error_total")
PREFIX = "doc_ai_"


@dataclass
class Run:
    """A run in the driver: stages add up, also when they fail; a row of the run log comes of it."""

    document: str
    status: str = "running"
    started: datetime = field(default_factory=lambda: datetime.now(UTC))
    stages: dict[str, float] = field(default_factory=dict)
    counters: dict[str, int] = field(default_factory=dict)
    info: dict[str, str] = field(default_factory=dict)
    _began: float = field(default_factory=time.perf_counter)

    @contextlib.contextmanager
    def stage(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.stages[name] = self.stages.get(name, 0.0) + time.perf_counter() - began

    def count(self, name: str, amount: int = 1) -> None:
        self.counters[name] = self.counters.get(name, 0) + amount

    def set_info(self, **known: object) -> None:
        self.info |= {k: str(v) for k, v in known.items()}

    def row(self) -> tuple:
        return self.started, self.document, self.status, round(time.perf_counter() - self._began, 2), {k: round(v, 2) for k, v in self.stages.items()}, dict(self.counters), dict(self.info)


def timer(run: Run | None, name: str):
    return run.stage(name) if run is not None else contextlib.nullcontext()


# Runs from events

def sums(events: DataFrame, kind: str, by: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """(by, name, value): stage seconds or counters of events (run_id, seq, kind, name, value) added up."""
    return events.where(F.col("kind") == kind).groupBy(*by, "name").agg(F.sum("value").alias("value"))


def last_info(events: DataFrame) -> DataFrame:
    """(run_id, name, value): the last value written."""
    return events.where("kind = 'info'").groupBy("run_id", "name").agg(F.max_by("value", "seq").alias("value"))


def stage_maps(events: DataFrame) -> DataFrame:
    """(run_id, stages, counters), seconds rounded to cents."""
    def mapped(kind: str, value: Column) -> DataFrame:
        return sums(events, kind).groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", value.alias("value"))))).alias(f"{kind}s"))

    runs = events.select("run_id").distinct()
    return runs.join(mapped("stage", rounded(F.col("value"))), "run_id", "left").join(mapped("counter", F.col("value").cast("bigint")), "run_id", "left")


def summary_line(status: Column, total_seconds: Column, stages: Column, counters: Column) -> Column:
    """status | total | stages, the longest first | counters by name."""
    def order(a: Column, b: Column) -> Column:
        return F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1).when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)

    timed = F.transform(F.array_sort(F.map_entries(stages), order), lambda e: F.concat(e["key"], F.lit(" "), e["value"].cast("string"), F.lit("s")))
    counted = F.transform(F.array_sort(F.map_entries(counters)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return F.array_join(F.concat(F.array(status, F.concat(total_seconds.cast("string"), F.lit("s tổng"))), F.coalesce(timed, F.array().cast("array<string>")), F.coalesce(counted, F.array().cast("array<string>"))), " | ")


# Totals

def contributions(runs: DataFrame, more: Column | None = None) -> DataFrame:
    """(name, value) that each run adds; a status out of the ordinary has a series of its own. Seconds are the rounded ones. `more`: an array that each run adds besides."""
    one = F.lit(1.0)
    fixed = F.array(
        F.struct(F.lit("documents_total").alias("name"), one.alias("value")),
        F.struct(F.concat(F.lit("documents_"), "status", F.lit("_total")).alias("name"), one.alias("value")),
        F.struct(F.lit("seconds_total").alias("name"), rounded(F.col("total_seconds")).alias("value")),
    )
    empty = F.array().cast("array<struct<name:string,value:double>>")
    stages = F.transform(F.map_entries("stages"), lambda e: F.struct(F.concat(F.lit("stage_"), e["key"], F.lit("_seconds_total")).alias("name"), rounded(e["value"]).alias("value")))
    counters = F.transform(F.map_entries("counters"), lambda e: F.struct(F.concat(e["key"], F.lit("_total")).alias("name"), e["value"].cast("double").alias("value")))
    return runs.select(F.inline(F.concat(fixed, F.coalesce(stages, empty), F.coalesce(counters, empty), *([] if more is None else [more]))))


def totals(runs: DataFrame) -> DataFrame:
    """(name, value) over all runs, with the seeded series at 0 where no run adds to them. Sums commute, so there is no lock."""
    seeds = runs.sparkSession.createDataFrame([(n, 0.0) for n in SEEDED], "name string, value double")
    return contributions(runs).unionByName(seeds).groupBy("name").agg(F.sum("value").alias("value"))


def unexpected_statuses(runs: DataFrame) -> DataFrame:
    return runs.where(~F.col("status").isin("ok", "error")).groupBy("status").agg(F.count("*").alias("n"))


def exposition(known: DataFrame) -> DataFrame:
    """One row `text`: a TYPE line and a value for each series, by name. Series are as few as stages and counters have names."""
    metric = F.concat(F.lit(PREFIX), "name")
    said = F.concat(F.lit("# TYPE "), metric, F.lit(" counter\n"), metric, F.lit(" "), F.col("value").cast("string"), F.lit("\n"))
    return known.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", said.alias("said")))), lambda x: x["said"]), "").alias("text"))


def stream_totals(runs: DataFrame, name: str, checkpoint: str, seconds: int | None = None) -> StreamingQuery:
    """Totals of a stream of runs in a table of the session, updated with each micro-batch; only as many rows as there are series.

    The seeded series stand in the table from the first batch on, at 0 where no run adds to them. With
    `seconds` the stream goes on and a batch is taken so often, as a scraper would; else what is
    there is taken and the stream ends.
    """
    seeds = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(0.0).alias("value")) for n in SEEDED])
    agg = contributions(runs, seeds).groupBy("name").agg(F.sum("value").alias("value"))
    trigger = {"availableNow": True} if seconds is None else {"processingTime": f"{seconds} seconds"}
    return agg.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(**trigger).start()


class Totals:
    """Totals of a service's own runs, added up as they end: as few numbers as there are series, whatever the number of runs."""

    def __init__(self):
        self.lock = threading.Lock()
        self.known = dict.fromkeys(SEEDED, 0.0)

    def add(self, run: tuple) -> None:
        _, _, status, total_seconds, stages, counters, _ = run
        parts = {"documents_total": 1.0, f"documents_{status}_total": 1.0, "seconds_total": round(total_seconds, 2)}
        parts |= {f"stage_{k}_seconds_total": round(v, 2) for k, v in stages.items()} | {f"{k}_total": float(v) for k, v in counters.items()}
        with self.lock:
            for k, v in parts.items():
                self.known[k] = self.known.get(k, 0.0) + v

    def exposition(self) -> str:
        """The text that exposition() gives of the same totals."""
        with self.lock:
            return "".join(f"# TYPE {PREFIX}{k} counter\n{PREFIX}{k} {v}\n" for k, v in sorted(self.known.items()))


# Series of samples (metric, ts, value)

def deltas(samples: DataFrame) -> DataFrame:
    """samples with delta: the growth since the sample before, the whole value after a reset, 0 for the first."""
    before = F.lag("value").over(Window.partitionBy("metric").orderBy("ts"))
    return samples.withColumn("delta", F.when(before.isNull(), 0.0).when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before))


def increase(samples: DataFrame, seconds: int) -> DataFrame:
    """samples with increase over the seconds up to each (exclusive at the far end), aware of resets, not extrapolated."""
    window = Window.partitionBy("metric").orderBy(F.col("ts").cast("timestamp").cast("bigint")).rangeBetween(-(seconds - 1), 0)
    return deltas(samples).withColumn("increase", F.sum("delta").over(window)).drop("delta")


def rate(samples: DataFrame, seconds: int) -> DataFrame:
    return increase(samples, seconds).withColumn("rate", F.col("increase") / seconds).drop("increase")


def ratios_of_rates(samples: DataFrame, part: str, whole: str, seconds: int, above: float | None = 0.0) -> DataFrame:
    """(target, ts, ratio): rates of the series part + target over those of whole + target, at equal times of each target.

    Only where the whole's rate is over `above`, so no traffic gives no row.
    """
    head = F.when(F.col("metric").startswith(part), F.lit(part)).when(F.col("metric").startswith(whole), F.lit(whole))
    rates = rate(samples.where(head.isNotNull()), seconds).withColumn("head", head)
    both = rates.groupBy(F.expr("substring(metric, length(head) + 1)").alias("target"), "ts").agg(*[F.max(F.when(F.col("head") == h, F.col("rate"))).alias(n) for h, n in ((part, "part"), (whole, "whole"))])
    if above is not None:
        both = both.where(F.col("whole") > above)
    return both.select("target", "ts", F.try_divide("part", "whole").alias("ratio"))


def ratio_of_rates(samples: DataFrame, part: str, whole: str, seconds: int, above: float | None = 0.0) -> DataFrame:
    """(ts, ratio) of two series' rates at equal times."""
    named = samples.where(F.col("metric").isin(part, whole)).withColumn("metric", F.when(F.col("metric") == part, "part:").otherwise("whole:"))
    return ratios_of_rates(named, "part:", "whole:", seconds, above).select("ts", "ratio")


def up(samples: DataFrame) -> DataFrame:
    """(target, up): the latest sample of each target's liveness."""
    return samples.groupBy(F.col("metric").alias("target")).agg(F.max_by("value", "ts").alias("up"))
