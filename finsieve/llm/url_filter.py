"""URL filters by a temporal join: dated list entries become intervals, and each capture is held against those at its fetch time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, quoted, stored

# Fixed value: scheme, user info and then the host of a URL in lower case.
HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"


def host_of(url: Column) -> Column:
    """The host in lower case without a final full stop; null where there is none."""
    host = F.regexp_replace(F.regexp_extract(F.lower(url.cast("string")), HOST, 1), r"\.$", "")
    return F.nullif(host, F.lit(""))


def intervals(events: DataFrame) -> DataFrame:
    """(pattern, since, until) in which a pattern is listed, from events (pattern, action, at).

    An entry is in force from its `add` up to the pattern's next event, exclusive; until is null
    where none follows. At one instant `remove` goes before `add`, and repeated events are one.
    Events with a null field are left out.
    """
    known = events.where("pattern is not null and at is not null and action in ('add', 'remove')")
    single = known.groupBy("pattern", "at").agg(F.max("action").alias("action"))
    later = F.lead("at").over(Window.partitionBy("pattern").orderBy("at"))
    return single.withColumn("until", later).where("action = 'add'").select("pattern", F.col("at").alias("since"), "until")


def suffixes(host: Column) -> Column:
    """The host and each domain above it but the last, of one label."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def filter_captures(captures: DataFrame, events: DataFrame, id_col: str = "page_id", url_col: str = "url", at_col: str = "fetched_at") -> DataFrame:
    """(id, host, fetched_at, matched, blocked) of every capture.

    A capture is blocked if an entry for its host or a domain above it was in force when it was
    fetched; matched is the longest such pattern. Captures of one host and time are judged once, so
    a host of very many captures is a row per task and time before the join, and a pattern's
    intervals don't overlap, so a host and pattern meet in one row at most. A last label such as
    `com`, which very many captures share, is looked up apart: among the list's patterns of one label,
    which are broadcast if they are few, so that it isn't a key that rows are dealt by.
    Without a host or time a capture isn't blocked. Repeated rows each give a row; empty tables give
    no rows or no blocks; hosts of any length are taken whole; other columns are ignored.
    """
    made = captures.select(F.col(quoted(id_col)).alias("id"), host_of(F.col(quoted(url_col))).alias("host"), F.col(quoted(at_col)).alias("at"))
    slim = stored(made, "captures")
    asked = slim.where("host is not null and at is not null").select("host", "at").distinct()
    listed = stored(intervals(events), "intervals")
    top = listed.where("not contains(pattern, '.')")
    top = F.broadcast(top) if top.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else top

    def inside(names: DataFrame, entries: DataFrame) -> DataFrame:
        n, e = names.alias("n"), entries.alias("e")
        held = (F.col("n.pattern") == F.col("e.pattern")) & (F.col("n.at") >= F.col("e.since")) & (F.col("e.until").isNull() | (F.col("n.at") < F.col("e.until")))
        return n.join(e, held).select("n.host", "n.at", "n.pattern")

    long = inside(asked.select("host", "at", F.explode(suffixes(F.col("host"))).alias("pattern")), listed)
    last = F.substring_index("host", ".", -1)
    short = inside(asked.where("contains(host, '.')").select("host", "at", last.alias("pattern")), top)
    found = long.unionByName(short).groupBy("host", "at").agg(F.max_by("pattern", F.length("pattern")).alias("matched"))
    judged = slim.join(found, ["host", "at"], "left")
    return judged.select(F.col("id").alias(id_col), "host", F.col("at").alias(at_col), "matched", F.col("matched").isNotNull().alias("blocked"))
