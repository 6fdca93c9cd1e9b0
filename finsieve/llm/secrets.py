"""Secret scans with corpus-wide ownership frequency.

Every text is scanned once; what is found goes to a slim table. Hashes of the candidates are then
counted by distinct repositories and owners over the whole corpus: a value that many owners hold is
a copied example, one that few hold looks like a live credential of theirs. Base kinds are always
reported; the wide kinds, whose patterns alone would be too eager, are reported where they are live.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, apart, located, locator, over_texts, quoted, short, stored, stored_from_python

# The base kinds, in their order, with the least length of what counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST = {"assign": 6, "access": 20, "hex": 24}
# The wide kinds, after the base kinds.
WIDE = {
    "bearer": re.compile(r"\b[Bb]earer\x20+([A-Za-z0-9._~+/-]{16,}=*)"),
    "signed": re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})"),
    "userinfo": re.compile(r"://[^\s/:@]{1,64}:([^\s/:@]{6,128})@"),
    "random": re.compile(r"(?<![A-Za-z0-9+/_-])([A-Za-z0-9+/_-]{20,})(?![A-Za-z0-9+/_-])"),
}
KINDS = [*LEAST, *WIDE]
#: Bits a character that the kind "random" needs, besides upper case, lower case and digits.
LEAST_BITS = 3.5
#: Values held by more owners, or in more repositories, are copied examples.
LIVE_OWNERS = 2
FOUND = "text_sha256 string, base_sha256 string, found array<struct<start:long,kind_no:int,end:long,hash:string>>"


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind's number, end, value) of the base kinds, by start, then kind; ends are exclusive."""
    spans = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]] if ":" in text or "=" in text else []
    spans += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]] if "AKIA" in text else []
    spans += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(spans)


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same places as spans that neither overlap nor touch, by start."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def wide_spans(text: str, taken: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """The same of the wide kinds, where no base span and no span of an earlier wide kind overlaps.

    Matches of a kind come by start and don't overlap, so each kind is one sweep along the taken places.
    """
    out: list[tuple[int, int, int, str]] = []
    places = union([(s, e) for s, _, e, _ in taken])
    for kind, pattern in WIDE.items():
        at, found = 0, []
        for m in pattern.finditer(text):
            start, end, value = *m.span(1), m[1]
            while at < len(places) and places[at][1] <= start:
                at += 1
            if (at == len(places) or places[at][0] >= end) and (kind != "random" or looks_random(value)):
                found.append((start, KINDS.index(kind), end, value))
        places = union(places + [(s, e) for s, _, e, _ in found])
        out += found
    return sorted(out)


def looks_random(value: str) -> bool:
    if not (re.search("[a-z]", value) and re.search("[A-Z]", value) and re.search("[0-9]", value)):
        return False
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values()) >= LEAST_BITS


def digest(spans: list[tuple]) -> str:
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, *_ in spans).encode()).hexdigest()


def scanned(texts: list[str | None]) -> Iterator[tuple]:
    for text in texts:
        base = base_spans(text or "")
        spans = base + wide_spans(text or "", base)  # sorted later, with what the corpus knows of them
        yield hashlib.sha256((text or "").encode()).hexdigest(), digest(base), [(s, k, e, hashlib.sha256(f"{KINDS[k] if k else 'value'}\0{v}".encode()).hexdigest()) for s, k, e, v in spans]


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository_col: str = "source", live_owners: int = LIVE_OWNERS) -> DataFrame:
    """One row per document: id, text_sha256, n_assign, n_access, n_hex, base_sha256, spans, live (array of start and end of live spans), n_live, n_copied.

    An owner is what stands before the first slash of a repository. Only slim rows are shuffled:
    hashes are counted by owner before they are counted at all, so that a value which a third of all
    rows hold is one row a task; the join back on the hash is one that AQE splits where it is skewed.
    A null text counts as empty; a text of any length is scanned whole, in time that grows with its
    length. A null repository is one owner of its own. Repeated rows each give a row. Spans that start together stand in the order of KINDS. An empty table gives no rows;
    other columns are ignored.
    """
    slim = docs.select(F.col(quoted(id_col)).alias("__id"), F.col(quoted(repository_col)).cast("string").alias("__repository"), F.col(quoted(text_col)).alias("__text"))
    found = stored_from_python(over_texts(slim, ["__id", "__repository"], "__text", FOUND, scanned).withColumn("__row", F.monotonically_increasing_id()), "secrets-found")
    repository = F.coalesce(F.concat(F.lit("="), F.col("__repository")), F.lit(""))
    held = found.select("__row", "__id", "text_sha256", "base_sha256", F.explode("found").alias("span"), repository.alias("repository"))
    owners = (
        held.groupBy(F.col("span.hash").alias("hash"), "repository")
        .agg(F.lit(1).alias("one"))
        .groupBy("hash")
        .agg(F.count("repository").alias("n_repositories"), F.count_distinct(F.substring_index("repository", "/", 1)).alias("n_owners"))
    )
    live = (F.col("n_owners") <= live_owners) & (F.col("n_repositories") <= live_owners)
    judged = (
        held.join(owners, F.col("span.hash") == F.col("hash"))
        .withColumn("live", live)
        .groupBy("__row")
        .agg(*[F.first(c).alias(c) for c in ("__id", "text_sha256", "base_sha256")], F.array_sort(F.collect_list(F.struct("span.start", "span.kind_no", "span.end", "live"))).alias("all"))
    )
    return judged.select("__id", "text_sha256", "base_sha256", "all").unionByName(
        found.where(F.size("found") == 0).select("__id", "text_sha256", "base_sha256", F.expr("cast(array() as array<struct<start:long,kind_no:int,end:long,live:boolean>>)").alias("all"))
    ).select(
        F.col("__id").alias(id_col),
        "text_sha256",
        *[counted(i).alias(f"n_{kind}") for i, kind in enumerate(LEAST)],
        "base_sha256",
        spelled().alias("spans"),
        F.transform(F.filter("all", lambda x: x["live"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("live"),
        F.size(F.filter("all", lambda x: x["live"])).cast("long").alias("n_live"),
        F.size(F.filter("all", lambda x: ~x["live"])).cast("long").alias("n_copied"),
    )


def counted(kind_no: int) -> Column:
    return F.size(F.filter("all", lambda x: x["kind_no"] == kind_no)).cast("long")


def spelled() -> Column:
    """Base spans, and wide spans that are live."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    kept = F.filter("all", lambda x: (x["kind_no"] < len(LEAST)) | x["live"])
    return F.array_join(F.transform(kept, lambda x: F.concat_ws(":", F.get(kinds, x["kind_no"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def masked(text: str | None, live: list[tuple[int, int]] | None, mask: str = "[SECRET]") -> str | None:
    """The text with each live span replaced; overlapping spans are one."""
    if text is None or not live:
        return text
    out, at = [], 0
    for start, end in sorted(live):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mask]
        at = end
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository_col: str = "source", live_owners: int = LIVE_OWNERS) -> DataFrame:
    """The documents, all columns kept, with live-looking credentials masked in their texts and copied examples left.

    A row's spans are found by its locator, so repeated ids do no harm, and are broadcast if they are
    few enough: documents without any are neither shuffled nor sent to Python. Texts are scanned and
    masked whole, whatever their length; other columns stay as they are; a null text stays null; an
    empty table gives no rows.
    """
    source = located(docs)
    at, text, lives = (apart(docs, c) for c in ("at", text_col, "live"))
    spans = find_secrets(source.select(locator().alias("at"), F.col(quoted(text_col)).alias("text"), F.col(quoted(repository_col)).alias("repository")), "at", "text", "repository", live_owners)
    live = stored(spans.where("n_live > 0").select(short(F.col("at")).alias("__at"), F.col("live").alias(lives)), "secrets-live")
    n_rows, n_spans = live.select(F.count("*"), F.coalesce(F.sum(F.size(lives)), F.lit(0))).first()
    live = F.broadcast(live) if n_rows <= BROADCAST_ROWS and n_spans <= 4 * BROADCAST_ROWS else live

    @F.pandas_udf("string")
    def replaced(texts, lives):
        import pandas as pd

        return pd.Series([None if live is None else masked(t, [(x["start"], x["end"]) for x in live]) for t, live in zip(texts, lives, strict=True)], dtype=object)

    joined = source.withColumn(at, short(locator())).join(live, F.col(at) == F.col("__at"), "left")
    given = F.col(quoted(text_col))
    done = joined.withColumn(text, F.when(F.col(lives).isNull(), given).otherwise(replaced(F.when(F.col(lives).isNotNull(), given), lives)))
    return done.select(*[F.col(quoted(text if c == text_col else s)).alias(c) for s, c in zip(source.columns, docs.columns, strict=True)])
