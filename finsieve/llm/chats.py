"""Collapse of logged conversations into the longest, and their rendering.

A conversation that is logged after every turn leaves snapshots, each of which begins the next. A
rolling digest over the turns names every beginning; a snapshot whose digest is that of another's
beginning goes by an anti-join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

# How a turn is rendered.
OPEN, ROLE_END, CLOSE = "<|", "|>\n", "<|end|>\n"


def beginnings(turns: DataFrame) -> DataFrame:
    """(conv_id, n, digest, last): the digest of the first n turns of each conversation.

    turns: conv_id, turn, role, text without repeats. Each conversation streams through one task in
    order, and only its digest so far is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, conv, n, rolled = None, object(), 0, b""
        names = ["conv_id", "n", "digest", "last"]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.bool_()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            out = []
            for c, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "role", "text"))):
                if c != conv:
                    if held:
                        out.append((*held, True))
                    conv, n, rolled = c, 0, b""
                elif held:
                    out.append((*held, False))
                role, text = role.encode(), text.encode()
                n, rolled = n + 1, hashlib.sha256(b"%s%d:%s%s" % (rolled, len(role), role, text)).digest()
                held = (c, n, rolled)
            if out:
                yield batch_of(out)
        if held:
            yield batch_of([(*held, True)])

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, "conv_id long, n long, digest binary, last boolean")


def turns_of(conversations: DataFrame) -> DataFrame:
    kept = conversations.where("conv_id is not null")
    return kept.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]).distinct()


def maximal(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of the conversations that begin no longer one; of equal ones the smallest conv_id, with how many there are."""
    known = stored(beginnings(turns_of(conversations)), "beginnings")
    whole = known.where("last").groupBy("digest").agg(F.min("conv_id").alias("conv_id"), F.first("n").alias("n_turns"), F.count("*").alias("n_copies"))
    return whole.join(known.where("not last").select("digest").distinct(), "digest", "left_anti").select("conv_id", "n_turns", "n_copies")


def collapse(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, rendered) of each maximal conversation.

    Conversations are compared by their turns' roles and texts in the order of turn (equal or null
    turn numbers, nulls first: by role, then text); a repeated row is one turn. Null roles and texts
    count as empty, rows without a conv_id are left out, other columns are ignored. An empty table
    gives no rows. A first turn or a whole conversation that very many share is one row a task
    before digests meet.
    """
    kept = maximal(conversations)
    turn = F.concat(F.lit(OPEN), F.col("role"), F.lit(ROLE_END), F.col("text"), F.lit(CLOSE))
    turns = turns_of(conversations).withColumn("said", turn).join(kept.select("conv_id"), "conv_id", "left_semi")
    rendered = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "said"))), lambda x: x["said"]), "").alias("rendered"))
    return kept.join(rendered, "conv_id")
