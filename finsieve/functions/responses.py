"""Replies of vision-language models: fences, strict JSON, and values that keep their kind."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fields import KEYS
from .numbers import stripped

#: Values by key with the kind that JSON gave them.
VALUES = "map<string, struct<kind:string, txt:string>>"
PARSED = f"struct<parse_ok:boolean, fields:{VALUES}>"


def unfenced(reply: Column) -> Column:
    """Without a fence of three backticks: its first line goes, and the last one if it begins with such a fence."""
    reply = stripped(reply)
    inside = F.regexp_replace(reply, r"(?s)\A```[^\n]*(?:\n(.*?))??(?:(?:\n|(?<=\n))[^\S\n]*```[^\n]*)?\z", "$1")
    return F.when(reply.startswith("```"), stripped(inside)).otherwise(reply)


class LongInt(str):
    """Digits of a whole number that is longer than Python reads into one."""


def _int(digits: str) -> int | LongInt:
    return int(digits) if len(digits) <= 4000 else LongInt(digits)


def _value(x: object) -> tuple[str, str] | None:
    if x is None:
        return None
    if isinstance(x, bool):
        return "bool", str(x).lower()
    if isinstance(x, int | LongInt):
        return "int", str(x)
    if isinstance(x, float):
        return "float", "NaN" if math.isnan(x) else repr(x).replace("inf", "Infinity")
    if isinstance(x, str):
        return "string", x
    try:
        return "string", str(x)
    except (ValueError, RecursionError):
        return "string", "…"


def read_object(cleaned: str | None) -> dict | None:
    """A JSON object, by strict parsing of all of the text or else of what stands from its first { to its last }.

    Other JSON is no object and counts as unreadable, as does what is nested too deeply to be read.
    """
    if cleaned is None:
        return None
    start, end = cleaned.find("{"), cleaned.rfind("}")
    for part in (cleaned, cleaned[start : end + 1] if 0 <= start < end else None):
        try:
            found = json.loads(part, parse_int=_int) if part is not None else None
        except (ValueError, RecursionError):
            continue
        return found if isinstance(found, dict) else None
    return None


def _parsed(cleaned: pd.Series) -> pd.DataFrame:
    found = [read_object(c) for c in cleaned]
    fields = [None if f is None else {k: {"kind": v[0], "txt": v[1]} for k in KEYS if (v := _value(f.get(k))) is not None} for f in found]
    return pd.DataFrame({"parse_ok": [f is not None for f in found], "fields": fields})


def parse(reply: Column) -> Column:
    """struct(parse_ok, fields) of a reply. Python reads the JSON, as no built-in parser is as strict and keeps kinds; it never raises."""
    return F.pandas_udf(_parsed, PARSED)(unfenced(reply))
