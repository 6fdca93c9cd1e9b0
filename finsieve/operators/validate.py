"""Accounting rules: as columns beside each record, and as a long table by joins with the rule tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fields import ASSETS, BY_KEY, FIELDS, IDENTITIES, IDENTITY_TOLERANCE, KEYS, MESSAGES, ORDERINGS, RATIO_BOUNDS, REQUIRED, REVENUE, REVENUE_LIMIT, Catalog
from ..functions.numbers import WIDE, bounded, coerce, grouped, percent, shown


@dataclass(frozen=True)
class Rule:
    """A rule's id, when it fires (null is no), and what it says then."""

    rule: str
    fires: Column
    says: Column


def _nan(kind: str, *numbers: Column) -> Column:
    """Whether any is NaN, of which comparisons are false (here they would be true)."""
    out = F.lit(False)
    if kind == "double":
        for n in numbers:
            out = out | F.isnan(n)
    return out


def _larger(a: Column, b: Column) -> Column:
    """Whether a is larger than b whatever their signs. Sizes are compared as negative numbers, of which every type has enough."""
    return F.when(a < 0, a).otherwise(-a) < F.when(b < 0, b).otherwise(-b)


def _added(kind: str, *numbers: Column) -> Column:
    """A sum that can't overflow."""
    return sum((n.cast("decimal(20,0)") if kind == "bigint" else n for n in numbers[1:]), numbers[0].cast("decimal(20,0)") if kind == "bigint" else numbers[0])


def rules(values: dict[str, Column], raw: dict[str, Column] | None = None, kind: str = "bigint") -> list[Rule]:
    """All rules in the order of their warnings. values: numbers by key, of one kind; raw: structs (kind, txt) before coercion.

    No value of that kind makes a rule fail: sums are taken in a wider type, and a tenfold beyond
    bigint is more than any bigint.
    """
    out = []
    for k, r in (raw or {}).items():
        given = F.when(r["kind"] == "string", F.concat(F.lit("'"), r["txt"], F.lit("'"))).when(r["kind"] == "bool", F.initcap(r["txt"])).otherwise(r["txt"])
        head, tail = MESSAGES["unreadable"].format(label=BY_KEY[k].label, value="\0").split("\0")
        out.append(Rule(f"unreadable:{k}", r["kind"].isNotNull() & (r["kind"] != "null") & values[k].isNull(), F.concat(F.lit(head), given, F.lit(tail))))
    for f in FIELDS:
        if not f.negative:
            v = values[f.key]
            head = MESSAGES["negative"].format(label=f.label, value="")
            out.append(Rule(f"negative:{f.key}", (v < 0) | _nan(kind, v), F.concat(F.lit(head), shown(v, kind))))
    for i, o in enumerate(ORDERINGS):
        a, b = values[o.smaller], values[o.larger]
        out.append(Rule(f"ordering:{i}", _larger(a, b) & ~_nan(kind, a, b), F.concat(F.lit(f"{o.message} ("), grouped(a), F.lit(" > "), grouped(b), F.lit(")"))))
    for i, n in enumerate(IDENTITIES):
        total, actual = values[n.total], _added(kind, *[values[p] for p in n.parts])
        diff = _added(kind, actual, -total if kind == "double" else -_added(kind, total))
        out.append(Rule(f"identity:{i}", (F.abs(diff.cast("double")) > F.abs(total.cast("double")) * IDENTITY_TOLERANCE) & ~_nan(kind, diff), F.concat(F.lit(f"{n.message} — lệch "), grouped(diff), F.lit(" ("), grouped(actual), F.lit(" vs "), grouped(total), F.lit(")"))))
    for i, r in enumerate(RATIO_BOUNDS):
        ratio = F.try_divide(F.abs(values[r.part].cast("double")), F.abs(values[r.base].cast("double")))
        out.append(Rule(f"ratio:{i}", ~ratio.between(r.least, r.most), F.concat(F.lit(f"{r.message}: "), percent(ratio, 2), F.lit(f" (ngoài khoảng {r.least:.0%}–{r.most:.0%})"))))
    revenue, assets = values[REVENUE], values[ASSETS]
    out.append(Rule("revenue", (assets > 0) & (revenue > (F.try_multiply(assets, F.lit(REVENUE_LIMIT)) if kind == "bigint" else assets * REVENUE_LIMIT)) & ~_nan(kind, revenue, assets), F.lit(MESSAGES["revenue"])))
    missing = F.array_compact(F.array(*[F.when(values[k].isNull(), F.lit(BY_KEY[k].label)) for k in REQUIRED]))
    out.append(Rule("required", F.size(missing) > 0, F.concat(F.lit(MESSAGES["required"]), F.array_join(missing, ", "))))
    return out


def _collected(found: list[Rule], what) -> Column:
    return F.array_compact(F.array(*[F.when(r.fires, what(r)) for r in found]))


def warnings(found: list[Rule]) -> Column:
    return _collected(found, lambda r: r.says)


def rule_ids(found: list[Rule]) -> Column:
    return _collected(found, lambda r: F.lit(r.rule))


def required_present(values: dict[str, Column]) -> Column:
    """Of raw values, before coercion: what can't be read counts as present."""
    out = F.lit(True)
    for k in REQUIRED:
        out = out & values[k].isNotNull()
    return out


def acceptable(raw_present: Column, n_warnings: Column) -> Column:
    return raw_present & (n_warnings == 0)


def present(raw: Column) -> Column:
    """A raw struct's value, null where its kind says so."""
    return F.when(raw["kind"].isNotNull() & (raw["kind"] != "null"), raw["txt"])


def validate(df: DataFrame, raw_prefix: str | None = None, kind: str | None = None) -> DataFrame:
    """df with rule_ids, warnings, n_warnings, acceptable.

    Fields are number columns named by key, bigint unless `kind` names another type, or, with
    raw_prefix, structs (kind, txt) of that prefix from which the number columns are made, WIDE then,
    as floats and long numbers may be among them. One projection: no shuffle, no UDF.
    """
    raw, kind = None, kind or ("bigint" if raw_prefix is None else WIDE)
    if raw_prefix is not None:
        raw = {k: F.col(raw_prefix + k) for k in KEYS}
        df = df.withColumns({k: coerce(raw[k], kind) for k in KEYS})
    values = {k: bounded(F.col(k), kind) if raw is None else F.col(k) for k in KEYS}
    found = rules(values, raw, kind)
    there = required_present({k: present(raw[k]) for k in KEYS} if raw else values)
    df = df.withColumns({"rule_ids": rule_ids(found), "warnings": warnings(found)})
    return df.withColumn("n_warnings", F.size("warnings")).withColumn("acceptable", acceptable(there, F.col("n_warnings")))


def long_form(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, field, value) of all fields, nulls too."""
    return df.select(id_col, *[bounded(F.col(k).cast(WIDE), WIDE).alias(k) for k in KEYS]).unpivot([id_col], list(KEYS), "field", "value")


def violations(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, rule) of each rule that a record of numbers breaks, by one join of its long form with the rules' sides and one aggregate.

    A second way to the same ids as `rules` gives without raw values. A rule's left side is a sum and
    its right side one value. The table of sides has the catalog's size, some thirty rows whatever the
    input, and is broadcast. Ids are those of single records.
    """
    sides = F.broadcast(Catalog(df.sparkSession).sides())
    left, right = (F.when(F.col("side") == s, F.col("value")) for s in ("left", "right"))
    judged = long_form(df, id_col).join(sides, "field").groupBy(id_col, "rule").agg(
        F.sum(left).alias("l"), F.count(left).alias("n_left"), F.max(right).alias("r"), F.count_if(F.col("value").isNull()).alias("n_null"),
        *[F.first(c).alias(c) for c in ("test", "n_parts", "least", "most")],
    )
    l, r = F.col("l"), F.col("r")  # noqa: E741
    tests = {
        "negative": l < 0,
        "ordering": F.abs(l) > F.abs(r),
        "identity": (F.col("n_left") == F.col("n_parts")) & (F.abs((l - r).cast("double")) > F.abs(r.cast("double")) * IDENTITY_TOLERANCE),
        "ratio": ~F.try_divide(F.abs(l.cast("double")), F.abs(r.cast("double"))).between(F.col("least"), F.col("most")),
        "revenue": (r > 0) & (l.cast("double") > r.cast("double") * REVENUE_LIMIT),
        "required": F.col("n_null") > 0,
    }
    broken = F.lit(False)
    for test, fires in tests.items():
        broken = broken | ((F.col("test") == test) & fires)
    return judged.where(broken).select(id_col, "rule")
