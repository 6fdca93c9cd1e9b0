import pytest
from pyspark.sql import functions as F

from finsieve import fields
from finsieve.fields import KEYS
from finsieve.functions.numbers import NUMBER, WIDE, coerce, parse_number, percent
from finsieve.operators.validate import validate, violations

GOLDEN = dict(zip(KEYS, (29403116984122, 5393002084291, 18372709942261, 47775826926383, 16666572149360, 31109254777023, 13217639635987, 7278764406353, 5938875229634, 2523887147085, 2049247209782)))
SCHEMA = "doc_id long, " + ", ".join(f"{k} bigint" for k in KEYS)
RAW_SCHEMA = "doc_id long, " + ", ".join(f"raw_{k} struct<kind:string,txt:string>" for k in KEYS)


def record(spark, **changes):
    return spark.createDataFrame([(1, *(GOLDEN | changes).values())], SCHEMA)


def raw_record(spark, **changes):
    raw = {k: ("int", str(v)) for k, v in GOLDEN.items()} | changes
    return spark.createDataFrame([(1, *raw.values())], RAW_SCHEMA)


def one(df, column):
    return df.select(column).first()[0]


def parsed(spark, text):
    return one(spark.createDataFrame([(text,)], "x string"), parse_number(F.col("x")).alias("n"))


@pytest.mark.parametrize(("text", "number"), [
    ("13.217.639.635.987", 13217639635987), ("(1.234.567)", -1234567), ("  -1.234.567  ", -1234567), ("abc", None),
    ("(1.234", -1234), ("- 1.234", -1234), ("1.234)", 1234), ("−1.234", 1234), ("\u00a0(7.000)\n", -7000), ("", None), (None, None), ("99999999999999999999", None),
])  # T12, T23
def test_parse_number(spark, text, number):
    assert parsed(spark, text) == number


def test_parse_number_strict(spark):
    with pytest.raises(Exception, match="no number"):
        spark.createDataFrame([("abc",)], "x string").select(parse_number(F.col("x"), strict=True)).collect()


@pytest.mark.parametrize(("kind", "txt", "number"), [("string", "13.217", 13217), ("bool", "true", None), ("null", None, None), ("int", "42", 42), ("string", "abc", None), ("string", "1.5", 15), ("string", "{'v': 12}", 12)])  # T11
def test_coerce(spark, kind, txt, number):
    df = spark.createDataFrame([((kind, txt),)], "r struct<kind:string,txt:string>")
    assert one(df, coerce(F.col("r")).alias("n")) == number


def test_coerce_floats(spark):
    df = spark.createDataFrame([(("float", "1.5"),)], "r struct<kind:string,txt:string>")
    assert one(df, coerce(F.col("r")).alias("n")) is None
    assert one(df, coerce(F.col("r"), "double").alias("n")) == 1.5


def test_golden_record(spark):
    r = validate(record(spark)).first()
    assert r["warnings"] == [] and r["acceptable"]


def test_small_drift_warns(spark):
    r = validate(record(spark, tai_san_ngan_han=GOLDEN["tai_san_ngan_han"] + 10_000_000)).first()
    assert r["rule_ids"] == ["identity:0"] and "10,000,000" in r["warnings"][0]


def test_tolerance_is_strict_and_relative(spark):
    inside = GOLDEN["tong_tai_san"] // 10**7
    assert validate(record(spark, tai_san_ngan_han=GOLDEN["tai_san_ngan_han"] + inside - 1)).first()["acceptable"]


def test_empty_and_missing(spark):
    empty = validate(record(spark, **dict.fromkeys(KEYS))).first()
    assert empty["rule_ids"] == ["required"] and not empty["acceptable"]
    missing = validate(record(spark, tong_tai_san=None)).first()
    assert not missing["acceptable"] and missing["warnings"][-1].endswith("Tổng tài sản")


def test_misread_line(spark):
    r = validate(record(spark, hang_ton_kho=5393002084)).first()
    assert r["rule_ids"] == ["ratio:0"] and not r["acceptable"] and "0.02%" in r["warnings"][0]


def test_unreadable_counts_as_present_but_warns(spark):
    r = validate(raw_record(spark, loi_nhuan_sau_thue=("string", "abc")), "raw_").first()
    assert r["rule_ids"] == ["unreadable:loi_nhuan_sau_thue", "required"] and "'abc'" in r["warnings"][0] and not r["acceptable"]


def test_nan_is_flagged_where_a_negated_test_meets_it(spark):  # T26
    r = validate(raw_record(spark, hang_ton_kho=("float", "NaN"), von_chu_so_huu=("float", "NaN")), "raw_", "double").first()
    assert r["rule_ids"] == ["negative:hang_ton_kho", "ratio:0"]


def test_orderings_compare_sizes_and_revenue_does_not(spark):
    assert "ordering:4" not in validate(record(spark, gia_von_hang_ban=-GOLDEN["gia_von_hang_ban"])).first()["rule_ids"]
    assert "revenue" in validate(record(spark, doanh_thu_thuan=GOLDEN["tong_tai_san"] * 11)).first()["rule_ids"]
    assert "revenue" not in validate(record(spark, doanh_thu_thuan=-GOLDEN["tong_tai_san"] * 11)).first()["rule_ids"]


def test_zero_base_has_no_ratio(spark):
    assert "ratio:0" not in validate(record(spark, tai_san_ngan_han=0)).first()["rule_ids"]


def test_two_implementations_agree(spark):
    import random

    draw = random.Random(5)
    rows = []
    for i in range(300):
        values = {k: draw.choice([v, v, v, None, -v, v * 11, v // 1000, v + draw.randrange(10**7)]) for k, v in GOLDEN.items()}
        rows.append((i, *values.values()))
    df = spark.createDataFrame(rows, SCHEMA)
    wide = {(r[0], x) for r in validate(df).select("doc_id", "rule_ids").collect() for x in r[1]}
    long = [tuple(r) for r in violations(df).select("doc_id", "rule").collect()]
    assert len(long) == len(set(long)) and set(long) == wide


def test_catalog_is_sound():
    fields.check()
    assert len(KEYS) == 11 and fields.REQUIRED == ("tong_tai_san", "doanh_thu_thuan", "loi_nhuan_sau_thue")
    assert fields.label_of("x") == "x"


def test_number_grammar_has_no_borders():  # T3, T4
    import re

    assert re.search(NUMBER, "1234.567").group() == "234.567"
    assert re.search(NUMBER, "10.1234").group() == "10.123"
    assert re.search(NUMBER, "31.12.2026").group() == "12.202"
    assert re.search(NUMBER, "999") is None and re.search(NUMBER, "1,5") is None


BIG = 2 * 10**18


def test_no_number_breaks_a_rule_itself(spark):
    top, least = 2**63 - 1, -(2**63)
    df = spark.createDataFrame([(1, *[BIG] * 11), (2, *[top] * 11), (3, *[-top] * 11), (4, *[least] * 11), (5, *[top, least] * 5, top)], SCHEMA)
    made = {r["doc_id"]: r for r in validate(df).collect()}
    assert {"identity:0", "identity:1", "identity:2"} <= set(made[1]["rule_ids"]) & set(made[2]["rule_ids"]) and "revenue" not in made[2]["rule_ids"]
    assert any("4,000,000,000,000,000,000" in w for w in made[1]["warnings"])
    assert made[4]["rule_ids"] == ["required"]
    wide = {(i, x) for i, r in made.items() for x in r["rule_ids"] if i <= 3}
    assert {tuple(r) for r in violations(df.where("doc_id <= 3")).collect()} == wide and violations(df).count()


@pytest.mark.parametrize(("kind", "txt", "number"), [("float", "47123.5", "47123.500000"), ("int", "12345678901234567890", "12345678901234567890.000000"), ("string", "99.999.999.999.999.999.999", "99999999999999999999.000000"), ("float", "1e+22", "10000000000000000000000.000000"), ("float", "NaN", None), ("float", "Infinity", None), ("int", "9" * 31, None), ("int", "9" * 5000, None), ("string", "1" * 5000, None), ("bool", "true", None)])
def test_wide_numbers(spark, kind, txt, number):
    df = spark.createDataFrame([((kind, txt),)], "r struct<kind:string,txt:string>")
    assert one(df, coerce(F.col("r"), WIDE).cast("string").alias("n")) == number


def test_floats_and_long_numbers_are_judged(spark):
    changes = {"tong_tai_san": ("float", f"{GOLDEN['tong_tai_san']}.5"), "hang_ton_kho": ("float", "-1234.25"), "no_phai_tra": ("int", "9" * 25), "loi_nhuan_gop": ("int", "9" * 40)}
    r = validate(raw_record(spark, **changes), "raw_").first()
    assert r["rule_ids"] == ["unreadable:loi_nhuan_gop", "negative:hang_ton_kho", "ordering:3", "identity:1", "ratio:0"]
    assert r["warnings"][1].endswith(" -1234.25") and "9,999,999,999,999,999,999,999,999 > 47,775,826,926,383.5" in r["warnings"][2]


def test_rules_are_joined_once(spark):
    plan = violations(record(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 1 and "NestedLoop" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_percentages_are_of_exact_values(spark):
    """Halves of the shortest digits aren't halves of the number; long numbers have digits of their own."""
    document_6550 = float(26550019650123456789) / 26550019650.0
    ratios = [document_6550, 0.00125, 0.00375, 0.28 / 3, 0.0, 1.0, 2.0**51 / 100, 2.0**60, 1.1e15, 9.007199254740993e13, 1e19, 7.3e33, None]
    made = spark.createDataFrame([(r,) for r in ratios], "r double").select(percent(F.col("r"), 2)).collect()
    assert [m[0] for m in made] == [r if r is None else f"{r * 100:.2f}%" for r in ratios]
    assert made[0][0] == "100000000000.46%" and made[1][0] == "0.12%"
