import random

import pytest
from pyspark.sql import functions as F

from finsieve.fields import BY_KEY, KEYS, REQUIRED
from finsieve.functions.responses import parse, read_object, unfenced
from finsieve.operators import layout, merge, router
from finsieve.sources import backends

from .test_numbers_and_rules import GOLDEN

PAGES = "doc_id long, page_no int, " + ", ".join(f"{k} bigint" for k in KEYS)
RESPONSES = backends.RESPONSES


def test_first_value_ignores_nulls_and_row_order(spark):
    rows = [(1, p, *[p * 10 if p >= i else None for i in range(11)]) for p in (3, 1, 2)]
    for n in (1, 5):
        r = merge.first_non_null(spark.createDataFrame(rows, PAGES).repartition(n), ["doc_id"], ["page_no"]).first()
        assert [r[k] for k in KEYS] == [10, 10, 20, 30] + [None] * 7


def walk(pages, patience=3):
    found, idle = {}, 0
    for p, values in pages:
        new = {k: v for k, v in values.items() if v is not None and k not in found}
        found |= new
        idle = 0 if new else idle + 1
        if len(found) == len(KEYS) or (all(k in found for k in REQUIRED) and idle >= patience):
            return p, True, found
    return pages[-1][0], False, found


def test_windows_stop_where_a_walk_stops(spark):
    draw = random.Random(3)
    rows, wanted = [], {}
    for d in range(300):
        density = draw.choice([0.05, 0.2, 0.6])
        pages = [(p, {k: p * 100 + i if draw.random() < density else None for i, k in enumerate(KEYS)}) for p in range(1, draw.randint(2, 14))]
        rows += [(d, p, *values.values()) for p, values in pages]
        wanted[d] = walk(pages)
    draw.shuffle(rows)
    got = merge.at_stop(merge.vlm_prefixes(spark.createDataFrame(rows, PAGES))).collect()
    assert {r["doc_id"]: (r["stop_page"], r["stopped"], {k: r[k] for k in KEYS if r[k] is not None}) for r in got} == wanted


@pytest.mark.parametrize(("reply", "value"), [
    ('{"a": 1}', '{"a": 1}'), ('```json\n{"a": 1}\n```', '{"a": 1}'), ('```\n{"a": 1}', '{"a": 1}'), ('```{"a": 1}```', ""), ("  x \n", "x"), ('```json\n{"a": 1}\n  ```  ', '{"a": 1}'),
    ("```", ""), ("```\n```", ""), ("```a\nb\nc\n```d", "b\nc"), (None, None),
])  # T24
def test_fences(spark, reply, value):
    assert spark.createDataFrame([(reply,)], "r string").select(unfenced(F.col("r"))).first()[0] == value


def test_json_strictness():  # T9, T10
    assert read_object('{"a":1} {"b":2}') is None
    assert read_object('x {"a": {"b": 2}} y') == {"a": {"b": 2}}
    assert read_object("[1]") is None and read_object("12") is None and read_object("}{") is None and read_object(None) is None


def test_parse_keeps_kinds(spark):  # T11, T26
    body = '{"tong_tai_san": 1.5, "no_phai_tra": "1.5", "von_chu_so_huu": true, "hang_ton_kho": NaN, "x": 1, "loi_nhuan_gop": {"v": 12}, "gia_von_hang_ban": null, "doanh_thu_thuan": 100000000000000000000}'
    r = spark.createDataFrame([(body,), (None,), ("",)], "r string").select(parse(F.col("r")).alias("p")).collect()
    fields = {k: tuple(v) for k, v in r[0]["p"]["fields"].items()}
    assert fields == {"tong_tai_san": ("float", "1.5"), "no_phai_tra": ("string", "1.5"), "von_chu_so_huu": ("bool", "true"), "hang_ton_kho": ("float", "NaN"), "loi_nhuan_gop": ("string", "{'v': 12}"), "doanh_thu_thuan": ("int", "100000000000000000000")}
    assert not r[1]["p"]["parse_ok"] and not r[2]["p"]["parse_ok"]


def pages_text(values):
    return "\n".join(f"{BY_KEY[k].label}\n{v:,}".replace(",", ".") for k, v in values.items())


def body(**values):
    import json

    return json.dumps(dict.fromkeys(KEYS) | values)


def routed(spark, text, replies, ocr_first):
    pages = spark.createDataFrame([(1, p, t) for p, t in enumerate(text, 1)], "doc_id long, page_no int, text string")
    calls = spark.createDataFrame([(1, p, 1, s, b) for p, (s, b) in enumerate(replies, 1)], RESPONSES)
    return router.route(pages, calls, router.RouteConfig(ocr_first)).first()


def test_accepted_text_never_needs_the_model(spark):  # T22
    r = routed(spark, ["x", pages_text(GOLDEN), "x"], [("ok", body(tong_tai_san=1))] * 3, True)
    assert not r["vlm_needed"] and r["vlm_calls"] == 0 and r["pages_processed"] == 2 and r["final_acceptable"] and r["tong_tai_san"] == GOLDEN["tong_tai_san"]


def test_model_overwrites_what_the_gate_rejects(spark):  # T1
    wrong = GOLDEN | {"hang_ton_kho": 5393002084}
    r = routed(spark, [pages_text(wrong)], [("ok", body(hang_ton_kho=GOLDEN["hang_ton_kho"], no_phai_tra=7))], True)
    assert r["vlm_needed"] and r["hang_ton_kho"] == GOLDEN["hang_ton_kho"] and r["no_phai_tra"] == 7 and r["tong_tai_san"] == GOLDEN["tong_tai_san"]


def test_nothing_is_gated_after_the_model(spark):  # T16
    r = routed(spark, ["x"], [("ok", body(tong_tai_san=-5))], False)
    assert not r["final_acceptable"] and r["tong_tai_san"] == -5 and r["vlm_needed"]


def test_first_raw_value_blocks_a_better_one(spark):  # T14, T15
    r = routed(spark, ["x", "x"], [("ok", body(tong_tai_san="abc")), ("ok", body(tong_tai_san=5))], False)
    assert r["tong_tai_san"] is None and r["rule_ids"][0] == "unreadable:tong_tai_san"
    assert not any("abc" in w for w in r["api_warnings"]) and any("abc" in w for w in r["warnings"])


def test_failures_are_counted_by_kind(spark):  # T25
    r = routed(spark, ["x"] * 4, [("failed", None), ("ok", None), ("ok", ""), ("ok", body())], False)
    assert (r["vlm_calls"], r["vlm_failures"], r["parse_failures"]) == (4, 2, 1)


def test_config_from_environment():  # S15
    assert router.RouteConfig.from_env({"USE_OCR_FIRST": " Yes "}).ocr_first and not router.RouteConfig.from_env({}).ocr_first


BOX = "doc_id long, page_no int, width int, height int, boxes array<struct<idx:int,cls:string,x1:double,y1:double,x2:double,y2:double>>"


def test_regions_are_stable_padded_and_clamped(spark):
    boxes = [(0, "table", 10.9, 50.2, 90.0, 60.0), (1, "text", 0.0, 0.0, 9.0, 9.0), (2, "table", 3.0, 50.9, 99.5, 120.0), (3, "table", 40.0, 2.0, 50.0, 9.0)]
    r = layout.page_regions(spark.createDataFrame([(1, 1, 100, 110, boxes)], BOX)).first()["regions"]
    assert [tuple(x) for x in r] == [(32, 0, 58, 17), (2, 42, 98, 68), (0, 42, 100, 110)]


def test_page_without_tables_is_one_region(spark):  # T17
    rows = [(1, 1, 100, 50, []), (1, 2, 100, 50, None), (1, 3, 100, 50, [(0, "text", 0.0, 0.0, 9.0, 9.0)])]
    found = layout.exploded_regions(spark.createDataFrame(rows, BOX)).collect()
    assert [(r["region_no"], tuple(r["region"])) for r in found] == [(1, (0, 0, 100, 50))] * 3


def test_live_calls_stop_across_batches(spark):
    draw = random.Random(8)
    regions, answers, wanted = [], {}, {}
    for d in range(12):
        pages = []
        for p in range(1, 13):
            values = {k: 1 if draw.random() < 0.25 else None for k in KEYS}
            image = f"{d}/{p}".encode()
            answers[backends.image_base64(image)] = [backends.Reply("ok", body(**{k: v for k, v in values.items() if v}))]
            regions.append((d, p, 1, bytearray(image)))
            pages.append((p, values))
        wanted[d] = walk(pages)[0]
    draw.shuffle(regions)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        df = spark.createDataFrame(regions, "doc_id long, page_no int, region_no int, image binary")
        made = backends.call_until_done(df, lambda: backends.ReplayVlm(answers), "p", sleep=lambda s: None)
        assert {r[0]: r[1] for r in made.groupBy("doc_id").agg(F.max("page_no")).collect()} == wanted
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_retries():  # T18
    waits = []
    model = backends.ReplayVlm({"x": [backends.Reply("retryable")] * 3})
    assert backends.call_with_retries(model, "x", "p", waits.append) is None and waits == [2.0, 4.0]
    model = backends.ReplayVlm({"x": [backends.Reply("retryable"), backends.Reply("ok", "y")]})
    assert backends.call_with_retries(model, "x", "p", lambda s: None) == "y"
    model = backends.ReplayVlm({"x": [backends.Reply("refused")]})
    assert backends.call_with_retries(model, "x", "p", waits.append) is None and model.seen["x"] == 1


def test_prompt_names_all_fields():
    prompt = backends.build_prompt()
    assert all(f'"{k}"' in prompt and BY_KEY[k].label in prompt for k in KEYS) and prompt.count("(bắt buộc)") == 3


def test_backend_checks():
    with pytest.raises(RuntimeError, match="SOME_KEY, SOME_MODEL"):
        backends.require_config({"OTHER": "x"}, ("SOME_KEY", "SOME_MODEL"))
    with pytest.raises(RuntimeError, match="SOME_MODEL"):
        backends.chat_backend({"SOME_KEY": "x"}, "http://127.0.0.1", "SOME_KEY", "SOME_MODEL")
    with pytest.raises(RuntimeError, match="no_such_module"):
        backends.require_modules("json", "no_such_module")


def test_pages_of_documents(spark):
    class Renderer:
        def count_pages(self, path):
            return 3

    made = backends.pages_of(spark.createDataFrame([("a.pdf",), ("b.png",)], "path string"), Renderer)
    assert sorted(map(tuple, made.collect())) == [("a.pdf", 1), ("a.pdf", 2), ("a.pdf", 3), ("b.png", 1)]


def test_live_chain_of_pages_boxes_and_texts(spark):
    class Live:
        def count_pages(self, path):
            return 2

        def render(self, path, page_no):
            return f"{path}#{page_no}".encode()

        def detect(self, image):
            return 100, 50, [("table", 10.5, 30.0, 20.0, 40.0), ("table", 10.5, 5.0, 20.0, 9.0)] if image.endswith(b"1") else []

        def read(self, image, box):
            return [image.decode(), str(box[1])]

    docs = spark.createDataFrame([("a.pdf",)], "path string")
    images = backends.render_pages(backends.pages_of(docs, Live), Live).withColumn("doc_id", F.lit(1))
    regions = layout.exploded_regions(backends.detect_boxes(images, Live)).join(images.drop("path"), ["doc_id", "page_no"])
    got = {r["page_no"]: r["text"] for r in layout.page_text(backends.read_regions(regions, Live)).collect()}
    assert got == {1: "a.pdf#1\n0\na.pdf#1\n22", 2: "a.pdf#2\n0"}


def test_no_reply_breaks_the_parser(spark):
    long, deep = '{"tong_tai_san": ' + "7" * 5000 + "}", '{"tong_tai_san": ' + "[" * 100_000 + "]" * 100_000 + "}"
    assert read_object(deep) is None and read_object(f"x {deep} y") is None
    r = spark.createDataFrame([(long,), (deep,), ("x " + long,)], "r string").select(parse(F.col("r")).alias("p")).collect()
    assert [x["p"]["parse_ok"] for x in r] == [True, False, True] and tuple(r[0]["p"]["fields"]["tong_tai_san"]) == ("int", "7" * 5000)
    made = routed(spark, ["x"] * 3, [("ok", long), ("ok", deep), ("ok", body(no_phai_tra=5))], False)
    assert made["tong_tai_san"] is None and made["rule_ids"][0] == "unreadable:tong_tai_san" and made["no_phai_tra"] == 5 and made["parse_failures"] == 1


def test_floats_and_long_numbers_are_routed(spark):  # T11
    values = GOLDEN | {"doanh_thu_thuan": 47123.5, "no_phai_tra": 12345678901234567890, "von_chu_so_huu": True}
    r = routed(spark, ["x"], [("ok", body(**values))], False)
    assert str(r["doanh_thu_thuan"]) == "47123.500000" and int(r["no_phai_tra"]) == 12345678901234567890 and r["von_chu_so_huu"] is None
    assert r["rule_ids"][0] == "unreadable:von_chu_so_huu" and "required" not in r["rule_ids"]
    plain = routed(spark, ["x"], [("ok", body(**GOLDEN))], False)
    assert plain["final_acceptable"] and {k: int(plain[k]) for k in KEYS} == GOLDEN


def test_documents_without_replies_are_routed(spark):
    pages = spark.createDataFrame([(1, 1, "x"), (2, 1, pages_text(GOLDEN)), (2, 2, "y")], "doc_id long, page_no int, text string")
    for first, wanted in ((True, {1: (True, 1, 0, None), 2: (False, 1, 0, GOLDEN["tong_tai_san"])}), (False, {1: (True, None, 0, None), 2: (True, None, 0, None)})):
        made = router.route(pages, spark.createDataFrame([], RESPONSES), router.RouteConfig(first)).collect()
        assert {r["doc_id"]: (r["vlm_needed"], r["pages_processed"], r["vlm_calls"], r["tong_tai_san"]) for r in made} == wanted


def test_replies_are_parsed_and_dealt_once(spark, sf_dir):
    from finsieve.plans import catalogue

    for name, exchanges in (("route_vlm_only", 3), ("vlm_call_counts", 1)):
        plan = catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        plan = plan.split("== Initial Plan ==")[0]
        assert plan.count("ArrowEvalPython") == 1 and plan.count("Exchange hashpartitioning") <= exchanges, plan
    plan = catalogue.route_ocr_first(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "InMemoryTableScan" not in plan
