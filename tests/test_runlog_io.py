import json

from pyspark.sql import functions as F

from finsieve.sources import io
from finsieve.streaming import runlog


def run(spark, *rows):
    return spark.createDataFrame([(None, f"d{i}", s, t, st, c, {}) for i, (s, t, st, c) in enumerate(rows)], runlog.RUN)


def known(df):
    return {r["name"]: r["value"] for r in df.collect()}


def test_seeded_before_any_run(spark):  # T19
    assert known(runlog.totals(run(spark).limit(0))) == dict.fromkeys(runlog.SEEDED, 0.0)


def test_statuses_and_isolation(spark):
    runs = run(spark, ("ok", 1.0, {"ocr": 0.5}, {"vlm_calls": 2}), ("ok", 2.0, {}, {}), ("error", 3.0, {"ocr": 0.25}, {"vlm_calls": 1}))
    assert known(runlog.totals(runs)) == {"documents_total": 3, "documents_ok_total": 2, "documents_error_total": 1, "seconds_total": 6.0, "stage_ocr_seconds_total": 0.75, "vlm_calls_total": 3}


def test_status_out_of_the_ordinary(spark):
    runs = run(spark, ("running", 1.0, {}, {}))
    assert known(runlog.totals(runs))["documents_running_total"] == 1
    assert [tuple(r) for r in runlog.unexpected_statuses(runs).collect()] == [("running", 1)]


def test_many_runs_in_many_tasks_add_up(spark):
    runs = run(spark, *[("ok", 0.5, {}, {"n": 1})] * 1000).repartition(50)
    assert known(runlog.totals(runs)) == {"documents_total": 1000, "documents_ok_total": 1000, "documents_error_total": 0, "seconds_total": 500.0, "n_total": 1000}


def test_stages_are_rounded_before_they_are_summed(spark):  # T20
    assert known(runlog.totals(run(spark, *[("ok", 0.0, {"a": 0.126}, {})] * 2)))["stage_a_seconds_total"] == 0.26


def test_driver_side_run(spark, tmp_path):  # X1 to X4, X6, T28
    r = runlog.Run("a.pdf")
    try:
        with r.stage("ocr"):
            raise ValueError
    except ValueError:
        r.status = "error"
    with runlog.timer(None, "x"), runlog.timer(r, "ocr"):
        pass
    r.count("vlm_calls")
    r.count("vlm_calls", 2)
    r.set_info(pages_processed=3)
    r.set_info(pages_processed=4)
    df = spark.createDataFrame([r.row()], runlog.RUN)
    path = str(tmp_path / "log")
    assert io.append_runs(df, path) and io.append_runs(df, path)
    back = io.read_runs(spark, path)
    assert back.count() == 2 and io.failed_runs(back).count() == 2
    assert back.first()["counters"] == {"vlm_calls": 3} and back.first()["info"] == {"pages_processed": "4"}


def test_log_that_cannot_be_written(spark, capsys):
    assert not io.append_runs(run(spark, ("ok", 1.0, {}, {})), "/proc/no/such/place")
    assert "WARNING" in capsys.readouterr().out


def test_summary_line(spark):
    df = run(spark, ("ok", 3.5, {"a": 1.0, "b": 2.25}, {"n": 2}), ("ok", 1.0, None, None))
    lines = [r[0] for r in df.select(runlog.summary_line(*[F.col(c) for c in ("status", "total_seconds", "stages", "counters")])).collect()]
    assert lines == ["ok | 3.5s tổng | b 2.25s | a 1.0s | n=2", "ok | 1.0s tổng"]


def test_exposition(spark):
    df = spark.createDataFrame([("b_total", 2.0), ("a_total", 0.5)], "name string, value double")
    assert runlog.exposition(df).first()[0] == "# TYPE doc_ai_a_total counter\ndoc_ai_a_total 0.5\n# TYPE doc_ai_b_total counter\ndoc_ai_b_total 2.0\n"


def test_streamed_totals_equal_batch_totals(spark, tmp_path):
    runs = run(spark, *[("ok", 0.5, {"ocr": 0.25}, {"n": i}) for i in range(40)])
    path = str(tmp_path / "runs")
    runs.repartition(4).write.json(path)
    stream = spark.readStream.schema(runlog.RUN).option("maxFilesPerTrigger", 1).json(path)
    runlog.stream_totals(stream, "totals_now", str(tmp_path / "checkpoint")).awaitTermination()
    streamed = known(spark.table("totals_now"))
    assert streamed == known(runlog.totals(runs)) and streamed["documents_total"] == 40 and streamed["documents_error_total"] == 0


def test_stream_goes_on_by_an_interval(spark, tmp_path):
    import time

    path = str(tmp_path / "runs")
    run(spark, ("ok", 0.5, {}, {})).write.json(path)
    stream = spark.readStream.schema(runlog.RUN).json(path)
    query = runlog.stream_totals(stream, "totals_on", str(tmp_path / "checkpoint"), seconds=1)
    try:
        query.processAllAvailable()
        assert known(spark.table("totals_on"))["documents_ok_total"] == 1
        run(spark, ("error", 0.5, {}, {})).write.mode("append").json(path)
        until = time.time() + 60
        while known(spark.table("totals_on"))["documents_total"] < 2 and time.time() < until:
            time.sleep(0.2)
        assert known(spark.table("totals_on"))["documents_error_total"] == 1
    finally:
        query.stop()


def test_totals_of_a_service_are_those_of_its_log(spark):
    rows = [(None, f"d{i}", ("ok", "error", "odd")[i % 3], i / 7, {"ocr": i / 3, "vlm": 0.005}, {"vlm_calls": i}, {}) for i in range(30)]
    totals = runlog.Totals()
    assert totals.exposition() == runlog.exposition(runlog.totals(spark.createDataFrame([], runlog.RUN))).first()[0]
    for row in rows:
        totals.add((*row[:3], round(row[3], 2), {k: round(v, 2) for k, v in row[4].items()}, *row[5:]))
    batch = known(runlog.totals(spark.createDataFrame([(*r[:3], round(r[3], 2), {k: round(v, 2) for k, v in r[4].items()}, *r[5:]) for r in rows], runlog.RUN)))
    assert set(totals.known) == set(batch) and all(abs(totals.known[k] - v) < 1e-6 for k, v in batch.items())


def test_increase_is_aware_of_resets(spark):
    rows = [("m", i * 15, v) for i, v in enumerate([5.0, 7.0, 9.0, 1.0, 4.0])]
    df = spark.createDataFrame(rows, "metric string, s long, value double").select("metric", F.timestamp_seconds("s").alias("ts"), "value")
    assert [r["increase"] for r in runlog.increase(df, 45).orderBy("ts").collect()] == [0.0, 2.0, 4.0, 5.0, 6.0]
    assert [r["up"] for r in runlog.up(df).collect()] == [4.0]


def test_no_traffic_gives_no_ratio(spark):
    rows = [(m, s, 3.0) for m in "ab" for s in (0, 15)]
    df = spark.createDataFrame(rows, "metric string, s long, value double").select("metric", F.timestamp_seconds("s").alias("ts"), "value")
    assert runlog.ratio_of_rates(df, "a", "b", 60).count() == 0


def test_names(spark):
    names = ["../x/a.PDF", "a.b.png", "a", ".pdf", "C:\\t\\x.jpeg", "x.exe", "", None]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(io.safe_upload(F.col("n"), F.lit("0123456789")).alias("u")).select("u.*")
    assert [r["saved_as"] for r in df.collect()] == ["a_01234567.pdf", "a.b_01234567.png", None, None, "x_01234567.jpeg", None, None, None]


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a_raw.txt").write_bytes("dòng 1\r\ndòng 2\r".encode())
    (tmp_path / "in" / "b.pdf").write_bytes(b"%PDF")
    texts = io.read_texts(spark, str(tmp_path / "in" / "*.txt")).collect()
    assert [r["text"] for r in texts] == ["dòng 1\ndòng 2\n"]
    assert [r["length"] for r in io.read_documents(spark, str(tmp_path / "in")).collect()] == [4]
    assert io.latest_file(spark, str(tmp_path / "in")).count() == 1


def test_results_keep_nulls(spark, tmp_path):
    from .test_numbers_and_rules import record
    from finsieve.operators.validate import validate

    made = validate(record(spark, hang_ton_kho=None))
    io.write_results(made, str(tmp_path / "x"))
    line = json.loads("".join(p.read_text() for p in (tmp_path / "x_routed.json").glob("part-*")))
    assert line["hang_ton_kho"] is None and line["tong_tai_san"] == 47775826926383
    assert list(json.loads(io.result_json(made).first()["json"])) == ["data", "warnings"]
