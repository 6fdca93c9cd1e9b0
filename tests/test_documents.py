"""From files to results: live backends of a made-up kind, the chat client against a local server, files of results."""

import json
import threading
import time
import urllib.request
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from finsieve import cli
from finsieve.fields import KEYS
from finsieve.operators.router import RouteConfig
from finsieve.service import serve
from finsieve.sources import backends, documents, io

from .test_merge_route_layout import body, pages_text
from .test_numbers_and_rules import GOLDEN

CALLS = []


class Renderer:
    """Documents are texts, pages are parted by form feeds, an image is its page's text."""

    def pages(self, path):
        return open(path.removeprefix("file:"), encoding="utf-8").read().split("\f")

    def count_pages(self, path):
        return len(self.pages(path))

    def render(self, path, page_no):
        return self.pages(path)[page_no - 1].encode()

    def crop(self, image, box):
        return image + f"#{box[1]}-{box[3]}".encode()


class Layout:
    def detect(self, image):
        return 100, 50, [("table", 1.0, 30.0, 20.0, 40.0), ("table", 1.0, 5.0, 20.0, 9.0)] if b"two tables" in image else []


class Reader:
    def read(self, image, box):
        return image.decode().split("\n")


class Model:
    """Answers what a page says behind `says `."""

    def call(self, image_base64, prompt):
        import base64

        text = base64.b64decode(image_base64).decode()
        assert '"tong_tai_san"' in prompt and "#" in text
        return backends.Reply("ok", text.rpartition("#")[0].partition("says ")[2] or "nothing here")


LIVE = documents.Backends(Renderer, Layout, Reader, Model)


def made_backends():
    return LIVE


@pytest.fixture
def files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "good.pdf").write_text("cover\f" + pages_text(GOLDEN) + "\fnever read")
    (folder / "bad one.pdf").write_text("cover\fsays " + body(tong_tai_san=47123.5, hang_ton_kho=-3) + "\ftwo tables says " + body(no_phai_tra=12))
    (folder / "picture.png").write_text("Tổng tài sản 1.000")
    (folder / "notes.txt").write_text("no document")
    return io.read_documents(spark, str(folder)).select("path"), tmp_path


def test_whole_documents_are_routed(files):
    df, tmp = files
    rows = {r["path"].rsplit("/", 1)[1].replace("%20", " "): r for r in documents.route_documents(df, LIVE, str(tmp / "w1"), RouteConfig(ocr_first=True)).collect()}
    assert set(rows) == {"good.pdf", "bad one.pdf", "picture.png"}
    good, bad, picture = rows["good.pdf"], rows["bad one.pdf"], rows["picture.png"]
    assert good["final_acceptable"] and not good["vlm_needed"] and good["vlm_calls"] == 0 and good["pages_processed"] == 2
    assert bad["vlm_needed"] and bad["vlm_calls"] == 4 and bad["parse_failures"] == 1 and float(bad["tong_tai_san"]) == 47123.5 and bad["no_phai_tra"] == 12
    assert picture["vlm_calls"] == 1 and picture["tong_tai_san"] == 1000
    only = {r["vlm_needed"]: r["vlm_calls"] for r in documents.route_documents(df, LIVE, str(tmp / "w2")).groupBy("vlm_needed").agg(F.sum("vlm_calls").alias("vlm_calls")).collect()}
    assert only == {True: 8}


def test_texts_and_model_alone(files):
    df, tmp = files
    texts = documents.ocr_documents(df, LIVE, str(tmp / "w3"))
    assert texts.where("path like '%good%'").count() == 3
    two = texts.where("text like '%two tables%'").first()["text"]
    assert two.count("two tables") == 2
    raw = documents.vlm_documents(df, LIVE, str(tmp / "w4")).where("path like '%bad%'").first()
    assert tuple(raw["tong_tai_san"]) == ("float", "47123.5") and raw["vlm_calls"] == 4


def test_command_writes_a_file_a_document(files):
    _, tmp = files
    cli.main(["route-files", str(tmp / "in"), str(tmp / "out"), "--ocr-first", "--backends", "tests.test_documents:made_backends"])
    made = {p.name: json.loads(p.read_text(encoding="utf-8")) for p in (tmp / "out").glob("*")}
    assert {n.replace("%20", " ") for n in made} == {"good_routed.json", "bad one_routed.json", "picture_routed.json"}
    assert made["good_routed.json"] == {"data": GOLDEN, "warnings": []}
    text = (tmp / "out" / "good_routed.json").read_text(encoding="utf-8")
    assert text.startswith('{\n  "data": {\n    "tai_san_ngan_han": 29403116984122,')
    assert (tmp / "out_runs").exists()
    with pytest.raises(SystemExit, match="--backends"):
        cli.main(["route-files", str(tmp / "in"), str(tmp / "out")])


def test_saving_one_result(tmp_path):
    path = io.save_result(f"file://{tmp_path}/x", "báo cáo", {"tong_tai_san": 1}, None, "vlm")
    assert path.endswith("báo cáo_vlm.json") and json.loads(open(path, encoding="utf-8").read()) == dict.fromkeys(KEYS) | {"tong_tai_san": 1}


def test_service_takes_files(spark, tmp_path):
    server = serve(spark, 0, RouteConfig(ocr_first=True), log_path=str(tmp_path / "log"), live=LIVE, upload_dir=str(tmp_path / "uploads"))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    root = f"http://127.0.0.1:{server.server_port}"
    try:
        asked = urllib.request.Request(f"{root}/extract?name=../a.pdf", pages_text(GOLDEN).encode(), {"Content-Type": "application/octet-stream"})
        assert json.loads(urllib.request.urlopen(asked).read()) == {"data": GOLDEN, "warnings": []}
        assert list((tmp_path / "uploads").iterdir()) == [] and not (tmp_path / "a.pdf").exists()
        assert "doc_ai_documents_ok_total 1.0\n" in urllib.request.urlopen(f"{root}/metrics").read().decode()
        assert io.read_runs(spark, str(tmp_path / "log")).where("status = 'ok'").count() == 1
    finally:
        server.shutdown()


class Chat(BaseHTTPRequestHandler):
    """Answers by the model's name; what was asked is kept."""

    def do_POST(self):
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        CALLS.append((self.path, self.headers["Authorization"], asked))
        name = asked["model"]
        if name == "slow":
            time.sleep(1.5)
        code = int(name) if name.isdigit() else 200
        answer = {"empty": {"error": "quota"}, "none": {"choices": [{"message": {"content": None}}]}}.get(name, {"choices": [{"message": {"content": "{}"}}]})
        data = b"<html>" if name == "html" else json.dumps(answer).encode()
        self.send_response(code)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, format, *args):
        pass


def test_chat_client():
    server = HTTPServer(("127.0.0.1", 0), Chat)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}/v1/"
    try:
        got = {m: backends.ChatBackend(base, m, "key", 0.5 if m == "slow" else 5).call("aW1n", "read") for m in ("good", "429", "500", "503", "400", "401", "empty", "none", "html", "slow")}
        assert {m: r.outcome for m, r in got.items()} == {"good": "ok", "429": "retryable", "500": "retryable", "503": "retryable", "400": "refused", "401": "refused", "empty": "retryable", "none": "ok", "html": "retryable", "slow": "retryable"}
        assert got["good"].content == "{}" and got["none"].content is None
        path, key, asked = CALLS[0]
        assert path == "/v1/chat/completions" and key == "Bearer key"
        assert asked["messages"][0]["content"] == [{"type": "text", "text": "read"}, {"type": "image_url", "image_url": {"url": "data:image/png;base64,aW1n"}}]
    finally:
        server.shutdown()
    assert backends.ChatBackend(base, "x", "key", 1).call("", "").outcome == "retryable"
    make = backends.chat_backend({"K": "key", "M": "model"}, base, "K", "M")
    assert make().model == "model" and backends.answer_schema()["required"] == list(KEYS)


def test_images_go_to_workers_in_bounded_batches(spark):
    assert 0 < int(str(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")).rstrip("bB")) <= 256 << 20
