"""What stands outside of Spark: page rendering, detection, text recognition and the model, each behind a small protocol.

Replay backends answer from recorded tables, so everything else runs and is tested without them.
Live ones are held once per Python worker and called over sorted partitions. Images go to workers in
batches that spark.sql.execution.arrow.maxBytesPerBatch bounds, and come back one at a time.
"""

from __future__ import annotations

import base64
import importlib.util
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fields import BY_KEY, FIELDS, FORM_NAMES, KEYS, REQUIRED
from ..functions.responses import _value, read_object

#: Resolution of rendered pages; input size and least confidence of detection; languages of recognition.
DPI, IMAGE_SIZE, CONFIDENCE, LANGUAGES = 300, 1024, 0.2, ("vi", "en")


class PageRenderer(Protocol):
    def count_pages(self, path: str) -> int: ...
    def render(self, path: str, page_no: int) -> bytes: ...
    def crop(self, image: bytes, box: tuple[int, int, int, int]) -> bytes: ...


class LayoutBackend(Protocol):
    def detect(self, image: bytes) -> tuple[int, int, list[tuple[str, float, float, float, float]]]: ...


class OcrBackend(Protocol):
    def read(self, image: bytes, box: tuple[int, int, int, int]) -> list[str]: ...


class VlmBackend(Protocol):
    def call(self, image_base64: str, prompt: str) -> Reply: ...


@dataclass(frozen=True)
class Reply:
    """One attempt's outcome: ok, retryable (rate limit, connection, timeout, 5xx, no choices) or refused (other 4xx)."""

    outcome: str
    content: str | None = None


# Attempts, and seconds before the second; each later wait doubles.
MAX_ATTEMPTS, BASE_DELAY = 3, 2.0


def next_action(attempt: int, outcome: str) -> tuple[str, float]:
    """(done, wait or give_up; seconds to wait) after an attempt counted from 1."""
    if outcome == "ok":
        return "done", 0.0
    if outcome == "refused" or attempt >= MAX_ATTEMPTS:
        return "give_up", 0.0
    return "wait", BASE_DELAY * 2 ** (attempt - 1)


def call_with_retries(backend: VlmBackend, image_base64: str, prompt: str, sleep: Callable[[float], None]) -> str | None:
    attempt = 0
    while True:
        attempt += 1
        reply = backend.call(image_base64, prompt)
        action, seconds = next_action(attempt, reply.outcome)
        if action != "wait":
            return reply.content if action == "done" else None
        sleep(seconds)


def require_modules(*names: str) -> None:
    """Fail before any job if a live backend's modules are missing, all of them named."""
    if missing := [n for n in names if importlib.util.find_spec(n) is None]:
        raise RuntimeError(f"missing modules: {', '.join(missing)}")


def require_config(env: dict[str, str], names: tuple[str, ...]) -> None:
    """Fail before any job if settings are missing or empty, all of them named."""
    if missing := [n for n in names if not env.get(n)]:
        raise RuntimeError(f"missing settings: {', '.join(missing)}")


def image_base64(image: bytes) -> str:
    return base64.b64encode(image).decode()


_held: dict[object, object] = {}


def held(key: object, make: Callable[[], object]) -> object:
    """One object per key and Python worker, made when first needed."""
    if key not in _held:
        _held[key] = make()
    return _held[key]


def answer_schema() -> dict:
    """JSON Schema of the model's answer: a nullable integer for each field of the catalog."""
    return {"type": "object", "properties": {k: {"type": ["integer", "null"]} for k in KEYS}, "required": list(KEYS), "additionalProperties": False}


def build_prompt() -> str:
    """The model's task: a table of the catalog's fields, how amounts are read, and a schema of the answer."""
    rows = ["key | name on the page | form | line | below zero?"]
    for f in FIELDS:
        rows.append(f'"{f.key}" | {f.label}{" (bắt buộc)" if f.key in REQUIRED else ""} | {f.form} {FORM_NAMES.get(f.form, "")} | {f.code} | {"possible" if f.negative else "no"}')
    reading = (
        "The picture is one page of a Vietnamese financial report. Find the table's lines on it by their "
        "meaning and line number, and copy the amount that each line has in the column headed with the "
        "latest date. Write an amount as printed but without its separators, in whatever unit the page uses; "
        "brackets or a leading minus make it negative. Small numbers beside a name are its line or a note, "
        "not its amount. Whatever isn't printed here or can't be made out is null: most pages have lines "
        "of one form at most, and no answer is better than an invented one."
    )
    table = "\n".join(rows)
    return f"{reading}\n\n{table}\n\nReply with bare JSON that is valid under this schema:\n{json.dumps(answer_schema())}"


@dataclass(frozen=True)
class ChatBackend:
    """A model behind a chat-completions interface over HTTP: a text and an image in, the first choice's text out."""

    base_url: str
    model: str
    api_key: str
    timeout: float = 120.0

    def call(self, image_base64: str, prompt: str) -> Reply:
        import http.client
        import urllib.error
        import urllib.request

        content = [{"type": "text", "text": prompt}, {"type": "image_url", "image_url": {"url": f"data:image/png;base64,{image_base64}"}}]
        body = json.dumps({"model": self.model, "messages": [{"role": "user", "content": content}]}).encode()
        headers = {"Authorization": f"Bearer {self.api_key}", "Content-Type": "application/json"}
        try:
            with urllib.request.urlopen(urllib.request.Request(f"{self.base_url.rstrip('/')}/chat/completions", body, headers), timeout=self.timeout) as answer:
                choices = json.load(answer).get("choices")
        except urllib.error.HTTPError as failure:
            return Reply("retryable" if failure.code == 429 or failure.code >= 500 else "refused")
        except (OSError, http.client.HTTPException, ValueError, AttributeError):  # no connection, a timeout, or an answer that is no JSON object
            return Reply("retryable")
        return Reply("ok", choices[0]["message"]["content"]) if choices else Reply("retryable")


def chat_backend(env: dict[str, str], base_url: str, key_name: str, model_name: str) -> Callable[[], ChatBackend]:
    """What makes the backend in each worker, from settings of the names given; fails at once if one is missing."""
    require_config(env, (key_name, model_name))
    made = ChatBackend(base_url, env[model_name], env[key_name])
    return lambda: made


# Documents to pages

def pages_of(documents: DataFrame, renderer: Callable[[], PageRenderer]) -> DataFrame:
    """(path, page_no) of each document; whatever isn't a PDF is one page."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = held(renderer, renderer)
        for pdf in frames:
            yield pd.DataFrame({"path": pdf["path"], "n_pages": [r.count_pages(p) if p.lower().endswith(".pdf") else 1 for p in pdf["path"]]})

    counted = documents.select("path").mapInPandas(run, "path string, n_pages int")
    return counted.select("path", F.explode(F.sequence(F.lit(1), F.greatest("n_pages", F.lit(1)))).alias("page_no"))


def render_pages(pages: DataFrame, renderer: Callable[[], PageRenderer]) -> DataFrame:
    """pages (path, page_no) with image; one page at a time is rendered and held."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = held(renderer, renderer)
        for pdf in frames:
            for path, page_no in zip(pdf["path"], pdf["page_no"]):
                yield pd.DataFrame({"path": [path], "page_no": [page_no], "image": [r.render(path, page_no)]})

    return pages.select("path", "page_no").mapInPandas(run, "path string, page_no int, image binary")


def crop_regions(regions: DataFrame, renderer: Callable[[], PageRenderer]) -> DataFrame:
    """(doc_id, page_no, region_no, image) of regions with their page's image, each cut out of it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = held(renderer, renderer)
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                box = tuple(row.region[c] for c in ("x1", "y1", "x2", "y2"))
                yield pd.DataFrame({"doc_id": [row.doc_id], "page_no": [row.page_no], "region_no": [row.region_no], "image": [r.crop(row.image, box)]})

    return regions.select("doc_id", "page_no", "region_no", "region", "image").mapInPandas(run, "doc_id long, page_no int, region_no int, image binary")


BOXES = "doc_id long, page_no int, width int, height int, boxes array<struct<idx:int,cls:string,x1:double,y1:double,x2:double,y2:double>>"


def detect_boxes(images: DataFrame, backend: Callable[[], LayoutBackend], with_images: bool = False) -> DataFrame:
    """(doc_id, page_no, width, height, boxes) of images (doc_id, page_no, image), as the layout operators take them; with the image if wanted."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = held(backend, backend)
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                width, height, found = model.detect(r.image)
                boxes = [dict(zip(("idx", "cls", "x1", "y1", "x2", "y2"), (i, *b))) for i, b in enumerate(found)]
                made = {"doc_id": [r.doc_id], "page_no": [r.page_no], "width": [width], "height": [height], "boxes": [boxes]}
                yield pd.DataFrame(made | ({"image": [r.image]} if with_images else {}))

    return images.select("doc_id", "page_no", "image").mapInPandas(run, BOXES + (", image binary" if with_images else ""))


def read_regions(regions: DataFrame, backend: Callable[[], OcrBackend]) -> DataFrame:
    """(doc_id, page_no, region_no, text) of regions with their page's image: the lines that are recognised, joined."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = held(backend, backend)
        for pdf in frames:
            texts = ["\n".join(reader.read(i, (b["x1"], b["y1"], b["x2"], b["y2"]))) for i, b in zip(pdf["image"], pdf["region"])]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "page_no": pdf["page_no"], "region_no": pdf["region_no"], "text": texts})

    return regions.select("doc_id", "page_no", "region_no", "region", "image").mapInPandas(run, "doc_id long, page_no int, region_no int, text string")


@dataclass
class Stopper:
    """The state of one document while its pages stream by: what was found, and when it is enough."""

    patience: int = 3
    found: dict[str, tuple[str, str]] = field(default_factory=dict)
    idle: int = 0
    stopped: bool = False

    def page(self, replies: list[dict | None]) -> None:
        before = len(self.found)
        for values in replies:
            for k in KEYS:
                if values is not None and k not in self.found and (v := _value(values.get(k))) is not None:
                    self.found[k] = v
        self.idle = 0 if len(self.found) > before else self.idle + 1
        enough = all(k in self.found for k in REQUIRED) and self.idle >= self.patience
        self.stopped = len(self.found) == len(BY_KEY) or enough


RESPONSES = "doc_id long, page_no int, region_no int, call_status string, body string"


def call_until_done(regions: DataFrame, backend: Callable[[], VlmBackend], prompt: str, patience: int = 3, sleep: Callable[[float], None] | None = None) -> DataFrame:
    """responses of regions (doc_id, page_no, region_no, image), calling the model only until each document has enough.

    Documents are sorted whole into partitions; state is carried across Arrow batches. Store the
    result before merging it: a task that is tried again would call again.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        model, wait = held(backend, backend), sleep or time.sleep
        doc = page = None
        state, replies = Stopper(patience), []
        for pdf in frames:
            rows = []
            for r in pdf.itertuples(index=False):
                if (r.doc_id, r.page_no) != (doc, page):
                    if page is not None and not state.stopped:
                        state.page(replies)
                    if r.doc_id != doc:
                        state = Stopper(patience)
                    doc, page, replies = r.doc_id, r.page_no, []
                if state.stopped:
                    continue
                body = call_with_retries(model, image_base64(r.image), prompt, wait)
                replies.append(read_object(body.strip()) if body is not None else None)
                rows.append((r.doc_id, r.page_no, r.region_no, "failed" if body is None else "ok", body))
            yield pd.DataFrame(rows, columns=["doc_id", "page_no", "region_no", "call_status", "body"])

    return regions.repartition("doc_id").sortWithinPartitions("doc_id", "page_no", "region_no").mapInPandas(run, RESPONSES)


# Replay

@dataclass(frozen=True)
class ReplayVlm:
    """Answers by image content; a list is one outcome per attempt."""

    answers: dict[str, list[Reply]]
    seen: dict[str, int] = field(default_factory=dict)

    def call(self, image_base64: str, prompt: str) -> Reply:
        n = self.seen[image_base64] = self.seen.get(image_base64, 0) + 1
        replies = self.answers.get(image_base64, [Reply("refused")])
        return replies[min(n, len(replies)) - 1]


def replay_texts(regions: DataFrame, recorded: DataFrame) -> DataFrame:
    """Recorded texts (doc_id, page_no, region_no, text) of regions, empty where nothing was recorded."""
    return regions.join(recorded, ["doc_id", "page_no", "region_no"], "left").withColumn("text", F.coalesce("text", F.lit("")))
