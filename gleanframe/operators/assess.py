"""Rows enriched by an outside model, under the schema of the answer template."""

from __future__ import annotations

import base64
import functools
import json
import re
import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .templates import AnswerError, ConfigError, in_order, problems, read_answer, schema, unestimated

# How outside calls are paced and repeated.
REQUESTS_PER_MINUTE, CALLS, CONTENT_ATTEMPTS, LONGEST_WAIT = 10, 4, 2, 90.0
RETRY_CODES = frozenset((429, 500, 502, 503, 504))
RETRY_STATUS = frozenset(("RESOURCE_EXHAUSTED", "UNAVAILABLE", "DEADLINE_EXCEEDED"))
MAX_DOCUMENT_BYTES = 20 << 20


class Assessor(Protocol):
    """Turns a listing into the text of an answer; raises CallError where the call failed."""

    def __call__(self, listing: dict[str, Any], template: dict[str, Any], attempt: int) -> str: ...


class CallError(RuntimeError):
    def __init__(self, message: str, code: int | None = None, status: str = "", retry_after: float | None = None):
        super().__init__(message)
        self.code, self.status, self.retry_after = code, status, retry_after

    @property
    def may_pass(self) -> bool:
        return self.code in RETRY_CODES or self.status in RETRY_STATUS


STATED_DELAY = re.compile(r"retry(?:[-_ ]?delay|[-_ ]?after| in)\W{0,6}(\d+(?:\.\d+)?)\s*(ms|s\b|$|\W)", re.I)


def stated_delay(message: str) -> float | None:
    """The seconds after which a service says that it may be called again."""
    m = STATED_DELAY.search(message)
    return float(m[1]) / (1000 if m[2].lower() == "ms" else 1) if m else None


def read_pdf(spark: SparkSession, path: str, most: int = MAX_DOCUMENT_BYTES) -> bytes:
    """A document to go with each call, by Spark's reader of whole files: a PDF of at most ``most`` bytes."""
    rows = spark.read.format("binaryFile").load(path).select("length", "content").where(F.col("length") <= most).take(2)
    if len(rows) != 1:
        raise ConfigError(f"{path}: not one document of at most {most} bytes")
    content = bytes(rows[0].content)
    if not content.startswith(b"%PDF"):
        raise ConfigError(f"{path}: not a PDF")
    return content


@dataclass
class HttpAssessor:
    """Asks a model over HTTP: one call with the instructions, the listing, the answer's schema and a document.

    ``post`` takes a URL, headers and a body, and gives (status, text); it raises OSError where the
    call fails. ``reply`` finds the answer's text in what came back. The document travels to each
    task with this object, and is encoded once in a worker.
    """

    url: str
    field: str
    key: str = ""
    document: bytes | None = None
    home: str | None = None
    post: Callable[[str, dict[str, str], bytes], tuple[int, str]] | None = None
    reply: Callable[[Any], str | None] = lambda data: data.get("text") if isinstance(data, dict) else None

    def __post_init__(self) -> None:
        if not self.url:
            raise ConfigError("no address of a model")

    def prompt(self, listing: dict[str, Any], template: dict[str, Any]) -> str:
        parts = [f"Assess how well the listing below suits a person who looks for: {self.field}."]
        parts += ["The person's CV is attached."] if self.document else []
        parts += [f"The person lives in {self.home}; estimate the way to work from there."] if self.home else []
        parts += ["Answer with one JSON object, with exactly the fields of this template, in its order:", json.dumps(template, ensure_ascii=False, indent=1), "The listing:", json.dumps(listing, ensure_ascii=False, indent=1)]
        return "\n".join(parts)

    def __call__(self, listing: dict[str, Any], template: dict[str, Any], attempt: int) -> str:
        payload: dict[str, Any] = {"prompt": self.prompt(listing, template), "schema": schema(template).jsonValue(), "attempt": attempt}
        if self.document:
            payload["document"] = {"type": "application/pdf", "data": encoded(self.document)}
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        try:
            status, text = (self.post or over_http)(self.url, headers, json.dumps(payload, ensure_ascii=False).encode())
        except OSError as error:
            raise CallError(str(error), status="UNAVAILABLE") from error
        if status in (401, 403):
            raise ConfigError(f"the model refuses the key: status {status}")
        if status >= 400:
            named = re.search(r"\b([A-Z]+_[A-Z_]+|UNAVAILABLE)\b", text)
            raise CallError(f"status {status}: {text[:300]}", status, named[1] if named else "", stated_delay(text))
        try:
            return self.reply(json.loads(text)) or ""
        except ValueError:
            return text


@functools.lru_cache(maxsize=1)
def encoded(document: bytes) -> str:
    return base64.b64encode(document).decode()


def over_http(url: str, headers: dict[str, str], body: bytes) -> tuple[int, str]:
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    try:
        with urlopen(Request(url, body, headers), timeout=LONGEST_WAIT) as answer:
            return answer.status, answer.read().decode("utf-8", "replace")
    except HTTPError as error:
        return error.code, error.read().decode("utf-8", "replace")


def wait_before(error: CallError, attempt: int) -> float:
    """The delay the service states and a second, else one that doubles."""
    return min(LONGEST_WAIT, error.retry_after + 1 if error.retry_after is not None else 5.0 * 2**attempt)


class Pace:
    """No more than so many calls a minute in this process; zero or less: no limit."""

    def __init__(self, per_minute: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.clock, self.sleep, self.lock, self.next = 60 / per_minute if per_minute > 0 else 0.0, clock, sleep, threading.Lock(), 0.0

    def __call__(self) -> None:
        with self.lock:
            now = self.clock()
            if self.gap and now < self.next:
                self.sleep(self.next - now)
            self.next = max(now, self.next) + self.gap


def call(assessor: Assessor, listing: dict, template: dict, attempt: int, pace: Pace, sleep: Callable[[float], None]) -> str:
    for i in range(CALLS):
        pace()
        try:
            return assessor(listing, template, attempt)
        except CallError as error:
            if not error.may_pass or i == CALLS - 1:
                raise AnswerError(str(error)) from error
            sleep(wait_before(error, i))
    raise AssertionError


def assess_one(assessor: Assessor, listing: dict, template: dict, attempts: int = CONTENT_ATTEMPTS, pace: Pace | None = None, sleep: Callable[[float], None] = time.sleep) -> dict:
    """One valid answer, in the template's order. A missing estimate is asked for again, and let pass at last."""
    pace = pace or Pace(0)
    for attempt in range(attempts):
        last = attempt == attempts - 1
        try:
            answer = read_answer(call(assessor, listing, template, attempt, pace, sleep))
            wrong = problems(answer, template)
            if not wrong and not last:
                wrong = [f"{p}: an estimate is required" for p in unestimated(answer, template)]
            if wrong:
                raise AnswerError("; ".join(wrong))
            return in_order(answer, template)
        except ConfigError:
            raise
        except AnswerError:
            if last:
                raise
    raise AnswerError("no attempts")


def assess(rows: DataFrame, template: dict[str, Any], assessor: Assessor, per_minute: float = REQUESTS_PER_MINUTE, attempts: int = CONTENT_ATTEMPTS, lanes: int = 1) -> DataFrame:
    """``rows`` with ``answer`` (JSON of a valid answer) or ``error``. A setting error fails the job.

    Calls have side effects and a price: write the result before using it twice. ``lanes`` tasks
    run at once, each at its share of the pace.
    """
    out = T.StructType([*rows.schema.fields, T.StructField("answer", T.StringType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pace = Pace(per_minute / lanes)
        for batch in batches:
            answers: list[str | None] = []
            errors: list[str | None] = []
            for row in batch.to_pylist():
                try:
                    answers.append(json.dumps(assess_one(assessor, {k: v for k, v in row.items() if v is not None}, template, attempts, pace), ensure_ascii=False))
                    errors.append(None)
                except ConfigError:
                    raise
                except AnswerError as error:
                    answers.append(None)
                    errors.append(str(error))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(answers, pa.string()), pa.array(errors, pa.string())], [*batch.schema.names, "answer", "error"])

    return rows.repartition(lanes).mapInArrow(run, out)


def parsed(rows: DataFrame, fields: T.StructType) -> DataFrame:
    """``assessment`` (struct; loosely typed leaves are kept as text) and ``present`` (the fields it has) for each answer."""
    loose = T.StructType([T.StructField(f.name, f.dataType if isinstance(f.dataType, (T.ArrayType, T.StructType)) else T.StringType()) for f in fields.fields])
    return rows.withColumn("assessment", F.from_json("answer", loose)).withColumn("present", F.json_object_keys("answer"))


def offline(listing: dict[str, Any], template: dict[str, Any], attempt: int) -> str:
    """A deterministic answer without any service: values drawn from a checksum of the listing."""
    import zlib

    from .templates import leaf

    seed = zlib.crc32(json.dumps(listing, sort_keys=True, default=str).encode())

    def make(value: Any, name: str) -> Any:
        if isinstance(value, dict):
            return {k: make(v, k) for k, v in value.items()}
        if isinstance(value, list):
            return [make(value[0] if value else "", name)]
        kind, note = leaf(value, name)
        draw = zlib.crc32(f"{seed}:{name}".encode())
        if isinstance(kind, T.BooleanType):
            return draw % 2 == 0
        if isinstance(kind, T.StringType):
            return note["enum"][draw % len(note["enum"])] if "enum" in note else str(listing.get(name) or f"{name} {draw % 1000}")
        return 1 + draw % 100

    return json.dumps(make(template, ""), ensure_ascii=False)
