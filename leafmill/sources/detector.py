"""Box detectors: a slot that turns images into rows, over the network or from a table."""

from __future__ import annotations

import json
import time
import urllib.request
import uuid
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import corner_box

RESULT = "array<struct<box:array<int>,class:string,conf:double>>"
DETECTIONS = "page_id string, response string, error string"
# fixed values: how often and how long a detector is asked
TIMEOUT_S, RETRIES, FIRST_WAIT_S = 30, 5, 1.0


class Detector(Protocol):
    def __call__(self, image: bytes, level: str) -> str:
        """JSON list of boxes (centre x, y, width, height), classes and confidences."""


class HttpDetector:
    """Posts an image; transport errors are tried again with growing waits, other answers are errors."""

    def __init__(self, url: str):
        self.url = url

    def __call__(self, image: bytes, level: str) -> str:
        mark = uuid.uuid4().hex
        body = f'--{mark}\r\nContent-Disposition: form-data; name="image"; filename="page.png"\r\nContent-Type: image/png\r\n\r\n'.encode() + image + f"\r\n--{mark}--\r\n".encode()
        for attempt in range(RETRIES + 1):
            try:
                request = urllib.request.Request(f"{self.url}/{level}", body, {"Content-Type": f"multipart/form-data; boundary={mark}"})
                with urllib.request.urlopen(request, timeout=TIMEOUT_S) as answer:
                    return answer.read().decode()
            except urllib.error.HTTPError:
                raise
            except OSError:
                if attempt == RETRIES:
                    raise
                time.sleep(FIRST_WAIT_S * 2**attempt)
        raise AssertionError


def detect(images: DataFrame, detector: Detector, level: str) -> DataFrame:
    """``page_id, response, error``: one bad page is a row with an error, not a failed job."""

    def ask(batches):
        for batch in batches:
            rows = []
            for page, image in zip(batch["page_id"], batch["image"]):
                try:
                    rows.append((page, detector(bytes(image), level), None))
                except Exception as e:  # whatever a detector raises belongs to its page
                    rows.append((page, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["page_id", "response", "error"])

    return images.select("page_id", "image").mapInPandas(ask, DETECTIONS)


def boxes_of(responses: DataFrame, labels: dict[str, str], scale: float = 1.0, least_conf: float = 0.0) -> DataFrame:
    """``page_id, det_id, label, l, t, w, h, conf`` from responses; unknown classes go."""
    x = responses.select("page_id", F.posexplode(F.from_json("response", RESULT)).alias("det_id", "r"))
    label = F.create_map(*[F.lit(v) for kv in labels.items() for v in kv])[F.col("r.class")]
    b = corner_box(*[F.get("r.box", F.lit(i)) for i in range(4)])
    scaled = [(c / scale).cast("int").alias(n) for n, c in zip("ltwh", (b.l, b.t, b.w, b.h))]
    return x.select("page_id", "det_id", label.alias("label"), *scaled, F.col("r.conf").alias("conf")).filter((F.col("conf") >= least_conf) & F.col("label").isNotNull())


def table_detector(rows: list[dict]) -> Detector:
    """A detector that always answers with given rows; for tests."""
    answer = json.dumps(rows)
    return lambda image, level: answer
