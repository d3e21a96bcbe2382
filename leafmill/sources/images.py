"""Images as rows: decoded scans, pages of documents, urls, transforms and skew. Pixels go through exchangeable slots in Arrow batches."""

from __future__ import annotations

import email.parser
import urllib.request
from collections.abc import Iterable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pixels
from ..operators import lines as L
from . import files

#: A gray image in rows: its bytes, row by row.
IMAGE = "path string, width int, height int, gray binary, error string"
#: fixed values: resolution of rendered pages, width that skew is measured at
DPI, SKEW_WIDTH = 300, 1000


class Decoder(Protocol):
    """Turns an image file into gray values, rows x columns."""

    def __call__(self, content: bytes) -> np.ndarray: ...


class Renderer(Protocol):
    """Turns one page of a document into gray values."""

    def __call__(self, content: bytes, page: int, dpi: int) -> np.ndarray: ...


class Transform(Protocol):
    """One step of preparation: a gray image to another, with what it found out (such as skew or scale) by name."""

    def __call__(self, gray: np.ndarray) -> tuple[np.ndarray, dict[str, float]]: ...


def plain_decoder(content: bytes) -> np.ndarray:
    """Portable gray maps (P5), the one format that needs no library."""
    head, width, height, most, rest = content.split(maxsplit=3)[0], *map(int, content.split(maxsplit=4)[1:4]), b""
    if head != b"P5" or most > 255:
        raise ValueError("no portable gray map of 8 bits")
    rest = content[len(content) - width * height :]
    return np.frombuffer(rest, dtype=np.uint8).reshape(height, width)


def encoded(gray: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (gray.shape[1], gray.shape[0]) + np.ascontiguousarray(gray, dtype=np.uint8).tobytes()


def _rows(items: Iterable[tuple[str, object]]) -> pd.DataFrame:
    rows = []
    for path, make in items:
        try:
            gray = make()
            rows.append((path, gray.shape[1], gray.shape[0], np.ascontiguousarray(gray, dtype=np.uint8).tobytes(), None))
        except Exception as e:  # whatever a slot raises belongs to its image
            rows.append((path, None, None, None, f"{type(e).__name__}: {e}"))
    return pd.DataFrame(rows, columns=["path", "width", "height", "gray", "error"]).astype({"width": "Int32", "height": "Int32"})


def decode(images: DataFrame, decoder: Decoder = plain_decoder) -> DataFrame:
    """``path, width, height, gray, error`` of ``path, content``; an unreadable image is a row with its error."""

    def run(batches):
        for batch in batches:
            yield _rows((p, lambda c=c: decoder(bytes(c))) for p, c in zip(batch["path"], batch["content"]))

    return images.select("path", "content").mapInPandas(run, IMAGE)


def scan_images(spark: SparkSession, folder: str, decoder: Decoder = plain_decoder, pattern: str = files.IMAGES, recursive: bool = True, limit: int | None = None) -> DataFrame:
    """Decoded images of a folder."""
    return decode(files.list_files(spark, folder, pattern, recursive, limit), decoder)


def render_pages(documents: DataFrame, count, renderer: Renderer, start: int = 1, end: int | None = None, dpi: int = DPI) -> DataFrame:
    """Pages of documents (``path, content``) as images, one row per page: ``path`` is that of the document and the page's number."""
    numbers = files.pdf_pages(documents, count, start, end)

    def run(batches):
        for batch in batches:
            yield _rows((f"{p}#{n}", lambda c=c, n=n: renderer(bytes(c), int(n), dpi)) for p, n, c in zip(batch["path"], batch["page_nr"], batch["content"]))

    pages = numbers.join(documents.select("path", "content"), "path")
    return pages.select("path", "page_nr", "content").mapInPandas(run, IMAGE)


def fetch(urls: DataFrame, allowed: bool = False, timeout_s: int = 30, open_url=urllib.request.urlopen) -> DataFrame:
    """``path, content, error`` of a column ``url``; off unless ``allowed``."""
    if not allowed:
        raise PermissionError("fetching urls is switched off")

    def run(batches):
        for batch in batches:
            rows = []
            for url in batch["url"]:
                try:
                    with open_url(url, timeout=timeout_s) as answer:
                        rows.append((url, answer.read(), None))
                except Exception as e:  # a url that does not answer belongs to its row
                    rows.append((url, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "content", "error"])

    return urls.select("url").mapInPandas(run, "path string, content binary, error string")


def parts_of_form(body: bytes, content_type: str) -> dict[str, bytes]:
    """Files and fields of a multipart form by name."""
    message = email.parser.BytesParser().parsebytes(b"Content-Type: " + content_type.encode() + b"\r\n\r\n" + body)
    return {p.get_param("name", header="content-disposition"): p.get_payload(decode=True) for p in message.get_payload() if not isinstance(p, str)}


def transformed(images: DataFrame, steps: list[Transform]) -> DataFrame:
    """Images after all steps, one after the other; ``found`` maps what steps found out, later ones over earlier ones."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, w, h, gray, error in batch[["path", "width", "height", "gray", "error"]].itertuples(index=False):
                found: dict[str, float] = {}
                if gray is not None:
                    x = np.frombuffer(gray, dtype=np.uint8).reshape(int(h), int(w))
                    for step in steps:
                        x, more = step(x)
                        found |= {k: float(v) for k, v in more.items()}
                    h, w, gray = x.shape[0], x.shape[1], np.ascontiguousarray(x, dtype=np.uint8).tobytes()
                rows.append((path, w, h, gray, error, found))
            yield pd.DataFrame(rows, columns=["path", "width", "height", "gray", "error", "found"]).astype({"width": "Int32", "height": "Int32"})

    return images.mapInPandas(run, IMAGE + ", found map<string,double>")


def contrast_step(contrast: float = pixels.CONTRAST, brightness: int = pixels.BRIGHTNESS) -> Transform:
    return lambda gray: (pixels.contrasted(gray, contrast, brightness), {})


def unrotate_step(degrees: float) -> Transform:
    return lambda gray: (pixels.rotated(gray, -degrees), {"skew": degrees})


def fit_step(most_width: int, most_height: int) -> Transform:
    def step(gray):
        scale = min(1.0, most_width / gray.shape[1], most_height / gray.shape[0])
        return pixels.resized(gray, max(1, int(gray.shape[1] * scale)), max(1, int(gray.shape[0] * scale))), {"scale": scale}

    return step


def contours_of(images: DataFrame) -> DataFrame:
    """``path, contour, l, t, w, h, angle, area``: dark blots of each image once text has run together into lines."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, w, h, gray in batch[["path", "width", "height", "gray"]].itertuples(index=False):
                if gray is None:
                    continue
                x = np.frombuffer(gray, dtype=np.uint8).reshape(int(h), int(w))
                x = pixels.resized(x, SKEW_WIDTH, max(1, int(h) * SKEW_WIDTH // int(w))) if int(w) > SKEW_WIDTH else x
                x = pixels.blurred(x, 9)
                dark = x <= pixels.threshold(x)
                for _ in range(3):
                    dark = pixels.dilated(dark, 10, 3)
                rows += [(path, i, *c) for i, c in enumerate(pixels.contours(dark))]
            yield pd.DataFrame(rows, columns=["path", "contour", "l", "t", "w", "h", "angle", "area"])

    return images.mapInPandas(run, "path string, contour int, l int, t int, w int, h int, angle double, area long")


def skew(images: DataFrame, most: int = 10) -> DataFrame:
    """``path, skew``: the slant of each image's text, by its largest contours that lie in no larger one."""
    from pyspark.sql import Window

    from ..operators import spatial

    c = contours_of(images).withColumn("angle", L.folded_angle(F.col("angle")))
    rank = Window.partitionBy("path").orderBy(F.desc("area"), "contour")
    c = spatial.contained_in_larger(c.withColumn("rank", F.row_number().over(rank)), ["path"])
    return L.skew_of(c, ["path"], ["contour"], most)


def cropped(images: DataFrame, l: Column, t: Column, w: Column, h: Column) -> DataFrame:  # noqa: E741
    """Images cut to boxes that columns give."""

    def run(batches):
        for batch in batches:
            yield _rows((p, lambda g=g, W=W, H=H, b=b: pixels.cropped(np.frombuffer(g, dtype=np.uint8).reshape(int(H), int(W)), *map(int, b))) for p, W, H, g, *b in batch[["path", "width", "height", "gray", "_l", "_t", "_w", "_h"]].itertuples(index=False))

    return images.select("path", "width", "height", "gray", l.alias("_l"), t.alias("_t"), w.alias("_w"), h.alias("_h")).mapInPandas(run, IMAGE)
