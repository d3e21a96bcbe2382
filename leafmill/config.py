"""Settings of the engine, with overrides from the session and the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Config:
    """fixed values: the defaults that users of such an engine expect."""

    language: str = "yi"
    contrast: float = 1.8
    brightness: int = 20
    adjust_contrast: bool = True
    skew_contours: int = 10
    line_thickness: float = 0.01
    crop_to_print_area: bool = True
    crop_margin: float = 0.01
    block_margin_across: float = 0.005
    block_margin_down: float = 0.0
    tiles: int = 2
    tile_margin: float = 0.125
    always_kept: float = 0.5
    least_block: float = 0.20
    least_paragraph: float = 0.20
    least_line: float = 0.05
    least_word: float = 0.05
    least_glyph: float = 0.10
    unknown_factor: float = 0.5
    impossible_factor: float = 0.01
    beam: int = 5
    hyphen: str = "־"
    hyphen_elements: bool = True
    remove_glyphs: bool = False
    detector_url: str = ""
    detector_timeout_s: int = 30
    detector_retries: int = 5
    pdf_dpi: int = 300
    allow_urls: bool = False

    @classmethod
    def of(cls, spark: SparkSession | None = None, **given) -> Config:
        """Given values first, then ``spark.leafmill.<name>``, then ``LEAFMILL_<NAME>``, then the defaults."""
        found = {}
        for f in fields(cls):
            text = (spark.conf.get(f"spark.leafmill.{f.name}", None) if spark else None) or os.environ.get(f"LEAFMILL_{f.name.upper()}")
            if text is not None:
                kind = type(f.default)
                found[f.name] = text.lower() in ("true", "1", "on") if kind is bool else kind(text)
        return replace(cls(), **found | given)
