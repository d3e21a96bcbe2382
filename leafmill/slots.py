"""Where users of the engine put their own parts: what each takes and gives. Any function of the shape will do."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame

from .operators.block_decode import TextGuesser
from .plans.segment import Segmented
from .sources.detector import Detector
from .sources.images import Decoder, Renderer, Transform


class TextSimplifier(Protocol):
    def __call__(self, text: Column) -> Column: ...


class Lexicon(Protocol):
    """Words (``word``) to frequencies (``word, freq``): 1 known, 0 unknown, -1 impossible."""

    def __call__(self, words: DataFrame) -> DataFrame: ...


class Dehyphenator(Protocol):
    """Texts (``doc_id, text``) to texts without line-end hyphens (``doc_id, content``)."""

    def __call__(self, texts: DataFrame) -> DataFrame: ...


class Metric(Protocol):
    """Pairs (``file, predicted, expected``) to ``file, metric, value``."""

    def __call__(self, pairs: DataFrame) -> DataFrame: ...


class LayoutFinder(Protocol):
    """Images (``path``) to the layouts that belong to them (``path, layout_path, xml``)."""

    def __call__(self, images: DataFrame) -> DataFrame: ...


class Segmenter(Protocol):
    def __call__(self, detections: DataFrame, left_to_right: bool) -> Segmented: ...


class TokenRule(Protocol):
    """One rule of rewriting, from tokens to tokens."""

    def __call__(self, tokens: DataFrame) -> DataFrame: ...


class Alternatives(Protocol):
    """Tokens to tokens with more in their column ``alternatives``."""

    def __call__(self, tokens: DataFrame) -> DataFrame: ...


class OutputFormat(Protocol):
    """Layout nodes to ``file`` and one column of text."""

    def __call__(self, nodes: DataFrame) -> DataFrame: ...


__all__ = ["Alternatives", "Decoder", "Dehyphenator", "Detector", "LayoutFinder", "Lexicon", "Metric", "OutputFormat", "Renderer", "Segmenter", "TextGuesser", "TextSimplifier", "TokenRule", "Transform"]
