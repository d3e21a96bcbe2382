"""Evaluation of read texts against expected ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import text as T


def evaluate(predicted: DataFrame, expected: DataFrame, simplify=T.simplified, both: bool = False, ignore_paragraphs: bool = False) -> DataFrame:
    """``file, metric, value``: character error rate and cosine of bags of words, for each expected file.

    ``predicted``: ``file, text`` and perhaps ``seconds``; ``expected``:
    ``file, text``. A file that was not read counts as empty. Expected texts
    are simplified, predicted ones only if asked for; blank lines can be left
    out of both. ``seconds`` becomes the metric AnalysisTime. Texts without a
    character have no error rate.
    """
    of = lambda c, s: T.single_paragraph_breaks(s(c)) if ignore_paragraphs else s(c)
    e = expected.select("file", of(F.col("text"), simplify).alias("expected"))
    p = predicted.select("file", of(F.coalesce("text", F.lit("")), simplify if both else (lambda c: c)).alias("predicted"), *(["seconds"] if "seconds" in predicted.columns else []))
    met = e.join(p, "file", "left").withColumn("predicted", F.coalesce("predicted", F.lit("")))
    rows = met.select("file", F.lit("CER").alias("metric"), M.character_error_rate(F.col("predicted"), F.col("expected")).alias("value"))
    rows = rows.unionByName(M.bag_of_words_cosine(met, ["file"], "predicted", "expected").select("file", F.lit("BagOfWords").alias("metric"), F.col("cosine").alias("value")))
    if "seconds" in predicted.columns:
        rows = rows.unionByName(met.select("file", F.lit("AnalysisTime").alias("metric"), F.col("seconds").cast("double").alias("value")))
    return rows


def report(results: DataFrame, digits: int = 3) -> DataFrame:
    """Results and a row of means for each metric, as text."""
    return M.with_mean_row(results).withColumn("value", F.format_string(f"%.{digits}f", "value"))


def read_and_evaluate(images: DataFrame, layouts: DataFrame, read, simplify=T.simplified, ignore_paragraphs: bool = False) -> DataFrame:
    """Images met with their gold layouts (``file, text``) by name, read by ``read`` (DataFrame to ``file, text, seconds``), and evaluated."""
    gold = images.select("file").join(layouts.select("file", "text"), "file")
    return evaluate(read(images.join(gold.select("file"), "file", "left_semi")), gold, simplify, False, ignore_paragraphs)


def mean_error(expected: Column, found: Column) -> list[Column]:
    """Mean and deviation of absolute errors, such as those of skews."""
    error = F.abs(expected - found)
    return [F.avg(error).alias("mean_error"), F.stddev_pop(error).alias("deviation"), F.count("*").alias("n")]
