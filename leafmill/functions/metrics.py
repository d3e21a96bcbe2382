"""Evaluation metrics as columns and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import tokens


def character_error_rate(predicted: Column, expected: Column) -> Column:
    """Edit distance over the expected length; may exceed 1, null for an empty expectation."""
    return F.levenshtein(predicted, expected) / F.nullif(F.length(expected), F.lit(0))


def bag_of_words_cosine(pairs: DataFrame, keys: list[str], predicted: str, expected: str) -> DataFrame:
    """Cosine of the two texts' word counts for each key: one aggregation, no join of bags."""
    side = lambda c, a, b: pairs.select(*keys, F.explode(tokens(F.col(c))).alias("word"), F.lit(a).alias("a"), F.lit(b).alias("b"))
    counts = side(predicted, 1, 0).unionByName(side(expected, 0, 1)).filter("word <> ''").groupBy(*keys, "word").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    dot, aa, bb = (F.sum(F.col(x) * F.col(y)) for x, y in ("ab", "aa", "bb"))
    return counts.groupBy(*keys).agg(F.coalesce(dot / F.nullif(F.sqrt(aa) * F.sqrt(bb), F.lit(0.0)), F.lit(0.0)).alias("cosine"))


def with_mean_row(long: DataFrame, label: str = "Mean") -> DataFrame:
    """``file, metric, value`` with a row per metric that holds the mean."""
    return long.unionByName(long.groupBy("metric").agg(F.avg("value").alias("value")).select(F.lit(label).alias("file"), "metric", "value"))
