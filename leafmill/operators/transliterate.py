"""Transliteration of texts with a dictionary of words that are not read as they are spelled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .lookup import lookup_join


def _looked_up(texts: DataFrame, keys: list[str], parts: Column, listed: DataFrame) -> DataFrame:
    """``keys, text``: parts joined again, each replaced by its entry in ``listed`` (``_part, _instead``)."""
    x = texts.select(*keys, F.posexplode(parts).alias("_i", "_part"))
    words = x.filter(F.length("_part") > 1).select("_part").distinct()
    known = lookup_join(words, listed, ["_part"], "inner")
    met = lookup_join(x, known, ["_part"], "left")
    rows = F.array_sort(F.collect_list(F.struct("_i", F.coalesce("_instead", "_part").alias("s"))))
    return met.groupBy(*keys).agg(F.concat_ws("", F.transform(rows, lambda r: r["s"])).alias("text"))


def transliterate(texts: DataFrame, keys: list[str], dictionary: DataFrame, rare: tuple[str, ...] = ()) -> DataFrame:
    """``keys, text`` romanised. ``dictionary``: ``word, readings`` (array, the first is read, unless it is ``rare`` and there is another)."""
    first, second = F.get("readings", F.lit(0)), F.get("readings", F.lit(1))
    read = F.when(first.isin(*rare) & second.isNotNull(), second).otherwise(first) if rare else first
    listed = dictionary.select(T.precombined(T.standard_punctuation(F.col("word"))).alias("_part"), F.replace(T.precombined(read), F.lit(T.MAQAF), F.lit("-")).alias("_instead"))
    listed = listed.filter(~F.col("_part").isin(*T.HOMOGRAPHS)).dropDuplicates(["_part"])
    parts = F.regexp_extract_all(T.precombined(F.col("text")), F.lit(f"(?s){T.HEBREW_WORD}|."), 0)
    return _looked_up(texts, keys, parts, listed).select(*keys, T.romanized(F.col("text")).alias("text"))


def detransliterate(texts: DataFrame, keys: list[str], dictionary: DataFrame, homophones: tuple[str, ...] = ()) -> DataFrame:
    """``keys, text`` in precombined letters, words of the dictionary in their spelling, unless they are ``homophones``."""
    listed = dictionary.select(F.explode("readings").alias("_r"), T.precombined(T.standard_punctuation(F.col("word"))).alias("_instead"))
    listed = listed.select(F.replace(T.precombined(F.col("_r")), F.lit(T.MAQAF), F.lit("-")).alias("_part"), F.replace("_instead", F.lit(T.MAQAF), F.lit("-")).alias("_instead"))
    if homophones:
        listed = listed.filter(~F.col("_part").isin(*homophones))
    listed = listed.groupBy("_part").agg(F.min("_instead").alias("_instead"))
    parts = F.regexp_extract_all(T.detransliterated(F.col("text")), F.lit(r"(?Us)[\w־-]+|."), 0)
    return _looked_up(texts, keys, parts, listed)
