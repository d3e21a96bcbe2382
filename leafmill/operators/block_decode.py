"""Decoding of whole blocks: beams of words, hyphens between lines, other alphabets, text slots."""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import decode as D

#: What a beam is: guesses from best to worst.
BEAM = "array<struct<text:string,score:double>>"


def beams(words: DataFrame, k: int = D.BEAM) -> DataFrame:
    """Adds ``beam`` to words with ``predictions``: glyphs in order, each an array of struct(outcome, conf). k = 1 is decoding without a beam."""
    return words.withColumn("beam", D.k_best(F.col("predictions"), k))


def _factor(words: DataFrame, column: str, lexicon: DataFrame, impossible: str, unknown: float, out: str) -> DataFrame:
    known = D.with_known(words, lexicon, column, "_known")
    return known.withColumn(out, D.frequency(F.col("_known"), F.col(column).rlike(impossible))).drop("_known")


def _best_alone(words: DataFrame, lexicon: DataFrame, impossible: str, unknown: float, keys: list[str]) -> DataFrame:
    """``keys, content, score``: each word's best guess by score times the lexicon's factor; ties to the better place in the beam."""
    x = words.select(*keys, F.posexplode("beam").alias("_i", "g")).select(*keys, "_i", F.col("g.text").alias("content"), F.col("g.score").alias("score"))
    x = _factor(x, "content", lexicon, impossible, unknown, "_f").withColumn("score", F.col("score") * D.lexicon_factor(F.col("_f"), unknown))
    best = x.groupBy(*keys).agg(F.min_by(F.struct("content", "score"), F.struct(-F.col("score"), "_i")).alias("b"))
    return best.select(*keys, "b.content", "b.score")


def decode_blocks(words: DataFrame, lexicon: DataFrame, block: list[str], hyphen: str = T.MAQAF, impossible: str = "$^", unknown: float = D.UNKNOWN_FACTOR) -> DataFrame:
    """Words of blocks with their contents, hyphenated ones over two lines decided together.

    ``words``: ``block, line_idx, tok_idx, beam``. Where a guess of a line's
    last word ends in the hyphen, all guesses of it meet all of the next
    line's first word (at most the square of the beam's width). A pair with a
    hyphen scores the root of both scores times the lexicon's factor of the
    joined word, with the hyphen only if that is strictly more frequent; a pair
    without one scores the root of both rescored guesses. The pair decides both
    words; all others take their best rescored guess. In a line of one word
    that the line before has decided, that decision stands.

    Returns ``block, line_idx, tok_idx, content, score, subs_type,
    subs_content``: the parts of a hyphenated word are HypPart1 and HypPart2,
    with the whole word, freed of outer punctuation.
    """
    keys = [*block, "line_idx", "tok_idx"]
    along = Window.partitionBy(*block).orderBy("line_idx")
    ends = words.groupBy(*block, "line_idx").agg(
        F.max_by(F.struct("tok_idx", "beam"), "tok_idx").alias("last"), F.min_by(F.struct("tok_idx", "beam"), "tok_idx").alias("first"), F.count("*").alias("n")
    )
    ends = ends.withColumn("next", F.lead(F.struct("line_idx", F.col("first.tok_idx").alias("tok_idx"), F.col("first.beam").alias("beam"))).over(along))
    broken = F.coalesce(F.exists("last.beam", lambda g: g["text"].endswith(hyphen)), F.lit(False)) & F.col("next").isNotNull()
    ends = ends.withColumn("_may", broken)
    # in a chain of lines of one word every other pair is decided
    chained = (F.col("n") == 1) & F.coalesce(F.lag("_may").over(along), F.lit(False))
    ends = ends.withColumn("_chain", F.sum(F.when(chained, 0).otherwise(1)).over(along))
    turn = F.row_number().over(Window.partitionBy(*block, "_chain").orderBy("line_idx")) - 1
    pairs = ends.withColumn("_turn", turn).filter(F.col("_may") & (F.col("_turn") % 2 == 0))

    met = pairs.select(*block, "line_idx", F.col("last.tok_idx").alias("tok1"), F.col("next.line_idx").alias("line2"), F.col("next.tok_idx").alias("tok2"), F.col("next.beam").alias("beam2"), F.posexplode("last.beam").alias("_i", "g1"))
    met = met.select(*[c for c in met.columns if c != "beam2"], F.posexplode("beam2").alias("_j", "g2"))
    met = met.select(*block, "line_idx", "tok1", "line2", "tok2", "_i", "_j", F.col("g1.text").alias("w1"), F.col("g1.score").alias("s1"), F.col("g2.text").alias("w2"), F.col("g2.score").alias("s2"))
    part = F.expr(f"substring(w1, 1, length(w1) - {len(hyphen)})")
    met = met.withColumn("_hyphen", F.col("w1").endswith(hyphen)).withColumn("_with", F.concat("w1", "w2")).withColumn("_without", F.concat(part, "w2"))
    for c in ("w1", "w2", "_with", "_without"):
        met = met.withColumn(f"{c}_w", T.without_outer_punctuation(F.col(c)) if c.startswith("_") else F.col(c))
        met = _factor(met, f"{c}_w", lexicon, impossible, unknown, f"{c}_f")
    keeps = F.col("_with_f") > F.col("_without_f")
    root = F.sqrt(F.col("s1") * F.col("s2"))
    score = F.when(F.col("_hyphen"), root * D.lexicon_factor(F.greatest("_with_f", "_without_f"), unknown)).otherwise(root * F.sqrt(D.lexicon_factor(F.col("w1_f"), unknown) * D.lexicon_factor(F.col("w2_f"), unknown)))
    whole = F.when(F.col("_hyphen"), F.when(keeps, F.col("_with_w")).otherwise(F.col("_without_w")))
    met = met.withColumn("score", score).withColumn("whole", whole)
    best = met.groupBy(*block, "line_idx").agg(F.min_by(F.struct("tok1", "line2", "tok2", "w1", "w2", "score", "whole"), F.struct(-F.col("score"), "_i", "_j")).alias("b")).select(*block, "line_idx", "b.*")
    first = best.select(*block, "line_idx", F.col("tok1").alias("tok_idx"), F.col("w1").alias("_c"), F.col("score").alias("_s"), F.when(F.col("whole").isNotNull(), "HypPart1").alias("subs_type"), F.col("whole").alias("subs_content"))
    second = best.select(*block, F.col("line2").alias("line_idx"), F.col("tok2").alias("tok_idx"), F.col("w2").alias("_c"), F.col("score").alias("_s"), F.when(F.col("whole").isNotNull(), "HypPart2").alias("subs_type"), F.col("whole").alias("subs_content"))
    decided = first.unionByName(second)
    out = _best_alone(words, lexicon, impossible, unknown, keys).join(decided, keys, "left")
    return out.select(*keys, F.coalesce("_c", "content").alias("content"), F.coalesce("_s", "score").alias("score"), "subs_type", "subs_content")


def guess_other_alphabets(words: DataFrame, guessers: list[tuple[str, str, str]], left_to_right: bool) -> DataFrame:
    """Words that fit another alphabet's pattern are guessed anew.

    ``words``: ``content, score, lang``; ``guessers``: language, pattern (of the
    whole word) and the column of that guesser's predictions, glyphs in the
    line's direction. The first that fits decides: its best outcome for each
    glyph, read in its own direction, its language, no lexicon.
    """
    content, score, lang = F.col("content"), F.col("score"), F.col("lang")
    for language, pattern, column in reversed(guessers):
        glyphs = F.col(column) if (language not in T.RIGHT_TO_LEFT) == left_to_right else F.reverse(column)
        best = F.get(D.k_best(glyphs, 1), F.lit(0))
        fits = F.col("content").rlike(f"^(?:{pattern})$") & F.col(column).isNotNull()
        content, score, lang = (F.when(fits, new).otherwise(old) for new, old in ((best["text"], content), (best["score"], score), (F.lit(language), lang)))
    return words.select(*[{"content": content, "score": score, "lang": lang}.get(c, F.col(c)).alias(c) for c in words.columns])


class TextGuesser(Protocol):
    """Reads a whole image of a block or page as layout XML; raises to say that it cannot."""

    def __call__(self, image: bytes) -> str: ...


def guess_whole(images: DataFrame, keys: list[str], guesser: TextGuesser, ignored: tuple[type[Exception], ...] = (Exception,)) -> DataFrame:
    """``keys, xml, error``: blocks, or pages without any, read in one piece; one that cannot be read is an empty text with its error."""

    def read(batches):
        for batch in batches:
            found, errors = [], []
            for image in batch["image"]:
                try:
                    found.append(guesser(bytes(image)))
                    errors.append(None)
                except ignored as e:
                    found.append("")
                    errors.append(f"{type(e).__name__}: {e}")
            yield batch[keys].assign(xml=pd.Series(found, index=batch.index), error=pd.Series(errors, index=batch.index))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in images.select(*keys).schema)
    return images.select(*keys, "image").mapInPandas(read, f"{fields}, xml string, error string")
