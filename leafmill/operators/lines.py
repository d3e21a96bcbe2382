"""Operators along lines and blocks: borders, spaces, words, paragraphs, votes, skew. Windows and aggregates, no folds but one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from .text_tree import ordered_text


def borders(boxes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds ``border_l, border_r``: half way to the neighbours, the box's own side at the ends. ``boxes`` stand from left to right."""
    w, r = Window.partitionBy(*keys).orderBy(*order), G.rect()
    left = F.coalesce(G.truncated((F.lag(r.r).over(w) + r.l) / 2), r.l)
    right = F.coalesce(G.truncated((r.r + F.lead("l").over(w)) / 2), r.r)
    return boxes.withColumn("border_l", left).withColumn("border_r", right)


def spaces(words: DataFrame, keys: list[str], order: list[str], left_to_right: bool = True) -> DataFrame:
    """A space for every gap between a word and the next: ``keys, order, l, w, t, h``."""
    w, r = Window.partitionBy(*keys).orderBy(*order), G.rect()
    gap = (F.lead("l").over(w) - r.r) if left_to_right else (r.l - F.lead(r.r).over(w))
    names = [c for c in order if isinstance(c, str)]
    found = words.withColumn("_gap", gap).filter("_gap > 0")
    return found.select(*keys, *names, (r.r if left_to_right else r.l - F.col("_gap")).alias("l"), F.col("_gap").alias("w"), "t", "h")


def combined_words(words: DataFrame, keys: list[str], order: list[str], gap: int) -> DataFrame:
    """Words that no gap of more than ``gap`` parts are one: ``keys, grp, content, l, t, w, h``."""
    w, r = Window.partitionBy(*keys).orderBy(*order), G.rect()
    g = words.withColumn("_s", F.when(F.col("l") - F.lag(r.r).over(w) > gap, 1).otherwise(0)).withColumn("grp", F.sum("_s").over(w))
    return g.groupBy(*keys, "grp").agg(ordered_text(order, "content", "").alias("content"), F.min("l").alias("l"), F.min("t").alias("t"), (F.max(r.r) - F.min("l")).alias("w"), (F.max(r.b) - F.min("t")).alias("h"))


def vote(voters: DataFrame, keys: list[str], value: str = "lang") -> DataFrame:
    """``keys, value``: the most frequent value of each group, no value being one too; ties go to none, then in order."""
    counted = voters.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    first = F.min(F.struct((-F.col("_n")).alias("n"), F.col(value).isNotNull().alias("some"), F.col(value).alias("v")))
    return counted.groupBy(*keys).agg(first.alias("_b")).select(*keys, F.col("_b.v").alias(value))


def vote_cascade(words: DataFrame, levels: list[list[str]], default: str, value: str = "lang") -> list[DataFrame]:
    """Votes of words for lines, of lines for blocks and so on; at the last level no value becomes ``default``."""
    out = []
    for keys in levels:
        words = vote(words, keys, value)
        out.append(words)
    out[-1] = out[-1].withColumn(value, F.coalesce(value, F.lit(default)))
    return out


def paragraph_steps(lines: Column, bottoms: Column) -> Column:
    """Paragraph number of each line of a block, in order.

    ``lines``: baselines from top to bottom; ``bottoms``: lower edges of the
    block's paragraphs. A line below the current paragraph's edge begins the
    next one, one step for a line; after the last paragraph all lines extend
    it. Groups that stay empty are not counted.
    """

    def step(acc: Column, y: Column) -> Column:
        below = (acc["at"] < F.size(bottoms)) & (y > F.get(bottoms, acc["at"]))
        first = F.size(acc["groups"]) == 0
        last = F.coalesce(F.element_at(acc["groups"], -1), F.lit(0))
        group = F.when(first, 0).when(below, last + 1).otherwise(last)
        return F.struct((acc["at"] + below.cast("int")).alias("at"), F.concat(acc["groups"], F.array(group.cast("int"))).alias("groups"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("groups"))
    return F.aggregate(lines, start, step)["groups"]


def stretched_children(children: DataFrame, block: list[str], order: str) -> DataFrame:
    """Children with ``bottom`` of a block with ``block_t, block_b``: each begins where the one before ends, the last reaches the block's end."""
    w = Window.partitionBy(*block).orderBy(order)
    top = F.coalesce(F.lag("bottom").over(w), F.col("block_t"))
    low = F.when(F.lead(order).over(w).isNull(), F.col("block_b")).otherwise(F.col("bottom"))
    return children.withColumn("t", top).withColumn("b", low)


def skew_of(contours: DataFrame, keys: list[str], order: list[str], most: int = 10, near: float = 1.0) -> DataFrame:
    """``keys, skew``: mean angle of the largest contours (``w, h, angle``) that lie near their upper median.

    Of each page the larger half counts, ``most`` at most.
    """
    c = contours.select(*keys, F.struct((-F.col("w") * F.col("h")).alias("area"), *order, "angle").alias("c")).groupBy(*keys).agg(F.array_sort(F.collect_list("c")).alias("c"))
    top = c.select(*keys, F.transform(F.slice("c", F.lit(1), F.least(F.lit(most), F.floor((F.size("c") + 1) / 2).cast("int"))), lambda x: x["angle"]).alias("angles"))
    top = top.withColumn("med", F.element_at(F.array_sort("angles"), (F.floor(F.size("angles") / 2) + 1).cast("int"))).withColumn("near", F.filter("angles", lambda x: F.abs(x - F.col("med")) <= near))
    return top.select(*keys, (F.aggregate("near", F.lit(0.0), lambda s, x: s + x) / F.size("near")).alias("skew"))


def folded_angle(degrees: Column) -> Column:
    """An angle of a box as the slant of its text: within 45 degrees of level."""
    turned = degrees % 90
    return F.when(turned > 45, turned - 90).when(turned < -45, turned + 90).otherwise(turned)
