"""The full segmenter once more, by joins and windows over whole tables: what pages' arrays are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.config import Config
from leafmill.functions import geometry as G
from leafmill.operators import lines as L
from leafmill.operators import spatial, suppress
from leafmill.operators.durable import once
from leafmill.plans import segment

PLACED, PLACED_LINE = 0.5, 0.01


def _boxes(df: DataFrame, prefix: str, *keep: str) -> DataFrame:
    return df.select("page_id", *keep, *[F.col(c).alias(prefix + c) for c in "ltwh"])


def segments_by_joins(detections: DataFrame, left_to_right: bool, pages: DataFrame | None = None, config: Config = Config(), region: tuple[int, int, int, int] | None = None) -> segment.Segmented:
    top = segment.segment_blocks(detections.select(*[c for c in detections.columns if c != "tile"]), left_to_right).blocks
    # every level is used by several others: each is computed once
    top = once(top)
    illustrations, blocks = top.filter("label = 'Illustration'").drop("reading_idx"), top.filter("label <> 'Illustration'").drop("reading_idx")
    inner = detections.filter("level <> 'block'")
    if pages is not None:
        areas = segment.print_areas(top, pages, config.crop_margin, config.crop_to_print_area)
        inner = segment.on_page(inner, areas, segment.glyph_tiles(areas, config.tiles, config.tile_margin)).join(areas.select("page_id", "height"), "page_id")
        low = F.col("t") + F.col("h")
        inner = inner.filter((F.col("level") != "line") | (low <= F.col("height"))).filter((F.col("level") != "word") | (low < F.col("height") - 1)).drop("height")
    inner = inner.drop("tile")
    at = lambda level: inner.filter(F.col("level") == level).drop("level")
    within = (lambda df, least: spatial.in_region(df, G.Rect(*map(F.lit, region)), least)) if region else (lambda df, least: df)

    blocks = within(blocks, 0)
    # tiles and repeated detectors may use one number twice
    paragraphs = suppress.suppress_unordered(within(at("paragraph"), 0), ["page_id"], ["t", "l", "det_id"])
    placed = spatial.place_best(_boxes(paragraphs, "a_", "det_id"), _boxes(blocks, "b_", F.col("det_id").alias("block")), ["page_id"], ["det_id"], ["block"], PLACED)
    lost = spatial.orphans(paragraphs, placed, ["page_id", "det_id"], config.always_kept)
    placed = once(placed)
    blocks = once(blocks.unionByName(lost.withColumn("det_id", -F.col("det_id") - 1)))

    lines = within(at("line").withColumn("t", F.col("t") - F.floor(F.col("h") / 2).cast("int")), 0)
    met = spatial.place_all(_boxes(lines, "a_", "det_id", "conf"), _boxes(blocks, "b_", F.col("det_id").alias("block")), ["page_id"], PLACED_LINE)
    lines = met.select("page_id", "block", "det_id", F.col("b_l").alias("l"), F.col("a_t").alias("t"), F.col("b_w").alias("w"), F.col("a_h").alias("h"), "conf", F.col("b_t").alias("block_t"), (F.col("b_t") + F.col("b_h")).alias("block_b"))
    lines = suppress.suppress_ordered(lines, ["page_id", "block"], ["t", "det_id"])
    lines = lines.withColumn("line_idx", F.row_number().over(Window.partitionBy("page_id", "block").orderBy("t", "det_id")) - 1)
    # words and glyphs are placed by the bands between baselines
    bands = spatial.line_bands(lines.withColumn("y", F.col("t") + F.col("h")), ["page_id", "block"])
    bands = once(bands.withColumn("t", F.col("band_t").cast("int")).withColumn("h", (F.col("band_b") - F.col("band_t")).cast("int")))

    def into(children: DataFrame, parents: DataFrame, keys: list[str], parent: str) -> DataFrame:
        a = children.select("page_id", *keys[1:], "det_id", "conf", *[F.col(c).alias(f"a_{c}") for c in "ltwh"])
        b = parents.select("page_id", *keys[1:], F.col(parent).alias("_p"), *[F.col(c).alias(f"b_{c}") for c in "ltwh"])
        got = spatial.place_best(a, b, keys, ["det_id"], ["_p"], PLACED)
        return got.select(*keys, F.col("_p").alias(parent), "det_id", *[F.col(f"a_{c}").alias(c) for c in "ltwh"], "conf")

    in_block = lambda df: into(df, blocks.withColumn("block", F.col("det_id")), ["page_id"], "block")
    number = Window.partitionBy("page_id").orderBy("t", "l", "w", "h", "det_id")
    numbered = lambda df: df.withColumn("det_id", F.row_number().over(number))
    line = ["page_id", "block", "line_idx"]
    words = suppress.suppress_ordered(into(in_block(numbered(within(at("word"), 0.8))), bands, line[:2], "line_idx"), line, ["l", "det_id"])
    right = [F.desc(F.col("l") + F.col("w")), F.desc("l"), "det_id"]
    along = Window.partitionBy(*line).orderBy(*(["l", "det_id"] if left_to_right else right))
    words = once(words.withColumn("word_idx", F.row_number().over(along) - 1))
    glyphs = into(into(in_block(numbered(within(at("glyph"), 0.8))), bands, line[:2], "line_idx"), words, line, "word_idx")
    glyphs = suppress.suppress_ordered(glyphs, [*line, "word_idx"], ["l", "det_id"])
    glyphs = L.borders(glyphs, [*line, "word_idx"], ["l", "det_id"])
    box = words.select(*line, "word_idx", F.col("t").alias("_t"), F.col("h").alias("_h"))
    glyphs = glyphs.join(box, [*line, "word_idx"]).select(*line, "word_idx", "det_id", F.col("border_l").alias("l"), F.col("_t").alias("t"), (F.col("border_r") - F.col("border_l")).alias("w"), F.col("_h").alias("h"), "conf")
    each = Window.partitionBy(*line, "word_idx").orderBy(*(["l", "det_id"] if left_to_right else right))
    glyphs = once(glyphs.withColumn("glyph_idx", F.row_number().over(each) - 1))

    words = once(spatial.with_children(words, glyphs, [*line, "word_idx"]))
    lines = once(spatial.with_children(bands.select(*lines.columns, "y", "band_t", "band_b"), words, line))
    children, lines = _children(lines, placed.select("page_id", "block", (F.col("a_t") + F.col("a_h")).alias("bottom")))
    blocks = spatial.with_children(blocks.withColumn("block", F.col("det_id")), lines, ["page_id", "block"])
    blocks = suppress.sort_pages(blocks.unionByName(illustrations.withColumn("block", F.col("det_id"))), ["page_id"], left_to_right)
    spaces = L.spaces(words, line, ["word_idx"], left_to_right)
    return segment.Segmented(blocks, lines, words, glyphs, spaces, children)


def _children(lines: DataFrame, paragraphs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Children of blocks that hold several paragraphs, and lines with ``child`` (null in other blocks)."""
    bottoms = paragraphs.groupBy("page_id", "block").agg(F.sort_array(F.collect_list("bottom")).alias("bottoms")).filter(F.size("bottoms") > 1)
    per = lines.groupBy("page_id", "block").agg(F.array_sort(F.collect_list(F.struct("line_idx", "y"))).alias("ls")).join(bottoms, ["page_id", "block"])
    steps = L.paragraph_steps(F.transform("ls", lambda x: x["y"]), F.col("bottoms"))
    per = per.withColumn("groups", steps).filter(F.array_max("groups") > 0)
    shared = per.select("page_id", "block", F.explode(F.arrays_zip("ls", "groups")).alias("z")).select("page_id", "block", F.col("z.ls.line_idx").alias("line_idx"), F.col("z.groups").alias("child"))
    lines = lines.join(shared, ["page_id", "block", "line_idx"], "left")
    found = lines.filter("child is not null").groupBy("page_id", "block", "child").agg(F.max_by("band_b", "line_idx").alias("bottom"), F.first("block_t").alias("block_t"), F.first("block_b").alias("block_b"), F.first("l").alias("l"), F.first("w").alias("w"))
    found = L.stretched_children(found, ["page_id", "block"], "child")
    return found.select("page_id", "block", "child", "l", F.col("t").cast("int").alias("t"), "w", (F.col("b") - F.col("t")).cast("int").alias("h")), lines
