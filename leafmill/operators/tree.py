"""The page tree in its flat form: nodes as the layout reader gives them, moved, flattened and named."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G


def blocks_of(nodes: DataFrame, kind: str) -> DataFrame:
    """Blocks of one kind: "text", "composed" or "illustration"."""
    return nodes.filter((F.col("node") == "block") & (F.col("kind") == kind))


def text_blocks(nodes: DataFrame) -> DataFrame:
    """All text blocks in reading order, those of a composed block in its place; adds ``block_nr``."""
    order = Window.partitionBy("file", "page_id").orderBy("idx")
    return blocks_of(nodes, "text").withColumn("block_nr", F.row_number().over(order) - 1)


def tokens_of(nodes: DataFrame, kind: str) -> DataFrame:
    """Tokens of one kind: "word", "space" or "hyphen"."""
    return nodes.filter((F.col("node") == "token") & (F.col("kind") == kind))


def first_hyphens(nodes: DataFrame) -> DataFrame:
    """``file, parent_idx, idx, content`` of each line's first hyphen."""
    return tokens_of(nodes, "hyphen").groupBy("file", "parent_idx").agg(F.min_by(F.struct("idx", "content"), "idx").alias("h")).select("file", "parent_idx", "h.*")


def without_ids(nodes: DataFrame) -> DataFrame:
    """Nodes without names, for comparisons."""
    return nodes.withColumn("id", F.lit(None).cast("string"))


def with_positional_ids(nodes: DataFrame) -> DataFrame:
    """Names of blocks from their places: composed CB_page_block, text TB_page_block_child (child 0 at top level), others IL_page_block."""
    b = nodes.filter("node = 'block'")
    outer = b.filter("kind = 'composed'").select("file", F.col("idx").alias("parent_idx"), F.lit(True).alias("_nested"))
    b = b.join(outer, ["file", "parent_idx"], "left").withColumn("_nested", F.coalesce("_nested", F.lit(False)))
    inside = Window.partitionBy("file", "parent_idx").orderBy("idx")
    b = b.withColumn("_child", F.row_number().over(inside)).withColumn("_top", F.sum((~F.col("_nested")).cast("int")).over(Window.partitionBy("file", "page_id").orderBy("idx")))
    prefix = F.when(F.col("kind") == "composed", "CB").when(F.col("kind") == "illustration", "IL").otherwise("TB")
    name = F.when(prefix == "TB", F.format_string("TB_%05d_%03d_%03d", "page_nr", "_top", F.when(F.col("_nested"), F.col("_child")).otherwise(0))).otherwise(F.format_string("%s_%05d_%03d", prefix, "page_nr", "_top"))
    named = b.select(*[name.alias("id") if c == "id" else F.col(c) for c in nodes.columns])
    return nodes.filter("node <> 'block'").unionByName(named)


def effective_languages(nodes: DataFrame, default: str) -> DataFrame:
    """Adds ``language``: a node's own, else that of the nearest node above that has one, else ``default``."""
    out, above = None, None
    for node in ("page", "block", "block", "line", "token", "glyph"):
        level = nodes.filter(F.col("node") == node)
        if above is None:
            level = level.withColumn("language", F.coalesce("lang", F.lit(default)))
        else:
            level = level.join(above.select("file", F.col("idx").alias("parent_idx"), F.col("language").alias("_above")), ["file", "parent_idx"]).withColumn("language", F.coalesce("lang", "_above")).drop("_above")
        level = level.select(*nodes.columns, "language")
        out = level if out is None else out.unionByName(level)
        above = level if node != "block" or above is None else above.unionByName(level)
    return out


def with_language(nodes: DataFrame, language: str, right_to_left: tuple[str, ...]) -> DataFrame:
    """Pages in another language; where that turns the direction of writing, tokens and glyphs change their order in line and word.

    ``idx`` of siblings is dealt anew from right to left or left to right.
    """
    page = nodes.filter("node = 'page'").select("file", "page_id", (F.col("lang").isin(*right_to_left) != F.lit(language in right_to_left)).alias("_turns"))
    x = nodes.join(page, ["file", "page_id"], "left").withColumn("_turns", F.coalesce("_turns", F.lit(False)) & F.col("node").isin("token", "glyph"))
    same = Window.partitionBy("file", "parent_idx", "node")
    along = [F.desc(F.col("l") + F.col("w")), F.desc("l")] if language in right_to_left else [F.col("l"), F.col("l") + F.col("w")]
    rank = F.row_number().over(same.orderBy(*along))
    places = F.array_sort(F.collect_list("idx").over(same))
    moved = x.withColumn("_to", F.when(F.col("_turns"), F.element_at(places, rank)).otherwise(F.col("idx")))
    parents = moved.filter("_turns and node = 'token'").select("file", F.col("idx").alias("parent_idx"), F.col("_to").alias("_parent"))
    moved = moved.join(parents, ["file", "parent_idx"], "left").withColumn("parent_idx", F.coalesce("_parent", "parent_idx")).withColumn("idx", F.col("_to"))
    own = F.when(F.col("node") == "page", F.lit(language)).otherwise(F.col("lang"))
    return moved.withColumn("lang", own).select(*nodes.columns)


def _moved(nodes: DataFrame, box, point, page_size) -> DataFrame:
    """Nodes with boxes and baselines moved by the constants of their page (``pw, ph, turn``)."""
    page = nodes.filter("node = 'page'").select("file", "page_id", F.col("w").alias("pw"), F.col("h").alias("ph"), F.coalesce("rotation", F.lit(0.0)).alias("turn"))
    x = nodes.join(page, ["file", "page_id"], "left")
    r, is_page = box(G.rect()), F.col("node") == "page"
    (x1, y1), (x2, y2) = point(F.col("x1"), F.col("y1")), point(F.col("x2"), F.col("y2"))
    w, h = page_size
    new = {"l": r.l, "t": r.t, "w": F.when(is_page, w).otherwise(r.w), "h": F.when(is_page, h).otherwise(r.h), "x1": x1, "y1": y1, "x2": x2, "y2": y2}
    size = lambda c: F.when(is_page, F.lit(0)).otherwise(c) if c is not None else None
    new["l"], new["t"] = size(new["l"]), size(new["t"])
    return x.select(*[new[c].cast("int").alias(c) if c in new else F.col(c) for c in nodes.columns])


def translate_pages(nodes: DataFrame, dx: Column, dy: Column) -> DataFrame:
    """Everything on a page moved; the page keeps its size. ``dx`` and ``dy`` may use ``pw, ph``."""
    return _moved(nodes, lambda r: G.translated(r, dx, dy), lambda x, y: (x + dx, y + dy), (F.col("w"), F.col("h")))


def crop_pages(nodes: DataFrame, area: G.Rect) -> DataFrame:
    """Pages cut to an area: what is on them moves, the page takes the area's size. Columns may use ``pw, ph``."""
    return _moved(nodes, lambda r: G.translated(r, -area.l, -area.t), lambda x, y: (x - area.l, y - area.t), (area.w, area.h))


def rescale_pages(nodes: DataFrame, scale: Column) -> DataFrame:
    return _moved(nodes, lambda r: G.rescaled(r, scale), lambda x, y: (G.truncated(x * scale), G.truncated(y * scale)), (G.truncated(F.col("w") * scale), G.truncated(F.col("h") * scale)))


def rotate_pages(nodes: DataFrame, degrees: Column | None = None) -> DataFrame:
    """Everything turned about the page's centre; without an angle by the page's own rotation, so that it stands as it was scanned."""
    turn = F.col("turn") if degrees is None else degrees
    return _moved(nodes, lambda r: G.rotated(r, turn, F.col("pw"), F.col("ph")), lambda x, y: G.rotated_point(x, y, turn, F.col("pw"), F.col("ph")), (F.col("w"), F.col("h")))


def unrotate_pages(nodes: DataFrame) -> DataFrame:
    """Pages set level: turned back by their rotation."""
    return rotate_pages(nodes, -F.col("turn"))
