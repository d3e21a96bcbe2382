"""Exports that train detectors and readers: boxes of all kinds, lines, words and glyphs with their texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T

#: fixed values: kinds of boxes, and the share of a line's height that separators fill
KINDS = ("TopLevelTextBlock", "Illustration", "TextBlock", "BaseLine", "NonFinalBaseLine", "FinalBaseLine", "Word", "Glyph", "WordSeparator", "GlyphSeparator")
SEPARATOR_HEIGHT = 0.85


def _norm(df: DataFrame, kind, x: Column, y: Column, w: Column, h: Column) -> DataFrame:
    """``page_id, kind, x, y, w, h``: centre and size as shares of the page's ``pw`` and ``ph``."""
    pw, ph = F.col("pw").cast("double"), F.col("ph").cast("double")
    return df.select("page_id", (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), (x / pw).alias("x"), (y / ph).alias("y"), (w / pw).alias("w"), (h / ph).alias("h"))


def training_boxes(pages: DataFrame, blocks: DataFrame, lines: DataFrame, words: DataFrame, glyphs: DataFrame, spaces: DataFrame, kinds: tuple[str, ...] = KINDS, thickness: float = 0.01, across: float = 0.005, down: float = 0.0) -> DataFrame:
    """Boxes of all asked ``kinds``: ``page_id, kind, x, y, w, h``, normalised by the page.

    ``pages``: ``page_id, pw, ph``; ``blocks``: ``block_type`` (composed, text,
    illustration), ``top`` (at top level), box; ``lines``: ``block, line_idx,
    x1, y1, x2, y2, band_t``; the others have ``block, line_idx`` and a box,
    glyphs also ``word_idx, glyph_idx`` in reading order. A baseline is as thick as
    ``thickness`` of the page; top-level blocks have margins. Separators of
    glyphs stand at a glyph's left side, unlike those of words in pixels cut
    to whole ones before they are normalised.
    """
    r = G.rect()
    on = lambda df: df.join(pages.select("page_id", "pw", "ph"), "page_id")
    centre = lambda df, kind: _norm(df, kind, r.x_center, r.y_center, r.w, r.h)
    b = on(blocks)
    parts = [centre(b.filter("block_type = 'text'"), "TextBlock")]
    top = b.filter("top")
    wide = _norm(top.filter("block_type <> 'illustration'"), "TopLevelTextBlock", r.x_center, r.y_center, r.w, r.h)
    parts.append(wide.withColumn("w", F.col("w") + 2 * across).withColumn("h", F.col("h") + 2 * down))
    parts.append(centre(top.filter("block_type = 'illustration'"), "Illustration"))

    line = on(lines).withColumn("y", (F.col("y1") + F.col("y2")) / 2.0)
    last = F.row_number().over(Window.partitionBy("page_id", "block").orderBy(F.desc("line_idx"))) == 1
    line = line.withColumn("_kind", F.when(last, "FinalBaseLine").otherwise("NonFinalBaseLine"))
    base = lambda kind: _norm(line, kind, (F.col("x1") + F.col("x2")) / 2.0, F.col("y"), G.horizontal_span(F.col("x1"), F.col("x2")), F.col("ph") * thickness)
    parts += [base("BaseLine"), base(F.col("_kind")), centre(on(words), "Word"), centre(on(glyphs), "Glyph")]

    at = line.select("page_id", "block", "line_idx", "band_t", "y")
    height, middle = F.col("y") - F.col("band_t"), (F.col("y") + F.col("band_t")) / 2.0
    parts.append(_norm(on(spaces).join(at, ["page_id", "block", "line_idx"]), "WordSeparator", r.l + r.w / 2.0, middle, r.w, height * SEPARATOR_HEIGHT))
    inner = on(glyphs.filter("glyph_idx > 0")).join(at, ["page_id", "block", "line_idx"])
    parts.append(_norm(inner, "GlyphSeparator", r.l, middle, G.truncated(F.col("pw") * thickness), G.truncated(height * SEPARATOR_HEIGHT)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter(F.col("kind").isin(*kinds))


def tiled(boxes: DataFrame, pages: DataFrame, n: int, margin: float) -> DataFrame:
    """Boxes that lie whole in a tile of their page, as shares of the tile: ``page_id, tile, kind, x, y, w, h``; one tile is the page."""
    if n <= 1:
        return boxes.withColumn("tile", F.lit(0))
    tiles = pages.select("page_id", "pw", "ph", F.posexplode(G.tiles(F.col("pw"), F.col("ph"), n, n, margin)).alias("tile", "q"))
    pw, ph = F.col("pw").cast("double"), F.col("ph").cast("double")
    met = boxes.join(tiles, "page_id")
    left, right, top, bottom = F.col("x") - F.col("w") / 2, F.col("x") + F.col("w") / 2, F.col("y") - F.col("h") / 2, F.col("y") + F.col("h") / 2
    tl, tt, tr, tb = F.col("q.l") / pw, F.col("q.t") / ph, (F.col("q.l") + F.col("q.w")) / pw, (F.col("q.t") + F.col("q.h")) / ph
    met = met.filter((left >= tl) & (right <= tr) & (top >= tt) & (bottom <= tb))
    return met.select("page_id", "tile", "kind", ((F.col("x") - tl) * pw / F.col("q.w")).alias("x"), ((F.col("y") - tt) * ph / F.col("q.h")).alias("y"), (F.col("w") * pw / F.col("q.w")).alias("w"), (F.col("h") * ph / F.col("q.h")).alias("h"))


def label_lines(boxes: DataFrame, kinds: tuple[str, ...], polygons: bool = False) -> DataFrame:
    """``page_id, tile, label``: the number of a box's kind, then centre and size, or four corners, with six decimals."""
    number = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind")) - 1
    six = lambda c: F.format_string("%.6f", c)
    half = lambda c, s, sign: six(F.col(c) + F.lit(sign) * F.col(s) / 2)
    if polygons:
        values = [f for x, y in ((-1, -1), (-1, 1), (1, 1), (1, -1)) for f in (half("x", "w", x), half("y", "h", y))]
    else:
        values = [six(F.col(c)) for c in "xywh"]
    return boxes.select("page_id", "tile", F.concat_ws(" ", number.cast("string"), *values).alias("label"))


def dataset_description(name: str, kinds: tuple[str, ...]) -> str:
    """The description file of a data set of labels, in YAML."""
    classes = "".join(f"  {i}: {k}\n" for i, k in enumerate(kinds))
    return f"path: {name}\ntrain: images/train\nval: images/val\ntest:\nnames:\n{classes}"


def split_of(index: Column, one_every: int | None) -> Column:
    """"val" for every ``one_every``-th item, counted from 1, else "train"."""
    return F.when((index + 1) % one_every == 0, "val").otherwise("train") if one_every else F.lit("train")


def text_items(items: DataFrame, order: list[str], digits: int, one_every: int | None = None, simplify=lambda c: T.simplified(c, True), extension: str = "png") -> DataFrame:
    """Lines or words (``file, content`` and a box) as rows ``split, image, text, l, t, w, h``, numbered in each file by ``order``."""
    i = F.row_number().over(Window.partitionBy("file").orderBy(*order)) - 1
    x = items.withColumn("_i", i)
    name = F.format_string(f"%s_%0{digits}d.{extension}", T.without_extension(F.col("file")), "_i")
    return x.select("file", split_of(F.col("_i"), one_every).alias("split"), name.alias("image"), simplify(F.col("content")).alias("text"), *"ltwh")


def glyph_items(glyphs: DataFrame, pages: DataFrame, simplify=lambda c: T.simplified(c, True)) -> DataFrame:
    """Glyphs with crops a tenth higher than they are and at least as wide as high, clipped to their page: ``file, text, l, t, w, h``."""
    h = G.truncated(F.col("h") * 1.1)
    w = F.greatest(F.col("w"), h)
    left, top = F.col("l") - F.floor((w - F.col("w")) / 2).cast("int"), F.col("t") - F.floor((h - F.col("h")) / 2).cast("int")
    x = glyphs.select("file", "content", left.alias("_l"), top.alias("_t"), w.alias("_w"), h.alias("_h")).join(pages.select("file", "pw", "ph"), "file")
    clip = G.intersection(G.rect("_"), G.Rect(F.lit(0), F.lit(0), F.col("pw"), F.col("ph")))
    return x.select("file", simplify(F.col("content")).alias("text"), *clip.columns()).filter("l is not null")


def selected_words(words: DataFrame, pattern: str) -> DataFrame:
    """Words whose whole content fits a pattern."""
    return words.filter(F.col("content").rlike(f"^(?:{pattern})$"))


def alphabet_of(texts: DataFrame, text: str = "text") -> DataFrame:
    """``glyph`` of all characters, with their points, that texts use."""
    return texts.select(F.explode(T.characters(F.col(text))).alias("glyph")).distinct()


def annotated(images: DataFrame, layouts: DataFrame, annotate, names: DataFrame | None = None, most: int | None = None, level: bool = True) -> DataFrame:
    """The frame of every annotator: allowed images meet their gold layouts by name, stand level, and go through ``annotate(nodes)``."""
    from ..sources import files, layout_xml
    from . import tree

    met = files.with_layouts(files.allowed_files(images, names, most), layouts)
    nodes = layout_xml.read_layout(met.select(F.col("path").alias("file"), "xml")).filter("node <> 'error'")
    return annotate(tree.unrotate_pages(nodes) if level else nodes)
