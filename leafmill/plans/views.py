"""The synthetic layout that the driver's tables give: lines, words, boxes, detections.

A text's lines and words become boxes on a grid: 10 units per character, 20
per line, words 16 high. Detections are these boxes moved by arithmetic on ids,
so SQL can repeat them. The SQL of each view is kept beside it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINES_PER_BLOCK = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """Rows of a table of fewer files than there are cores are dealt to all of them; larger tables are read as they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, line_idx, line``."""
    docs = dealt(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_idx", "line"))


#: Words of a line whose places are counted together.
STEP = 16


def words(spark: SparkSession, sf_dir: str, of: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, line_idx, tok_idx, content, l, t, w, h, conf``; no shuffle: words come in the order of the text.

    A word's place in its line is a sum over the words before it in its step,
    and over the steps before that one; the line itself goes no further. ``of``
    are the lines, if they are at hand; of these ``keep`` is kept.
    """
    at = ("doc_id", "line_idx", *keep)
    size = lambda parts: F.aggregate(parts, F.lit(0), lambda n, x: n + F.length(x) + 1)
    parts = (lines(spark, sf_dir) if of is None else of).select(*at, F.split("line", " ").alias("parts"))
    steps = F.transform(F.sequence(F.lit(0), F.floor((F.size("parts") - 1) / STEP).cast("int")), lambda i: F.slice("parts", i * STEP + 1, STEP))
    steps = parts.select(*at, steps.alias("steps"))
    starts = F.aggregate("steps", F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + size(x))))
    step = steps.select(*at, F.posexplode(F.arrays_zip(F.col("steps").alias("words"), starts.alias("start"))).alias("step", "s")).filter("s.words is not null")
    step = step.select(*at, "step", F.col("s.start").alias("start"), F.col("s.words").alias("ws"))
    t = step.select(*at, "step", "start", "ws", F.posexplode("ws").alias("i", "content")).filter("content <> ''")
    offset = F.col("start") + size(F.slice("ws", F.lit(1), F.col("i")))
    t = t.select(*at, (F.col("step") * STEP + F.col("i")).alias("tok_idx"), "content", offset.alias("offset"))
    return t.select(
        *at, "tok_idx", "content", (F.col("offset") * 10).cast("int").alias("l"), (F.col("line_idx") * 20).alias("t"), (F.length("content") * 10).cast("int").alias("w"), F.lit(16).alias("h"),
        ((F.col("doc_id") * 13 + F.col("line_idx") * 7 + F.col("tok_idx") * 3) % 100 / F.lit(100.0)).alias("conf"),
    )


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, block_idx, l, t, w, h``: five lines each."""
    sized = lines(spark, sf_dir).select("doc_id", F.floor(F.col("line_idx") / LINES_PER_BLOCK).cast("int").alias("block_idx"), (F.length("line") * 10).alias("width"))
    return sized.groupBy("doc_id", "block_idx").agg(F.max("width").cast("int").alias("w")).select("doc_id", "block_idx", F.lit(0).alias("l"), (F.col("block_idx") * 100).alias("t"), "w", F.lit(100).alias("h"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words' boxes as a detector would give them: moved and stretched a little."""
    jitter = (F.col("doc_id") * 31 + F.col("line_idx") * 17 + F.col("tok_idx") * 5) % 7
    return words(spark, sf_dir).select(
        "doc_id", "line_idx", "tok_idx", "content", (F.col("l") + jitter - 3).cast("int").alias("l"), (F.col("t") + jitter * 3 - 9).cast("int").alias("t"), (F.col("w") + jitter).cast("int").alias("w"), (F.col("h") + 4).alias("h"), "conf",
    )


#: Bytes of text whose boxes are made at a time, and boxes in one row at most.
STEP_BYTES, ROW_BOXES = 1_000_000, 256

BOXES = "page_id string, level string, det_id array<int>, label array<string>, l array<int>, t array<int>, w array<int>, h array<int>, conf array<double>"


def text_boxes(pages: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """Boxes of all levels of texts as pages, in rows of arrays (``BOXES``); a page's rows lie together.

    Lines, words and blocks stand where the views say; a glyph is as large as
    its word. Every other block holds two paragraphs.
    """
    signs = np.frombuffer("".join(x + "\n" for x in texts.to_pylist() if x is not None).encode("utf-32-le"), np.uint32)
    some = np.flatnonzero(pc.is_valid(texts).to_numpy(zero_copy_only=False))
    begin = np.append(0, np.cumsum(pc.utf8_length(texts).drop_null().to_numpy().astype(np.int64) + 1))
    ends = np.flatnonzero(signs == 10)
    first = np.searchsorted(ends, begin[:-1])  # of a page's lines
    start = np.append(0, ends + 1)[:-1]
    n_lines = np.diff(np.append(first, len(ends)))
    page = np.repeat(np.arange(len(some)), n_lines)
    idx, length = np.arange(len(ends)) - np.repeat(first, n_lines), ends - start
    # words: runs of other signs than spaces and line ends
    inside = np.concatenate([[False], (signs != 32) & (signs != 10)])
    at, to = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(~inside[1:] & inside[:-1])
    line = np.searchsorted(ends, at)
    block = np.flatnonzero(idx % LINES_PER_BLOCK == 0)
    width = np.maximum.reduceat(length, block) if len(block) else length
    block, width = block[width > 0], width[width > 0] * 10
    top = idx[block] // LINES_PER_BLOCK * 100
    two = np.flatnonzero(top // 100 % 2 == 0)
    twice, lower = np.repeat(two, 2), np.tile([0, 1], len(two))
    full = np.flatnonzero(length > 0)
    fixed = lambda x, n: np.full(len(x), n)
    levels = [
        ("page", np.arange(len(pages)), fixed(pages, 0), fixed(pages, 0), fixed(pages, 1_000_000), fixed(pages, 1_000_000)),
        ("block", some[page[block]], fixed(block, 0), top, width, fixed(block, 100)),
        ("paragraph", some[page[block[twice]]], fixed(twice, 0), top[twice] + 40 * lower, width[twice], 40 + 20 * lower),
        ("line", some[page[full]], fixed(full, 0), idx[full] * 20 + 10, length[full] * 10, fixed(full, 16)),
        ("word", some[page[line]], (at - start[line]) * 10, idx[line] * 20, (to - at) * 10, fixed(at, 16)),
    ]
    row_page, row_level, size = [], [], []
    for k, (_, of, *_) in enumerate(levels):
        n = np.bincount(of, minlength=len(pages))
        rows = -(-n // ROW_BOXES)
        owner = np.repeat(np.arange(len(pages)), rows)
        last = np.append(owner[1:] != owner[:-1], True)[: len(owner)]
        row_page.append(owner)
        row_level.append(np.full(len(owner), k))
        size.append(np.where(last, n[owner] - (rows[owner] - 1) * ROW_BOXES, ROW_BOXES))
    row_page, row_level, size = map(np.concatenate, (row_page, row_level, size))
    # a word's boxes once more as glyphs
    rows = np.append(np.arange(len(row_page)), np.flatnonzero(row_level == len(levels) - 1))
    level = np.append(row_level, np.full(len(rows) - len(row_page), len(levels)))
    by = np.lexsort((level, row_page[rows]))
    rows, level = rows[by], level[by]
    offsets = pa.array(np.append(0, np.cumsum(size)), pa.int32())
    listed = lambda x, kind: pa.ListArray.from_arrays(offsets, pa.array(x, kind)).take(pa.array(rows))
    number = np.concatenate([np.arange(len(of)) - np.searchsorted(of, of) for _, of, *_ in levels])
    whole = [np.concatenate([x[k] for x in levels]) for k in range(2, 6)]
    names = pa.array([x[0] for x in levels] + ["glyph"]).take(pa.array(level))
    label = pa.ListArray.from_arrays(offsets, pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(number), np.int8)), pa.array(["Text"])).cast(pa.string()))
    label = label.take(pa.array(rows, mask=(level == 0) | (level > 2)))
    columns = [pages.take(pa.array(row_page[rows])), names, listed(number, pa.int32()), label, *(listed(x, pa.int32()) for x in whole), listed(np.full(len(number), 0.9), pa.float64())]
    return pa.RecordBatch.from_arrays(columns, ["page_id", "level", "det_id", "label", "l", "t", "w", "h", "conf"])


def page_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of all levels of the documents as pages of a million units each way, in rows of arrays; no shuffle, a page's rows lie together."""

    def boxes(batches):
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy().astype(np.int64))
            at = 0
            while at < len(batch):
                end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + STEP_BYTES, "right")))
                yield text_boxes(batch["page_id"].slice(at, end - at), batch["text"].slice(at, end - at))
                at = end

    docs = dealt(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select(F.col("doc_id").cast("string").alias("page_id"), "text").mapInArrow(boxes, BOXES)


def millionths_sql(n: str, d: str) -> str:
    return f"((2000000 * ({n})::bigint + ({d})) // (2 * ({d}))::bigint)"


def six_sql(n: str, d: str) -> str:
    k = millionths_sql(n, d)
    return f"printf('%d.%06d', {k} // 1000000, {k} % 1000000)"


LINES = """lines as (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) - 1 line_idx from documents)"""
WORDS = (
    LINES
    + """,
parts as (select doc_id, line_idx, unnest(string_split(line, ' ')) content, generate_subscripts(string_split(line, ' '), 1) - 1 tok_idx from lines),
words as (select * from (select doc_id, line_idx, tok_idx, content, 10 * (sum(length(content) + 1) over (partition by doc_id, line_idx order by tok_idx) - length(content) - 1) l,
    20 * line_idx t, 10 * length(content) w, 16 h, (doc_id * 13 + line_idx * 7 + tok_idx * 3) % 100 / 100.0 conf from parts) where content <> '')"""
)
BLOCKS = """blocks as (select doc_id, line_idx // 5 block_idx, 0 l, (line_idx // 5) * 100 t, max(length(line)) * 10 w, 100 h from lines group by all)"""
DETECTIONS = """detections as (select doc_id, line_idx, tok_idx, content, l + (doc_id * 31 + line_idx * 17 + tok_idx * 5) % 7 - 3 l, t + ((doc_id * 31 + line_idx * 17 + tok_idx * 5) % 7) * 3 - 9 t,
    w + (doc_id * 31 + line_idx * 17 + tok_idx * 5) % 7 w, h + 4 h, conf from words)"""


def overlap_sql(a: str, b: str) -> str:
    """Area of the intersection of two aliased boxes."""
    return f"(greatest(0, least({a}.l + {a}.w, {b}.l + {b}.w) - greatest({a}.l, {b}.l)) * greatest(0, least({a}.t + {a}.h, {b}.t + {b}.h) - greatest({a}.t, {b}.t)))"
