"""Layout XML (ALTO 4) to flat tables and back.

A built-in XML reader groups repeated children by tag and so loses the order
of words, spaces and hyphens in a line; one parser per file, in Arrow batches,
keeps it. Missing or unreadable attributes get defaults, never errors.
Writing is ordered string aggregation.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

NODES = (
    "file string, page_id string, page_nr int, node string, parent_idx int, idx int, kind string, id string, content string, l int, t int, w int, h int, "
    "x1 int, y1 int, x2 int, y2 int, conf double, lang string, subs_type string, subs_content string, style_refs string, tag_refs string, rotation double"
)
_NAMES = [f.split()[0] for f in NODES.split(", ")]


def number(value: str | None, default=0):
    if value is not None and value.isdecimal() and value.isascii() and len(value) < 16:
        return type(default)(value)
    try:
        return type(default)(float(value))
    except (TypeError, ValueError):
        return default


def baseline(text: str | None, left: int, width: int) -> tuple[int, int, int, int]:
    """A baseline given as "y", "x,y" or "x1,y1 x2,y2"; empty is zeros, width at least 1."""
    points = [[number(v) for v in p.split(",")] for p in (text or "").split()]
    if not points:
        return 0, 0, 0, 0
    right = left + max(width, 1)
    if len(points[0]) == 1:
        return left, points[0][0], right, points[0][0]
    (x1, y1), (x2, y2) = points[0][:2], (points[-1][:2] if len(points) > 1 else [right, points[0][1]])
    return x1, y1, x2, y2


def _local(e) -> str:
    return e.tag.rpartition("}")[2]


def parse_layout(file: str, xml: str | bytes, default_lang: str = "yi") -> Iterator[dict]:
    """Rows of all nodes of a document in order; ``parent_idx`` points at another row's ``idx``."""
    root, count, none = ET.fromstring(xml), 0, dict.fromkeys(_NAMES) | {"file": file}

    def row(node: str, parent: int | None, e, page: dict, **more):
        nonlocal count
        of, got = e.get, none.copy()
        got["node"], got["parent_idx"], got["idx"], got["id"], got["lang"], got["style_refs"], got["tag_refs"] = node, parent, count, of("ID"), of("LANG") or of("language"), of("STYLEREFS"), of("TAGREFS")
        got["l"], got["t"], got["w"], got["h"] = number(of("HPOS")), number(of("VPOS")), number(of("WIDTH")), number(of("HEIGHT"))
        got.update(page)
        got.update(more)
        count += 1
        return got

    for tag in root.iter():
        if _local(tag) in ("LayoutTag", "StructureTag", "TextStyle", "Processing"):
            yield row(_local(tag), None, tag, {}, content=tag.get("LABEL") or tag.get("FONTFAMILY") or tag.findtext(".//{*}processingStepDescription"))
    for nr, p in enumerate(x for x in root.iter() if _local(x) == "Page"):
        first = next((x for x in p.iter() if _local(x) == "TextBlock"), None)
        turned = p.get("ROTATION") or (first.get("ROTATION") if first is not None else None)
        lang = p.get("LANG") or default_lang
        page = {"page_id": p.get("ID"), "page_nr": number(p.get("PHYSICAL_IMG_NR"), nr)}
        at = row("page", None, p, page, lang=lang, rotation=number(turned, 0.0), conf=number(p.get("PC"), 0.0))
        yield at
        for space in (x for x in p if _local(x) == "PrintSpace"):
            yield from _blocks(space, at["idx"], page, row)


def _blocks(parent, parent_idx, page, row):
    for e in parent:
        kind = {"TextBlock": "text", "ComposedBlock": "composed", "Illustration": "illustration"}.get(_local(e))
        if kind is None:
            continue
        at = row("block", parent_idx, e, page, kind=kind)
        yield at
        if kind == "composed":
            yield from _blocks(e, at["idx"], page, row)
        for line in (x for x in e if kind == "text" and _local(x) == "TextLine"):
            x1, y1, x2, y2 = baseline(line.get("BASELINE"), number(line.get("HPOS")), number(line.get("WIDTH")))
            on = row("line", at["idx"], line, page, x1=x1, y1=y1, x2=x2, y2=y2)
            yield on
            for tok in line:
                kind_ = {"String": "word", "SP": "space", "HYP": "hyphen"}.get(_local(tok))
                if kind_ is None:
                    continue
                content = " " if kind_ == "space" else tok.get("CONTENT") or ""
                word = row("token", on["idx"], tok, page, kind=kind_, content=content, conf=number(tok.get("WC"), 0.0), subs_type=tok.get("SUBS_TYPE"), subs_content=tok.get("SUBS_CONTENT"))
                yield word
                for sub in tok:
                    if _local(sub) == "ALTERNATIVE":
                        yield row("alternative", word["idx"], sub, page, kind=sub.get("PURPOSE"), content=sub.text or "")
                for g in (x for x in tok.iter() if _local(x) == "Glyph") if len(tok) else ():
                    yield row("glyph", word["idx"], g, page, content=g.get("CONTENT") or "", conf=number(g.get("GC"), 0.0))


#: Nodes that leave the reader together: a batch of long files has far more than fit in memory.
ROWS = 20_000


def read_layout(files: DataFrame, default_lang: str = "yi", columns: tuple[str, ...] = tuple(_NAMES), only: tuple[str, ...] = ()) -> DataFrame:
    """``files``: ``file`` and ``xml``; one row per node. A file that is no XML gives one row of node "error".

    With ``columns`` or ``only`` (values of ``node``) nothing else leaves the parser.
    """
    kinds = dict(f.split() for f in NODES.split(", "))
    schema = to_arrow_schema(StructType.fromDDL(", ".join(f"{c} {kinds[c]}" for c in columns)))

    def nodes(file: str, xml: str) -> Iterator[dict]:
        try:
            yield from parse_layout(file, xml, default_lang)
        except ET.ParseError as e:
            yield dict.fromkeys(_NAMES) | {"file": file, "node": "error", "content": str(e)}

    def parse(batches):
        rows: list[dict] = []
        for batch in batches:
            for file, xml in zip(batch.column(0), batch.column(1)):
                for row in nodes(file.as_py(), xml.as_py()):
                    if only and row["node"] not in only:
                        continue
                    rows.append(row)
                    if len(rows) >= ROWS:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
        yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("file", "xml").mapInArrow(parse, ", ".join(f"{c} {kinds[c]}" for c in columns))


HEADERS = (
    "file string, node string, idx int, id string, label string, time string, agency string, descriptions array<string>, settings string, "
    "creator string, name string, version string, application string, family string, font_type string, font_width string, font_size double"
)
_HEADER_NAMES = [f.split()[0] for f in HEADERS.split(", ")]
#: fixed values: font size that is taken where the given one is no number
FONT_SIZE = 12.0


def parse_headers(file: str, xml: str | bytes) -> Iterator[dict]:
    """Steps of processing ("step"), styles ("style") and tags ("LayoutTag", "StructureTag") of a document, in order."""
    text = lambda e, tag: next((x.text or "" for x in e.iter() if _local(x) == tag), None)
    for i, e in enumerate(x for x in ET.fromstring(xml).iter() if _local(x) in ("Processing", "TextStyle", "LayoutTag", "StructureTag")):
        row = dict.fromkeys(_HEADER_NAMES) | {"file": file, "idx": i, "id": e.get("ID")}
        if _local(e) == "Processing":
            row |= {"node": "step", "time": text(e, "processingDateTime"), "agency": text(e, "processingAgency"), "descriptions": [x.text or "" for x in e.iter() if _local(x) == "processingStepDescription"]}
            row |= {"settings": text(e, "processingStepSettings"), "creator": text(e, "softwareCreator"), "name": text(e, "softwareName"), "version": text(e, "softwareVersion"), "application": text(e, "applicationDescription")}
        elif _local(e) == "TextStyle":
            row |= {"node": "style", "family": e.get("FONTFAMILY"), "font_type": e.get("FONTTYPE"), "font_width": e.get("FONTWIDTH"), "font_size": number(e.get("FONTSIZE"), FONT_SIZE) if e.get("FONTSIZE") else None}
        else:
            row |= {"node": _local(e), "label": e.get("LABEL") or ""}
        yield row


def read_headers(files: DataFrame) -> DataFrame:
    """``HEADERS`` and ``at``, a step's point in time: with an offset, else a plain date, else null."""

    def parse(batches):
        for batch in batches:
            rows: list[dict] = []
            for file, xml in zip(batch["file"], batch["xml"]):
                try:
                    rows += parse_headers(file, xml)
                except ET.ParseError:  # read_layout has the row with the error
                    continue
            yield pd.DataFrame(rows, columns=_HEADER_NAMES)

    found = files.select("file", "xml").mapInPandas(parse, HEADERS)
    forms = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX", "yyyy-MM-ddXXX", "yyyy-MM-dd")
    return found.withColumn("at", F.coalesce(*[F.try_to_timestamp("time", F.lit(f)) for f in forms]))


def escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _attribute(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f' {name}="'), escaped(value.cast("string")), F.lit('"'))).otherwise("")


def _box() -> Column:
    return F.concat(*[_attribute(a, F.col(c)) for a, c in (("HPOS", "l"), ("VPOS", "t"), ("WIDTH", "w"), ("HEIGHT", "h"))])


def _element(tag: Column | str, attributes: Column, children: Column) -> Column:
    tag = F.lit(tag) if isinstance(tag, str) else tag
    return F.concat(F.lit("<"), tag, attributes, F.when(children == "", "/>").otherwise(F.concat(F.lit(">"), children, F.lit("</"), tag, F.lit(">"))))


def _tag(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"<{name}>"), escaped(value), F.lit(f"</{name}>"))).otherwise("")


def header_xml(headers: DataFrame) -> DataFrame:
    """``file, head``: steps, styles and tags as they stand before the layout."""
    names = (("softwareCreator", "creator"), ("softwareName", "name"), ("softwareVersion", "version"), ("applicationDescription", "application"))
    software = F.concat(*[_tag(a, F.col(c)) for a, c in names])
    described = F.concat_ws("", F.transform(F.coalesce("descriptions", F.array().cast("array<string>")), lambda d: _tag("processingStepDescription", d)))
    step = F.concat(F.lit("<Processing"), _attribute("ID", F.col("id")), F.lit(">"), _tag("processingDateTime", F.col("time")), _tag("processingAgency", F.col("agency")), described, _tag("processingStepSettings", F.col("settings")), F.lit("<processingSoftware>"), software, F.lit("</processingSoftware></Processing>"))
    style = F.concat(F.lit("<TextStyle"), *[_attribute(a, c) for a, c in (("ID", F.col("id")), ("FONTFAMILY", F.col("family")), ("FONTTYPE", F.col("font_type")), ("FONTWIDTH", F.col("font_width")), ("FONTSIZE", F.format_string("%.1f", "font_size")))], F.lit("/>"))
    style = F.when(F.col("font_size").isNull(), F.regexp_replace(style, ' FONTSIZE="[^"]*"', "")).otherwise(style)
    tag = F.concat(F.lit("<"), F.col("node"), _attribute("ID", F.col("id")), _attribute("LABEL", F.col("label")), F.lit("/>"))
    xml = headers.select("file", "idx", F.when(F.col("node") == "step", "1").when(F.col("node") == "style", "2").otherwise("3").alias("kind"), F.when(F.col("node") == "step", step).when(F.col("node") == "style", style).otherwise(tag).alias("xml"))
    rows = F.array_sort(F.collect_list(F.struct("idx", "kind", "xml")))

    def part(kind: str, around: str) -> Column:
        found = F.concat_ws("", F.transform(F.filter("rows", lambda r: r["kind"] == kind), lambda r: r["xml"]))
        return F.when(found != "", F.concat(F.lit(f"<{around}>"), found, F.lit(f"</{around}>"))).otherwise("")

    return xml.groupBy("file").agg(rows.alias("rows")).select("file", F.concat(part("1", "Description"), part("2", "Styles"), part("3", "Tags")).alias("head"))


def start_tag(node: str, depth: int | Column, columns: dict[str, Column]) -> Column:
    """``struct<depth, tag, head, text>`` of a node of one kind: its tag, its attributes and, if it is no element's, its text. Columns may be missing."""
    kinds = dict(f.split() for f in NODES.split(", "))
    c = {n: columns.get(n, F.lit(None)).cast(t) for n, t in kinds.items()}
    numbers = lambda **named: F.concat(*[F.when(c[n].isNotNull(), F.concat(F.lit(f' {a}="'), c[n].cast("string"), F.lit('"'))).otherwise("") for a, n in named.items()])
    texts = lambda **named: F.concat(*[_attribute(a, c[n]) for a, n in named.items()])
    cents = F.floor(c["conf"] * 100 + 0.5) / 100
    conf = lambda name: F.when(cents.isNotNull(), F.concat(F.lit(f' {name}="'), cents.cast("string"), F.lit('"'))).otherwise("")
    box, text = numbers(HPOS="l", VPOS="t", WIDTH="w", HEIGHT="h"), F.lit(None).cast("string")
    if node == "page":
        tag, head = F.lit("Page"), F.concat(texts(ID="page_id"), numbers(WIDTH="w", HEIGHT="h", PHYSICAL_IMG_NR="page_nr", ROTATION="rotation"), texts(LANG="lang"), conf("PC"))
    elif node == "block":
        tag, head = F.when(c["kind"] == "composed", "ComposedBlock").when(c["kind"] == "illustration", "Illustration").otherwise("TextBlock"), F.concat(texts(ID="id"), box, texts(STYLEREFS="style_refs", TAGREFS="tag_refs", LANG="lang"))
    elif node == "line":
        at = F.concat_ws(" ", F.concat_ws(",", c["x1"], c["y1"]), F.concat_ws(",", c["x2"], c["y2"]))
        tag, head = F.lit("TextLine"), F.concat(F.lit(' BASELINE="'), at, F.lit('"'), box, texts(LANG="lang"))
    elif node == "token":
        word = F.when(c["kind"] == "word", F.concat(conf("WC"), texts(LANG="lang", SUBS_TYPE="subs_type", SUBS_CONTENT="subs_content"))).otherwise("")
        tag, head = F.when(c["kind"] == "word", "String").when(c["kind"] == "space", "SP").otherwise("HYP"), F.concat(_attribute("CONTENT", F.when(c["kind"] != "space", c["content"])), box, word)
    elif node == "glyph":
        tag, head = F.lit("Glyph"), F.concat(texts(CONTENT="content"), box, conf("GC"))
    else:
        tag, head, text = F.lit("ALTERNATIVE"), texts(PURPOSE="kind"), escaped(c["content"])
    return F.struct(F.lit(depth).cast("int").alias("depth") if isinstance(depth, int) else depth.cast("int").alias("depth"), tag.alias("tag"), head.alias("head"), text.alias("text"))


#: Characters of files that leave the writer together.
CHARACTERS = 2_000_000


def write_layout_in_order(nodes: DataFrame) -> DataFrame:
    """``file, xml`` as ``write_layout`` gives them, from nodes that lie in order: no shuffle.

    All nodes of a file follow each other in one partition, each after the node
    above it, as the reader gives them. ``depth`` (a page's is 0) says what is
    above: the last node that is less deep.
    """
    of = lambda node: start_tag(node, F.col("depth"), {n: F.col(n) for n in nodes.columns if n in _NAMES})
    tags = F.when(F.col("node") == "token", of("token"))
    for node in ("glyph", "alternative", "line", "block", "page"):
        tags = tags.when(F.col("node") == node, of(node))
    return fold_tags(nodes.select("file", tags.alias("_t")).filter("_t is not null").select("file", "_t.*"))


def fold_tags(tags: DataFrame) -> DataFrame:
    """``file, xml`` from ``file, depth, tag, head, text`` (``start_tag``) that lie in order."""

    def fold(batches):
        files, xmls, size, file, parts, open_, bare = [], [], 0, None, [], [], False
        start = '<?xml version="1.0" encoding="UTF-8"?><alto xmlns="http://www.loc.gov/standards/alto/ns-v4#"><Layout>'

        def close(depth: float) -> None:
            nonlocal bare
            while open_ and open_[-1][0] >= depth:
                parts.append("/>" if bare else f"</{open_[-1][1]}>")
                bare = False
                open_.pop()

        def end() -> None:
            nonlocal size
            close(0)
            files.append(file)
            xmls.append(start + "".join(parts) + "</Layout></alto>")
            size += len(xmls[-1])
            parts.clear()

        for batch in batches:
            for f, depth, name, attributes, inner in zip(*[c.to_pylist() for c in batch.columns]):
                if f != file:
                    if file is not None:
                        end()
                    if size > CHARACTERS:
                        yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(xmls, pa.string())], ["file", "xml"])
                        files, xmls, size = [], [], 0
                    file = f
                close(depth)
                if bare:
                    parts.append(">")
                if name == "Page":
                    parts.append(f"<Page{attributes}><PrintSpace")
                    open_ += [(depth, name), (depth + 0.5, "PrintSpace")]
                    bare = True
                elif inner is not None:
                    parts.append(f"<{name}{attributes}>{inner}")
                    open_.append((depth, name))
                    bare = False
                else:
                    parts.append(f"<{name}{attributes}")
                    open_.append((depth, name))
                    bare = True
        if file is not None:
            end()
        yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(xmls, pa.string())], ["file", "xml"])

    return tags.select("file", "depth", "tag", "head", "text").mapInArrow(fold, "file string, xml string")


def write_layout(nodes: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """``file, xml`` from rows as ``read_layout`` and ``read_headers`` give them; levels fold upwards, children in order."""

    def folded(rows: DataFrame, into: str) -> DataFrame:
        parts = F.array_sort(F.collect_list(F.struct("idx", "xml")))
        return rows.groupBy("file", F.col("parent_idx").alias("idx")).agg(F.concat_ws("", F.transform(parts, lambda x: x["xml"])).alias(into))

    def level(node: str, below: DataFrame | None, xml: Column) -> DataFrame:
        own = nodes.filter(F.col("node") == node)
        own = own.join(folded(below, "children"), ["file", "idx"], "left") if below is not None else own.withColumn("children", F.lit(""))
        own = own.withColumn("children", F.coalesce("children", F.lit("")))
        return own.select("file", "parent_idx", "idx", xml.alias("xml"))

    conf = lambda name: _attribute(name, F.floor(F.col("conf") * 100 + 0.5) / 100)
    inner = level("glyph", None, _element("Glyph", F.concat(_attribute("CONTENT", F.col("content")), _box(), conf("GC")), F.lit("")))
    inner = inner.unionByName(level("alternative", None, F.concat(F.lit("<ALTERNATIVE"), _attribute("PURPOSE", F.col("kind")), F.lit(">"), escaped(F.col("content")), F.lit("</ALTERNATIVE>"))))
    tag = F.when(F.col("kind") == "word", "String").when(F.col("kind") == "space", "SP").otherwise("HYP")
    content = _attribute("CONTENT", F.when(F.col("kind") != "space", F.col("content")))
    word = F.when(F.col("kind") == "word", F.concat(conf("WC"), _attribute("LANG", F.col("lang")), _attribute("SUBS_TYPE", F.col("subs_type")), _attribute("SUBS_CONTENT", F.col("subs_content")))).otherwise("")
    tokens = level("token", inner, _element(tag, F.concat(content, _box(), word), F.col("children")))
    at = F.concat_ws(" ", F.concat_ws(",", "x1", "y1"), F.concat_ws(",", "x2", "y2"))
    lines = level("line", tokens, _element("TextLine", F.concat(_attribute("BASELINE", at), _box(), _attribute("LANG", F.col("lang"))), F.col("children")))
    refs = F.concat(_attribute("ID", F.col("id")), _box(), _attribute("STYLEREFS", F.col("style_refs")), _attribute("TAGREFS", F.col("tag_refs")), _attribute("LANG", F.col("lang")))
    kind = F.when(F.col("kind") == "composed", "ComposedBlock").when(F.col("kind") == "illustration", "Illustration").otherwise("TextBlock")
    block = _element(kind, refs, F.col("children"))
    composed = nodes.filter("node = 'block' and kind = 'composed'").select("file", F.col("idx").alias("parent_idx"))
    inside = level("block", lines, block)
    nested = inside.join(composed, ["file", "parent_idx"], "left_semi")
    top = nodes.filter("node = 'block' and kind = 'composed'").join(folded(nested, "children"), ["file", "idx"], "left").withColumn("children", F.coalesce("children", F.lit(""))).select("file", "parent_idx", "idx", block.alias("xml"))
    flat = inside.join(composed, ["file", "parent_idx"], "left_anti").join(top.select("file", "idx"), ["file", "idx"], "left_anti")
    attributes = F.concat(_attribute("ID", F.col("page_id")), _attribute("WIDTH", F.col("w")), _attribute("HEIGHT", F.col("h")), _attribute("PHYSICAL_IMG_NR", F.col("page_nr")), _attribute("ROTATION", F.col("rotation")), _attribute("LANG", F.col("lang")), conf("PC"))
    page = level("page", flat.select("file", "parent_idx", "idx", "xml").unionByName(top), _element("Page", attributes, _element("PrintSpace", F.lit(""), F.col("children"))))
    parts = F.array_sort(F.collect_list(F.struct("idx", "xml")))
    body = page.groupBy("file").agg(F.concat_ws("", F.transform(parts, lambda x: x["xml"])).alias("body"))
    body = body.join(header_xml(headers), "file", "left") if headers is not None else body.withColumn("head", F.lit(""))
    start = F.lit('<?xml version="1.0" encoding="UTF-8"?><alto xmlns="http://www.loc.gov/standards/alto/ns-v4#">')
    return body.select("file", F.concat(start, F.coalesce("head", F.lit("")), F.lit("<Layout>"), "body", F.lit("</Layout></alto>")).alias("xml"))
