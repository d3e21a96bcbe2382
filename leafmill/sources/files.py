"""Files in and out: listings, text, lexicons, pairs, reports, archives."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..functions.text import without_extension

IMAGES = r"\.(jpg|jpeg|png)$"
IMAGES_AND_DOCUMENTS = r"\.(pdf|jpg|jpeg|png|tif)$"


def list_files(spark: SparkSession, folder: str, pattern: str, recursive: bool = True, limit: int | None = None) -> DataFrame:
    """``path, length, content`` of files whose name fits anywhere; content is read only where it is used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    found = files.filter(F.element_at(F.split("path", "/"), -1).rlike(pattern)).select("path", "length", "content")
    return found.orderBy("path").limit(limit) if limit is not None else found


def list_images(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    return list_files(spark, folder, IMAGES, recursive)


def layout_key(path: Column, suffix: str = "_alto4.xml") -> Column:
    """The layout file that belongs to an image."""
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit(suffix))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("line"), F.input_file_name().alias("file"))


def read_lexicon(spark: SparkSession, path: str, simplify=lambda c: c, skip_comments: bool = False) -> DataFrame:
    """Distinct entries, one per line, of a text file or all in a folder."""
    lines = spark.read.text(path)
    return (lines.filter("not value like '#%'") if skip_comments else lines).select(simplify(F.col("value")).alias("word")).distinct()


def read_text_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Image and text of a tab-separated file: rows of just two columns with a text."""
    parts = F.split("value", "\t", -1)
    return spark.read.text(path).filter((F.size(parts) == 2) & (parts[1] != "")).select(parts[0].alias("image"), parts[1].alias("text"))


def pdf_pages(files: DataFrame, count, start: int = 1, end: int | None = None) -> DataFrame:
    """One row per page of each file: ``path, page_nr``. ``count(bytes) -> pages`` is the renderer's."""

    def pages(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                n = count(content)
                rows += [(path, p) for p in range(start, min(end or n, n) + 1)]
            yield pd.DataFrame(rows, columns=["path", "page_nr"])

    return files.select("path", "content").mapInPandas(pages, "path string, page_nr int")


def write_report(report: DataFrame, path: str) -> None:
    """Tab-separated, with a header."""
    report.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_texts(docs: DataFrame, path: str, by: str) -> None:
    """Texts as files, in a folder per value of ``by``."""
    docs.select(by, "content").write.mode("overwrite").partitionBy(by).text(path)


def allowed_files(files: DataFrame, names: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Files whose name is listed (column ``name``), if there is a list, and the first ``most`` of them in order."""
    own = F.element_at(F.split("path", "/"), -1)
    found = files if names is None else files.join(names.select(F.col("name").alias("_name")).distinct(), own == F.col("_name"), "left_semi")
    return found if most is None else found.orderBy("path").limit(most)


def with_layouts(images: DataFrame, layouts: DataFrame, suffix: str = "_alto4.xml") -> DataFrame:
    """Images with the layout file of their name: ``path, ..., layout_path, xml``; images without one go."""
    found = layouts.select(F.col("path").alias("layout_path"), F.decode("content", "UTF-8").alias("xml"))
    return images.join(found, layout_key(F.col("path"), suffix) == F.col("layout_path"))


def write_lexicon(lexicon: DataFrame, path: str) -> None:
    """A lexicon as a table that ``read_saved_lexicon`` reads."""
    lexicon.select("word").distinct().write.mode("overwrite").parquet(path)


def read_saved_lexicon(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("word")


def write_text_files(docs: DataFrame, path: str, columns: dict[str, str]) -> None:
    """Texts of each document as rows of ``file, text``, a folder for each suffix in ``columns`` (suffix to column)."""
    parts = [F.struct(F.concat(without_extension(F.col("file")), F.lit(suffix)).alias("file"), F.lit(suffix.strip("._") or "text").alias("kind"), F.col(c).alias("text")) for suffix, c in columns.items()]
    docs.select(F.inline(F.array(*parts))).write.mode("overwrite").partitionBy("kind").json(path)


@F.pandas_udf(BinaryType())
def zipped(files: pd.Series) -> pd.Series:
    """An archive of each row's array of struct(name, content)."""

    def one(parts) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for p in parts if parts is not None else []:
                z.writestr(zipfile.ZipInfo(p["name"]), p["content"])
        return out.getvalue()

    return files.map(one)
