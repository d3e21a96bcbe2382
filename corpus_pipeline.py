"""The corpus pipeline: documents in, packed sequences out.

Each stage takes the documents that its predecessor kept, decides over all of
them, and returns documents with the columns it got; the last returns pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import crc_bucket, row_keys, skew_join, table
from leafmill.llm.line_dedup import line_dedup
from leafmill.llm.mixing import mix_sources, row_identity
from leafmill.llm.ngram_join import ngram_join
from leafmill.llm.packing import best_fit_packing
from leafmill.llm.toxicity import THRESHOLD, score_toxicity, train_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores under its threshold.

    It learns from the labelled rows that op1 learns from. No documents, or no
    labels, drop nothing.
    """
    labels = table(spark, sf_dir, "labels").filter(crc_bucket("doc_id", 4) != 2)
    scored = score_toxicity(docs.withColumnRenamed("score", "_own_score"), train_toxicity(docs, labels))
    return scored.filter(F.col("score") < THRESHOLD).drop("score").withColumnRenamed("_own_score", "score").select(*docs.columns)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that stand in ten or more of them.

    A document of nothing but such lines stays, with an empty text; n_chars,
    where there is one, follows the text.
    """
    others = {c: f"_in_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    found = line_dedup(docs.withColumnsRenamed(others))
    dropped = F.col("n_dropped") > 0
    new = {c: F.col(n) for c, n in others.items()} | {"text": F.when(dropped, F.col("kept")).otherwise(F.col("text"))}
    if "n_chars" in others:
        new["n_chars"] = F.when(dropped, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(new["n_chars"])
    return found.select([new.get(c, F.col(c)).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one with the smallest id.

    Documents without words are in no class and stay. Of rows that are equal
    in id and text one stays; of rows of a class that share the smallest id
    with other texts one stays, too.
    """
    found = ngram_join(docs)
    first = found.filter("n_shingles > 0 and doc_id <=> component_id").groupBy("class_id").agg(F.min("row_id").alias("row"))
    stays = first.select("row").unionByName(found.filter("n_shingles = 0").select(F.col("row_id").alias("row"))).distinct()
    # own columns travel in a struct, so that no name can clash
    keyed = docs.select(F.struct(*docs.columns).alias("own"), row_keys()[0].alias("row"))
    return skew_join(keyed, stays, ["row"], "left_semi").dropDuplicates(["row"]).select("own.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it: none, once or twice."""
    copies = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("long")
    # rows of one id and text are named by both, a null id too
    mark = lambda key: F.xxhash64(F.isnull("doc_id"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), key).alias("mark")
    taken = mix_sources(docs).groupBy(mark(F.col("key"))).agg(F.sum(copies).alias("copies"), F.count("*").alias("rows")).filter("copies > 0")
    # own columns travel in a struct, so that no name can clash
    own = docs.select(F.struct(*docs.columns).alias("own"), mark(row_identity()))
    met = skew_join(own, taken, ["mark"])
    # equal rows share their copies; what is left over goes to one of them
    again = lambda df, times: df.withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), times))).select("own.*")
    each, rest = F.floor(F.col("copies") / F.col("rows")), F.col("copies") % F.col("rows")
    return again(met.filter(each > 0), each).unionByName(again(met.filter(rest > 0).dropDuplicates(["mark"]), rest))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 1024 tokens."""
    return best_fit_packing(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_common_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("source_mixing", mix),
    ("best_fit_packing", pack),
]

#: The learned toxicity model is beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
