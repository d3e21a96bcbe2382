"""Glyph models: class lists, training, top predictions, accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def class_index(glyphs: DataFrame, simplify=lambda c: c) -> DataFrame:
    """``glyph, class_idx`` of distinct simplified glyphs in order; an alphabet is small."""
    distinct = glyphs.select(simplify(F.col("glyph")).alias("glyph")).distinct()
    return distinct.withColumn("class_idx", F.row_number().over(Window.orderBy("glyph")) - 1)


def with_class(glyphs: DataFrame, classes: DataFrame) -> DataFrame:
    """Adds ``class_idx``; unknown glyphs get the number of classes."""
    return glyphs.join(classes.select("glyph", "class_idx"), "glyph", "left").withColumn("class_idx", F.coalesce("class_idx", classes.agg(F.count("*").cast("int")).scalar()))


def train_perceptron(rows: DataFrame, features: str, label: str, classes: int, hidden: tuple[int, ...] = (128, 64), epochs: int = 10, seed: int = 1):
    """A multilayer perceptron on nine tenths of ``rows``; returns it and its accuracy on the rest."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector

    data = rows.select(array_to_vector(F.col(features).cast("array<double>")).alias("features"), F.col(label).cast("double").alias("label"))
    width = len(rows.select(features).first()[0])
    train, rest = data.randomSplit([0.9, 0.1], seed)
    model = MultilayerPerceptronClassifier(layers=[width, *hidden, classes], maxIter=epochs, seed=seed, blockSize=128).fit(train)
    hits = model.transform(rest).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    return model, hits


def top_predictions(scores: Column, k: int) -> Column:
    """The k best classes of an array of scores: array<struct<cls, prob>>, by softmax."""
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + F.exp(x.cast("double")))
    ranked = F.slice(F.array_sort(F.transform(scores, lambda x, i: F.struct((-x.cast("double")).alias("s"), i.alias("cls")))), 1, k)
    return F.transform(ranked, lambda x: F.struct(x["cls"].alias("cls"), (F.exp(-x["s"]) / total).alias("prob")))
