"""Language ID by a string kernel with Nyström landmarks.

Two texts are compared by the character n-grams of one to three characters
that are present in both (a blended-spectrum presence kernel, normalised by
the geometric mean of their numbers). n-grams are hashed to ``CELLS`` cells,
so a text is a row of bits. Landmark texts span the kernel's feature space;
one-versus-rest ridge regression in it gives a weight per language. Scoring
multiplies a batch of rows with the landmarks' matrix, then with the weights.

Landmarks and training texts are a bounded sample: at most ``PER_LANG`` texts
of each of the ``MOST_LANGS`` most frequent languages, the first by hash of
their ids; landmarks are at most ``MOST_LANDMARKS`` in all, 64 MB.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, crc_bucket, cut, table

PER_LANG, LANDMARKS, RIDGE = 250, 48, 0.1
MOST_LANGS, MOST_LANDMARKS = 200, 2048
BITS, SPECTRUM = 13, 3
CELLS = 1 << BITS
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")


def presence(texts: list[str | None]) -> np.ndarray:
    """A row of CELLS for each text, 1 where an n-gram of the whole text falls."""
    out = np.zeros((len(texts), CELLS), dtype=np.float32)
    with np.errstate(over="ignore"):
        for row, text in zip(out, texts):
            if not text:
                continue
            codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            gram = codes
            for n in range(1, SPECTRUM + 1):
                if n > 1:
                    gram = gram[:-1] * np.uint32(0x01000193) + codes[n - 1 :]
                if not len(gram):
                    break
                row[((gram + np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)] = 1
    return out


@dataclass
class Kernel:
    """Landmarks, their number of cells, and weights from kernel values to languages."""

    langs: list[str]
    landmarks: np.ndarray
    sizes: np.ndarray
    weights: np.ndarray
    offset: np.ndarray

    def kernel(self, rows: np.ndarray) -> np.ndarray:
        sizes = np.maximum(rows.sum(1), 1)
        return rows @ self.landmarks.T / np.sqrt(sizes[:, None] * self.sizes[None, :])

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        at = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
        if at and self.langs:
            found = self.kernel(presence([texts[i] for i in at])) @ self.weights + self.offset
            share = np.exp(4 * (found - found.max(1, keepdims=True)))
            share /= share.sum(1, keepdims=True)
            for i, best, s in zip(at, share.argmax(1), share.max(1)):
                langs[i], scores[i] = self.langs[best], float(min(1.0, s))
        return langs, scores


def fit(rows: np.ndarray, langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Kernel:
    """``landmarks`` rows (of ``presence``) of each language span the space; all rows train the regression."""
    names = sorted(set(langs))
    if not names:
        return Kernel([], np.zeros((0, CELLS), np.float32), np.zeros(0, np.float32), np.zeros((0, 0), np.float32), np.zeros(0, np.float32))
    landmarks = max(1, min(landmarks, MOST_LANDMARKS // len(names)))
    taken = [i for name in names for i in [j for j, x in enumerate(langs) if x == name][:landmarks]]
    marks = rows[taken]
    made = Kernel(names, marks, np.maximum(marks.sum(1), 1), np.zeros((len(taken), len(names)), np.float32), np.zeros(len(names), np.float32))
    values, vectors = np.linalg.eigh(made.kernel(marks).astype(np.float64))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    x = made.kernel(rows).astype(np.float64) @ root
    y = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    # every language weighs the same, however many texts it has
    weight = np.array([1.0 / langs.count(name) for name in langs])[:, None]
    weight /= weight.mean()
    middle, aim = (weight * x).mean(0), (weight * y).mean(0)
    solved = np.linalg.solve((weight * (x - middle)).T @ (x - middle) + ridge * np.eye(x.shape[1]), (weight * (x - middle)).T @ (y - aim))
    made.weights = (root @ solved).astype(np.float32)
    made.offset = (aim - middle @ solved).astype(np.float32)
    return made


def train_language(docs: DataFrame, per_lang: int = PER_LANG, most_langs: int = MOST_LANGS) -> Kernel:
    """Learn from ``docs`` (``doc_id, text, lang``) with a language and a letter in the text.

    Of each of the ``most_langs`` most frequent languages the ids of least
    hash are drawn before any text is touched: a hash filter that follows the
    language's count keeps some twice as many as are needed, whatever a
    language's share of all rows; texts of these ids alone are read, whole,
    and leave the executors as rows of bits. Of a repeated id the first text
    in order counts.
    """
    known = docs.filter("lang is not null and text is not null").select("doc_id", "lang", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("_h"))
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs)
    share = F.least(F.lit(1.0), F.lit(2.0 * per_lang + 50) / F.col("n"))
    drawn = known.join(F.broadcast(counts.select("lang", share.alias("_share"))), "lang").filter(F.pmod("_h", F.lit(1 << 40)) < F.col("_share") * float(1 << 40)).drop("_share").distinct()
    # about twice per_lang ids of each language: the first of them
    first = Window.partitionBy("lang").orderBy("_h", "doc_id")
    drawn = cut(drawn.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= 2 * per_lang).select("lang", "_h", "_n", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id")))
    texts = docs.filter("text is not null").select("lang", "text", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"))
    texts = texts.join(F.broadcast(drawn), ["lang", "_id"]).groupBy("lang", "_n").agg(F.min("text").alias("text"))

    def bits(batches):
        for batch in chunks(batches):
            lettered = [bool(_LETTER.search(t)) for t in batch.column(2).to_pylist()]
            batch = batch.filter(pa.array(lettered))
            rows = np.packbits(presence(batch.column(2).to_pylist()).astype(bool), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in rows], pa.binary())], names=["lang", "n", "bits"])

    # at most 2 * per_lang * most_langs rows of one kilobyte
    found = sorted(tuple(r) for r in texts.mapInArrow(bits, "lang string, n int, bits binary").collect())
    rows, langs = [], []
    for lang, _, raw in found:
        if len(langs) < per_lang or langs[-per_lang] != lang:  # sorted by language
            rows.append(np.unpackbits(np.frombuffer(bytes(raw), dtype=np.uint8)).astype(np.float32))
            langs.append(lang)
    return fit(np.stack(rows) if rows else np.zeros((0, CELLS), np.float32), langs)


def identify_language(docs: DataFrame, kernel: Kernel) -> DataFrame:
    """``docs`` (with ``text``; other columns pass through) plus ``lang_pred, score`` (replaced if there).

    A null text or one without letters is "und" with score 0; so is every
    text if nothing was learned.
    """
    # plain arrays: a broadcast object's class would have to be importable on executors
    held = docs.sparkSession.sparkContext.broadcast((kernel.langs, kernel.landmarks, kernel.sizes, kernel.weights, kernel.offset))
    own = [c for c in docs.columns if c not in ("lang_pred", "score")]
    at = own.index("text")

    def predict(batches):
        kernel = Kernel(*held.value)
        for batch in chunks(batches):
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                langs, scores = kernel.predict(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*own, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*own).schema)
    return docs.select(*own).mapInArrow(predict, f"{fields}, lang_pred string, score double")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    kernel = train_language(docs.filter(crc_bucket("doc_id", 3) != 1))
    found = identify_language(docs.select("doc_id", "text"), kernel)
    return found.select("doc_id", (crc_bucket("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
