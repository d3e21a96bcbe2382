"""Toxicity by a factorization machine over hashed terms.

A text's terms are its distinct lower-cased words and their first four and
five characters, as 64-bit hashes, so stems count in languages that inflect.
The terms that tell the classes apart best in the training sample are the
model's inputs; a weight for each and a vector for each pair of terms that
meet in a text (the dot product of their vectors) add up to the logit. So an
insult and a mention of a group can count for more together than apart.

The model is trained on the driver from a sample of at most ``MOST_TOXIC`` and
``MOST_CLEAN`` labelled documents, the first by hash of their ids; its size is
fixed, and so is what is broadcast. The two limits change the ratio of the
classes, so the bias is moved to the ratio of all labels: a score means the
same at every size of input. Scoring is one narrow pass.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, crc_bucket, cut, hashes64, table

MOST_TOXIC, MOST_CLEAN = 3000, 6000
TERMS, FACTORS = 4096, 8
#: Terms of less chi squared are left to chance and left out.
LEAST_CHI = 15.0
EPOCHS, BATCH, RATE, DECAY, SEED = 25, 256, 0.02, 1e-4, 7
THRESHOLD = 0.3

_WORD = re.compile(r"\w+")


def term_hashes(text: str | None) -> np.ndarray:
    """Distinct hashes of a whole text's terms."""
    words = set(_WORD.findall(text.lower())) if text else set()
    terms = {f"={w}" for w in words} | {f"4{w[:4]}" for w in words if len(w) > 4} | {f"5{w[:5]}" for w in words if len(w) > 5}
    return hashes64([t.encode("utf-8", "surrogatepass") for t in terms])


@dataclass
class Machine:
    """Terms (sorted hashes) with weights and vectors; logits of sets of terms."""

    terms: np.ndarray
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def inputs(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.terms):
            return np.empty(0, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.sort(at[self.terms[at] == hashes])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Scores of whole texts: all their terms are looked up and summed together."""
        found = [term_hashes(t) for t in texts]
        sizes = np.array([len(h) for h in found], dtype=np.int64)
        hashes = np.concatenate([*found, np.empty(0, dtype=np.uint64)])
        known = np.minimum(np.searchsorted(self.terms, hashes), max(len(self.terms) - 1, 0))
        hits = np.flatnonzero(self.terms[known] == hashes) if len(self.terms) else np.empty(0, dtype=np.int64)
        at, doc = known[hits], np.repeat(np.arange(len(texts)), sizes)[hits]
        order = np.lexsort((at, doc))  # sums in one order, whatever the order of a set
        at, doc = at[order], doc[order]
        return 1 / (1 + np.exp(-np.clip(self.logits(at, doc, len(texts)), -40, 40)))

    def logits(self, at: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """Of ``n`` documents, from pairs of a term's place and its document."""
        pairs = np.zeros(n)
        for v in self.vectors.T:
            pairs += np.bincount(doc, v[at], n) ** 2 - np.bincount(doc, v[at] ** 2, n)
        return self.bias + np.bincount(doc, self.weights[at], n) + 0.5 * pairs

    def logit(self, at: np.ndarray) -> float:
        return float(self.logits(at, np.zeros(len(at), dtype=np.int64), 1)[0])

    def score(self, text: str | None) -> float:
        return float(self.scores([text])[0])


def fit(terms: np.ndarray, inputs: list[np.ndarray], labels: np.ndarray, factors: int = FACTORS) -> Machine:
    """Logistic loss by Adam in small batches; the same inputs give the same model."""
    rng = np.random.default_rng(SEED)
    rate = np.clip(labels.mean() if len(labels) else 0.0, 1e-3, 1 - 1e-3)
    n = len(terms)
    params = [np.array([np.log(rate / (1 - rate))]), np.zeros(n), rng.normal(0, 0.01, (n, factors))]
    if not len(labels) or labels.min() == labels.max() or not n:
        return Machine(terms, float(params[0][0]), params[1], params[2])
    m, s, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for i in range(0, len(order), BATCH):
            rows = order[i : i + BATCH]
            sizes = np.array([len(inputs[r]) for r in rows])
            at, doc = np.concatenate([inputs[r] for r in rows]), np.repeat(np.arange(len(rows)), sizes)
            v = params[2][at]
            total, squares, linear = np.zeros((len(rows), factors)), np.zeros((len(rows), factors)), np.zeros(len(rows))
            np.add.at(total, doc, v)
            np.add.at(squares, doc, v**2)
            np.add.at(linear, doc, params[1][at])
            z = params[0][0] + linear + 0.5 * (total**2 - squares).sum(1)
            g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[rows]) / len(rows)
            grads = [np.array([g.sum()]), DECAY * params[1], DECAY * params[2]]
            np.add.at(grads[1], at, g[doc])
            np.add.at(grads[2], at, g[doc, None] * (total[doc] - v))
            step += 1
            for p, d, a, b in zip(params, grads, m, s):
                a += 0.1 * (d - a)
                b += 0.001 * (d * d - b)
                p -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return Machine(terms, float(params[0][0]), params[1], params[2])


def train_toxicity(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN, terms: int = TERMS) -> Machine:
    """Learn from ``labels`` (``doc_id, toxic``) and the texts of ``docs``.

    Null labels and ids are left out; of differing labels of an id the highest
    counts, of its texts the first in order. With no labels, or of one class only, every score is the same.
    """
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = known.withColumn("_h", F.xxhash64("doc_id"))
    taken = [known.filter(F.col("toxic") == c).orderBy("_h", "doc_id").limit(most) for c, most in ((1, most_toxic), (0, most_clean))]
    sample = taken[0].unionByName(taken[1]).select("doc_id", "toxic")
    # at most most_toxic + most_clean ids are broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    # one text of an id, however often the id is repeated
    texts = cut(texts.groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text")))

    def count(batches):
        held = {0: [], 1: []}
        for batch in chunks(batches):
            for label, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                held[label].append(term_hashes(text))
        for label, parts in held.items():
            if parts:
                h, n = np.unique(np.concatenate(parts), return_counts=True)
                n, zero = pa.array(n), pa.array(np.zeros(len(n), dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), n if label else zero, zero if label else n], names=["h", "a", "b"])

    held = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    # how much larger a part of the toxic labels than of the clean ones is learned from, as a logarithm
    favour = float(np.log(min(held[1], most_toxic) / held[1]) - np.log(min(held[0], most_clean) / held[0])) if len(held) == 2 and most_toxic and most_clean else 0.0
    sums = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pos, neg = sums.get(1, 0), sums.get(0, 0)
    vocabulary = np.empty(0, dtype=np.uint64)
    if pos and neg:
        counts = texts.mapInArrow(count, "h long, a long, b long").groupBy("h").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).filter("a + b >= 3")
        # how far a term's share of toxic documents is from the sample's, as chi squared
        chi = (F.col("a") * neg - F.col("b") * pos) ** 2 / ((F.col("a") + F.col("b")) * (pos + neg - F.col("a") - F.col("b") + 1.0)) * ((pos + neg) / (pos * neg))
        # only evidence for toxicity: a long text's many harmless words must not outvote a few insults
        telling = counts.withColumn("chi", chi).filter((F.col("a") * neg > F.col("b") * pos) & (F.col("chi") >= LEAST_CHI))
        chosen = telling.orderBy(F.desc("chi"), "h").limit(terms).select("h").collect()
        vocabulary = np.sort(np.array([r["h"] for r in chosen], dtype=np.int64).view(np.uint64))
    empty = Machine(vocabulary, 0.0, np.zeros(len(vocabulary)), np.zeros((len(vocabulary), 1)))

    def describe(batches):
        for batch in chunks(batches):
            found = [empty.inputs(term_hashes(t)).astype(np.int32) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f.tobytes() for f in found], pa.binary())], names=["doc_id", "toxic", "at"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    rows = sorted(texts.mapInArrow(describe, f"doc_id {kind}, toxic int, at binary").collect(), key=lambda r: (str(r["doc_id"]), r["toxic"], bytes(r["at"])))
    machine = fit(vocabulary, [np.frombuffer(bytes(r["at"]), dtype=np.int32) for r in rows], np.array([r["toxic"] for r in rows], dtype=np.float64))
    machine.bias -= favour
    return machine


def score_toxicity(docs: DataFrame, machine: Machine) -> DataFrame:
    """``docs`` (with ``text``; other columns pass through) plus ``score``, 0 to 1, of every whole text.

    A column named ``score`` is replaced. Null and empty texts get the score
    of a text without terms.
    """
    # plain arrays: a broadcast object's class would have to be importable on executors
    held = docs.sparkSession.sparkContext.broadcast((machine.terms, machine.bias, machine.weights, machine.vectors))
    own = [c for c in docs.columns if c != "score"]
    at = own.index("text")

    def score(batches):
        machine = Machine(*held.value)
        for batch in chunks(batches):
            found = machine.scores(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*own, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*own).schema)
    return docs.select(*own).mapInArrow(score, f"{fields}, score double")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(crc_bucket("doc_id", 4) != 2)
    scored = score_toxicity(docs, train_toxicity(docs, labels))
    return scored.select("doc_id", (crc_bucket("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
