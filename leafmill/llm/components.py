"""Connected components by alternating large and small stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, measured, rows_of, skew_join

#: Edges that a task contracts together.
BLOCK = 1_000_000


def _contract(batches):
    """Each task replaces blocks of its edges by one star per component that it sees in them."""
    parent: dict[int, int] = {}

    def root(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = p
        return x

    def stars():
        pairs = [(x, r) for x in list(parent) if (r := root(x)) != x]
        if pairs:
            u, v = np.array(pairs, dtype=np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > BLOCK:
            yield from stars()
            parent.clear()
    yield from stars()


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` has longs ``a, b``; returns ``id, comp`` for every id in a link, comp the least id reached.

    Each round is two equi-joins on pre-aggregated minima, in which the edges
    of a large star's centre are dealt to many tasks; edges never exceed the
    links. Loops and repeated links change nothing; no links give no rows.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").mapInArrow(_contract, "u long, v long").distinct())
    before, size = None, 2 * rows_of(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = skew_join(both.filter("v > u"), least, ["u"], rows=size).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = skew_join(large, least, ["u"], rows=size)
        edges = cut(small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u > v").distinct(), sum=F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
        now, size = measured(edges), 2 * rows_of(edges)
        if now == before:
            break
        before = now
    stars = edges.select(F.col("u").alias("id"), F.col("v").alias("comp"))
    return stars.unionByName(stars.select(F.col("comp").alias("id"), "comp").distinct())
