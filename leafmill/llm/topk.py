"""Exact top-k inner products by a three-phase uniform threshold.

A candidate's score is the sum of its scores in two lists: its components are
split into a coarse digit and a fine one (``base`` * coarse + fine), and each
list scores one of them. Phase 1 gathers, for each query, every task's best
entries of the coarse list with their whole scores, and how much the fine list
can add at most; the k-th best whole score is a safe bound. Phase 2 broadcasts
the cutoff that follows for the coarse list, one number per query; no entry of
the fine list alone can reach it. Each task collects the coarse entries at or
above the cutoff: all others are out, whatever their fine score. Phase 3
resolves the missing fine scores of these entries, and of no others, exactly.

Scores are whole numbers and computed as such. What the fine list can add is
bounded by lengths (Cauchy and Schwarz): that of the query times that of the
row's fine digits, so a row far from a query is settled by one short product.
Queries are held in groups of a fixed size that are broadcast; of each block of
rows only k entries per query leave a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

K, SCALE, EVERY = 5, 256, 50
#: Coarse digits are multiples of this.
BASE = 8
#: Components of the queries that are broadcast together, 8 bytes each; queries and rows that are multiplied at once.
BLOCK_VALUES, SOME_QUERIES, ROWS = 4 << 20, 1024, 2048


def _integers(vectors: DataFrame, scale: int) -> DataFrame:
    """``vec_id, v``: usable vectors only."""
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double"))
    usable = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()
    usable &= F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.filter(F.coalesce(usable, F.lit(False))).select("vec_id", whole.alias("v"))


def _matrix(column, dims: int) -> np.ndarray:
    """Rows of whole numbers, shorter vectors filled with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(sizes), dims))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T, exact: by floats where every sum stays below what they hold exactly, else by integers."""
    bound = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1])
    if bound < 2**24:
        return a.astype(np.float32) @ b.astype(np.float32).T
    return a @ b.T if bound < 2**53 else a.astype(np.int64) @ b.astype(np.int64).T


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row products as int64."""
    bound = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1])
    if bound < 2**53:
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    return (a.astype(np.int64) * b.astype(np.int64)).sum(1)


def _merge(best, q, ids, totals, n: int, k: int):
    """The k best (by score, then smaller id) entries of each query, of those held and new ones."""
    if best is not None:
        q, ids, totals = (np.concatenate(x) for x in zip(best, (q, ids, totals)))
    order = np.lexsort((ids, -totals, q))
    q, ids, totals = q[order], ids[order], totals[order]
    first = np.searchsorted(q, np.arange(n))
    keep = np.arange(len(q)) - first[q] < k
    return q[keep], ids[keep], totals[keep]


def _phases(rows: DataFrame, queries: pa.Table, dims: int, k: int, base: int, touched=None) -> DataFrame:
    """Top k of each query of one group, in three phases; ``touched`` is an accumulator of resolved entries."""
    spark = rows.sparkSession
    held = spark.sparkContext.broadcast((queries["vec_id"].to_numpy(), _matrix(queries["v"].combine_chunks(), dims)))
    n = queries.num_rows

    def blocks(batches):
        """Ids, vectors, coarse digits and the lengths of the fine ones."""
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                x = _matrix(part.column(1), dims)
                coarse = np.floor((x + base // 2) / base)
                yield part.column(0).to_numpy(), x, coarse, np.sqrt(((x - base * coarse) ** 2).sum(1))

    def entries(vec, ids, q, x, s, at, row):
        """Whole scores of coarse entries: the fine score is added to that of the coarse list."""
        other = vec[row] != ids[at]
        at, row = at[other], row[other]
        coarse = np.floor((x[row] + base // 2) / base)
        return at, row, base * s[at, row].astype(np.int64) + _dots(q[at], x[row] - base * coarse)

    def gather(batches):
        """Per query: the best coarse entries with whole scores, and the length of the largest fine digits."""
        ids, q = held.value
        best, longest = None, 0.0
        for vec, x, coarse, fine in blocks(batches):
            longest = max(longest, float(fine.max()))
            for a in range(0, n, SOME_QUERIES):
                s = _product(q[a : a + SOME_QUERIES], coarse)
                m = min(k + 1, s.shape[1])  # one may be the query itself
                top = np.argpartition(-s, m - 1, axis=1)[:, :m]
                at, row, total = entries(vec, ids[a:], q[a:], x, s, np.repeat(np.arange(len(s)), m), top.ravel())
                best = _merge(best, at + a, vec[row], total, n, k)
        if best is not None:
            yield pa.RecordBatch.from_arrays([pa.array(best[0].astype(np.int32)), pa.array(best[2]), pa.array(np.full(len(best[0]), longest))], names=["q", "score", "fine"])

    seen = rows.mapInArrow(gather, "q int, score long, fine double")
    # k scores per query reach the driver: bounded by the group
    kth = seen.groupBy("q").agg(F.element_at(F.slice(F.array_sort(F.collect_list(-F.col("score"))), 1, k), -1).alias("least"), F.count("*").alias("m")).filter(F.col("m") >= k).select("q", (-F.col("least")).alias("least")).toArrow()
    bound = np.full(n, np.iinfo(np.int64).min)
    bound[kth["q"].to_numpy()] = kth["least"].to_numpy()
    cutoff = spark.sparkContext.broadcast(bound)

    def resolve(batches):
        ids, q = held.value
        bound = cutoff.value
        known = bound > np.iinfo(np.int64).min
        lengths = np.sqrt((q**2).sum(1))
        best = None
        for vec, x, coarse, fine in blocks(batches):
            for a in range(0, n, SOME_QUERIES):
                s = _product(q[a : a + SOME_QUERIES], coarse)
                some = slice(a, a + len(s))
                # the cutoff of the coarse list: the bound less what the fine list can add (and one for rounding)
                need = (bound[some, None].astype(np.float64) - lengths[some, None] * fine[None, :]) / base - 1 - 1e-9 * np.abs(bound[some, None].astype(np.float64))
                at, row = np.nonzero((s >= need) | ~known[some, None])
                if not len(at):
                    continue
                if touched is not None:
                    touched.add(len(at))
                for i in range(0, len(at), 1 << 17):
                    i_at, i_row, total = entries(vec, ids[a:], q[a:], x, s, at[i : i + (1 << 17)], row[i : i + (1 << 17)])
                    reach = total >= bound[i_at + a]
                    best = _merge(best, i_at[reach] + a, vec[i_row[reach]], total[reach], n, k)
        if best is not None and len(best[0]):
            yield pa.RecordBatch.from_arrays([pa.array(ids[best[0]]), pa.array(best[0].astype(np.int32)), pa.array(best[1]), pa.array(best[2])], names=["query_id", "q", "vec_id", "score"])

    found = rows.mapInArrow(resolve, "query_id long, q int, vec_id long, score long")
    ranked = found.groupBy("query_id", "q").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("best"))
    return ranked.select("query_id", F.posexplode("best").alias("pos", "b")).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score"))


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, base: int = BASE, touched=None) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k highest integer inner products in ``vectors``.

    Both have ``vec_id, embedding``; other columns are ignored. A component x
    counts as floor(scale * x). Rows with the query's own vec_id are no
    candidates; ties go to the smaller vec_id; fewer candidates give fewer
    rows. Null ids, null vectors and vectors with a null or non-finite
    component take no part; a shorter vector counts as filled with zeros, and
    an empty one scores 0. A query row that is repeated is answered once for
    each row. Queries beyond one broadcast group make further passes over the
    rows, each of which is bound by its products, not by reading.
    """
    spark = vectors.sparkSession
    rows, asked = _integers(vectors, scale), _integers(queries, scale)
    shape = rows.agg(F.max(F.size("v")).alias("dims")).first()
    n, widest = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    dims = max(shape["dims"] or 0, widest or 0, 1)
    groups = max(1, -(-n * dims // BLOCK_VALUES))
    asked = asked.withColumn("_g", F.pmod(F.xxhash64("vec_id"), F.lit(groups)))
    out = None
    for g in range(groups):  # a group at a time reaches the driver
        part = asked.filter(F.col("_g") == g).select("vec_id", "v").toArrow()
        if part.num_rows:
            found = _phases(rows, part, dims, k, base, touched)
            out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return exact_top_k(vectors, vectors.filter(F.col("vec_id") % EVERY == 0))


ORACLE = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) v from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint score
    from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from s)
select query_id, rank::int rank, vec_id, score from r where rank <= 5
"""
