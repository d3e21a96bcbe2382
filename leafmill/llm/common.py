"""What several corpus operators share: shared storage, hashing, batches."""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
MULTIPLIER = U64(0x9E3779B97F4A7C15)
SECOND_MULTIPLIER = U64(0xC2B2AE3D27D4EB4F)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; where none is named, one in the warehouse, which is shared."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")


def cut(df: DataFrame, **measures) -> DataFrame:
    """Compute once and cut the lineage with a reliable checkpoint.

    Rows are counted on the way (``rows_of``), and so are further aggregates
    (``measured``), without a job of their own.

    The files lie in the shared checkpoint folder, so a lost executor loses
    nothing; where spark.cleaner.referenceTracking.cleanCheckpoints is set,
    Spark removes them once the plan is garbage.
    """
    ensure_checkpoint_dir(df.sparkSession)
    seen = Observation()
    out = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in measures.items()]).checkpoint(eager=True)
    out._measured = seen.get
    return out


def tidy(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files and checkpoints that no table needs any more.

    Its cleaner follows the driver's garbage collection, which seldom comes
    where the driver has little to do; until then cut tables' files fill the
    executors' disks. Nothing depends on when this happens.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def measured(df: DataFrame) -> dict:
    """What ``cut`` measured of a table."""
    return df._measured


def rows_of(df: DataFrame) -> int | None:
    """Rows of a table that comes from ``cut``; None for others."""
    return df._measured["rows"] if hasattr(df, "_measured") else None


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A key counts as hot if it holds more than one part in this many of all rows; at most so many keys can.
HOT_PARTS = 1000
#: Fewer rows than this are joined in one task each key whatever their keys: some megabytes.
FEW_ROWS = 50_000
#: Rows of a side that may be broadcast, and their bytes.
SMALL_ROWS, SMALL_BYTES = 200_000, 16 << 20


def hot_keys(df: DataFrame, key, parts: int = HOT_PARTS) -> list[tuple[int, int]]:
    """Hashes of the keys that hold more than 1 / ``parts`` of the rows, and into how many pieces to deal each: powers of 4.

    A frequent-items sketch per task finds them in one narrow pass; at most
    ``parts`` keys can be that frequent, so the list is bounded whatever the input.
    """
    found, total = df.select(key.alias("_h")).agg(F.expr(f"approx_top_k(_h, {parts}, {8 * parts})"), F.count("*")).first()
    pieces = lambda share: next(p for p in (4, 16, 64, 256, 1024) if share <= p or p == 1024)
    return [(r["item"], pieces(r["count"] * parts / total)) for r in found or [] if r["item"] is not None and r["count"] * parts > total]


def skew_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", of: DataFrame | None = None, rows: int | None = None) -> DataFrame:
    """``big`` joined with ``small`` (few rows per key) on ``keys``, hot keys dealt to many tasks.

    Rows of a hot key are dealt into pieces of at most one part in
    ``HOT_PARTS`` of all rows, and the small side's rows of that key go to
    every piece. ``how`` is inner, left, left_semi or left_anti; null keys
    meet nothing. Hot keys are looked for in ``of`` where ``big`` is costly,
    and not at all if ``rows``, the size of ``big`` where it is known, is small.
    """
    if rows is None:
        rows = rows_of(big if of is None else of)
    key = F.xxhash64(*keys)
    hot = hot_keys(big if of is None else of, key) if rows is None or rows > FEW_ROWS else []
    if not hot:
        return big.join(small, keys, how)
    pieces = F.lit(1)
    for p in sorted({p for _, p in hot}):
        pieces = F.when(F.col("_skew_h").isin([h for h, x in hot if x == p]), p).otherwise(pieces)
    one = big.withColumn("_skew_h", key).withColumn("_skew_salt", (F.monotonically_increasing_id() % pieces).cast("int")).drop("_skew_h")
    other = small.withColumn("_skew_h", key).withColumn("_skew_salt", F.explode(F.sequence(F.lit(0), pieces - 1))).drop("_skew_h")
    return one.join(other, [*keys, "_skew_salt"], how).drop("_skew_salt")


def group_join(big: DataFrame, groups: DataFrame, keys: list[str], row_bytes: int = 256, most_rows: int = SMALL_ROWS, how: str = "inner") -> DataFrame:
    """``big`` with the columns of its group; ``groups`` (computed before) has one row per ``keys``, nulls included.

    Groups are counted: few are broadcast, so ``big`` is not exchanged; more
    are joined with hot groups dealt to many tasks.
    """
    names = {k: f"_g_{i}" for i, k in enumerate(keys)}
    marks = lambda df: df.select("*", *[F.to_json(F.array(k)).alias(n) for k, n in names.items()])
    small = marks(groups).drop(*keys)
    n = rows_of(groups)
    if (groups.limit(most_rows + 1).count() if n is None else n) <= min(most_rows, SMALL_BYTES // row_bytes):
        out = marks(big).join(F.broadcast(small), list(names.values()), how)
    else:
        out = skew_join(marks(big), small, list(names.values()), how)
    return out.drop(*names.values())


def crc_bucket(column: str, modulus: int):
    """crc32 of the id as text, modulo; a null id counts as bucket 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % modulus, F.lit(0))


def row_keys() -> tuple:
    """128 bits that name a row by id and text; equal rows share them.

    Operators that send positions back to their documents join on these, so
    repeated ids with other texts stay apart and equal rows are treated alike.
    """
    return (
        F.xxhash64("doc_id", "text").alias("_k1"),
        F.xxhash64(F.lit(7), "text", "doc_id", F.length("text")).alias("_k2"),
    )


def words_of(text: str | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; bytes.split() splits at just these."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def hashes64(items: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, items)), dtype="<u8")


def hashes128(items: list[bytes]) -> np.ndarray:
    """n x 2 unsigned 64-bit halves."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, items)), dtype="<u8").reshape(-1, 2)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that order and buckets look random."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x = x ^ (x >> U64(27))
    x = x * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


def window_hashes(symbols: np.ndarray, width: int, multiplier: np.uint64 = MULTIPLIER) -> np.ndarray:
    """Hash of each run of ``width`` neighbours, built by doubling."""
    n = len(symbols)
    if n < width:
        return np.empty(0, dtype=U64)
    total, done, block, size, power = None, 0, symbols, 1, multiplier
    with np.errstate(over="ignore"):
        while True:
            if width & size:
                if total is None:
                    total, done = block, size
                else:
                    # total covers [i, i+done); append block at i+done
                    m = len(block) - done
                    total = total[:m] * power + block[done:]
                    done += size
            if size * 2 > width:
                break
            block = block[:-size] * power + block[size:]
            size, power = size * 2, power * power
        return mixed(total[: n - width + 1])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def chunks(batches, most_bytes: int = 1 << 20):
    """Record batches cut into slices of bounded text, so memory does not follow batch size."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index("text")
        sizes = np.zeros(batch.num_rows, dtype=np.int64)
        if at >= 0:
            import pyarrow.compute as pc

            sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = (np.cumsum(sizes) - sizes) // most_bytes
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)


def arrow_batch(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def blob_lists(buckets: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Stable order by bucket, and the edges of each bucket in it."""
    order = np.argsort(buckets, kind="stable")
    return order, np.searchsorted(buckets[order], np.arange(n_buckets + 1))
