"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target from its weight, at most ``most_copies`` times its
size. Every document of the source then has the same real number of copies,
target / size: a whole part, and a fraction to round. Fractions are rounded in
pairs: mass (fraction times size) moves from one document to the other until
one of the two fractions is 0 or 1; which way is drawn so that each keeps its
expectation. The total mass stays, so a source misses its target by less than
its last document.

Pairs meet in a tree. A bucket of about ``FAN`` documents is reduced to one
residual inside one row of arrays; the residuals of about ``FAN`` buckets meet
in the next level, until each source has one. Buckets are counted from each
source's rows, so a hot source gets more buckets, not larger ones. All of it is
DataFrame functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, group_join, partitions, table

WEIGHTS = (3, 1, 2)
SHARE, MOST_COPIES = 1.5, 2
#: Documents or residuals that meet in one bucket, on average.
FAN = 256
SEED = 9


def words_in(column: str) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null has none. Native."""
    # a word starts where a character that is none follows the start or a space
    squeezed = F.translate(F.coalesce(F.col(column), F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(squeezed, " "), lambda w: w != "")).cast("long")


def row_identity() -> Column:
    """With doc_id, names a row by its text; equal rows share it."""
    return F.xxhash64("text", "doc_id")


#: Equal rows are numbered in blocks of so many.
TURNS = 10_000


def numbered(sized: DataFrame) -> DataFrame:
    """Adds ``turn``, which counts equal rows from 0, so that they fall into different buckets.

    Equal rows are counted with map-side sums and dealt out again in blocks,
    so no window gathers them; rows that differ have turn 0 on every run.
    """
    counted = cut(sized.groupBy(*sized.columns).agg(F.count("*").alias("_m")))
    most = counted.agg(F.max("_m")).first()[0] or 0
    if most <= TURNS:
        return counted.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1))).drop("_m")
    blocks = counted.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_m") - 1) / TURNS)))).repartition(partitions(sized.sparkSession), "doc_id", "key", "_b")
    return blocks.withColumn("turn", F.explode(F.sequence(F.col("_b") * TURNS, F.least(F.col("_m"), (F.col("_b") + 1) * TURNS) - 1))).drop("_m", "_b")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """``source, source_size, n, target`` from ``source, size``.

    Sources by code point, null last, take the weights in turn. What exceeds
    ``most`` times a source's size is shared among the others by weight until
    none is above: with sources in order of most * size / weight, the first
    ones are full and the rest share by weight. One row per source is ordered
    in one task: sources are names of collections, up to some millions.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    turn = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    totals = totals.withColumn("w", weight).withColumn("cap", F.col("source_size") * float(most))
    by_room = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    upto = by_room.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * float(share) - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / F.sum("w").over(rest)
    totals = totals.withColumn("level", level)
    # the level at the first source that it does not fill holds; further on it only falls
    totals = totals.withColumn("level", F.max(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))).over(everything))
    return totals.select("source", "source_size", "n", F.least(F.coalesce(F.col("level") * F.col("w"), F.col("cap")), "cap").alias("target"))


def _uniform(x: Column, y: Column) -> Column:
    """A draw in [0, 1) that depends on the two documents alone."""
    bits = F.shiftrightunsigned(F.xxhash64(x["id"], y["id"], x["key"], y["key"], F.lit(SEED)), 11)
    return bits.cast("double") / float(1 << 53)


def _pivot(x: Column, y: Column) -> Column:
    """struct(done, left): one of the two with fraction 0 or 1, and the other."""
    up = F.least((1.0 - x["p"]) * x["size"], y["p"] * y["size"])  # mass that y can give to x
    down = F.least(x["p"] * x["size"], (1.0 - y["p"]) * y["size"])
    drawn = F.when(up + down <= 0, 0.0).when(_uniform(x, y) * (up + down) < down, up).otherwise(-down)
    x_gives = (1.0 - x["p"]) * x["size"] <= y["p"] * y["size"]  # x fills up before y is empty
    y_gives = x["p"] * x["size"] <= (1.0 - y["p"]) * y["size"]  # x is empty before y is full
    x_done = (drawn > 0) & x_gives | (drawn < 0) & y_gives | (drawn == 0) & ((x["p"] <= 0) | (x["p"] >= 1))

    def moved(d: Column, mass: Column, done: Column, full: Column) -> Column:
        p = F.when(done, F.when(full, 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), d["p"] + mass / d["size"])))
        return F.struct(d["id"].alias("id"), d["key"].alias("key"), d["size"].alias("size"), F.when(drawn == 0, d["p"]).otherwise(p).alias("p"))

    a, b = moved(x, drawn, x_done, drawn > 0), moved(y, -drawn, ~x_done, drawn < 0)
    return F.struct(F.when(x_done, a).otherwise(b).alias("done"), F.when(x_done, b).otherwise(a).alias("left"))


def _reduced(items: Column) -> Column:
    """One round over an array: struct(done: array, left: array of half the length)."""
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(items) / 2).cast("int") - 1), lambda i: _pivot(F.get(items, 2 * i), F.get(items, 2 * i + 1)))
    odd = F.slice(items, F.size(items), F.size(items) % 2)
    return F.transform(F.array(pairs), lambda p: F.struct(F.transform(p, lambda t: t["done"]).alias("done"), F.concat(F.transform(p, lambda t: t["left"]), odd).alias("left")))[0]


def _rounds(df: DataFrame) -> DataFrame:
    """``source, bucket, items`` to ``done`` and ``left`` of at most one item, by rounds inside the row.

    A row's items halve each round, so the number of rounds follows the largest
    bucket, a scalar that is read before.
    """
    longest = df.agg(F.max(F.size("items"))).first()[0] or 1
    out = df.select("source", "bucket", F.struct(F.slice("items", 1, 0).alias("done"), F.col("items").alias("left")).alias("s"))
    step = lambda s: F.when(F.size(s["left"]) < 2, s).otherwise(F.transform(F.array(_reduced(s["left"])), lambda r: F.struct(F.concat(s["done"], r["done"]).alias("done"), r["left"].alias("left")))[0])
    rounds = math.ceil(math.log2(longest)) if longest > 1 else 0
    folded = F.aggregate(F.sequence(F.lit(0), F.lit(rounds)), F.col("s"), lambda s, _: step(s))
    return out.select("source", "bucket", folded.alias("s")).select("source", "bucket", "s.done", "s.left")


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """``doc_id, key, source, size, source_size, target, taken`` for every row of ``docs``; key is ``row_identity``.

    ``docs`` has ``doc_id, text, source``; other columns are ignored. size
    counts words, taken is copies times size. Reruns agree: draws depend on
    ids and texts. A null source is one source. Rows without words are never
    taken; equal rows are rounded one by one and may differ in copies. No rows
    give none.
    """
    sized = cut(docs.select("doc_id", "source", words_in("text").alias("size"), row_identity().alias("key")))
    targets = cut(source_targets(sized, weights, share, most))
    both = group_join(numbered(sized), targets, ["source"])
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    both = both.withColumn("ratio", ratio).withColumn("whole", F.floor(F.col("ratio") + 1e-12)).withColumn("p", F.greatest(F.lit(0.0), F.col("ratio") - F.col("whole")))
    meant = both.select("source", "doc_id", "key", "turn", "size", "p", F.greatest(F.lit(1), F.ceil(F.col("n") / FAN)).alias("buckets"))
    rounding = meant.filter((F.col("size") > 0) & (F.col("p") > 1e-12))

    item = F.struct(F.col("doc_id").alias("id"), "key", F.col("size").cast("double").alias("size"), "p")
    level = rounding.select("source", F.pmod(F.xxhash64("doc_id", "key", "turn", F.lit(SEED)), F.col("buckets")).alias("bucket"), F.col("buckets"), item.alias("item"))
    most_buckets = targets.agg(F.max(F.ceil(F.col("n") / FAN))).first()[0] or 0
    done = None
    while True:
        # sorted, so that reruns pair the same documents; equal rows are alike
        grouped = level.groupBy("source", "bucket", "buckets").agg(F.array_sort(F.collect_list("item")).alias("items"))
        sizes = grouped.select("source", F.struct("bucket", "buckets").alias("bucket"), "items")
        reduced = cut(_rounds(sizes))
        settled = reduced.select("source", F.explode("done").alias("d"))
        done = settled if done is None else done.unionByName(settled)
        left = reduced.select("source", "bucket.*", F.explode("left").alias("item"))
        if most_buckets <= 1:
            # a source's last fraction goes to the nearer end: off by half a document at most
            last = left.select("source", F.struct("item.id", "item.key", "item.size", F.when(F.col("item.p") >= 0.5, 1.0).otherwise(0.0).alias("p")).alias("d"))
            done = done.unionByName(last)
            break
        level = left.select("source", F.floor(F.col("bucket") / FAN).cast("long").alias("bucket"), F.ceil(F.col("buckets") / FAN).alias("buckets"), "item")
        most_buckets = math.ceil(most_buckets / FAN)
    rounded = done.select("source", F.col("d.id").alias("doc_id"), F.col("d.key").alias("key"), F.col("d.size").cast("long").alias("size"), F.when(F.col("d.p") >= 0.5, 1).otherwise(0).alias("more"))
    plain = meant.filter(~((F.col("size") > 0) & (F.col("p") > 1e-12))).select("source", "doc_id", "key", "size", F.lit(0).alias("more"))
    out = group_join(rounded.unionByName(plain), targets, ["source"])
    whole = F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0) + 1e-12)
    return out.select("doc_id", "key", "source", "size", "source_size", "target", ((whole + F.col("more")) * F.col("size")).cast("long").alias("taken"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken")
