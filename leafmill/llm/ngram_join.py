"""N-gram Jaccard join by a grouped prefix join, and its connected classes.

1. A document's set is its distinct word shingles. Equal sets are one class.
2. Shingles are ordered rare first by a counting sketch of fixed size over all
   documents (ties by hash). Two sets that reach the threshold share a shingle
   among their first ``n - ceil(t * n) + 1``. Classes with equal prefixes and
   size are one group, and only groups are indexed.
3. Prefix shingles held by a single group are dropped in a packed exchange;
   they matter only inside that group.
4. First links: every group is paired with one leader of its token and size
   band, so a token with m groups gives 2 m pairs, not m^2. The leader is the
   group with the fewest rarer shingles before the token, which of many edited
   copies is the original. Pairs are expanded to member classes and verified
   on whole sets, after bitmaps have excluded what cannot reach the threshold.
5. Rest: members of one component need no more pairs. Only tokens that hold
   sets of different components are kept. What stands before a token in a set's
   order limits the sizes of its partners. Within a token, size classes that
   admit each other and hold different components are found first, then only
   their sets meet; these pairs are filtered by the bound that all shared prefix
   tokens give, by bitmaps, and verified. Where two crowded classes would meet,
   their sets are dealt again, to cells of this token and each of their next
   ones within reach, since sets that link share more than one token; two such
   steps are made before a cell meets in full. Inside a group, whose members
   share the whole prefix, members of different components meet in the same
   way, in cells of the tokens after it.

So each link between different components is either found or excluded by a
bound, and the classes are exact.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, chunks, cut, hashes64, measured, mixed, row_keys, rows_of, skew_join, table, tidy, window_hashes
from .components import connected_components
from .shared import shared_places

WIDTH, PERCENT = 5, 75
#: Least and most cells of the counting sketch (one byte each where it is broadcast) and the cells of one of its parts.
LEAST_CELLS, MOST_CELLS, PART_CELLS = 1 << 20, 1 << 24, 1 << 16
#: Documents counted together: a cell of 16 bits holds them all.
COUNTED = 60_000
#: Longest list of ids that is broadcast: 8 MB.
BROADCAST_IDS = 1_000_000
#: Where more sets than this would meet as many, they are dealt again by their next tokens, at most so many times.
CELL, STEPS = 128, 2


def shingle_sets(batch, width: int):
    """For each row the sorted distinct shingle hashes of its lower-cased words."""
    texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
    lists = [t.encode("utf-8", "surrogatepass").lower().split() if t else [] for t in texts]
    flat = hashes64([w for x in lists for w in x])
    grams = window_hashes(flat, width)
    out, at = [], 0
    with np.errstate(over="ignore"):
        for x in lists:
            n = len(x)
            if n >= width:
                out.append(np.unique(grams[at : at + n - width + 1]))
            elif n:
                out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(x), seed=n)], dtype=U64))
            else:
                out.append(np.empty(0, dtype=U64))
            at += n
    return out


def _cells(grams, size: int):
    return (mixed(grams) & U64(size - 1)).astype(np.int64)


def bitmap(grams: np.ndarray) -> bytes:
    """A set as bits, four to eight for each element; sizes are powers of two, so a larger one folds onto a smaller."""
    size = max(64, 1 << int(4 * len(grams) - 1).bit_length())
    bits = np.zeros(size, dtype=np.uint8)
    bits[(grams >> U64(7)).astype(np.int64) & (size - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def most_shared(a: bytes, m: int, b: bytes, n: int) -> int:
    """No two sets of m and n elements with these bitmaps share more elements than this.

    Every bit that only one of them has stands for at least one element that
    the other lacks.
    """
    x, y = np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    return min(m - int(np.bitwise_count(x & ~y).sum()), n - int(np.bitwise_count(y & ~x).sum()))


def shingle_counts(docs: DataFrame, width: int) -> np.ndarray:
    """How many documents' sets fall in each cell, as eighths of a binary logarithm: a byte a cell.

    The number of cells follows the text's length between two fixed bounds;
    tasks' sketches are merged on executors by parts, in 64 bits.
    """
    length = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    size = min(MOST_CELLS, max(LEAST_CELLS, 1 << (length // 24).bit_length()))
    parts = size // PART_CELLS

    def count(batches):
        total, n = np.zeros(size, dtype=np.uint16), 0

        def packed():
            return pa.RecordBatch.from_pydict({"part": pa.array(range(parts), pa.int32()), "cells": pa.array([zlib.compress(p.tobytes(), 1) for p in total.reshape(parts, -1)], pa.binary())})

        for batch in chunks(batches):
            if n + batch.num_rows > COUNTED:
                yield packed()
                total[:], n = 0, 0
            for part in shingle_sets(batch, width):
                np.add.at(total, np.unique(_cells(part, size)), 1)
            n += batch.num_rows
        yield packed()

    def merge(batches):
        total = {}
        for batch in batches:
            for part, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(zlib.decompress(cells), dtype=np.uint16).astype(np.uint64)
                total[part] = total[part] + x if part in total else x
        levels = [np.minimum(np.rint(8 * np.log2(x + 1.0)), 255).astype(np.uint8).tobytes() for x in total.values()]
        if total:
            yield pa.RecordBatch.from_pydict({"part": pa.array(list(total), pa.int32()), "cells": pa.array(levels, pa.binary())})

    merged = docs.select("text").mapInArrow(count, "part int, cells binary").repartitionById(parts, F.col("part")).mapInArrow(merge, "part int, cells binary")
    out = np.zeros((parts, PART_CELLS), dtype=np.uint8)
    for r in merged.collect():
        out[r["part"]] = np.frombuffer(r["cells"], dtype=np.uint8)
    return out.reshape(-1)


def rare_first(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A set in the common order of all sets."""
    return grams[np.lexsort((grams, counts[_cells(grams, len(counts))]))]


def _sets(counts, width: int, percent: int):
    def described(batches):
        cells = counts.value
        for batch in chunks(batches):
            cols = {n: [] for n in ("n", "f1", "f2", "g", "prefix", "bits")}
            for s in shingle_sets(batch, width):
                n = len(s)
                cols["n"].append(n)
                if not n:
                    for c in ("f1", "f2", "g", "prefix", "bits"):
                        cols[c].append(None)
                    continue
                f = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), dtype="<i8")
                size = n - (percent * n + 99) // 100 + 1
                prefix = rare_first(s, cells)[:size].tobytes()
                cols["f1"].append(int(f[0]))
                cols["f2"].append(int(f[1]))
                cols["g"].append(int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(prefix, seed=n)))))
                cols["prefix"].append(prefix)
                cols["bits"].append(bitmap(s))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(cols[c], pa.int64()) for c in ("n", "f1", "f2", "g")), *(pa.array(cols[c], pa.binary()) for c in ("prefix", "bits"))], names=["doc_id", "id", *cols])

    return described


def _prefix_keys(batch):
    prefixes = [np.frombuffer(p, dtype=U64) for p in batch.column(batch.schema.get_field_index("prefix")).to_pylist()]
    sizes = np.array([len(p) for p in prefixes], dtype=np.int64)
    pos = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    key = np.concatenate(prefixes)
    return np.repeat(np.arange(len(prefixes)), sizes), pos, key, np.zeros(len(key), dtype=np.uint32)


def plausible(pairs: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """Pairs whose bitmaps (``id, n, bits``) allow the threshold; a twentieth of what their sets would move."""

    def judge(batches):
        for batch in batches:
            a, b, m, n, x, y = (c.to_pylist() for c in batch.columns)
            good = [i for i in range(len(a)) if (100 + percent) * most_shared(x[i], m[i], y[i], n[i]) >= percent * (m[i] + n[i])]
            yield batch.select(["a", "b"]).take(pa.array(good, pa.int64()))

    side = lambda k: bitmaps.select(F.col("id").alias(k), F.col("n").alias(f"n_{k}"), F.col("bits").alias(f"bits_{k}"))
    met = skew_join(skew_join(pairs, side("a"), ["a"]), side("b"), ["b"], of=pairs).select("a", "b", "n_a", "n_b", "bits_a", "bits_b")
    return met.mapInArrow(judge, "a long, b long")


def texts_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """``id, text`` of the rows with these ``id``; a bounded list of them saves an exchange of all texts."""
    ids = cut(ids.distinct())
    return docs.join(F.broadcast(ids) if rows_of(ids) <= BROADCAST_IDS else ids, "id", "left_semi").select("id", "text")


def verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (``a, b``: row ids) whose whole sets reach the threshold."""
    texts = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("id")), docs)

    def sets(batches):
        for batch in chunks(batches):
            found = shingle_sets(batch, width)
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in found])]).astype(np.int32)
            values = np.concatenate(found).view(np.int64) if found else np.empty(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["id", "grams"])

    held = texts.mapInArrow(sets, "id long, grams array<long>").dropDuplicates(["id"])
    met = skew_join(pairs, held.select(F.col("id").alias("a"), F.col("grams").alias("x")), ["a"])
    met = skew_join(met, held.select(F.col("id").alias("b"), F.col("grams").alias("y")), ["b"], of=pairs)
    met = met.select("a", "b", F.size("x").alias("m"), F.size("y").alias("n"), F.size(F.array_intersect("x", "y")).cast("long").alias("k"))
    return met.filter(100 * F.col("k") >= percent * (F.col("m") + F.col("n") - F.col("k"))).select("a", "b")


def least_shared(n, percent: int):
    """How many elements a set of ``n`` shares at least with any that it links with."""
    return F.expr(f"({n} * {percent} + 99) div 100")


def size_class(n):
    """Sizes below 256 are their own class; above, a class spans about 0.4 percent."""
    return F.when(n < 256, n).otherwise(256 + F.floor(256 * F.log(F.greatest(n, F.lit(256)) / 256.0))).cast("int")


#: A set's place in a cell: ``_pos`` is its token's place less the shared elements counted before it, ``_at`` the place itself.
PLACED = ("_key", "_pos", "_at", "id", "n", "comp", "grp", "_last", "_least")


#: Words of 64 bits of a signature: a set's elements as bits, folded to so many.
SIGNATURE = 8


def signature(grams: np.ndarray) -> list[int]:
    bits = np.zeros(64 * SIGNATURE, dtype=np.uint8)
    bits[(grams >> U64(7)).astype(np.int64) & (64 * SIGNATURE - 1)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64).tolist()


def may_link(percent: int):
    """Whether the signatures ``sig, sig2`` of sets of ``n, n2`` elements allow the threshold; one that is missing does."""
    lacks = lambda a, b: sum((F.bit_count(F.get(a, F.lit(i)).bitwiseAND(F.bitwise_not(F.get(b, F.lit(i))))) for i in range(SIGNATURE)), F.lit(0))
    most = F.least(F.col("n") - lacks("sig", "sig2"), F.col("n2") - lacks("sig2", "sig"))
    return F.coalesce((100 + percent) * most >= percent * (F.col("n") + F.col("n2")), F.lit(True))


def next_tokens(rows: DataFrame, docs: DataFrame, counts, width: int) -> DataFrame:
    """Every placed set once for each token after ``_at`` up to ``_last``, in the cell of both tokens, with its signature ``sig``."""
    held = rows.groupBy("id", "n", "comp", "grp").agg(F.collect_set(F.struct("_key", "_pos", "_at", "_last", "_least")).alias("at"))
    texts = texts_of(rows.select("id"), docs).dropDuplicates(["id"])

    def expand(batches):
        cells = counts.value
        for batch in chunks(batches):
            out, sigs = {k: [] for k in PLACED}, []
            for grams, id_, n, comp, grp, at in zip(shingle_sets(batch.select(["text"]), width), *(batch.column(i).to_pylist() for i in (1, 2, 3, 4, 5))):
                order, sig = rare_first(grams, cells), signature(grams)
                for r in at:
                    pos = np.arange(r["_at"] + 1, min(r["_last"], n - 1) + 1)
                    with np.errstate(over="ignore"):
                        out["_key"].append(mixed(np.array([r["_key"]], dtype=np.int64).view(U64) * U64(0x9E3779B97F4A7C15) + order[pos]).view(np.int64))
                    out["_at"].append(pos)
                    # one more element is shared before the new place
                    out["_pos"].append(pos - (r["_at"] - r["_pos"] + 1))
                    for k, x in (("id", id_), ("n", n), ("comp", comp), ("grp", grp), ("_last", r["_last"] + 1), ("_least", r["_least"])):
                        out[k].append(np.full(len(pos), x, dtype=np.int64))
                    sigs += [sig] * len(pos)
            if out["id"]:
                yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(x).astype(np.int64)) for x in out.values()), pa.array(sigs, pa.list_(pa.int64()))], names=[*out, "sig"])

    return texts.join(held, "id").select("text", "id", "n", "comp", "grp", "at").mapInArrow(expand, ", ".join(f"{k} long" for k in PLACED) + ", sig array<long>")


def crossing_pairs(placed: DataFrame, docs: DataFrame, counts, width: int, percent: int, steps: int = STEPS) -> DataFrame:
    """Pairs ``a, b`` of different components and groups that may reach the threshold.

    ``placed`` has the columns ``PLACED``: sets in the cells of their tokens;
    the next shared element must come at ``_last`` or before, and a set shares
    at least ``_least`` elements with any partner. At a pair's first shared
    token the overlap is at most what is left of either set, so the partner's
    size is at most ``top``; a pair that fails there fails at later tokens.
    Within a token, classes of sizes that admit each other and hold different
    components are found first, then only their sets meet. Where more than
    ``CELL`` sets of both classes would meet, they are dealt again by their next
    tokens, with signatures that exclude pairs; sets that may share no more than
    the cell stands for stay.
    """
    placed = placed if "sig" in placed.columns else placed.withColumn("sig", F.lit(None).cast("array<long>"))
    several = placed.groupBy("_key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x < y").select("_key")
    rows = skew_join(placed, several, ["_key"])
    rows = rows.withColumn("top", F.least(F.expr(f"(n - _pos) * {100 + percent} div {percent} - n"), F.expr(f"n * 100 div {percent}"))).withColumn("low", least_shared("n", percent)).filter("top >= low")
    rows = cut(rows.withColumns({"c": size_class(F.col("n")), "c_top": size_class(F.col("top")), "c_low": size_class(F.col("low"))}).drop("low"))
    # at most some 75 classes of one token admit each other, however many sets share it
    sizes = rows.groupBy("_key", "c").agg(F.max("c_top").alias("c_top"), F.min("c_low").alias("c_low"), F.min("comp").alias("x"), F.max("comp").alias("y"))
    two = sizes.select("_key", *[F.col(k).alias(f"{k}2") for k in ("c", "c_top", "c_low", "x", "y")])
    met = cut(sizes.join(two, "_key").filter("c <= c2 and c2 <= c_top and c <= c_top2 and c2 >= c_low and c >= c_low2 and least(x, x2) < greatest(y, y2)").select("_key", "c", "c2"))
    if not rows_of(met):
        return docs.sparkSession.createDataFrame([], "a long, b long")
    n = rows_of(rows)
    one = skew_join(rows, met, ["_key", "c"], rows=n).filter("c_low <= c2 and c2 <= c_top").withColumn("_side", F.lit(1))
    other = skew_join(rows.withColumnRenamed("c", "c2"), met, ["_key", "c2"], rows=n).filter("c_low <= c and c <= c_top").withColumn("_side", F.lit(2))
    both = one.unionByName(other).drop("c_low", "c_top")
    cell = ["_key", "c", "c2"]
    live = both.groupBy(*cell).agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count_if(F.col("_side") == 1).alias("m1"), F.count_if(F.col("_side") == 2).alias("m2"), *[F.min(F.when(F.col("_side") == i, F.col("n"))).alias(f"n_{i}") for i in (1, 2)]).filter("x < y")
    live = live.select(*cell, "n_1", "n_2", (F.least("m1", "m2") > CELL).alias("_crowded") if steps else F.lit(False).alias("_crowded"))
    # how many elements a set shares at least with any of the other side's
    sized = F.greatest("_least", F.expr(f"({percent} * (n + if(_side = 1, n_2, n_1)) + {99 + percent}) div {100 + percent}"))
    both = cut(skew_join(both, live, cell, rows=n).withColumn("_least", F.when(F.col("_crowded"), sized).otherwise(F.col("_least"))).drop("n_1", "n_2"), crowded=F.count_if("_crowded"))
    n, crowded = rows_of(both), measured(both)["crowded"]
    shared = F.col("_at") - F.col("_pos")
    here = both.filter(~F.col("_crowded") | (F.col("_least") < shared + 2)) if crowded else both

    left = here.filter("_side = 1").select(*cell, "id", "n", "_pos", "comp", "grp", "top", "sig")
    right = here.filter("_side = 2").select(*cell, *[F.col(k).alias(f"{k}2") for k in ("id", "n", "_pos", "comp", "grp", "top", "sig")])
    fits = F.expr("comp <> comp2 and grp <> grp2 and n2 <= top and n <= top2 and (c < c2 or id < id2)")
    found = skew_join(left, right, cell, rows=n).filter(fits & may_link(percent))
    swap = lambda k: F.when(F.col("id") < F.col("id2"), F.struct(k, f"{k}2")).otherwise(F.struct(F.col(f"{k}2").alias(k), F.col(k).alias(f"{k}2")))
    found = found.select(*[swap(k).alias(f"s{k}") for k in ("id", "n", "_pos")]).select("sid.*", "sn.*", "s_pos.*")
    # after the last token that met, both sets may share all that is left
    counted = found.groupBy("id", "id2").agg(F.first("n").alias("n"), F.first("n2").alias("n2"), F.count("*").alias("k"), F.max("_pos").alias("p"), F.max("_pos2").alias("p2"))
    if crowded:
        # cells that are dealt again count for a pair as if it met in all of them
        again = both.filter("_crowded").groupBy("id").agg(F.count_distinct("_key").alias("_r"))
        counted = counted.join(again, "id", "left").withColumn("k", F.col("k") + F.coalesce("_r", F.lit(0))).drop("_r")
    kept = counted.filter(F.expr(f"(k + least(n - 1 - p, n2 - 1 - p2)) * {100 + percent} >= {percent} * (n + n2)"))
    pairs = kept.select(F.col("id").alias("a"), F.col("id2").alias("b"))
    if not crowded:
        return pairs
    # one row per token and set, with the least bound of all its cells; the next shared element comes before what is then left
    again = both.filter("_crowded").groupBy(*[k for k in PLACED if k != "_least"]).agg(F.min("_least").alias("_least"))
    again = again.withColumn("_last", F.least("_last", F.expr("n - _least + _at - _pos + 1"))).select(*PLACED)
    dealt = cut(next_tokens(again, docs, counts, width))
    return pairs.unionByName(crossing_pairs(dealt, docs, counts, width, percent, steps - 1)).distinct()


def ngram_join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Classes of documents joined by links of Jaccard similarity >= ``percent`` / 100.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored. Returns
    one row per row: ``doc_id, n_shingles, component_id`` (smallest doc_id
    reached by links, itself included), ``row_id``, the first of ``row_keys``, and
    ``class_id``, which names the class where ids repeat. A text of fewer than ``width`` words
    is one shingle; a null or blank one has none and stands alone. Equal rows
    share a class; null ids count as smallest and stay null.
    """
    sparks = docs.sparkSession
    docs = docs.select("doc_id", "text").select("doc_id", "text", row_keys()[0].alias("id"))
    counts = sparks.sparkContext.broadcast(shingle_counts(docs, width))
    kind = docs.schema["doc_id"].dataType.simpleString()
    described = cut(docs.mapInArrow(_sets(counts, width, percent), f"doc_id {kind}, id long, n long, f1 long, f2 long, g long, prefix binary, bits binary"))
    full = described.filter("n > 0")

    classes = cut(full.groupBy("f1", "f2").agg(F.min(F.struct("doc_id", "id", "n", "g", "bits")).alias("r")).select("f1", "f2", F.col("r.doc_id").alias("first_doc"), "r.id", "r.n", "r.g", "r.bits"))
    bitmaps = classes.select("id", "n", "bits")
    members = classes.select("g", "id", "n")
    leaders = cut(classes.groupBy("g").agg(F.min("id").alias("leader"), F.count("*").alias("m")))

    # groups by prefix token, only tokens that two groups share
    groups = full.select("g", "n", "prefix").dropDuplicates(["g"]).select(F.col("g").alias("_a"), F.col("n").alias("_b"), "prefix")
    index = cut(shared_places(groups, _prefix_keys, with_keys=True))
    banded = index.withColumn("band", F.floor(F.log("_b") / F.log(F.lit(100.0 / percent))))
    heads = banded.groupBy("_key", "band").agg(F.min(F.struct("_pos", "_a", "_b")).alias("h"))
    heads = heads.withColumn("band", F.explode(F.array("band", F.col("band") + 1)))
    close = F.col("h._b") * 100 >= percent * F.col("_b")
    close &= F.col("_b") * 100 >= percent * F.col("h._b")
    group_pairs = cut(skew_join(banded, heads, ["_key", "band"], rows=rows_of(index)).filter((F.col("_a") != F.col("h._a")) & close).select("_a", F.col("h._a").alias("_h")).distinct())

    n = rows_of(classes)
    outside = skew_join(members.select(F.col("g").alias("_a"), F.col("id").alias("a")), group_pairs, ["_a"], rows=n)
    outside = skew_join(outside, leaders.select(F.col("g").alias("_h"), F.col("leader").alias("b")), ["_h"], of=group_pairs).select("a", "b")
    inside = skew_join(members.select("g", F.col("id").alias("a")), leaders.filter("m > 1").select("g", F.col("leader").alias("b")), ["g"], rows=n).filter("a <> b").select("a", "b")
    links = cut(verified(cut(plausible(cut(outside.unionByName(inside)), bitmaps, percent)), docs, width, percent))
    comps = connected_components(links)

    tidy(sparks)

    # cells and groups that hold sets of different components
    held = cut(members.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id")))
    of_group = cut(held.groupBy("g").agg(F.min("comp").alias("x"), F.max("comp").alias("y")))
    mixed_cells = index.select("_key", F.col("_a").alias("g")).join(of_group, "g").groupBy("_key").agg(F.min("x").alias("x"), F.max("y").alias("y")).filter("x < y").select("_key")
    crossing = skew_join(index.select("_key", "_pos", F.col("_a").alias("g")), mixed_cells, ["_key"], "left_semi", rows=rows_of(index))
    least = least_shared("n", percent)
    place = lambda key, pos, at, grp, last, least: [F.col(key).alias("_key"), *[x.cast("long").alias(k) for k, x in (("_pos", pos), ("_at", at), ("id", F.col("id")), ("n", F.col("n")), ("comp", F.col("comp")), ("grp", F.col(grp)), ("_last", last), ("_least", least))]]
    placed = skew_join(held, crossing, ["g"]).select(*place("_key", F.col("_pos"), F.col("_pos"), "g", F.col("n") - least + 1, least))
    pairs = crossing_pairs(cut(placed), docs, counts, width, percent)
    # members of a group have one size, n, and share the first n - least + 1 tokens and at least `same` in all
    same = F.expr(f"(2 * n * {percent} + {99 + percent}) div {100 + percent}")
    split = cut(skew_join(held, of_group.filter("x < y").select("g"), ["g"]).select(*place("g", F.lit(0), F.col("n") - least, "id", 2 * F.col("n") - least + 1 - same, same)))
    if rows_of(split):
        pairs = pairs.unionByName(crossing_pairs(cut(next_tokens(split, docs, counts, width)), docs, counts, width, percent)).distinct()
    links = links.unionByName(verified(cut(plausible(cut(pairs), bitmaps, percent)), docs, width, percent))
    comps = connected_components(links)

    tidy(sparks)

    labelled = classes.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    smallest = labelled.groupBy("comp").agg(F.min(F.struct("first_doc")).alias("s")).select("comp", F.col("s.first_doc").alias("component_id"))
    by_set = labelled.join(smallest, "comp").select("f1", "f2", "component_id", F.col("comp").alias("class_id"), F.lit(True).alias("_found"))
    out = described.select("doc_id", "id", "n", "f1", "f2").join(by_set, ["f1", "f2"], "left")
    return out.select("doc_id", F.col("id").alias("row_id"), F.col("n").alias("n_shingles"), F.when(F.col("_found"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "class_id")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLE = """
with recursive t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') w from documents),
g as (select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) end) s from t),
d as (select doc_id, list_sort(list(distinct s)) k, count(distinct s) n from g group by doc_id),
c as (select k, n, min(doc_id) id from d group by k, n), cs as (select id, n, unnest(k) s from c),
m as (select a.id x, b.id y, any_value(a.n) n1, any_value(b.n) n2, count(*) k from cs a join cs b on a.s = b.s and a.id < b.id group by all),
e as (select x, y from m where 100 * k >= 75 * (n1 + n2 - k)), both_ as (select x, y from e union all select y, x from e),
r(x, y) as (select id, id from c union select r.x, b.y from r join both_ b on b.x = r.y),
l as (select x, min(y) component_id from r group by x)
select t.doc_id, coalesce(d.n, 0)::bigint n_shingles, coalesce(l.component_id, t.doc_id) component_id from t left join d on t.doc_id = d.doc_id left join c on d.k = c.k left join l on c.id = l.x
"""


def brute_force(rows: list[tuple], width: int = WIDTH, percent: int = PERCENT) -> list[tuple]:
    """The same by comparing all pairs; for tests."""
    sets = []
    for _, text in rows:
        w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and min(len(sets[i]), len(sets[j])) * 100 >= percent * max(len(sets[i]), len(sets[j])):
                k = len(sets[i] & sets[j])
                if 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                    parent[root(i)] = root(j)
    first: dict[int, int] = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        first[r] = min(first.get(r, d), d)
    return [(d, len(sets[i]), first[root(i)]) for i, (d, _) in enumerate(rows)]
