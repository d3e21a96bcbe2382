"""Line dedup with exact reference counts and sharded cuckoo filters.

The index has two tables. ``counts`` holds for every line key (128 bits) in
how many documents it stands, exactly; inserting documents adds to it and
deleting them subtracts, so every step can be undone. ``filters`` holds one
cuckoo filter per shard over the keys that reach the threshold; a key that
crosses it up or down is inserted into or deleted from its shard's filter.

To apply the index, filters whose total size is within a bound are broadcast;
each task then sees which lines may be common. If the exact keys behind the
filters are few as well, they are broadcast too and settle these lines in the
same pass, so no text is exchanged; else the lines go to a join with the exact
counts. Filters beyond the bound are not broadcast: all lines go to that join.
All ways give the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, blob_lists, chunks, cut, hashes128, mixed, partitions, row_keys, skew_join, table

MIN_DOCS = 10
#: Filters of more bytes than this are not broadcast; nor are more exact keys than this, of 16 bytes each.
FILTER_BYTES, EXACT_KEYS = 64 << 20, 1 << 20
FLUSH = 1_000_000


class CuckooFilter:
    """16-bit fingerprints in buckets of four; keys are pairs of 64-bit hashes."""

    SLOTS, KICKS = 4, 500

    def __init__(self, capacity: int):
        self.table = np.zeros((1 << max(1, int(np.ceil(np.log2(max(capacity, 1) / 3.4 + 1)))), self.SLOTS), dtype=np.uint16)

    def _places(self, h1: np.ndarray, h2: np.ndarray):
        mask = U64(len(self.table) - 1)
        mark = ((h2 & U64(0xFFFF)) % U64(0xFFFF) + U64(1)).astype(np.uint16)
        one = h1 >> U64(20) & mask
        return mark, one, one ^ (mixed(mark.astype(U64)) & mask)

    def insert(self, h1: int, h2: int) -> bool:
        """False if it is full: nothing then has changed."""
        mark, one, two = (int(x[0]) for x in self._places(np.array([h1], dtype=U64), np.array([h2], dtype=U64)))
        for at in (one, two):
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                return True
        path, at = [], two
        for k in range(self.KICKS):
            slot = (mark + k) % self.SLOTS
            path.append((at, slot, int(self.table[at, slot])))
            self.table[at, slot], mark = mark, path[-1][2]
            at ^= int(mixed(np.array([mark], dtype=U64))[0]) & (len(self.table) - 1)
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                return True
        for at, slot, old in reversed(path):
            self.table[at, slot] = old
        return False

    def delete(self, h1: int, h2: int) -> bool:
        mark, one, two = (int(x[0]) for x in self._places(np.array([h1], dtype=U64), np.array([h2], dtype=U64)))
        for at in (one, two):
            held = np.flatnonzero(self.table[at] == mark)
            if len(held):
                self.table[at, held[0]] = 0
                return True
        return False

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        mark, one, two = self._places(h1, h2)
        return (self.table[one.astype(np.int64)] == mark[:, None]).any(1) | (self.table[two.astype(np.int64)] == mark[:, None]).any(1)

    @classmethod
    def of(cls, h1: np.ndarray, h2: np.ndarray) -> CuckooFilter:
        """A filter that holds all the keys; grows until they fit."""
        capacity = max(8, len(h1))
        while True:
            made = cls(capacity)
            if all(made.insert(a, b) for a, b in zip(h1.tolist(), h2.tolist())):
                return made
            capacity *= 2

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        made = cls.__new__(cls)
        made.table = np.frombuffer(raw, dtype=np.uint16).reshape(-1, cls.SLOTS).copy()
        return made


def line_keys(text: str | None) -> list[bytes]:
    return [x.strip().lower() for x in (text or "").encode("utf-8", "surrogatepass").split(b"\n")]


def line_counts(docs: DataFrame) -> DataFrame:
    """``h1, h2, n``: in how many rows of ``docs`` each line key stands. Blank lines have no key."""

    def summed(held):
        keys, counts = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
        order = np.lexsort((keys[:, 1], keys[:, 0]))
        keys, counts = keys[order], counts[order]
        starts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1])
        return keys[starts], np.add.reduceat(counts, starts)

    def batch_of(held):
        keys, counts = summed(held)
        return pa.RecordBatch.from_arrays([pa.array(keys[:, 0].view(np.int64)), pa.array(keys[:, 1].view(np.int64)), pa.array(counts)], names=["h1", "h2", "n"])

    def count(batches):
        held, size = [], 0
        for batch in chunks(batches):
            keys = [k for t in batch.column(0).to_pylist() for k in {k for k in line_keys(t) if k}]
            if keys:
                # no view of a slice: columns must be contiguous
                held.append((np.ascontiguousarray(hashes128(keys)), np.ones(len(keys), dtype=np.int64)))
                size += len(keys)
            if size >= FLUSH:
                held = [summed(held)]
                size = len(held[0][0])
                if size >= FLUSH // 2:
                    yield batch_of(held)
                    held, size = [], 0
        if held:
            yield batch_of(held)

    return docs.select("text").mapInArrow(count, "h1 long, h2 long, n long").groupBy("h1", "h2").agg(F.sum("n").alias("n"))


def _shard(n: int):
    return (F.shiftrightunsigned("h2", 40) % n).cast("int")


@dataclass
class LineIndex:
    """Exact counts and the filters over keys in at least ``min_docs`` documents."""

    counts: DataFrame
    filters: DataFrame
    min_docs: int
    shards: int

    @classmethod
    def build(cls, docs: DataFrame, min_docs: int = MIN_DOCS) -> LineIndex:
        counts = cut(line_counts(docs))
        shards = partitions(docs.sparkSession)

        def build(batches):
            keys: dict[int, list] = {}
            for batch in batches:
                shard, h1, h2 = (c.to_numpy() for c in batch.columns)
                for s in np.unique(shard):
                    keys.setdefault(int(s), []).append((h1[shard == s], h2[shard == s]))
            for s, parts in keys.items():
                h1, h2 = (np.concatenate([p[i] for p in parts]).view(U64) for i in (0, 1))
                yield pa.RecordBatch.from_pydict({"shard": pa.array([s], pa.int32()), "blob": pa.array([CuckooFilter.of(h1, h2).to_bytes()], pa.binary())})

        hot = counts.filter(F.col("n") >= min_docs).select(_shard(shards).alias("shard"), "h1", "h2")
        return cls(counts, cut(hot.repartitionById(shards, F.col("shard")).mapInArrow(build, "shard int, blob binary")), min_docs, shards)

    def _changed(self, change: DataFrame) -> LineIndex:
        """``change``: h1, h2, n to add, negative to subtract."""
        new = cut(self.counts.unionByName(change).groupBy("h1", "h2").agg(F.sum("n").alias("n")).filter("n <> 0"))
        if new.filter("n < 0").limit(1).count():
            raise ValueError("documents were deleted that had not been inserted")
        was = self.counts.filter(F.col("n") >= self.min_docs).select("h1", "h2", F.lit(True).alias("was"))
        now = new.filter(F.col("n") >= self.min_docs).select("h1", "h2", F.lit(True).alias("now"))
        crossed = was.join(now, ["h1", "h2"], "full").filter("was is null or now is null").select(_shard(self.shards).alias("shard"), "h1", "h2", F.col("now").isNotNull().alias("rises"))

        def update(key, held: pa.Table, moved: pa.Table) -> pa.Table:
            filter_ = CuckooFilter.from_bytes(held["blob"][0].as_py()) if held.num_rows else CuckooFilter(8)
            for a, b, rises in zip(moved["h1"].to_numpy().view(U64).tolist(), moved["h2"].to_numpy().view(U64).tolist(), moved["rises"].to_pylist()):
                if not rises:
                    filter_.delete(a, b)
                elif not filter_.insert(a, b):
                    # full: an empty blob is rebuilt from the exact counts below
                    return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "blob": pa.array([b""], pa.binary())})
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "blob": pa.array([filter_.to_bytes()], pa.binary())})

        updated = cut(self.filters.groupBy("shard").cogroup(crossed.groupBy("shard")).applyInArrow(update, "shard int, blob binary"))
        index = LineIndex(new, updated, self.min_docs, self.shards)
        if updated.filter(F.length("blob") == 0).limit(1).count():
            full = updated.filter(F.length("blob") == 0).select("shard")
            keys = new.filter(F.col("n") >= self.min_docs).withColumn("shard", _shard(self.shards)).join(full, "shard", "left_semi").select("shard", "h1", "h2")

            def rebuild(key, table: pa.Table) -> pa.Table:
                made = CuckooFilter.of(table["h1"].to_numpy().view(U64), table["h2"].to_numpy().view(U64))
                return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "blob": pa.array([made.to_bytes()], pa.binary())})

            index.filters = cut(updated.filter(F.length("blob") > 0).unionByName(keys.groupBy("shard").applyInArrow(rebuild, "shard int, blob binary")))
        return index

    def insert(self, docs: DataFrame) -> LineIndex:
        return self._changed(line_counts(docs))

    def delete(self, docs: DataFrame) -> LineIndex:
        """Takes back documents inserted before; a ValueError if some had not been."""
        return self._changed(line_counts(docs).withColumn("n", -F.col("n")))

    def _applied_in_place(self, docs: DataFrame, filters, known: pa.Table) -> DataFrame:
        """One narrow pass: filters name the lines that may be common, the exact keys settle them."""
        h1, h2 = (known[c].to_numpy().view(U64) for c in ("h1", "h2"))
        order = np.argsort(h1)
        exact = docs.sparkSession.sparkContext.broadcast((h1[order], h2[order]))
        names, shards, at = docs.columns, self.shards, docs.columns.index("text")

        def drop(batches):
            held = {s: CuckooFilter.from_bytes(b) for s, b in filters.value.items()}
            for batch in chunks(batches):
                texts = [t or "" for t in batch.column(at).to_pylist()]
                lines = [line_keys(t) for t in texts]
                sizes = np.array([len(x) for x in lines], dtype=np.int64)
                flat = [k for x in lines for k in x]
                h = hashes128(flat)
                gone = np.zeros(len(flat), dtype=bool)
                order, edges = blob_lists((h[:, 1] >> U64(40)) % U64(shards), shards)
                for s, f in held.items():
                    part = order[edges[s] : edges[s + 1]]
                    gone[part] = f.contains(h[part, 0], h[part, 1])
                maybe = np.flatnonzero(gone)
                one, two = exact.value
                found = np.minimum(np.searchsorted(one, h[maybe, 0]), max(len(one) - 1, 0))
                gone[maybe] = (one[found] == h[maybe, 0]) & (two[found] == h[maybe, 1]) if len(one) else False
                gone &= np.fromiter(map(bool, flat), dtype=bool, count=len(flat))
                starts = np.cumsum(sizes) - sizes
                dropped = np.add.reduceat(gone.astype(np.int64), starts) if len(starts) else np.empty(0, dtype=np.int64)
                for i in np.flatnonzero(dropped):
                    mine = gone[starts[i] : starts[i] + sizes[i]]
                    texts[i] = "\n".join(x for x, g in zip(texts[i].split("\n"), mine) if not g)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes), pa.array(dropped), pa.array(texts, pa.string())], names=[*names, "n_lines", "n_dropped", "kept"])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
        return docs.mapInArrow(drop, f"{fields}, n_lines long, n_dropped long, kept string")

    def apply(self, docs: DataFrame) -> DataFrame:
        """``docs`` plus ``n_lines, n_dropped, kept``; see ``line_dedup``."""
        spark = docs.sparkSession
        size = self.filters.agg(F.sum(F.length("blob"))).first()[0] or 0
        filters = None
        if size <= FILTER_BYTES:
            filters = spark.sparkContext.broadcast({r["shard"]: r["blob"] for r in self.filters.collect()})
        own = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept", "_k1", "_k2", "_drop")]
        hot = self.counts.filter(F.col("n") >= self.min_docs).select("h1", "h2")
        if filters:
            known = hot.limit(EXACT_KEYS + 1).toArrow()
            if known.num_rows <= EXACT_KEYS:
                return self._applied_in_place(docs.select(*own), filters, known)
        keyed, shards = docs.select(*own, *row_keys()), self.shards

        def suspects(batches):
            held = {s: CuckooFilter.from_bytes(b) for s, b in filters.value.items()} if filters else None
            for batch in chunks(batches):
                k1, k2 = (batch.column(i).to_numpy() for i in (0, 1))
                lines = [line_keys(t) for t in batch.column(2).to_pylist()]
                sizes = np.array([len(x) for x in lines], dtype=np.int64)
                flat = [k for x in lines for k in x]
                row = np.repeat(np.arange(len(lines)), sizes)
                pos = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                h = hashes128(flat)
                maybe = np.fromiter(map(bool, flat), dtype=bool, count=len(flat))
                if held is not None:
                    order, edges = blob_lists((h[:, 1] >> U64(40)) % U64(shards), shards)
                    found = np.zeros(len(flat), dtype=bool)
                    for s, f in held.items():
                        part = order[edges[s] : edges[s + 1]]
                        found[part] = f.contains(h[part, 0], h[part, 1])
                    maybe &= found
                at = np.flatnonzero(maybe)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k1[row[at]], k2[row[at]], pos[at].astype(np.int32), np.ascontiguousarray(h[at, 0]).view(np.int64), np.ascontiguousarray(h[at, 1]).view(np.int64))], names=["_k1", "_k2", "pos", "h1", "h2"])

        lines = keyed.select("_k1", "_k2", "text").mapInArrow(suspects, "_k1 long, _k2 long, pos int, h1 long, h2 long")
        drops = skew_join(lines, hot, ["h1", "h2"]).groupBy("_k1", "_k2").agg(F.collect_set("pos").alias("_drop"))
        joined = keyed.join(drops, ["_k1", "_k2"], "left").select(*own, "_drop")
        at = own.index("text")

        def drop(batches):
            for batch in chunks(batches):
                n_lines, n_dropped, kept = [], [], []
                for text, gone in zip(batch.column(at).to_pylist(), batch.column(len(own)).to_pylist()):
                    text = text or ""
                    if gone:
                        lines = text.split("\n")
                        n_lines.append(len(lines))
                        gone = set(gone)
                        text = "\n".join(x for i, x in enumerate(lines) if i not in gone)
                    else:
                        n_lines.append(text.count("\n") + 1)
                    n_dropped.append(len(gone) if gone else 0)
                    kept.append(text)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], names=[*own, "n_lines", "n_dropped", "kept"])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields[:-1])
        return joined.mapInArrow(drop, f"{fields}, n_lines long, n_dropped long, kept string")


def line_dedup(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Drop every line whose key stands in at least ``min_docs`` rows of ``docs``.

    A key is the line without ASCII white space at both ends, A-Z lower-cased;
    blank lines have none and stay. ``docs`` has ``doc_id`` and ``text``;
    other columns pass through. Adds ``n_lines`` (before dropping),
    ``n_dropped`` and ``kept`` (other lines joined by \\n; input columns with
    these names are replaced, and _k1, _k2, _drop left out). A null or empty text is one blank line. Every
    row counts as a document, repeated ids and equal rows included.
    """
    return LineIndex.build(docs, min_docs).apply(docs)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = """
with l as (select doc_id, i, x, translate(trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') k
    from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) x,
        generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) i from documents)),
hot as (select k from l where k <> '' group by k having count(distinct doc_id) >= 10)
select doc_id, count(*) n_lines, count(*) filter (k in (select k from hot)) n_dropped,
    sha256(coalesce(string_agg(x, chr(10) order by i) filter (k not in (select k from hot)), '')) kept_sha256
from l group by doc_id
"""
