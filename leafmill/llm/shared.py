"""Which keys occur at more than one place: a two-step exchange of packed keys.

Every task first looks at its own keys. A key it holds twice is settled there:
its places go on as confirmed, and a single representative travels. So however
common a key is, at most one entry of it per flush of a task is exchanged, and
no task gathers the places of a hot key. Entries travel as packed arrays,
about 16 to 24 bytes each, instead of as rows. The number of buckets follows
the input's bytes, so what a task holds at once does not grow with it.

Each shared key has owners: the first of its places in every flush that holds
it repeatedly, or, if there is no such flush, the first of all its places.
Flushes and orders depend on the rows alone, so reruns agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, blob_lists, chunks, mixed, partitions

#: Bytes of input for each bucket.
BUCKET_BYTES = 48 << 20

FLUSH = 2_000_000
SINGLE, CONFIRMED, REPRESENTATIVE, LEADING = 0, 1, 2, 3
#: A place with its key; ``own`` marks an owner of the key.
PLACE = np.dtype([("pos", "<i4"), ("own", "u1"), ("key", "<u8"), ("check", "<u4")])
_NONE = np.uint32(0xFFFFFFFF)

PACKED = "_bucket int, _n int, _key binary, _check binary, _flag binary, _doc binary, _pos binary, _a binary, _b binary"


def buckets_for(df: DataFrame, column: str = "text") -> int:
    """How many buckets to deal into, from the bytes of a column."""
    size = df.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(partitions(df.sparkSession), -(-size // BUCKET_BYTES))


def runs_of(key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by key, start of each run of equal keys in it, and the run's length."""
    order = np.argsort(key, kind="stable")
    k, c = key[order], check[order]
    same = k[1:] == k[:-1]
    if (same & (c[1:] != c[:-1])).any():  # keys agree by chance, checks don't
        order = np.lexsort((check, key))
        k, c = key[order], check[order]
        same = k[1:] == k[:-1]
    same &= c[1:] == c[:-1]
    starts = np.concatenate([[0], np.flatnonzero(~same) + 1]) if len(k) else np.empty(0, dtype=np.int64)
    return order, starts, np.diff(np.append(starts, len(k)))


def _pack(n_buckets, key, check, doc, pos, a, b):
    order, starts, lengths = runs_of(key, check)
    repeated = np.repeat(lengths > 1, lengths)
    flag = np.zeros(len(key), dtype=np.uint8)
    flag[order[repeated]] = CONFIRMED
    first = order[starts[lengths > 1]]  # of a stable order: the first place met
    flag[first] = LEADING
    key = np.concatenate([key, key[first]])
    check = np.concatenate([check, check[first]])
    pos = np.concatenate([pos, np.zeros(len(first), dtype=np.uint32)])
    flag = np.concatenate([flag, np.full(len(first), REPRESENTATIVE, dtype=np.uint8)])
    with np.errstate(over="ignore"):
        home = mixed(a.view(U64) * U64(3) + b.view(U64))
        bucket = (mixed(key) % U64(n_buckets)).astype(np.int32)
    settled = np.flatnonzero((flag == CONFIRMED) | (flag == LEADING))  # nothing is left to compare: dealt by document
    bucket[settled] = (home[doc[settled]] % U64(n_buckets)).astype(np.int32)
    doc = np.concatenate([doc, np.full(len(first), _NONE, dtype=np.uint32)])
    order, edges = blob_lists(bucket, n_buckets)
    rows = {n: [] for n in ("_bucket", "_n", "_key", "_check", "_flag", "_doc", "_pos", "_a", "_b")}
    for i in range(n_buckets):
        part = order[edges[i] : edges[i + 1]]
        if not len(part):
            continue
        docs, local = np.unique(doc[part], return_inverse=True)
        known = docs[docs != _NONE]
        local = np.where(doc[part] == _NONE, _NONE, local).astype(np.uint32)
        for n, x in (("_bucket", i), ("_n", len(part)), ("_key", key[part].tobytes()), ("_check", check[part].tobytes()), ("_flag", flag[part].tobytes()), ("_doc", local.tobytes()), ("_pos", pos[part].tobytes()), ("_a", a[known].tobytes()), ("_b", b[known].tobytes())):
            rows[n].append(x)
    return rows


def _packed_schema():
    return pa.schema([("_bucket", pa.int32()), ("_n", pa.int32()), *[(n, pa.binary()) for n in ("_key", "_check", "_flag", "_doc", "_pos", "_a", "_b")]])


def shared_places(df: DataFrame, keys_of, with_keys: bool = False, with_places: bool = False, n_buckets: int | None = None) -> DataFrame:
    """Places whose key occurs at two or more places in all of ``df``.

    ``df`` has longs ``_a, _b`` that name a row, and whatever ``keys_of`` needs.
    ``keys_of(batch)`` returns arrays: row in the batch, position, key (64 bits)
    and check (32 further bits). Returns ``_a, _b, positions`` for each row of
    ``df`` that has such places (equal rows share one); with ``with_keys`` one row per place:
    ``_key, _a, _b, _pos``; with ``with_places`` ``_a, _b, places``: packed ``PLACE``s in order.
    """
    n_buckets = n_buckets or partitions(df.sparkSession)

    def pack(batches):
        held, size, docs = [], 0, 0

        def flush():
            key, check, doc, pos = (np.concatenate([h[i] for h in held]) for i in range(4))
            a, b = (np.concatenate([h[i] for h in held]) for i in (4, 5))
            return pa.RecordBatch.from_pydict(_pack(n_buckets, key, check, doc, pos, a, b), schema=_packed_schema())

        for batch in chunks(batches):
            row, pos, key, check = keys_of(batch)
            if not len(key):
                continue
            a, b = (batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("_a", "_b"))
            held.append((key, check.astype(np.uint32), (row + docs).astype(np.uint32), pos.astype(np.uint32), a, b))
            docs += len(a)
            size += len(key)
            if size >= FLUSH:
                yield flush()
                held, size, docs = [], 0, 0
        if held:
            yield flush()

    def settle(batches):
        cols = {n: [] for n in ("key", "check", "flag", "doc", "pos", "a", "b")}
        docs = 0
        for batch in batches:
            for r in batch.to_pylist():
                doc = np.frombuffer(r["_doc"], dtype=np.uint32)
                cols["key"].append(np.frombuffer(r["_key"], dtype=U64))
                cols["check"].append(np.frombuffer(r["_check"], dtype=np.uint32))
                cols["flag"].append(np.frombuffer(r["_flag"], dtype=np.uint8))
                cols["pos"].append(np.frombuffer(r["_pos"], dtype=np.uint32))
                cols["doc"].append(np.where(doc == _NONE, 0, doc).astype(np.int64) + docs)
                for n in ("a", "b"):
                    cols[n].append(np.frombuffer(r[f"_{n}"], dtype=np.int64))
                docs += len(cols["a"][-1])
        if not cols["key"]:
            return
        key, check, flag, doc, pos, a, b = (np.concatenate(cols[n]) for n in cols)
        settled = (flag == CONFIRMED) | (flag == LEADING)
        own = flag == LEADING
        rest = np.flatnonzero(~settled)
        order, starts, lengths = runs_of(key[rest], check[rest])
        keep = settled.copy()
        found = rest[order[np.repeat(lengths > 1, lengths)]]
        keep[found[flag[found] == SINGLE]] = True
        if with_places:
            # of a key without a leading place the least one owns it
            run = np.repeat(np.arange(len(starts))[lengths > 1], lengths[lengths > 1])
            of = np.minimum(doc[found], max(len(a) - 1, 0))  # a representative belongs to no document
            least = np.lexsort((pos[found], *((b[of], a[of]) if len(a) else ()), flag[found] == SINGLE, run))
            heads = least[np.flatnonzero(np.diff(run[least], prepend=-1))]
            own[found[heads[flag[found[heads]] == SINGLE]]] = True
        at = np.flatnonzero(keep)
        if not len(at):
            return
        if with_keys:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[at].view(np.int64), a[doc[at]], b[doc[at]], pos[at].astype(np.int32))], names=["_key", "_a", "_b", "_pos"])
            return
        # packed again by the document's home, so rows don't multiply with the parts
        da, db = a[doc[at]], b[doc[at]]
        with np.errstate(over="ignore"):
            order, edges = blob_lists(mixed(da.view(U64) * U64(3) + db.view(U64)) % U64(n_buckets), n_buckets)
        homes = np.flatnonzero(np.diff(edges))
        parts = [order[edges[i] : edges[i + 1]] for i in homes]
        if with_places:
            values = np.zeros(len(at), dtype=PLACE)
            for n, x in (("pos", pos), ("own", own), ("key", key), ("check", check)):
                values[n] = x[at]
        else:
            values = pos[at].astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(homes.astype(np.int32)), *(pa.array([x[part].tobytes() for part in parts], pa.binary()) for x in (da, db, values))], names=["_home", "_a", "_b", "_pos"])

    def gather(batches):
        kinds = (("_a", np.int64), ("_b", np.int64), ("_pos", PLACE if with_places else np.int32))
        held = [[np.frombuffer(r[n], dtype=t) for n, t in kinds] for batch in batches for r in batch.to_pylist()]
        if not held:
            return
        a, b, pos = (np.concatenate([h[i] for h in held]) for i in range(3))
        order = np.lexsort((pos["pos"], b, a)) if with_places else np.lexsort((pos, b, a))
        a, b, pos = a[order], b[order], pos[order]
        starts = np.concatenate([[0], np.flatnonzero((np.diff(a) != 0) | (np.diff(b) != 0)) + 1])
        for i in range(0, len(starts), 10_000):
            part = starts[i : i + 10_000]
            to = starts[i + 10_000] if i + 10_000 < len(starts) else len(pos)
            if with_places:
                blobs = [pos[x:y].tobytes() for x, y in zip(part, np.append(part[1:], to))]
                yield pa.RecordBatch.from_arrays([pa.array(a[part]), pa.array(b[part]), pa.array(blobs, pa.binary())], names=["_a", "_b", "places"])
                continue
            offsets = np.append(part, to) - part[0]
            positions = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(pos[part[0] : to]))
            yield pa.RecordBatch.from_arrays([pa.array(a[part]), pa.array(b[part]), positions], names=["_a", "_b", "positions"])

    packed = df.mapInArrow(pack, PACKED)
    dealt = packed.repartitionById(n_buckets, F.col("_bucket"))
    if with_keys:
        return dealt.mapInArrow(settle, "_key long, _a long, _b long, _pos int")
    homes = dealt.mapInArrow(settle, "_home int, _a binary, _b binary, _pos binary")
    return homes.repartitionById(n_buckets, F.col("_home")).mapInArrow(gather, "_a long, _b long, places binary" if with_places else "_a long, _b long, positions array<int>")
