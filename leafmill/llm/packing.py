"""Best-fit packing of tokenized documents under several capacities at once.

Every piece is an item with three sizes: its tokens, one document, and its
attention cost (tokens squared). A sequence has a capacity for each. Items go
from longest to shortest into the fitting sequence that the rule prefers: the
largest weighted dot product of item and residual capacities ("dot", small
residuals preferred through negative weights), or the least weighted norm of
what would stay free ("norm").

Items of one length are alike, so the plan is made from how many items each
length has: at most ``capacity`` numbers whatever the corpus. Sequences with
equal contents are one state with a multiplicity; the plan says which ranks of
a length go to which range of sequences and where in them. Each piece then
finds its place by its rank within its length, which comes from its rank in
its own task plus an offset, so no length, however common, is gathered or
sorted in one place.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, cut, table

CAPACITY, END = 1024, 2
#: Entries of a task's memo from text pieces to token ids.
MEMO = 150_000

_ODD_SPACE = re.compile(r"[^\S \n]")
_SPLIT = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: Parts that may be encoded side by side, tabs between them: at most one space, then common letters and signs.
_PLAIN = re.compile(r"[ \n]?[!-~\u00a1-\u024f]+\Z")


def ranks_of(path: str) -> dict[bytes, int] | None:
    """Byte sequences to ids, if the file's ids follow the order of its merges; else None.

    Then merging the pair of least id, as a rank-based encoder does, is merging
    by the file's order.
    """
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    # fixed values of byte-level BPE: printable bytes stand for themselves, the others follow from 256 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    vocabulary, before = model["vocab"], -1
    for merge in model["merges"]:
        made = vocabulary["".join(merge if isinstance(merge, list) else merge.split(" "))]
        if made <= before:
            return None
        before = made
    return {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if all(c in byte for c in token)}


class MemoTokenizer:
    """Token ids of whole texts as bytes (little-endian, 32 bits each).

    Byte-level pre-tokenization never joins a character with white space that
    follows it, so a text may be cut before each run of spaces and line feeds
    that follows another character, and the ids of the parts follow each
    other. Parts are remembered. New plain parts are encoded side by side by
    the rank-based encoder, which gives the same ids faster; parts with special
    tokens or less common characters, and texts with other white space, go to
    the file's own tokenizer.
    """

    def __init__(self, path: str, most: int = MEMO):
        self.path, self.memo, self.most, self.own = path, {}, most, None
        ranks = ranks_of(path)
        if ranks:
            import public_tokenizers
            import tiktoken

            # without special tokens: parts that may hold one go to the own tokenizer
            self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={b: i for b, i in ranks.items()}, special_tokens={})
            self.tab = self.fast.encode_ordinary("\t")[0]
        else:
            self.fast = None

    def _encode(self, parts: list[str]) -> list[bytes]:
        if not parts:
            return []
        if self.own is None:
            from tokenizers import Tokenizer

            self.own = Tokenizer.from_file(self.path)
        return [np.array(e.ids, dtype="<u4").tobytes() for i in range(0, len(parts), 1000) for e in self.own.encode_batch_fast(parts[i : i + 1000], add_special_tokens=False)]

    def _learn(self, parts: set[str]) -> None:
        plain = [p for p in parts if _PLAIN.match(p) and "<|" not in p] if self.fast else []
        if plain:
            ids = self.fast.encode_to_numpy("\t".join(plain)).astype("<u4")
            raw, at = ids.tobytes(), 0
            for part, end in zip(plain, [*np.flatnonzero(ids == self.tab).tolist(), len(ids)]):
                self.memo[part] = raw[4 * at : 4 * end]
                at = end + 1
        rest = list(parts.difference(plain))
        self.memo.update(zip(rest, self._encode(rest)))

    def __call__(self, texts: list[str]) -> list[bytes]:
        whole = [i for i, t in enumerate(texts) if _ODD_SPACE.search(t)]
        odd = dict(zip(whole, self._encode([texts[i] for i in whole])))
        parts = [None if i in odd else _SPLIT.findall(t) for i, t in enumerate(texts)]
        asked = {p for x in parts if x for p in x}
        new = asked.difference(self.memo)
        if len(self.memo) + len(new) > self.most:
            self.memo.clear()
            new = asked
        self._learn(new)
        memo = self.memo
        return [odd[i] if x is None else b"".join([memo[p] for p in x]) for i, x in enumerate(parts)]


def plan(counts: dict[int, int], capacity: int, most_docs: int | None = None, most_cost: int | None = None, rule: str = "norm", weights=(1.0, 1.0, 1.0)):
    """Where items of each length go: rows (length, first rank, count, first sequence, offset), and how many sequences.

    ``counts``: items of each length from 1 to ``capacity``. A capacity of
    None binds nothing.
    """
    caps = np.array([capacity, most_docs or capacity, most_cost or capacity * capacity], dtype=np.float64)
    w = np.array(weights, dtype=np.float64)
    #: (residual tokens, documents, cost) -> ranges of sequences [first, end)
    open_: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
    rows, sequences = [], 0
    full = (capacity, int(caps[1]), int(caps[2]))
    for length in sorted(counts, reverse=True):
        left, rank, cost = counts[length], 0, length * length
        if cost > full[2] or length > capacity:
            raise ValueError(f"an item of {length} tokens fits no sequence")
        item = np.array([length, 1, cost]) / caps
        while left:
            states = [s for s in open_ if s[0] >= length and s[1] >= 1 and s[2] >= cost]
            if states:
                room = np.array(states) / caps
                after = room - item
                score = -(w * item * room).sum(1) if rule == "dot" else -(w * after**2).sum(1)
                best = max(range(len(states)), key=lambda i: (score[i], -states[i][0], states[i]))
                state = states[best]
            else:
                # as many alike sequences as these items alone will fill
                each = max(1, min(capacity // length, full[1], full[2] // cost))
                n = -(-left // each)
                state = full
                open_[state] = [(sequences, sequences + n)]
                sequences += n
            ranges = open_[state]
            first, end = ranges.pop()
            n = min(left, end - first)
            if first + n < end:
                ranges.append((first + n, end))
            if not ranges:
                del open_[state]
            rows.append((length, rank, n, first, capacity - state[0]))
            then = (state[0] - length, state[1] - 1, state[2] - cost)
            if then[0] > 0 and then[1] > 0:
                open_.setdefault(then, []).append((first, first + n))
            rank, left = rank + n, left - n
    return rows, sequences


def tokenized_pieces(docs: DataFrame, tokenizer: str, capacity: int, end: int) -> DataFrame:
    """One row per piece, with the task that made it and its rank in that task among equal lengths."""

    def pieces(batches):
        encode, task = MemoTokenizer(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        tail = np.array([end], dtype="<u4").tobytes()
        for batch in chunks(batches, 1 << 20):
            ids = [x + tail for x in encode([t or "" for t in batch.column(1).to_pylist()])]
            row, piece, start, length, crc, rank = [], [], [], [], [], []
            for i, x in enumerate(ids):
                n = len(x) // 4
                first = n % capacity or capacity  # the rest comes first; whole pieces follow
                at, k = 0, 0
                while at < n:
                    to = at + (first if not k else capacity)
                    size = to - at
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(x[4 * at : 4 * to]))
                    rank.append(int(seen[size]))
                    seen[size] += 1
                    at, k = to, k + 1
            columns = [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc, rank)), pa.array([task] * len(row), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "rank", "task"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(pieces, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, rank long, task int")


def pack(pieces: DataFrame, capacity: int = CAPACITY, most_docs: int | None = None, most_cost: int | None = None, rule: str = "norm", weights=(1.0, 1.0, 1.0)) -> DataFrame:
    """Places for ``pieces`` (``length, rank, task``): adds ``sequence_id, offset``."""
    per_task = pieces.groupBy("task", "length").agg(F.count("*").alias("c"))
    before = per_task.withColumn("before", F.sum("c").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)))
    counts = {r["length"]: r["c"] for r in per_task.groupBy("length").agg(F.sum("c").alias("c")).collect()}  # at most `capacity` rows
    rows, _ = plan(counts, capacity, most_docs, most_cost, rule, weights)
    lengths: dict[int, list] = {}
    for length, rank, n, first, offset in rows:
        lengths.setdefault(length, []).append((rank, first, offset))
    placed = pieces.sparkSession.sparkContext.broadcast({k: np.array(v, dtype=np.int64).T for k, v in lengths.items()})
    columns = [c for c in pieces.columns if c not in ("rank", "task")]
    ranked = pieces.join(before.select("task", "length", F.coalesce("before", F.lit(0)).alias("before")), ["task", "length"]).select(*columns, (F.col("rank") + F.col("before")).alias("_rank"))

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("length", "_rank"))
            sequence, offset = np.empty(len(length), dtype=np.int64), np.empty(len(length), dtype=np.int64)
            order = np.argsort(length, kind="stable")
            edges = np.concatenate([[0], np.flatnonzero(np.diff(length[order])) + 1, [len(order)]])
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                at = order[a:b]
                ranks, first, offsets = placed.value[int(length[at[0]])]
                k = np.searchsorted(ranks, rank[at], side="right") - 1
                sequence[at] = first[k] + rank[at] - ranks[k]
                offset[at] = offsets[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields[:-1])
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def best_fit_packing(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END, **limits) -> DataFrame:
    """Pack all of ``docs`` (``doc_id, text``; other columns are ignored) into sequences of at most ``capacity`` tokens.

    A document is its text's ids (null text: empty) and the id ``end``. Longer
    ones are cut into pieces of ``capacity`` tokens, the first of which takes
    the rest. Returns a row per piece: ``doc_id, piece, start, length,
    ids_crc32, sequence_id, offset``. Every row is packed, so repeated rows
    and ids are packed as often as they occur; no rows give none.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return pack(cut(tokenized_pieces(docs, tokenizer, capacity, end)), capacity, **limits)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"))
