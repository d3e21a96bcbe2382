"""Substring dedup by recompression: long repeats found by consistent symbols.

A text is a sequence of symbols that rounds rewrite: runs of one symbol, then
pairs of neighbours, become one symbol of a new name. Names follow from what a
symbol stands for, so equal substrings get equal names everywhere, and which
neighbours merge depends on a bounded stretch around them, so of two equal
substrings the interior symbols are equal.

1. The first rounds name runs and pairs of words inside the scan: symbols of a
   few words. In each window the least of those that keep ``MARGIN`` words off
   its ends is its anchor, the same one in all equal windows. A census over all
   documents finds which anchors, with ``MARGIN`` words around, occur twice.
   They are the first global symbols; all others can be in no repeat.
2. Each further round is a Spark stage. In every document's sequence of global
   symbols some pairs of neighbours are proposed (those whose hash is least
   among the pairs around them); a pair's name is made of the two names and
   their distance, so it stands for all words from the first to the last. The
   census keeps proposed names that occur twice: these pairs become one symbol.
   A pair that occurs once is never looked at again: no longer symbol over it
   can occur twice. Rounds go on until little merges, ``ROUNDS`` at most.
3. The highest symbols of ``width`` words or more are verified long repeats:
   every window inside is a repeat. One owner per symbol sends its windows on
   for windows elsewhere to meet; the others send none. Windows over an anchor
   that no such symbol covers, at the fringes, are verified outwards over all
   their words, by 96 bits, in one more census.

Rows that repeat as a whole are counted first; one of them takes part.

A window's width is a parameter; ``MARGIN`` and symbol lengths follow from the
rounds and need a width of at least 30.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .common import MULTIPLIER, SECOND_MULTIPLIER, U64, chunks, cut, group_join, hashes128, measured, mixed, row_keys, rows_of, table, tidy, window_hashes, words_of
from .shared import shared_places

WINDOW = 35
#: Longest run named, longest symbol of each pair round; what these see around a symbol: 3 + 3 + 4 words.
LONGEST_RUN, PAIR_CAPS = 3, (4, 5)
MARGIN = LONGEST_RUN + LONGEST_RUN + PAIR_CAPS[0]
AROUND = 2 * MARGIN + 1


def recompress(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names, first words and lengths of the last round's symbols. words: hashes; doc: row of each word."""
    with np.errstate(over="ignore"):
        edge = np.concatenate([[0], np.flatnonzero((words[1:] != words[:-1]) | (doc[1:] != doc[:-1])) + 1])
        run = np.diff(np.append(edge, len(words)))
        keep = np.ones(len(words), dtype=bool)
        short = (run > 1) & (run <= LONGEST_RUN)
        inside = np.repeat(short, run)
        keep[inside] = False
        keep[edge] = True
        name, length = words.copy(), np.ones(len(words), dtype=np.int64)
        at = edge[short]
        name[at] = mixed(words[at] * MULTIPLIER + run[short].astype(U64))
        length[at] = run[short]
        start = np.flatnonzero(keep)
        name, length, row = name[start], length[start], doc[start]
        for k, cap in enumerate(PAIR_CAPS):
            left = (mixed(name + U64(k + 1) * SECOND_MULTIPLIER) >> U64(63)).astype(bool)
            joins = left[:-1] & ~left[1:] & (row[:-1] == row[1:]) & (length[:-1] + length[1:] <= cap)
            at = np.flatnonzero(joins)
            name[at] = mixed(mixed(name[at] * MULTIPLIER + U64(1)) + name[at + 1] * SECOND_MULTIPLIER)
            length[at] += length[at + 1]
            keep = np.ones(len(name), dtype=bool)
            keep[at + 1] = False
            name, length, row, start = name[keep], length[keep], row[keep], start[keep]
    return name, start, length


def anchors(words: np.ndarray, doc: np.ndarray, first: np.ndarray, width: int):
    """For each window inside one document: its first word and its anchor's symbol; then all symbols."""
    name, start, length = recompress(words, doc)
    last = np.flatnonzero(doc[width - 1 :] == doc[: len(doc) - width + 1])  # first words of windows
    lo = np.searchsorted(start, last + MARGIN)
    hi = np.searchsorted(start + length, last + width - MARGIN, side="right")
    value = mixed(name ^ MULTIPLIER)
    levels = [np.arange(len(name))]
    while 2 ** len(levels) <= (hi - lo).max(initial=1):
        x, half = levels[-1], 2 ** (len(levels) - 1)
        a, b = x[:-half], x[half:]
        levels.append(np.where(value[b] < value[a], b, a))  # the leftmost of equal ones
    best = np.empty(len(last), dtype=np.int64)
    level = np.frexp((hi - lo).astype(np.float64))[1] - 1
    for k, x in enumerate(levels):
        at = np.flatnonzero(level == k)
        a, b = x[lo[at]], x[hi[at] - 2**k]
        best[at] = np.where(value[b] < value[a], b, a)
    return last, best, name, start


def _words(batch):
    """Hashes (n x 2), row of each word and each row's first word."""
    lists = [words_of(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
    sizes = np.array([len(x) for x in lists], dtype=np.int64)
    flat = [w for x in lists for w in x]
    return lists, hashes128(flat), np.repeat(np.arange(len(lists)), sizes), np.cumsum(sizes) - sizes


_EMPTY = (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=U64), np.empty(0, dtype=np.uint32))


def _anchor_keys(width: int):
    def keys(batch):
        _, h, doc, first = _words(batch)
        if len(h) < width:
            return _EMPTY
        words = np.ascontiguousarray(h[:, 0])
        windows, best, name, start = anchors(words, doc, first, width)
        if not len(windows):
            return _EMPTY
        chosen = np.zeros(len(name), dtype=bool)
        chosen[best] = True
        at = np.flatnonzero(chosen)
        s = start[at]
        with np.errstate(over="ignore"):
            key = mixed(window_hashes(words, AROUND)[s - MARGIN] + name[at] * SECOND_MULTIPLIER)
        check = window_hashes(np.ascontiguousarray(h[:, 1]), AROUND, SECOND_MULTIPLIER)[s - MARGIN] >> U64(32)
        return doc[s], s - first[doc[s]], key, check.astype(np.uint32)

    return keys


#: A symbol of a document's sequence: words [start, end), its name of 96 bits, whether it is an owner, whether the pair with the next one is known to occur once.
SYMBOL = np.dtype([("start", "<i4"), ("end", "<i4"), ("name", "<u8"), ("check", "<u4"), ("own", "u1"), ("once", "u1")])


def first_symbols(places: bytes) -> np.ndarray:
    """The sequence of a document's shared anchors with the words around them."""
    places = np.frombuffer(places, dtype=shared.PLACE)
    out = np.zeros(len(places), dtype=SYMBOL)
    out["start"], out["end"] = places["pos"] - MARGIN, places["pos"] + MARGIN + 1
    out["name"], out["check"], out["own"] = places["key"], places["check"], places["own"]
    same = np.flatnonzero(out["start"][1:] == out["start"][:-1])
    out["own"][same] |= out["own"][same + 1]
    return np.delete(out, same + 1)


def proposed(seq: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, names and checks of the pairs to merge in sequences that begin at ``first`` (places; sorted).

    Two symbols are neighbours if no word lies between them. A pair is
    proposed if its hash is less than those of the pairs before and after it;
    in a run of equal pairs every other one is, from its left end on.
    """
    with np.errstate(over="ignore"):
        distance = (seq["start"][1:] - seq["start"][:-1]).astype(U64)
        name = mixed(mixed(seq["name"][:-1] * MULTIPLIER + distance) + seq["name"][1:] * SECOND_MULTIPLIER)
        check = (mixed(mixed(seq["check"][:-1].astype(U64) * SECOND_MULTIPLIER + distance) + seq["check"][1:] * MULTIPLIER) >> U64(32)).astype(np.uint32)
    fits = (seq["start"][1:] <= seq["end"][:-1]) & (seq["once"][:-1] == 0)
    fits[first[1:] - 1] = False
    most = U64(0xFFFFFFFFFFFFFFFF)
    value = np.where(fits, np.minimum(mixed(name ^ SECOND_MULTIPLIER), most - U64(1)), most)
    run = np.concatenate([[0], np.flatnonzero(value[1:] != value[:-1]) + 1]) if len(value) else np.empty(0, dtype=np.int64)
    turn = np.arange(len(value)) - np.repeat(run, np.diff(np.append(run, len(value))))
    value = np.where(turn % 2 == 1, most, value)
    before, after = np.concatenate([[most], value[:-1]]), np.concatenate([value[1:], [most]])
    at = np.flatnonzero(fits & (value < before) & (value < after))
    return at, name[at], check[at]


def _pair_keys(batch):
    blobs = [np.frombuffer(x, dtype=SYMBOL) for x in batch.column(batch.schema.get_field_index("symbols")).to_pylist()]
    sizes = np.array([len(x) for x in blobs], dtype=np.int64)
    first = np.cumsum(sizes) - sizes
    at, name, check = proposed(np.concatenate(blobs), first)
    row = np.repeat(np.arange(len(blobs)), sizes)[at]
    return row, at - first[row], name, check


def merged(seq: np.ndarray, found: bytes | None) -> np.ndarray:
    """One sequence after a round: shared pairs are one symbol, other proposed ones are marked."""
    at, name, check = proposed(seq, np.zeros(1, dtype=np.int64))
    places = np.frombuffer(found, dtype=shared.PLACE) if found is not None else np.empty(0, dtype=shared.PLACE)
    seq = seq.copy()
    seq["once"][at] = 1
    pos = places["pos"]
    seq["name"][pos], seq["check"][pos] = places["key"], places["check"]
    seq["end"][pos] = np.maximum(seq["end"][pos], seq["end"][pos + 1])
    seq["own"][pos] = 0
    np.bitwise_or.at(seq["own"], pos, places["own"])
    seq["once"][pos] = seq["once"][pos + 1]
    return np.delete(seq, np.unique(pos) + 1)


def parted(seq: np.ndarray, width: int) -> tuple[bytes, bytes]:
    """The symbols that a later round may still merge, and those of ``width`` words or more of the others.

    A symbol that is left out stands between no two that may merge: the pair
    before it is known to occur once, or words lie between.
    """
    may = (seq["start"][1:] <= seq["end"][:-1]) & (seq["once"][:-1] == 0)
    live = np.concatenate([may, [False]]) | np.concatenate([[False], may])
    return seq[live].tobytes(), seq[~live & (seq["end"] - seq["start"] >= width)].tobytes()


#: Rounds of pairs: symbols then have some 25 times as many words as the first ones; one round in which less than a part in so many merges is the last.
ROUNDS, LEAST_MERGED = 8, 50


def highest_symbols(places: DataFrame, width: int, n_buckets: int, most_rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Each document's first symbols' places, ``_a, _b, listed``, and its symbols of ``width`` words or more after the last round, ``_a, _b, symbols``.

    ``places`` is what ``shared_places`` gives. Only sequences that may still
    merge go from round to round. A round's sequences lie in the checkpoint
    folder, so owners are the same for all that follows.
    """

    def begin(batches):
        for batch in batches:
            listed = [np.ascontiguousarray(np.frombuffer(x, dtype=shared.PLACE)["pos"]).tobytes() for x in batch.column(2).to_pylist()]
            made = [parted(first_symbols(x), width) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(listed, pa.binary()), *(pa.array([m[i] for m in made], pa.binary()) for i in (0, 1))], names=["_a", "_b", "listed", "symbols", "ended"])

    def advance(batches):
        for batch in batches:
            made = [parted(merged(np.frombuffer(x, dtype=SYMBOL), y), width) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([m[i] for m in made], pa.binary()) for i in (0, 1))], names=["_a", "_b", "symbols", "ended"])

    size = F.sum(F.length("symbols"))
    first = cut(places.mapInArrow(begin, "_a long, _b long, listed binary, symbols binary, ended binary"), size=size)
    current, parts, before = first.select("_a", "_b", "symbols", "ended"), [], None
    left = measured(first)["size"] or 0
    for _ in range(most_rounds):
        if not left or before is not None and (before - left) * LEAST_MERGED < before:
            break
        parts.append(current.select("_a", "_b", F.col("ended").alias("symbols")))
        live = current.filter(F.length("symbols") > 0).select("_a", "_b", "symbols")
        # in one order, so that reruns flush alike
        found = shared_places(live.sortWithinPartitions("_a", "_b"), _pair_keys, with_places=True, n_buckets=n_buckets)
        current = cut(live.join(found, ["_a", "_b"], "left").select("_a", "_b", "symbols", "places").mapInArrow(advance, "_a long, _b long, symbols binary, ended binary"), size=size)
        before, left = left, measured(current)["size"] or 0
    parts += [current.select("_a", "_b", "symbols"), current.select("_a", "_b", F.col("ended").alias("symbols"))]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)

    def long_ones(batches):
        """All long symbols of a document, of all rounds."""
        for batch in batches:
            made = [(seq := np.frombuffer(b"".join(x), dtype=SYMBOL))[seq["end"] - seq["start"] >= width].tobytes() for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], names=["_a", "_b", "symbols"])

    symbols = found.filter(F.length("symbols") > 0).groupBy("_a", "_b").agg(F.collect_list("symbols").alias("s")).mapInArrow(long_ones, "_a long, _b long, symbols binary")
    return first.select("_a", "_b", "listed"), symbols.filter(F.length("symbols") > 0)


def _window_keys(width: int):
    """Windows over a shared anchor, but for those inside a highest symbol that another place owns."""

    def keys(batch):
        known = batch.column(batch.schema.get_field_index("listed")).is_valid()
        rows = np.flatnonzero(known.to_numpy(zero_copy_only=False))
        batch = batch.filter(known)
        _, h, doc, first = _words(batch)
        if len(h) < width:
            return _EMPTY
        words = np.ascontiguousarray(h[:, 0])
        windows, best, _, start = anchors(words, doc, first, width)
        wanted = np.zeros(len(words) + 1, dtype=bool)
        covered = np.zeros(len(words) + 1, dtype=np.int64)
        for at, listed, seq in zip(first, batch.column(batch.schema.get_field_index("listed")).to_pylist(), batch.column(batch.schema.get_field_index("symbols")).to_pylist()):
            wanted[at + np.frombuffer(listed, dtype=np.int32)] = True
            seq = np.frombuffer(seq or b"", dtype=SYMBOL)
            long = seq[seq["own"] == 0]
            np.add.at(covered, at + long["start"], 1)
            np.add.at(covered, at + long["end"] - width + 1, -1)
        at = windows[wanted[start[best]] & (np.cumsum(covered)[windows] == 0)]
        one = window_hashes(words, width)[at]
        two = window_hashes(np.ascontiguousarray(h[:, 1]), width, SECOND_MULTIPLIER)[at]
        return rows[doc[at]], at - first[doc[at]], one, (two >> U64(32)).astype(np.uint32)

    return keys


def spans_of(n: int, width: int, starts: np.ndarray, symbols: bytes | None) -> list[dict]:
    """Stretches of words covered by windows that begin at ``starts`` or lie in long symbols."""
    covered = np.zeros(n + 1, dtype=np.int64)
    starts = np.unique(starts).astype(np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + width, -1)
    if symbols is not None:
        seq = np.frombuffer(symbols, dtype=SYMBOL)
        np.add.at(covered, seq["start"], 1)
        np.add.at(covered, seq["end"], -1)
    inside = np.cumsum(covered[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    return [{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)]


def substring_dedup(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """Remove every word covered by a window of ``width`` words that occurs anywhere else.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored. Returns a
    row per row: ``doc_id, n_words, n_removed, kept`` (kept words joined by one
    space), ``removed`` (spans of words, start and end). A null or empty text
    has no words and an empty ``kept``; texts shorter than the window stay
    whole; rows that repeat, even with one id, are each other's elsewhere.
    """
    if width < 2 * MARGIN + 2 * PAIR_CAPS[-1] - 1:
        raise ValueError(f"width must be at least {2 * MARGIN + 2 * PAIR_CAPS[-1] - 1}")
    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, n_words long, n_removed long, kept string, removed array<struct<start:int,end:int>>"
    docs = docs.select("doc_id", "text").select("doc_id", "text", *row_keys())
    n_buckets = shared.buckets_for(docs)

    # rows that repeat as a whole: all their windows do; one of them takes part for others
    repeated = cut(docs.groupBy("_k1", "_k2").agg(F.count("*").alias("n")).filter("n > 1").select("_k1", "_k2"))
    if rows_of(repeated):
        marked = group_join(docs, repeated.withColumn("_twin", F.lit(True)), ["_k1", "_k2"], row_bytes=64, how="left")
        twins, single = marked.filter("_twin"), marked.filter("_twin is null")
        docs = single.select("doc_id", "text", "_k1", "_k2", F.lit(False).alias("_twin"))
        docs = docs.unionByName(twins.select("doc_id", "text", "_k1", "_k2", F.lit(True).alias("_twin")).dropDuplicates(["_k1", "_k2"]))
    else:
        twins, docs = None, docs.withColumn("_twin", F.lit(False))

    named = docs.select(F.col("_k1").alias("_a"), F.col("_k2").alias("_b"), "text")
    listed, symbols = highest_symbols(shared_places(named, _anchor_keys(width), with_places=True, n_buckets=n_buckets), width, n_buckets)
    tidy(docs.sparkSession)
    known = listed.join(symbols, ["_a", "_b"], "left").select(F.col("_a").alias("_k1"), F.col("_b").alias("_k2"), "symbols", "listed")
    joined = docs.join(known, ["_k1", "_k2"], "left").select("doc_id", "text", "_twin", F.col("_k1").alias("_a"), F.col("_k2").alias("_b"), "symbols", "listed")
    windows = shared_places(joined.filter("listed is not null").select("text", "_a", "_b", "symbols", "listed"), _window_keys(width), n_buckets=n_buckets)
    last = joined.join(windows.withColumnRenamed("positions", "starts"), ["_a", "_b"], "left").filter("not _twin").select("doc_id", "text", "starts", "symbols")

    def remove(batches):
        for batch in chunks(batches):
            out = {"doc_id": batch.column(0), "n_words": [], "n_removed": [], "kept": [], "removed": []}
            for text, starts, seq in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                words = words_of(text)
                starts = starts.values.to_numpy(zero_copy_only=False) if starts.is_valid else np.empty(0, dtype=np.int64)
                spans = spans_of(len(words), width, starts, seq)
                _put(out, words, spans)
            yield _removed_batch(out)

    def remove_all(batches):
        for batch in chunks(batches):
            out = {"doc_id": batch.column(0), "n_words": [], "n_removed": [], "kept": [], "removed": []}
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                _put(out, words, [{"start": 0, "end": len(words)}] if len(words) >= width else [])
            yield _removed_batch(out)

    found = last.mapInArrow(remove, shape)
    return found if twins is None else found.unionByName(twins.select("doc_id", "text").mapInArrow(remove_all, shape))


def _put(out: dict, words: list[bytes], spans: list[dict]) -> None:
    out["n_words"].append(len(words))
    out["n_removed"].append(sum(s["end"] - s["start"] for s in spans))
    for s in reversed(spans):
        del words[s["start"] : s["end"]]
    out["kept"].append(b" ".join(words).decode("utf-8", "surrogatepass"))
    out["removed"].append(spans)


def _removed_batch(out: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([out["doc_id"], pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept"], pa.string()), pa.array(out["removed"], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], names=list(out))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = """
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') w from documents),
i as (select doc_id, unnest(range(1, greatest(len(w) - 33, 1))) i, w from w where len(w) >= 35),
k as (select doc_id, i, sha256(array_to_string(list_slice(w, i, i + 34), ' ')) k from i),
r as (select doc_id, i from k where k in (select k from k group by k having count(*) > 1)),
g as (select doc_id, unnest(range(i, i + 35)) j from r), gone as (select distinct doc_id, j from g),
l as (select doc_id, list(j) js from gone group by doc_id)
select w.doc_id, len(w) n_words, coalesce(len(js), 0)::bigint n_removed,
    sha256(array_to_string(case when js is null then w else list_filter(w, lambda x, n: not list_contains(js, n)) end, ' ')) kept_sha256
from w left join l using (doc_id)
"""


def brute_force(texts: list[str | None], width: int = WINDOW) -> list[tuple[int, int, str]]:
    """The same by comparing all windows; for tests."""
    seen: dict[tuple, int] = {}
    words = [words_of(t) for t in texts]
    for w in words:
        for i in range(len(w) - width + 1):
            seen[key] = seen.get(key := tuple(w[i : i + width]), 0) + 1
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return out
