"""The corpus operators against brute force, on small tables with every awkward row."""

from __future__ import annotations

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from leafmill.llm import components, language, line_dedup, mixing, ngram_join, packing, quality, shared, substring_dedup, topk, toxicity, url_filter

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, _k1 string"


def awkward() -> list[tuple]:
    """Null, empty, blank, tiny, long and repeated rows, with clashing columns."""
    rnd = random.Random(8)
    base = " ".join(rnd.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rnd.randrange(400)) for _ in range(120))
    edited = base.split()
    edited[60] = "other"
    texts = [None, "", " \t\n ", "one", "one two three", base, base, base.upper(), " ".join(edited), base + "\n" + base, "x " * 3000, "idiot fool " * 4, "Common line\n" + base[:80]]
    texts += [f"  COMMON line \nown {i}\n\n" for i in range(11)]
    texts += [" ".join(f"w{rnd.randrange(10**6)}" for _ in range(200)) + " " + base[:400] + " \u2003é\x1c<|endoftext|> end", "日本語 テキスト", "12 34 !!"]
    rows = [(i, t, ["en", "de", None][i % 3], "hot" if i % 2 else None, len(t or ""), "s", "k", "c") for i, t in enumerate(texts)]
    return [*rows, rows[5], (5, "same id, other text", "en", None, 3, "s", "k", "c")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_substring_dedup(spark, docs, empty):
    want = Counter((d, *w) for (d, *_), w in zip(awkward(), substring_dedup.brute_force([r[1] for r in awkward()])))
    out = substring_dedup.substring_dedup(docs)
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in out.collect())
    assert got == want
    assert substring_dedup.substring_dedup(empty).count() == 0
    with pytest.raises(ValueError, match="width"):
        substring_dedup.substring_dedup(docs, 10)


@pytest.mark.parametrize("seed", [1, 2])
def test_long_and_short_repeats(spark, monkeypatch, seed):
    """Passages that repeat in part, periodic stretches, edits and equal rows; many small flushes, so owners differ."""
    if seed == 1:
        monkeypatch.setattr(shared, "FLUSH", 500)
    rnd = random.Random(seed)
    pool = [[f"p{k}_{rnd.randrange(400)}" for _ in range(rnd.randrange(30, 260))] for k in range(8)]
    texts = []
    for _ in range(60):
        w = []
        for _ in range(rnd.randrange(1, 6)):
            kind = rnd.random()
            if kind < 0.6:
                passage = rnd.choice(pool)
                at = rnd.randrange(len(passage) // 2)
                w += passage[at : at + rnd.randrange(10, 300)]
            elif kind < 0.75:
                w += ["x", "y"][: rnd.randrange(1, 3)] * rnd.randrange(10, 60)
            else:
                w += [f"u{rnd.randrange(10**6)}" for _ in range(rnd.randrange(1, 60))]
        for _ in range(rnd.randrange(4)):
            w[rnd.randrange(len(w))] = "edited"
        texts.append(" ".join(w))
    texts += [texts[3], texts[3], texts[5]]
    df = spark.createDataFrame([(i % 50, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    got = Counter((r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in substring_dedup.substring_dedup(df).collect())
    assert got == Counter(substring_dedup.brute_force(texts))


def test_symbols_verify_long_repeats(spark, monkeypatch):
    """Highest symbols cover most of a long repeat; without shared symbols nothing is removed."""
    rnd = random.Random(22)
    words = lambda n: [f"v{rnd.randrange(10**6)}" for _ in range(n)]
    passage = words(2000)
    df = spark.createDataFrame([(i, " ".join([*words(40), *passage, *words(40)])) for i in range(6)], "doc_id long, text string").repartition(3)
    seen = []
    real = substring_dedup.highest_symbols

    def watched(*args, **more):
        listed, symbols = real(*args, **more)
        seen.append(symbols)
        return listed, symbols

    monkeypatch.setattr(substring_dedup, "highest_symbols", watched)
    assert {r["n_removed"] for r in substring_dedup.substring_dedup(df).collect()} == {2000}
    covered = [np.frombuffer(bytes(r["symbols"]), dtype=substring_dedup.SYMBOL) for r in seen[0].collect()]
    assert len(covered) == 6 and all((c["end"] - c["start"]).sum() > 1500 and (c["end"] - c["start"]).max() > 60 for c in covered)
    assert any((c["own"] == 1).any() for c in covered) and any((c["own"] == 0).all() for c in covered)
    monkeypatch.setattr(substring_dedup, "highest_symbols", lambda *args, **more: tuple(x.limit(0) for x in real(*args, **more)))
    assert {r["n_removed"] for r in substring_dedup.substring_dedup(df).collect()} == {0}


def test_recompression_is_consistent():
    """Equal windows have equal symbols in their middle, and every window an anchor."""
    rng = np.random.default_rng(1)
    words = rng.integers(0, 3, 4000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    words[500:800] = words[1500:1800]
    words[2000:2100] = words[2000]
    doc = np.repeat(np.arange(4), 1000)
    windows, best, name, start = substring_dedup.anchors(words, doc, np.arange(4) * 1000, 35)
    assert len(windows) == 4 * (1000 - 34)
    seen = {}
    for p, b in zip(windows, best):
        assert p + substring_dedup.MARGIN <= start[b] <= p + 35 - substring_dedup.MARGIN
        assert seen.setdefault(words[p : p + 35].tobytes(), (start[b] - p, name[b])) == (start[b] - p, name[b])


def test_line_dedup(spark, docs, empty):
    rows = awkward()
    counts = Counter(k for r in rows for k in {k for k in line_dedup.line_keys(r[1]) if k})
    out = line_dedup.line_dedup(docs)
    assert [c for c in out.columns if c in docs.columns and c != "kept"] == [c for c in docs.columns if c not in ("kept", "_k1")]
    got = Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in out.collect())
    want = Counter()
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x, k in zip(lines, line_dedup.line_keys(r[1])) if not k or counts[k] < 10]
        want[(r[0], len(lines), len(lines) - len(kept), "\n".join(kept))] += 1
    assert got == want and any(d for _, _, d, _ in want)
    assert line_dedup.line_dedup(empty).count() == 0


def test_line_index_is_reversible(spark, docs):
    some = docs.filter("doc_id < 20").cache()
    more = docs.filter("doc_id >= 20")
    index = line_dedup.LineIndex.build(some, 9)
    state = lambda i: (sorted(map(tuple, i.counts.collect())), sorted((r["doc_id"], r["kept"]) for r in i.apply(some).collect()))
    before = state(index)
    grown = index.insert(more)
    assert state(grown) == state(line_dedup.LineIndex.build(docs, 9)) != before
    assert state(grown.delete(more)) == before


def test_unknown_documents_cannot_be_deleted(docs):
    index = line_dedup.LineIndex.build(docs.filter("doc_id < 3"), 2)
    with pytest.raises(ValueError, match="not been inserted"):
        index.delete(docs.filter("doc_id >= 15"))


def test_line_dedup_by_exchange(docs, monkeypatch):
    """Too many exact keys for a broadcast: lines are settled by a join, with the same rows."""
    want = sorted((r["doc_id"], r["kept"]) for r in line_dedup.line_dedup(docs).collect())
    monkeypatch.setattr(line_dedup, "EXACT_KEYS", -1)
    assert sorted((r["doc_id"], r["kept"]) for r in line_dedup.line_dedup(docs).collect()) == want


def test_line_index_without_broadcast(docs, monkeypatch):
    want = sorted((r["doc_id"], r["kept"]) for r in line_dedup.line_dedup(docs).collect())
    monkeypatch.setattr(line_dedup, "FILTER_BYTES", -1)
    assert sorted((r["doc_id"], r["kept"]) for r in line_dedup.line_dedup(docs).collect()) == want


def test_cuckoo_filter():
    rng = np.random.default_rng(2)
    h1, h2 = rng.integers(0, 2**63, (2, 3000)).astype(np.uint64)
    made = line_dedup.CuckooFilter.of(h1, h2)
    assert made.contains(h1, h2).all()
    for a, b in zip(h1[:1500].tolist(), h2[:1500].tolist()):
        assert made.delete(a, b)
    again = line_dedup.CuckooFilter.from_bytes(made.to_bytes())
    assert again.contains(h1[1500:], h2[1500:]).all() and again.contains(h1[:1500], h2[:1500]).mean() < 0.05
    full = line_dedup.CuckooFilter(1)
    while full.insert(*rng.integers(0, 2**63, 2).tolist()):
        before = full.to_bytes()
    assert (full.table > 0).sum() == np.count_nonzero(np.frombuffer(full.to_bytes(), np.uint16)) and len(before) == len(full.to_bytes())


def test_ngram_join(spark, docs, empty):
    rows = [(r[0], r[1]) for r in awkward()]
    rnd = random.Random(9)
    base = [f"b{rnd.randrange(10**6)}" for _ in range(80)]
    for i in range(60):  # copies with up to seven edits, so some link and some don't
        w = list(base)
        for _ in range(rnd.randrange(8)):
            w[rnd.randrange(80)] = f"e{rnd.randrange(10**6)}"
        rows.append((100 + i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).repartition(4)
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(df).collect())
    assert got == Counter(ngram_join.brute_force(rows))
    assert ngram_join.ngram_join(empty).count() == 0


def test_links_inside_a_prefix_group(spark):
    """Two of three sets with one prefix link, the third doesn't, whichever of them leads the group."""
    rnd = random.Random(18)
    ids = rnd.sample(range(10**6), 2000)
    rows, roles, bare = [], {}, set()
    for f in range(24):
        rare, common = [f"r{f}x{i}" for i in range(5)], [f"c{f}x{i}" for i in range(22)]
        # 16 words, a prefix of 5: the first two share 14, the third shares 5 with them
        texts = [rare + common[:9] + common[9:11], rare + common[:9] + common[11:13], rare + common[11:22]]
        if f % 2:  # another group holds the last of the rare words
            texts.append([rare[4], *(f"o{f}x{i}" for i in range(15))])
        else:
            bare.add(f)
        for i, t in enumerate(texts):
            rows.append((ids.pop(), " ".join(t)))
            roles[rows[-1][0]] = (f, i)
        rows += [(ids.pop(), c) for c in common for _ in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    first = {}
    for r in df.select("doc_id", ngram_join.row_keys()[0].alias("id")).orderBy("id").collect():
        f, i = roles.get(r["doc_id"], (None, 3))
        if i < 3:
            first.setdefault(f, i)
    assert {(f in bare, i) for f, i in first.items()} == {(b, i) for b in (True, False) for i in range(3)}
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(df, width=1).collect())
    assert got == Counter(ngram_join.brute_force(rows, width=1))


@pytest.mark.parametrize("cell", [ngram_join.CELL, 0])
def test_exact_pairs_without_first_links(spark, monkeypatch, cell):
    """The last phase alone finds every link, in crowded cells that are dealt again, too."""
    monkeypatch.setattr(ngram_join, "CELL", cell)
    rnd = random.Random(10)
    texts = []
    for f in range(14):
        base = [f"w{f}x{rnd.randrange(10**6)}" for _ in range([3, 4, 5, 6][f] if f < 4 else rnd.randrange(20, 90))]
        for _ in range(5):
            s = [x if rnd.random() > 0.06 else f"e{rnd.randrange(10**6)}" for x in base]
            texts.append(" ".join(dict.fromkeys(s[: len(s) - rnd.randrange(6 if f > 3 else 2)])))
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, id long").repartition(3)
    counts = ngram_join.shingle_counts(docs, 1)
    held = spark.sparkContext.broadcast(counts)
    sets = ngram_join.shingle_sets(pa.RecordBatch.from_pydict({"text": texts}), 1)
    placed = []
    for i, s in enumerate(sets):
        n, least = len(s), (75 * len(s) + 99) // 100
        placed += [(int(x), p, p, i, n, i, i, n - least + 1, least) for p, x in enumerate(ngram_join.rare_first(s, counts).view(np.int64)[: n - least + 1])]
    df = spark.createDataFrame(placed, ", ".join(f"{k} long" for k in ngram_join.PLACED))
    got = {(r["a"], r["b"]) for r in ngram_join.crossing_pairs(df, docs, held, 1, 75).collect()}
    as_sets = [set(s.tolist()) for s in sets]
    want = {(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(as_sets[i] & as_sets[j]) >= 75 * len(as_sets[i] | as_sets[j])}
    assert len(want) > 20 and want <= got


def test_one_shingle_in_many_sets(spark, monkeypatch):
    """Thousands of unlinked sets that share shingles: their cell is dealt again, and few pairs come out of it."""
    rnd = random.Random(21)
    common = [f"c{i}" for i in range(40)]
    rows = [(i, " ".join([*rnd.sample(common, 34), f"own{i}"])) for i in range(1500)] + [(5000 + i, "same few words") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter((r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(df).collect())
    assert got[1, 5000] == 3000 and sum(n for (k, _), n in got.items() if k == 31) == 1500


def test_bitmaps_never_exclude():
    rng = np.random.default_rng(17)
    for _ in range(300):
        both = rng.integers(0, 2**62, int(rng.integers(1, 400))).astype(np.uint64)
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 2**62, int(rng.integers(0, 300))).astype(np.uint64)])) for _ in range(2))
        assert len(np.intersect1d(a, b)) <= ngram_join.most_shared(ngram_join.bitmap(a), len(a), ngram_join.bitmap(b), len(b)) <= min(len(a), len(b))


def test_components(spark):
    rnd = random.Random(11)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)] + [(i + 1000, i + 1001) for i in range(60)]
    parent = {x: x for ab in links for x in ab}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r["id"]: r["comp"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long").repartition(6)).collect()}
    assert got == {x: root(x) for a, b in links if a != b for x in (a, b)} | {x: c for x, c in got.items() if x == c}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_quality_measures(spark, docs, empty):
    got = Counter((r["doc_id"], *tuple(r)[1:7]) for r in quality.quality_rules(docs).collect())
    assert got == Counter((r[0], *quality.brute_force(r[1])) for r in awkward())
    assert quality.quality_rules(empty).count() == 0


def test_quality_verdicts(spark):
    out = quality.op2(spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id")
    rows = out.collect()
    assert np.mean([r["kept"] or r["base_failed"] for r in rows if r["quality"]]) > 0.95
    assert not any(r["kept"] and r["base_failed"] for r in rows)


URLS = ["https://a.COM/en/7", "http://example.com/en/71?x#y", "http://sub.example.com/en/6", "http://example.net/de/8/x", "http://x.net/de/9", "http://a.org/es/", "http://a.org/es", "org", None, "", "x://com/en/", "http://notexample.net/de/8", "http://a.b/http://com/en/", "http://com?/en/", "a://b/c?d=://e", "://ORG/es/#"]


@pytest.mark.parametrize("rule_bytes", [url_filter.RULE_BYTES, 0])
def test_rules_with_nulls_and_hot_hosts(spark, rule_bytes):
    """A null host or path counts as empty; a suffix that most urls share; columns with any names."""
    rules = [("com", None, "block"), (None, None, "block"), ("a.com", "/x", "allow")]
    urls = [f"http://h{i % 7}.com/x" for i in range(300)] + ["http://a.com/xy", "nothing", None]
    df = spark.createDataFrame([(i, u, "b", "s") for i, u in enumerate(urls)], "page_id long, url string, best string, suffix string")
    got = {r["page_id"]: (r["rule"], r["verdict"], r["best"]) for r in url_filter.url_filter(df, rules, rule_bytes=rule_bytes).collect()}
    assert got[0] == ("com", "block", "b") and got[300] == ("a.com/x", "allow", "b") and got[301] == got[302] == ("", "block", "b") and len(got) == 303


@pytest.mark.parametrize("rule_bytes", [url_filter.RULE_BYTES, 0])
def test_url_filter(spark, rule_bytes):
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.url_filter(df, url_filter.RULES, rule_bytes=rule_bytes).collect()}
    for i, u in enumerate(URLS):
        m = re.search(r"://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len(h), len(p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits, default=(0, 0, None, "allow"))
        assert got[i] == (host, path, rule[2], rule[3]), u
    assert url_filter.url_filter(df.limit(0), url_filter.RULES).count() == 0


def test_trie_equals_all_rules():
    rnd = random.Random(12)
    labels, parts = ["a", "b", "c"], ["", "x", "xy", "y"]
    rules = list({(h, p): (h, p, rnd.choice(["allow", "block"])) for h, p in ((".".join(rnd.choices(labels, k=rnd.randrange(1, 4))), "/" + "/".join(rnd.choices(parts, k=rnd.randrange(3)))) for _ in range(60))}.values())
    trie = url_filter.HostPathTrie(rules)
    for _ in range(2000):
        host, path = ".".join(rnd.choices(labels, k=rnd.randrange(1, 5))), "/" + "/".join(rnd.choices(parts, k=rnd.randrange(4)))
        fits = [(len(h), len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert trie.longest(host, path) == (max(fits)[2:] if fits else None)


def test_packing(spark, docs, empty):
    out = packing.best_fit_packing(docs.filter("doc_id <> 5"), capacity=64)
    rows = out.collect()
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for r in awkward():
        if r[0] != 5:
            ids = np.array([*own.encode(r[1] or "", add_special_tokens=False).ids, 2], dtype="<u4")
            at = 0
            for k, p in enumerate(sorted(by_doc[r[0]], key=lambda p: p["piece"])):
                assert (p["piece"], p["start"], p["ids_crc32"]) == (k, at, zlib.crc32(ids[at : at + p["length"]].tobytes()))
                assert k == 0 or p["length"] == 64
                at += p["length"]
            assert at == len(ids)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.best_fit_packing(empty).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_plan_keeps_every_capacity(rule):
    rnd = random.Random(13)
    counts = {rnd.randrange(1, 77): rnd.randrange(1, 40) for _ in range(40)}
    rows, n = packing.plan(counts, 100, most_docs=5, most_cost=6000, rule=rule)
    bins = defaultdict(list)
    for length, rank, count, first, offset in rows:
        for i in range(count):
            bins[first + i].append((offset, length))
    assert len(bins) == n and Counter(x for b in bins.values() for _, x in b) == Counter(counts)
    for b in bins.values():
        assert len(b) <= 5 and sum(x for _, x in b) <= 100 and sum(x * x for _, x in b) <= 6000


def test_tokenizer_memo():
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    own, memo = Tokenizer.from_file(path), packing.MemoTokenizer(path, 300)
    rnd = random.Random(14)
    pieces = ["a", "b", " ", "  ", "\n", "\t", "é", "<|endoftext|>", "'s", "'", "1", "23", "!", "日本", "Δ", " \n ", "\x1c", "\u2003", "don't", "\r\n", "\U0001f600"]
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randrange(30))) for _ in range(3000)]
    for i in range(0, len(texts), 100):
        assert memo(texts[i : i + 100]) == [np.array(own.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts[i : i + 100]]


def test_mixing(spark, docs, empty):
    out = mixing.mix_sources(docs).collect()
    assert sorted((r["doc_id"], r["size"]) for r in out) == sorted((r[0], len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))) for r in awkward())
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in out)
    again = mixing.mix_sources(docs.repartition(7)).collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, again))
    assert mixing.mix_sources(empty).count() == 0


def test_targets_and_sums(spark):
    rnd = random.Random(15)
    rows = [(i, " ".join(["w"] * rnd.randrange(0, 60)), rnd.choice(["é", "b", "a", None, "c", "d"])) for i in range(3000)]
    rows += [(9000 + i, "w w", "tiny") for i in range(3)]
    out = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    size, taken, target = Counter(), Counter(), {}
    for r in out:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    open_, rest, want = set(names), 1.5 * sum(size.values()), {}
    while over := [s for s in open_ if rest * weight[s] / sum(weight[x] for x in open_) > 2 * size[s]]:
        for s in over:
            want[s] = 2 * size[s]
            open_.discard(s)
        rest = 1.5 * sum(size.values()) - sum(want.values())
    total = sum(weight[x] for x in open_)
    want |= {s: rest * weight[s] / total for s in open_}
    for s in names:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 60


def test_top_k(spark):
    rng = np.random.default_rng(16)
    vectors = [(i, rng.normal(0, 0.2, 8).astype(np.float32).tolist()) for i in range(400)]
    vectors += [(i, vectors[0][1]) for i in range(400, 430)] + [(900, None), (901, [float("nan")] * 8), (902, [None] * 8), (903, [float("inf")] * 8), (904, [1.0, 2.0]), (905, []), (50, [0.5] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash")).repartition(3)
    whole = [(i, np.floor(256 * np.array(v, dtype=np.float64))) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    pad = lambda v: np.pad(v, (0, 8 - len(v)))
    want = []
    for q, v in whole:
        if q % 50 == 0:
            found = sorted((-int(pad(v) @ pad(x)), i) for i, x in whole if i != q)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(found)]
    got = [tuple(r) for r in topk.exact_top_k(df, df.filter("vec_id % 50 = 0")).collect()]
    assert Counter(got) == Counter(want)
    few = df.filter("vec_id in (0, 1, 2)")
    assert topk.exact_top_k(few, few.filter("vec_id = 0")).count() == 2
    assert topk.exact_top_k(df.limit(0), df.limit(0)).count() == 0


def test_top_k_resolves_candidates_only(spark):
    """The cutoff keeps most entries from being resolved."""
    touched = spark.sparkContext.accumulator(0)
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    found = topk.exact_top_k(df, df.filter("vec_id % 50 = 0"), touched=touched)
    assert found.count() == 200
    assert 0 < touched.value < 0.06 * 40 * df.count()


def test_top_k_of_large_numbers(spark):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.random.default_rng(3).integers(-(2**20), 2**20, (60, 4)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.exact_top_k(df, df).collect()}
    for q, v in rows:
        order = sorted((-sum(int(256 * a) * int(256 * b) for a, b in zip(v, x)), i) for i, x in rows if i != q)
        for k in range(5):
            assert got[q, k + 1] == (order[k][1], -order[k][0])


def test_top_k_in_blocks(spark, monkeypatch):
    want = sorted(map(tuple, topk.op10(spark, DATA).collect()))
    monkeypatch.setattr(topk, "BLOCK_VALUES", 200)
    assert sorted(map(tuple, topk.op10(spark, DATA).collect())) == want


def test_toxicity(spark, docs, empty):
    rows = toxicity.op1(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert np.mean([r["predicted"] == r["toxic"] for r in held]) > 0.9
    machine = toxicity.train_toxicity(docs, spark.createDataFrame([(11, 1), (5, 0)], "doc_id long, toxic int"))
    out = toxicity.score_toxicity(docs, machine)
    assert out.count() == len(awkward()) and all(0 <= r["score"] <= 1 for r in out.collect())
    none = toxicity.train_toxicity(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score_toxicity(empty, none).count() == 0 and 0 <= none.score(None) <= 1


def test_scores_do_not_follow_the_caps(spark):
    """A capped sample of another class ratio gives the scores of all labels."""
    rnd = random.Random(19)
    rows = [(i, " ".join([*(["bad"] if rnd.random() < (0.6 if i < 600 else 0.1) else []), f"n{rnd.randrange(50)}"]), int(i < 600)) for i in range(6600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").cache()
    share = np.mean([t for _, text, t in rows if "bad" in text])
    machines = [toxicity.train_toxicity(df, df.select("doc_id", "toxic"), *most) for most in ((6600, 6600), (600, 1500))]
    for machine in machines:
        assert machine.score("bad") == pytest.approx(share, abs=0.1)
        assert machine.score("other") == pytest.approx(0.4 * 600 / (0.4 * 600 + 0.9 * 6000), abs=0.03)


def test_machine_learns_pairs():
    """An insult counts only together with a mention: no linear weights can tell."""
    terms = np.arange(4, dtype=np.uint64)
    inputs = [np.array(x, dtype=np.int32) for x in ([0, 2], [1, 3], [0, 3], [1, 2])] * 100
    labels = np.array([1, 1, 0, 0] * 100, dtype=np.float64)
    machine = toxicity.fit(terms, inputs, labels)
    assert min(machine.logit(x) for x in inputs[:2]) > 0 > max(machine.logit(x) for x in inputs[2:4])


def test_language(spark, docs, empty):
    rows = language.op5(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows if r["held_out"]]) > 0.95
    kernel = language.train_language(docs)
    out = {r["text"]: (r["lang_pred"], r["score"]) for r in language.identify_language(docs, kernel).collect()}
    assert out[None] == out[""] == out["12 34 !!"] == ("und", 0.0) and out["one"][0] in ("en", "de")
    nothing = language.train_language(empty)
    assert {r["lang_pred"] for r in language.identify_language(docs, nothing).collect()} == {"und"}
    assert language.identify_language(empty, kernel).count() == 0


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline

    labels = tmp_path / "labels.parquet"
    spark.createDataFrame([(11, 0, 1), (5, 1, 0), (13, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(labels))
    for table in (docs, docs.limit(0)):
        stage = table
        for i, (name, f) in enumerate(corpus_pipeline.STAGES):
            out = f(spark, stage, str(tmp_path))
            if name != "best_fit_packing":
                assert out.columns == docs.columns, name
            path = str(tmp_path / f"{table is docs}-{i}")
            out.write.parquet(path)
            stage = spark.read.parquet(path)
    near = spark.read.parquet(str(tmp_path / "True-2"))
    assert near.filter("doc_id in (5, 6, 7)").select("text").distinct().count() <= 2  # one of the copies, and the row that repeats an id


def spark_hash(*values) -> int:
    """Spark's xxhash64 of texts, longs and nulls; a tuple (n,) is an int. Unsigned."""
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<i", *v) if isinstance(v, tuple) else struct.pack("<q", v), h)
    return h


def mixed_by_hand(rows: list[tuple]) -> Counter:
    """Copies of each row ``(doc_id, text, source)``, none of them equal; at most one bucket a source."""
    size = {r: len((r[1] or "").encode().split()) for r in rows}
    of = defaultdict(list)
    for r in rows:
        of[r[2]].append(r)
    names = sorted((s for s in of if s is not None), key=str.encode) + [None] * (None in of)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total = {s: sum(size[r] for r in of[s]) for s in names}
    open_, rest, target = set(names), 1.5 * sum(total.values()), {}
    while over := [s for s in open_ if rest * weight[s] / sum(weight[x] for x in open_) > 2 * total[s]]:
        target |= {s: 2 * total[s] for s in over}
        open_ -= set(over)
        rest = 1.5 * sum(total.values()) - sum(target.values())
    target |= {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
    copies = Counter()
    for s in names:
        assert len(of[s]) <= mixing.FAN
        ratio = target[s] / total[s] if total[s] else 0.0
        whole = int(ratio + 1e-12)
        copies.update({r: whole for r in of[s] if size[r]})
        signed = lambda h: h - (h >> 63 << 64)
        left = sorted([r[0], signed(spark_hash(r[1], r[0])), size[r], ratio - whole, r] for r in of[s] if size[r]) if ratio - whole > 1e-12 else []
        while left:
            if len(left) == 1:
                copies[left[0][4]] += left[0][3] >= 0.5
                break
            later = []
            for x, y in zip(left[::2], left[1::2]):
                up, down = min((1 - x[3]) * x[2], y[3] * y[2]), min(x[3] * x[2], (1 - y[3]) * y[2])
                draw = (spark_hash(x[0], y[0], x[1], y[1], (mixing.SEED,)) >> 11) / 2**53
                mass = up if draw * (up + down) < down else -down
                x_ends = (1 - x[3]) * x[2] <= y[3] * y[2] if mass > 0 else x[3] * x[2] <= (1 - y[3]) * y[2]
                ends, stays, sign = (x, y, 1) if x_ends else (y, x, -1)
                copies[ends[4]] += sign * mass > 0
                later.append([*stays[:3], min(1.0, max(0.0, stays[3] - sign * mass / stays[2])), stays[4]])
            left = later + left[len(left) // 2 * 2 :]
    return copies


def test_pipeline_against_brute_force(spark, tmp_path):
    """The rows of the whole pipeline, each stage written out; the toxicity model is taken as it is learned."""
    import corpus_pipeline

    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    rnd = random.Random(20)
    words = lambda n: " ".join(f"v{rnd.randrange(10**6)}" for _ in range(n))
    texts = {1000 + i: words(20) + (" idiot fool" if i < 40 else "") for i in range(120)}
    for f in range(3):  # copies with some edits, so some link and some don't
        base = words(80).split()
        for i in range(12):
            edited = list(base)
            for _ in range(rnd.randrange(6)):
                edited[rnd.randrange(80)] = words(1)
            texts[2000 + 100 * f + i] = " ".join(edited)
    for f in range(8):  # three texts with one prefix, of which only two link; all their other shingles are more common
        rare, common = words(9).split(), words(22).split()
        for i, end in enumerate((common[:11], common[:9] + common[11:13], common[11:])):
            texts[3000 + 100 * f + i] = " ".join(rare + end)
            texts |= dict.fromkeys(range(3010 + 100 * f + 10 * i, 3014 + 100 * f + 10 * i), " ".join([words(100), *rare[-4:], *end]))
    rows = [*awkward(), *((d, t, "en", ["a", "b", None][d % 3], len(t), "s", "k", "c") for d, t in texts.items())]
    docs = spark.createDataFrame(rows, DOCS)
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1000 + i, 1, int(i < 40)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    labels = spark.read.parquet(str(tmp_path / "labels.parquet")).collect()
    taught = spark.createDataFrame([(r["doc_id"], r["toxic"]) for r in labels if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2], "doc_id long, toxic int")
    machine = toxicity.train_toxicity(docs, taught)
    clean = [(r[0], r[1], r[3]) for r in rows if machine.score(r[1]) < 0.3]
    assert 30 <= len(rows) - len(clean) <= 50

    counts = Counter(k for _, t, _ in clean for k in {k for k in line_dedup.line_keys(t) if k})
    lined = []
    for d, t, s in clean:
        kept = [x for x, k in zip((t or "").split("\n"), line_dedup.line_keys(t)) if not k or counts[k] < 10]
        lined.append((d, t if len(kept) == len((t or "").split("\n")) else "\n".join(kept), s))
    assert lined != clean

    found = ngram_join.brute_force([r[:2] for r in lined])
    single = list(dict.fromkeys(r for r, (d, n, first) in zip(lined, found) if not n or d == first))
    assert len({r[:2] for r in single}) == len(single) < len(lined)

    copies = mixed_by_hand(single)
    assert {0, 1, 2} <= {copies[r] for r in single}
    own, pieces = Tokenizer.from_file(path), Counter()
    for (d, t, s), n in copies.items():
        ids = np.array([*own.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        edges = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            pieces[d, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += n
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == +pieces
    lengths = Counter(r["length"] for r in got)
    places, n = packing.plan(lengths, 1024)
    assert Counter((r["sequence_id"], r["offset"], r["length"]) for r in got) == Counter((first + i, offset, length) for length, _, count, first, offset in places for i in range(count))
    filled = Counter()
    for s, offset, length in sorted((r["sequence_id"], r["offset"], r["length"]) for r in got):
        assert offset == filled[s]
        filled[s] += length
    assert len(filled) == n and max(filled.values()) <= 1024


@pytest.mark.parametrize("few", [0, 10**9])
def test_joins_of_hot_keys(spark, monkeypatch, few):
    """Half of all rows under one key: all ways of joining give the same rows."""
    from leafmill.llm import common

    monkeypatch.setattr(common, "FEW_ROWS", few)
    big = spark.range(6000).select("id", F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("k")).repartition(4)
    small = spark.createDataFrame([("hot", 1), ("hot", 2), ("k3", 3), (None, 4)], "k string, v int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        got, want = common.skew_join(big, small, ["k"], how), big.join(small, ["k"], how)
        assert Counter(map(str, got.collect())) == Counter(map(str, want.collect()))
    groups = spark.createDataFrame([("hot", 1), ("k3", 3), (None, 4)], "k string, v int")
    want = Counter(map(str, big.join(groups.withColumnRenamed("k", "g"), F.col("k").eqNullSafe(F.col("g"))).select("id", "k", "v").collect()))
    for most in (0, common.SMALL_ROWS):
        assert Counter(map(str, common.group_join(big, groups, ["k"], most_rows=most).select("id", "k", "v").collect())) == want


def test_many_equal_rows_are_mixed(spark, monkeypatch):
    """Equal rows fall into many buckets, are numbered in blocks, and copies come near the target."""
    monkeypatch.setattr(mixing, "TURNS", 100)
    df = spark.range(5000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source")).unionByName(spark.createDataFrame([(2, "x y", "t")], "doc_id long, text string, source string"))
    out = mixing.mix_sources(df).collect()
    assert len(out) == 5001 and abs(sum(r["taken"] for r in out if r["source"] == "s") - next(r["target"] for r in out if r["source"] == "s")) <= 1.5


def test_language_of_many_rows_of_one_id(spark):
    """A repeated id gives one text; languages beyond the bound are not learned."""
    rows = [(1, "ein kleiner hund", "de")] * 500 + [(i, "the small dog", "en") for i in range(2, 30)] + [(99, "un petit chien", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kernel = language.train_language(df, most_langs=2)
    assert kernel.langs == ["de", "en"] and len(kernel.landmarks) <= 29
    assert kernel.predict(["der hund ist klein", "the dog is small"])[0] == ["de", "en"]


def test_very_long_texts(spark):
    """A line of a megabyte and a text of 100,000 words go through every operator on texts."""
    rnd = random.Random(23)
    long = " ".join(f"w{rnd.randrange(10**5)}" for _ in range(100_000))
    df = spark.createDataFrame([(1, long, "en", "a"), (2, long + " more", "en", "a"), (3, "z" * 1_000_000, "de", "b"), (4, "short", "de", "b")], "doc_id long, text string, lang string, source string").repartition(2)
    near = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(df).collect()}
    assert near[2][1] == 1 and near[3] == (1, 3)
    cut_ = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring_dedup.substring_dedup(df).collect()}
    assert cut_[1] == (100_000, 100_000) and cut_[2] == (100_001, 100_000) and cut_[3] == (1, 0)
    assert {r["n_lines"] for r in line_dedup.line_dedup(df).collect()} == {1}
    assert {r["doc_id"]: r["n_words"] for r in quality.quality_rules(df).collect()}[1] == 100_000
    assert sum(r["size"] for r in mixing.mix_sources(df).collect()) == 200_003
    assert packing.best_fit_packing(df.filter("doc_id > 2")).count() > 100
    scored = toxicity.score_toxicity(df, toxicity.train_toxicity(df, spark.createDataFrame([(1, 1), (4, 0)], "doc_id long, toxic int")))
    assert scored.count() == 4 and language.identify_language(df, language.train_language(df)).count() == 4


def test_executors_need_no_copy_of_the_package(tmp_path):
    """Queries that send models and trees to executors run from another folder, without the package on their path."""
    import os
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.sql.warehouse.dir", {str(tmp_path)!r}).getOrCreate()
import __spark_entry__
for name, query in __spark_entry__.queries().items():
    if name.startswith(("op1_", "op3_", "op5_", "op7_", "op8_", "op10_")):
        assert query(spark, {DATA!r}).count() > 0, name
print("all ran")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd="/", env=env, capture_output=True, text=True, timeout=600)
    assert "all ran" in done.stdout, done.stderr[-2000:]


def test_pa_batches_are_cut():
    from leafmill.llm.common import chunks

    batch = pa.RecordBatch.from_pydict({"text": ["x" * 10, None, "y" * 30, "z"]})
    assert [b.num_rows for b in chunks([batch], 20)] in ([2, 2], [3, 1], [2, 1, 1])
