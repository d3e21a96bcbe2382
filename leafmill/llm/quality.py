"""Quality rules with adaptive thresholds from mergeable quantile sketches.

For each language and source, and each language over all its sources, a
quantile sketch (KLL) of every measured ratio is built in map-side
pre-aggregation and merged, so a hot source costs one sketch per task. The
thresholds are quantiles of the group, drawn towards the language's by how few
documents the group has, and loosened by a margin of the group's own spread.
They replace fixed cutoffs; the verdicts come from a join with the sketches'
few rows. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, group_join, table

WINDOW = 8
MIN_WORDS, MOST_REPEATED = 20, 30
#: Quantiles between which a ratio counts as usual, and by how many of their distances it may exceed them.
LOW, HIGH, MARGIN = 0.2, 0.8, 2.0
#: A group of so many documents weighs as much as its language.
PRIOR = 200
#: Measured ratios, and the least spread that counts: a group of equal texts keeps near ones, and short texts vary.
#: Where a group is tighter than that, this floor and the group's own middle make the cutoff.
RATIOS = {"word_length": 0.8, "symbol_ratio": 0.03, "dup_line_ratio": 0.2, "repeat_ratio": 0.1, "stutter_ratio": 0.05}


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _words(text: Column) -> Column:
    plain = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.filter(F.split(plain, " "), lambda w: w != "")


def _repeat_words(words: Column) -> Column:
    """Words in windows of eight words that occur twice or more in the text."""

    def of(hashes: Column) -> Column:
        def cover(s: Column) -> Column:
            # places of windows equal to a neighbour in order of hash
            at = F.array_sort(F.transform(F.filter(F.transform(s, lambda x, i: F.struct(x["i"].alias("i"), ((x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])).alias("again"))), lambda x: x["again"]), lambda x: x["i"]))
            return _let(at, lambda p: F.aggregate(F.sequence(F.lit(1), F.size(p)), F.lit(0), lambda n, k: n + F.when(k == F.size(p), WINDOW).otherwise(F.least(F.lit(WINDOW), F.get(p, k) - F.get(p, k - 1)))))

        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(ordered, cover))

    # two chained hashes of four words each give 64 bits over the eight
    fours = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    eights = lambda f: F.transform(F.sequence(F.lit(0), F.size(f) - 5), lambda i: F.xxhash64(F.get(f, i), F.get(f, i + 4)))
    return F.when(F.size(words) < WINDOW + 1, F.lit(0)).otherwise(_let(_let(fours(words), eights), of))


def _dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    plain = lambda x: F.translate(x, "\t\x0b\x0c\r ", "")
    return _let(F.filter(F.split(text, "\n", -1), lambda x: plain(x) != ""), lambda lines: F.size(lines) - F.size(F.array_distinct(lines)))


def measures(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source`` and the counts of every whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("doc_id", "lang", "source", _let(text, lambda t: _let(_words(t), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        (F.length(F.translate(t, "\t\n\x0b\x0c\r ", ""))).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        _dup_lines(t).cast("long").alias("n_dup_lines"),
        _repeat_words(w).cast("long").alias("n_repeat_words"),
        F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1))).cast("long").alias("n_stutters"),
        (F.length(t) - F.length(F.translate(t, "\n", "")) + 1).cast("long").alias("n_lines"),
    ))).alias("m"))
    return found.select("doc_id", "lang", "source", "m.*")


def _with_ratios(df: DataFrame) -> DataFrame:
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return df.withColumns({"word_length": per("word_chars", "n_words"), "symbol_ratio": per("n_symbols", "n_words"), "dup_line_ratio": per("n_dup_lines", "n_lines"), "repeat_ratio": per("n_repeat_words", "n_words"), "stutter_ratio": per("n_stutters", "n_words")})


def thresholds(measured: DataFrame) -> DataFrame:
    """``lang, source, n`` and for every ratio its lowest and highest accepted value.

    ``measured`` holds the documents that pass the base rules. One sketch per
    language and source; a language's sketch is the merge of its sources'.
    """
    sketched = measured.groupBy("lang", "source").agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(r).alias(r) for r in RATIOS])
    sketched = cut(sketched)
    merged = sketched.groupBy("lang").agg(F.sum("n").alias("all_n"), *[F.kll_merge_agg_double(r).alias(f"all_{r}") for r in RATIOS])
    # a row here is some kilobytes of sketches
    both = group_join(sketched, cut(merged), ["lang"], row_bytes=8192)
    own = F.col("n") / (F.col("n") + PRIOR)
    at = lambda r, q: own * F.kll_sketch_get_quantile_double(F.col(r), F.lit(q)) + (1 - own) * F.kll_sketch_get_quantile_double(F.col(f"all_{r}"), F.lit(q))
    out = both.select("lang", "source", "n", *[at(r, q).alias(f"{r}_{s}") for r in RATIOS for s, q in (("low", LOW), ("mid", 0.5), ("high", HIGH))])
    for r, least in RATIOS.items():
        out = out.withColumn(f"{r}_min", F.col(f"{r}_mid") - (1 + MARGIN) * F.greatest(F.col(f"{r}_mid") - F.col(f"{r}_low"), F.lit(least)))
        out = out.withColumn(f"{r}_max", F.col(f"{r}_mid") + (1 + MARGIN) * F.greatest(F.col(f"{r}_high") - F.col(f"{r}_mid"), F.lit(least)))
    return out.select("lang", "source", "n", *[f"{r}_{s}" for r in RATIOS for s in ("min", "max")])


def quality_rules(docs: DataFrame) -> DataFrame:
    """Counts and verdicts for every row of ``docs`` (``doc_id, text, lang, source``; other columns are ignored).

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept`` and the ratios. Fails on base rules
    lead to ``kept`` false; else every ratio must lie within its group's
    thresholds. A null text has no words and fails. Null languages and sources
    are groups of their own. Repeated rows count each time.
    """
    measured = measures(docs)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    measured = cut(_with_ratios(measured).withColumn("base_failed", failed))
    limits = cut(thresholds(measured.filter(~F.col("base_failed"))).drop("n"))
    judged = group_join(measured, limits, ["lang", "source"], how="left")
    usual = F.lit(True)
    for r in RATIOS:
        usual &= F.col(r).between(F.col(f"{r}_min"), F.col(f"{r}_max"))
    kept = ~F.col("base_failed") & F.coalesce(usual, F.lit(False))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), *RATIOS)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def brute_force(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed; for tests."""
    import re

    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, again, at = set(), 0, {}
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    for i in range(len(words) - WINDOW + 1):
        at.setdefault(tuple(words[i : i + WINDOW]), []).append(i)
    covered = {j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + WINDOW)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), again, len(covered), n < MIN_WORDS or 100 * len(covered) > MOST_REPEATED * n
