"""URL filter: a trie over reversed host labels, then path segments.

A rule is a host and a path prefix with a verdict. It fits its host and all
subdomains, and urls whose path starts with its path. Of the fitting rules the
longest wins: the one with the longer host, then with the longer path; of
equal rules, "block".

The trie is broadcast while its rules' text is within a bound. Larger rule
lists are not: each url then meets, in a join, the rules of every suffix of its
host. Both ways give the same rows.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import skew_join, table

#: Rules of more text than this are joined, not broadcast.
RULE_BYTES = 16 << 20
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
DEFAULT = "allow"

_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    found = _URL.search(url) if url else None
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


class HostPathTrie:
    """Nodes are dicts: host labels from the right, and under "/" the path trie.

    A path node maps whole segments to nodes; rules end in it as the begun
    last segment they ask for, so "/en/7" ends under "en" with "7".
    """

    def __init__(self, rules):
        self.root: dict = {}
        for host, path, verdict in rules:
            node, host, path = self.root, host or "", path or ""
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault("/", {"ends": {}})
            *whole, begun = path.split("/")
            for segment in whole:
                node = node.setdefault("s", {}).setdefault(segment, {"ends": {}})
            if node["ends"].get(begun, ("", ""))[1] != "block":
                node["ends"][begun] = (host + path, verdict)
                node["sizes"] = sorted({len(x) for x in node["ends"]}, reverse=True)

    @staticmethod
    def _by_path(node, path):
        best, (*whole, last) = None, path.split("/")
        for segment in [*whole, last]:
            for size in node.get("sizes", ()):  # longest first
                if size <= len(segment) and (found := node["ends"].get(segment[:size])):
                    best = found
                    break
            node = node.get("s", {}).get(segment)
            if node is None:
                break
        return best

    @classmethod
    def of(cls, root: dict) -> HostPathTrie:
        made = cls(())
        made.root = root
        return made

    def longest(self, host: str, path: str) -> tuple[str, str] | None:
        """Rule and verdict of the longest match."""
        node, paths = self.root, []
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            if "/" in node:
                paths.append(node["/"])
        return next((found for p in reversed(paths) if (found := self._by_path(p, path))), None)


def _by_trie(pages: DataFrame, rules: list, default: str) -> DataFrame:
    # the plain tree: a broadcast object's class would have to be importable on executors
    root = pages.sparkSession.sparkContext.broadcast(HostPathTrie(rules).root)
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    at = own.index("url")

    def judge(batches):
        find = HostPathTrie.of(root.value).longest
        for batch in batches:
            hosts, paths, names, verdicts = [], [], [], []
            for url in batch.column(at).to_pylist():
                host, path = split_url(url)
                rule, verdict = find(host, path) or (None, default)
                hosts.append(host)
                paths.append(path)
                names.append(rule)
                verdicts.append(verdict)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.string()) for x in (hosts, paths, names, verdicts))], names=[*own, "host", "path", "rule", "verdict"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*own).schema)
    return pages.select(*own).mapInArrow(judge, f"{fields}, host string, path string, rule string, verdict string")


def _by_join(pages: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    lower = F.translate(F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # own columns travel in one struct, so none of their names can clash
    split = pages.select(F.struct(*own).alias("own"), F.coalesce(lower, F.lit("")).alias("host"), F.coalesce(F.regexp_extract("url", r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit("")).alias("path"))
    # distinct hosts and paths meet the rules, so repeated urls are judged once
    keys = split.select("host", "path").distinct()
    labels = F.split("host", "[.]")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    listed = rules.select(F.coalesce("host", F.lit("")).alias("suffix"), F.coalesce("path", F.lit("")).alias("start"), F.col("verdict").alias("v"))
    listed = listed.groupBy("suffix", "start").agg(F.max("v").alias("v"))  # of equal rules "block"
    met = skew_join(keys.withColumn("suffix", F.explode(suffixes)), listed, ["suffix"]).filter(F.col("path").startswith(F.col("start")))
    best = met.groupBy("host", "path").agg(F.max(F.struct(F.size(F.split("suffix", "[.]")), F.length("start"), "v", F.concat("suffix", "start").alias("rule"))).alias("best"))
    return skew_join(split, best, ["host", "path"], "left").select("own.*", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.v", F.lit(default)).alias("verdict"))


def url_filter(pages: DataFrame, rules, default: str = DEFAULT, rule_bytes: int = RULE_BYTES) -> DataFrame:
    """Adds ``host, path, rule, verdict`` to ``pages`` (replacing columns of these names).

    ``pages`` has ``url``. ``rules`` is a list of (host, path, verdict), or a
    DataFrame with these columns for lists of any size. Host: after the first
    "://" up to "/", "?", "#" or the end, A-Z lower-cased; path: then up to
    "?", "#" or the end; both empty if the url is null or has no "://". A url
    that no rule fits has a null rule and the default verdict. A rule's null
    host or path counts as empty; an empty host fits urls without one.
    """
    spark = pages.sparkSession
    if isinstance(rules, DataFrame):
        size = rules.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 64)).first()[0] or 0
        if size > rule_bytes:
            return _by_join(pages, rules, default)
        rules = [tuple(r) for r in rules.select("host", "path", "verdict").collect()]
    elif sum(len(h or "") + len(p or "") + 64 for h, p, _ in rules) > rule_bytes:
        return _by_join(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), default)
    return _by_trie(pages, rules, default)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


ORACLE = """
with u as (select page_id,
        case when contains(url, '://') then translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end host,
        case when contains(url, '://') then regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) else '' end path from pages),
rules(rhost, rpath, v) as (values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
m as (select page_id, rhost || rpath rule, v, row_number() over (partition by page_id order by length(rhost) desc, length(rpath) desc) k
    from u join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath))
select u.page_id, host, path, rule, coalesce(v, 'allow') verdict from u left join m on u.page_id = m.page_id and k = 1
"""
