"""URL filters: a trie over reversed host labels and path segments.

A rule is (host, path, verdict).  It fits its host and all subdomains when the
path of the url starts with the rule's path.  The longest rule wins: the deeper
host first, then the longer path; an allow and a block entry for the same host
and path resolve to block.  Urls that no rule fits get the default verdict.

Defined cases: a null url or one without "://" has an empty host and path, and
so fits no rule but one with an empty host; an empty path does not start with
"/".  A url of any length is judged whole.  Rows are never dropped or merged, repeated rows each get a verdict, extra
columns are not carried, and an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.llm.common import table

#: Rules as (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
DEFAULT = "allow"
#: The trie is broadcast, so the number of rules is bounded.
MAX_RULES = 5_000_000

_HOST_END = re.compile(r"[/?#]")
_PATH_END = re.compile(r"[?#]")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host (ASCII capitals lowered) and path of a url."""
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    end = _HOST_END.search(rest)
    if end is None:
        return rest.translate(_LOWER), ""
    tail = rest[end.start() :]
    stop = _PATH_END.search(tail)
    return rest[: end.start()].translate(_LOWER), tail[: stop.start()] if stop else tail


class _Node:
    __slots__ = ("next", "ends", "lengths", "paths")

    def __init__(self) -> None:
        self.next: dict[str, _Node] = {}
        #: On a path node: unfinished last segment -> (rule, verdict).
        self.ends: dict[str, tuple[str, str]] = {}
        #: The lengths of these last segments, longest first.
        self.lengths: list[int] = []
        #: On a host node: the root of its path trie.
        self.paths: _Node | None = None


class UrlTrie:
    """Longest-match lookup; memory is linear in the rules' text."""

    def __init__(self, rules: Iterable[tuple[str, str, str]] = ()) -> None:
        self.root = _Node()
        self.size = 0
        for rule in rules:
            self.add(*rule)

    def add(self, host: str, path: str, verdict: str) -> None:
        if verdict not in ("allow", "block"):
            raise ValueError(f"unknown verdict {verdict!r}")
        self.size += 1
        if self.size > MAX_RULES:
            raise ValueError(f"more than {MAX_RULES} rules; the trie is meant to be broadcast")
        node = self.root
        for label in reversed(host.split(".")) if host else ():
            node = node.next.setdefault(label, _Node())
        node.paths = node.paths or _Node()
        node = node.paths
        *whole, last = path.split("/")
        for segment in whole:
            node = node.next.setdefault(segment, _Node())
        if len(last) not in node.lengths:
            node.lengths = sorted([*node.lengths, len(last)], reverse=True)
        if node.ends.get(last, ("", ""))[1] != "block":
            node.ends[last] = (host + path, verdict)

    def _longest_path(self, node: _Node, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for depth, segment in enumerate(segments):
            # one probe for each length, however many rules there are
            ends = (node.ends.get(segment[:n]) for n in node.lengths if n <= len(segment))
            best = next((end for end in ends if end), best)
            if depth == len(segments) - 1 or segment not in node.next:
                break
            node = node.next[segment]
        return best

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest fitting rule."""
        segments, best, node = path.split("/"), None, self.root
        labels = reversed(host.split(".")) if host else iter(())
        while True:
            if node.paths is not None:
                best = self._longest_path(node.paths, segments) or best
            label = next(labels, None)
            if label is None or label not in node.next:
                return best
            node = node.next[label]


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, default: str = DEFAULT, key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule (null if none fits) and verdict for every row of `pages`.

    A map-only plan: only the two columns are read, nothing is shuffled.
    """
    trie = pages.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    @F.pandas_udf("host string, path string, rule string, verdict string")
    def judge(urls: pd.Series) -> pd.DataFrame:
        find, rows = trie.value.match, []
        for text in urls:
            host, path = split_url(text)
            rows.append((host, path, *(find(host, path) or (None, default))))
        return pd.DataFrame(rows, columns=["host", "path", "rule", "verdict"])

    return pages.select(F.col(key), judge(F.col(url)).alias("judged")).select(key, "judged.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


ORACLE_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), fit AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
  END AS rule FROM parts
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
FROM fit
"""
