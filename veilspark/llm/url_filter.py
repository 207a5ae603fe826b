"""URL filtering with a broadcast trie over reversed host labels and path segments.

Rules are ``(verdict, host, path)``.  A rule fits its host and every subdomain
when the url's path starts with the rule's path (a plain prefix: the last
segment of a rule may end inside a segment of the url).  Of the fitting rules
the one with most host labels wins, then the longest path; between equal rules
``block`` wins.  The trie holds one node per host label and path segment, so a
lookup costs the depth of the url, whatever the number of rules.

Defined results: a null url, or one without ``://``, has an empty host and an
empty path, fits no rule and gets ``default``.  Repeated rows are judged each.
Columns of the input other than the url are passed through untouched.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

#: Above this size the rule trie isn't broadcast (pickled bytes are smaller than this estimate).
MAX_TRIE_NODES = 5_000_000
_ASCII_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    stop = min((i for i in (rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
    rest = rest[:stop]
    slash = rest.find("/")
    if slash < 0:
        return rest.translate(_ASCII_LOWER), ""
    return rest[:slash].translate(_ASCII_LOWER), rest[slash:]


class UrlTrie:
    """Host labels from the right, then path segments; each path node keeps prefixes of its next segment."""

    __slots__ = ("root", "nodes")

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        self.nodes = 0
        for verdict, host, path in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"verdict must be allow or block, not {verdict!r}")
            self._add(verdict, host.translate(_ASCII_LOWER), path)
        if self.nodes > MAX_TRIE_NODES:
            raise ValueError(f"{self.nodes} trie nodes are too many to broadcast; split the rules by host and join them")

    def _add(self, verdict: str, host: str, path: str) -> None:
        node = self.root
        for label in reversed(host.split(".")) if host else ():
            node = node.setdefault(sys.intern(label), {})
            self.nodes += 1
        segments = path.split("/")
        node = node.setdefault(None, {})  # None: from hosts over to paths
        for segment in segments[:-1]:
            node = node.setdefault((segment,), {})
            self.nodes += 1
        ends = node.setdefault("ends", {})
        self.nodes += 1
        if ends.get(segments[-1], ("",))[0] != "block":
            ends[segments[-1]] = (verdict, host + path)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """The winning rule for a host and path: (verdict, rule), or None."""
        if not host:
            return None
        best, node = None, self.root
        if None in node:
            best = self._path(node[None], path)
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            if None in node:
                best = self._path(node[None], path) or best
        return best

    @staticmethod
    def _path(node: dict, path: str) -> tuple[str, str] | None:
        best = None
        segments = path.split("/")
        for k, segment in enumerate(segments):
            ends = node.get("ends")
            if ends:
                rest = segment if k == len(segments) - 1 else segment + "/"
                for n in range(len(rest.rstrip("/")), -1, -1):
                    if rest[:n] in ends:
                        best = ends[rest[:n]]
                        break
            node = node.get((segment,))
            if node is None or k == len(segments) - 1:
                break
        return best


def filter_urls(df: DataFrame, rules: list[tuple[str, str, str]], url_col: str = "url", default: str = "allow") -> DataFrame:
    """``df`` with host, path, rule (null if none fits) and verdict added; clashing columns of these names are replaced."""
    ship(df.sparkSession)
    trie = df.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    @F.pandas_udf("host string, path string, rule string, verdict string")
    def judge(urls: pd.Series) -> pd.DataFrame:
        find = trie.value.find
        out = []
        for url in urls:
            host, path = split_url(url)
            verdict, rule = find(host, path) or (default, None)
            out.append((host, path, rule, verdict))
        return pd.DataFrame(out, columns=["host", "path", "rule", "verdict"])

    keep = [c for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    made = df.withColumn("_judged", judge(F.col(url_col)))
    return made.select(*(F.col(f"`{c}`") for c in keep), "_judged.host", "_judged.path", "_judged.rule", "_judged.verdict")
