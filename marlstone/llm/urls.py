"""Operator 10: allow and block lists of hosts and paths, judged by a trie.

The trie's edges are the host's labels from the right, then the path's segments; a node where a rule ends holds it.
The url's own labels and segments walk it, and the deepest rule met wins.  The trie of a bounded rule list is
broadcast, once an executor.

A rule ``host/path`` fits its host and all subdomains if the url's path starts with the rule's (which starts with a
slash and may end within a segment).  Hosts: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased; the path runs on to ``?``, ``#`` or the end.

Edge cases: a null url, or one without ``://``, has an empty host and path; a url without a path meets no rule;
urls that meet no rule get the default verdict; repeated and null ids are judged row by row; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rules that may be broadcast.
MAX_RULES = 1_000_000
SCHEMA = "page_id long, host string, path string, rule string, verdict string"
URL = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
UPPER = {c: c + 32 for c in range(65, 91)}


class Trie:
    """``rules``: (verdict, host, path) triples; of equal rules the last counts."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.root: dict = {}
        for verdict, host, path in rules:
            if not path.startswith("/"):
                raise ValueError(f"a rule's path starts with a slash: {path!r}")
            node = self.root
            for label in reversed(host.translate(UPPER).split(".")):
                node = node.setdefault(("host", label), {})
            *whole, part = path[1:].split("/")
            for segment in whole:
                node = node.setdefault(("path", segment), {})
            node.setdefault("ends", {})[part] = (verdict, host + path)

    def judge(self, host: str, path: str) -> tuple[str, str] | None:
        """(verdict, rule) of the longest rule that fits: the longer host first, then the longer path."""
        if not path.startswith("/"):
            return None
        best, node = None, self.root
        segments = path[1:].split("/")
        for label in reversed(host.split(".")):
            node = node.get(("host", label))
            if node is None:
                return best
            best = self._path(node, segments) or best
        return best

    @staticmethod
    def _path(node: dict, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for segment in segments:
            for part in sorted(node.get("ends", ()), key=len):
                if segment.startswith(part):
                    best = node["ends"][part]
            node = node.get(("path", segment))
            if node is None:
                break
        return best


def split_url(url: str | None) -> tuple[str, str]:
    found = URL.search(url or "")
    return (found[1].translate(UPPER), found[2]) if found else ("", "")


def judge_urls(
    pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow",
) -> DataFrame:
    """One row per page, ``SCHEMA``; the verdict is the rule's, else ``default``."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    blob = pages.sparkSession.sparkContext.broadcast(Trie(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = blob.value
        for batch in batches:
            split = [split_url(u) for u in batch.column(1).to_pylist()]
            judged = [trie.judge(*x) or (default, None) for x in split]
            cols = ([x[0] for x in split], [x[1] for x in split], [x[1] for x in judged], [x[0] for x in judged])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in cols)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return pages.selectExpr(f"cast(`{id_col}` as long) as page_id", f"`{url_col}` as url").mapInArrow(run, SCHEMA)
