"""URL filter: a trie over reversed host labels and path segments, longest match wins."""

from __future__ import annotations

import string
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
OUT = "page_id bigint, host string, path string, rule string, verdict string"


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host and path as they stand between ``://`` and ``?``, ``#`` or the end; both empty without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    rest = rest.split("?", 1)[0].split("#", 1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


class _Node:
    __slots__ = ("children", "ends", "paths", "rule")

    def __init__(self):
        self.children: dict[str, _Node] = {}
        self.ends: dict[str, tuple[str, str]] = {}
        self.paths: _Node | None = None


class UrlTrie:
    """Rules such as ``("block", "example.org/es/")``: a host with its subdomains, and the start of a path.

    The rule with the most host labels wins, then the one with the longest path; of
    one rule listed twice with both verdicts, block wins.
    """

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.root = _Node()
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            node = self.root
            for label in reversed(host.translate(_LOWER).split(".")):
                node = node.children.setdefault(label, _Node())
            node.paths = node.paths or _Node()
            node = node.paths
            # All but the last segment must be equal; the last one is the start of a segment.
            *whole, last = (slash + path).split("/")
            for segment in whole:
                node = node.children.setdefault(segment, _Node())
            if node.ends.get(last, ("", ""))[0] != "block":
                node.ends[last] = (verdict, rule)

    @staticmethod
    def _deepest(node: _Node, segments: Sequence[str]) -> tuple[str, str] | None:
        best = None
        for segment in segments:
            if node.ends:
                starts = [end for end in node.ends if segment.startswith(end)]
                best = node.ends[max(starts, key=len)] if starts else best
            node = node.children.get(segment)
            if node is None:
                break
        return best

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """Verdict and text of the longest rule that fits, if any."""
        best, node, segments = None, self.root, path.split("/")
        for label in reversed(host.split(".")):
            node = node.children.get(label)
            if node is None:
                break
            if node.paths is not None:
                best = self._deepest(node.paths, segments) or best
        return best


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages`` (page_id, url).

    ``rules`` is a given list, so the trie that goes to the tasks does not grow with
    the pages. A url that no rule fits gets ``default`` and no rule. Null urls and
    those without ``://`` have an empty host and path. Repeated rows are each judged,
    and other columns are not read. Nothing is shuffled.
    """
    trie = pages.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for url in batch.column("url").to_pylist():
                host, path = host_and_path(url)
                verdict, rule = trie.value.match(host, path) or (default, None)
                rows.append((host, path, rule, verdict))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), *(pa.array(c, pa.string()) for c in columns)],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    narrow = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"))
    return narrow.mapInArrow(judged, OUT)
