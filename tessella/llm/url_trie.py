"""Allow and block lists for URLs, held as a trie."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    verdict: str  # allow or block
    host: str
    path: str  # begins with a slash


#: What a URL gets that no rule fits.
DEFAULT = "allow"


def host_of(url: Column) -> Column:
    """From after the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From after the host to ``?``, ``#`` or the end; empty if there is no ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def build_trie(rules: Iterable[Rule]) -> dict:
    """Nested dicts: host labels from the last to the first, then whole path segments, then what a last segment begins with.

    A node's ``"/"`` holds its path trie. In a path trie, ``segments`` leads on and ``starts`` maps the begin of the
    next segment to a rule; the begin is empty where a rule's path ends in a slash.
    """
    root: dict = {"labels": {}, "path": None}
    for rule in rules:
        node = root
        for label in reversed(rule.host.split(".")):
            node = node["labels"].setdefault(label, {"labels": {}, "path": None})
        if node["path"] is None:
            node["path"] = {"segments": {}, "starts": {}}
        node = node["path"]
        *whole, last = rule.path.split("/")[1:]
        for segment in whole:
            node = node["segments"].setdefault(segment, {"segments": {}, "starts": {}})
        node["starts"][last] = (rule.host + rule.path, rule.verdict)
    return root


def longest_in_path(node: dict, path: str) -> tuple[str, str] | None:
    """The rule of a host's path trie with the longest path that ``path`` starts with."""
    best = None
    if not path.startswith("/"):
        return None
    for segment in path.split("/")[1:]:
        fits = [start for start in node["starts"] if segment.startswith(start)]
        if fits:
            best = node["starts"][max(fits, key=len)]
        node = node["segments"].get(segment)
        if node is None:
            break
    return best


def match(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """The longest rule that fits: of those on the way from the last label, the one whose host and path are longest together."""
    best, node = None, trie
    for label in reversed(host.split(".")):
        node = node["labels"].get(label)
        if node is None:
            break
        if node["path"] is not None:
            found = longest_in_path(node["path"], path)
            if found and (best is None or len(found[0]) > len(best[0])):
                best = found
    return best


def filter_urls(pages: DataFrame, rules: Iterable[Rule], url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    The trie is broadcast: it grows with the rules, not with the pages. A page without a fitting rule has a null rule
    and gets ``default``. A null URL, or one without ``://``, has empty host and path and so fits no rule. A URL
    without a path fits no rule either, as every rule's path begins with a slash. Two rules of the same host and path:
    the later one holds. Input columns named like an output column are replaced; an empty table gives an empty result.
    """
    trie = pages.sparkSession.sparkContext.broadcast(build_trie(rules))

    @F.pandas_udf("rule string, verdict string")
    def judged(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hosts, paths in batches:
            found = [match(trie.value, h, p) or (None, default) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame(found, columns=["rule", "verdict"])

    out = ("host", "path", "rule", "verdict")
    own = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in out]
    return (
        pages.select(*own, host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
        .withColumn("judged", judged("host", "path"))
        .select(*own, "host", "path", "judged.rule", "judged.verdict")
    )
