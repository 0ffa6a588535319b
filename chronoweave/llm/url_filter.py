"""URL allow and block lists in one trie over reversed host labels, then path segments.

The trie is a plain nested dict; it is built once on the driver from the rule list (a parameter, bounded by
`MAX_RULES`) and travels to the tasks as a broadcast variable. A url walks the labels of its host from the last one,
and below each host that it meets the segments of its path; the deepest entry wins, a longer host before a longer path.

Cases: a null url, or one without `://`, has an empty host and path and gets the default verdict. Ties cannot occur:
a rule listed twice must have one verdict, else building fails. Repeated rows are judged alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from chronoweave.llm.common import map_texts

MAX_RULES = 5_000_000
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
_END_OF_HOST, _END_OF_PATH = re.compile(r"[/?#]"), re.compile(r"[?#]")


def split_url(url: str | None) -> tuple[str, str]:
    if not isinstance(url, str) or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    host = _END_OF_HOST.split(rest, maxsplit=1)[0]
    return host.translate(_ASCII_LOWER), _END_OF_PATH.split(rest[len(host) :], maxsplit=1)[0]


class Trie:
    """Nodes: [children by label, paths]; a path node: [children by segment, (rule, verdict) or None]."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: list = [{}, None]
        for n, (host, path, verdict) in enumerate(rules):
            if n >= MAX_RULES:
                raise ValueError(f"more than {MAX_RULES} rules")
            if verdict not in ("allow", "block") or not path.endswith("/") or not path.startswith("/"):
                raise ValueError(f"rule {host}{path}: verdicts are allow and block, paths begin and end with /")
            node = self.root
            for label in reversed(host.split(".")):
                node = node[0].setdefault(label, [{}, None])
            if node[1] is None:
                node[1] = [{}, None]
            node = node[1]
            for segment in path.split("/")[:-1]:
                node = node[0].setdefault(segment, [{}, None])
            if node[1] not in (None, (host + path, verdict)):
                raise ValueError(f"two verdicts for {host}{path}")
            node[1] = (host + path, verdict)

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        found, node, segments = None, self.root, path.split("/")[:-1]
        for label in reversed(host.split(".")):
            node = node[0].get(label)
            if node is None:
                break
            below = node[1]
            if below is not None:
                for segment in segments:
                    below = below[0].get(segment)
                    if below is None:
                        break
                    found = below[1] or found
        return found


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """Rows (key, host, path, rule, verdict), one for each row of `pages`; `rules` are (host, path, verdict)."""
    trie = pages.sparkSession.sparkContext.broadcast(Trie(rules))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        match = trie.value.match
        for frame in frames:
            parts = [split_url(u) for u in frame["text"]]
            hits = [match(h, p) for h, p in parts]
            yield pd.DataFrame({"key": frame["key"], "host": [h for h, _ in parts], "path": [p for _, p in parts], "rule": [h and h[0] for h in hits], "verdict": [h[1] if h else default for h in hits]})

    return map_texts(pages, key, url, run, "host string, path string, rule string, verdict string")
