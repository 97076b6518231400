"""URL filter: a trie over reversed host labels and path segments, broadcast, with longest-match precedence.

A trie takes about 44 times the text of its rules in a worker, so lists over MOST_RULE_BYTES go in several tries, one
pass over the urls for each, which keeps the best rule so far.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import materialize

#: The rules of the contract: (verdict, host, path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Text of the rules in one trie, which then takes some 180 MB.
MOST_RULE_BYTES = 4 << 20
_PARTS = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


class UrlTrie:
    """Host labels from the right, then path segments; the last segment of a rule may match by its beginning."""

    def __init__(self, rules: list[tuple[str, str, str]], first: int = 0):
        self.root: dict = {}
        for place, (verdict, host, path) in enumerate(rules, first):
            node = self.root
            for label in reversed(host.translate(_LOWER).split(".")):
                node = node.setdefault(("h", label), {})
            *whole, last = path.split("/")
            for segment in whole:
                node = node.setdefault(("p", segment), {})
            node.setdefault("ends", {})[last] = (len(path), place, host.translate(_LOWER) + path, verdict)

    def match(self, host: str, path: str) -> tuple[int, int, int, str, str] | None:
        """(labels, path length, place, rule, verdict) of the longest rule that fits: most host labels, then longest path."""
        node, found = self.root, None
        segments = path.split("/")
        for depth, label in enumerate(reversed(host.split(".")), 1):
            node = node.get(("h", label))
            if node is None:
                break
            best, at = None, node
            for segment in segments:
                for last, rule in at.get("ends", {}).items():
                    if segment.startswith(last) and (best is None or rule > best):
                        best = rule
                at = at.get(("p", segment))
                if at is None:
                    break
            found = (depth, *best) if best else found
        return found


def split_url(url: str | None) -> tuple[str, str]:
    """Host, A-Z lower-cased, and path; both empty when the url is null or has no '://'."""
    m = _PARTS.search(url) if url else None
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


def _blocks(rules: list[tuple[str, str, str]]):
    """The rules in blocks of at most MOST_RULE_BYTES, each with the place of its first rule."""
    first, size = 0, 0
    for i, (_, host, path) in enumerate(rules):
        size += len(host) + len(path)
        if size > MOST_RULE_BYTES and i > first:
            yield first, rules[first:i]
            first, size = i, len(host) + len(path)
    yield first, rules[first:]


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for each row; ``default`` is the verdict where no rule fits (rule null).

    A rule fits its host and all subdomains when the url's path starts with the rule's path. The rule with more host
    labels wins, then the one with the longer path; on a tie of the same host and path the later entry wins. Null,
    empty and malformed urls have empty host and path and so fit no rule of a named host. Repeated rows are each judged;
    urls of any length are read whole. Other columns are not read. Empty table: empty result. Each block of rules is one
    pass, with its trie broadcast; between passes rows are written, so that a worker holds one trie.
    """
    spark = pages.sparkSession
    kind = dict(pages.dtypes)["page_id"]
    best = "page_id {0}, host string, path string, labels int, length int, place long, rule string, verdict string".format(kind)
    out = pages.select("page_id", F.col("url").cast("string"))
    blocks = list(_blocks(RULES if rules is None else rules))
    for number, (first, some) in enumerate(blocks):
        trie = spark.sparkContext.broadcast(UrlTrie(some, first))

        def run(batches, trie=trie, again=number > 0):
            for batch in batches:
                if again:
                    parts = list(zip(*(batch.column(i).to_pylist() for i in (1, 2)), strict=True))
                    before = [x if x[0] is not None else None for x in zip(*(batch.column(i).to_pylist() for i in range(3, 8)), strict=True)]
                else:
                    parts = [split_url(u) for u in batch.column(1).to_pylist()]
                    before = [None] * len(parts)
                found = [max(filter(None, (trie.value.match(*p), b)), default=(None,) * 5) for p, b in zip(parts, before, strict=True)]
                columns = [pa.array([p[i] for p in parts], pa.string()) for i in (0, 1)]
                columns += [pa.array([f[i] for f in found], k) for i, k in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["page_id", "host", "path", "labels", "length", "place", "rule", "verdict"])

        out = out.mapInArrow(run, best)
        if number + 1 < len(blocks):
            out = materialize(out, "urls")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
