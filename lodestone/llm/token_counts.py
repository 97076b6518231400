"""Edit-aware token counts: a segment tree over each document's pre-tokens; an edit re-encodes only what it touches."""

from __future__ import annotations

import base64
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import rows

LEAF = 32
#: Runs of one symbol that the query's clean-up shortens to a single one.
_RUNS = re.compile(r"([^\w\s])\1{2,}")


class Encoder:
    """Token counts of pre-tokens, remembered for at most ``most`` of them at a time."""

    def __init__(self, path: str, most: int = 200_000):
        import public_tokenizers
        import regex
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb") if line.strip())}
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, int] = {}
        self.most = most

    def counts(self, pieces: list[str]) -> list[int]:
        known, out = self.known, []
        for p in pieces:
            n = known.get(p)
            if n is None:
                if len(known) >= self.most:
                    known.clear()
                n = len(self.encoding.encode_ordinary(p))
                if len(p) <= 64:
                    known[p] = n
            out.append(n)
        return out


class TokenTree:
    """Pre-tokens of a text in leaves, their token counts summed up a binary tree (tree[1] is the sum).

    ``ends`` are the leaves' ends in the text as it is now, so batches of edits can follow each other.
    """

    def __init__(self, encoder: Encoder, text: str):
        self.encoder, self.text = encoder, text
        pieces = encoder.pattern.findall(text)
        self.encoded = len(pieces)
        lengths, sums = self._leaves(pieces, -(-len(pieces) // LEAF))
        self._build(np.cumsum(lengths).tolist(), sums)

    def _leaves(self, pieces: list[str], leaves: int) -> tuple[list[int], list[int]]:
        """Lengths and token counts of pre-tokens dealt out evenly over leaves."""
        counts = self.encoder.counts(pieces)
        cuts = [i * len(pieces) // leaves for i in range(leaves + 1)] if leaves else [0]
        pairs = list(zip(cuts, cuts[1:], strict=False))
        return [sum(map(len, pieces[a:b])) for a, b in pairs], [sum(counts[a:b]) for a, b in pairs]

    def _build(self, ends: list[int], sums: list[int]) -> None:
        self.ends, self.n = ends, max(1, len(sums))
        self.tree = [0] * self.n + (sums or [0])
        for i in range(self.n - 1, 0, -1):
            self.tree[i] = self.tree[2 * i] + self.tree[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tree[1]

    def _set(self, leaf: int, value: int) -> None:
        i = leaf + self.n
        change = value - self.tree[i]
        while i and change:
            self.tree[i] += change
            i //= 2

    def apply(self, edits: list[tuple[int, int, str]]) -> int:
        """Replace text[a:b] by s for each (a, b, s), sorted and apart; gives the number of pre-tokens encoded anew.

        Pre-tokens are cut by a pattern that looks one character ahead, so re-cutting begins at a leaf's start that lies
        at least a whole pre-token before the edit and ends at the first old leaf border, past the edit, at which the
        new cut has a border as well. The pre-tokens of a re-cut region are dealt out over its old leaves, whose sums
        are updated along their paths; only where a leaf would grow to twice LEAF is the tree built anew, from sums.
        """
        if not edits:
            return 0
        out, moves, at, shift = [], [], 0, 0
        for a, b, s in edits:
            out += [self.text[at:a], s]
            shift += len(s) - (b - a)
            moves.append((b, shift))
            at = b
        new = "".join([*out, self.text[at:]])
        places = [b for b, _ in moves]

        def moved(x: int) -> int:
            """The new place of old place x, which lies in no edit."""
            k = bisect_right(places, x)
            return x + (moves[k - 1][1] if k else 0)

        begin_of = lambda leaf: self.ends[leaf - 1] if leaf else 0
        regions, k, done = [], 0, -1  # (first leaf, last leaf, begin in the new text, pre-tokens)
        while k < len(edits):
            a = edits[k][0]
            # a leaf that begins close to the edit may owe its first border to it
            leaf = min(bisect_right(self.ends, max(a - 1, 0)), len(self.ends) - 1) if self.ends else 0
            start = begin_of(leaf)
            while leaf and begin_of(leaf) == start:
                leaf -= 1
            leaf = max(done + 1, leaf)
            place = moved(begin_of(leaf)) if leaf else 0
            stop, pieces = leaf, []
            found = self.encoder.pattern.finditer(new, place)
            edge = place
            while True:
                # the first leaf border past all edits that begin before it, with room to look ahead
                while stop < len(self.ends) and k < len(edits) and edits[k][0] <= self.ends[stop]:
                    if edits[k][1] < self.ends[stop]:
                        k += 1
                    else:
                        stop += 1
                goal = moved(self.ends[stop]) if stop < len(self.ends) and self.ends[stop] < len(self.text) else len(new)
                while edge < goal:
                    m = next(found, None)
                    if m is None:
                        edge = goal = len(new)
                        break
                    pieces.append(m[0])
                    edge = m.end()
                if edge == goal:
                    break
                stop += 1
            if goal == len(new):
                k, stop = len(edits), len(self.ends) - 1
            regions.append((leaf, stop, place, pieces))
            done = stop
        ends = list(map(moved, self.ends))  # right outside the regions
        grown = any(len(p) > 2 * LEAF * (last - first + 1) for first, last, _, p in regions)
        sums = self.tree[self.n : self.n + len(self.ends)]
        for first, last, place, pieces in reversed(regions):
            lengths, counts = self._leaves(pieces, -(-len(pieces) // LEAF) if grown else last - first + 1)
            ends[first : last + 1] = [place + x for x in np.cumsum(lengths, dtype=int).tolist()]
            if grown:
                sums[first : last + 1] = counts
            else:
                for i, c in enumerate(counts, first):
                    self._set(i, c)
        self.text = new
        if grown:
            self._build(ends, sums)
        else:
            self.ends = ends
        return sum(len(p) for _, _, _, p in regions)


def symbol_runs(text: str) -> list[tuple[int, int, str]]:
    """The clean-up's edits: every run of three or more of one symbol becomes one."""
    return [(m.start(), m.end(), m[1]) for m in _RUNS.finditer(text)]


def count_tokens(docs: DataFrame, vocabulary: str, edits=symbol_runs) -> DataFrame:
    """Token counts before and after each document's edits: doc_id, tokens_before, tokens_after, n_edits,
    n_pretokens, n_reencoded.

    ``edits`` maps a text to sorted, disjoint (begin, end, replacement). Null and empty text: zeros. Whole texts are
    encoded. Repeated rows are each counted; an empty table gives an empty result; other columns are not read,
    so their names may clash. ``vocabulary`` is a rank file that every worker can read; nothing of it is in this library.
    """

    def run(batches):
        encoder = Encoder(vocabulary)
        for batch in rows(batches):
            out = []
            for text in batch.column(1):
                tree = TokenTree(encoder, text.as_py() or "")
                before, changes = tree.total, edits(tree.text)
                again = tree.apply(changes)
                out.append((before, tree.total, len(changes), tree.encoded, again))
            columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "tokens_before", "tokens_after", "n_edits", "n_pretokens", "n_reencoded"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(
        run, f"doc_id {kind}, tokens_before long, tokens_after long, n_edits long, n_pretokens long, n_reencoded long"
    )
