"""Edit-aware token counts with a segment tree over each document's pre-tokens.

A leaf holds a short run of pre-tokens with its code points and tokens; inner nodes hold
their sums.  An edit goes down the tree to the leaves it touches, splits only the text
from a few code points before the edit until the splits agree with the old ones again,
counts the new pre-tokens, and adds the difference to the sums above.  The root is the
document's token count.

The splits depend on no text before a pre-token and on two code points behind it, so the
counts are those of the whole edited text.

Defined results: a null text counts as empty.  Edits are ``(start, end, new)`` in code
points of the text before any edit, and must not overlap; null edits are none, a null
replacement is empty.  Repeated rows count alike; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tabloom.llm.bpe import Bpe
from tabloom.llm.ship import ship

# Pre-tokens of one leaf.
LEAF = 32
# Code points that a split may look at behind its end.
AHEAD = 3
# Texts whose pre-tokens are learned together.
CHARS_AT_ONCE = 2_000_000


class Counter:
    """Pre-token split and token counts of one vocabulary file."""

    def __init__(self, path: str, pattern: str):
        self.bpe = Bpe(path)
        self.pattern = regex.compile(pattern)

    def split(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def counts(self, words: list[str]) -> list[int]:
        known = self.bpe.known
        try:
            return [len(known[w]) >> 2 for w in words]
        except KeyError:
            self.bpe.learn(set(words))
            known = self.bpe.known
            return [len(known[w]) >> 2 for w in words]


class TokenTree:
    """Segment tree of one document."""

    def __init__(self, counter: Counter, words: list[str], counts: list[int] | None = None):
        self.counter = counter
        counts = counter.counts(words) if counts is None else counts
        self.words = [words[k : k + LEAF] for k in range(0, len(words), LEAF)] or [[]]
        lengths = [len(w) for w in words]
        leaves = len(self.words)
        self.width = 1 << max(leaves - 1, 0).bit_length()
        chars = np.zeros(2 * self.width, np.int64)
        tokens = np.zeros(2 * self.width, np.int64)
        if words:
            at = np.arange(0, len(words), LEAF)
            chars[self.width : self.width + leaves] = np.add.reduceat(lengths, at)
            tokens[self.width : self.width + leaves] = np.add.reduceat(counts, at)
        level = self.width
        while level > 1:
            for sums in (chars, tokens):
                sums[level // 2 : level] = sums[level : 2 * level : 2] + sums[level + 1 : 2 * level : 2]
            level //= 2
        self.chars, self.tokens = chars.tolist(), tokens.tolist()
        self.encoded = 0  # pre-tokens counted for edits

    @property
    def total(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(w for leaf in self.words for w in leaf)

    def _leaf_at(self, position: int) -> tuple[int, int]:
        """The leaf that holds a code point (the last one at the end), and where it starts."""
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if position >= start + self.chars[node] and self.chars[node + 1] > 0:
                start += self.chars[node]
                node += 1
        return node - self.width, start

    def _set_leaf(self, leaf: int, words: list[str]) -> None:
        chars = sum(map(len, words))
        tokens = sum(self.counter.counts(words))
        self.words[leaf] = words
        node = leaf + self.width
        more_chars, more_tokens = chars - self.chars[node], tokens - self.tokens[node]
        while node:
            self.chars[node] += more_chars
            self.tokens[node] += more_tokens
            node >>= 1

    def replace(self, start: int, end: int, new: str) -> None:
        """Put ``new`` in place of the code points ``[start, end)``."""
        first, first_at = self._leaf_at(max(start - AHEAD, 0))
        # A split that began before the context may reach into it.
        while first > 0 and (not self.words[first] or first_at > start - AHEAD):
            first -= 1
            first_at -= self.chars[first + self.width]
        old: list[str] = []
        last, reach = first, first_at
        while last < len(self.words) and reach < end + AHEAD:
            old += self.words[last]
            reach += self.chars[last + self.width]
            last += 1
        # Words that neither the edit nor a look ahead touches stay as they are.
        keep, at = 0, first_at
        while keep < len(old) and at + len(old[keep]) + AHEAD <= start:
            at += len(old[keep])
            keep += 1
        head, begin = old[:keep], at
        while True:
            tail = old[keep:]
            text = "".join(tail)
            edited = text[: start - begin] + new + text[end - begin :]
            shift = len(new) - (end - start)
            ends: dict[int, int] = {}
            p = begin
            for k, w in enumerate(tail):
                if p >= end:
                    ends[p + shift] = k
                p += len(w)
            final = last >= len(self.words)
            safe = len(edited) - (0 if final else AHEAD)
            made: list[str] = []
            agreed = None
            q = 0
            for m in self.counter.pattern.finditer(edited):
                if begin + q >= end + shift and (begin + q) in ends and q >= start - begin + len(new):
                    agreed = ends[begin + q]
                    break
                if m.end() > safe:
                    break
                made.append(m.group())
                q = m.end()
            if agreed is None and q == len(edited) and final:
                agreed = len(tail)
            if agreed is not None:
                break
            # The splits have not agreed yet: take in as many leaves again.
            for _ in range(max(1, last - first)):
                if last < len(self.words):
                    old += self.words[last]
                    last += 1
        self.encoded += len(made)
        words = head + made + tail[agreed:]
        leaves = last - first
        share = -(-len(words) // leaves) if leaves else 0
        for k in range(leaves):
            self._set_leaf(first + k, words[k * share : (k + 1) * share])


@lru_cache(maxsize=2)
def loaded(path: str, pattern: str) -> Counter:
    return Counter(path, pattern)


def edited_counts(text: Column, edits: Column, path: str, pattern: str) -> Column:
    """Struct ``n_tokens, n_tokens_edited, n_encoded`` of a text and its edits.

    ``edits`` is an array of ``(start, end, new)``; ``n_encoded`` counts the pre-tokens
    that were split again.  Give both as columns of the table that are also used
    elsewhere in the row (the query counts the edits): Spark does not plan a Python
    function over an array function that it has merged into its arguments.
    """

    ship()

    @arrow_udf("n_tokens long, n_tokens_edited long, n_encoded long")
    def counted(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        counter = loaded(path, pattern)
        for texts, changes in batches:
            rows: list[tuple[int, int, int]] = []
            chunk: list[tuple[list[str], list]] = []
            held = 0

            def finish() -> None:
                counter.bpe.learn(set().union(*(w for w, _ in chunk)))
                for words, edits in chunk:
                    tree = TokenTree(counter, words)
                    before = tree.total
                    for e in sorted(edits, key=lambda e: e["start"], reverse=True):
                        tree.replace(e["start"], e["end"], e["new"] or "")
                    rows.append((before, tree.total, tree.encoded))
                chunk.clear()

            for raw, change in zip(texts, changes):
                body = raw.as_py() or ""
                chunk.append((counter.split(body), change.as_py() or []))
                held += len(body)
                if held >= CHARS_AT_ONCE:
                    finish()
                    held = 0
            if chunk:
                finish()
            columns = list(zip(*rows)) if rows else [[], [], []]
            yield pa.StructArray.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], names=["n_tokens", "n_tokens_edited", "n_encoded"]
            )

    return counted(text, edits)
