"""Quality rules: counts of words, symbols and lines, and suffix-array repetition.

The suffix array of a text's words is sorted by prefix doubling; the ranks of every
doubling give the longest common prefix of neighbouring suffixes.  Each interval of
suffixes that share a prefix is a maximal repeated passage; the union of the passages'
spans gives the covered words, the largest prefix the longest repeat.  Both limits can
reject a text that the plain counts let pass.

Texts of one Arrow batch are worked in bounded chunks, a long text in a chunk of its
own (about 4 bytes a word for each doubling its longest repeat needs).

Defined results: a null text counts as empty, has no words and fails the base rules.
Repeated rows are measured alike.  Clashing column names do not matter because all
measures travel in one struct column.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tabloom.llm.places import by_place
from tabloom.llm.ship import ship

# Words that are sorted at once, unless a single text has more.
WORDS_AT_ONCE = 200_000
WINDOW = 3
MIN_WORDS = 50
# A passage counts as repeated from this many words on.
PASSAGE_WORDS = 10
# Per cent of a text's words that repeated passages may cover.
MAX_COVERED = 30
# Words that the longest repeated passage may have.
MAX_REPEAT = 60

FIELDS = (
    "n_words word_chars n_symbols n_dup_lines n_repeat_words covered_words longest_repeat".split()
)
_SYMBOLS = np.isin(np.arange(256), list(b"[#*$%&|<>]"[1:-1]))
_WHITE = np.isin(np.arange(256), [32, *range(9, 14)])
_LEADS = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a code point


def repeat_lengths(words: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each word the length of the longest passage that begins there and occurs
    again in the same text (0 where that is less than two words).

    ``words`` holds word numbers, ``text`` the ascending number of the word's text.
    """
    n = len(words)
    longest = np.zeros(n, np.int64)
    if n < 2:
        return longest
    last = np.flatnonzero(np.concatenate((text[1:] != text[:-1], [True]))) + 1
    end = np.repeat(last, np.diff(np.concatenate(([0], last))))

    def grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start of each item's run of equal keys, and whether the run has others."""
        new = np.concatenate(([True], key[1:] != key[:-1]))
        start = np.flatnonzero(new)
        size = np.diff(np.concatenate((start, [len(key)])))
        return np.repeat(start, size), np.repeat(size > 1, size)

    key = text.astype(np.int64) * (int(words.max()) + 1) + words
    order = np.argsort(key, kind="stable")
    start, shared = grouped(key[order])
    rank = np.empty(n, np.int32)
    rank[order] = start
    ranks = [rank]
    active = order[shared]
    pairs = None
    step = 1
    while len(active):
        ahead = active + step
        inside = ahead < end[active]
        second = np.where(inside, rank[np.minimum(ahead, n - 1)].astype(np.int64) + 1, 0)
        key = rank[active].astype(np.int64) * (n + 1) + second
        order = np.argsort(key, kind="stable")
        active, key = active[order], key[order]
        held = rank[active]
        outer, _ = grouped(held)
        inner, shared = grouped(key)
        rank = rank.copy()
        rank[active] = held + (inner - outer)
        ranks.append(rank)
        active = active[shared]
        pairs = active if pairs is None else pairs
        step *= 2
    if pairs is None or len(pairs) == 0:
        return longest
    # Suffixes that share two words or more, in the order of the finished array.
    array = pairs[np.argsort(rank[pairs], kind="stable")]
    a, b = array[:-1], array[1:]
    common = np.zeros(len(a), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        x, y = a + common, b + common
        inside = (x < end[a]) & (y < end[b])
        same = ranks[level][np.minimum(x, n - 1)] == ranks[level][np.minimum(y, n - 1)]
        common += (inside & same).astype(np.int64) << level
    np.maximum.at(longest, a, common)
    np.maximum.at(longest, b, common)
    return longest


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Words inside the union of the repeated passages of ``least`` words or more."""
    at = np.flatnonzero(longest >= least)
    edge = np.bincount(at, minlength=len(longest) + 1) - np.bincount(
        at + longest[at], minlength=len(longest) + 1
    )
    return np.cumsum(edge[:-1]) > 0


def _measure_chunk(texts: list[bytes], lists: list[list[bytes]], window: int, passage: int):
    counts = np.array([len(x) for x in lists])
    numbers: defaultdict = defaultdict()
    numbers.default_factory = numbers.__len__
    words = np.fromiter(
        (numbers[w] for x in lists for w in x), np.int64, count=int(counts.sum())
    )
    text = np.repeat(np.arange(len(lists)), counts)
    longest = repeat_lengths(words, text)
    out = np.zeros((len(texts), len(FIELDS)), np.int64)
    out[:, 0] = counts
    for k, raw in enumerate(texts):
        kinds = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        out[k, 1] = kinds[_LEADS & ~_WHITE].sum()
        out[k, 2] = kinds[_SYMBOLS].sum()
        lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
        out[k, 3] = len(lines) - len(set(lines))
    out[:, 4] = np.bincount(text[covered(longest, window)], minlength=len(texts))
    out[:, 5] = np.bincount(text[covered(longest, passage)], minlength=len(texts))
    if len(text):
        np.maximum.at(out[:, 6], text, longest)
    return out


def measure(texts: list[bytes | None], window: int = WINDOW, passage: int = PASSAGE_WORDS):
    """One row of ``FIELDS`` for each text; see the module."""
    parts, chunk, lists, held = [], [], [], 0
    for raw in texts:
        raw = raw or b""
        words = raw.split()
        if chunk and held + len(words) > WORDS_AT_ONCE:
            parts.append(_measure_chunk(chunk, lists, window, passage))
            chunk, lists, held = [], [], 0
        chunk.append(raw)
        lists.append(words)
        held += len(words)
    if chunk:
        parts.append(_measure_chunk(chunk, lists, window, passage))
    return np.concatenate(parts) if parts else np.zeros((0, len(FIELDS)), np.int64)


def measures(text: str, window: int = WINDOW, passage: int = PASSAGE_WORDS):
    """Struct column of ``FIELDS`` (long) for a text column."""
    ship()

    @arrow_udf(", ".join(f"{f} long" for f in FIELDS))
    def column(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = measure(batch.to_pylist(), window, passage)
            yield pa.StructArray.from_arrays(
                [pa.array(np.ascontiguousarray(rows[:, k])) for k in range(len(FIELDS))],
                names=list(FIELDS),
            )

    return column(F.col(text).cast("binary"))


def with_verdict(
    docs: DataFrame,
    text: str = "text",
    out: str = "quality",
    window: int = WINDOW,
    passage: int = PASSAGE_WORDS,
    min_words: int = MIN_WORDS,
    max_covered: int = MAX_COVERED,
    max_repeat: int = MAX_REPEAT,
) -> DataFrame:
    """``docs`` with a struct column ``out``: the measures, ``base_failed``, ``kept``."""
    q = docs.withColumn("__measures", measures(text, window, passage))
    m = {f: F.col(f"__measures.{f}") for f in FIELDS}
    base_failed = (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    kept = (
        ~base_failed
        & (100 * m["covered_words"] <= max_covered * m["n_words"])
        & (m["longest_repeat"] <= max_repeat)
    )
    fields = [c.alias(f) for f, c in m.items()]
    return q.withColumn(
        out, F.struct(*fields, base_failed.alias("base_failed"), kept.alias("kept"))
    ).drop("__measures")


def keep_good(docs: DataFrame, text: str = "text", **limits) -> DataFrame:
    """``docs`` without the rows that the rules reject; columns stay as they are."""
    rows, (body,) = by_place(docs, text)
    marked = with_verdict(rows, body, "__quality", **limits)
    return marked.filter("__quality.kept").drop("__quality").toDF(*docs.columns)
