"""Ranked lexical search: summed accumulators of short lists beside skipped long lists.

One pass over the documents keeps, per document, its length and the terms that the
items ask for; these rows are written once and give the statistics of the table.  Each
task then turns bounded runs of rows (shards) into posting lists.  An item's short
lists are summed term at a time into accumulators, which from there on are one list
with a known largest value.  Accumulators and long lists are walked together, window of
documents by window: windows whose bounds stay below the worst kept score are skipped,
lists that cannot lift a document over it are only probed for documents that the others
brought up.  Nothing is left out, the bounds are exact, so the ranking is exhaustive.

Defined results: a null or term-less text is no document of the statistics and never
found.  Repeated rows of a document are documents of their own; equal scores go to the
smaller id, a null id comes last.  Rows that repeat an item id are one item with all
their terms, a null item id is an item like any other; items without terms give no rows.
Other columns are ignored, empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.sizing import shared_folder
from tabloom.llm.ship import ship
from tabloom.llm.words import word_lists

TOP = 10
# Bytes of item texts that are searched together; more items mean more passes.
BLOCK_BYTES = 8_000_000
# Postings and documents of a shard: 2 M postings are about 100 MB while it is built.
SHARD_POSTINGS = 2_000_000
SHARD_DOCS = 65_536
# Documents of a window, and the share of a shard's documents up to which the lists of
# an item that are summed first may reach together.
WINDOW = 2_048
SHORT_SHARE = 8

# Digits, letters (A-Z folded) and all bytes of other characters stay, the rest parts terms.
TERMS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
Postings = tuple[np.ndarray, np.ndarray]


def _term_counts(raw: bytes | None) -> Counter:
    counts: Counter = Counter()
    for words in word_lists(raw, TERMS):
        counts.update(words)
    return counts


def impact(tf: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """What an occurrence count gives in a document of ``n`` terms, before the weight."""
    m = 25 + (75 * n * documents) // terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Shard:
    """Posting lists of some documents, given in the order in which ties are broken."""

    def __init__(self, docs: int, of: np.ndarray, terms: np.ndarray, impacts: np.ndarray):
        order = np.argsort(terms, kind="stable")
        self.docs = docs
        self._terms, starts = np.unique(terms[order], return_index=True)
        self._ends = np.append(starts, len(terms))
        self._of, self._impacts = of[order], impacts[order]
        self._sums = np.zeros(docs, np.int64)
        self._bounds: dict[int, np.ndarray] = {}
        self.windows = -(-docs // WINDOW)

    def postings(self, term: int) -> Postings | None:
        at = np.searchsorted(self._terms, term)
        if at == len(self._terms) or self._terms[at] != term:
            return None
        s, e = self._ends[at], self._ends[at + 1]
        return self._of[s:e], self._impacts[s:e]

    def bounds(self, docs: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The largest value of a list in each window."""
        out = np.zeros(self.windows, np.int64)
        of = docs // WINDOW
        starts = np.flatnonzero(np.diff(of, prepend=-1))
        if len(starts):
            out[of[starts]] = np.maximum.reduceat(values, starts)
        return out

    def term_bounds(self, term: int, postings: Postings) -> np.ndarray:
        if term not in self._bounds:
            self._bounds[term] = self.bounds(*postings)
        return self._bounds[term]

    def accumulate(self, lists: list[tuple[int, Postings]]) -> Postings:
        """Term at a time: the summed scores of the documents in any of the lists."""
        found = np.unique(np.concatenate([docs for _, (docs, _) in lists]))
        for w, (docs, values) in lists:
            self._sums[docs] += w * values
        sums = self._sums[found]
        self._sums[found] = 0
        return found, sums


def _best(docs: np.ndarray, scores: np.ndarray, top: int) -> Postings:
    order = np.lexsort((docs, -scores))[:top]
    return docs[order], scores[order]


def search_shard(shard: Shard, item: dict[int, int], top: int, floor: int) -> Postings:
    """The ``top`` documents of a shard that score ``floor`` or more, best first.

    ``item`` has the summed weight of each of its terms.
    """
    lists = []
    for term, w in item.items():
        held = shard.postings(term) if w > 0 else None
        if held is not None:
            lists.append((term, w, held))
    lists.sort(key=lambda x: len(x[2][0]))
    room, short = shard.docs // SHORT_SHARE, 0
    while short < len(lists) and len(lists[short][2][0]) <= room:
        room -= len(lists[short][2][0])
        short += 1
    # The bounded iterators: (weight, documents, values, largest weighted value by window).
    walked = [(w, *p, w * shard.term_bounds(t, p)) for t, w, p in lists[short:]]
    floor = max(floor, 1)
    if short:
        docs, sums = shard.accumulate([(w, p) for _, w, p in lists[:short]])
        walked.append((1, docs, sums, shard.bounds(docs, sums)))
        if len(sums) >= top:
            # Scores only grow from here, so the kept ones reach this already.
            floor = max(floor, int(np.partition(sums, len(sums) - top)[len(sums) - top]))
    best = (np.empty(0, np.int64), np.empty(0, np.int64))
    if not walked:
        return best
    bounds = np.array([b for *_, b in walked])
    reach = bounds.sum(axis=0)
    for window in np.flatnonzero(reach >= floor):
        if reach[window] < floor:
            continue
        low = window * WINDOW
        order = np.argsort(bounds[:, window])
        below = np.cumsum(bounds[order, window])
        # Lists that cannot reach the floor even together bring up no document.
        probed = int(np.searchsorted(below, floor, side="left"))
        sums = np.zeros(min(WINDOW, shard.docs - low), np.int64)
        parts = {}
        for k in order:
            if bounds[k, window]:
                w, docs, values, _ = walked[k]
                s, e = np.searchsorted(docs, (low, low + WINDOW))
                parts[k] = (w, docs[s:e] - low, values[s:e])
        for k in order[probed:]:
            w, docs, values = parts[k]
            sums[docs] += w * values
        found = np.flatnonzero(sums)
        for place in range(probed - 1, -1, -1):
            found = found[sums[found] + below[place] >= floor]
            if not len(found) or order[place] not in parts:
                continue
            w, docs, values = parts[order[place]]
            at = np.searchsorted(docs, found)
            at[at == len(docs)] = 0
            hit = docs[at] == found
            sums[found[hit]] += w * values[at[hit]]
        found = found[sums[found] >= floor]
        if len(found):
            best = _best(np.append(best[0], found + low), np.append(best[1], sums[found]), top)
            if len(best[0]) == top:
                floor = max(floor, int(best[1][-1]))
    return best


def _forward(docs: DataFrame, doc_id: str, text: str, numbers: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, terms, tfs`` of every document with a term."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = numbers.keys()
        for batch in batches:
            lengths, terms, tfs = [], [], []
            for raw in batch["raw"].to_pylist():
                counts = _term_counts(raw)
                held = sorted((numbers[t], counts[t]) for t in counts.keys() & wanted)
                lengths.append(counts.total())
                terms.append([t for t, _ in held])
                tfs.append([c for _, c in held])
            out = pa.record_batch(
                {
                    "doc_id": batch["doc_id"],
                    "n": pa.array(lengths, pa.int64()),
                    "terms": pa.array(terms, pa.list_(pa.int32())),
                    "tfs": pa.array(tfs, pa.list_(pa.int64())),
                }
            )
            yield out.filter(pa.array([n > 0 for n in lengths], pa.bool_()))

    rows = docs.filter(F.col(text).isNotNull()).select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("raw")
    )
    return rows.mapInArrow(index, "doc_id long, n long, terms array<int>, tfs array<long>")


def _search(forward: DataFrame, items: list[dict[int, int]], documents: int, terms: int, top: int) -> DataFrame:
    """``(item, doc_id, score)``: each task's best documents of every item."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[tuple[int, bool, int]]] = [[] for _ in items]
        held: list[pa.RecordBatch] = []

        def run() -> None:
            table = pa.Table.from_batches(held)
            held.clear()
            if not table.num_rows:
                return
            # Null ids sort last, as in the final ranking.
            table = table.sort_by("doc_id").combine_chunks()
            ids = table["doc_id"].to_pylist()
            lists, tfs = table["terms"].combine_chunks(), table["tfs"].combine_chunks()
            of = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy())
            n = table["n"].to_numpy()
            values = impact(tfs.flatten().to_numpy(), n[of], documents, terms)
            shard = Shard(len(ids), of, lists.flatten().to_numpy(), values)
            for number, item in enumerate(items):
                old = kept[number]
                found = search_shard(shard, item, top, -old[-1][0] if len(old) == top else 0)
                if len(found[0]):
                    new = [(-int(s), ids[d] is None, ids[d] or 0) for d, s in zip(*found)]
                    kept[number] = sorted(old + new)[:top]

        size = rows = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                held.append(part)
                size += len(part["terms"].flatten())
                rows += part.num_rows
                if size >= SHARD_POSTINGS or rows >= SHARD_DOCS:
                    run()
                    size = rows = 0
        if held:
            run()
        flat = [(number, None if none else d, -s) for number, best in enumerate(kept) for s, none, d in best]
        yield pa.record_batch(
            {
                "item": pa.array([x[0] for x in flat], pa.int32()),
                "doc_id": pa.array([x[1] for x in flat], pa.int64()),
                "score": pa.array([x[2] for x in flat], pa.int64()),
            }
        )

    return forward.mapInArrow(search, "item int, doc_id long, score long")


def ranked_search(
    items: DataFrame,
    docs: DataFrame,
    top: int = TOP,
    item_id: str = "item_id",
    item_text: str = "text",
    doc_id: str = "doc_id",
    doc_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``item_id, rank, doc_id, score`` of each item's ``top`` documents.

    Items are searched in blocks of about ``block_bytes`` of text, whose terms are what
    travels to the driver and the tasks; each block is one pass over the documents.
    """
    spark = docs.sparkSession
    ship(spark)
    asked = items.select(
        F.col(item_id).cast("long").alias("item_id"),
        F.coalesce(F.col(item_text).cast("string"), F.lit("")).cast("binary").alias("raw"),
    )
    size = asked.agg(F.sum(F.length("raw"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    out = None
    for block in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block) if blocks > 1 else asked
        found = _block(part, docs, top, doc_id, doc_text)
        out = found if out is None else out.unionByName(found)
    return out


def _block(asked: DataFrame, docs: DataFrame, top: int, doc_id: str, doc_text: str) -> DataFrame:
    spark = docs.sparkSession
    by_item: dict[int | None, Counter] = {}
    for row in asked.collect():
        by_item.setdefault(row["item_id"], Counter()).update(_term_counts(bytes(row["raw"])))
    numbers = {t: k for k, t in enumerate(sorted(set().union(*by_item.values())))}
    folder = shared_folder(spark, "lexical")
    _forward(docs, doc_id, doc_text, numbers).write.parquet(folder)
    forward = spark.read.parquet(folder)
    whole = forward.agg(F.count("*").alias("documents"), F.sum("n").alias("terms")).first()
    documents, terms = whole["documents"], whole["terms"] or 0
    held = forward.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
    weights = {r["term"]: weight(documents, r["count"]) for r in held}
    ids = list(by_item)
    wanted = [
        {numbers[t]: c * weights[numbers[t]] for t, c in by_item[i].items() if numbers[t] in weights} for i in ids
    ]
    best = _search(forward, wanted, documents, terms, top)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    named = spark.createDataFrame([(k, i) for k, i in enumerate(ids)], "item int, item_id long")
    return best.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")
