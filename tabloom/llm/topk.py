"""Exact top-k search by exhaustive term-at-a-time accumulation.

Candidate rows are dealt into bounded blocks, and every query row goes to every block
in a stream behind the block's rows, so that a task holds one block and one batch of
queries.  In a block each term has its postings; a query adds, term after term, its
weight times the postings' weights into a dense array of scores.  Partition selection
gives the block's best, and a ranked merge over the blocks gives the result.

Defined results: rows with a null id or vector take no part.  A candidate with the
query's own id is left out.  Equal scores go to the smaller id.  Repeated candidate
rows fill as many ranks as they have copies; query rows that repeat an id are one
query, that of the smallest vector.  Scores are 64-bit integers.  Missing terms weigh
zero.  An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.ship import ship

# Candidate rows of a block; a task holds one, and one score for each of its rows.
BLOCK_ROWS = 16_384


class Block:
    """Postings of one block of candidates, by term."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, terms: np.ndarray, weights: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        row = np.empty(len(ids), np.int64)
        row[order] = np.arange(len(ids))
        row = np.repeat(row, lengths)
        order = np.lexsort((row, terms))
        terms, row, weights = terms[order], row[order], weights[order]
        start = np.flatnonzero(np.concatenate(([True], terms[1:] != terms[:-1]))) if len(terms) else []
        self.postings: dict[int, tuple[np.ndarray | None, np.ndarray]] = {}
        for s, e in zip(start, [*start[1:], len(terms)]):
            if 2 * (e - s) > len(ids) and (np.diff(row[s:e]) > 0).all():
                # A term of most rows is kept as a whole column.
                column = np.zeros(len(ids), np.int64)
                column[row[s:e]] = weights[s:e]
                self.postings[int(terms[s])] = (None, column)
            else:
                self.postings[int(terms[s])] = (row[s:e], weights[s:e])
        self.scores = np.zeros(len(ids), np.int64)
        self.product = np.empty(len(ids), np.int64)

    def best(self, own: int, terms: list[int], weights: list[int], k: int):
        """Ids and scores of the block's ``k`` best rows for one query."""
        scores = self.scores
        scores[:] = 0
        for term, weight in zip(terms, weights):
            rows, values = self.postings.get(term, (None, None))
            if values is None:
                continue
            if rows is None:
                np.multiply(values, weight, out=self.product)
                scores += self.product
            else:
                np.add.at(scores, rows, values * weight)
        lo, hi = np.searchsorted(self.ids, [own, own + 1])
        if lo < hi:
            left = np.concatenate((np.arange(lo), np.arange(hi, len(scores))))
            values, ids = scores[left], self.ids[left]
        else:
            values, ids = scores, self.ids
        if len(values) > k:
            least = np.partition(values, len(values) - k)[len(values) - k]
            above = np.flatnonzero(values > least)
            tied = np.flatnonzero(values == least)[: k - len(above)]
            chosen = np.concatenate((above, tied))
            return ids[chosen], values[chosen]
        return ids.copy(), values.copy()


def sparse(vector: Column, scale: int = 256) -> tuple[Column, Column, Column]:
    """``valid, terms, weights`` of a dense vector column: ``floor(scale * x)``, zeros left out."""
    number = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"))
    valid = vector.isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    entries = F.filter(
        F.transform(number, lambda w, i: F.struct(i.cast("int").alias("t"), w.alias("w"))), lambda e: e.w != 0
    )
    return valid, F.transform(entries, lambda e: e.t), F.transform(entries, lambda e: e.w)


def search(queries: DataFrame, rows: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``; both inputs hold ``id, terms, weights``."""
    ship(rows.sparkSession)
    rows = rows.select("id", "terms", "weights").filter("id is not null and terms is not null")
    queries = queries.select("id", "terms", "weights").filter("id is not null and terms is not null")
    blocks = max(1, -(-rows.count() // block_rows))
    queries = queries.groupBy("id").agg(F.min(F.struct("terms", "weights")).alias("v")).select(
        "id", "v.terms", "v.weights"
    )
    dealt = rows.select(
        F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("asks"), "*"
    ).union(
        queries.select(
            F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("asks"), "*"
        )
    )
    streamed = dealt.repartition(blocks, "block").sortWithinPartitions("block", "asks")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        number, block = None, None
        for batch in batches:
            numbers = batch["block"].to_numpy()
            asks = batch["asks"].to_numpy().astype(bool)
            edges = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(asks.astype(int)) != 0)) + 1
            for s, e in zip([0, *edges], [*edges, len(numbers)]):
                if s == e:
                    continue
                part = batch.slice(s, e - s)
                ids, terms, weights = part["id"].to_numpy(), part["terms"], part["weights"]
                if not asks[s]:
                    if number != numbers[s]:
                        held, block, number = [], None, numbers[s]
                    held.append(
                        (
                            ids,
                            terms.value_lengths().to_numpy(zero_copy_only=False),
                            terms.flatten().to_numpy(),
                            weights.flatten().to_numpy(),
                        )
                    )
                    continue
                if number != numbers[s]:
                    continue  # a block without candidates
                if block is None:
                    block = Block(*(np.concatenate(x) for x in zip(*held)))
                    held = []
                out = [
                    block.best(own, t, w, k)
                    for own, t, w in zip(ids.tolist(), terms.to_pylist(), weights.to_pylist())
                ]
                yield pa.record_batch(
                    {
                        "query_id": np.repeat(ids, [len(x) for x, _ in out]),
                        "vec_id": np.concatenate([x for x, _ in out]),
                        "score": np.concatenate([y for _, y in out]),
                    }
                )

    found = streamed.mapInArrow(scan, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
