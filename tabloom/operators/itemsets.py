"""Frequent itemsets: level-wise counting and FP-growth, with the same result."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import combinations, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..functions.sizing import collect_if_small, cut_lineage, join_by_size
from .baskets import EQUAL, Baskets

# Automatic length limits by item count, and the guards.
LENGTH_MANY_ITEMS = 3
LENGTH_SOME_ITEMS = 4
LENGTH_FEW_ITEMS = 5
MANY_ITEMS = 50
SOME_ITEMS = 20
LENGTH_CAP = 8
WIDE_TABLE_COLUMNS = 20
WIDE_TABLE_SUPPORT = 0.2
WIDE_TABLE_LENGTH = 3

# Candidates of one level that are sent to the tasks as an array; more stay in tables.
MAX_CANDIDATES = 100_000
# Candidates whose bit columns are combined at once inside a task.
STEP = 4_096

SCHEMA = "items array<string>, freq long, support double, length int"


def automatic_length(n_items: int) -> int:
    """Longest itemset of the guard policy for a number of distinct items (or columns)."""
    if n_items > MANY_ITEMS:
        return LENGTH_MANY_ITEMS
    return LENGTH_SOME_ITEMS if n_items > SOME_ITEMS else LENGTH_FEW_ITEMS


def mining_limits(
    n_columns: int, min_support: float, max_len: int | None, guard: bool = False
) -> tuple[float, int | None]:
    """Support and length limits really used.

    Only with ``guard`` are they tightened: lengths to :func:`automatic_length` or
    ``LENGTH_CAP``, and for wide tables to the fixed support and length.
    """
    if not guard:
        return min_support, max_len
    max_len = automatic_length(n_columns) if max_len is None else min(max_len, LENGTH_CAP)
    if n_columns > WIDE_TABLE_COLUMNS:
        min_support = max(min_support, WIDE_TABLE_SUPPORT)
        max_len = min(max_len, WIDE_TABLE_LENGTH)
    return min_support, max_len


def item_frequencies(baskets: Baskets) -> DataFrame:
    return baskets.data.select(F.explode("items").alias("item")).groupBy("item").agg(
        F.count(F.lit(1)).alias("freq")
    )


def frequent_itemsets(
    baskets: Baskets, min_support: float = 0.1, max_len: int | None = None, algorithm: str = "apriori"
) -> DataFrame:
    """``(items, freq, support, length)`` of all itemsets with at least ``min_support``.

    ``max_len=None`` sets no limit on the length.
    """
    if algorithm == "apriori":
        return apriori(baskets, min_support, max_len)
    if algorithm == "fpgrowth":
        return fp_growth(baskets, min_support, max_len)
    raise ValueError(f"unknown algorithm {algorithm!r}")


def fp_growth(baskets: Baskets, min_support: float, max_len: int | None = None) -> DataFrame:
    """FP-growth with an inclusive support threshold.

    Where transactions are often equal they are grouped first and the patterns are grown
    on the groups (:func:`_grow`).  Otherwise the estimator does it; it rounds
    ``support × n`` up, which can lose an itemset exactly on the threshold, so it is
    asked for slightly less and the exact ratio is filtered here.
    The itemsets are written to the shared folder once: they are read several times
    by rule generation, and mining them again would be far dearer.
    """
    spark = baskets.data.sparkSession
    if baskets.groups is not None:
        return _grow(baskets.groups, baskets.n, min_support, max_len)
    occupied = baskets.data.where(F.size("items") > 0).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows, kinds = occupied.agg(F.count("*"), F.approx_count_distinct(F.xxhash64("items"))).first()
        if not rows:
            return spark.createDataFrame([], SCHEMA)
        if EQUAL * kinds <= rows:
            groups = occupied.groupBy("items").agg(F.count(F.lit(1)).alias("freq"))
            return _grow(groups, baskets.n, min_support, max_len)
        # The same absolute support, over the transactions that have items.
        asked = min(1.0, max(min_support - 1e-9, 0.0) * baskets.n / rows)
        model = FPGrowth(itemsCol="items", minSupport=asked).fit(occupied)
        found = model.freqItemsets.select(
            F.array_sort("items").alias("items"),
            "freq",
            (F.col("freq") / F.lit(baskets.n)).alias("support"),
            F.size("items").alias("length"),
        ).where(F.col("support") >= min_support)
        return cut_lineage(found if max_len is None else found.where(F.col("length") <= max_len))
    finally:
        occupied.unpersist()


def _grow(groups: DataFrame, n: int, min_support: float, max_len: int | None) -> DataFrame:
    """Patterns grown on grouped transactions, all of one length in a step.

    An itemset's *base* has the items that come before it in each transaction it is in,
    equal ones once with their number.  Counting a base's items gives the itemsets one
    longer; cut at each of those items it gives their bases.
    """
    enough = F.col("freq") / F.lit(n) >= min_support
    bases = cut_lineage(
        groups.select(F.expr("CAST(array() AS array<string>)").alias("found"), F.array_sort("items").alias("before"), "freq")
    )
    levels = []
    for length in count(1) if max_len is None else range(1, max_len + 1):
        cells = bases.select("found", F.posexplode("before").alias("at", "item"), "before", "freq")
        fresh = cut_lineage(cells.groupBy("found", "item").agg(F.sum("freq").alias("freq")).where(enough))
        n_fresh = fresh.count()
        if not n_fresh:
            break
        levels.append(fresh.select(F.array_sort(F.concat("found", F.array("item"))).alias("items"), "freq"))
        if length == max_len:
            break
        bases = cut_lineage(
            join_by_size(cells.where(F.col("at") > 0), fresh.select("found", "item"), ["found", "item"], "inner", n_fresh)
            .groupBy(
                F.concat("found", F.array("item")).alias("found"),
                F.slice("before", F.lit(1), F.col("at")).alias("before"),
            )
            .agg(F.sum("freq").alias("freq"))
        )
    if not levels:
        return groups.sparkSession.createDataFrame([], SCHEMA)
    return reduce(DataFrame.unionAll, levels).select(
        "items", "freq", (F.col("freq") / F.lit(n)).alias("support"), F.size("items").alias("length")
    )


def apriori(
    baskets: Baskets, min_support: float, max_len: int | None = None, max_candidates: int = MAX_CANDIDATES
) -> DataFrame:
    """Level-wise counting.

    Frequent items come from one aggregate.  Each further level joins the previous
    level's itemsets that share all but their last item and counts the result in one
    pass.  While a level has at most ``max_candidates`` they travel to the tasks as an
    array (:func:`_few_candidates`); otherwise itemsets, candidates and counts stay in
    tables (:func:`_levels_in_tables`).  Both give the same itemsets.
    """
    spark = baskets.data.sparkSession
    if not baskets.n:
        return spark.createDataFrame([], SCHEMA)
    frequent = item_frequencies(baskets).where(F.col("freq") / F.lit(baskets.n) >= min_support)
    rows = collect_if_small(frequent.orderBy("item"))
    found = None if rows is None else _few_candidates(baskets, min_support, max_len, rows, max_candidates)
    if found is None:
        return _levels_in_tables(baskets, min_support, max_len, frequent)
    return spark.createDataFrame([(s, f, f / baskets.n, len(s)) for s, f in found], SCHEMA)


def _few_candidates(
    baskets: Baskets, min_support: float, max_len: int | None, rows: list[Row], max_candidates: int
) -> list[tuple[list[str], int]] | None:
    """Itemsets with their counts, or ``None`` once a level has too many candidates.

    A task turns its transactions into one bit column per frequent item, combines the
    columns of each candidate and sends a single partial count per candidate.
    """
    names = [r["item"] for r in rows]
    found: list[tuple[tuple[int, ...], int]] = [((i,), r["freq"]) for i, r in enumerate(rows)]
    level = [s for s, _ in found]
    data = baskets.data.select("items").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for _ in count(2) if max_len is None else range(2, max_len + 1):
            candidates = _candidates(level, max_candidates)
            if candidates is None:
                return None
            if not len(candidates):
                break
            counted = (
                data.mapInArrow(_count_candidates(names, candidates), "c int, n long")
                .groupBy("c")
                .agg(F.sum("n").alias("n"))
                .where(F.col("n") / F.lit(baskets.n) >= min_support)
                .collect()
            )
            fresh = sorted((tuple(int(x) for x in candidates[r["c"]]), r["n"]) for r in counted)
            found += fresh
            level = [s for s, _ in fresh]
    finally:
        data.unpersist()
    return [([names[i] for i in s], f) for s, f in found]


def _levels_in_tables(
    baskets: Baskets, min_support: float, max_len: int | None, frequent: DataFrame
) -> DataFrame:
    """Level-wise counting without collecting anything.

    Transactions are numbered and taken 64 at a time as a *word*; an itemset has one
    row ``(parent, item, word, bits)`` for each word it occurs in.  Two itemsets with
    the same parent meet on parent and word, never on the itemset alone, so an item
    that is in every transaction is spread over all tasks; the bits they share are
    counted before the shuffle.  Only words of frequent itemsets are written.
    """
    # Ids are given to checkpointed rows only: they come out the same when a task is repeated.
    numbered = cut_lineage(frequent).withColumn("sid", F.monotonically_increasing_id())
    level = numbered.select("sid", F.array("item").alias("items"), "freq")
    known = numbered.select("item", F.col("sid").alias("id"))
    n_known = known.count()
    transactions = cut_lineage(baskets.data.select("items")).select(
        F.monotonically_increasing_id().alias("tid"), "items"
    )
    cells = transactions.select("tid", F.explode("items").alias("item"))
    words = cut_lineage(
        join_by_size(cells, known, "item", "inner", n_known)
        .groupBy(F.col("id").alias("sid"), F.expr("shiftright(tid, 6)").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, CAST(tid & 63 AS INT))")).alias("bits"))
        .select("sid", F.lit(-1).cast("bigint").alias("parent"), F.col("sid").alias("item"), "word", "bits")
    )
    levels = [level]
    for _ in count(2) if max_len is None else range(2, max_len + 1):
        left = words.select("parent", "word", F.col("sid").alias("a"), F.col("item").alias("ai"), "bits")
        right = words.select("parent", "word", F.col("item").alias("b"), F.col("bits").alias("more"))
        both = (
            left.join(right, ["parent", "word"])
            .where(F.col("ai") < F.col("b"))
            .select("a", "b", "word", F.col("bits").bitwiseAND(F.col("more")).alias("bits"))
            .where(F.col("bits") != 0)
        )
        fresh = cut_lineage(
            both.groupBy("a", "b")
            .agg(F.sum(F.bit_count("bits")).cast("bigint").alias("freq"))
            .where(F.col("freq") / F.lit(baskets.n) >= min_support)
        ).withColumn("sid", F.monotonically_increasing_id())
        n_fresh = fresh.count()
        if not n_fresh:
            break
        texts = fresh.join(level.select(F.col("sid").alias("a"), "items"), "a").join(
            known.select(F.col("id").alias("b"), "item"), "b"
        )
        level = texts.select("sid", F.concat("items", F.array("item")).alias("items"), "freq")
        levels.append(level)
        words = cut_lineage(
            join_by_size(both, fresh.select("a", "b", "sid"), ["a", "b"], "inner", n_fresh).select(
                "sid", F.col("a").alias("parent"), F.col("b").alias("item"), "word", "bits"
            )
        )
    return reduce(DataFrame.unionAll, levels).select(
        F.array_sort("items").alias("items"),
        "freq",
        (F.col("freq") / F.lit(baskets.n)).alias("support"),
        F.size("items").alias("length"),
    )


def _candidates(level: list[tuple[int, ...]], most: int) -> np.ndarray | None:
    """Join itemsets sharing all but their last item and keep those with frequent subsets.

    ``None`` when the join has more than ``most`` rows, which is known before it is made.
    """
    known = set(level)
    tails: dict[tuple[int, ...], list[int]] = defaultdict(list)
    for s in level:
        tails[s[:-1]].append(s[-1])
    if sum(len(t) * (len(t) - 1) // 2 for t in tails.values()) > most:
        return None
    out = []
    for prefix, ends in tails.items():
        for a, b in combinations(sorted(ends), 2):
            candidate = (*prefix, a, b)
            if all(candidate[:i] + candidate[i + 1 :] in known for i in range(len(prefix))):
                out.append(candidate)
    width = len(level[0]) + 1 if level else 1
    return np.array(out, dtype=np.int32).reshape(-1, width)


def _count_candidates(names: list[str], candidates: np.ndarray):
    """Partial candidate counts of one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = pa.array(names, pa.string())
        totals = np.zeros(len(candidates), dtype=np.int64)
        for batch in batches:
            lists = batch.column(0)
            if not len(lists):
                continue
            flat = lists.flatten()
            codes = pc.index_in(flat.cast(pa.string()), value_set=values)
            owner = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            known = codes.is_valid().to_numpy(zero_copy_only=False)
            member = np.zeros((len(names), len(lists)), dtype=bool)
            member[codes.drop_null().to_numpy(), owner[known]] = True
            bits = np.packbits(member, axis=1)
            for s in range(0, len(candidates), STEP):
                part = candidates[s : s + STEP]
                both = bits[part[:, 0]]
                for j in range(1, part.shape[1]):
                    both &= bits[part[:, j]]
                totals[s : s + STEP] += np.bitwise_count(both).sum(axis=1, dtype=np.int64)
        hit = np.nonzero(totals)[0]
        yield pa.RecordBatch.from_arrays(
            [pa.array(hit.astype(np.int32)), pa.array(totals[hit])], ["c", "n"]
        )

    return run


def itemset_statistics(itemsets: DataFrame) -> DataFrame:
    """One row: number of itemsets, largest and mean support."""
    return itemsets.agg(
        F.count(F.lit(1)).alias("total_itemsets"),
        F.max("support").alias("max_support"),
        F.avg("support").alias("avg_support"),
    )


def itemsets_by_length(itemsets: DataFrame) -> DataFrame:
    return itemsets.groupBy("length").agg(F.count(F.lit(1)).alias("n"))


def itemset_text(itemsets: DataFrame) -> DataFrame:
    """Itemsets with a readable text form."""
    return itemsets.withColumn("itemset", F.array_join("items", ", "))
