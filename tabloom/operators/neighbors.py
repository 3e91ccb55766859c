"""Exact k nearest neighbours as a partitioned join.

Training rows are assigned to the nearest of a number of pivots that grows with the
table.  A query row is first answered by its home cell, which gives its true k-th
distance there; nearer rows can only be in cells whose distance ring reaches that
ball (triangle inequality), so it is sent to those cells alone.  Cells are cut into blocks of a
bounded number of rows and the queries of a cell into chunks of a bounded number
of rows; each task meets one block with one chunk as two matrices and returns only
the k best per query.  A cell or query group of any size is therefore split, no
pair of rows is ever a record, and no group is larger than its bound.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..functions.columns import col
from ..functions.sizing import cut_lineage
from .models import read_json, write_json

# Numbers (rows × features) per block or chunk: 32 MB of doubles.
BLOCK_NUMBERS = 4_000_000
MAX_BLOCK_ROWS = 50_000
# Pivots travel to every task: 4,096 x 64 features are 2 MB.  Cells only grow beyond
# MAX_PIVOTS x ROWS_PER_PIVOT rows, and are cut into blocks as ever.
MAX_PIVOTS = 4_096
ROWS_PER_PIVOT = 20_000
# Cells of the distance matrix held at once inside a task.
MATRIX_CELLS = 1_000_000
# Rows for each different one from which on equal rows are answered once.
REPEATED = 4


@dataclass
class Neighbors:
    """A stored training table, ready to answer queries."""

    train: DataFrame  # __id, __x (array<double>), label
    k: int
    weights: str
    regression: bool
    n_classes: int = 0
    block_rows: int | None = None
    rows_per_pivot: int = ROWS_PER_PIVOT

    @property
    def name(self) -> str:
        return "knn_regressor" if self.regression else "knn"

    def predict(self, df: DataFrame) -> DataFrame:
        """Predictions for rows with ``__id`` and ``features``.

        ``__id`` must be unique among the queries.
        """
        queries = df.select(F.col("__id").alias("__q"), vector_to_array("features").alias("__x"))
        nearest = nearest_neighbors(
            self.train, queries, self.k, self.block_rows, self.rows_per_pivot
        )
        if self.regression:
            votes = vote_mean(nearest, self.weights)
        else:
            votes = vote_class(nearest, self.weights)
            # Shares of at most k labels, laid out in class order.
            codes = F.sequence(F.lit(0), F.lit(max(self.n_classes, 1) - 1))
            share = F.transform(
                codes, lambda c: F.coalesce(F.element_at("shares", c.cast("double")), F.lit(0.0))
            )
            votes = votes.withColumn("probability", share).drop("shares", "confidence")
        return df.join(votes.withColumnRenamed("__q", "__id"), "__id", "left")

    def importance(self) -> None:
        return None

    def save(self, path: str) -> None:
        record = {
            "k": self.k,
            "weights": self.weights,
            "regression": self.regression,
            "n_classes": self.n_classes,
        }
        write_json(SparkSession.active(), record, f"{path}/parameters")
        self.train.write.parquet(f"{path}/rows")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Neighbors:
        record = read_json(spark, f"{path}/parameters")
        return Neighbors(spark.read.parquet(f"{path}/rows"), **record)


def fit_neighbors(
    train: DataFrame, k: int = 5, weights: str = "uniform", regression: bool = False, n_classes: int = 0
) -> Neighbors:
    """Keep id, features and label of the training rows (``__id``, ``features``, ``label``)."""
    rows = train.select("__id", vector_to_array("features").alias("__x"), F.col("label").cast("double"))
    return Neighbors(rows, k, weights, regression, n_classes)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(float, copy=False)


def _steps(rows: int, columns: int) -> Iterator[slice]:
    """Slices of rows whose matrix with the columns has at most ``MATRIX_CELLS``."""
    step = max(1, MATRIX_CELLS // max(1, columns))
    return (slice(s, min(s + step, rows)) for s in range(0, rows, step))


def _rough(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by products, and what each row's may be wrong by."""
    a_norm, b_norm = (a**2).sum(axis=1), (b**2).sum(axis=1)
    return a_norm[:, None] + b_norm[None, :] - 2.0 * (a @ b.T), 1e-12 * (a_norm + b_norm.max())


def _closest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A pivot as near as any, but for rounding, and the distance to it by differences."""
    cell = np.empty(len(x), np.int32)
    for s in _steps(len(x), len(pivots)):
        cell[s] = _rough(x[s], pivots)[0].argmin(axis=1)
    return cell, np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1))


def _best_of_block(k: int):
    """The k nearest block rows for each chunk row, by distance and then id."""

    def run(block: pa.Table, chunk: pa.Table) -> pa.Table:
        names, places, distances = [], [], []
        if block.num_rows and chunk.num_rows:
            block = block.take(pc.sort_indices(block, [("__id", "ascending")])).combine_chunks()
            chunk = chunk.combine_chunks()
            width = len(block["__x"][0])
            b, q = (_matrix(side["__x"].combine_chunks(), width) for side in (block, chunk))
            take = min(k, len(b))
            b_norm = (b**2).sum(axis=1)
            for s in _steps(len(q), len(b)):
                part = q[s]
                # Fast squared distances choose candidates; exact ones decide.
                p_norm = (part**2).sum(axis=1)
                rough = p_norm[:, None] + b_norm[None, :] - 2.0 * (part @ b.T)
                slack = 1e-9 * (p_norm[:, None] + b_norm.max() + 1.0)
                limit = np.partition(rough, take - 1, axis=1)[:, take - 1 : take] + slack
                row, column = np.nonzero(rough <= limit)
                exact = np.empty(len(row))
                for h in _steps(len(row), width):
                    exact[h] = np.sqrt(((part[row[h]] - b[column[h]]) ** 2).sum(axis=1))
                order = np.lexsort((column, exact, row))
                row, column, exact = row[order], column[order], exact[order]
                keep = np.arange(len(row)) - np.searchsorted(row, np.arange(len(part)))[row] < take
                names.append(s.start + row[keep])
                places.append(column[keep])
                distances.append(exact[keep])
        names, places = (np.concatenate([np.empty(0, np.int64), *v]) for v in (names, places))
        return pa.table(
            {
                "__q": chunk["__q"].take(pa.array(names)),
                "__d": np.concatenate([np.empty(0), *distances]),
                "__id": block["__id"].take(pa.array(places)),
                "label": block["label"].take(pa.array(places)),
            }
        )

    return run


def nearest_neighbors(
    train: DataFrame,
    queries: DataFrame,
    k: int,
    block_rows: int | None = None,
    rows_per_pivot: int = ROWS_PER_PIVOT,
) -> DataFrame:
    """``(__q, __d, __id, label, rank)``: the k nearest training rows of each query.

    Ties in distance go to the smaller ``__id``.  Where most rows have equals, queries on
    the same spot are answered once, from the k smallest ids of every spot.
    """
    kinds = F.approx_count_distinct(F.xxhash64("__x")).alias("kinds")
    facts = train.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("__x")).alias("d"), kinds).first()
    n, d = facts["n"], facts["d"]
    if not n:
        raise ValueError("the training table is empty")
    if n > REPEATED * facts["kinds"]:
        spot = Window.partitionBy("__x").orderBy("__id")
        first = train.withColumn("__n", F.row_number().over(spot)).where(F.col("__n") <= k).drop("__n")
        # Ids are given to checkpointed rows only: they come out the same when a task is repeated.
        spots = cut_lineage(queries.select("__x").distinct()).select(F.monotonically_increasing_id().alias("__q"), "__x")
        first = cut_lineage(first)
        found = _nearest(first, spots, k, first.count(), d, block_rows, rows_per_pivot)
        best = found.groupBy("__q").agg(F.collect_list(F.struct("__d", "__id", "label")).alias("best"))
        answers = spots.join(best, "__q").select("__x", "best")
        found = queries.join(answers, "__x").select("__q", F.inline("best"))
    else:
        found = _nearest(train, queries, k, n, d, block_rows, rows_per_pivot)
    return found.withColumn("rank", F.row_number().over(_nearest_first())).where(F.col("rank") <= k)


def _nearest(
    train: DataFrame, queries: DataFrame, k: int, n: int, d: int, block_rows: int | None, rows_per_pivot: int
) -> DataFrame:
    """``(__q, __d, __id, label)`` with at least the k nearest rows of each query."""
    block_rows = block_rows or max(1, min(MAX_BLOCK_ROWS, BLOCK_NUMBERS // max(d, 1)))
    n_pivots = max(1, min(MAX_PIVOTS, n // rows_per_pivot))
    id_type = train.schema["__id"].dataType.simpleString()
    q_type = queries.schema["__q"].dataType.simpleString()

    types = f"__q {q_type}, __d double, __id {id_type}, label double"
    routes = _route(train, n_pivots, k) if n_pivots > 1 else None
    if routes is None:
        whole = F.lit(0).alias("__cell")
        best = _search(train.select("*", whole), {0: n}, queries.select("*", whole), k, block_rows, types)
    else:
        sent = queries.select("*", routes.home("__x").alias("__cell"))
        # At most k rows for each query, read for the bound and for the answer.
        first = cut_lineage(_search(routes.placed, routes.sizes, sent, k, block_rows, types))
        first = first.withColumn("__n", F.row_number().over(_nearest_first())).where(F.col("__n") <= k)
        bound = first.where(F.col("__n") == k).select("__q", F.col("__d").alias("__bound"))
        others = (
            sent.withColumnRenamed("__cell", "__home")
            .join(bound, "__q")
            .select("__q", "__x", F.explode(routes.reach("__x", "__bound", "__home")).alias("__cell"))
        )
        more = _search(routes.placed, routes.sizes, cut_lineage(others), k, block_rows, types)
        best = first.drop("__n").unionByName(more)
    return best


def _nearest_first():
    return Window.partitionBy("__q").orderBy("__d", "__id")


def _search(
    placed: DataFrame, sizes: dict[int, int], sent: DataFrame, k: int, block_rows: int, types: str
) -> DataFrame:
    """The k nearest rows of each block for each query sent to its cell."""
    spark = placed.sparkSession
    waiting = {r["__cell"]: r["n"] for r in sent.groupBy("__cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    # One row per pivot that has queries: a table of at most MAX_PIVOTS rows.
    plan = F.broadcast(
        spark.createDataFrame(
            [(c, -(-sizes[c] // block_rows), -(-n // block_rows)) for c, n in waiting.items()],
            "__cell int, __blocks long, __chunks long",
        )
    )
    part = lambda key, of: F.pmod(F.xxhash64(col(key)), F.col(of))
    block_side = (
        placed.join(plan, "__cell")
        .withColumn("__block", part("__id", "__blocks"))
        .withColumn("__chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__chunks") - 1)))
        .select("__cell", "__block", "__chunk", "__id", "__x", "label")
    )
    chunk_side = (
        sent.join(plan, "__cell")
        .withColumn("__chunk", part("__q", "__chunks"))
        .withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__blocks") - 1)))
        .select("__cell", "__block", "__chunk", "__q", "__x")
    )
    keys = ["__cell", "__block", "__chunk"]
    return (
        block_side.groupBy(*keys).cogroup(chunk_side.groupBy(*keys)).applyInArrow(_best_of_block(k), types)
    )


@dataclass
class _Routes:
    """Training rows with their cell, cell sizes, and where a query has to look."""

    placed: DataFrame
    sizes: dict[int, int]
    home: Callable
    reach: Callable


def _route(train: DataFrame, n_pivots: int, k: int) -> _Routes | None:
    """Assign training rows to pivots; ``None`` when no cell has k rows."""
    # The pivots are the rows with the smallest id hashes: at most MAX_PIVOTS vectors.
    pivots = np.array(
        [r["__x"] for r in train.orderBy(F.xxhash64("__id"), "__id").select("__x").limit(n_pivots).collect()]
    )

    width = pivots.shape[1]

    @arrow_udf("struct<cell: int, distance: double>")
    def place(x: pa.Array) -> pa.Array:
        cell, distance = _closest(_matrix(x, width), pivots)
        return pa.StructArray.from_arrays([pa.array(cell), pa.array(distance)], ["cell", "distance"])

    # Read for the rings and for both searches.
    placed = cut_lineage(
        train.withColumn("__p", place("__x"))
        .select("*", F.col("__p.cell").alias("__cell"), F.col("__p.distance").alias("__r"))
        .drop("__p")
    )
    rings = placed.groupBy("__cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("__r").alias("near"), F.max("__r").alias("far")
    ).collect()  # one row per pivot
    cells = np.array([r["__cell"] for r in rings], dtype=np.int32)
    near = np.array([r["near"] for r in rings])
    far = np.array([r["far"] for r in rings])
    centres = pivots[cells]
    # Only a cell with k rows gives a k-th distance.
    homes = np.array([r["__cell"] for r in rings if r["n"] >= k], dtype=np.int32)
    if not len(homes):
        return None

    @arrow_udf("int")
    def home(x: pa.Array) -> pa.Array:
        return pa.array(homes[_closest(_matrix(x, width), pivots[homes])[0]])

    @arrow_udf("array<int>")
    def reach(x: pa.Array, bound: pa.Array, own: pa.Array) -> pa.Array:
        x, bound, own = _matrix(x, width), bound.to_numpy(zero_copy_only=False), own.to_numpy(zero_copy_only=False)
        counts, hits = [np.zeros(1, np.int64)], [np.empty(0, np.int32)]
        for s in _steps(len(x), len(cells)):
            square, wrong = _rough(x[s], centres)
            least = np.sqrt(np.maximum(square - wrong[:, None], 0.0))
            most = np.sqrt(np.maximum(square + wrong[:, None], 0.0))
            wide = bound[s, None] * (1 + 1e-9) + 1e-9 * (1 + most)
            hit = (least - far[None, :] <= wide) & (near[None, :] - most <= wide)
            hit &= cells[None, :] != own[s, None]
            counts.append(hit.sum(axis=1))
            hits.append(cells[np.nonzero(hit)[1]])
        ends = np.cumsum(np.concatenate(counts))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(hits)))

    return _Routes(placed.drop("__r"), {r["__cell"]: r["n"] for r in rings}, home, reach)


def _weight(weights: str):
    """Vote weight: one, or one over the distance; exact hits outvote everything else."""
    if weights == "uniform":
        return F.lit(1.0)
    hits = F.max((F.col("__d") == 0).cast("int")).over(Window.partitionBy("__q"))
    return F.when(hits == 1, (F.col("__d") == 0).cast("double")).otherwise(1.0 / F.col("__d"))


def vote_class(nearest: DataFrame, weights: str = "uniform") -> DataFrame:
    """The label with the largest vote (smallest label on ties) and its share."""
    ballots = nearest.withColumn("__w", _weight(weights)).groupBy("__q", "label").agg(
        F.sum("__w").alias("w")
    )
    best = F.max(F.struct(F.round("w", 12).alias("w"), (-F.col("label")).alias("l")))
    per_query = ballots.groupBy("__q").agg(
        best.alias("b"),
        F.sum("w").alias("t"),
        F.map_from_entries(F.collect_list(F.struct("label", "w"))).alias("m"),
    )
    return per_query.select(
        "__q",
        (-F.col("b.l")).alias("prediction"),
        (F.col("b.w") / F.col("t")).alias("confidence"),
        F.transform_values("m", lambda _, w: w / F.col("t")).alias("shares"),
    )


def vote_mean(nearest: DataFrame, weights: str = "uniform") -> DataFrame:
    """The weighted mean of the neighbours' labels."""
    weighted = nearest.withColumn("__w", _weight(weights))
    return weighted.groupBy("__q").agg(
        (F.sum(F.col("__w") * F.col("label")) / F.sum("__w")).alias("prediction")
    )
