"""Linear support vectors: classifiers of all class pairs and regression, to a known gap.

Minimises ``|w|²/2 + C·Σ loss`` with a free intercept, the loss being ``max(0, 1 − s f)``
for a pair's classes or ``max(0, |y − f| − ε)``.  The kinks of the loss are rounded over
a width that shrinks from round to round; each round is one pass, in which a task adds up
the losses, gradient and curvature of its rows for all pairs at once, and one damped
Newton step on the driver.  Rows keep no state between rounds, so a lost executor costs
its rows' sums of one round only.  The rounded loss also gives every row its dual weight;
scaled so that both sides balance they are a feasible dual point, whose value bounds the
least possible objective from below.  A fit ends when that gap is small enough.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.storagelevel import StorageLevel

from .models import read_json, write_json

# Fixed value: half-width of the tube without loss.
EPSILON = 0.1
# Relative gap at which a fit ends, and the rounds after which it ends anyway.
GAP = 1e-5
MAX_ROUNDS = 200
# Factor by which the rounding of the kinks shrinks, and the shorter steps that a pass
# looks at beside the whole one.
SHRINK = 0.5
SHORTER = 0.4 ** np.arange(1, 16)
# Share of the rounding's own gap below which a step is not worth a round.
SETTLED = 0.01
# Weight in the curvature of rows just outside the rounded kink.
NEAR = 0.02
# Numbers that one round may bring to the driver; more pairs are fitted in turns.
ROUND_NUMBERS = 2_000_000
# Numbers of all rows up to which one task fits alone (8 MB), as rounds would cost more.
TASK_NUMBERS = 1_000_000
# Rows a task should have, the most it gets, and tasks for each core in between.
ROWS_PER_TASK = 50_000
MOST_ROWS = 250_000
TASKS_PER_CORE = 4
# Numbers of one block of rows.
BLOCK = 500_000


@dataclass
class Line:
    """One ``f = w x + b`` while it is fitted (the last of ``w`` is the intercept).

    ``pair`` holds the classes below and above zero, or nothing for regression.
    """

    pair: tuple[int, int] | None
    width: int
    w: np.ndarray
    rounding: float
    tried: np.ndarray = field(init=False)
    step: np.ndarray | None = None
    value: float = np.inf
    objective: float = np.inf
    bound: float = -np.inf
    best: np.ndarray = field(init=False)
    rounds: int = 0
    done: bool = False

    def __post_init__(self) -> None:
        self.tried, self.best = self.w, self.w

    @property
    def gap(self) -> float:
        return (self.objective - self.bound) / max(abs(self.objective), 1e-12)

    @staticmethod
    def size(width: int) -> int:
        return 7 + 2 * width + (width + 1) ** 2 + len(SHORTER)

    def take(self, sums: np.ndarray, C: float, gap: float) -> None:
        """Judge the tried point by its sums and choose the next one."""
        d = self.width
        rounded, loss, n_up, n_down, gain_up, gain_down, squares = map(float, sums[:7])
        up, down = sums[7 : 7 + d], sums[7 + d : 7 + 2 * d]
        self.rounds += 1
        norm = 0.5 * float(self.tried[:d] @ self.tried[:d])
        if norm + C * loss < self.objective:
            self.objective, self.best = norm + C * loss, self.tried
        # The dual weights of both sides must have the same sum.
        even = min(n_up, n_down)
        a, b = (even / n_up if n_up else 0.0), (even / n_down if n_down else 0.0)
        pull = C * (a * up - b * down)
        self.bound = max(self.bound, C * (a * gain_up + b * gain_down) - 0.5 * float(pull @ pull))
        if self.gap <= gap:
            self.done = True
            return
        value = norm + C * rounded
        if self.step is not None and value > self.value:
            # The whole step leads too far: on to the best of the shorter ones.
            values = [
                0.5 * float(w[:d] @ w[:d]) + C * r
                for w, r in zip(self.w + SHORTER[:, None] * self.step, sums[-len(SHORTER) :])
            ]
            k = int(np.argmin(values))
            if values[k] < self.value:
                self.tried, self.step = self.w + SHORTER[k] * self.step, None
                return
            # Nothing better at this rounding.
            self._round_less()
            return
        self.value, self.w = value, self.tried
        gradient = np.append(self.tried[:d] - C * (up - down), -C * (n_up - n_down))
        curvature = C / self.rounding * sums[7 + 2 * d : -len(SHORTER)].reshape(d + 1, d + 1)
        curvature[np.arange(d), np.arange(d)] += 1.0
        # Features of any scale count alike in the system's rounding errors.
        scale = 1 / np.sqrt(np.maximum(np.diag(curvature), 1e-12))
        system = curvature * scale[:, None] * scale + 1e-13 * np.eye(d + 1)
        self.step = -scale * np.linalg.solve(system, gradient * scale)
        # The gap that the least rounded objective has because of the rounding.
        owed = C * (loss - rounded - 0.5 * self.rounding * squares)
        if -float(gradient @ self.step) / 2 <= SETTLED * owed:
            self._round_less()
        self.tried = self.w + (0 if self.step is None else self.step)

    def _round_less(self) -> None:
        self.rounding = max(self.rounding * SHRINK, 1e-14)
        self.value, self.tried, self.step = np.inf, self.w, None


def line_sums(line: Line, x: np.ndarray, y: np.ndarray, weight: np.ndarray, epsilon: float) -> np.ndarray:
    """The sums of :meth:`Line.take` over some rows ``[x, 1]``."""
    out = np.zeros(Line.size(line.width))
    if line.pair:
        sides = [(x[y == c], None, weight[y == c]) for c in line.pair]
        parts = [(k, xs, 1.0 + (1 if k == 0 else -1) * (xs @ line.tried), np.ones(len(xs)), ws) for k, (xs, _, ws) in enumerate(sides)]
    else:
        e = y - x @ line.tried
        parts = [(0, x, -e - epsilon, -(y + epsilon), weight), (1, x, e - epsilon, y - epsilon, weight)]
    d = line.width
    back = np.zeros(d + 1) if line.step is None else line.step
    for k, xs, z, gain, ws in parts:
        a = np.clip(z / line.rounding, 0.0, 1.0)
        out[0] += float(ws @ (a * (z - 0.5 * line.rounding * a)))
        if line.step is not None:
            # Excesses are linear in the step; the sign is that of the side.
            turn = (1.0 if k == 0 else -1.0) * (xs @ back)
            for place, part in enumerate(SHORTER):
                shorter = z - (1.0 - part) * turn
                b = np.clip(shorter / line.rounding, 0.0, 1.0)
                out[len(out) - len(SHORTER) + place] += float(ws @ (b * (shorter - 0.5 * line.rounding * b)))
        out[1] += float(ws @ np.maximum(z, 0.0))
        out[6] += float(ws @ (a * a))
        a = a * ws
        out[3 - k] += a.sum()
        out[5 - k] += a @ gain
        out[7 + (1 - k) * d : 7 + (2 - k) * d] += a @ xs[:, :d]
        zone = (z > -line.rounding) & (z < 2 * line.rounding)
        if zone.any():
            inside, bend = xs[zone], ws[zone] * np.where((z[zone] > 0) & (z[zone] < line.rounding), 1.0, NEAR)
            out[7 + 2 * d : -len(SHORTER)] += (inside.T @ (inside * bend[:, None])).ravel()
    return out


def solve(lines: list[Line], sums_of: Callable[[list[Line]], np.ndarray], C: float, gap: float, max_rounds: int) -> None:
    """Rounds over all lines together until each has its gap or no rounds are left."""
    for _ in range(max_rounds):
        open_lines = [line for line in lines if not line.done]
        if not open_lines:
            return
        for line, sums in zip(open_lines, sums_of(open_lines)):
            line.take(sums, C, gap)


# --- on Spark -----------------------------------------------------------------------


def _packed(rows: DataFrame, width: int, labelled: bool) -> DataFrame:
    """Rows ``[x, 1]``, ``y`` and ``n`` in blocks of plain bytes, which every round reads
    without looking at single values; ``labels`` has the labels of a block if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, BLOCK // (width + 1))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                x = part["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                y, n = (part[c].to_numpy(zero_copy_only=False).astype(np.float64) for c in ("y", "n"))
                held = {c: pa.array([v.tobytes()], pa.binary()) for c, v in (("x", np.insert(x, width, 1.0, axis=1)), ("y", y), ("n", n))}
                labels = np.unique(y).tolist() if labelled else []
                yield pa.record_batch({**held, "labels": pa.array([labels], pa.list_(pa.float64()))})

    return rows.mapInArrow(run, "x binary, y binary, n binary, labels array<double>")


def _arrays(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for block in zip(*(batch[c] for c in ("x", "y", "n"))):
            x, y, n = (np.frombuffer(c.as_buffer(), np.float64) for c in block)
            yield x.reshape(-1, width + 1), y, n


def _partition_sums(lines: list[Line], epsilon: float):
    width = lines[0].width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(lines), Line.size(width)))
        for x, y, weight in _arrays(batches, width):
            for k, line in enumerate(lines):
                total[k] += line_sums(line, x, y, weight, epsilon)
        yield pa.record_batch({"sums": pa.array([total.ravel()], pa.list_(pa.float64()))})

    return run


def _prepared(train: DataFrame, labelled: bool = False) -> tuple[DataFrame, bool, int, float, float]:
    """Blocks of rows spread over tasks, equal ones once, whether they fit in one task,
    and their width, mean and deviation."""
    rows = train.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y"))
    facts = rows.agg(
        F.count("*").alias("n"),
        F.approx_count_distinct(F.xxhash64("x", "y")).alias("kinds"),
        F.max(F.size("x")).alias("width"),
        F.avg("y").alias("mean"),
        F.stddev_pop("y").alias("std"),
    ).first()
    if not facts["n"] or not facts["width"]:
        raise ValueError("no rows or no features to fit")
    grouped = 4 * facts["kinds"] < facts["n"]
    rows = rows.groupBy("x", "y").agg(F.count("*").alias("n")) if grouped else rows.withColumn("n", F.lit(1).cast("long"))
    # The number of kinds is an estimate, a few hundredths off.
    size = min(facts["n"], 2 * facts["kinds"]) if grouped else facts["n"]
    alone = size * (facts["width"] + 1) <= TASK_NUMBERS
    if alone:
        rows = rows.coalesce(1) if grouped else rows.repartition(1)
    rows = _packed(rows, facts["width"], labelled)
    if not alone:
        cores = train.sparkSession.sparkContext.defaultParallelism
        rows = rows.repartition(max(-(-size // MOST_ROWS), min(TASKS_PER_CORE * cores, -(-size // ROWS_PER_TASK))))
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    return rows, alone, facts["width"], facts["mean"], facts["std"] or 0.0


def _fitted(
    rows: DataFrame, in_task: bool, lines: list[Line], C: float, epsilon: float, gap: float, max_rounds: int
) -> None:
    """Fit the lines in rounds over all tasks, or wholly in one task that all rows fit in."""

    def sums_of(part: list[Line]) -> np.ndarray:
        sums = rows.mapInArrow(_partition_sums(part, epsilon), "sums array<double>")
        total = sums.agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("t")).first()["t"]
        return np.array(total).reshape(len(part), -1)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y, weight = (np.concatenate(c) for c in zip(*_arrays(batches, lines[0].width)))
        for line in lines:
            solve([line], lambda _: [line_sums(line, x, y, weight, epsilon)], C, gap, max_rounds)
        yield pa.record_batch(
            {
                "k": pa.array(range(len(lines)), pa.int32()),
                "w": pa.array([line.best.tolist() for line in lines], pa.list_(pa.float64())),
                "objective": [line.objective for line in lines],
                "bound": [line.bound for line in lines],
                "rounds": pa.array([line.rounds for line in lines], pa.int32()),
            }
        )

    if in_task:
        kind = "k int, w array<double>, objective double, bound double, rounds int"
        for r in rows.mapInArrow(alone, kind).collect():
            line = lines[r["k"]]
            line.best, line.objective, line.bound, line.rounds = np.array(r["w"]), r["objective"], r["bound"], r["rounds"]
        return
    together = max(1, ROUND_NUMBERS // Line.size(lines[0].width))
    for at in range(0, len(lines), together):
        solve(lines[at : at + together], sums_of, C, gap, max_rounds)


@dataclass
class LinearSVC:
    """Classifiers of all class pairs; each votes, equal votes go to the lower class.

    ``gap`` is the largest relative duality gap, ``rounds`` the most rounds of a pair.
    """

    pairs: list[tuple[int, int]]
    weights: np.ndarray
    classes: int
    gap: float
    rounds: int
    name: str = "svm"

    def predict(self, df: DataFrame) -> DataFrame:
        pairs, weights, classes = np.array(self.pairs).reshape(-1, 2), self.weights, self.classes

        @arrow_udf("double")
        def elected(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for column in columns:
                x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
                votes = np.zeros((len(x), max(classes, 1)), np.int32)
                if len(pairs):
                    above = x @ weights[:, :-1].T + weights[:, -1] > 0
                    for k, (low, high) in enumerate(pairs):
                        votes[np.arange(len(x)), np.where(above[:, k], high, low)] += 1
                yield pa.array(votes.argmax(axis=1).astype(np.float64))

        return df.withColumn("prediction", elected(vector_to_array("features")))

    def importance(self) -> None:
        return None

    def save(self, path: str) -> None:
        record = {"pairs": self.pairs, "weights": self.weights.tolist(), "classes": self.classes}
        write_json(SparkSession.active(), {**record, "gap": self.gap, "rounds": self.rounds}, path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> LinearSVC:
        r = read_json(spark, path)
        pairs = [tuple(p) for p in r["pairs"]]
        return LinearSVC(pairs, np.array(r["weights"]), r["classes"], r["gap"], r["rounds"])


def fit_svc(
    train: DataFrame, C: float = 1.0, classes: int = 2, gap: float = GAP, max_rounds: int = MAX_ROUNDS
) -> LinearSVC:
    """Fit on ``features``/``label``; labels are 0 to ``classes`` - 1."""
    rows, alone, width, _, _ = _prepared(train, labelled=True)
    try:
        seen = sorted(int(r[0]) for r in rows.select(F.explode("labels")).distinct().collect())
        pairs = list(combinations(seen, 2))
        if not pairs:
            # A single class is all there is to predict.
            lone = [(seen[0], seen[0])]
            return LinearSVC(lone, np.zeros((1, width + 1)), max(classes, seen[0] + 1), 0.0, 0)
        lines = [Line(p, width, np.zeros(width + 1), 2.0) for p in pairs]
        _fitted(rows, alone, lines, C, 0.0, gap, max_rounds)
    finally:
        rows.unpersist()
    weights = np.array([line.best for line in lines])
    return LinearSVC(pairs, weights, max(classes, seen[-1] + 1), max(x.gap for x in lines), max(x.rounds for x in lines))


@dataclass
class LinearSVR:
    """A fitted line with its objective, relative duality gap and rounds."""

    coefficients: np.ndarray
    intercept: float
    objective: float
    rounds: int
    gap: float | None = None
    name: str = "svr"

    def predict(self, df: DataFrame) -> DataFrame:
        w = F.array(*[F.lit(float(c)) for c in self.coefficients])
        products = F.zip_with(vector_to_array("features"), w, lambda a, b: a * b)
        dot = F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)
        return df.withColumn("prediction", dot + F.lit(self.intercept))

    def importance(self) -> list[float]:
        return [float(c) for c in self.coefficients]

    def linear_terms(self) -> tuple[list[float], float]:
        return self.importance(), self.intercept

    def save(self, path: str) -> None:
        record = {"coefficients": self.importance(), "intercept": self.intercept, "objective": self.objective}
        write_json(SparkSession.active(), {**record, "rounds": self.rounds, "gap": self.gap}, path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> LinearSVR:
        r = read_json(spark, path)
        return LinearSVR(np.array(r["coefficients"]), r["intercept"], r["objective"], r["rounds"], r.get("gap"))


def fit_svr(
    train: DataFrame, C: float = 1.0, epsilon: float = EPSILON, gap: float = GAP, max_rounds: int = MAX_ROUNDS
) -> LinearSVR:
    """Fit on ``features``/``label``; a round brings a matrix of features² numbers."""
    rows, alone, width, mean, std = _prepared(train)
    try:
        line = Line(None, width, np.append(np.zeros(width), mean), max(2 * std, 1e-9))
        _fitted(rows, alone, [line], C, epsilon, gap, max_rounds)
    finally:
        rows.unpersist()
    return LinearSVR(line.best[:-1], float(line.best[-1]), line.objective, line.rounds, line.gap)
