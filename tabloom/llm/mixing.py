"""Mixing sources to target weights by iterative proportional fitting.

Token sums of the cells source x language x topic are raked until each marginal has its
target shares; a document is then expected so many times in the sample as its cell's
raked weight per token times the budget.  Where that is more than once its row is
repeated: the whole copies for certain, the fraction by a draw.  So the sample meets both
the targets and the budget, however rare a value is in the table.

The marginals are parameters, and a value they do not name falls into ``rest``, which
keeps the share it has.  The cells that reach the driver are therefore at most the
product of the marginals' lengths, whatever the corpus; they are checked against
``MAX_CELLS``.  Raking runs on that small array, counting and sampling on Spark.

Defined results: null sources and languages are ``rest``.  A null or empty text has no
tokens, is of topic ``prose`` and is sampled like its cell; a cell without tokens has
weight one.  Rows with equal ids and texts are drawn alike, others apart, also where an
id is null or very frequent.  Target shares of cells that do not
occur are spread over the others, with a warning.  Where the targets contradict each other
on a table (a source that is a language's only one, with another share), no weights reach
them and raking does not settle; rows are then drawn at most once, as many as the budget
asks for, and a warning tells the shares reached.  Columns of the input pass through
unchanged.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.sizing import cut_lineage
from tabloom.llm.pii import MARKS
from tabloom.llm.places import by_place

REST = "rest"
MAX_CELLS = 1_000_000
# Raking stops when no marginal is off by more, or after so many rounds.
TOLERANCE = 1e-9
ROUNDS = 1000
# Targets contradict each other if a share is still off by more after the last round.
UNSETTLED = 0.005
# Copies of a row that are numbered in one array.
COPIES_AT_ONCE = 4096
SEED = 42
# A text is code or a list if it has at least one of their signs in so many code points.
CODE_EVERY = 2000
LIST_EVERY = 2000

# What the registered query and the pipeline aim at: shares of tokens.
TARGETS: dict[str, dict[str, float]] = {
    "source": {"src0": 0.30, **{f"src{k}": 0.70 / 19 for k in range(1, 20)}},
    "lang": {"en": 0.58, "de": 0.15, "fr": 0.15, "es": 0.12},
    "topic": {"prose": 0.88, "contact": 0.08, "code": 0.02, "list": 0.02},
}
# Expected tokens of the sample as a share of all tokens.
BUDGET = 0.8


def tokens(text: str) -> Column:
    """Lexical tokens: runs of letters or digits, and single other signs."""
    return F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(r"[\p{L}\p{N}]++|[^\s\p{L}\p{N}]"))


def topic(text: str) -> Column:
    """A coarse topic by rules: contact data, code or secrets, lists, else prose.

    Any contact data make a text one of contact; code and lists need a share of their signs
    in the whole text, so that a few in a long text change nothing.  The marks that redaction leaves count as the contact data they stand for.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    # Plain searches for single signs cost far less than patterns over whole texts.
    has = lambda signs: reduce(or_, (F.contains(body, F.lit(s)) for s in signs))

    def often(signs: str, every: int) -> Column:
        found = F.length(body) - F.length(F.translate(body, signs, ""))
        return has(signs) & (found * every >= F.length(body))

    return (
        F.when(has("@") | (has("+") & body.rlike(r"\+[0-9]")) | (has("[") & has(MARKS)), "contact")
        .when(often("{};=", CODE_EVERY), "code")
        .when(often("|*#", LIST_EVERY), "list")
        .otherwise("prose")
    )


def _wanted(have: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The target shares of the values that occur, the others' spread over them."""
    want = np.where(have > 0, target, 0)
    return want / want.sum() if want.sum() > 0 else have


def _marginal(cells: np.ndarray, axis: int) -> np.ndarray:
    return cells.sum(axis=tuple(a for a in range(cells.ndim) if a != axis))


def rake(mass: np.ndarray, targets: list[np.ndarray]) -> np.ndarray:
    """Iterative proportional fitting of a dense array to shares along each axis."""
    fitted = mass / max(mass.sum(), 1e-300)
    for _ in range(ROUNDS):
        worst = 0.0
        for axis, target in enumerate(targets):
            have = _marginal(fitted, axis)
            want = _wanted(have, target)
            worst = max(worst, np.abs(have - want).max(initial=0))
            factor = np.divide(want, have, out=np.ones_like(want), where=have > 0)
            shape = [1] * mass.ndim
            shape[axis] = -1
            fitted = fitted * factor.reshape(shape)
        if worst <= TOLERANCE:
            break
    return fitted


def probabilities(mass: np.ndarray, weight: np.ndarray, budget: float) -> np.ndarray:
    """``min(1, s * weight)`` with ``s`` such that the expected tokens are the budget."""
    low, high = 0.0, 1.0
    total = mass.sum()
    while (mass * np.minimum(1, high * weight)).sum() < budget * total and high < 1e12:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        if (mass * np.minimum(1, mid * weight)).sum() < budget * total:
            low = mid
        else:
            high = mid
    return np.minimum(1, high * weight)


@dataclass
class Plan:
    """Expected copies of a row of each cell, in the order of the dimensions' values.

    ``goals`` are the target shares of each dimension's values, ``rest`` included.
    """

    values: dict[str, list[str]]
    mass: np.ndarray
    weight: np.ndarray
    copies: np.ndarray
    goals: list[np.ndarray]

    @property
    def probability(self) -> np.ndarray:
        """That a row is in the sample at all."""
        return np.minimum(1, self.copies)

    def reached(self) -> list[tuple[str, str, float, float, float]]:
        """``dimension, value, share of the table, target, expected share of the sample``."""
        out = []
        drawn = self.mass * self.copies
        for axis, (dimension, values) in enumerate(self.values.items()):
            before, after = (_marginal(m, axis) / max(m.sum(), 1e-300) for m in (self.mass, drawn))
            out += zip([dimension] * len(values), values, *(a.tolist() for a in (before, self.goals[axis], after)))
        return out


def plan(cells: list[tuple], targets: dict[str, dict[str, float]], budget: float = BUDGET) -> Plan:
    """Rake the cells ``(value per dimension..., tokens)``."""
    values = {d: [*shares, REST] for d, shares in targets.items()}
    mass = np.zeros([len(v) for v in values.values()])
    for *where, n in cells:
        mass[tuple(values[d].index(v) for d, v in zip(values, where))] += n
    total = max(mass.sum(), 1e-300)
    goals = []
    for axis, shares in enumerate(targets.values()):
        rest = _marginal(mass, axis)[-1] / total
        named = np.array([*shares.values()], float)
        goals.append(np.append(named / named.sum() * (1 - rest), rest))
    fitted = rake(mass, goals)
    weight = np.divide(fitted * total, mass, out=np.ones_like(mass), where=mass > 0)
    off = 0.0
    for axis, goal in enumerate(goals):
        have = _marginal(fitted, axis)
        off = max(off, np.abs(have - _wanted(have, goal)).max(initial=0))
    settled = off <= UNSETTLED
    made = Plan(values, mass, weight, budget * weight if settled else probabilities(mass, weight, budget), goals)
    if mass.sum() > 0:
        _warn(made, settled)
    return made


def _warn(made: Plan, settled: bool) -> None:
    """Tell which targets the table's tokens cannot reach."""
    shares = made.reached()
    absent = [f"{d} {v} ({goal:.3g})" for d, v, before, goal, _ in shares if goal > 0 and before == 0]
    if absent:
        warnings.warn(f"target shares of values without tokens are spread over the others: {', '.join(absent)}", stacklevel=3)
    if not settled:
        off = [f"{d} {v} {after:.3g} instead of {goal:.3g}" for d, v, _, goal, after in shares if abs(after - goal) > UNSETTLED]
        warnings.warn(f"the targets contradict each other on this table; reached: {', '.join(off)}", stacklevel=3)


def _cell(column: Column, named) -> Column:
    return F.when(column.isin(*named), column).otherwise(F.lit(REST))


def with_cells(
    docs: DataFrame, targets: dict[str, dict[str, float]], text: str, names: dict[str, str] | None = None
) -> DataFrame:
    """``docs`` with a struct column ``__cell`` of the dimensions' values.

    ``names`` tells the column of a dimension that is not called like it.
    """
    at = lambda d: topic(text) if d == "topic" else F.col((names or {}).get(d, d))
    return docs.withColumn("__cell", F.struct(*(_cell(at(d), shares).alias(d) for d, shares in targets.items())))


def fit(
    docs: DataFrame, targets: dict[str, dict[str, float]] = TARGETS, text: str = "text", budget: float = BUDGET
) -> Plan:
    """Count the cells' tokens on Spark and rake them."""
    return _fit_cells(with_cells(docs, targets, text).select("__cell", tokens(text).alias("__n")), targets, budget)


def _fit_cells(counted: DataFrame, targets: dict[str, dict[str, float]], budget: float) -> Plan:
    if np.prod([len(s) + 1 for s in targets.values()], dtype=float) > MAX_CELLS:
        raise ValueError(f"the marginals span more than {MAX_CELLS} cells")
    sums = counted.groupBy("__cell").agg(F.sum("__n").alias("n")).collect()
    return plan([(*r["__cell"], r["n"] or 0) for r in sums], targets, budget)


def draw(key: list[Column], seed: int = SEED) -> Column:
    """A number in [0, 1) that depends on the key alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 53)) / F.lit(float(1 << 53))


def marked(celled: DataFrame, mix: Plan) -> DataFrame:
    """Rows with ``__cell`` get ``__weight`` and the expected copies ``__p``; array literals hold the cells."""
    out = celled
    index = F.lit(0)
    for dimension, values in mix.values.items():
        place = F.array_position(F.array(*map(F.lit, values)), F.col(f"__cell.{dimension}")) - 1
        index = index * len(values) + place
    out = out.withColumn("__index", (index + 1).cast("int"))
    table = lambda a: F.array(*map(F.lit, a.ravel().tolist()))
    return out.withColumns(
        {
            "__weight": F.element_at(table(mix.weight), F.col("__index")),
            "__p": F.element_at(table(mix.copies), F.col("__index")),
        }
    ).drop("__index")


def repeated(rows: DataFrame, mix: Plan, key: list[Column], seed: int) -> DataFrame:
    """Each row with ``__p`` as often as it is sampled, ``__copy`` numbers its copies from one."""
    whole = F.floor("__p")
    n = (whole + (draw(key, seed) < F.col("__p") - whole).cast("long")).alias("n")
    rows = rows.withColumn("__copies", n).filter("__copies > 0")
    numbers = lambda first, last: F.explode(F.when(last >= first, F.sequence(first, last)))
    if mix.copies.max(initial=0) < COPIES_AT_ONCE:
        return rows.withColumn("__copy", numbers(F.lit(1).cast("long"), F.col("__copies"))).drop("__copies")
    # A row with very many copies: blocks of numbers first, so that no array is long.
    size = F.lit(COPIES_AT_ONCE).cast("long")
    rows = rows.withColumn("__block", numbers(F.lit(0).cast("long"), F.floor((F.col("__copies") - 1) / size)))
    first = F.col("__block") * size + 1
    last = F.least(first + size - 1, F.col("__copies"))
    return rows.withColumn("__copy", numbers(first, last)).drop("__copies", "__block")


def sampled(
    docs: DataFrame,
    targets: dict[str, dict[str, float]] = TARGETS,
    doc_id: str = "doc_id",
    text: str = "text",
    budget: float = BUDGET,
    seed: int = SEED,
) -> DataFrame:
    """The sampled rows of ``docs``, repeated where their cell needs it, columns unchanged."""
    rows, (key, body, *places) = by_place(docs, doc_id, text, *targets)
    celled = with_cells(rows, targets, body, dict(zip(targets, places)))
    mix = _fit_cells(celled.select("__cell", tokens(body).alias("__n")), targets, budget)
    out = repeated(marked(celled, mix), mix, [F.col(key), F.xxhash64(F.col(body).cast("string"))], seed)
    return out.drop("__cell", "__weight", "__p", "__copy").toDF(*docs.columns)


def report(docs: DataFrame, targets=TARGETS, doc_id: str = "doc_id", text: str = "text", budget=BUDGET, seed=SEED):
    """``doc_id, source, lang, topic, n_tokens, weight, probability, expected_copies, copy`` of the sampled rows.

    A row that is sampled repeatedly is there once per copy.  The texts are read once: ids, cells and counts are kept in a checkpoint.
    """
    rows, (key, body, *places) = by_place(docs, doc_id, text, *targets)
    counted = cut_lineage(
        with_cells(rows, targets, body, dict(zip(targets, places))).select(
            F.col(key).alias("__id"), F.xxhash64(F.col(body).cast("string")).alias("__text"), "__cell", tokens(body).cast("long").alias("__n")
        )
    )
    mix = _fit_cells(counted, targets, budget)
    out = repeated(marked(counted, mix), mix, [F.col("__id"), F.col("__text")], seed)
    return out.select(
        F.col("__id").alias("doc_id"),
        *(F.col(f"__cell.{d}").alias(d) for d in targets),
        F.col("__n").alias("n_tokens"),
        F.col("__weight").alias("weight"),
        F.least(F.lit(1.0), F.col("__p")).alias("probability"),
        F.col("__p").alias("expected_copies"),
        F.col("__copy").alias("copy"),
    )


def reached(report_rows: DataFrame, dimensions=tuple(TARGETS)) -> DataFrame:
    """``dimension, value, n_tokens, share``: what the rows of a report hold."""
    pairs = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dimensions)))
    sums = report_rows.select(pairs.alias("v"), "n_tokens").groupBy("v").agg(F.sum("n_tokens").alias("n_tokens"))
    whole = sums.groupBy("v.dimension").agg(F.sum("n_tokens").alias("whole"))
    return sums.select("v.*", "n_tokens").join(whole, "dimension").select(
        "dimension", "value", "n_tokens", (F.col("n_tokens") / F.col("whole")).alias("share")
    )
