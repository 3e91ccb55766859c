"""Toxicity from a weighted lexicon that an Aho-Corasick automaton finds in folded texts.

Folding lower-cases, takes letters to their base form, look-alike letters of other
alphabets to Latin ones and digits or signs inside words to the letters they stand for;
everything else is a blank.  Lexicon entries are whole words and beginnings of words,
weighted by the log odds of documents that hold them being toxic.  Exceptions are words
that begin like an entry and pairs of words around an entry that clean documents hold as
often; an entry inside a found exception does not count.  At each word the longest entry
counts.  The summed weight is normalised by the number of words, and a logistic curve
over it gives the score.

The lexicon is counted on Spark over at most ``LEARN_ROWS`` labelled documents, taken by
a hash of their id.  The curve is fitted on sums from a lexicon that has not seen the
document: one half of them is weighed by what the other half teaches.

Defined results: an empty or null text has no words, its score is that of a text without
findings.  A null id belongs to no fold: not held out, not learned from.  Where the
labels of an id differ it counts as toxic; null labels are left out.  Rows that repeat an
id teach once, with the smallest of their texts.  Without labels of both kinds every
score is 0.  Repeated rows are scored alike; other columns are ignored, an empty table
gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tabloom.functions.sizing import shared_folder
from tabloom.llm.ship import ship

FOLDS = 3
HELD_OUT = 1
TOXIC_FROM = 0.7
# Labelled documents that are learned from at most, and entries of a lexicon.
LEARN_ROWS = 100_000
MAX_ENTRIES = 20_000
# Letters of a word's beginning that can be an entry.
STEMS = range(4, 9)
# An entry needs so many toxic documents, odds (log) and odds in standard deviations; an
# exception so many clean documents and odds below the second.
MIN_DOCS = 5
MIN_ODDS = 2.0
MIN_SIGMAS = 3.5
MAX_WEIGHT = 6.0
EXCEPTION_DOCS = 3
EXCEPTION_ODDS = 1.0
# Words added to a text's length, so that one finding in a short text is not all of it.
EXTRA_WORDS = 15
# Distinct patterns that a task counts before it hands them on.
HELD_PATTERNS = 300_000

# Look-alikes of Latin letters in the Cyrillic and Greek alphabets, and
# what digits and signs inside words stand for.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "һ": "h", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o",
    "р": "p", "с": "c", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ь": "b", "ӏ": "l",
    "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
    "υ": "u", "χ": "x", "ω": "w",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}

_LOOK = str.maketrans(LOOK_ALIKES)
_SIGN_BYTES = bytes.maketrans("".join(SIGNS).encode(), "".join(SIGNS.values()).encode())
_LETTER = rb"a-z\x80-\xff"
_KEPT = bytes(b if b >= 128 or 97 <= b <= 122 or b in b"0134578@$!" else 32 for b in range(256))
_LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
# Combining marks, soft hyphens and invisible signs vanish, other non-letters part words.
_VANISH = re.compile(rb"\xcc[\x80-\xbf]|\xcd[\x80-\xaf]|\xc2\xad|\xe2\x80[\x8b-\x8f]|\xe2\x81\xa0|\xef\xbb\xbf")
_PART = re.compile(rb"\xc2[\x80-\xbf]|\xc3[\x97\xb7]|\xe2[\x80-\xaf][\x80-\xbf]|\xe3\x80[\x80-\xbf]")
_OTHER_ALPHABET = re.compile(rb"[\xcd-\xd4]")
_SIGN_RUN = re.compile(
    rb"(?<=[" + _LETTER + rb"])[0134578@$!]+(?=[" + _LETTER + rb"])|(?<![\S])[013457@]+(?=[" + _LETTER + rb"])"
)


def fold(text: str | None) -> str:
    """The words of a text in folded letters, a blank between them and at both ends."""
    if not text:
        return " "
    low = text.lower()
    raw = low.encode()
    if not low.isascii():
        raw = _VANISH.sub(b"", unicodedata.normalize("NFKD", low).encode())
        if _OTHER_ALPHABET.search(raw):
            raw = raw.decode().translate(_LOOK).encode()
        raw = _PART.sub(b" ", raw)
    raw = _SIGN_RUN.sub(lambda m: m.group().translate(_SIGN_BYTES), raw.translate(_KEPT))
    words = raw.translate(_LETTERS).split()
    return " " + b" ".join(words).decode() + " " if words else " "


def _patterns(words: Iterable[str]) -> set[str]:
    """Whole words and their beginnings, as entries of a lexicon."""
    out = set()
    for word in words:
        out.add(f" {word} ")
        out.update(f" {word[:k]}" for k in STEMS if k <= len(word))
    return out


@dataclass
class Lexicon:
    """Weights of entries, and exceptions that make the entries inside them void."""

    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        self._automaton = ahocorasick.Automaton()
        for pattern, weight in self.weights.items():
            self._automaton.add_word(pattern, (len(pattern), weight))
        for pattern in self.exceptions:
            self._automaton.add_word(pattern, (len(pattern), None))
        if len(self._automaton):
            self._automaton.make_automaton()

    def __getstate__(self):
        return self.weights, self.exceptions

    def __setstate__(self, state) -> None:
        self.weights, self.exceptions = state
        self.__post_init__()

    def found(self, folded: str) -> dict[int, tuple[int, float]]:
        """Length and weight of the entry that counts at each word, by the word's place."""
        hits: dict[int, tuple[int, float]] = {}
        void: list[tuple[int, int]] = []
        if not len(self._automaton):
            return hits
        for end, (length, weight) in self._automaton.iter(folded):
            start = end - length + 1
            if weight is None:
                void.append((start, end))
            elif start not in hits or hits[start][0] < length:
                hits[start] = (length, weight)
        for s, e in void:
            for start in [k for k in hits if s <= k and k + hits[k][0] - 1 <= e]:
                del hits[start]
        return hits

    def measures(self, folded: str) -> tuple[float, float, float]:
        """Normalised weight, and logarithms of weight and length."""
        total = sum(w for _, w in self.found(folded).values())
        words = folded.count(" ") - 1
        return (total / (words + EXTRA_WORDS)) ** 0.5, float(np.log1p(total)), float(np.log1p(words))


@dataclass
class Model:
    lexicon: Lexicon
    curve: np.ndarray

    def scores(self, texts: list[str | None]) -> np.ndarray:
        rows = np.array([(1.0, *self.lexicon.measures(fold(t))) for t in texts]).reshape(-1, 4)
        return 1 / (1 + np.exp(-np.clip(rows @ self.curve, -30, 30)))


def odds(toxic, clean, all_toxic: int, all_clean: int):
    """Log odds of holding a pattern, toxic against clean, and the same in deviations.

    The document counts are columns.
    """
    lo = F.log((toxic + 0.1) / (all_toxic - toxic + 0.1)) - F.log((clean + 0.1) / (all_clean - clean + 0.1))
    return lo, lo / F.sqrt(1 / (toxic + 0.1) + 1 / (clean + 0.5))


def logistic(rows: np.ndarray, toxic: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Coefficients of a logistic curve by Newton's method."""
    b = np.zeros(rows.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(rows @ b, -30, 30)))
        bend = rows.T @ (rows * (p * (1 - p))[:, None]) + ridge * np.eye(len(b))
        step = np.linalg.solve(bend, rows.T @ (toxic - p) - ridge * b)
        b = b + step
        if np.abs(step).max() < 1e-9:
            break
    return b


def fold_of(doc_id: str):
    return F.crc32(F.col(doc_id).cast("string")) % FOLDS


def _counted(learn: DataFrame, patterns) -> DataFrame:
    """``half, pattern, toxic, clean``: documents of either kind that hold a pattern."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], Counter] = {}

        def emptied() -> Iterator[pa.RecordBatch]:
            for (half, toxic), counts in held.items():
                names = list(counts)
                n = np.fromiter(counts.values(), np.int64, len(counts))
                for at in range(0, len(names), 100_000):
                    part = n[at : at + 100_000]
                    yield pa.record_batch(
                        {
                            "half": pa.array(np.full(len(part), half, np.int32)),
                            "pattern": pa.array(names[at : at + 100_000], pa.string()),
                            "toxic": pa.array(part if toxic else part * 0),
                            "clean": pa.array(part * 0 if toxic else part),
                        }
                    )
            held.clear()

        for batch in batches:
            for half, toxic, text in zip(*(batch[c].to_pylist() for c in ("half", "toxic", "text"))):
                held.setdefault((half, toxic), Counter()).update(patterns(half, fold(text)))
                if sum(map(len, held.values())) >= HELD_PATTERNS:
                    yield from emptied()
        yield from emptied()

    return (
        learn.mapInArrow(count, "half int, pattern string, toxic long, clean long")
        .groupBy("half", "pattern")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    )


def _written(df: DataFrame) -> DataFrame:
    folder = shared_folder(df.sparkSession, "toxicity")
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    learn_rows: int = LEARN_ROWS,
    exceptions: Iterable[str] = (),
) -> Model | None:
    """Learn from labelled documents outside the held-out fold (see the module).

    ``exceptions`` are further phrases that make the entries inside them void.
    """
    ship(docs.sparkSession)
    known = (
        labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold_of("doc_id") != HELD_OUT))
        .groupBy(F.col("doc_id").alias("__id"))
        .agg(F.max(F.col(label).cast("int")).alias("toxic"))
        .withColumn("h", F.xxhash64("__id"))
        .orderBy("h", "__id")
        .limit(learn_rows)
    )
    known = known.select("__id", "toxic", F.pmod("h", F.lit(2)).cast("int").alias("half"))
    texts = docs.select(F.col(doc_id).alias("__id"), F.col(text).cast("string").alias("text"))
    # The labels are at most ``learn_rows`` rows of three numbers.
    learn = _written(texts.join(F.broadcast(known), "__id"))
    ids = learn.agg(F.count("*").alias("rows"), F.count_distinct("__id").alias("ids")).first()
    if ids["rows"] > ids["ids"]:
        learn = _written(learn.groupBy("__id", "half", "toxic").agg(F.min("text").alias("text")))
    sizes = {(r["half"], r["toxic"]): r["n"] for r in learn.groupBy("half", "toxic").agg(F.count("*").alias("n")).collect()}
    toxic = [sizes.get((h, 1), 0) for h in (0, 1)]
    clean = [sizes.get((h, 0), 0) for h in (0, 1)]
    if not sum(toxic) or not sum(clean):
        return None

    counted = _written(_counted(learn, lambda half, folded: _patterns(set(folded.split()))))
    both = counted.groupBy("pattern").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    whole = _lexicon(both, sum(toxic), sum(clean))
    halves = [_lexicon(counted.filter(F.col("half") == h), toxic[h], clean[h]) for h in (0, 1)]
    lexicons = [halves[1], halves[0], whole]

    def pairs(half: int, folded: str) -> set[str]:
        """The found words with the word before or after them."""
        out = set()
        for start in whole.found(folded):
            end = folded.index(" ", start + 1)
            before = folded.rfind(" ", 0, start)
            after = folded.find(" ", end + 1)
            if before >= 0:
                out.add(folded[before : end + 1])
            if after >= 0:
                out.add(folded[start : after + 1])
        return out

    around = _counted(learn, pairs).groupBy("pattern").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    lo, _ = odds(F.col("toxic"), F.col("clean"), sum(toxic), sum(clean))
    harmless = around.filter((F.col("clean") >= EXCEPTION_DOCS) & (lo < EXCEPTION_ODDS))
    phrases = [r["pattern"] for r in harmless.orderBy(F.desc("clean"), "pattern").limit(MAX_ENTRIES).collect()]
    phrases += [f for f in (fold(e) for e in exceptions) if len(f) > 1]
    lexicons = [Lexicon(x.weights, sorted({*x.exceptions, *phrases} - x.weights.keys())) for x in lexicons]

    @arrow_udf("array<double>")
    def unseen(half: pa.Array, text: pa.Array) -> pa.Array:
        pairs = zip(half.to_pylist(), text.to_pylist())
        return pa.array([lexicons[h].measures(fold(t)) for h, t in pairs], pa.list_(pa.float64()))

    table = learn.select("toxic", unseen("half", "text").alias("m")).toArrow()
    measured = np.array(table["m"].to_pylist()).reshape(-1, 3)
    curve = logistic(np.hstack([np.ones((len(measured), 1)), measured]), table["toxic"].to_numpy().astype(float))
    return Model(lexicons[2], curve)


def _lexicon(counted: DataFrame, all_toxic: int, all_clean: int) -> Lexicon:
    """The lexicon of counted patterns; only what it may hold reaches the driver."""
    lo, sigmas = odds(F.col("toxic"), F.col("clean"), all_toxic, all_clean)
    sure = (F.col("toxic") >= MIN_DOCS) & (lo >= MIN_ODDS) & (sigmas >= MIN_SIGMAS)
    entries = counted.filter(sure).orderBy(sigmas.desc(), "pattern").limit(MAX_ENTRIES)
    weights = {r["pattern"]: min(r["odds"], MAX_WEIGHT) for r in entries.select("pattern", lo.alias("odds")).collect()}
    stems = [(p,) for p in weights if not p.endswith(" ")]
    if not stems:
        return Lexicon(weights)
    begins = F.broadcast(counted.sparkSession.createDataFrame(stems, "stem string"))
    words = counted.filter(
        F.col("pattern").endswith(" ") & (F.col("clean") >= EXCEPTION_DOCS) & (lo < EXCEPTION_ODDS)
    )
    # The beginnings of each word, with the blank before it.
    held = F.filter(F.array(*[F.lit(k) for k in STEMS]), lambda k: k <= F.length("pattern") - 2)
    spread = words.select("pattern", "clean", F.explode(held).alias("k")).withColumn(
        "stem", F.expr("substring(pattern, 1, k + 1)")
    )
    found = (
        spread.join(begins, "stem", "left_semi")
        .select("pattern", "clean")
        .distinct()
        .orderBy(F.desc("clean"), "pattern")
        .limit(MAX_ENTRIES)
    )
    return Lexicon(weights, sorted({r["pattern"] for r in found.collect()} - weights.keys()))


def scores(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row."""
    plain = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(fold_of(doc_id) == HELD_OUT, F.lit(False)).alias("held_out"),
        F.col(text).cast("string").alias("text"),
    )
    if model is None:
        return plain.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    ship(docs.sparkSession)

    @arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(model.scores(batch.to_pylist()))

    told = plain.withColumn("score", score("text"))
    return told.select(
        "doc_id", "held_out", "score", F.when(F.col("score") >= TOXIC_FROM, 1).otherwise(0).alias("predicted")
    )
