"""Language identification with error-correcting output codes.

Every language has a codeword of +1 and -1.  For each bit a binary n-gram classifier
(log odds of hashed byte 2- and 3-grams, each side the mean of its languages) gives a
margin.  Decoding adds the logistic loss of every codeword's bits, each bit weighted by
how well its classifier did on documents it was not fitted on, takes the codeword of
least loss, and flags the text as ambiguous where the runner-up is close.

Counts come from every learning document and are weighed into the bits' two sides on
Spark; only ``buckets x bits`` sums reach the driver, and bits grow with the logarithm of
the languages, of which there is no fixed bound.  A language is learned from non-null ``lang`` of documents outside the held-out
fold; ids choose the fold and are no input of a prediction.

Defined results: a null text or one without a letter is ``und`` with score 0, also when
nothing could be learned.  A null id belongs to no fold: not held out, not learned from.
Equal losses go to the language that sorts first.  Repeated rows count as often as they
occur.  Other columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tabloom.functions.sizing import shared_folder
from tabloom.llm.ship import ship

# Hash buckets of the n-grams.
BUCKETS = 1 << 14
FOLDS = 5
UNKNOWN = "und"
# Best codeword's share of the likelihood below which a text is ambiguous.
AMBIGUOUS = 0.75
# Bytes that are turned into n-grams at once.
BYTES_AT_ONCE = 1_000_000

_OTHER = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def grams(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 2-grams and 3-grams that begin at each byte (but the last)."""
    x = raw.astype(np.uint32)
    two = (x[:-1] << np.uint32(8)) | x[1:]
    three = (two[:-1] << np.uint32(8)) | x[2:]
    mix = np.uint32(2654435769)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    return (two * mix) >> shift, ((three ^ np.uint32(0x5BD1E995)) * mix) >> shift


def _grams_by_text(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets and the numbers of their texts, a bounded piece of bytes at a time.

    Each text has a space on either side.  A piece that goes on with a long text begins
    two bytes back and leaves out the 2-gram that its predecessor had already.
    """
    held: list[bytes] = []
    owner: list[int] = []
    size = 0
    goes_on = False

    def cut() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        raw = np.frombuffer(b"".join(held), np.uint8)
        of = np.repeat(owner, [*map(len, held)])
        for width, bucket in zip((2, 3), grams(raw)):
            inside = of[: len(bucket)] == of[width - 1 :]
            if goes_on and width == 2:
                inside[0] = False
            yield bucket[inside], of[: len(bucket)][inside]

    for k, text in enumerate(texts):
        text = b" " + (text or b"").translate(_OTHER) + b" "
        for at in range(0, len(text), BYTES_AT_ONCE):
            if held and (at or size + len(text) > BYTES_AT_ONCE):
                yield from cut()
                held, owner, size = [], [], 0
            if not held:
                goes_on = at > 0
            held.append(text[max(at - 2, 0) : at + BYTES_AT_ONCE])
            owner.append(k)
            size += len(held[-1])
    if held:
        yield from cut()


def gram_sums(texts: list[bytes | None], weights: np.ndarray) -> np.ndarray:
    """For each text the summed weight rows of its n-grams, and their number last."""
    out = np.zeros((len(texts), weights.shape[1] + 1))
    for bucket, of in _grams_by_text(texts):
        if len(of):
            start = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            out[of[start], :-1] += np.add.reduceat(weights[bucket], start, axis=0)
            out[of[start], -1] += np.diff(np.concatenate((start, [len(of)])))
    return out


def codewords(languages: int, seed: int = 42) -> np.ndarray:
    """A row of +1 and -1 per language: all splits up to 7 languages, else the best of
    many random codes by their smallest distance."""
    if languages < 2:
        return np.ones((languages, 0))
    if languages <= 7:
        bits = np.arange(1, 2 ** (languages - 1))
        code = np.ones((languages, len(bits)))
        for k in range(1, languages):
            code[k] = np.where(bits >> (k - 1) & 1, -1, 1)
        return code
    rng = np.random.default_rng(seed)
    length = int(np.ceil(10 * np.log2(languages)))
    best, best_gap = None, -1.0
    # Every try compares all pairs of languages.
    for _ in range(max(4, min(200, 20_000 // languages))):
        code = rng.choice([-1.0, 1.0], size=(languages, length))
        flat = np.abs(code.sum(axis=0)) == languages
        code[0, flat] *= -1
        gap = np.min(length - (code @ code.T)[np.triu_indices(languages, 1)])
        if gap > best_gap:
            best, best_gap = code, gap
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def margins(self, texts: list[bytes | None]) -> np.ndarray:
        sums = gram_sums(texts, self.weights)
        return sums[:, :-1] / np.sqrt(np.maximum(sums[:, -1:], 1))

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest codeword and its share of the likelihood."""
        up, down = (np.logaddexp(0, side * margins) * self.trust for side in (-1, 1))
        loss = up @ (self.code > 0).T + down @ (self.code < 0).T
        best = loss.argmin(axis=1)
        share = np.exp(loss.min(axis=1, keepdims=True) - loss).sum(axis=1)
        return best, 1 / share


def classifiers(grams: DataFrame, languages: list[str], totals: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Log odds per bucket and bit, each side of a bit the mean rate of its languages.

    ``grams`` has ``lang, bucket, n``; ``totals`` are the n-grams of each language.
    """
    spark, bits = grams.sparkSession, code.shape[1]
    size = totals + 0.5 * BUCKETS
    rows = [(name, float(1 / t), [bool(x > 0) for x in word]) for name, t, word in zip(languages, size, code)]
    shares = spark.createDataFrame(rows, "lang string, share double, word array<boolean>")
    rate = F.col("n") * F.col("share")
    on = [F.sum(F.when(F.col("word")[b], rate)).alias(f"b{b}") for b in range(bits)]
    summed = grams.join(shares, "lang").groupBy("bucket").agg(F.sum(rate).alias("all"), *on).toArrow()
    place = summed["bucket"].to_numpy()
    whole, sides = np.zeros((BUCKETS, 1)), np.zeros((BUCKETS, bits))
    whole[place, 0] = summed["all"].to_numpy()
    for b in range(bits):
        sides[place, b] = summed[f"b{b}"].fill_null(0.0).to_numpy()
    # Half an n-gram more in every bucket.
    above = code > 0
    smooth_on, smooth_off = ((0.5 / size) @ side for side in (above, ~above))
    rate_on = (sides + smooth_on) / above.sum(axis=0)
    rate_off = (np.maximum(whole - sides, 0) + smooth_off) / (~above).sum(axis=0)
    return (np.log(rate_on) - np.log(rate_off)).astype(np.float32)


def _lowered(text: str):
    return F.lower(F.col(text).cast("string")).cast("binary")


def fold(doc_id: str):
    return F.crc32(F.col(doc_id).cast("string")) % FOLDS


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """Fit on all documents outside fold 0; fold 1 measures the bits (see the module)."""
    ship(docs.sparkSession)
    learn = docs.filter((fold(doc_id) != 0) & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        (fold(doc_id) == 1).alias("checks"), F.col(lang).cast("string").alias("lang"), _lowered(text).alias("raw")
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[bool, str], np.ndarray] = {}
        for batch in batches:
            langs, checks = batch["lang"].to_pylist(), batch["checks"].to_pylist()
            raws = batch["raw"].to_pylist()
            keys = sorted(set(zip(checks, langs)))
            number = {key: n for n, key in enumerate(keys)}
            of = np.array([number[key] for key in zip(checks, langs)], np.int64)
            found = np.zeros(len(keys) * BUCKETS, np.int64)
            for bucket, owner in _grams_by_text(raws):
                found += np.bincount(of[owner] * BUCKETS + bucket, minlength=len(found))
            for key, n in number.items():
                part = found[n * BUCKETS : (n + 1) * BUCKETS]
                sums[key] = sums[key] + part if key in sums else part
        for (check, name), total in sums.items():
            at = np.flatnonzero(total)
            yield pa.record_batch(
                {
                    "checks": pa.array([check] * len(at), pa.bool_()),
                    "lang": pa.array([name] * len(at), pa.string()),
                    "bucket": pa.array(at, pa.int32()),
                    "n": pa.array(total[at], pa.int64()),
                }
            )

    folder = shared_folder(docs.sparkSession, "langid")
    learn.mapInArrow(count, "checks boolean, lang string, bucket int, n long").groupBy("checks", "lang", "bucket").agg(
        F.sum("n").alias("n")
    ).write.parquet(folder)
    grams = docs.sparkSession.read.parquet(folder)
    sizes = {(r["checks"], r["lang"]): r["n"] for r in grams.groupBy("checks", "lang").agg(F.sum("n").alias("n")).collect()}
    languages = [r[0] for r in learn.select("lang").distinct().orderBy("lang").collect()]
    if not languages:
        return None
    place = {name: k for k, name in enumerate(languages)}
    counts = np.array([[sizes.get((checks, name), 0) for name in languages] for checks in (False, True)], float)
    code = codewords(len(languages))
    bits = code.shape[1]
    every = grams.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    model = Model(languages, code, classifiers(every, languages, counts.sum(axis=0), code), np.ones(bits))
    if bits and counts[1].sum() and counts[0].sum():
        first = grams.filter(~F.col("checks"))
        trial = Model(languages, code, classifiers(first, languages, counts[0], code), np.ones(bits))

        @arrow_udf("array<double>")
        def margins(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                yield pa.array(list(trial.margins(batch.to_pylist())), pa.list_(pa.float64()))

        rows = (
            learn.filter("checks")
            .select("lang", margins("raw").alias("m"))
            .groupBy("lang")
            .agg(
                F.count("*").alias("n"),
                *(F.sum((F.element_at("m", b + 1) > 0).cast("long")).alias(f"b{b}") for b in range(bits)),
            )
            .collect()
        )
        right, total = np.zeros(bits), 0
        for r in rows:
            ups = np.array([r[f"b{b}"] for b in range(bits)])
            right += np.where(code[place[r["lang"]]] > 0, ups, r["n"] - ups)
            total += r["n"]
        error = np.clip(1 - right / total, 1e-3, 0.499)
        trust = np.log((1 - error) / error)
        model.trust = trust / trust.mean()
    return model


def predictions(
    docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, ambiguous`` of each row."""
    plain = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(fold(doc_id) == 0, F.lit(False)).alias("held_out"),
        F.coalesce(F.col(text).cast("string").rlike(r"\p{L}"), F.lit(False)).alias("readable"),
        _lowered(text).alias("raw"),
    )
    if model is None:
        return plain.select(
            "doc_id",
            "held_out",
            F.lit(UNKNOWN).alias("lang_pred"),
            F.lit(0.0).alias("score"),
            F.lit(True).alias("ambiguous"),
        )

    ship(docs.sparkSession)

    @arrow_udf("lang string, score double")
    def nearest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = np.array(model.languages, object)
        for batch in batches:
            best, score = model.decode(model.margins(batch.to_pylist()))
            yield pa.StructArray.from_arrays(
                [pa.array(names[best], pa.string()), pa.array(score)], names=["lang", "score"]
            )

    told = plain.withColumn("p", nearest("raw"))
    score = F.when(F.col("readable"), F.col("p.score")).otherwise(0.0)
    return told.select(
        "doc_id",
        "held_out",
        F.when(F.col("readable"), F.col("p.lang")).otherwise(UNKNOWN).alias("lang_pred"),
        score.alias("score"),
        (score < AMBIGUOUS).alias("ambiguous"),
    )
