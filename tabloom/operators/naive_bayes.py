"""Gaussian naive Bayes with variance smoothing."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .models import read_json, write_json


@dataclass
class GaussianNaiveBayes:
    """Per class: share, feature means and smoothed population variances."""

    classes: np.ndarray
    log_prior: np.ndarray
    means: np.ndarray
    variances: np.ndarray
    name: str = "naive_bayes"

    def predict(self, df: DataFrame) -> DataFrame:
        """Class scores are evaluated per Arrow batch; the model is classes × features numbers."""
        classes, prior = self.classes, self.log_prior
        means, variances = self.means, self.variances
        constant = prior - 0.5 * np.log(2.0 * np.pi * variances).sum(axis=1)

        @F.arrow_udf("struct<prediction: double, probability: array<double>>")
        def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                x = batch.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
                joint = np.empty((len(x), len(classes)))
                for c in range(len(classes) if len(x) else 0):
                    joint[:, c] = constant[c] - 0.5 * ((x - means[c]) ** 2 / variances[c]).sum(axis=1)
                shifted = np.exp(joint - joint.max(axis=1, keepdims=True))
                share = shifted / shifted.sum(axis=1, keepdims=True)
                offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(classes))
                yield pa.StructArray.from_arrays(
                    [
                        pa.array(classes[joint.argmax(axis=1)]),
                        pa.ListArray.from_arrays(offsets, pa.array(share.ravel())),
                    ],
                    ["prediction", "probability"],
                )

        scored = df.withColumn("__s", score(vector_to_array("features")))
        return scored.select(*df.columns, "__s.prediction", "__s.probability")

    def importance(self) -> None:
        return None

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        record = {
            k: getattr(self, k).tolist() for k in ("classes", "log_prior", "means", "variances")
        }
        write_json(spark, record, path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> GaussianNaiveBayes:
        record = read_json(spark, path)
        return GaussianNaiveBayes(**{k: np.array(v, dtype=float) for k, v in record.items()})


def fit_naive_bayes(train: DataFrame, var_smoothing: float = 1e-9) -> GaussianNaiveBayes:
    """One grouped aggregate; a class sends its moments only, however many rows it has.

    The smoothing term is a share of the largest feature variance over all rows,
    which follows from the class moments.
    """
    moments = (
        train.groupBy("label")
        .agg(
            F.count(F.lit(1)).alias("n"),
            Summarizer.metrics("mean", "variance").summary(F.col("features")).alias("s"),
        )
        .select("label", "n", vector_to_array("s.mean").alias("mean"), vector_to_array("s.variance").alias("var"))
    )
    rows = sorted(moments.collect(), key=lambda r: r["label"])  # one row per class
    n = np.array([r["n"] for r in rows], dtype=float)
    mean = np.array([r["mean"] for r in rows])
    # The summary gives sample variances; a single row has none.
    var = np.array([r["var"] for r in rows]) * ((n - 1) / n)[:, None]
    share = n / n.sum()
    centre = (share[:, None] * mean).sum(axis=0)
    overall = (share[:, None] * (var + (mean - centre) ** 2)).sum(axis=0)
    return GaussianNaiveBayes(
        classes=np.array([r["label"] for r in rows], dtype=float),
        log_prior=np.log(share),
        means=mean,
        variances=var + var_smoothing * overall.max(),
    )
