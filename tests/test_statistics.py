import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.functions.statistics import distinct_counts, exact_quantiles, smallest_values, value_counts
from tabloom.operators.prepare import code_table


def skewed(spark):
    """Heavy copies in the middle, spread-out ends, and gaps."""
    rng = np.random.default_rng(3)
    a = np.concatenate([rng.normal(0, 50, 3000), np.full(2500, 7.25), rng.exponential(1e6, 500)])
    b = np.concatenate([np.repeat([1.0, 2.0], 2900), rng.uniform(0, 3, 200)])
    return spark.createDataFrame(list(zip(a.tolist(), b.tolist())), "a double, b double"), {"a": a, "b": b}


@pytest.mark.parametrize("direct", [10, 1_000_000])
def test_exact_quantiles(spark, direct):
    df, values = skewed(spark)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.93, 1.0]
    got = exact_quantiles(
        df.withColumn("none", F.lit(None).cast("double")),
        ["a", "b", "none"],
        probs,
        direct_rows=direct,
        accuracy=100,
        value_rows=200,
    )
    for c, v in values.items():
        np.testing.assert_allclose(got[c], np.quantile(v, probs), rtol=1e-12)
    assert got["none"] == [None] * len(probs)


def test_code_table_without_a_known_size(spark):
    df = spark.range(5000).select(
        F.concat(F.lit("v"), F.col("id") % 700).alias("x"), F.concat(F.lit("w"), F.col("id") % 11).alias("y")
    )
    counts = value_counts(df, ["x", "y"])
    known = code_table(counts, 711)
    unknown = code_table(counts, None)
    assert sorted(map(tuple, known.collect())) == sorted(map(tuple, unknown.collect()))
    assert unknown.where("column_name = 'x'").agg(F.min("code"), F.max("code")).first()[:] == (0, 699)


def test_distinct_counts(spark):
    df = spark.range(20_000).select("id", (F.col("id") % 9).cast("double").alias("d"), F.lit(None).cast("string").alias("e"))
    exact = dict(map(tuple, distinct_counts(df, df.columns).collect()))
    assert exact == {"id": 20_000, "d": 9, "e": 0}
    sketched = dict(map(tuple, distinct_counts(df, df.columns, exact=False).collect()))
    assert sketched["d"] == 9 and sketched["e"] == 0 and abs(sketched["id"] - 20_000) < 3_000


def test_smallest_values_sort_numbers_as_numbers(spark):
    df = spark.createDataFrame([(10, "b"), (9, "a"), (100, None)], "n int, s string")
    got = dict(map(tuple, smallest_values(df, ["n", "s"], 2).collect()))
    assert got == {"n": ["9", "10"], "s": ["a", "b"]}


def test_values_keep_the_order_of_their_type(spark):
    df = spark.sql(
        "SELECT CAST(d AS DECIMAL(6, 2)) AS d, CAST(d AS FLOAT) AS f, DATE'2020-01-09' + INT(d) AS t"
        " FROM VALUES (10), (9), (-3), (-20), (9) AS v(d)"
    )
    got = dict(map(tuple, smallest_values(df, ["d", "f", "t"], 3).collect()))
    assert got["d"] == ["-20.00", "-3.00", "9.00"]
    assert got["f"] == ["-20.0", "-3.0", "9.0"]
    assert got["t"] == ["2019-12-20", "2020-01-06", "2020-01-18"]
    zero = spark.sql("SELECT CAST(x AS FLOAT) AS f FROM VALUES ('-0.0'), ('0.0') AS v(x)")
    assert [tuple(r) for r in value_counts(zero, ["f"]).collect()] == [("f", "0.0", 2)]
