import pytest
from pyspark.sql import functions as F

from tabloom.operators import split
from tabloom.operators.evaluate import training_summary


@pytest.mark.parametrize("n, test", [(5, 1), (9, 1), (10, 1), (24, 2), (25, 5), (101, 21)])
def test_sizes(spark, n, test):
    got = split.train_test_split(spark.range(n), ["id"])
    assert (got.n_test, got.test.count(), got.train.count()) == (test, test, n - test)


def test_too_small(spark):
    with pytest.raises(ValueError):
        split.train_test_split(spark.range(4), ["id"])


def test_small_tables_fall_back_to_plain_split(spark):
    df = spark.range(12).withColumn("y", F.col("id") % 3)
    got = split.train_test_split(df, ["id"], "y")
    assert not got.stratified and got.test.count() == 1


def test_hot_class_keeps_its_share(spark, monkeypatch):
    # Few rows per bucket, so that several hash digits are used.
    monkeypatch.setattr(split, "BUCKET_ROWS", 20)
    label = F.when(F.col("id") % 10 < 8, "hot").when(F.col("id") % 10 == 8, "b").otherwise("c")
    df = spark.range(4000).withColumn("y", label)
    got = split.train_test_split(df, ["id"], "y")
    counts = dict(map(tuple, got.test.groupBy("y").count().collect()))
    assert counts == {"hot": 640, "b": 80, "c": 80}
    again = split.train_test_split(df.repartition(5), ["id"], "y")
    assert got.test.exceptAll(again.test).isEmpty()


def test_one_row_classes_are_removed(spark):
    df = spark.range(50).withColumn("y", F.when(F.col("id") == 3, "rare").otherwise("common"))
    got = split.train_test_split(df, ["id"], "y")
    assert got.data.where("y = 'rare'").isEmpty()
    row = training_summary(got).first()
    assert (row["original_rows"], row["rows"], row["classes_removed"], row["stratified"]) == (50, 49, 1, True)
