import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.functions.ranking import ranked
from tabloom.operators.rules import all_rules, export_rules
from tabloom.operators.split import class_quotas


@pytest.mark.parametrize("rows", [None, 5_000])
def test_numbers_follow_the_order(spark, rows):
    values = np.random.default_rng(3).permutation(5_000).tolist()
    df = spark.createDataFrame([(v % 7, v) for v in values], "a long, `b.c` long").repartition(6)
    got = ranked(df, F.col("a").desc(), F.col("`b.c`"), rows=rows).collect()
    expected = sorted(((v % 7, v) for v in values), key=lambda r: (-r[0], r[1]))
    assert [(r["a"], r["b.c"]) for r in sorted(got, key=lambda r: r["__rank"])] == expected
    assert sorted(r["__rank"] for r in got) == list(range(1, 5_001))
    assert ranked(df.limit(0), F.col("a"), rows=rows).count() == 0


def test_quotas_do_not_depend_on_how_classes_are_ranked(spark):
    sizes = spark.createDataFrame([(f"c{i}", 2 + i * i % 11) for i in range(50)], "label string, n long")
    n = sizes.agg(F.sum("n")).first()[0]
    few, many = (
        {r["label"]: r["quota"] for r in class_quotas(sizes, "label", n, 60, known).collect()} for known in (50, None)
    )
    assert few == many and sum(few.values()) == 60


def test_export_of_any_number_of_rules(spark):
    sets = spark.createDataFrame(
        [(["a"], 6, 0.6, 1), (["b"], 5, 0.5, 1), (["c"], 4, 0.4, 1), (["a", "b"], 4, 0.4, 2), (["b", "c"], 3, 0.3, 2)],
        "items array<string>, freq long, support double, length int",
    )
    rules = all_rules(sets, 10)
    limited, free = (sorted(map(tuple, export_rules(rules, n).collect())) for n in (100, None))
    assert limited == free and [r[0] for r in free] == [1, 2, 3, 4]
