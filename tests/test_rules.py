from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tabloom.operators import itemsets, rules
from tabloom.operators.baskets import Baskets, column_baskets, item_columns, row_baskets, text_baskets
from tabloom.operators.itemsets import apriori, automatic_length, fp_growth, frequent_itemsets, mining_limits
from tabloom.operators.rules import all_rules, generate_rules, relaxed_thresholds, top_rules
from tabloom.plans.mining import analyze_associations


def baskets(spark, transactions):
    df = spark.createDataFrame([(sorted(set(t)),) for t in transactions], "items array<string>")
    return Baskets(df.repartition(3), len(transactions), "test")


def brute(transactions, min_support, max_len):
    sets = [set(t) for t in transactions]
    items = sorted(set().union(*sets))
    out = {}
    for k in range(1, max_len + 1):
        for c in combinations(items, k):
            n = sum(set(c) <= s for s in sets)
            if n and n / len(sets) >= min_support:
                out[c] = n
    return out


def found(df):
    return {tuple(r["items"]): r["freq"] for r in df.collect()}


BASKET = ["abc", "abc", "ab", "ad", "bc", "", "acde", "e"]


@pytest.mark.parametrize("support, max_len", [(0.1, 5), (0.25, 3), (0.5, 2), (0.99, 2)])
def test_both_algorithms_match_brute_force(spark, support, max_len):
    expected = brute(BASKET, support, max_len)
    assert found(apriori(baskets(spark, BASKET), support, max_len)) == expected
    assert found(fp_growth(baskets(spark, BASKET), support, max_len)) == expected


def test_support_is_inclusive(spark):
    rows = ["xy"] * 7 + ["y"] * 93
    for run in (apriori, fp_growth):
        assert found(run(baskets(spark, rows), 0.07, 2)) == {("x",): 7, ("y",): 100, ("x", "y"): 7}


def test_fp_growth_groups_equal_transactions(spark, monkeypatch):
    monkeypatch.setattr(itemsets, "FPGrowth", None)
    for support, max_len in ((0.1, None), (0.25, 2), (1.0, None)):
        expected = brute(BASKET, support, max_len or 5)
        assert found(fp_growth(baskets(spark, BASKET * 6), support, max_len)) == {k: 6 * v for k, v in expected.items()}
    table = spark.createDataFrame([("x", 1), ("x", 1), ("y", 1), (None, None)] * 9, "a string, b int")
    named = column_baskets(table, ["a", "b"])
    assert named.n == 27 and {tuple(r["items"]): r["freq"] for r in named.groups.collect()} == {("a=x", "b=1"): 18, ("a=y", "b=1"): 9}
    assert found(fp_growth(named, 0.5)) == {("a=x",): 18, ("b=1",): 27, ("a=x", "b=1"): 18}


@pytest.mark.parametrize("limit", [0, 2])
def test_many_candidates_stay_in_tables(spark, monkeypatch, limit):
    monkeypatch.setattr(itemsets, "fp_growth", None)
    assert found(apriori(baskets(spark, BASKET), 0.1, 3, limit)) == brute(BASKET, 0.1, 3)
    assert found(apriori(baskets(spark, BASKET), 0.1, None, limit)) == brute(BASKET, 0.1, 5)


def test_tables_count_over_many_words(spark):
    """More than 64 transactions a task, one item in all of them, some without items."""
    rows = ["a" + "".join(c for i, c in enumerate("bcdef") if not n % (i + 2)) for n in range(700)] + [""] * 60
    assert found(apriori(baskets(spark, rows), 0.02, None, 0)) == brute(rows, 0.02, 6)
    assert found(apriori(baskets(spark, ["", ""]), 0.5, None, 0)) == {}
    assert found(apriori(baskets(spark, rows), 0.9, 1, 0)) == brute(rows, 0.9, 1)


def test_rules_of_every_split(spark):
    sets = apriori(baskets(spark, BASKET), 0.1, 3)
    freq = found(sets)
    got = {(tuple(r["antecedents"]), tuple(r["consequents"])): r for r in all_rules(sets, 8).collect()}
    expected = {
        (a, tuple(x for x in s if x not in a))
        for s in freq
        for k in range(1, len(s))
        for a in combinations(s, k)
    }
    assert set(got) == expected
    r = got["d", "a"] if ("d", "a") in got else got[("d",), ("a",)]
    assert r["confidence"] == 1.0 and r["conviction"] == float("inf")
    r = got[("a", "b"), ("c",)]
    assert r["support"] == 2 / 8 and r["confidence"] == pytest.approx(2 / 3)
    assert r["lift"] == pytest.approx((2 / 3) / (4 / 8)) and r["leverage"] == pytest.approx(2 / 8 - 3 / 8 * 4 / 8)
    assert r["conviction"] == pytest.approx((1 - 4 / 8) / (1 - 2 / 3))


def test_relaxation(spark):
    assert relaxed_thresholds(0.6) == [0.6, 0.5, 0.4, 0.30000000000000004, 0.20000000000000004]
    assert relaxed_thresholds(0.05) == [0.05] * 5
    sets = apriori(baskets(spark, BASKET), 0.1, 3)
    n_all = all_rules(sets, 8).count()
    strict = generate_rules(sets, 8, 0.9, 3)
    assert strict.rules.count() == 3 and strict.threshold == 0.9
    loose = generate_rules(sets, 8, 0.9, n_all)
    assert loose.threshold == relaxed_thresholds(0.9)[-1]
    assert loose.rules.agg(F.min("confidence")).first()[0] < 0.9
    assert generate_rules(sets, 8, 0.9, 0).rules.isEmpty()
    assert generate_rules(sets, 8, 0.9, None).rules.where("confidence < 0.9").isEmpty()
    with pytest.raises(ValueError):
        top_rules(loose.rules, "support")


def test_limits():
    assert [automatic_length(n) for n in (20, 21, 50, 51)] == [5, 4, 4, 3]
    assert mining_limits(5, 0.01, 12, guard=True) == (0.01, 8)
    assert mining_limits(5, 0.01, None, guard=True) == (0.01, 5)
    assert mining_limits(21, 0.01, None, guard=True) == (0.2, 3)
    assert mining_limits(21, 0.3, 2, guard=True) == (0.3, 2)
    assert mining_limits(21, 0.01, 12) == (0.01, 12)
    assert mining_limits(21, 0.01, None) == (0.01, None)


def test_long_itemsets_and_wide_tables_are_not_cut(spark):
    transactions = [list("abcdefgh")] * 3 + [list("abc"), ["z"], []]
    expected = brute(transactions, 0.5, 8)
    assert max(map(len, expected)) == 8
    assert found(apriori(baskets(spark, transactions), 0.5)) == expected
    assert found(fp_growth(baskets(spark, transactions), 0.5)) == expected
    # A table of more than 20 columns, at a support the guard would not allow.
    columns = [f"c{k}" for k in range(22)]
    cells = [tuple("yes" if i % 15 == k % 15 else None for k in range(22)) for i in range(40)]
    wide = spark.createDataFrame(cells, ", ".join(f"{c} string" for c in columns))
    rows = [[f"c{k}=yes" for k in range(22) if i % 15 == k % 15] for i in range(40)]
    assert found(frequent_itemsets(column_baskets(wide, columns), 0.05)) == brute(rows, 0.05, 3)


def test_transactions(spark):
    df = spark.createDataFrame([("b; a ,a",), (" , ",), (None,), ("one two",)], "t string")
    got = text_baskets(df, "t")
    assert got.n == 3 and sorted(r["items"] for r in got.data.collect()) == [[], ["a", "b"], ["one two"]]
    cells = spark.createDataFrame(
        [("x", 1.0, "0"), (" y ", None, "nan"), (None, None, "")], "c string, d double, e string"
    )
    got = column_baskets(cells, ["c", "d", "e"])
    assert got.n == 2 and sorted(r["items"] for r in got.data.collect()) == [["c=x", "d=1.0"], ["c=y"]]
    wide = spark.range(200).select("id", (F.col("id") % 3).alias("three"), F.lit(1).alias("one"), (F.col("id") % 51).alias("many"))
    assert item_columns(wide) == ["three"]
    with pytest.raises(ValueError):
        column_baskets(wide)


def test_one_transaction_with_most_rows(spark):
    """A key with two thirds of the rows and thousands of rare items stays small."""
    hot = spark.range(4000).select(F.lit(0).alias("t"), F.concat(F.lit("r"), "id").alias("i"))
    rest = spark.range(2000).select((F.col("id") % 400 + 1).cast("int").alias("t"), F.concat(F.lit("f"), F.col("id") % 7).alias("i"))
    got = row_baskets(hot.unionAll(rest), "t", "i", 0.1)
    assert got.n == 401
    assert got.data.agg(F.max(F.size("items"))).first()[0] <= 7
    rows = hot.unionAll(rest).distinct().groupBy("t").agg(F.collect_set("i").alias("s")).collect()
    assert found(apriori(got, 0.1, 3)) == {
        k: v for k, v in brute([r["s"] for r in rows if r["t"]] + [[]], 0.1, 3).items()
    }


def test_analysis(spark):
    df = spark.range(100).select(
        F.when(F.col("id") % 4 < 3, "yes").otherwise("no").alias("bought"),
        F.when(F.col("id") % 4 == 0, "red").otherwise("blue").alias("colour"),
    )
    out = analyze_associations(df, min_support=0.1, target="bought", algorithm="fpgrowth")
    assert out.rules.where("NOT exists(consequents, x -> x LIKE 'bought=%')").isEmpty()
    assert out.statistics.first()["total_rules"] == out.rules.count() > 0
    assert out.itemsets_by_length.count() == 2 and out.listed_itemsets.count() <= 50
    assert out.sample_transactions.count() == 5
    with pytest.raises(ValueError):
        frequent_itemsets(out.baskets, algorithm="other")


def test_consequents_grow_as_far_as_confidence_holds(spark, monkeypatch):
    """Itemsets of twelve items, of which only some splits are ever made."""
    rows = ["abcdefghijkl"] * 90 + ["abcdef"] * 6 + ["ghijkl", "abc", "l", "kl"]
    sets = spark.createDataFrame(
        [(list(c), f, len(c)) for c, f in brute(rows, 0.01, 4).items()], "items array<string>, freq long, length int"
    ).repartition(4)
    freq = {tuple(r["items"]): r["freq"] for r in sets.collect()}
    made = []
    plain = rules._with_confidence
    monkeypatch.setattr(rules, "_with_confidence", lambda s, i, c: made.append(s.count()) or plain(s, i, c))
    some = [s for s in freq if len(s) >= 2]
    got = {(tuple(r["antecedents"]), tuple(r["consequents"])) for r in all_rules(sets, 100, 0.97).collect()}
    expected = {
        (a, tuple(x for x in s if x not in a))
        for s in some
        for k in range(1, len(s))
        for a in combinations(s, k)
        if freq[s] / freq[a] >= 0.97
    }
    assert got == expected and 0 < len(got) < sum(made) < sum(2 ** len(s) - 2 for s in some)
    strict = generate_rules(sets, 100, 0.97, None).rules
    assert strict.count() == len(got)


def test_rules_of_very_long_itemsets(spark):
    """Thirty-three and forty items, where bit masks of machine words end."""
    for length in (33, 40):
        items = [f"i{k:02}" for k in range(length)]
        parts = [items] + [[x for x in items if x != i] for i in items] + [[i] for i in items]
        freqs = [9] + [10 if k < 5 else 9 for k in range(length)] + [20] * length
        sets = spark.createDataFrame(
            [(p, f, len(p)) for p, f in zip(parts, freqs)], "items array<string>, freq long, length int"
        )
        got = {(tuple(r["antecedents"]), tuple(r["consequents"])): r["confidence"] for r in all_rules(sets, 30, 0.95).collect()}
        assert got == {(tuple(x for x in items if x != i), (i,)): 1.0 for i in items[5:]}
        assert generate_rules(sets, 30, 0.95, length).threshold == pytest.approx(0.85)
