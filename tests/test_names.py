import pytest

from tabloom.functions.names import clean_name, match_names, select_task, tidy_columns, unique_names


def test_clean_name():
    assert clean_name(" Nombre ") == "Nombre"
    assert clean_name(" IDIOMAS  I​") == "IDIOMAS I"
    assert clean_name("a\t b\n c") == "a b c"
    assert clean_name(12) == "12"


def test_unique_names():
    assert unique_names(["a", "b", "a", "a"]) == ["a", "b", "a_1", "a_2"]


def test_match_names():
    available = ["IDIOMAS  I", "Total General", "x"]
    assert match_names(["idiomas i", "total", "nope"], available) == {
        "idiomas i": "IDIOMAS  I",
        "total": "Total General",
    }


def test_tidy_columns_and_task(spark):
    df = tidy_columns(spark.createDataFrame([(1, 2, "x")], ["  a", "a ", "b"]))
    assert df.columns == ["a", "a_1", "b"]
    task = select_task(df, " b", ["a", "zz"])
    assert (task.target, task.predictors) == ("b", ("a",))
    for target, predictors in [(None, ["a"]), ("b", []), ("b", ["b", "a"]), ("q", ["a"]), ("b", ["zz"])]:
        with pytest.raises(ValueError):
            select_task(df, target, predictors)
