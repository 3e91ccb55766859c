from tabloom.operators.clean import CleaningOptions, clean, clean_automatically


def test_columns_named_like_parts_of_the_report(spark):
    """Text columns whose names resemble the counters' change no count."""
    rows = [(" a", "x ", 1, 2), (None, None, None, 3), ("b", "y", 2, 4), (None, None, None, None)]
    df = spark.createDataFrame(rows, "parse string, padded string, mpty int, v0 int")
    options = CleaningOptions(remove_empty_rows=True, remove_rows_many_missing=True, clean_text_spaces=True)
    got = {r["step"]: r["affected"] for r in clean(df, options).report.collect()}
    assert got == {"remove_empty_rows": 1, "remove_rows_many_missing": 1, "clean_text_spaces": 2}
    got = {r["step"]: r["affected"] for r in clean_automatically(df).report.collect()}
    assert got["remove_empty_rows"] == 1 and got["remove_rows_many_missing"] == 1 and got["clean_text_spaces"] == 2
