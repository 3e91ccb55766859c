import pytest

from tabloom.sources.dialect import dialect_report, detect_dialects
from tabloom.sources.tables import (
    by_name_priority,
    check_structure,
    coverage_report,
    preview,
    read_by_coverage,
    read_csv_robust,
    read_first_usable,
    read_for_retraining,
)


def write(folder, name, text, encoding="utf-8"):
    path = folder / name
    path.write_bytes(text.encode(encoding))
    return str(path)


def rows(n, sep):
    return "".join(f"{i}{sep}n{i}{sep}{i}.5\n" for i in range(n))


def test_dialects(spark, tmp_path):
    files = [
        write(tmp_path, "comma.csv", "id,name,score\n" + rows(12, ",")),
        write(tmp_path, "semi.csv", "año;niño;valor\n" + rows(3, ";"), "latin-1"),
        write(tmp_path, "tab.csv", "a\tb\tc\n" + rows(3, "\t")),
        write(tmp_path, "pipe.csv", "a|b|c\n" + rows(3, "|")),
        write(tmp_path, "single.csv", "only\nplain\nvalues\n"),
        write(tmp_path, "single_bad.csv", "only\na;b\n"),
        write(tmp_path, "empty.csv", ""),
        str(tmp_path / "missing.csv"),
    ]
    got = {r["priority"]: r for r in dialect_report(spark, files, whole=True).collect()}
    assert [(got[i]["separator"], got[i]["encoding"], got[i]["n_cols"]) for i in range(5)] == [
        (",", "utf-8", 3),
        (";", "latin-1", 3),
        ("\t", "utf-8", 3),
        ("|", "utf-8", 3),
        (",", "utf-8", 1),
    ]
    assert got[0]["sample_rows"] == 5 and got[0]["attempts"] == 1
    assert got[1]["columns"] == ["año", "niño", "valor"] and got[1]["attempts"] == 6
    # Under every separator the row is wider than the header or unseparated.
    assert got[5]["separator"] is None
    assert got[6]["reason"] == "the file is empty"
    assert got[7]["reason"].startswith("cannot be read")


def test_encoding_is_decided_by_the_whole_file(spark, tmp_path):
    text = "k;v\n" + "".join(f"{i};plain\n" for i in range(30_000)) + "30000;señal\n"
    path = write(tmp_path, "late.csv", text, "latin-1")
    assert detect_dialects(spark, [path])[0].encoding == "utf-8"
    assert detect_dialects(spark, [path], whole=True)[0].encoding == "latin-1"
    out = read_csv_robust(spark, [path])
    assert out.where("v = 'señal'").count() == 1 and out.count() == 30_001


def test_row_wider_than_header_rules_a_separator_out(spark, tmp_path):
    path = write(tmp_path, "late_wide.csv", "a,b;c\n" + "1,2;3\n" * 20 + "1,2,3;4\n")
    assert detect_dialects(spark, [path])[0].separator == ","
    assert detect_dialects(spark, [path], whole=True)[0].separator == ";"


def test_long_header(spark, tmp_path):
    names = [f"column_{i}" for i in range(9_000)]
    path = write(tmp_path, "wide.csv", ";".join(names) + "\n" + ";".join("1" * 9_000) + "\n")
    assert detect_dialects(spark, [path])[0].header == names


def test_most_columns(spark, tmp_path):
    path = write(tmp_path, "mixed.csv", "a;b;c\n1,5;2,5;x\n2,5;3,5;y\n")
    (d,) = detect_dialects(spark, [path], rule="max_columns")
    assert (d.separator, len(d.header)) == (";", 3)


def test_missing_tokens_and_types(spark, tmp_path):
    text = 'n,f,b,t,q\n1,NA,True,x,"a, ""b"""\nn/a,1.5,False,NULL,c\n3,nan,True,None,d\n'
    out = read_csv_robust(spark, [write(tmp_path, "na.csv", text)])
    assert dict(out.dtypes) == {"n": "bigint", "f": "double", "b": "boolean", "t": "string", "q": "string"}
    assert [tuple(r) for r in out.orderBy("q").collect()] == [
        (1, None, True, "x", 'a, "b"'),
        (None, 1.5, False, None, "c"),
        (3, None, True, None, "d"),
    ]


def test_union_of_different_headers(spark, tmp_path):
    files = [
        write(tmp_path, "one.csv", " a ,b\n1,2\n"),
        write(tmp_path, "two.csv", "b;c\n3;x\n"),
    ]
    out = read_csv_robust(spark, files)
    assert sorted(map(tuple, out.select("a", "b", "c").collect()), key=str) == [(1, 2, None), (None, 3, "x")]


def test_unreadable_file_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="empty"):
        read_csv_robust(spark, [write(tmp_path, "e.csv", "")])


def test_choice_of_source(spark, tmp_path):
    narrow = write(tmp_path, "clean.csv", "IDIOMAS  I;x\n1;2\n")
    full = write(tmp_path, "datos_full.csv", "IDIOMAS  I;Total General;y\n1;2;3\n")
    assert by_name_priority([narrow, full]) == [full, narrow]
    required = ["idiomas i", "total"]
    report = {r["path"]: r["pct"] for r in coverage_report(spark, [narrow, full], required).collect()}
    assert report == {narrow: 50.0, full: 100.0}
    path, out = read_by_coverage(spark, [narrow, full], required)
    assert path == full and out.columns == ["idiomas i", "total", "y"]
    assert read_for_retraining(spark, [narrow, full], required)[0] == narrow
    with pytest.raises(ValueError):
        read_by_coverage(spark, [narrow], required)
    broken = write(tmp_path, "broken.csv", "IDIOMAS I;x\n" + "1;2\n" * 30 + "1;2;3;4\n")
    with pytest.warns(UserWarning, match="1 rows that do not fit"):
        assert read_for_retraining(spark, [broken], required)[1].count() == 30
    assert read_first_usable(spark, [str(tmp_path / "no.csv"), narrow])[0] == narrow


def test_preview_and_structure(spark):
    df = spark.createDataFrame([("x" * 60, 1), ("y" * 50, 2)], ["  long text", "n"])
    got = preview(df, key=["n"]).collect()
    assert got[0]["long text"] == "x" * 50 + "..." and got[1]["long text"] == "y" * 50
    assert check_structure(df).first()["is_valid"]
    assert not check_structure(df.limit(0)).first()["is_valid"]
    assert not check_structure(df.select("n")).first()["is_valid"]


def test_line_breaks_inside_quotes(spark, tmp_path):
    text = "id;note;n\n" + "".join(f'{i};"line {i};a\nand ""b"" | ,,;,\n\nend";{i}\n' for i in range(50))
    path = write(tmp_path, "breaks.csv", text)
    (d,) = detect_dialects(spark, [path], whole=True)
    assert (d.separator, d.multiline) == (";", True)
    got = read_csv_robust(spark, [path, write(tmp_path, "plain.csv", "id,note,n\n90,x,1\n")])
    rows = {r["id"]: (r["note"], r["n"]) for r in got.collect()}
    assert rows == {i: (f'line {i};a\nand "b" | ,,;,\n\nend', i) for i in range(50)} | {90: ("x", 1)}


def test_record_wider_than_header_behind_line_breaks(spark, tmp_path):
    path = write(tmp_path, "wide_breaks.csv", 'a,b\n1,"x\ny"\n' + "2,z\n" * 40 + "1,2,3\n")
    with pytest.raises(ValueError, match="no separator"):
        read_csv_robust(spark, [path])


def test_stray_quote_inside_a_cell(spark, tmp_path):
    path = write(tmp_path, "inch.csv", "id,size\n" + '0,5" pipe\n' + "".join(f"{i},p{i}\n" for i in range(1, 20_000)))
    (d,) = detect_dialects(spark, [path], whole=True)
    assert (d.separator, d.multiline) == (",", False)
    out = read_csv_robust(spark, [path])
    assert out.count() == 20_000 and out.where("id = 0").first()["size"] == '5" pipe'


def test_huge_lines(spark, tmp_path):
    path = write(tmp_path, "long.csv", "id,t\n" + "1," + "x" * 1_000_000 + "\n2,y\n")
    assert read_csv_robust(spark, [path]).where("length(t) = 1000000").count() == 1
    path = write(tmp_path, "endless.csv", "y" * 40_000_000)
    assert "longer than" in detect_dialects(spark, [path])[0].reason


def test_folder_as_source(spark, tmp_path):
    for name, n in (("p0.csv", 2), ("p1.csv", 30)):
        (tmp_path / "d").mkdir(exist_ok=True)
        write(tmp_path / "d", name, "id;t\n" + "1;x\n" * n)
    (tmp_path / "d" / "_SUCCESS").write_bytes(b"")
    assert read_csv_robust(spark, [str(tmp_path / "d")]).count() == 32
    (tmp_path / "none").mkdir()
    path, out = read_first_usable(spark, [str(tmp_path / "none"), str(tmp_path / "d")])
    assert path == str(tmp_path / "d") and out.columns == ["id", "t"]


def test_folder_of_differing_files(spark, tmp_path):
    folder = tmp_path / "d"
    folder.mkdir()
    write(folder, "a.csv", "id;t;n\n" + "1;año;5\n" * 30, "latin-1")
    write(folder, "b.csv", "t;id\nñu;2\nñu;2\n")
    write(folder, "c.csv", "n,id,t\n7,3,x\n8,3,y\n")
    write(folder, "d.csv", "")
    got = read_csv_robust(spark, [str(folder)])
    rows = sorted(map(tuple, got.select("id", "t", "n").collect()), key=str)
    assert rows == [(1, "año", 5)] * 30 + [(2, "ñu", None)] * 2 + [(3, "x", 7), (3, "y", 8)]
    (d,) = detect_dialects(spark, [str(folder)], whole=True)
    assert (d.path, d.encoding, d.separator, d.columns) == (str(folder), "latin-1", ";", ["id", "t", "n"])
    assert read_by_coverage(spark, [str(folder)], ["id", "t", "n"])[1].count() == 34
    write(folder, "e.csv", "a,b;c\n1;2,3,4;5\n")
    with pytest.raises(ValueError, match="e.csv"):
        read_csv_robust(spark, [str(folder)])


def test_folder_with_parts_of_a_header_alone(spark, tmp_path):
    folder = tmp_path / "one"
    folder.mkdir()
    write(folder, "p0.csv", "only\n")
    write(folder, "p1.csv", "only\nx\ny\n")
    assert read_csv_robust(spark, [str(folder)]).count() == 2


def test_listed_parts_of_a_header_alone(spark, tmp_path):
    """Writers leave a header alone where their first task has no rows."""
    empty = write(tmp_path, "part-0.csv", "k;total;s\n")
    full = write(tmp_path, "part-1.csv", "k;total;s\n1;2,5;F\n2;3,5;O\n")
    out = read_csv_robust(spark, [empty, full], rule="max_columns")
    assert sorted(map(tuple, out.collect())) == [(1, "2,5", "F"), (2, "3,5", "O")]
    other = write(tmp_path, "other.csv", "k;total\n")
    with pytest.raises(ValueError, match="no separator"):
        read_csv_robust(spark, [other, full], rule="max_columns")


def test_most_columns_of_a_table_whose_first_split_is_empty(spark, tmp_path):
    from tabloom.queries.sources import csv_most_columns

    schema = "o_orderkey long, o_totalprice double, o_orderstatus string"
    orders = spark.createDataFrame([(k, k + 0.5, "F") for k in range(9)], schema)
    folder = tmp_path / "orders.parquet"
    orders.limit(0).coalesce(1).write.parquet(f"{folder}/a")
    orders.coalesce(1).write.parquet(f"{folder}/b")
    for at in ("a", "b"):
        for part in (folder / at).glob("*.parquet"):
            part.rename(folder / f"{at}.parquet")
    for at in ("a", "b"):
        for left in (folder / at).iterdir():
            left.unlink()
        (folder / at).rmdir()
    out = csv_most_columns(spark, str(tmp_path))
    assert sorted(map(tuple, out.collect())) == [(";", k, k + 0.5, "F") for k in range(9)]
