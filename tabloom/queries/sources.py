"""CSV source queries: tables written in awkward dialects and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sizing import shared_folder
from ..sources.dialect import detect_dialects, dialect_report, list_files, with_records
from ..sources.tables import (
    coverage_report,
    read_by_coverage,
    read_csv_robust,
    read_first_usable,
    read_for_retraining,
    write_csv,
)
from .inputs import table

MESSY = {
    "key": "o_orderkey",
    "estado año": "CASE o_orderstatus WHEN 'F' THEN 'señal' WHEN 'O' THEN 'a;b' ELSE 'n/a' END",
    "total": "CASE WHEN o_orderkey % 7 = 0 THEN 'NA' ELSE CAST(o_totalprice AS STRING) END",
    "open": "CASE WHEN o_orderstatus = 'O' THEN 'True' ELSE 'False' END",
    "prio": "CASE WHEN o_orderkey % 3 = 0 THEN 'None' ELSE o_orderpriority END",
}


def _messy(spark: SparkSession, folder: str, where: str = "true") -> DataFrame:
    return table(spark, folder, "orders").where(where).selectExpr(*[f"{e} AS `{n}`" for n, e in MESSY.items()])


_MESSY_SQL = """SELECT o_orderkey AS key, CASE o_orderstatus WHEN 'F' THEN 'señal' WHEN 'O' THEN 'a;b' END AS "estado año",
 CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS total, o_orderstatus = 'O' AS open,
 CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS prio FROM orders"""


def _mixed_files(spark: SparkSession, folder: str) -> list[str]:
    """The orders in four folders, each in another separator and two encodings."""
    base = shared_folder(spark, "csv")
    files = []
    for i, (separator, encoding) in enumerate(
        [(",", "utf-8"), (";", "latin-1"), ("\t", "utf-8"), ("|", "latin-1")]
    ):
        path = f"{base}/{i}"
        write_csv(_messy(spark, folder, f"o_orderkey % 4 = {i}"), path, separator, encoding)
        files += list_files(spark, f"{path}/*.csv")
    return files


def csv_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Files of four dialects read as one typed table."""
    return read_csv_robust(spark, _mixed_files(spark, folder))


def csv_dialects(spark: SparkSession, folder: str) -> DataFrame:
    """Dialects of the same files, with the rows behind each."""
    files = _mixed_files(spark, folder)
    report = dialect_report(spark, files, whole=True)
    lines = spark.read.text(files).groupBy(F.col("_metadata.file_path").alias("uri")).agg(
        (F.count(F.lit(1)) - 1).alias("n")
    )
    counted = lines.withColumn("path", F.regexp_replace("uri", "^file:/+", "/"))
    return report.join(counted, "path").groupBy("encoding", "separator", "n_cols").agg(F.sum("n").alias("rows"))


CSV_DIALECTS = """SELECT CASE o_orderkey % 4 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'latin-1' WHEN 2 THEN 'utf-8'
 ELSE 'latin-1' END AS encoding, CASE o_orderkey % 4 WHEN 0 THEN ',' WHEN 1 THEN ';' WHEN 2 THEN chr(9) ELSE '|' END
 AS separator, 5 AS n_cols, count(*) AS rows FROM orders GROUP BY ALL"""


def csv_multiline(spark: SparkSession, folder: str) -> DataFrame:
    """Cells with line breaks, separators and quotes, in several files."""
    path = f"{shared_folder(spark, 'csv')}/breaks"
    write_csv(table(spark, folder, "orders").selectExpr("o_orderkey AS k", f"{BREAKS} AS note", "o_totalprice AS t"), path)
    return read_csv_robust(spark, [path])


BREAKS = (
    "concat(o_orderstatus, ', \"', o_orderpriority, '\"', CASE WHEN o_orderkey % 3 = 0 THEN chr(10) ELSE ' ' END,"
    " CASE WHEN o_orderkey % 5 = 0 THEN concat(chr(10), ';,|') ELSE '' END, 'end')"
)


def csv_most_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Decimal commas inside semicolon files: the rule of most columns finds the semicolon."""
    path = f"{shared_folder(spark, 'csv')}/decimals"
    data = table(spark, folder, "orders").selectExpr(
        "o_orderkey AS k", "translate(CAST(o_totalprice AS STRING), '.', ',') AS total", "o_orderstatus AS s"
    )
    data.write.csv(path, sep=";", header=True, quote="\u0000")
    files = list_files(spark, f"{path}/*.csv")
    separators = {d.separator for d in with_records(detect_dialects(spark, files, rule="max_columns"))}
    (separator,) = separators
    out = read_csv_robust(spark, files, rule="max_columns")
    return out.select(
        F.lit(separator).alias("separator"),
        "k",
        F.regexp_replace("total", ",", ".").cast("double").alias("total"),
        "s",
    )


def csv_first_usable(spark: SparkSession, folder: str) -> DataFrame:
    """A missing file, a file of one unseparated column, then a good one."""
    base = shared_folder(spark, "csv")
    orders = table(spark, folder, "orders")
    joined = orders.select(F.concat_ws("~,~", "o_orderkey", "o_orderstatus").alias("only"))
    joined.write.csv(f"{base}/one", header=True, quote="\u0000", sep="|")
    write_csv(orders.select("o_orderkey", "o_orderstatus"), f"{base}/two", ";")
    return read_first_usable(spark, [f"{base}/none.csv", f"{base}/one", f"{base}/two"])[1]


def _candidates(spark: SparkSession, folder: str) -> list[str]:
    base = shared_folder(spark, "csv")
    orders = table(spark, folder, "orders")
    narrow = orders.selectExpr("o_orderkey", "o_orderstatus AS `Estado  Final`")
    full = orders.selectExpr("o_orderkey", "o_orderstatus AS `Estado  Final`", "o_totalprice AS `Total General`", "o_custkey")
    write_csv(narrow, f"{base}/narrow", ";")
    write_csv(full, f"{base}/full", ";")
    return [f"{base}/narrow", f"{base}/full"]


_REQUIRED = ["estado final", "total", "o_custkey"]


def csv_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Coverage of two candidates, next to the rows each holds."""
    files = _candidates(spark, folder)
    report = coverage_report(spark, files, _REQUIRED)
    # A header is the only line with column names in it.
    candidate = F.regexp_extract("_metadata.file_path", "/(narrow|full)/[^/]*$", 1)
    rows = spark.read.text(files).groupBy(candidate.alias("name")).agg(
        F.count_if(~F.col("value").startswith("o_orderkey")).alias("rows")
    )
    named = report.withColumn("name", F.regexp_extract("path", "/(narrow|full)$", 1))
    return named.join(rows, "name").select(
        "priority",
        F.array_join("found", ",").alias("found"),
        F.array_join("missing", ",").alias("missing"),
        F.round("pct", 4).alias("pct"),
        "rows",
    )


CSV_COVERAGE = """SELECT 0 AS priority, 'estado final' AS found, 'total,o_custkey' AS missing, 33.3333::DOUBLE AS pct,
 count(*) AS rows FROM orders UNION ALL SELECT 1, 'estado final,total,o_custkey', '', 100.0, count(*) FROM orders"""


def csv_by_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """The first candidate with 80% of the columns, under the required names."""
    return read_by_coverage(spark, _candidates(spark, folder), _REQUIRED)[1]


def csv_for_retraining(spark: SparkSession, folder: str) -> DataFrame:
    """Half of the expected columns are enough to train again."""
    return read_for_retraining(spark, _candidates(spark, folder), ["estado final", "not there"])[1]


QUERIES = {
    "csv_roundtrip": (csv_roundtrip, _MESSY_SQL),
    "csv_dialects": (csv_dialects, CSV_DIALECTS),
    "csv_multiline": (csv_multiline, f"SELECT o_orderkey AS k, {BREAKS} AS note, o_totalprice AS t FROM orders"),
    "csv_most_columns": (
        csv_most_columns,
        "SELECT ';' AS separator, o_orderkey AS k, o_totalprice AS total, o_orderstatus AS s FROM orders",
    ),
    "csv_first_usable": (csv_first_usable, "SELECT o_orderkey, o_orderstatus FROM orders"),
    "csv_coverage": (csv_coverage, CSV_COVERAGE),
    "csv_by_coverage": (
        csv_by_coverage,
        'SELECT o_orderkey, o_orderstatus AS "estado final", o_totalprice AS total, o_custkey FROM orders',
    ),
    "csv_for_retraining": (csv_for_retraining, 'SELECT o_orderkey, o_orderstatus AS "estado final" FROM orders'),
}
