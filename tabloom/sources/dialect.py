"""CSV dialects of many files at once.

Two jobs answer for all files: a task per file reads whole leading lines until a
handful of records is complete, and a split-parallel pass over all lines checks
what only the whole text can tell (valid UTF-8, rows wider than the header).  Files
with line breaks inside quotes cannot be judged by lines: a third job streams each
of them, and they are read unsplit.  A path may also be a folder of such files, each of
which has its own dialect.
"""

from __future__ import annotations

import codecs
import csv
import io
import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import clean_name, unique_names

# Separators in order of preference, for either rule, and encodings.
SEPARATORS = [",", ";", "\t", "|"]
SEPARATORS_MOST_COLUMNS = [";", ",", "\t", "|"]
ENCODINGS = ["utf-8", "latin-1", "cp1252", "iso-8859-1"]
# A lone column whose first cell holds one of these was not separated.  The pipe is
# listed too: without it a pipe file would always be taken for one column.
SINGLE_COLUMN_SUSPECTS = [",", ";", "\t", "|"]
SAMPLE_ROWS = 5

# The CSV reader's spelling of the two encodings that can be chosen: latin-1 decodes
# every byte, so the encodings after it are never reached.
SPARK_ENCODING = {"utf-8": "UTF-8", "latin-1": "ISO-8859-1"}

HEAD_BYTES = 1 << 16
# Leading bytes looked at, at most; a longer record is an error, not a dialect.
MAX_HEAD_BYTES = 1 << 24
# Width of a file that cannot be parsed under a separator: wider than any header.
UNREADABLE = (1 << 31) - 1
NAMES = ["comma", "semicolon", "tab", "pipe"]

_HEAD_SCHEMA = (
    "priority int, path string, utf8 boolean, header array<array<string>>, rows array<int>,"
    " widest array<int>, first_cell array<string>, error string"
)


@dataclass
class Dialect:
    """How one file is to be read; a folder also has the dialects of its files as ``parts``.

    A folder's encoding and separator are those of its largest file, its header the columns
    of all files.  ``alone`` has the headers, by separator, of a file without a record that
    no rule could be applied to.
    """

    path: str
    priority: int
    encoding: str | None = None
    separator: str | None = None
    header: list[str] = field(default_factory=list)
    sample_rows: int = 0
    attempts: int = 0
    reason: str | None = None
    multiline: bool = False
    parts: list[Dialect] = field(default_factory=list)
    alone: list[list[str]] = field(default_factory=list)

    @property
    def files(self) -> list[Dialect]:
        return self.parts or [self]

    @property
    def columns(self) -> list[str]:
        return unique_names(clean_name(h) for h in self.header)


def list_files(spark: SparkSession, path: str) -> list[str]:
    """Data files at a path, folder or pattern, by listing only."""
    rows = spark.read.format("binaryFile").load(path).where(F.col("length") >= 0).select("path").collect()
    return sorted(_plain(r["path"]) for r in rows)


def _plain(path: str) -> str:
    path = unquote(path)
    if path.startswith("file:"):
        return "/" + path[len("file:") :].lstrip("/")
    return path


def _is_data(name: str) -> bool:
    """Spark's readers pass over names that start with a dot or an underscore."""
    return not name.rsplit("/", 1)[-1].startswith((".", "_"))


def _open(path: str):
    """A binary stream for a plain path or any address Arrow's file systems know."""
    if "://" not in path:
        if os.path.isdir(path):
            raise OSError("the folder has no files")
        return open(path, "rb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    if system.get_file_info(inner).type == fs.FileType.Directory:
        raise OSError("the folder has no files")
    return system.open_input_stream(inner)


def _folder_files(path: str) -> list[str]:
    """The data files of a folder, the largest first; none if the path is no folder."""
    try:
        if "://" not in path:
            if not os.path.isdir(path):
                return []
            found = [(e.stat().st_size, e.path) for e in os.scandir(path) if e.is_file() and _is_data(e.name)]
        else:
            from pyarrow import fs

            system, inner = fs.FileSystem.from_uri(path)
            if system.get_file_info(inner).type != fs.FileType.Directory:
                return []
            listed = [f for f in system.get_file_info(fs.FileSelector(inner)) if f.is_file and _is_data(f.path)]
            found = [(f.size, f"{path.rstrip('/')}/{f.base_name}") for f in listed]
    except (OSError, ValueError):
        # Reading its head tells what is wrong with the path.
        return []
    return [p for _, p in sorted(found, reverse=True)]


def _leading_records(path: str) -> tuple[bytes, bool]:
    """Whole lines from the start of a file, enough for a few records, and the end flag.

    A quote that is never closed ends the search at ``MAX_HEAD_BYTES``.
    """
    with _open(path) as stream:
        data, size = b"", HEAD_BYTES
        while True:
            more = stream.read(size)
            data += more
            if not more or len(more) < size:
                return data, True
            lines = data.count(b"\n")
            full = len(data) >= MAX_HEAD_BYTES
            if full and not lines:
                raise OSError(f"a line is longer than {MAX_HEAD_BYTES} bytes")
            if full or lines > 4 * SAMPLE_ROWS and data.count(b'"') % 2 == 0:
                return data[: data.rindex(b"\n") + 1], False
            size = min(2 * size, MAX_HEAD_BYTES)


def _looks_utf8(data: bytes) -> bool:
    try:
        codecs.decode(data, "utf-8")
        return True
    except UnicodeDecodeError:
        return False


def _describe(data: bytes, utf8: bool) -> dict:
    """Header, sampled rows and widths under each separator."""
    csv.field_size_limit(MAX_HEAD_BYTES)
    text = data.decode("utf-8-sig" if utf8 else "latin-1")
    out = {"header": [], "rows": [], "widest": [], "first_cell": []}
    for separator in SEPARATORS:
        records = []
        try:
            for record in csv.reader(io.StringIO(text, newline=""), delimiter=separator):
                if record:
                    records.append(record)
                if len(records) > SAMPLE_ROWS:
                    break
        except csv.Error:
            records = []
        out["header"].append(records[0] if records else [])
        out["rows"].append(max(len(records) - 1, 0))
        out["widest"].append(max((len(r) for r in records), default=0))
        out["first_cell"].append(records[1][0] if len(records) > 1 else None)
    return out


def _read_heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for priority, path in zip(batch["priority"], batch["path"]):
            row = {"priority": priority, "path": path, "utf8": None, "error": None}
            try:
                data, _ = _leading_records(path)
                utf8 = _looks_utf8(data)
                row.update(utf8=utf8, **_describe(data, utf8))
                if not data.strip():
                    row["error"] = "the file is empty"
            except OSError as problem:
                row["error"] = f"cannot be read: {problem.strerror or problem}"
            for name in ("header", "rows", "widest", "first_cell"):
                row.setdefault(name, [])
            out.append(row)
        yield pd.DataFrame(
            out, columns=["priority", "path", "utf8", "header", "rows", "widest", "first_cell", "error"]
        )


def heads(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Leading records of every file, one task row per file."""
    listed = spark.createDataFrame(
        [(i, p) for i, p in enumerate(paths)], "priority int, path string"
    )
    tasks = max(1, min(len(paths), spark.sparkContext.defaultParallelism * 4))
    return listed.repartition(tasks, "priority").mapInPandas(_read_heads, _HEAD_SCHEMA)


def whole_file_facts(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Per file, over all of its lines: valid UTF-8, the widest row per separator and
    the number of lines that end inside quotes.

    Lines are combined per file before the shuffle.  Quoted stretches within a line
    do not count as separators; a quote left over at the start of a cell is open.
    """
    lines = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("path"), "value")
    # Separators and quotes are single bytes in every encoding at hand; reading bytes as
    # characters keeps invalid UTF-8 from swallowing them.
    characters = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    bare = F.regexp_replace(characters, '"[^"]*"', "")
    widths = [
        F.max(F.length(bare) - F.length(F.replace(bare, F.lit(s), F.lit(""))) + 1).alias(n)
        for s, n in zip(SEPARATORS, NAMES)
    ]
    return lines.groupBy("path").agg(
        F.bool_and(F.is_valid_utf8("value")).alias("utf8"),
        F.count_if(bare.rlike('(^|[,;\t|])"')).alias("open"),
        *widths,
    )


def _record_widths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    csv.field_size_limit(MAX_HEAD_BYTES)
    for batch in batches:
        out = []
        for path in batch["path"]:
            row = {"path": path}
            for name, separator in zip(NAMES, SEPARATORS):
                with _open(path) as stream:
                    text = io.TextIOWrapper(io.BufferedReader(stream), "latin-1", newline="")
                    try:
                        row[name] = max(map(len, csv.reader(text, delimiter=separator)), default=0)
                    except csv.Error:
                        row[name] = UNREADABLE
            out.append(row)
        yield pd.DataFrame(out, columns=["path", *NAMES])


def record_widths(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Widest record per separator of files with line breaks inside quotes.

    Such files have no safe split, so a task streams a whole file, holding one record.
    """
    listed = spark.createDataFrame([(p,) for p in paths], "path string")
    schema = "path string, " + ", ".join(f"{n} int" for n in NAMES)
    return listed.repartition(max(1, len(paths)), "path").mapInPandas(_record_widths, schema)


def _facts(spark: SparkSession, paths: Sequence[str]) -> dict[str, dict]:
    """What all lines tell of each file."""
    per_file = {_plain(r["path"]): r.asDict() for r in whole_file_facts(spark, paths).collect()}
    quoted = sorted(p for p, f in per_file.items() if f["open"])
    if quoted:
        for r in record_widths(spark, quoted).collect():
            per_file[r["path"]].update({n: r[n] for n in NAMES})
    return {path: per_file[_plain(path)] for path in paths if _plain(path) in per_file}


def _choose(row, facts, rule: str) -> Dialect:
    """Apply the chosen rule to what is known about one file."""
    out = Dialect(row["path"], row["priority"])
    if row["error"]:
        out.reason = row["error"]
        return out
    utf8 = row["utf8"] if facts is None else facts["utf8"]
    found = {}
    for i, s in enumerate(SEPARATORS):
        header, n_rows = row["header"][i], row["rows"][i]
        widest = row["widest"][i] if facts is None else max(row["widest"][i], facts[NAMES[i]])
        if not header or widest > len(header):
            continue
        if len(header) > 1:
            found[s] = (len(header), n_rows, header)
        elif n_rows and not any(x in (row["first_cell"][i] or "") for x in SINGLE_COLUMN_SUSPECTS):
            found[s] = (1, n_rows, header)
    if rule == "max_columns":
        order = SEPARATORS_MOST_COLUMNS
        usable = [s for s in order if s in found and found[s][0] > 1 and found[s][1] > 0]
        chosen = max(usable, key=lambda s: found[s][0], default=None)
        tried = len(order)
    else:
        order = SEPARATORS
        chosen = next((s for s in order if s in found), None)
        tried = len(order) if chosen is None else order.index(chosen) + 1
    if chosen is None:
        out.attempts = len(ENCODINGS) * len(SEPARATORS)
        out.reason = "no separator gives a usable table"
        out.alone = [] if max(row["rows"], default=0) else row["header"]
        return out
    out.encoding = "utf-8" if utf8 else "latin-1"
    out.attempts = tried if utf8 else tried + len(order)
    out.separator = chosen
    out.multiline = bool(facts and facts["open"])
    _, out.sample_rows, out.header = found[chosen]
    return out


def detect_dialects(
    spark: SparkSession, paths: Sequence[str], rule: str = "first", whole: bool = False
) -> list[Dialect]:
    """One :class:`Dialect` per path, in the given order.

    ``rule`` is ``first`` (first separator by preference) or ``max_columns``.
    ``whole`` also looks at every line, which decides the encoding for certain and
    finds line breaks inside quotes.
    Results are one per named path; a folder's holds those of its files.
    """
    if rule not in ("first", "max_columns"):
        raise ValueError(f"unknown rule {rule!r}")
    # A folder's files take its place; the folder itself stays where it has none.
    spread = [(i, p) for i, path in enumerate(paths) for p in _folder_files(path) or [path]]
    rows = sorted(heads(spark, [p for _, p in spread]).collect(), key=lambda r: r["priority"])
    facts = {}
    if whole:
        readable = [r["path"] for r in rows if not r["error"]]
        if readable:
            facts = _facts(spark, readable)
    chosen: list[list[tuple]] = [[] for _ in paths]
    for (i, _), r in zip(spread, rows):
        chosen[i].append((_choose(r, facts.get(r["path"]), rule), r))
    return [_gathered(path, i, found) for i, (path, found) in enumerate(zip(paths, chosen))]


def with_records(dialects: Sequence[Dialect]) -> list[Dialect]:
    """The dialects of files that are parts of one table, less those of a header alone.

    Writers leave such parts where a task had no rows; they add none.  Only a header that
    another file has too tells such a part.
    """
    known = {(f.separator, tuple(f.header)) for d in dialects for f in d.files if not f.reason}
    return [d for d in dialects if not any((s, tuple(h)) in known for s, h in zip(SEPARATORS, d.alone))]


def _gathered(path: str, priority: int, found: list[tuple]) -> Dialect:
    """The dialect of a path from those of its files, which come with their heads."""
    if len(found) == 1 and found[0][0].path == path:
        found[0][0].priority = priority
        return found[0][0]
    # Files without a record, empty or of a header alone, add no rows to the others.
    bare = lambda d, r: d.reason and (d.reason == "the file is empty" or not r["error"] and not max(r["rows"], default=0))
    parts = [d for d, r in found if not bare(d, r)] or [found[0][0]]
    first = parts[0]
    columns = list(dict.fromkeys(c for d in parts for c in d.columns))
    bad = next((d for d in parts if d.reason), None)
    return Dialect(
        path,
        priority,
        first.encoding,
        first.separator,
        first.header if len({tuple(d.columns) for d in parts}) == 1 else columns,
        first.sample_rows,
        first.attempts,
        bad and f"{bad.path.rsplit('/', 1)[-1]}: {bad.reason}",
        any(d.multiline for d in parts),
        parts,
    )


def dialect_report(
    spark: SparkSession, paths: Sequence[str], rule: str = "first", whole: bool = False
) -> DataFrame:
    """The dialects as a table, one row per file."""
    rows = [
        (
            d.priority,
            d.path,
            d.encoding,
            d.separator,
            len(d.header),
            d.sample_rows,
            d.columns,
            d.attempts,
            d.reason,
        )
        for d in detect_dialects(spark, paths, rule, whole)
    ]
    return spark.createDataFrame(
        rows,
        "priority int, path string, encoding string, separator string, n_cols int, sample_rows int,"
        " columns array<string>, attempts int, reason string",
    )
