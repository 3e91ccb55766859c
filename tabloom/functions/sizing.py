"""Size checks for everything that travels to the driver or is broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

# Rows a fitted statistics table may have before it stops being collected or
# broadcast and is joined by shuffle instead.
SMALL_ROWS = 100_000


def collect_if_small(df: DataFrame, rows: int = SMALL_ROWS) -> list[Row] | None:
    """The rows of ``df`` when there are at most ``rows`` of them, else ``None``."""
    head = df.limit(rows + 1).collect()
    return head if len(head) <= rows else None


def join_by_size(
    big: DataFrame, small: DataFrame, on, how: str, small_rows: int | None
) -> DataFrame:
    """Join, broadcasting ``small`` only when its known row count is within bounds.

    ``small_rows`` is a count the caller already holds; ``None`` means unknown, in
    which case Spark decides from its own statistics and AQE splits skewed keys.
    """
    if small_rows is not None and small_rows <= SMALL_ROWS:
        return big.join(F.broadcast(small), on, how)
    return big.join(small, on, how)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder named by ``spark.checkpoint.dir``.

    The setting must point to storage every executor reaches.  Where it is unset a
    local session (tests) gets its own temporary folder; a cluster is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="tabloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession, "checkpoint"))
    return df.checkpoint(eager=True)
