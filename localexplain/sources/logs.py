"""Timing logs and timing tables."""

from __future__ import annotations

import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from localexplain import schemas

LINES = "file STRING, chunk BIGINT, seq BIGINT, value STRING"
# Columns a timing table must have.
REQUIRED_TIMINGS = ("D", "B", "gpu_gen", "gpu_infer", "gpu_weights", "gpu_total", "cpu_total")
LINES_PER_CHUNK = 1 << 16


def read_timing_logs(spark: SparkSession, path, missing_ok: bool = True) -> DataFrame:
    """Log lines as (file, chunk, seq, value); order in a file is (chunk, seq).

    Files are split like any text source: ``chunk`` is the byte offset of the split and ``seq`` the
    read order inside it, so a huge log is neither one row nor one task.  A missing file gives a
    warning and no lines, or an error with ``missing_ok=False``.
    """
    try:
        text = spark.read.text(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        if not missing_ok:
            raise FileNotFoundError(f"timing log not found: {path}") from e
        warnings.warn(f"timing log not found: {path}; skipped")
        return spark.createDataFrame([], LINES)
    return text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("chunk"),
        F.monotonically_increasing_id().alias("seq"),
        "value",
    )


def number_lines(lines: DataFrame, order: str = "line_no", per_chunk: int = LINES_PER_CHUNK) -> DataFrame:
    """(file, line number, value) tables in the layout of ``read_timing_logs``."""
    return lines.select(
        "file", F.floor(F.col(order) / per_chunk).cast("bigint").alias("chunk"),
        F.col(order).cast("bigint").alias("seq"), "value",
    )


def write_timings(merged: DataFrame, path: str) -> None:
    """CSV with header, sorted by (D, B); blanks where a device is missing; nothing to write is an error."""
    if merged.isEmpty():
        raise ValueError("the table of timings is empty")
    merged.orderBy("D", "B").write.mode("overwrite").option("header", True).csv(path)


def read_timings(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).csv(path)
    missing = sorted(set(REQUIRED_TIMINGS) - set(raw.columns))
    if missing:
        raise ValueError(f"a timing table also needs {', '.join(missing)}")
    types = dict(f.strip().split(" ") for f in schemas.TIMINGS.split(","))
    return raw.select(*[F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in raw.columns])
