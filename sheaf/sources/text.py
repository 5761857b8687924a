"""Line-oriented log sources (A1 memory logs, A2 conversion logs).

File order matters to several operators, and a distributed text read has no row
order. Every line therefore carries an explicit order key:

* ``log_id``  - the file path (one log per file),
* ``block``   - byte offset of the split the line came from, plus one for every ``BLOCK_LINES`` lines
  read with it: a compressed log is a single split, and still many blocks,
* ``line_no`` - a per-split increasing id.

``(log_id, block, line_no)`` sorts lines exactly as they appear in their files,
however the files were split. ``block`` doubles as the bucket that lets a
carry-forward over one huge log run in many tasks (see ``operators.carry``).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE_COLUMNS = ("log_id", "block", "line_no", "line")
BLOCK_LINES = 100_000
"""Lines of a block. Blocks of a split stay below the offset of the next one: that takes more bytes than there are blocks."""


def read_log_lines(spark: SparkSession, paths, recursive: bool = False, block_lines: int = BLOCK_LINES) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    number = F.monotonically_increasing_id()
    within = number.bitwiseAND(F.lit((1 << 33) - 1))  # rows before it in its task
    return reader.text(paths).select(
        F.col("_metadata.file_path").alias("log_id"),
        (F.col("_metadata.file_block_start") + F.floor(within / F.lit(block_lines))).cast("long").alias("block"),
        number.alias("line_no"),
        F.col("value").alias("line"),
    )


def stream_log_lines(spark: SparkSession, path: str, block_lines: int = BLOCK_LINES, **options) -> DataFrame:
    """Lines of arriving logs in the same columns and order; large files are read in splits by many tasks.

    ``line_no`` counts the lines of a split (a stream cannot number rows itself, so a task counts them as they pass).
    """
    def numbered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n = None, 0
        for b in batches:
            logs, starts = b.column(0).to_pylist(), b.column(1).to_pylist()
            numbers = []
            for key in zip(logs, starts):
                if key != at:
                    at, n = key, 0
                numbers.append(n)
                n += 1
            block = [s + k // block_lines for s, k in zip(starts, numbers)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(block, pa.int64()), pa.array(numbers, pa.int64()), b.column(2)],
                                             list(LINE_COLUMNS))

    lines = spark.readStream.options(**options).text(path).select(
        F.col("_metadata.file_path").alias("log_id"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"))
    return lines.mapInArrow(numbered, "log_id string, block long, line_no long, line string")


def lines_from_column(df: DataFrame, line_col: str, order_col: str, log_id=None,
                      block_size: int = 4096) -> DataFrame:
    """Adapt an already-ordered table of lines to the line schema.

    ``order_col`` is a long that gives file order; ``block`` groups it into runs of
    ``block_size`` lines so that order-dependent operators still split the work.
    """
    log = F.lit("log") if log_id is None else (F.col(log_id).cast("string") if isinstance(log_id, str) else log_id)
    return df.select(
        log.alias("log_id"),
        F.floor(F.col(order_col) / F.lit(block_size)).cast("long").alias("block"),
        F.col(order_col).cast("long").alias("line_no"),
        F.col(line_col).alias("line"),
    )
