"""Writers.  Each task writes its own part files; nothing is gathered first."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxledger.functions.text import strip_ws


def write_json_lines(df: DataFrame, path: str, *, mode: str = "error") -> None:
    """One JSON record per line, non-ASCII text as it is: splittable on reading."""
    df.write.mode(mode).json(path)


#: Characters that one array file may hold, but for a longer single record.
ARRAY_CHARS = 16_000_000


def _as_arrays(most: int):
    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(["[" + "\n,".join(held) + "\n]"], pa.string())], ["value"])

        held, size, written = [], 0, False
        for batch in batches:
            for line in batch.column(0).to_pylist():
                if held and size + len(line) > most:
                    yield closed()
                    held, size, written = [], 0, True
                held.append(line)
                size += len(line)
        if held or not written:
            yield closed()

    return arrays


def write_json_array(df: DataFrame, path: str, *, mode: str = "error") -> None:
    """Part files that each hold one JSON array of records, none larger than one task should read."""
    records = df.select(F.to_json(F.struct(*df.columns)).alias("value"))
    arrays = records.mapInArrow(_as_arrays(ARRAY_CHARS), "value string")
    arrays.write.mode(mode).option("compression", "none").option("maxRecordsPerFile", 1).text(path)


def write_csv(df: DataFrame, path: str, *, mode: str = "error") -> None:
    """CSV with a header and doubled quotes; nulls are empty fields."""
    df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_partitioned(
    df: DataFrame, path: str, *by: str, mode: str = "error", format: str = "json", gather: bool = False
) -> None:
    """One directory per value of the ``by`` columns.

    ``gather`` brings the rows of a value together, for few files; adaptive execution splits a large
    value over as many tasks as its bytes need.
    """
    if gather:
        df = df.hint("rebalance", *by)
    df.write.mode(mode).partitionBy(*by).format(format).save(path)


def write_text(df: DataFrame, column: str, path: str, *, mode: str = "error") -> None:
    """One stripped text per line.

    A line break inside a text would look like two lines to a reader, so it becomes a space.
    """
    one_line = F.regexp_replace(strip_ws(column), r"[\r\n]+", " ")
    df.select(F.coalesce(one_line, F.lit("")).alias("value")).write.mode(mode).text(path)
