"""Streams over files, run to the end with ``availableNow``: stateless, capped by source, and running totals."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from voxledger.operators.lookup import last_wins

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, path: str, schema: T.StructType, *, files_per_trigger: int = 64) -> DataFrame:
    """A Parquet table as a stream of its files: a directory of part files, or one file.

    A single file is watched for by its name in the directory above.
    """
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    directory = system.getFileStatus(hadoop_path).isDirectory()
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if directory:
        return reader.option("pathGlobFilter", "*.parquet").parquet(path)
    return reader.option("pathGlobFilter", hadoop_path.getName()).parquet(hadoop_path.getParent().toString())


def lookup_static(
    stream: DataFrame, dim: DataFrame, key: str, dim_key: str, value: str, *, position: str, out: str, default: str = ""
) -> DataFrame:
    """Stream joined with a static dimension; the default where it has no row.

    Of rows with one key the one at the greatest ``position`` counts, so no stream row is doubled.
    """
    table = last_wins(dim, dim_key, position, value).select(F.col(dim_key).alias("_key"), F.col(value).alias("_value"))
    joined = stream.join(table, stream[key] == table["_key"], "left")
    return joined.select(*stream.columns, F.coalesce("_value", F.lit(default)).alias(out))


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append the stream to Parquet files (exactly once per input file) and wait for its end."""
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()


def _first_of_task(source: str, limits: Mapping[str, int], order: Sequence[str]):
    """Keep the first rows of each source among what a task reads, so no more are shuffled."""
    keys = [(c, "ascending") for c in order]

    def cut(rows: pa.Table, n: int) -> pa.Table:
        return rows.take(pc.sort_indices(rows, sort_keys=keys, null_placement="at_start")[:n])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, pa.Table] = {}
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            for name in pc.unique(batch.column(source)).to_pylist():
                own = rows.filter(pc.equal(rows.column(source), name))
                own = pa.concat_tables([held[name], own]) if name in held else own
                # Cut once in a while, so a large limit is not sorted again for every batch.
                held[name] = cut(own, limits[name]) if own.num_rows > 2 * limits[name] + 10_000 else own
        for name, own in held.items():
            yield from cut(own, limits[name]).to_batches()

    return run


class _FirstRows(StatefulProcessor):
    """Counts the rows taken of a source, over triggers and restarts."""

    def __init__(self, limits: Mapping[str, int], order: Sequence[str]):
        self.limits, self.order = dict(limits), list(order)

    def init(self, handle) -> None:
        self.taken = handle.getValueState("taken", "n long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = self.taken.get()[0] if self.taken.exists() else 0
        left = self.limits[key[0]] - before
        # The state is a number; at most ``left`` rows are held.
        picked = heapq.nsmallest(left, rows, key=lambda r: [(r[c] is not None, r[c]) for c in self.order]) if left > 0 else []
        if picked:
            self.taken.update((before + len(picked),))
        yield from picked

    def close(self) -> None:
        pass


def cap_stream(stream: DataFrame, source: str, caps: Mapping[str, int | None], order: Sequence[str]) -> DataFrame:
    """First n rows of each source with a cap, over all triggers; sources without one pass through whole.

    Rows of an earlier trigger come first, those of one trigger in ``order`` (nulls first). Each task passes on at most
    n rows of a source, and the state of a source is one number. It needs the RocksDB
    state store: start it with :func:`run_capped`.
    """
    limits = {k: v for k, v in caps.items() if v is not None}
    if not limits:
        return stream
    capped = F.coalesce(F.col(source).isin(list(limits)), F.lit(False))
    few = stream.filter(capped).mapInArrow(_first_of_task(source, limits, order), stream.schema)
    first = few.groupBy(source).transformWithState(_FirstRows(limits, order), stream.schema, "append", "none")
    return first.unionByName(stream.filter(~capped))


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Queries that start inside keep their state in RocksDB, which keyed processors need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def run_capped(stream: DataFrame, path: str, checkpoint: str) -> None:
    """:func:`run_to_files` for a stream with a cap."""
    with rocksdb_state(stream.sparkSession):
        run_to_files(stream, path, checkpoint)


# Totals are stored in versions, one directory a batch; a pointer names the one that counts.
POINTER = "_current"


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def _point(spark: SparkSession, path: str, version: str) -> None:
    """Let the pointer name a version: written aside, then renamed over the old one."""
    jvm, folder, system = _files(spark, path)
    aside, pointer = (jvm.org.apache.hadoop.fs.Path(folder, name) for name in (f"{POINTER}-{version}", POINTER))
    out = system.create(aside, True)
    out.write(bytearray(version.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(folder.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(aside, pointer, options)


def _versions(spark: SparkSession, path: str) -> list[str]:
    """Versions that were written to their end, oldest first."""
    jvm, folder, system = _files(spark, path)
    if not system.exists(folder):
        return []
    names = [s.getPath().getName() for s in system.listStatus(folder)]
    whole = [n for n in names if re.fullmatch(r"v\d{19}", n) and system.exists(jvm.org.apache.hadoop.fs.Path(folder, f"{n}/_SUCCESS"))]
    return sorted(whole)


def current_version(spark: SparkSession, path: str) -> str | None:
    """The version that the pointer names; the newest whole one where a rename is under way."""
    jvm, folder, system = _files(spark, path)
    whole, pointer = _versions(spark, path), jvm.org.apache.hadoop.fs.Path(folder, POINTER)
    if system.exists(pointer):
        source = system.open(pointer)
        named = bytes(source.readAllBytes()).decode()
        source.close()
        if named in whole:
            return named
    return whole[-1] if whole else None


def read_totals(spark: SparkSession, path: str) -> DataFrame:
    """The stored totals of the last batch that was published."""
    version = current_version(spark, path)
    if version is None:
        raise FileNotFoundError(f"no totals at {path}")
    return spark.read.parquet(f"{path}/{version}")


def store_totals(batch: DataFrame, path: str, batch_id: int, keep: int = 2) -> None:
    """Store the totals of a batch as its version and publish it; a replayed batch gives the same table.

    Until the pointer is renamed, readers see the version before, whatever dies in between. Versions but the last
    ``keep`` are taken away afterwards.
    """
    spark, version = batch.sparkSession, f"v{batch_id:019d}"
    batch.write.mode("overwrite").parquet(f"{path}/{version}")
    _point(spark, path, version)
    jvm, folder, system = _files(spark, path)
    for old in [v for v in _versions(spark, path) if v < version][: -(keep - 1) or None]:
        system.delete(jvm.org.apache.hadoop.fs.Path(folder, old), True)


def run_totals(totals: DataFrame, path: str, checkpoint: str) -> None:
    """Publish the totals after each trigger and wait for the end; :func:`read_totals` reads them.

    ``complete`` mode keeps one state row per group; the last table equals the batch result.
    """
    query = (
        totals.writeStream.foreachBatch(lambda batch, k: store_totals(batch, path, k))
        .option("checkpointLocation", checkpoint)
        .outputMode("complete")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
