"""Sorted runs: Parquet folders, range-partitioned and sorted by key, with bloom filters and page checksums."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

import pyarrow as pa
import pyarrow.parquet as pq
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, DataFrameReader, Observation, SparkSession, functions as F

from ..errors import CorruptDataError
from ..functions.values import DELETE, LOG
from .manifest import Mutation, Run
from .store import Hadoop, Local

OPTIONS = {
    "parquet.bloom.filter.enabled#key": "true",
    "parquet.page.write-checksum.enabled": "true",
    "compression": "zstd",
}


def dealt(log: DataFrame, merge: Callable[[DataFrame], DataFrame] | None = None, partitions: int | None = None) -> DataFrame:
    """The rows of a run: dealt by ranges of the key once, then merged and sorted where they lie.

    A range of keys holds all entries of its keys, so the aggregation by key of
    ``merge`` doesn't shuffle again.
    """
    ranges = log.repartitionByRange(partitions, "key") if partitions else log.repartitionByRange("key")
    rows = merge(ranges) if merge else ranges
    return rows.select(*(F.col(c).cast(LOG[c].dataType).alias(c) for c in LOG.names))


def write_run(log: DataFrame, folder: str, unique: bool, partitions: int | None = None, merge: Callable[[DataFrame], DataFrame] | None = None) -> Run:
    """Write a log's rows as one run. Its statistics are observed while it is written, not by another pass."""
    seen = Observation()
    statistics = (
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("op") == DELETE).alias("tombstones"),
        F.min("key").alias("least"),
        F.max("key").alias("most"),
        F.count_if(F.col("key").isNull()).alias("nulls"),
    )
    name = f"runs/{uuid.uuid4().hex}"
    writer = dealt(log, merge, partitions).sortWithinPartitions("key").observe(seen, *statistics).write
    for k, v in OPTIONS.items():
        writer = writer.option(k, v)
    writer.parquet(os.path.join(folder, name))
    try:
        got = seen.get
    except Py4JError:  # a plan found to be empty while it runs drops the observation
        got = reader(log.sparkSession).parquet(os.path.join(folder, name)).agg(*statistics).first()
    if got["nulls"]:
        raise ValueError("a key is null")
    return Run(name, got["rows"], got["tombstones"], *(None if got[k] is None else bytes(got[k]) for k in ("least", "most")), unique)


#: The schema of a run for Arrow.
_ARROW = pa.schema(
    [
        pa.field("key", pa.binary(), False),
        pa.field("op", pa.string(), False),
        pa.field("value", pa.struct([("kind", pa.string()), ("i", pa.int32()), ("f", pa.float64()), ("t", pa.string()), ("b", pa.bool_()), ("d", pa.binary())])),
        pa.field("cv", pa.int64(), False),
        pa.field("ord", pa.int32(), False),
    ]
)


def write_small(entries: list[tuple[int, Mutation]], store: Local | Hadoop) -> Run:
    """A run of a few mutations, the newest of each key, written by the driver without a job; synced when it returns.

    The file is like those of ``write_run``, but has no bloom filter: it is small, and its keys are held while it is looked up.
    """
    newest = {m.key: (cv, m) for cv, m in entries}
    keys = sorted(newest)
    rows = [newest[k] for k in keys]
    fields = [f.name for f in _ARROW.field("value").type]
    # plain columns, since rows as dictionaries are slow to convert
    flat = [m.value.row() if m.value else (None,) * len(fields) for _, m in rows]
    children = [pa.array(c, t.type) for c, t in zip(zip(*flat), _ARROW.field("value").type)]
    value = pa.StructArray.from_arrays(children, fields, mask=pa.array([m.value is None for _, m in rows]))
    table = pa.table([pa.array(keys, pa.binary()), pa.array([m.op for _, m in rows]), value, pa.array([cv for cv, _ in rows], pa.int64()), pa.array([m.ord for _, m in rows], pa.int32())], schema=_ARROW)
    name = f"runs/{uuid.uuid4().hex}"
    out = pa.BufferOutputStream()
    pq.write_table(table, out, compression="zstd", write_page_checksum=True)
    store.write(f"{name}/part-00000.parquet", out.getvalue().to_pybytes())
    return Run(name, len(rows), sum(m.value is None for _, m in rows), keys[0], keys[-1], True)


def reader(spark: SparkSession) -> DataFrameReader:
    """For runs by their paths as they stand: a table's name may hold what would else be a pattern."""
    return spark.read.schema(LOG).option("__globPaths__", "false")


def read_runs(spark: SparkSession, folder: str, runs: list[Run]) -> DataFrame:
    """All rows of some runs in one scan; page checksums are verified."""
    paths = [os.path.join(folder, r.path) for r in runs if r.rows]
    if not paths:
        return spark.createDataFrame([], LOG)
    return reader(spark).option("parquet.page.verify-checksum.enabled", "true").parquet(*paths)


def checked(action):
    """Run an action over runs; a damaged file is a CorruptDataError."""
    try:
        return action()
    except (PySparkException, Py4JError) as e:
        text = str(e)
        if any(sign in text for sign in ("CRC", "checksum", "CANNOT_READ_FILE", "not a Parquet file", "FAILED_READ_FILE")):
            raise CorruptDataError(text[:500]) from e
        raise
