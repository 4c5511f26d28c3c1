"""Cutting lineage in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows of one key that a join still leaves in one task.
SPLIT_ROWS, SPLIT_WAYS = 100_000, 32


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset: a temporary folder in local mode, an error on a cluster."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if d is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        d = tempfile.mkdtemp(prefix="kvspark-")
        spark.sparkContext.setCheckpointDir(d)
        d = spark.sparkContext.getCheckpointDir()
    return d


_left: dict[str, set[str]] = {}


def scratch(spark: SparkSession) -> str:
    """A new folder's name below the shared folder; what is still there when Python ends is removed."""
    path = f"{shared_dir(spark)}/kvspark-{uuid.uuid4().hex}"
    app = spark.sparkContext.applicationId
    if app not in _left:
        _left[app] = set()
        atexit.register(_sweep, spark, app)
    _left[app].add(path)
    return path


def _sweep(spark: SparkSession, app: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before Python does
        for path in list(_left.get(app, ())):
            removed(spark, path)


def saved(df: DataFrame) -> DataFrame:
    """``df`` computed once, written to the shared folder and read from there from now on."""
    return kept(df)[0]


def kept(df: DataFrame) -> tuple[DataFrame, str]:
    """Like ``saved``, with the folder, for ``removed`` once nothing reads it any more."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it lies."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _left.get(spark.sparkContext.applicationId, set()).discard(path)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text alone, in the types that the Arrow operators declare."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def smallest_hashes(df: DataFrame, rows: int, wanted: int, *cols: str) -> DataFrame:
    """Of ``df``'s ``rows`` rows those whose hash of ``cols`` is small: all if few are wanted of few, else about twice ``wanted``.

    A filter, so that a top-k by the same hash that follows gets a bounded number of
    rows however many tasks there are.
    """
    share = min(1.0, (2 * wanted + 50) / max(1, rows))
    return df if share == 1 else df.filter(F.xxhash64(*cols) / F.lit(2.0**64) + 0.5 < share)


def join_once(rows: DataFrame, one: DataFrame, on: list[str], n: str, salt: Column, most: int) -> DataFrame:
    """``rows``, ``most`` of them at most, joined with ``one``, which has a row a key and the number ``n`` of rows under it.

    Keys of more than SPLIT_ROWS rows are dealt to SPLIT_WAYS tasks by ``salt``. Such keys
    are at most one in SPLIT_ROWS rows: 1.6 MB of keys for 10^10 rows, so their list can be broadcast.
    """
    if most <= SPLIT_ROWS:
        return rows.join(one.drop(n), on)
    few = F.broadcast(one.filter(F.col(n) > SPLIT_ROWS).select(*on, F.lit(SPLIT_WAYS).alias("ways")))
    ways = F.coalesce("ways", F.lit(1))
    dealt = rows.join(few, on, "left").withColumn("join_salt", F.pmod(F.xxhash64(salt), ways).cast("int")).drop("ways")
    copies = one.withColumn("join_salt", F.explode(F.when(F.col(n) > SPLIT_ROWS, F.sequence(F.lit(0), F.lit(SPLIT_WAYS - 1))).otherwise(F.array(F.lit(0))))).drop(n)
    return dealt.join(copies, [*on, "join_salt"]).drop("join_salt")
