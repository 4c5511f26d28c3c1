"""Access paths over a resolved state (key, value): lookups, scans, ranges, prefixes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.bounds import Bound, prefix_bounds, within

#: Requests that still go into the plan as literals, so that they reach the scan as a key list.
LITERAL_KEYS = 1024


def get(state: DataFrame, key: bytes) -> DataFrame:
    """The row of a key, or none."""
    return state.filter(F.col("key") == F.lit(bytes(key)))


def contains(state: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests`` (key, ...) with ``found``. Reads keys only."""
    keys = state.select("key").withColumn("found", F.lit(True))
    return requests.join(keys, "key", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def multi_get(state: DataFrame, keys: Sequence[bytes]) -> DataFrame:
    """pos, key, value: a row a request, in request order, duplicates kept, null for a miss."""
    spark = state.sparkSession
    requests = spark.createDataFrame([(i, bytearray(k)) for i, k in enumerate(keys)], "pos int, key binary")
    if 0 < len(set(keys)) <= LITERAL_KEYS:
        # the list reaches the Parquet scan; what is left is at most one row a key
        state = state.filter(F.col("key").isin([bytearray(k) for k in set(keys)]))
    return multi_get_df(state, requests).orderBy("pos")


def multi_get_df(state: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests`` (pos, key) with value, for requests of any number: an outer join that Spark plans by their sizes."""
    return requests.join(state, "key", "left").select("pos", "key", "value")


def scan_range(state: DataFrame, low: Bound, high: Bound) -> DataFrame:
    """Keys within general bounds, ascending by unsigned bytes."""
    return state.filter(within(low, high)).orderBy("key")


def scan(state: DataFrame) -> DataFrame:
    return state.orderBy("key")


def half_open(state: DataFrame, start: bytes, end: bytes) -> DataFrame:
    """start <= key < end."""
    return scan_range(state, Bound.included(start), Bound.excluded(end))


def scan_prefix(state: DataFrame, prefix: bytes) -> DataFrame:
    """Keys that begin with a prefix, as a range, so that it is pushed into the scan."""
    return scan_range(state, *prefix_bounds(prefix))
