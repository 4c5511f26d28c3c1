"""The one idea: of all mutations of a key, the newest committed one holds.

Only predicates on the key may go below ``newest``; Catalyst pushes those into the
Parquet scan by itself, and can't push others, since values are aggregate results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.values import DELETE, PUT


def newest(log: DataFrame, *order: str) -> DataFrame:
    """key, op, value: the entry of each key with the greatest version, deletions included.

    One shuffle by key with map-side combining. op and value are wrapped in a struct,
    so that a deletion's null value is kept.
    """
    version = F.struct(*(order or ("cv", "ord")))
    return log.groupBy("key").agg(F.max_by(F.struct("op", "value"), version).alias("entry")).select("key", "entry.op", "entry.value")


def newest_versions(log: DataFrame) -> DataFrame:
    """Like ``newest``, with the version of each entry: key, op, value, cv, ord.

    Over rows already dealt by ranges of the key this needs no shuffle of its own.
    """
    at = F.struct("cv", "ord")
    top = log.groupBy("key").agg(F.max_by(F.struct("op", "value"), at).alias("e"), F.max(at).alias("v"))
    return top.select("key", "e.op", "e.value", "v.cv", "v.ord")


def live(entries: DataFrame) -> DataFrame:
    """key, value of the entries that are not deletions. Always above ``newest``."""
    return entries.filter(F.col("op") == PUT).select("key", "value")


def state(log: DataFrame, *order: str) -> DataFrame:
    """key, value of every visible key."""
    return live(newest(log, *order))


def layered(*layers: DataFrame) -> DataFrame:
    """A log of layers given oldest first: the later layer wins, whatever the entries' own numbers."""
    parts = [d.select("key", "op", "value", F.lit(k).cast("bigint").alias("cv"), F.lit(0).alias("ord")) for k, d in enumerate(layers)]
    return reduce(DataFrame.unionByName, parts)


def overlay(snapshot: DataFrame, pending: DataFrame, *order: str) -> DataFrame:
    """What a transaction sees: its own mutations over a snapshot's log."""
    names = order or ("cv", "ord")
    below = snapshot.select("key", "op", "value", F.lit(0).alias("over"), F.struct(*names).alias("at"))
    above = pending.select("key", "op", "value", F.lit(1).alias("over"), F.struct(*(F.col(n).cast(snapshot.schema[n].dataType).alias(n) for n in names)).alias("at"))
    return below.unionByName(above)


def last_per_key(batch: DataFrame, order: Column | str = "ord") -> DataFrame:
    """One mutation a key of a batch: the one written last."""
    return batch.groupBy("key").agg(F.max_by(F.struct("op", "value"), order).alias("e"), F.max(order).alias("ord")).select("key", "e.op", "e.value", "ord")


def committed(log: DataFrame, position: str, is_commit: Column) -> DataFrame:
    """The mutations at or before the last COMMIT; the uncommitted tail is cut off.

    The cut is a scalar subquery over the markers alone, so the log is read with a
    plain filter, without a join.
    """
    return log.filter(~is_commit & (F.col(position) <= _last(log, position, is_commit)))


def uncommitted(log: DataFrame, position: str, is_commit: Column) -> DataFrame:
    """The tail that recovery drops; everything if nothing was committed."""
    cut = _last(log, position, is_commit)
    return log.filter(~is_commit & ((F.col(position) > cut) | cut.isNull()))


def _last(log: DataFrame, position: str, is_commit: Column) -> Column:
    return log.filter(is_commit).agg(F.max(position)).scalar()


def by_rank(log: DataFrame, *order: str) -> DataFrame:
    """``newest`` by a ranked window instead; same rows, other plan (Spark limits the window per group)."""
    w = Window.partitionBy("key").orderBy(*(F.desc(c) for c in order or ("cv", "ord")))
    return log.withColumn("rank", F.row_number().over(w)).filter("rank = 1").select("key", "op", "value")


def is_deleted() -> Column:
    return F.col("op") == DELETE
