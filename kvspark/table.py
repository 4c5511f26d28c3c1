"""A table: a log of commits and runs, read as DataFrames, written by one writer."""

from __future__ import annotations

import os
from collections.abc import Iterable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from .errors import UnexpectedValueError
from .functions import values as V
from .functions.bounds import Bound, holds, overlaps, prefix_bounds, within
from .operators import access, resolve
from .sources.blocks import ASK_SPARK, BlockCache
from .sources.manifest import Commit, Commits, Mutation, Run, State
from .sources.runs import checked, read_runs, reader, write_run, write_small
from .sources.store import place

#: Bytes of buffered small mutations that trigger a flush, and runs beyond which some are merged.
BUFFER_BUDGET, MAX_RUNS = 4 << 20, 8
#: A merge of the newest runs takes in the one before them while that is at most so many times as large.
TIER = 4


def _key(k: Any) -> bytes:
    if not isinstance(k, (bytes, bytearray, memoryview)):
        raise TypeError("a key is bytes")
    return bytes(k)


class Table:
    """Small mutations are committed in the manifest and held in a driver-side buffer; bulk ones go straight to a run.

    The bytes interface (``get``, ``scan``, ...) reads cells of kind bytes and raises
    UnexpectedValueError for others; the typed one (``get_value``, ``df``) reads any.
    """

    def __init__(self, spark: SparkSession, folder: str, budget: int = BUFFER_BUDGET, max_runs: int = MAX_RUNS):
        self.spark, self.folder, self.budget, self.max_runs = spark, folder, budget, max_runs
        self._store = place(spark, folder)
        self._store.make()
        self._lock = self._store.lock()
        self._blocks = BlockCache(folder)
        try:
            self._commits = Commits(self._store)
            self._state: State = self._commits.state()
        except BaseException:
            self._lock.release()
            raise
        self._index()

    def _index(self) -> None:
        """The buffer's newest mutation of each key, and its size."""
        self._buffer: dict[bytes, Mutation] = {}
        self._bytes = 0
        for _, m in self._state.entries:
            self._remember(m)

    def _remember(self, m: Mutation) -> None:
        self._buffer[m.key] = m
        self._bytes += len(m.key) + (m.value.footprint() if m.value else 0)

    # --- life ---------------------------------------------------------------

    def close(self) -> None:
        self._lock.release()

    def __enter__(self) -> Table:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    @property
    def version(self) -> int:
        return self._state.version

    @property
    def runs(self) -> list:
        return list(self._state.runs)

    @property
    def pending_bytes(self) -> int:
        return self._bytes

    def set_budget(self, budget: int) -> None:
        self.budget = budget

    # --- the log ------------------------------------------------------------

    def _pending(self, entries: Iterable[tuple[int, Mutation]]) -> DataFrame:
        rows = [(bytearray(m.key), m.op, m.value and m.value.row(), cv, m.ord) for cv, m in entries]
        return self.spark.createDataFrame(rows, V.LOG)

    def pending_df(self) -> DataFrame:
        """The unflushed layer, deletions included: key, op, value."""
        return resolve.newest(self._pending(self._state.entries)).orderBy("key")

    def log_df(self, version: int | None = None, low: Bound = Bound(), high: Bound = Bound()) -> DataFrame:
        """Every stored mutation of a version; runs whose keys lie outside the bounds are not even opened."""
        s = self._state if version is None else self._commits.state(version)
        runs = [r for r in s.runs if overlaps(low, high, r.least, r.most)]
        entries = [(cv, m) for cv, m in s.entries if holds(low, high, m.key)]
        log = read_runs(self.spark, self.folder, runs)
        return log.unionByName(self._pending(entries)) if entries else log

    def raw_log_df(self) -> DataFrame:
        """Every mutation still on disk, with ``committed``: false for runs that no commit names (left by a crash)."""
        there = {f"runs/{n}" for n in self._store.names("runs")}
        commits = [self._commits.read(v) for v in self._commits.versions()]
        named = {r.path for c in commits for r in c.runs}
        log = self._pending((c.version, m) for c in commits if not c.snapshot for m in c.entries).withColumn("committed", F.lit(True))
        for paths, committed in ((there & named, True), (there - named, False)):
            if paths:
                rows = reader(self.spark).parquet(*(os.path.join(self.folder, p) for p in sorted(paths)))
                log = log.unionByName(rows.withColumn("committed", F.lit(committed)))
        # a flushed entry lies in its commit and in its run
        return log.dropDuplicates(["key", "op", "cv", "ord", "committed"])

    def df(self, version: int | None = None, low: Bound = Bound(), high: Bound = Bound(), keys: DataFrame | None = None) -> DataFrame:
        """key, value of every visible key within the bounds, and of ``keys`` (key) if given; unordered, lazy.

        The keys cut the log down before anything is merged: a predicate on the key may
        go below the resolution.

        Runs without repeated keys whose key range meets no other run's and no buffered
        key are read as they are; only the others are merged, by one shuffle.
        """
        s = self._state if version is None else self._commits.state(version)
        runs = [r for r in s.runs if overlaps(low, high, r.least, r.most)]
        entries = [(cv, m) for cv, m in s.entries if holds(low, high, m.key)]
        alone = [r for r in runs if r.unique and not any(_meet(r, o) for o in runs if o is not r) and not any(r.least <= m.key <= r.most for _, m in entries)]
        mixed = [r for r in runs if r not in alone]
        parts = []

        def cut(log: DataFrame) -> DataFrame:
            log = log.filter(within(low, high))
            return log if keys is None else log.join(keys, "key", "left_semi")

        if alone:
            parts.append(resolve.live(cut(read_runs(self.spark, self.folder, alone))))
        if mixed or entries or not alone:
            log = read_runs(self.spark, self.folder, mixed)
            log = cut(log.unionByName(self._pending(entries)) if entries else log)
            parts.append(resolve.state(log) if mixed or entries else resolve.live(log))
        return reduce(DataFrame.unionByName, parts)

    # --- reads --------------------------------------------------------------

    def get_value(self, key: bytes) -> V.Value | None:
        """The typed cell of a key, or None."""
        key = _key(key)
        m = self._buffer.get(key)
        if m is not None:
            return m.value
        found = self._blocks.find(self._state.runs, key)
        if found is not ASK_SPARK:
            return found
        at = Bound.included(key)
        found = checked(lambda: self.df(low=at, high=at).take(1))
        return V.Value.from_row(found[0]["value"]) if found else None

    def get(self, key: bytes) -> bytes | None:
        v = self.get_value(key)
        return None if v is None else v.as_bytes()

    def contains(self, key: bytes) -> bool:
        return self.get(key) is not None

    def get_batch(self, keys: Sequence[bytes]) -> list[bytes | None]:
        """One answer a request, in request order."""
        found = {bytes(r["key"]): V.Value.from_row(r["value"]) for r in self._few({_key(k) for k in keys})}
        return [found[bytes(k)].as_bytes() if bytes(k) in found else None for k in keys]

    def _few(self, keys: set[bytes]) -> list[Row]:
        if not keys:
            return []
        low, high = Bound.included(min(keys)), Bound.included(max(keys))
        state = self.df(low=low, high=high)
        if len(keys) <= access.LITERAL_KEYS:
            return checked(state.filter(F.col("key").isin([bytearray(k) for k in keys])).collect)
        asked = self.spark.createDataFrame([(bytearray(k),) for k in keys], "key binary")
        return checked(self.df(low=low, high=high, keys=asked).collect)

    def multi_get_df(self, requests: DataFrame) -> DataFrame:
        """``requests`` (pos, key) with value (a struct), any number of them."""
        return access.multi_get_df(self.df(keys=requests.select("key").distinct()), requests)

    def _bytes_view(self, state: DataFrame) -> DataFrame:
        return state.select("key", V.byte_view().alias("value"))

    def scan_range(self, low: Bound = Bound(), high: Bound = Bound()) -> DataFrame:
        """Typed scan with general bounds, ascending."""
        return self.df(low=low, high=high).orderBy("key")

    def scan_df(self) -> DataFrame:
        """key, value (bytes), ascending; raises on a cell of another kind when it runs."""
        return self._bytes_view(self.df()).orderBy("key")

    def range_df(self, start: bytes, end: bytes) -> DataFrame:
        return self._bytes_view(self.df(low=Bound.included(start), high=Bound.excluded(end))).orderBy("key")

    def prefix_df(self, prefix: bytes) -> DataFrame:
        low, high = prefix_bounds(prefix)
        return self._bytes_view(self.df(low=low, high=high)).orderBy("key")

    def scan(self) -> list[tuple[bytes, bytes]]:
        return self._pairs(self.scan_df())

    def range(self, start: bytes, end: bytes) -> list[tuple[bytes, bytes]]:
        return self._pairs(self.range_df(start, end))

    def scan_prefix(self, prefix: bytes) -> list[tuple[bytes, bytes]]:
        return self._pairs(self.prefix_df(prefix))

    @staticmethod
    def _pairs(df: DataFrame) -> list[tuple[bytes, bytes]]:
        try:
            return [(bytes(r["key"]), bytes(r["value"])) for r in checked(df.collect)]
        except Exception as e:
            if "UnexpectedValue:" in str(e):
                raise UnexpectedValueError(str(e)[:300]) from e
            raise

    # --- what is known of the runs ----------------------------------------------

    def key_range(self) -> tuple[bytes, bytes] | None:
        """Smallest and largest key of the runs, deletions included, from the manifest alone."""
        ranges = [(r.least, r.most) for r in self._state.runs if r.rows]
        return (min(a for a, _ in ranges), max(b for _, b in ranges)) if ranges else None

    def might_contain(self, key: bytes) -> bool:
        """False: no run holds an entry of the key. True: one does (the scan is pruned by the key's bloom filter)."""
        at = Bound.included(_key(key))
        runs = [r for r in self._state.runs if overlaps(at, at, r.least, r.most)]
        found = read_runs(self.spark, self.folder, runs).filter(within(at, at)).select("key")
        return bool(runs) and bool(checked(lambda: found.take(1)))

    def run_stats(self) -> DataFrame:
        """path, rows, tombstones, least, most, blocks (null where lookups are left to Spark) of each run, oldest first."""
        rows = [(i, r.path, r.rows, r.tombstones, *(None if k is None else bytearray(k) for k in (r.least, r.most)), self._blocks.count(r)) for i, r in enumerate(self._state.runs)]
        return self.spark.createDataFrame(rows, "layer int, path string, rows bigint, tombstones bigint, least binary, most binary, blocks int")

    def cached(self) -> DataFrame:
        """The current version's state, kept in the executors' memory until ``unpersist`` is called on it."""
        return self.df().persist()

    # --- writes -------------------------------------------------------------

    def _commit(self, commit: Commit) -> None:
        self._commits.publish(commit)
        self._state.apply(commit)
        if commit.snapshot:
            self._index()
            self._blocks.clear()
        for m in () if commit.snapshot else commit.entries:
            self._remember(m)

    def write(self, mutations: Iterable[tuple[bytes, Any]], tag: str | None = None) -> None:
        """Atomic batch of (key, value or None for a deletion); the last one of a key holds. Nothing to do is no commit."""
        last: dict[bytes, V.Value | None] = {}
        for k, v in mutations:
            last[_key(k)] = None if v is None else V.Value.of(v)
        if not last:
            return
        entries = tuple(Mutation(k, last[k], i) for i, k in enumerate(sorted(last)))
        self._commit(Commit(self.version + 1, entries=entries, tag=tag))
        if self._bytes >= self.budget:
            self.flush()

    def put(self, key: bytes, value: bytes) -> None:
        self.write([(key, V.Value("bytes", bytes(value)))])

    def set_value(self, key: bytes, value: Any) -> str:
        self.write([(key, V.Value.of(value))])
        return "Inserted value"

    def delete(self, key: bytes) -> None:
        """Idempotent; nothing is read first."""
        self.write([(key, None)])

    def delete_value(self, key: bytes) -> str:
        self.delete(key)
        return "Deleted value"

    def put_batch(self, pairs: Iterable[tuple[bytes, bytes]]) -> None:
        self.write([(k, V.Value("bytes", bytes(v))) for k, v in pairs])

    def put_df(self, rows: DataFrame, order: str | None = None, tag: str | None = None) -> None:
        """Atomic bulk batch from a DataFrame (key, value [, op]); value may be the struct or one of its kinds.

        ``op`` 'D' deletes. Of repeated keys the row with the greatest ``order``
        holds; without an order, the greatest (op, value).
        """
        if tag is not None and self._state.done(tag):
            return
        self.flush()  # so the buffer is always newer than every run
        kinds = {"int": "integer", "double": "float", "string": "text", "boolean": "boolean", "binary": "bytes"}
        kind = dict(rows.dtypes)["value"]
        value = V.typed(kinds[kind], F.col("value")) if kind in kinds else F.col("value").cast(V.VALUE)
        op = F.col("op") if "op" in rows.columns else F.lit(V.PUT)
        log = rows.select("key", op.alias("op"), F.when(op == V.PUT, value).alias("value"), (F.col(order) if order else F.struct(op, value)).alias("ord"))

        def last(ranges: DataFrame) -> DataFrame:
            return resolve.last_per_key(ranges).select("key", "op", "value", F.lit(self.version + 1).alias("cv"), F.lit(0).alias("ord"))

        run = write_run(log, self.folder, unique=True, merge=last)
        if not run.rows:
            self._store.remove(run.path)
            return
        self._commit(Commit(self.version + 1, runs=(run,), tag=tag))
        self._maybe_compact()

    def transaction(self):
        from .txn import Txn

        return Txn(self)

    # --- maintenance ----------------------------------------------------------

    def flush(self) -> None:
        """Fold the buffer into a run; nothing to do if it is empty."""
        if not self._state.entries:
            return
        self._replace((*self._state.runs, write_small(self._state.entries, self._store)), ())
        self._maybe_compact()

    def _replace(self, runs: tuple[Run, ...], entries: tuple[Mutation, ...]) -> None:
        """Commit a snapshot: these runs, and entries newer than all of them."""
        self._commit(Commit(self.version + 1, runs=runs, entries=entries, snapshot=True, tags=tuple(sorted(self._state.tags.items()))))

    def _maybe_compact(self) -> None:
        """Beyond ``max_runs``, merge the newest runs: at least two, and older ones as far as they aren't much larger."""
        runs = self._state.runs
        if len(runs) <= self.max_runs:
            return
        first, rows = len(runs) - 1, runs[-1].rows
        while first and (first == len(runs) - 1 or runs[first - 1].rows <= TIER * rows):
            first -= 1
            rows += runs[first].rows
        self._merge(first)

    def compact(self) -> None:
        """Merge all runs into one without deletions, or into none if nothing is left.

        The buffer is newer than every run and stays as it is. A single run is rewritten
        only if it holds deletions.
        """
        runs = self._state.runs
        if runs and (len(runs) > 1 or runs[0].tombstones):
            self._merge(0)

    def _merge(self, first: int) -> None:
        """Merge the runs from a place on. Deletions go only if no older run is left that they might hide entries of."""
        runs = self._state.runs

        def merged(ranges: DataFrame) -> DataFrame:
            rows = resolve.newest_versions(ranges)
            return rows if first else rows.filter(F.col("op") == V.PUT)

        log = read_runs(self.spark, self.folder, runs[first:])
        run = checked(lambda: write_run(log, self.folder, unique=True, merge=merged))
        # carried entries get a newer version than the run, as they had; their own order is kept by the buffer
        latest = {m.key: m for _, m in self._state.entries}
        carried = tuple(Mutation(k, latest[k].value, i) for i, k in enumerate(sorted(latest)))
        self._replace((*runs[:first], run) if run.rows else tuple(runs[:first]), carried)

    def vacuum(self) -> list[str]:
        """Delete run folders that the current version doesn't list, and the log before its snapshot; older versions can't be read any more."""
        listed = {r.path for r in self._state.runs}
        gone = [f"runs/{n}" for n in sorted(self._store.names("runs")) if f"runs/{n}" not in listed]
        # the log first: a version whose runs are gone must not be found
        dropped = self._commits.drop_before(self._state.base)
        for path in gone:
            self._store.remove(path)
        return gone + dropped


def _meet(a: Run, b: Run) -> bool:
    """Do the key ranges of two runs overlap?"""
    return a.least <= b.most and b.least <= a.most
