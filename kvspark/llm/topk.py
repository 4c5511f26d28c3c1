"""Exact top-k by integer inner product: columnar branch and bound.

A component x becomes floor(1024 * x), x as double. Vectors are held in vertical
layout: one contiguous row for each dimension, blocks of ``DIM_BLOCK`` dimensions.
For a query, the products of one block of dimensions after the other are added
for all surviving candidates at once. After each block, by Cauchy-Schwarz, what
the remaining dimensions can still add is at most the product of the remaining
norms of query and candidate; candidates whose partial score plus that mass stays
below the k-th best complete score so far are dropped and the survivors are
compacted. Ties never fall, since only strictly smaller bounds are dropped.

The queries are quantised once and written to the shared folder, in files of
``QUERY_BLOCK`` vectors or ``QUERY_BYTES`` at most; only the files' names come to the
driver. Then one scan of the table, however many queries there are: each task holds
its candidates a chunk at a time (``CHUNK_COMPONENTS``) and walks through the queries'
files for each. While these hold ``KEPT_QUERIES`` at most, a task keeps its best k of
each from chunk to chunk, as a bar for the next; else they are given out chunk by
chunk. Either way the partial lists are merged by one aggregation.

Defined cases: a vector that is null, empty or holds a null, NaN or infinite
component takes no part, as query or candidate; a null id takes no part either.
A candidate of another length than the query takes no part for it. Rows that
repeat an id are candidates one by one; of a query's repeats the smallest vector
(by its components) is the query, and no row with the query's id is its candidate. Ties go to the smaller vec_id.
A query without candidates has no rows. An empty table gives no rows. Other
columns are ignored. Components beyond +-2^52 / 1024 are taken at that limit, and
scores beyond a long at the long's limits.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import files
from .work import saved, scratch

SCALE = 1024
DIM_BLOCK = 16
QUERY_BLOCK = 1024
QUERY_BYTES = 16 << 20
#: Queries whose best k a task keeps over its chunks: 16 bytes a place.
KEPT_QUERIES = 100_000
#: Candidates of a task that are held in vertical layout at a time, by components of 8 bytes.
CHUNK_COMPONENTS = 1 << 22
_LIMIT = float(1 << 52)


def quantised(col: pa.Array) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
    """Row numbers and integer vectors (a row each) of the usable vectors, by length."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    valid = np.ones(n, bool) if not col.null_count else np.asarray(col.is_valid())
    off = np.asarray(col.offsets, np.int64)
    flat = col.values
    x = np.asarray(flat.cast(pa.float64()).fill_null(np.nan)) if len(flat) else np.zeros(0)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    size = off[1:] - off[:-1]
    usable = valid & (size > 0) & (bad[off[1:]] == bad[off[:-1]])
    rows, vecs = {}, {}
    for d in np.unique(size[usable]).tolist():
        at = np.flatnonzero(usable & (size == d))
        take = x[off[at][:, None] + np.arange(d)[None, :]]
        rows[d] = at
        vecs[d] = np.clip(np.floor(take * SCALE), -_LIMIT, _LIMIT).astype(np.int64)
    return rows, vecs


def _exact(q: np.ndarray, c: np.ndarray, wide: bool) -> np.ndarray:
    """Inner products of a query with candidates (a column each), as longs."""
    c = c.astype(np.int64)
    if not wide:
        return q @ c
    lo, hi = -(1 << 63), (1 << 63) - 1
    return np.array([min(hi, max(lo, sum(int(a) * int(b) for a, b in zip(q, col)))) for col in c.T], np.int64)


def _edges(d: int) -> list[int]:
    return [*range(0, d, DIM_BLOCK), d]


@dataclass
class Chunk:
    """Candidates in vertical layout, long vectors first, since they set a high bar early."""

    ids: np.ndarray
    f: np.ndarray  # a row a dimension; integers below 2^53, so exact
    rest: list[np.ndarray]  # norms of what remains after each block of dimensions
    top: float

    @staticmethod
    def of(ids: np.ndarray, vecs: np.ndarray) -> Chunk:
        """From candidates given a row each."""
        norms = (vecs.astype(np.float64) ** 2).sum(1)
        order = np.argsort(-norms, kind="stable")
        f = np.ascontiguousarray(vecs[order].T.astype(np.float64))
        return Chunk(ids[order], f, [np.sqrt((f[e:] ** 2).sum(0)) for e in _edges(len(f))], float(np.abs(f).max(initial=0)))


class Searcher:
    """The best k candidates of each query so far; queries of one length."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray, k: int, best: list | None = None):
        self.ids, self.q, self.k = ids, vecs, k
        self.edges = _edges(vecs.shape[1])
        f = vecs.astype(np.float64)
        self.rest = [np.sqrt((f[:, e:] ** 2).sum(1)) for e in self.edges]
        self.top = float(np.abs(f).max(initial=0))
        self.best: list[tuple[np.ndarray, np.ndarray]] = best or [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in ids]

    def feed(self, c: Chunk) -> None:
        """Hold candidates against every query."""
        wide = self.top * c.top * len(c.f) >= 2.0**62
        for i in range(len(self.ids)):
            self._one(i, c.ids, c.f, c.rest, wide)

    def _one(self, i: int, ids: np.ndarray, f: np.ndarray, rest: list[np.ndarray], wide: bool) -> None:
        q, (have, have_ids) = self.q[i], self.best[i]
        start = 0
        if len(have) < self.k:
            # complete the first few, to have a bar at all
            start = min(4 * self.k, len(ids))
            head = np.flatnonzero(ids[:start] != self.ids[i])
            have = np.concatenate([have, _exact(q, f[:, head], wide)])
            have_ids = np.concatenate([have_ids, ids[head]])
        bar = float(np.partition(have, -self.k)[-self.k]) if len(have) >= self.k else -np.inf
        qf = q.astype(np.float64)
        live = np.arange(start, len(ids))
        part = np.zeros(len(live))
        slack = 1e-9
        for b in range(len(self.edges) - 1):
            lo, hi = self.edges[b], self.edges[b + 1]
            left = self.rest[b][i] * rest[b][live]
            ok = part + left + slack * (np.abs(part) + left) + 1 >= bar
            if not ok.all():
                live, part = live[ok], part[ok]
            if not len(live):
                break
            block = f[lo:hi, start:] if len(live) == f.shape[1] - start else f[lo:hi, live]
            part = part + qf[lo:hi] @ block
        live = live[(part + slack * np.abs(part) + 1 >= bar) & (ids[live] != self.ids[i])] if len(live) else live
        if len(live):
            have = np.concatenate([have, _exact(q, f[:, live], wide)])
            have_ids = np.concatenate([have_ids, ids[live]])
        keep = np.lexsort((have_ids, -(have.astype(np.float64) if wide else have)))[: self.k]
        self.best[i] = have[keep], have_ids[keep]


def _query_files(asked: DataFrame) -> list[tuple[str, int, int]]:
    """(URI, length of the vectors, queries) of files that hold the quantised queries: the smallest vector of each id."""
    usable = asked.filter("id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    path = scratch(asked.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def write(d: int) -> pa.RecordBatch:
            ids, vecs = (np.concatenate(x) for x in zip(*held.pop(d)))
            uri = f"{path}/{uuid.uuid4().hex}.bin"
            with files.writer(uri) as out:
                out.write(ids.astype("<i8"))
                out.write(vecs.astype("<i8"))
            return pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([d]), pa.array([len(ids)])], ["uri", "d", "n"])

        for b in batches:
            own = np.asarray(b.column("id").cast(pa.int64()))
            at, vecs = quantised(b.column("v"))
            for d in vecs:
                step = max(1, min(QUERY_BLOCK, QUERY_BYTES // (8 * d)))
                for i in range(0, len(at[d]), step):
                    more = own[at[d][i : i + step]], vecs[d][i : i + step]
                    if d in held and sum(len(x) for x, _ in held[d]) + len(more[0]) > step:
                        yield write(d)
                    held.setdefault(d, []).append(more)
        for d in list(held):
            yield write(d)

    # a row a file; a file of an attempt that failed is named by none
    names = saved(usable.groupBy("id").agg(F.min("v").alias("v")).mapInArrow(work, "uri string, d bigint, n bigint"))
    return sorted(tuple(r) for r in names.collect())


def search(table: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best candidates of each query."""
    whole = table.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("asked"))
    queries = _query_files(whole.filter("asked").select("id", "v"))
    if not queries:
        return table.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    parts = whole.select("id", "v").filter("id is not null").mapInArrow(_task(queries, k), "query_id bigint, vec_id bigint, score bigint")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return parts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _task(queries: list[tuple[str, int, int]], k: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keeps = sum(n for *_, n in queries) <= KEPT_QUERIES
        best: dict[str, tuple[np.ndarray, list]] = {}
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        lengths = {d for _, d, _ in queries}

        def walk(d: int) -> Iterator[pa.RecordBatch]:
            ids, vecs = (np.concatenate(x) for x in zip(*held.pop(d)))
            chunk = Chunk.of(ids, vecs)
            del ids, vecs
            for uri, size, n in queries:
                if size != d:
                    continue
                with files.reader(uri) as f:
                    own = np.frombuffer(f.read_at(8 * n, 0), "<i8")
                    s = Searcher(own, np.frombuffer(f.read_at(8 * n * d, 8 * n), "<i8").reshape(n, d), k, best.get(uri, (None, None))[1])
                s.feed(chunk)
                if keeps:
                    best[uri] = own, s.best
                else:
                    yield from _found(own, s.best)

        for b in batches:
            own = np.asarray(b.column("id"))
            at, vecs = quantised(b.column("v"))
            for d in lengths & vecs.keys():
                step = max(1, CHUNK_COMPONENTS // d)
                for i in range(0, len(at[d]), step):
                    held.setdefault(d, []).append((own[at[d][i : i + step]], vecs[d][i : i + step]))
                    if sum(len(x) for x, _ in held[d]) >= step:
                        yield from walk(d)
        for d in list(held):
            yield from walk(d)
        for own, found in best.values():
            yield from _found(own, found)

    return work


def _found(ids: np.ndarray, best: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    n = np.array([len(x) for x, _ in best])
    if n.sum():
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(ids, n)), pa.array(np.concatenate([y for _, y in best])), pa.array(np.concatenate([x for x, _ in best]))], ["query_id", "vec_id", "score"]
        )


def brute_force(rows: list[tuple[int, list[float]]], query_ids: set[int], k: int) -> list[tuple[int, int, int, int]]:
    """The same by full comparison in plain Python integers; for tests."""
    import math

    fit = [(i, [math.floor(SCALE * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    asked: dict[int, list] = {}
    for i, v in fit:
        if i in query_ids:
            asked[i] = min(asked.get(i, v), v)
    for i, q in asked.items():
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in fit if j != i and len(v) == len(q))
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)
