"""Hashed n-gram features shared by the trained text models.

Families, each hashed into ``BUCKETS`` columns of its own:

* white-space words as they stand (case and punctuation kept),
* pairs of neighbouring words,
* character 3-grams (code points).

A model is a weight per column. A document's score averages the weights over
each family's n-grams, so a text's length doesn't move it.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import vectext as vt
from .work import kept, removed, smallest_hashes, texts

BUCKETS = 1 << 16
FAMILIES = 3
#: Entries (8 bytes) of a sample's features that the driver holds; more of them lie in a file of its own.
HELD_ENTRIES = 1 << 22
#: Entries of a sample that come to the driver in one job, and that a worker hands on at a time.
PART_ENTRIES = 1 << 21
#: Rows of a file with more entries are written with all their columns, which are gone through faster.
DENSE_ENTRIES = BUCKETS * FAMILIES // 8
_U = np.uint64


def _pairs(h: np.ndarray) -> np.ndarray:
    """Hashes of neighbouring words' hashes."""
    return vt.mix(h[:-1] * _U(3) + (h[1:] ^ (h[1:] >> _U(7))))


def _triples(cp: np.ndarray) -> np.ndarray:
    """Hashes of three code points in a row."""
    cp = cp.astype(np.uint64)
    return vt.mix(cp[:-2] * _U(0x9E3779B97F4A7C15) + cp[1:-1] * _U(0xC2B2AE3D27D4EB4F) + cp[2:] * _U(0x165667B19E3779F9))


def grams(s: vt.Slice, starts: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(column in the family, n + 1 offsets by document) of each family."""
    shift = _U(64 - BUCKETS.bit_length() + 1)
    h = s.span_hash(starts, ends)
    off = np.searchsorted(starts, s.off)
    out = [((h >> shift).astype(np.int32), off)]
    pair = _pairs(h)
    inner = np.ones(len(pair), bool)
    last = off[1:-1] - 1
    inner[last[(last >= 0) & (last < len(pair))]] = False
    c = np.zeros(len(pair) + 1, np.int64)
    np.cumsum(inner, out=c[1:])
    out.append(((pair[inner] >> shift).astype(np.int32), c[np.minimum(off, len(pair))]))
    cp, at = s.code_points()
    if len(cp) >= 3:
        g = _triples(cp)
        inner = np.ones(len(g), bool)
        for k in (1, 2):
            last = at[1:-1] - k
            inner[last[(last >= 0) & (last < len(g))]] = False
        c = np.zeros(len(g) + 1, np.int64)
        np.cumsum(inner, out=c[1:])
        out.append(((g[inner] >> shift).astype(np.int32), c[np.minimum(at, len(g))]))
    else:
        out.append((np.zeros(0, np.int32), np.zeros(s.n + 1, np.int64)))
    return out


def word_spans(s: vt.Slice) -> tuple[np.ndarray, np.ndarray]:
    return s.spans(~vt.WHITE[s.b])


def _mean_weights(s: vt.Slice, w: np.ndarray) -> np.ndarray:
    total = np.zeros(s.n)
    for k, (col, off) in enumerate(grams(s, *word_spans(s))):
        total += vt.segment_sum(w[k * BUCKETS : (k + 1) * BUCKETS][col], off) / np.maximum(1, np.diff(off))
    return total


def _long_grams(doc: vt.Long) -> Iterator[tuple[int, np.ndarray]]:
    """(family, columns) of a document, piece by piece."""
    shift = _U(64 - BUCKETS.bit_length() + 1)
    last = np.zeros(0, np.uint64)
    for h, _ in doc.spans(~vt.WHITE):
        yield 0, (h >> shift).astype(np.int32)
        h = np.append(last, h)
        yield 1, (_pairs(h) >> shift).astype(np.int32)
        last = h[-1:]
    tail = np.zeros(0, np.uint32)
    for b in doc.pieces():
        cp = np.append(tail, vt.code_points(b))
        yield 2, (_triples(cp) >> shift).astype(np.int32)
        tail = cp[-2:]


def scores(s: vt.Slice | vt.Long, w: np.ndarray) -> np.ndarray:
    """Sum over the families of the mean weight, by document; w has BUCKETS weights a family."""
    if isinstance(s, vt.Slice):
        return _mean_weights(s, w)
    sums, counts = np.zeros(FAMILIES), np.zeros(FAMILIES)
    for k, col in _long_grams(s):
        sums[k] += w[k * BUCKETS : (k + 1) * BUCKETS][col].sum(dtype=np.float64)
        counts[k] += len(col)
    return np.array([(sums / np.maximum(1, counts)).sum()])


def sparse_rows(column: pa.Array) -> Iterator[tuple[bytes, bytes]]:
    """(int32 columns, float32 shares) of each document, as raw bytes."""
    for s in vt.slices(column):
        if isinstance(s, vt.Long):
            yield _long_row(s)
            continue
        fam = grams(s, *word_spans(s))
        for i in range(s.n):
            cols, vals = [], []
            for k, (col, off) in enumerate(fam):
                if off[i + 1] > off[i]:
                    u, c = np.unique(col[off[i] : off[i + 1]], return_counts=True)
                    cols.append(u + np.int32(k * BUCKETS))
                    vals.append((c / (off[i + 1] - off[i])).astype(np.float32))
            yield (np.concatenate(cols).astype(np.int32).tobytes(), np.concatenate(vals).tobytes()) if cols else (b"", b"")


def _long_row(doc: vt.Long) -> tuple[bytes, bytes]:
    n = np.zeros((FAMILIES, BUCKETS))
    for k, col in _long_grams(doc):
        n[k] += np.bincount(col, minlength=BUCKETS)
    share = (n / np.maximum(1, n.sum(1, keepdims=True))).astype(np.float32).ravel()
    at = np.flatnonzero(share)
    return at.astype(np.int32).tobytes(), share[at].tobytes()


def labelled_sample(docs: DataFrame, labels: DataFrame, target: Column, values: tuple[int, ...], per_value: int) -> list:
    """At most ``per_value`` labelled rows of each value, with their features.

    The ids with the smallest xxhash64 stand for the others, so the choice is the
    same on every run. A label repeated for an id counts once (if its values differ,
    the smallest holds), and so does a text (the smallest holds). What comes to the
    driver is bounded by ``per_value``, never by the corpus: a row of sparse features
    an id, BUCKETS * FAMILIES entries of 8 bytes at most, no texts. Where that is over
    HELD_ENTRIES, as with long documents, it comes in parts and goes to a file
    (of BUCKETS * FAMILIES * 4 bytes a row at most).
    Returns rows (doc_id, y, cols, vals) sorted by doc_id.
    """
    lab = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), target.cast("int").alias("y")).filter(F.col("y").isin(list(values)) & F.col("doc_id").isNotNull())
    one = lab.groupBy("doc_id").agg(F.min("y").alias("y"))
    there = {r.y: r["count"] for r in one.groupBy("y").count().collect()}
    chosen = None
    for v in values:
        top = smallest_hashes(one.filter(F.col("y") == v), there.get(v, 0), per_value, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_value)
        chosen = top if chosen is None else chosen.unionByName(top)
    # at most per_value * len(values) rows of 12 bytes: bounded by parameters
    rows = texts(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done, got, held = 0, [], 0
            for row in sparse_rows(b.column("text")):
                got.append(row)
                held += len(row[0]) // 4
                if done + len(got) == b.num_rows or held >= PART_ENTRIES:
                    at = b.slice(done, len(got))
                    sizes = pa.array([len(x) // 4 for x, _ in got], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [at.column("doc_id"), at.column("y"), sizes, pa.array([x for x, _ in got], pa.binary()), pa.array([x for _, x in got], pa.binary())],
                        ["doc_id", "y", "n", "cols", "vals"],
                    )
                    done, got, held = done + len(got), [], 0

    found, path = kept(rows.mapInArrow(work, "doc_id bigint, y int, n bigint, cols binary, vals binary"))
    entries = found.agg(F.sum("n")).first()[0] or 0
    if entries <= HELD_ENTRIES:
        out = found.select("doc_id", "y", "cols", "vals").collect()
    else:
        out = _filed(found.repartition(math.ceil(entries / PART_ENTRIES), "doc_id").toLocalIterator())
    removed(docs.sparkSession, path)
    return sorted(out, key=lambda r: r.doc_id)


class Sampled(NamedTuple):
    """A labelled row whose features lie in a file; without ``cols``, ``vals`` has all columns."""

    doc_id: int
    y: int
    cols: np.ndarray | None
    vals: np.ndarray


def _filed(rows: Iterator) -> list[Sampled]:
    """The rows, their features in a file of the driver's that goes with them."""
    places, at = [], 0
    with tempfile.TemporaryFile() as f:
        for r in rows:
            cols, vals = np.frombuffer(r.cols, np.int32), np.frombuffer(r.vals, np.float32)
            dense = len(cols) > DENSE_ENTRIES
            if dense:
                every = np.zeros(BUCKETS * FAMILIES, np.float32)
                every[cols] = vals
                cols, vals = cols[:0], every
            f.write(cols.tobytes())
            f.write(vals.tobytes())
            places.append((r.doc_id, r.y, dense, at, at + len(cols), at + len(cols) + len(vals)))
            at = places[-1][-1]
        f.flush()
        whole = np.asarray(np.memmap(f, np.int32, "r"))
    return [Sampled(i, y, None if dense else whole[a:b], whole[b:c].view(np.float32)) for i, y, dense, a, b, c in places]


class Design:
    """Rows of sparse shares with the products that gradient descent needs. Rows that lie in a file are gone
    through one by one; they are never all in memory."""

    def __init__(self, rows: list):
        self.y = np.array([r.y for r in rows], np.int64)
        self.filed = rows if any(isinstance(r, Sampled) for r in rows) else None
        if self.filed:
            return
        parts = [np.frombuffer(bytes(r.cols), np.int32) for r in rows]
        self.col = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        self.val = np.concatenate([np.frombuffer(bytes(r.vals), np.float32) for r in rows]).astype(np.float64) if parts else np.zeros(0)
        self.off = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        self.row = np.repeat(np.arange(len(parts)), np.diff(self.off))

    def dot(self, w: np.ndarray) -> np.ndarray:
        if self.filed:
            w4 = w.astype(np.float32)
            return np.array([w4 @ r.vals if r.cols is None else (w.take(r.cols) * r.vals).sum() for r in self.filed], np.float64)
        return vt.segment_sum(w[self.col] * self.val, self.off)

    def back(self, g: np.ndarray) -> np.ndarray:
        if self.filed:
            total, one = np.zeros(BUCKETS * FAMILIES), np.zeros(BUCKETS * FAMILIES)
            for r, x in zip(self.filed, g):
                if r.cols is None:
                    total += np.multiply(r.vals, x, out=one)
                else:
                    total[r.cols] += r.vals * x  # a row names a column once
            return total
        return np.bincount(self.col, self.val * g[self.row], BUCKETS * FAMILIES)


def adam(grad, size: int, steps: int, rate: float) -> np.ndarray:
    """Full-batch Adam from zero; grad(params) gives the gradient."""
    p, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = grad(p)
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return p


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
