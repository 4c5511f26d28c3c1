"""Token counts of documents in flat token files, by a separator scan.

A flat token file is nothing but token ids, two or four bytes each, with an
end-of-document id after each document; it has no index. Files are read by byte
ranges, in parallel and of any size, as fixed-size blocks (file, block, tokens) that
cut documents anywhere. Each block is searched for separators with one vectorised
comparison, on its own. Documents that cross blocks are stitched by a prefix scan
over the blocks' summaries (tokens, separators, place of the last separator): first
within runs of ``RUN`` blocks, then over the runs' totals, so that no task holds the
summaries of a whole large file. Only summaries and lengths are shuffled, never tokens.

``count_tokens`` writes such files into the shared folder and scans them. A task's
file counts only by the manifest row that names it, and Spark commits the manifest of
one attempt, so files of failed or repeated attempts are never read.

Defined cases: adjacent separators enclose a document of 0 tokens; what follows
a file's last separator is a document that isn't closed (``closed`` false), if it
has a token; a file without separators is one such document; empty files and
tables give no rows; a file that ends amid a token is an error; null ``tokens`` count
as an empty block; extra columns are ignored. In ``write_flat`` null and empty texts
are documents of 0 tokens, equal rows are counted one by one, and a text of any
length is encoded whole.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import files
from .work import removed, saved, scratch, texts

#: A public byte-level BPE as ranks, and the id that it leaves free.
RANKS_PATH, SEPARATOR = "/opt/tokenizers/byte_bpe_50k.tiktoken", 50256
#: How that tokenizer cuts texts before merging (a fixed value that belongs to the vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK_TOKENS = 1 << 16
RUN = 1024
#: Blocks that one row of the plan stands for.
RANGE_BLOCKS = 256


@lru_cache(maxsize=2)
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def write_flat(docs: DataFrame, path: str, ranks_path: str = RANKS_PATH, separator: int = SEPARATOR) -> tuple[list[tuple[int, str, int]], DataFrame]:
    """Encode ``docs`` to flat token files under ``path``, one a partition, of little-endian uint16.

    Returns the files (number, URI, bytes), a row a task, and the order of the
    documents in each file (file, ordinal, doc_id).
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, number, ordinal = _encoder(ranks_path), TaskContext.get().partitionId(), 0
        name, out, size = f"{path}/{number:06d}-{uuid.uuid4().hex}.bin", None, 0

        def row(first: int | None, ids: list | None, size: int | None) -> pa.RecordBatch:
            types = [pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([number, name, first, ids, size], types)], ["file", "uri", "first", "doc_ids", "bytes"])

        for b in batches:
            if not b.num_rows:
                continue
            out = out or files.writer(name)
            for text in b.column("text"):
                out.write(enc.encode_to_numpy(text.as_py() or "", disallowed_special=()).astype("<u2"))
                out.write(np.array([separator], "<u2"))
            yield row(ordinal, b.column("doc_id").to_pylist(), None)
            ordinal += b.num_rows
        if out is not None:
            size = out.tell()
            out.close()
            yield row(None, None, size)

    manifest = saved(texts(docs).mapInArrow(work, "file bigint, uri string, first bigint, doc_ids array<bigint>, bytes bigint"))
    written = [tuple(r) for r in manifest.filter("bytes is not null").select("file", "uri", "bytes").collect()]
    order = manifest.filter("bytes is null").select("file", "first", F.posexplode("doc_ids").alias("at", "doc_id"))
    return written, order.select("file", (F.col("first") + F.col("at")).alias("ordinal"), "doc_id")


def read_flat(spark: SparkSession, path: str, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of raw token files at ``path`` (a file, folder or glob); ``file`` is the file's URI."""
    return read_ranges(spark, [(uri, uri, size) for uri, size in files.listed(spark, path)], width, block_tokens)


def read_ranges(spark: SparkSession, named: list[tuple], width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """file, block, tokens of files (key, URI, bytes), read by ranges of RANGE_BLOCKS blocks wherever these lie."""
    if odd := [uri for _, uri, size in named if size % width]:
        raise ValueError(f"not a whole number of tokens: {odd[0]}")
    cut = block_tokens * width
    kind = "bigint" if all(isinstance(k, int) for k, *_ in named) and named else "string"
    rows = spark.createDataFrame([x for x in named if x[2]], f"file {kind}, uri string, bytes bigint")
    starts = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("bytes") - 1) / (cut * RANGE_BLOCKS)))
    ranges = rows.select("file", "uri", "bytes", F.explode(starts).alias("range"))
    count = sum(-(-size // (cut * RANGE_BLOCKS)) for *_, size in named)
    dealt = ranges.repartition(max(1, min(count, 4 * spark.sparkContext.defaultParallelism)), "uri", "range")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = pa.int64() if kind == "bigint" else pa.string()
        for b in batches:
            for file, uri, size, at in zip(*(b.column(c).to_pylist() for c in ("file", "uri", "bytes", "range"))):
                with files.reader(uri) as f:
                    for k in range(at * RANGE_BLOCKS, min((at + 1) * RANGE_BLOCKS, -(-size // cut))):
                        tokens = f.read_at(min(cut, size - k * cut), k * cut)
                        yield pa.RecordBatch.from_arrays([pa.array([file], arrow), pa.array([k], pa.int64()), pa.array([tokens], pa.binary())], ["file", "block", "tokens"])

    return dealt.mapInArrow(work, f"file {kind}, block bigint, tokens binary")


def scan(blocks: DataFrame, separator: int = SEPARATOR, width: int = 2) -> DataFrame:
    """file, block, n (tokens), seps, last (tokens up to and with the last separator), gaps (lengths ended by each separator, the first counted from the block's start)."""
    kind = {2: "<u2", 4: "<u4"}[width]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, seps, last, gaps = [], [], [], []
            for x in b.column("tokens"):
                a = np.frombuffer(x.as_py() or b"", kind)
                at = np.flatnonzero(a == separator)
                n.append(len(a))
                seps.append(len(at))
                last.append(int(at[-1]) + 1 if len(at) else None)
                gaps.append(np.diff(at, prepend=-1) - 1)
            off = np.concatenate([[0], np.cumsum(seps)]).astype(np.int32)
            flat = np.concatenate(gaps) if gaps else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column("file"), b.column("block"), pa.array(n, pa.int64()), pa.array(seps, pa.int64()), pa.array(last, pa.int64()), pa.ListArray.from_arrays(pa.array(off), pa.array(flat.astype(np.int64)))],
                ["file", "block", "n", "seps", "last", "gaps"],
            )

    kind_of_file = dict(blocks.dtypes)["file"]
    return blocks.select("file", "block", "tokens").mapInArrow(work, f"file {kind_of_file}, block bigint, n bigint, seps bigint, last bigint, gaps array<bigint>")


def stitch(found: DataFrame) -> DataFrame:
    """file, ordinal (from 0), n_tokens, closed from the blocks' summaries of ``scan``."""
    runs = found.withColumn("run", F.floor(F.col("block") / RUN))
    inside = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    local = runs.withColumns({"base": F.coalesce(F.sum("n").over(inside), F.lit(0)), "done": F.coalesce(F.sum("seps").over(inside), F.lit(0))})
    local = local.withColumn("cut", F.max(F.col("base") + F.col("last")).over(inside))
    totals = local.groupBy("file", "run").agg(F.sum("n").alias("run_n"), F.sum("seps").alias("run_seps"), F.max(F.col("base") + F.col("last")).alias("run_cut"))
    over_runs = Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    placed = totals.withColumns({"run_base": F.coalesce(F.sum("run_n").over(over_runs), F.lit(0)), "run_done": F.coalesce(F.sum("run_seps").over(over_runs), F.lit(0))})
    placed = placed.withColumn("run_before", F.max(F.col("run_base") + F.col("run_cut")).over(over_runs))
    every = local.join(placed.select("file", "run", "run_base", "run_done", "run_before"), ["file", "run"])
    # tokens since the last separator before the block, or since the file's start
    start = F.col("run_base") + F.col("base")
    carried = start - F.coalesce(F.col("run_base") + F.col("cut"), F.col("run_before"), F.lit(0))
    closed = every.select("file", (F.col("run_done") + F.col("done")).alias("first"), carried.alias("carried"), F.posexplode("gaps").alias("at", "gap")).select(
        "file", (F.col("first") + F.col("at")).alias("ordinal"), (F.col("gap") + F.when(F.col("at") == 0, F.col("carried")).otherwise(0)).alias("n_tokens"), F.lit(True).alias("closed")
    )
    ends = placed.groupBy("file").agg(F.sum("run_n").alias("all_n"), F.sum("run_seps").alias("ordinal"), F.max(F.col("run_base") + F.col("run_cut")).alias("end_cut"))
    rest = ends.withColumn("n_tokens", F.col("all_n") - F.coalesce("end_cut", F.lit(0))).filter("n_tokens > 0")
    return closed.unionByName(rest.select("file", "ordinal", "n_tokens", F.lit(False).alias("closed")))


def count_tokens(docs: DataFrame) -> DataFrame:
    """doc_id, file, ordinal, n_tokens: encodes ``docs`` to flat files in the shared folder and scans those."""
    spark = docs.sparkSession
    path = scratch(spark)
    written, order = write_flat(docs, path)
    # the summaries are read by both levels of the prefix scan; with them kept, the files can go
    found = saved(scan(read_ranges(spark, written)))
    removed(spark, path)
    return order.join(stitch(found), ["file", "ordinal"]).select("doc_id", "file", "ordinal", "n_tokens")
