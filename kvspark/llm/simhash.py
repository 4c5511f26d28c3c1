"""SimHash near-duplicates: 64-bit fingerprints, pigeonhole blocks, components.

Fingerprint: the text with A-Z in lower case, words (runs of characters other
than space and U+0009-U+000D), 3-word shingles with repeats joined by single
spaces (fewer words: the whole sequence; no word: fingerprint 0). A bit is 1 if
it is set in over half of the shingles' XXH64 (seed 42). A text of any length is
read whole, a long one in pieces, so that few of its words are held at a time.

Links: two fingerprints with at most ``MAX_DISTANCE`` = 3 differing bits. The 64
bits are split into 6 blocks; two linked fingerprints agree on 3 blocks at least,
so each distinct fingerprint is put under the 20 choices of 3 blocks (about 32
bits each), equal keys are joined, and the Hamming distance is verified.

No bucket is compared quadratically: where over ``HEAVY`` distinct fingerprints
share a key, they are linked through hubs instead. For every point within one bit
of a member (flipping only bits outside the key), the smallest such member is the
hub's centre, and members within two bits of the point are linked to the centre.
Two members at distance 3 or less have a common hub, and members and centre of a
hub are at distance 3 or less, so the components stay exactly the same while the
links grow in proportion to the members. Exact copies are one fingerprint before
anything is joined.

Keys that many rows share (exact copies of one text, the root of a large component,
a heavy block key) are dealt to several tasks wherever rows are joined by them.

Defined cases: null and empty texts have fingerprint 0 and are linked like any
other; repeated rows and ids get one result each, and a component's id is the
smallest doc_id of its rows, null if it has none; an empty table gives no rows;
other columns are ignored by ``components`` and kept by ``first_of_each``, which
keeps one row of every component, also where an id stands for several texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh64_intdigest

from . import vectext as vt
from .work import join_once, kept, removed, saved, texts

SHINGLE, SEED, MAX_DISTANCE = 3, 42, 3
#: Bytes of a text whose words are held at a time.
PIECE_BYTES = 1 << 18
BLOCK_BITS = (11, 11, 11, 11, 10, 10)
#: Distinct fingerprints under one key that are still compared pair by pair. Hubs send 33 + 529 rows a member, pairs
#: cost half the members in comparisons where they lie.
HEAVY = 512
#: Heavy keys that are broadcast (16 bytes each); more are joined, each dealt to WAYS tasks.
BROADCAST_KEYS, WAYS = 500_000, 16


def _pieces(b: np.ndarray) -> Iterator[bytes]:
    """The bytes in order, cut after white space; more than twice PIECE_BYTES only where a word is as long."""
    at = stop = 0
    while at < len(b):
        white = ()
        while stop < len(b) and not len(white):
            first, stop = stop, min(stop + PIECE_BYTES, len(b))
            white = () if stop == len(b) else np.flatnonzero(vt.WHITE[b[first:stop]])
        end = len(b) if stop == len(b) else first + int(white[-1]) + 1
        yield b[at:end].tobytes()
        at = end


def _hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 of each k words in a row."""
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: len(words) - k].tolist()]
    stops = (ends[k - 1 :] - 1).tolist()
    return np.array([xxh64_intdigest(flat[a:b], SEED) for a, b in zip(starts, stops)], ">u8")


def fingerprint(text: bytes | np.ndarray) -> int:
    """Fingerprint of a text's UTF-8 bytes, unsigned. Gone through in pieces; two words are carried over each cut."""
    ones, n, last = np.zeros(64, np.int64), 0, []

    def add(h: np.ndarray) -> int:
        for i in range(0, len(h), 1 << 16):
            ones[:] += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        return len(h)

    for piece in _pieces(np.frombuffer(text, np.uint8)):
        words = last + piece.lower().split()  # bytes: A-Z and ASCII white space only
        if len(words) >= SHINGLE:
            n += add(_hashes(words, SHINGLE))
        last = words[1 - SHINGLE :]
    if not n:
        if not last:
            return 0
        n = add(_hashes(last, len(last)))
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _name(docs: DataFrame) -> list[F.Column]:
    """r1 and r2: 128 bits of hash of all columns that can be hashed."""
    whole = [F.col(f"`{f.name}`") for f in docs.schema.fields if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    return [F.xxhash64(F.lit(k), *whole).alias(f"r{k}") for k in (1, 2)]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long), salt (the row's number in its task, for dealing equal rows), and
    r1, r2 (hashes of the whole row, which name it). One scan, no shuffle."""
    rows = texts(docs, *_name(docs))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for b in batches:
            data, off = vt.string_buffers(b.column("text"))
            fps = [fingerprint(data[i:j]) for i, j in zip(off[:-1].tolist(), off[1:].tolist())]
            salt = pa.array(np.arange(done, done + len(fps)))
            done += len(fps)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.array(fps, np.uint64).view(np.int64)), salt, b.column("r1"), b.column("r2")], ["doc_id", "fp", "salt", "r1", "r2"])

    return rows.mapInArrow(work, "doc_id bigint, fp bigint, salt bigint, r1 bigint, r2 bigint")


def _choices() -> list[tuple[int, list[int]]]:
    """(mask of the key's bits, the other bits) of each choice of 3 blocks."""
    bits, at = [], 0
    for n in BLOCK_BITS:
        bits.append(range(at, at + n))
        at += n
    keep = len(BLOCK_BITS) - MAX_DISTANCE
    out = []
    for c in combinations(range(len(BLOCK_BITS)), keep):
        mask = sum(1 << i for k in c for i in bits[k])
        out.append((mask, [i for k in range(len(BLOCK_BITS)) if k not in c for i in bits[k]]))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints, column ``fp``; enough of them to connect all that are linked."""
    choices = _choices()
    keyed = fps.select(
        "fp",
        F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(_signed(m))) for m, _ in choices))).alias("c", "key"),
    )
    heavy = saved(keyed.groupBy("c", "key").count().filter(F.col("count") > HEAVY).select("c", "key"))
    number = heavy.count()
    light, members = (keyed, None) if not number else _parted(keyed, heavy, number)
    other = light.select("c", "key", F.col("fp").alias("b"))
    pairs = (
        light.select("c", "key", F.col("fp").alias("a"))
        .join(other, ["c", "key"])
        .filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_DISTANCE))
        .select("a", "b")
    )
    return (pairs if members is None else pairs.unionByName(_hub_links(members, choices))).distinct()


def _parted(keyed: DataFrame, heavy: DataFrame, number: int) -> tuple[DataFrame, DataFrame]:
    """The rows under light keys and those under heavy ones."""
    if number <= BROADCAST_KEYS:
        few, on = F.broadcast(heavy), ["c", "key"]
    else:
        keyed = keyed.withColumn("way", F.pmod(F.xxhash64("fp"), F.lit(WAYS)).cast("int"))
        few, on = heavy.withColumn("way", F.explode(F.sequence(F.lit(0), F.lit(WAYS - 1)))), ["c", "key", "way"]
    return tuple(keyed.join(few, on, how).select("fp", "c", "key") for how in ("left_anti", "left_semi"))


def _hub_links(members: DataFrame, choices: list[tuple[int, list[int]]]) -> DataFrame:

    # one row a choice of blocks: 20 rows, a fixed size
    spark = members.sparkSession
    ball = [
        (k, [_signed(sum(1 << i for i in c)) for n in range(2) for c in combinations(free, n)], [_signed(sum(1 << i for i in c)) for n in range(3) for c in combinations(free, n)])
        for k, (_, free) in enumerate(choices)
    ]
    balls = F.broadcast(spark.createDataFrame(ball, "c int, near array<bigint>, wide array<bigint>"))
    with_balls = members.join(balls, "c")
    hub = F.col("fp").bitwiseXOR(F.col("flip")).alias("hub")
    centres = with_balls.select("c", "key", "fp", F.explode("near").alias("flip")).groupBy("c", "key", hub).agg(F.min("fp").alias("a"))
    wide = with_balls.select("c", "key", "fp", F.explode("wide").alias("flip")).select("c", "key", hub, F.col("fp").alias("b"))
    return wide.join(centres, ["c", "key", "hub"]).filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): root is the smallest node reachable.

    Alternates large-star and small-star rounds: aggregations by minimum with
    map-side combining, and joins that deal the rows of a node with many neighbours
    to many tasks. Each round is written to the shared folder; the one before goes.
    """

    def star(e: DataFrame, large: bool, rows: int) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        if large:
            both = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
            out = join_once(both.filter("v > u"), low, ["u"], "n", F.col("v"), 2 * rows).select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            low = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
            out = join_once(down, low, ["u"], "n", F.col("v"), rows).select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.filter("a != b").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b") % 1_000_003)).first())

    spark = edges.sparkSession
    now, path = kept(edges.select("a", "b"))
    before = None
    while (at := state(now)) != before:
        # a star round has one edge at most for each of the last one's
        before, (after, then) = at, kept(star(star(now, True, at[0]), False, 2 * at[0]))
        removed(spark, path)
        now, path = after, then
    pairs = now.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
    return pairs.unionByName(pairs.select(F.col("root").alias("node"), "root")).distinct()


def components(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id: a row for each row of ``docs``."""
    return _with_components(saved(fingerprints(docs)))


def _with_components(fps: DataFrame) -> DataFrame:
    out = _rooted(fps, F.col("doc_id"))
    return out.select("doc_id", "fp", F.col("first").alias("component_id"))


def _rooted(fps: DataFrame, first: F.Column) -> DataFrame:
    """``fps`` with ``first``, the smallest value of that expression in the row's component."""
    one = saved(fps.groupBy("fp").agg(F.min(first).alias("first"), F.count("*").alias("n")))
    tree = connected(links(one.select("fp"))).withColumnsRenamed({"node": "fp"})
    # what isn't linked to another fingerprint is a component by itself
    rooted = one.join(tree, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("first"), F.count("*").alias("members"))
    size = one.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    ids = join_once(rooted.drop("first"), smallest, ["root"], "members", F.col("fp"), size[0]).select("fp", "n", "first")
    return join_once(fps, ids, ["fp"], "n", F.col("salt" if "salt" in fps.columns else "doc_id"), size[1])


def first_of_each(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component, with all columns: the one with the smallest doc_id (null last), of several
    the one with the smallest hash of the row. Rows that are equal in all columns are one."""
    fps = saved(fingerprints(docs))
    name = F.struct(F.isnull("doc_id").alias("none"), F.col("doc_id").alias("id"), "r1", "r2")
    each = _rooted(fps, name)
    drops = each.filter((F.col("r1") != F.col("first.r1")) | (F.col("r2") != F.col("first.r2"))).select("r1", "r2").distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *_name(docs))
    if not fps.groupBy("r1", "r2").count().filter("count > 1").isEmpty():
        rows = rows.groupBy("r1", "r2").agg(F.first("row").alias("row"))  # equal rows, so any of them
    return rows.join(drops, ["r1", "r2"], "left_anti").select("row.*")


def hex16(fp: str = "fp") -> F.Column:
    """The fingerprint's 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
