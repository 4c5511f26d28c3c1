"""Registered queries: each of the reference's operators over the supplied tables, with DuckDB SQL that must agree.

Mappings: ``events`` is a mutation log (key user_id as text, version event_id,
``error`` deletes, ``signup`` is a COMMIT marker where a log is replayed and a put
elsewhere, the rest put ``value``). ``customer`` is keyed by c_name, ``pages`` by
url, ``orders`` by the zero-padded o_orderkey, ``conversations`` by conv_id:turn.
Keys are shown as text.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..database import Database
from ..errors import InvalidTableNameError, TableExistsError
from ..functions import bounds as B, values as V
from ..operators import access, resolve
from ..sources import runs
from ..sources.store import Hadoop, Local, place
from ..table import Table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Keys that the lookups ask for: present, deleted and absent ones, one of them twice.
ASKED = ["7", "none", "42", "7", "12", "-1", "99", "3"]
LAYER_EVENTS, QUARTERS = 1000, 4


def query(sql: str | None = None):
    """Register a query, and its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _binary(text: str) -> F.Column:
    return F.col(text).cast("string").cast("binary")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, op, value (double), cv, ord of every event."""
    op = F.when(F.col("event_type") == "error", V.DELETE).otherwise(V.PUT)
    return read(spark, sf_dir, "events").select(
        _binary("user_id").alias("key"), op.alias("op"), F.when(op == V.PUT, F.col("value")).alias("value"), F.col("event_id").alias("cv"), F.lit(0).alias("ord")
    )


def with_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "error", V.DELETE).when(F.col("event_type") == "signup", "C").otherwise(V.PUT)
    return e.select(_binary("user_id").alias("key"), op.alias("op"), F.when(op == V.PUT, F.col("value")).alias("value"), F.col("event_id").alias("cv"), F.lit(0).alias("ord"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(_binary("c_name").alias("key"), F.col("c_acctbal").alias("value"))


def shown(df: DataFrame) -> DataFrame:
    return df.withColumn("key", F.col("key").cast("string"))


_LOG = "log AS (SELECT CAST(user_id AS VARCHAR) AS key, CASE WHEN event_type = 'error' THEN 'D' ELSE 'P' END AS op, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value, event_id FROM events)"
_MARKED = "log AS (SELECT CAST(user_id AS VARCHAR) AS key, CASE event_type WHEN 'error' THEN 'D' WHEN 'signup' THEN 'C' ELSE 'P' END AS op, CASE WHEN event_type IN ('error', 'signup') THEN NULL ELSE value END AS value, event_id FROM events)"
_NEWEST = "newest AS (SELECT key, e.op AS op, e.value AS value FROM (SELECT key, arg_max({'op': op, 'value': value}, event_id) AS e FROM log GROUP BY key))"
_STATE = f"{_LOG}, {_NEWEST}, state AS (SELECT key, value FROM newest WHERE op = 'P')"
_CUSTOMERS = "state AS (SELECT c_name AS key, c_acctbal AS value FROM customer)"
_ASKED = "asked(pos, key) AS (VALUES " + ", ".join(f"({i}, '{k}')" for i, k in enumerate(ASKED)) + ")"
_QUARTERED = f"{_LOG}, layered AS (SELECT *, event_id * {QUARTERS} // (SELECT max(event_id) + 1 FROM events) AS layer FROM log)"
_TOUCHED = f"{_STATE} SELECT * FROM state WHERE key NOT IN ('7', '12') UNION ALL VALUES ('7', 1.5::DOUBLE), ('new', 2.5::DOUBLE)"


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.state(event_log(spark, sf_dir))


# --- resolution ---------------------------------------------------------------


@query(f"WITH {_STATE} SELECT * FROM state")
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(access.scan(_state(spark, sf_dir)))


@query(f"WITH {_LOG}, {_NEWEST} SELECT * FROM newest")
def newest_entry_with_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(resolve.newest(event_log(spark, sf_dir)))


@query(f"WITH {_LOG}, {_NEWEST} SELECT * FROM newest")
def newest_entry_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(resolve.by_rank(event_log(spark, sf_dir)))


@query(f"WITH {_LOG}, {_NEWEST} SELECT key FROM newest WHERE op = 'D'")
def deleted_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(resolve.newest(event_log(spark, sf_dir)).filter(resolve.is_deleted()).select("key"))


def _layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log(spark, sf_dir).withColumn("layer", F.floor(F.col("cv") / LAYER_EVENTS))


@query(f"WITH {_STATE} SELECT * FROM state")
def layer_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each layer is resolved by itself, then the newest layer wins."""
    inside = _layers(spark, sf_dir).groupBy("key", "layer").agg(F.max_by(F.struct("op", "value"), "cv").alias("e"))
    return shown(resolve.state(inside.select("key", "e.op", "e.value", F.col("layer").alias("cv"), F.lit(0).alias("ord"))))


# --- access paths ---------------------------------------------------------------


def _point(key: str):
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        asked = spark.createDataFrame([(key.encode(),)], "key binary")
        return shown(asked.join(access.get(_state(spark, sf_dir), key.encode()), "key", "left"))

    return f


def _register_points() -> None:
    for name, key in (("point_get", "7"), ("point_get_absent", "no such key")):
        QUERIES[name] = _point(key)
        ORACLE_SQL[name] = f"WITH {_STATE} SELECT a.key, s.value FROM (SELECT '{key}' AS key) a LEFT JOIN state s ON a.key = s.key"


_register_points()


@query(f"WITH {_LOG}, {_NEWEST} SELECT d.key, s.value FROM (SELECT min(key) AS key FROM newest WHERE op = 'D') d LEFT JOIN (SELECT * FROM newest WHERE op = 'P') s ON d.key = s.key")
def point_get_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = resolve.newest(event_log(spark, sf_dir))
    gone = entries.filter(resolve.is_deleted()).agg(F.min("key").alias("key"))
    return shown(gone.join(resolve.live(entries), "key", "left"))


def _requests(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, bytearray(k.encode())) for i, k in enumerate(ASKED)], "pos int, key binary")


@query(f"WITH {_STATE}, {_ASKED} SELECT CAST(pos AS INTEGER) AS pos, key, EXISTS (SELECT 1 FROM state s WHERE s.key = a.key) AS found FROM asked a")
def contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(access.contains(_state(spark, sf_dir), _requests(spark))).select("pos", "key", "found")


@query(f"WITH {_STATE}, {_ASKED} SELECT CAST(pos AS INTEGER) AS pos, a.key, s.value FROM asked a LEFT JOIN state s ON a.key = s.key")
def multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(access.multi_get(_state(spark, sf_dir), [k.encode() for k in ASKED]))


@query(f"WITH {_STATE} SELECT s.key, s.value, CAST(a.pos AS BIGINT) AS pos FROM (SELECT event_id AS pos, CAST(user_id AS VARCHAR) AS key FROM events WHERE event_type = 'view') a LEFT JOIN state s ON a.key = s.key WHERE s.key IS NOT NULL")
def multi_get_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for each view event: any number of requests, planned by their size."""
    asked = read(spark, sf_dir, "events").filter("event_type = 'view'").select(F.col("event_id").alias("pos"), _binary("user_id").alias("key"))
    return shown(access.multi_get_df(_state(spark, sf_dir), asked).filter("value is not null"))


@query("SELECT url AS key, sha256(html) AS value FROM pages")
def full_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages").select(_binary("url").alias("key"), F.sha2("html", 256).alias("value"))
    return shown(access.scan(p))


@query("SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS key, o_totalprice AS value FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 250")
def range_half_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.lpad(F.col("o_orderkey").cast("string"), 12, "0").cast("binary").alias("key"), F.col("o_totalprice").alias("value"))
    return shown(access.half_open(o, b"%012d" % 100, b"%012d" % 250))


LOW, HIGH = "Customer#000000040", "Customer#000000090"


def _range(low: str, high: str):
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shown(access.scan_range(customers(spark, sf_dir), B.Bound(low, LOW.encode()), B.Bound(high, HIGH.encode())))

    return f


def _register_ranges() -> None:
    above = {B.UNBOUNDED: "TRUE", B.INCLUDED: f"key >= '{LOW}'", B.EXCLUDED: f"key > '{LOW}'"}
    below = {B.UNBOUNDED: "TRUE", B.INCLUDED: f"key <= '{HIGH}'", B.EXCLUDED: f"key < '{HIGH}'"}
    for low in above:
        for high in below:
            name = f"range_bounds_{low}_{high}"
            QUERIES[name] = _range(low, high)
            ORACLE_SQL[name] = f"WITH {_CUSTOMERS} SELECT * FROM state WHERE {above[low]} AND {below[high]}"


_register_ranges()


@query(f"WITH {_CUSTOMERS} SELECT count(*) AS n FROM state WHERE key >= 'z' AND key < 'a'")
def range_inverted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.half_open(customers(spark, sf_dir), b"z", b"a").agg(F.count("*").alias("n"))


def _prefix(prefix: bytes):
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shown(access.scan_prefix(customers(spark, sf_dir), prefix))

    return f


def _register_prefixes() -> None:
    for name, p in (("prefix_scan", "Customer#00000010"), ("prefix_empty", "")):
        QUERIES[name] = _prefix(p.encode())
        ORACLE_SQL[name] = f"WITH {_CUSTOMERS} SELECT * FROM state WHERE starts_with(key, '{p}')"


_register_prefixes()


@query("SELECT upper(hex(encode('k' || conv_id))) || 'FF' AS key, count(*) AS n FROM conversations WHERE conv_id % 10 = 3 GROUP BY conv_id")
def prefix_ff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of raw bytes: a prefix of 0xFF only has no upper bound."""
    c = read(spark, sf_dir, "conversations")
    stem = F.concat(F.lit("k"), F.col("conv_id").cast("string")).cast("binary")
    low = F.when(F.col("conv_id") % 10 == 3, F.lit(b"\xff\xff")).otherwise(F.lit(b"\xfe\xff"))
    keyed = c.groupBy("conv_id").agg(F.count("*").alias("n")).select(F.concat(low, stem).alias("key"), "n")
    found = access.scan_prefix(keyed.withColumnRenamed("n", "value"), b"\xff\xff")
    return found.select(F.concat(F.hex(F.expr("substring(key, 3)")), F.lit("FF")).alias("key"), F.col("value").alias("n"))


@query("SELECT conv_id, turn, role AS value FROM conversations WHERE conv_id = 12")
def prefix_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").cast("binary").alias("key"), F.col("role").alias("value"))
    parts = F.split(F.col("key").cast("string"), ":")
    return access.scan_prefix(c, b"12:").select(parts[0].cast("bigint").alias("conv_id"), parts[1].cast("bigint").alias("turn"), "value")


# --- transactions and batches ---------------------------------------------------


def _own(spark: SparkSession) -> DataFrame:
    rows = [(bytearray(b"7"), "P", 1.5, 0), (bytearray(b"12"), "D", None, 1), (bytearray(b"new"), "P", 2.5, 2), (bytearray(b"7"), "P", 3.5, 3)]
    return spark.createDataFrame(rows, "key binary, op string, value double, ord int").withColumn("cv", F.lit(0))


@query(f"WITH {_STATE} SELECT * FROM state WHERE key NOT IN ('7', '12', 'new') UNION ALL VALUES ('7', 3.5::DOUBLE), ('new', 2.5::DOUBLE)")
def txn_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read-your-writes: puts, a deletion and an overwrite over a snapshot."""
    return shown(resolve.state(resolve.overlay(event_log(spark, sf_dir), _own(spark)), "over", "at"))


@query(f"WITH {_STATE} SELECT * FROM state WHERE key NOT IN ('7', '12', 'new') UNION ALL VALUES ('7', 3.5::DOUBLE), ('new', 2.5::DOUBLE)")
def txn_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same batch committed, as a newer layer."""
    own = resolve.last_per_key(_own(spark))
    return shown(resolve.state(resolve.layered(resolve.newest(event_log(spark, sf_dir)), own)))


@query(f"WITH {_STATE} SELECT * FROM state")
def txn_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = engine(spark, sf_dir)
    with t.transaction() as x:
        x.set_value(b"7", 1.5)
        x.delete(b"12")
        x.rollback()
    with t.transaction() as x:  # left without a commit
        x.set_value(b"new", 2.5)
    return floats(t.df())


@query("WITH b(key, value, ord) AS (SELECT CAST(user_id % 10 AS VARCHAR), value, event_id FROM events) SELECT key, arg_max({'v': value}, ord).v AS value FROM b GROUP BY key")
def put_batch_dupes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select((F.col("user_id") % 10).cast("string").cast("binary").alias("key"), F.lit(V.PUT).alias("op"), "value", F.col("event_id").alias("ord"))
    return shown(resolve.last_per_key(e).select("key", "value"))


@query(f"WITH {_STATE} SELECT * FROM state WHERE key NOT IN ('7', 'no such key')")
def delete_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = spark.createDataFrame([(bytearray(b"7"), "D", None), (bytearray(b"no such key"), "D", None)], "key binary, op string, value double")
    return shown(resolve.state(resolve.layered(resolve.newest(event_log(spark, sf_dir)), once, once)))


# --- the log --------------------------------------------------------------------


@query(f"WITH {_MARKED}, cut AS (SELECT max(event_id) AS c FROM log WHERE op = 'C'), kept AS (SELECT * FROM log, cut WHERE op <> 'C' AND event_id <= c) SELECT key, e.value AS value FROM (SELECT key, arg_max({{'op': op, 'value': value}}, event_id) AS e FROM kept GROUP BY key) WHERE e.op = 'P'")
def committed_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(resolve.state(resolve.committed(with_markers(spark, sf_dir), "cv", F.col("op") == "C")))


@query(f"WITH {_MARKED}, cut AS (SELECT max(event_id) AS c FROM log WHERE op = 'C') SELECT key, op, value, event_id AS cv FROM log, cut WHERE op <> 'C' AND event_id > c")
def uncommitted_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(resolve.uncommitted(with_markers(spark, sf_dir), "cv", F.col("op") == "C")).drop("ord")


@query(f"WITH {_QUARTERED} SELECT key, arg_max(op, event_id) AS op, arg_max({{'v': value}}, event_id).v AS value, count(*) > 0 AS committed FROM layered GROUP BY key, layer")
def wal_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mutation in the log: of each layer the last one of a key, since a batch keeps one."""
    t = engine(spark, sf_dir, QUARTERS)
    return shown(t.raw_log_df().select("key", "op", F.col("value.f").alias("value"), "committed"))


@query("SELECT user_id, count(*) AS n, sum(CASE WHEN prev IS NOT NULL AND event_id <= prev THEN 1 ELSE 0 END) = 0 AS rising FROM (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) GROUP BY user_id")
def sequence_monotone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions rise along each key's history; by key, so that no task holds the whole log."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, sf_dir, "events").select("user_id", "event_id", F.lag("event_id").over(w).alias("prev"))
    return e.groupBy("user_id").agg(F.count("*").alias("n"), (F.sum(F.when(F.col("event_id") <= F.col("prev"), 1).otherwise(0)) == 0).alias("rising"))


# --- flush, compaction, runs ------------------------------------------------------


def _folder(spark: SparkSession) -> str:
    """A folder for a query's table: in the session's shared folder; a temporary one in local mode. Removed when Python ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
    folder = f"{re.sub('^file:/+', '/', base)}/kvspark-{uuid.uuid4().hex}" if base else tempfile.mkdtemp(prefix="kvspark-")
    store = place(spark, folder)
    store.make()
    atexit.register(_remove, store)
    return folder


def _remove(store: Local | Hadoop) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before Python does
        store.remove("")


def _parts(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The typed log in QUARTERS layers by event_id, oldest first."""
    log = _typed_log(spark, sf_dir)
    end = log.agg(F.max("cv")).first()[0] + 1
    part = F.floor(F.col("cv") * QUARTERS / end)
    return [log.filter(part == k).select("key", "op", "value", "cv") for k in range(QUARTERS)]


def engine(spark: SparkSession, sf_dir: str, layers: int = 1) -> Table:
    """A table of the engine with the event log in it: in one bulk batch, or in QUARTERS, a run each."""
    t = Database(spark, _folder(spark)).table("events", max_runs=100)
    for part in _parts(spark, sf_dir) if layers > 1 else [_typed_log(spark, sf_dir).select("key", "op", "value", "cv")]:
        t.put_df(part, order="cv")
    return t


def _touched(t: Table) -> Table:
    for k, v in ((b"7", 9.5), (b"12", None), (b"7", 1.5), (b"new", 2.5)):
        t.write([(k, v)])
    return t


def floats(df: DataFrame) -> DataFrame:
    return shown(df.select("key", F.col("value.f").alias("value")))


def _typed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    return log.withColumn("value", F.when(F.col("op") == V.PUT, V.typed("float", F.col("value"))))


@query(f"WITH {_TOUCHED}")
def flush_then_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small writes over a bulk run, flushed into a run of their own."""
    t = _touched(engine(spark, sf_dir))
    t.flush()
    return floats(t.df())


@query(f"WITH {_TOUCHED}")
def engine_flush_reopen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after closing and opening the table."""
    t = _touched(engine(spark, sf_dir))
    t.flush()
    t.close()
    return floats(Table(spark, t.folder).df())


@query(f"WITH {_TOUCHED}")
def engine_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from the log alone, beside a run that no commit names."""
    t = _touched(engine(spark, sf_dir))
    ghost = spark.createDataFrame([(bytearray(b"ghost"), "P", None, 10**9, 0)], V.LOG)
    runs.write_run(ghost, t.folder, unique=True)
    t.close()
    return floats(Table(spark, t.folder).df())


@query(f"WITH {_TOUCHED}")
def engine_auto_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A budget of a few bytes: every write is flushed, and runs beyond two are merged."""
    t = engine(spark, sf_dir)
    t.set_budget(1)
    t.max_runs = 2
    return floats(_touched(t).df())


@query(f"WITH {_STATE}, {_ASKED} SELECT CAST(pos AS INTEGER) AS pos, a.key, s.value FROM asked a LEFT JOIN state s ON a.key = s.key")
def engine_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single lookups over four runs, newest first: by key range, sparse index and block cache, or a pruned scan."""
    t = engine(spark, sf_dir, QUARTERS)
    found = [(i, k, t.get_value(k.encode())) for i, k in enumerate(ASKED)]
    return spark.createDataFrame([(i, k, v and v.data) for i, k, v in found], "pos int, key string, value double")


@query(f"WITH {_STATE}, {_ASKED} SELECT CAST(pos AS INTEGER) AS pos, a.key, s.value FROM asked a LEFT JOIN state s ON a.key = s.key")
def engine_multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests as a DataFrame: the log is cut down to their keys before it is merged."""
    found = engine(spark, sf_dir, QUARTERS).multi_get_df(_requests(spark))
    return shown(found).select("pos", "key", F.col("value.f").alias("value"))


@query(f"WITH {_STATE} SELECT * FROM state WHERE key >= '4' AND key < '5'")
def engine_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prefix over four runs: those whose keys lie outside aren't opened."""
    low, high = B.prefix_bounds(b"4")
    return floats(engine(spark, sf_dir, QUARTERS).df(low=low, high=high))


@query("SELECT * FROM (VALUES ('12', 'D', NULL), ('7', 'P', 1.5::DOUBLE), ('new', 'P', 2.5::DOUBLE)) t(key, op, value)")
def engine_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unflushed layer alone, deletions included."""
    t = _touched(engine(spark, sf_dir))
    return shown(t.pending_df().select("key", "op", F.col("value.f").alias("value")))


@query(f"WITH {_STATE} SELECT * FROM state WHERE key NOT IN ('7', '12') UNION ALL VALUES ('7', 3.5::DOUBLE), ('new', 2.5::DOUBLE)")
def engine_transaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Puts, a deletion and an overwrite, committed in one piece; the value written last was read within the transaction."""
    t = engine(spark, sf_dir)
    with t.transaction() as x:
        x.set_value(b"7", 2.5)
        x.delete_value(b"12")
        x.set_value(b"new", x.get_value(b"7").data)
        x.set_value(b"7", x.get_value(b"7").data + 1.0)
        x.commit()
    return floats(t.df())


@query("WITH first AS (SELECT min(event_id) AS id FROM events GROUP BY user_id % 5) SELECT 'i' || event_id AS key, 'integer' AS kind, CAST(CAST(user_id AS INTEGER) AS VARCHAR) AS value FROM events WHERE event_id IN (FROM first) UNION ALL SELECT 't' || event_id, 'text', event_type FROM events WHERE event_id IN (FROM first) UNION ALL SELECT 'b' || event_id, 'boolean', CAST(value > 50 AS VARCHAR) FROM events WHERE event_id IN (FROM first) UNION ALL SELECT 'd' || event_id, 'bytes', lower(hex(encode(event_type))) FROM events WHERE event_id IN (FROM first)")
def engine_typed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of four kinds, put one by one, flushed, and read back from the file; floats, deleted again, are not there."""
    t = Database(spark, _folder(spark)).table("cells")
    firsts = read(spark, sf_dir, "events").groupBy(F.col("user_id") % 5).agg(F.min_by(F.struct("event_id", "user_id", "event_type", "value"), "event_id").alias("e"))
    for e in firsts.select("e.*").collect():  # five rows
        cells = {"i": e.user_id, "t": e.event_type, "b": e.value > 50, "d": e.event_type.encode(), "f": e.value}
        for k, v in cells.items():
            t.set_value(f"{k}{e.event_id}".encode(), v)
        t.delete_value(f"f{e.event_id}".encode())
    t.flush()
    v = F.col("value")
    text = F.coalesce(v["i"].cast("string"), v["t"], v["b"].cast("string"), F.lower(F.hex(v["d"])), v["f"].cast("string"))
    return shown(t.scan_range().select("key", v["kind"].alias("kind"), text.alias("value")))


@query(f"WITH {_TOUCHED}")
def engine_vacuum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After a merge the log before it and the merged runs are cleared; the state, opened again, is the same."""
    t = _touched(engine(spark, sf_dir, QUARTERS))
    t.flush()
    t.compact()
    t.vacuum()
    t.close()
    return floats(Table(spark, t.folder).df())


@query(f"WITH {_QUARTERED} SELECT CAST(layer AS INTEGER) AS layer, count(*) AS rows, count(*) FILTER (op = 'D') AS tombstones FROM (SELECT layer, key, arg_max(op, event_id) AS op FROM layered GROUP BY layer, key) GROUP BY layer")
def engine_run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the manifest knows of each run, observed while it was written."""
    return engine(spark, sf_dir, QUARTERS).run_stats().select("layer", "rows", "tombstones")


@query(f"WITH {_QUARTERED}, e AS (SELECT key, arg_max({{'op': op, 'value': value}}, event_id) AS e FROM layered WHERE layer < 2 GROUP BY key) SELECT key, e.value AS value FROM e WHERE e.op = 'P'")
def engine_older_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after the second of four batches."""
    return floats(engine(spark, sf_dir, QUARTERS).df(version=2))


@query(f"WITH {_STATE} SELECT * FROM state")
def engine_in_a_hadoop_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table addressed by a URI, so that commits go through Hadoop's file systems."""
    folder = _folder(spark)
    t = Database(spark, f"file://{folder}" if folder.startswith("/") else folder).table("events")
    for part in _parts(spark, sf_dir):
        t.put_df(part, order="cv")
    t.close()
    return floats(Table(spark, t.folder).df())


@query(f"WITH {_STATE} SELECT * FROM state")
def compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four runs merged into one without deletions; reading it needs no merge."""
    t = engine(spark, sf_dir, QUARTERS)
    t.compact()
    return floats(t.df())


@query(f"WITH {_STATE} SELECT count(*) AS rows, CAST(0 AS BIGINT) AS tombstones, min(key) AS least, max(key) AS most FROM state")
def engine_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the manifest says of the one run that is left."""
    t = engine(spark, sf_dir, QUARTERS)
    t.compact()
    return t.run_stats().select("rows", "tombstones", F.col("least").cast("string").alias("least"), F.col("most").cast("string").alias("most"))


@query("SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS runs")
def compact_all_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = engine(spark, sf_dir)
    t.put_df(t.df().select("key", F.lit(None).cast("binary").alias("value"), F.lit(V.DELETE).alias("op")))
    t.compact()
    return t.df().agg(F.count("*").alias("n")).withColumn("runs", F.lit(len(t.runs)).cast("bigint"))


@query(f"WITH {_QUARTERED} SELECT CAST(layer AS INTEGER) AS layer, min(key) AS least, max(key) AS most, count(DISTINCT key) AS rows FROM layered GROUP BY layer")
def run_key_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = engine(spark, sf_dir, QUARTERS).run_stats()
    return r.select("layer", F.col("least").cast("string").alias("least"), F.col("most").cast("string").alias("most"), "rows")


@query(f"WITH {_QUARTERED}, r AS (SELECT CAST(layer AS INTEGER) AS layer, min(key) AS least, max(key) AS most FROM layered GROUP BY layer) SELECT layer, most >= '98' AND least < '985' AS overlaps FROM r")
def runs_overlapping_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = engine(spark, sf_dir, QUARTERS)
    low, high = B.Bound.included(b"98"), B.Bound.excluded(b"985")
    return spark.createDataFrame([(k, B.overlaps(low, high, r.least, r.most)) for k, r in enumerate(t.runs)], "layer int, overlaps boolean")


@query(f"WITH {_LOG}, {_ASKED} SELECT CAST(pos AS INTEGER) AS pos, key, EXISTS (SELECT 1 FROM log l WHERE l.key = a.key) AS found FROM asked a")
def bloom_no_false_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership of keys in the runs, those of deletions included: looked up by range, statistics and bloom filter."""
    t = engine(spark, sf_dir, QUARTERS)
    return spark.createDataFrame([(i, k, t.might_contain(k.encode())) for i, k in enumerate(ASKED)], "pos int, key string, found boolean")


@query(f"WITH {_LOG} SELECT key, CAST(sum(octet_length(encode(key)) + CASE op WHEN 'P' THEN 8 ELSE 0 END) AS BIGINT) AS bytes FROM log GROUP BY key")
def memtable_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(_typed_log(spark, sf_dir).withColumn("bytes", V.footprint()).groupBy("key").agg(F.sum("bytes").alias("bytes")))


@query(
    "WITH steps AS (SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) r(i)), "
    "content AS (SELECT page_id, hex(encode(html)) AS h FROM pages) "
    "SELECT page_id, xor(list_reduce([4294967295] || [CAST('0x' || substr(h, 2 * k - 1, 2) AS BIGINT) FOR k IN range(1, length(h) // 2 + 1)], lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM content, steps"
)
def block_crc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IEEE CRC32 of each page's content."""
    return read(spark, sf_dir, "pages").select("page_id", F.crc32(F.col("html").cast("binary")).alias("crc"))


# --- values and catalog -------------------------------------------------------------


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'integer' WHEN 1 THEN 'float' WHEN 2 THEN 'text' WHEN 3 THEN 'boolean' ELSE 'bytes' END AS kind, CASE WHEN event_id % 5 = 0 THEN CAST(user_id AS INTEGER) END AS i, CASE WHEN event_id % 5 = 1 THEN value END AS f, CASE WHEN event_id % 5 = 2 THEN event_type END AS t, CASE WHEN event_id % 5 = 3 THEN value > 50 END AS b, CASE WHEN event_id % 5 = 4 THEN upper(hex(encode(event_type))) END AS d FROM events")
def typed_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five kinds of cells in one struct column."""
    e = read(spark, sf_dir, "events")
    kinds = [("integer", F.col("user_id")), ("float", F.col("value")), ("text", F.col("event_type")), ("boolean", F.col("value") > 50), ("bytes", F.col("event_type").cast("binary"))]
    cell = F.when(F.col("event_id") % 5 == 0, V.typed(*kinds[0]))
    for n, k in enumerate(kinds[1:], 1):
        cell = cell.when(F.col("event_id") % 5 == n, V.typed(*k))
    v = e.select("event_id", cell.alias("v"))
    return v.select("event_id", "v.kind", "v.i", "v.f", "v.t", "v.b", F.hex("v.d").alias("d"))


@query("SELECT CAST(user_id AS VARCHAR) AS key, upper(hex(encode(arg_max(event_type, event_id)))) AS value FROM events GROUP BY user_id")
def byte_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes interface over cells that are all bytes where visible, though not where shadowed."""
    e = read(spark, sf_dir, "events")
    last = e.groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    visible = e.join(last.withColumn("top", F.lit(True)), ["user_id", "event_id"], "left")
    cell = F.when(F.col("top"), V.typed("bytes", F.col("event_type").cast("binary"))).otherwise(V.typed("float", F.col("value")))
    log = visible.select(_binary("user_id").alias("key"), F.lit(V.PUT).alias("op"), cell.alias("value"), F.col("event_id").alias("cv"), F.lit(0).alias("ord"))
    return shown(resolve.state(log).select("key", F.hex(V.byte_view()).alias("value")))


@query("SELECT DISTINCT event_type AS table_name FROM events WHERE event_type <> 'error'")
def tables_on_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table for each type of event, created when it is asked for; names that are taken or no names are refused."""
    with Database(spark, _folder(spark)) as db:
        for r in read(spark, sf_dir, "events").select("event_type").distinct().collect():  # a handful
            db.table(r.event_type).put(b"made", b"1")
            for name in (r.event_type, "", ".", "..", f"a/{r.event_type}"):
                with contextlib.suppress(TableExistsError, InvalidTableNameError):
                    db.create_table(name)
        db.delete_table("error")
        return db.tables_df()


@query("SELECT * FROM (VALUES ('orders'), ('users 2.x')) t(table_name)")
def list_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Database(spark, _folder(spark)) as db:
        for name in ("users 2.x", "gone", "orders"):
            db.create_table(name)
        db.delete_table("gone")
        return db.tables_df()
