"""URL filter: a trie over reversed host labels and path segments, longest match wins.

A rule is a host, a path and a verdict. It fits its host and all subdomains if
the URL's path starts with the rule's path, character by character. The trie's
levels are the host's labels from the last to the first; each node holds a second
trie over the whole segments of the rules' paths, whose nodes list what remains of
a path after its last slash. One walk down a URL's labels and segments meets every
rule that fits; the longest (host and path together, then the path, then the
rule's text) wins, whether it allows or blocks. URLs that no rule fits get the
default verdict.

The trie is broadcast while what it takes in a worker's memory, reckoned from the
rules' labels and segments, stays under ``BROADCAST_BYTES``; beyond that, ``judge``
joins instead: each URL lists its pairs of host suffix and path up to a slash (both
bounded by the URL's own length) and is joined with the rules under the same pair,
which splits by those pairs however many rules there are. URLs under one pair (``com``
and ``/``) are dealt to several tasks.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased. Path: from there up to ``?``, ``#`` or the end. A null URL, or one
without ``://``, has an empty host and path, which no rule fits.

Defined cases: equal URLs get equal verdicts, one row each; an empty table gives
no rows; columns named like the results are replaced; URLs may be of any length;
no rules: every URL gets the default; of rules with equal host and path ``block`` wins;
a rule with a null host, path or verdict, or an empty host, fits no URL.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

ALLOW, BLOCK = "allow", "block"
#: Memory of the broadcast trie, and what a rule takes: itself, and a dictionary for each label and segment.
BROADCAST_BYTES, RULE_BYTES, NODE_BYTES = 64 << 20, 400, 350
#: Tasks that the URLs under one pair are dealt to in the join.
WAYS = 16
Rule = tuple[str, str, str]


def parts(url: str = "url") -> tuple[Column, Column]:
    """Host and path of a URL column."""
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.expr(f"substring({url}, locate('://', {url}) + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def _lower(host: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host)


def _bytes(host: str, path: str) -> int:
    """What a rule takes in the trie, at most about."""
    return RULE_BYTES + 2 * len(host) + 2 * len(path) + NODE_BYTES * (host.count(".") + path.count("/") + 2)


def _split(path: str) -> tuple[list[str], str]:
    """Whole segments of a path (each ended by a slash), and the rest."""
    *whole, rest = path.split("/")
    return whole, rest


class Trie:
    """Rules by reversed host labels, then by path segments."""

    def __init__(self, rules: list[Rule]):
        self.root: dict = {}
        for host, path, verdict in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault("hosts", {}).setdefault(label, {})
            node = node.setdefault("paths", {})
            whole, rest = _split(path)
            for segment in whole:
                node = node.setdefault("next", {}).setdefault(segment, {})
            node.setdefault("rests", []).append((rest, (len(host) + len(path), len(path), host + path, verdict == BLOCK), verdict))

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits."""
        best = None
        whole, last = _split(path)
        node = self.root
        for label in reversed(host.split(".")) if host else ():
            node = node.get("hosts", {}).get(label)
            if node is None:
                break
            at = node.get("paths")
            if at is None:
                continue
            for depth in range(len(whole) + 1):
                text = whole[depth] if depth < len(whole) else last
                # a rule's rest may end anywhere in the next segment
                for rest, rank, verdict in at.get("rests", ()):
                    if text.startswith(rest) and (best is None or rank > best[0]):
                        best = rank, verdict
                at = at.get("next", {}).get(text) if depth < len(whole) else None
                if at is None:
                    break
        return best and (best[0][2], best[1])


def judge(urls: DataFrame, rules: list[Rule] | DataFrame, default: str = ALLOW, url: str = "url", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``urls`` with host, path, rule (null if none fits) and verdict.

    ``rules``: a list of (host, path, verdict), or a DataFrame with these columns
    for lists of any size, whose size is checked before anything is collected.
    """
    host, path = parts(url)
    split = urls.drop("host", "path", "rule", "verdict").withColumn("host", host).withColumn("path", path)
    if not isinstance(rules, DataFrame):
        rules = [r for r in rules if None not in r and r[0]]
        if sum(_bytes(h, p) for h, p, _ in rules) > broadcast_bytes:
            return _joined(split, urls.sparkSession.createDataFrame(rules, "host string, path string, verdict string"), default)
    else:
        rules = rules.select("host", "path", "verdict").dropna().filter("host != ''")
        nodes = F.length(F.regexp_replace("host", r"[^.]", "")) + F.length(F.regexp_replace("path", r"[^/]", "")) + 2
        size = rules.agg(F.sum(RULE_BYTES + 2 * F.length("host") + 2 * F.length("path") + NODE_BYTES * nodes)).first()[0] or 0
        if size > broadcast_bytes:
            return _joined(split, rules, default)
        rules = [tuple(r) for r in rules.collect()]
    sent = urls.sparkSession.sparkContext.broadcast(Trie([(_lower(h), p, v) for h, p, v in rules]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = sent.value
        for b in batches:
            found = [trie.match(h, p) for h, p in zip(b.column("host").to_pylist(), b.column("path").to_pylist())]
            cols = [pa.array([f and f[0] for f in found], pa.string()), pa.array([f[1] if f else default for f in found], pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*b.schema.names, "rule", "verdict"])

    schema = StructType([*split.schema.fields, StructField("rule", StringType()), StructField("verdict", StringType())])
    return split.mapInArrow(work, schema)


def _joined(split: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    keyed = rules.select(
        F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("r_host"),
        F.expr("substring(path, 1, length(path) - locate('/', reverse(path)) + 1)").alias("r_stem"),
        F.col("path").alias("r_path"),
        F.col("verdict").alias("r_verdict"),
    ).withColumn("r_stem", F.when(F.instr("r_path", "/") > 0, F.col("r_stem")).otherwise(""))
    # only what a rule can depend on goes through the join, once for equal URLs
    once = split.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    pieces = F.split("path", "/")
    stems = F.transform(F.sequence(F.lit(0), F.size(pieces) - 1), lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(pieces, F.lit(1), i), "/"), F.lit("/"))))
    asked = once.select("host", "path", F.explode(suffixes).alias("r_host"), stems.alias("stems")).select("host", "path", "r_host", F.explode("stems").alias("r_stem"))
    # rules are few beside URLs: each is sent WAYS times, so that no pair's URLs stay together
    dealt = asked.withColumn("way", F.pmod(F.xxhash64("host", "path"), F.lit(WAYS)).cast("int"))
    keyed = keyed.withColumn("way", F.explode(F.sequence(F.lit(0), F.lit(WAYS - 1))))
    fit = dealt.join(keyed, ["r_host", "r_stem", "way"]).filter(F.expr("startswith(path, r_path)") & (F.col("host") != ""))
    rank = F.struct(
        (F.length("r_host") + F.length("r_path")).alias("a"), F.length("r_path").alias("b"), F.concat("r_host", "r_path").alias("rule"), (F.col("r_verdict") == BLOCK).alias("c"), F.col("r_verdict").alias("verdict")
    )
    best = fit.groupBy("host", "path").agg(F.max(rank).alias("best"))
    # one column beside host and path, so no other name can clash; equal URLs, however many, are dealt by the rest of their rows
    whole = split.select("host", "path", F.struct(*(F.col(f"`{c}`") for c in split.columns)).alias("row"))
    ways = F.pmod(F.crc32(F.to_json("row").cast("binary")), F.lit(WAYS)).cast("int")
    spread = best.withColumn("way", F.explode(F.sequence(F.lit(0), F.lit(WAYS - 1))))
    out = whole.withColumn("way", ways).join(spread, ["host", "path", "way"], "left")
    return out.select("row.*", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
