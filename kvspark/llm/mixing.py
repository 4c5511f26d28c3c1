"""Mixing sources to target weights: Poisson replication, DataFrame functions only.

A source's target repetition rate is the share asked for it times the size of
the whole table, over its own size. Each document draws a uniform number from
MD5(seed, id), the Poisson distribution with the rate as mean is inverted at it,
and the document is exploded by the count. The copies are then shuffled globally:
each is dealt to a partition by a hash of its own and sorted there by another, so
no source, however large, stays together.

A rate above ``MOST_MEAN`` is split into equal parts of at most that mean, each
drawn from a hash of its own: a sum of independent Poisson counts is a Poisson
count, so the distribution is the same at every rate and the inverted one short.

Defined cases: sources outside ``targets`` (null included) share the weight
``other`` as one group; a weight of 0 drops a source by request; a target source
without documents adds nothing, and its weight is shared among the others in
proportion. A null doc_id draws as id ''. Rows that repeat an id draw the same
count each. Null and empty texts are documents like any other. An empty table
gives no rows. All columns are kept, but for one named like a column that is asked
for (``copy_col``, or ``mix_copies`` of ``counted``), which that one replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Uniform numbers have this many bits.
BITS = 52
#: Mean of the distribution that is inverted, at most, and its terms: beyond them lies less than 2^-52.
MOST_MEAN, TERMS = 32, 128


def uniform(seed: int, col: str, part: Column) -> Column:
    """A number in (0, 1) from the hash of the seed, the column, and the number of the draw."""
    key = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(col).cast("string"), F.lit("")), part.cast("string"))
    bits = F.conv(F.substring(F.md5(key), 1, BITS // 4), 16, 10).cast("bigint")
    return (bits + F.lit(0.5)) / F.lit(float(1 << BITS))


def _keyed(docs: DataFrame, targets: dict[str, float], source: str, key: str) -> DataFrame:
    """mix_row (the whole row, so no column's name can clash), mix_own (its group), mix_key."""
    group = F.when(F.col(source).isin(list(targets)), F.col(source)).otherwise(F.lit(None).cast("string"))
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("mix_row"), group.alias("mix_own"), F.col(key).alias("mix_key"))


def rates(groups: DataFrame, targets: dict[str, float], other: float) -> DataFrame:
    """mix_group, parts, cdf (of one part) from the column mix_own: a row a group, len(targets) + 1 at most."""
    sizes = groups.groupBy(F.col("mix_own").alias("mix_group")).agg(F.count("*").alias("n"))
    weight = F.lit(float(other))
    for name, w in targets.items():
        weight = F.when(F.col("mix_group") == name, F.lit(float(w))).otherwise(weight)
    weighed = sizes.withColumn("w", weight)
    # a window over len(targets) + 1 rows at most
    every = Window.partitionBy(F.lit(1))
    summed = weighed.withColumns({"all_n": F.sum("n").over(every), "all_w": F.sum("w").over(every)})
    rated = summed.withColumn("rate", F.when(F.col("all_w") > 0, F.col("w") / F.col("all_w") * F.col("all_n") / F.col("n")).otherwise(0.0))
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / MOST_MEAN)).cast("int")
    mean = F.col("rate") / F.col("parts")
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.array(F.exp(-mean)).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.array_append(acc["cdf"], acc["c"] + p).alias("cdf"))

    cdf = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda a: a["cdf"])
    return rated.withColumn("parts", parts).select("mix_group", "parts", cdf.alias("cdf"))


def _counted(docs: DataFrame, targets: dict[str, float], other: float, seed: int, source: str, key: str) -> DataFrame:
    keyed = _keyed(docs, targets, source, key)
    # len(targets) + 1 rows of 1.1 kB: bounded by a parameter
    by_group = F.broadcast(rates(keyed.select("mix_own"), targets, other))
    joined = keyed.join(by_group, F.col("mix_own").eqNullSafe(F.col("mix_group")))

    def drawn(part: Column) -> Column:
        u = F.array(uniform(seed, "mix_key", part))  # a variable, so that the number is hashed once
        return F.aggregate(u, F.lit(0), lambda _, x: F.size(F.filter("cdf", lambda c: c < x)))

    copies = F.aggregate(F.sequence(F.lit(1), F.col("parts")), F.lit(0), lambda n, part: n + drawn(part))
    return joined.select("mix_row", "mix_key", copies.alias("mix_copies"))


def _others(docs: DataFrame, name: str | None) -> list[Column]:
    """The columns of mix_row but for one of that name."""
    return [F.col(f"mix_row.`{c}`") for c in docs.columns if name is None or c.lower() != name.lower()]


def counted(docs: DataFrame, targets: dict[str, float], other: float, seed: int, source: str = "source", key: str = "doc_id") -> DataFrame:
    """``docs`` with mix_copies, the number of times each row is to appear."""
    return _counted(docs, targets, other, seed, source, key).select(*_others(docs, "mix_copies"), "mix_copies")


def mix(docs: DataFrame, targets: dict[str, float], other: float, seed: int = 1, source: str = "source", key: str = "doc_id", copy_col: str | None = None) -> DataFrame:
    """The mixed corpus, globally shuffled, with the columns of ``docs``; ``copy_col`` names the copy's number, from 1."""
    n = _counted(docs, targets, other, seed, source, key).filter("mix_copies > 0")
    copies = n.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))))
    place = F.xxhash64(F.lit(seed), F.col("mix_key"), F.col("mix_copy"))
    order = F.xxhash64(F.lit(seed + 1), F.col("mix_key"), F.col("mix_copy"))
    dealt = copies.withColumn("mix_place", place).repartition("mix_place").sortWithinPartitions(order)
    return dealt.select(*_others(docs, copy_col), *([F.col("mix_copy").alias(copy_col)] if copy_col else []))
