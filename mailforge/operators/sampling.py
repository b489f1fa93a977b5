"""Exact samples and splits by a seeded hash, without a sort of a stratum.

Rows fall into buckets by the first digits of their hash; per-stratum counts of the buckets, a small table, tell where each cut of the order lies.
Only rows of a bucket that holds a cut are ranked, the others know their part from the bucket. The order is that of md5(seed | id), ties by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 67


def order_of(seed: int | Column, key: str) -> Column:
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat(seed.cast("string"), F.lit("|"), F.col(key).cast("string")).cast("binary"))


def parts(rows: DataFrame, by: list[str], cuts: DataFrame, seed: int = SEED, key: str = "message_id", digits: int = 3) -> DataFrame:
    """rows with ``part``: cuts has (by..., part, low, high); a row of rank r in its stratum is in the part with low < r <= high, others are dropped.

    A task ranks about 16 ** -digits of a stratum; cuts is small (a few rows for each stratum).
    """
    h = rows.withColumn("_h", order_of(seed, key)).withColumn("_b", F.substring("_h", 1, digits))
    counts = h.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1) if by else Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    of = cuts.groupBy(*by).agg(F.collect_list(F.struct("part", "low", "high")).alias("_cuts"))
    buckets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    buckets = buckets.join(F.broadcast(of), by) if by else buckets.crossJoin(F.broadcast(of))
    inside = lambda v: (v > F.col("_before")) & (v < F.col("_before") + F.col("_n"))
    buckets = buckets.withColumn("_open", F.exists("_cuts", lambda c: inside(c.low) | inside(c.high)))
    dealt = h.join(buckets, [*by, "_b"])
    rank = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h", key))
    closed = dealt.where("not _open").withColumn("_r", F.col("_before") + 1)
    ranked = dealt.where("_open").withColumn("_r", F.col("_before") + rank)
    out = closed.unionByName(ranked).withColumn("_part", F.get(F.filter("_cuts", lambda c: (F.col("_r") > c.low) & (F.col("_r") <= c.high)), F.lit(0)))
    return out.where("_part is not null").select(*rows.columns, F.col("_part.part").alias("part"))


def take(rows: DataFrame, by: list[str], quotas: DataFrame, seed: int = SEED, key: str = "message_id", digits: int = 3) -> DataFrame:
    """The first n rows of each stratum in hash order; quotas has (by..., n). 0 takes none, n beyond the stratum all; strata without a quota none."""
    if quotas.where("n < 0").limit(1).count():
        raise ValueError("a sample size must not be negative")
    cuts = quotas.select(*by, F.lit("taken").alias("part"), F.lit(0).cast("long").alias("low"), F.col("n").cast("long").alias("high"))
    return parts(rows, by, cuts, seed, key, digits).drop("part")


def numbered(rows: DataFrame, order: list[Column], name: str = "number") -> DataFrame:
    """rows with a number from 1 on in the given order: one range sort, written down, then offsets of the partitions; no single-task window."""
    from mailforge.session import cut

    parts_ = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s = cut(rows.repartitionByRange(parts_, *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    pid = F.shiftright("_m", 33)
    sizes = {r.p: r.n for r in s.groupBy(pid.alias("p")).agg(F.count("*").alias("n")).collect()}  # one row for each partition
    at, offsets = 0, []
    for p in sorted(sizes):
        offsets.append((p, at))
        at += sizes[p]
    table = rows.sparkSession.createDataFrame(offsets, "_p long, _o long")
    return s.withColumn("_p", pid).join(F.broadcast(table), "_p").withColumn(name, F.col("_o") + F.col("_m").bitwiseAND((1 << 33) - 1) + 1).drop("_m", "_p", "_o")
