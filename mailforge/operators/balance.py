"""Class and source balance. Only counts of (source, label) cells reach the driver; rows are taken by exact hash thresholds (sampling)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailforge.operators import sampling

LABELS = {0: "ham", 1: "spam"}
MODES = ("balanced_source_50_50", "mixed", "mixed_50_50", "source_aware_50_50")
#: Cells, of registered sources and two labels, that the driver holds at most.
CELLS = 10_000


def check_ratio(ratio: float) -> None:
    if ratio != -1 and not 0 <= ratio <= 1:
        raise ValueError("spam_ham_ratio must be between 0.0 and 1.0, or -1 to disable balancing.")


def cells(m: DataFrame) -> list:
    out = m.groupBy("source", "label").count().limit(CELLS + 1).collect()
    if len(out) > CELLS:
        raise ValueError(f"more than {CELLS} cells of source and label")
    return out


def quotas(spark: SparkSession, rows: list[tuple], by: str) -> DataFrame:
    return spark.createDataFrame(rows, f"{by}, n long")


def by_ratio(m: DataFrame, ratio: float, seed: int = sampling.SEED) -> DataFrame:
    """The class that limits stays whole, the other is cut to the whole number; -1 leaves all, 0 and 1 leave one class."""
    check_ratio(ratio)
    if ratio == -1:
        return m
    n = {r.label: r["count"] for r in m.groupBy("label").count().collect()}  # a row for each label
    spam, ham = n.get(1, 0), n.get(0, 0)
    if ratio in (0, 1):
        if not n.get(int(ratio)):
            raise ValueError(f"no rows of class {LABELS[int(ratio)]} for ratio {ratio}")
        return m.where(F.col("label") == int(ratio))
    if not spam or not ham:
        raise ValueError("balance needs rows of both classes")
    if spam / ratio <= ham / (1 - ratio):
        ham = int(spam * (1 - ratio) / ratio)
    else:
        spam = int(ham * ratio / (1 - ratio))
    if not spam or not ham:
        raise ValueError("the ratio leaves no rows of one class")
    return sampling.take(m, ["label"], quotas(m.sparkSession, [(0, ham), (1, spam)], "label int"), seed)


def caps(m: DataFrame, multiplier: float) -> DataFrame:
    """(label, source, n, cap, target): each source capped at multiplier times the class's smallest; target is the smaller class's total."""
    if multiplier < 1:
        raise ValueError("the multiplier must be 1 or more")
    c = m.groupBy("label", "source").agg(F.count("*").alias("n"))
    cap = F.least("n", F.greatest(F.lit(1), F.ceil(F.min("n").over(Window.partitionBy("label")) * F.lit(float(multiplier))))).cast("long")
    c = c.withColumn("cap", cap)
    target = c.groupBy("label").agg(F.sum("cap").alias("t")).agg(F.min("t").alias("target"))
    return c.crossJoin(F.broadcast(target))  # one row


def shares_of(capacity: np.ndarray, names: np.ndarray, target: int) -> np.ndarray:
    """Units of target for each capacity: by its square root in rounds of largest remainders, one unit each first if there are enough."""
    if target > capacity.sum():
        raise ValueError(f"{target} asked for, {capacity.sum()} available")
    if target == capacity.sum():
        return capacity.copy()
    root = np.sqrt(capacity.astype(float))
    given = np.minimum(capacity, 1) * int(target >= (capacity > 0).sum())
    while (rest := target - given.sum()) > 0:
        room = capacity - given
        wish = rest * root * (room > 0) / root[room > 0].sum()
        step = np.minimum(np.floor(wish).astype(np.int64), room)
        by_name = np.empty(len(names), np.int64)
        by_name[np.argsort(names)] = np.arange(len(names))
        order = np.lexsort((by_name, room, wish - np.floor(wish)))[::-1]
        order = order[(step < room)[order]]
        step[order[: rest - step.sum()]] += 1
        given = given + step
    return given


def source_aware(m: DataFrame, multiplier: float = 8.0) -> DataFrame:
    """Classes of equal size; within each, sources get their shares of it, drawn by a seed of mode, class and source."""
    c = caps(m, multiplier).where(F.col("label").isin(0, 1)).limit(CELLS).collect()
    if {r.label for r in c} != {0, 1}:
        raise ValueError("source_aware_50_50 requires both spam and ham samples.")
    plan = []
    for label in LABELS:
        own = [r for r in c if r.label == label]
        given = shares_of(np.array([r.cap for r in own]), np.array([r.source for r in own]), own[0].target)
        plan += [(label, r.source, int(n)) for r, n in zip(own, given)]
    seed = F.concat(F.lit("source_aware_50_50/"), F.when(F.col("label") == 0, "ham").otherwise("spam"), F.lit("/"), F.col("source"))
    return sampling.take(m, ["label", "source"], quotas(m.sparkSession, plan, "label int, source string"), seed)


def by_smallest_cell(m: DataFrame, seed: int = sampling.SEED) -> DataFrame:
    """As many rows of each source and class as the smallest such cell has; every source must have both classes."""
    c = cells(m)
    have = {(r.source, r.label): r["count"] for r in c}
    sources = sorted({r.source for r in c})
    one_sided = [s for s in sources if not all(have.get((s, x)) for x in LABELS)]
    if one_sided:
        raise ValueError("sources without one of the classes: " + ", ".join(one_sided))
    n = min(have.values(), default=0)
    return sampling.take(m, ["source", "label"], quotas(m.sparkSession, [(s, x, n) for s in sources for x in LABELS], "source string, label int"), seed)


def stratified_counts(m: DataFrame, limit: int) -> DataFrame:
    """(label, n): shares of limit by class, rounded half to even; the last class takes the rest."""
    n = sorted((r.label, r["count"]) for r in m.groupBy("label").count().collect())
    total, rest, out = sum(c for _, c in n), limit, []
    for i, (label, c) in enumerate(n):
        k = min(rest, c) if i == len(n) - 1 else max(0, min(round(limit * c / total), c, rest))
        out.append((label, k))
        rest -= k
    if rest:
        raise ValueError(f"{rest} of {limit} stratified rows cannot be allotted")
    return quotas(m.sparkSession, out, "label int")


def plain_sample(m: DataFrame, limit: int, seed: int = sampling.SEED) -> DataFrame:
    return m if limit <= 0 else sampling.take(m, [], quotas_of_all(m.sparkSession, limit), seed)


def quotas_of_all(spark: SparkSession, n: int) -> DataFrame:
    return spark.createDataFrame([(n,)], "n long")


def first_of_each_class(m: DataFrame) -> DataFrame:
    """The first rows of each class in table order; cuts by range need no single task: rows are numbered in one range sort."""
    o = sampling.numbered(m.select("message_id", "label", "pos"), [F.col("label"), F.col("pos")])
    first = o.groupBy("label").agg(F.min("number").alias("first"), F.count("*").alias("n"))
    least = first.agg(F.min("n").alias("least"))
    return o.join(F.broadcast(first.crossJoin(least)), "label").where(F.col("number") - F.col("first") < F.col("least"))  # a row for each label


def validation(m: DataFrame, size: int, seed: int = sampling.SEED) -> DataFrame:
    """m with part: validation for the first rows in hash order, remaining for the others."""
    n = m.count()
    if n < 2 * size:
        raise ValueError(f"{2 * size} rows are needed, {n} are there")
    cuts = m.sparkSession.createDataFrame([("validation", 0, size), ("remaining", size, n)], "part string, low long, high long")
    return sampling.parts(m, [], cuts, seed)


def stratified_validation(m: DataFrame, size: int, seed: int = sampling.SEED) -> DataFrame:
    taken = stratified_counts(m, size)
    cuts = taken.select("label", F.inline(F.array(F.struct(F.lit("validation").alias("part"), F.lit(0).cast("long").alias("low"), F.col("n").alias("high")), F.struct(F.lit("remaining").alias("part"), F.col("n").alias("low"), F.lit(2**62).alias("high")))))
    return sampling.parts(m, ["label"], cuts, seed)


def halves(spark: SparkSession, n: int) -> DataFrame:
    """(label, n): half of n rounded down of class 0, the rest of class 1."""
    return spark.createDataFrame([(0, n // 2), (1, n - n // 2)], "label int, n long")


def spaced(n: int, keep: int) -> list[int]:
    """Indexes of keep evenly spaced items of n, first and last included; one item is the last, 0 or less keeps all."""
    if keep <= 0 or keep >= n:
        return list(range(n))
    if keep == 1:
        return [n - 1]
    return sorted({round(i * (n - 1) / (keep - 1)) for i in range(keep)})


def ratio_token(ratio: float) -> str:
    return "all_samples" if ratio == -1 else f"spam_{str(ratio).replace('.', '_')}"


def check_mode(mode: str, ratio: float, multiplier: float) -> str:
    """The mode in its usual spelling, after all rules on it, the ratio and the multiplier."""
    check_ratio(ratio)
    mode = str(mode).strip().lower()
    if mode not in MODES:
        raise ValueError(f"combination_mode must be one of: {', '.join(MODES)}")
    if not math.isfinite(multiplier) or multiplier < 1:
        raise ValueError("source_aware_max_multiplier must be >= 1.")
    if mode != "mixed" and ratio not in (-1, 0.5):
        raise ValueError("the 50/50 modes take a ratio of -1 or 0.5 only")
    return mode


def balanced(m: DataFrame, mode: str = "mixed", ratio: float = -1, multiplier: float = 8.0) -> DataFrame:
    mode = check_mode(mode, ratio, multiplier)
    if mode == "source_aware_50_50":
        return source_aware(m, multiplier)
    if mode == "balanced_source_50_50":
        return by_smallest_cell(m)
    return by_ratio(m, 0.5 if mode == "mixed_50_50" else ratio)
