"""Problem 4: mixing sources to target weights.

Documents are first aggregated by membership pattern (the set of cells of a mix a document may serve; a cell with a null source or label takes
any), which leaves a table whose size depends on the plan alone. Capacity in rows or tokens is then routed from patterns to cell quotas by a
min-cost flow with convex repetition costs: the first use of a pattern's documents is free, the second costs one a unit, the third two, up to
max_repeats.

The draw takes what the flow routes: in a pass of a pattern each cell holds one stretch of the pattern's documents in the order of a seeded hash,
as long as the flow on that arc. A document belongs to the stretch in which it begins, so a stretch is off by less than one document at either
end. Where a document stands is known without a sort of the pattern: sizes are summed per bucket of the hash, and only rows of one bucket are
ordered.

Defined results: rows of unknown source or null label serve no cell; a cell without rows gets 0 passes and is capped if it
needs anything; a mix whose weights sum to 0 needs nothing; null weights count as 0; an empty pool needs nothing; documents of size 0 or null
are never drawn; repeated message_ids are drawn each on its own.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from mailforge.functions.sources import canonical_source
from mailforge.session import small


def route(patterns: dict[frozenset, float], quotas: dict[object, float], repeats: dict[object, int]) -> dict[tuple[frozenset, object, int], float]:
    """Flow on the arcs (pattern, cell, pass) that meets the quotas at the least repetition cost, as far as capacity goes.

    Each pattern offers its size once per pass; a pass k of any cell costs k - 1 a unit, so first uses come first. Successive
    shortest paths (Bellman-Ford over the residual arcs) on a graph of patterns x passes + cells nodes, independent of the data's size.
    """
    source, sink = ("s",), ("t",)
    cap: dict = defaultdict(float)
    cost: dict = {}
    nodes = {source, sink}
    adjacent = defaultdict(set)

    def arc(a, b, c, w):
        cap[a, b] += c
        cost[a, b], cost[b, a] = w, -w
        adjacent[a].add(b)
        adjacent[b].add(a)
        nodes.update((a, b))

    for cell, quota in quotas.items():
        if quota > 0:
            arc(("c", cell), sink, quota, 0)
    for pattern, total in patterns.items():
        for k in range(1, max([repeats.get(c, 0) for c in pattern], default=0) + 1):
            p = ("p", pattern, k)
            arc(source, p, total, 0)
            for c in pattern:
                if k <= repeats.get(c, 0) and quotas.get(c, 0) > 0:
                    arc(p, ("c", c), total, k - 1)
    eps = 1e-12 * max([1.0, *quotas.values()])
    while True:
        best, previous = {source: 0.0}, {}
        heap = [(0.0, 0, source)]
        tick = 0
        while heap:  # label-correcting search; residual costs may be negative
            d, _, a = heapq.heappop(heap)
            if d > best[a]:
                continue
            for b in adjacent[a]:
                if cap[a, b] > eps and d + cost[a, b] < best.get(b, math.inf) - 1e-9:
                    best[b] = d + cost[a, b]
                    previous[b] = a
                    tick += 1
                    heapq.heappush(heap, (best[b], tick, b))
        if sink not in previous:
            break
        path, b = [], sink
        while b != source:
            path.append((previous[b], b))
            b = previous[b]
        push = min(cap[e] for e in path)
        for a, b in path:
            cap[a, b] -= push
            cap[b, a] += push
    return {(a[1], b[1], a[2]): cap[b, a] for (a, b) in list(cost) if a[0] == "p" and b[0] == "c" and cap[b, a] > eps}


#: Rows of a pattern that are ordered in one task, about; rows of a plan at most (cells and patterns are held by the driver).
BUCKET_ROWS, PLAN_ROWS = 50_000, 10_000


def pool(messages: DataFrame, registry: DataFrame, size: DataFrame | None = None) -> DataFrame:
    """(message_id, source, label, size): the messages of known source and non-null label; size 1, or from a table (message_id, size)."""
    known = registry.select(canonical_source(F.col("source")).alias("source")).where("source is not null").distinct()
    m = messages.select("message_id", canonical_source(F.col("source")).alias("source"), F.col("label").cast("int").alias("label")).where("label is not null and source is not null")
    m = m.join(small(known), "source", "left_semi")
    if size is None:
        return m.withColumn("size", F.lit(1).cast("long"))
    per = size.groupBy("message_id").agg(F.max("size").cast("long").alias("size"))
    return m.join(per, "message_id", "left").withColumn("size", F.coalesce("size", F.lit(0).cast("long")))


def serves(cell, source: str, label: int) -> bool:
    return cell.source in (None, source) and cell.label in (None, label)


def plan_mixes(rows: DataFrame, plan: DataFrame) -> tuple[list[dict], list[tuple]]:
    """(one dict per plan row, with its passes and need; the stretches (mix_name, source, label, number of the plan row, low, high) of the flow).

    Only the sizes of (source, label) reach the driver. Stretches are measured in the pattern's own order, that of its (source, label) pairs by
    name and within one by the seeded hash.
    """
    sizes = {(r.source, r.label): r.n for r in rows.groupBy("source", "label").agg(F.sum("size").alias("n")).collect()}
    total = sum(sizes.values())
    cells = plan.select("mix_name", "source", "label", F.coalesce("target_weight", F.lit(0.0)).alias("w"), F.coalesce("max_repeats", F.lit(0)).alias("r"), F.coalesce("pool_ratio", F.lit(0.0)).alias("ratio")).limit(PLAN_ROWS + 1).collect()
    if len(cells) > PLAN_ROWS:
        raise ValueError(f"a plan has at most {PLAN_ROWS} rows")
    out, stretches = [], []
    for name in dict.fromkeys(c.mix_name for c in cells):
        own = [(i, c) for i, c in enumerate(cells) if c.mix_name == name]
        weights = math.fsum(c.w for _, c in own)
        quotas = {i: (c.ratio * total * c.w / weights if weights > 0 else 0.0) for i, c in own}
        members = defaultdict(list)
        for key in sorted(k for k in sizes if sizes[k]):
            if pattern := frozenset(i for i, c in own if serves(c, *key)):
                members[pattern].append(key)
        flow = route({p: float(sum(sizes[k] for k in keys)) for p, keys in members.items()}, quotas, {i: int(c.r) for i, c in own})
        for i, c in own:
            there = sum(n for k, n in sizes.items() if serves(c, *k))
            passes = max([k for (_, cell, k) in flow if cell == i], default=0)
            out.append({"mix_name": name, "source": c.source, "label": c.label, "passes": passes, "capped": int(c.r * there < quotas[i]), "need": quotas[i], "row": i})
        for pattern, keys in members.items():
            for k in sorted({k for (p, _, k) in flow if p == pattern}):
                at = 0.0
                for i in sorted(i for (p, i, kk) in flow if p == pattern and kk == k):
                    low, at = at, at + flow[pattern, i, k]
                    base = 0
                    for key in keys:  # the part of the stretch in each (source, label)
                        a, b = max(low, base), min(at, base + sizes[key])
                        if b > a:
                            stretches.append((name, *key, i, a - base, b - base))
                        base += sizes[key]
    return out, stretches


PLAN_SCHEMA = "mix_name string, source string, label int, passes int, capped int"


def mix_passes(messages: DataFrame, registry: DataFrame, plan: DataFrame) -> DataFrame:
    rows, _ = plan_mixes(pool(messages, registry), plan)
    return messages.sparkSession.createDataFrame([(r["mix_name"], r["source"], r["label"], r["passes"], r["capped"]) for r in rows], PLAN_SCHEMA)


def placed(rows: DataFrame, seed: int) -> DataFrame:
    """The rows with ``at``, the total size of those before them in the seeded order of their (source, label)."""
    spark = rows.sparkSession
    cells = rows.groupBy("source", "label").count().collect()  # as many as registered sources and labels
    buckets = spark.createDataFrame([(r.source, r.label, -(-r["count"] // BUCKET_ROWS)) for r in cells], "source string, label int, buckets int")
    h = F.xxhash64(F.lit(seed), F.col("message_id"))
    dealt = rows.where("size > 0").join(F.broadcast(buckets), ["source", "label"]).withColumn("h", h).withColumn("bucket", F.expr("cast((h / 1.8446744073709552e19 + 0.5) * buckets as int)"))
    sums = dealt.groupBy("source", "label", "bucket").agg(F.sum("size").alias("n")).collect()  # one row for BUCKET_ROWS rows
    before, offsets = defaultdict(int), []
    for r in sorted(sums, key=lambda r: (r.source, r.label, r.bucket)):
        offsets.append((r.source, r.label, r.bucket, before[r.source, r.label]))
        before[r.source, r.label] += r.n
    offset = spark.createDataFrame(offsets, "source string, label int, bucket int, offset long")
    order = Window.partitionBy("source", "label", "bucket").orderBy("h", "message_id").rowsBetween(Window.unboundedPreceding, -1)
    inside = dealt.withColumn("inside", F.coalesce(F.sum("size").over(order), F.lit(0)))
    return inside.join(offset, ["source", "label", "bucket"]).select("source", "label", "message_id", "size", (F.col("offset") + F.col("inside")).alias("at"))


def draw(messages: DataFrame, registry: DataFrame, plan: DataFrame, seed: int = 67, size: DataFrame | None = None) -> DataFrame:
    """The drawn rows (mix_name, source, label, message_id, repeats, tokens): source and label are those of the plan row a document is drawn for,
    tokens its size (1 where rows count)."""
    spark = messages.sparkSession
    rows = pool(messages, registry, size)
    cells, stretches = plan_mixes(rows, plan)
    taken = spark.createDataFrame(stretches, "mix_name string, source string, label int, row int, low double, high double")
    named = spark.createDataFrame([(c["row"], c["source"], c["label"]) for c in cells], "row int, cell_source string, cell_label int")
    met = placed(rows, seed).join(F.broadcast(taken), ["source", "label"]).where("at >= low and at < high")  # as many stretches as arcs of the flow
    drawn = met.groupBy("mix_name", "row", "message_id", "at").agg(F.count("*").cast("int").alias("repeats"), F.max("size").alias("tokens"))
    return drawn.join(F.broadcast(named), "row").select("mix_name", F.col("cell_source").alias("source"), F.col("cell_label").alias("label"), "message_id", "repeats", "tokens")


def shares(messages: DataFrame, registry: DataFrame, plan: DataFrame, seed: int = 67, size: DataFrame | None = None) -> DataFrame:
    """Report per plan row: target share, size drawn with repeats, share reached."""
    got = draw(messages, registry, plan, seed, size).groupBy("mix_name", "source", "label").agg(F.sum(F.col("repeats") * F.col("tokens")).alias("drawn"))
    target = plan.select("mix_name", "source", "label", F.coalesce("target_weight", F.lit(0.0)).alias("w"))
    sums = target.groupBy("mix_name").agg(F.sum("w").alias("sw"))
    drawn = got.groupBy("mix_name").agg(F.sum("drawn").alias("sd"))
    keys = ["mix_name", "source", "label"]
    g = got.select(*[F.col(k).alias(f"g_{k}") for k in keys], "drawn")
    same = F.expr("mix_name = g_mix_name and source <=> g_source and label <=> g_label")
    out = target.join(F.broadcast(sums), "mix_name").join(F.broadcast(g), same, "left").join(F.broadcast(drawn), "mix_name", "left")  # at most PLAN_ROWS rows each
    return out.select(*keys, F.expr("try_divide(w, sw)").alias("target_share"), F.coalesce("drawn", F.lit(0)).alias("drawn"), F.coalesce(F.expr("try_divide(drawn, sd)"), F.lit(0.0)).alias("actual_share"))


def by_source_and_by_label(plan: DataFrame) -> DataFrame:
    """A plan of overlapping cells: for each mix one cell per source, of any label, and one per label, of any source, half the weight each."""
    half = lambda keep, any_, kind: plan.groupBy("mix_name", keep).agg((F.sum("target_weight") / 2).alias("target_weight"), F.max("max_repeats").alias("max_repeats"), F.max("pool_ratio").alias("pool_ratio")).withColumn(any_, F.lit(None).cast(kind))
    return half("source", "label", "int").unionByName(half("label", "source", "string"))
