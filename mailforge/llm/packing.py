"""Problem 9: filling containers of fixed capacity with whole texts.

Minimum bin slack on the histogram of lengths: the longest length left opens a container, a bitset subset-sum over the remaining
length counts finds the multiset that fills the rest closest to capacity, and the backtracked counts give a pattern. A pattern is
used as often as the counts allow at once. Every pattern leaves at least one length with fewer than capacity / length items, so there are at most
capacity * (2 + ln capacity) patterns whatever the size of the corpus; histogram and patterns are all that the driver sees.
Items then find their container by their rank within their length: ranks are counted per hash bucket and shifted by bucket
offsets. A length has one bucket for every BUCKET_ITEMS of its items, so that one holding most items is no single task.

Defined results: null and empty texts take no room and have no row; a text longer than the capacity is cut into full containers
and a rest, which is packed; repeated doc_ids are items of their own; an empty table has no containers.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from mailforge.llm.tokens import TOKENIZERS, token_counts
from mailforge.session import cut

#: Items of one length and limit that one task ranks, about.
BUCKET_ITEMS = 50_000


def fill(counts: dict[int, int], lengths: list[int], room: int) -> dict[int, int]:
    """The multiset of lengths, within counts, whose sum is closest to room from below; longer lengths first."""
    reach, mask, layers = 1, (1 << (room + 1)) - 1, []
    full = 1 << room
    for n in lengths:
        if n > room or not counts[n]:
            continue
        left, k = min(counts[n], room // n), 1
        while left > 0:
            k = min(k, left)
            after = (reach | reach << (n * k)) & mask
            if after != reach:
                layers.append((n, k, reach))
                reach = after
            left -= k
            k *= 2
        if reach & full:
            break
    s, used = reach.bit_length() - 1, Counter()
    for n, k, before in reversed(layers):
        if not before >> s & 1:
            s -= n * k
            used[n] += k
    return used


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(multiset of lengths, number of containers filled so), covering the histogram exactly."""
    counts = {n: c for n, c in histogram.items() if n > 0 and c > 0}
    out, lengths = [], sorted(counts, reverse=True)
    while lengths:
        top = lengths[0]
        counts[top] -= 1
        used = Counter(fill(counts, lengths, capacity - top))
        counts[top] += 1
        used[top] += 1
        times = min(counts[n] // k for n, k in used.items())
        out.append((dict(used), times))
        for n, k in used.items():
            counts[n] -= k * times
        lengths = [n for n in lengths if counts[n]]
    return out


def items(counts: DataFrame, limits: DataFrame) -> DataFrame:
    """(limit_id, doc_id, part_no, start_token, length) of all parts to place."""
    rest = counts.where("n_tokens > 0").crossJoin(F.broadcast(limits.select("limit_id", "max_tokens")))  # a few limits
    parts = rest.select("limit_id", "doc_id", "max_tokens", "n_tokens", F.explode(F.expr("sequence(0, (n_tokens - 1) div max_tokens)")).alias("part_no"))
    return parts.select("limit_id", "doc_id", F.col("part_no").cast("int").alias("part_no"), (F.col("part_no") * F.col("max_tokens")).cast("int").alias("start_token"), F.least(F.col("max_tokens"), F.col("n_tokens") - F.col("part_no") * F.col("max_tokens")).cast("int").alias("length"))


def containers(documents: DataFrame, limits: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """(limit_id, container_no, doc_id, part_no, start_token, end_token) for every pack limit."""
    spark = documents.sparkSession
    packs = [r for r in limits.where("purpose = 'pack' and max_tokens > 0 and limit_id is not null").select("limit_id", "tokenizer_name", "max_tokens").collect()]
    whole = None
    for name in sorted({r.tokenizer_name for r in packs}):
        own = spark.createDataFrame([(r.limit_id, r.max_tokens) for r in packs if r.tokenizer_name == name], "limit_id int, max_tokens int")
        part = items(cut(token_counts(documents.where("text is not null and text <> ''"), name, folder)), own)
        whole = part if whole is None else whole.unionByName(part)
    schema = "limit_id int, container_no long, doc_id long, part_no int, start_token int, end_token int"
    if whole is None:
        return spark.createDataFrame([], schema)
    lengths = whole.groupBy("limit_id", "length").count().collect()  # at most capacity rows a limit
    dealt = spark.createDataFrame([(r.limit_id, r.length, -(-r["count"] // BUCKET_ITEMS)) for r in lengths], "limit_id int, length int, buckets int")
    bucket = F.pmod(F.xxhash64("doc_id", "part_no"), F.col("buckets")).cast("int")
    placed = whole.join(F.broadcast(dealt), ["limit_id", "length"]).withColumn("bucket", bucket).drop("buckets")
    if any(r["count"] > BUCKET_ITEMS for r in lengths):
        histogram = placed.groupBy("limit_id", "length", "bucket").count().collect()  # at most capacity rows a limit and one for BUCKET_ITEMS items
    else:
        histogram = [Row(limit_id=r.limit_id, length=r.length, bucket=0, count=r["count"]) for r in lengths]
    offsets, slots = {}, defaultdict(list)
    by_length = defaultdict(Counter)
    for r in sorted(histogram, key=lambda r: (r.limit_id, r.length, r.bucket)):
        offsets[r.limit_id, r.length, r.bucket] = by_length[r.limit_id][r.length]
        by_length[r.limit_id][r.length] += r["count"]
    for r in packs:
        next_container, taken = 0, Counter()
        for used, times in patterns(by_length[r.limit_id], r.max_tokens):
            for n, k in used.items():
                slots[r.limit_id, n].append((taken[n], k, next_container))
                taken[n] += k * times
            next_container += times
    table = {k: np.array(v, np.int64) for k, v in slots.items()}
    shared = spark.sparkContext.broadcast((offsets, table))  # bounded by the number of patterns

    def place(batches):
        offsets, table = shared.value
        for b in batches:
            if not len(b):
                continue
            b = b.reset_index(drop=True)
            out = np.zeros(len(b), np.int64)
            for (limit, n, bucket), at in b.groupby(["limit_id", "length", "bucket"]).indices.items():
                rank = b["rank"].to_numpy()[at] - 1 + offsets[limit, n, bucket]
                s = table[limit, n]
                j = np.searchsorted(s[:, 0], rank, "right") - 1
                out[at] = s[j, 2] + (rank - s[j, 0]) // s[j, 1]
            yield pd.DataFrame({"limit_id": b["limit_id"], "container_no": out, "doc_id": b["doc_id"], "part_no": b["part_no"], "start_token": b["start_token"], "end_token": b["start_token"] + b["length"]})

    order = Window.partitionBy("limit_id", "length", "bucket").orderBy("doc_id", "part_no")
    return placed.withColumn("rank", F.row_number().over(order)).mapInPandas(place, schema)


def fill_report(packed: DataFrame, limits: DataFrame) -> DataFrame:
    """Per limit: containers, items, tokens and the share of room that is used."""
    agg = packed.groupBy("limit_id").agg((F.max("container_no") + 1).alias("containers"), F.count("*").alias("items"), F.sum(F.col("end_token") - F.col("start_token")).alias("tokens"))
    return agg.join(F.broadcast(limits.select("limit_id", "max_tokens")), "limit_id").select("limit_id", "containers", "items", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("max_tokens")), 6).alias("used_share"))
