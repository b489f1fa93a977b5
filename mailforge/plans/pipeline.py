"""The entry pipeline: resolve sources, union, clean, report, de-duplicate, balance, shuffle, write; and its manifest."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailforge.functions import text as X
from mailforge.operators import balance, sampling
from mailforge.plans.curation import digest, key_of
from mailforge.sources import registry, sinks


def cleaned(m: DataFrame) -> DataFrame:
    c = m.withColumns({"subject": X.strip(X.text(F.col("subject"))), "body": X.strip(X.text(F.col("body"))), "pos": F.struct("source_rank", "row_in_source")})
    return c.where("subject <> '' or body <> ''")


def unique(c: DataFrame, level: str) -> DataFrame:
    """The first row of each key, whole; the rows themselves move once, by the digest of their place."""
    first = c.groupBy(digest(key_of(level)).alias("_k")).agg(F.min("pos").alias("pos")).select("pos")
    return c.join(first, "pos", "left_semi")


def duplicate_report(c: DataFrame, level: str, samples: int = 5) -> DataFrame:
    """Groups of two rows or more in the order of the report, with their first samples side by side."""
    from pyspark.sql import Window

    k = c.withColumn("_k", digest(key_of(level)))
    g = k.groupBy("_k").agg(F.count("*").alias("duplicate_count"), F.sort_array(F.collect_set("label")).alias("labels"), F.sort_array(F.collect_set("source")).alias("sources"), F.min("pos").alias("first")).where("duplicate_count > 1")
    g = sampling.numbered(g, [F.col("first")], "duplicate_group_id")
    w = k.withColumn("i", F.row_number().over(Window.partitionBy("_k").orderBy("pos")) - 1).where(F.col("i") < samples)
    wide = w.groupBy("_k").agg(*[F.max(F.when(F.col("i") == i, F.col(c_))).alias(f"sample_{i}_{c_}") for i in range(samples) for c_ in ("subject", "label", "source")])
    out = g.join(wide, "_k").withColumns({"labels": F.to_json("labels"), "sources": F.to_json("sources"), "duplicate_detection": F.lit(level), "kept_subject": F.col("sample_0_subject"), "kept_source": F.col("sample_0_source"), "kept_label": F.col("sample_0_label")})
    return out.drop("_k", "first").orderBy(F.desc("duplicate_count"), "duplicate_group_id")


def combine(spark: SparkSession, folder: str, out: str, names, ratio: float = -1, dedup: str = "high", mode: str = "mixed", multiplier: float = 8.0, report: bool = False) -> str:
    """Path of the combined result; one that was made before by the same rules is used again."""
    atomic = registry.resolve(names)
    dedup = str(dedup).strip().lower()
    path = os.path.join(out, sinks.result_name(atomic, ratio, dedup, mode, multiplier))
    key_of(dedup)  # an unknown level is an error before any work
    done = os.path.exists(os.path.join(path, "_SUCCESS"))
    if done and not report:
        return path
    c = cleaned(registry.load(spark, folder, atomic)).withColumn("message_id", F.xxhash64("source_rank", "row_in_source"))
    if report:
        r = duplicate_report(c, dedup)
        sinks.write_csv(r, os.path.join(out, sinks.report_name(atomic, ratio, dedup)), r.columns, mode="overwrite")
    if not done:
        kept = balance.balanced(unique(c, dedup), mode, ratio, multiplier)
        shuffled = kept.withColumn("_h", sampling.order_of(sampling.SEED, "message_id")).repartitionByRange("_h").sortWithinPartitions("_h")
        sinks.write_parquet(shuffled.select("subject", "body", "label", "source"), path)
    return path


def manifest(spark: SparkSession, splits: dict[str, str], seed: int = sampling.SEED) -> dict:
    """Rows, labels and fingerprint overlaps of written splits, as a document for write_json; an overlap between two splits is an error."""
    entries, prints = {}, {}
    for name, path in splits.items():
        df = spark.read.parquet(path)
        n = df.agg(F.count("*").alias("rows"), F.count_if(F.col("label") == 0).alias("ham"), F.count_if(F.col("label") == 1).alias("spam")).first()
        entries[name] = {"rows": n.rows, "ham": n.ham, "spam": n.spam, "path": os.path.basename(path)}
        key = X.high_key(F.col("body"))
        prints[name] = df.select(X.fingerprint(key, X.sha256(X.exact_text(F.col("subject"), F.col("body")))).alias("fp")).distinct()
    overlap = {f"{a}|{b}": prints[a].join(prints[b], "fp", "left_semi").count() for a in prints for b in prints if a < b}
    if any(overlap.values()):
        raise ValueError(f"splits overlap: {overlap}")
    return {"schema_version": 1, "seed": seed, "checks": {"pairwise_overlap": overlap}, "splits": entries}
