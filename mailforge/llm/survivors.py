"""Problem 2: one survivor for each group of duplicate records, chosen field by field.

Members are unpivoted into long (group, field, value) rows, every row carrying the vote of the member that offers the value. Values are normalised:
canonical sources, labels, and the digest of a text's words in lower case between single blanks. A vote is source trust, 1 / (1 + trust_rank),
times recency decay, one half for each half_life_days before the last load of the table; for bodies also times completeness, the
characters. Votes are summed per normalised value, max_by picks the winning value of a field (ties: the preferred voter), and a pivot
puts the survivor together again. What is shown of a value is its preferred voter's.

With ``half_life_days=None`` a member's vote is more than all votes of the members it is preferred to together: votes are powers of a base
greater than the number of members, and no two members of a group have the same exponent, as (completeness, trust, recency, row) orders them
strictly. A sum of such votes compares like its greatest exponent, all that is kept of it, so the aggregate is ``max`` and exact at any size. All
aggregates combine on the map side, so a group holding a third of the rows shuffles one row per task and value.

Defined results: null or unknown sources have the lowest trust; null loaded_at is the oldest; rows with a null group or row
index are no members; a field without a qualifying value has no row; an empty input gives no rows; extra columns are ignored.
Rows of one original_row_index loaded at the same time: the one with the greater sample_index counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailforge.functions.sources import canonical_source
from mailforge.session import small

#: Subjects that say nothing.
PLACEHOLDER_SUBJECTS = ("(no subject)", "n/a", "none", "-")
WORST = 2**31 - 1
EPOCH = "1900-01-01 00:00:00"


def strip(col: Column) -> Column:
    return F.regexp_replace(col, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def latest_members(samples: DataFrame) -> DataFrame:
    """Each (duplicate_group_id, original_row_index) once, in the version loaded last."""
    cols = ["duplicate_group_id", "original_row_index", "sample_index", "subject", "body", "label", "source", "loaded_at"]
    s = samples.select(*cols).where("duplicate_group_id is not null and original_row_index is not null")
    s = s.withColumn("loaded_at", F.coalesce("loaded_at", F.lit(EPOCH).cast("timestamp_ntz").cast(samples.schema["loaded_at"].dataType)))
    subject, body = strip(F.coalesce("subject", F.lit(""))), strip(F.coalesce("body", F.lit("")))
    offers = F.struct(
        F.col("loaded_at"),
        F.coalesce("sample_index", F.lit(-1)).alias("sample_index"),
        canonical_source(F.col("source")).alias("source"),
        F.col("label").cast("int").alias("label"),
        ((subject != "") & ~F.lower(subject).isin(*PLACEHOLDER_SUBJECTS)).alias("has_subject"),
        F.length(body).alias("body_chars"),
        digest(subject).alias("subject_digest"),
        digest(body).alias("body_digest"),
    )
    best = s.groupBy("duplicate_group_id", "original_row_index").agg(F.max(offers).alias("m"))
    return best.select("duplicate_group_id", "original_row_index", "m.*")


#: The trust_rank that sources count with which have none, where votes are summed.
NO_TRUST = 1000


def digest(text: Column) -> Column:
    """Digest of a text in lower case with single blanks between its words."""
    return F.md5(strip(F.regexp_replace(F.lower(text), r"(?U)[\s\x1c-\x1f]+", " ")).cast("binary"))


def long_votes(members: DataFrame, registry: DataFrame, half_life_days: float | None = None) -> DataFrame:
    """Rows (duplicate_group_id, field_name, value, shown, quality, preference struct, vote) of all values the members offer."""
    trust = registry.groupBy(canonical_source(F.col("source")).alias("source")).agg(F.min("trust_rank").alias("trust_rank"))
    m = members.join(small(trust), "source", "left")
    rank = F.coalesce("trust_rank", F.lit(WORST))
    preference = F.struct((-rank).alias("trust"), F.col("loaded_at").alias("loaded_at"), (-F.col("original_row_index")).alias("row"))
    row, label = F.col("original_row_index").cast("string"), F.col("label").cast("string")
    one = F.lit(1).cast("long")
    fields = [
        ("kept_source", F.coalesce("source", F.lit("\x00")), F.coalesce("source", F.lit("\x00")), one, F.lit(True)),
        ("kept_label", label, label, one, F.col("label").isNotNull()),
        ("kept_subject_row", F.col("subject_digest"), row, one, F.col("has_subject")),
        ("kept_body_row", F.col("body_digest"), row, F.col("body_chars").cast("long"), F.col("body_chars") > 0),
    ]
    offers = F.array(*[F.struct(F.lit(n).alias("field_name"), v.alias("value"), shown.alias("shown"), q.alias("quality"), ok.alias("ok")) for n, v, shown, q, ok in fields])
    vote = F.lit(1.0)
    if half_life_days is not None:
        seconds = lambda c: F.unix_micros(c.cast("timestamp")) / F.lit(1e6)
        last = members.agg(F.max("loaded_at").alias("last"))  # one row
        m = m.crossJoin(F.broadcast(last))
        vote = F.pow(F.lit(0.5), (seconds(F.col("last")) - seconds(F.col("loaded_at"))) / F.lit(86400.0 * half_life_days)) / (1 + F.coalesce("trust_rank", F.lit(NO_TRUST)))
    return (
        m.select("duplicate_group_id", preference.alias("preference"), vote.alias("vote"), F.explode(offers).alias("o"))
        .where("o.ok")
        .select("duplicate_group_id", "o.field_name", "o.value", "o.shown", "o.quality", "preference", "vote")
    )


def survivors_long(samples: DataFrame, registry: DataFrame, half_life_days: float | None = None) -> DataFrame:
    """Survivors as (duplicate_group_id, field_name, field_value); fields without a qualifying member have no row."""
    members = latest_members(samples)
    votes = long_votes(members, registry, half_life_days)
    best = F.struct("quality", "preference")
    total = F.max(best) if half_life_days is None else F.struct(F.round(F.sum(F.col("quality") * F.col("vote")), 9).alias("votes"), F.max(best).alias("best"))
    per_value = votes.groupBy("duplicate_group_id", "field_name", "value").agg(total.alias("total"), F.max_by("shown", best).alias("shown"))
    winners = per_value.groupBy("duplicate_group_id", "field_name").agg(F.max_by("shown", "total").alias("field_value"))
    winners = winners.withColumn("field_value", F.nullif("field_value", F.lit("\x00")))
    whole = members.groupBy("duplicate_group_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("label")).alias("labels"))
    labels = F.concat(F.lit("["), F.array_join(F.transform("labels", lambda x: x.cast("string")), ", "), F.lit("]"))
    counted = whole.select("duplicate_group_id", F.explode(F.array(F.struct(F.lit("duplicate_count").alias("field_name"), F.col("n").cast("string").alias("field_value")), F.struct(F.lit("labels").alias("field_name"), labels.alias("field_value")))).alias("o")).select("duplicate_group_id", "o.*")
    return winners.unionByName(counted)


def survivors_wide(samples: DataFrame, registry: DataFrame, half_life_days: float | None = None) -> DataFrame:
    """One row per group: the pivot of survivors_long, with the winning rows' subject and body."""
    names = ["kept_source", "duplicate_count", "labels", "kept_label", "kept_subject_row", "kept_body_row"]
    wide = survivors_long(samples, registry, half_life_days).groupBy("duplicate_group_id").pivot("field_name", names).agg(F.first("field_value"))
    key = F.struct(F.coalesce("loaded_at", F.lit(EPOCH).cast("timestamp_ntz").cast(samples.schema["loaded_at"].dataType)), F.coalesce("sample_index", F.lit(-1)))
    texts = samples.groupBy("duplicate_group_id", "original_row_index").agg(F.max_by(F.struct("subject", "body"), key).alias("t"))
    subject = texts.select("duplicate_group_id", F.col("original_row_index").cast("string").alias("kept_subject_row"), F.col("t.subject").alias("subject"))
    body = texts.select("duplicate_group_id", F.col("original_row_index").cast("string").alias("kept_body_row"), F.col("t.body").alias("body"))
    out = wide.join(subject, ["duplicate_group_id", "kept_subject_row"], "left").join(body, ["duplicate_group_id", "kept_body_row"], "left")
    return out.select("duplicate_group_id", "kept_source", F.col("duplicate_count").cast("long").alias("duplicate_count"), "labels", F.col("kept_label").cast("int").alias("label"), "subject", "body")
