"""Curation of the message table: cleaning, de-duplication, reports, balance, samples, splits, overlap of sources and splits.

``messages`` is the cleaned table: outer white space stripped, rows empty in both texts dropped, sources in canonical spelling. Its order, in
which the first of equal rows is kept, is ``pos`` (source rank, row in source, id). Keys are grouped as 16-byte digests, texts never are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailforge.functions import text as X
from mailforge.functions.sources import canonical_source
from mailforge.operators import balance, sampling
from mailforge.plans.rules import CLEAN, GROUPS, KEYED, PRINTS, collapse, hashed, normal_form, ranked, strip
from mailforge.session import cut, spread, table

QUERIES, SQL = {}, {}
#: Parameters of the queries.
RESERVED, RATIO, SAMPLE, DISJOINT, MULTIPLIER, PAIRS = "trec_2006", 0.25, 1000, 15, 2.0, 100


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def messages(spark: SparkSession, d: str) -> DataFrame:
    m = spread(table(spark, d, "combine").select("message_id", "subject", "body", "label", "source", "source_rank", "row_in_source"))
    source = F.coalesce(F.nullif(canonical_source(X.strip(X.text(F.col("source")))), F.lit("")), F.lit("unknown"))
    pos = F.struct(F.coalesce("source_rank", F.lit(999)).alias("rank"), F.coalesce("row_in_source", F.lit(0)).alias("row"), F.col("message_id").alias("id"))
    c = m.select("message_id", X.strip(X.text(F.col("subject"))).alias("subject"), X.strip(X.text(F.col("body"))).alias("body"), F.col("label").cast("int").alias("label"), source.alias("source"), pos.alias("pos"))
    return c.where("subject <> '' or body <> ''")


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return messages(spark, d).where("label in (0, 1)").select("message_id", "label", "source")


def digest(key: Column) -> Column:
    return F.unhex(F.md5(key.cast("binary")))


def key_of(level: str) -> Column:
    """The key of a level: basic (subject, body and label), medium (body without white space), high (letters and digits of the body)."""
    if level == "basic":
        return F.to_json(F.struct("subject", "body", "label"))
    if level not in ("medium", "high"):
        raise ValueError("duplicate_detection must be one of: basic, high, medium")
    return X.medium_key(F.col("body")) if level == "medium" else X.high_key(F.col("body"))


def keep_first(m: DataFrame, level: str) -> DataFrame:
    """(message_id, label, source): the first row of each key; one shuffle of digests, combined on the map side."""
    first = m.groupBy(digest(key_of(level)).alias("k")).agg(F.min(F.struct("pos", "message_id", "label", "source")).alias("m"))
    return first.select("m.message_id", "m.label", "m.source")


@query(f"with {KEYED}, kept as (select * from keyed k where pos = (select min(pos) from keyed o where o.k = k.k)) select source, count(*) filter (label = 0) as ham, count(*) filter (label = 1) as spam, count(*) as n from kept group by source")
def source_label_matrix(spark, d):
    """The flagship: clean, keep the first of equal bodies, count by source and label with zeros for missing labels."""
    kept = keep_first(messages(spark, d), "high")
    return kept.groupBy("source").agg(F.count_if(F.col("label") == 0).alias("ham"), F.count_if(F.col("label") == 1).alias("spam"), F.count("*").alias("n"))


@query(f"with {CLEAN} select arg_min(message_id, pos) as message_id, arg_min(source, pos) as source, label from clean group by subject, body, label")
def dedup_basic(spark, d):
    return keep_first(messages(spark, d), "basic")


@query(f"with {CLEAN}, firsts as (select min(pos) as pos from clean group by {collapse('body').replace(', chr(32),', ', chr(32),').replace(chr(39) + ' ' + chr(39), chr(39) * 2)}) select message_id, source, label from clean where pos in (select pos from firsts)")
def dedup_medium(spark, d):
    return keep_first(messages(spark, d), "medium")


@query(f"with {KEYED}, firsts as (select min(pos) as pos from keyed group by k) select message_id, source, label from keyed where pos in (select pos from firsts)")
def dedup_high(spark, d):
    return keep_first(messages(spark, d), "high")


def groups(m: DataFrame, level: str = "high") -> DataFrame:
    """(k, n, kinds, first): groups of two rows or more of a key."""
    g = m.groupBy(digest(key_of(level)).alias("k")).agg(F.count("*").alias("n"), F.collect_set("label").alias("labels"), F.collect_set("source").alias("sources"), F.min(F.struct("pos", "message_id", "source", "label")).alias("kept"))
    return g.where("n > 1")  # sets of labels and sources are small by contract


@query(f"""with {GROUPS}, numbered as (select *, row_number() over (order by first) as group_id from grouped)
select g.group_id, g.n as duplicate_count, (select '[' || string_agg(distinct cast(k.label as varchar), ', ' order by cast(k.label as varchar)) || ']' from keyed k where k.k = g.k) as labels,
  (select '["' || string_agg(distinct k.source, '", "' order by k.source) || '"]' from keyed k where k.k = g.k) as sources, f.message_id as kept_message_id, f.source as kept_source, f.label as kept_label, row_number() over (order by g.n desc, g.group_id) as place
from numbered g join keyed f on f.pos = g.first""")
def duplicate_groups(spark, d):
    """Groups numbered in the order of their first rows, with their place in the report (most copies first)."""
    g = sampling.numbered(groups(messages(spark, d)), [F.col("kept.pos")], "group_id")
    g = sampling.numbered(g, [F.col("n").desc(), F.col("group_id")], "place")
    labels = F.nullif(F.concat(F.lit("["), F.array_join(F.transform(F.sort_array("labels"), lambda x: x.cast("string")), ", "), F.lit("]")), F.lit("[]"))
    sources = F.concat(F.lit('["'), F.array_join(F.sort_array("sources"), '", "'), F.lit('"]'))
    return g.select("group_id", F.col("n").alias("duplicate_count"), labels.alias("labels"), sources.alias("sources"), F.col("kept.message_id").alias("kept_message_id"), F.col("kept.source").alias("kept_source"), F.col("kept.label").alias("kept_label"), "place")


@query(f"""with {GROUPS}, o as (select k.*, row_number() over (partition by k.k order by k.pos) - 1 as i, first_value(k.message_id) over (partition by k.k order by k.pos) as kept from keyed k join grouped g on g.k = k.k)
select kept as kept_message_id, {", ".join(f"max(case when i = {i} then {c} end) as sample_{i}_{c}" for i in range(3) for c in ("message_id", "label", "source"))} from o where i < 3 group by kept""")
def duplicate_report_wide(spark, d):
    """The first three rows of each group side by side; ranks above that are dropped before the shuffle, so a large group is no large task."""
    k = messages(spark, d).select(digest(key_of("high")).alias("k"), "pos", "message_id", "label", "source")
    r = k.withColumn("i", F.row_number().over(Window.partitionBy("k").orderBy("pos")) - 1).where("i < 3")
    wide = r.groupBy("k").agg(F.max(F.when(F.col("i") == 0, F.col("message_id"))).alias("kept_message_id"), *[F.max(F.when(F.col("i") == i, F.col(c))).alias(f"sample_{i}_{c}") for i in range(3) for c in ("message_id", "label", "source")])
    return wide.where("sample_1_message_id is not null").drop("k")


@query(f"with {GROUPS} select count(*) as dup_groups, coalesce(sum(n), 0) as rows_in_groups, coalesce(sum(n - 1), 0) as redundant_rows, max(n) as largest, count(*) filter (kinds > 1) as conflicting from grouped")
def duplicate_stats(spark, d):
    g = groups(messages(spark, d))
    return g.agg(F.count("*").alias("dup_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows_in_groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("redundant_rows"), F.max("n").alias("largest"), F.count_if(F.size("labels") > 1).alias("conflicting"))


@query(f"with {GROUPS} select message_id, label from keyed where k in (select k from grouped where kinds > 1)")
def label_conflicts(spark, d):
    """All rows of keys with more than one label."""
    k = messages(spark, d).select("message_id", "label", digest(key_of("high")).alias("k"))
    bad = k.groupBy("k").agg((F.min("label") != F.max("label")).alias("bad")).where("bad").select("k")
    return k.join(bad, "k", "left_semi").select("message_id", "label")


@query(f"with {GROUPS} select case when n <= 5 then cast(n as varchar) when n <= 10 then '6-10' when n <= 20 then '11-20' when n <= 50 then '21-50' when n <= 100 then '51-100' when n <= 500 then '101-500' else '501+' end as size_bin, count(*) as n_groups from grouped group by 1")
def group_size_histogram(spark, d):
    n = F.col("n")
    b = F.when(n <= 5, n.cast("string"))
    for low, high in ((6, 10), (11, 20), (21, 50), (51, 100), (101, 500)):
        b = b.when(n <= high, f"{low}-{high}")
    return messages(spark, d).groupBy(digest(key_of("high")).alias("k")).agg(F.count("*").alias("n")).where("n > 1").groupBy(b.otherwise("501+").alias("size_bin")).agg(F.count("*").alias("n_groups"))


# balance and samples ------------------------------------------------------------------------------------------------------------------------

LABELLED = f"{CLEAN}, labelled as (select message_id, label, source from clean where label in (0, 1))"


def ratio_sql(ratio: float) -> str:
    return f"""with {LABELLED}, {ranked('labelled', 'label')}, c as (select count(*) filter (label = 1) as s, count(*) filter (label = 0) as h from labelled)
select r.message_id, r.label from ranked r, c where case when s / {ratio}::double <= h / (1.0 - {ratio})::double
  then r.label = 1 or r.r <= trunc(s * (1.0 - {ratio})::double / {ratio}::double) else r.label = 0 or r.r <= trunc(h * {ratio}::double / (1.0 - {ratio})::double) end"""


@query(ratio_sql(RATIO))
def ratio_trim(spark, d):
    return balance.by_ratio(labelled(spark, d), RATIO).select("message_id", "label")


@query(ratio_sql(0.5))
def mixed_50_50(spark, d):
    return balance.by_ratio(labelled(spark, d), 0.5).select("message_id", "label")


@query(f"with {LABELLED} select message_id, label from labelled where label = 1")
def ratio_one(spark, d):
    """Ratio 1: one class only."""
    return balance.by_ratio(labelled(spark, d), 1.0).select("message_id", "label")


@query(f"""with {LABELLED}, b as (select source from labelled group by source having count(distinct label) = 2), pool as (select l.* from labelled l where source in (select source from b)), {ranked('pool', 'source, label')}
select message_id, source, label from ranked where r <= (select min(n) from ranked)""")
def balanced_source(spark, d):
    """Each source gives as many rows of each class as the smallest cell has; sources of one class are left out first, as balance asks for both."""
    m = labelled(spark, d)
    both = m.groupBy("source").agg((F.min("label") != F.max("label")).alias("both")).where("both").select("source")
    return balance.by_smallest_cell(m.join(F.broadcast(both), "source", "left_semi")).select("message_id", "source", "label")  # registered sources


@query(f"""with {LABELLED}, cells as (select label, source, count(*) as n from labelled group by label, source), caps as (select *, least(n, greatest(1, ceil(min(n) over (partition by label) * {MULTIPLIER}))) as cap from cells)
select label, source, n, cast(cap as bigint) as cap, cast((select min(t) from (select sum(cap) as t from caps group by label)) as bigint) as target from caps""")
def class_source_caps(spark, d):
    return balance.caps(labelled(spark, d), MULTIPLIER)


def _aware_sql() -> str:
    """Rounds of the allotment as recursive rows (label, source, capacity, given, round, left)."""
    return f"""with recursive {LABELLED}, cells as (select label, source, count(*) as n from labelled group by label, source), caps as (select *, cast(least(n, greatest(1, ceil(min(n) over (partition by label) * {MULTIPLIER}))) as bigint) as cap from cells),
goal as (select min(t) as target from (select sum(cap) as t from caps group by label)),
begin_ as (select c.label, c.source, c.cap, case when g.target = sum(c.cap) over w then c.cap when g.target >= count(*) over w then 1 else 0 end as given, g.target from caps c, goal g window w as (partition by c.label)),
steps as (
  select label, source, cap, cast(given as bigint) as given, cast(target as bigint) as target, 0 as round from begin_
  union all
  select label, source, cap, cast(given + step + case when step < room and place <= spare then 1 else 0 end as bigint), target, round + 1 from (
    select *, row_number() over (partition by label order by (step < room) desc, wish - floor(wish) desc, room desc, source desc) as place, rest - sum(step) over (partition by label) as spare from (
      select *, least(room, cast(floor(wish) as bigint)) as step from (
        select *, case when room > 0 then rest * sqrt(cast(cap as double)) / sum(case when room > 0 then sqrt(cast(cap as double)) else 0 end) over (partition by label) else 0 end as wish from (
          select *, cap - given as room, target - sum(given) over (partition by label) as rest from steps) a where rest > 0) b) c) e where round < 50),
final as (select label, source, arg_max(given, round) as given from steps group by label, source),
strata as (select l.*, case when label = 0 then 'ham' else 'spam' end as name from labelled l),
picked as (select s.*, row_number() over (partition by s.label, s.source order by md5('source_aware_50_50/' || s.name || '/' || s.source || '|' || cast(s.message_id as varchar)), s.message_id) as r from strata s)
select p.message_id, p.source, p.label from picked p join final f on f.label = p.label and f.source = p.source where p.r <= f.given"""


@query(_aware_sql())
def source_aware_balance(spark, d):
    """Both classes alike; within each, sources share by the square root of their capped size, none above MULTIPLIER times the smallest."""
    return balance.source_aware(labelled(spark, d), MULTIPLIER).select("message_id", "source", "label")


@query(f"with {LABELLED}, {ranked('labelled', 'label', 42)} select message_id, label from ranked where r <= case when label = 0 then round_even({SAMPLE} * n / total::double, 0) else {SAMPLE} - round_even({SAMPLE} * (total - n) / total::double, 0) end")
def stratified_sample(spark, d):
    m = labelled(spark, d)
    return sampling.take(m, ["label"], balance.stratified_counts(m, SAMPLE), 42).select("message_id", "label")


@query(f"with {LABELLED}, {ranked('labelled', '')} select message_id, label from ranked where r <= {SAMPLE}")
def plain_sample(spark, d):
    """The first rows of a shuffle; a limit of 0 or less takes all."""
    return balance.plain_sample(labelled(spark, d), SAMPLE).select("message_id", "label")


@query(f"with {LABELLED}, {ranked('labelled', 'label', 42)} select message_id, label from ranked where r <= {PAIRS}")
def fixed_per_class(spark, d):
    m = labelled(spark, d)
    return sampling.take(m, ["label"], m.select("label").distinct().withColumn("n", F.lit(PAIRS)), 42).select("message_id", "label")


@query(f"with {LABELLED}, o as (select l.message_id, l.label, row_number() over (partition by l.label order by c.pos) as r from labelled l join clean c using (message_id)) select message_id, label from o where r <= (select min(n) from (select count(*) as n from labelled group by label))")
def truncated_balance(spark, d):
    """The first rows of each class in table order, as many as the smaller class has."""
    m = messages(spark, d).where("label in (0, 1)")
    return balance.first_of_each_class(m).select("message_id", "label")


@query(f"with {LABELLED}, {ranked('labelled', 'label')} select message_id, label, case when r <= ceil(ceil(n * 8 / 100.0) * 0.75) then 'test' when r <= ceil(n * 8 / 100.0) then 'validation' else 'train' end as split from ranked")
def split_92_2_6(spark, d):
    """Per label 8 % are held out, rounded up, and three quarters of these, rounded up, are the test split."""
    m = labelled(spark, d)
    n = m.groupBy("label").agg(F.count("*").alias("n")).withColumn("held", F.ceil(F.col("n") * 8 / 100)).withColumn("tested", F.ceil(F.col("held") * 0.75))
    cut_ = lambda part, low, high: F.struct(F.lit(part).alias("part"), low.cast("long").alias("low"), high.cast("long").alias("high"))
    cuts = n.select("label", F.inline(F.array(cut_("test", F.lit(0), F.col("tested")), cut_("validation", F.col("tested"), F.col("held")), cut_("train", F.col("held"), F.col("n")))))
    return sampling.parts(m, ["label"], cuts).select("message_id", "label", F.col("part").alias("split"))


@query(f"with {LABELLED}, e as (select * from labelled where source = 'enron'), {ranked('e', '')} select message_id, case when r <= {PAIRS} then 'validation' else 'remaining' end as part from ranked where total >= 2 * {PAIRS}")
def validation_take(spark, d):
    """The first rows of a source's shuffle for validation, the rest as the pool of its test; a source needs twice as many rows."""
    return balance.validation(labelled(spark, d).where("source = 'enron'"), PAIRS).select("message_id", "part")


@query(f"""with {LABELLED}, e as (select * from labelled where source = 'spam_ham'), {ranked('e', 'label')}
select message_id, label, case when r <= case when label = 0 then round_even({PAIRS} * n / total::double, 0) else {PAIRS} - round_even({PAIRS} * (total - n) / total::double, 0) end then 'validation' else 'remaining' end as part from ranked""")
def stratified_validation(spark, d):
    return balance.stratified_validation(labelled(spark, d).where("source = 'spam_ham'"), PAIRS).select("message_id", "label", "part")


# fingerprints, overlap, disjoint splits -----------------------------------------------------------------------------------------------------


def prints(m: DataFrame) -> DataFrame:
    """m's ids with exact_sha, norm_sha ('' for short keys) and fp."""
    k = m.withColumn("k", X.high_key(F.col("body"))).withColumn("exact_sha", X.sha256(X.exact_text(F.col("subject"), F.col("body"))))
    short = F.length("k") < X.LEAST_KEY
    return k.select("message_id", "label", "source", "pos", "exact_sha", F.when(short, "").otherwise(X.sha256(F.col("k"))).alias("norm_sha"), X.fingerprint(F.col("k"), F.col("exact_sha")).alias("fp"))


@query(f"with {PRINTS} select message_id, exact_sha, norm_sha, fp from prints")
def message_fingerprints(spark, d):
    return prints(messages(spark, d)).select("message_id", "exact_sha", "norm_sha", "fp")


@query(f"with {PRINTS} select p.message_id, coalesce(nullif(s.sha, ''), p.fp) as fp from prints p left join (select message_id, max(message_sha256) as sha from split_rows group by message_id) s on s.message_id = p.message_id")
def stored_fingerprints(spark, d):
    """A fingerprint stored with a split comes before the computed one."""
    stored = table(spark, d, "split_rows").groupBy("message_id").agg(F.max("message_sha256").alias("sha"))
    p = prints(messages(spark, d)).join(stored, "message_id", "left")
    return p.select("message_id", X.known_fingerprint(F.col("sha"), F.lit(None).cast("string"), F.col("fp")).alias("fp"))


OVERLAP = f"""with {PRINTS}, r as (select * from prints where source = '{RESERVED}'), o as (select * from prints where source <> '{RESERVED}'),
met as (select r.message_id as x, r.fp, r.label as l, o.source, o.message_id as y, o.label as m, max(cast(r.exact_sha = o.exact_sha as int)) as exact from r join o on r.exact_sha = o.exact_sha or (r.norm_sha = o.norm_sha and r.norm_sha <> '') group by all),
best as (select x, source, fp, any_value(l) as l, max(exact) as exact, count(*) as met_rows, bool_or(l <> m) as conflict from met group by x, source, fp)"""


@query(f"{OVERLAP} select source, sum(exact) as exact_rows, count(*) - sum(exact) as normalized_only, count(*) as matched, count(distinct fp) as unique_matched, (select count(distinct y) from met m where m.source = b.source) as rows_involved from best b group by source")
def cross_source_overlap(spark, d):
    """Rows of each source met by the reserved corpus, exactly or only when normalised; an exact match comes first.

    Sources meet per key, not per pair: each key's rows are counted by source first, so a key held by many rows of both sides costs one row each.
    """
    p = cut(prints(messages(spark, d)))
    reserved = F.col("source") == RESERVED
    keys = p.select("message_id", "source", "fp", F.inline(F.array(F.struct(F.lit(1).alias("exact"), F.col("exact_sha").alias("sha")), F.struct(F.lit(0).alias("exact"), F.col("norm_sha").alias("sha"))))).where("sha <> ''")
    mine = keys.where(reserved)
    there = keys.where(~reserved).select("exact", "sha", "source").distinct()
    met = mine.drop("source").join(there, ["exact", "sha"]).groupBy("source", "message_id", "fp").agg(F.max("exact").alias("exact"))
    involved = keys.where(~reserved).join(mine.select("exact", "sha").distinct(), ["exact", "sha"], "left_semi").groupBy("source").agg(F.countDistinct("message_id").alias("rows_involved"))
    per = met.groupBy("source").agg(F.sum("exact").alias("exact_rows"), (F.count("*") - F.sum("exact")).alias("normalized_only"), F.count("*").alias("matched"), F.countDistinct("fp").alias("unique_matched"))
    return per.join(involved, "source")


@query(f"{OVERLAP} select x as message_id, source, case when exact = 1 then 'exact' else 'normalized' end as match_type, met_rows, conflict from best")
def overlap_details(spark, d):
    """One row for each reserved row and source that meet: the kind of match, the rows met and whether a label differs."""
    p = cut(prints(messages(spark, d)).withColumn("label", F.coalesce("label", F.lit(-1))))
    keys = p.select("message_id", "source", "label", "exact_sha", "norm_sha")
    reserved = F.col("source") == RESERVED
    # rows of a source per pair of hashes: copies are one row with a count
    o = keys.where(~reserved).groupBy("source", "exact_sha", "norm_sha").agg(F.count("*").alias("n"), F.min(F.when(F.col("label") >= 0, F.col("label"))).alias("low"), F.max(F.when(F.col("label") >= 0, F.col("label"))).alias("high"))
    r = keys.where(reserved).select("message_id", F.when(F.col("label") >= 0, F.col("label")).alias("l"), "exact_sha", "norm_sha")
    exact = r.join(o.drop("norm_sha"), "exact_sha").select("message_id", "l", "source", "n", "low", "high", F.lit(1).alias("exact"))
    n2 = o.withColumnRenamed("exact_sha", "other")
    norm = r.where("norm_sha <> ''").join(n2, "norm_sha").where("exact_sha <> other").select("message_id", "l", "source", "n", "low", "high", F.lit(0).alias("exact"))
    best = exact.unionByName(norm).groupBy("message_id", "source").agg(F.max("exact").alias("e"), F.sum("n").alias("met_rows"), F.bool_or((F.col("l") != F.col("low")) | (F.col("l") != F.col("high"))).alias("conflict"))
    return best.select("message_id", "source", F.when(F.col("e") == 1, "exact").otherwise("normalized").alias("match_type"), "met_rows", "conflict")


@query(f"""{OVERLAP}, bad as (select fp from r group by fp having count(distinct label) > 1), firsts as (select fp, min(pos) as pos from r group by fp)
select r.message_id, r.label from r join firsts f on f.fp = r.fp and f.pos = r.pos where r.fp not in (select fp from bad) and r.fp not in (select fp from best)""")
def eligible_pool(spark, d):
    """The reserved corpus, first of each fingerprint, without fingerprints of two labels and without those met elsewhere."""
    return _eligible(cut(prints(messages(spark, d)))).select("message_id", "label")


def _eligible(p: DataFrame) -> DataFrame:
    reserved = F.col("source") == RESERVED
    per = p.where(reserved).groupBy("fp").agg(F.min(F.struct("pos", "message_id", "label")).alias("m"), (F.min("label") != F.max("label")).alias("bad"))
    other = p.where(~reserved)
    met = [p.where(reserved).join(other.where(f"{k} <> ''").select(k).distinct(), k, "left_semi").select("fp") for k in ("exact_sha", "norm_sha")]
    clear = per.where("not coalesce(bad, false)").join(met[0].unionByName(met[1]).distinct(), "fp", "left_anti")
    return clear.select("m.message_id", "m.label", "fp")


SPLITS = f"{PRINTS}, assigned as (select message_id, min(lower({strip('split_name')})) as split from split_rows group by message_id), placed as (select distinct a.split, p.fp from assigned a join prints p on p.message_id = a.message_id)"


def placed(p: DataFrame, splits: DataFrame) -> DataFrame:
    """(split, fp): the fingerprints of each split."""
    s = splits.groupBy("message_id").agg(F.min(F.lower(X.strip(X.text(F.col("split_name"))))).alias("split"))
    return p.select("message_id", "fp").join(s, "message_id").select("split", "fp").distinct()


@query(f"with {SPLITS} select a.split as left_split, b.split as right_split, count(*) as shared from placed a join placed b on a.fp = b.fp and a.split < b.split group by 1, 2")
def pairwise_overlap(spark, d):
    """Fingerprints shared by each two splits, from the splits of each fingerprint (a handful), not from a self-join of all."""
    per = placed(prints(messages(spark, d)), table(spark, d, "split_rows")).groupBy("fp").agg(F.sort_array(F.collect_set("split")).alias("s")).where("size(s) > 1")
    two = per.select(F.posexplode("s").alias("i", "left_split"), "s").select("left_split", F.explode(F.expr("slice(s, i + 2, size(s))")).alias("right_split"))
    return two.groupBy("left_split", "right_split").agg(F.count("*").alias("shared"))


@query(f"with {SPLITS}, t as (select fp from placed where split = 'train') select split, count(*) as prints, count(*) filter (fp in (select fp from t)) as leaked from placed where split <> 'train' group by split")
def leakage_counts(spark, d):
    p = placed(prints(messages(spark, d)), table(spark, d, "split_rows")).groupBy("fp").agg(F.collect_set("split").alias("s"))
    flat = p.select(F.explode("s").alias("split"), F.array_contains("s", "train").alias("leaked")).where("split <> 'train'")
    return flat.groupBy("split").agg(F.count("*").alias("prints"), F.count_if("leaked").alias("leaked"))


def disjoint_take(candidates: DataFrame, excluded: DataFrame, quotas: DataFrame, seed: int = 67) -> DataFrame:
    """The first n rows of each label in hash order whose fingerprint is not excluded, each fingerprint once; fails when a label is short."""
    h = sampling.order_of(seed, "message_id")
    free = candidates.where("label in (0, 1)").withColumn("h", h).join(excluded.select("fp").distinct(), "fp", "left_anti")
    once = cut(free.groupBy("fp").agg(F.min(F.struct("h", "message_id", "label")).alias("m")).select("fp", "m.message_id", "m.label"))
    short = quotas.join(once.groupBy("label").agg(F.count("*").alias("there")), "label", "left").where("n > coalesce(there, 0)").collect()  # a row for each label
    if short:
        raise ValueError("too few disjoint rows: " + ", ".join(f"label {r.label}: {r.there or 0} of {r.n}" for r in short))
    return sampling.take(once, ["label"], quotas, seed)


@query(f"""with {SPLITS}, free as (select p.message_id, p.label, p.fp, {hashed(67, 'p.message_id')} as h from prints p where p.label in (0, 1) and p.fp not in (select fp from placed where split = 'train')),
once as (select *, row_number() over (partition by fp order by h, message_id) as k from free), taken as (select *, row_number() over (partition by label order by h, message_id) as r from once where k = 1) select message_id, label from taken where r <= {DISJOINT}""")
def disjoint_split(spark, d):
    p = cut(prints(messages(spark, d)))
    train = placed(p, table(spark, d, "split_rows")).where("split = 'train'")
    return disjoint_take(p, train, spark.createDataFrame([(0, DISJOINT), (1, DISJOINT)], "label int, n long")).select("message_id", "label")


@query(f"""with {PRINTS}, r as (select * from prints where source = '{RESERVED}'), o as (select * from prints where source <> '{RESERVED}'), bad as (select fp from r group by fp having count(distinct label) > 1),
pool as (select r.* from r where pos = (select min(pos) from r q where q.fp = r.fp) and fp not in (select fp from bad) and not exists (select 1 from o where o.exact_sha = r.exact_sha) and not exists (select 1 from o where o.norm_sha = r.norm_sha and r.norm_sha <> '')),
free as (select message_id, label, {hashed(67)} as h from pool where label in (0, 1)), taken as (select *, row_number() over (partition by label order by h, message_id) as r from free)
select message_id, label from taken where r <= 10""")
def balanced_test(spark, d):
    """Half of a test of 20 from each label of the reserved corpus's eligible rows."""
    p = cut(prints(messages(spark, d)))
    return disjoint_take(_eligible(p), p.limit(0), balance.halves(spark, 20)).select("message_id", "label")


#: Sources in the order in which their tests are taken, rows of each, and rows of validation.
EXTERNAL, TEST, VALIDATION = ("enron", "fraudulent_email_corpus", "spam_ham"), 40, 40


def external_tests(p: DataFrame, train: DataFrame) -> DataFrame:
    """(message_id, source, part): validation and test rows of the external sources; each test joins the exclusions of the next source's.

    Three sources, so the loop runs in the driver; what grows stays in tables.
    """
    first = p.where(F.col("source").isin(*EXTERNAL)).groupBy("source", "fp").agg(F.min(F.struct("pos", "message_id", "label")).alias("m")).select("source", "fp", "m.message_id", "m.label")
    spark = p.sparkSession
    quota = spark.createDataFrame([(s, "validation", 0, VALIDATION) for s in EXTERNAL] + [(s, "remaining", VALIDATION, 2**62) for s in EXTERNAL], "source string, part string, low long, high long")
    dealt = cut(sampling.parts(first, ["source"], quota))
    excluded, out = train.select("fp").unionByName(dealt.where("part = 'validation'").select("fp")), dealt.where("part = 'validation'").select("message_id", "source", "part")
    for s in EXTERNAL:
        pool = dealt.where((F.col("source") == s) & (F.col("part") == "remaining")).drop("part").join(excluded.distinct(), "fp", "left_anti")
        test = cut(sampling.take(pool, [], spark.createDataFrame([(TEST,)], "n long")))
        excluded = excluded.unionByName(test.select("fp"))
        out = out.unionByName(test.select("message_id", "source", F.lit("test").alias("part")))
    return out


def _external_sql() -> str:
    parts_, gone = [], f"select fp from placed where split = 'train' union select fp from dealt where r <= {VALIDATION}"
    for i, s in enumerate(EXTERNAL):
        parts_.append(f"t{i} as (select * from (select *, row_number() over (order by h, message_id) as q from dealt where source = '{s}' and r > {VALIDATION} and fp not in ({gone})) where q <= {TEST})")
        gone += f" union select fp from t{i}"
    return f"""with {SPLITS}, firsts as (select *, {hashed(67)} as h from prints p where source in {EXTERNAL} and pos = (select min(pos) from prints q where q.fp = p.fp and q.source = p.source)),
dealt as (select *, row_number() over (partition by source order by h, message_id) as r from firsts), {", ".join(parts_)}
select message_id, source, 'validation' as part from dealt where r <= {VALIDATION} """ + "".join(f" union all select message_id, source, 'test' from t{i}" for i in range(len(EXTERNAL)))


@query(_external_sql())
def external_splits(spark, d):
    p = cut(prints(messages(spark, d)))
    return external_tests(p, placed(p, table(spark, d, "split_rows")).where("split = 'train'"))


BLOCK = 4096


@query(f"""with {PRINTS}, o as (select *, row_number() over (partition by source order by pos) - 1 as i from prints), b as (select source, i // {BLOCK} as b, sha256(string_agg(coalesce(cast(label as varchar), '') || chr(0) || fp || chr(10), '' order by i)) as h, count(*) as n from o group by source, i // {BLOCK})
select source, sha256(string_agg(h, '' order by b)) as digest, cast(sum(n) as bigint) as n from b group by source""")
def content_digest(spark, d):
    """Digest of a source's labels and fingerprints in order: blocks of BLOCK rows are hashed, then their hashes, so no task holds a source."""
    p = prints(messages(spark, d)).select("source", "label", "fp", "pos")
    o = sampling.numbered(p, [F.col("source"), F.col("pos")])
    first = o.groupBy("source").agg(F.min("number").alias("first"))
    line = F.concat(F.coalesce(F.col("label").cast("string"), F.lit("")), F.lit("\0"), F.col("fp"), F.lit("\n"))
    b = o.join(F.broadcast(first), "source").withColumn("b", F.floor((F.col("number") - F.col("first")) / BLOCK))  # registered sources
    join = lambda x, k: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(k), x.alias("x")))), lambda e: e.x), "")
    blocks = b.groupBy("source", "b").agg(X.sha256(join(line, "number")).alias("h"), F.count("*").alias("n"))
    return blocks.groupBy("source").agg(X.sha256(join(F.col("h"), "b")).alias("digest"), F.sum("n").alias("n"))


@query(f"with {PRINTS} select source, count(*) as n, count(*) filter (label = 0) as ham, count(*) filter (label = 1) as spam, count(distinct fp) as prints, count(distinct message_id) as ids from prints group by source")
def split_manifest(spark, d):
    """Rows, labels and distinct fingerprints of each source: the entries of a manifest."""
    p = prints(messages(spark, d))
    return p.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 0).alias("ham"), F.count_if(F.col("label") == 1).alias("spam"), F.countDistinct("fp").alias("prints"), F.countDistinct("message_id").alias("ids"))


@query(f"with {CLEAN} select message_id, {normal_form('subject')} as subject from clean")
def normal_subjects(spark, d):
    return messages(spark, d).select("message_id", X.normal_form(F.col("subject")).alias("subject"))


#: Columns of a split table, in order.
STANDARD = ("subject", "body", "label", "source", "source_row_index", "message_sha256")


def standard_columns(df: DataFrame, order: list[Column]) -> DataFrame:
    """The columns of a split table: a missing row index is the place in the given order, a missing hash is computed, other missing ones are an error."""
    if missing := set(STANDARD) - set(df.columns) - {"source_row_index", "message_sha256"}:
        raise ValueError(f"missing columns: {sorted(missing)}")
    if "source_row_index" not in df.columns:
        df = sampling.numbered(df, order, "_n").withColumn("source_row_index", F.col("_n") - 1)
    if "message_sha256" not in df.columns:
        df = df.withColumn("message_sha256", X.fingerprint(X.high_key(F.col("body")), X.sha256(X.exact_text(F.col("subject"), F.col("body")))))
    return df.select(*STANDARD)


@query(f"with {PRINTS} select subject, body, label, source, pos - 1 as source_row_index, fp as message_sha256 from prints where source = 'enron'".replace("pos - 1 as", "row_number() over (order by pos) - 1 as"))
def standard_split(spark, d):
    return standard_columns(messages(spark, d).where("source = 'enron'"), [F.col("pos")])


@query(f"select message_id, subject, body from combine where {strip('subject')} <> '' or {strip('body')} <> ''")
def unstripped_messages(spark, d):
    """Rows empty in both texts dropped, the texts as they are."""
    m = table(spark, d, "combine").select("message_id", "subject", "body")
    return m.where((X.strip(X.text(F.col("subject"))) != "") | (X.strip(X.text(F.col("body"))) != ""))


@query("select message_sha256 as token, count(*) as n from split_rows where regexp_full_match(message_sha256, '[0-9a-f]{24,}') group by 1")
def hash_tokens(spark, d):
    """Texts that are long hexadecimal numbers."""
    return table(spark, d, "split_rows").where(F.col("message_sha256").rlike(r"^[0-9a-f]{24,}\z")).groupBy(F.col("message_sha256").alias("token")).agg(F.count("*").alias("n"))


BATCH = 64


@query(f"with {CLEAN}, o as (select source, length(body) as n, row_number() over (partition by source order by length(body), message_id) - 1 as i from clean) select source, i // {BATCH} as batch, count(*) as rows, min(n) as shortest, max(n) as longest, sum(n) as chars from o group by 1, 2")
def length_batches(spark, d):
    """Batches of texts of like lengths, which need little padding."""
    o = sampling.numbered(messages(spark, d).select("source", "message_id", F.length("body").alias("n")), [F.col("source"), F.col("n"), F.col("message_id")])
    first = o.groupBy("source").agg(F.min("number").alias("first"))
    b = o.join(F.broadcast(first), "source").withColumn("batch", F.expr(f"(number - first) div {BATCH}"))  # registered sources
    return b.groupBy("source", "batch").agg(F.count("*").alias("rows"), F.min("n").alias("shortest"), F.max("n").alias("longest"), F.sum("n").alias("chars"))
