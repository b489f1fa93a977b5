"""Evaluation: records of checkpoints, scores, ranking, selection of thresholds and models, repeats, intervals.

``results`` are rows (config_index, step, dataset, confusion counts and rates) as an evaluation writes them: here they come from the deterministic
scores of the message table, a config being message_id % 6 and a step its next digits, the last one named ``final``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailforge.plans.rules import CLEAN
from mailforge.session import cut, table

QUERIES, SQL = {}, {}
DATASETS = {"train_subset": "trec_2007", "enron": "enron", "fraudulent_email_corpus": "fraudulent_email_corpus", "spam_ham": "spam_ham", "trec_2006": "trec_2006"}
NEEDED = ("train_subset", "enron", "fraudulent_email_corpus", "spam_ham")
#: Score thresholds are sought among these many quantiles and the default.
QUANTILES, DEFAULT = 401, 0.5
#: Scores of 0 to 1 fall into this many buckets for running sums.
BUCKETS = 1024


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


SCORED_SQL = f"""{CLEAN}, scored as (select message_id, label, source, (label * 300 + (message_id * 7919) % 701) / 1000.0::double as score from clean where label in (0, 1))"""
RESULTS_SQL = f"""{SCORED_SQL}, picked as (select *, message_id % 6 as config_index, case (message_id // 6) % 4 when 3 then 'final' else cast(500 * (1 + (message_id // 6) % 4) as varchar) end as step,
  case source {" ".join(f"when '{s}' then '{n}'" for n, s in DATASETS.items())} end as dataset, case when score >= 0.3 + 0.05 * (message_id % 6) then 1 else 0 end as p from scored),
counted as (select config_index, step, dataset, count(*) filter (label = 1 and p = 1) as tp, count(*) filter (label = 0 and p = 1) as fp, count(*) filter (label = 1 and p = 0) as fn, count(*) filter (label = 0 and p = 0) as tn from picked where dataset is not null group by 1, 2, 3),
results as (select *, case when tp + fp + fn = 0 then 0 else 2.0::double * tp / (2 * tp + fp + fn) end as f1, case when tp + fn = 0 then 0 else tp / (tp + fn)::double end as recall, case when tn + fp = 0 then 0 else tn / (tn + fp)::double end as specificity,
  case when tn + fp = 0 then 0 else fp / (tn + fp)::double end as fpr, case when tp + fn = 0 then 0 else fn / (tp + fn)::double end as fnr from counted)"""
RECORDS_SQL = f"""{RESULTS_SQL}, wide as (select config_index, step, case when step = 'final' then 'Infinity'::double else cast(step as double) end as step_sort, max(case when dataset = 'train_subset' then f1 end) as train_f1, max(case when dataset = 'enron' then specificity end) as enron_specificity,
  max(case when dataset = 'fraudulent_email_corpus' then recall end) as fraud_recall, max(case when dataset = 'spam_ham' then f1 end) as spam_ham_f1, max(case when dataset = 'trec_2006' then f1 end) as trec_f1, count(distinct case when dataset in {NEEDED} then dataset end) as parts from results group by config_index, step),
records as (select *, round((enron_specificity + fraud_recall + spam_ham_f1) / 3, 9) as external_score, round((enron_specificity + fraud_recall + spam_ham_f1 + trec_f1) / 4, 9) as final_score, round(train_f1 - (enron_specificity + fraud_recall + spam_ham_f1) / 3, 9) as gap from wide)"""


def scored(spark, d) -> DataFrame:
    from mailforge.plans.curation import messages

    m = messages(spark, d).where("label in (0, 1)")
    return m.select("message_id", "label", "source", ((F.col("label") * 300 + (F.col("message_id") * 7919) % 701) / F.lit(1000.0)).alias("score"))


def rates(df: DataFrame) -> DataFrame:
    """Rates from confusion counts, zero where a denominator is."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return df.withColumns({"f1": ratio(2 * tp, 2 * tp + fp + fn), "recall": ratio(tp, tp + fn), "precision": ratio(tp, tp + fp), "specificity": ratio(tn, tn + fp), "fpr": ratio(fp, tn + fp), "fnr": ratio(fn, tp + fn)})


def confusion(df: DataFrame, by: list, label: str = "label", p: str = "p") -> DataFrame:
    cell = lambda a, b: F.count_if((F.col(label) == a) & (F.col(p) == b))
    return df.groupBy(*by).agg(cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(0, 0).alias("tn"))


def results(spark, d) -> DataFrame:
    s = scored(spark, d)
    name = F.create_map(*[F.lit(x) for n, src in DATASETS.items() for x in (src, n)])
    k = F.expr("message_id div 6") % 4
    s = s.withColumns({"config_index": F.col("message_id") % 6, "step": F.when(k == 3, "final").otherwise((500 * (1 + k)).cast("string")), "dataset": F.try_element_at(name, F.col("source"))})
    s = s.where("dataset is not null").withColumn("p", (F.col("score") >= 0.3 + 0.05 * F.col("config_index")).cast("int"))
    return rates(confusion(s, ["config_index", "step", "dataset"]))


def step_sort(c: str = "step"):
    """The number of a step; ``final`` comes last, other text is not a number."""
    return F.when(F.col(c) == "final", float("inf")).otherwise(F.coalesce(F.expr(f"try_cast({c} as double)"), F.lit(float("nan"))))


def records(r: DataFrame, complete: bool = True) -> DataFrame:
    """One row for each (config_index, step): the four quality values, external and final score and the gap to training; complete: only those with
    all needed datasets, else missing parts stay null and so do scores that need them."""
    value = lambda dataset, c: F.max(F.when(F.col("dataset") == dataset, F.col(c)))
    w = r.groupBy("config_index", "step").agg(
        value("train_subset", "f1").alias("train_f1"), value("enron", "specificity").alias("enron_specificity"), value("fraudulent_email_corpus", "recall").alias("fraud_recall"),
        value("spam_ham", "f1").alias("spam_ham_f1"), value("trec_2006", "f1").alias("trec_f1"), F.count_distinct(F.when(F.col("dataset").isin(*NEEDED), F.col("dataset"))).alias("parts"),
    )
    three = F.col("enron_specificity") + F.col("fraud_recall") + F.col("spam_ham_f1")
    w = w.withColumns({"step_sort": step_sort(), "external_score": F.round(three / 3, 9), "final_score": F.round((three + F.col("trec_f1")) / 4, 9), "gap": F.round(F.col("train_f1") - three / 3, 9)})
    return w.where(F.col("parts") == len(NEEDED)) if complete else w


def best_order() -> list:
    """Greatest first: external score, F1 on spam_ham, the smaller gap, the later step; missing values come last."""
    return [F.desc_nulls_last("external_score"), F.desc_nulls_last("spam_ham_f1"), F.asc_nulls_last(F.abs("gap")), F.desc_nulls_last("step_sort")]


BEST_SQL = "external_score desc nulls last, spam_ham_f1 desc nulls last, abs(gap) asc nulls last, step_sort desc"


def best_of(r: DataFrame, *by: str) -> DataFrame:
    """The best record of each group; the rank filter works before the shuffle, too."""
    return r.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*best_order()))).where("_r = 1").drop("_r")


@query(f"with {RECORDS_SQL} select config_index, step, external_score, final_score, gap, parts from records where parts = {len(NEEDED)}")
def external_score(spark, d):
    return records(results(spark, d)).select("config_index", "step", "external_score", "final_score", "gap", "parts")


@query(f"with {RECORDS_SQL} select config_index, step, external_score, parts from records")
def partial_records(spark, d):
    return records(results(spark, d), complete=False).select("config_index", "step", "external_score", "parts")


@query(f"with {RECORDS_SQL}, b as (select *, row_number() over (partition by config_index order by {BEST_SQL}) as r from records where parts = 4) select config_index, step, external_score, gap, row_number() over (order by external_score desc, config_index) as place from b where r = 1")
def best_per_config(spark, d):
    b = best_of(records(results(spark, d)), "config_index")
    return b.select("config_index", "step", "external_score", "gap", F.row_number().over(Window.orderBy(F.desc("external_score"), "config_index")).alias("place"))  # a row for each config


@query(f"with {RECORDS_SQL}, b as (select *, row_number() over (partition by config_index order by {BEST_SQL}) as r from records where parts = 4), t as (select config_index, step, external_score from b where r = 1 order by external_score desc, config_index limit 3) select *, row_number() over (order by config_index) as n from t")
def top_configs(spark, d):
    """The three best configurations, in the order of their numbers again."""
    t = best_of(records(results(spark, d)), "config_index").orderBy(F.desc("external_score"), "config_index").limit(3)
    return t.select("config_index", "step", "external_score", F.row_number().over(Window.orderBy("config_index")).alias("n"))  # three rows


@query(f"""with {RECORDS_SQL}, m as (select *, case when config_index < 3 then 'low' else 'high' end as method from records where parts = 4), b as (select *, row_number() over (partition by method order by {BEST_SQL}, config_index) as r from m)
select b.method, b.config_index, b.step, b.external_score, (select count(distinct config_index) from m where m.method = b.method) as configs, (select count(*) from m where m.method = b.method) as checkpoints, (select count(*) from m where m.method = b.method and m.config_index = b.config_index) as own_checkpoints from b where r = 1""")
def best_per_method(spark, d):
    """The best record of each method with how many configurations and checkpoints it had."""
    m = records(results(spark, d)).withColumn("method", F.when(F.col("config_index") < 3, "low").otherwise("high"))
    b = m.withColumn("_r", F.row_number().over(Window.partitionBy("method").orderBy(*best_order(), "config_index"))).where("_r = 1")
    counts = m.groupBy("method").agg(F.count_distinct("config_index").alias("configs"), F.count("*").alias("checkpoints"))
    own = m.groupBy("method", "config_index").agg(F.count("*").alias("own_checkpoints"))
    return b.join(counts, "method").join(own, ["method", "config_index"]).select("method", "config_index", "step", "external_score", "configs", "checkpoints", "own_checkpoints")


@query(f"with {RECORDS_SQL}, b as (select * from records where parts = 4 order by {BEST_SQL}, config_index limit 1) select r.dataset, round(100 * r.fpr, 6) as fpr_pct, round(100 * r.fnr, 6) as fnr_pct from results r join b using (config_index, step)")
def error_profile(spark, d):
    """False positive and negative rates of the best record on each dataset."""
    r = results(spark, d)
    b = records(r).orderBy(*best_order(), "config_index").limit(1).select("config_index", "step")
    return r.join(F.broadcast(b), ["config_index", "step"]).select("dataset", F.round(100 * F.col("fpr"), 6).alias("fpr_pct"), F.round(100 * F.col("fnr"), 6).alias("fnr_pct"))  # one row


@query(f"with {RESULTS_SQL}, w as (select config_index, step, count(distinct dataset) as kinds from results group by 1, 2) select config_index, count(*) as checkpoints, count(*) filter (kinds = 5) as whole from w group by config_index")
def completeness(spark, d):
    w = results(spark, d).groupBy("config_index", "step").agg(F.count_distinct("dataset").alias("kinds"))
    return w.groupBy("config_index").agg(F.count("*").alias("checkpoints"), F.count_if(F.col("kinds") == len(DATASETS)).alias("whole"))


@query(f"with {RESULTS_SQL} select config_index, dataset, step, row_number() over (partition by config_index, dataset order by case when step = 'final' then 'Infinity'::double else cast(step as double) end, step) as checkpoint_no from results")
def numbered_checkpoints(spark, d):
    w = Window.partitionBy("config_index", "dataset").orderBy(step_sort(), "step")
    return results(spark, d).select("config_index", "dataset", "step", F.row_number().over(w).alias("checkpoint_no"))


@query(f"with {RESULTS_SQL} select config_index, dataset, max(cast(step as int)) as latest from results where step <> 'final' group by 1, 2")
def latest_checkpoint(spark, d):
    """The greatest numeric step; other names are skipped."""
    n = F.expr("try_cast(step as int)")
    return results(spark, d).where(n.isNotNull()).groupBy("config_index", "dataset").agg(F.max(n).alias("latest"))


@query(f"with {RESULTS_SQL} select dataset, step, f1 from (select dataset, step, round(f1, 6) as f1, row_number() over (partition by dataset order by case when step = 'final' then 'Infinity'::double else cast(step as double) end desc) as r from results where config_index = 2 and step <> '1000') where r = 1")
def last_by_dataset(spark, d):
    """Of one configuration the last completed row of each dataset; a needed dataset without one is an error."""
    r = results(spark, d).where("config_index = 2 and step <> '1000'")
    last = cut(r.withColumn("_r", F.row_number().over(Window.partitionBy("dataset").orderBy(step_sort().desc()))).where("_r = 1"))
    missing = set(NEEDED) - {x.dataset for x in last.select("dataset").collect()}  # a row for each dataset
    if missing:
        raise ValueError(f"no completed rows of {sorted(missing)}")
    return last.select("dataset", "step", F.round("f1", 6).alias("f1"))


@query(f"with {RESULTS_SQL} select dataset, round(f1, 6) as f1, round(specificity, 6) as specificity, round(recall, 6) as recall from results where config_index = 4 and step = '1500'")
def published_config(spark, d):
    return results(spark, d).where("config_index = 4 and step = '1500'").select("dataset", *[F.round(c, 6).alias(c) for c in ("f1", "specificity", "recall")])


@query(f"with {RESULTS_SQL}, n as (select *, row_number() over (partition by config_index, dataset order by case when step = 'final' then 'Infinity'::double else cast(step as double) end) - 1 as i, count(*) over (partition by config_index, dataset) as n from results) select config_index, dataset, step from n where i in (0, n - 1)")
def spaced_checkpoints(spark, d):
    """Two checkpoints of each run, evenly spaced: the first and the last."""
    w = Window.partitionBy("config_index", "dataset")
    n = results(spark, d).withColumn("i", F.row_number().over(w.orderBy(step_sort())) - 1).withColumn("n", F.count("*").over(w))
    return n.where(spaced_index("i", "n", 2)).select("config_index", "dataset", "step")


def spaced_index(i: str, n: str, keep: int):
    """Whether index i of n items is one of keep evenly spaced ones (rounded half to even); all where there are no more than keep, one: the last."""
    if keep <= 0:
        return F.lit(True)
    if keep == 1:
        return F.col(i) == F.col(n) - 1
    steps = F.transform(F.sequence(F.lit(0), F.lit(keep - 1)), lambda k: F.bround(k * (F.col(n) - 1) / F.lit(float(keep - 1)), 0).cast("int"))
    return (F.col(n) <= keep) | F.array_contains(steps, F.col(i).cast("int"))


# scores: running sums over buckets, so that no task orders all of them ---------------------------------------------------------------------------


def ordered_counts(s: DataFrame) -> DataFrame:
    """(score, pos, neg, above_pos, above_neg, below_neg, all_pos, all_neg) of each distinct score: sums over greater and smaller ones.

    Scores are ordered within buckets of their range; the buckets' own sums are a table of BUCKETS rows.
    """
    per = s.groupBy("score").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg")).withColumn("b", F.greatest(F.lit(0), F.least(F.lit(BUCKETS - 1), F.floor(F.col("score") * BUCKETS))).cast("int"))
    sums = per.groupBy("b").agg(F.sum("pos").alias("bp"), F.sum("neg").alias("bn"))
    up, all_ = Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    sums = sums.select("b", F.coalesce(F.sum("bp").over(up), F.lit(0)).alias("op"), F.coalesce(F.sum("bn").over(up), F.lit(0)).alias("on_"), F.sum("bp").over(all_).alias("all_pos"), F.sum("bn").over(all_).alias("all_neg"))  # BUCKETS rows
    inside = Window.partitionBy("b").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    o = per.withColumn("ip", F.coalesce(F.sum("pos").over(inside), F.lit(0))).withColumn("in_", F.coalesce(F.sum("neg").over(inside), F.lit(0))).join(F.broadcast(sums), "b")
    o = o.withColumns({"above_pos": F.col("op") + F.col("ip"), "above_neg": F.col("on_") + F.col("in_")})
    return o.withColumn("below_neg", F.col("all_neg") - F.col("above_neg") - F.col("neg")).select("score", "pos", "neg", "above_pos", "above_neg", "below_neg", "all_pos", "all_neg")


@query(f"with {SCORED_SQL}, p as (select score, label, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0 as mean_rank from scored), n as (select sum(label) as pos, sum(1 - label) as neg from scored) select round((sum(case when label = 1 then mean_rank end) - max(pos) * (max(pos) + 1) / 2.0) / greatest(max(pos) * max(neg), 1), 6) as auc from p, n")
def roc_auc(spark, d):
    """Pairs won plus half of the ties; 0 without both classes."""
    o = ordered_counts(scored(spark, d))
    won = F.sum(F.col("pos") * (F.col("below_neg") + F.col("neg") / 2.0))
    return o.agg(F.round(F.coalesce(F.try_divide(won, F.max("all_pos").cast("double") * F.max("all_neg")), F.lit(0.0)), 6).alias("auc"))


@query(f"with {SCORED_SQL}, t as (select distinct score from scored), c as (select t.score, count(*) filter (label = 1) as tp, count(*) as k, count(*) filter (label = 1 and s.score = t.score) as own from t join scored s on s.score >= t.score group by t.score) select round(sum(own * tp / k::double) / greatest((select sum(label) from scored), 1), 6) as ap from c")
def average_precision(spark, d):
    o = ordered_counts(scored(spark, d))
    tp, k = F.col("above_pos") + F.col("pos"), F.col("above_pos") + F.col("above_neg") + F.col("pos") + F.col("neg")
    return o.agg(F.round(F.coalesce(F.try_divide(F.sum(F.col("pos") * tp / k), F.max("all_pos")), F.lit(0.0)), 6).alias("ap"))


def candidates(s: DataFrame, n: int = QUANTILES, default: float = DEFAULT) -> DataFrame:
    """(t): the distinct values of n evenly spaced quantiles and the default; from the distinct scores' counts."""
    per = s.groupBy("score").agg(F.count("*").alias("c"))
    q = per.agg(F.percentile("score", F.array(*[F.lit(i / (n - 1)) for i in range(n)]), F.col("c")).alias("q"))
    return q.select(F.explode(F.array_union(F.coalesce("q", F.array()), F.array(F.lit(default)))).alias("t")).distinct()


def at_thresholds(s: DataFrame, ts: DataFrame) -> DataFrame:
    """(t, tp, fp, fn, tn) of each of a few hundred thresholds: scores are counted in the interval of thresholds they fall into, then summed."""
    edges = sorted(r.t for r in ts.collect())  # at most QUANTILES + 1
    at = F.array(*[F.lit(e) for e in edges])
    place = F.size(F.filter(at, lambda e: e <= F.col("score")))
    per = s.groupBy("score").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg")).groupBy(place.alias("i")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    every = s.sparkSession.createDataFrame([(i, e) for i, e in enumerate(edges, 1)] + [(0, None)], "i int, t double")
    w = Window.orderBy(F.desc("i"))
    o = every.join(per, "i", "left").na.fill(0, ["pos", "neg"])  # a few hundred rows
    o = o.select("i", "t", F.sum("pos").over(w).alias("tp"), F.sum("neg").over(w).alias("fp"), F.sum("pos").over(Window.partitionBy()).alias("p"), F.sum("neg").over(Window.partitionBy()).alias("n"))
    return o.where("t is not null").select("t", "tp", "fp", (F.col("p") - F.col("tp")).alias("fn"), (F.col("n") - F.col("fp")).alias("tn"))


def best_threshold(s: DataFrame, default: float = DEFAULT) -> DataFrame:
    """(t, f1, balanced_accuracy): best F1, then balanced accuracy, then nearness to the default, then the lowest."""
    m = rates(at_thresholds(s, candidates(s, QUANTILES, default)))
    m = m.select("t", F.round("f1", 9).alias("f1"), F.round((F.col("recall") + F.col("specificity")) / 2, 9).alias("balanced_accuracy"))
    return m.orderBy(F.desc("f1"), F.desc("balanced_accuracy"), F.abs(F.col("t") - default), "t").limit(1)


_levels = "[" + ", ".join(f"{i / (QUANTILES - 1)!r}" for i in range(QUANTILES)) + "]"
THRESHOLDS_SQL = f"""ts as (select distinct t from (select unnest(quantile_cont(score, {_levels})) as t from scored union all select {DEFAULT})),
m as (select t, count(*) filter (label = 1 and score >= t) as tp, count(*) filter (label = 0 and score >= t) as fp, count(*) filter (label = 1 and score < t) as fn, count(*) filter (label = 0 and score < t) as tn from ts, scored group by t),
o as (select t, round(case when tp + fp + fn = 0 then 0 else 2.0::double * tp / (2 * tp + fp + fn) end, 9) as f1, round((case when tp + fn = 0 then 0 else tp / (tp + fn)::double end + case when tn + fp = 0 then 0 else tn / (tn + fp)::double end) / 2, 9) as balanced_accuracy from m)"""


@query(f"with {SCORED_SQL}, {THRESHOLDS_SQL} select round(t, 6) as threshold, round(f1, 6) as f1, round(balanced_accuracy, 6) as balanced_accuracy from o order by f1 desc, balanced_accuracy desc, abs(t - {DEFAULT}), t limit 1")
def threshold_sweep(spark, d):
    return best_threshold(scored(spark, d)).select(F.round("t", 6).alias("threshold"), F.round("f1", 6).alias("f1"), F.round("balanced_accuracy", 6).alias("balanced_accuracy"))


@query(f"""with {SCORED_SQL}, {THRESHOLDS_SQL} select round(t, 6) as t, f1 from o""")
def threshold_table(spark, d):
    s = scored(spark, d)
    return rates(at_thresholds(s, candidates(s))).select(F.round("t", 6).alias("t"), F.round("f1", 9).alias("f1"))


@query(f"""with {SCORED_SQL}, c as (select g as candidate, message_id, label, least(1.0, score * (0.8 + 0.1 * g)) as score from scored, range(4) r(g)), m as (select candidate, count(*) filter (label = 1 and score >= 0.5) as tp, count(*) filter (label = 0 and score >= 0.5) as fp, count(*) filter (label = 1 and score < 0.5) as fn, count(*) filter (label = 0 and score < 0.5) as tn from c group by candidate)
select candidate, round(2.0::double * tp / (2 * tp + fp + fn), 6) as f1 from m order by round(2.0::double * tp / (2 * tp + fp + fn), 9) desc, round((tp / (tp + fn)::double + tn / (tn + fp)::double) / 2, 9) desc, candidate limit 1""")
def model_selection(spark, d):
    """Of several candidates the one of best F1, then balanced accuracy; the first wins ties."""
    c = scored(spark, d).crossJoin(spark.range(4).withColumnRenamed("id", "candidate")).withColumn("p", (F.least(F.lit(1.0), F.col("score") * (0.8 + 0.1 * F.col("candidate"))) >= 0.5).cast("int"))
    m = rates(confusion(c, ["candidate"]))
    return m.orderBy(F.desc(F.round("f1", 9)), F.desc(F.round((F.col("recall") + F.col("specificity")) / 2, 9)), "candidate").limit(1).select("candidate", F.round("f1", 6).alias("f1"))


@query(f"with {SCORED_SQL}, p as (select source, label, score as s, (score * 3) % 1 as h from scored), n as (select source, label, case when s + h > 0 then s / (s + h) else 0.5 end as p from p) select source, round(avg(p), 6) as mean_spam, round(avg(case when label = 1 then p end), 6) as mean_spam_of_spam, round(avg(case when label = 0 then p end), 6) as mean_spam_of_ham from n group by source")
def mean_probabilities(spark, d):
    """Probability pairs brought to a sum of one (one half where it is zero), averaged over all, spam and ham."""
    s = scored(spark, d).withColumn("h", (F.col("score") * 3) % 1)
    p = F.coalesce(F.try_divide(F.col("score"), F.col("score") + F.col("h")), F.lit(0.5))
    return s.withColumn("p", p).groupBy("source").agg(F.round(F.avg("p"), 6).alias("mean_spam"), *[F.round(F.avg(F.when(F.col("label") == v, F.col("p"))), 6).alias(f"mean_spam_of_{n}") for v, n in ((1, "spam"), (0, "ham"))])


@query(f"with {SCORED_SQL} select source, count(*) as rows, count(*) filter (score >= 0.5) as predicted_spam, count(*) filter (score < 0.5) as predicted_ham, round_even(avg(case when (score >= 0.5) = (label = 1) then 1.0::double else 0 end), 6) as accuracy from scored group by source")
def run_summary(spark, d):
    s = scored(spark, d)
    spam = F.col("score") >= 0.5
    return s.groupBy("source").agg(F.count("*").alias("rows"), F.count_if(spam).alias("predicted_spam"), F.count_if(~spam).alias("predicted_ham"), F.bround(F.avg((spam == (F.col("label") == 1)).cast("double")), 6).alias("accuracy"))


@query(f"with {SCORED_SQL}, m as (select message_id, label, case when score >= 0.5 then 1 else 0 end as p, score from scored) select message_id, label, p from m where p <> label or score > 0.95 order by message_id limit 30")
def failures(spark, d):
    """The first 30 rows that were misread or overly sure, in table order: a report of a fixed size."""
    s = scored(spark, d).withColumn("p", (F.col("score") >= 0.5).cast("int"))
    return s.where((F.col("p") != F.col("label")) | (F.col("score") > 0.95)).orderBy("message_id").limit(30).select("message_id", "label", "p")


@query(f"""with {SCORED_SQL}, m as (select label, case when score >= 0.5 then 1 else 0 end as p from scored), k as (select c as class, count(*) filter (label = c and p = c) as hit, count(*) filter (p = c) as said, count(*) filter (label = c) as support from m, (values (0), (1)) v(c) group by c),
r as (select *, case when said = 0 then 0 else hit / said::double end as prec, case when support = 0 then 0 else hit / support::double end as rec from k), f as (select *, case when prec + rec = 0 then 0 else 2 * prec * rec / (prec + rec) end as f1 from r)
select round(avg(prec), 6) as macro_precision, round(avg(rec), 6) as macro_recall, round(avg(f1), 6) as macro_f1, round(sum(prec * support) / sum(support), 6) as weighted_precision, round(sum(rec * support) / sum(support), 6) as weighted_recall, round(sum(f1 * support) / sum(support), 6) as weighted_f1 from f""")
def class_averages(spark, d):
    """Precision, recall and F1 of each class, averaged plainly and by support; zeros on empty input."""
    s = scored(spark, d).withColumn("p", (F.col("score") >= 0.5).cast("int"))
    one = rates(confusion(s, [])).select("precision", "recall", "f1", (F.col("tp") + F.col("fn")).alias("support"))
    zero = rates(confusion(s.withColumns({"label": 1 - F.col("label"), "p": 1 - F.col("p")}), [])).select("precision", "recall", "f1", (F.col("tp") + F.col("fn")).alias("support"))
    both = one.unionByName(zero)
    r = lambda c, n: F.round(F.coalesce(c, F.lit(0.0)), 6).alias(n)
    return both.agg(*[r(F.avg(c), f"macro_{c}") for c in ("precision", "recall", "f1")], *[r(F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")), f"weighted_{c}") for c in ("precision", "recall", "f1")])


#: Resamples of a bootstrap interval.
RESAMPLES = 200


def bootstrap(s: DataFrame, resamples: int = RESAMPLES, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """(f1, low, high): interval of F1 over Poisson resamples: each row counts in each resample as often as a hash of both says. Rows stay where they are;
    a task gives one row for each resample."""
    u = F.pmod(F.xxhash64("message_id", "k"), F.lit(1 << 30)) / float(1 << 30)
    edges, p, total = [], 0.36787944117144233, 0.0
    for i in range(8):  # probabilities of a Poisson number of mean one
        total += p
        edges.append(total)
        p /= i + 1
    weight = sum((u >= e).cast("int") for e in edges)
    r = s.withColumn("p", (F.col("score") >= 0.5).cast("int")).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(resamples)))).withColumn("w", weight)
    cell = lambda a, b: F.coalesce(F.sum(F.when((F.col("label") == a) & (F.col("p") == b), F.col("w"))), F.lit(0))
    f = rates(r.groupBy("k").agg(cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(0, 0).alias("tn")))
    return f.agg(F.round(F.avg("f1"), 6).alias("f1"), F.round(F.expr(f"percentile(f1, {low})"), 6).alias("low"), F.round(F.expr(f"percentile(f1, {high})"), 6).alias("high"))


@query()
def bootstrap_interval(spark, d):
    return bootstrap(scored(spark, d))


# repeats ------------------------------------------------------------------------------------------------------------------------------------

REPEATS_SQL = "repeats as (select 'm' || (user_id % 5) as method, event_id as run, 40 + user_id % 5 as rows, 'cpu' as device, value + 1 as inference_seconds, value * 2 as peak_rss_mib from events where value is not null)"


def repeats(spark, d) -> DataFrame:
    e = table(spark, d, "events").where("value is not null")
    return e.select(F.concat(F.lit("m"), (F.col("user_id") % 5).cast("string")).alias("method"), F.col("event_id").alias("run"), (40 + F.col("user_id") % 5).alias("rows"), F.lit("cpu").alias("device"), (F.col("value") + 1).alias("inference_seconds"), (F.col("value") * 2).alias("peak_rss_mib"))


def aggregate_repeats(r: DataFrame, same: tuple[str, ...] = ("rows", "device"), medians: tuple[str, ...] = ("inference_seconds", "peak_rss_mib")) -> DataFrame:
    """One row for each method: medians over its repeats, throughput and latency from the median time, its range; fields that must not differ between
    repeats raise an error if they do."""
    checks = [F.min(F.struct(c)).alias(f"low_{c}") for c in same] + [F.max(F.struct(c)).alias(f"high_{c}") for c in same]
    g = cut(r.groupBy("method").agg(*[F.median(c).alias(c) for c in medians], F.count("*").alias("repeat_count"), F.min("inference_seconds").alias("inference_seconds_min"), F.max("inference_seconds").alias("inference_seconds_max"), *checks))
    for c in same:
        bad = [x.method for x in g.where(f"not (low_{c} <=> high_{c})").select("method").limit(20).collect()]
        if bad:
            raise ValueError(f"{', '.join(sorted(bad))}: field {c!r} differs between repeats")
    g = g.select("method", *[F.col(f"low_{c}.{c}").alias(c) for c in same], *medians, "repeat_count", "inference_seconds_min", "inference_seconds_max")
    return g.withColumns({"samples_per_second": F.col("rows") / F.col("inference_seconds"), "ms_per_sample": F.col("inference_seconds") * 1000 / F.col("rows")})


@query(f"with {REPEATS_SQL}, m as (select method, max(rows) as rows, median(inference_seconds) as s, median(peak_rss_mib) as rss, count(*) as repeat_count, min(inference_seconds) as lo, max(inference_seconds) as hi from repeats group by method) select method, rows, round(s, 6) as seconds, round(rss, 6) as rss, repeat_count, round(lo, 6) as low, round(hi, 6) as high, round(rows / s, 6) as per_second, round(s * 1000 / rows, 6) as ms from m")
def repeat_medians(spark, d):
    g = aggregate_repeats(repeats(spark, d))
    r = lambda c, n: F.round(c, 6).alias(n)
    return g.select("method", "rows", r("inference_seconds", "seconds"), r("peak_rss_mib", "rss"), "repeat_count", r("inference_seconds_min", "low"), r("inference_seconds_max", "high"), r("samples_per_second", "per_second"), r("ms_per_sample", "ms"))
