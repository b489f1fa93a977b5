"""All queries of the engine, and the simple plans among them that are one text in two spellings: counts, summaries, metrics, pivots, series.

A plan here is a function of a dialect that returns SQL over named tables: Catalyst gets the Spark spelling, the second engine the other. ``run``
binds the tables a plan names. Plans with rules of their own are in the other modules, with SQL written from the rules.
Shared part: ``clean`` strips subject and body and drops rows empty in both.
"""

from __future__ import annotations

import os

from mailforge.plans import curation, evaluation, models, replies
from mailforge.plans import runs as run_plans
from mailforge.plans.dialect import BLANKS, Duck, Spark

TABLES = ("combine", "split_rows", "events", "embeddings", "source_registry", "duplicate_report")
PLANS = {}


def plan(f):
    PLANS[f.__name__] = f
    return f


def strip(d, x):
    return d.rx(f"coalesce({x}, '')", f"^{BLANKS}+|{BLANKS}+$")


def source(d, x="source"):
    return d.rx(f"lower({strip(d, x)})", r"[\s_\-]+", "_")


def clean(d):
    key = ", ".join(f"lpad({d.text(x)}, {n}, '0')" for x, n in (("coalesce(source_rank, 999)", 4), ("coalesce(row_in_source, 0)", 15), ("message_id", 19)))
    return f"""clean as (
  select * from (select message_id, {strip(d, 'subject')} as subject, {strip(d, 'body')} as body, label, case when {source(d)} = '' then 'unknown' else {source(d)} end as source, concat({key}) as pos from combine) c
  where subject <> '' or body <> '')"""


def scored(d):
    """Deterministic scores of the labelled rows: a stand-in for a model's predictions."""
    return f"""{clean(d)}, scored as (
  select message_id, label, source, (label * 300 + (message_id * 7919) % 701) / 1000.0e0 as score,
    case when message_id % 37 = 0 then -1 when label * 300 + (message_id * 7919) % 701 >= 500 then 1 else 0 end as prediction
  from clean where label in (0, 1))"""


CONFUSION = "sum(case when label = 1 and p = 1 then 1 else 0 end) as tp, sum(case when label = 0 and p = 1 then 1 else 0 end) as fp, sum(case when label = 1 and p = 0 then 1 else 0 end) as fn, sum(case when label = 0 and p = 0 then 1 else 0 end) as tn"


def rates(c="m"):
    p, r, s = "tp / cast(greatest(tp + fp, 1) as double)", "tp / cast(greatest(tp + fn, 1) as double)", "tn / cast(greatest(tn + fp, 1) as double)"
    f1 = f"2 * ({p}) * ({r}) / greatest(({p}) + ({r}), 1e-12)"
    return f"""round((tp + tn) / cast(greatest(tp + fp + fn + tn, 1) as double), 6) as accuracy, round({p}, 6) as prec, round({r}, 6) as recall, round({f1}, 6) as f1, round({s}, 6) as specificity,
    round((({r}) + ({s})) / 2, 6) as balanced_accuracy, round(fp / cast(greatest(tn + fp, 1) as double), 6) as fpr, round(fn / cast(greatest(tp + fn, 1) as double), 6) as fnr, round((tp + fp) / cast(greatest(tp + fp + fn + tn, 1) as double), 6) as spam_rate"""


@plan
def class_counts(d):
    return f"with {clean(d)} select source, label, count(*) as n from clean group by source, label"


@plan
def dataset_summary(d):
    return f"with {clean(d)} select source, count(*) as n, round(sum(length(subject)) / cast(greatest(count(*), 1) as double), 6) as avg_subject, round(sum(length(body)) / cast(greatest(count(*), 1) as double), 6) as avg_body from clean group by source"


@plan
def binary_metrics(d):
    return f"with {scored(d)}, m as (select source, {CONFUSION} from (select *, case when score >= 0.5 then 1 else 0 end as p from scored) x group by source) select source, tp, fp, fn, tn, {rates()} from m"


@plan
def failure_aware_metrics(d):
    return f"with {scored(d)}, m as (select {CONFUSION} from (select label, case when prediction in (0, 1) then prediction else 1 - label end as p from scored) x) select tp, fp, fn, tn, {rates()} from m"


@plan
def prediction_crosstab(d):
    return f"with {scored(d)} select label, sum(case when prediction = 0 then 1 else 0 end) as as_ham, sum(case when prediction = 1 then 1 else 0 end) as as_spam, sum(case when prediction = -1 then 1 else 0 end) as unparsed from scored group by label"


@plan
def source_macro_f1(d):
    return f"with {scored(d)}, m as (select source, {CONFUSION} from (select *, case when score >= 0.5 then 1 else 0 end as p from scored) x group by source), f as (select {rates()} from m) select round(avg(f1), 5) as macro_f1, count(*) as sources from f"


@plan
def macro_weighted_metrics(d):
    return f"""with {scored(d)}, m as (select {CONFUSION} from (select *, case when score >= 0.5 then 1 else 0 end as p from scored) x), f as (select *, 2.0e0 * tp / greatest(2 * tp + fp + fn, 1) as f1_1, 2.0e0 * tn / greatest(2 * tn + fp + fn, 1) as f1_0 from m)
select round((f1_0 + f1_1) / 2, 6) as macro_f1, round((f1_0 * (tn + fp) + f1_1 * (tp + fn)) / (tp + fp + fn + tn), 6) as weighted_f1, round((cast(tp as double) * tn - cast(fp as double) * fn) / greatest(sqrt(cast(tp + fp as double) * (tp + fn) * (tn + fp) * (tn + fn)), 1e-12), 6) as mcc from f"""


@plan
def probability_metrics(d):
    p = "least(greatest(score, 1e-12), 1 - 1e-12)"
    return f"with {scored(d)} select round(avg(-(label * ln({p}) + (1 - label) * ln(1 - {p}))), 6) as log_loss, round(avg((score - label) * (score - label)), 6) as brier, round(avg(abs(score - label)), 6) as mae, round(avg(-({p} * ln({p}) + (1 - {p}) * ln(1 - {p}))), 6) as entropy, round(avg(score), 6) as mean_spam from scored"


def runs(d):
    return "runs as (select user_id as run_id, event_type as metric, event_id as step, value from events where value is not null)"


@plan
def metric_pivot(d):
    return f"with {runs(d)}, l as (select *, row_number() over (partition by run_id, metric order by step desc) as r from runs) select run_id, max(case when metric = 'click' then value end) as click, max(case when metric = 'view' then value end) as view_value, count(*) as metrics from l where r = 1 group by run_id"


@plan
def training_progress(d):
    return f"with {runs(d)} select run_id, metric, step, round(100.0e0 * step / max(step) over (partition by run_id), 6) as progress from runs"


@plan
def rolling_median(d):
    """Centred median of seven values; at the ends of those there are."""
    a = d.window_list("value", "partition by run_id order by step rows between 3 preceding and 3 following")
    return f"with {runs(d)}, w as (select run_id, step, {a} as a from runs) select run_id, step, round(({d.at('a', f'({d.size(chr(97))} + 1) / 2.0 - 0.5 * (({d.size(chr(97))} + 1) % 2)')} + {d.at('a', f'({d.size(chr(97))} + 2) / 2.0 - 0.5 * ({d.size(chr(97))} % 2)')}) / 2, 6) as med from w"


@plan
def runtime_statistics(d):
    return f"with {runs(d)} select metric, count(*) as n, round(avg(value), 6) as mean, round({d.quantile('value', 0.5)}, 6) as med, round(min(value), 6) as low, round(max(value), 6) as high from runs group by metric"


@plan
def rank_configs(d):
    """Best step per run by value, then later step; ranked over all runs."""
    return f"with {runs(d)}, b as (select *, row_number() over (partition by run_id order by value desc, step desc) as r from runs) select run_id, step, value, row_number() over (order by value desc, run_id) as place from b where r = 1"


@plan
def complete_groups(d):
    return f"with {runs(d)} select run_id, count(distinct metric) as kinds, count(*) as n from runs group by run_id having count(distinct metric) = (select count(distinct metric) from runs)"


@plan
def checkpoint_numbers(d):
    return f"with {runs(d)} select run_id, step, row_number() over (partition by run_id order by step, metric) as checkpoint_no from runs"


@plan
def compose_text(d):
    return f"select message_id, case when s <> '' and b <> '' then concat('Subject: ', s, chr(10), chr(10), b) when s <> '' then concat('Subject: ', s) else b end as email_text from (select message_id, {strip(d, 'subject')} as s, {strip(d, 'body')} as b from combine) x where s <> '' or b <> ''"


@plan
def training_lines(d):
    body = d.rx(f"replace(replace(concat(subject, ' ', body), chr(0), ' '), '__label__', 'label_')", BLANKS + "+", " ")
    return f"with {clean(d)} select message_id, concat('__label__', case when label = 1 then 'spam' else 'ham' end, ' ', {strip(d, body)}) as line from clean where label in (0, 1)"


@plan
def normalize_labels(d):
    return f"select duplicate_group_id, case when lower({strip(d, 'labels')}) in ('[1]', '1', 'spam', 'true') then 1 when lower({strip(d, 'labels')}) in ('[0]', '0', 'ham', 'valid', 'false') then 0 end as label, {d.number(strip(d, d.text('duplicate_count')))} as n from duplicate_report"


@plan
def length_quantiles(d):
    return f"with {clean(d)}, l as (select source, length(body) as n from clean) select source, count(*) as n, round(avg(n), 6) as mean, round({d.quantile('n', 0.5)}, 6) as med, round({d.quantile('n', 0.95)}, 6) as p95 from l group by source"


def run(spark, name: str, folder: str):
    """A plan over the tables of a folder."""
    sql = PLANS[name](Spark())
    for t in TABLES:
        if f" {t}" in sql:
            spark.read.parquet(os.path.join(folder, f"{t}.parquet")).createOrReplaceTempView(t)
    return spark.sql(sql)


def queries():
    return curation.QUERIES | replies.QUERIES | evaluation.QUERIES | run_plans.QUERIES | models.QUERIES | {name: (lambda spark, d, name=name: run(spark, name, d)) for name in PLANS}


def oracle_sql():
    return curation.SQL | replies.SQL | evaluation.SQL | run_plans.SQL | models.SQL | {name: f(Duck()) for name, f in PLANS.items()}
