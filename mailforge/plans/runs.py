"""Metric streams of training runs: names and contexts, selection, joins with metadata, progress, curves, pivots, run times, stores.

A stream is the events table: run_hash ``run<user_id>``, metric its event_type, step event_id, the context its props; half the names carry the prefix
of evaluations.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailforge.plans.evaluation import spaced_index
from mailforge.session import table

QUERIES, SQL = {}, {}
#: Metrics that are exported when any of them is there, points of a curve at most, checkpoints of a run at most.
DEFAULT_METRICS, POINTS, PER_RUN = ("click", "view"), 80, 5


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


STREAM_SQL = """stream as (select 'run' || user_id as run_hash, user_id, case when event_id % 2 = 0 then 'eval_' else '' end || event_type as name, event_type as metric, event_id as step, value, props from events where value is not null)"""


def stream(spark, d) -> DataFrame:
    e = table(spark, d, "events").where("value is not null")
    name = F.concat(F.when(F.col("event_id") % 2 == 0, "eval_").otherwise(""), F.col("event_type"))
    return e.select(F.concat(F.lit("run"), F.col("user_id").cast("string")).alias("run_hash"), "user_id", name.alias("name"), F.col("event_type").alias("metric"), F.col("event_id").alias("step"), "value", "props")


def context_label(m: Column) -> Column:
    """``k=v`` pairs of a map by key; ``no-context`` for an empty or missing one."""
    pairs = F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e.key, F.lit("="), e.value))
    return F.when(m.isNull() | (F.size(m) == 0), "no-context").otherwise(F.array_join(pairs, ", "))


def metric_identity(name: Column, m: Column) -> Column:
    """Name and context as one text: ``name::{"k": "v"}`` with sorted keys."""
    pairs = F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(F.to_json(F.array(e.key)), F.to_json(F.array(e.value))))
    inner = F.array_join(F.transform(pairs, lambda p: F.replace(F.regexp_replace(p, r'^\[|\]$', ""), F.lit("]["), F.lit(": "))), ", ")
    return F.concat(name, F.lit("::{"), inner, F.lit("}"))


def context(props: Column) -> Column:
    return F.from_json(props, "map<string,string>")


@query(f"with {STREAM_SQL} select step, case when props is null or (props ->> '$.k') is null then 'no-context' else 'k=' || (props ->> '$.k') end as label, metric || '::{{\"k\": \"' || (props ->> '$.k') || '\"}}' as identity from stream")
def metric_contexts(spark, d):
    m = context(F.col("props"))
    return stream(spark, d).select("step", context_label(m).alias("label"), metric_identity(F.col("metric"), m).alias("identity"))


@query(f"with {STREAM_SQL} select step, case when name like 'eval\\_%' escape '\\' then 'validation' else 'train' end as subset, regexp_replace(name, '^eval_', '') as metric from stream")
def metric_names(spark, d):
    """The prefix of evaluations becomes a subset."""
    is_eval = F.col("name").startswith("eval_")
    return stream(spark, d).select("step", F.when(is_eval, "validation").otherwise("train").alias("subset"), F.regexp_replace("name", "^eval_", "").alias("metric"))


def default_metrics(s: DataFrame, wanted: tuple[str, ...]) -> DataFrame:
    """The rows of the wanted metrics; all rows where none of them occurs."""
    any_ = s.agg(F.coalesce(F.bool_or(F.col("metric").isin(*wanted)), F.lit(False)).alias("_any"))
    return s.crossJoin(F.broadcast(any_)).where(F.col("metric").isin(*wanted) | ~F.col("_any")).drop("_any")  # one row


@query(f"with {STREAM_SQL} select step, metric from stream where metric in {DEFAULT_METRICS}")
def exported_metrics(spark, d):
    return default_metrics(stream(spark, d), DEFAULT_METRICS).select("step", "metric")


@query(f"with {STREAM_SQL} select step, metric from stream")
def exported_without_defaults(spark, d):
    return default_metrics(stream(spark, d), ("no such metric",)).select("step", "metric")


#: A sweep: its grid as group, context lengths and the values that vary.
LENGTHS, RATES, SIZES, DROPOUTS = (512, 1024), (1e-6, 5e-5, 1e-4), ((8, 16), (32, 64), (64, 128)), (0.0, 0.4)


def sweep() -> list[tuple]:
    """(config_index, group, max_seq_length, learning_rate, rank, alpha, dropout): one factor varies at a time, for each length."""
    base = (1e-4, 16, 32, 0.05)
    rows = [("LR/context", n, r, *base[1:]) for n, r in itertools.product(LENGTHS, RATES)]
    rows += [("LoRA capacity", n, base[0], *ra, base[3]) for n, ra in itertools.product(LENGTHS, SIZES)]
    rows += [("Dropout", n, *base[:3], x) for n, x in itertools.product(LENGTHS, DROPOUTS)]
    return [(i, *r) for i, r in enumerate(rows, 1)]


def float_token(x: Column) -> Column:
    """A number as part of a name: known small ones in their usual spelling, others with p for the point."""
    known = {1e-6: "1e-6", 5e-5: "5e-5", 1e-4: "1e-4", 0.0: "0p0", 0.05: "0p05", 0.1: "0p1", 0.4: "0p4"}  # fixed values
    out = F
    for v, name in known.items():
        out = out.when(F.abs(x - v) <= 1e-12, name)
    return out.otherwise(F.replace(F.regexp_replace(F.format_string("%.6f", x), r"\.?0+$", ""), F.lit("."), F.lit("p")))


def configs(spark) -> DataFrame:
    c = spark.createDataFrame(sweep(), "config_index int, grp string, max_seq_length int, learning_rate double, lora_r int, lora_alpha int, lora_dropout double")
    group = F.replace(F.replace(F.lower("grp"), F.lit("/"), F.lit("_")), F.lit(" "), F.lit("_"))
    s = lambda c: F.col(c).cast("string")
    return c.withColumn("config_id", F.concat(group, F.lit("_seq"), s("max_seq_length"), F.lit("_lr"), float_token(F.col("learning_rate")), F.lit("_r"), s("lora_r"), F.lit("_a"), s("lora_alpha"), F.lit("_do"), float_token(F.col("lora_dropout"))))


def _sweep_sql() -> str:
    rows = ", ".join(f"({i}, '{g.lower().replace('/', '_').replace(' ', '_')}', {n}, '{ {1e-6: '1e-6', 5e-5: '5e-5', 1e-4: '1e-4'}[r]}', {a}, {b}, '{ {0.0: '0p0', 0.05: '0p05', 0.4: '0p4'}[x]}')" for i, g, n, r, a, b, x in sweep())
    return f"c as (select * from (values {rows}) v(config_index, g, n, lr, r, a, x)), named as (select config_index, n as max_seq_length, g || '_seq' || n || '_lr' || lr || '_r' || r || '_a' || a || '_do' || x as config_id from c)"


@query(f"with {_sweep_sql()} select config_index, max_seq_length, config_id from named")
def sweep_configs(spark, d):
    return configs(spark).select("config_index", "max_seq_length", "config_id")


def parsed_name(name: Column) -> tuple[Column, Column, Column]:
    """(config_index, config_id, max_seq_length) of a run's name ``...__<index>__<id>``; an error where there is none."""
    index, id_ = F.regexp_extract(name, r"__(\d+)__([^ ]+)", 1), F.regexp_extract(name, r"__(\d+)__([^ ]+)", 2)
    length = F.regexp_extract(id_, r"seq(\d+)", 1)
    fail = F.raise_error(F.concat(F.lit("no config in the run name: "), name)).cast("int")
    return F.when(index == "", fail).otherwise(index.cast("int")), id_, F.when(length == "", fail).otherwise(length.cast("int"))


META_SQL = f"{_sweep_sql()}, meta as (select distinct 'run' || user_id as run_hash, config_id, config_index, max_seq_length from events join named on config_index = 1 + user_id % 16)"


def metadata(spark, d) -> DataFrame:
    """(run_hash, run_name) with what the name says."""
    runs = table(spark, d, "events").select("user_id").distinct()
    named = runs.join(F.broadcast(configs(spark).select("config_index", "config_id")), F.col("config_index") == 1 + F.col("user_id") % 16)  # a row for each config
    r = named.select(F.concat(F.lit("run"), F.col("user_id").cast("string")).alias("run_hash"), F.concat(F.lit("sweep__"), F.col("config_index").cast("string"), F.lit("__"), F.col("config_id"), F.lit(" (1)")).alias("run_name"))
    i, id_, n = parsed_name(F.col("run_name"))
    return r.select("run_hash", "run_name", i.alias("config_index"), F.format_string("K%02d", i).alias("config_label"), id_.alias("config_id"), n.alias("max_seq_length"))


@query(f"with {META_SQL} select run_hash, config_index, 'K' || lpad(cast(config_index as varchar), 2, '0') as config_label, config_id, max_seq_length from meta")
def run_metadata(spark, d):
    return metadata(spark, d).select("run_hash", "config_index", "config_label", "config_id", "max_seq_length")


@query(f"with {META_SQL}, {STREAM_SQL}, t as (select run_hash, max(step) as last from stream where metric = 'click' and name not like 'eval%' group by run_hash) select s.step, s.run_hash, m.config_index, round(s.step * 100.0::double / t.last, 6) as progress from stream s left join meta m using (run_hash) left join t using (run_hash)")
def progress_with_metadata(spark, d):
    """Each point with its run's config and its share of the run's last training step of one metric; runs without that metric have none."""
    s = stream(spark, d)
    last = s.where("metric = 'click' and not startswith(name, 'eval')").groupBy("run_hash").agg(F.max("step").alias("last"))
    j = s.join(metadata(spark, d), "run_hash", "left").join(last, "run_hash", "left")
    return j.select("step", "run_hash", "config_index", F.round(F.col("step") * 100.0 / F.col("last"), 6).alias("progress"))


@query(f"with {STREAM_SQL}, o as (select *, row_number() over (partition by run_hash order by step) - 1 as i, count(*) over (partition by run_hash) as n from stream), k as (select run_hash, n, unnest([round_even(j * (n - 1) / {POINTS - 1}.0::double, 0) for j in range({POINTS})]) as i from (select distinct run_hash, n from o)) select o.run_hash, o.step, o.value from o where n <= {POINTS} or exists (select 1 from k where k.run_hash = o.run_hash and k.i = o.i)")
def curve_downsample(spark, d):
    """At most POINTS evenly spaced points of each run."""
    w = Window.partitionBy("run_hash")
    o = stream(spark, d).withColumn("i", F.row_number().over(w.orderBy("step")) - 1).withColumn("n", F.count("*").over(w))
    return o.where(spaced_index("i", "n", POINTS)).select("run_hash", "step", "value")


@query(f"with {STREAM_SQL}, o as (select *, row_number() over (partition by user_id, metric order by step) - 1 as i, count(*) over (partition by user_id, metric) as n from stream), k as (select distinct user_id, metric, n, unnest(case when n <= {PER_RUN} then range(n) else [cast(round_even(j * (n - 1) / {PER_RUN - 1}.0::double, 0) as bigint) for j in range({PER_RUN})] end) as i from o) select o.user_id, o.metric, max(o.n) as available, count(k.i) as selected, '[' || string_agg(cast(o.step as varchar), ', ' order by o.step) filter (k.i is not null) || ']' as steps from o left join k on k.user_id = o.user_id and k.metric = o.metric and k.i = o.i group by o.user_id, o.metric")
def limited_per_run(spark, d):
    """How many points of each run are there and chosen, and the chosen steps (PER_RUN at most)."""
    w = Window.partitionBy("user_id", "metric")
    o = stream(spark, d).withColumn("i", F.row_number().over(w.orderBy("step")) - 1).withColumn("n", F.count("*").over(w)).withColumn("chosen", spaced_index("i", "n", PER_RUN))
    steps = F.transform(F.sort_array(F.collect_list(F.when(F.col("chosen"), F.col("step")))), lambda x: x.cast("string"))
    return o.groupBy("user_id", "metric").agg(F.max("n").alias("available"), F.count_if("chosen").alias("selected"), F.concat(F.lit("["), F.array_join(steps, ", "), F.lit("]")).alias("steps"))


@query(f"with {META_SQL}, {STREAM_SQL}, l as (select run_hash, metric, arg_max(value, step) as v from stream group by 1, 2), p as (select run_hash, max(case when metric = 'click' then v end) as runtime, max(case when metric = 'view' then v end) as steps_s, max(case when metric = 'error' then v end) as samples_s from l group by 1) select m.max_seq_length, count(*) as n, round(avg(runtime), 6) as mean_h, round(median(runtime), 6) as median_h, round(min(runtime), 6) as min_h, round(max(runtime), 6) as max_h, round(avg(steps_s), 6) as mean_steps_s, round(avg(samples_s), 6) as mean_samples_s from p join meta m using (run_hash) where runtime is not null group by 1")
def runtime_by_context(spark, d):
    """Last values of three metrics side by side for each run, runs without the key metric dropped, then summed up by context length."""
    last = stream(spark, d).groupBy("run_hash", "metric").agg(F.max_by("value", "step").alias("v"))
    of = lambda m: F.max(F.when(F.col("metric") == m, F.col("v")))
    p = last.groupBy("run_hash").agg(of("click").alias("runtime"), of("view").alias("steps_s"), of("error").alias("samples_s")).where("runtime is not null")
    r = lambda c, n: F.round(c, 6).alias(n)
    return p.join(metadata(spark, d), "run_hash").groupBy("max_seq_length").agg(F.count("*").alias("n"), r(F.avg("runtime"), "mean_h"), r(F.median("runtime"), "median_h"), r(F.min("runtime"), "min_h"), r(F.max("runtime"), "max_h"), r(F.avg("steps_s"), "mean_steps_s"), r(F.avg("samples_s"), "mean_samples_s"))


@query(f"with {STREAM_SQL} select run_hash, step, row_number() over (order by step desc, run_hash desc) as place from stream where run_hash in (select run_hash from stream group by 1 having count(*) > 0) order by step desc, run_hash desc limit 50")
def latest_runs(spark, d):
    """The 50 latest points, newest first, ties by hash downwards."""
    s = stream(spark, d).orderBy(F.desc("step"), F.desc("run_hash")).limit(50)
    return s.select("run_hash", "step", F.row_number().over(Window.orderBy(F.desc("step"), F.desc("run_hash"))).alias("place"))  # 50 rows


@query("select duplicate_group_id, coalesce(try_cast(duplicate_count as double), 'NaN'::double) as n, case when duplicate_count is null then '--' else printf('%.1f', 100.0 * duplicate_count / 7) end as pct, case when duplicate_group_id % 3 = 0 then 'failed' when duplicate_group_id % 3 = 1 then 'interrupted' else 'completed' end as status from duplicate_report where duplicate_group_id % 3 <> 2")
def failed_rows(spark, d):
    """Rows of some states, numbers read as NaN where they cannot be, percentages as text with -- for those."""
    r = table(spark, d, "duplicate_report")
    k = F.col("duplicate_group_id") % 3
    status = F.when(k == 0, "failed").when(k == 1, "interrupted").otherwise("completed")
    n = F.coalesce(F.expr("try_cast(duplicate_count as double)"), F.lit(float("nan")))
    return r.select("duplicate_group_id", n.alias("n"), F.when(F.isnan(n), "--").otherwise(F.format_string("%.1f", 100.0 * n / 7)).alias("pct"), status.alias("status")).where(F.col("status").isin("failed", "interrupted", "metrics_json_invalid"))


@query(f"with {STREAM_SQL}, old as (select run_hash, metric, max(step) as step from stream where step % 3 <> 0 group by 1, 2), new as (select run_hash, metric, max(step) as step from stream where step % 3 = 0 and user_id % 2 = 0 group by 1, 2), u as (select *, 0 as o from old union all select *, 1 from new), m as (select *, row_number() over (partition by run_hash, metric order by o desc) as r from u) select run_hash, metric, step, case when o = 1 then 'merged' else 'kept' end as state from m where r = 1")
def merged_store(spark, d):
    """Upsert of a store: rows of the newer one replace those of the same key, the others stay."""
    s = stream(spark, d)
    part = lambda c: s.where(c).groupBy("run_hash", "metric").agg(F.max("step").alias("step"))
    return upsert(part("step % 3 <> 0"), part("step % 3 = 0 and user_id % 2 = 0"), ["run_hash", "metric"])


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    u = old.withColumn("_o", F.lit(0)).unionByName(new.withColumn("_o", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in u.columns if c not in key]
    m = u.groupBy(*key).agg(F.max(F.struct("_o", *[c for c in rest if c != "_o"])).alias("m"))
    return m.select(*key, *[f"m.{c}" for c in rest if c != "_o"], F.when(F.col("m._o") == 1, "merged").otherwise("kept").alias("state"))


@query(f"with {STREAM_SQL}, store as (select distinct run_hash from stream where user_id % 5 <> 0) select s.run_hash, case when t.run_hash is null then 'failed' else 'merged' end as state, count(*) as n from stream s left join store t using (run_hash) group by 1, 2")
def merge_report(spark, d):
    """Runs told apart by whether the target store has them."""
    s = stream(spark, d)
    there = s.where("user_id % 5 <> 0").select("run_hash").distinct().withColumn("there", F.lit(True))
    return s.groupBy("run_hash").agg(F.count("*").alias("n")).join(there, "run_hash", "left").select("run_hash", F.when(F.col("there"), "merged").otherwise("failed").alias("state"), "n")


@query(f"with {STREAM_SQL} select run_hash, null as value, step from stream where metric = 'click' union all select run_hash, value, null from stream where metric = 'view'")
def uneven_union(spark, d):
    """Union of tables with different columns: what one lacks is null."""
    s = stream(spark, d)
    return s.where("metric = 'click'").select("run_hash", "step").unionByName(s.where("metric = 'view'").select("run_hash", "value"), allowMissingColumns=True)


@query("with n as (select vec_id, embedding, sqrt(list_sum([y::double * y::double for y in embedding])) as norm from embeddings) select vec_id, generate_subscripts(embedding, 1) - 1 as i, round(unnest(embedding)::double / case when norm > 0 then norm else 1 end, 4) + 0.0 as x from n")
def vector_normalize(spark, d):
    """Vectors brought to length one, place by place; the zero vector stays."""
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode(unit(F.col("embedding"))).alias("i", "x"))
    return e.select("vec_id", "i", (F.round("x", 4) + 0.0).alias("x"))


def unit(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


@query("select label, i, round(avg(x), 6) as mean from (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as i from embeddings) group by label, i")
def chunk_means(spark, d):
    """Means of the vectors of a group, place by place, as rows (no array grows in a task)."""
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    return e.groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


def flattened(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested structs as columns with dotted names; arrays and maps as JSON."""
    from pyspark.sql import types as T

    def walk(c: Column, kind, name: str):
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                yield from walk(c[f.name], f.dataType, f"{name}{sep}{f.name}")
        else:
            yield (F.to_json(c) if isinstance(kind, (T.ArrayType, T.MapType)) else c).alias(name)

    return df.select(*[x for f in df.schema.fields for x in walk(F.col(f"`{f.name}`"), f.dataType, f.name)])


def ordered_columns(df: DataFrame, first: list[str], extras: bool = True) -> DataFrame:
    """The columns of first that are there, in that order, then (extras) the others sorted by name."""
    there = [c for c in first if c in df.columns]
    return df.select(*[f"`{c}`" for c in there + (sorted(set(df.columns) - set(there)) if extras else [])])


def distinct_arguments(text: str) -> list[str]:
    """Parts of a comma-separated text, stripped, empty ones left out, the first of equal ones kept."""
    return list(dict.fromkeys(p.strip() for p in text.split(",") if p.strip()))


def config_indexes(values: list[str] | None, available: set[int] | None = None) -> list[int]:
    """Numbers from texts with commas; all without any; unknown ones are an error."""
    available = available or {r[0] for r in sweep()}
    out = [int(p) for v in values or [] for p in str(v).split(",") if p.strip()] or sorted(available)
    if unknown := sorted(set(out) - available):
        raise ValueError(f"unknown config indexes: {unknown}")
    return out


def required(df: DataFrame, key: str, wanted: list, what: str = "rows") -> DataFrame:
    """df's rows with one of the wanted keys; a key without rows is an error."""
    there = {r[0] for r in df.where(F.col(key).isin(*wanted)).select(key).distinct().collect()}  # as many as are wanted
    if missing := [w for w in wanted if w not in there]:
        raise ValueError(f"no {what} for {missing}")
    return df.where(F.col(key).isin(*wanted))


def mebibytes(c: Column) -> Column:
    return c / F.lit(1024.0 * 1024.0)


@query("select event_id, round((event_id * 1000) / 1048576.0::double, 6) as mib, round(50 / (value + 1), 6) as per_second, round((value + 1) * 1000 / 50, 6) as ms from events where value is not null")
def throughput(spark, d):
    e = table(spark, d, "events").where("value is not null")
    s = F.col("value") + 1
    return e.select("event_id", F.round(mebibytes(F.col("event_id") * 1000), 6).alias("mib"), F.round(50 / s, 6).alias("per_second"), F.round(s * 1000 / 50, 6).alias("ms"))


