"""Queries of this subpackage for __spark_entry__.py, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailforge.llm import formatting, leakage, mixing, mojibake, neardup, newtext, packing, splitting, survivors, tokens
from mailforge.session import cut, table


def p1_found(spark, d):
    return mojibake.garbled_fields(table(spark, d, "combine"))


def p1_restored(spark, d):
    return mojibake.judge(table(spark, d, "combine"))


def p2_found(spark, d):
    return survivors.survivors_long(table(spark, d, "duplicate_samples"), table(spark, d, "source_registry"))


def p2_survivors(spark, d):
    return survivors.survivors_wide(table(spark, d, "duplicate_samples"), table(spark, d, "source_registry"))


#: Days in which a vote halves in p2_weighted.
HALF_LIFE = 30.0


def p2_weighted(spark, d):
    return survivors.survivors_long(table(spark, d, "duplicate_samples"), table(spark, d, "source_registry"), HALF_LIFE)


def p3_found(spark, d):
    return neardup.near_pairs(table(spark, d, "combine"), threshold=0.5, shingle_words=3, min_words=20)


def p3_classes(spark, d):
    return neardup.near_duplicates(table(spark, d, "combine"), threshold=0.5, shingle_words=3, min_words=20)


def p4_found(spark, d):
    return mixing.mix_passes(table(spark, d, "combine"), table(spark, d, "source_registry"), table(spark, d, "mix_plan"))


def p4_drawn(spark, d):
    return mixing.draw(table(spark, d, "combine"), table(spark, d, "source_registry"), table(spark, d, "mix_plan"))


def p4_shares(spark, d):
    return mixing.shares(table(spark, d, "combine"), table(spark, d, "source_registry"), table(spark, d, "mix_plan"))


def p4_overlap(spark, d):
    """Shares in tokens of overlapping cells: each message may serve the cell of its source or that of its label."""
    messages = table(spark, d, "combine")
    size = tokens.token_counts(messages.select(F.col("message_id").alias("doc_id"), F.col("body").alias("text")), "byte_bpe_50k").toDF("message_id", "size")
    return mixing.shares(messages, table(spark, d, "source_registry"), mixing.by_source_and_by_label(table(spark, d, "mix_plan")), size=cut(size))


def p5_found(spark, d):
    return newtext.removed_lines(table(spark, d, "combine"))


def p5_new_text(spark, d):
    return newtext.new_text(table(spark, d, "combine"))


def p6_found(spark, d):
    return formatting.format_copies(table(spark, d, "combine"))


def p6_copies(spark, d):
    return formatting.copy_counts(table(spark, d, "combine"))


def p7_found(spark, d):
    return leakage.cross_split_pairs(table(spark, d, "combine"), table(spark, d, "split_rows"), threshold=0.5, shingle_words=3, min_words=20)


def p7_report(spark, d):
    return leakage.overlap_report(table(spark, d, "combine"), table(spark, d, "split_rows"), threshold=0.5, shingle_words=3, min_words=20)


def p8_ids(spark, d):
    return tokens.token_ids(table(spark, d, "documents"))


def p9_containers(spark, d):
    return packing.containers(table(spark, d, "documents"), table(spark, d, "size_limits"))


def p9_fill(spark, d):
    limits = table(spark, d, "size_limits")
    return packing.fill_report(packing.containers(table(spark, d, "documents"), limits), limits)


def p10_pieces(spark, d):
    return splitting.pieces(table(spark, d, "documents"), table(spark, d, "size_limits"))


def p10_texts(spark, d):
    return splitting.pieces(table(spark, d, "documents"), table(spark, d, "size_limits"), with_text=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = [p1_found, p1_restored, p2_found, p2_survivors, p2_weighted, p3_found, p3_classes, p4_found, p4_drawn, p4_shares, p4_overlap, p5_found, p5_new_text, p6_found, p6_copies, p7_found, p7_report, p8_ids, p9_containers, p9_fill, p10_pieces, p10_texts]
    return {f.__name__: f for f in names}


def canon(col: str) -> str:
    return rf"regexp_replace(lower(regexp_replace({col}, '^\s+|\s+$', '', 'g')), '[\s_\-]+', '_', 'g')"


SPACES = r"[\s\x0b\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WHITE = rf"^{SPACES}+|{SPACES}+$"


def squeezed(col: str) -> str:
    return rf"regexp_replace(regexp_replace(lower({col}), '{SPACES}+', ' ', 'g'), '^ | $', '', 'g')"


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": rf"""
with ranked as (
  select *, {canon("source")} as src,
         row_number() over (partition by duplicate_group_id, original_row_index order by loaded_at desc nulls last, sample_index desc nulls last) as rn
  from duplicate_samples where duplicate_group_id is not null and original_row_index is not null),
m as (
  select r.duplicate_group_id as g, r.original_row_index as row_index, r.label, r.src, coalesce(t.trust_rank, 2147483647) as trust,
         coalesce(r.loaded_at, timestamp '1900-01-01') as loaded_at,
         regexp_replace(coalesce(r.subject, ''), '^\s+|\s+$', '', 'g') as subject, length(regexp_replace(coalesce(r.body, ''), '^[\s\x{{00A0}}\x{{2000}}-\x{{200A}}\x{{3000}}]+|[\s\x{{00A0}}\x{{2000}}-\x{{200A}}\x{{3000}}]+$', '', 'g')) as chars
  from ranked r left join source_registry t on t.source = r.src where rn = 1),
o as (select *, row_number() over (partition by g order by trust, loaded_at desc, row_index) as pref from m)
select g as duplicate_group_id, 'kept_source' as field_name, arg_min(coalesce(src, chr(1)), pref) as field_value from o group by g having arg_min(coalesce(src, chr(1)), pref) <> chr(1)
union all select g, 'kept_source', null from o group by g having arg_min(coalesce(src, chr(1)), pref) = chr(1)
union all select g, 'duplicate_count', cast(count(*) as varchar) from o group by g
union all select g, 'labels', '[' || coalesce(string_agg(distinct cast(label as varchar), ', ' order by cast(label as varchar)), '') || ']' from o group by g
union all select g, 'kept_label', cast(arg_min(label, pref) as varchar) from o where label is not null group by g
union all select g, 'kept_subject_row', cast(arg_min(row_index, pref) as varchar) from o where subject <> '' and lower(subject) not in ('(no subject)', 'n/a', 'none', '-') group by g
union all select g, 'kept_body_row', cast(arg_min(row_index, struct_pack(a := -chars, b := pref)) as varchar) from o where chars > 0 group by g""",
        "p2_weighted": rf"""
with ranked as (
  select *, {canon("source")} as src,
         row_number() over (partition by duplicate_group_id, original_row_index order by loaded_at desc nulls last, sample_index desc nulls last) as rn
  from duplicate_samples where duplicate_group_id is not null and original_row_index is not null),
m as (
  select r.duplicate_group_id as g, r.original_row_index as row_index, r.label, r.src, t.trust_rank, coalesce(r.loaded_at, timestamp '1900-01-01') as loaded_at,
         regexp_replace(coalesce(r.subject, ''), '{WHITE}', '', 'g') as subject, regexp_replace(coalesce(r.body, ''), '{WHITE}', '', 'g') as body
  from ranked r left join source_registry t on t.source = r.src where rn = 1),
o as (
  select *, row_number() over (partition by g order by coalesce(trust_rank, 2147483647), loaded_at desc, row_index) as pref,
         pow(0.5, (epoch_us((select max(loaded_at) from m)) - epoch_us(loaded_at)) / 1e6 / (86400.0 * {HALF_LIFE})) / (1 + coalesce(trust_rank, 1000)) as vote from m),
offers as (
  select g, pref, vote, 'kept_source' as field_name, coalesce(src, chr(1)) as value, coalesce(src, chr(1)) as shown, 1 as quality from o
  union all select g, pref, vote, 'kept_label', cast(label as varchar), cast(label as varchar), 1 from o where label is not null
  union all select g, pref, vote, 'kept_subject_row', {squeezed("subject")}, cast(row_index as varchar), 1 from o where subject <> '' and lower(subject) not in ('(no subject)', 'n/a', 'none', '-')
  union all select g, pref, vote, 'kept_body_row', {squeezed("body")}, cast(row_index as varchar), length(body) from o where length(body) > 0),
v as (
  select g, field_name, value, round(sum(quality * vote), 9) as votes, max(quality) as quality, arg_min(shown, struct_pack(a := -quality, b := pref)) as shown, min(struct_pack(a := -quality, b := pref)) as best
  from offers group by g, field_name, value),
w as (select *, row_number() over (partition by g, field_name order by votes desc, best) as rn from v)
select g as duplicate_group_id, field_name, case when shown = chr(1) then null else shown end as field_value from w where rn = 1
union all select g, 'duplicate_count', cast(count(*) as varchar) from o group by g
union all select g, 'labels', '[' || coalesce(string_agg(distinct cast(label as varchar), ', ' order by cast(label as varchar)), '') || ']' from o group by g""",
        "p4_found": rf"""
with pool as (select {canon("source")} as src, label from combine where label is not null),
known as (select src, label, count(*) as n from pool where src in (select source from source_registry) group by 1, 2),
need as (
  select p.mix_name, p.source, p.label, p.max_repeats, coalesce(k.n, 0) as n,
         p.pool_ratio * (select sum(n) from known) * p.target_weight / sum(p.target_weight) over (partition by p.mix_name) as need
  from mix_plan p left join known k on k.src = p.source and k.label = p.label)
select mix_name, source, label, case when n = 0 then 0 else cast(least(max_repeats, ceil(need / n)) as int) end as passes,
       case when max_repeats * n < need then 1 else 0 end as capped from need""",
        "p6_found": r"""
with lines as (
  select message_id, coalesce(label, -99) as label, body, [x for x in string_split(body, chr(10)) if regexp_matches(x, '\S')] as ls from combine where body is not null),
kinds as (
  select *, len(ls) >= 2 and list_bool_and([regexp_matches(x, '^\s*\pL[^:=]{0,39}[:=]\s*\S') for x in ls]) as is_form from lines),
keyed as (
  select message_id, label, is_form, case when is_form then array_to_string(list_sort([regexp_replace(lower(x), '[^\pL\pN]+', '', 'g') for x in ls]), chr(10))
    else regexp_replace(lower(body), '[^\pL\pN]+', '', 'g') end as k from kinds),
firsts as (select *, min(message_id) over (partition by label, is_form, k) as first_id from keyed where regexp_replace(k, '\n', '', 'g') <> '')
select first_id as first_message_id, message_id as copy_message_id from firsts where message_id <> first_id""",
    }
