"""Replies of models: parsers, failure handling, trimming of word lists, prompts; over replies made from the message table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailforge.functions import labels as L
from mailforge.functions import text as X
from mailforge.plans.rules import CLEAN, strip
from mailforge.session import table

QUERIES, SQL = {}, {}

#: Forms a reply may take; the number of the message picks one.
FORMS = (
    "spam", "Ham.", "It is not spam", '{"label": "spam"}', '```json {"classification": "not spam"} ```', "<think>spam? yes</think> ham", "Answer: phishing", "YES\nham", "no", "I cannot tell",
    '<think>x</think><final>{"label": "spam"}</final>', '<THINK>x</THINK><final>{"label": "ham"}</final><|im_end|>', '<think>x</think><final>{"label": "ham", "p": 1}</final>', '<think>x</think><final>{"label": "eel"}</final>',
    '<think>x</think> spam', '<think>x</think><final>{"label": "ham"}</final> more', "legitimate mail", '{"class": "unknown"} result = scam', "label: 'ham'", '{"label": "HAM"} trailing', "valid", "", "unsolicited offer\nnot phishing", '{bad json} "label": "spam"',
)
REPLIES_SQL = "replies as (select message_id, label, case message_id % {n} {cases} end || case when message_id % 5 = 0 then chr(10) || coalesce(subject, '') else '' end as reply from combine)".format(
    n=len(FORMS), cases=" ".join(f"when {i} then '" + f.replace("'", "''") + "'" for i, f in enumerate(FORMS))
)


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def replies(spark, d) -> DataFrame:
    m = table(spark, d, "combine")
    form = F.element_at(F.array(*[F.lit(f) for f in FORMS]), (F.col("message_id") % len(FORMS) + 1).cast("int"))
    tail = F.when(F.col("message_id") % 5 == 0, F.concat(F.lit("\n"), F.coalesce("subject", F.lit("")))).otherwise("")
    return m.select("message_id", F.col("label").cast("int").alias("label"), F.concat(form, tail).alias("reply"))


LINE = r"regexp_extract({0}, '^[^\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]*')"


def words(t: str, *ws: str) -> str:
    return "(" + " or ".join(f"regexp_matches({t}, '{w}')" for w in ws) + ")"


def norm_sql(v: str) -> str:
    w = f"trim(regexp_replace(lower({v}), '[^a-z]+', ' ', 'g'))"
    return f"case when {w} in {L.SPAM} then 1 when {w} in {L.HAM} then 0 end"


def marks_sql(t: str, fences: bool, any_case: bool) -> str:
    t = f"regexp_replace({t}, '(?{'i' if any_case else ''}s)<think>.*?</think>', ' ', 'g')"
    for m in L.MARKS + (L.FENCES if fences else ()):
        t = f"replace({t}, '{m}', ' ')"
    return strip(t)


@query(f"""with {REPLIES_SQL}, c as (select message_id, {strip(LINE.format(f'lower({marks_sql("reply", False, False)})'))} as t from replies)
select message_id, case {" ".join(f"when {words('t', chr(92) + 'b' + w + chr(92) + 'b')} then {v}" for w, v in (("spam", 1), ("ham", 0), ("valid", 0), ("yes", 1), ("no", 0)))} end as parsed from c""")
def parse_strict(spark, d):
    return replies(spark, d).select("message_id", L.strict(F.col("reply")).alias("parsed"))


_first_json = "(select list_filter([" + ", ".join(f"struct_pack(l := {norm_sql(chr(106) + ' ->> ' + chr(39) + '$.' + k + chr(39))}, r := 'json.{k}')" for k in L.KEYS) + "], lambda o: o.l is not null)[1] from (select case when json_valid(x) then x else '{}' end as j) q)"


@query(f"""with {REPLIES_SQL}, c as (select message_id, {marks_sql('reply', True, True)} as t from replies), l as (select *, lower(t) as low, {strip(LINE.format('lower(t)'))} as line from c),
found as (select message_id, i, {_first_json} as o from (select message_id, unnest(regexp_extract_all(t, '(?s)\\{{.*?\\}}')) as x, generate_subscripts(regexp_extract_all(t, '(?s)\\{{.*?\\}}'), 1) as i from l)),
js as (select message_id, arg_min(o, i) as o from found where o is not null group by message_id), f as (select l.*, js.o, {norm_sql("regexp_extract(low, '" + L.FIELD.replace("'", "''") + "', 1)")} as field, line || chr(1) || low[1:400] as w from l left join js using (message_id)),
r as (select message_id, o, field, case when o is not null then o.r when field is not null then 'field' when {words('w', *L.NOT_SPAM)} then 'negative_spam_phrase' when {words('w', *L.HAM_PHRASES)} then 'ham_phrase' when {words('w', *L.SPAM_PHRASES)} then 'spam_phrase'
  when regexp_matches(line, '\\byes\\b') then 'yes' when regexp_matches(line, '\\bno\\b') then 'no' else 'unparsed' end as rule from f)
select message_id, case when o is not null then o.l when rule = 'field' then field when rule in ('negative_spam_phrase', 'ham_phrase', 'no') then 0 when rule in ('spam_phrase', 'yes') then 1 end as parsed, case when rule in ('yes', 'no') then 'yes_no' else rule end as rule from r""")
def parse_permissive(spark, d):
    label, rule = L.permissive(F.col("reply"))
    return replies(spark, d).select("message_id", label.alias("parsed"), rule.alias("rule"))


@query(f"""with {REPLIES_SQL}, c as (select message_id, {marks_sql('reply', False, False)} as t from replies), j as (select *, regexp_extract(t, '\\{{[^{{}}]*\\}}') as x, lower(regexp_extract(t, '(?i)["'']?label["'']?\\s*:\\s*["'']?(spam|ham)["'']?', 1)) as f, {strip(LINE.format('lower(t)'))} as line from c),
v as (select *, case when json_valid(x) then lower(trim(x ->> '$.label')) end as v from j)
select message_id, case when v = 'spam' then 1 when v = 'ham' then 0 when f = 'spam' then 1 when f = 'ham' then 0 when regexp_matches(line, '\\bspam\\b') then 1 when regexp_matches(line, '\\bham\\b') then 0 end as parsed from v""")
def parse_structured(spark, d):
    return replies(spark, d).select("message_id", L.structured(F.col("reply")).alias("parsed"))


@query(f"""with {REPLIES_SQL}, a as (select message_id, reply, instr(lower(reply), '</think>') as ends from replies), b as (select *, case when ends > 0 then reply[ends + 8:] else '' end as rest from a),
c as (select *, regexp_extract(rest, '(?is)<final>\\s*(\\{{.*?\\}})\\s*</final>', 1) as x, replace(replace(regexp_extract(rest, '(?is)<final>\\s*(\\{{.*?\\}})\\s*</final>(.*)$', 2), '<|im_end|>', ' '), '<|endoftext|>', ' ') as after from b),
v as (select *, case when json_valid(x) then x end as j from c), n as (select *, {norm_sql("j ->> '$.label'")} as l from v),
r as (select *, case when ends = 0 then 'missing_think_end' when x = '' then 'missing_final_block' when j is null then 'invalid_final_json' when json_keys(j) <> ['label'] then 'invalid_final_schema' when l is null then 'invalid_final_label' when {strip('after')} <> '' then 'text_after_final' else 'thinking_final_json' end as rule from n)
select message_id, case when rule = 'thinking_final_json' then l end as parsed, rule from r""")
def parse_reasoning(spark, d):
    label, rule = L.reasoning(F.col("reply"))
    return replies(spark, d).select("message_id", label.alias("parsed"), rule.alias("rule"))


@query(f"""with {REPLIES_SQL}, c as (select message_id, label, {strip(LINE.format(f'lower({marks_sql("reply", False, False)})'))} as t from replies where label in (0, 1)),
p as (select *, case {" ".join(f"when {words('t', chr(92) + 'b' + w + chr(92) + 'b')} then {v}" for w, v in (("spam", 1), ("ham", 0), ("valid", 0), ("yes", 1), ("no", 0)))} end as p from c)
select label, coalesce(p, -1) as prediction, count(*) as n, count(*) filter (coalesce(p, 0) = label) as correct_with_default, count(*) filter (p is null) as failures from p group by label, coalesce(p, -1)""")
def parse_outcomes(spark, d):
    """Counts by label and prediction, failures as -1, and how many a default of ham gets right."""
    p = replies(spark, d).where("label in (0, 1)").withColumn("p", L.strict(F.col("reply")))
    return p.groupBy("label", L.or_default(F.col("p"), -1).alias("prediction")).agg(F.count("*").alias("n"), F.count_if(L.or_default(F.col("p")) == F.col("label")).alias("correct_with_default"), F.count_if(F.col("p").isNull()).alias("failures"))


@query(f"""with {REPLIES_SQL}, c as (select source_, r.label, {strip(LINE.format(f'lower({marks_sql("reply", False, False)})'))} as t, r.message_id from replies r join (select message_id, label_ as source_ from (select message_id, case when message_id % 2 = 0 then 'even' else 'odd' end as label_ from combine)) s using (message_id))
select source_ as dataset, count(*) as n, count(*) filter (t = '') as empty from c group by source_""")
def reply_groups(spark, d):
    r = replies(spark, d).withColumn("dataset", F.when(F.col("message_id") % 2 == 0, "even").otherwise("odd"))
    line = L.first_line(F.lower(L.without_marks(F.col("reply"), any_case=False)))
    return r.groupBy("dataset").agg(F.count("*").alias("n"), F.count_if(line == "").alias("empty"))


@query(f"select message_id % {len(FORMS)} as form, rule, count(*) as n, count(*) filter (parsed = 1) as spam from ({SQL['parse_permissive']}) p group by 1, 2")
def rule_counts(spark, d):
    """How often each rule of the permissive parser decided, by the reply's form."""
    label, rule = L.permissive(F.col("reply"))
    return replies(spark, d).groupBy((F.col("message_id") % len(FORMS)).alias("form"), rule.alias("rule")).agg(F.count("*").alias("n"), F.count_if(label == 1).alias("spam"))


# word lists -----------------------------------------------------------------------------------------------------------------------------------

#: Words of a text at most, the share of the head, and the mark between head and tail with the room it needs.
BUDGET, HEAD, MARK, LEAST_ROOM = 60, 0.67, ("[...]",), 8


def head_and_tail(ids, budget: int = BUDGET, mark: tuple = MARK):
    """A list of at most budget items: all of it, or its head (67 %, rounded up), the mark and its tail; without the mark where less than
    LEAST_ROOM items are left beside it."""
    import math

    if budget <= 0:
        return F.slice(ids, 1, 0)
    room = budget - len(mark)
    inner, middle = (room, F.array(*[F.lit(m) for m in mark])) if room >= LEAST_ROOM else (budget, F.slice(ids, 1, 0))
    head = max(1, math.ceil(inner * HEAD))
    tail = max(1 if room >= LEAST_ROOM else 0, inner - head)
    end = F.slice(ids, -tail, tail) if tail else F.slice(ids, 1, 0)
    return F.when(F.size(ids) <= budget, ids).otherwise(F.concat(F.slice(ids, 1, head), middle, end))


def fit_to_budget(text: str, room: int, encode, decode, wrap=lambda t: t, mark: tuple = MARK) -> tuple[str, int, bool]:
    """(text, its items wrapped, whether it was cut): head and tail of a text that with what wraps it encode to at most room items.

    Cut text may encode to another length, so the budget shrinks by the overflow, one at least, until it fits; the wrapping alone must.
    """
    import math

    ids = list(encode(text))
    budget = min(len(ids), room - len(encode(wrap(""))))
    if budget < 0:
        raise ValueError(f"the wrapping alone takes more than {room} items")
    while True:
        inner = budget - len(mark) if budget - len(mark) >= LEAST_ROOM else budget
        head = max(1, math.ceil(inner * HEAD)) if inner else 0
        tail = inner - head
        cut_ = ids if budget >= len(ids) else [*ids[:head], *(mark if inner < budget else ()), *ids[len(ids) - tail :]]
        out = decode(cut_)
        size = len(encode(wrap(out)))
        if size <= room or budget == 0:
            return out, size, budget < len(ids)
        budget = max(0, budget - max(1, size - room))


def padded(ids, width, pad):
    """(list padded on the left to width, mask)."""
    fill = F.greatest(F.lit(0), width - F.size(ids))
    return F.concat(F.array_repeat(pad, fill), ids), F.concat(F.array_repeat(F.lit(0), fill), F.transform(ids, lambda _: F.lit(1)))


_room = BUDGET - 1
_head = -(-_room * 67 // 100)


@query(f"with {CLEAN}, w as (select message_id, string_split(body, ' ') as ws from clean) select message_id, len(ws) as raw, array_to_string(case when len(ws) <= {BUDGET} then ws else ws[1:{_head}] || ['[...]'] || ws[-{_room - _head}:] end, ' ') as trimmed, len(ws) > {BUDGET} as was_trimmed from w")
def trim_words(spark, d):
    from mailforge.plans.curation import messages

    w = messages(spark, d).select("message_id", F.split("body", " ").alias("ws"))
    return w.select("message_id", F.size("ws").cast("long").alias("raw"), F.array_join(head_and_tail(F.col("ws")), " ").alias("trimmed"), (F.size("ws") > BUDGET).alias("was_trimmed"))


@query(f"with {CLEAN}, w as (select source, len(string_split(body, ' ')) as raw from clean) select source, count(*) as n, count(*) filter (raw > {BUDGET}) as trimmed_rows, round(count(*) filter (raw > {BUDGET}) / greatest(count(*), 1)::double, 6) as trimmed_rate, max(least(raw, {BUDGET})) as max_length, round(avg(least(raw, {BUDGET})), 6) as mean_length, max(raw) as max_raw from w group by source")
def trim_statistics(spark, d):
    from mailforge.plans.curation import messages

    raw = F.size(F.split("body", " ")).cast("long")
    w = messages(spark, d).select("source", raw.alias("raw"), F.least(raw, F.lit(BUDGET)).alias("kept"))
    over = F.count_if(F.col("raw") > BUDGET)
    return w.groupBy("source").agg(F.count("*").alias("n"), over.alias("trimmed_rows"), F.round(over / F.greatest(F.count("*"), F.lit(1)), 6).alias("trimmed_rate"), F.max("kept").alias("max_length"), F.round(F.avg("kept"), 6).alias("mean_length"), F.max("raw").alias("max_raw"))


@query(f"with {CLEAN}, w as (select message_id, string_split(subject, ' ') as ws from clean), m as (select *, max(len(ws)) over (partition by message_id // 16) as width from w) select message_id, array_to_string(list_transform(range(width - len(ws)), lambda x: '<pad>') || ws, ' ') as padded, cast(width - len(ws) as bigint) as masked from m")
def left_padded(spark, d):
    """Word lists of batches of 16 ids padded to the longest of the batch."""
    from pyspark.sql import Window

    from mailforge.plans.curation import messages

    w = messages(spark, d).select("message_id", F.split("subject", " ").alias("ws"))
    w = w.withColumn("width", F.max(F.size("ws")).over(Window.partitionBy(F.expr("message_id div 16"))))
    ids, mask = padded(F.col("ws"), F.col("width"), F.lit("<pad>"))
    return w.select("message_id", F.array_join(ids, " ").alias("padded"), F.size(F.filter(mask, lambda x: x == 0)).cast("long").alias("masked"))


@query(f"""with t as (select message_id, case when s <> '' and b <> '' then 'Subject: ' || s || chr(10) || chr(10) || b when s <> '' then 'Subject: ' || s else b end as t from (select message_id, {strip('subject')} as s, {strip('body')} as b from combine) where s <> '' or b <> ''),
p as (select *, string_split(t, chr(10) || chr(10))[1] as head from t)
select message_id, case when starts_with(head, 'Subject: ') then head[10:] else '' end as subject, case when starts_with(head, 'Subject: ') then t[len(head) + 3:] else t end as body from p""")
def split_text(spark, d):
    """Composed texts taken apart again."""
    t = table(spark, d, "combine").select("message_id", X.email_text(F.col("subject"), F.col("body")).alias("t")).where("t <> ''")
    s, b = X.split_email_text(F.col("t"))
    return t.select("message_id", s.alias("subject"), b.alias("body"))


@query(f"with {CLEAN} select message_id, 'Is this e-mail spam or ham? Answer with one word, spam or ham.' || chr(10) || chr(10) || subject as prompt, case when label = 1 then 'spam' when label = 0 then 'ham' end as completion from clean")
def prompts(spark, d):
    from mailforge.plans.curation import messages

    return messages(spark, d).select("message_id", X.prompt(F.col("subject")).alias("prompt"), F.when(F.col("label") == 1, "spam").when(F.col("label") == 0, "ham").alias("completion"))


@query(f"""with f as (select doc_id, {strip("regexp_replace(string_split(text, chr(10))[1], 'Subject:', '')")} as subject, {strip("text[len(string_split(text, chr(10))[1]) + 2:]")} as body from documents where text is not null) select doc_id, subject, body from f""")
def flat_subjects(spark, d):
    """Subject and body of flat texts: the first line without its first mark, and the rest."""
    s, b = X.first_line_subject(F.col("text"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", s.alias("subject"), b.alias("body"))


@query()
def flattened_messages(spark, d):
    """Subject and body found in texts whose lines were joined (lookahead: no SQL twin)."""
    t = table(spark, d, "documents").where("text is not null").select("doc_id", F.translate("text", "\n", " ").alias("t"))
    s, b = X.flattened(F.col("t"))
    return t.select("doc_id", s.alias("subject"), b.alias("body"))


@query("""with e as (select event_id, case event_id % 7 when 0 then 'NaN'::double when 1 then 'Infinity'::double else value / 100 end as a, case event_id % 11 when 0 then '-Infinity'::double else (value * 7) % 5 end as b from events where value is not null),
s as (select *, case when isnan(a) then -1e9 else greatest(-1e9, least(1e9, a)) end as x, case when isnan(b) then -1e9 else greatest(-1e9, least(1e9, b)) end as y from e)
select event_id, round(exp(x - greatest(x, y)) / (exp(x - greatest(x, y)) + exp(y - greatest(x, y))), 6) as p_ham, not (isfinite(a) and isfinite(b)) as failed from s""")
def label_softmax(spark, d):
    inf = float("inf")
    e = table(spark, d, "events").where("value is not null")
    a = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).when(F.col("event_id") % 7 == 1, F.lit(inf)).otherwise(F.col("value") / 100)
    b = F.when(F.col("event_id") % 11 == 0, F.lit(-inf)).otherwise((F.col("value") * 7) % 5)
    p, _, failed = L.softmax(a, b)
    return e.select("event_id", F.round(p, 6).alias("p_ham"), failed.alias("failed"))
