"""The rules of curation as SQL for a second engine, written from the rules and not from the plans, to check those."""

from __future__ import annotations

import unicodedata
from functools import cache

from mailforge.functions.text import WHITE

#: Code points whose normal form the second engine spells out: Latin signs, punctuation and letter-like signs, fractions, ligatures.
SPELLED = [*range(0xA0, 0x100), *range(0x2D8, 0x2DE), *range(0x2000, 0x2150), *range(0x2150, 0x2160), *range(0xFB00, 0xFB07)]


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


WHITE_SQL = "||".join(f"chr({ord(c)})" for c in WHITE)


def strip(x: str) -> str:
    return f"trim(coalesce({x}, ''), {WHITE_SQL})"


SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def collapse(x: str) -> str:
    return f"regexp_replace({x}, '{SPACE}+', ' ', 'g')"


@cache
def normal_form(x: str) -> str:
    out = x
    for c in map(chr, SPELLED):
        if (n := unicodedata.normalize("NFKC", c)) != c:
            out = f"replace({out}, chr({ord(c)}), {quoted(n)})"
    return f"nfc_normalize({out})"


def resolved(x: str) -> str:
    for name, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\xa0"), ("&amp;", "&")):
        x = f"replace({x}, {quoted(name)}, {quoted(c)})"
    return x


def high_key(x: str) -> str:
    out = f"lower({resolved(normal_form(x))})"
    for pattern, to in ((r"<[^>]+>", " "), (rf"(https?://{SPACE.replace('[', '[^', 1)}+|www\.{SPACE.replace('[', '[^', 1)}+)", " "), (r"\b[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}\b", " "), ("[^a-z0-9]+", "")):
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    return out


def exact_text(s: str, b: str) -> str:
    part = lambda x: collapse(f"trim(replace({normal_form(x)}, chr(13)||chr(10), chr(10)), {WHITE_SQL})")
    return f"{part(s)} || chr(10) || chr(10) || {part(b)}"


def source(x: str = "source") -> str:
    return f"coalesce(nullif(regexp_replace(lower({strip(x)}), '({SPACE}|[_-])+', '_', 'g'), ''), 'unknown')"


#: Cleaned messages in their order.
CLEAN = f"""clean as (
  select *, row_number() over (order by source_rank, row_in_source, message_id) as pos from (
    select message_id, {strip('subject')} as subject, {strip('body')} as body, label, {source()} as source, coalesce(source_rank, 999) as source_rank, coalesce(row_in_source, 0) as row_in_source from combine)
  where subject <> '' or body <> '')"""
KEYED = f"{CLEAN}, keyed as (select *, {high_key('body')} as k from clean)"
GROUPS = f"{KEYED}, grouped as (select k, count(*) as n, count(distinct label) as kinds, min(pos) as first from keyed group by k having count(*) > 1)"
PRINTS = f"""{CLEAN}, hashed as (select *, {high_key('body')} as k, sha256({exact_text('subject', 'body')}) as exact_sha from clean),
prints as (select message_id, subject, body, label, source, pos, exact_sha, case when length(k) < 50 then '' else sha256(k) end as norm_sha, case when length(k) < 50 then 'subject_body:' || exact_sha else sha256(k) end as fp from hashed)"""


def hashed(seed: int | str, key: str = "message_id") -> str:
    return f"md5('{seed}|' || cast({key} as varchar))"


def ranked(rows: str, by: str, seed: int | str = 67) -> str:
    """A CTE ``ranked``: rows with their rank r in the seeded order of a stratum, its size n and the size of all."""
    return f"ranked as (select *, row_number() over ({f'partition by {by} ' if by else ''}order by {hashed(seed)}, message_id) as r, count(*) over ({f'partition by {by}' if by else ''}) as n, count(*) over () as total from {rows})"
