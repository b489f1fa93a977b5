"""Text functions as Columns: white space, body keys, fingerprints, composition and its reverse, cleaning for line formats, prompts.

Native expressions throughout; only normal forms (texts beyond ASCII) and character references (texts with an ampersand) go to Python, in Arrow
batches, with all other rows as nulls.
"""

from __future__ import annotations

import html
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that outer stripping and collapsing know.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"
# fixed values: what the body key leaves out, in this order, and what stands for it
TAG, URL, ADDRESS, SIGNS = (r"<[^>]+>", " "), (r"(?U)(https?://\S+|www\.\S+)", " "), (r"(?U)\b[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}\b", " "), (r"[^a-z0-9]+", "")
#: Length of the body key from which the key alone tells messages apart.
LEAST_KEY = 50


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    """Without outer white space; linear in the text."""
    return F.btrim(c, F.lit(WHITE))


def collapse(c: Column) -> Column:
    """Each run of white space as one blank."""
    return F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " ")


@cache
def _each(change: str):
    """An Arrow function that changes each text that is not null; made when first used, as that takes a session."""
    f = {"normal form": lambda t: unicodedata.normalize("NFKC", t), "resolved": html.unescape}[change]

    def run(x: pd.Series) -> pd.Series:
        return x.map(f, na_action="ignore")

    return F.pandas_udf(run, "string")


def normal_form(c: Column) -> Column:
    """NFKC form."""
    return F.coalesce(_each("normal form")(F.when(F.octet_length(c) > F.length(c), c)), c)


def resolved(c: Column) -> Column:
    """Character references as the characters they stand for."""
    return F.coalesce(_each("resolved")(F.when(F.contains(c, F.lit("&")), c)), c)


def medium_key(body: Column) -> Column:
    return F.translate(text(body), WHITE, "")


def high_key(body: Column) -> Column:
    """Letters a to z and digits of a body without markup, addresses and letter case."""
    out = F.lower(resolved(normal_form(text(body))))
    for pattern, to in (TAG, URL, ADDRESS, SIGNS):
        out = F.regexp_replace(out, pattern, to)
    return out


def exact_text(subject: Column, body: Column) -> Column:
    part = lambda c: collapse(strip(F.replace(normal_form(text(c)), F.lit("\r\n"), F.lit("\n"))))
    return F.concat(part(subject), F.lit("\n\n"), part(body))


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def fingerprint(key: Column, exact_sha: Column) -> Column:
    """Of a message from its body key and the hash of its exact text, which stands in for short keys."""
    return F.when(F.length(key) < LEAST_KEY, F.concat(F.lit("subject_body:"), exact_sha)).otherwise(sha256(key))


def known_fingerprint(message_sha: Column, dedup_sha: Column, otherwise: Column) -> Column:
    """The first fingerprint there is: stored, of de-duplication, computed."""
    return F.coalesce(F.nullif(message_sha, F.lit("")), F.nullif(dedup_sha, F.lit("")), otherwise)


def stable_seed(*parts: Column | str, seed: int = 67) -> Column:
    """A 32-bit number from a seed and texts: the first eight digits of the SHA-1 of their compact JSON list."""
    quoted = [F.concat(F.lit('"'), p if isinstance(p, Column) else F.lit(p), F.lit('"')) for p in parts]
    return F.conv(F.substring(F.sha1(F.concat(F.lit("["), F.concat_ws(",", F.lit(str(seed)), *quoted), F.lit("]"))), 1, 8), 16, 10).cast("long")


def email_text(subject: Column, body: Column) -> Column:
    """Subject line and body with a blank line between; empty parts and their separator are left out."""
    s, b = strip(text(subject)), strip(text(body))
    return F.concat_ws("\n\n", F.when(s != "", F.concat(F.lit("Subject: "), s)), F.when(b != "", b))


def split_email_text(t: Column) -> tuple[Column, Column]:
    """(subject, body) of a composed text; without a subject line everything is body."""
    head = F.substring_index(t, "\n\n", 1)
    has = F.startswith(head, F.lit("Subject: "))
    return F.when(has, F.substr(head, F.lit(10))).otherwise(""), F.when(has, F.substr(t, F.length(head) + 3)).otherwise(t)


def first_line_subject(t: Column) -> tuple[Column, Column]:
    """(subject, body) of a flat text: the first line without its first ``Subject:``, and the rest."""
    line = F.substring_index(t, "\n", 1)
    at = F.instr(line, "Subject:")
    subject = F.when(at > 0, F.concat(F.substr(line, F.lit(1), at - 1), F.substr(line, at + 8))).otherwise(line)
    return strip(subject), strip(F.substr(t, F.length(line) + 2))


# fixed values: what may follow a subject in a flattened message, and after what its body begins
FLAT_SUBJECT = r"(?iU)\bSubject:\s*([^\n]*?)\s+(?=(?:Date:|MIME-Version:|Content-Type:|Content-Transfer-Encoding:|Message-Id:|X-[A-Za-z-]+:|Status:|To:|From:|Cc:|Reply-To:|$))"
FLAT_BODIES = (r"(?iU)\bContent-Transfer-Encoding:\s*[^\s]+\s+([^\n]*)\n?\z", r"(?iU)\bContent-Type:\s*[^:]+?\s+([^\n]*)\n?\z", r"(?iU)\bMIME-Version:\s*[^\s]+\s+([^\n]*)\n?\z")


def flattened(raw: Column) -> tuple[Column, Column]:
    """(subject, body) of a message whose lines were joined."""
    found = [F.nullif(strip(F.regexp_extract(raw, p, 1)), F.lit("")) for p in FLAT_BODIES]
    return strip(F.regexp_extract(raw, FLAT_SUBJECT, 1)), F.coalesce(*found, strip(raw))


def line_format(label: Column, t: Column) -> Column:
    """A training line: the label's mark, then the text on one line with no mark inside."""
    clean = F.replace(F.replace(t, F.lit("\0"), F.lit(" ")), F.lit("__label__"), F.lit("label_"))
    return F.concat(F.lit("__label__"), F.when(label == 1, "spam").otherwise("ham"), F.lit(" "), strip(collapse(clean)))


def prompt(t: Column, style: str = "plain") -> Column:
    """An instruction around a text; styles: plain, json, none."""
    ask = {"plain": "Answer with one word, spam or ham.", "json": 'Answer with {"label": "spam"} or {"label": "ham"}.'}
    return t if style == "none" else F.concat(F.lit(f"Is this e-mail spam or ham? {ask[style]}\n\n"), t)
