"""Labels read from replies of language models: clean-up, normalisation and four parsers, as native CASE chains (1 spam, 0 ham, null unread)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailforge.functions.text import strip

# fixed values: marks of reasoning and of the end of a text, words that mean a label, keys that may hold one
THINK = r"(?is)<think>.*?</think>"
MARKS, FENCES = ("<|im_end|>", "<|endoftext|>"), ("```json", "```")
SPAM = ("spam", "junk", "phishing", "scam", "malicious")
HAM = ("ham", "valid", "legitimate", "not spam", "non spam", "safe", "clean")
KEYS = ("label", "classification", "class", "result", "answer")
FIELD = r"""\b(?:label|classification|class|result|answer)\b\s*[:=\-]\s*["']?([a-z][a-z\-\s]{0,24})"""
NOT_SPAM = (r"\bnot\s+spam\b", r"\bnon[-\s]?spam\b", r"\bno\s+spam\b", r"\bnot\s+a\s+spam\b", r"\blegitimate\b", r"\bvalid\b", r"\bsafe\b", r"\bclean\b")
HAM_PHRASES = (r"\bham\b", r"\bnot\s+phishing\b", r"\bnot\s+malicious\b")
SPAM_PHRASES = (r"\bspam\b", r"\bjunk\b", r"\bphishing\b", r"\bscam\b", r"\bmalicious\b", r"\bunsolicited\b")
FINAL = r"(?is)<final>\s*(\{.*?\})\s*</final>"
#: Line ends that a first line stops at.
LINE_END = r"[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def without_marks(t: Column, fences: bool = False, any_case: bool = True) -> Column:
    """A reply without its reasoning and special marks; fences: without marks of code, too."""
    t = F.regexp_replace(t, THINK if any_case else THINK.replace("i", "", 1), " ")
    for m in MARKS + (FENCES if fences else ()):
        t = F.replace(t, F.lit(m), F.lit(" "))
    return strip(t)


def first_line(t: Column) -> Column:
    return strip(F.regexp_extract(t, rf"(?s)^(.*?)(?:{LINE_END}|$)", 1))


def normalized(value: Column) -> Column:
    """The label a value's letters spell."""
    v = F.trim(F.regexp_replace(F.lower(value), r"[^a-z]+", " "))
    return F.when(v.isin(*SPAM), 1).when(v.isin(*HAM), 0)


def has(t: Column, *patterns: str) -> Column:
    return t.rlike("(?U)" + "|".join(patterns))


def strict(t: Column) -> Column:
    """The first line of a reply: spam before ham, valid, yes and no."""
    line = first_line(F.lower(without_marks(t, any_case=False)))
    out = F
    for word, label in (("spam", 1), ("ham", 0), ("valid", 0), ("yes", 1), ("no", 0)):
        out = out.when(has(line, rf"\b{word}\b"), label)
    return out


def in_json(t: Column) -> tuple[Column, Column]:
    """(label, key) of the first object in braces that has one, by the order of KEYS."""
    def read(c):
        options = [F.struct(normalized(F.get_json_object(c, f"$.{k}")).alias("label"), F.lit(f"json.{k}").alias("rule")) for k in KEYS]
        return F.get(F.filter(F.array(*options), lambda o: o.label.isNotNull()), F.lit(0))

    found = F.get(F.filter(F.transform(F.regexp_extract_all(t, F.lit(r"(?s)(\{.*?\})"), F.lit(1)), read), lambda o: o.isNotNull()), F.lit(0))
    return found.label, found.rule


def permissive(t: Column) -> tuple[Column, Column]:
    """(label, rule) from whatever can be read: an object, a field, phrases against spam, for ham, for spam, yes or no."""
    clean = without_marks(t, fences=True)
    low = F.lower(clean)
    line = first_line(low)
    window = F.concat(line, F.lit("\1"), F.substring(low, 1, 400))
    label, rule = in_json(clean)
    field = normalized(F.regexp_extract(low, "(?U)" + FIELD, 1))
    steps = [(label.isNotNull(), label, rule), (field.isNotNull(), field, F.lit("field"))]
    for name, patterns, value in (("negative_spam_phrase", NOT_SPAM, 0), ("ham_phrase", HAM_PHRASES, 0), ("spam_phrase", SPAM_PHRASES, 1)):
        steps.append((has(window, *patterns), F.lit(value), F.lit(name)))
    steps += [(has(line, r"\byes\b"), F.lit(1), F.lit("yes_no")), (has(line, r"\bno\b"), F.lit(0), F.lit("yes_no"))]
    a, b = F, F
    for when, value, name in steps:
        a, b = a.when(when, value), b.when(when, name)
    return a, b.otherwise("unparsed")


def structured(t: Column) -> Column:
    """The label field of the first object, else a label field anywhere, else the first line."""
    clean = without_marks(t, any_case=False)
    value = F.lower(F.trim(F.get_json_object(F.nullif(F.regexp_extract(clean, r"\{[^{}]*\}", 0), F.lit("")), "$.label")))
    field = F.lower(F.regexp_extract(clean, r"""(?i)["']?label["']?\s*:\s*["']?(spam|ham)["']?""", 1))
    line = first_line(F.lower(clean))
    spam, ham = F.lit(1), F.lit(0)
    return F.when(value == "spam", spam).when(value == "ham", ham).when(field == "spam", spam).when(field == "ham", ham).when(has(line, r"\bspam\b"), spam).when(has(line, r"\bham\b"), ham)


def reasoning(t: Column) -> tuple[Column, Column]:
    """(label, rule) of a reply that must think first and then give one final object with a label and nothing after it."""
    at = F.instr(F.lower(t), "</think>")
    rest = F.substr(t, at + 8)
    block = F.regexp_extract(rest, FINAL, 1)
    keys = F.json_object_keys(block)
    label = normalized(F.get_json_object(block, "$.label"))
    after = F.regexp_extract(rest, FINAL + "(.*)$", 2)
    for m in MARKS:
        after = F.replace(after, F.lit(m), F.lit(" "))
    rule = (
        F.when(at == 0, "missing_think_end").when(block == "", "missing_final_block").when(keys.isNull(), "invalid_final_json").when((F.size(keys) != 1) | (keys[0] != "label"), "invalid_final_schema")
        .when(label.isNull(), "invalid_final_label").when(strip(after) != "", "text_after_final").otherwise("thinking_final_json")
    )
    return F.when(rule == "thinking_final_json", label), rule


def or_default(label: Column, default: int = 0) -> Column:
    """Unread replies as a default label: 0, or -1 to count them as failures."""
    return F.coalesce(label, F.lit(default))


def softmax(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """(probability of a, of b, failed) of two logits; those that are not finite fail and count within plus and minus 1e9."""
    inf = F.lit(float("inf"))
    finite = lambda x: ~F.isnan(x) & (F.abs(x) != inf)
    safe = lambda x: F.when(F.isnan(x), -1e9).otherwise(F.greatest(F.lit(-1e9), F.least(F.lit(1e9), x)))
    x, y = safe(a), safe(b)
    top = F.greatest(x, y)
    ex, ey = F.exp(x - top), F.exp(y - top)
    return ex / (ex + ey), ey / (ex + ey), ~(finite(a) & finite(b))
