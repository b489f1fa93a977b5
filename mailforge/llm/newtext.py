"""Problem 5: only what the sender newly wrote.

Bodies are segmented into lines and paragraphs, and each line has features: structure (quote depth, rules, header fields, introductions, the region
after a forwarded head, and those of its neighbours), place in body and paragraph, contact density (addresses, links, digits, names), wording
(log-odds of its words and word pairs), sender frequency (how often its sender and the corpus write this line) and ancestor overlap (how many
of its words stand in six-word runs that other messages hold). Gradient-boosted trees classify the lines of each block; nothing else decides.

Frequencies and runs are counted over all bodies in one hashed table sized by their number. The trees and the log-odds are fitted on TRAIN messages
drawn by hash, whose lines have weak labels from seed rules (structure, and phrases of closings and notices, below). The rules see the sample
only: phrases are no feature, and a wording they do not know is judged by its other features. Log-odds of a half of the sample come from the
other half, so that the trees learn how much to trust them.

Defined results: null, empty and wordless bodies have no case; blank lines are never listed; lines end at line feeds and count
from 1; repeated message_ids are judged each on its own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailforge.llm.neardup import SPARSE, counts_table, sparse_counts, table_bits
from mailforge.llm.trees import Boosted
from mailforge.llm.words import fingerprints, grams, mix, word_hashes
from mailforge.session import spread

#: Messages the trees are fitted on; bits of the table of log-odds; counts from which a word has log-odds of its own.
TRAIN, ODDS_BITS, LEAST = 8000, 20, 3
I = regex.I  # noqa: E741
QUOTE = regex.compile(r"^\s*(?:[>|]|[A-Z]{1,3}>|:(?:\s|$))", I)
DEPTH = regex.compile(r"^\s*((?:[A-Z]{0,3}[>|:]\s?)+)", I)
RULE = regex.compile(r"^\s*[-_=~*#–—]{2,}\s*$")
DATE = r"(?:\p{L}{2,9},?\s+)?(?:\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{4}-\d\d-\d\d|\d{1,2}\s+\p{L}{3,9}\s+\d{4}|\p{L}{3,9}\s+\d{1,2},?\s+\d{4})"
INTRO = regex.compile(rf"(?:\b(?:wrote|writes|schrieb|a écrit|escreveu|napisał(?:\(a\))?|пишет|написал(?:\(а\)|а)?|écrit)\b[^.!?]{{0,60}}:\s*$|^\s*(?:on\s+|le\s+|am\s+|em\s+)?{DATE}(?:\s+(?:at\s+)?\d{{1,2}}:\d\d(?:\s*[ap]m)?)?,\s+\S[^.!?]{{2,60}}:\s*$)", I)
STARRED = regex.compile(rf"^\s*\*\s+\S.{{2,80}}\[[^\]]*\d[^\]]*\]:\s*$", I)
INTRO_HEAD = regex.compile(rf"^\s*(?:on|am|le|em|w dniu|в)\s+(?:\p{{L}}{{2,9}},?\s+)?{DATE}", I)
INTRO_TAIL = regex.compile(r"\b(?:wrote|writes|schrieb|écrit|escreveu|napisał(?:\(a\))?|пишет|написал(?:\(а\)|а)?)\b.{0,60}:\s*$", I)
FORWARD = regex.compile(r"^\s*(?:-{2,}\s*(?:original message|forwarded message|forwarded by\b.*|ursprüngliche nachricht|mensagem original|message d'origine|wiadomość oryginalna)\s*.*|begin forwarded message:)\s*$", I)
HEADER = regex.compile(r"^\s*(?:from|to|cc|date|sent|subject|von|an|gesendet|betreff|de|para|à|assunto|objet|od|do|data|temat|envoyé)\s*:\s", I)
HEADER_FIRST = regex.compile(r"^\s*(?:from|von|de|od)\s*:\s", I)
CLOSING = regex.compile(
    r"^\s*(?:cheers|best|thanks|many thanks|thank you|kind regards|best regards|warm regards|regards|rgds|yours truly|yours sincerely|yours faithfully|sincerely|all the best|with kind regards|"
    r"z poważaniem|pozdrawiam|viele grüße|mit freundlichen grüßen|liebe grüße|bien à vous|cordialement|atenciosamente|abraços|с уважением|всего доброго|saludos|此致)\s*[,!.]?\s*$",
    I,
)
LEGAL = regex.compile(
    r"confidentiality notice|any .{3,20} may hold \w+\b|^\W*meant only for the|\bif you are not the (?:intended|named|addressee)|without consent is (?:not permitted|prohibited|forbidden|unlawful)|accepts no liability for|think of the trees before printing|legal notice \*\*\*|the views in this .{0,40}belong to|^\W*note: .{0,40}(?:scans|monitors)|^\W*\[external\]|^\W*caution: sender|mail gateway:|^\W*they are intended for the|of the contents is (?:prohibited|forbidden|unlawful)|kindly destroy every copy|"
    r"copy received in error|to pass on \w+ material|monitors .{0,30}traffic for|is at your own risk|should (?:destroy|delete|erase|remove) suspicious|est confidentiel et r|ist vertraulich und nur|jest poufna i|конфиденциально и предназначено|confidencial e destina-se|^\W*you receive this .{0,30}under|under the terms agreed with",
    I,
)
LISTS = regex.compile(r"receiving this because you joined|mailing list\s*[-–:]\s*(?:https?:|www)|unsubscribe from .{0,60}visit|manage your .{0,40}settings|your \S+ settings:|^\W*list archive|mailing list\s*$|listinfo", I)
DEVICE = regex.compile(r"^\W*(?:sent from my \S+|get \S+ mail for your \S+|typed with thumbs|sent with \S+ mail|enviado do meu|envoyé de mon|von meinem \S+ gesendet|wysłane z)", I)
CONTACT = regex.compile(r"(?:[\w.+-]+@[\w-]+\.\w+|(?:tel|fax|ph|phone|desk|mobile|x)\.?:?\s*\+?\d[\d\s()-]+|^\s*\+\d[\d\s-]{5,}$|https?://\S+|www\.\S+)", I)
PHONE = regex.compile(r"(?:tel|fax|ph|phone|desk|mobile|\bx)\.?:?\s*\+?\d|^\s*\+?\d[\d\s()-]{5,}$", I)
NAME = regex.compile(r"^\W*\p{Lu}[\p{L}'’.-]+(?:\s+\p{Lu}[\p{L}'’.-]+){0,3}(?:\s*[,|–-]\s*\p{Lu}[\p{L}'’.&-]*(?:\s+\p{Lu}[\p{L}'’.&-]*){0,3})?\W*$")
TAG = regex.compile(r"<[^<>@]{1,60}>")
#: Kinds of line.
TEXT, BLANK, QUOTED, INTRODUCES, FORWARDS, HEAD, SEPARATES, CLOSES, NOTICE, FOOTER = range(10)


def plain(line: str) -> str:
    """A line without markup, zero-width signs and its carriage return."""
    if "<" in line:
        line = TAG.sub("", line)
    return line.replace("​", "").replace("\xa0", " ").rstrip("\r")


CUE_STARTS = frozenset(">|:-_=~*#–—")


def structure(line: str) -> int:
    """Kind of one line by its structure alone."""
    text = line.strip()
    if not text:
        return BLANK
    first, colon = text[0], ":" in text
    if (first in CUE_STARTS or ">" in text[:4]) and QUOTE.match(line):
        return QUOTED
    if first in CUE_STARTS and RULE.match(line):
        return SEPARATES
    if (first == "-" or colon and first in "bB") and FORWARD.match(line):
        return FORWARDS
    if colon and ":" in text[:12] and HEADER.match(line):
        return HEAD
    if colon and text[-1] == ":" and (INTRO.search(line) or STARRED.match(line)):
        return INTRODUCES
    return TEXT


def kind(line: str) -> int:
    """Kind of one line for the seed rules, which know phrases, too."""
    k = structure(line)
    if k in (TEXT, INTRODUCES) and CLOSING.match(line):
        return CLOSES
    if k == TEXT:
        return FOOTER if DEVICE.search(line) or LISTS.search(line) else NOTICE if LEGAL.search(line) else TEXT
    return k


class Body:
    """A body of the sample under the seed rules: its lines, their kinds and whether each has to go."""

    def __init__(self, body: str):
        self.lines = [plain(x) for x in body.split("\n")]
        k = self.kinds = [kind(x) for x in self.lines]
        n = len(k)
        dated = [i for i in range(n - 1) if k[i] in (TEXT, HEAD) and k[i + 1] in (TEXT, INTRODUCES) and self.lines[i + 1].rstrip().endswith(":")]
        for i in dated:  # an introduction over two lines
            if k[i] in (TEXT, HEAD) and k[i + 1] in (TEXT, INTRODUCES) and INTRO_HEAD.match(self.lines[i]) and INTRO_TAIL.search(self.lines[i] + " " + self.lines[i + 1]):
                k[i] = k[i + 1] = INTRODUCES
        for i in dated:  # ... or broken inside the names
            if k[i] == TEXT and k[i + 1] == TEXT and STARRED.match(self.lines[i] + " " + self.lines[i + 1]) and self.lines[i].lstrip().startswith("*"):
                k[i] = k[i + 1] = INTRODUCES
            if k[i] == TEXT and k[i + 1] == INTRODUCES and not INTRO.search(self.lines[i]) and INTRO_HEAD.match(self.lines[i]):
                k[i] = INTRODUCES
        gone = [False] * n
        role = list(k)
        i = 0
        while i < n:
            nxt = next((j for j in range(i + 1, n) if k[j] != BLANK), n)
            heads = sum(k[j] == HEAD for j in range(i, min(n, i + 6)))
            if k[i] == FORWARDS or (k[i] == SEPARATES and nxt < n and k[nxt] == HEAD and HEADER_FIRST.match(self.lines[nxt])) or (k[i] == HEAD and HEADER_FIRST.match(self.lines[i]) and heads >= 3 and i):
                for j in range(i, n):
                    gone[j], role[j] = True, FORWARDS
                break
            if k[i] == QUOTED:
                gone[i] = True
            elif k[i] == INTRODUCES:
                gone[i] = True
            elif k[i] in (NOTICE, FOOTER):
                gone[i] = True
                if k[i] == NOTICE:
                    j = i + 1
                    while j < n and k[j] in (TEXT, NOTICE):
                        gone[j], role[j] = True, NOTICE
                        j += 1
                j = i - 1
                if j >= 0 and k[j] == SEPARATES:
                    gone[j] = True
            elif k[i] == CLOSES or (k[i] == SEPARATES and i + 1 < n and k[i + 1] in (TEXT, CLOSES) and len(self.lines[i + 1]) < 60):
                short = 0
                j = i + 1
                while j < n and short < 6 and k[j] in (TEXT, CLOSES) and len(self.lines[j]) < 60 and (NAME.match(self.lines[j]) or CONTACT.search(self.lines[j]) or (k[i] == SEPARATES or short) and not regex.search(r"[.!?]\s*$", self.lines[j]) and len(self.lines[j].split()) <= 6):
                    short += 1
                    j += 1
                if k[i] == CLOSES or short:
                    for m in range(i, j):
                        gone[m], role[m] = True, CLOSES
                    i = j - 1
            i += 1
        self.gone = gone


class Lines:
    """The non-blank lines of bodies, with what their text and structure say; arrays over all lines, no loop over words."""

    def __init__(self, bodies: list[str], senders: list[str | None]):
        texts, kinds, owner, number, para, forwarded = [], [], [], [], [], []
        paragraph = 0
        for i, body in enumerate(bodies):
            lines = [plain(x) for x in body.split("\n")]
            ks = [structure(x) for x in lines]
            start = len(lines)
            if FORWARDS in ks:
                start = ks.index(FORWARDS)
            if HEAD in ks:  # a head of three fields or more that does not open the body
                for j in range(1, min(start, len(lines))):
                    if ks[j] == HEAD and HEADER_FIRST.match(lines[j]) and ks[j : j + 6].count(HEAD) >= 3:
                        start = j
                        break
            paragraph += 1
            for j, (x, k) in enumerate(zip(lines, ks)):
                if k == BLANK:
                    paragraph += 1
                    continue
                texts.append(x)
                kinds.append(k)
                owner.append(i)
                number.append(j)
                para.append(paragraph)
                forwarded.append(j >= start)
        self.texts, self.owner, self.number = texts, np.array(owner, np.int64), np.array(number, np.int64)
        self.kind, self.para, self.forwarded = np.array(kinds, np.int64), np.array(para, np.int64), np.array(forwarded, bool)
        self.h, self.bounds = word_hashes(texts)
        self.sender = np.array([zlib.crc32((x or "").encode("utf-8", "replace")) for x in senders], np.uint64)
        self.size = np.diff(self.bounds)
        self.line = np.repeat(np.arange(len(texts)), self.size)  # of each word

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(corpus key, sender key of each line; six-word runs, whether each lies in one body)."""
        own = fingerprints(self.h, self.bounds)
        runs = grams(self.h, 6)
        body = self.owner[self.line]
        inside = body[: len(runs)] == body[5 : 5 + len(runs)] if len(runs) else np.zeros(0, bool)
        return mix(own + np.uint64(1)), mix(own + mix(self.sender[self.owner] + np.uint64(2))), mix(runs + np.uint64(3)), inside

    def wording(self) -> tuple[np.ndarray, np.ndarray]:
        """(cell of each word and word pair, its line): pairs stay inside a line."""
        pair = grams(self.h, 2)
        inside = self.line[: len(pair)] == self.line[1 : 1 + len(pair)]
        shift = np.uint64(64 - ODDS_BITS)
        cells = np.concatenate([mix(self.h) >> shift, mix(pair[inside] + np.uint64(5)) >> shift]).astype(np.int64)
        return cells, np.concatenate([self.line, self.line[: len(pair)][inside]])


def mean_of(value: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    return np.bincount(group, value, groups) / np.maximum(1, np.bincount(group, minlength=groups))


def log_odds(cells: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Smoothed log-odds of each cell for going; cells met less than LEAST times say nothing."""
    a, n = np.bincount(cells[gone], minlength=1 << ODDS_BITS), np.bincount(cells, minlength=1 << ODDS_BITS)
    prior = (a.sum() + 1) / (n.sum() + 2)
    p = (a + 2 * prior) / (n + 2)
    return np.where(n >= LEAST, np.log(p / (1 - p)) - np.log(prior / (1 - prior)), 0.0).astype(np.float32)


def features(x: Lines, level: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """One row for each line. odds: one table, or one for each line's half of the sample, (2, cells) with x.half."""
    m = len(x.texts)
    if not m:
        return np.zeros((0, 1))
    shift = np.uint64(65 - len(level).bit_length())
    corpus, sender, runs, inside = x.keys()
    seen = np.zeros(len(x.h))
    met = np.flatnonzero(inside & (level[(runs >> shift).astype(np.int64)] > 10))
    for j in range(6):
        seen[met + j] = 1
    cells, of = x.wording()
    w = odds[cells] if odds.ndim == 1 else odds[x.half[x.owner[of]], cells]
    word_mean = mean_of(w, of, m)
    word_max, word_min = np.zeros(m), np.zeros(m)
    np.maximum.at(word_max, of, w)
    np.minimum.at(word_min, of, w)
    known = mean_of((w != 0).astype(float), of, m)
    ancestor = mean_of(seen, x.line, m)

    length = np.array([len(t) for t in x.texts], float)
    stripped = [t.strip() for t in x.texts]
    last = np.array([".!?,:".find(t[-1]) for t in stripped])
    signs = np.array([t.count("@") + t.count("://") + t.count("www.") for t in x.texts], float)
    digits = np.array([sum(c.isdigit() for c in t) if len(t) < 60 else -1 for t in stripped], float)
    titled = np.array([sum(v[0].isupper() for v in t.split()) / (t.count(" ") + 1) if len(t) < 60 else -1 for t in stripped])
    depth = np.array([sum(d.group(1).count(c) for c in ">|:") if k == QUOTED and (d := DEPTH.match(t)) else 0 for t, k in zip(x.texts, x.kind.tolist())], float)
    letters = np.array([t[0].isalnum() for t in stripped], float)

    first = np.searchsorted(x.owner, np.arange(len(x.sender)))
    lines = np.bincount(x.owner, minlength=len(x.sender))
    at = np.arange(m) - first[x.owner]
    left = lines[x.owner] - at
    para_id, para = np.unique(x.para, return_inverse=True)
    para_first, para_size = np.searchsorted(x.para, para_id), np.bincount(para)
    in_para = np.arange(m) - para_first[para]
    para_of_body = para - para[first[x.owner]]
    last_line = first[x.owner] + lines[x.owner] - 1
    para_left = para[last_line] - para
    para_words = np.bincount(para, word_mean * x.size) / np.maximum(1, np.bincount(para, x.size))
    para_words = para_words[para]

    def near(value: np.ndarray, step: int, none: float) -> np.ndarray:
        out = np.full(m, none)
        if step > 0:
            ok = x.owner[step:] == x.owner[:-step]
            out[:-step][ok] = value[step:][ok]
        else:
            ok = x.owner[-step:] == x.owner[:step]
            out[-step:][ok] = value[:step][ok]
        return out

    blank_before, blank_after = in_para == 0, in_para == para_size[para] - 1
    separates = np.where(x.kind == SEPARATES, np.arange(m), -1)
    since = np.arange(m) - np.maximum.accumulate(np.where(separates >= 0, separates, 0))
    since = np.where(np.maximum.accumulate(separates) >= first[x.owner], since, 99)
    contact = (signs > 0) | (digits >= 4)
    short = length < 60
    run = (short & letters.astype(bool)).astype(float)
    tail = near(run, 1, 0) + near(run, 1, 0) * near(run, 2, 0) + near(run, 1, 0) * near(run, 2, 0) * near(run, 3, 0)
    columns = [
        at, left, at / (at + left), para_of_body, para_left, in_para, para_size[para], length, x.size, blank_before, blank_after, last == 0, last == 1, last == 3, last == 4, letters,
        signs, digits, titled, depth, signs / (x.size + 1), x.forwarded, since, tail,
        word_mean, word_max, word_min, known, para_words, word_mean[para_first[para]],
        level[(corpus >> shift).astype(np.int64)], level[(sender >> shift).astype(np.int64)], ancestor, np.bincount(para, ancestor)[para] / para_size[para],
        *[x.kind == k for k in (QUOTED, SEPARATES, HEAD, FORWARDS, INTRODUCES)],
    ]
    for step in (-3, -2, -1, 1, 2, 3):
        columns += [near(x.kind.astype(float), step, -1), near(word_mean, step, 0), near(contact.astype(float), step, -1), near(length, step, -1), near(titled, step, -1)]
    for step in (-1, 1):
        columns += [near(para_words, step, 0), near(level[(corpus >> shift).astype(np.int64)].astype(float), step, -1), near(x.size.astype(float), step, -1)]
    return np.column_stack([np.asarray(c, np.float32) for c in columns])


def fit(bodies: list[str], senders: list[str | None], level: np.ndarray) -> tuple[np.ndarray, Boosted | None]:
    """(table of log-odds, trees) from a sample under the seed rules."""
    x = Lines(bodies, senders)
    gone = [Body(b).gone for b in bodies]
    y = np.array([gone[o][n] for o, n in zip(x.owner.tolist(), x.number.tolist())], bool)
    if not len(y):
        return np.zeros(1 << ODDS_BITS, np.float32), None
    cells, of = x.wording()
    x.half = np.arange(len(bodies)) % 2
    half = x.half[x.owner[of]]
    crossed = np.stack([log_odds(cells[half != k], y[of][half != k]) for k in (0, 1)])
    model = Boosted(rounds=45, depth=5, rate=0.3, bins=40).fit(features(x, level, crossed), y.astype(float))
    return log_odds(cells, y[of]), model


def removed_lines(messages: DataFrame, train: int = TRAIN) -> DataFrame:
    """(message_id, line_no) of the lines that go."""
    spark = messages.sparkSession
    m = spread(messages.select("message_id", "sender", "body").where("message_id is not null and body is not null and body <> ''"))
    bits = table_bits(m.count())

    def count(batches):
        found = []
        for b in batches:
            corpus, sender, runs, inside = Lines(b.column("body").to_pylist(), b.column("sender").to_pylist()).keys()
            found += [corpus, sender, runs[inside]]
        yield sparse_counts(found, bits)

    table = counts_table(m.mapInArrow(count, SPARSE), bits)  # 2**bits bytes, 64 MB at most
    h = F.xxhash64("message_id")
    last = m.select(h.alias("h")).orderBy("h").limit(train).agg(F.max("h")).first()[0]  # hashes alone reach the driver here
    sample = m.where(h <= F.lit(last)).select("body", "sender").limit(2 * train).collect() if last is not None else []  # repeated ids may add some
    shared = spark.sparkContext.broadcast((table, *fit([r.body for r in sample], [r.sender for r in sample], table)))

    def judge(batches):
        level, odds, model = shared.value
        for b in batches:
            ids, bodies = b.column("message_id").to_numpy(zero_copy_only=False), b.column("body").to_pylist()
            x = Lines(bodies, b.column("sender").to_pylist())
            go = model.predict(features(x, level, odds)) >= 0.5 if model is not None and len(x.texts) else np.zeros(len(x.texts), bool)
            worded = np.zeros(len(bodies), bool)
            worded[x.owner[x.size > 0]] = True
            at = np.flatnonzero(go & worded[x.owner])
            yield pa.RecordBatch.from_arrays([pa.array(ids[x.owner[at]], pa.int64()), pa.array((x.number[at] + 1).astype(np.int32))], ["message_id", "line_no"])

    return m.mapInArrow(judge, "message_id long, line_no int")


def new_text(messages: DataFrame) -> DataFrame:
    """(message_id, body): each body without the removed lines, blank ends stripped."""
    gone = removed_lines(messages).groupBy("message_id").agg(F.collect_set("line_no").alias("gone"))  # lines of one body
    lines = F.split("body", "\n")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.coalesce(F.array_contains("gone", i + 1), F.lit(False))), "\n")
    return messages.select("message_id", "body").where("message_id is not null and body is not null").join(gone, "message_id", "left").select("message_id", F.regexp_replace(kept, r"(?U)^\s+|\s+$", "").alias("body"))
