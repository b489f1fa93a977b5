"""Problem 1: text read in a wrong character encoding.

A smoothed character trigram model is counted over all clean tokens with letters or signs beyond ASCII (tokens that no UTF-8 chain can undo and that
hold neither replacement nor control characters). Each such token of each field is then scored under every candidate chain (encode
in the encoding it was read in, decode in the one it was written in, up to three times for UTF-8); the likeliest is accepted when its
log-likelihood beats the token's own by the margin. Chains between single-byte encodings are also scored for all tokens of a field together.
The model is counted twice, the second time without tokens that occur more often as a chain would restore them. The margin comes from held-out
clean tokens, scored by a model counted without them: the gain of each as it stands, and after garbling it by a known chain, go into two
histograms, and the margin with the least error is taken.

The model lives in hashed tables of fixed size. Each distinct token is scored once for the table; the tasks that judge fields score only the
tokens of fields with a token that may be a case, and keep the scores of a bounded number of tokens.

Defined results: null, empty and ASCII fields are no case; replacement characters and C1 controls are a case even when nothing can
be restored; repeated message_ids are judged each on its own, listed once; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from functools import cache, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailforge.session import cut, spread

#: Encodings a text may have been read in, and those it may have been written in.
READ_AS = ("cp1252", "latin-1", "cp1250", "iso8859-2", "cp437", "cp850", "cp852", "mac_roman", "cp1251", "koi8-r", "cp866", "iso8859-15", "cp1254", "iso8859-5")
WRITTEN_IN = ("cp1252", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "iso8859-5", "cp437", "cp850", "cp852", "mac_roman")
#: Blanks end a token; a no-break space does unless the sign before it may be a UTF-8 lead byte.
INSIDE = r"(?:[^ \t\r\n\u2000-\u200b\u3000\xa0]|(?<=[ÃÂĂÐÑƒ├┬√])\xa0)"
TOKEN = regex.compile(rf"{INSIDE}*(?![ \u2000-\u200b\u3000\xa0])[^\x00-\x7f]{INSIDE}*")
BROKEN = regex.compile(r"[�\x80-\x9f]")
#: Signs no message is written with: phonetic letters, combining marks, private use.
UNLIKELY = regex.compile(r"[\u0180-\u0191\u0193-\u0217\u0221-\u02c5\u02c8-\u02db\u02dd-\u036f\ue000-\uf8ff]")
RISE = regex.compile(r"\p{Ll}\p{Lu}")
T3, T2, T1, T0 = 1 << 18, 1 << 16, 1 << 13, 1 << 20
SIZE = T3 + T2 + T1 + T0
STEP, BINS = 0.5, 200
UNSEEN = 30.0
#: Parameters: one of HELD_OUT tokens chooses the margin and is not counted for that; the least margin; the gain from which a token hints at a case.
HELD_OUT, LEAST_MARGIN, HINT = 4, 4.0, 0.5
#: Cells of the bitmap of tokens that may be a case, and the distinct tokens a task keeps scores of at once.
CASES, TASK_TOKENS = 1 << 24, 1 << 18


@cache
def to_bytes(name: str) -> dict[int, int]:
    """Code points to bytes as code points; bytes the encoding leaves undefined stand for themselves."""
    table = {i: 0xFFFF for i in range(128, 256)}
    for b in range(128, 256):
        try:
            table[ord(bytes([b]).decode(name))] = b
        except UnicodeDecodeError:
            table[b] = b
    return table


@cache
def from_bytes(name: str) -> dict[int, int]:
    out = {}
    for b in range(128, 256):
        try:
            out[b] = ord(bytes([b]).decode(name))
        except UnicodeDecodeError:
            out[b] = 0xFFFD
    return out


def encodings_of(token: str) -> dict[bytes, str]:
    out: dict[bytes, str] = {}
    for name in READ_AS:
        try:
            raw = token.translate(to_bytes(name)).encode("latin-1")
        except UnicodeEncodeError:
            continue
        out.setdefault(raw, name)
    return out


#: Small letters that stand for UTF-8 lead bytes when a garbled text was put in lower case.
RAISED = {ord(c): ord(c.upper()) for c in "ãâäåđñćę"}


def utf8_readings(token: str, raise_case: bool = True) -> list[tuple[str, str]]:
    """(candidate, chain) of all ways to undo one reading of UTF-8 in another encoding."""
    out = {}
    for form, note in ((token, ""), *[(token.translate(RAISED), "raised,")] * raise_case):
        if note and form == token:
            continue
        for raw, name in encodings_of(form).items():
            try:
                text = raw.decode("utf-8")
            except UnicodeDecodeError:
                continue
            if text != token and not UNLIKELY.search(text):
                out.setdefault(text, f"{note}{name}>utf-8")
    return list(out.items())


@lru_cache(1 << 14)
def candidates(token: str) -> list[tuple[str, str]]:
    """(candidate, chain), the token itself left out."""
    out = {}
    level = [(token, "")]
    for _ in range(3):
        deeper = []
        for text, chain in level:
            for c, step in utf8_readings(text):
                if c not in out and c != token:
                    out[c] = chain + step
                    if not c.isascii():
                        deeper.append((c, chain + step + ","))
        level = deeper
    for raw, name in encodings_of(token).items():
        for to in WRITTEN_IN:
            c = raw.decode("latin-1").translate(from_bytes(to))
            if c != token and c not in out:
                out[c] = f"{name}>{to}"
    return [(c, chain) for c, chain in out.items() if not BROKEN.search(c)]


def clean(token: str) -> bool:
    return not BROKEN.search(token) and not utf8_readings(token, False)


def cells(token: str) -> list[tuple[int, int, int]]:
    t = "\x02\x02" + token.lower() + "\x03"
    return [tuple(zlib.crc32(t[j : i + 1].encode("utf-8", "replace")) & (size - 1) for j, size in ((i - 2, T3), (i - 1, T2), (i, T1))) for i in range(2, len(t))]


def whole_cells(token: str) -> list[int]:
    """Two cells of the token without case and end marks; the lesser count is the less spoilt by collisions."""
    t = token.lower().strip(".,;:!?").encode("utf-8", "replace")
    return [zlib.crc32(t) & (T0 // 2 - 1), T0 // 2 + (zlib.crc32(t, 77) & (T0 // 2 - 1))]


def count_tokens(tokens: Counter) -> np.ndarray:
    """Counts of the hashed trigrams, bigrams and characters of tokens, one after another in one table."""
    at, weight = [], []
    for token, n in tokens.items():
        for c3, c2, c1 in cells(token):
            at += (c3, T3 + c2, T3 + T2 + c1)
            weight += (n, n, n)
        for c in whole_cells(token):
            at.append(T3 + T2 + T1 + c)
            weight.append(n)
    return np.bincount(np.array(at, np.int64), np.array(weight, float), SIZE) if at else np.zeros(SIZE)


class Model:
    def __init__(self, counts: np.ndarray):
        self.c3, self.c2, self.c1, self.c0 = np.split(counts, np.cumsum([T3, T2, T1]))
        self.total = float(self.c1.sum())
        self.known: dict[str, float] = {}
        self.chars: dict[str, bool] = {}

    def _piece(self, abc: str) -> float:
        h = lambda s, size: zlib.crc32(s.encode("utf-8", "replace")) & (size - 1)
        p1 = (self.c1[h(abc[2:], T1)] + 0.05) / (self.total + 0.05 * T1)
        p2 = (self.c2[h(abc[1:], T2)] + 2 * p1) / (self.c1[h(abc[1:2], T1)] + 2) if abc[1] != "\x02" else None
        if p2 is None:
            starts = self.c2[h(abc[1:], T2)]
            return math.log((starts + 2 * p1) / (self.total / 8 + 2))
        p3 = (self.c3[h(abc, T3)] + 2 * p2) / (self.c2[h(abc[:2], T2)] + 2)
        return math.log(min(1.0, max(p3, 1e-12)))

    def score(self, token: str) -> float:
        t = "\x02\x02" + token.lower() + "\x03"
        s = 0.0
        for i in range(len(t) - 2):
            g = t[i : i + 3]
            p = self.known.get(g)
            if p is None:
                p = self.known[g] = self._piece(g)
            s += p
        return s

    def seen(self, text: str) -> bool:
        """Whether all signs of a text occur in the clean tokens."""
        for c in text:
            known = self.chars.get(c)
            if known is None:
                known = self.chars[c] = c.isascii() or self.c1[zlib.crc32(c.lower().encode("utf-8", "replace")) & (T1 - 1)] > 0
            if not known:
                return False
        return True

    def plausible(self, token: str, candidate: str) -> bool:
        """Not where the candidate alone has a capital after a small letter, nor for a single sign that occurs no less often than the candidate."""
        if RISE.search(candidate) and not RISE.search(token):
            return False
        return len(token) > 1 or self.c0[whole_cells(candidate)].min() > self.c0[whole_cells(token)].min()

    def gains(self, token: str) -> list[tuple[float, str, str]]:
        """(gain, candidate, chain) of all candidates, the likeliest first; implausible ones and those with signs never seen lose UNSEEN."""
        own = self.score(token)
        return sorted(((self.score(c) - own if (self.seen(c) or "utf-8" in chain) and self.plausible(token, c) else -UNSEEN, c, chain) for c, chain in candidates(token)), reverse=True)

    def clean(self, token: str) -> bool:
        """Whether no UTF-8 chain can undo a token, but by chance into signs that clean tokens never have."""
        return not BROKEN.search(token) and not any(self.seen(c) for c, _ in utf8_readings(token, False))

    def outdone(self, token: str, n: int) -> bool:
        """Whether a candidate occurs as a token more than twice as often as this one, which occurs n times."""
        count = lambda t: self.c0[whole_cells(t)].min()
        own = max(n, count(token))
        return any(count(c) > 2 * own for c, _ in candidates(token))

    def best(self, token: str) -> tuple[float, str, str]:
        """The likeliest candidate; gain -inf without one."""
        return max(self.gains(token), default=(-math.inf, token, ""))


def garble(token: str) -> str | None:
    """The token as one of the chains, chosen by its hash, would spoil it."""
    k = zlib.crc32(token.encode("utf-8", "replace"))
    wrong = READ_AS[k % len(READ_AS)]
    source = ("utf-8", "utf-8", "cp1250", "cp1251", "cp1252")[k // 97 % 5]
    try:
        out = token.encode(source).decode("latin-1").translate(from_bytes(wrong))
    except UnicodeEncodeError:
        return None
    return None if out == token or BROKEN.search(out) else out


def foreign(messages: DataFrame, *ids: str) -> DataFrame:
    """The fields with a sign beyond ASCII, others null; rows without such a field are left out before Python sees them."""
    m = spread(messages.select(*ids, "subject", "body")).select(*ids, *[F.when(F.octet_length(c) > F.length(c), F.col(c)).alias(c) for c in ("subject", "body")])
    return m.where("subject is not null or body is not null")


def fields(batch: pa.RecordBatch):
    for name in ("subject", "body"):
        yield name, batch.column(name).to_pylist()


#: What parts words here; a word holds whole tokens, as these signs end every token.
PARTS = str.maketrans("\t\r\n", "   ")


def words_of(text: str) -> list[str]:
    """The words of a text with a sign beyond ASCII."""
    return [w for w in text.translate(PARTS).split(" ") if not w.isascii()]


@lru_cache(1 << 14)
def tokens_in(word: str) -> tuple[str, ...]:
    return tuple(TOKEN.findall(word))


def tokens_of(batches) -> Counter:
    words: Counter = Counter()
    for b in batches:
        for _, texts in fields(b):
            for t in texts:
                if t:
                    words.update(words_of(t))
    out: Counter = Counter()
    for w, n in words.items():
        for t in tokens_in(w):
            out[t] += n
    return out


def _sparse(values: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(values)
    part = at >> 14
    keys = np.unique(part)
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.int64()), pa.array([(at[part == k] & 16383).astype(np.int32).tobytes() for k in keys], pa.binary()), pa.array([values[at[part == k]].astype(np.float64).tobytes() for k in keys], pa.binary())],
        ["part", "idx", "cnt"],
    )


def _add(df: DataFrame, size: int) -> np.ndarray:
    """Sum of the tasks' tables, whose size is fixed."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(1 << 14)
        for i, c in zip(pdf["idx"], pdf["cnt"]):
            total[np.frombuffer(i, np.int32)] += np.frombuffer(c, np.float64)
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "cnt": [total.tobytes()]})

    out = np.zeros(-(-size >> 14 << 14) + (1 << 14))
    for r in df.groupBy("part").applyInPandas(add, "part long, cnt binary").collect():
        out[r.part << 14 : (r.part + 1) << 14] = np.frombuffer(r.cnt, np.float64)
    return out[:size]


SPARSE = "part long, idx binary, cnt binary"


def distinct_tokens(messages: DataFrame) -> DataFrame:
    """(token, n) of all tokens beyond ASCII, in as many even parts as there are cores."""

    def count(batches):
        found = tokens_of(batches)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["token", "n"])

    per_task = foreign(messages).mapInArrow(count, "token string, n long")
    return per_task.groupBy("token").sum("n").toDF("token", "n").repartition(messages.sparkSession.sparkContext.defaultParallelism, "token")


def held_out(token: str) -> bool:
    """Whether a token, in any letter case, is kept for choosing the margin."""
    return zlib.crc32(token.lower().encode("utf-8", "replace")) % HELD_OUT == 0


def chosen(right: np.ndarray, wrong: np.ndarray) -> float:
    """The margin of least error: the share of right tokens at or above it plus that of garbled ones below it; the middle of equal ones."""
    error = [right[b:].sum() / max(1.0, right.sum()) + wrong[:b].sum() / max(1.0, wrong.sum()) for b in range(1, BINS)]
    even = [b for b, e in enumerate(error) if e <= min(error) + 1e-4]
    return max(LEAST_MARGIN, even[len(even) // 2] * STEP)


def train(messages: DataFrame) -> tuple[np.ndarray, float, np.ndarray]:
    """(model table, margin, bitmap of the tokens that may be a case) of a message table; each distinct token is scored once."""
    spark = messages.sparkSession
    tokens = cut(distinct_tokens(messages))
    pairs = lambda batches: ((t, n) for b in batches for t, n in zip(b.column("token").to_pylist(), b.column("n").to_pylist()))

    def count(batches):
        yield _sparse(count_tokens(Counter({t: n for t, n in pairs(batches) if clean(t)})))

    first = spark.sparkContext.broadcast(_add(tokens.mapInArrow(count, SPARSE), SIZE))

    def recount(batches):  # without the tokens that occur more often as another chain would have them; the held-out ones apart
        model, kept = Model(first.value), (Counter(), Counter())
        for t, n in pairs(batches):
            if model.clean(t) and not model.outdone(t, n):
                kept[held_out(t)][t] = n
        yield _sparse(np.concatenate([count_tokens(c) for c in kept]))

    both = _add(tokens.mapInArrow(recount, SPARSE), 2 * SIZE)
    table, unheld = both[:SIZE] + both[SIZE:], spark.sparkContext.broadcast(both[:SIZE])  # 11 MB each, whatever the corpus
    shared = spark.sparkContext.broadcast(table)

    def bin_of(gain: float) -> int:
        return min(BINS - 1, max(0, int(gain / STEP) + 1)) if gain > 0 else 0

    def validate(batches):
        model, whole, out, cases = Model(unheld.value), Model(shared.value), np.zeros(2 * BINS), np.zeros(CASES)
        for t, _ in pairs(batches):
            if BROKEN.search(t) or whole.best(t)[0] > HINT:
                cases[cell_of(t)] = 1
            if held_out(t) and whole.clean(t):
                out[bin_of(model.best(t)[0])] += 1
                if (g := garble(t)) is not None:
                    out[BINS + bin_of(model.best(g)[0])] += 1
        yield _sparse(np.concatenate([out, cases]))

    h = _add(tokens.mapInArrow(validate, SPARSE), 2 * BINS + CASES)
    return table, chosen(h[:BINS], h[BINS : 2 * BINS]), np.packbits(h[2 * BINS :] > 0)


def cell_of(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "replace"), 5) & (CASES - 1)


def judge(messages: DataFrame) -> DataFrame:
    """(message_id, field_name, text, restored, chains): fields with a garbled token; restored is the text as far as it can be undone.

    A field none of whose tokens is broken or has a candidate likelier than itself (by HINT) is no case; tokens are looked up in the bitmap for
    that, whose collisions cost time only. The others are judged on all their tokens.
    """
    table, margin, cases = train(messages)
    shared = messages.sparkSession.sparkContext.broadcast((table, cases))

    def run(batches):
        model, cases = Model(shared.value[0]), shared.value[1]
        known: dict[str, tuple[bool, list]] = {}
        suspect: dict[str, bool] = {}

        def look(token: str):
            v = known.get(token)
            if v is None:
                if len(known) >= TASK_TOKENS:
                    known.clear()
                v = known[token] = (bool(BROKEN.search(token)), model.gains(token))
            return v

        def any_suspect(words: list[str]) -> bool:
            for w in words:
                v = suspect.get(w)
                if v is None:
                    if len(suspect) >= TASK_TOKENS:
                        suspect.clear()
                    v = suspect[w] = any(cases[(c := cell_of(t)) >> 3] >> (7 - (c & 7)) & 1 for t in tokens_in(w))
                if v:
                    return True
            return False

        def whole(tokens: Counter) -> tuple[float, str]:
            """The single-byte chain that explains the field's tokens together best, with its gain."""
            total: Counter = Counter()
            if not any(gain > HINT and not chain.endswith("utf-8") for t in tokens for gain, _, chain in look(t)[1]):
                return -math.inf, ""
            for t in tokens:
                for gain, _, chain in look(t)[1]:
                    if not chain.endswith("utf-8"):
                        total[chain] += gain
            return max(((g, c) for c, g in total.items()), default=(-math.inf, ""))

        for b in batches:
            rows = []
            ids = b.column("message_id").to_pylist()
            for name, texts in fields(b):
                for i, t in zip(ids, texts):
                    if not t or not any_suspect(words := words_of(t)):
                        continue
                    tokens = Counter(x for w in words for x in tokens_in(w))
                    fixed = {}
                    bad = False
                    for x in tokens:
                        broken, options = look(x)
                        bad |= broken
                        if options and options[0][0] >= margin:
                            fixed[x] = options[0][1:]
                    gain, chain = whole(tokens)
                    if gain >= 2 * margin:
                        for x in tokens:
                            if x not in fixed or not fixed[x][1].endswith("utf-8"):
                                fixed.update({x: (c, k) for g, c, k in look(x)[1] if k == chain})
                    if fixed or bad:
                        rows.append((i, name, t, TOKEN.sub(lambda m: fixed.get(m.group(), (m.group(),))[0], t), ";".join(sorted({k for _, k in fixed.values()}))))
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = [pa.int64(), *[pa.string()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["message_id", "field_name", "text", "restored", "chains"])

    return foreign(messages.where("message_id is not null"), "message_id").mapInArrow(run, "message_id long, field_name string, text string, restored string, chains string")


def garbled_fields(messages: DataFrame) -> DataFrame:
    return judge(messages).select("message_id", "field_name").distinct()
