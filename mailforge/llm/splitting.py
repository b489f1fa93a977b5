"""Problem 10: splitting oversized texts at natural boundaries.

Agglomerative merging: atomic segments are held with the boundaries between neighbours in a heap; the weakest boundary whose two
sides fit together with the overlap merges first (ties: the smaller union, then the earlier one), until nothing fits. Boundaries
rank paragraph over line, sentence, clause, word and the inside of a word. Strength comes first in the heap, so no boundary merges while a
weaker one still can: of a unit without a boundary of its ends' strength inside, all inner ones have merged, if it fits as a whole, before
its ends are looked at. Such units therefore enter the heap as one atom each, with the same pieces as from single tokens (tested).

Positions are tokens of the whole text; a piece starts ``overlap`` tokens before its own part (fewer only where that would cut a
character) and has at most max_tokens tokens.

Defined results: null, empty and fitting texts have no pieces; repeated doc_ids are split each time; overlaps of max_tokens or
more are read as max_tokens - 1; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mailforge.llm.tokens import TOKENIZERS, encode, encoding, token_lengths
from mailforge.session import spread

PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD, INSIDE, CHARACTER = 6, 5, 4, 3, 2, 1, 0


#: What a sign may be; the wide ones need no blank after them.
STOP, CLOSER, PAUSE, WIDE_STOP, WIDE_CLOSER, WIDE_PAUSE, SPACE = (1 << i for i in range(7))
#: Signs that end a sentence, close a quotation or bracket, end a clause, and blanks.
SIGNS = {STOP: ".!?…؟।۔։", CLOSER: "\"')]»”’", PAUSE: ",;:،؛–—", WIDE_STOP: "。！？．", WIDE_CLOSER: "」』）】》", WIDE_PAUSE: "、，；：", SPACE: " \n\t\r\xa0\u3000\u2002\u2003\u2009"}


@cache
def sign_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What each sign is, by its UTF-8 bytes: of one byte, of two, of three by the number of the first; and those numbers."""
    one, two, lead = np.zeros(256, np.uint8), np.zeros(1 << 16, np.uint8), np.zeros(256, np.uint8)
    raw = [(kind, c.encode("utf-8")) for kind, signs in SIGNS.items() for c in signs]
    for i, first in enumerate(sorted({r[0] for _, r in raw if len(r) == 3}), 1):
        lead[first] = i
    three = np.zeros((int(lead.max()) + 1, 1 << 16), np.uint8)
    for kind, r in raw:
        if len(r) == 1:
            one[r[0]] |= kind
        elif len(r) == 2:
            two[r[0] << 8 | r[1]] |= kind
        else:
            three[lead[r[0]], r[1] << 8 | r[2]] |= kind
    return one, two, three, lead


def strengths(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Strength of the boundary before each byte position of at (0 < at < len(data))."""
    one, two, three, lead = sign_tables()
    padded = np.concatenate([np.zeros(6, np.uint8), data, np.zeros(2, np.uint8)])
    at = at + 6

    def ending(where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(what the sign before each position is, its bytes)."""
        last = padded[where - 1]
        kind, size = one[last], np.ones(len(where), np.int64)
        high = np.flatnonzero(last >= 0x80)
        if len(high):
            w = where[high]
            b, c = padded[w - 2].astype(np.int64), padded[w - 3]
            k2, k3 = two[b << 8 | last[high]], three[lead[c], b << 8 | last[high]]
            kind[high], size[high] = np.where(k2 > 0, k2, k3), np.where(k2 > 0, 2, 3)
        return kind, size

    right, l1, l2, l3 = padded[at], padded[at - 1], padded[at - 2], padded[at - 3]
    left, size = ending(at)
    blank_right = (one[right] & SPACE) > 0
    high = np.flatnonzero(right >= 0xC0)
    if len(high):
        w = at[high]
        b, c = padded[w + 1].astype(np.int64), padded[w + 2]
        blank_right[high] = (two[right[high].astype(np.int64) << 8 | b] | three[lead[right[high]], b << 8 | c]) & SPACE > 0
    out = np.where(blank_right | ((left & SPACE) > 0) & (l1 != 13), WORD, INSIDE)
    out[((left & PAUSE) > 0) & blank_right | ((left & WIDE_PAUSE) > 0)] = CLAUSE
    stop, wide_stop = (left & STOP) > 0, (left & WIDE_STOP) > 0
    closed = np.flatnonzero(left & (CLOSER | WIDE_CLOSER))
    if len(closed):
        inner, _ = ending(at[closed] - size[closed])
        stop[closed] |= ((left[closed] & CLOSER) > 0) & ((inner & STOP) > 0)
        wide_stop[closed] |= ((left[closed] & WIDE_CLOSER) > 0) & ((inner & WIDE_STOP) > 0)
    out[stop & blank_right | wide_stop] = SENTENCE
    line = (l1 == 10) & ~blank_right
    out[line] = LINE
    out[line & ((l2 == 10) | ((l2 == 13) & (l3 == 10)))] = PARAGRAPH
    out[(right & 0xC0) == 0x80] = CHARACTER
    return out


def atoms(strength: np.ndarray, n: int, room: int) -> list[int]:
    """Starts of the largest units that fit; strength[i] is that of the boundary before token i + 1."""
    cuts, level, todo = [], PARAGRAPH, [(0, n)]
    while todo and level >= CHARACTER:
        rest = []
        for a, b in todo:
            inner = np.flatnonzero(strength[a : b - 1] >= level) + a + 1
            edges = [a, *inner.tolist(), b]
            for x, y in zip(edges, edges[1:]):
                if y - x <= room or level == CHARACTER:
                    cuts.append(x)
                else:
                    rest.append((x, y))
        todo, level = rest, level - 1
    return sorted(cuts)


def merge(strength: np.ndarray, n: int, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Token ranges (start, end) of the pieces' own parts."""
    room = limit - overlap
    start = atoms(strength, n, room)
    m = len(start)
    end, after, before, alive = [*start[1:], n], list(range(1, m + 1)), list(range(-1, m - 1)), [True] * m
    level = [-1, *strength[np.array(start[1:], np.int64) - 1].tolist()]  # of the boundary before each atom
    by_level: dict[int, list[int]] = {}
    for j in range(1, m):
        by_level.setdefault(level[j], []).append(j)
    # Sizes only grow, so what did not fit at a weaker level never will, but beside the first piece, which needs no room for an overlap; what is
    # stronger is not asked yet.
    for now in sorted(by_level):
        heap = []
        for j in by_level[now]:
            i = before[j]
            if (size := end[j] - start[i]) + (overlap if i else 0) <= limit:
                heap.append((now, size, i, j))
        heapq.heapify(heap)
        while heap:
            _, size, i, j = heapq.heappop(heap)
            if not alive[j] or before[j] != i or size != end[j] - start[i]:
                continue
            end[i], alive[j], k = end[j], False, after[j]
            after[i] = k
            if k < m:
                before[k] = i
                if (level[k] == now or not i and level[k] < now) and (size := end[k] - start[i]) + (overlap if i else 0) <= limit:
                    heapq.heappush(heap, (level[k], size, i, k))
            if level[i] == now and (size := end[i] - start[h := before[i]]) + (overlap if h else 0) <= limit:
                heapq.heappush(heap, (now, size, h, i))
    return [(start[i], end[i]) for i in range(m) if alive[i]]


def split_text(text: str, ids: list[int], lengths: np.ndarray, limits: list[tuple[int, int, int]]) -> list[tuple]:
    """(limit_id, piece_no, start_token, end_token, overlap_tokens, start_char, end_char, strength of the cut before it)."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    ends = np.cumsum(lengths[ids])
    strength = strengths(data, ends[:-1])
    chars = None
    out = []
    n = len(ids)
    for limit_id, limit, overlap in limits:
        if n <= limit:
            continue
        if chars is None:
            chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        for no, (a, b) in enumerate(merge(strength, n, limit, overlap)):
            first = max(0, a - overlap)
            while 0 < first < a and strength[first - 1] == CHARACTER:
                first += 1
            out.append((limit_id, no, first, b, a - first, int(chars[ends[first - 1] if first else 0]), int(chars[ends[b - 1]]), int(strength[a - 1]) if a else PARAGRAPH))
    return out


PIECES = "limit_id int, doc_id long, piece_no int, start_token int, end_token int, overlap_tokens int, start_char int, end_char int, boundary int"


def pieces(documents: DataFrame, limits: DataFrame, folder: str = TOKENIZERS, with_text: bool = False) -> DataFrame:
    """The pieces of all texts longer than a split limit; with_text adds each piece's text, start_char to end_char of the document."""
    rows = limits.where("purpose = 'split' and max_tokens > 0 and limit_id is not null").select("limit_id", "tokenizer_name", "max_tokens", "overlap_tokens").collect()
    wanted: dict[str, list] = {}
    for r in rows:
        wanted.setdefault(r.tokenizer_name, []).append((r.limit_id, r.max_tokens, min(max(r.overlap_tokens or 0, 0), r.max_tokens - 1)))
    fields = [("limit_id", pa.int32()), ("doc_id", pa.int64()), ("piece_no", pa.int32()), ("start_token", pa.int32()), ("end_token", pa.int32()), ("overlap_tokens", pa.int32()), ("start_char", pa.int32()), ("end_char", pa.int32()), ("boundary", pa.int32())]
    schema = PIECES + (", text string" if with_text else "")
    if with_text:
        fields.append(("text", pa.string()))

    def run(batches):
        tools = {name: (encoding(name, folder), token_lengths(name, folder)) for name in wanted}
        least = min(x[1] for v in wanted.values() for x in v)
        for b in batches:
            out = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                if text is None or len(text) * (1 if text.isascii() else 4) <= least:  # a token has a byte or more
                    continue
                for name, own in wanted.items():
                    ids = encode(text, tools[name][0])
                    if len(ids) > min(x[1] for x in own):
                        for p in split_text(text, ids, tools[name][1], own):
                            row = (p[0], doc, *p[1:])
                            out.append((*row, text[p[5] : p[6]]) if with_text else row)
            columns = list(zip(*out)) if out else [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])

    if not wanted:
        return documents.sparkSession.createDataFrame([], schema)
    return spread(documents.select("doc_id", "text")).mapInArrow(run, schema)
