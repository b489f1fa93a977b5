"""Words of many texts at once as 64-bit hashes, in numpy over code points; no Python loop over words.

Words are maximal runs of Unicode letters and numbers of the lower-cased text.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import regex

M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
U31, U29, U32 = np.uint64(31), np.uint64(29), np.uint64(32)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> U31)) * M1
    x = (x ^ (x >> U29)) * M2
    return x ^ (x >> U32)


@cache
def word_table() -> np.ndarray:
    """For each code point, whether it is a letter or number."""
    text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    table = np.zeros(0x110000, bool)
    for m in regex.finditer(r"[\p{L}\p{N}]+", text):
        a, b = m.span()
        shift = lambda i: i if i < 0xD800 else i + 0x800
        if shift(b - 1) - shift(a) == b - 1 - a:
            table[shift(a) : shift(b - 1) + 1] = True
        else:
            for i in range(a, b):
                table[shift(i)] = True
    return table


@cache
def powers() -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(1 << 12, M1 | np.uint64(1), np.uint64))


#: Characters whose arrays are held at once.
BLOCK = 1 << 20


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word in order, bounds): the words of text i are [bounds[i]:bounds[i + 1]]."""
    blocks, block, held = [], [], 0
    for t in texts:
        block.append(t)
        held += len(t)
        if held >= BLOCK:
            blocks.append(_word_hashes(block))
            block, held = [], 0
    if block or not blocks:
        blocks.append(_word_hashes(block))
    if len(blocks) == 1:
        return blocks[0]
    sizes = np.concatenate([np.diff(b) for _, b in blocks])
    return np.concatenate([h for h, _ in blocks]), np.concatenate([[0], np.cumsum(sizes)])


def _word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lowered = [t.lower() for t in texts]
    n = len(lowered)
    points = np.frombuffer("\n".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4")
    ends_of_texts = np.cumsum(np.fromiter(map(len, lowered), np.int64, n) + 1)
    inside = word_table()[points]
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    start, end = edges[::2], edges[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    size = end - start
    chars = points[inside].astype(np.uint64)
    first = np.cumsum(size) - size
    place = np.arange(len(chars)) - np.repeat(first, size)
    with np.errstate(over="ignore"):
        h = np.add.reduceat((chars + np.uint64(17)) * powers()[place & 4095] * (place.astype(np.uint64) // np.uint64(4096) * np.uint64(2) + np.uint64(1)), first)
        h = mix(h + size.astype(np.uint64) * M2)
    bounds = np.concatenate([[0], np.searchsorted(start, ends_of_texts)])
    return h, bounds


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; the last k - 1 positions have none. Grams may cross texts."""
    with np.errstate(over="ignore"):
        out = np.zeros(max(0, len(h) - k + 1), np.uint64)
        for j in range(k):
            out = out * np.uint64(0x100000001B3) + h[j : j + len(out)]
        return mix(out + np.uint64(k))


def text_of(bounds: np.ndarray, positions: int) -> np.ndarray:
    """The text of each of the first word positions."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[:positions]


def inside_text(bounds: np.ndarray, k: int) -> np.ndarray:
    """For each gram position, whether its k words belong to one text."""
    total = int(bounds[-1])
    last = np.repeat(bounds[1:], np.diff(bounds))[: max(0, total - k + 1)]
    return np.arange(len(last)) + k <= last


def distinct_by_text(text: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, value) pairs, sorted."""
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    keep = np.ones(len(text), bool)
    keep[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    return text[keep], value[keep]


def fingerprints(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each text's word sequence."""
    with np.errstate(over="ignore"):
        size = np.diff(bounds)
        place = (np.arange(len(h)) - np.repeat(bounds[:-1], size)).astype(np.uint64)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(h + mix(place * M1 + M2)))])
        return mix(sums[bounds[1:]] - sums[bounds[:-1]] + size.astype(np.uint64) * M1)
