"""Problem 3: near-duplicates with small edits, insertions or moved passages.

1. Every text's words become hashes; equal word sequences are one node from here on (a 64-bit fingerprint), so copies never pair. The shingles of
   all texts are counted in a hashed table of fixed size.
2. A text keeps the first n - ceil(t * n) + 1 of its n distinct shingles, rarest first. Two texts of similarity t share at least t times the
   larger one's shingles, so their first common shingle in this order is kept by both (any order common to all texts will do, so hash collisions in
   the counts cost time, never links). Shingles counted once cannot meet and are dropped.
3. Tiles: texts meeting in a shingle are compared when their sizes lie in the same band. Their places in the order bound the overlap: of a run sorted
   by size, only the stretch that the smaller text's place allows is listed. Then parity bitmaps of 128 to 4,096 bits do: the bits in which two
   bitmaps differ are at most the shingles the texts do not share. They are wide enough that texts without much in common hardly pass, as
   such links grow with the square of the texts and would join all of them to one component. A tile's links leave it as stars. A shingle kept by more than RUN texts is dealt to sub-tiles, one for each two blocks of its texts, so no task compares more than
   2 * RUN texts in one shingle.
4. Components of these links are tiles again: their shingle sets come together once per distinct text, are compared by size band, bitmap and exact
   sorted-array intersection, and give the classes. Components of more than TILE texts are dealt to sub-tiles by size band and two blocks.

Defined results: null subjects and bodies are empty; texts under min_words words have no class, even when equal; repeated
message_ids are one member; ties in size or hash do not matter; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailforge.llm.components import components
from mailforge.llm.words import distinct_by_text, fingerprints, grams, inside_text, mix, text_of, word_hashes
from mailforge.session import cut, spread

#: Texts of one shingle and of one component, from which they are dealt to sub-tiles.
RUN, TILE = 2048, 8192
#: Texts that may lie in one part of the shingles, and the kept shingles of a text by which the parts are reckoned.
PART, KEPT = 600_000, 45
#: Bitmap widths in 64-bit words, and the distinct shingles up to which each but the last is used.
WIDTHS, STEPS = (2, 4, 8, 16, 32, 64), (40, 96, 208, 448, 1024)
#: Steps of the scale of counts for each doubling; the level of a count of one.
SCALE = 8
ONE = SCALE


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def signed_bytes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


class Texts:
    """Hashed words of a batch's subjects, if it has them, and bodies, without the texts under min_words words."""

    def __init__(self, batch: pa.RecordBatch, min_words: int):
        b = batch.column("body").to_pylist()
        s = batch.column("subject").to_pylist() if "subject" in batch.schema.names else [""] * len(b)
        h, bounds = word_hashes([f"{x or ''} {y or ''}" for x, y in zip(s, b)])
        keep = np.diff(bounds) >= min_words
        self.id = batch.column("message_id").to_numpy(zero_copy_only=False)[keep]
        self.h = h[np.repeat(keep, np.diff(bounds))]
        self.bounds = np.concatenate([[0], np.cumsum(np.diff(bounds)[keep])])
        self.fp = signed(fingerprints(self.h, self.bounds))

    def only(self, keep: np.ndarray) -> None:
        self.h = self.h[np.repeat(keep, np.diff(self.bounds))]
        self.bounds = np.concatenate([[0], np.cumsum(np.diff(self.bounds)[keep])])
        self.id, self.fp = self.id[keep], self.fp[keep]

    def unseen(self, seen: set) -> None:
        """Keep the first text of each fingerprint this task meets."""
        keep = np.zeros(len(self.fp), bool)
        for i, f in enumerate(self.fp.tolist()):
            if f not in seen:
                seen.add(f)
                keep[i] = True
        self.only(keep)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        ok = inside_text(self.bounds, k)
        return distinct_by_text(text_of(self.bounds, len(ok))[ok], grams(self.h, k)[ok])


def bitmaps(text: np.ndarray, shingle: np.ndarray, n: int, words: int) -> np.ndarray:
    """Parity bitmaps of n texts: each shingle flips one of 64 * words bits (a power of two, so that wide ones fold to narrow ones)."""
    bit = (shingle >> np.uint64(24)) & np.uint64(64 * words - 1)
    flips = np.bincount(text * (64 * words) + bit.astype(np.int64), minlength=n * 64 * words) & 1
    return np.packbits(flips.astype(np.uint8).reshape(n, -1), axis=1, bitorder="little").view(np.uint64)


class Bitmaps:
    """The bitmaps of texts, each in the width its size n asks for: rows[c] holds those of kind c, at[i] is text i's row there."""

    def __init__(self, n: np.ndarray, rows: list[np.ndarray]):
        self.n, self.rows = n, rows
        self.kind = np.searchsorted(STEPS, n)
        self.at = np.zeros(len(n), np.int64)
        for c in range(len(WIDTHS)):
            own = np.flatnonzero(self.kind == c)
            self.at[own] = np.arange(len(own))
        self.levels: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @classmethod
    def of(cls, text: np.ndarray, shingle: np.ndarray, n: np.ndarray) -> Bitmaps:
        kind, rows = np.searchsorted(STEPS, n), []
        for c, words in enumerate(WIDTHS):
            own, out = np.flatnonzero(kind == c), [np.zeros((0, words), np.uint64)]
            for block in np.array_split(own, len(own) * words // 20_000 + 1):
                if len(block):
                    place = np.full(len(n), -1)
                    place[block] = np.arange(len(block))
                    sel = place[text] >= 0
                    out.append(bitmaps(place[text[sel]], shingle[sel], len(block), words))
            rows.append(np.concatenate(out))
        return cls(n, rows)

    def take(self, texts: np.ndarray) -> Bitmaps:
        return Bitmaps(self.n[texts], [r[self.at[texts[self.kind[texts] == c]]] for c, r in enumerate(self.rows)])

    def level(self, c: int) -> tuple[np.ndarray, np.ndarray]:
        """(row of each text, rows) of the bitmaps of kind c and of wider ones folded to c."""
        if c not in self.levels:
            index, parts, base = np.zeros(len(self.n), np.int64), [], 0
            for wide in range(c, len(WIDTHS)):
                own = np.flatnonzero(self.kind == wide)
                index[own] = base + np.arange(len(own))
                base += len(own)
                parts.append(np.bitwise_xor.reduce(self.rows[wide].reshape(len(own), WIDTHS[wide] // WIDTHS[c], WIDTHS[c]), axis=1))
            self.levels[c] = index, np.concatenate(parts)
        return self.levels[c]

    def near(self, i: np.ndarray, other: Bitmaps, j: np.ndarray, t: float) -> np.ndarray:
        """Of the pairs (i here, j in other), those that sizes and bitmaps allow to have similarity t."""
        n1, n2 = self.n[i], other.n[j]
        ok = np.minimum(n1, n2) >= t * np.maximum(n1, n2) - 1e-9
        kind = np.minimum(self.kind[i], other.kind[j])
        for c in range(len(WIDTHS)):
            at = np.flatnonzero(ok & (kind == c))
            if not len(at):
                continue
            (x, left), (y, right) = self.level(c), other.level(c)
            for part in np.array_split(at, len(at) * WIDTHS[c] // 500_000 + 1):
                most = (n1[part] + n2[part]) * ((1 - t) / (1 + t)) + 1e-9
                ok[part] = np.bitwise_count(left[x[i[part]]] ^ right[y[j[part]]]).sum(-1) <= most
        return ok


def source(messages: DataFrame) -> DataFrame:
    return spread(messages.select("message_id", "subject", "body").where("message_id is not null"))


def counts_table(keys: DataFrame, bits: int) -> np.ndarray:
    """Counts of the column ``keys`` (top bits of 64-bit hashes, as binary batches of uint32) in a table of 2**bits cells, on a logarithmic
    scale of one byte: 0 none, ONE exactly one. Its size depends on bits alone."""
    low = min(bits, 16)

    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(1 << low, np.int64)
        for i, c in zip(pdf["idx"], pdf["cnt"]):
            total[np.frombuffer(i, np.uint16)] += np.frombuffer(c, np.uint32)
        level = np.minimum(255, np.round(SCALE * np.log2(total + 1.0))).astype(np.uint8)
        return pd.DataFrame({"segment": [int(pdf["segment"].iloc[0])], "level": [level.tobytes()]})

    rows = keys.groupBy("segment").applyInPandas(reduce, "segment int, level binary").collect()
    out = np.zeros(1 << bits, np.uint8)
    for r in rows:
        out[r.segment << low : (r.segment + 1) << low] = np.frombuffer(r.level, np.uint8)
    return out


def sparse_counts(hashes: list[np.ndarray], bits: int) -> pa.RecordBatch:
    """What one task adds to the table, without its zeros."""
    low = min(bits, 16)
    cell, n = np.unique(np.concatenate(hashes) >> np.uint64(64 - bits), return_counts=True) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    segment = (cell >> np.uint64(low)).astype(np.int64)
    at = np.flatnonzero(np.diff(segment, prepend=-1))
    parts = list(zip(at, np.append(at[1:], len(segment))))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([int(segment[a]) for a, _ in parts], pa.int32()),
            pa.array([(cell[a:b] & np.uint64((1 << low) - 1)).astype(np.uint16).tobytes() for a, b in parts], pa.binary()),
            pa.array([n[a:b].astype(np.uint32).tobytes() for a, b in parts], pa.binary()),
        ],
        ["segment", "idx", "cnt"],
    )


SPARSE = "segment int, idx binary, cnt binary"


def table_bits(n: int) -> int:
    """Cells for the shingles of n texts, within 2**20 and 2**26."""
    return max(20, min(26, math.ceil(math.log2(32 * max(1, n)))))


def union(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """root (each node's least node so far) after the links (a, b)."""
    while True:
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            return root
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(root, higher := root[root]):
            root = higher


#: Pairs listed at once.
PAIRS = 500_000


def stretches(first: np.ndarray, size: np.ndarray):
    """(i, j) in blocks: each i with the size[i] places from first[i] on."""
    for block in blocks_of(size, PAIRS):
        n = size[block]
        yield np.repeat(block, n), np.repeat(first[block] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def most_size(n: np.ndarray, rest: np.ndarray, t: float) -> np.ndarray:
    """The largest size of a text that may have similarity t to one of size n with rest shingles still to come."""
    return np.floor(np.minimum(n / t, rest * ((1 + t) / t) - n) + 1e-6).astype(np.int64)


def links_of_runs(key: np.ndarray, text: np.ndarray, place: np.ndarray, maps: Bitmaps, t: float) -> np.ndarray:
    """root of each text after linking the texts of equal keys (rows sorted by key, then size) that places, sizes and bitmaps allow to be similar.

    At their first common key both texts have all common ones still to come. place counts in 256ths of a text, rounded down.
    """
    n = maps.n[text]
    rest = n - (place.astype(np.int64) * n >> 8)
    root = np.arange(len(maps.n))
    run = np.cumsum(np.diff(key, prepend=key[:1]) != 0) << 32
    end = np.searchsorted(run + n, run + np.maximum(0, most_size(n, rest, t)), "right")
    first = np.arange(1, len(key) + 1)
    for i, j in stretches(first, np.maximum(0, end - first)):
        a, b = text[i], text[j]
        ok = (rest[j] >= (n[i] + n[j]) * (t / (1 + t)) - 1e-9) & (root[a] != root[b])
        a, b = a[ok], b[ok]
        ok = maps.near(a, maps, b, t)
        if ok.any():
            root = union(root, a[ok], b[ok])
    return root


def by_runs(batches, column: str):
    """Concatenate Arrow batches of a partition sorted by column so that no run is cut, in blocks of about 200,000 rows."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows >= 200_000:
            whole = pa.Table.from_batches(held).combine_chunks()
            keys = whole.column(column).to_numpy()
            cut_at = int(np.searchsorted(keys, keys[-1])) if keys[0] <= keys[-1] else 0
            if cut_at:
                yield whole.slice(0, cut_at)
                held = whole.slice(cut_at).to_batches()
                rows = whole.num_rows - cut_at
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def prefixes(text: np.ndarray, shingle: np.ndarray, n: np.ndarray, level: np.ndarray, t: float) -> tuple[np.ndarray, ...]:
    """(text, shingle, place, level) of the shingles, rarest first, of which two texts of similarity t share one, without those counted once."""
    order = np.lexsort((shingle, level, text))
    text, shingle, level = text[order], shingle[order], level[order]
    place = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    keep = (place <= (n - np.ceil(t * n - 1e-9).astype(np.int64))[text]) & (level > ONE)
    return text[keep], shingle[keep], place[keep] * 256 // n[text[keep]], level[keep]


def sub_tiles(text: np.ndarray, key: np.ndarray, place: np.ndarray, level: np.ndarray, fp: np.ndarray, run: int) -> tuple[np.ndarray, ...]:
    """(text, key, place) with each key of more than run texts dealt to one key for each two blocks of its texts."""
    blocks = np.ceil((2.0 ** ((level + 0.5) / SCALE) - 1) / run).astype(np.int64)
    many = np.flatnonzero(blocks > 1)
    if not len(many):
        return text, key, place
    at = np.repeat(many, blocks[many])
    other = np.arange(len(at)) - np.repeat(np.cumsum(blocks[many]) - blocks[many], blocks[many])
    own = (mix(fp[text[at]].view(np.uint64)) % blocks[at].astype(np.uint64)).astype(np.int64)
    low, high = np.minimum(own, other).astype(np.uint64), np.maximum(own, other).astype(np.uint64)
    dealt = mix(key[at] + mix(low * np.uint64(1 << 32) + high + np.uint64(1)))
    rest = np.flatnonzero(blocks <= 1)
    return np.concatenate([text[rest], text[at]]), np.concatenate([key[rest], dealt]), np.concatenate([place[rest], place[at]])


def slices(batches, rows: int = 10_000):
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def parts_of(texts: int, cores: int) -> int:
    """Parts of the shingles, of which none has more than about PART of the texts: a text lies in as many parts as it has kept shingles, while there are
    that many."""
    share = min(1.0, PART / max(1, texts))
    return cores if share == 1 else max(cores, math.ceil(1 / (1 - (1 - share) ** (1 / KEPT))))


def part_rows(fp: np.ndarray, n: np.ndarray, maps: Bitmaps, text: np.ndarray, key: np.ndarray, place: np.ndarray, parts: int) -> list[tuple]:
    """A row of PARTS for each part of the shingles, with the texts that have keys there, their bitmaps, and the keys."""
    part = (key % np.uint64(parts)).astype(np.int64)
    short = (mix(key) >> np.uint64(32)).astype(np.uint32)  # keys of one part; chance equality costs time only
    order = np.lexsort((maps.kind[text], part))
    text, part, short, place = text[order], part[order], short[order], place[order].astype(np.uint8)
    edges, out = np.searchsorted(part, np.arange(parts + 1)), []
    for p in np.flatnonzero(np.diff(edges)).tolist():
        own = slice(edges[p], edges[p + 1])
        there = np.unique(text[own])
        there = there[np.argsort(maps.kind[there], kind="stable")]
        index = np.zeros(len(n), np.uint16)
        index[there] = np.arange(len(there))
        bm = b"".join(signed_bytes(r) for r in maps.take(there).rows)
        out.append((p, signed_bytes(fp[there]), signed_bytes(n[there].astype(np.int32)), bm, signed_bytes(short[own]), signed_bytes(index[text[own]]), signed_bytes(place[own])))
    return out


def id_row(number: int, x: Texts, parts: int) -> tuple:
    """A row of PARTS with ids (as keys) and fingerprints."""
    return ((number + int(x.fp[0])) % parts, signed_bytes(x.fp), None, None, signed_bytes(x.id.astype(np.int64)), None, None)


PARTS = "part int, fp binary, n binary, bm binary, key binary, text binary, place binary"


def parts_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]], ["part", "fp", "n", "bm", "key", "text", "place"])


class Part:
    """The texts and keys of a part, put together row by row."""

    def __init__(self):
        self.fps, self.sizes, self.rows, self.keys, self.texts, self.places, self.base = [], [], [[] for _ in WIDTHS], [], [], [], 0

    def ids_of(self, batches):
        """Take the rows of the texts; give (ids, fingerprints) of the rows of ids."""
        for b in batches:
            for fp, n, bm, key, text, place in zip(*[b.column(c).to_pylist() for c in ("fp", "n", "bm", "key", "text", "place")]):
                if n is None:
                    yield np.frombuffer(key, np.int64), np.frombuffer(fp, np.int64)
                else:
                    self.add(fp, n, bm, key, text, place)

    def add(self, fp: bytes, n: bytes, bm: bytes, key: bytes, text: bytes, place: bytes) -> None:
        self.fps.append(np.frombuffer(fp, np.int64))
        self.sizes.append(np.frombuffer(n, np.int32).astype(np.int64))
        at = 0
        for c, m in enumerate(np.bincount(np.searchsorted(STEPS, self.sizes[-1]), minlength=len(WIDTHS)).tolist()):
            self.rows[c].append(np.frombuffer(bm, np.uint64, m * WIDTHS[c], at).reshape(m, WIDTHS[c]))
            at += 8 * m * WIDTHS[c]
        self.keys.append(np.frombuffer(key, np.uint32))
        self.texts.append(np.frombuffer(text, np.uint16).astype(np.int64) + self.base)
        self.places.append(np.frombuffer(place, np.uint8))
        self.base += len(self.fps[-1])

    def whole(self) -> tuple[np.ndarray, Bitmaps, np.ndarray, np.ndarray, np.ndarray]:
        """(fp, bitmaps, key, text, place): the distinct texts, and their keys sorted by key, then size."""
        fp, at, text = np.unique(np.concatenate(self.fps), return_index=True, return_inverse=True)
        maps = Bitmaps(np.concatenate(self.sizes), [np.concatenate(r) for r in self.rows]).take(at)
        key, text, place = np.concatenate(self.keys), text[np.concatenate(self.texts)], np.concatenate(self.places)
        order = np.lexsort((place, text, maps.n[text], key))  # of keys equal by chance the lower place counts
        key, text, place = key[order], text[order], place[order]
        keep = np.ones(len(key), bool)
        keep[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
        return fp, maps, key[keep], text[keep], place[keep]


def links(m: DataFrame, t: float, k: int, min_words: int, run: int = RUN) -> DataFrame:
    """(a, b, is_link): links, as stars, between fingerprints whose sizes and bitmaps allow similarity t; and each message_id with its fingerprint."""
    spark = m.sparkSession
    texts = m.count()
    bits = table_bits(texts)
    parts = parts_of(texts, spark.sparkContext.defaultParallelism)

    def count(batches):
        found, seen = [], set()
        for batch in batches:
            x = Texts(batch, min_words)
            x.unseen(seen)
            if len(x.fp):
                found.append(x.shingles(k)[1])
        yield sparse_counts(found, bits)

    level = spark.sparkContext.broadcast(counts_table(m.mapInArrow(count, SPARSE), bits))  # 2**bits bytes

    def rows(batches):
        """For each batch and part of the shingles one row, with the texts that have keys there, their bitmaps, and the keys; for each batch one
        more with its ids (as keys) and fingerprints."""
        seen: set = set()
        for number, batch in enumerate(slices(batches)):
            x = Texts(batch, min_words)
            if not len(x.fp):
                continue
            ids = id_row(number, x, parts)
            x.unseen(seen)
            st, sv = x.shingles(k)
            n = np.bincount(st, minlength=len(x.fp))
            text, key, place = sub_tiles(*prefixes(st, sv, n, level.value[sv >> np.uint64(64 - bits)], t), x.fp, run)
            yield parts_batch([ids, *part_rows(x.fp, n, Bitmaps.of(st, sv, n), text, key, place, parts)])

    def out(a: np.ndarray, b: np.ndarray, is_link: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), is_link))], ["a", "b", "is_link"])

    def tiles(batches):
        part = Part()
        for ids, fp in part.ids_of(batches):
            yield out(ids, fp, False)
        if part.fps:
            fp, maps, key, text, place = part.whole()
            root = links_of_runs(key, text, place, maps, t)
            moved = np.flatnonzero(root != np.arange(len(root)))
            yield out(fp[moved], fp[root[moved]], True)

    return m.mapInArrow(rows, PARTS).repartitionById(parts, "part").mapInArrow(tiles, "a long, b long, is_link boolean")


class Sets:
    """Shingle sets of texts, 40 bits a shingle, one after another: n[i] sorted values from start[i] on."""

    def __init__(self, n: np.ndarray, value: np.ndarray):
        self.n, self.value, self.start = n, value, np.cumsum(n) - n

    @classmethod
    def unpack(cls, raw: list[bytes]) -> Sets:
        n = np.array([len(r) // 5 for r in raw], np.int64)
        wide = np.zeros((int(n.sum()), 8), np.uint8)
        wide[:, :5] = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, 5)
        return cls(n, wide.view("<u8").ravel())

    @classmethod
    def of(cls, text: np.ndarray, shingle: np.ndarray, texts: int) -> Sets:
        """Of 64-bit shingles of texts, distinct or not."""
        text, value = distinct_by_text(text, shingle >> np.uint64(24))
        return cls(np.bincount(text, minlength=texts), value)

    def pack(self) -> list[bytes]:
        packed = np.ascontiguousarray(self.value.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()
        return [packed[5 * a : 5 * (a + n)] for a, n in zip(self.start.tolist(), self.n.tolist())]

    def maps(self) -> Bitmaps:
        return Bitmaps.of(np.repeat(np.arange(len(self.n)), self.n), self.value << np.uint64(24), self.n)

    def gather(self, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into texts, value) of all values of the texts."""
        size = self.n[texts]
        at = np.repeat(self.start[texts] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return np.repeat(np.arange(len(texts)), size), self.value[at]

    def common(self, a: np.ndarray, other: Sets, b: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of the pairs' sorted sets."""
        out = np.zeros(len(a), np.int64)
        for block in blocks_of(self.n[a] + other.n[b]):
            keys = [pair.astype(np.uint64) << np.uint64(40) | value for pair, value in (self.gather(a[block]), other.gather(b[block]))]
            both = np.concatenate(keys)
            both.sort(kind="stable")
            out[block] = np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(40)).astype(np.int64), minlength=len(block))
        return out


def blocks_of(size: np.ndarray, most: int = 1_000_000) -> list[np.ndarray]:
    """Indexes in blocks whose sizes sum to about most."""
    if not len(size):
        return []
    total = np.cumsum(size)
    return [x for x in np.split(np.arange(len(size)), np.searchsorted(total, np.arange(most, int(total[-1]) + 1, most))) if len(x)]


def classes_of_tiles(tile: np.ndarray, sets: Sets, t: float) -> np.ndarray:
    """Root index of each text among those of its tile: size band, bitmap bound, exact intersection of sorted arrays."""
    maps = sets.maps()
    order = np.lexsort((sets.n, tile))
    group, n = tile[order], sets.n[order]
    root, i, d = np.arange(len(tile)), np.arange(len(tile)), 0
    while True:
        d += 1
        i = i[i + d < len(group)]
        i = i[(group[i] == group[i + d]) & (n[i] >= t * n[i + d] - 1e-9)]
        if not len(i):
            return root
        a, b = order[i], order[i + d]
        ok = root[a] != root[b]
        a, b = a[ok], b[ok]
        ok = maps.near(a, maps, b, t)
        a, b = a[ok], b[ok]
        both = sets.common(a, sets, b)
        ok = both >= t * (sets.n[a] + sets.n[b] - both)
        if ok.any():
            root = union(root, a[ok], b[ok])


def sub_tiles_of(held: DataFrame, t: float, tile: int) -> DataFrame:
    """(tile, fp, shingles) of components of more than tile texts: one sub-tile for each two blocks of a size band or of two neighbouring ones."""
    g = F.ceil(F.col("size") / F.lit(tile)).cast("int")
    band = F.floor(F.log(F.greatest(F.length("shingles") / 5, F.lit(1.0))) / F.lit(math.log(1 / t))).cast("int")
    h = held.withColumn("g", g).withColumn("band", band).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("g")).cast("int"))
    every = F.sequence(F.lit(0), F.col("g") - 1)
    same = F.transform(every, lambda j: F.xxhash64("component", "band", F.lit(0), F.least("own", j), F.greatest("own", j)))
    up = F.transform(every, lambda j: F.xxhash64("component", "band", F.lit(1), F.col("own"), j))
    down = F.transform(every, lambda j: F.xxhash64("component", F.col("band") - 1, F.lit(1), j, F.col("own")))
    return h.select(F.explode(F.concat(same, up, down)).alias("tile"), "fp", "shingles")


def near_duplicates(messages: DataFrame, threshold: float = 0.8, shingle_words: int = 5, min_words: int = 1, run: int = RUN, tile: int = TILE) -> DataFrame:
    """(message_id, class_id): class_id is the least message_id of the class; only members of classes of two or more."""
    spark = messages.sparkSession
    m = source(messages)
    min_words = max(min_words, shingle_words)
    met = cut(links(m, threshold, shingle_words, min_words, run))
    members = met.where("not is_link").select(F.col("a").alias("message_id"), F.col("b").alias("fp"))
    copies = members.groupBy("fp").agg(F.min("message_id").alias("low"), F.max("message_id").alias("high"))
    labels = components(met.where("is_link").select("a", "b"))
    nodes = cut(copies.join(labels.withColumnRenamed("node", "fp"), "fp", "left"))
    marks = 24

    def mark(batches):
        yield sparse_counts([mix(b.column("low").to_numpy().view(np.uint64)) for b in batches], marks)

    wanted = spark.sparkContext.broadcast(np.packbits(counts_table(nodes.where("component is not null").select("low").mapInArrow(mark, SPARSE), marks) > 0))  # 2 MB

    def sets(batches):
        for batch in batches:
            cell = mix(batch.column("message_id").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) >> np.uint64(64 - marks)
            x = Texts(batch.filter(pa.array((wanted.value[cell >> np.uint64(3)] >> (7 - (cell & np.uint64(7))).astype(np.uint8) & 1).astype(bool))), min_words)
            if not len(x.fp):
                continue
            yield pa.RecordBatch.from_arrays([pa.array(x.id, pa.int64()), pa.array(x.fp), pa.array(Sets.of(*x.shingles(shingle_words), len(x.fp)).pack(), pa.binary())], ["low", "fp", "shingles"])

    def verify(batches):
        for block in by_runs(batches, "tile"):
            group, fp, raw = block.column("tile").to_numpy(), block.column("fp").to_numpy(), block.column("shingles").to_pylist()
            keep = np.ones(len(fp), bool)
            keep[1:] = (group[1:] != group[:-1]) | (fp[1:] != fp[:-1])
            group, fp, raw = group[keep], fp[keep], [r for r, k in zip(raw, keep) if k]
            root = classes_of_tiles(group, Sets.unpack(raw), threshold)
            yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array(fp[root])], ["fp", "root"])

    sized = nodes.where("component is not null").groupBy("component").agg(F.count("*").alias("size"))
    large = cut(sized.where(F.col("size") > tile))
    chosen = nodes.where("component is not null").select("low", "fp", "component")
    held = m.mapInArrow(sets, "low long, fp long, shingles binary").join(chosen, ["low", "fp"])
    exact = lambda x: x.repartition("tile").sortWithinPartitions("tile", "fp").mapInArrow(verify, "fp long, root long")
    if large.isEmpty():
        roots = exact(held.select(F.col("component").alias("tile"), "fp", "shingles"))
    else:
        small = held.join(large.select("component"), "component", "left_anti")
        stars = exact(sub_tiles_of(held.join(large, "component"), threshold, tile))
        roots = exact(small.select(F.col("component").alias("tile"), "fp", "shingles")).unionByName(components(stars.toDF("a", "b")).toDF("fp", "root"))
    rooted = nodes.select("fp", "low", "high").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    whole = rooted.groupBy("root").agg(F.min("low").alias("class_id"), F.max("high").alias("high")).where("class_id <> high").select("root", "class_id")
    node_class = rooted.select("fp", "root").join(whole, "root").select("fp", "class_id")
    return members.join(node_class, "fp").select("message_id", "class_id").distinct()


def near_pairs(messages: DataFrame, threshold: float = 0.8, shingle_words: int = 5, min_words: int = 1) -> DataFrame:
    """(message_id_a, message_id_b): each member but the least of its class, with the least."""
    c = near_duplicates(messages, threshold, shingle_words, min_words)
    return c.where("message_id <> class_id").select(F.col("class_id").alias("message_id_a"), F.col("message_id").alias("message_id_b"))
