"""Problem 7: same or near-same records across splits.

1. Shingles of k words are counted in a hashed table of fixed size, in training and in evaluation texts; only those found in both can meet. Equal texts of
   a side are one, by a 64-bit fingerprint.
2. In one order common to all texts, rarest first, two texts of similarity t meet in one of the first n - ceil(t * n) + 1 of the n distinct shingles of
   both (see neardup). Each text is routed to the parts of the shingles that it keeps, so work follows the texts, not training times evaluation
   texts. A shingle of many texts is dealt to sub-tiles of a block of training and a block of evaluation texts.
3. In a part, the places of the met shingles and the sizes bound the training texts listed for an evaluation text, then bitmaps do.
4. For the pairs that remain, the shingles of both come together in their order: whole shingle sets decide, and adjacent matched
   shingles merge into maximal spans of the training text, which are counted with their words.

Which side a message is on, tables of bits say while texts are read: a wrong bit costs time, and the sides themselves are joined to the pairs at the end.
Bodies equal when written together are found by an equi-join of digests. Index is a full-text index of one shard for searches of single patterns; the
pairs do without it.

Defined results: null, empty and wordless bodies have no case; split names count without outer blanks and in any case; rows in no
split or with a blank split name are left out; rows listed twice count once; extra columns are ignored; empty tables give no rows. Pairs equal only
when written together have no spans.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailforge.functions.sources import canonical_source
from mailforge.llm.formatting import leaf
from mailforge.llm.neardup import PARTS, RUN, SCALE, SPARSE, Bitmaps, Part, Sets, Texts, blocks_of, counts_table, most_size, part_rows, parts_batch, parts_of, prefixes, slices, sparse_counts, stretches, table_bits
from mailforge.llm.words import grams, inside_text, mix, text_of
from mailforge.session import cut, spread

#: Steps of a scale of counts in four bits; each stands for counts up to its own.
COUNTS = np.array([0, 1, 2, 4, 8, 16, 32, 64, 128, 512, 2048, 1 << 13, 1 << 15, 1 << 17, 1 << 20, 1 << 24])
#: Most bits of the table of counts and, for each side, of the table of sides; bits of the table of wanted messages.
COUNT_BITS, SIDE_BITS, WANTED_BITS = 25, 25, 24
#: Pairs of a part that are held before repeated ones are dropped.
HELD = 4_000_000


class Index:
    """Word-level index of many texts for backward search of patterns of k words."""

    def __init__(self, h: np.ndarray, bounds: np.ndarray, k: int):
        self.k = k
        self.words, ids = np.unique(h, return_inverse=True)
        n, docs = len(h), len(bounds) - 1
        at = np.arange(n) + np.repeat(np.arange(docs), np.diff(bounds))  # a separator, symbol 0, ends each text
        self.size = n + docs
        text = np.zeros(self.size + k, np.int32)
        text[at] = ids + 1
        self.doc = np.zeros(self.size, np.int32)
        self.doc[at] = np.repeat(np.arange(docs, dtype=np.int32), np.diff(bounds))
        del at, ids

        def code(a, b):
            return a.astype(np.int64) * (int(b.max(initial=0)) + 1) + b

        rank, width = text, 1
        while 2 * width <= k:  # ranks of width words from each position on
            key = code(rank[:-width], rank[width:])
            order = np.argsort(key, kind="stable")
            key = key[order]
            rank = np.empty(len(key), np.int32)
            rank[order] = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]), dtype=np.int32)
            width *= 2
        rest = k - width
        self.suffix = np.argsort(code(rank[: self.size], rank[rest : rest + self.size]), kind="stable").astype(np.int32)
        del rank
        before = text[self.suffix - 1]
        before[self.suffix == 0] = 0
        del text
        order = np.argsort(before, kind="stable")
        self.span = self.size + 1
        self.steps = before[order].astype(np.int64) * self.span + order
        self.first = np.searchsorted(self.steps, np.arange(len(self.words) + 2) * self.span)

    def symbols(self, h: np.ndarray) -> np.ndarray:
        """Symbol of each word; -1 for words that are not in the index."""
        i = np.searchsorted(self.words, h)
        i[i == len(self.words)] = 0
        return np.where(self.words[i] == h, i + 1, -1) if len(self.words) else np.full(len(h), -1)

    def search(self, symbols: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix interval [low, high) of the k words from each start on, by backward steps; empty ones drop out on the way."""
        low, high = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        c = symbols[start + self.k - 1]
        live = np.flatnonzero(c > 0)
        c = c[live]
        a, b = self.first[c], self.first[c + 1]
        for back in range(self.k - 2, -1, -1):
            c = symbols[start[live] + back]
            known = c > 0
            live, c = live[known], c[known] * self.span
            a, b = np.searchsorted(self.steps, c + a[known]), np.searchsorted(self.steps, c + b[known])
            some = b > a
            live, a, b = live[some], a[some], b[some]
        low[live], high[live] = a, b
        return low, high


class Ordered:
    """The shingles of texts in their order, 40 bits each (one after another in raw), and as sets."""

    def __init__(self, raw: list[bytes]):
        whole = Sets.unpack(raw)
        self.text, self.gram = np.repeat(np.arange(len(raw)), whole.n), whole.value << np.uint64(24)
        self.at = np.arange(len(self.gram))
        self.sets = Sets.of(self.text, self.gram, len(raw))

    def __len__(self) -> int:
        return len(self.sets.n)


def pairs_of_runs(key: np.ndarray, text: np.ndarray, place: np.ndarray, maps: Bitmaps, train: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """(training text, evaluation text): the distinct pairs of texts of equal keys (rows sorted by key, then size) that places, sizes and bitmaps allow to be
    similar; see neardup.links_of_runs."""
    n = maps.n[text]
    rest = n - (place.astype(np.int64) * n >> 8)
    run = np.cumsum(np.diff(key, prepend=key[:1]) != 0) << 32
    x, y = np.flatnonzero(train[text]), np.flatnonzero(~train[text])
    sizes = (run + n)[x]
    first = np.searchsorted(sizes, run[y] + np.ceil(t * n[y] - 1e-6).astype(np.int64))
    end = np.searchsorted(sizes, run[y] + np.maximum(0, most_size(n[y], rest[y], t)), "right")
    found, held = [np.zeros(0, np.int64)], 0
    for i, j in stretches(first, np.maximum(0, end - first)):
        i, j = y[i], x[j]
        ok = rest[j] >= (n[i] + n[j]) * (t / (1 + t)) - 1e-9
        pair = np.unique(text[j[ok]] << 32 | text[i[ok]])
        pair = pair[maps.near(pair >> 32, maps, pair & 0xFFFFFFFF, t)]
        found.append(pair)
        held += len(pair)
        if held > HELD:
            found = [np.unique(np.concatenate(found))]
            held = len(found[0]) // 2
    pair = np.unique(np.concatenate(found))
    return pair >> 32, pair & 0xFFFFFFFF


def blocks_by_side(text: np.ndarray, key: np.ndarray, place: np.ndarray, fp: np.ndarray, own: np.ndarray, other: np.ndarray, is_train: int) -> tuple[np.ndarray, ...]:
    """(text, key, place) with each key of more than one block of texts on either side dealt: a text goes to its own block with each block of the other."""
    many, rest = np.flatnonzero(own * other > 1), np.flatnonzero(own * other <= 1)
    if not len(many):
        return text, key, place
    at = np.repeat(many, other[many])
    there = np.arange(len(at)) - np.repeat(np.cumsum(other[many]) - other[many], other[many])
    here = (mix(fp[text[at]].view(np.uint64)) % own[at].astype(np.uint64)).astype(np.int64)
    a, b = (here, there) if is_train else (there, here)
    dealt = mix(key[at] + mix(a.astype(np.uint64) * np.uint64(1 << 32) + b.astype(np.uint64) + np.uint64(1)))
    return np.concatenate([text[rest], text[at]]), np.concatenate([key[rest], dealt]), np.concatenate([place[rest], place[at]])


def spans_of(x: Ordered, a: np.ndarray, y: Ordered, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(spans, words) of each pair: maximal runs of the training text's shingles that stand in the evaluation text, and the words they cover."""
    spans, words = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    size, start = np.bincount(x.text, minlength=len(x)), np.searchsorted(x.text, np.arange(len(x)))
    for block in blocks_of(size[a] + y.sets.n[b]):
        m = size[a[block]]
        at = np.repeat(start[a[block]] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
        pair = np.repeat(np.arange(len(block)), m)
        other, value = y.sets.gather(b[block])
        there = other.astype(np.uint64) << np.uint64(40) | value
        mine = pair.astype(np.uint64) << np.uint64(40) | x.gram[at] >> np.uint64(24)
        met = np.zeros(len(mine), bool)
        if len(there):
            met = there[np.minimum(np.searchsorted(there, mine), len(there) - 1)] == mine
        pair, at = pair[met], x.at[at[met]]
        gap = np.full(len(at), k)
        gap[1:] = np.where(pair[1:] == pair[:-1], np.minimum(k, at[1:] - at[:-1]), k)
        fresh = np.ones(len(at), bool)
        fresh[1:] = (pair[1:] != pair[:-1]) | (at[1:] > at[:-1] + k)
        spans[block], words[block] = np.bincount(pair, fresh, len(block)), np.bincount(pair, gap, len(block))
    return spans, words


def split_sides(splits: DataFrame) -> DataFrame:
    """(message_id, split_name, is_train), each message once."""
    name = F.lower(F.regexp_replace("split_name", r"(?U)^\s+|\s+$", ""))
    s = splits.select("message_id", name.alias("split_name")).where("message_id is not null and split_name <> ''")
    return s.groupBy("message_id").agg(F.min("split_name").alias("split_name")).withColumn("is_train", F.col("split_name") == "train")


def sides_table(sides: DataFrame) -> np.ndarray:
    """Bits by hash of message_id: first those of evaluation messages, then those of training messages; its size is bounded, so other messages may share them."""
    bits = min(SIDE_BITS, max(16, math.ceil(math.log2(16 * max(1, sides.count())))))

    def mark(batches):
        yield sparse_counts([hashed(b.column("message_id"), b.column("is_train").to_numpy(zero_copy_only=False).astype(np.uint64)) for b in batches], bits + 1)

    return np.packbits(counts_table(sides.mapInArrow(mark, SPARSE), bits + 1) > 0)


def hashed(ids: pa.Array | np.ndarray, side: np.ndarray | int) -> np.ndarray:
    """Hash of each message_id, with the side as its top bit."""
    ids = ids.to_numpy(zero_copy_only=False) if isinstance(ids, pa.Array) else ids
    return mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(1) | np.uint64(side) << np.uint64(63)


def bits_at(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    cell = hashes >> np.uint64(64 - (8 * len(table)).bit_length() + 1)
    return table[cell >> np.uint64(3)] >> (7 - (cell & np.uint64(7))).astype(np.uint8) & 1


def unseen(x: Texts, sides: np.ndarray, seen: dict[int, int]) -> np.ndarray:
    """Keep the first text of each fingerprint and side this task meets; sides: bit 0 evaluation, bit 1 training. Gives the sides of those kept."""
    fresh = np.zeros(len(sides), np.uint8)
    for i, (f, s) in enumerate(zip(x.fp.tolist(), sides.tolist())):
        if new := s & ~seen.get(f, 0):
            seen[f] = seen.get(f, 0) | new
            fresh[i] = new
    x.only(fresh > 0)
    return fresh[fresh > 0]


def near_overlaps(messages: DataFrame, splits: DataFrame, threshold: float = 0.8, shingle_words: int = 5, min_words: int = 1, run: int = RUN) -> DataFrame:
    """(train_id, other_id, spans, words) of cross-split pairs with similarity threshold or more."""
    spark, k, t = messages.sparkSession, shingle_words, threshold
    min_words = max(min_words, k)  # shorter texts have no shingle, so no similarity
    sides = split_sides(splits).select("message_id", "is_train")
    m = spread(messages.select("message_id", "body").where("message_id is not null and body is not null"))
    texts = m.count()
    bits, parts = min(COUNT_BITS, table_bits(texts)), parts_of(texts, spark.sparkContext.defaultParallelism)
    where = spark.sparkContext.broadcast(sides_table(sides))

    def read(batches):
        """(texts of the batch on a side, those of them not met before, their sides)"""
        seen: dict[int, int] = {}
        for batch in slices(batches):
            x = Texts(batch, min_words)
            s = bits_at(where.value, hashed(x.id, 0)) | bits_at(where.value, hashed(x.id, 1)) << 1
            x.only(s > 0)
            if len(x.fp):
                all_ids, all_fp = x.id, x.fp
                s = unseen(x, s[s > 0], seen)
                yield all_ids, all_fp, x, s

    def count(batches):
        found = []
        for _, _, x, s in read(batches):
            if len(x.fp):
                st, sv = x.shingles(k)
                found += [sv[(s[st] >> side & 1) > 0] >> np.uint64(1) | np.uint64(side) << np.uint64(63) for side in (0, 1)]
        yield sparse_counts(found, bits + 1)

    step = np.searchsorted(COUNTS[:-1], np.round(2.0 ** (np.arange(256) / SCALE) - 1)).astype(np.uint8)
    both = step[counts_table(m.mapInArrow(count, SPARSE), bits + 1)]
    table = spark.sparkContext.broadcast(both[: 1 << bits] | both[1 << bits :] << 4)  # 2**bits bytes
    del both

    def rows(batches):
        for number, (ids, fps, x, s) in enumerate(read(batches)):
            out = [((number + int(fps[0])) % parts, (fps & ~1).tobytes(), None, None, ids.astype(np.int64).tobytes(), None, None)]
            if len(x.fp):
                st, sv = x.shingles(k)
                n = np.bincount(st, minlength=len(x.fp))
                maps, code = Bitmaps.of(st, sv, n), table.value[sv >> np.uint64(64 - bits)]
                level = np.where((code & 15 > 0) & (code >> 4 > 0), 2 * SCALE + (code & 15) + (code >> 4), 0)  # those of one side come first and are dropped
                text, key, place, _ = prefixes(st, sv, n, level, t)
                code = table.value[key >> np.uint64(64 - bits)]
                blocks = [np.maximum(1, -(-COUNTS[c] // run)) for c in (code & 15, code >> 4)]
                for side in (0, 1):
                    own = (s[text] >> side & 1) > 0
                    dealt = blocks_by_side(text[own], key[own], place[own], x.fp, blocks[side][own], blocks[1 - side][own], side)
                    out += part_rows(x.fp & ~1 | side, n, maps, *dealt, parts)
            yield parts_batch(out)

    def pairs(a: np.ndarray, b: np.ndarray, is_pair: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), is_pair))], ["a", "b", "is_pair"])

    def tiles(batches):
        part = Part()
        for ids, fp in part.ids_of(batches):
            yield pairs(ids, fp, False)
        if part.fps:
            fp, maps, key, text, place = part.whole()
            a, b = pairs_of_runs(key, text, place, maps, fp & 1 > 0, t)
            for at in range(0, len(a), 100_000):
                yield pairs(fp[a[at : at + 100_000]] & ~1, fp[b[at : at + 100_000]] & ~1, True)

    met = cut(m.mapInArrow(rows, PARTS).repartitionById(parts, "part").mapInArrow(tiles, "a long, b long, is_pair boolean"))
    candidates = cut(met.where("is_pair").select(F.col("a").alias("train_fp"), F.col("b").alias("other_fp")).distinct())
    nodes = candidates.select(F.explode(F.array("train_fp", "other_fp")).alias("fp")).distinct()
    members = cut(met.where("not is_pair").select(F.col("a").alias("message_id"), F.col("b").alias("fp")).join(nodes, "fp", "left_semi").distinct())
    chosen = cut(members.groupBy("fp").agg(F.min("message_id").alias("low")))

    def mark(batches):
        yield sparse_counts([hashed(b.column("low"), 0) for b in batches], WANTED_BITS)

    wanted = spark.sparkContext.broadcast(np.packbits(counts_table(chosen.select("low").mapInArrow(mark, SPARSE), WANTED_BITS) > 0))  # 2 MB

    def ordered(batches):
        for batch in batches:
            ok = bits_at(wanted.value, hashed(batch.column("message_id"), 0)) > 0
            x = Texts(batch.filter(pa.array(ok)), min_words)
            if len(x.fp):
                ok = inside_text(x.bounds, k)
                size = np.bincount(text_of(x.bounds, len(ok))[ok], minlength=len(x.fp))
                raw = Sets(size, grams(x.h, k)[ok] >> np.uint64(24)).pack()
                yield pa.RecordBatch.from_arrays([pa.array(x.id, pa.int64()), pa.array(x.fp & ~1), pa.array(raw, pa.binary())], ["low", "fp", "shingles"])

    def verify(batches):
        for part in slices(batches, 2_000):
            sides = []
            for name in ("train", "other"):
                fp, first, of = np.unique(part.column(f"{name}_fp").to_numpy(), return_index=True, return_inverse=True)
                sides.append((Ordered(part.column(f"{name}_shingles").take(pa.array(first)).to_pylist()), of, fp))
            (x, a, train_fp), (y, b, other_fp) = sides
            shared = x.sets.common(a, y.sets, b)
            ok = shared >= t * (x.sets.n[a] + y.sets.n[b] - shared)
            a, b = a[ok], b[ok]
            spans, words = spans_of(x, a, y, b, k)
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in (train_fp[a], other_fp[b], spans, words)], ["train_fp", "other_fp", "spans", "words"])

    shingles = m.mapInArrow(ordered, "low long, fp long, shingles binary").join(chosen, ["low", "fp"]).select("fp", "shingles").dropDuplicates(["fp"])
    side = lambda name: shingles.select(F.col("fp").alias(f"{name}_fp"), F.col("shingles").alias(f"{name}_shingles"))
    similar = candidates.join(side("train"), "train_fp").join(side("other"), "other_fp").mapInArrow(verify, "train_fp long, other_fp long, spans long, words long")
    ids = cut(members.join(sides, "message_id"))
    train = ids.where("is_train").select(F.col("message_id").alias("train_id"), F.col("fp").alias("train_fp"))
    other = ids.where("not is_train").select(F.col("message_id").alias("other_id"), F.col("fp").alias("other_fp"))
    return similar.join(train, "train_fp").join(other, "other_fp").select("train_id", "other_id", "spans", "words")


#: Tasks over which the training rows of one digest are dealt.
SALTS = 16


def same_overlaps(messages: DataFrame, splits: DataFrame) -> DataFrame:
    """(train_id, other_id) of cross-split pairs whose words written together are equal. Training rows are dealt over SALTS keys of a digest and the fewer
    evaluation rows copied to each, so a much-copied body is no single task; the pairs themselves are the result."""
    digest = F.unhex(F.md5(leaf(F.col("body")).cast("binary")))
    empty = F.unhex(F.md5(F.lit("").cast("binary")))
    d = messages.where("body is not null").select("message_id", digest.alias("digest")).where(F.col("digest") != empty)
    d = cut(d.join(split_sides(splits).select("message_id", "is_train"), "message_id"))
    a = d.where("is_train").select(F.col("message_id").alias("train_id"), "digest", F.pmod(F.xxhash64("message_id"), F.lit(SALTS)).cast("int").alias("salt"))
    b = d.where("not is_train").select(F.col("message_id").alias("other_id"), "digest", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return a.join(b, ["digest", "salt"]).select("train_id", "other_id")


def cross_split_pairs(messages: DataFrame, splits: DataFrame, threshold: float = 0.8, shingle_words: int = 5, min_words: int = 1) -> DataFrame:
    """(message_id_a, message_id_b): smaller id first, one in train and one in another split."""
    near = near_overlaps(messages, splits, threshold, shingle_words, min_words).select("train_id", "other_id")
    both = near.unionByName(same_overlaps(messages, splits)).distinct()
    return both.select(F.least("train_id", "other_id").alias("message_id_a"), F.greatest("train_id", "other_id").alias("message_id_b"))


def overlap_report(messages: DataFrame, splits: DataFrame, threshold: float = 0.8, shingle_words: int = 5, min_words: int = 1) -> DataFrame:
    """(split_name, source, overlapping, pairs, spans, words): evaluation messages with a train counterpart, pairs, and the merged spans of the
    near pairs and their words, per split and canonical source."""
    near = near_overlaps(messages, splits, threshold, shingle_words, min_words)
    both = near.unionByName(same_overlaps(messages, splits).select("train_id", "other_id", F.lit(None).cast("long").alias("spans"), F.lit(None).cast("long").alias("words")))
    once = both.groupBy("train_id", "other_id").agg(F.max("spans").alias("spans"), F.max("words").alias("words"))
    per = once.groupBy("other_id").agg(F.count("*").alias("n"), F.sum("spans").alias("spans"), F.sum("words").alias("words"))
    about = messages.select(F.col("message_id").alias("other_id"), canonical_source(F.col("source")).alias("source")).join(split_sides(splits).select(F.col("message_id").alias("other_id"), "split_name"), "other_id")
    totals = [F.coalesce(F.sum(c), F.lit(0)).alias(name) for c, name in (("n", "pairs"), ("spans", "spans"), ("words", "words"))]
    return per.join(about, "other_id").groupBy("split_name", "source").agg(F.count("*").alias("overlapping"), *totals)
