"""Operators for training data: brute force, round trips and hand-made rows with nulls, empties, ties and repeats."""

import random
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("mailforge.llm")
from mailforge.llm import formatting, leakage, mixing, mojibake, neardup, newtext, packing, splitting, survivors, tokens, words  # noqa: E402

MESSAGE = "message_id long, subject string, body string, label int, source string, sender string, id long"


def messages(spark, rows):
    return spark.createDataFrame([(i, s, b, l, src, "s", 7) for i, s, b, l, src in rows], MESSAGE)


def sentence(rng, n):
    return " ".join("".join(rng.choices(string.ascii_lowercase, k=5)) for _ in range(n))


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = "zz" + str(rng.randrange(1000))
    return " ".join(w)


def similarity(a, b, k=3):
    s = lambda t: {tuple(t[i : i + k]) for i in range(len(t) - k + 1)}
    x, y = s(a.split()), s(b.split())
    return len(x & y) / len(x | y) if x | y else 0


@pytest.fixture(scope="module")
def near_rows():
    rng = random.Random(5)
    rows, texts = [], {}
    for g in range(30):
        base = sentence(rng, 40 if g else 400)
        for c in range(rng.randint(1, 4)):
            i = len(rows) + 1
            texts[i] = base if c == 1 else edited(rng, base, 2 * c)
            rows.append((i, "", texts[i], 0, "a"))
    return [*rows, (900, None, None, None, None), (901, "", "", 0, "a"), (902, "x", "y", 0, "a")], texts


def test_near_duplicates_against_brute_force(spark, near_rows):
    rows, texts = near_rows
    root = {i: i for i in texts}
    for i in sorted(texts):
        for j in texts:
            if i < j and similarity(texts[i], texts[j]) >= 0.5 and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = {k: low if v == high else v for k, v in root.items()}
    want = {(r, i) for i, r in root.items() if r != i}
    got = {tuple(r) for r in neardup.near_pairs(messages(spark, rows), 0.5, 3, 20).collect()}
    assert got == want and want
    assert neardup.near_pairs(messages(spark, []), 0.5, 3, 20).count() == 0


def test_near_duplicates_without_long_common_runs(spark):
    rng = random.Random(11)
    rows = []
    for g in range(40):
        a, b, c, d = (sentence(rng, 5) for _ in range(4))
        rows += [(2 * g, "", " ".join([a, b, c, d]), 0, "a"), (2 * g + 1, "", " ".join([b, d, a, c]), 0, "a")]
    assert all(similarity(x[2], y[2]) == 0.5 for x, y in zip(rows[::2], rows[1::2]))
    for rest in ([], [(1000 + i, "", f"{rows[0][2]} {sentence(rng, 2)}", 0, "a") for i in range(60)]):  # the second time at frequent shingles
        got = {tuple(r) for r in neardup.near_pairs(messages(spark, rows + rest), 0.5, 3, 20).collect()}
        assert got == {(2 * g, 2 * g + 1) for g in range(40)} | {(0, r[0]) for r in rest}


def test_near_duplicates_in_sub_tiles(spark):
    """Shingles and components of more texts than a tile takes give the same classes; texts changed evenly at every ninth to twelfth word."""
    rng = random.Random(13)
    base, rows = sentence(rng, 60), []
    for i in range(150):
        w = base.split() if i % 3 else sentence(rng, 40 + i % 30).split()
        step = 9 + i % 4
        for j in range(i % step, len(w), step):
            w[j] = f"q{i}x{j}"
        rows += [(2 * i, "", " ".join(w), 0, "a"), (2 * i + 1, "", " ".join(w[:-2] + [f"z{i}"]), 0, "a")]
    root = {r[0]: r[0] for r in rows}
    for a in rows:
        for b in rows:
            if a[0] < b[0] and root[a[0]] != root[b[0]] and similarity(a[2], b[2]) >= 0.5:
                low, high = sorted((root[a[0]], root[b[0]]))
                root = {k: low if v == high else v for k, v in root.items()}
    want = {(i, r) for i, r in root.items() if list(root.values()).count(r) > 1}
    for run, tile in ((2048, 8192), (16, 32)):
        assert {tuple(r) for r in neardup.near_duplicates(messages(spark, rows), 0.5, 3, 20, run, tile).collect()} == want


def test_cross_split_against_brute_force(spark, near_rows):
    rows, texts = near_rows
    splits = spark.createDataFrame([(i, " Train " if i % 2 else "test") for i in texts] + [(1, "train"), (902, None)], "message_id long, split_name string")
    want = {(i, j) for i in texts for j in texts if i < j and i % 2 != j % 2 and similarity(texts[i], texts[j]) >= 0.5}
    got = {tuple(r) for r in leakage.cross_split_pairs(messages(spark, rows), splits, 0.5, 3, 20).collect()}
    assert got == want and want


def test_backward_search_counts_every_gram():
    rng = np.random.default_rng(1)
    h, bounds = rng.integers(1, 6, 300).astype(np.uint64), np.array([0, 120, 120, 300])
    for k in (1, 2, 3, 5, 6):
        index = leakage.Index(h, bounds, k)
        grams = [tuple(h[i : i + k]) for a, b in zip(bounds, bounds[1:]) for i in range(a, b - k + 1)]
        for p in range(0, 290, 7):
            low, high = index.search(index.symbols(h), np.array([p]))
            assert high[0] - low[0] == grams.count(tuple(h[p : p + k]))
            assert all(index.doc[s] == np.searchsorted(bounds, s - index.doc[s], "right") - 1 for s in index.suffix[low[0] : high[0]])


def test_words_equal_a_pattern():
    import regex

    texts = ["Ein Süß-Wort, 12½ ok", "", "ééé zwei", "a\nb"]
    h, bounds = words.word_hashes(texts)
    assert np.diff(bounds).tolist() == [len(regex.findall(r"[\p{L}\p{N}]+", t.lower())) for t in texts]
    same, _ = words.word_hashes(["zwei", "ZWEI"])
    assert same[0] == same[1]


def test_format_copies(spark):
    rows = [(1, "", "A b", 0, "a"), (2, "", "a-B!", 0, "a"), (3, "", "a b", 1, "a"), (4, "", "X: 1\nYy = 2", 0, "a"), (5, "", "yy=2\nx: 1", 0, "a"), (6, "", "x1yy2", 0, "a"), (7, "", "!!!", 0, "a"), (8, "", "???", 0, "a"), (9, "", None, 0, "a"), (10, "", "q", None, "a"), (11, "", "Q", None, "a")]
    got = {tuple(r) for r in formatting.format_copies(messages(spark, rows)).collect()}
    assert got == {(1, 2), (4, 5), (10, 11)}
    assert formatting.format_copies(messages(spark, [])).count() == 0


def test_survivors(spark):
    t = "timestamp_ntz"
    s = spark.createDataFrame(
        [(1, 0, 5, "n/a", "long body", None, "Ling ", "2010-01-01"), (1, 1, 6, "Hi", " ", 1, "enron", "2011-01-01"), (1, 2, 6, "Hi", "x", 1, "enron", "2009-01-01"), (2, 0, 1, None, None, None, None, None)],
        "duplicate_group_id long, sample_index int, original_row_index long, subject string, body string, label int, source string, loaded_at string",
    )
    s = s.withColumn("loaded_at", s.loaded_at.cast(t))
    reg = spark.createDataFrame([("ling", 2), ("enron", 3)], "source string, trust_rank int")
    got = {(r[0], r[1]): r[2] for r in survivors.survivors_long(s, reg).collect()}
    assert got == {(1, "kept_source"): "ling", (1, "duplicate_count"): "2", (1, "labels"): "[1]", (1, "kept_label"): "1", (1, "kept_subject_row"): "6", (1, "kept_body_row"): "5", (2, "kept_source"): None, (2, "duplicate_count"): "1", (2, "labels"): "[]"}


def test_flow_spreads_overlapping_patterns():
    a, b = frozenset([1]), frozenset([1, 2])
    flow = mixing.route({a: 10.0, b: 10.0}, {1: 15.0, 2: 5.0}, {1: 2, 2: 2})
    assert sum(v for (p, c, k), v in flow.items() if c == 1) == 15 and sum(v for (p, c, k), v in flow.items() if c == 2) == 5
    assert all(k == 1 for _, _, k in flow)  # capacity suffices without repetition
    assert sum(v for v in mixing.route({a: 10.0}, {1: 99.0}, {1: 3}).values()) == 30


def test_draw_takes_what_the_flow_routes(spark):
    rows = messages(spark, [(i, "", "x", i % 2, "Enron" if i % 5 else "ling") for i in range(1000)] + [(2000, "", "x", None, "enron"), (2001, "", "x", 0, "other"), (2002, "", "x", 0, None)])
    registry = spark.createDataFrame([("enron",), ("ling",)], "source string")
    plan = spark.createDataFrame([("m", "enron", 0, 3.0, 2, 0.5), ("m", "ling", 1, 2.0, 3, 0.5), ("m", "ling", 0, 0.0, 3, 0.5), ("z", "enron", 0, None, None, None)], "mix_name string, source string, label int, target_weight double, max_repeats int, pool_ratio double")
    got = {(r.mix_name, r.source, r.label): r.n for r in mixing.draw(rows, registry, plan).groupBy("mix_name", "source", "label").agg(F.sum("repeats").alias("n")).collect()}
    assert got == {("m", "enron", 0): 300, ("m", "ling", 1): 200}
    assert max(r.repeats for r in mixing.draw(rows, registry, plan).collect() if r.source == "ling") == 2
    size = spark.createDataFrame([(i, 1 + i % 7) for i in range(1000)], "message_id long, size long")
    wide = mixing.by_source_and_by_label(plan)
    total = sum(1 + i % 7 for i in range(1000))
    report = {(r.source, r.label): r for r in mixing.shares(rows, registry, wide, size=size).collect() if r.mix_name == "m"}
    assert set(report) == {("enron", None), ("ling", None), (None, 0), (None, 1)}
    for r in report.values():
        assert abs(r.drawn - 0.5 * total * r.target_share) <= 3 * 7 and abs(r.actual_share - r.target_share) < 0.02
    assert mixing.draw(rows.limit(0), registry, plan).count() == 0


def test_tokens_round_trip_and_long_runs():
    enc = tokens.encoding("byte_bpe_50k")
    rng = random.Random(3)
    texts = ["", None, "  ", "Hi there", "ab" * 9000, "x" * 5000 + " word " + "漢字" * 4000, "".join(rng.choices("aàb1é", k=20000)), "\n" * 6000]
    for t in texts:
        ids = tokens.encode(t, enc)
        assert ids == (enc.encode_ordinary(t) if t else [])


def test_white_space_before_long_runs():
    enc = tokens.encoding("byte_bpe_50k")
    runs = ["x" * 5000, "=" * 5000, "7" * 5000, "\n" * 5000]
    for space in ["\n\n", "\n", " ", "  ", "\n\n ", " \n\t\n", "\u00a0\u3000", "\x1c\x1c"]:
        for run in runs:
            for text in [f"abc{space}{run}", space + run, f"{run}{space}{runs[0]}{space}", f"a{space}b{space}{run}{space}c"]:
                assert tokens.encode(text, enc) == enc.encode_ordinary(text)


def test_packing_covers_and_beats_first_fit():
    rng = random.Random(1)
    lengths = [rng.randint(1, 100) for _ in range(2000)]
    hist = {n: lengths.count(n) for n in set(lengths)}
    plan = packing.patterns(hist, 128)
    back = {}
    for used, times in plan:
        assert sum(n * k for n, k in used.items()) <= 128
        for n, k in used.items():
            back[n] = back.get(n, 0) + k * times
    assert back == hist and sum(t for _, t in plan) <= sum(lengths) / 128 * 1.06 + 1


def test_containers(spark):
    docs = spark.createDataFrame([(1, "word " * 700), (2, None), (3, ""), (4, "a"), (4, "a")], "doc_id long, text string")
    limits = spark.createDataFrame([(1, "pack", "byte_bpe_50k", 512, 0)], "limit_id int, purpose string, tokenizer_name string, max_tokens int, overlap_tokens int")
    rows = packing.containers(docs, limits).collect()
    assert {r.doc_id for r in rows} == {1, 4} and sum(r.end_token - r.start_token for r in rows if r.doc_id == 1) >= 700
    assert all(sum(r.end_token - r.start_token for r in rows if r.container_no == c) <= 512 for c in {r.container_no for r in rows})


def test_splitting_covers_within_limit():
    enc, lengths = tokens.encoding("byte_bpe_50k"), tokens.token_lengths("byte_bpe_50k")
    text = "\n\n".join(f"Paragraph {i}. It says, among other things: hello! " + "word " * (i % 37) for i in range(60)) + "漢字" * 300
    ids = enc.encode_ordinary(text)
    pieces = splitting.split_text(text, ids, lengths, [(1, 64, 8), (2, 10**6, 0)])
    assert {p[0] for p in pieces} == {1}
    at = 0
    for _, no, first, end, overlap, c0, c1, _ in pieces:
        assert first + overlap == at and end - first <= 64 and overlap <= 8 and len(enc.encode_ordinary(text[c0:c1])) <= 64
        at = end
    assert at == len(ids) and sum(p[4] == 8 for p in pieces) > len(pieces) / 2


def plain_merge(strength, n, limit, overlap):
    """Bottom-up from single tokens, always the weakest boundary, then the smallest union, then the first."""
    parts = [(i, i + 1) for i in range(n)]
    while True:
        fits = [(strength[b[0] - 1], b[1] - a[0], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if b[1] - a[0] + (overlap if a[0] else 0) <= limit]
        if not fits:
            return parts
        i = min(fits)[2]
        parts[i : i + 2] = [(parts[i][0], parts[i + 1][1])]


def test_merging_equals_plain_bottom_up():
    rng = np.random.default_rng(4)
    for case in range(600):
        n, limit = int(rng.integers(2, 90)), int(rng.integers(2, 24))
        strength = rng.choice(7, n - 1, p=[0.02, 0.3, 0.3, 0.14, 0.12, 0.08, 0.04])
        overlap = int(rng.integers(0, limit))
        assert splitting.merge(strength, n, limit, overlap) == plain_merge(strength.tolist(), n, limit, overlap), case


def test_boundary_strengths():
    S = splitting
    for left, right, want in [("a.", " b", S.SENTENCE), ("a.”", " b", S.SENTENCE), ("a", " b", S.WORD), ("a;", " b", S.CLAUSE), ("क।", " ख", S.SENTENCE), ("漢。", "字", S.SENTENCE), ("漢！」", "字", S.SENTENCE), ("漢，", "字", S.CLAUSE), ("a؟", " b", S.SENTENCE), ("a،", " b", S.CLAUSE), ("a", "b", S.INSIDE),
                              ("a", "\xa0b", S.WORD), ("a\u3000", "b", S.WORD), ("x\n", "y", S.LINE), ("x\n\n", "y", S.PARAGRAPH), ("x\r\n\r\n", "y", S.PARAGRAPH), (".", " b", S.SENTENCE), ("é", "é", S.INSIDE)]:
        data = np.frombuffer((left + right).encode(), np.uint8)
        assert splitting.strengths(data, np.array([len(left.encode())]))[0] == want, (left, right)


def test_garbled_text(spark):
    good = ["Größe über für Straße", "wiadomość książka żółty", "São ação coração"]
    rows = [(i, "plain", good[i % 3], 0, "a") for i in range(60)]
    rows += [(100, "plain", good[0].encode().decode("latin-1"), 0, "a"), (101, "caf�", "x", 0, "a"), (102, None, None, 0, "a"), (103, good[2].encode().decode("cp1252"), "", 0, "a")]
    got = {(r.message_id, r.field_name): r.restored for r in mojibake.judge(messages(spark, rows)).collect()}
    assert set(got) == {(100, "body"), (101, "subject"), (103, "subject")}
    assert got[100, "body"] == good[0] and got[103, "subject"] == good[2]


def test_new_text(spark):
    body = "Hi Ulla,\n\nPlease see the list > 5 items.\n\nBest regards,\nIvo Marek\n\nOn 01.01.2009, Pavo Lum wrote:\n> old text\n> more"
    rows = [(i, "", body.replace("Ulla", f"U{i}"), 0, "a") for i in range(40)] + [(90, "", None, 0, "a"), (91, "", "", 0, "a"), (92, "", ">>>", 0, "a")]
    got = {(r.message_id, r.line_no) for r in newtext.removed_lines(messages(spark, rows)).collect()}
    assert {n for i, n in got if i == 3} == {5, 6, 8, 9, 10} and not {i for i, _ in got} & {90, 91, 92}
    kept = {r.message_id: r.body for r in newtext.new_text(messages(spark, rows)).collect()}
    assert kept[3] == "Hi U3,\n\nPlease see the list > 5 items."


CLASHING = ["fp", "n", "a", "b", "key", "root", "low", "high", "class_id", "token", "digest", "line_no", "bucket", "size", "at", "tile", "component", "part", "is_train", "split_name", "group", "text_", "i", "word"]


def dirty(spark, empty=False):
    """Messages with nulls in every column, empty, blank and very long texts, repeated rows and ids, and extra columns named as inner ones."""
    long = "lorem ipsum dolor sit amet " * 40_000
    rows = [(1, "s", "body of one message with a few words in it", 0, "enron", "x@y"), (1, "s", "body of one message with a few words in it", 0, "enron", "x@y"), (1, "other", "text", 1, None, None), (2, None, None, None, None, None), (None, "s", "b", 1, "ling", "z"),
            (3, "", "", 0, "", ""), (4, " \n ", "\t\r\n", 1, " Enron ", "s"), (5, "x" * 100_000, long, 1, "ling", "s"), (6, "y", long + "end", 1, "ling", "s"), (7, "\x00", "😀".encode("utf-16", "surrogatepass").decode("utf-16"), 0, "no such source", "s")]
    df = spark.createDataFrame([] if empty else rows, "message_id long, subject string, body string, label int, source string, sender string")
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHING])


@pytest.mark.parametrize("empty", [False, True])
def test_dirty_messages(spark, empty):
    m = dirty(spark, empty)
    registry = spark.createDataFrame([("enron", 1), ("ling", None), (None, 2)], "source string, trust_rank int")
    plan = spark.createDataFrame([("m", "enron", 0, 1.0, 2, 0.5), ("m", None, None, None, None, None), (None, "ling", 1, 1.0, 1, 1.0)], "mix_name string, source string, label int, target_weight double, max_repeats int, pool_ratio double")
    splits = spark.createDataFrame([] if empty else [(1, "train"), (5, "train"), (6, " TEST"), (None, "test"), (2, None), (3, ""), (5, "train")], "message_id long, split_name string")
    assert mojibake.garbled_fields(m).count() == 0
    near = {tuple(r) for r in neardup.near_pairs(m, 0.5, 3, 20).collect()}
    assert near == (set() if empty else {(5, 6)})
    assert {tuple(r) for r in leakage.cross_split_pairs(m, splits, 0.5, 3, 20).collect()} == near
    report = leakage.overlap_report(m, splits, 0.5, 3, 20).collect()
    assert [(r.split_name, r.overlapping, r.pairs) for r in report] == ([] if empty else [("test", 1, 1)])
    assert formatting.format_copies(m).count() == 0 and formatting.copy_counts(m).count() == (0 if empty else 7)
    assert mixing.mix_passes(m, registry, plan).count() == 3 and mixing.draw(m, registry, plan).count() >= 0
    assert newtext.removed_lines(m).count() >= 0 and newtext.new_text(m).count() == (0 if empty else 8)


@pytest.mark.parametrize("empty", [False, True])
def test_dirty_documents(spark, empty):
    long = "word " * 60_000
    rows = [(1, None), (2, ""), (3, " "), (4, long), (4, long), (None, "no id"), (5, "x" * 30_000), (6, "\u0000�")]
    d = spark.createDataFrame([] if empty else rows, "doc_id long, text string").select("*", *[F.lit("clash").alias(c) for c in [*CLASHING, "ids", "n_tokens", "length", "limit_id"]])
    limits = spark.createDataFrame([(1, "pack", "byte_bpe_50k", 512, 0), (2, "split", "byte_bpe_50k", 64, 100), (3, "split", "byte_bpe_50k", None, None), (None, "pack", "byte_bpe_50k", 10, 0)], "limit_id int, purpose string, tokenizer_name string, max_tokens int, overlap_tokens int")
    ids = tokens.token_ids(d).collect()
    assert len(ids) == (0 if empty else 8) and all(r.ids == [] for r in ids if r.doc_id in (1, 2))
    packed = packing.containers(d, limits).groupBy("container_no").agg(F.sum(F.col("end_token") - F.col("start_token")).alias("n"))
    assert packed.where("n > 512").count() == 0
    pieces = splitting.pieces(d, limits)
    assert pieces.where("end_token - start_token > 64").count() == 0 and (pieces.count() > 0) != empty


def test_trees_beyond_the_seed_rules():
    """On messages not fitted on, lines that go are found as the rules do; a notice in words the rules do not know is found, too, where it stands like one."""
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.01/combine.parquet", columns=["sender", "body"])
    rows = [(b, s) for b, s in zip(t["body"].to_pylist(), t["sender"].to_pylist()) if b]
    bodies, senders = [b for b, _ in rows], [s for _, s in rows]
    level = np.full(1 << 20, 8, np.uint8)
    odds, model = newtext.fit(bodies[::2], senders[::2], level)
    x = newtext.Lines(bodies[1::2], senders[1::2])
    gone = [newtext.Body(b).gone for b in bodies[1::2]]
    y = np.array([gone[o][n] for o, n in zip(x.owner.tolist(), x.number.tolist())])
    p = model.predict(newtext.features(x, level, odds)) >= 0.5
    assert (p & y).sum() >= 0.97 * y.sum() and (p & y).sum() >= 0.97 * p.sum()
