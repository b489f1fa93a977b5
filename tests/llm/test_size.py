"""What keeps the pair operators in proportion to large tables: few listed pairs, few chance links, parts of bounded size."""

import random

import numpy as np
import pytest

pytest.importorskip("mailforge.llm")
from mailforge.llm import leakage, neardup  # noqa: E402


def random_maps(rng, n):
    text = np.repeat(np.arange(len(n)), n)
    return neardup.Bitmaps.of(text, rng.integers(0, 1 << 63, len(text)).astype(np.uint64), n)


@pytest.mark.parametrize("size", [64, 96, 128, 256])
def test_unrelated_texts_hardly_pass_the_bitmaps(size):
    maps = random_maps(np.random.default_rng(size), np.full(2000, size))
    i, j = np.triu_indices(2000, 1)
    assert maps.near(i, maps, j, 0.5).mean() < 5e-4


def test_links_of_runs_are_those_that_places_and_sizes_allow():
    rng = np.random.default_rng(3)
    n = rng.integers(20, 200, 300)
    maps = random_maps(rng, n)
    maps.near = lambda i, other, j, t: n[j] * t <= n[i] + 1e-9
    key, text = np.repeat(np.arange(60, dtype=np.uint32), 20), np.concatenate([rng.choice(300, 20, False) for _ in range(60)])
    order = np.lexsort((text, n[text], key))
    key, text, place = key[order], text[order], rng.integers(0, 129, 1200).astype(np.uint8)
    rest, group = n[text] - (place.astype(np.int64) * n[text] >> 8), np.arange(300)
    for i in range(1200):
        for j in range(i + 1, 1200):
            if key[i] == key[j] and n[text[i]] >= 0.5 * n[text[j]] and min(rest[i], rest[j]) >= (n[text[i]] + n[text[j]]) / 3 - 1e-9:
                a, b = group[text[i]], group[text[j]]
                group[group == max(a, b)] = min(a, b)
    assert neardup.links_of_runs(key, text, place, maps, 0.5).tolist() == group.tolist()


def test_late_places_list_no_pairs():
    n, rest = np.full(5, 90), np.array([90, 75, 61, 59, 45])
    assert neardup.most_size(n, rest, 0.5).tolist() == [180, 135, 93, 87, 45]


@pytest.mark.parametrize("texts", [0, 300_000, 1_000_000, 16_500_000, 81_000_000])
def test_parts_hold_a_bounded_number_of_texts(texts):
    assert texts * (1 - (1 - 1 / neardup.parts_of(texts, 6)) ** neardup.KEPT) <= neardup.PART


def test_cross_split_pairs_of_runs_are_those_that_places_and_sizes_allow():
    rng = np.random.default_rng(4)
    n, train = rng.integers(20, 200, 200), rng.random(200) < 0.7
    maps = random_maps(rng, n)
    maps.near = lambda i, other, j, t: np.minimum(n[i], n[j]) >= t * np.maximum(n[i], n[j]) - 1e-9
    key, text = np.repeat(np.arange(40, dtype=np.uint32), 20), np.concatenate([rng.choice(200, 20, False) for _ in range(40)])
    order = np.lexsort((text, n[text], key))
    key, text, place = key[order], text[order], rng.integers(0, 129, 800).astype(np.uint8)
    rest, want = n[text] - (place.astype(np.int64) * n[text] >> 8), set()
    for i in np.flatnonzero(train[text]):
        for j in np.flatnonzero(~train[text]):
            a, b = n[text[i]], n[text[j]]
            if key[i] == key[j] and min(a, b) >= 0.5 * max(a, b) and min(rest[i], rest[j]) >= (a + b) / 3 - 1e-9:
                want.add((text[i], text[j]))
    assert want and set(zip(*leakage.pairs_of_runs(key, text, place, maps, train, 0.5))) == want


def test_texts_of_a_frequent_shingle_meet_once():
    rng = np.random.default_rng(5)
    fp, train = rng.integers(0, 1 << 62, 100), np.arange(100) < 60
    met = []
    for side, own, other in ((1, 4, 3), (0, 3, 4)):
        text = np.flatnonzero(train == side)
        at, key, _ = leakage.blocks_by_side(text, np.full(len(text), 7, np.uint64), text, fp, np.full(len(text), own), np.full(len(text), other), side)
        met.append((at, key))
    (a, x), (b, y) = met
    i, j = np.nonzero(x[:, None] == y[None, :])
    assert sorted(zip(a[i], b[j])) == [(i, j) for i in range(60) for j in range(60, 100)] and len(set(x.tolist())) == 12


@pytest.fixture(scope="module")
def split_messages(spark):
    rng, rows = random.Random(8), []
    head = " ".join(f"h{i}" for i in range(12))
    for g in range(25):
        tail = [f"t{g}x{i}" for i in range(18)]
        rows += [(4 * g + c, f"{head} {' '.join(tail[: 18 - 2 * c])} {' '.join(f'e{g}x{c}x{i}' for i in range(2 * c))}") for c in range(4)]
    rng.shuffle(rows)
    m = spark.createDataFrame([(i, "", b, 0, "a") for i, b in rows], "message_id long, subject string, body string, label int, source string")
    return dict(rows), m, spark.createDataFrame([(i, "train" if i % 4 else "test") for i, _ in rows], "message_id long, split_name string")


@pytest.mark.parametrize("run, side_bits", [(leakage.RUN, leakage.SIDE_BITS), (3, leakage.SIDE_BITS), (3, 2)])
def test_cross_split_pairs_in_sub_tiles_and_with_sides_that_share_bits(monkeypatch, split_messages, run, side_bits):
    texts, m, splits = split_messages
    monkeypatch.setattr(leakage, "SIDE_BITS", side_bits)
    sets = {i: {tuple(w[j : j + 3]) for j in range(len(w) - 2)} for i, w in ((i, t.split()) for i, t in texts.items())}
    want = {(i, j) for i in sets for j in sets if i % 4 and not j % 4 and len(sets[i] & sets[j]) >= 0.5 * len(sets[i] | sets[j])}
    got = leakage.near_overlaps(m, splits, 0.5, 3, 20, run)
    assert {(r.train_id, r.other_id) for r in got.collect()} == want and len(want) > 50


def test_texts_are_not_copied_to_shards(split_messages):
    _, m, splits = split_messages
    plan = leakage.near_overlaps(m, splits, 0.5, 3, 20)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan and "MapInArrow" in plan
