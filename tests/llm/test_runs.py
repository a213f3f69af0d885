"""Shingles that many texts begin with: their runs are written down by members, and no link is lost."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pytest

from repolens.llm import near_dedup, simhash


def family(rng: np.random.Generator, base: list[str], n: int, changed: float) -> list[str]:
    """Copies of one text in each of which other words are changed."""
    return [" ".join(f"new{rng.integers(1 << 30)}" if rng.random() < changed else w for w in base) for _ in range(n)]


def similar(texts: dict[int, str]) -> list[tuple[int, int]]:
    sets = {k: set(near_dedup._set_of(t.encode()).tolist()) for k, t in texts.items()}
    return [(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]


def roots(links: list[tuple[int, int]]) -> dict[int, int]:
    own: dict[int, int] = {}

    def top(x: int) -> int:
        while own.setdefault(x, x) != x:
            x = own[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        own[b] = a
    return {x: top(x) for x in own}


@pytest.mark.parametrize("n", [9, 400, 4000])
def test_a_run_of_unlike_sets_gives_rows_in_proportion(n):
    one = np.ones(n, np.int64)
    found = near_dedup.met_in_runs(one, np.arange(n), one * near_dedup.ALONE, 100 * one, 0 * one)
    assert [len(c) for c in found] == [n] * 4


def test_short_runs_and_joined_runs():
    keys = np.repeat([1, 2, 3], [3, 20, 20])
    root = np.concatenate([[near_dedup.ALONE] * 3, [7] * 20, [7] * 19, [8]]).astype(np.int64)
    a, b, key, place = near_dedup.met_in_runs(keys, np.arange(43), root, np.full(43, 100), np.zeros(43, np.int64))
    assert list(zip(a[place < 0].tolist(), b[place < 0].tolist(), strict=True)) == [(0, 1), (0, 2), (1, 2)]
    assert set(key[place >= 0].tolist()) == {3} and b[place >= 0].tolist() == list(range(23, 43)) and set(a[place >= 0].tolist()) == {23}


@pytest.mark.parametrize("held", [40, 2_000_000])
def test_pieces_have_all_pairs_of_a_run_and_few_at_once(monkeypatch, held):
    monkeypatch.setattr(near_dedup, "HELD_PAIRS", held)
    monkeypatch.setattr(near_dedup, "RUN_BLOCK", 4)
    keys = np.repeat(np.arange(7), [1, 5, 2, 30, 9, 8, 1])
    pieces = [p.tolist() for p in near_dedup.run_pieces(keys)]
    met = {pair for p in pieces for pair in combinations(sorted(p), 2)}
    assert met >= {(i, j) for i, j in combinations(range(len(keys)), 2) if keys[i] == keys[j]}
    assert not list(near_dedup.run_pieces(keys[:0]))
    assert held > 40 or max(map(len, pieces)) <= 20


@pytest.mark.parametrize("words", [120, 2600])
def test_no_link_of_a_long_run_is_lost(spark, monkeypatch, words):
    """Without clusters of fingerprints, texts around the least similarity that share most of their first shingles."""
    rng = np.random.default_rng(words)
    monkeypatch.setattr(near_dedup, "HELD_PAIRS", 200)
    texts: list[str] = []
    for k, changed in enumerate((0.012, 0.03)):
        base = [f"w{k}_{i}" for i in rng.permutation(words)]
        texts += family(rng, base, 40, changed)
    texts += [" ".join(f"own{k}_{i}" for i in range(60)) for k in range(30)]
    order = rng.permutation(len(texts))
    by_node = {int(i): texts[k] for k, i in enumerate(order)}
    want = similar(by_node)
    assert len(want) > 40
    rows = spark.createDataFrame(list(by_node.items()), "node long, text string")
    prints = near_dedup.materialize(near_dedup.long_prints(rows), "prints")
    none = spark.createDataFrame([], "node long, root long")
    links = [tuple(sorted(r)) for r in near_dedup.prefix_links(rows, prints, none).collect()]
    assert set(links) <= set(want)
    assert roots(links) == roots(want)


def test_marks_in_pairs_as_one_by_one():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64)) for n in (0, 5, 300, 2000, 2300, 4300, 9000)]
    marks = [near_dedup.mark_of(s) for s in sets]
    ends = np.cumsum([0, *map(len, marks)])
    flat, long = np.concatenate(marks), np.diff(ends)
    x, y = (np.array(c) for c in zip(*((i, j) for i in range(7) for j in range(7)), strict=True))
    got = near_dedup.apart_in_pairs(flat, ends[x], long[x], flat, ends[y], long[y])
    assert got.tolist() == [near_dedup.apart(marks[i], marks[j]) for i, j in zip(x, y, strict=True)]


def test_forest_names_each_set_once():
    assert [c.tolist() for c in simhash.forest(np.array([3, 3]), np.array([1, 2]))] == [[2, 3], [1, 1]]
