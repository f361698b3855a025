"""The index of bands against brute force, with bands that are given out as they come, and lists that say the same."""

import numpy as np
import pytest

from docmeter.llm import line_dedup

SHAPE = "item long, bands array<long>"


@pytest.fixture
def small_bucket(monkeypatch):
    monkeypatch.setattr(line_dedup, "BUCKET", 40)
    monkeypatch.setattr(line_dedup, "DEAL", 64)


def _shared(rows):
    by_token = {}
    for item, bands in rows:
        for b in bands or []:
            by_token.setdefault(b, set()).add(item)
    return {(t, i) for t, items in by_token.items() if len(items) > 1 for i in items}


@pytest.mark.parametrize("hot", [False, True])
def test_shared_bands(spark, small_bucket, hot):
    rng = np.random.default_rng(4)
    tokens = rng.integers(-(2**62), 2**62, 300)
    rows = [(i, [int(t) for t in rng.choice(tokens, 9)] if not hot else [7, *[int(t) for t in rng.choice(tokens, 8)]]) for i in range(200)]
    rows += rows[:50] + [(900, []), (901, None), (None, [])]
    found = line_dedup.shared_bands(spark.createDataFrame(rows, SHAPE)).collect()
    assert {(r.token, r.item) for r in found} == _shared(rows)
    assert all(r.pos == 0 for r in found)


def test_shared_bands_empty(spark):
    assert line_dedup.shared_bands(spark.createDataFrame([], SHAPE)).count() == 0


def test_distinct_lists(spark):
    rows = [(t, i, 0) for t, items in {1: [5, 6], 2: [6, 5], 3: [5, 6, 7], 4: [8], 5: [5, 7]}.items() for i in items]
    found = line_dedup.distinct_lists(spark.createDataFrame(rows, "token long, item long, pos int")).collect()
    lists = {}
    for r in found:
        lists.setdefault(r.token, set()).add(r.item)
    assert lists == {1: {5, 6}, 3: {5, 6, 7}, 5: {5, 7}}
