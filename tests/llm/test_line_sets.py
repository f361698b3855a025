"""Shingle sets of lines and the bodies that are held once a line."""

import time

import numpy as np

from docmeter.llm import line_dedup


def lines(n, seed):
    rng = np.random.default_rng(seed)
    return ["".join(map(chr, rng.integers(97, 117, rng.integers(1, 500)))) for _ in range(n)]


def test_line_sets_are_sorted_and_distinct():
    some = ["aaaaaaaaaa", "x", "abcdeabcdeabcde", *lines(50, 1)]
    hashes, line = line_dedup.line_sets(some)
    for i, x in enumerate(some):
        own = hashes[line == i]
        assert len(own) == len({x[j : j + 5] for j in range(max(1, len(x) - 4))}) and (own[1:] > own[:-1]).all()
    assert line_dedup.line_items(some).tolist() == [line_dedup.line_item(x) for x in some]


def test_line_sets_cost_less_than_one_sort_of_all_shingles():
    some = lines(1500, 2)
    hashes, line = line_dedup.shingle_hashes(some)

    def least(f):
        took = []
        for _ in range(5):
            start = time.process_time()
            f()
            took.append(time.process_time() - start)
        return min(took)

    assert least(lambda: line_dedup.line_sets(some)) < least(lambda: np.lexsort((hashes, line)))


def test_lines_of_repeated_rows(spark):
    body = "the quick brown fox jumps over the lazy dog near the river bank"
    docs = [(1, f"{body}\nfirst only"), (1, f"{body}\nfirst only"), (2, f"{body}!\nsecond"), (3, f"{body}!\nsecond"), (3, f"{body}!\nsecond")]
    out = line_dedup.duplicate_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_lines, r["drop"]) for r in out) == [(1, 2, []), (2, 2, [0]), (3, 2, [0, 1])]
