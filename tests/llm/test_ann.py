"""Nearest vectors of rows on which cells and codes say little, against brute force."""

import numpy as np
import pytest

from docmeter.llm import ann

N, D = 1500, 24


def two_scales(rng):
    return 10 * rng.normal(size=(8, D))[rng.integers(0, 8, N)] + 0.3 * rng.normal(size=(N, D))


def outliers(rng):
    x = rng.normal(size=(N, D))
    x[rng.choice(N, 9, replace=False)] *= 1000
    return x


def lengths(rng):
    return rng.normal(size=(N, D)) * np.exp(2 * rng.normal(size=(N, 1)))


def minute(rng):
    return 1e-160 * two_scales(rng)


@pytest.mark.parametrize("rows", [two_scales, outliers, lengths, minute])
def test_no_nearer_vector_is_missed(spark, rows):
    x = rows(np.random.default_rng(11))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    # the index is fitted on a fifth of the rows
    settings = ann.Settings(sample=300, cells=16, block=128, query_block=16, rerank=1)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in ann.search(table, lambda k: k % 20 == 0, k=10, settings=settings).collect()}
    want = {}
    for q in range(0, N, 20):
        s = x @ x[q]
        s[q] = -np.inf
        for place, i in enumerate(np.lexsort((np.arange(N), -s))[:10]):
            want[q, place + 1] = (i, s[i])
    assert {p: v[0] for p, v in got.items()} == {p: v[0] for p, v in want.items()}
    np.testing.assert_allclose([got[p][1] for p in want], [v[1] for v in want.values()], rtol=1e-9)
