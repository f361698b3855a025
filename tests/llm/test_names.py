"""Columns of the caller that are named as the operators' own stay as they are; empty tables stay empty."""

import public_tokenizers
import pytest

import corpus_pipeline
from docmeter.llm import bpe, language_id, line_dedup, linking, mixing, sharding, toxicity
from docmeter.llm.queries import RANK_FILE

EXTRA = {"_text": "t", "_bucket": "7", "_order": "8", "copies": "c", "n_lines": "l", "score": "mine", "_k": "k", "found": "f", "row": "r", "a.b": "d"}
SHAPE = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in EXTRA)
TEXTS = ["one two three four five six seven", "uno dos tres", None, "", "½ ²", "one two three four five six seven\neight nine"]


@pytest.fixture(scope="module")
def named(spark):
    return spark.createDataFrame([(i, t, "en", f"s{i % 2}", *EXTRA.values()) for i, t in enumerate(TEXTS)], SHAPE).cache()


def kept(out, columns=EXTRA):
    for r in out.collect():
        assert {c: r[c] for c in columns} == {c: EXTRA[c] for c in columns}


def test_operators(spark, named):
    ranks, pattern = public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN
    kept(sharding.shard_rows(named, 3))
    kept(bpe.encode_decode(named, ranks, pattern))
    kept(bpe.decode(bpe.encode(named, ranks, pattern), ranks, pattern))
    found = language_id.identify(named, language_id.learn(named))
    kept(found, [c for c in EXTRA if c != "score"])
    assert {r.doc_id for r in found.where("lang_pred = 'und'").collect()} == {2, 3, 4}
    index = toxicity.learn(named, spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int"))
    kept(toxicity.classify(named, index, outputs=("p", "q", "e")))
    kept(mixing.mix(named))
    kept(line_dedup.dedup_lines(named))


def test_encode_decode_is_encode_then_decode(named):
    ranks, pattern = public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN
    rows = lambda x: sorted((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in x.collect())
    assert rows(bpe.encode_decode(named, ranks, pattern)) == rows(bpe.decode(bpe.encode(named, ranks, pattern), ranks, pattern))


def test_stages(spark, data, named):
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, named, data)
        assert out.columns == named.columns
        kept(out)
        assert stage(spark, named.limit(0), data).count() == 0
    assert corpus_pipeline.STAGES[4][1](spark, named.limit(0), data).count() == 0


def test_signatures_never_lose_a_pair():
    import numpy as np

    rng, rule = np.random.default_rng(5), linking.Rule(80, False, 256)
    for _ in range(200):
        x = np.unique(rng.integers(0, 1 << 62, 300).astype(np.uint64))
        y = np.unique(np.concatenate([x[: rng.integers(1, 300)], rng.integers(0, 1 << 62, rng.integers(1, 200)).astype(np.uint64)]))
        s = [rule.sign(z, np.zeros(len(z)), 1)[0].view(np.uint64) for z in (x, y)]
        differ = int(np.bitwise_count(s[0] ^ s[1]).sum())
        both, union = linking.overlap_of_hashes(x, y)
        assert both == len(np.intersect1d(x, y)) and differ <= union - both


def test_large_group_of_near_copies(spark):
    """More than BLOCK variants of a text, few of which link with each other: components as by brute force."""
    import random

    from docmeter.llm import jaccard_join

    rng, base = random.Random(3), [f"w{i}" for i in range(120)]
    texts = []
    for i in range(1300):
        w = list(base)
        for at in rng.sample(range(120), rng.choice([1, 2, 3, 4, 5])):
            w[at] = f"x{rng.randrange(400)}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs).collect()}
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in map(str.split, texts)]
    number: dict = {}
    bits = [sum(1 << number.setdefault(g, len(number)) for g in s) for s in sets]
    root = list(range(len(sets)))

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = (bits[i] & bits[j]).bit_count()
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    assert got == {i: top(i) for i in range(len(sets))}
