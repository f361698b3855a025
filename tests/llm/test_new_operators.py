"""Decontamination, hard negatives and periodic runs, operators and queries, against brute force."""

import hashlib
import os
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docmeter.llm import decontamination, hard_negatives, periodic_runs, queries

SHAPE = "doc_id long, text string, items string, spans string, runs string, `a.b` string"
EXTRA = {"items": "i", "spans": "s", "runs": "r", "a.b": "d"}


def table(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(2).write.parquet(f"{tmp_path}/{name}.parquet")


# Benchmark decontamination.

ITEM = "What is the capital of the old kingdom, and who built its 3 walls? ÉTÉ über"
ITEMS = [(1, ITEM), (2, "short ONE"), (10, ITEM.lower() + " and more words"), (None, "nameless item here"), (3, None), (4, "?!"), (2, "another part of two")]
TEXTS = [
    "Before: what IS the capital\nof the old-kingdom and who built its 3 walls! ÉTÉ über, after", "what is the capital of the old kingdom and who", "", None, "   ",
    "a short one, short one short\tone", "x " * 20_000 + "short one " + ITEM + " y" * 20_000, "nameless item here, twice nameless item here", "shortone short ones", "été ÉTÉ",
    "🙂 another part of two 🙂 short one", ITEM + " " + ITEM,
]


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def hits(text, window=10):
    w, hit, named = words(text), set(), set()
    for name, item in ITEMS:
        v = words(item)
        for i in range(max(1, len(v) - window + 1) if v else 0):
            part = v[i : i + window]
            for j in range(len(w) - len(part) + 1):
                if w[j : j + len(part)] == part:
                    hit |= set(range(j, j + len(part)))
                    if name is not None:
                        named.add(str(name))
    return len(w), hit, sorted(named)


@pytest.mark.parametrize("block_bytes", [2_000_000, 120])
def test_decontamination(spark, block_bytes):
    docs = spark.createDataFrame([(i, t, *EXTRA.values()) for i, t in enumerate([*TEXTS, TEXTS[0]])] + [(None, TEXTS[0], *EXTRA.values())], SHAPE)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = decontamination.decontaminate(docs, items, block_bytes=block_bytes).collect()
    assert len(out) == len(TEXTS) + 2
    for r in out:
        n, hit, named = hits(r.text)
        assert (r.n_words, r.n_hit, r["items"]) == (n, len(hit), named)
        assert (r.runs, r["a.b"]) == ("r", "d")
        shown = [w for s in r.spans for w in words(r.text[s["start"] : s["end"]])]
        assert shown == [w for i, w in enumerate(words(r.text)) if i in hit]
    assert decontamination.decontaminate(docs.limit(0), items).count() == 0
    assert {r.n_hit for r in decontamination.decontaminate(docs, items.limit(0)).collect()} == {0}


def test_decontamination_of_questions_and_answers(spark):
    items = spark.createDataFrame([("q", "one two three", "four five")], "item_id string, question string, answer string")
    docs = spark.createDataFrame([(1, "one two three four"), (2, "three four five"), (3, "two three")], "doc_id int, text string")
    out = decontamination.decontaminate(docs, items, parts=("question", "answer")).collect()
    assert {r.doc_id: r.n_hit for r in out} == {1: 3, 2: 2, 3: 0}


def test_decontamination_query_and_sql(spark, tmp_path):
    table(spark, tmp_path, "documents", [(i, t) for i, t in enumerate([*TEXTS, TEXTS[5]])] + [(5, TEXTS[5])], "doc_id long, text string")
    table(spark, tmp_path, "benchmark", ITEMS, "item_id long, text string")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    found = con.sql(queries.OP11_SQL)
    mine = queries.op11_decontamination(spark, str(tmp_path)).select(*found.columns).collect()
    assert sorted(map(tuple, mine)) == sorted(found.fetchall())


# Hard negatives.


def negatives(rows, is_anchor, k=5, percent=(80, 100)):
    best: dict = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            best[i] = min(best.get(i, (str(label), list(v))), (str(label), list(v)))
    dot = lambda a, b: float(sum(x * y for x, y in zip(a, b, strict=False)))
    out = set()
    for a, (label, v) in best.items():
        if not is_anchor(a):
            continue
        scored = [(-dot(v, w), i, other) for i, (other, w) in best.items() if i != a]
        for p, i, _ in sorted(s for s in scored if s[2] == label)[:k]:
            fits = sorted(s for s in scored if s[2] != label and percent[0] * -p <= 100 * -s[0] <= percent[1] * -p)[:k]
            out |= {(a, i, r, j, -p, -s) for r, (s, j, _) in enumerate(fits, 1)}
    return out


def vectors(seed, n=900, d=6, clusters=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, d)) * 40
    rows = [(int(i), int(rng.integers(4)), [float(x) for x in np.floor(centres[rng.integers(clusters)] + rng.normal(size=d) * 5)]) for i in range(n)]
    rows += [(n + i, i % 3, rows[7][2]) for i in range(300)]  # a hot vector
    rows += [rows[3], (5, 0, rows[9][2]), (None, 1, rows[0][2]), (n + 301, None, rows[0][2]), (n + 302, 1, None), (n + 303, 1, [float("nan")] * d), (n + 304, 1, [1.0, None])]
    return rows + [(n + 310, 1, [0.0] * d), (n + 311, 1, []), (n + 320, 2, [50.0, -20.0]), (n + 321, 2, [30.0] * (d + 2)), (n + 305, 1, [float("inf")] * d)]


@pytest.mark.parametrize("s", [hard_negatives.Settings(), hard_negatives.Settings(sample=200, leaf=20, fanout=4, bin=64, lot=8)])
def test_hard_negatives(spark, s):
    rows = vectors(3)
    docs = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(5)
    out = hard_negatives.hard_negatives(docs, lambda key: key % 10 == 0, settings=s).collect()
    assert len(out) == len(set(map(tuple, out)))
    assert set(map(tuple, out)) == negatives(rows, lambda i: i % 10 == 0)
    assert hard_negatives.hard_negatives(docs.limit(0), lambda key: key % 10 == 0).count() == 0
    assert hard_negatives.hard_negatives(docs, lambda key: key < 0).count() == 0


def test_tree_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(40, 8)) * 9)[rng.integers(40, size=3000)] + rng.normal(size=(3000, 8))
    length = float(np.sqrt((x**2).sum(1).max()))
    tree = hard_negatives.fit(x[:600], length, 64, hard_negatives.Settings(fanout=8))
    seen: dict = {}
    leaf = hard_negatives.descend(tree, x, seen)
    for number, node in enumerate(tree.nodes):
        k = len(node.child)
        node.low = np.stack([seen[number, j][0] if (number, j) in seen else np.full(k, np.inf) for j in range(k)])
        node.high = np.stack([seen[number, j][1] if (number, j) in seen else np.full(k, -1.0) for j in range(k)])
    low, high = hard_negatives.bounds(tree, x[:50])
    scores = x[:50] @ x.T
    for q in range(50):
        assert (scores[q] >= low[q][leaf]).all() and (scores[q] <= high[q][leaf]).all()
    # An annulus around the best fifth of a clustered table leaves most leaves out.
    edge = np.sort(scores, axis=1)[:, -5]
    assert (high >= edge[:, None]).mean() < 0.5


def test_hard_negatives_query_and_sql(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, int(rng.integers(10)), [float(x) for x in rng.normal(size=5).astype(np.float32)]) for i in range(700)]
    table(spark, tmp_path, "embeddings", rows + [(700, 1, None), (800, None, rows[0][2]), (900, 2, [float("inf")] * 5)], "vec_id long, label int, embedding array<float>")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    found = con.sql(queries.OP12_SQL)
    mine = queries.op12_hard_negatives(spark, str(tmp_path)).select(*found.columns).collect()
    assert len(mine) > 50 and sorted(map(tuple, mine)) == sorted(found.fetchall())


# Periodic runs.


def brute_runs(w, least=6, exponent=4):
    out = []
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(least, exponent * q) and not any(w[i + p : j + q] == w[i : j + q - p] for p in range(1, q)):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [x for i, x in enumerate(w) if i not in gone]


piece = st.lists(st.sampled_from("abc"), min_size=1, max_size=24)
repeated = st.tuples(piece, st.integers(1, 9), st.integers(0, 23)).map(lambda t: t[0] * t[1] + t[0][: t[2]])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.one_of(piece, repeated), max_size=5).map(lambda parts: [x for p in parts for x in p]), min_size=1, max_size=4))
def test_runs_are_those_of_brute_force(texts):
    found = periodic_runs._search([[x.encode() for x in t] for t in texts], 6, 4)
    for t, (runs, keep) in zip(texts, found, strict=True):
        want = brute_runs(t)
        assert list(map(tuple, runs.tolist())) == want
        assert [x for i, x in enumerate(t) if keep is None or keep[i]] == collapsed(t, want)


def test_runs_of_long_texts():
    rng = np.random.default_rng(4)
    noise = [b"%d" % i for i in rng.integers(0, 400, 60_000)]
    long = noise[:30_000] + noise[:7_001] * 5 + noise[30_000:]
    (runs, _), (same, _), (none, _) = periodic_runs._search([long, [b"x"] * 100_000, noise], 6, 4)
    assert (30_000, 35_005, 7_001) in {tuple(r) for r in runs.tolist()} or any(r[2] == 7_001 and r[0] <= 30_000 for r in runs.tolist())
    assert same.tolist() == [[0, 100_000, 1]] and len(none) == 0


def test_deceived_hashes_are_found_out():
    words = np.array([1, 2, 1, 2, 1, 2, 1, 2, 9, 9])
    assert periodic_runs._checked(words, np.array([[0, 10, 2]]), 4).tolist() == [[0, 8, 2]]


PERIODIC = [None, "", " \t\n", "one", "a b " * 30, "x " * 5, "x " * 6, "la la la la", "p q r " * 4 + "p", "u v w " + "ab cd ef gh " * 12 + "end", "é ü x\n" * 9, " ".join(map(str, range(500)))]


def test_runs_operator(spark):
    docs = spark.createDataFrame([(i, t, *EXTRA.values()) for i, t in enumerate([*PERIODIC, PERIODIC[4]])] + [(None, PERIODIC[4], *EXTRA.values())], SHAPE)
    out = periodic_runs.collapse_runs(docs).collect()
    assert len(out) == len(PERIODIC) + 2
    for r in out:
        w = re.findall("[^\x20\x09-\x0d]+", r.text or "")
        runs = brute_runs(w)
        assert [(x.start, x.length, x.period) for x in r.runs] == runs and r.collapsed == " ".join(collapsed(w, runs))
        assert (r["items"], r["a.b"]) == ("i", "d")
    assert periodic_runs.collapse_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.collapse_runs(docs, least_exponent=3)
    with pytest.raises(ValueError):
        periodic_runs.collapse_runs(docs, outputs=("TEXT", "x"))


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def check_runs(rows, texts):
    for r in rows:
        w = re.findall("[^\x20\x09-\x0d]+", texts[r.doc_id] or "")
        h, n = zlib.crc32(str(r.doc_id).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(w)
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r.runs_sha256 == digest("".join(f"{s},{x},{q}\n" for s, x, q in runs))
        assert r.collapsed_sha256 == digest(" ".join(collapsed(w, runs)))


def test_runs_query(spark, tmp_path):
    texts = {i: PERIODIC[i % len(PERIODIC)] for i in range(80)} | {80 + i: " ".join(f"w{j % 17}" for j in range(i * 3)) for i in range(40)}
    table(spark, tmp_path, "documents", list(texts.items()), "doc_id long, text string")
    check_runs(queries.op13_periodic_runs(spark, str(tmp_path)).collect(), texts)


def test_runs_query_on_given_documents(spark, data):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    short = {k: t for k, t in texts.items() if t is None or len(t) < 6_000}
    rows = [r for r in queries.op13_periodic_runs(spark, data).collect() if r.doc_id in short]
    assert len(rows) > 100 and os.path.exists(data)
    check_runs(rows, short)
