"""The pipeline's stages, each against brute force on its own input."""

from collections import Counter, defaultdict

import corpus_pipeline
from docmeter.llm import line_dedup, mixing


def words(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_stages(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    tables = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], data).write.parquet(str(tmp_path / str(i)))
        tables.append(spark.read.parquet(str(tmp_path / str(i))))
    rows = [{r.doc_id: r for r in t.collect()} for t in tables[:4]]
    assert all(t.columns == docs.columns for t in tables[:5])

    # toxicity: rows are as they were; toxic ones go, clean ones stay
    assert all(rows[0][i] == r for i, r in rows[1].items())
    clean = [i for i, y in labels.items() if y == 0]
    assert sum(i in rows[1] for i in clean) >= 0.97 * len(clean)
    assert sum(i in rows[1] for i, y in labels.items() if y == 1) < 0.7 * sum(labels.values())

    # lines: each near-equal line is left once
    sets = {x: frozenset(x[i : i + 5] for i in range(max(1, len(x) - 4))) for r in rows[2].values() for _, x in line_dedup._lines(r.text)}
    count = Counter(x for r in rows[2].values() for _, x in line_dedup._lines(r.text))
    assert max(count.values()) == 1
    by_shingle = defaultdict(set)
    for x, s in sets.items():
        for g in s:
            by_shingle[g].add(x)
    for x, s in list(sets.items())[::5]:
        for y in set().union(*(by_shingle[g] for g in list(s)[:3])) - {x}:
            assert 100 * len(s & sets[y]) < 80 * len(s | sets[y]) or len(s) < 8
    assert all(rows[1][i].source == r.source and len(r.text) <= len(rows[1][i].text) for i, r in rows[2].items())

    # near copies: one of each group stays
    s = {i: words(r.text) for i, r in rows[2].items()}
    linked = {i: {j for j in s if i != j and s[i] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j])} for i in s}
    for i in s:
        group, todo = {i}, [i]
        while todo:
            more = linked[todo.pop()] - group
            group |= more
            todo += more
        assert (i in rows[3]) == (i == min(group)) and (i not in rows[3] or rows[3][i] == rows[2][i])

    # mixing: copies as expected; then tokens of every row
    sized = tables[3].withColumn("size", mixing.word_count())
    want = {r.doc_id: r.copies for r in mixing.expected_copies(sized).collect() if r.copies}
    assert Counter(r.doc_id for r in tables[4].collect()) == Counter(want)
    assert tables[5].count() == tables[4].count()


def test_jaccard_stage_keeps_one_row_of_each_component(spark, data):
    text = lambda c: " ".join(f"{c}{i}" for i in range(40))
    rows = [(1, text("a")), (2, text("a")), (2, text("b")), (3, text("c")), (3, text("c")), (None, text("d")), (None, text("d") + " more"), (None, text("e")), (5, text("e")), (6, None), (7, ""), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.jaccard_stage(spark, docs, data).collect())
    some = [k for k in got if k[0] is None]
    assert len(some) == 1 and some[0][1].startswith("d0 ") and got[some[0]] == 1
    del got[some[0]]
    assert got == Counter([(1, text("a")), (2, text("b")), (3, text("c")), (5, text("e")), (6, None), (7, ""), (8, "")])


def test_run(spark, data):
    assert corpus_pipeline.run(spark, data).count() > 0
