"""Passages in documents agree with the SQL on texts that the given tables don't hold."""

import duckdb
import pytest

import __spark_entry__ as entry

SEVEN = "ein {} wort steht hier in der mitte"
TEXTS = {
    "sharp s": ("STRASSE", "straße"),
    "combining mark": ("cafe\u0301", "caf\u00e9"),
    "final sigma": ("ΟΔΟΣ", "οδοσ"),
    "other sigma": ("ΟΔΟΣ", "οδος"),
    "dotted capital": ("İki", "iki"),
    "vertical tab": ("a\x0bb", "a b"),
    "line ends": ("a\r\n\tb", "A  B"),
    "no-break space": ("a\u00a0b", "a b"),
}


@pytest.mark.parametrize("short", [False, True])
def test_agrees_with_sql(spark, tmp_path, short):
    pattern = "{}" if short else SEVEN
    docs = [(10 * i + j, f"vor {pattern.format(t)} nach") for i, pair in enumerate(TEXTS.values()) for j, t in enumerate(pair)]
    items = [(10 * i + j, around.format(pattern.format(t))) for i, pair in enumerate(TEXTS.values()) for j, t in enumerate(pair) for around in ("{}", "\u3000{}\u00a0 ")]
    docs += [(None, f"nur {pattern.format('hier')} ohne nummer"), (7, None), (8, ""), (8, pattern.format("doppelt")), (9, pattern.format("doppelt"))]
    items += [(900, pattern.format("hier")), (901, pattern.format("doppelt")), (902, " "), (903, None), (None, pattern.format("doppelt"))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got = entry.queries()["value_in_text"](spark, str(tmp_path)).select("item_id", "n_docs").collect()
    want = con.sql(f"SELECT item_id, n_docs FROM ({entry.oracle_sql()['value_in_text']})").fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert len(want) > len(TEXTS)
