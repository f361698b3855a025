"""Benchmark decontamination: passages of test questions and answers found in documents.

Each item is cut into windows of consecutive words. All windows, normalised, make one Aho-Corasick automaton, which reads
each normalised document once and reports every window that ends at each place. Matches are mapped back to words and to
offsets of the original text.

Normalising keeps one byte a byte: A-Z become small, whatever is no word becomes a space. Words are then joined by single
spaces, with one at either end, so that a match of characters is a match of whole words.

The automaton goes to every task, so the windows are dealt into blocks of bounded size: a benchmark that fits into one
block, as all common ones do, costs one pass over the documents, a larger one a pass a block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import appended, col, drop_outputs, fresh, map_arrow, materialize

SPAN = StructType([StructField(n, LongType()) for n in ("start", "end")])
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_NORMAL = bytes(ord(chr(b).lower()) if chr(b).isalnum() else 0x20 for b in range(0x80)) + bytes(range(0x80, 0x100))


def words_of(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a UTF-8 text after A-Z became small."""
    return text.translate(_NORMAL).split()


Block = tuple[list[bytes], list[list[int]], list[str | None]]


def _blocks(items: DataFrame, parts: Sequence[str], item: str, window: int, block_bytes: int) -> Iterator[Block]:
    """Windows, the items of each, and the items' names, so many bytes at a time; the driver holds one block and one partition of items."""
    numbers: dict[bytes, set[int]] = {}
    names: list[str | None] = []
    size = 0
    for row in items.select(col(item).cast("string").alias("item"), *[F.encode(col(p), "UTF-8").alias(f"p{i}") for i, p in enumerate(parts)]).toLocalIterator():
        names.append(row["item"])
        for part in row[1:]:
            words = words_of(bytes(part)) if part is not None else []
            for i in range(max(1, len(words) - window + 1) if words else 0):
                key = b" ".join(words[i : i + window])
                if key not in numbers:
                    size += len(key) + 2
                numbers.setdefault(key, set()).add(len(names) - 1)
                if size >= block_bytes:
                    yield [*numbers], [sorted(s) for s in numbers.values()], names
                    numbers, names, size = {}, [row["item"]], 0
    if numbers:
        yield [*numbers], [sorted(s) for s in numbers.values()], names


@lru_cache(maxsize=1)
def _automaton(windows: tuple[bytes, ...]) -> ahocorasick.Automaton:
    """One a Python worker and block."""
    found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, key in enumerate(windows):
        found.add_word(f" {key.decode('latin-1')} ", i)
    found.make_automaton()
    return found


def _merged(spans: np.ndarray) -> np.ndarray:
    """Stretches (first, past the last) that cover what the spans cover; touching ones are one."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    return np.stack([spans[new, 0], reach[np.append(np.flatnonzero(new)[1:] - 1, len(spans) - 1)]], 1)


def _offsets(text: bytes, spans: np.ndarray) -> list[dict[str, int]]:
    """Spans of words as spans of characters (code points) of the text as it was."""
    edges = np.array([m.span() for m in _WORD.finditer(text)], np.int64)
    begins = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    at = np.concatenate([[0], begins])
    return [{"start": int(at[edges[a, 0]]), "end": int(at[edges[b - 1, 1]])} for a, b in spans]


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item: str = "item_id",
    parts: Sequence[str] = ("text",),
    window: int = 10,
    outputs: tuple[str, str, str, str] = ("n_words", "n_hit", "items", "spans"),
    block_bytes: int = 2_000_000,
) -> DataFrame:
    """Adds each document's number of words, how many of them stand in a window of an item, the items (as strings, sorted) with
    such windows, and the hit stretches of the original text (code points, end exclusive).

    * A window is ``window`` consecutive words of one of an item's ``parts`` (question, answer); a part of fewer words, but
      not none, is one window. Overlapping and touching hits make one stretch.
    * Null and empty texts have no words and no hits; null parts no windows. Items with equal names are one; an item without
      a name hits words but is not listed. Without items nothing is hit.
    * Rows are searched each on its own, whole, so that repeated rows and null keys make no difference. Columns of the caller
      pass through, but for those named as the outputs; the text must not be one of these.
    """
    if text.lower() in {n.lower() for n in outputs}:
        raise ValueError("outputs must not be named as the text")
    spark = docs.sparkSession
    kept = drop_outputs(docs, *outputs)
    names = kept.columns
    at_text = [n.lower() for n in names].index(text.lower())
    listed, placed, more, at = fresh(kept, "_items", "_placed", "_more", "_at")

    def passed(rows: DataFrame, block: Block, last: bool) -> DataFrame:
        shared = spark.sparkContext.broadcast((tuple(block[0]), [[block[2][i] for i in held if block[2][i] is not None] for held in block[1]]))
        again = rows.columns != names

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows, owners = shared.value
            lengths = [w.count(b" ") + 1 for w in windows]
            find = _automaton(windows).iter if windows else lambda s: ()
            for b in batches:
                n_words, found_items, found_spans = [], [], []
                before = (b.column(len(names)).to_pylist(), b.column(len(names) + 1).to_pylist()) if again else None
                for i, value in enumerate(b.column(at_text)):
                    raw = value.as_buffer().to_pybytes() if value.is_valid else b""
                    words = words_of(raw)
                    n_words.append(len(words))
                    line = b"".join((b" ", b" ".join(words), b" "))
                    hits = [*find(line.decode("latin-1"))]
                    mine = {o for _, w in hits for o in owners[w]}
                    spans = np.empty((0, 2), np.int64)
                    if hits:
                        ends = np.searchsorted(np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20), [e for e, _ in hits])
                        spans = np.stack([ends - [lengths[w] for _, w in hits], ends], 1)
                    if before:
                        mine.update(before[0][i])
                        spans = np.concatenate([spans, np.array(before[1][i], np.int64).reshape(-1, 2)])
                    spans = _merged(spans) if len(spans) else spans
                    found_items.append(sorted(mine))
                    found_spans.append((spans, raw))
                texts = pa.array(found_items, pa.list_(pa.string()))
                if not last:
                    places = pa.array([s.ravel().tolist() for s, _ in found_spans], pa.list_(pa.int64()))
                    yield appended(b, [texts, places])
                    continue
                hit = pa.array([int((s[:, 1] - s[:, 0]).sum()) for s, _ in found_spans], pa.int64())
                shown = pa.array([_offsets(raw, s) if len(s) else [] for s, raw in found_spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                yield appended(b, [pa.array(n_words, pa.int64()), hit, texts, shown])

        added = dict(zip(outputs, (LongType(), LongType(), ArrayType(StringType()), ArrayType(SPAN)), strict=True))
        if last:
            return map_arrow(rows, search, added).select(*map(col, names), *map(col, outputs))
        found = map_arrow(rows, search, {more: ArrayType(StringType()), at: ArrayType(LongType())})
        return found.select(*map(col, names), F.col(more).alias(listed), F.col(at).alias(placed))

    out, current = kept, None
    for block in _blocks(items, parts, item, window, block_bytes):
        if current is not None:
            out = materialize(passed(out, current, False), "decontamination")
        current = block
    return passed(out, current or ([], [], []), True)
