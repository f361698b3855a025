"""Periodic runs: stretches of words that repeat a short passage several times over.

A run is a stretch of consecutive words with smallest period q and at least ``least_exponent`` times q words that no
neighbouring word extends. All runs of a text are found by string synchronising sets:

* Every passage of t words (t a power of two) has a hash, put together from the hashes of its halves. A position is
  chosen at scale t if its hash, or the one t places on, is the smallest of the t + 1 hashes between. Whether a position
  is chosen depends on the next 2t words alone, so a repeated passage has its chosen positions in the same places; at most
  t places lie between two chosen ones.
* Positions whose next t words have a period of t / 4 or less are never chosen: they would crowd the set. Such highly
  periodic regions are runs of smaller scales, known by then; periods of one to three words are found by comparing
  neighbours.
* A run with a period from t to 2t holds a chosen position and the same context of 2t words one period on, and none
  between. So consecutive chosen positions of equal context propose all periods of that scale; each proposal is extended
  both ways by doubling steps, and every run is compared word by word before it is returned.

The texts of a batch are searched as one row of words, longest text first and a sign of its own after each, so that a
scale reads only the front part, the texts long enough for it. Work is n log n words, and a text is never cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import appended, drop_outputs, map_arrow

RUN = StructType([StructField(n, LongType()) for n in ("start", "length", "period")])
#: Words that are searched together; a longer text is searched on its own.
WORDS_AT_ONCE = 1 << 18
#: The proof above needs four repeats.
LEAST_EXPONENT = 4
_NONE = np.iinfo(np.uint64).max


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers without visible order."""
    x = x.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _stretches(flags: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last places of the stretches of at least so many true flags."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).view(np.int8)))
    first, last = edges[0::2], edges[1::2]
    long = last - first >= least
    return first[long], last[long]


def _smallest(v: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours, by doubling."""
    out, have = v, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def _extended(hashes: list[np.ndarray], x: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretch around x whose words equal those one period on: its start, and the end of the run."""
    left, right = x.copy(), x.copy()
    for k in reversed(range(len(hashes))):
        h, w = hashes[k], 1 << k
        for ends, step in ((right, 0), (left, w)):
            at = ends - step
            ok = (at >= 0) & (at + period < len(h))
            ok[ok] = h[at[ok]] == h[at[ok] + period[ok]]
            ends += np.where(ok, -w if step else w, 0)
    return left, right + period


def _checked(words: np.ndarray, runs: np.ndarray, exponent: int) -> np.ndarray:
    """Runs that hold word by word; where hashes deceived, the real stretches of the period instead."""
    out = []
    for first, last, q in runs:
        same = words[first : last - q] == words[first + q : last]
        if same.all():
            out.append((first, last, q))
        else:
            out += [(first + a, first + b + q, q) for a, b in zip(*_stretches(same, (exponent - 1) * q), strict=True)]
    return np.array(out, np.int64).reshape(-1, 3)


def find_runs(words: np.ndarray, lengths: np.ndarray, exponent: int = LEAST_EXPONENT) -> np.ndarray:
    """(first, past the last, period) of all runs of texts of so many words, longest first, each followed by a number of its own."""
    ends = np.cumsum(lengths + 1)
    reach = lambda n: int(ends[np.searchsorted(-lengths, -n, side="right") - 1]) if len(lengths) and lengths[0] >= n else 0
    hashes = [_mixed(words + 1)]
    while 2 << (len(hashes) - 1) <= (lengths[0] if len(lengths) else 0):
        half, w = hashes[-1], 1 << (len(hashes) - 1)
        front = half[: max(0, reach(2 * w) - w)]
        hashes.append(_mixed(front[: max(0, len(front) - w)] * np.uint64(0x9E3779B97F4A7C15) + front[w:]))
    found = []
    for q in range(1, 4):  # neighbours compared
        first, last = _stretches(words[:-q] == words[q:], (exponent - 1) * q)
        found.append(np.stack([first, last + q, np.full(len(first), q)], 1))
    for k in range(2, len(hashes) - 1):
        t = 1 << k
        size = min(len(hashes[k]), reach(4 * t))
        if size <= t:
            break
        v = hashes[k][:size].copy()
        known = np.concatenate(found)
        dense = known[(known[:, 2] * 4 <= t) & (known[:, 1] - known[:, 0] >= t) & (known[:, 0] < size)]
        marks = np.zeros(size + 1, np.int64)
        np.add.at(marks, dense[:, 0], 1)
        np.add.at(marks, np.minimum(dense[:, 1] - t + 1, size), -1)
        v[np.cumsum(marks[:-1]) > 0] = _NONE
        low = _smallest(v, t + 1)
        chosen = np.flatnonzero((low != _NONE) & ((low == v[: len(low)]) | (low == v[t:])))
        context = hashes[k + 1]
        chosen = chosen[chosen < len(context)]
        order = np.argsort(context[chosen], kind="stable")
        at, kinds = chosen[order], context[chosen][order]
        gap = np.diff(at)
        pair = (kinds[1:] == kinds[:-1]) & (gap >= t) & (gap < 2 * t)
        x, period = at[:-1][pair], gap[pair]
        first, last = _extended(hashes, x, period)
        keep = last - first >= exponent * period
        found.append(np.unique(np.stack([first, last, period], 1)[keep], axis=0))
    runs = np.concatenate(found)
    # Where one stretch has several periods, the smallest is its period.
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    return _checked(words, runs[new], exponent)


def _search(texts: list[list[bytes]], least_length: int, exponent: int) -> list[tuple[np.ndarray, np.ndarray | None]]:
    """Of each text its runs (start, length, period) by start and period, and which words stay (None: all)."""
    order = np.argsort([-len(t) for t in texts], kind="stable")
    lengths = np.array([len(texts[i]) for i in order], np.int64)
    codes: dict[bytes, int] = {}
    number = codes.setdefault
    parts = []
    for place, i in enumerate(order):
        parts.append(np.array([number(w, len(codes)) for w in texts[i]], np.int64))
        parts.append(np.array([-2 - place], np.int64))
    words = np.concatenate(parts) if parts else np.empty(0, np.int64)
    runs = find_runs(words, lengths, exponent)
    runs = runs[runs[:, 1] - runs[:, 0] >= least_length]
    starts = np.cumsum(lengths + 1) - lengths - 1
    owner = np.searchsorted(starts, runs[:, 0], side="right") - 1
    out: list[tuple[np.ndarray, np.ndarray | None]] = [(np.empty((0, 3), np.int64), None)] * len(texts)
    for place in np.unique(owner):
        mine = runs[owner == place]
        first, last, q = mine[:, 0] - starts[place], mine[:, 1] - starts[place], mine[:, 2]
        marks = np.zeros(lengths[place] + 1, np.int64)
        np.add.at(marks, first + q, 1)
        np.add.at(marks, last, -1)
        rows = np.stack([first, last - first, q], 1)
        out[order[place]] = rows[np.lexsort((q, first))], np.cumsum(marks[:-1]) == 0
    return out


def collapse_runs(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    outputs: tuple[str, str] = ("runs", "collapsed"),
    least_length: int = 6,
    least_exponent: int = LEAST_EXPONENT,
    rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """Adds each text's runs (array of start, length, period in words, by start and period) and the text with every run cut
    down to its first period, words joined by one space.

    * Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text; null and empty texts have none: no runs and ''.
    * Rows are searched each on its own: repeated rows and null keys make no difference, an empty table stays empty.
      Columns of the caller pass through, but for those named as the outputs.
    * ``rewrite`` may put other words (as UTF-8) in the place of a row's, by its key.
    * ``least_exponent`` is a whole number from 4.
    """
    if least_exponent < LEAST_EXPONENT or least_exponent != int(least_exponent):
        raise ValueError(f"least_exponent must be a whole number from {LEAST_EXPONENT}")
    if not {text.lower(), key.lower()}.isdisjoint(n.lower() for n in outputs):
        raise ValueError("outputs must not be named as the key or the text")
    kept = drop_outputs(docs, *outputs)
    at_key, at_text = ([n.lower() for n in kept.columns].index(c.lower()) for c in (key, text))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, texts = b.column(at_key), b.column(at_text)
            begun, held, n = 0, [], 0
            for i in range(b.num_rows):
                raw = texts[i].as_buffer() if texts[i].is_valid else None
                words = raw.to_pybytes().split() if raw is not None else []
                if rewrite is not None:
                    words = rewrite(keys[i].as_py(), words)
                held.append(words)
                n += len(words)
                if n >= WORDS_AT_ONCE or i == b.num_rows - 1:
                    yield with_results(b.slice(begun, i + 1 - begun), held)
                    begun, held, n = i + 1, [], 0

    def with_results(rows: pa.RecordBatch, held: list[list[bytes]]) -> pa.RecordBatch:
        found = _search(held, least_length, least_exponent)
        offsets = np.cumsum([0, *[len(r) for r, _ in found]]).astype(np.int32)
        flat = np.concatenate([r for r, _ in found]).reshape(-1, 3)
        struct = pa.StructArray.from_arrays([pa.array(flat[:, j].copy()) for j in range(3)], ["start", "length", "period"])
        whole = (w if keep is None else [x for x, k in zip(w, keep.tolist(), strict=True) if k] for w, (_, keep) in zip(held, found, strict=True))
        collapsed = pa.array([b" ".join(w) for w in whole], pa.binary()).cast(pa.string(), safe=False)
        lists = pa.ListArray.from_arrays(pa.array(offsets), struct)
        return appended(rows, [lists, collapsed])

    return map_arrow(kept, search, dict(zip(outputs, (ArrayType(RUN), StringType()), strict=True)))
